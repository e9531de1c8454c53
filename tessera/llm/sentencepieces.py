"""SentencePiece encoding and decoding: segmentations are sampled from the lattice
of pieces, forward-filtering and backward-sampling.

Each piece has a probability that falls with its rank in the model's vocabulary;
a character that no piece holds is spelt in byte pieces. No piece has a space
after another character, so a text's lattice falls into words with their leading
spaces, and a path's probability is the product over these. Forward sums are made
once for each distinct word of a batch; each occurrence then draws its own path
backwards, with numbers that follow from the seed, the row's key and the place,
so a segmentation is the same whenever it is made. Decoding joins the pieces'
bytes, and gives the text back exactly: a literal U+2581 is spelt in bytes.

A word of over LONG characters is first cut where no piece crosses, which leaves its
paths and their chances as they are. Where that leaves over LONGEST characters in
one, forward sums are kept a character, and the lattice is made anew, BLOCK
characters at a time, as the path is drawn, so memory stays bounded.

The model's path is a parameter; the driver reads it and sends the pieces (some
hundred kB). Defined results: null text gives no pieces and decodes to an empty
text; words of any length are sampled whole; equal rows get equal pieces; a null id is seeded as the text 'null'; an empty table
gives none; further columns are ignored by the queries.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, id_and_text, mix, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, SPACE, SPELT = 17, 0x2581, 0x110000
LONG, STRETCH, LONGEST, BLOCK = 128, 32, 2048, 1 << 15
UNIT = re.compile(r" *[^ ]+| +")
TURN = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 18
FLATTEN = 10.0  # ranks below this hardly differ


class Pieces:
    """The vocabulary: pieces and their beginnings by hash, their log-probabilities and bytes."""

    def __init__(self, names: list[str], plain: list[bool], byte_ids: list[int]):
        known = [(n, k) for k, (n, p) in enumerate(zip(names, plain, strict=True)) if p]
        if any(chr(SPACE) in n.lstrip(chr(SPACE)) for n, _ in known):
            raise ValueError("a piece has a space after another character")
        self.longest = max(len(n) for n, _ in known)
        self.byte_ids = np.array(byte_ids)
        first = min(k for _, k in known)
        weight = 1 / (np.array([k - first for _, k in known]) + FLATTEN)
        logs = np.log(weight / weight.sum())
        starts = {n[:k]: (-1, -np.inf) for n, _ in known for k in range(1, len(n) + 1)}
        starts |= {n: (k, log) for (n, k), log in zip(known, logs.tolist(), strict=True)}
        hashes = np.array([self._hash(n) for n in starts], np.uint64)
        self.ids, self.logs = np.array([k for k, _ in starts.values()], np.int32), np.array([x for _, x in starts.values()], np.float32)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        by = np.argsort(slot, kind="stable")
        nth = np.arange(len(by)) - np.searchsorted(slot[by], slot[by])
        self.slots, self.entry = np.zeros((1 << SLOT_BITS, int(nth.max()) + 1), np.uint64), np.zeros((1 << SLOT_BITS, int(nth.max()) + 1), np.int32)
        self.slots[slot[by], nth], self.entry[slot[by], nth] = hashes[by], by
        self.byte_log = float(logs.min()) - 3.0
        self.bytes = [b""] * len(names)
        for n, k in known:
            self.bytes[k] = n.replace(chr(SPACE), " ").encode()
        for b, k in enumerate(byte_ids):
            self.bytes[k] = bytes([b])

    @staticmethod
    def _hash(name: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in name:
            h = mix(h + np.array([ord(c) + 1], np.uint64) * TURN)
        return h[0]

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length (rows of codes): at each end and for each piece
        length, the chance that the last piece is no longer, and that piece's id;
        an id below 0 spells the character."""
        n, size = codes.shape
        most = min(size, self.longest)
        logs, ids = np.full((n, size, most), -np.inf, np.float32), np.full((n, size, most), -1, np.int32)
        for start in range(size):
            row, h = np.arange(n), np.zeros(n, np.uint64)
            for k in range(min(most, size - start)):  # rows drop out where no piece goes on
                h = mix(h + (codes[row, start + k] + np.uint64(1)) * TURN)
                slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                same = self.slots[slot] == h[:, None]
                going = same.any(1)
                row, h = row[going], h[going]
                if not len(row):
                    break
                entry = self.entry[slot[going], same[going].argmax(1)]
                logs[row, start + k, k], ids[row, start + k, k] = self.logs[entry], self.ids[entry]
        spelt = ~np.isfinite(logs[:, :, 0])
        logs[:, :, 0][spelt] = self.byte_log
        forward = np.zeros((n, size + 1))
        chances = np.zeros((n, size, most), np.float32)
        for end in range(size):
            k = min(most, end + 1)
            ways = logs[:, end, :k] + forward[:, end - np.arange(k)]
            top = ways.max(1)
            total = np.log(np.exp(ways - top[:, None]).sum(1)) + top
            forward[:, end + 1] = total
            chances[:, end, :k] = np.cumsum(np.exp(ways - total[:, None]), 1)
            chances[:, end, k - 1 :] = 2.0
        return chances, ids


    def starting(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For each start from low to high of one word and each piece length, the log
        probability of that piece (none: -inf) and its id, below 0 for a spelt character."""
        n = high - low
        logs, ids = np.full((n, self.longest), -np.inf, np.float32), np.full((n, self.longest), -1, np.int32)
        row, h = np.arange(n), np.zeros(n, np.uint64)
        for k in range(self.longest):
            inside = row + low + k < len(codes)
            row, h = row[inside], h[inside]
            h = mix(h + (codes[row + low + k] + np.uint64(1)) * TURN)
            slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            same = self.slots[slot] == h[:, None]
            going = same.any(1)
            row, h = row[going], h[going]
            if not len(row):
                break
            entry = self.entry[slot[going], same[going].argmax(1)]
            logs[row, k], ids[row, k] = self.logs[entry], self.ids[entry]
        spelt = ~np.isfinite(logs[:, 0])
        logs[spelt, 0] = self.byte_log
        return logs, ids

    def cuts(self, codes: np.ndarray) -> list[int]:
        """Places in a word that no piece crosses, STRETCH and more apart, with both ends."""
        out, far = [0], 0
        for low in range(0, len(codes), BLOCK):
            high = min(len(codes), low + BLOCK)
            logs, _ = self.starting(codes, low, high)
            ends = np.arange(low, high) + self.longest - np.isfinite(logs[:, ::-1]).argmax(1)
            ends = np.maximum(np.maximum.accumulate(ends), far)
            before = np.concatenate(([far], ends[:-1]))  # how far pieces that start before each place go
            for at in (np.flatnonzero(before <= np.arange(low, high)) + low).tolist():
                if at - out[-1] >= STRETCH:
                    out.append(at)
            far = int(ends[-1])
        return [*out, len(codes)] if len(codes) - out[-1] else out

    def forward(self, codes: np.ndarray) -> np.ndarray:
        """The log of the summed chances of all paths to each place of a word."""
        out = [0.0] + [-math.inf] * len(codes)
        for low in range(0, len(codes), BLOCK):
            logs, _ = self.starting(codes, low, min(len(codes), low + BLOCK))
            row, k = np.nonzero(np.isfinite(logs))
            for start, end, log in zip((row + low).tolist(), (row + k + low + 1).tolist(), logs[row, k].tolist(), strict=True):
                a, b = out[end], out[start] + log
                if a < b:
                    a, b = b, a
                out[end] = a + math.log1p(math.exp(b - a))
        return np.array(out)

    def draw(self, codes: np.ndarray, forward: np.ndarray, seed: int, place: int) -> tuple[np.ndarray, np.ndarray]:
        """A path drawn backwards: where its pieces start, and their ids."""
        at, low, high, step, starts, found = len(codes), 0, 0, 0, [], []
        while at > 0:
            if not high or at - self.longest < low and low > 0:
                low, high = max(0, at - BLOCK), at
                logs, ids = self.starting(codes, low, high)
            k = np.arange(min(self.longest, at - low))
            ways = np.exp(logs[at - 1 - low - k, k] + forward[at - 1 - k] - forward[at])
            chance = np.cumsum(ways)
            pick = int((chance[:-1] < chance[-1] * _uniform(np.array([seed], np.uint64), np.array([place]), step)[0]).sum())
            at -= pick + 1
            starts.append(at)
            found.append(int(ids[at - low, pick]))
            step += 1
        return np.array(starts, np.int64), np.array(found, np.int64)


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)) for k in range(n)]
    return Pieces([sp.id_to_piece(k) for k in range(n)], plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def seed_of(key, seed: int = SEED) -> int:
    return xxhash.xxh3_64_intdigest("null" if key is None else str(key), seed)


def _uniform(seeds: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    h = mix(seeds + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(step * 0x2545F4914F6CDD1D % (1 << 64)))
    return ((h >> np.uint64(40)).astype(np.float64) + 0.5) / (1 << 24)


def _codes(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a space as the pieces write it."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.uint64)
    return np.where(codes == SPACE, np.uint64(SPELT + SPACE), np.where(codes == 32, np.uint64(SPACE), codes))


def units(text: str, pieces: Pieces) -> list[str]:
    """The words of a text with their leading spaces; a long one in the parts that no piece crosses."""
    found = UNIT.findall(text)
    if max(map(len, found), default=0) <= LONG:
        return found
    out = []
    for u in found:
        cuts = pieces.cuts(_codes([u], len(u))[0]) if len(u) > LONG else [0, len(u)]
        out += [u[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def encode(texts: list[str | None], seeds: list[int], pieces: Pieces) -> list[np.ndarray]:
    """Piece ids of each text, sampled with the row's seed."""
    lists = [units(t, pieces) if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists])
    words: dict[str, int] = {}
    kinds = np.array([words.setdefault(w, len(words)) for x in lists for w in x], np.int64)
    if not len(kinds):
        return [np.zeros(0, np.int32) for _ in texts]
    seed = np.repeat(np.array(seeds, np.uint64), sizes)
    place = np.arange(len(kinds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    names = sorted(words, key=len)
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    rank = np.empty(len(names), np.int64)
    rank[np.fromiter(map(words.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
    kinds = rank[kinds]
    by_kind = np.argsort(kinds, kind="stable")
    first = np.searchsorted(kinds[by_kind], np.arange(len(names) + 1))
    got_at, got_id, span = [], [], int(lengths[-1]) + 1
    for size in np.unique(lengths).tolist():
        low, high = np.searchsorted(lengths, [size, size + 1]).tolist()
        if size > LONGEST:
            for a in range(low, high):
                codes = _codes([names[a]], size)[0]
                forward = pieces.forward(codes)
                for here in by_kind[first[a] : first[a + 1]].tolist():
                    at, found = pieces.draw(codes, forward, int(seed[here]), int(place[here]))
                    got_at.append(here * span + at)
                    got_id.append(_spelt(found, codes, at))
            continue
        step_by = max(1, 60_000 // size)
        for a in range(low, high, step_by):
            b = min(high, a + step_by)
            codes = _codes(names[a:b], size)
            chances, ids = pieces.lattice(codes)
            here = by_kind[first[a] : first[b]]
            rows, at = kinds[here] - a, np.full(len(here), size)
            step = 0
            while len(here):
                u = _uniform(seed[here], place[here], step)
                k = (chances[rows, at - 1] < u[:, None]).sum(1)
                found = ids[rows, at - 1, k].astype(np.int64)
                at = at - k - 1
                got_at.append(here * span + at)
                got_id.append(_spelt(found, codes, (rows, at)))
                going = at > 0
                here, rows, at, step = here[going], rows[going], at[going], step + 1
    at, found = np.concatenate(got_at), np.concatenate(got_id)
    by = np.argsort(at)
    at, found = at[by] // span, found[by]
    text_of = np.repeat(np.arange(len(texts)), sizes)[at]
    if (found < 0).any():
        found, text_of = _spell(found, text_of, pieces)
    return np.split(found.astype(np.int32), np.searchsorted(text_of, np.arange(1, len(texts))))


def _spelt(found: np.ndarray, codes: np.ndarray, at) -> np.ndarray:
    """Ids, with -1 - code point for a character that is to be spelt."""
    spelt = found < 0
    if spelt.any():
        c = codes[at][spelt].astype(np.int64)
        found[spelt] = -1 - np.where(c == SPACE, 32, np.where(c >= SPELT, c - SPELT, c))
    return found


def _spell(found: np.ndarray, text_of: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Characters given as -1 - code point become the pieces of their bytes."""
    spelt = np.flatnonzero(found < 0)
    raw = [chr(-1 - int(c)).encode() for c in found[spelt]]
    count = np.ones(len(found), np.int64)
    count[spelt] = [len(r) for r in raw]
    out = np.repeat(found, count)
    out[out < 0] = pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.repeat(text_of, count)


def decode(ids, pieces: Pieces) -> bytes:
    return b"".join(map(pieces.bytes.__getitem__, ids))


def encoded(docs: DataFrame, path: str = MODEL, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `pieces`, an array of ids, of each row; doc_id seeds."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))
    names = [*keep, *({"doc_id", "text"} - set(keep))]
    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep), "pieces array<int>"])

    def each(batch):
        seeds = [seed_of(k, seed) for k in batch.column("doc_id").to_pylist()]
        return {n: batch.column(n) for n in keep} | {"pieces": encode(batch.column("text").to_pylist(), seeds, sent.value)}

    return arrow_map(docs.select(*names), each, schema)


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of doc_id, pieces."""
    sent = rows.sparkSession.sparkContext.broadcast(load(path))

    def each(batch):
        return {"doc_id": batch.column("doc_id"), "text": [decode(x or [], sent.value).decode() for x in batch.column("pieces").to_pylist()]}

    # A piece is about four bytes: so many rows make a slice.
    sized = rows.select("doc_id", "pieces", F.repeat(F.lit("x"), F.least(F.coalesce(F.size("pieces"), F.lit(0)), F.lit(1 << 20))).alias("size"))
    return arrow_map(sized, each, "doc_id long, text string", text="size")


def digests(docs: DataFrame, path: str = MODEL, seed: int = SEED) -> DataFrame:
    """Encode and decode each text: doc_id, n_pieces, n_byte_pieces, pieces_sha256,
    decoded_sha256, lossless."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def each(batch):
        pieces, texts = sent.value, batch.column("text").to_pylist()
        out = {k: [] for k in ("n_pieces", "n_byte_pieces", "pieces_sha256", "decoded_sha256", "lossless")}
        for text, ids in zip(texts, encode(texts, [seed_of(k, seed) for k in batch.column("doc_id").to_pylist()], pieces), strict=True):
            back = decode(ids.tolist(), pieces)
            out["n_pieces"].append(len(ids))
            out["n_byte_pieces"].append(int(np.isin(ids, pieces.byte_ids).sum()))
            out["pieces_sha256"].append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            out["lossless"].append(back == (text or "").encode())
        return {"doc_id": batch.column("doc_id")} | out

    return arrow_map(id_and_text(docs), each, "doc_id long, n_pieces long, n_byte_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean", limit=1 << 22)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
