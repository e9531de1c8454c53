"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags each token outside (O), begin (B) or inside (I) a secret. A
token's features are its own shape and word, those of the two tokens before and of
the one after, and features of the whole text. Words are hashed to WORDS buckets. Weights are fitted on the driver from
windows of a bounded sample (SAMPLE_ROWS documents, SAMPLE_WINDOWS windows),
labelled by the patterns, with made-up secrets of further formats put in, and
addresses, numbers and dates that are none.
Decoding is Viterbi over the stretches that can be part of a secret at all: a
running sum of the best gain over O shows, exactly, where no tag but O can win.

Defined results: a null or empty text has no secret; texts and tokens of any length
are read whole, in time and memory that grow with them; each row is judged alone, so
repeated rows get equal results; of field spans, those that touch a base span go; null ids pass through; other columns are
ignored (find) or kept (redact); an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, id_and_text, table

# The patterns of the base spans.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]
WORD_HINTS = (b"passw", b"secret", b"token", b"api")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW, ROUNDS, WORDS = 4000, 900, 100, 80, 32
TOKEN = re.compile(r"""[^\s"'=:,;()<>]+|["'=:,;()<>]+""")
KEYWORD = re.compile(r"(?ai:passw|pwd|secret|token|api|key|auth|bearer|credential)")
HEX_LETTERS = set("abcdef")
O, B, I = range(3)  # noqa: E741
ROLES = 4  # the token itself, the one before, two before, one after

SHAPES = (
    [f"len{k}" for k in range(8)]
    + [f"turns{k}" for k in range(5)]
    + [f"entropy{k}" for k in range(5)]
    + ["digit", "upper", "lower", "mixed", "alpha", "wordlike", "capital", "hex", "caps", "sign", "assign", "quote", "other", "keyword", "symbol", "none", "address", "number", "other script"]
    + [f"word{k}" for k in range(WORDS)]
)
SHAPE = {name: k for k, name in enumerate(SHAPES)}
FILE = ["bias", "dense=", "digits", "keys", "code"]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, in order."""
    found = []
    low = text.encode("utf-8", "surrogatepass").translate(LOWER)
    if any(h in low for h in WORD_HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted((s, e, k) for s, e, k in found) if len(found) < 2 else sorted(found, key=lambda x: (x[0], x[2]))


def word(token: str) -> str:
    """The bucket of a word, in either case."""
    return f"word{zlib.crc32(token.lower().encode('utf-8', 'replace')) % WORDS}"


def shape(token: str) -> list[int]:
    """Indexes of the token's features: its shape, and its word if it is of letters."""
    n = len(token)
    out = ["len%d" % (0 if n < 4 else 1 if n < 8 else 2 if n < 12 else 3 if n < 16 else 4 if n < 24 else 5 if n < 32 else 6 if n < 64 else 7)]
    if not any(c.isalnum() for c in token):
        out.append("assign" if token in ("=", ":", "=\"", ":\"") or token[0] in "=:" else "quote" if token[0] in "\"'" else "other")
        return [SHAPE[x] for x in out]
    digit, upper, lower = any(c.isdigit() for c in token), any(c.isupper() for c in token), any(c.islower() for c in token)
    turns, last = 0, -1
    for c in token:
        kind = 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3
        turns += last >= 0 and kind != last
        last = kind
    out += ["turns%d" % (0 if turns == 0 else 1 if turns == 1 else 2 if turns < 4 else 3 if turns < 8 else 4), "entropy%d" % min(4, int(math.log2(len(set(token)))))]
    out += [name for name, on in (
        ("digit", digit), ("upper", upper), ("lower", lower), ("mixed", digit and (upper or lower)), ("alpha", not digit), ("wordlike", not digit and turns < 3),
        ("capital", token[:1].isupper() and lower), ("hex", n > 7 and all(c in "0123456789abcdef" for c in token)), ("caps", upper and not lower),
        ("sign", any(c in "+/_-" for c in token)), ("keyword", bool(KEYWORD.search(token))), ("symbol", not token[-1].isalnum()),
        ("address", "@" in token or "//" in token or token.startswith("www.")), ("number", digit and not upper and not lower), ("other script", not token.isascii()), (word(token), token.isalpha()),
    ) if on]
    return [SHAPE[x] for x in out]


def file_features(text: str) -> np.ndarray:
    n = max(1, len(text))
    return np.array([1, text.count("=") * 500 > n, sum(text.count(d) for d in "0123456789") * 10 > n, "key" in text, text.count("{") + text.count(";") > n / 100], np.float64)


def _weights(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = len(SHAPES) * ROLES * 3, len(FILE) * 3
    return flat[:a].reshape(len(SHAPES), ROLES * 3), flat[a : a + b].reshape(len(FILE), 3), flat[a + b :].reshape(3, 3)


SIZE = len(SHAPES) * ROLES * 3 + len(FILE) * 3 + 9


class Tagger:
    """Emission rows by token, kept while there are few, and the decoder."""

    MOST = 50_000  # about 15 MB; two hundred thousand take 60 and save 4 % of the seconds

    def __init__(self, flat: np.ndarray):
        self.shape_w, self.file_w, self.steps = _weights(flat)
        self.steps = self.steps.copy()
        self.steps[O, I] = -1e9
        self.gain = max(0.0, float((self.steps - self.steps[O, O]).max()))
        self.ids: dict[str, int] = {}
        self.words: dict[tuple, np.ndarray] = {}
        self.rows = np.zeros((1024, ROLES * 3))
        self.none = self.shape_w[[SHAPE["none"]]].sum(0)

    def row_ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.ids) > self.MOST:
            self.ids = {}
        get, ids = self.ids.get, self.ids
        out = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
        for k in np.flatnonzero(out < 0).tolist():
            t = tokens[k]
            if (at := ids.get(t)) is None:
                at = ids[t] = len(ids)
                if at >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[at] = self._row(t)
            out[k] = at
        return out

    def _row(self, token: str) -> np.ndarray:
        """Lower-case and capitalised words share a row if all their features agree."""
        key, n = None, len(token)
        if n < 64 and token.isalpha() and (token.islower() or (token[0].isupper() and token[1:].islower())) and not KEYWORD.search(token):
            letters = set(token)
            key = (n, len(letters), token[0].islower(), token.isascii(), n > 7 and letters <= HEX_LETTERS, word(token))
            if (hit := self.words.get(key)) is not None:
                return hit
        row = self.shape_w[shape(token)].sum(0)
        if key:
            if len(self.words) > self.MOST:
                self.words = {}
            self.words[key] = row
        return row

    def emissions(self, tokens: list[str], text: str) -> np.ndarray:
        ids = self.row_ids(tokens)
        r = self.rows[ids]
        e = r[:, 0:3] + file_features(text) @ self.file_w
        for role, far in ((1, 1), (2, 2)):
            part = slice(3 * role, 3 * role + 3)
            e[far:] += r[:-far, part] if far < len(r) else 0
            e[:far] += self.none[part]
        e[:-1] += r[1:, 9:12]
        e[-1:] += self.none[9:12]
        return e

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans that the field tags, in code points."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        e = self.emissions(tokens, text)
        gain = e[:, 1:].max(1) - e[:, O] + self.gain
        sums = np.concatenate(([0.0], np.cumsum(gain)))
        ending = sums[1:] - np.minimum.accumulate(sums[:-1])
        starting = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
        maybe = np.flatnonzero(ending + starting - gain + self.gain >= 0)
        if not len(maybe):
            return []
        places, out = None, []
        for run in np.split(maybe, np.flatnonzero(np.diff(maybe) > 1) + 1):
            tags = self.viterbi(e[run[0] : run[-1] + 1])
            if any(tags):
                if places is None:
                    places = [m.span() for m in TOKEN.finditer(text)]
                for k, tag in enumerate(tags):
                    s, end = places[run[0] + k]
                    if tag == B or tag == I and not out:
                        out.append((s, end))
                    elif tag == I:
                        out[-1] = (out[-1][0], end)
        return out

    def viterbi(self, e: np.ndarray) -> list[int]:
        best, back = e[0] + self.steps[O], []
        for row in e[1:]:
            all_ways = best[:, None] + self.steps
            back.append(all_ways.argmax(0))
            best = all_ways.max(0) + row
        tag = int((best + self.steps[:, O]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]


def all_spans(text: str, tagger: Tagger) -> tuple[list, list]:
    """The base spans, and these with the field's spans that touch none of them."""
    base = base_spans(text)
    starts, furthest = [s for s, _, _ in base], list(itertools.accumulate((e for _, e, _ in base), max))
    touches = lambda s, e: (k := bisect.bisect_left(starts, e)) > 0 and furthest[k - 1] > s
    more = [(s, e, 3) for s, e in tagger.spans(text) if not touches(s, e)]
    return base, sorted(base + more, key=lambda x: (x[0], x[2])) if more else base


# Training


def labelled_windows(docs: DataFrame) -> DataFrame:
    """Snippets around base spans, and one elsewhere in each sampled text; the
    sample is the SAMPLE_ROWS rows of least hash, so it is the same every time."""
    mine = id_and_text(docs).where("text IS NOT NULL AND doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = mine.select("doc_id", "h").orderBy("h", "doc_id").limit(SAMPLE_ROWS).distinct()  # so it may be broadcast
    sample = mine.join(F.broadcast(chosen), ["doc_id", "h"])

    def each(batch):
        out = {"h": [], "snippet": [], "starts": [], "ends": []}

        def put(text, s, e, spans):
            inside = [(a - s, b - s) for a, b, _ in spans if a >= s and b <= e]
            out["h"].append(int.from_bytes(hashlib.md5(text[s:e].encode("utf-8", "replace")).digest()[:7], "little"))
            out["snippet"].append(text[s:e])
            out["starts"].append([a for a, _ in inside])
            out["ends"].append([b for _, b in inside])

        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            for s, e, _ in spans[:8]:
                if e - s < 200:
                    put(text, max(0, s - WINDOW), e + WINDOW, spans)
            at = int.from_bytes(hashlib.md5(text.encode("utf-8", "replace")).digest()[:4], "little") % max(1, len(text))
            put(text, at, at + 2 * WINDOW, spans)
        return out

    return arrow_map(sample.select("text"), each, "h long, snippet string, starts array<int>, ends array<int>").orderBy("h", "snippet").limit(SAMPLE_WINDOWS)


def made_up(rng: random.Random) -> tuple[str, str]:
    """A line with a secret of a common format, and the secret."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secret = rng.choice([
        lambda: "ghp_" + pick(low + up + num, 36), lambda: "sk_live_" + pick(low + up + num, 24), lambda: "eyJ" + pick(low + up + num, 40) + "." + pick(low + up + num, 43),
        lambda: pick(up + num, 20), lambda: pick(low + up + num + "+/", 40), lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])), lambda: pick(low + num, 16) + pick(up + num, 4),
        lambda: pick(low, rng.choice([3, 4, 5])) + rng.choice("-_") + pick(low + up + num, rng.choice([16, 20, 24, 32])),
    ])()
    lead = rng.choice(["Authorization Bearer ", "key ", "auth = \"", "credential: ", "pwd=", "secret is ", "token ", *[""] * 5])
    return lead, secret


def harmless(rng: random.Random) -> str:
    """An address, number or date: shapes that aren't secrets."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, num = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return rng.choice([
        lambda: pick(low, 9) + "." + pick(num, 2) + "@" + pick(low, 5) + pick(num, 1) + ".example.com", lambda: pick(num, rng.choice([4, 9, 16])), lambda: "+" + pick(num, 2) + "-" + pick(num, 3) + "-" + pick(num, 7),
        lambda: f"https://{pick(low, 8)}.example.org/{pick(low, 5)}/{pick(num, 5)}?page=2", lambda: f"{pick(num, 4)}-0{pick(num, 1)}-1{pick(num, 1)}", lambda: pick(num, 3) + "." + pick(num, 2) + "." + pick(num, 3) + "." + pick(num, 2),
    ])()


def training_set(rows: list, seed: int = 7) -> tuple[list, list]:
    """(tokens, tags, file features) of the windows, a third with made-up secrets."""
    rng, out = random.Random(seed), []
    for k, row in enumerate(rows):
        text, spans = row["snippet"], list(zip(row["starts"], row["ends"], strict=True))
        if k % 3 == 0 and not spans and " " in text:
            at = text.index(" ", rng.randrange(text.rindex(" ") + 1)) + 1
            lead, secret = made_up(rng)
            text = text[:at] + lead + secret + " " + text[at:]
            spans = [(at + len(lead), at + len(lead) + len(secret))]
        elif k % 3 == 1 and not spans and " " in text:
            at = text.index(" ", rng.randrange(text.rindex(" ") + 1)) + 1
            text = text[:at] + harmless(rng) + " " + text[at:]
        tokens, tags, inside = [], [], False
        for m in TOKEN.finditer(text):
            hit = any(m.start() < e and s < m.end() for s, e in spans) and any(c.isalnum() for c in m[0]) and not KEYWORD.fullmatch(m[0]) and not m[0].lower() in ("password", "token", "secret", "apikey", "api_key", "passwd")
            tags.append((I if inside else B) if hit else O)
            inside = hit
            tokens.append(m[0])
        if tokens:
            out.append((tokens, tags, file_features(text)))
    return out


def fit(windows: list, rounds: int = ROUNDS, l2: float = 1e-3) -> np.ndarray:
    """Maximise the conditional likelihood by Adam; forward and backward sums run
    over all windows at once."""
    flat = np.zeros(SIZE)
    if not windows:
        flat[len(SHAPES) * ROLES * 3] = 5.0  # nothing to learn from: tag O
        return flat
    long, n = max(len(t) for t, _, _ in windows), len(windows)
    x = np.zeros((n, long, ROLES, len(SHAPES)), np.float32)
    y, here = np.zeros((n, long), int), np.zeros((n, long), bool)
    for k, (tokens, tags, _) in enumerate(windows):
        shapes = [shape(t) for t in tokens]
        y[k, : len(tags)], here[k, : len(tags)] = tags, True
        for j in range(len(tokens)):
            for role, at in enumerate((j, j - 1, j - 2, j + 1)):
                x[k, j, role, shapes[at] if 0 <= at < len(tokens) else [SHAPE["none"]]] = 1
    files = np.array([f for _, _, f in windows])
    flat_x = x.reshape(n, long, -1)
    gold = np.eye(3, dtype=np.float32)[y] * here[..., None]
    gold_x, gold_f = flat_x.reshape(n * long, -1).T @ gold.reshape(-1, 3), files.T @ gold.sum(1)
    gold_t = np.zeros((3, 3))
    padded = np.concatenate([np.zeros((n, 1), int), np.where(here, y, 0)], 1)
    np.add.at(gold_t, (padded[:, :-1][here], padded[:, 1:][here]), 1)
    mom, var = np.zeros(SIZE), np.zeros(SIZE)
    for step in range(1, rounds + 1):
        w, fw, tw = _weights(flat)
        wx = w.reshape(len(SHAPES), ROLES, 3).transpose(1, 0, 2).reshape(-1, 3)
        e = flat_x @ wx.astype(np.float32) + (files @ fw)[:, None, :]
        trans = tw.copy()
        trans[O, I] = -1e9
        fwd, bwd = np.zeros((n, long, 3)), np.zeros((n, long, 3))
        fwd[:, 0] = e[:, 0] + trans[O]
        for j in range(1, long):
            new = _lse(fwd[:, j - 1, :, None] + trans, 1) + e[:, j]
            fwd[:, j] = np.where(here[:, j, None], new, fwd[:, j - 1])
        for j in range(long - 2, -1, -1):
            new = _lse(trans[None] + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
            bwd[:, j] = np.where(here[:, j + 1, None], new, bwd[:, j + 1])
        z = _lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * here[..., None]
        gx = flat_x.reshape(n * long, -1).T @ p.reshape(-1, 3).astype(np.float32) - gold_x
        gf = files.T @ p.sum(1) - gold_f
        pair = np.exp(fwd[:, :-1, :, None] + trans + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * here[:, 1:, None, None]
        gt = pair.sum((0, 1)) - gold_t
        gt[O] += p[:, 0].sum(0)
        grad = np.concatenate([gx.reshape(ROLES, len(SHAPES), 3).transpose(1, 0, 2).ravel(), gf.ravel(), gt.ravel()]) / n + l2 * flat
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        flat = flat - 0.15 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return flat


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def train(docs: DataFrame) -> np.ndarray:
    rows = [r.asDict() for r in labelled_windows(docs).collect()]
    return fit(training_set(rows))


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, flat: np.ndarray) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, and all spans."""

    def each(batch, tagger):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans")}
        for text in batch.column("text").to_pylist():
            base, spans = all_spans(text or "", tagger)
            for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_crf")):
                out[name].append(sum(x[2] == k for x in spans))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
        return {"doc_id": batch.column("doc_id")} | out

    return arrow_map(id_and_text(docs), each, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string", start=lambda: Tagger(flat))


def redact(docs: DataFrame, flat: np.ndarray, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by the mark; n_chars, if there, follows."""
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def each(batch, tagger):
        texts = []
        for text in batch.column("text").to_pylist():
            if text:
                at, parts = 0, []
                for s, e, _ in all_spans(text, tagger)[1]:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                text = "".join([*parts, text[at:]]) if parts else text
            texts.append(text)
        out = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in out:
            out["n_chars"] = [None if n is None else n if t is None else len(t) for n, t in zip(batch.column("n_chars").to_pylist(), texts, strict=True)]
        return out

    return arrow_map(docs, each, schema, start=lambda: Tagger(flat))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
