"""Removal of repeated passages, decided in suffix arrays made by induced sorting.

A string of SPAN bytes goes to where its least KEY-byte hash (its anchor) says, so
equal strings meet. Neighbouring strings with one anchor form a region; only
regions whose anchor occurs elsewhere too are gathered. Equal regions are counted
first. The different regions of an anchor share a shard: their bytes are
concatenated, the suffix array is induced, and permuted common prefixes of SPAN
and more mark strings that occur again. An anchor with one region only, in which it
occurs once, needs no array: its strings occur again just where the region does. Where the different regions of an anchor
exceed HOT_BYTES, they are parted by content: by where the anchor lies in a string,
in ever shorter stretches (WIDTHS), and by the bytes that all strings of the stretch
have around it. Equal strings stay together; the parts go through suffix arrays too.

Equal texts are known by 128 bits of their SHA-256, equal regions by 128-bit
digests. Defined results: a null text is empty; texts below SPAN bytes
keep everything; of equal rows each removes all (each string occurs in the other);
null ids pass through; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, giving_back, prefix_sums, span_hash, spool, table, utf8

SPAN, KEY, MOST_STARTS = 200, 40, 400
HOT_BYTES, SHARD_BYTES = 256 << 10, 1 << 20
WIDTHS = (64, 16, 4, 1)
PIECE = 1 << 20


# Suffix arrays


def types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S-type); the last one is."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    known = at < n
    out[:-1][known] = step[at[known]] > 0
    return out


def _deal(places: np.ndarray, letters: np.ndarray, lists: dict[int, list]) -> None:
    """Append places to their letters' lists, in order."""
    if not len(places):
        return
    by = np.argsort(letters, kind="stable")
    places, letters = places[by], letters[by]
    cuts = np.flatnonzero(np.diff(letters)) + 1
    for part, letter in zip(np.split(places, cuts), letters[np.concatenate(([0], cuts))].tolist(), strict=True):
        lists.setdefault(letter, []).append(part)


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, from leftmost-smaller ones in the given order: one pass up for
    larger (L) suffixes, one down for smaller (S). Each bucket is taken at once."""
    starts: dict[int, list] = {}
    _deal(lms, s[lms], starts)
    large: dict[int, list] = {}
    bigger = ~small
    for c in range(size):
        for part in _growing(large, c):
            _push(s, part, bigger, large)
        for part in _growing(starts, c):
            _push(s, part, bigger, large)
    smaller: dict[int, list] = {}
    for c in range(size - 1, -1, -1):
        for part in _growing(smaller, c):
            _push(s, part, small, smaller)
        for part in _growing(large, c):
            _push(s, part[::-1], small, smaller)
    out = []
    for c in range(size):
        out += large.get(c, [])
        out += [p[::-1] for p in reversed(smaller.get(c, []))]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _growing(lists: dict[int, list], c: int):
    """What a bucket holds, as one array; then what it has got meanwhile."""
    k = 0
    while k < len(lists.get(c, ())):
        parts, k = lists[c][k:], len(lists[c])
        yield parts[0] if len(parts) == 1 else np.concatenate(parts)


def _push(s: np.ndarray, places: np.ndarray, wanted: np.ndarray, lists: dict[int, list]) -> None:
    before = places[places > 0] - 1
    before = before[wanted[before]]
    _deal(before, s[before], lists)


def induce_each(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same for a string of names, whose many buckets hold a few suffixes each: they
    are filled one suffix at a time."""
    ends = np.cumsum(np.bincount(s, minlength=size))
    before = np.concatenate(([-1], s[:-1], [-1]))  # the letter before each suffix; an empty place has none
    kind = np.concatenate(([True], small[:-1], [True]))
    larger, smaller = np.where(kind, -1, before).tolist(), np.where(kind, before, -1).tolist()
    order, tail = [-1] * len(s), ends.tolist()
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        tail[c] -= 1
        order[tail[c]] = i
    head = [0, *ends.tolist()]
    for i in order:  # what is put ahead is met later in the same pass
        c = larger[i]
        if c >= 0:
            order[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for i in reversed(order):
        c = smaller[i]
        if c >= 0:
            tail[c] -= 1
            order[tail[c]] = i - 1
    return np.array(order, np.int64)


def suffix_array(s: np.ndarray, size: int, inducing=induce) -> np.ndarray:
    """The suffixes of s in order; s ends with its only 0, and its symbols are below size.
    Leftmost-smaller substrings are sorted by inducing, named by their ranks, and where
    two are equal the string of names is sorted the same way first."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ranked = lms
    if len(lms) > 1:
        first = _with_last(s, inducing(s, small, lms, size))
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        ranked = first[is_lms[first]]
        ends = np.append(lms[1:] + 1, len(s))
        nth = np.zeros(len(s), np.int64)
        nth[lms] = np.arange(len(lms))
        hashes = span_hash(prefix_sums(s), lms, ends)[nth[ranked]]
        name = np.zeros(len(lms), np.int64)
        name[nth[ranked]] = np.concatenate(([0], np.cumsum(hashes[1:] != hashes[:-1])))
        kinds = int(name.max()) + 1
        if kinds < len(lms):
            # The last name is that of the end mark, the least and only one: names are such a string too.
            ranked = lms[suffix_array(name, kinds, induce_each)]
    return _with_last(s, inducing(s, small, ranked, size))


def _with_last(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The suffix of the end mark has none after it to induce it from."""
    last = len(s) - 1
    return order if len(order) == len(s) else np.concatenate(([last], order[order != last]))


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the place before it in order, and the length of their common
    prefix (at most `most`). Where the place before moves along with the text, the
    length is one less than at the last place; only other places are compared, and
    each 1 (a region's end), so that no region carries on what `most` cut before it.
    Lengths below `least` may be given as less: where a compared place has no common
    prefix of that length, none that moves along with it has one."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    moves = np.zeros(n, bool)
    moves[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (s[:-1] == s[np.maximum(before[:-1], 0)])
    moves[s == 1] = False
    fresh = np.flatnonzero(~moves)
    sums = prefix_sums(s)
    other = before[fresh]
    lo, hi = np.zeros(len(fresh), np.int64), np.minimum(most, n - np.maximum(fresh, other))
    hi[other < 0] = 0
    other = np.maximum(other, 0)
    if least:
        may = np.flatnonzero(hi >= least)
        may = may[span_hash(sums, fresh[may], fresh[may] + least) == span_hash(sums, other[may], other[may] + least)]
        top = np.zeros(len(fresh), np.int64)
        top[may] = hi[may]
        lo[may], hi = least, top
    while True:
        todo = np.flatnonzero(lo < hi)
        if not len(todo):
            break
        mid = (lo[todo] + hi[todo] + 1) // 2
        i, j = fresh[todo], other[todo]
        same = span_hash(sums, i, i + mid) == span_hash(sums, j, j + mid)
        lo[todo] = np.where(same, mid, lo[todo])
        hi[todo] = np.where(same, hi[todo], mid - 1)
    run = np.cumsum(~moves) - 1
    return before, np.maximum(lo[run] - (np.arange(n) - fresh[run]), 0)


def repeated_starts(regions: list[bytes]) -> list[np.ndarray]:
    """For each region, where a string of SPAN bytes starts that starts elsewhere
    in the regions too."""
    sizes = np.array([len(r) + 1 for r in regions])
    s = np.ones(int(sizes.sum()) + 1, np.int32)
    ends = np.cumsum(sizes)
    for r, end in zip(regions, ends, strict=True):
        s[end - 1 - len(r) : end - 1] = np.frombuffer(r, np.uint8).astype(np.int32) + 2
    s[-1] = 0
    before, common = common_prefixes(s, suffix_array(s, 258), int(sizes.max()) + SPAN, SPAN)
    again = np.zeros(len(s), bool)
    hit = np.flatnonzero(common >= SPAN)
    again[hit] = True
    again[before[hit]] = True
    out = []
    for r, end in zip(regions, ends, strict=True):
        begin = end - 1 - len(r)
        out.append(np.flatnonzero(again[begin : max(begin, end - SPAN)]))
    return out


# Anchors and regions


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least value in each window of width values."""
    n = len(h) - width + 1
    pad = -len(h) % width
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regions of a text: anchor, first start, number of starts, and whether the
    anchor occurs more than once in it."""
    parts = []
    for at in range(0, max(1, len(text) - SPAN + 1), PIECE):
        data = np.frombuffer(text, np.uint8)[at : at + PIECE + SPAN - 1]
        if len(data) < SPAN:
            break
        sums = prefix_sums(data)
        first = np.arange(len(data) - KEY + 1)
        h = span_hash(sums, first, first + KEY)
        v = window_min(h, SPAN - KEY + 1)
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        begin = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((begin, [len(v)])))
        if size.max() > MOST_STARTS:
            begin = np.concatenate([np.arange(b, b + n, MOST_STARTS) for b, n in zip(begin.tolist(), size.tolist(), strict=True)])
            size = np.diff(np.concatenate((begin, [len(v)])))
        value = v[begin]
        own = np.array([np.count_nonzero(h[b : b + n + SPAN - KEY] == x) > 1 for b, n, x in zip(begin.tolist(), size.tolist(), value, strict=True)])
        parts.append((value, begin + at, size, own))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _digest(b: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    half = lambda at: F.conv(F.substring(F.sha2("text", 256), at, 16), 16, -10).cast("long")
    return out.withColumns({"a": half(1), "b": half(17), "row": F.coalesce("doc_id", F.lit(-(1 << 63)))})


def parted(content: bytes, width: int) -> list[tuple[int, int, int]]:
    """A region as runs of strings: (first start, number of starts, key). The strings of
    a run have the anchor's first occurrence in them at offsets of one stretch of width
    offsets; the key names the stretch and the bytes that each string with an offset of
    it has, so equal strings have equal keys."""
    data = np.frombuffer(content, np.uint8)
    first = np.arange(len(data) - KEY + 1)
    h = span_hash(prefix_sums(data), first, first + KEY)
    found = np.flatnonzero(h == h[: SPAN - KEY + 1].min())
    start = np.arange(len(data) - SPAN + 1)
    anchor = found[np.searchsorted(found, start)]
    stretch = (anchor - start) // width
    cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])) + 1
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)], strict=True):
        low = int(stretch[a]) * width
        high = min(low + width - 1, SPAN - KEY)
        common = content[int(anchor[a]) - low : int(anchor[a]) - high + SPAN]
        out.append((a, b - a, xxhash.xxh3_64_intdigest(common, seed=width << 8 | low) - (1 << 63)))
    return out


def repeated_regions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of equal texts (a, b, n, first) and, for one text of each class,
    the intervals [start, end) of bytes to remove, as rows (a, b, start, end)."""
    mine = _keyed(docs)
    classes = mine.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("row").alias("first"))

    def find(batch):
        out = {k: [] for k in ("a", "b", "v", "start", "size", "own")}
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        for k, text in enumerate(utf8(batch.column("text"))):
            v, start, size, own = anchors(text)
            for name, x in (("a", np.full(len(v), a[k])), ("b", np.full(len(v), b[k])), ("v", v.view(np.int64)), ("start", start), ("size", size), ("own", own)):
                out[name].append(x)
        return {k: np.concatenate(x) for k, x in out.items()}

    found = spool(arrow_map(mine.where(F.octet_length("text") >= SPAN).select("a", "b", "text"), find, "a long, b long, v long, start int, size int, own boolean"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("a", "b", "start") for f in (F.min, F.max)]
    shared = found.groupBy("v").agg(*ends, F.max("own").alias("own")).where("own OR min_a <> max_a OR min_b <> max_b OR min_start <> max_start").select("v")
    hits = found.join(shared, "v").select("a", "b", "start", "size", "v", "own").distinct()
    hits = hits.groupBy("a", "b").agg(F.collect_list(F.struct("start", "size", "v", "own")).alias("hits"))  # no more than the text has regions
    one = mine.select("a", "b", "row", "text").join(hits.join(classes, ["a", "b"]).select("a", "b", F.col("first").alias("row"), "hits"), ["a", "b", "row"])

    def cut(batch):
        out = {k: [] for k in ("a", "b", "v", "start", "size", "own", "r1", "r2", "content")}
        for a, b, text, hits in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), utf8(batch.column("text")), batch.column("hits").to_pylist(), strict=True):
            for h in hits:
                content = text[h["start"] : h["start"] + h["size"] + SPAN - 1]
                r1, r2 = _digest(content)
                for name, x in (("a", a), ("b", b), ("v", h["v"]), ("start", h["start"]), ("size", h["size"]), ("own", h["own"]), ("r1", r1), ("r2", r2), ("content", content)):
                    out[name].append(x)
        return out

    regions = spool(arrow_map(one, cut, "a long, b long, v long, start int, size int, own boolean, r1 long, r2 long, content binary"), found)
    placed, contents = regions.select("a", "b", "start", "size", "v", "r1", "r2"), regions.select("v", "r1", "r2", "content", "own")
    all_placed, shards, done = [], [], [regions]
    for width in WIDTHS:
        sizes = contents.groupBy("v", "r1", "r2").agg(F.max(F.octet_length("content")).alias("bytes"))
        hot = spool(sizes.groupBy("v").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > HOT_BYTES).select("v"))
        done.append(hot)
        if hot.isEmpty():
            break
        all_placed.append(placed.join(hot, "v", "left_anti"))
        shards.append(contents.join(hot, "v", "left_anti"))

        def part(batch, width=width):
            out = {k: [] for k in ("r1", "r2", "at", "size", "v", "s1", "s2", "content")}
            for r1, r2, content in zip(batch.column("r1").to_pylist(), batch.column("r2").to_pylist(), utf8(batch.column("content")), strict=True):
                for at, size, v in parted(content, width):
                    own = content[at : at + size + SPAN - 1]
                    s1, s2 = _digest(own)
                    for name, x in (("r1", r1), ("r2", r2), ("at", at), ("size", size), ("v", v), ("s1", s1), ("s2", s2), ("content", own)):
                        out[name].append(x)
            return out

        different = contents.join(hot, "v").groupBy("r1", "r2").agg(F.first("content").alias("content"))
        parts = spool(arrow_map(different, part, "r1 long, r2 long, at int, size int, v long, s1 long, s2 long, content binary", text="content", limit=1 << 16))
        inner = placed.join(hot, "v", "left_semi").select("a", "b", "start", "r1", "r2").join(parts.drop("content"), ["r1", "r2"])
        placed = spool(inner.select("a", "b", (F.col("start") + F.col("at")).alias("start"), "size", "v", F.col("s1").alias("r1"), F.col("s2").alias("r2")))
        contents = parts.select("v", F.col("s1").alias("r1"), F.col("s2").alias("r2"), "content", F.lit(True).alias("own"))
        done += [parts, placed]
    all_placed, shards = (functools.reduce(DataFrame.unionByName, x) for x in ([*all_placed, placed], [*shards, contents]))

    def sort_shards(batches):
        import pyarrow as pa

        held, size, last, alone = [], 0, None, False

        def flush():
            ids, starts, ends = [], [], []
            for (r1, r2, _), at in zip(held, repeated_starts([x[2] for x in held]), strict=True):
                if len(at):
                    cuts = np.flatnonzero(np.diff(at) > 1)
                    ids.append((r1, r2))
                    starts.append(at[np.concatenate(([0], cuts + 1))].tolist())
                    ends.append((at[np.concatenate((cuts, [len(at) - 1]))] + SPAN).tolist())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["r1", "r2", "starts", "ends"])

        for batch in batches:
            for v, r1, r2, content, own in zip(*(batch.column(c).to_pylist() for c in ("v", "r1", "r2", "content", "own")), strict=True):
                if v != last:
                    if alone:
                        size -= len(held.pop()[2])
                    if size > SHARD_BYTES:
                        yield flush()
                        held, size = [], 0
                alone = v != last and not own
                held.append((r1, r2, content))
                size, last = size + len(content), v
        if alone:
            held.pop()
        if held:
            yield flush()

    one_each = shards.groupBy("v", "r1", "r2").agg(F.first("content").alias("content"), F.max("own").alias("own"))
    inside = one_each.repartition("v").sortWithinPartitions("v", "r1", "r2").mapInArrow(giving_back(sort_shards), "r1 long, r2 long, starts array<int>, ends array<int>")
    counted = all_placed.groupBy("r1", "r2").agg(F.count("*").alias("times")).where("times > 1").select("r1", "r2", F.lit(True).alias("whole"))
    verdict = counted.join(inside, ["r1", "r2"], "full")
    judged = all_placed.select("a", "b", "start", "size", "r1", "r2").join(verdict, ["r1", "r2"])
    all_of_it = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("size") + (SPAN - 1)).alias("end")))
    some = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct((F.col("start") + x["starts"]).alias("start"), (F.col("start") + x["ends"]).alias("end")))
    spans = judged.select("a", "b", F.explode(F.when(F.col("whole"), all_of_it).otherwise(some)).alias("p")).select("a", "b", "p.start", "p.end")
    return classes, spool(spans, *done)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with texts,
    the kept bytes too."""
    classes, spans = repeated_regions(docs)
    spans = spans.groupBy("a", "b").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    known = classes.join(spans, ["a", "b"], "left").select("a", "b", "n", F.when(F.col("n") == 1, F.col("spans")).alias("spans"))
    rows = _keyed(docs).select("doc_id", "text", "a", "b").join(known, ["a", "b"]).select("doc_id", "text", "n", "spans")

    def each(batch):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, n, spans in zip(utf8(batch.column("text")), batch.column("n").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            gone = [(0, len(text))] if n > 1 and len(text) >= SPAN else merged([(x["start"], x["end"]) for x in spans or ()])
            at, kept = 0, []
            for s, e in gone:
                kept.append(text[at:s])
                at = e
            left = b"".join([*kept, text[at:]])
            for name, x in (("n_bytes", len(text)), ("n_removed", len(text) - len(left)), ("n_spans", len(gone)), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left)):
                out[name].append(x)
        return {"doc_id": batch.column("doc_id")} | out

    return arrow_map(rows, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
