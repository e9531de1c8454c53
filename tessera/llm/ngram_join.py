"""N-gram Jaccard join: documents whose sets of five-word shingles are alike.

Two sets link if 100 * |A and B| >= 75 * |A or B|. Equal sets are one class, known
by 64 bits of their digest, as shingles are by theirs. Then:

1. Two similar sets share a shingle among the first quarter (and one) of each, in
   any one order of all shingles. The order here is by hash, but common shingles
   come last, so that no common passage gathers its documents: those that a sample
   of the texts shows to be in very many, and those that over HEAVY classes turn out
   to share. A set whose first shingles are mostly common is matched by all its
   other shingles against the rest, and by its first quarter in plain order
   against its like; no link is lost.
2. The classes that share a shingle are points: counts of shingles by hashed
   group, of as many groups as keep a group at a few shingles. A packed R-tree over the points bounds each overlap by the sum
   of coordinate minima; classes that the bound can't part become one candidate
   group.
3. In each candidate group the same tree and bound pick pairs, and surviving pairs
   are verified on the shingle sets of the whole texts. A class that is already
   reached isn't compared again, so copies cost no quadratic work.

A group of over BLOCK classes is dealt to blocks. One class of each block is
compared with those of the others; then only what this leaves apart from the group's
largest part is compared with the whole group, so a group of any number of copies is
read about once. Defined results: null text or text without words has an empty
set and links with nothing; a text below five words is one shingle; null ids get a
component, but never name one unless all its ids are null; equal rows are linked;
an empty table gives none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, giving_back, mix, spool, table, unspool, unused, utf8, word_hashes
from tessera.llm.components import components

WORDS, DIMENSIONS, PER_LEVEL, HEAVY, BLOCK, LEAF = 5, 128, 600, 256, 1024, 32
BUCKET_SHINGLES, MOST_BROADCAST = 2_000_000, 500_000
#: One text of SAMPLE shows which shingles are common: those in LEAST texts of the sample
#: and in more than one of MOST_COMMON of its shingles, so at most MOST_COMMON are.
SAMPLE, LEAST, MOST_COMMON = 64, 16, 1_000_000
NUMERATOR, DENOMINATOR = 3, 4  # the least similarity, 0.75
NO_ID = (1 << 63) - (1 << 40)  # row numbers from here on stand for null ids, by text
_TURNS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(WORDS)]


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    span = min(len(w), WORDS)
    h = np.zeros(len(w) - span + 1, np.uint64)
    for k in range(span):
        h += w[k : len(w) - span + 1 + k] * _TURNS[k]
    return np.unique(mix(h + np.uint64(span)))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def level(n) -> np.ndarray:
    """Sets of up to PER_LEVEL shingles are of level 0; each level doubles the size."""
    return np.ceil(np.log2(np.maximum(n, PER_LEVEL) / PER_LEVEL)).astype(np.int64)


def point(s: np.ndarray) -> np.ndarray:
    """Counts by hashed group, more groups for larger sets; 255 stands for 255 or more."""
    groups = DIMENSIONS << int(level(len(s)))
    return np.minimum(np.bincount((mix(s) % np.uint64(groups)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point of as many groups: each sums those that it covers."""
    return np.minimum(p.reshape(-1, groups).sum(0, dtype=np.int64), 255).astype(np.uint8)


def first_part(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def least_overlap(n: np.ndarray, m: int) -> np.ndarray:
    """The smallest overlap of similar sets of n and m shingles."""
    total = n + m
    return -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))


class Tree:
    """A packed R-tree of count vectors: points sorted by set size, then by the
    heavier halves of their counts; a leaf holds LEAF points and their box."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        half = points[:, : points.shape[1] // 2].sum(1, dtype=np.int64)
        self.order = np.lexsort((half, sizes * 16 // max(1, int(sizes.max(initial=1)))))
        self.sizes, self.points = sizes[self.order].astype(np.int64), points[self.order]
        cuts = np.arange(0, len(sizes), LEAF)
        self.top = np.maximum.reduceat(self.points, cuts, axis=0) if len(sizes) else self.points
        self.low, self.high = np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts)
        self.left = np.ones(len(sizes), bool)  # points not yet reached
        self.alive = np.add.reduceat(self.left.astype(int), cuts)

    def take(self, at: np.ndarray) -> None:
        self.left[at] = False
        np.subtract.at(self.alive, at // LEAF, 1)

    def near(self, i: int) -> np.ndarray:
        """Unreached points that the bound can't part from point i."""
        n, p = int(self.sizes[i]), self.points[i]
        leaves = np.flatnonzero((self.alive > 0) & (self.high * DENOMINATOR >= NUMERATOR * n) & (self.low * NUMERATOR <= DENOMINATOR * n))
        if len(leaves) > 1:
            leaves = leaves[_overlap(p, self.top[leaves]) >= least_overlap(self.low[leaves], n)]
        if not len(leaves):
            return leaves
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.left)]
        at = at[self.left[at]]
        m = self.sizes[at]
        at = at[(m * DENOMINATOR >= NUMERATOR * n) & (m * NUMERATOR <= DENOMINATOR * n)]
        return at[_overlap(p, self.points[at]) >= least_overlap(self.sizes[at], n)]


def _overlap(p: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The bound: summed coordinate minima; where both are full, no bound."""
    least = np.minimum(p, points)
    return least.sum(-1, dtype=np.int64) + (least == 255).any(-1) * (1 << 40)


def reach(sizes: np.ndarray, points: list[np.ndarray], similar=None) -> list[tuple[int, int]]:
    """Links that connect what is near (and similar, if a test is given). Sizes of
    similar sets are of one level or of two that follow each other: each level has a
    tree of its own, with the next level's points folded."""
    levels, out = level(sizes), []
    for k in np.unique(levels).tolist():
        mine = np.flatnonzero((levels == k) | (levels == k + 1))
        if len(mine) > 1:
            here = np.array([folded(points[i], DIMENSIONS << k) for i in mine])
            test = (lambda i, others: similar(int(mine[i]), mine[others])) if similar else None  # noqa: B023
            out += [(int(mine[i]), int(mine[j])) for i, j in _reach(sizes[mine], here, test)]
    return out


def _reach(sizes: np.ndarray, points: np.ndarray, similar) -> list[tuple[int, int]]:
    """Within a level, each class is met once, by the first one that reaches it."""
    if len(sizes) == 2 and similar is None:
        a, b = sorted(sizes.tolist())
        return [(0, 1)] if b * NUMERATOR <= a * DENOMINATOR and _overlap(points[0], points[1:])[0] >= least_overlap(np.int64(a), b) else []
    tree, out = Tree(sizes, points), []
    for start in range(len(sizes)):
        if not tree.left[start]:
            continue
        tree.take(np.array([start]))
        stack = [start]
        while stack:
            i = stack.pop()
            near = tree.near(i)
            if similar is not None and len(near):
                near = near[similar(int(tree.order[i]), tree.order[near])]
            if len(near):
                tree.take(near)
                stack += near.tolist()
                out += [(int(tree.order[i]), int(j)) for j in tree.order[near]]
    return out


def common_shingles(rows: DataFrame) -> np.ndarray:
    """The shingles, in order, that a sample of the texts shows to be common. Whether one
    is found here decides only how its sets are matched, not which of them link."""
    limit = LEAST

    def each(batch):
        h, n = np.unique(np.concatenate([shingles(t) for t in utf8(batch.column("text"))]), return_counts=True)
        return {"h": h.view(np.int64), "n": n}

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = spool(arrow_map(sample, each, "h long, n long", limit=1 << 22).groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(limit, total // MOST_COMMON + 1)).select("h").toPandas()["h"].to_numpy(np.int64)  # at most MOST_COMMON
    unspool(counts)
    return np.sort(found.view(np.uint64))


def _but(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """s without what is in common (sorted)."""
    if not len(common) or not len(s):
        return s
    return s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]


def sets_of(rows: DataFrame, common) -> DataFrame:
    """doc_id, row, a digest of the text, id, n, point and `plain`, the number of
    shingles that aren't common, of each row; common is a broadcast of an array."""

    def each(batch):
        sets = [shingles(t) for t in utf8(batch.column("text"))]
        out = {"id": [set_id(s) for s in sets], "n": [len(s) for s in sets], "point": [point(s).tobytes() if len(s) else None for s in sets], "plain": [len(_but(s, common.value)) for s in sets]}
        return out | {k: batch.column(k) for k in ("doc_id", "row", "digest")}

    return arrow_map(rows.select("doc_id", "row", "text", F.xxhash64("text").alias("digest")), each, "doc_id long, row long, digest long, id long, n int, point binary, plain int")


def _row_number() -> Column:
    text = F.col("text").cast("string")
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit((1 << 40) - 1)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_number().alias("row"), F.col("text").cast("string").alias("text"))


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, row, ...) with the text of a row of that id; a row number that
    stands for several texts is told apart when the set is made. Up to MOST_BROADCAST
    wanted rows are sent to the texts; beyond, both sides are shuffled."""
    wanted = spool(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    return rows.select("row", "text").join(wanted, "row")


def _shared_shingles(rows: DataFrame, total: int, common) -> DataFrame:
    """(id, at, shingle, k): the first shingles, by hash and but for common ones, of
    each class that another class has among its first too. k is the number of such
    classes, at most HEAVY + 1; at is the set's size and the shingle's place in it.

    Shingles travel as packed blocks by hash range, 20 bytes or less each."""
    buckets, limit = total // BUCKET_SHINGLES + 32, HEAVY
    width = np.uint64((1 << 64) // buckets + 1)

    def pack(batch):
        sets = [shingles(t) for t in utf8(batch.column("text"))]
        known = dict((set_id(s), s) for s in sets if len(s))  # copies in a piece go as one
        if not known:
            return {"bucket": [], "shingle": [], "nth": [], "place": [], "ids": [], "sizes": []}
        first = [_but(s, common.value)[: first_part(len(s)) + _slack(len(s))] for s in known.values()]
        shingle = np.concatenate(first)
        nth = np.repeat(np.arange(len(first), dtype=np.uint32), [len(f) for f in first])
        place = np.concatenate([np.arange(len(f), dtype=np.uint32) for f in first])
        by = np.argsort(shingle)
        shingle, nth, place = shingle[by], nth[by], place[by]
        bucket = (shingle // width).astype(np.int64)
        ids, sizes = np.array(list(known), np.int64), np.array([len(s) for s in known.values()], np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        out = {"bucket": bucket[np.concatenate(([0], cuts))], "shingle": [], "nth": [], "place": [], "ids": [], "sizes": []}
        for s, m, p in zip(np.split(shingle, cuts), np.split(nth, cuts), np.split(place, cuts), strict=True):
            mine, m = np.unique(m, return_inverse=True)
            for name, x in (("shingle", s), ("nth", m.astype(np.uint32)), ("place", p), ("ids", ids[mine]), ("sizes", sizes[mine])):
                out[name].append(x.tobytes())
        return out

    def match(batches):
        held: list[tuple] = []
        now = None
        for batch in batches:
            for k in range(batch.num_rows):  # a batch holds many buckets, so only one row's copy is made at a time
                row = tuple(batch.column(c)[k].as_py() for c in ("bucket", "shingle", "nth", "place", "ids", "sizes"))
                if held and row[0] != now:
                    yield _matched(held, limit)
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield _matched(held, limit)

    packed = arrow_map(rows.select("text"), pack, "bucket long, shingle binary, nth binary, place binary, ids binary, sizes binary", limit=1 << 22)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(match), "id long, at long, shingle long, k int")


def _matched(held: list[tuple], limit: int) -> pa.RecordBatch:
    """Of a bucket's blocks, the shingles of at least two classes."""
    parts = [[np.frombuffer(x, t) for x, t in zip(block, (np.uint64, np.uint32, np.uint32, np.int64, np.int64), strict=True)] for block in held]
    shingle = np.concatenate([p[0] for p in parts])
    ids = np.concatenate([p[3][p[1]] for p in parts])
    at = np.concatenate([(p[4][p[1]] << 32) + p[2] for p in parts])
    by = np.lexsort((ids, shingle))
    shingle, ids, at = shingle[by], ids[by], at[by]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (ids[1:] != ids[:-1])  # copies are one class
    shingle, ids, at = shingle[new], ids[new], at[new]
    begin = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
    count = np.diff(np.concatenate((begin, [len(shingle)])))
    k = np.repeat(count, count)
    keep = k > 1
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(at[keep]), pa.array(shingle[keep].view(np.int64)), pa.array(np.minimum(k[keep], limit + 1).astype(np.int32))], names=["id", "at", "shingle", "k"])


def _slack(n: int) -> int:
    return n // 10 + 8


def _all_shingles(rows: DataFrame, classes: DataFrame, common) -> DataFrame:
    """(kind, shingle, ids) of the given classes: kind 0 for shingles that aren't common,
    kind 1 for those of the first quarter in plain order. What the classes of a piece of
    the table share goes as one row."""

    def each(batch):
        found = {0: ([], []), 1: ([], [])}
        for text, known in zip(utf8(batch.column("text")), batch.column("id").to_pylist(), strict=True):
            s = shingles(text)
            if len(s) and set_id(s) == known:
                for kind, part in ((0, _but(s, common.value)), (1, s[: first_part(len(s))])):
                    found[kind][0].append(part)
                    found[kind][1].append(np.full(len(part), known))
        kinds, shared, lists, ends = [], [], [], [np.zeros(1, np.int64)]
        for kind, (parts, ids) in found.items():
            if parts:
                all_of, ids = np.concatenate(parts), np.concatenate(ids)
                by = np.argsort(all_of, kind="stable")
                all_of, ids = all_of[by].view(np.int64), ids[by]
                cuts = np.flatnonzero(np.diff(all_of)) + 1
                if len(all_of):
                    shared.append(all_of[np.concatenate(([0], cuts))])
                    ends.append(ends[-1][-1] + np.append(cuts, len(ids)))
                    lists.append(ids)
                    kinds.append(np.full(len(cuts) + 1, kind))
        if not lists:
            return None
        kinds, shared, lists, ends = (np.concatenate(x) for x in (kinds, shared, lists, ends))
        return {"kind": kinds, "shingle": shared, "ids": pa.ListArray.from_arrays(ends.astype(np.int32), lists.astype(np.int64))}

    return arrow_map(_texts(rows, classes.select("id", "row")), each, "kind int, shingle long, ids array<long>", limit=1 << 23)


def _keys(rows: DataFrame, classes: DataFrame, total: int, common) -> DataFrame:
    """(key, id): classes that may be similar share a key."""
    shared = spool(_shared_shingles(rows, total, common))
    first = shared.join(classes.select("id", "plain"), "id")
    by_class = first.groupBy("id", "plain").agg(F.collect_list(F.struct("at", "shingle", "k")).alias("s"))  # bounded by one text

    limit = HEAVY

    def choose(batch):
        out = {"id": [], "kind": [], "shingle": []}

        def put(i, kind, found):
            out["id"].append(np.full(len(found), i)), out["kind"].append(np.full(len(found), kind)), out["shingle"].append(found)

        offsets = batch.column("s").offsets.to_numpy()
        flat = batch.column("s").values
        at, sh, k = (flat.field(n).to_numpy() for n in range(3))
        for j, (i, plain) in enumerate(zip(batch.column("id").to_pylist(), batch.column("plain").to_pylist(), strict=True)):
            a, b = offsets[j], offsets[j + 1]
            by = np.argsort(at[a:b])
            place, s, times, n = (at[a:b] & 0xFFFFFFFF)[by], sh[a:b][by], k[a:b][by], int(at[a] >> 32)
            heavy = times > limit
            light_rank = place - (np.cumsum(heavy) - heavy)
            sent, part = min(plain, first_part(n) + _slack(n)), first_part(n)
            if sent - heavy.sum() >= part:
                put(i, 0, s[~heavy & (light_rank < part)])
            else:
                put(i, 0, s[~heavy])
                put(i, 2, np.zeros(1, np.int64))
        return {name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in out.items()}

    chosen = spool(arrow_map(by_class.withColumn("text", F.lit("x" * 64)), choose, "id long, kind int, shingle long"), shared)
    few = F.col("plain") < F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1  # less than its first part is not common
    lacking = classes.join(chosen.where("kind = 2").select("id").unionByName(classes.where(few).select("id")).distinct(), "id", "left_semi")
    rest = spool(_all_shingles(rows, lacking, common))
    asked = chosen.where("kind = 0").select("shingle").distinct()  # no other shingle can meet one of the rest
    rest_keys = rest.where("kind = 0").join(asked, "shingle", "left_semi").unionByName(rest.where("kind = 1").select("shingle", "kind", "ids"))
    rest_keys = rest_keys.select(F.xxhash64("kind", "shingle").alias("key"), F.explode("ids").alias("id"))
    keys = chosen.where("kind = 0").select(F.xxhash64("kind", "shingle").alias("key"), "id").unionByName(rest_keys)
    return spool(keys.distinct(), chosen, rest)


def _different(keys: DataFrame) -> DataFrame:
    """keys without those that hold no other ids than another key: the classes of a
    family share many shingles, and one says all."""
    each = keys.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("u"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("v")).where("k > 1")
    return spool(keys.join(each.groupBy("k", "u", "v").agg(F.min("key").alias("key")).select("key"), "key"), keys)


def _connected(members: DataFrame, group, fetch, columns: list[str]) -> DataFrame:
    """(x, y): links that group() finds, enough to connect in each key of members (key,
    id) what all its links connect; fetch() adds the columns that group() reads. A key
    of over BLOCK ids is dealt to blocks, and what these leave apart is compared in
    three steps."""
    sizes = spool(members.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", _block_count("k").alias("blocks")))
    largest = sizes.agg(F.max("blocks")).first()[0] or 0
    dealt = spool(members.join(sizes, "key").withColumn("block", _block_of("blocks")), sizes)
    linked_in = lambda cells: spool(_by_cell(fetch(cells), group, columns))
    links = linked_in(dealt.select("id", F.xxhash64("key", "block").alias("cell")))
    if largest < 2:
        unspool(dealt)
        return links
    big = spool(dealt.where("blocks > 1"), dealt)
    # One of each block's largest part meets those of the other blocks, block by block.
    named = spool(big.select("key", "block", "id").join(_labels(links), "id", "left").select("key", "block", "id", F.coalesce("root", "id").alias("root")))
    leaders = named.groupBy("key", "block", "root").agg(F.count("*").alias("k"), F.min("id").alias("id")).groupBy("key", "block").agg(F.max_by("id", F.struct("k", "id")).alias("id"))
    found, done = [links], [named]
    while largest > 1:
        counts = leaders.groupBy("key").agg(_block_count(F.count("*")).alias("blocks"))
        leaders = spool(leaders.select("key", "id").join(counts, "key").withColumn("block", _block_of("blocks")))
        largest = leaders.agg(F.max("blocks")).first()[0] or 0
        found.append(linked_in(leaders.select("id", F.xxhash64("key", "block").alias("cell"))))
        done.append(leaders)
        leaders = leaders.groupBy("key", "block").agg(F.min("id").alias("id"))
    # What is still apart from a key's largest part meets all ids of the key.
    labels = _labels(functools.reduce(DataFrame.unionByName, found))
    named = spool(big.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), *done)
    main = named.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    apart = spool(named.join(main, "key").where("root <> main").select("key", "id"), named)
    if not apart.isEmpty():
        counts = apart.groupBy("key").agg(_block_count(F.count("*")).alias("rest"))
        mine = big.join(counts, "key").join(apart.select("key", "id", F.lit(True).alias("apart")), ["key", "id"], "left")
        each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        as_rest = mine.where("apart").withColumn("i", _block_of("rest")).withColumn("j", F.explode(each("blocks")))
        as_all = mine.withColumn("j", F.col("block")).withColumn("i", F.explode(each("rest"))).where(F.col("apart").isNull() | (F.col("i") != _block_of("rest")))
        found.append(linked_in(as_rest.unionByName(as_all).select("id", F.xxhash64(F.lit(2), "key", "i", "j").alias("cell"))))
    unspool(apart, big)
    return functools.reduce(DataFrame.unionByName, found)


def _block_count(k: Column | str) -> Column:
    return F.ceil((F.col(k) if isinstance(k, str) else k) / BLOCK).cast("int")


def _block_of(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(blocks).cast("long")).cast("int")


def _labels(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("id"), "root")


def _by_cell(frame: DataFrame, group, columns: list[str]) -> DataFrame:
    """Links (x, y) that group(rows of a cell) finds; frame is dealt and sorted by cell."""

    def run(batches):
        held, now = [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and cells[a] != now:
                    out += group(held)
                    held = []
                held.append(batch.slice(a, b - a))
                now = cells[a]
            if out:
                yield _pairs(out)
        if held:
            out = group(held)
            if out:
                yield _pairs(out)

    return frame.select("cell", *columns).repartition("cell").sortWithinPartitions("cell").mapInArrow(giving_back(run), "x long, y long")


def _pairs(out: list) -> pa.RecordBatch:
    a = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["x", "y"])


def _column(held: list, name: str) -> pa.Array:
    return held[0].column(name) if len(held) == 1 else pa.concat_arrays([h.column(name) for h in held])


def _near(held: list) -> list:
    """Links that keep together the classes of a cell that the bound can't part."""
    if sum(len(h) for h in held) < 2:
        return []
    ids, sizes = _column(held, "id").to_numpy(), _column(held, "n").to_numpy()
    points = [np.frombuffer(p, np.uint8) for p in _column(held, "point").to_pylist()]
    return [(ids[i], ids[j]) for i, j in reach(sizes, points)]


def _similar(held: list) -> list:
    """Verified links among the texts of a cell; equal rows give an id more than once."""
    known = {}
    for i, text in zip(_column(held, "id").to_pylist(), utf8(_column(held, "text")), strict=True):
        if i not in known and set_id(s := shingles(text)) == i:
            known[i] = s
    ids, sets = list(known), list(known.values())
    if len(ids) < 2:
        return []

    index: list = []

    def test(i: int, others: np.ndarray) -> np.ndarray:
        mine = sets[i]
        if len(others) <= 4:
            common = np.array([_common(mine, sets[j]) for j in others])
        else:  # one pass over the postings of this set's shingles gives all overlaps
            if not index:
                index.extend(_postings(sets))
            common = _overlaps(mine, *index, len(sets))[others]
        sizes = np.array([len(sets[j]) for j in others])
        return common * DENOMINATOR >= NUMERATOR * (sizes + len(mine) - common)

    return [(ids[i], ids[j]) for i, j in reach(np.array([len(s) for s in sets]), [point(s) for s in sets], test)]


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the sets in order, and the set of each."""
    shingle, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    by = np.argsort(shingle, kind="stable")
    return shingle[by], of[by]


def _overlaps(mine: np.ndarray, shingle: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sizes of mine's overlaps with all n sets."""
    begin, end = np.searchsorted(shingle, mine), np.searchsorted(shingle, mine, side="right")
    size = end - begin
    at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return np.bincount(of[at], minlength=n)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(b) < len(a):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all rows, the classes (id, row, digest) and (id, root) of each class."""
    rows = _rows(docs)
    common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows))
    sets = spool(sets_of(rows, common))
    classes = sets.where("n > 0").groupBy("id").agg(F.min(F.struct("row", "digest")).alias("least"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("plain").alias("plain"))
    classes = spool(classes.select("id", "least.row", "least.digest", "n", "point", "plain"))
    total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    keys = _different(_keys(rows, classes, total, common))
    near = _connected(keys, _near, lambda cells: cells.join(classes.select("id", "n", "point"), "id"), ["id", "n", "point"])
    groups = spool(components(near).select(F.col("node").alias("id"), F.col("root").alias("key")), keys)
    links = _connected(groups, _similar, lambda cells: _texts(rows, cells.join(classes.select("id", "row"), "id")), ["id", "text"])
    roots = spool(components(links).select(F.col("node").alias("id"), "root"), groups)
    return sets, classes, classes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    sets, classes, roots = _components(docs)
    named = classes.select("id", "row").join(roots, "id")
    names = named.groupBy("root").agg(F.min("row").alias("name"))
    by_class = named.join(names, "root").select("id", "name")
    found = sets.where("n > 0").join(by_class, "id").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("name") < NO_ID, F.col("name")).alias("component_id"))
    return found.unionByName(sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs, that of least doc_id, of each component, with all columns;
    every row without a word stays."""
    _, classes, roots = _components(docs)
    first = classes.join(roots, "id").groupBy("root").agg(F.min(F.struct("row", "digest")).alias("w")).select("w.*")
    row, digest = unused(docs, "join_row"), unused(docs, "join_digest")
    mine = docs.withColumns({row: _row_number(), digest: F.xxhash64(F.col("text").cast("string"))})
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = mine.where(has_words).join(first.select(F.col("row").alias(row), F.col("digest").alias(digest)), [row, digest], "left_semi").dropDuplicates([row, digest])
    return kept.unionByName(mine.where(~has_words)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
