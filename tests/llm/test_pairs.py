"""Near copies, benchmark passages, repeated passages: against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components as components_module
from tessera.llm import decontaminate, ngram_join, suffixes
from tessera.llm.common import table
from tessera.llm.components import components

UPPER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(rows):
    """(doc_id, size, component) of each row, by comparing all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got_components(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(frame).collect()), key=repr)


def test_join_of_odd_rows(odd, odd_rows):
    assert got_components(odd) == components_of([(r[0], r[1]) for r in odd_rows])


def test_join_of_nothing(none):
    assert ngram_join.linked(none).count() == 0
    assert ngram_join.one_of_each(none).columns == none.columns


@pytest.mark.parametrize(("heavy", "block", "sample", "least"), [(256, 4096, 64, 16), (2, 3, 1, 4)])
def test_join_of_families(spark, monkeypatch, heavy, block, sample, least):
    for name, value in (("HEAVY", heavy), ("BLOCK", block), ("SAMPLE", sample), ("LEAST", least)):
        monkeypatch.setattr(ngram_join, name, value)
    rng, rows = random.Random(5), []
    boiler = " ".join(f"common{k}" for k in range(30))
    for family in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 20, 90, 300]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 15))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(500)}"
            rows.append((len(rows), " ".join(copy) + (f" {boiler}" if family % 2 else "")))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(frame) == components_of(rows)


def test_bound_never_parts_similar_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.choice([3, 40, 400, 650, 1300, 5000])).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 4 * common >= 3 * (len(a) + len(b) - common):
            assert ngram_join.reach(np.array([len(a), len(b)]), [ngram_join.point(a), ngram_join.point(b)]) in ([(0, 1)], [(1, 0)])
            links = ngram_join.reach(np.array([len(a), len(b)] * 40), [ngram_join.point(a), ngram_join.point(b)] * 40)
            assert {x for pair in links for x in pair} == set(range(80))


def test_one_of_each(odd, odd_rows):
    kept = sorted((r.doc_id for r in ngram_join.one_of_each(odd).collect()), key=repr)
    assert kept == sorted([-5, 4, 5, 6, None, 7, 9, 10, 11, 12, 12, 13, 14, 15, 16], key=repr)


@pytest.mark.parametrize("in_one_task", [300_000, 20, 0])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", in_one_task)
    links = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 90)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {k: 0 for k in range(51)} | {1000 + k: 1000 for k in range(90)}


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def contamination_of(rows, items):
    out = []
    windows = collections.defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("null" if i is None else str(i))
    for d, t in rows:
        w, hit, found = item_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contamination_of_odd_rows(spark, monkeypatch, odd, odd_rows, limit):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", limit)
    base = odd_rows[0][1].split()
    items = [(1, " ".join(base[10:40])), (2, "Two THREE"), (3, None), (4, "--"), (None, " ".join(base[30:41])), (2, "Two THREE"), (10, "日本語 😀 with"), (5, "nothing of this kind is there")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = sorted((tuple(r) for r in decontaminate.contamination(odd, benchmark).collect()), key=repr)
    assert got == contamination_of([(r[0], r[1]) for r in odd_rows], items)
    clean = sorted((r.doc_id for r in decontaminate.drop_contaminated(odd, benchmark).collect()), key=repr)
    assert clean == sorted((x[0] for x in got if not x[5]), key=repr)


def test_contamination_of_nothing(odd, none, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, empty).where("contaminated").count() == 0
    assert decontaminate.contamination(none, empty).count() == 0
    assert decontaminate.drop_contaminated(odd, empty).count() == odd.count()


def removal_of(rows):
    count, out = collections.Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(int)) == 1)), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4 << 20, 500, 0])
def test_removal_of_odd_rows(odd, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot)
    rows = [(r[0], r[1]) for r in odd_rows]
    assert sorted((tuple(r) for r in suffixes.without_repeats(odd).collect()), key=repr) == removal_of(rows)


def test_removal_keeps_the_rest(spark, none):
    rng = random.Random(2)
    text = "".join(rng.choice("abcd ") for _ in range(3000))
    rows = [(k, text[a:b] + "".join(rng.choice("xyz ") for _ in range(90))) for k, (a, b) in enumerate([(0, 600), (300, 900), (500, 699), (850, 1300), (2000, 2600), (2450, 2640)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffixes.without_repeats(frame).collect()), key=repr) == removal_of(rows)
    assert suffixes.without_repeats(none).count() == 0


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(150):
        k, n = rng.choice([1, 2, 3, 20, 250]), rng.randrange(1, 150)
        b = [rng.randrange(k) for _ in range(n)]
        b += b[: rng.randrange(n + 1)] if rng.random() < 0.5 else []
        s = np.array([c + 1 for c in b] + [0])
        order = suffixes.suffix_array(s, k + 1)
        assert order.tolist() == suffixes.suffix_array(s, k + 1, suffixes.induce_each).tolist()
        full = s.tolist()
        assert order.tolist() == sorted(range(len(full)), key=lambda i: full[i:])
        before, common = suffixes.common_prefixes(s, order, 10**6)
        for r in range(1, len(full)):
            i, j, n = order[r], order[r - 1], 0
            while max(i, j) + n < len(full) and full[i + n] == full[j + n]:
                n += 1
            assert (before[i], common[i]) == (j, n)


def test_names_are_sorted_by_recursion(spark, sf, monkeypatch):
    texts = [r.text.encode() for r in table(spark, sf, "documents").select("text").where("text IS NOT NULL").collect()]
    inner, sizes = suffixes.suffix_array, []

    def counting(s, *more):
        sizes.append(len(s))
        return inner(s, *more)

    monkeypatch.setattr(suffixes, "suffix_array", counting)
    shard = [t[:4000] for t in texts[:60]]
    assert [x.tolist() for x in suffixes.repeated_starts(shard)] == starts_of(shard)
    assert len(sizes) >= 3 and all(2 * b <= a for a, b in zip(sizes, sizes[1:], strict=False))  # names, and names of names


@pytest.mark.parametrize("hot", [256 << 10, 2000, 0])
def test_removal_around_a_hot_passage(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot)
    rng = random.Random(8)
    new = lambda n, of="abcdefgh ": "".join(rng.choice(of) for _ in range(n))
    passage, edges = new(150), [new(60) for _ in range(4)]
    rows = [(k, new(rng.randrange(300)) + rng.choice(edges) + passage + rng.choice([rng.choice(edges), new(80)]) + new(rng.randrange(300))) for k in range(60)]
    rows += [(100 + k, "ab" * (90 + 15 * k) + passage + "x" * rng.randrange(400)) for k in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in suffixes.without_repeats(frame).collect()), key=repr) == removal_of(rows)


@pytest.mark.parametrize("width", suffixes.WIDTHS)
def test_parting_keeps_equal_strings_together(width):
    rng = random.Random(width)
    key = {}
    for _ in range(30):
        text = bytes(rng.choice(b"ab") for _ in range(60)) * 12 + bytes(rng.choice(b"abc") for _ in range(300))
        for v, start, size, _ in zip(*suffixes.anchors(text), strict=True):
            content, covered = text[start : start + size + 199], []
            for at, n, k in suffixes.parted(content, width):
                covered += range(at, at + n)
                for j in range(at, at + n):
                    assert key.setdefault(content[j : j + 200], (v, k)) == (v, k)
            assert covered == list(range(size))


def starts_of(regions):
    count = collections.Counter(r[k : k + 200] for r in regions for k in range(len(r) - 199))
    return [[k for k in range(len(r) - 199) if count[r[k : k + 200]] > 1] for r in regions]


def test_repeats_in_neighbouring_near_copies():
    rng = random.Random(4)
    new = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    late, early = new(300), new(300)
    regions = [new(60) + late, early + new(60), new(60) + late, early + new(60)]
    assert [x.tolist() for x in suffixes.repeated_starts(regions)] == starts_of(regions)


@pytest.mark.parametrize("copies", [8, 12, 16])
def test_repeats_in_copies_with_one_edit(copies):
    rng = random.Random(copies)
    for _ in range(10):
        base, regions = bytes(rng.randrange(97, 123) for _ in range(360)), set()
        while len(regions) < copies:
            at = rng.randrange(360)
            regions.add(base[:at] + bytes([rng.randrange(65, 91)]) + base[at + 1 :])
        regions = rng.sample(sorted(regions), copies)
        assert [x.tolist() for x in suffixes.repeated_starts(regions)] == starts_of(regions)
