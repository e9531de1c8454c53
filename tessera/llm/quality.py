"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over the features, become one lookup table a
feature; then the strongest pairs of features get tables of two dimensions. A
score is a sum of table entries, found by binning whole batches.

Labels are learnt from at most TRAIN_ROWS labelled rows (those of least hash),
never from the held-out fifth. Defined results: a null text counts as an empty
one and is scored like any; a document labelled more than once counts with its
mean label; with no label, or labels of one value, every score is their mean
(0.5 without any); repeated rows get equal scores; null ids pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, held_out, id_and_text, table, unused, utf8

TRAIN_ROWS, BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 20_000, 32, 8, 120, 40, 6, 0.1
THRESHOLD = 0.3
NAMES = [
    "chars", "words", "word_length", "upper", "digit", "punctuation", "space", "non_ascii", "lines", "line_length", "repeated_lines", "distinct_words",
    "longest_word", "letterless", "stops", "short_words", "entropy", "symbols", "pipes", "repeated_pairs", "top_word", "links", "ends",
]

_CLASS = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [65 <= _b <= 90, 48 <= _b <= 57, 33 <= _b < 127 and not _c.isalnum(), _b in (9, 10, 11, 12, 13, 32), _b >= 128, _c in "&%$#*@^~<>{}[]\\", _b == 124, _c in ".!?"]


def text_features(text: bytes | None) -> list[float]:
    """Figures of a whole text; they are all 0 for an empty one."""
    raw = text or b""
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts @ _CLASS / n
    p = counts[counts > 0] / n
    words = raw.split()
    k = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n), math.log1p(k), n / max(1, k), share[0], share[1], share[2], share[3], share[4], math.log1p(len(lines)), math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), len(kinds) / max(1, k), math.log1p(max(map(len, kinds), default=0)), sum(v for w, v in kinds.items() if not w.isalpha() and w.isascii() and not any(65 <= c <= 122 for c in w)) / max(1, k),
        share[7] * n / max(1, k), sum(v for w, v in kinds.items() if len(w) < 4) / max(1, k), float(-(p * np.log2(p)).sum()), share[5], share[6], 1 - pairs / max(1, k - 1) if k > 1 else 0.0,
        max(kinds.values(), default=0) / max(1, k), math.log1p(raw.count(b"http") + raw.count(b"www.")), float(raw.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


@dataclass
class Additive:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[_coarse(bins[i], self.edges[i]), _coarse(bins[j], self.edges[j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of the pair tables: a feature's own bins if they are few, else joined alike."""
    return bins * COARSE // max(len(edges) + 1, COARSE)


def _split(g: np.ndarray, h: np.ndarray, least: float) -> int:
    """The best cut of a row of bins, 0 if none gains."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = -1
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 2.0) -> np.ndarray:
    """Leaf values by bin of a shallow tree fitted to gradients g, curvatures h."""
    cut = _split(g, h, least) if depth and len(g) > 1 else 0
    if not cut:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, least), _tree(g[cut:], h[cut:], depth - 1, least)])


def _tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of one cut along each axis, and the gain of it."""
    best, most = np.zeros_like(g), 0.0
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        cut = _split(a.sum(1), b.sum(1), 2.0) or len(a) // 2
        out = np.empty_like(a)
        gain = 0.0
        for part in (slice(0, cut), slice(cut, len(a))):
            leaf = _tree(a[part].sum(0), b[part].sum(0), 1)
            out[part] = leaf
            gain += float(-(a[part].sum(0) * leaf).sum())
        if gain > most:
            best, most = (out.T if turn else out), gain
    return best, most


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost the features in turn, then the pairs whose residual gains most."""
    width = len(NAMES)
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return Additive(math.log(mean / (1 - mean)), [np.zeros(0)] * width, [np.zeros(1)] * width, [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    mean = float(np.clip(y.mean(), 0.001, 0.999))
    base = math.log(mean / (1 - mean))
    total, tables = np.full(len(y), base), [np.zeros(len(e) + 1) for e in edges]
    for _ in range(ROUNDS):
        for k in range(width):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[k])
            step = RATE * _tree(np.bincount(bins[k], p - y, size), np.bincount(bins[k], p * (1 - p), size))
            tables[k] += step
            total += step[bins[k]]
    coarse = [_coarse(b, e) for b, e in zip(bins, edges, strict=True)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, at = 1 / (1 + np.exp(-total)), coarse[i] * COARSE + coarse[j]
        return np.bincount(at, p - y, COARSE**2).reshape(COARSE, COARSE), np.bincount(at, p * (1 - p), COARSE**2).reshape(COARSE, COARSE)

    ranked = sorted(((_tree_2d(*sums(i, j))[1], -i, -j) for i in range(width) for j in range(i + 1, width)), reverse=True)[:PAIRS]
    pairs = [(-i, -j, np.zeros((COARSE, COARSE))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            step = RATE * _tree_2d(*sums(i, j))[0]
            t += step
            total += step[coarse[i], coarse[j]]
    return Additive(base, edges, tables, pairs)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Additive:
    chosen = labels.where(~held_out(5, 0)).where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so it may be broadcast

    def each(batch):
        return {"y": batch.column("y"), "x": [text_features(t) for t in utf8(batch.column("text"))], "doc_id": batch.column("doc_id")}

    got = arrow_map(id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), each, "doc_id long, y double, x array<double>")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * rows).toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(NAMES)))
    return fit(x, (got["y"].to_numpy(float) >= 0.5).astype(float))


def score(docs: DataFrame, model: Additive, keep: str = "") -> DataFrame:
    """doc_id, held_out, score, predicted; with keep, docs with a score of that name instead."""
    if keep:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{keep}` double"])
        frame = docs
    else:
        schema, frame = "doc_id long, held_out boolean, score double, predicted int", id_and_text(docs).withColumn("held_out", held_out(5, 0))

    def each(batch):
        s = model.score(np.array([text_features(t) for t in utf8(batch.column("text"))]))
        if keep:
            return {n: batch.column(n) for n in batch.schema.names} | {keep: s}
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= THRESHOLD).astype(int)}

    return arrow_map(frame, each, schema)


def keep_good(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    name = unused(docs, "quality_score")
    return score(docs, model, keep=name).where(F.col(f"`{name}`") >= threshold).drop(name)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
