"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order ORDER over the letters of its words, a word's
edges included. All models lie in one sorted array of hashes an order, with a
row of discounted probabilities and one of back-off weights, a column a language.
The language of least cross-entropy a character wins; a softmax whose steepness
is fitted on sampled documents that no count saw turns the lead into a score. The same
documents give the rejection threshold: the bits a character that ACCEPTED of them
stay below under the best model. Text that takes more is in no learnt language: its
`accepted` is false, and with reject its answer is `und`.

Counts come from at most SAMPLE rows a language (those of least hash). Defined
results: null text, or text without a letter, is `und` with score 0 and not accepted,
as is all text when no language could be learnt; ties go to the language that sorts
first; texts of any length are judged whole; repeated rows get equal results; null
ids pass through; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, held_out, mix, table

ORDER, SAMPLE, ALPHABET, MOST_WORDS, PIECE = 4, 300, 5000, 300_000, 1 << 18
ACCEPTED = 0.99  # the share of the fitting documents that the rejection threshold lets pass
WORD = re.compile(r"[^\W\d_]+")
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(ORDER + 1)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with a space at either end, each one's place in
    its word, and the word's number."""
    text = " " + "  ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - starts[word], word


def _grams(codes: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams that end at each place, and where they lie in one word."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(k):
        h[back:] += (codes[: len(codes) - back] + np.uint64(1)) * _SALT[back]
    return mix(h + _SALT[k]), np.flatnonzero(place >= max(k - 1, 1))


def _distinct(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights, len(found))


def kneser_ney(counts: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, from 1: gram hashes and discounted probabilities, context
    hashes and back-off weights. Orders below the highest count the distinct
    letters before a gram."""
    words = sorted(counts)
    codes, place, word = _codes(words)
    weight = np.array([counts[w] for w in words], float)[word]
    out = []
    for k in range(1, ORDER + 1):
        grams, at = _grams(codes, place, k)
        contexts = _grams(codes, place, k - 1)[0] if k > 1 else np.zeros(len(codes), np.uint64)
        context = np.zeros(len(codes), np.uint64)
        context[1:] = contexts[:-1] if k > 1 else 0
        if k == ORDER:
            key, c = _distinct(grams[at], weight[at])
            first = at[np.unique(grams[at], return_index=True)[1]]
        else:  # one for each distinct letter before; a gram at a word's edge has none but the edge
            longer, ends = _grams(codes, place, k + 1)
            inner = np.isin(at, ends)
            whole = np.where(inner, longer[at], mix(grams[at]))
            pick = at[np.unique(whole, return_index=True)[1]]
            key, c = _distinct(grams[pick])
            first = pick[np.unique(grams[pick], return_index=True)[1]]
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        ctx, inverse = np.unique(context[first], return_inverse=True)
        total, kinds = np.bincount(inverse, c, len(ctx)), np.bincount(inverse, None, len(ctx))
        out.append((key, np.maximum(c - discount, 0) / total[inverse], ctx, discount * kinds / total))
    return out


class Models:
    """All languages' models, by order, as sorted hashes with a column a language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs, self.heat, self.limit = sorted(counts), 20.0, math.inf
        each = [kneser_ney(counts[lang]) for lang in self.langs]
        self.alpha = [self._merge([(m[k][0], m[k][1]) for m in each], 0.0) for k in range(ORDER)]
        self.gamma = [self._merge([(m[k][2], m[k][3]) for m in each], 1.0) for k in range(ORDER)]

    @staticmethod
    def _merge(parts: list, default: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
        rows = np.full((len(keys) + 1, len(parts)), default, np.float32)
        for n, (k, v) in enumerate(parts):
            rows[np.searchsorted(keys, k), n] = v
        return keys, rows

    @staticmethod
    def _look(side: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        keys, rows = side
        if not len(keys):
            return rows[np.zeros(len(hashes), int)]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return rows[np.where(keys[at] == hashes, at, len(keys))]

    def bits(self, words: list[str]) -> np.ndarray:
        """Cross-entropy of each word by language, in bits: the letters and its end."""
        codes, place, word = _codes(words)
        p = np.full((len(codes), len(self.langs)), 1 / ALPHABET, np.float32)
        context = np.zeros(len(codes), np.uint64)
        for k in range(1, ORDER + 1):
            grams, at = _grams(codes, place, k)
            p[at] = self._look(self.alpha[k - 1], grams[at]) + self._look(self.gamma[k - 1], context[at]) * p[at]
            context = np.concatenate([np.zeros(1, np.uint64), grams[:-1]])
        spent = np.where((place > 0)[:, None], -np.log2(p), 0)
        return np.add.reduceat(spent, np.flatnonzero(place == 0), axis=0)


class Scorer:
    """Cross-entropies of texts; words met before are looked up."""

    def __init__(self, models: Models):
        self.models, self.ids = models, {}
        self.rows = np.zeros((1024, len(models.langs)), np.float32)

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by language, and the number of characters, of each text."""
        if len(self.ids) > MOST_WORDS:
            self.ids = {}
        ids = self.ids
        lists = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = []
        for words in lists:
            for w in words:
                if w not in ids:
                    ids[w] = len(ids)
                    new.append(w)
        while len(self.rows) < len(ids):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            first = ids[part[0]]
            self.rows[first : first + len(part)] = self.models.bits(part)
        bits, sizes = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts))
        for k, words in enumerate(lists):
            if words:
                for j in range(0, len(words), PIECE):
                    at = np.fromiter(map(ids.__getitem__, words[j : j + PIECE]), np.int64)
                    bits[k] += self.rows[at].sum(0, dtype=np.float64)
                sizes[k] = sum(map(len, words)) + len(words)
        return bits / np.maximum(sizes, 1)[:, None], sizes

    def answers(self, texts: list[str | None], reject: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, its score, and whether the text is in any learnt language."""
        if not self.models.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        bits, sizes = self.totals(texts)
        least = bits.min(1, keepdims=True)
        z = -self.models.heat * (bits - least)
        odds = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        best = odds.argmax(1)
        score = odds[np.arange(len(texts)), best]
        letters = np.array([n > 0 and any(c.isalpha() for c in t) for t, n in zip(texts, sizes, strict=True)], bool)
        accepted = letters & (least[:, 0] <= self.models.limit)
        known = accepted if reject else letters
        return [self.models.langs[b] if k else "und" for k, b in zip(known, best, strict=True)], np.where(known, score, 0.0), accepted


def train(docs: DataFrame, sample: int = SAMPLE) -> Models:
    """Models from the sampled rows that aren't held out; each fifth of these
    serves to fit the steepness alone."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(~held_out(5, 0)).where("lang IS NOT NULL AND text IS NOT NULL")
    ids = mine.where("doc_id IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    for parts in (64, 8, 1):  # first within parts, so no task ranks a whole language
        window = Window.partitionBy("lang", F.pmod("part", F.lit(parts))).orderBy("h", "doc_id")
        ids = ids.withColumn("n", F.row_number().over(window)).where(F.col("n") <= sample)
    chosen = ids.groupBy("doc_id", "lang").agg(F.min("n").alias("n"))

    def each(batch):
        out = {"lang": [], "word": [], "n": [], "fit": []}
        for lang, text, n in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if n % 5 == 0:
                out["lang"].append(lang), out["word"].append(text), out["n"].append(1), out["fit"].append(True)
                continue
            for w, c in Counter(WORD.findall(text.lower())).items():
                out["lang"].append(lang), out["word"].append(w), out["n"].append(c), out["fit"].append(False)
        return out

    rows = arrow_map(mine.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text", "n"), each, "lang string, word string, n long, fit boolean")
    got = rows.groupBy("lang", "word", "fit").agg(F.sum("n").alias("n")).toPandas()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, fit, n in got.itertuples(index=False):
        if not fit:
            counts.setdefault(lang, {})[word] = int(n)
    models = Models({k: v for k, v in counts.items() if v})
    checks = sorted((x.lang, x.word) for x in got[got["fit"]].itertuples(index=False) if x.lang in models.langs)
    if checks and len(models.langs) > 1:
        bits, _ = Scorer(models).totals([t for _, t in checks])
        truth = np.array([models.langs.index(x) for x, _ in checks])

        def loss(heat: float) -> float:
            z = -heat * bits
            z -= z.max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())

        models.heat = min((float(h) for h in np.geomspace(0.5, 100, 40)), key=loss)
    if checks:
        bits, sizes = Scorer(models).totals([t for _, t in checks])
        if (sizes > 0).any():
            models.limit = float(np.quantile(bits.min(1)[sizes > 0], ACCEPTED))
    return models


def predict(docs: DataFrame, models: Models, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of each row of docs; with reject,
    what isn't accepted is `und`."""

    def each(batch, scorer):
        langs, scores, accepted = scorer.answers(batch.column("text").to_pylist(), reject)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores, "accepted": accepted}

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(5, 0))
    return arrow_map(frame, each, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean", start=lambda: Scorer(models))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
