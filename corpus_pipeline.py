"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and
read again as the next stage's docs. All but the last return docs' own columns.

Defined results: a null text is judged as an empty one by the classifier, has no
copies, words or secrets, and gives no pieces; of equal rows, and of near copies, the
one of least doc_id stays; rows without a word all stay there; equal scores are
treated equally, as the threshold itself is kept; null ids pass through; an empty
table gives an empty one with the same columns; further columns pass through all
stages but the last, whatever their names. SQL can't express the learnt stages, so
tests hold run() against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, ngram_join, quality, secrets, sentencepieces
from tessera.llm.common import spool, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark span occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs, secrets.train(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the sampled pieces of each document."""
    return sentencepieces.encoded(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ()
    for _, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), *before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
