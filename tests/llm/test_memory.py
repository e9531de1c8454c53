"""Workers give memory back when their task ends, and take little while it runs."""

import random
import tracemalloc

import numpy as np
import psutil
import pyarrow as pa

from tessera.llm import common, secrets, sentencepieces


def test_a_task_gives_its_memory_back():
    me, kept = psutil.Process(), []

    def run(batches):
        held = [bytes(3000) for _ in range(70_000)]
        kept.append(held[-1])  # the end of the heap stays in use, so what is freed below it isn't returned unasked
        yield from batches

    before = me.memory_info().rss
    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2]
    assert me.memory_info().rss - before < 100e6


def test_encoding_takes_little_memory(spark, monkeypatch):
    """A text is a few kB; what a task holds must not grow with the rows of its Arrow batch."""
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(700)) for _ in range(1200)]
    batch, taken = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts}), {}

    def arrow_map(df, each, schema, text="text", limit=1 << 20):
        tracemalloc.start()
        taken["rows"] = sum(len(each(piece)["pieces"]) for piece in common.rows_by_size(batch, text, limit))
        taken["peak"] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()

    monkeypatch.setattr(sentencepieces, "arrow_map", arrow_map)
    sentencepieces.encoded(spark.createDataFrame([], "doc_id long, text string"))
    assert taken["rows"] == len(texts) and batch.nbytes > 4e6
    assert taken["peak"] < 120e6


def test_tagging_takes_little_memory(monkeypatch):
    """Texts of ever new tokens: the tagger keeps few of them, and tags as if it kept all or none."""
    flat = np.random.default_rng(1).normal(size=secrets.SIZE)
    texts = [" ".join(f"{k}n{j}" for j in range(1000)) for k in range(150)] + ["password token0 hunter22 0n1"]
    tagger = secrets.Tagger(flat)
    tracemalloc.start()
    got = [tagger.emissions(t.split(), t).sum() for t in texts]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    for most in (0, 1 << 30):
        monkeypatch.setattr(secrets.Tagger, "MOST", most)
        other = secrets.Tagger(flat)
        assert got == [other.emissions(t.split(), t).sum() for t in texts]
