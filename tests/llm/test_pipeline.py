import os
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, ngram_join, quality, secrets
from tessera.llm.common import spool, table


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    names, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spool(stage(spark, docs, sf))
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == names
        if k == 1:
            assert docs.count() == ngram_join.linked(docs).select("component_id").distinct().count()
        if k == 2:
            assert decontaminate.contamination(docs, table(spark, sf, "benchmark")).where("contaminated").count() == 0
    assert 200 > seen[0] > seen[1] > seen[2] == seen[3] == seen[4] > 100
    assert docs.where("size(pieces) = 0").count() == 0


def brute_rows(rows, good, items):
    """doc_ids that stay: good ones, one (the least) of each component of alike sets, without an item's window."""
    from test_pairs import components_of, contamination_of

    kept = [(d, t) for d, t in rows if good[d]]
    root = {d: c for d, n, c in components_of(kept) if n}
    kept = [(d, t) for d, t in kept if root.get(d, d) == d]
    dirty = {x[0] for x in contamination_of(kept, items) if x[5]}
    return sorted(d for d, _ in kept if d not in dirty)


def test_run_against_brute_force(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = table(spark, source, "documents").where("doc_id < 90")
    for name, frame in (("documents", docs), ("labels", table(spark, source, "labels")), ("benchmark", table(spark, source, "benchmark"))):
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, labels = table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels")
    model = quality.train(docs, labels)
    good = {r.doc_id: r.score >= quality.THRESHOLD for r in quality.score(docs, model).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in table(spark, source, "benchmark").collect()]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == brute_rows(rows, good, items)


@pytest.fixture(scope="module")
def clashing(odd):
    """The odd rows with columns named like the helpers' own."""
    names = ["quality_score", "Decontaminate_Key", "join_row", "join_digest"]
    return odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def test_stages_on_odd_rows_and_clashing_names(spark, sf, clashing):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    for stage in (lambda d: quality.keep_good(d, model), ngram_join.one_of_each, lambda d: decontaminate.drop_contaminated(d, benchmark), lambda d: secrets.redact(d, secrets.train(d))):
        out = stage(clashing)
        assert out.columns == clashing.columns
        got = out.select("quality_score", "Decontaminate_Key", "join_row", "join_digest").distinct().collect()
        assert [tuple(r) for r in got] == [(0, 1, 2, 3)]
        assert stage(clashing.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_run_on_odd_tables(spark, sf, tmp_path, kind, odd, none):
    docs = {"odd": odd, "none": none}[kind].select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf, name).limit(0 if kind == "none" else 1000).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() > 5) == (kind == "odd")


def test_spools_are_deleted_and_need_a_shared_folder(spark, monkeypatch):
    first = spool(spark.range(5))
    path = re.sub("^file:", "", first.spooled_at)
    assert os.path.exists(path)
    second = spool(first.where("id > 2"), first)
    assert not os.path.exists(path) and second.count() == 2

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "local-cluster[3,2,1000]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    Cluster.sparkContext.master = "local[4]"
    assert common.shared_dir(Cluster).endswith("/checkpoints")
