"""Definitions, relationships and excerpts."""

import hashlib

from pyspark.sql import functions as F
from test_library import small

from tessera.operators import context


def test_relationships_and_definitions(spark):
    facts = small(
        spark,
        symbols=[("f", "p.F", "F", (), "function", "d1"), ("g", "p.G", "G", (), "function", "d1"), ("v", "p.v", "v", (), "variable", "d1"), ("h", "q.H", "H", (), "function", "d2")],
        documents=[("d1", "p/a.go"), ("d2", "q/b.go")], occurrences=[("o1", "f", "d1"), ("o2", "f", "d2")],
        edges=[("f", "references", "g"), ("f", "calls", "g"), ("f", "references", "v"), ("f", "references", "h"), ("h", "calls", "f")],
    )
    got = [(r.kind, r.other, r.near) for r in context.relationships(facts, "f").orderBy("pos").collect()]
    assert got == [("calls", "g", 1020), ("references", "h", 1000)]
    assert [r.symbol_id for r in context.definitions(facts, "F").collect()] == ["f"]
    parts = context.dossier(facts, "f")
    assert parts["evidence"].count() == 2 and [r.other for r in parts["incoming"].collect()] == ["h"]


def test_excerpts(spark):
    text = "\n".join(f"line {k}" for k in range(10))
    good = hashlib.sha256(text.encode()).hexdigest()
    places = spark.createDataFrame([(1, "d", good, 4, 4), (2, "d", "other", 4, 4), (3, "gone", good, 0, 0), (4, "d", good, 50, 50), (5, "d", good, 0, 9)], "pos int, document_id string, content_hash string, first int, last int")
    contents = spark.createDataFrame([("d", text)], "document_id string, text string")
    got = {r.pos: (r.status, r.quoted) for r in context.excerpts(places, contents, 1, 60).collect()}
    assert got[1] == ("current", "line 3\nline 4\nline 5") and [got[k][0] for k in (2, 3, 4, 5)] == ["changed", "missing", "out of range", "over budget"]
    assert context.excerpts(places.where("pos = 5"), contents).select(F.col("quoted")).first()[0] == text
