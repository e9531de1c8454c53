"""References between extracted files, and files that are too large."""

import pytest

from tessera.operators import traverse
from tessera.sources import extract

SQL = "CREATE TABLE owners (id int PRIMARY KEY);\nCREATE TABLE pets (id int, owner int REFERENCES owners (id), food int REFERENCES foods (id));\n"
MORE = "CREATE TABLE foods (id int);\nCREATE VIEW hungry AS SELECT * FROM pets JOIN elsewhere ON true;\nALTER TABLE pets ADD CONSTRAINT c FOREIGN KEY (id) REFERENCES owners (id);\n"
PROTO = 'syntax = "proto3";\npackage shop.v1;\nmessage Item { string name = 1; Kind kind = 2; message Kind { int32 id = 1; } }\nmessage Cart { repeated Item items = 1; Item.Kind first = 2; .shop.v1.Item last = 3; other.Thing thing = 4; }\n'


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("db/migrations/001_a.sql", SQL), ("db/migrations/002_b.sql", MORE), ("api/shop.proto", PROTO)], "path string, text string")
    return extract.to_facts(files, extract.extract(files))


def test_walk_from_pets_to_owners(spark, facts):
    names = {r.id: r.display_name for r in facts.symbols.collect()}
    pets = next(i for i, n in names.items() if n == "pets")
    walk = traverse.neighborhood(facts.edges, pets, ["depends-on"], "outgoing")
    assert sorted(names.get(r.id, r.id) for r in walk.nodes.collect()) == ["foods", "owners", "pets"]
    view = next(i for i, n in names.items() if n == "hungry")
    assert sorted(names.get(r.to, r.to) for r in facts.edges.where("kind = 'depends-on'").collect() if r["from"] == view) == ["open:sql:elsewhere", "pets"]


def test_protobuf_names_are_sought_outwards(facts):
    names = {r.id: r.stable_name.split("#")[-1] for r in facts.symbols.collect()}
    got = {(names[r["from"]], names.get(r.to, r.to)) for r in facts.edges.where("kind = 'references'").collect() if r["from"] in names and "proto" in r["from"]}
    assert got == {("shop.v1.Item.kind", "shop.v1.Item.Kind"), ("shop.v1.Cart.items", "shop.v1.Item"), ("shop.v1.Cart.first", "shop.v1.Item.Kind"), ("shop.v1.Cart.last", "shop.v1.Item"), ("shop.v1.Cart.thing", "open:protobuf:other.Thing")}


def test_edges_stay_distinct(facts):
    assert facts.edges.count() == facts.edges.select("id").distinct().count()


def test_large_files_are_reported(spark, monkeypatch):
    monkeypatch.setattr(extract, "MOST_BYTES", 40)
    files = spark.createDataFrame([("a.sql", "CREATE TABLE t (id int);"), ("db/migrations/b.sql", SQL), ("db/migrations/s.sql", "CREATE TABLE t (id int);")], "path string, text string")
    rows = extract.extract(files).where("family = 'problem'").collect()
    assert [(r.path, "bytes is over 40" in r.text) for r in rows] == [("db/migrations/b.sql", True)]


def test_excerpts_spend_only_what_they_quote(spark):
    import hashlib

    from tessera.operators import context

    texts = {"a": "\n".join(["x" * 10] * 9), "b": "\n".join(["y" * 100] * 3), "c": "one\ntwo\nthree"}
    contents = spark.createDataFrame(list(texts.items()), "document_id string, text string")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    places = [(1, "a", 4, 4), (2, "b", 1, 1), (3, "c", 1, 1), (4, "c", 2, 2), (5, "c", 7, 7), (6, "gone", 0, 0), (7, "c", 0, 0)]
    rows = [(p, d, digest(texts.get(d, "")) if p != 7 else "other", f, last) for p, d, f, last in places]
    frame = spark.createDataFrame(rows, "pos int, document_id string, content_hash string, first int, last int")
    got = {r.pos: (r.status, r.start, r.quoted) for r in context.excerpts(frame, contents, 2, 70).collect()}
    # 50 bytes go to the first; the second fits neither way and costs nothing; the third fits with its 11, the fourth alone.
    assert got[1] == ("current", 2, "\n".join(["x" * 10] * 5)) and got[2] == ("over budget", None, None)
    assert got[3] == ("current", 0, "one\ntwo\nthree") and got[4] == ("current", 2, "three")
    assert got[5][0] == "out of range" and got[6][0] == "missing" and got[7][0] == "changed"
    alone = {r.pos: r.quoted for r in context.excerpts(frame, contents, 2, 60).collect()}
    assert alone[3] == "two" and alone[1] is not None
