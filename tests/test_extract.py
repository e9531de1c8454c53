"""Extractors on small files."""

import pytest

from tessera.operators import snapshots
from tessera.sources import extract

FILES = {
    "db/1.sql": "CREATE TABLE owners (id int primary key, name text);\n-- note; with a semicolon\nCREATE TABLE pets (id int, owner int REFERENCES owners(id));\nCREATE TYPE mood AS ENUM ('ok', 'bad');\nVACUUM;",
    "db/2.sql": "CREATE VIEW v AS SELECT * FROM pets JOIN owners ON true;\nALTER TABLE pets ADD COLUMN x int;",
    "a.proto": 'syntax = "proto3";\npackage shop.v1;\nimport "b.proto";\nmessage Order { string id = 1; repeated Item items = 2; enum State { NEW = 0; } }\nservice Shop { rpc Get(Order) returns (stream Order); }',
    "s.graphql": "interface Node { id: ID! }\ntype User implements Node { id: ID! friends(first: Int): [User!] }\nenum Role { ADMIN USER }\nunion Any = User | Node",
    "openapi.json": '{"openapi": "3.0.0", "paths": {"/pets": {"get": {"operationId": "list", "x": {"$ref": "#/components/schemas/Pet"}}}}, "components": {"schemas": {"Pet": {"properties": {"tag": {"$ref": "other.json#/T"}}}}}}',
    "m.tf": 'variable "size" {}\nresource "aws_instance" "web" {\n  count = var.size\n  depends_on = [module.net]\n}\nmodule "net" { source = "./net" }',
    "go.mod": "module example.test/app\n\nrequire (\n\texample.test/lib v1.2.3\n)\n",
    "Cargo.toml": '[package]\nname = "app"\n[dependencies]\nserde = "1"\n',
    "docs/a.md": "# Top\n\nSee [b](b.md#two) and ![i](../i.png).\n\n## Part\n\n```py\n# not a heading\n```\n\n## Part\n\n<https://x.test>\n",
    "p/q.py": "import os\nclass A(Base):\n    def f(self):\n        return os.getcwd()\n",
    "bad.py": "def (:",
    "notes.txt": "nothing",
}


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame(list(FILES.items()), "path string, text string").cache()
    return frame, extract.extract(frame).cache()


def edges_of(rows, path):
    return {(r.a.split("#")[-1], r.kind, r.b.split("#")[-1]) for r in rows.where(f"family = 'edge' AND path = '{path}'").collect()}


def names_of(rows, path, kind):
    return {r.b for r in rows.where(f"family = 'symbol' AND path = '{path}' AND kind = '{kind}'").collect()}


def test_sql(rows):
    _, got = rows
    assert names_of(got, "db/1.sql", "sql-table") == {"owners", "pets"} and names_of(got, "db/1.sql", "sql-column") == {"id", "name", "owner"}
    assert ("pets", "depends-on", "open:sql:owners") in edges_of(got, "db/1.sql")
    assert {("v", "depends-on", "open:sql:pets"), ("v", "depends-on", "open:sql:owners"), ("sql-migrations:db/2.sql", "references", "open:sql:pets")} <= edges_of(got, "db/2.sql")
    assert names_of(got, "db/1.sql", "sql-enum-value") == {"ok", "bad"} and got.where("family = 'problem' AND path = 'db/1.sql'").count() == 1


def test_schemas(rows):
    _, got = rows
    assert names_of(got, "a.proto", "protobuf-field") == {"id", "items"} and names_of(got, "a.proto", "protobuf-rpc") == {"Get"}
    assert {("protobuf:a.proto", "imports", "protobuf:b.proto"), ("shop.v1.Order.items", "references", "open:protobuf:Item"), ("shop.v1.Shop.Get", "references", "open:protobuf:Order")} <= edges_of(got, "a.proto")
    assert {("User", "implements", "Node"), ("User.friends", "references", "User"), ("Any", "references", "User")} <= edges_of(got, "s.graphql")
    assert names_of(got, "s.graphql", "graphql-enum-value") == {"ADMIN", "USER"} and names_of(got, "s.graphql", "graphql-argument") == {"first"}
    assert {("paths/pets.get", "references", "components/schemas/Pet"), ("components/schemas/Pet.tag", "references", "/T")} <= edges_of(got, "openapi.json")
    assert {("aws_instance.web", "depends-on", "module.net"), ("aws_instance.web", "references", "var.size"), ("module.net", "depends-on", "open:terraform:./net")} <= edges_of(got, "m.tf")


def test_builds(rows):
    _, got = rows
    assert ("project.example.test/app", "depends-on", "open:go:example.test/lib") in edges_of(got, "go.mod")
    assert ("project.app", "depends-on", "open:cargo:serde") in edges_of(got, "Cargo.toml")


def test_markdown_and_python(rows):
    _, got = rows
    assert names_of(got, "docs/a.md", "section") == {"Top", "Part"}
    assert {("markdown:docs/a.md", "contains", "top"), ("top", "contains", "part"), ("top", "contains", "part-1"), ("top", "links-to", "two"), ("top", "embeds", "markdown:i.png"), ("part-1", "links-to", "external:https://x.test")} <= edges_of(got, "docs/a.md")
    assert {("p.q", "imports", "open:python:os"), ("p.q.A", "extends", "open:python:Base"), ("p.q.A.f", "calls", "open:python:os.getcwd")} <= edges_of(got, "p/q.py")
    assert got.where("family = 'problem' AND path = 'bad.py'").count() == 1 and got.where("path = 'notes.txt'").count() == 0


def test_facts_of_files_are_sound(rows):
    files, got = rows
    assert snapshots.verify(extract.to_facts(files, got)).isEmpty()
    assert [(r["from"], r.to) for r in extract.migration_order(files).collect()] == [("sql-migrations:db/2.sql", "sql-migrations:db/1.sql")]


def test_frames(spark):
    run = ["run.begin", "unit.begin", "facts", "unit.end", "run.end"]
    frame = lambda kinds: spark.createDataFrame([("r", k, "{}", n) for n, k in enumerate(kinds)], extract.FRAME)
    assert extract.frame_problems(frame(run)).isEmpty()
    assert extract.frame_problems(frame(run[:-1])).count() == 1
    assert extract.frame_problems(frame(["run.begin", "facts", "run.end"])).count() == 2
