"""Text functions, search, snapshots, policy, federation, store and streams on small facts."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import federate, policy, render, search, snapshots
from tessera.schema import FAMILIES, Facts, conform, empty, problems
from tessera.sources.store import Store
from tessera.streaming import ingest


def small(spark, name="u", symbols=(), edges=(), documents=(), occurrences=()):
    base = {f: spark.createDataFrame([], "id string") for f in FAMILIES}
    base["units"] = spark.createDataFrame([(name, "p", "1", f"fp-{name}")], "id string, provider string, provider_version string, surface_fingerprint string")
    if symbols:
        base["symbols"] = spark.createDataFrame([(i, name, s, d, T_lower(d), list(t), k, doc, "p", "exact") for i, s, d, t, k, doc in symbols], "id string, unit_id string, stable_name string, display_name string, normalized_name string, search_terms array<string>, kind string, document_id string, provider string, evidence string")
    if documents:
        base["documents"] = spark.createDataFrame([(i, name, p) for i, p in documents], "id string, unit_id string, path string")
    if edges:
        base["edges"] = spark.createDataFrame([(f"{a}-{k}-{b}", name, a, b, k, "exact") for a, k, b in edges], "id string, unit_id string, `from` string, `to` string, kind string, evidence string")
    if occurrences:
        base["occurrences"] = spark.createDataFrame([(i, name, s, d, "reference") for i, s, d in occurrences], "id string, unit_id string, symbol_id string, document_id string, role string")
    return Facts(**{f: conform(df, f) for f, df in base.items()})


def T_lower(x):
    return x.strip().lower()


@pytest.mark.parametrize(("raw", "want"), [("HandleHTTPRequest2", ["2", "handle", "http", "request"]), ("parse_user-ID", ["id", "parse", "user"]), ("HTTPServerHTTP", ["http", "server"]), ("", []), ("ΟΔΟΣ", ["οδοσ"])])
def test_tokens(spark, raw, want):
    assert spark.range(1).select(T.tokens(F.lit(raw))).first()[0] == want


def test_search_terms_are_bounded(spark):
    raw = "A latency correctness " + "x" * 129
    assert spark.range(1).select(T.search_terms(F.lit(raw))).first()[0] == ["correctness", "latency"]


@pytest.mark.parametrize(("pattern", "value", "want"), [("a/**", "a/b/c", True), ("a/**", "ab", False), ("a/*", "a/b", True), ("a/*", "a/b/c", False), ("?.go", "x.go", True), ("[a-c]x", "bx", True), ("[^a]x", "ax", False), ("a.b", "axb", False), ("a\\*", "a*", True)])
def test_patterns(spark, pattern, value, want):
    assert spark.range(1).select(T.matches(F.lit(value), pattern)).first()[0] is want


@pytest.mark.parametrize(("raw", "want"), [("a/./b//c", "a/b/c"), ("../a", "../a"), ("a/../..", ".."), ("/a/../b", "/b"), ("a/..", ".")])
def test_paths(spark, raw, want):
    assert spark.range(1).select(T.clean_path(F.lit(raw))).first()[0] == want


def test_anchor_and_common_segments(spark):
    row = spark.range(1).select(T.heading_anchor(F.lit(" Hello, World-wide Web! ")), T.common_segments(F.lit("a/b/c"), F.lit("a/b/d/e"))).first()
    assert tuple(row) == ("hello-world-wide-web", 2)


@pytest.fixture(scope="module")
def named(spark):
    rows = [("s1", "ex/pkg.type.Server.method.Serve", "Serve", (), "method", ""), ("s2", "ex/pkg.type.Client.method.Serve", "Serve", (), "method", ""), ("s3", "ex/pkg.type.Server", "Server", (), "type", ""), ("s4", "doc/x", "Notes", ("artifacts", "latency"), "section", ""), ("s5", "doc/y", "Guide", ("latency", "serve"), "document", "")]
    return small(spark, symbols=rows).symbols


def test_find(named):
    got = [(r.id, r["rank"]) for r in search.find_symbols(named, "Serve").orderBy("pos").collect()]
    assert got == [("s1", 1), ("s2", 1), ("s3", 2), ("s5", 3)]
    assert [r.id for r in search.find_symbols(named, "serve", 1).collect()] == ["s1"] and search.find_truncated(named, "serve", 1)
    assert [(r.id, r["rank"]) for r in search.find_symbols(named, "s3").collect()] == [("s3", 0)]
    assert not search.find_truncated(named, "serve", 50)


def test_resolve(named):
    assert search.resolve(named, "Server.Serve").id == "s1" and search.resolve(named, "s4").id == "s4"
    assert search.resolve_unique(named, "doc/x").id == "s4"
    with pytest.raises(search.Ambiguous):
        search.resolve_unique(named, "Serve")
    with pytest.raises(search.NotFound):
        search.resolve(named, "nothing")


def test_workspace_search_and_exploration(named):
    assert [r.id for r in search.workspace_find(named, "latency serve").collect()] == ["s5"]
    assert search.explore_terms("How does the server handle requests?") == ["server", "handle", "requests"]
    assert search.variants("requests") == ["request", "requests"] and search.variants("indexed") == ["index", "indexe", "indexed", "indexs"]
    first = search.explore(named, "serve latency", 3).orderBy("pos").collect()
    assert first[0].id == "s2" and len(first) == 3


def test_snapshot_difference(spark):
    a = small(spark, symbols=[("x", "x", "X", (), "type", ""), ("y", "y", "Y", (), "type", "")], edges=[("x", "calls", "y")])
    b = small(spark, symbols=[("x", "x", "X2", (), "type", ""), ("z", "z", "Z", (), "test", "")], edges=[("x", "calls", "z"), ("z", "tests", "x")])
    got = sorted((r.family, r.change, r.id) for r in snapshots.snapshot_delta(a, b).collect())
    assert got == [("edges", "added", "x-calls-z"), ("edges", "added", "z-tests-x"), ("edges", "removed", "x-calls-y"), ("symbols", "added", "z"), ("symbols", "changed", "x"), ("symbols", "removed", "y")]
    assert {r.id for r in snapshots.current_roots(a, b).collect()} == {"x", "z"}
    assert {(r.id, r.reason) for r in snapshots.affected_tests(b, b.symbols.select("id")).collect()} == {("z", "tests x")}
    assert snapshots.surface_delta(a.units, b.units).isEmpty()


def test_integrity(spark):
    good = small(spark, symbols=[("x", "x", "X", (), "type", "d")], documents=[("d", "a.go")], occurrences=[("o", "open:y", "d")], edges=[("x", "calls", "gone")])
    assert snapshots.verify(good).isEmpty() and problems(good).isEmpty()
    bad = Facts(good.units.limit(0), good.documents, good.symbols.withColumn("document_id", F.lit("no")), good.occurrences.withColumn("symbol_id", F.lit("y")), good.edges)
    kinds = sorted(r.kind for r in snapshots.verify(bad).collect())
    assert kinds == ["invalid-symbol-document", "orphan-document", "orphan-edge", "orphan-occurrence", "orphan-symbol", "unresolved-occurrence"]
    assert snapshots.fatal(snapshots.verify(bad)).count() == 5


def test_impact_roots(spark):
    facts = small(spark, symbols=[("f", "p.F", "F", (), "function", "d"), ("v", "p.v", "v", (), "variable", "d"), ("k", "example.test/pkg", "pkg", (), "package", "")], documents=[("d", "pkg/service.go")])
    assert {r.id for r in snapshots.impact_roots(facts, ["pkg/service.go"]).collect()} == {"f"}
    assert {r.id for r in snapshots.impact_roots(facts, [], ["pkg"]).collect()} == {"f", "v", "k"}
    assert {r.missing for r in snapshots.missing_roots(facts, ["pkg/service.go", "no.go"], ["pkg", "other"]).collect()} == {"file:no.go", "package:other"}


def test_policy(spark):
    facts = small(spark, symbols=[("api", "api", "A", (), "type", "d1"), ("db", "db", "D", (), "type", "d2"), ("ui", "ui", "U", (), "type", "d3")], documents=[("d1", "api/a.go"), ("d2", "storage/d.go"), ("d3", "ui/u.go")], edges=[("api", "calls", "db"), ("api", "calls", "open:lib"), ("ui", "calls", "api")])
    layers = [policy.Layer("api", paths=["api/**"]), policy.Layer("storage", paths=["storage/**"]), policy.Layer("lib", symbols=["open:*"])]
    rules = [policy.Rule("no-storage", "forbid", "api", "storage", ["calls"]), policy.Rule("lib-only", "allow", "api", "lib", ["calls"])]
    got = sorted((r.rule, r.edge) for r in policy.violations(facts, layers, rules).collect())
    assert got == [("lib-only", "api-calls-db"), ("no-storage", "api-calls-db")]
    log = json.loads(render.sarif(policy.violations(facts, layers, rules)))
    assert [r["ruleId"] for r in log["runs"][0]["results"]] == ["lib-only", "no-storage"]
    with pytest.raises(ValueError):
        policy.checked(layers, [policy.Rule("x", "deny", "api", "lib", ["calls"])])


def test_federation(spark):
    a = small(spark, symbols=[("x", "x", "X", (), "type", "")], edges=[("x", "calls", "y")])
    both = federate.aggregate({"b": a, "a": a})
    assert [(r.id, r.source) for r in federate.unique_symbols(both.symbols).collect()] == [("x", "a")]
    assert federate.unique_edges(both.edges).count() == 1
    assert [r.sources for r in federate.provenance(both, "edges").collect()] == [["a", "b"]]
    assert federate.find_everywhere({"a": a.symbols, "b": a.symbols}, "x").count() == 1


def test_drawing(spark):
    nodes = spark.createDataFrame([("a", 'A "q"', "p"), ("b", "B", "q")], "id string, display_name string, provider string")
    edges = spark.createDataFrame([(str(k), "a", "b", "calls", "exact", "p") for k in range(3)], "id string, `from` string, `to` string, kind string, evidence string, provider string")
    text = render.dot(nodes, edges, "a")
    assert text == render.dot(nodes.repartition(3), edges, "a") and "calls ×3" in text and '\\"q\\"' in text


def test_store_replaces_units(spark, tmp_path):
    store = Store(spark, str(tmp_path / "facts"))
    assert store.load() is None
    one = small(spark, "u", symbols=[("x", "x", "X", (), "type", "")])
    two = small(spark, "v", symbols=[("y", "y", "Y", (), "type", "")])
    store.replace_units(one)
    store.replace_units(two)
    store.replace_units(two)
    assert sorted(r.id for r in store.load().symbols.collect()) == ["x", "y"]
    store.replace_units(empty(spark), spark.createDataFrame([("u",)], "id string"))
    assert [r.id for r in store.load().symbols.collect()] == ["y"] and store.collect_garbage(0) == 3
    with pytest.raises(ValueError):
        store.replace_units(small(spark, "w", symbols=[("y", "y", "Y", (), "type", "")]))
    with pytest.raises(ValueError):
        store.replace_units(small(spark, "w", symbols=[("q", "", "Y", (), "type", "")]))


def test_stream_of_batches(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "store"
    source.mkdir()

    def send(name, sent, display, removed=False):
        row = {"sent": sent, "removed": removed, "unit": {"id": "u", "provider": "p"}, "symbols": [] if removed else [{"id": "x", "unit_id": "u", "stable_name": "x", "display_name": display, "evidence": "exact"}]}
        (source / name).write_text(json.dumps(row) + "\n")

    def run():
        ingest.watch(spark, str(source), str(root), str(tmp_path / "marks"), once=True).awaitTermination()
        return [r.display_name for r in Store(spark, str(root)).load().symbols.collect()]

    send("1.json", 1, "X")
    assert run() == ["X"]
    send("2.json", 2, "Y"), send("3.json", 3, "Z")
    assert run() == ["Z"] and run() == ["Z"]
    send("4.json", 4, "", removed=True)
    assert run() == []


def test_unit_states_and_retry(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, input_fingerprint string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "id string, input_fingerprint string")
    assert {r.id: r.state for r in ingest.unit_changes(before, after).collect()} == {"a": "reuse", "b": "refresh", "c": "removed", "d": "new"}
    retry = ingest.Retry()
    assert [retry.failed("t") for _ in range(7)] == [0.75, 1.5, 3.0, 6.0, 12.0, 24.0, 30.0]
    assert retry.may_try("new", 0) and not retry.may_try("t", 5)
