"""Rules over edges, their configuration, inventories and places in lines."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from test_library import small

from tessera.functions import text as T
from tessera.operators import inventory, policy

CONFIG = {"schema": 1, "layers": [{"id": "a", "paths": ["x/**"]}, {"id": "b", "symbols": ["s?"]}], "rules": [{"id": "r", "action": "forbid", "from": "a", "to": "b", "kinds": ["calls"]}]}


def test_configurations_are_strict():
    layers, rules = policy.load_config(json.dumps(CONFIG))
    assert [x.id for x in layers] == ["a", "b"] and rules[0].source == "a"
    for bad in ({**CONFIG, "more": 1}, {**CONFIG, "layers": [{"id": "a", "paths": ["x"], "path": "y"}]}, {**CONFIG, "rules": [{**CONFIG["rules"][0], "form": "a"}]}):
        with pytest.raises(ValueError, match="unknown"):
            policy.load_config(json.dumps(bad))
    for text in (json.dumps(CONFIG) + " {}", '{"layers": [], "layers": []}', "[]"):
        with pytest.raises(ValueError):
            policy.load_config(text)


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    nodes = [f"s{k}" for k in range(8)]
    edges = [(a, k, b) for a, b in itertools.product([*nodes, "open:q"], repeat=2) for k in ("calls", "imports", "reads") if rng.random() < 0.3]
    facts = small(spark, symbols=[(n, f"pkg.{n}", n, (), "type", f"d{n}") for n in nodes], documents=[(f"d{n}", f"{'x' if int(n[1:]) % 2 else 'y/z'}/{n}") for n in nodes], edges=edges)
    layers = [policy.Layer("odd", paths=["x/**"]), policy.Layer("low", symbols=["s[0-3]"]), policy.Layer("deep", paths=["y/*/*"]), policy.Layer("open", symbols=["open:*"])]
    inside = lambda n: {x for x, hit in (("odd", n[0] == "s" and int(n[1:]) % 2 == 1), ("low", n in nodes[:4]), ("deep", n[0] == "s" and int(n[1:]) % 2 == 0), ("open", n == "open:q")) if hit}
    for _ in range(4):
        rules = [policy.Rule(f"r{k}", rng.choice(["allow", "forbid"]), rng.choice(layers).id, rng.choice(layers).id, rng.sample(["calls", "imports", "reads"], 2)) for k in range(5)]
        want = set()
        for a, kind, b in edges:
            met = [r for r in rules if kind in r.kinds and r.source in inside(a)]
            want |= {(r.id, f"{a}-{kind}-{b}") for r in met if r.action == "forbid" and r.target in inside(b)}
            allows = [r for r in met if r.action == "allow"]
            if allows and not any(r.target in inside(b) for r in allows):
                want.add((allows[0].id, f"{a}-{kind}-{b}"))
        got = [(r.rule, r.edge) for r in policy.violations(facts, layers, rules).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_entities_of_a_workspace(spark):
    paths = spark.createDataFrame([("README.md",), ("a/b/c.go",), ("a/d.go",), ("a/b/e.go",)], "path string")
    got = {r.path: (r.kind, r.parent, r.children) for r in inventory.entities(paths).collect()}
    assert got == {"README.md": ("file", ".", 0), "a": ("directory", ".", 2), "a/b": ("directory", "a", 2), "a/b/c.go": ("file", "a/b", 0), "a/b/e.go": ("file", "a/b", 0), "a/d.go": ("file", "a", 0)}


def test_places_in_lines(spark):
    line = "aé😀b"
    frame = spark.createDataFrame([(line, k) for k in range(-1, 10)], "line string, k int")
    for unit, encoding, width in (("utf-32", "utf-32-le", 4), ("utf-16", "utf-16-le", 2), ("utf-8", "utf-8", 1)):
        got = [r[0] for r in frame.select("k", T.byte_column(F.col("line"), F.col("k"), unit).alias("b")).orderBy("k").select("b").collect()]
        ends = {len(line[:n].encode(encoding)) // width: len(line[:n].encode()) for n in range(len(line) + 1)}
        assert got == [ends.get(k) if unit != "utf-8" else k if 0 <= k <= 8 else None for k in range(-1, 10)]


def test_exploration_of_documents_domains_and_surfaces(spark):
    from tessera.operators import search

    rows = [(f"g{k}", f"app/surfaces/gui/menu.type.T{k}.method.Open", "Open", ("open", "menu"), "method", "") for k in range(6)]
    rows += [("t1", "app/surfaces/tui/menu.function.Open", "Other", ("open",), "parameter", "")]
    named = small(spark, symbols=rows).symbols
    found = [r.id for r in search.explore(named, "open menu gui tui", 3).orderBy("pos").collect()]
    assert len(found) == 3 and found[-1] == "t1"
    assert "t1" not in [r.id for r in search.explore(named, "open menu", 3).collect()]
    rows = [("o1", "app/domains/orders.function.Ship", "Ship", ("ship",), "function", ""), ("o2", "app/domains/orders.function.Pay", "Pay", ("ship",), "function", ""), ("u1", "app/domains/users.function.Shipper", "Shipper", ("ship",), "function", "")]
    named = small(spark, symbols=rows).symbols
    assert {r.id for r in search.explore(named, "ship order", 8).collect()} == {"o1", "o2"}
    assert {r.id for r in search.explore(named, "ship", 8).collect()} == {"o1", "o2", "u1"}
    rows = [("d", "guide.md", "Guide", ("alpha",), "document", ""), *[(f"s{k}", f"guide.md#s{k}", f"Part {k}", ("alpha",), "section", "") for k in range(3)], ("x", "x.md", "X", ("alpha",), "section", "")]
    scores = {r.id: r.score for r in search.explore(small(spark, symbols=rows).symbols, "alpha", 8).collect()}
    alone = {r.id: r.score for r in search.explore(small(spark, symbols=rows[:2] + rows[-1:]).symbols, "alpha", 8).collect()}
    assert scores["s0"] - scores["x"] >= 40 and alone["s0"] - alone["x"] < 40
