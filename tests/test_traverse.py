"""Bounded walks against a plain queue, on random graphs with tight bounds."""

import random
from collections import deque

import pandas as pd
import pytest

from tessera.operators import traverse
from tessera.operators.traverse import COMPARE, Bounds
from tessera.schema import EDGE_KINDS

KINDS = ["calls", "depends-on", "defines", "references"]


class Graph:
    """Edges as dicts, read as the store would: by kind, other end, id."""

    def __init__(self, edges):
        self.edges = edges

    def read(self, node, way, limit):
        near, far = ("from", "to") if way == "out" else ("to", "from")
        mine = sorted((e for e in self.edges if e[near] == node), key=lambda e: (EDGE_KINDS.index(e["kind"]), e[far], e["id"]))
        return sorted(mine[:limit], key=lambda e: [e[c] for c in COMPARE]), len(mine) > limit

    def level(self, frontier, room):
        rows = []
        for at, (node, way) in enumerate(frontier):
            far = "to" if way == "out" else "from"
            near = "from" if way == "out" else "to"
            rows += [(at, way, e[far], *(e[c] for c in COMPARE), EDGE_KINDS.index(e["kind"])) for e in self.edges if e[near] == node]
        frame = pd.DataFrame(rows, columns=["at", "way", "other", *COMPARE, "code"])
        return frame.sort_values(["at", "code", "other", "id"], kind="stable").head(room + 1)


def queue_impact(graph, roots, bounds):
    nodes, waiting, spent, cut, used = list(roots), deque((r, 0) for r in roots), 0, False, []
    while waiting:
        node, depth = waiting.popleft()
        if depth == bounds.max_depth:
            cut = True
        elif spent >= bounds.max_edges:
            return nodes, used, True
        else:
            edges, more = graph.read(node, "in", bounds.max_edges - spent)
            spent, cut = spent + len(edges), cut or more
            for e in edges:
                if e["from"] not in nodes:
                    if len(nodes) < bounds.max_nodes:
                        nodes.append(e["from"]), used.append(e["id"]), waiting.append((e["from"], depth + 1))
                    else:
                        cut = True
    return nodes, used, cut


def queue_path(graph, source, target, bounds):
    met, by, waiting, spent, cut = {source}, {}, deque([(source, 0)]), 0, False
    while waiting:
        node, depth = waiting.popleft()
        if depth == bounds.max_depth:
            cut = True
            continue
        if spent >= bounds.max_edges:
            return None, True
        edges, more = graph.read(node, "out", bounds.max_edges - spent)
        spent, cut = spent + len(edges), cut or more
        for e in edges:
            if e["to"] in met:
                continue
            met.add(e["to"])
            by[e["to"]] = e
            if e["to"] == target:
                chain = []
                while target != source:
                    chain.append(by[target]["id"])
                    target = by[target]["from"]
                return chain[::-1], cut
            if len(met) >= bounds.max_nodes:
                cut = True
            else:
                waiting.append((e["to"], depth + 1))
    return None, cut


def queue_near(graph, root, ways, bounds):
    waiting = deque((root, 0, w) for w in ways)
    states, nodes, used, spent, cut = {(root, w) for w in ways}, {root}, {}, 0, False
    while waiting:
        node, depth, way = waiting.popleft()
        room = bounds.max_edges - spent
        if depth == bounds.max_depth:
            if room <= 0:
                cut = True
                continue
            edges, more = graph.read(node, way, 1)
            spent, cut = spent + len(edges), cut or more or bool(edges)
            continue
        if room <= 0:
            cut = True
            break
        edges, more = graph.read(node, way, room)
        spent, cut = spent + len(edges), cut or more
        for e in edges:
            other = e["to"] if way == "out" else e["from"]
            if other not in nodes and len(nodes) >= bounds.max_nodes:
                cut = True
                continue
            nodes.add(other)
            used[e["id"]] = e
            if (other, way) not in states:
                states.add((other, way))
                waiting.append((other, depth + 1, way))
    return nodes, sorted(used.values(), key=lambda e: [e[c] for c in COMPARE]), cut


@pytest.fixture
def plain(monkeypatch):
    """Walks on plain rows: the level is a list, the result a tuple."""
    monkeypatch.setattr(traverse, "_level", lambda g, f, room: g.level(f, room))
    monkeypatch.setattr(traverse, "of_kinds", lambda g, kinds: g)
    monkeypatch.setattr(traverse, "_result", lambda _, nodes, edges, cut: ([n for _, n in nodes], list(edges["id"]), cut))
    Graph.sparkSession = None


def random_graph(rng):
    names = [f"n{k}" for k in range(rng.randrange(2, 9))]
    n = rng.randrange(0, 22)
    edges = [{"from": rng.choice(names), "to": rng.choice(names), "kind": rng.choice(KINDS), "evidence": rng.choice(["exact", "declared"]), "id": f"e{k:02}"} for k in range(n)]
    rng.shuffle(edges)
    return names, Graph(edges), Bounds(rng.randrange(1, 5), rng.randrange(1, 9), rng.randrange(1, 20))


def test_walks_are_what_a_queue_gives(plain):
    rng = random.Random(11)
    for _ in range(1500):
        names, graph, bounds = random_graph(rng)
        roots = sorted(set(rng.sample(names, rng.randrange(1, 3))))
        if len(roots) <= bounds.max_nodes:
            assert traverse.impact(graph, roots, None, bounds) == queue_impact(graph, roots, bounds)
        a, b = rng.choice(names), rng.choice(names)
        if a != b:
            _, ids, cut = traverse.path(graph, a, b, None, bounds)
            want, want_cut = queue_path(graph, a, b, bounds)
            assert (ids, cut) == (want or [], want_cut)
        for way, ways in (("outgoing", ["out"]), ("incoming", ["in"]), ("both", ["out", "in"])):
            nodes, ids, cut = traverse.neighborhood(graph, a, None, way, bounds)
            want_nodes, want_edges, want_cut = queue_near(graph, a, ways, bounds)
            assert (set(nodes), ids, cut) == (want_nodes, [e["id"] for e in want_edges], want_cut)


def frame(spark, edges):
    return spark.createDataFrame([(f"{a}{b}{k}", a, b, k, "exact") for a, b, k in edges], "id string, `from` string, `to` string, kind string, evidence string")


def test_small_walks_in_spark(spark):
    edges = frame(spark, [("a", "b", "calls"), ("a", "c", "calls"), ("b", "d", "calls"), ("c", "d", "calls")])
    walk = traverse.path(edges, "a", "d", ["calls"], Bounds(4, 10, 20))
    assert [r.id for r in walk.edges.orderBy("pos").collect()] == ["abcalls", "bdcalls"] and not walk.truncated
    walk = traverse.impact(edges, ["d"], ["calls"], Bounds(8, 2, 100))
    assert [r.id for r in walk.nodes.orderBy("pos").collect()] == ["d", "b"] and walk.truncated
    walk = traverse.neighborhood(edges, "b", None, "both", Bounds(1, 10, 10))
    assert {r.id for r in walk.nodes.collect()} == {"a", "b", "d"}
    assert {r.id: r.depth for r in traverse.reachable(edges, spark.createDataFrame([("d",)], "id string")).collect()} == {"d": 0, "b": 1, "c": 1, "a": 2}
    with pytest.raises(ValueError):
        traverse.neighborhood(edges, "b", None, "sideways")
    with pytest.raises(ValueError):
        traverse.adjacent(edges, "a", "out", ["likes"])
    with pytest.raises(ValueError):
        Bounds(0)


def test_selection_is_by_code_or_by_text(spark):
    edges = frame(spark, [("a", "b", "defines"), ("a", "c", "depends-on"), ("a", "d", "writes")])
    assert [r.kind for r in traverse.adjacent(edges, "a", limit=1).collect()] == ["depends-on"]
    assert [r.kind for r in traverse.adjacent(edges, "a", limit=1, by_text=True).collect()] == ["defines"]
    assert traverse.is_cut(edges, "a", "out", None, 2) and not traverse.is_cut(edges, "a", "out", None, 3)


def test_dependencies_prefer_depends_on(spark):
    edges = frame(spark, [("a", "b", "imports"), ("a", "b", "depends-on"), ("a", "c", "imports")])
    assert [(r.to, r.kind) for r in traverse.dependencies(edges, "a").collect()] == [("b", "depends-on"), ("c", "imports")]


def listed(walk):
    columns = ["id", "from", "to", "kind", "evidence"]
    return [(r.pos, r.depth, r.id) for r in walk.nodes.orderBy("pos").collect()], [(r.pos, *(r[c] for c in columns)) for r in walk.edges.orderBy("pos").collect()], walk.truncated


@pytest.mark.parametrize("way", ["impact", "path", "both", "outline"])
def test_walks_without_budgets_are_what_a_queue_gives(spark, monkeypatch, way):
    """Nodes and edges in the queue's order, with frontiers broadcast or shuffled."""
    from tessera.operators import levels

    monkeypatch.setattr(traverse, "MOST_IN_FILTER", 1)
    monkeypatch.setattr(levels, "MOST_BROADCAST", 2)
    rows = [("a", "d"), ("a", "b"), ("a", "c"), ("b", "e"), ("c", "e"), ("c", "a"), ("d", "e"), ("d", "f"), ("d", "g"), ("e", "h"), ("f", "h"), ("h", "i")]
    edges = spark.createDataFrame([(f"e{k:02}", a, b, "contains" if way == "outline" else "calls", "exact") for k, (a, b) in enumerate(rows)], traverse.EDGE).coalesce(1)
    symbols = spark.createDataFrame([(n,) for n in "abcdegh"], "id string").coalesce(1)
    walk = {
        "impact": lambda b: traverse.impact(edges, ["e", "h"], ["calls"], b), "path": lambda b: traverse.path(edges, "a", "h", None, b),
        "both": lambda b: traverse.neighborhood(edges, "d", None, "both", b), "outline": lambda b: traverse.outline(edges, symbols, "a", b),
    }[way]
    depth = 3 if way == "path" else 2
    assert listed(walk(Bounds(depth, None, None))) == listed(walk(Bounds(depth)))
    with pytest.raises(ValueError):
        Bounds(8, None, 5)


def test_queries_walk_without_budgets(spark, sf, monkeypatch):
    """At size, path, neighbourhood, outline and impact pass any budget of nodes, which SQL doesn't have."""
    from tessera.plans import changes, registry

    class Asked(Exception):
        pass

    def asked(edges, *more, bounds=None, **named):
        raise Asked(bounds or more[-1])

    for name in ("path", "neighborhood", "outline", "impact"):
        monkeypatch.setattr(traverse, name, asked)
    for query in (registry.g5_path, registry.g7_neighborhood, registry.g8_outline, registry.g6_impact, changes.d1_impact, changes.d1_tests):
        with pytest.raises(Asked) as e:
            query(spark, sf)
        assert e.value.args[0].whole
