"""Registered queries over whole tables, against brute force and the same in SQL."""

import collections

import pytest

from tessera.operators import search
from tessera.plans import registry
from tessera.sources import project

KINDS = {"region", "nation", "customer", "supplier", "part", "order", "event", "page", "document"}


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def rows_in_sql(sf, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return sorted(db.execute(registry.ORACLE[name]).fetchall(), key=repr)


def test_postings_of_all_symbols(spark, sf):
    got = rows_of(registry.QUERIES["postings_all"](spark, sf))
    count = collections.Counter()
    for s in project.symbols(spark, sf).select("id", "display_name", "search_terms").collect():
        count.update(_words(s.display_name) | set(s.search_terms))
    assert dict(got) == dict(count)
    assert got == rows_in_sql(sf, "postings_all")


def _words(name):
    import re

    for pattern in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z])", "([0-9])([A-Za-z])", "([A-Za-z])([0-9])"):
        name = re.sub(pattern, r"\1 \2", name)
    return {w.lower() for w in re.findall("[A-Za-z0-9]+", name)}


def test_exploration_searches_all_kinds(spark, sf, monkeypatch):
    seen, explore = [], search.explore

    def kept(symbols, *more):
        seen.append({r.kind for r in symbols.select("kind").distinct().collect()})
        return explore(symbols, *more)

    monkeypatch.setattr(search, "explore", kept)
    assert len(registry.QUERIES["q7_explore"](spark, sf).collect()) == 8 and seen == [KINDS]


def test_differences_of_all_families(spark, sf):
    got = rows_of(registry.QUERIES["u3_delta_all"](spark, sf))
    assert got == rows_in_sql(sf, "u3_delta_all")
    changes = {(family, change) for family, change, _ in got}
    assert changes >= {(f, c) for f in ("documents", "symbols", "occurrences", "edges") for c in ("added", "removed", "changed")}
    assert "units" in {f for f, _ in changes}
    assert {i.split(":")[0] for f, _, i in got if f == "symbols"} >= KINDS - {"region", "nation"}  # 5 and 25 rows
    for name in ("u3_delta_all_bounded", "u5_transitions_all"):
        assert rows_of(registry.QUERIES[name](spark, sf)) == rows_in_sql(sf, name)


@pytest.mark.parametrize("name", ["g9_links", "g10_backlinks"])
def test_links_of_all_pages_and_routes(spark, sf, name):
    got = rows_of(registry.QUERIES[name + "_all"](spark, sf))
    assert got == rows_in_sql(sf, name + "_all")
    part = rows_of(registry.QUERIES[name](spark, sf))
    assert part == rows_in_sql(sf, name) and set(part) < set(got)
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
