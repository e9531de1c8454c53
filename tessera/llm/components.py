"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import giving_back, spool, unspool

#: So many links, and no more, are finished in one task (32 bytes each, with its tables).
ONE_TASK = 300_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (x, y); root is the least node that
    links reach. Each round aggregates minima and joins, so a node of many links
    costs no task more than its share; nothing is collected. Once ONE_TASK links or
    fewer are left, one task joins them, which gives the same roots."""
    edges = spool(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
    state = None
    while got != state:
        state = got
        if got[0] <= ONE_TASK:
            return spool(edges.repartition(1).mapInArrow(giving_back(_joined), "node long, root long"), edges)
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = spool(large)
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        before, edges = edges, spool(small.unionByName(least.select("x", F.col("m").alias("y"))).where("x <> y").distinct())
        unspool(before, large)
        got = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
    roots = edges.groupBy("x").agg(F.min("y").alias("root"))
    return roots.select(F.col("x").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find whose roots are the least nodes."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above.get(x, x)
        return top

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(x), find(y)
            above.setdefault(a, a)
            above.setdefault(b, b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])
