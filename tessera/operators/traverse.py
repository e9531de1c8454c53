"""Adjacency and bounded breadth-first walks.

A walk is taken level by level. One job a level joins the edges with the frontier
and keeps the first edges that the budget allows, in the order in which a queue
would read them; what is kept, and so what the driver holds, is bounded by
`max_nodes` and `max_edges`. The set rules per level give what a queue would. A walk
whose Bounds have no such budgets (None) is taken by `levels.Whole`, of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import EDGE_KINDS, IMPACT_KINDS, kind_code

MOST_READ = 100_000
COMPARE = ["from", "kind", "to", "evidence", "id"]
EDGE = "id string, `from` string, `to` string, kind string, evidence string"


@dataclass(frozen=True)
class Bounds:
    max_depth: int = 8
    max_nodes: int | None = 100_000
    max_edges: int | None = 1_000_000

    def __post_init__(self):
        if not (1 <= self.max_depth <= 100 and (self.whole or (1 <= (self.max_nodes or 0) <= 100_000 and 1 <= (self.max_edges or 0) <= 1_000_000))):
            raise ValueError("bounds are 1-100 levels, 1-100000 nodes, 1-1000000 edges, or neither a number of nodes nor of edges")

    @property
    def whole(self) -> bool:
        return self.max_nodes is None and self.max_edges is None


@dataclass(frozen=True)
class Walk:
    """nodes (pos, depth, id) and edges (pos and EDGE) of a walk."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


@dataclass(frozen=True)
class Indexed:
    """The same edges twice, sorted by either end; a walk reads what its direction needs."""

    out: DataFrame
    into: DataFrame

    def where(self, condition) -> Indexed:
        return Indexed(self.out.where(condition), self.into.where(condition))

    @property
    def sparkSession(self):  # as a DataFrame has it
        return self.out.sparkSession


MOST_IN_FILTER = 1000


def _near(edges: DataFrame | Indexed, way: str, nodes: list[str]) -> DataFrame:
    """Edges that may leave the nodes in the direction; a few nodes are a filter of the scan."""
    source = edges if isinstance(edges, DataFrame) else edges.out if way == "out" else edges.into
    return source.where(F.col("from" if way == "out" else "to").isin(nodes)) if len(nodes) <= MOST_IN_FILTER else source


def of_kinds(edges: DataFrame | Indexed, kinds: list[str] | None) -> DataFrame | Indexed:
    if unknown := set(kinds or ()) - set(EDGE_KINDS):
        raise ValueError(f"unknown edge kinds {sorted(unknown)}")
    return edges.where(F.col("kind").isin(kinds)) if kinds else edges


def adjacent(edges: DataFrame, node: str, direction: str = "out", kinds: list[str] | None = None, limit: int = 50, by_text: bool = False) -> DataFrame:
    """Edges of a node: the first `limit` by kind, other end and id, then in the
    order of edges, as `pos`. Kinds rank by code, or by_text as strings."""
    near, far = ("from", "to") if direction == "out" else ("to", "from")
    rank = F.col("kind") if by_text else kind_code(F.col("kind"))
    picked = _near(of_kinds(edges, kinds), direction, [node]).orderBy(rank, far, "id").limit(limit)
    return picked.withColumn("pos", F.row_number().over(Window.orderBy(*COMPARE)))  # limit rows


def is_cut(edges: DataFrame, node: str, direction: str, kinds: list[str] | None, limit: int) -> bool:
    return _near(of_kinds(edges, kinds), direction, [node]).limit(limit + 1).count() > limit


def callers(edges: DataFrame, node: str, limit: int = 50) -> DataFrame:
    return adjacent(edges, node, "in", ["calls"], limit)


def callees(edges: DataFrame, node: str, limit: int = 50) -> DataFrame:
    return adjacent(edges, node, "out", ["calls"], limit)


def references(occurrences: DataFrame, symbol: str, limit: int = 50, roles: tuple[str, ...] = ("reference",)) -> DataFrame:
    """Occurrences of a symbol, by document and id; no role means any."""
    found = occurrences.where(F.col("symbol_id") == symbol)
    found = found.where(F.col("role").isin(*roles)) if roles else found
    return found.orderBy("document_id", "id").limit(limit)


def dependencies(edges: DataFrame, node: str, limit: int = 50) -> DataFrame:
    """One edge for each target of depends-on or imports; depends-on goes first."""
    mine = _near(edges, "out", [node]).where(F.col("kind").isin("depends-on", "imports"))
    one = mine.withColumn("k", F.row_number().over(Window.partitionBy("from", "to").orderBy("kind", "evidence", "id"))).where("k = 1").drop("k")
    return one.orderBy("to", "id").limit(limit)


def _level(edges: DataFrame, frontier: list[tuple[str, str]], room: int) -> pd.DataFrame:
    """The first room + 1 edges that a queue of (node, direction) would read."""
    spark = edges.sparkSession
    asked = F.broadcast(spark.createDataFrame([(k, n, d) for k, (n, d) in enumerate(frontier)], "at int, node string, way string"))
    parts = []
    for way, near, far in (("out", "from", "to"), ("in", "to", "from")):
        if any(d == way for _, d in frontier):
            mine = asked.where(F.col("way") == way)
            parts.append(_near(edges, way, [n for n, d in frontier if d == way]).join(mine, F.col(near) == F.col("node")).select("at", "way", F.col(far).alias("other"), *COMPARE, kind_code(F.col("kind")).alias("code")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.orderBy("at", "code", "other", "id").limit(room + 1).toPandas()


def _walk(edges: DataFrame, roots: list[str], ways: list[str], bounds: Bounds, *, target: str | None = None, probe: bool = False):
    """Nodes [(depth, id)], kept edges as frames by level, and the flag."""
    states = [(r, w) for r in roots for w in ways]
    seen_states, depth_of, truncated, spent = set(states), dict.fromkeys(roots, 0), False, 0
    kept, frontier, marked = [], states, len(roots)
    for depth in range(bounds.max_depth + 1):
        if not frontier:
            break
        room = bounds.max_edges - spent
        if depth == bounds.max_depth:
            truncated = truncated or not probe or room <= 0 or len(_level(edges, frontier, 0)) > 0
            break
        if room <= 0:
            truncated = True
            break
        rows = _level(edges, frontier, room)
        cut = len(rows) > room
        cut_at = int(rows["at"].iloc[room]) if cut else -1
        rows = rows.iloc[:room].sort_values(["at", *COMPARE], kind="stable")
        spent += len(rows)
        fresh = rows[~rows["other"].isin(depth_of.keys())].drop_duplicates("other")
        if target is not None:
            hit = fresh[fresh["other"] == target]
            if len(hit):
                ahead = fresh.iloc[: list(fresh["other"]).index(target)]
                full = marked + len(ahead) >= bounds.max_nodes
                cut_here = cut_at == int(hit["at"].iloc[0])
                kept.append(fresh.iloc[: len(ahead) + 1])
                return depth_of | {target: depth + 1}, kept, truncated or (full and len(ahead) > 0) or cut_here
            # Every new node counts as met, but once max_nodes are met no more are walked from.
            going = max(0, bounds.max_nodes - marked - 1)
            marked += len(fresh)
            truncated = truncated or len(fresh) > going
            kept.append(fresh)
            depth_of |= dict.fromkeys(fresh["other"], depth + 1)
            frontier_next = [(n, "out") for n in fresh["other"].iloc[:going]]
        else:
            going = bounds.max_nodes - len(depth_of)
            if len(fresh) > going:
                truncated, fresh = True, fresh.iloc[:going]
            depth_of |= dict.fromkeys(fresh["other"], depth + 1)
            if probe:
                within = rows[rows["other"].isin(depth_of.keys())]
                kept.append(within)
                states_next = dict.fromkeys(zip(within["other"], within["way"], strict=True))
                frontier_next = [s for s in states_next if s not in seen_states]
                seen_states |= set(frontier_next)
            else:
                kept.append(fresh)
                frontier_next = [(n, ways[0]) for n in fresh["other"]]
        if cut:
            truncated = True
            break
        if spent == bounds.max_edges and len(rows) and rows["at"].max() < len(frontier) - 1:
            truncated = True
            break
        frontier = frontier_next
    return depth_of, kept, truncated


def _result(spark, nodes: list[tuple[int, str]], edges: pd.DataFrame, truncated: bool) -> Walk:
    listed = [(k + 1, d, n) for k, (d, n) in enumerate(nodes)]
    rows = [(k + 1, r.id, getattr(r, "source"), r.to, r.kind, r.evidence) for k, r in enumerate(edges.rename(columns={"from": "source"}).itertuples(index=False))]
    return Walk(spark.createDataFrame(listed, "pos int, depth int, id string"), spark.createDataFrame(rows, "pos int, " + EDGE), truncated)


def _together(kept: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(kept)[COMPARE] if kept else pd.DataFrame(columns=COMPARE)


def _whole(edges, roots: list[str], ways: list[str], bounds: Bounds, **how):
    from tessera.operators.levels import Whole

    return Whole(edges, roots, ways, bounds.max_depth, **how)


def impact(edges: DataFrame, roots: list[str], kinds: list[str] | None = None, bounds: Bounds = Bounds()) -> Walk:
    """What reaches the roots: a reverse walk, each node with the edge that found it."""
    roots = sorted(set(roots))
    if not roots:
        raise ValueError("impact needs a root")
    if bounds.whole:
        return _whole(of_kinds(edges, kinds or IMPACT_KINDS), roots, ["in"], bounds)
    if len(roots) > bounds.max_nodes:
        return _result(edges.sparkSession, [(0, r) for r in roots[: bounds.max_nodes]], _together([]), True)
    depth_of, kept, truncated = _walk(of_kinds(edges, kinds or IMPACT_KINDS), roots, ["in"], bounds)
    return _result(edges.sparkSession, [(d, n) for n, d in depth_of.items()], _together(kept), truncated)


def path(edges: DataFrame, source: str, target: str, kinds: list[str] | None = None, bounds: Bounds = Bounds()) -> Walk:
    """A shortest path; the first edge that meets a node leads to it."""
    spark = edges.sparkSession
    if source == target:
        return _result(spark, [(0, source)], _together([]), False)
    if bounds.whole:
        walk = _whole(of_kinds(edges, kinds), [source], ["out"], bounds, target=target)
        chain = pd.DataFrame(walk.chain(target) if walk.met else [], columns=COMPARE)
        return _result(spark, [(0, source), *((k + 1, n) for k, n in enumerate(chain["to"]))] if walk.met else [], chain, walk.truncated)
    depth_of, kept, truncated = _walk(of_kinds(edges, kinds), [source], ["out"], bounds, target=target)
    if target not in depth_of:
        return _result(spark, [], _together([]), truncated)
    met = pd.concat(kept).set_index("other")
    at, back = target, []
    while at != source:
        back.append(met.loc[at])
        at = met.loc[at]["from"]
    chain = pd.DataFrame(back[::-1])[COMPARE]
    return _result(spark, [(0, source), *((k + 1, n) for k, n in enumerate(chain["to"]))], chain, truncated)


def neighborhood(edges: DataFrame, root: str, kinds: list[str] | None = None, direction: str = "both", bounds: Bounds = Bounds()) -> Walk:
    """The subgraph around a root; both directions share the budgets, in turn."""
    ways = {"outgoing": ["out"], "incoming": ["in"], "both": ["out", "in"]}.get(direction)
    if not root or ways is None:
        raise ValueError("a neighborhood has a root and a direction outgoing, incoming or both")
    kinds = kinds or [k for k in EDGE_KINDS if k not in ("defines", "references")]
    if bounds.whole:
        return _whole(of_kinds(edges, kinds), [root], ways, bounds, probe=True, tree=False, queued=False)
    depth_of, kept, truncated = _walk(of_kinds(edges, kinds), [root], ways, bounds, probe=True)
    rows = _together(kept).drop_duplicates("id").sort_values(COMPARE, kind="stable")
    return _result(edges.sparkSession, [(d, n) for n, d in depth_of.items()], rows, truncated)


def reachable(edges: DataFrame, roots: DataFrame, direction: str = "in", max_depth: int = 100) -> DataFrame:
    """(id, depth) of all that the roots (id) reach, of any size: frontier and
    visited nodes stay distributed and are written at each level."""
    from tessera.sources.store import spooled

    near, far = ("to", "from") if direction == "in" else ("from", "to")
    pairs = edges.select(F.col(near).alias("id"), F.col(far).alias("other")).distinct()
    seen = frontier = spooled(roots.select("id", F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        found = pairs.join(frontier.select("id"), "id").select(F.col("other").alias("id")).distinct()
        frontier = spooled(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def outline(edges: DataFrame, symbols: DataFrame, root: str, bounds: Bounds = Bounds()) -> Walk:
    """What an entity contains, level by level; only targets with a symbol count."""
    contained = of_kinds(edges, ["contains"])
    if bounds.whole:
        return _whole(contained, [root], ["out"], bounds, probe=True, tree=False, among=symbols)
    known = (contained if isinstance(contained, DataFrame) else contained.out).join(symbols.select(F.col("id").alias("to")), "to", "left_semi")
    depth_of, kept, truncated = _walk(known, [root], ["out"], bounds, probe=True)
    rows = _together(kept).drop_duplicates("id")
    return _result(edges.sparkSession, [(d, n) for n, d in depth_of.items()], rows, truncated)


def content_links(edges: DataFrame, nodes: DataFrame, limit: int | None = 50) -> DataFrame:
    """Content edges out of nodes (pos, id), node by node, up to a limit in all, if any."""
    from tessera.schema import CONTENT_KINDS

    wanted = nodes.select(F.col("id").alias("from"), F.col("pos").alias("at"))
    mine = of_kinds(edges, CONTENT_KINDS).join(wanted if limit is None else F.broadcast(wanted), "from")
    mine = mine.orderBy("at", kind_code(F.col("kind")), "to", "id")
    return mine if limit is None else mine.limit(limit)


def backlinks(edges: DataFrame, nodes: DataFrame, limit: int | None = 50) -> DataFrame:
    """Content edges into nodes (id, pos if any), and links and embeds of an alias that
    resolves to one; with a limit, the first of them as they are read: node by node,
    an alias's own right after the edge that names it."""
    from tessera.schema import CONTENT_KINDS

    wanted = nodes.select(F.col("id").alias("to"), (F.col("pos") if "pos" in nodes.columns else F.lit(0)).alias("at"))
    place = lambda: [kind_code(F.col("kind")), F.col("from"), F.col("id")]
    incoming = of_kinds(edges, CONTENT_KINDS).join(wanted, "to").withColumn("read", F.struct("at", *place(), F.lit(0).alias("then"), F.lit(0).alias("k"), F.lit("").alias("f"), F.lit("").alias("i")).cast(_READ))
    names = incoming.where("kind = 'resolves-to'").select(F.col("from").alias("to"), "read")
    through = of_kinds(edges, ["links-to", "embeds"]).join(names, "to")
    through = through.withColumn("read", F.struct("read.at", "read.kind", "read.source", "read.edge", F.lit(1).alias("then"), *place()).cast(_READ))
    both = incoming.select(*edges.columns, "read").unionByName(through.select(*edges.columns, "read"))
    if limit is None:
        return both.drop("read").dropDuplicates(["id"]).orderBy(*COMPARE)
    first = both.groupBy("id").agg(F.min_by(F.struct(*edges.columns), "read").alias("e"), F.min("read").alias("read"))
    return first.orderBy("read").limit(limit).select("e.*").orderBy(*COMPARE)


_READ = "struct<at:int,kind:int,source:string,edge:string,then:int,k:int,f:string,i:string>"


def filtered_view(edges: DataFrame, focus: str, kinds: list[str] = (), providers: list[str] = (), evidence: list[str] = (), direction: str = "both") -> DataFrame:
    """Of a drawn graph's edges, those of the kinds, providers and evidence asked for (none:
    any) whose ends the focus still reaches along the direction."""
    kept = of_kinds(edges, list(kinds))
    for name, values in (("provider", providers), ("evidence", evidence)):
        kept = kept.where(F.col(name).isin(*values)) if values else kept
    ways = {"outgoing": ["out"], "incoming": ["in"], "both": ["out", "in"]}.get(direction)
    if ways is None:
        raise ValueError("a direction is outgoing, incoming or both")
    near = {"out": ("from", "to"), "in": ("to", "from")}
    steps = [kept.select(F.col(near[w][0]).alias("from"), F.col(near[w][1]).alias("to")) for w in ways]
    steps = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    seen = reachable(steps, edges.sparkSession.createDataFrame([(focus,)], "id string"), "out", 1 << 20).select("id")
    return kept.join(seen.withColumnRenamed("id", "from"), "from", "left_semi").join(seen.withColumnRenamed("id", "to"), "to", "left_semi").select(*edges.columns)
