"""Queries of the fact-graph operators over the projected tables, and the same in SQL.

Names begin with the inventory's letter and number. An order that is part of a
result is a column (pos, place, rank).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import federate, inventory, policy, render, search, snapshots, traverse
from tessera.schema import EDGE_KINDS, Facts, conform, kind_code
from tessera.sources import projected

COMPARE = traverse.COMPARE


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return projected.table(spark, d, "symbols")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return projected.table(spark, d, "edges")


def _both_ways(spark: SparkSession, d: str) -> traverse.Indexed:
    return projected.edges(spark, d)


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return projected.table(spark, d, "postings")


def s2_symbol(spark, d):
    return _symbols(spark, d).where(F.col("id") == "supplier:7").select("id", "stable_name", "kind").limit(1)


def s2_document(spark, d):
    return projected.table(spark, d, "documents").where(F.col("id") == "orders:1").select("id", "path", "content_hash").limit(1)


def s3_symbols(spark, d):
    return _symbols(spark, d).select("id", "unit_id", "stable_name", "display_name", "normalized_name", "kind", "document_id", "evidence")


def s4_hot_facts(spark, d):
    hot = _symbols(spark, d).select(F.lit("symbol").alias("family"), "id", F.col("stable_name").alias("a"), F.col("kind").alias("b"))
    return hot.unionByName(_edges(spark, d).select(F.lit("edge").alias("family"), "id", F.col("from").alias("a"), F.col("to").alias("b")))


def s7_inventory(spark, d):
    """Directories of all document paths, with the paths below each."""
    return inventory.directories(projected.table(spark, d, "documents"))


def f_adjacency_kinds(spark, d):
    return _edges(spark, d).where(F.col("kind").isin("imports", "depends-on")).groupBy("kind", "evidence").agg(F.count("*").alias("n"))


def f3_prefix(spark, d):
    return _symbols(spark, d).where(F.col("normalized_name").startswith("customer#00000001")).select("id", "normalized_name")


def f6_glob(spark, d):
    paths = projected.table(spark, d, "documents")
    return paths.where(T.matches_any(F.col("path"), ["docs/1?.txt", "pages/**", "orders/[1-3]*"])).select("id", "path")


def f10_tests(spark, d):
    facts = projected.facts(spark, d)
    declared = facts.edges.where("kind = 'links-to'").withColumn("kind", F.lit("tests"))
    facts = Facts(facts.units, facts.documents, facts.symbols, facts.occurrences, declared)
    return snapshots.affected_tests(facts, facts.symbols.select("id")).select("id", "reason")


def q1_find_symbols(spark, d, query="customer#00000001", limit=50):
    return search.find_symbols(_symbols(spark, d), query, limit, _postings(spark, d)).select("pos", "rank", "id", "normalized_name")


def q1_find_by_term(spark, d):
    return q1_find_symbols(spark, d, "widget", 40)


def q1_find_exact(spark, d):
    return q1_find_symbols(spark, d, "part/11", 10)


def q4_qualified(spark, d):
    named = _symbols(spark, d).where("kind IN ('nation', 'region')").withColumn("stable_name", F.concat(F.lit("world.type."), "kind", F.lit(".method."), "display_name"))
    return named.select("id", T.human_name(F.col("stable_name")).alias("name"))


def q5_workspace_find(spark, d):
    found = search.workspace_find(_symbols(spark, d).where("kind = 'document'"), "the and", 30)
    return found.select("place", "id", "score")


def q8_anchor_line(spark, d):
    """The line of each document that shares most words with a phrase, the first of equals."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return inventory.anchor_lines(docs, ["and", "of", "the", "that"]).withColumnRenamed("id", "doc_id")


def text_tokens(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    return parts.select("p_partkey", F.array_join(T.tokens(F.concat_ws(" ", "p_name", "p_brand", "p_type")), "|").alias("tokens"))


def text_terms(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.array_join(T.search_terms(F.col("text")), "|").alias("terms"))


def postings(spark, d):
    return search.postings(_symbols(spark, d).where("kind <> 'document'")).groupBy("token").agg(F.count("*").alias("n"))


def postings_all(spark, d):
    return _postings(spark, d).groupBy("token").agg(F.count("*").alias("n"))


def g1_edges_from(spark, d):
    return traverse.adjacent(_both_ways(spark, d), "order:7", "out", None, 3).select("pos", "id", "from", "to", "kind")


def g1_edges_to(spark, d):
    return traverse.adjacent(_both_ways(spark, d), "part:5", "in", ["references", "depends-on"], 20).select("pos", "id", "from", "to", "kind")


def g2_callers(spark, d):
    return traverse.callers(_both_ways(spark, d), "event:500").select("id", "from", "to")


def g2_callees(spark, d):
    return traverse.callees(_both_ways(spark, d), "event:500").select("id", "from", "to")


def g3_references(spark, d):
    return traverse.references(projected.table(spark, d, "occurrences"), "part:5", 25).select("id", "document_id", "role")


def g4_dependencies(spark, d):
    return traverse.dependencies(_both_ways(spark, d), "part:5", 50).select("id", "to", "kind")


def g5_path(spark, d):
    walk = traverse.path(_both_ways(spark, d), "region:1", "supplier:7", ["contains", "depends-on", "imports"], traverse.Bounds(20, None, None))
    return walk.nodes.agg(F.max("depth").alias("length"), F.min_by("id", "depth").alias("start"), F.max_by("id", "depth").alias("end"))


def _impact(spark, d, root="supplier:1"):
    walk = traverse.impact(_both_ways(spark, d), [root], ["imports", "references", "depends-on"], traverse.Bounds(20, None, None))
    return walk.nodes


def g6_impact(spark, d):
    nodes = _impact(spark, d)
    return nodes.join(_symbols(spark, d).select("id", "kind", "display_name"), "id", "left").select(F.col("depth").cast("long").alias("depth"), F.col("id").alias("node"), "kind", "display_name")


def g6_reachable(spark, d):
    roots = _symbols(spark, d).where("kind = 'supplier' AND stable_name LIKE 'supplier/1%'").select("id")
    found = traverse.reachable(_edges(spark, d).where("kind IN ('imports', 'depends-on', 'contains')"), roots)
    return found.select("id", F.col("depth").cast("long").alias("depth"))


def g7_neighborhood(spark, d):
    walk = traverse.neighborhood(_both_ways(spark, d), "nation:3", ["contains"], "both", traverse.Bounds(2, None, None))
    return walk.edges.select("id", "from", "to", "kind")


def g8_outline(spark, d):
    walk = traverse.outline(_both_ways(spark, d), _symbols(spark, d), "region:2", traverse.Bounds(8, None, None))
    return walk.nodes.select("id", F.col("depth").cast("long").alias("depth"))


def g9_links(spark, d):
    nodes = spark.range(1, 40).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("page:"), F.col("id").cast("string")).alias("id"))
    return traverse.content_links(_edges(spark, d), nodes, None).select("id", "from", "to")


def g9_links_all(spark, d):
    nodes = _symbols(spark, d).where("kind = 'page'").select(F.substring_index("id", ":", -1).cast("long").alias("pos"), "id")
    return traverse.content_links(_edges(spark, d), nodes, None).select("id", "from", "to")


def g10_backlinks(spark, d):
    nodes = _edges(spark, d).where("kind = 'links-to'").select(F.col("to").alias("id")).distinct().where("id LIKE 'route:/t%'")
    return traverse.backlinks(_edges(spark, d), nodes, None).select("id", "from", "to")


def g10_backlinks_all(spark, d):
    nodes = _edges(spark, d).where("kind = 'links-to'").select(F.col("to").alias("id")).distinct()
    return traverse.backlinks(_edges(spark, d), nodes, None).select("id", "from", "to")


def g11_impact_roots(spark, d):
    facts = projected.facts(spark, d)
    as_types = facts.symbols.withColumn("kind", F.when(F.col("kind") == "order", "type").otherwise(F.col("kind")))
    facts = Facts(facts.units, facts.documents, as_types, facts.occurrences, facts.edges)
    return snapshots.impact_roots(facts, ["orders/1", "orders/2", "docs/3.txt"])


def g14_proximity(spark, d):
    """How near the documents at either end of an edge lie: leading path segments in common."""
    docs = projected.table(spark, d, "documents")
    other = docs.select(F.col("id").alias("other"), F.col("path").alias("other_path")).where("other IN ('orders:1', 'pages:1')")
    return docs.join(F.broadcast(other)).select("id", "other", (10 * T.common_segments(F.col("path"), F.col("other_path"))).cast("long").alias("near"))


def a1_status(spark, d):
    facts = projected.facts(spark, d)
    return federate.status(federate.aggregate({"one": facts, "two": facts}))


def a2_collapsed(spark, d):
    return render.collapsed(_edges(spark, d).where("kind = 'references'")).select("from", "to", "kind", "times", "id")


def a3_unit_counts(spark, d):
    return inventory.unit_counts(_edges(spark, d))


def a4_entity_usage(spark, d):
    return snapshots.entity_usage(projected.facts(spark, d))


def a8_route_ambiguity(spark, d):
    return inventory.ambiguous_routes(_edges(spark, d))


def _versions(spark, d) -> tuple[Facts, Facts]:
    facts = projected.facts(spark, d)
    key = F.substring_index("id", ":", -1).cast("long")
    order = facts.symbols.where("kind = 'order'")
    before = order.where(key % 7 != 0)
    after = order.where(key % 11 != 0).withColumn("display_name", F.when(key % 13 == 0, F.concat("display_name", F.lit("*"))).otherwise(F.col("display_name")))
    none = facts.map(lambda _, df: df.limit(0))
    return Facts(none.units, none.documents, before, none.occurrences, none.edges), Facts(none.units, none.documents, after, none.occurrences, none.edges)


def u3_delta(spark, d):
    return snapshots.snapshot_delta(*_versions(spark, d))


def u3_delta_bounded(spark, d):
    return snapshots.snapshot_delta(*_versions(spark, d), limit=5)


#: What a changed record differs in, in each family.
_CHANGED = {"units": "surface_fingerprint", "documents": "content_hash", "symbols": "display_name", "occurrences": "role", "edges": "evidence"}


def _whole_versions(spark, d) -> tuple[Facts, Facts]:
    """Two versions of all five families, parted and changed by digests of their ids."""
    key = F.conv(F.substring(F.sha2("id", 256), 1, 6), 16, 10).cast("long")

    def later(family, df):
        c = _CHANGED[family]
        return df.where(key % 11 != 0).withColumn(c, F.when(key % 13 == 0, F.concat(c, F.lit("*"))).otherwise(F.col(c)))

    facts = projected.facts(spark, d)
    return facts.map(lambda _, df: df.where(key % 7 != 0)), facts.map(later)


def u3_delta_all(spark, d):
    return snapshots.snapshot_delta(*_whole_versions(spark, d))


def u3_delta_all_bounded(spark, d):
    return snapshots.snapshot_delta(*_whole_versions(spark, d), limit=5)


def u5_transitions_all(spark, d):
    return snapshots.transitions(*_whole_versions(spark, d))


def u4_surfaces(spark, d):
    units = _edges(spark, d).groupBy(F.col("unit_id").alias("id")).agg(F.count("*").cast("string").alias("surface_fingerprint"))
    after = units.where("id <> 'tables:calls'").withColumn("surface_fingerprint", F.when(F.col("id") == "tables:imports", "").otherwise(F.concat("surface_fingerprint", F.when(F.col("id") == "tables:contains", "x").otherwise(""))))
    return snapshots.surface_delta(units, after)


def u5_transitions(spark, d):
    return snapshots.transitions(*_versions(spark, d))


def u1_federated_edges(spark, d):
    edges = _edges(spark, d).where("kind IN ('depends-on', 'imports')")
    both = edges.withColumn("source", F.lit("b")).unionByName(edges.withColumn("source", F.lit("a")).where("`from` LIKE 'order:1%'"))
    return federate.unique_edges(both).select("id", "source")


def u1_federated_find(spark, d):
    s = _symbols(spark, d)
    return federate.find_everywhere({"b": s, "a": s.where("kind = 'customer' AND id LIKE '%1'")}, "customer#00000001", 60).select("pos", "rank", "id", "source")


def u7_removed_units(spark, d):
    units = _edges(spark, d).select(F.col("unit_id").alias("id")).distinct()
    return snapshots.removed_units(units, units.where("id LIKE '%s'"))


def p1_architecture(spark, d):
    layers = [policy.Layer("orders", paths=["orders/**"]), policy.Layer("parts", symbols=["part:*"]), policy.Layer("suppliers", units=["supplier:1*"]), policy.Layer("named", symbols=["supplier/[1-4]?"])]
    rules = [
        policy.Rule("no-part-to-supplier", "forbid", "parts", "suppliers", ["imports"]),
        policy.Rule("parts-import-named", "allow", "parts", "named", ["imports", "depends-on"], "only named suppliers"),
        policy.Rule("parts-import-some", "allow", "parts", "suppliers", ["imports"]),
    ]
    return policy.violations(projected.facts(spark, d), layers, rules).select("rule", "edge", "from", "to", "message")


def p3_verify(spark, d):
    facts = projected.facts(spark, d)
    damaged = Facts(facts.units.where("id <> 'customer:3'"), facts.documents.where("id <> 'docs:5'"), facts.symbols.where("id <> 'part:9'"), facts.occurrences, facts.edges)
    return snapshots.verify(damaged)


def k4_export(spark, d):
    return render.export(projected.facts(spark, d)).groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def fn_kind_code(spark, d):
    kinds = spark.createDataFrame([(k,) for k in EDGE_KINDS], "kind string")
    return kinds.select("kind", kind_code(F.col("kind")).alias("code"))


def fn_clean_path(spark, d):
    raw = F.concat(F.lit("./a//b/../c"), F.col("p_partkey").cast("string"), F.lit("/./d/../e"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.clean_path(raw).alias("path"))


def fn_stable_hash(spark, d):
    return spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", T.stable_hash(F.lit("file"), F.col("r_name")).alias("hash"))


def q7_explore(spark, d):
    return search.explore(_symbols(spark, d), "red widgets explained", 8, _postings(spark, d))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] != "_" and getattr(f, "__module__", "") == __name__ and name not in ("partial", "conform")}

_SYMBOLS = r"""
symbols AS (
  SELECT 'region:' || r_regionkey AS id, 'tables:region' AS unit_id, 'region/' || r_name AS stable_name, r_name AS display_name, 'region' AS kind, '' AS document_id, '' AS extra FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'tables:nation', 'nation/' || n_name, n_name, 'nation', '', '' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer:' || c_nationkey, 'customer/' || c_custkey, c_name, 'customer', '', '' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier:' || s_nationkey, 'supplier/' || s_suppkey, s_name, 'supplier', '', '' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'tables:part', 'part/' || p_partkey, p_name, 'part', '', p_brand || ' ' || p_type FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'tables:orders', 'order/' || o_orderkey, 'Order#' || o_orderkey, 'order', 'orders:' || o_orderkey, '' FROM orders
  UNION ALL SELECT 'event:' || event_id, 'tables:events', 'event/' || event_id, event_type, 'event', '', '' FROM events
  UNION ALL SELECT 'page:' || page_id, 'tables:pages', 'page/' || page_id, url, 'page', 'pages:' || page_id, '' FROM pages
  UNION ALL SELECT 'document:' || doc_id, 'tables:documents', 'docs/' || doc_id || '.txt', 'Doc' || doc_id, 'document', 'docs:' || doc_id, text FROM documents
)"""
_EDGES = r"""
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS n FROM lineitem),
nexts AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events),
edges AS (
  SELECT kind || ':' || src || '>' || dst || more AS id, 'tables:' || kind AS unit_id, src AS "from", dst AS "to", kind, evidence, document_id, 'tables' AS provider FROM (
    SELECT 'contains' AS kind, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'exact' AS evidence, '' AS more, '' AS document_id FROM nation
    UNION ALL SELECT 'contains', 'nation:' || c_nationkey, 'customer:' || c_custkey, 'exact', '', '' FROM customer
    UNION ALL SELECT 'contains', 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'exact', '', '' FROM supplier
    UNION ALL SELECT 'contains', 'customer:' || o_custkey, 'order:' || o_orderkey, 'exact', '', '' FROM orders
    UNION ALL SELECT 'references', 'order:' || l_orderkey, 'part:' || l_partkey, 'exact', '>' || l_linenumber || ':' || n, 'orders:' || l_orderkey FROM lines
    UNION ALL SELECT DISTINCT 'depends-on', 'order:' || l_orderkey, 'part:' || l_partkey, 'declared', '', '' FROM lineitem
    UNION ALL SELECT DISTINCT 'imports', 'part:' || l_partkey, 'supplier:' || l_suppkey, 'declared', '', '' FROM lineitem
    UNION ALL SELECT 'calls', 'event:' || event_id, 'event:' || following, 'syntactic', '', '' FROM nexts WHERE following IS NOT NULL
    UNION ALL SELECT 'member-of', 'event:' || event_id, 'customer:' || user_id, 'declared', '', '' FROM events
    UNION ALL SELECT 'links-to', 'page:' || page_id, 'route:' || href, 'declared', '', 'pages:' || page_id FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
  )
)"""
_DOCUMENTS = r"""
docs AS (
  SELECT 'orders:' || o_orderkey AS id, 'tables:orders' AS unit_id, 'orders/' || o_orderkey AS path, sha256(o_orderstatus) AS content_hash FROM orders
  UNION ALL SELECT 'pages:' || page_id, 'tables:pages', 'pages/' || page_id, sha256(html) FROM pages
  UNION ALL SELECT 'docs:' || doc_id, 'tables:documents', 'docs/' || doc_id || '.txt', sha256(text) FROM documents
)"""
_OCCURRENCES = r"""
occ AS (SELECT 'occurrence:' || l_orderkey || ':' || l_linenumber || ':' || n AS id, 'tables:orders' AS unit_id, 'part:' || l_partkey AS symbol_id, 'orders:' || l_orderkey AS document_id, 'reference' AS role FROM lines)"""


def _tokens(x: str) -> str:
    """Sorted distinct tokens of x, for an engine without look-around."""
    for pattern in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{Ll})(\p{Lu})", r"(\p{Nd})(\p{L})", r"(\p{L})(\p{Nd})"):
        x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
    x = f"string_split(regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' ')"
    return f"list_sort(list_distinct(list_transform(list_filter({x}, lambda w: w <> ''), lambda w: lower(w))))"


_TERMS = "list_slice(list_filter({}, lambda w: octet_length(encode(w)) BETWEEN 3 AND 128), 1, 2048)"
_POSTINGS = "posts AS (SELECT id, unnest(list_distinct(list_concat(" + _tokens("display_name") + ", " + _TERMS.format(_tokens("extra")) + "))) AS token FROM symbols)"
_CODE = "list_position([" + ", ".join(f"'{k}'" for k in EDGE_KINDS) + "], kind)"


def _find(query: str, limit: int, columns: str = "pos, rank, id, normalized_name") -> str:
    q, w = query, query.strip().lower()
    return f"""WITH {_SYMBOLS}, {_POSTINGS}, named AS (SELECT *, lower(trim(display_name)) AS normalized_name FROM symbols),
ids AS (
  SELECT id FROM symbols WHERE id = '{q}'
  UNION SELECT id FROM (SELECT id FROM symbols WHERE stable_name = '{q}' ORDER BY id LIMIT {limit + 1})
  UNION SELECT id FROM (SELECT id FROM named WHERE starts_with(normalized_name, '{w}') ORDER BY normalized_name, id LIMIT {4 * limit + 1})
  UNION SELECT id FROM (SELECT id FROM posts WHERE starts_with(token, '{w}') ORDER BY token, id LIMIT {4 * limit + 1})
), ranked AS (
  SELECT id, normalized_name, CASE WHEN id = '{q}' OR stable_name = '{q}' THEN 0 WHEN normalized_name = '{w}' THEN 1 WHEN starts_with(normalized_name, '{w}') THEN 2 ELSE 3 END AS rank FROM named WHERE id IN (SELECT id FROM ids)
)
SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (ORDER BY rank, normalized_name, id) AS INTEGER) AS pos FROM ranked) WHERE pos <= {limit}"""


def _term(query: str, limit: int, name: str) -> str:
    """CTEs of the first `limit` documents that a term finds, with their places."""
    return f"""ids_{name} AS (
  SELECT id FROM named WHERE id = '{query}' UNION SELECT id FROM (SELECT id FROM named WHERE stable_name = '{query}' ORDER BY id LIMIT {limit + 1})
  UNION SELECT id FROM (SELECT id FROM named WHERE starts_with(normalized_name, '{query}') ORDER BY normalized_name, id LIMIT {4 * limit + 1})
  UNION SELECT id FROM (SELECT id FROM posts WHERE id LIKE 'document:%' AND starts_with(token, '{query}') ORDER BY token, id LIMIT {4 * limit + 1})
), top_{name} AS (
  SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY rank, normalized_name, id) AS pos FROM (
    SELECT id, normalized_name, CASE WHEN id = '{query}' OR stable_name = '{query}' THEN 0 WHEN normalized_name = '{query}' THEN 1 WHEN starts_with(normalized_name, '{query}') THEN 2 ELSE 3 END AS rank FROM named WHERE id IN (SELECT id FROM ids_{name})))
  WHERE pos <= {limit}
)"""


def _adjacent(near: str, node: str, kinds: str, limit: int) -> str:
    far = "to" if near == "from" else "from"
    return f"""WITH {_EDGES} SELECT CAST(row_number() OVER (ORDER BY "from", kind, "to", evidence, id) AS INTEGER) AS pos, id, "from", "to", kind
FROM (SELECT * FROM edges WHERE "{near}" = '{node}' {kinds} ORDER BY {_CODE}, "{far}", id LIMIT {limit})"""


def _reach(seed: str, join: str, kinds: str, out: str, start: str) -> str:
    return f"""WITH RECURSIVE {_SYMBOLS}, {_EDGES}, pairs AS (SELECT DISTINCT "{join}" AS a, "{out}" AS b FROM edges WHERE kind IN ({kinds})),
r(id, d) AS (SELECT id, 0 FROM ({start}) UNION SELECT b, d + 1 FROM r JOIN pairs ON a = id WHERE d < 12),
best AS (SELECT id, min(d) AS depth FROM r GROUP BY id) {seed}"""


_BEFORE = "SELECT id, stable_name, display_name FROM symbols WHERE kind = 'order' AND CAST(split_part(id, ':', 2) AS BIGINT) % 7 <> 0"
_AFTER = "SELECT id, stable_name, CASE WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 13 = 0 THEN display_name || '*' ELSE display_name END AS display_name FROM symbols WHERE kind = 'order' AND CAST(split_part(id, ':', 2) AS BIGINT) % 11 <> 0"
_DELTA = f"""WITH {_SYMBOLS}, b AS ({_BEFORE}), a AS ({_AFTER}),
dl AS (SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN b.display_name <> a.display_name THEN 'changed' END AS change FROM b FULL OUTER JOIN a ON a.id = b.id)"""

_DELTA_ALL = f"""WITH {_SYMBOLS}, {_EDGES}, {_OCCURRENCES}, {_DOCUMENTS}, records AS (
  SELECT 'units' AS family, unit_id AS id FROM (SELECT unit_id FROM symbols UNION SELECT unit_id FROM edges)
  UNION ALL SELECT 'documents', id FROM docs UNION ALL SELECT 'symbols', id FROM symbols UNION ALL SELECT 'occurrences', id FROM occ UNION ALL SELECT 'edges', id FROM edges
), keyed AS (SELECT family, id, CAST('0x' || substr(sha256(id), 1, 6) AS BIGINT) AS k FROM records),
dl AS (SELECT family, id, CASE WHEN k % 7 = 0 AND k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'removed' WHEN k % 13 = 0 THEN 'changed' END AS change FROM keyed)"""

ORACLE = {
    "s2_symbol": f"WITH {_SYMBOLS} SELECT id, stable_name, kind FROM symbols WHERE id = 'supplier:7'",
    "s2_document": f"WITH {_DOCUMENTS} SELECT id, path, content_hash FROM docs WHERE id = 'orders:1'",
    "s3_symbols": f"WITH {_SYMBOLS} SELECT id, unit_id, stable_name, display_name, lower(trim(display_name)) AS normalized_name, kind, document_id, 'exact' AS evidence FROM symbols",
    "s4_hot_facts": f"WITH {_SYMBOLS}, {_EDGES} SELECT 'symbol' AS family, id, stable_name AS a, kind AS b FROM symbols UNION ALL SELECT 'edge', id, \"from\", \"to\" FROM edges",
    "s7_inventory": f"WITH {_DOCUMENTS} SELECT split_part(path, '/', 1) AS directory, count(*) AS paths FROM docs GROUP BY 1",
    "f_adjacency_kinds": f"WITH {_EDGES} SELECT kind, evidence, count(*) AS n FROM edges WHERE kind IN ('imports', 'depends-on') GROUP BY 1, 2",
    "f3_prefix": f"WITH {_SYMBOLS} SELECT id, lower(trim(display_name)) AS normalized_name FROM symbols WHERE lower(trim(display_name)) LIKE 'customer#00000001%'",
    "f6_glob": f"WITH {_DOCUMENTS} SELECT id, path FROM docs WHERE regexp_matches(path, '^docs/1[^/]\\.txt$') OR starts_with(path, 'pages/') OR regexp_matches(path, '^orders/[1-3][^/]*$')",
    "f10_tests": f"WITH {_SYMBOLS}, {_EDGES} SELECT \"from\" AS id, 'tests ' || min(\"to\") AS reason FROM edges WHERE kind = 'links-to' AND \"from\" IN (SELECT id FROM symbols) GROUP BY 1",
    "q1_find_symbols": _find("customer#00000001", 50),
    "q1_find_by_term": _find("widget", 40),
    "q1_find_exact": _find("part/11", 10),
    "q5_workspace_find": f"""WITH {_SYMBOLS}, {_POSTINGS}, named AS (SELECT *, lower(trim(display_name)) AS normalized_name FROM symbols WHERE kind = 'document'), {_term('and', 1024, 'a')}, {_term('the', 1024, 'b')}
SELECT place, id, CAST(score AS BIGINT) AS score FROM (
  SELECT named.id AS id, a.pos + b.pos - 2 AS score, CAST(row_number() OVER (ORDER BY a.pos + b.pos, stable_name, named.id) AS INTEGER) AS place
  FROM named JOIN top_a a ON a.id = named.id JOIN top_b b ON b.id = named.id) WHERE place <= 30""",
    "u1_federated_find": _find("customer#00000001", 60, "pos, rank, id, CASE WHEN id LIKE '%1' THEN 'a' ELSE 'b' END AS source"),
    "q4_qualified": f"WITH {_SYMBOLS} SELECT id, 'world.' || kind || '.' || display_name AS name FROM symbols WHERE kind IN ('nation', 'region')",
    "q8_anchor_line": "WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), h AS (SELECT doc_id, line, len(list_intersect(" + _tokens("body") + ", ['and', 'of', 'the', 'that'])) AS hits FROM l) SELECT doc_id, line, CAST(hits AS BIGINT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, line) AS k FROM h) WHERE k = 1",
    "text_tokens": f"SELECT p_partkey, array_to_string({_tokens('p_name || chr(32) || p_brand || chr(32) || p_type')}, '|') AS tokens FROM part",
    "text_terms": f"SELECT doc_id, array_to_string({_TERMS.format(_tokens('text'))}, '|') AS terms FROM documents",
    "postings": f"WITH {_SYMBOLS}, {_POSTINGS} SELECT token, count(*) AS n FROM posts WHERE id NOT LIKE 'document:%' GROUP BY token",
    "postings_all": f"WITH {_SYMBOLS}, {_POSTINGS} SELECT token, count(*) AS n FROM posts GROUP BY token",
    "g1_edges_from": _adjacent("from", "order:7", "", 3),
    "g1_edges_to": _adjacent("to", "part:5", "AND kind IN ('references', 'depends-on')", 20),
    "g2_callers": f"WITH {_EDGES} SELECT id, \"from\", \"to\" FROM edges WHERE kind = 'calls' AND \"to\" = 'event:500' ORDER BY \"from\", id LIMIT 50",
    "g2_callees": f"WITH {_EDGES} SELECT id, \"from\", \"to\" FROM edges WHERE kind = 'calls' AND \"from\" = 'event:500' ORDER BY \"to\", id LIMIT 50",
    "g3_references": f"WITH {_EDGES}, {_OCCURRENCES} SELECT id, document_id, role FROM occ WHERE symbol_id = 'part:5' ORDER BY document_id, id LIMIT 25",
    "g4_dependencies": f"WITH {_EDGES} SELECT id, \"to\", kind FROM (SELECT *, row_number() OVER (PARTITION BY \"to\" ORDER BY kind, evidence, id) AS k FROM edges WHERE \"from\" = 'part:5' AND kind IN ('depends-on', 'imports')) WHERE k = 1 ORDER BY \"to\", id LIMIT 50",
    "g5_path": _reach("SELECT CAST(min(depth) AS INTEGER) AS length, 'region:1' AS start, 'supplier:7' AS \"end\" FROM best WHERE id = 'supplier:7'", "from", "'contains', 'depends-on', 'imports'", "to", "SELECT 'region:1' AS id"),
    "g6_impact": _reach("SELECT depth, best.id AS node, kind, display_name FROM best LEFT JOIN symbols ON symbols.id = best.id", "to", "'imports', 'references', 'depends-on'", "from", "SELECT 'supplier:1' AS id"),
    "g6_reachable": _reach("SELECT id, depth FROM best", "to", "'imports', 'depends-on', 'contains'", "from", "SELECT id FROM symbols WHERE kind = 'supplier' AND stable_name LIKE 'supplier/1%'"),
    "g7_neighborhood": f"WITH {_EDGES}, c AS (SELECT * FROM edges WHERE kind = 'contains'), o AS (SELECT \"to\" AS n FROM c WHERE \"from\" = 'nation:3'), i AS (SELECT \"from\" AS n FROM c WHERE \"to\" = 'nation:3') SELECT DISTINCT id, \"from\", \"to\", kind FROM c WHERE \"from\" = 'nation:3' OR \"to\" = 'nation:3' OR \"from\" IN (SELECT n FROM o) OR \"to\" IN (SELECT n FROM i)",
    "g8_outline": _reach("SELECT id, depth FROM best", "from", "'contains'", "to", "SELECT 'region:2' AS id"),
    "g9_links": f"WITH {_EDGES} SELECT id, \"from\", \"to\" FROM edges WHERE kind IN ('links-to', 'embeds') AND split_part(\"from\", ':', 1) = 'page' AND CAST(split_part(\"from\", ':', 2) AS BIGINT) BETWEEN 1 AND 39",
    "g10_backlinks": f"WITH {_EDGES} SELECT id, \"from\", \"to\" FROM edges WHERE kind = 'links-to' AND \"to\" LIKE 'route:/t%'",
    "g9_links_all": f"WITH {_EDGES} SELECT id, \"from\", \"to\" FROM edges WHERE kind IN ('links-to', 'embeds')",
    "g10_backlinks_all": f"WITH {_EDGES} SELECT id, \"from\", \"to\" FROM edges WHERE kind = 'links-to'",
    "g11_impact_roots": f"WITH {_SYMBOLS} SELECT id FROM symbols WHERE id IN ('order:1', 'order:2', 'document:3')",
    "g14_proximity": f"WITH {_DOCUMENTS} SELECT d.id, o.id AS other, CAST(10 * CASE WHEN d.path = o.path THEN 2 WHEN split_part(d.path, '/', 1) = split_part(o.path, '/', 1) THEN 1 ELSE 0 END AS BIGINT) AS near FROM docs d, docs o WHERE o.id IN ('orders:1', 'pages:1')",
    "a1_status": f"WITH {_SYMBOLS}, {_EDGES} SELECT (SELECT count(DISTINCT id) FROM symbols) AS symbols, CAST(2 AS BIGINT) AS sources, (SELECT count(*) FROM (SELECT DISTINCT \"from\", kind, \"to\", evidence, document_id, provider FROM edges)) AS edges",
    "a2_collapsed": f"WITH {_EDGES} SELECT \"from\", \"to\", kind, count(*) AS times, min(id) AS id FROM edges WHERE kind = 'references' GROUP BY 1, 2, 3",
    "a3_unit_counts": f"WITH {_EDGES} SELECT unit_id, count(*) AS n FROM edges GROUP BY 1",
    "a4_entity_usage": f"WITH {_SYMBOLS}, {_EDGES}, {_OCCURRENCES} SELECT id, count(*) AS uses FROM (SELECT id FROM symbols UNION ALL SELECT symbol_id FROM occ UNION ALL SELECT \"from\" FROM edges UNION ALL SELECT \"to\" FROM edges) GROUP BY id",
    "a8_route_ambiguity": f"WITH {_EDGES} SELECT \"to\" AS route, count(DISTINCT \"from\") AS owners, min(\"from\") AS \"first\" FROM edges WHERE kind = 'links-to' GROUP BY 1 HAVING count(DISTINCT \"from\") > 1",
    "u3_delta": _DELTA + " SELECT 'symbols' AS family, change, id FROM dl WHERE change IS NOT NULL",
    "u3_delta_bounded": _DELTA + " SELECT 'symbols' AS family, change, id, total FROM (SELECT change, id, row_number() OVER (PARTITION BY change ORDER BY id) AS k, count(*) OVER (PARTITION BY change) AS total FROM dl WHERE change IS NOT NULL) WHERE k <= 5",
    "u3_delta_all": _DELTA_ALL + " SELECT family, change, id FROM dl WHERE change IS NOT NULL",
    "u3_delta_all_bounded": _DELTA_ALL + " SELECT family, change, id, total FROM (SELECT family, change, id, row_number() OVER (PARTITION BY family, change ORDER BY id) AS k, count(*) OVER (PARTITION BY family, change) AS total FROM dl WHERE change IS NOT NULL) WHERE k <= 5",
    "u5_transitions_all": _DELTA_ALL + " SELECT id, change AS status FROM dl WHERE family = 'symbols' AND change IS NOT NULL",
    "u4_surfaces": f"WITH {_EDGES}, u AS (SELECT unit_id AS id, CAST(count(*) AS VARCHAR) AS s FROM edges GROUP BY 1) SELECT id, CASE WHEN id = 'tables:contains' THEN 'changed' ELSE 'removed' END AS change, s AS before, CASE WHEN id = 'tables:contains' THEN s || 'x' ELSE '' END AS \"after\" FROM u WHERE id IN ('tables:calls', 'tables:imports', 'tables:contains')",
    "u5_transitions": _DELTA + " SELECT id, change AS status FROM dl WHERE change IS NOT NULL",
    "u1_federated_edges": f"WITH {_EDGES} SELECT id, CASE WHEN \"from\" LIKE 'order:1%' THEN 'a' ELSE 'b' END AS source FROM edges WHERE kind IN ('depends-on', 'imports')",
    "u7_removed_units": f"WITH {_EDGES} SELECT DISTINCT unit_id AS id FROM edges WHERE unit_id NOT LIKE '%s'",
    "p3_verify": f"""WITH {_SYMBOLS}, {_EDGES}, {_OCCURRENCES}, {_DOCUMENTS}
SELECT 'error' AS severity, 'orphan-symbol' AS kind, id AS record FROM symbols WHERE unit_id = 'customer:3'
UNION ALL SELECT 'error', 'orphan-document', id FROM docs WHERE id <> 'docs:5' AND unit_id NOT IN (SELECT unit_id FROM symbols UNION SELECT unit_id FROM edges)
UNION ALL SELECT 'error', 'invalid-symbol-document', id FROM symbols WHERE document_id = 'docs:5'
UNION ALL SELECT 'error', 'invalid-edge-document', id FROM edges WHERE document_id <> ''
UNION ALL SELECT 'warning', 'unresolved-occurrence', id FROM occ WHERE symbol_id = 'part:9'""",
    "p1_architecture": f"""WITH {_SYMBOLS}, {_EDGES}, e AS (
  SELECT edges.id, "from", "to", edges.kind AS kind, coalesce(s.unit_id, '') AS unit, coalesce(s.stable_name, '') AS name FROM edges LEFT JOIN symbols s ON s.id = "to" WHERE edges.kind IN ('imports', 'depends-on') AND "from" LIKE 'part:%'
), m AS (SELECT *, regexp_matches(unit, '^supplier:1[^/]*$') AS sup, regexp_matches(name, '^supplier/[1-4][^/]$') AS nam FROM e)
SELECT 'no-part-to-supplier' AS rule, id AS edge, "from", "to", 'forbidden dependency' AS message FROM m WHERE kind = 'imports' AND sup
UNION ALL SELECT 'parts-import-named', id, "from", "to", 'only named suppliers' FROM m WHERE NOT sup AND NOT nam""",
    "k4_export": f"""WITH {_SYMBOLS}, {_EDGES}, {_OCCURRENCES}, {_DOCUMENTS}
SELECT 'units' AS family, count(*) AS n, count(DISTINCT u) AS ids FROM (SELECT unit_id AS u FROM symbols UNION SELECT unit_id FROM edges)
UNION ALL SELECT 'documents', count(*), count(DISTINCT id) FROM docs UNION ALL SELECT 'symbols', count(*), count(DISTINCT id) FROM symbols
UNION ALL SELECT 'occurrences', count(*), count(DISTINCT id) FROM occ UNION ALL SELECT 'edges', count(*), count(DISTINCT id) FROM edges""",
    "fn_kind_code": "SELECT unnest([" + ", ".join(f"'{k}'" for k in EDGE_KINDS) + "]) AS kind, CAST(unnest(range(1, 21)) AS INTEGER) AS code",
    "fn_clean_path": "SELECT p_partkey, 'a/c' || p_partkey || '/e' AS path FROM part",
    "fn_stable_hash": "SELECT r_regionkey, sha256('file' || chr(0) || r_name) AS hash FROM region",
}
