"""Queries of differences, links through aliases, drawn views and routing, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import diff, inventory, search, snapshots, traverse
from tessera.plans import registry
from tessera.schema import Facts
from tessera.sources import projected, routing


def u6_current_roots(spark, d):
    return snapshots.current_roots(*registry._whole_versions(spark, d))


def u6_removed_roots(spark, d):
    return snapshots.removed_roots(*registry._whole_versions(spark, d))


def _small_change(spark, d) -> tuple[Facts, Facts]:
    """All facts, and the same with one supplier renamed and one part's imports gone."""
    facts = projected.facts(spark, d)
    symbols = facts.symbols.withColumn("display_name", F.when(F.col("id") == "supplier:1", F.concat("display_name", F.lit("*"))).otherwise(F.col("display_name")))
    edges = facts.edges.where("NOT (kind = 'imports' AND `from` = 'part:7')")
    return facts, Facts(facts.units, facts.documents, symbols, facts.occurrences, edges)


def d1_graph(spark, d):
    return diff.diff_graph(*registry._whole_versions(spark, d), limit=20)[0]


def d1_api(spark, d):
    return diff.diff_api(*registry._whole_versions(spark, d)).select("id", "change")


def d1_impact(spark, d):
    found = diff.diff_impact(*_small_change(spark, d), paths=["./docs//3.txt", "no/such.txt"], kinds=["imports", "references", "depends-on"], bounds=traverse.Bounds(20, None, None))
    return found.nodes.select(F.col("depth").cast("long").alias("depth"), "id")


def d1_tests(spark, d):
    """Orders that reference a changed part count as its tests."""
    before, after = _small_change(spark, d)
    as_tests = lambda f: Facts(f.units, f.documents, f.symbols, f.occurrences, f.edges.withColumn("kind", F.when(F.col("kind") == "depends-on", "tests").otherwise(F.col("kind"))))
    found = diff.diff_tests(as_tests(before), as_tests(after), kinds=["imports", "references", "tests"], bounds=traverse.Bounds(20, None, None))
    return found.select("id", "evidence", "reason", "edge")


def g11_impact_roots_cleaned(spark, d):
    facts = projected.facts(spark, d)
    kind = F.when(F.col("kind") == "order", "type").when(F.col("kind") == "region", "package").otherwise(F.col("kind"))
    facts = Facts(facts.units, facts.documents, facts.symbols.withColumn("kind", kind), facts.occurrences, facts.edges)
    return snapshots.impact_roots(facts, ["./orders//1", "orders/9/../2", "docs/3.txt"], [" AFRICA "])


def g11_missing_roots(spark, d):
    return snapshots.missing_roots(projected.facts(spark, d), ["./orders//1", "nowhere/x.txt", "docs/./none.txt"], ["nothing"])


def _with_aliases(spark, d) -> DataFrame:
    """Links of pages to routes, the topic that each route resolves to, and pages that document a route."""
    links = registry._edges(spark, d).where("kind = 'links-to'").select("id", "from", "to", "kind", "evidence")
    topic = F.concat(F.lit("topic:"), F.substring(F.sha2("to", 256), 1, 1))
    routes = links.select("to").distinct().select(F.concat(F.lit("alias:"), "to").alias("id"), F.col("to").alias("from"), topic.alias("to"), F.lit("resolves-to").alias("kind"), F.lit("declared").alias("evidence"))
    documented = links.withColumns({"id": F.concat(F.lit("documents:"), "id"), "kind": F.lit("documents")})
    return links.unionByName(routes).unionByName(documented)


def g10_backlinks_alias(spark, d):
    edges = _with_aliases(spark, d)
    topics = edges.where("kind = 'resolves-to'").select(F.col("to").alias("id")).distinct()
    return traverse.backlinks(edges, topics, None).select("id", "from", "to", "kind")


def g10_backlinks_first(spark, d):
    """The first forty that lead to three topics, as they are read."""
    topics = spark.createDataFrame([(0, "topic:a"), (1, "topic:3"), (2, "topic:0")], "pos int, id string")
    return traverse.backlinks(_with_aliases(spark, d), topics, 40).select("id", "from", "to", "kind")


def g10_backlinks_outline(spark, d):
    """What belongs to anything inside a nation."""
    inside = traverse.outline(registry._both_ways(spark, d), registry._symbols(spark, d), "nation:3", traverse.Bounds(8)).nodes
    return traverse.backlinks(registry._edges(spark, d), inside.select("pos", "id"), None).select("id", "from", "to")


def f7_filtered_view(spark, d):
    return traverse.filtered_view(registry._edges(spark, d), "nation:3", ["contains", "references", "calls"], ["tables"], ["exact"], "outgoing").select("id", "from", "to", "kind")


def q5_workspace_terms(spark, d):
    """Terms are split as in texts, and those below three bytes don't count."""
    documents = registry._symbols(spark, d).where("kind = 'document'")
    return search.workspace_find(documents, "The-And of", 30).select("place", "id", "score")


def q5_workspace_word(spark, d):
    return search.workspace_find(registry._symbols(spark, d), "docs/12.txt", 5).select("place", "id", "score")


def s24_routes(spark, d):
    paths = projected.table(spark, d, "documents").select(F.when(F.col("path").startswith("pages/"), F.concat("path", F.lit(".HTML"))).otherwise(F.col("path")).alias("path"))
    claims = [routing.Claim("text", [".txt", ".md"]), routing.Claim("web", [".html"]), routing.Claim("never", [".txt"], markers=["go.mod"]), routing.Claim("first", filenames=["1"]), routing.Claim("any", [".*"], fallback=True)]
    return routing.routed(paths, claims)


def s7_entities(spark, d):
    return inventory.entities(projected.table(spark, d, "documents"))


def fn_byte_columns(spark, d):
    """Where the twentieth character and UTF-16 unit of each text's first line lie, in bytes."""
    line = F.substring_index("text", "\n", 1)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", T.byte_column(line, F.lit(20), "utf-32").cast("long").alias("point"), T.byte_column(line, F.lit(20), "utf-16").cast("long").alias("unit"), T.byte_column(line, F.lit(20)).cast("long").alias("byte"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and name[0] != "_"}

_CHANGES = registry._DELTA_ALL + """, new AS (SELECT * FROM dl WHERE change IN ('added', 'changed')), gone AS (SELECT * FROM dl WHERE change = 'removed'),
later AS (SELECT s.id, s.unit_id, s.document_id FROM symbols s JOIN keyed k ON k.family = 'symbols' AND k.id = s.id AND k.k % 11 <> 0)"""
_ALIASES = f"""WITH {registry._EDGES}, links AS (SELECT id, "from", "to", kind FROM edges WHERE kind = 'links-to'),
resolved AS (SELECT DISTINCT 'alias:' || "to" AS id, "to" AS "from", 'topic:' || substr(sha256("to"), 1, 1) AS "to", 'resolves-to' AS kind FROM links)"""
_SMALL = "SELECT id, \"from\", \"to\", kind FROM edges WHERE NOT (kind = 'imports' AND \"from\" = 'part:7') AND kind IN ('imports', 'references', 'depends-on')"
_ROOTS = "SELECT 'supplier:1' AS id UNION SELECT 'part:7' UNION SELECT \"to\" FROM edges WHERE kind = 'imports' AND \"from\" = 'part:7' UNION SELECT 'document:3'"
_IMPACT = f"""WITH RECURSIVE {registry._SYMBOLS}, {registry._EDGES}, step AS ({_SMALL}), walk AS (
  SELECT id, CAST(0 AS BIGINT) AS depth FROM ({{roots}}) UNION SELECT step."from", walk.depth + 1 FROM walk JOIN step ON step."to" = walk.id WHERE walk.depth < 20
), best AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""

ORACLE = {
    "u6_current_roots": _CHANGES + """ SELECT id FROM new WHERE family = 'symbols' UNION SELECT symbol_id FROM occ JOIN new ON new.family = 'occurrences' AND new.id = occ.id
      UNION SELECT unnest(["from", "to"]) FROM edges JOIN new ON new.family = 'edges' AND new.id = edges.id
      UNION SELECT id FROM later WHERE unit_id IN (SELECT id FROM new WHERE family = 'units') OR document_id IN (SELECT id FROM new WHERE family = 'documents')""",
    "u6_removed_roots": _CHANGES + """ SELECT id FROM gone WHERE family = 'symbols' UNION SELECT symbol_id FROM occ JOIN gone ON gone.family = 'occurrences' AND gone.id = occ.id
      UNION SELECT unnest(["from", "to"]) FROM edges JOIN gone ON gone.family = 'edges' AND gone.id = edges.id""",
    "d1_graph": registry._DELTA_ALL + " SELECT family, change, id, total FROM (SELECT family, change, id, row_number() OVER (PARTITION BY family, change ORDER BY id) AS k, count(*) OVER (PARTITION BY family, change) AS total FROM dl WHERE change IS NOT NULL) WHERE k <= 20",
    "d1_api": registry._DELTA_ALL + " SELECT id, change FROM dl WHERE family = 'units' AND change IS NOT NULL",
    "d1_impact": _IMPACT.format(roots=_ROOTS) + " SELECT depth, id FROM best",
    "d1_tests": _IMPACT.format(roots=_ROOTS.replace(" UNION SELECT 'document:3'", "")) + """ SELECT id, evidence, reason, edge FROM (
      SELECT e."from" AS id, 'declared' AS evidence, 'explicit tests relationship' AS reason, e.id AS edge, row_number() OVER (PARTITION BY e."from" ORDER BY e."to", e.id) AS k
      FROM edges e JOIN best ON best.id = e."from" WHERE e.kind = 'depends-on' AND e."from" IN (SELECT id FROM symbols)) WHERE k = 1""",
    "g11_impact_roots_cleaned": f"WITH {registry._SYMBOLS} SELECT id FROM symbols WHERE id IN ('order:1', 'order:2', 'document:3') OR unit_id = 'tables:region'",
    "g11_missing_roots": "SELECT unnest(['file:nowhere/x.txt', 'file:docs/none.txt', 'package:nothing']) AS missing",
    "g10_backlinks_alias": _ALIASES + ' SELECT id, "from", "to", kind FROM links UNION ALL SELECT id, "from", "to", kind FROM resolved',
    "g10_backlinks_first": _ALIASES + """, asked AS (SELECT * FROM (VALUES (0, 'topic:a'), (1, 'topic:3'), (2, 'topic:0')) t(pos, topic)),
      hits AS (SELECT r.id, r."from", r."to", r.kind, pos, r."from" AS f, r.id AS e, 0 AS thn, '' AS g, '' AS i FROM resolved r JOIN asked ON topic = r."to"
        UNION ALL SELECT l.id, l."from", l."to", l.kind, pos, r."from", r.id, 1, l."from", l.id FROM resolved r JOIN asked ON topic = r."to" JOIN links l ON l."to" = r."from")
      SELECT id, "from", "to", kind FROM (SELECT *, row_number() OVER (ORDER BY pos, f, e, thn, g, i) AS k FROM hits) WHERE k <= 40""",
    "g10_backlinks_outline": f"WITH {registry._EDGES} SELECT id, \"from\", \"to\" FROM edges WHERE kind = 'member-of' AND \"to\" IN (SELECT \"to\" FROM edges WHERE kind = 'contains' AND \"from\" = 'nation:3')",
    "f7_filtered_view": f"""WITH RECURSIVE {registry._EDGES}, kept AS (SELECT id, "from", "to", kind FROM edges WHERE kind IN ('contains', 'references') ),
      seen AS (SELECT 'nation:3' AS n UNION SELECT kept."to" FROM seen JOIN kept ON kept."from" = seen.n)
      SELECT id, "from", "to", kind FROM kept WHERE "from" IN (SELECT n FROM seen) AND "to" IN (SELECT n FROM seen)""",
    "q5_workspace_terms": registry.ORACLE["q5_workspace_find"],
    "q5_workspace_word": "SELECT CAST(1 AS INTEGER) AS place, 'document:12' AS id, CAST(0 AS INTEGER) AS score FROM documents WHERE doc_id = 12",
    "s7_entities": f"""WITH {registry._DOCUMENTS}, e AS (SELECT DISTINCT '.' AS parent, split_part(path, '/', 1) AS path FROM docs UNION SELECT split_part(path, '/', 1), path FROM docs)
      SELECT e.path, CASE WHEN n.k IS NULL THEN 'file' ELSE 'directory' END AS kind, e.parent, coalesce(n.k, 0) AS children FROM e LEFT JOIN (SELECT parent, count(*) AS k FROM e GROUP BY 1) n ON n.parent = e.path""",
    "fn_byte_columns": """WITH l AS (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents)
      SELECT doc_id, CASE WHEN length(line) >= 20 THEN octet_length(encode(substr(line, 1, 20))) END AS point, CASE WHEN length(line) >= 20 THEN octet_length(encode(substr(line, 1, 20))) END AS unit, CASE WHEN octet_length(encode(line)) >= 20 THEN 20 END AS byte FROM l""",
    "s24_routes": f"""WITH {registry._DOCUMENTS} SELECT path, CASE WHEN path LIKE '%.txt' THEN 'text' WHEN path LIKE '%.HTML' THEN 'web' WHEN path LIKE '%/1' THEN 'first' ELSE 'any' END AS owner
      FROM (SELECT CASE WHEN path LIKE 'pages/%' THEN path || '.HTML' ELSE path END AS path FROM docs)""",
}
