"""URL filters by a temporal list join, in DataFrame functions alone.

A list is a table of dated events (kind, pattern, action, verdict, at): from an
`add` on, until the next event of the same kind and pattern, the pattern is in
force with its verdict. Kinds are `host` (the host itself), `domain` (the host or
any parent of it) and `prefix` (host and leading path segments). Each capture
(url, fetched) meets the entries in force when it was fetched: candidates of a
URL are joined by equality of pattern, and the interval picks the entry as of
then. The most specific entry decides; `allow` beats `block` between equals.

The list's side is broadcast if it has at most MOST_BROADCAST intervals;
otherwise the join shuffles, and adaptive execution splits a hot host. Defined
results: a null or unparsable URL, or a null fetch time, meets no entry and gets
verdict `none`; events of equal time are one event, `remove` before `add`, then
`allow`; repeated captures are judged alike; an empty list gives `none`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

MOST_BROADCAST = 200_000


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """kind, pattern, verdict and the half-open interval [since, until) of each add."""
    ranked = F.when(F.col("action") == "remove", 0).when(F.col("verdict") == "allow", 2).otherwise(1)
    one = events.groupBy("kind", "pattern", "at").agg(F.max(F.struct(ranked.alias("rank"), "action", "verdict")).alias("e"))
    after = F.lead("at").over(Window.partitionBy("kind", "pattern").orderBy("at"))
    return one.withColumn("until", after).where(F.col("e.action") == "add").select("kind", "pattern", F.col("e.verdict").alias("verdict"), F.col("at").alias("since"), "until")


def candidates(url: Column) -> Column:
    """All (kind, pattern, rank) that could name the URL, the most specific of highest rank."""
    host, labels = url_host(url), F.split(url_host(url), r"\.")
    parts = F.filter(F.split(url_path(url), "/"), lambda x: x != "")
    n = F.size(labels)
    struct = lambda kind, pattern, rank: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), rank.cast("int").alias("rank"))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: struct("domain", F.concat_ws(".", F.slice(labels, i, n)), F.lit(1000) - i))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: struct("prefix", F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(parts, F.lit(1), i))), F.lit(2000) + i)))
    none = F.array().cast("array<struct<kind:string,pattern:string,rank:int>>")
    return F.when(F.coalesce(host, F.lit("")) == "", none).otherwise(F.concat(F.array(struct("host", host, F.lit(1500))), domains, F.coalesce(prefixes, none)))


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, url, fetched, verdict, kind, pattern, since and n_active, a row for
    each capture. A URL and time are judged once, however many captures share them."""
    entries = intervals(events)
    entries = F.broadcast(entries) if entries.count() <= MOST_BROADCAST else entries
    mine = captures.select("page_id", "url", "fetched")
    asked = mine.where("url IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched").distinct()
    met = asked.select("url", "fetched", F.explode(candidates(F.col("url"))).alias("c")).select("url", "fetched", "c.*").join(entries, ["kind", "pattern"])
    met = met.where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = F.max(F.struct("rank", (F.col("verdict") == "allow").alias("allowed"), "kind", "pattern", "since"))
    judged = met.groupBy("url", "fetched").agg(best.alias("b"), F.count("*").alias("n_active"))
    verdict = F.when(F.col("b").isNull(), "none").when(F.col("b.allowed"), "allow").otherwise("block")
    return mine.join(judged, ["url", "fetched"], "left").select(
        "page_id", "url", "fetched", verdict.alias("verdict"), F.col("b.kind").alias("kind"), F.col("b.pattern").alias("pattern"), F.col("b.since").alias("since"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active")
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages with a date of fetching that follows from page_id."""
    return pages.withColumn("fetched", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") * 37 % 365).cast("int")))


def page_list(pages: DataFrame) -> DataFrame:
    """A list for the pages' hosts, whose dates and kinds follow from the names."""
    hosts = pages.select(url_host(F.col("url")).alias("h")).where("h <> ''").distinct()
    code = lambda i: F.ascii(F.substring("h", i, 1))
    x = (code(1) * 31 + code(3) * 17 + code(5) * 7 + code(6) * 3 + F.length("h")).cast("int")
    hosts = hosts.withColumn("x", x).withColumn("domain", F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1))
    day = lambda n: F.date_add(F.to_date(F.lit("2024-01-01")), n.cast("int"))
    event = lambda where, kind, pattern, action, verdict, at: hosts.where(where).select(
        F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), F.lit(verdict).alias("verdict"), at.alias("at")
    )
    h, x, domain = F.col("h"), F.col("x"), F.col("domain")
    parts = [
        event("x % 2 = 0", "host", h, "add", "block", day(x % 200)),
        event("x % 4 = 0", "host", h, "remove", "block", day(x % 200 + 40)),
        event("x % 8 = 0", "host", h, "add", "block", day(x % 200 + 90)),
        event("x % 3 = 0", "prefix", F.concat(h, F.lit("/en")), "add", "allow", day(x % 150)),
        event("x % 6 = 0", "prefix", F.concat(h, F.lit("/en")), "remove", "allow", day(x % 150 + 100)),
        event("x % 29 = 0", "domain", domain, "add", "block", day(x % 100)),
        event("x % 31 = 0", "domain", domain, "remove", "block", day(x % 120 + 30)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(page_captures(pages), page_list(pages))


OP7_SQL = r"""
WITH hosts AS (
  SELECT h, ascii(substr(h, 1, 1)) * 31 + ascii(substr(h, 3, 1)) * 17 + ascii(substr(h, 5, 1)) * 7 + ascii(substr(h, 6, 1)) * 3 + length(h) AS x, regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS domain
  FROM (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM pages) WHERE h <> ''
), ev AS (
  SELECT 'host' AS kind, h AS pattern, 'add' AS action, 'block' AS verdict, DATE '2024-01-01' + CAST(x % 200 AS INTEGER) AS "at" FROM hosts WHERE x % 2 = 0
  UNION SELECT 'host', h, 'remove', 'block', DATE '2024-01-01' + CAST(x % 200 + 40 AS INTEGER) FROM hosts WHERE x % 4 = 0
  UNION SELECT 'host', h, 'add', 'block', DATE '2024-01-01' + CAST(x % 200 + 90 AS INTEGER) FROM hosts WHERE x % 8 = 0
  UNION SELECT 'prefix', h || '/en', 'add', 'allow', DATE '2024-01-01' + CAST(x % 150 AS INTEGER) FROM hosts WHERE x % 3 = 0
  UNION SELECT 'prefix', h || '/en', 'remove', 'allow', DATE '2024-01-01' + CAST(x % 150 + 100 AS INTEGER) FROM hosts WHERE x % 6 = 0
  UNION SELECT 'domain', domain, 'add', 'block', DATE '2024-01-01' + CAST(x % 100 AS INTEGER) FROM hosts WHERE x % 29 = 0
  UNION SELECT 'domain', domain, 'remove', 'block', DATE '2024-01-01' + CAST(x % 120 + 30 AS INTEGER) FROM hosts WHERE x % 31 = 0
), one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, pattern, "at" ORDER BY CASE WHEN action = 'remove' THEN 0 WHEN verdict = 'allow' THEN 2 ELSE 1 END DESC) AS k FROM ev) WHERE k = 1
), iv AS (
  SELECT * FROM (SELECT kind, pattern, action, verdict, "at" AS since, lead("at") OVER (PARTITION BY kind, pattern ORDER BY "at") AS until FROM one) WHERE action = 'add'
), cap AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), cand AS (
  SELECT page_id, url, fetched, 'host' AS kind, host AS pattern, 1500 AS rank FROM cap WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched, 'domain', array_to_string(list_slice(ls, i, len(ls)), '.'), 1000 - i FROM (SELECT *, string_split(host, '.') AS ls, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM cap WHERE host <> '')
  UNION ALL SELECT page_id, url, fetched, 'prefix', host || '/' || array_to_string(list_slice(ps, 1, i), '/'), 2000 + i FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, list_filter(string_split(path, '/'), lambda p: p <> '') AS ps FROM cap WHERE host <> ''))
), met AS (
  SELECT c.*, verdict, since, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, verdict = 'allow' DESC, c.kind DESC, c.pattern DESC, since DESC) AS k, count(*) OVER (PARTITION BY page_id) AS n_active
  FROM cand c JOIN iv ON c.kind = iv.kind AND c.pattern = iv.pattern AND since <= fetched AND (until IS NULL OR fetched < until)
)
SELECT cap.page_id, cap.url, cap.fetched, coalesce(met.verdict, 'none') AS verdict, met.kind AS kind, met.pattern AS pattern, met.since AS since, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active
FROM cap LEFT JOIN met ON cap.page_id = met.page_id AND k = 1
"""
