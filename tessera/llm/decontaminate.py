"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of each SPAN consecutive words, the least of the hashes of its GRAM-word runs is
kept: two equal spans keep equal values, so a join on kept values misses no
shared span. Where a document keeps a value that an item keeps too, the spans
behind it are extended to their whole text and compared as such; no hash decides
a result. An item shorter than SPAN words is one span of its own length.

The join's item side is broadcast if it has at most MOST_BROADCAST values, and
shuffled beyond. Documents are known by a digest of id and text, so repeated rows
get equal results and null ids work. Defined results: null text or text without
words has no words and isn't contaminated; an item without words never occurs; a
null item_id is listed as 'null'; repeated items count once; an empty benchmark
hits nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import spool, table, unused

GRAM, SPAN = 5, 10
MOST_BROADCAST = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all other code points above ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def starts(size: Column, span: int) -> Column:
    """1 .. size - span + 1, or nothing."""
    return F.when(size >= span, F.sequence(F.lit(1), size - (span - 1))).otherwise(F.array().cast("array<int>"))


def kept(ws: Column, size: Column) -> Column:
    """For each start of a span, the least hash of the runs in it."""
    grams = F.transform(starts(size, GRAM), lambda i: F.xxhash64(F.slice(ws, i, GRAM)))
    return let(grams, lambda g: F.transform(starts(size, SPAN), lambda i: F.array_min(F.slice(g, i, SPAN - GRAM + 1))))


def whole(ws: Column, size: Column, span: int) -> Column:
    """For each start of a short span, the hash of all of it."""
    return F.transform(starts(size, span), lambda i: F.xxhash64(F.slice(ws, i, span)))


def item_spans(benchmark: DataFrame) -> DataFrame:
    """item_id (a string), its spans' text, length and kept hash."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text").cast("string")).alias("ws")).distinct()
    items = items.withColumn("n", F.size("ws")).where("n > 0")
    long = items.where(F.col("n") >= SPAN).select("item_id", "ws", F.posexplode(kept(F.col("ws"), F.col("n"))).alias("i", "kept"))
    long = long.select("item_id", F.lit(SPAN).alias("length"), F.concat_ws(" ", F.slice("ws", F.col("i") + 1, SPAN)).alias("span"), "kept")
    short = items.where(F.col("n") < SPAN).select("item_id", F.col("n").alias("length"), F.concat_ws(" ", "ws").alias("span"), F.xxhash64("ws").alias("kept"))
    return long.unionByName(short).distinct()


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, start (from 1), length and text of the spans of docs (key, text) that
    an item has; at most one row for each place and length."""
    spans = spool(item_spans(benchmark))
    values = spans.select("kept").distinct()
    n_values = values.count()
    short = sorted(r[0] for r in spans.where(F.col("length") < SPAN).select("length").distinct().collect())  # 9 at most
    if not n_values:
        return docs.select("key", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("span")).where("false")

    def all_kept(ws: Column) -> Column:
        return let(F.size(ws), lambda n: F.concat(kept(ws, n), *(whole(ws, n, k) for k in short)))

    found = docs.select("key", F.explode(let(words(F.col("text")), lambda ws: F.array_distinct(all_kept(ws)))).alias("kept"))
    found = spool(found.join(_sized(values, n_values), "kept", "left_semi").distinct())
    n_found = found.count()
    keys = found.select("key").distinct()

    def all_places(ws: Column) -> Column:
        def of(span: int, values: Column) -> Column:
            return F.transform(values, lambda v, i: F.struct((i + 1).alias("start"), F.lit(span).alias("length"), v.alias("kept")))

        return let(F.size(ws), lambda n: F.concat(of(SPAN, kept(ws, n)), *(of(k, whole(ws, n, k)) for k in short)))

    # Of texts with any such value: where it stands, and then the words there.
    everywhere = docs.join(_sized(keys, n_found), "key").select("key", F.explode(let(words(F.col("text")), all_places)).alias("p")).select("key", "p.*")
    picked = everywhere.join(_sized(found, n_found), ["key", "kept"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("at"))  # no more than the text has words
    cut = lambda ws: F.transform("at", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), F.concat_ws(" ", F.slice(ws, p["start"], p["length"])).alias("span")))
    maybe = docs.join(_sized(picked, n_found), "key").select("key", F.explode(let(words(F.col("text")), cut)).alias("p")).select("key", "p.*")
    known = spans.select("span", "length").distinct()
    return spool(maybe.join(_sized(known, known.count()), ["span", "length"], "left_semi").select("key", "start", "length", "span").distinct())


def row_key() -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text").cast("string")).cast("binary")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that equal rows share."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("key"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    mine = keyed(docs)
    hit = hits(mine.select("key", "text"), benchmark)
    ends = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    covered = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n")),
        lambda a: a["n"],
    )
    counts = hit.groupBy("key").agg(covered.alias("n_hit"))
    items = spool(item_spans(benchmark)).select("span", "item_id").distinct()
    listed = hit.select("key", "span").distinct().join(items, "span").select("key", "item_id").distinct()
    listed = listed.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = counts.join(listed, "key")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return (
        mine.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
        .join(found, "key", "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item's span occurs, with all their columns."""
    name = unused(docs, "decontaminate_key")
    mine = docs.withColumn(name, row_key())
    found = hits(mine.select(F.col(name).alias("key"), F.col("text").cast("string").alias("text")), benchmark)
    bad = found.select(F.col("key").alias(name)).distinct()
    return mine.join(bad, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS length, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS span
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), lengths AS (SELECT DISTINCT length FROM bw),
dw AS (
  SELECT doc_id, i, length, array_to_string(list_slice(ws, i, i + length - 1), ' ') AS span
  FROM (SELECT doc_id, ws, length, unnest(range(1, len(ws) - length + 2)) AS i FROM d, lengths WHERE len(ws) >= length)
), hit AS (SELECT DISTINCT doc_id, i, dw.length AS length, item_id FROM dw JOIN bw ON dw.span = bw.span AND dw.length = bw.length),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + length)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
