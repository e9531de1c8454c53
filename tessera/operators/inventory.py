"""What a workspace holds: its directories, what contains what, and how facts spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

ROOT = "."


def _ancestors(path: Column) -> Column:
    """The directories above a path, nearest last, without the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def directories(paths: DataFrame) -> DataFrame:
    """(directory, paths) of all directories above the paths (path), with how many lie below."""
    return paths.select(F.explode(_ancestors(F.col("path"))).alias("directory")).groupBy("directory").agg(F.count("*").alias("paths"))


def contains(paths: DataFrame) -> DataFrame:
    """(from, to): the root contains what is at the top, a directory what is directly in it."""
    chain = F.concat(F.array(F.lit(ROOT)), _ancestors(F.col("path")), F.array(F.col("path")))
    pairs = paths.select(chain.alias("c")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("from"), F.element_at("c", i + 1).alias("to")))).alias("p"))
    return pairs.select("p.*").distinct()


def entities(paths: DataFrame) -> DataFrame:
    """(path, kind, parent, children): directories and files, each with its parent."""
    links = contains(paths)
    below = links.groupBy(F.col("from").alias("path")).agg(F.count("*").alias("children"))
    kinds = links.select(F.col("to").alias("path"), F.col("from").alias("parent")).join(below, "path", "left")
    return kinds.select("path", F.when(F.col("children").isNull(), "file").otherwise("directory").alias("kind"), "parent", F.coalesce("children", F.lit(0).cast("long")).alias("children"))


def anchor_lines(texts: DataFrame, words: list[str]) -> DataFrame:
    """(id, line, hits): of each text (id, text) the line that shares most words, the first of equals."""
    wanted = F.array(*map(F.lit, words))
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    hits = lines.withColumn("hits", F.size(F.array_intersect(T.tokens(F.col("body")), wanted)))
    best = hits.groupBy("id").agg(F.max(F.struct("hits", (-F.col("line")).alias("minus"))).alias("b"))
    return best.select("id", (-F.col("b.minus")).cast("long").alias("line"), F.col("b.hits").cast("long").alias("hits"))


def unit_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("unit_id").agg(F.count("*").alias("n"))


def ambiguous_routes(edges: DataFrame) -> DataFrame:
    """(route, owners, first) of routes that more than one page links."""
    routes = edges.where("kind = 'links-to'").groupBy(F.col("to").alias("route")).agg(F.count_distinct("from").alias("owners"), F.min("from").alias("first"))
    return routes.where("owners > 1")
