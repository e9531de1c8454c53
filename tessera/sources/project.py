"""A fact graph projected from relational tables, so that every operator has data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.schema import Facts, conform


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of every table; id is `kind:key`, stable names are path-like."""

    def of(name, kind, key, stable, display, unit=None, document=None, terms=None):
        df = _table(spark, sf_dir, name)
        unit = unit if unit is not None else F.lit(f"tables:{name}")
        shown = display.cast("string")
        return df.select(
            _id(kind, key).alias("id"), unit.alias("unit_id"), stable.alias("stable_name"), shown.alias("display_name"), T.normalize_name(shown).alias("normalized_name"),
            (terms if terms is not None else F.array().cast("array<string>")).alias("search_terms"), F.lit(kind).alias("kind"), (document if document is not None else F.lit("")).alias("document_id"),
            F.lit("tables").alias("provider"), F.lit("exact").alias("evidence"),
        )

    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [
        of("region", "region", "r_regionkey", key("region/", "r_name"), F.col("r_name")),
        of("nation", "nation", "n_nationkey", key("nation/", "n_name"), F.col("n_name")),
        of("customer", "customer", "c_custkey", key("customer/", "c_custkey"), F.col("c_name"), unit=key("customer:", "c_nationkey")),
        of("supplier", "supplier", "s_suppkey", key("supplier/", "s_suppkey"), F.col("s_name"), unit=key("supplier:", "s_nationkey")),
        of("part", "part", "p_partkey", key("part/", "p_partkey"), F.col("p_name"), terms=T.search_terms(F.concat_ws(" ", "p_brand", "p_type"))),
        of("orders", "order", "o_orderkey", key("order/", "o_orderkey"), key("Order#", "o_orderkey"), document=_id("orders", "o_orderkey")),
        of("events", "event", "event_id", key("event/", "event_id"), F.col("event_type")),
        of("pages", "page", "page_id", key("page/", "page_id"), F.col("url"), document=_id("pages", "page_id")),
        of("documents", "document", "doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")), key("Doc", "doc_id"), document=_id("docs", "doc_id"), terms=T.search_terms("text")),
    ]
    return reduce(DataFrame.unionByName, parts)


def numbered_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order))
    return _table(spark, sf_dir, "lineitem").withColumn("n", n)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(df, kind, source, target, evidence="exact", more=None, document=None):
        ident = F.concat_ws(">", F.concat(F.lit(f"{kind}:"), source), target, *([more] if more is not None else []))
        return df.select(ident.alias("id"), F.lit(f"tables:{kind}").alias("unit_id"), source.alias("from"), target.alias("to"), F.lit(kind).alias("kind"), F.lit(evidence).alias("evidence"), (document if document is not None else F.lit("")).alias("document_id"), F.lit("tables").alias("provider"))

    t = lambda name: _table(spark, sf_dir, name)
    lines = t("lineitem")
    follows = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    calls = t("events").withColumn("next", follows).where("next IS NOT NULL")
    hrefs = t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("href"))
    parts = [
        of(t("nation"), "contains", _id("region", "n_regionkey"), _id("nation", "n_nationkey")),
        of(t("customer"), "contains", _id("nation", "c_nationkey"), _id("customer", "c_custkey")),
        of(t("supplier"), "contains", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey")),
        of(t("orders"), "contains", _id("customer", "o_custkey"), _id("order", "o_orderkey")),
        of(numbered_lineitems(spark, sf_dir), "references", _id("order", "l_orderkey"), _id("part", "l_partkey"), more=F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("n").cast("string")), document=_id("orders", "l_orderkey")),
        of(lines.select("l_orderkey", "l_partkey").distinct(), "depends-on", _id("order", "l_orderkey"), _id("part", "l_partkey"), "declared"),
        of(lines.select("l_partkey", "l_suppkey").distinct(), "imports", _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "declared"),
        of(calls, "calls", _id("event", "event_id"), _id("event", "next"), "syntactic"),
        of(t("events"), "member-of", _id("event", "event_id"), _id("customer", "user_id"), "declared"),
        of(hrefs, "links-to", _id("page", "page_id"), F.concat(F.lit("route:"), F.col("href")), "declared", document=_id("pages", "page_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(df, kind, key, path, content):
        return df.select(_id(kind, key).alias("id"), F.lit(f"tables:{df_name[kind]}").alias("unit_id"), path.alias("path"), F.sha2(content, 256).alias("content_hash"), F.lit("tables").alias("provider"), F.lit("1").alias("provider_version"))

    df_name = {"orders": "orders", "pages": "pages", "docs": "documents"}
    o, p, d = (_table(spark, sf_dir, n) for n in ("orders", "pages", "documents"))
    return reduce(DataFrame.unionByName, [
        of(o, "orders", "o_orderkey", F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")), F.col("o_orderstatus")),
        of(p, "pages", "page_id", F.concat(F.lit("pages/"), F.col("page_id").cast("string")), F.col("html")),
        of(d, "docs", "doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text")),
    ])


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = numbered_lineitems(spark, sf_dir)
    at = lambda c: F.struct(F.col("l_linenumber").alias("line"), F.lit(c).alias("column"), F.lit(-1).cast("long").alias("byte"))
    return lines.select(
        F.concat_ws(":", F.lit("occurrence"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("n").cast("string")).alias("id"), F.lit("tables:orders").alias("unit_id"),
        _id("part", "l_partkey").alias("symbol_id"), _id("orders", "l_orderkey").alias("document_id"), F.lit("reference").alias("role"), F.struct(at(0).alias("start"), at(1).alias("end")).alias("range"), F.lit("tables").alias("provider"), F.lit("exact").alias("evidence"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit for each id that symbols and edges name; its fingerprint sums row digests."""
    named = symbols(spark, sf_dir).select("unit_id", F.xxhash64("id", "stable_name", "display_name").alias("h"))
    named = named.unionByName(edges(spark, sf_dir).select("unit_id", F.xxhash64("id", "evidence").alias("h")))
    digest = F.sha2(F.sum(F.col("h").cast("decimal(38,0)")).cast("string"), 256)
    return named.groupBy("unit_id").agg(digest.alias("input_fingerprint")).select(F.col("unit_id").alias("id"), F.lit("tables").alias("provider"), F.lit("1").alias("provider_version"), "input_fingerprint", F.col("input_fingerprint").alias("surface_fingerprint"))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    makers = {"units": units, "documents": documents, "symbols": symbols, "occurrences": occurrences, "edges": edges}
    return Facts(**{name: conform(make(spark, sf_dir), name) for name, make in makers.items()})
