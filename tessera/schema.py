"""The fact tables: units, documents, symbols, occurrences and edges."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
RANGE = "struct<start:struct<line:int,column:int,byte:bigint>,end:struct<line:int,column:int,byte:bigint>>"
DDL = {
    "units": "id string, provider string, provider_version string, language string, variant string, input_fingerprint string, surface_fingerprint string, inventory_digest string",
    "documents": "id string, unit_id string, path string, language string, content_hash string, provider string, provider_version string",
    "symbols": f"id string, unit_id string, stable_name string, display_name string, normalized_name string, search_terms array<string>, kind string, document_id string, definition {RANGE}, provider string, evidence string",
    "occurrences": f"id string, unit_id string, symbol_id string, document_id string, role string, range {RANGE}, provider string, evidence string",
    "edges": f"id string, unit_id string, `from` string, `to` string, kind string, evidence string, document_id string, range {RANGE}, provider string",
}
FAMILIES = list(DDL)

# The kinds of evidence, and the kinds of edge in their order of selection.
EVIDENCE = ["exact", "declared", "generated", "inferred", "syntactic", "ambiguous"]
EDGE_KINDS = [
    "calls", "contains", "depends-on", "defines", "documents", "embeds", "exposes", "extends", "generates", "handles",
    "implements", "imports", "instantiates", "links-to", "member-of", "reads", "references", "resolves-to", "tests", "writes",
]
IMPACT_KINDS = ["calls", "references", "depends-on", "implements", "imports", "tests", "links-to", "embeds"]
CONTENT_KINDS = ["links-to", "embeds", "documents", "generates", "exposes", "member-of", "resolves-to"]
# Kinds of workspace entities.
WORKSPACE_KINDS = ["workspace", "directory", "file", "asset", "symlink", "resource", "document", "section", "code-block", "route", "series", "topic", "url"]
OPEN_ENDPOINT = "^(external|go-external|open|schema-open):"


def no_range() -> Column:
    at = F.struct(F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit(0).cast("long").alias("byte"))
    return F.struct(at.alias("start"), at.alias("end"))


def kind_code(kind: Column) -> Column:
    """Selection order of an edge kind, from 1; 0 for an unknown one."""
    return F.array_position(F.array(*map(F.lit, EDGE_KINDS)), kind).cast("int")


@dataclass(frozen=True)
class Facts:
    """One snapshot: a DataFrame for each family."""

    units: DataFrame
    documents: DataFrame
    symbols: DataFrame
    occurrences: DataFrame
    edges: DataFrame

    def families(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def map(self, change) -> Facts:
        return Facts(**{name: change(name, df) for name, df in self.families().items()})


def empty(spark: SparkSession) -> Facts:
    return Facts(**{name: spark.createDataFrame([], ddl) for name, ddl in DDL.items()})


def conform(df: DataFrame, family: str) -> DataFrame:
    """df with the family's columns, types and order; absent columns get blanks."""
    from pyspark.sql.types import StructType

    out = []
    for field in StructType.fromDDL(DDL[family]).fields:
        blank = no_range() if "struct" in field.dataType.simpleString() else F.array().cast("array<string>") if field.name == "search_terms" else F.lit("")
        out.append((F.coalesce(F.col(f"`{field.name}`"), blank) if field.name in df.columns else blank).cast(field.dataType).alias(field.name))
    return df.select(*out)


def problems(facts: Facts) -> DataFrame:
    """Rows (family, record, problem) of a batch that break the rules of its tables."""
    s, o, e, d = facts.symbols, facts.occurrences, facts.edges, facts.documents
    parts = []

    def put(family: str, df: DataFrame, problem: str, where) -> None:
        parts.append(df.where(where).select(F.lit(family).alias("family"), F.col("id").alias("record"), F.lit(problem).alias("problem")))

    for family, df in facts.families().items():
        put(family, df, "blank id", F.coalesce(F.col("id"), F.lit("")) == "")
        twice = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        put(family, twice, "repeated id", F.lit(True))
        if family != "units":
            put(family, df.join(facts.units.select(F.col("id").alias("unit_id")), "unit_id", "left_anti"), "no such unit", F.lit(True))
    put("documents", d, "blank path", F.col("path") == "")
    put("symbols", s, "blank name", (F.col("stable_name") == "") | (F.col("display_name") == ""))
    put("symbols", s, "unknown evidence", ~F.col("evidence").isin(EVIDENCE))
    put("symbols", s, "bad search terms", F.exists("search_terms", lambda t: (F.octet_length(t) > 128) | (t == "")) | (F.size("search_terms") > 2048))
    put("edges", e, "blank endpoint", (F.col("from") == "") | (F.col("to") == ""))
    put("edges", e, "unknown kind", ~F.col("kind").isin(EDGE_KINDS))
    put("edges", e, "unknown evidence", ~F.col("evidence").isin(EVIDENCE))
    owned = d.select(F.col("id").alias("document_id"), "unit_id")
    put("occurrences", o.join(owned, ["document_id", "unit_id"], "left_anti"), "document not in unit", F.lit(True))
    for family, df in (("symbols", s), ("edges", e)):
        put(family, df.where("document_id <> ''").join(owned, ["document_id", "unit_id"], "left_anti"), "document not in unit", F.lit(True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
