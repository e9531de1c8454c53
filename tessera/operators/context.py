"""Context of a symbol: definitions, one-hop relationships, and source excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.search import find_symbols
from tessera.schema import Facts

# Names of predeclared types and constants, and the rank of each kind of relationship.
BUILTINS = ["true", "false", "nil", "bool", "byte", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32", "int64", "rune", "string", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr"]
RANK = {
    0: ["calls"], 1: ["implements", "extends", "instantiates", "handles"], 2: ["tests", "depends-on", "imports"],
    3: ["exposes", "generates", "documents", "links-to", "embeds", "resolves-to"], 4: ["reads", "writes"], 5: ["member-of", "defines", "contains"], 6: ["references"],
}
MOST_READ = 512


def definitions(facts: Facts, query: str, limit: int = 50, index: DataFrame | None = None) -> DataFrame:
    """(pos, symbol_id, document_id, range): definitions of what a query finds, match
    by match; a symbol without one counts with its own place, if it has a document."""
    found = find_symbols(facts.symbols, query, limit, index)
    used = facts.occurrences.where("role = 'definition'").join(F.broadcast(found.select(F.col("id").alias("symbol_id"), F.col("pos").alias("place"))), "symbol_id")
    used = used.select("place", "symbol_id", "document_id", F.col("id").alias("occurrence"), "range")
    own = found.where("document_id <> ''").join(used.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_anti")
    rows = used.unionByName(own.select(F.col("pos").alias("place"), F.col("id").alias("symbol_id"), "document_id", F.lit("").alias("occurrence"), F.col("definition").alias("range")))
    order = ["place", "document_id", "occurrence"]
    return rows.orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("pos", "symbol_id", "document_id", "range")


def proximity(unit: Column, other_unit: Column, path: Column, other_path: Column) -> Column:
    """1000 for one unit, and 10 for each leading path segment in common."""
    return F.when(unit == other_unit, 1000).otherwise(0) + 10 * T.common_segments(F.coalesce(path, F.lit("")), F.coalesce(other_path, F.lit("")))


def relationships(facts: Facts, symbol: str, direction: str = "out", limit: int = 16) -> DataFrame:
    """(pos, edge, kind, other, name, near): one edge for each other end, the best
    kind's; references to variables and to built-in names stay out."""
    near, far = ("from", "to") if direction == "out" else ("to", "from")
    surplus = min(MOST_READ, max(limit + 1, 8 * limit))
    read = facts.edges.where(F.col(near) == symbol).select("id", "kind", F.col(far).alias("other")).orderBy("kind", "other", "id").limit(surplus)
    paths = facts.documents.select(F.col("id").alias("document_id"), "path")
    known = facts.symbols.select(F.col("id").alias("other"), F.col("unit_id").alias("unit"), F.col("display_name").alias("name"), F.col("stable_name").alias("stable"), F.col("kind").alias("what"), "document_id")
    focus = facts.symbols.where(F.col("id") == symbol).join(paths, "document_id", "left").select(F.col("unit_id").alias("own_unit"), F.col("path").alias("own_path")).limit(1)
    rows = known.join(F.broadcast(read), "other", "right").join(paths, "document_id", "left").join(F.broadcast(focus), F.lit(True), "left")
    dull = (F.col("kind") == "references") & (F.coalesce("what", F.lit("")).isin("variable", "parameter") | F.coalesce("stable", F.lit("")).isin(BUILTINS))
    rank = F.lit(7)
    for k, kinds in RANK.items():
        rank = F.when(F.col("kind").isin(kinds), k).otherwise(rank)
    rows = rows.where(~dull).withColumn("rank", rank).withColumn("near", F.coalesce(proximity(F.col("own_unit"), F.col("unit"), F.col("own_path"), F.col("path")), F.lit(0)))
    one = rows.withColumn("k", F.row_number().over(Window.partitionBy("other").orderBy("rank", "id"))).where("k = 1")
    order = ["rank", F.desc("near"), F.coalesce("name", "other"), "id"]
    return one.orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("pos", F.col("id").alias("edge"), "kind", "other", "name", "near")


def excerpts(places: DataFrame, contents: DataFrame, lines: int = 2, most_bytes: int = 64 << 10) -> DataFrame:
    """places (pos, document_id, content_hash, first, last: lines from 0) with the text
    around each and a status; contents is (document_id, text). Texts that aren't what
    was indexed aren't quoted. The byte budget is spent in order of pos by what is quoted:
    a place that no longer fits with the lines around it is quoted alone, and one that
    doesn't fit even so costs nothing."""
    rows = places.join(contents, "document_id", "left")
    parts = F.split("text", "\n")
    status = F.when(F.col("text").isNull(), "missing").when(F.sha2("text", 256) != F.col("content_hash"), "changed")
    status = status.when((F.col("first") < 0) | (F.col("last") < F.col("first")) | (F.col("first") >= F.size(parts)), "out of range").otherwise("current")

    def cut(around: int) -> Column:
        begin, end = F.greatest(F.lit(0), F.col("first") - around), F.least(F.size(parts) - 1, F.col("last") + around)
        return F.when(F.col("status") == "current", F.struct(begin.alias("start"), F.slice(parts, begin + 1, end - begin + 1).alias("lines")))

    def cost(c: Column) -> Column:
        return F.aggregate(c["lines"], F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))

    rows = rows.withColumn("status", status).withColumns({"wide": cut(lines), "bare": cut(0)})
    rows = rows.withColumns({"wide_cost": cost(F.col("wide")), "bare_cost": cost(F.col("bare"))})
    # One row of as many entries as there are places: what each may spend follows from those before it.
    entries = rows.where("status = 'current'").agg(F.array_sort(F.collect_list(F.struct("pos", "wide_cost", "bare_cost"))).alias("entries"))
    none = F.array().cast("array<struct<pos:bigint,choice:int>>")

    def spend(a: Column, x: Column) -> Column:
        choice = F.when(a["used"] + x["wide_cost"] <= most_bytes, 2).when(a["used"] + x["bare_cost"] <= most_bytes, 1).otherwise(0)
        used = a["used"] + F.when(choice == 2, x["wide_cost"]).when(choice == 1, x["bare_cost"]).otherwise(0)
        return F.struct(used.alias("used"), F.concat(a["out"], F.array(F.struct(x["pos"].cast("long").alias("pos"), choice.alias("choice")))).alias("out"))

    chosen = entries.select(F.explode(F.aggregate("entries", F.struct(F.lit(0).cast("long").alias("used"), none.alias("out")), spend, lambda a: a["out"])).alias("c")).select("c.*")
    rows = rows.join(chosen, "pos", "left")
    picked = F.when(F.col("choice") == 2, F.col("wide")).when(F.col("choice") == 1, F.col("bare"))
    status = F.when((F.col("status") == "current") & (F.col("choice") == 0), "over budget").otherwise(F.col("status"))
    return rows.select("pos", "document_id", status.alias("status"), picked["start"].alias("start"), F.array_join(picked["lines"], "\n").alias("quoted"))


def dossier(facts: Facts, symbol: str, limit: int = 16) -> dict[str, DataFrame]:
    """The focus, its occurrences (definitions first), and what is one hop away."""
    seen = facts.occurrences.where(F.col("symbol_id") == symbol)
    order = [F.when(F.col("role") == "definition", 0).otherwise(1), "document_id", "id"]
    return {
        "focus": facts.symbols.where(F.col("id") == symbol).drop("search_terms"),
        "evidence": seen.orderBy(*order).limit(limit),
        "incoming": relationships(facts, symbol, "in", limit),
        "outgoing": relationships(facts, symbol, "out", limit),
    }
