"""Snapshot differences, impact roots, affected tests, and integrity."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.schema import OPEN_ENDPOINT, Facts

# Kinds of symbol that stand for a changed file.
ROOT_KINDS = ["function", "method", "type", "field", "constant", "package", "file", "asset", "symlink", "document", "section"]
PATH_KINDS = ["file", "asset", "symlink", "document"]
# What the letters of a source change mean.
CHANGES = {"A": "added", "C": "copied", "D": "deleted", "M": "modified", "R": "renamed", "T": "type-changed", "U": "unmerged", "B": "broken"}


def _digest(df: DataFrame, ignore: tuple[str, ...], first: str, second: str) -> list[Column]:
    """All columns but id and ignored ones as two 64-bit hashes, so that only these are
    shuffled; records that differ share both with a chance of 2**-128. A null is told
    apart from any value, at any depth."""
    values = []
    for f in df.schema.fields:
        if f.name != "id" and f.name not in ignore:
            c = F.col(f"`{f.name}`")
            nested = f.dataType.typeName() in ("struct", "array", "map")
            values += [c.isNull(), F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}) if nested else c]
    return [F.xxhash64(F.lit(0), *values).alias(first), F.xxhash64(F.lit(1), *values).alias(second)]


def delta(before: DataFrame, after: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(id, change) of records added, removed or changed in any other column."""
    after = after.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in before.schema.fields])
    both = before.select("id", *_digest(before, ignore, "was", "was2")).join(after.select("id", *_digest(after, ignore, "is", "is2")), "id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when((F.col("was") != F.col("is")) | (F.col("was2") != F.col("is2")), "changed")
    return both.select("id", change.alias("change")).where("change IS NOT NULL")


def snapshot_delta(before: Facts, after: Facts, limit: int | None = None) -> DataFrame:
    """(family, change, id, total) for all families; limit bounds each change of each family."""
    parts = [delta(df, after.families()[name]).select(F.lit(name).alias("family"), "change", "id") for name, df in before.families().items()]
    rows = reduce(DataFrame.unionByName, parts)
    if limit is None:
        return rows
    totals = rows.groupBy("family", "change").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("family", "change").orderBy("id"))
    return rows.withColumn("k", place).where(F.col("k") <= limit).drop("k").join(F.broadcast(totals), ["family", "change"])


def surface_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Units whose surface appeared, went or changed; a blank surface is none."""
    side = lambda df, name: df.where("surface_fingerprint <> ''").select("id", F.col("surface_fingerprint").alias(name))
    both = side(before, "was").join(side(after, "is"), "id", "full_outer").where("NOT was <=> is")
    return both.select("id", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed").alias("change"), F.coalesce("was", F.lit("")).alias("before"), F.coalesce("is", F.lit("")).alias("after"))


def transitions(before: Facts, after: Facts) -> DataFrame:
    """(id, status) of symbols that were added, removed or changed, for drawing."""
    return delta(before.symbols, after.symbols).select("id", F.col("change").alias("status"))


def _new(before: Facts, after: Facts, family: str, *columns: str) -> DataFrame:
    """Columns of the later snapshot's records that are added or changed."""
    was, now = before.families()[family], after.families()[family]
    now = now.select("id", *[c for c in columns if c != "id"], *_digest(now, (), "is", "is2"))
    both = now.join(was.select("id", *_digest(was, (), "was", "was2")), "id", "left")
    return both.where("was IS NULL OR was <> is OR was2 <> is2").select(*columns)


def _gone(before: Facts, after: Facts, family: str, *columns: str) -> DataFrame:
    return before.families()[family].join(after.families()[family].select("id"), "id", "left_anti").select(*columns)


def _all_ids(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).where(F.trim("id") != "").distinct()


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("from", "to")).alias("id"))


def current_roots(before: Facts, after: Facts) -> DataFrame:
    """(id) of what the later snapshot's new and changed facts touch: symbols, those of
    occurrences, both ends of edges, and all symbols of such units and documents. An
    end needn't have a symbol."""
    new = lambda family, *columns: _new(before, after, family, *columns)
    in_units = after.symbols.join(new("units", "id").withColumnRenamed("id", "unit_id"), "unit_id", "left_semi")
    in_documents = after.symbols.join(new("documents", "id").withColumnRenamed("id", "document_id"), "document_id", "left_semi")
    occurring = new("occurrences", "symbol_id").select(F.col("symbol_id").alias("id"))
    return _all_ids([new("symbols", "id"), occurring, _ends(new("edges", "from", "to")), in_units.select("id"), in_documents.select("id")])


def removed_roots(before: Facts, after: Facts) -> DataFrame:
    """(id) of what removed facts touched: symbols, those of occurrences, both ends of edges."""
    gone = lambda family, *columns: _gone(before, after, family, *columns)
    occurring = gone("occurrences", "symbol_id").select(F.col("symbol_id").alias("id"))
    return _all_ids([gone("symbols", "id"), occurring, _ends(gone("edges", "from", "to"))])


def removed_units(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after.select("id"), "id", "left_anti").select("id")


def change_name(letter: Column) -> Column:
    out = F.lit("unknown")
    for k, v in CHANGES.items():
        out = F.when(letter == k, v).otherwise(out)
    return out


def safe_path(value: str) -> str:
    """A path inside a repository, cleaned; any other raises ValueError."""
    path = posixpath.normpath(value) if value else ""
    if not value or value.startswith("/") or path in (".", "..") or path.startswith("../"):
        raise ValueError(f"not a path inside the repository: {value!r}")
    return path


def _names(packages: list[str]) -> list[str]:
    names = [p.strip() for p in packages]
    if "" in names:
        raise ValueError("a package name is empty")
    return names


def impact_roots(facts: Facts, files: list[str], packages: list[str] = (), required: bool = True) -> DataFrame:
    """(id) of symbols that stand for files and packages, and of all in a package's unit;
    paths are compared clean. LookupError if nothing matches, unless not required."""
    wanted, names = [safe_path(f) for f in files], _names(packages)
    paths = facts.documents.where(T.clean_path(F.col("path")).isin(wanted)).select(F.col("id").alias("document_id"))
    inside = facts.symbols.join(paths, "document_id", "left_semi").where(F.col("kind").isin(ROOT_KINDS)).select("id")
    named = facts.symbols.where(F.col("kind").isin(PATH_KINDS) & T.clean_path(F.col("stable_name")).isin(wanted)).select("id")
    package = facts.symbols.where((F.col("kind") == "package") & (F.col("stable_name").isin(names) | F.col("display_name").isin(names)))
    members = facts.symbols.join(package.select("unit_id").distinct(), "unit_id", "left_semi").select("id")
    roots = _all_ids([inside, named, package.select("id"), members])
    if required and roots.isEmpty():
        raise LookupError(f"nothing stands for {[*wanted, *names]}")
    return roots


def missing_roots(facts: Facts, files: list[str], packages: list[str] = ()) -> DataFrame:
    """(missing): `file:` paths and `package:` names that nothing stands for."""
    spark, s = facts.documents.sparkSession, facts.symbols
    paths = facts.documents.select(T.clean_path(F.col("path")).alias("path")).unionByName(s.where(F.col("kind").isin(PATH_KINDS)).select(T.clean_path(F.col("stable_name")).alias("path")))
    names = s.where("kind = 'package'").select(F.explode(F.array("stable_name", "display_name")).alias("name"))
    lost = spark.createDataFrame([(safe_path(f),) for f in files], "path string").join(paths, "path", "left_anti").select(F.concat(F.lit("file:"), "path").alias("missing"))
    return lost.unionByName(spark.createDataFrame([(p,) for p in _names(packages)], "name string").join(names, "name", "left_anti").select(F.concat(F.lit("package:"), "name").alias("missing"))).distinct()


def test_evidence(facts: Facts, nodes: DataFrame) -> DataFrame:
    """(id, evidence, reason, edge) of tests among nodes (id): a declared edge goes
    before the symbol's kind, and that before the naming convention."""
    mine = facts.symbols.join(nodes.select("id").distinct(), "id", "left_semi")
    declared = facts.edges.where("kind = 'tests'").groupBy(F.col("from").alias("id")).agg(F.min(F.struct("from", "kind", "to", "evidence", F.col("id").alias("edge"))).alias("e"))
    rows = mine.join(declared, "id", "left").join(facts.documents.select(F.col("id").alias("document_id"), "path"), "document_id", "left")
    named = F.col("path").endswith("_test.go") & F.col("display_name").rlike("^(Test|Benchmark|Fuzz)")
    # The reasons.
    reason = F.when(F.col("e").isNotNull(), "explicit tests relationship").when(F.col("kind") == "test", "provider-classified test symbol").when(named, "Go test declaration naming convention")
    evidence = F.when(F.col("e").isNotNull(), F.col("e.evidence")).when(F.col("kind") == "test", F.col("evidence")).otherwise("syntactic")
    return rows.select("id", evidence.alias("evidence"), reason.alias("reason"), F.coalesce("e.edge", F.lit("")).alias("edge")).where("reason IS NOT NULL")


def affected_tests(facts: Facts, nodes: DataFrame) -> DataFrame:
    """(id, reason) of tests among nodes (id): an explicit edge, the kind, or the naming convention."""
    mine = facts.symbols.join(nodes.select("id"), "id", "left_semi")
    declared = facts.edges.where("kind = 'tests'").groupBy(F.col("from").alias("id")).agg(F.min(F.struct("from", "kind", "to", "evidence", F.col("id").alias("edge"))).alias("e"))
    rows = mine.join(declared, "id", "left").join(facts.documents.select(F.col("id").alias("document_id"), "path"), "document_id", "left")
    named = F.col("path").endswith("_test.go") & F.col("display_name").rlike("^(Test|Benchmark|Fuzz)")
    reason = F.when(F.col("e").isNotNull(), F.concat(F.lit("tests "), F.col("e.to"))).when(F.col("kind") == "test", "symbol kind test").when(named, "test naming convention")
    return rows.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def verify(facts: Facts) -> DataFrame:
    """(severity, kind, record) of records that contradict each other; occurrences of
    deliberately open symbols are fine, and other unresolved ones only warn."""
    units = facts.units.select(F.col("id").alias("unit_id")).distinct()
    owned = facts.documents.select(F.col("id").alias("document_id"), "unit_id").distinct()
    issue = lambda df, severity, kind: df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col("id").alias("record"))
    parts = [issue(df.join(units, "unit_id", "left_anti"), "error", f"orphan-{name}") for name, df in (("document", facts.documents), ("symbol", facts.symbols), ("edge", facts.edges), ("occurrence", facts.occurrences))]
    for name, df in (("symbol", facts.symbols), ("edge", facts.edges), ("occurrence", facts.occurrences)):
        placed = df if name == "occurrence" else df.where("document_id <> ''")
        parts.append(issue(placed.join(owned, ["document_id", "unit_id"], "left_anti"), "error", f"invalid-{name}-document"))
    closed = facts.occurrences.where(~F.col("symbol_id").rlike(OPEN_ENDPOINT))
    parts.append(issue(closed.join(facts.symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti"), "warning", "unresolved-occurrence"))
    return reduce(DataFrame.unionByName, parts)


def fatal(issues: DataFrame) -> DataFrame:
    return issues.where("severity <> 'warning'")


def entity_usage(facts: Facts) -> DataFrame:
    """(id, uses): how often each entity is named by symbols, occurrences and edges."""
    s, o, e = facts.symbols.select("id"), facts.occurrences.select(F.col("symbol_id").alias("id")), facts.edges
    return reduce(DataFrame.unionByName, [s, o, e.select(F.col("from").alias("id")), e.select(F.col("to").alias("id"))]).groupBy("id").agg(F.count("*").alias("uses"))
