"""Which adapter owns an input path: claims by name, extension and marker."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Conflict(ValueError):
    """Two adapters own one path."""


@dataclass(frozen=True)
class Claim:
    """An adapter's claim: base names and extensions (with their dot; `.*` is any) it reads, in
    lower case; markers are base names one of which must be there for it to be active; a
    fallback yields to others."""

    name: str
    extensions: list[str] = field(default_factory=list)
    filenames: list[str] = field(default_factory=list)
    markers: list[str] = field(default_factory=list)
    fallback: bool = False


def _base(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def _claimed(claim: Claim, path: Column) -> Column:
    base = _base(path)
    extension = F.when(F.instr(base, ".") > 0, F.concat(F.lit("."), F.substring_index(base, ".", -1))).otherwise("")
    return F.lit(".*" in claim.extensions) | extension.isin(claim.extensions) | base.isin(claim.filenames)


def route(paths: DataFrame, claims: list[Claim]) -> DataFrame:
    """(path, owner, owners) of each of paths (path) that an active claim covers: the
    precise claims, or the fallbacks where there are none; owner is the least of owners.
    Rows of more than one owner are conflicts."""
    markers = [m for c in claims for m in c.markers]
    present = {r[0] for r in paths.select(_base(F.col("path")).alias("m")).where(F.col("m").isin(markers)).distinct().collect()} if markers else set()  # no more than there are markers
    active = [c for c in claims if not c.markers or present & set(c.markers)]
    of = lambda wanted: F.array_compact(F.array(*[F.when(_claimed(c, F.col("path")), F.lit(c.name)) for c in active if c.fallback == wanted], F.lit(None).cast("string")))
    owners = paths.select("path").distinct().select("path", of(False).alias("precise"), of(True).alias("fallback"))
    owners = owners.select("path", F.array_sort(F.when(F.size("precise") > 0, F.col("precise")).otherwise(F.col("fallback"))).alias("owners")).where(F.size("owners") > 0)
    return owners.select("path", F.col("owners")[0].alias("owner"), "owners")


def routed(paths: DataFrame, claims: list[Claim]) -> DataFrame:
    """(path, owner); Conflict if a path has two."""
    found = route(paths, claims)
    if bad := found.where(F.size("owners") > 1).orderBy("path").head(1):
        raise Conflict(f"{bad[0]['owners'][0]!r} and {bad[0]['owners'][1]!r} both own {bad[0]['path']}")
    return found.select("path", "owner")
