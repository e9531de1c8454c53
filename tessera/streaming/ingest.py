"""Streams of fact batches into a store, a micro-batch at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.schema import DDL, FAMILIES, Facts, conform
from tessera.sources.store import Store

#: One row a unit: its facts as arrays, and when it was sent.
BATCH = f"sent bigint, removed boolean, unit struct<{DDL['units']}>, " + ", ".join(f"{f} array<struct<{DDL[f]}>>" for f in FAMILIES[1:])


def latest(rows: DataFrame) -> DataFrame:
    """The last sent row of each unit."""
    place = F.row_number().over(Window.partitionBy("unit.id").orderBy(F.desc("sent")))
    return rows.withColumn("k", place).where("k = 1").drop("k")


def unpack(rows: DataFrame) -> Facts:
    parts = {f: conform(rows.select(F.explode(f).alias("x")).select("x.*"), f) for f in FAMILIES[1:]}
    return Facts(units=conform(rows.select("unit.*"), "units"), **parts)


def apply_batch(store: Store, rows: DataFrame) -> str | None:
    """Replace the batch's units; sending a batch again changes nothing."""
    rows = latest(rows).persist()
    try:
        if rows.isEmpty():
            return None
        gone = rows.where("removed").select("unit.id")
        return store.replace_units(unpack(rows.where("NOT coalesce(removed, false)")), gone)
    finally:
        rows.unpersist()


def watch(spark: SparkSession, source: str, root: str, checkpoint: str, every: str = "750 milliseconds", once: bool = False) -> StreamingQuery:
    """Follow a folder of JSON batches; each micro-batch is one generation."""
    store = Store(spark, root)
    rows = spark.readStream.schema(BATCH).json(source)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_batch(store, df) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def unit_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, state): reuse, refresh, new or removed, by input fingerprint."""
    a, b = before.select("id", F.col("input_fingerprint").alias("was")), after.select("id", F.col("input_fingerprint").alias("is"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "reuse").otherwise("refresh")
    return a.join(b, "id", "full_outer").select("id", state.alias("state"))


@dataclass
class Retry:
    """When to try again after failures: twice as long each time, up to a cap; a
    new observation may be tried at once."""

    first: float = 0.75
    cap: float = 30.0
    failures: int = 0
    token: str = ""

    def failed(self, token: str) -> float:
        self.failures = self.failures + 1 if token == self.token else 1
        self.token = token
        return min(self.cap, self.first * 2 ** (self.failures - 1))

    def succeeded(self) -> None:
        self.failures, self.token = 0, ""

    def may_try(self, token: str, waited: float) -> bool:
        return token != self.token or waited >= min(self.cap, self.first * 2 ** max(0, self.failures - 1))
