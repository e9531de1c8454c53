"""Fact generations: immutable Parquet folders, published by one small manifest.

A generation is written whole before the manifest names it, so readers see the
last one or the new one. Replacing units keeps all other units' rows as they are.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import DDL, FAMILIES, SCHEMA_VERSION, Facts, conform, problems


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where all run in one process may it be unset, and is a
    folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def spooled(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer published first."""


class Store:
    """A folder of generations, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def manifest(self) -> dict | None:
        """The generation that is current. manifest.json may lag behind a writer that was
        lost: the successors that generations were given lead on from it."""
        got = self._read("manifest.json")
        while after := self._read(self._successor(got)):
            got = after
        if got and got["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"generation of schema {got['schema_version']}; rebuild the store")
        return got

    @staticmethod
    def _successor(of: dict | None) -> str:
        return f"next-of-{of['generation'] if of else 'nothing'}.json"

    def _read(self, name: str) -> dict | None:
        if not self.fs.exists(self._path(name)):
            return None
        text = "".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())
        return json.loads(text) if text else None

    def load(self) -> Facts | None:
        m = self.manifest()
        if m is None:
            return None
        return Facts(**{f: self.spark.read.schema(DDL[f]).parquet(f"{self.root}/{m['generation']}/{f}") for f in FAMILIES})

    def publish(self, facts: Facts, expected: str | None = "") -> str:
        """Write a generation, then name it in the manifest. With `expected` (a generation,
        or None for no manifest), only if that is still the one; Conflict otherwise."""
        name = f"generation-{uuid.uuid4().hex}"
        current = self.manifest()
        before = (current or {}).get("generation") if expected == "" else expected
        for family, df in facts.families().items():
            out = conform(df, family)
            out = out.sortWithinPartitions("from", "kind", "to") if family == "edges" else out.sortWithinPartitions("id")
            out.write.parquet(f"{self.root}/{name}/{family}")
        # A generation has one successor: whoever creates that file publishes. It needs a file
        # system on which two can't create one file.
        current, mine = self.manifest(), {"schema_version": SCHEMA_VERSION, "generation": name}
        if (current or {}).get("generation") != before or not self._create(self._path(self._successor(current)), json.dumps(mine)):
            self.fs.delete(self._path(name), True)
            raise Conflict(f"the store moved on from {before}")
        self._write_manifest(mine)
        return name

    def _create(self, path, text: str) -> bool:
        """Create a file unless it exists; one that a lost writer left empty makes way."""
        if self.fs.exists(path):
            status = self.fs.getFileStatus(path)
            if status.getLen() or status.getModificationTime() > (time.time() - 60) * 1000:
                return False
            self.fs.delete(path, False)
        try:
            out = self.fs.create(path, False)
        except Py4JJavaError as e:
            if self.fs.exists(path):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _write_manifest(self, value: dict) -> None:
        fresh = self._path(f"manifest-{uuid.uuid4().hex}.json")
        out = self.fs.create(fresh)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        target = self._path("manifest.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(fresh, target, options)

    def replace_units(self, batch: Facts, removed: DataFrame | None = None) -> str:
        """Units of the batch take the place of theirs; removed ones (id) go."""
        bad = problems(batch).limit(5).collect()
        if bad:
            raise ValueError(f"facts break their rules: {[tuple(r) for r in bad]}")
        gone = batch.units.select("id")
        if removed is not None:
            if not removed.join(gone, "id", "left_semi").isEmpty():
                raise ValueError("a unit is both replaced and removed")
            gone = gone.unionByName(removed.select("id"))
        m = self.manifest()
        expected = m["generation"] if m else None
        base = self.load()
        if base is None:
            return self.publish(batch, expected)

        def keep(family: str, df: DataFrame) -> DataFrame:
            key = "id" if family == "units" else "unit_id"
            left = df.join(gone.select(F.col("id").alias(key)), key, "left_anti")
            return conform(left, family).unionByName(conform(batch.families()[family], family))

        merged = base.map(keep)
        for family, df in merged.families().items():
            if not df.groupBy("id").count().where("count > 1").isEmpty():
                raise ValueError(f"{family}: an id belongs to two units")
        return self.publish(merged, expected)

    def collect_garbage(self, age_seconds: int = 3600) -> int:
        """Delete generations, older than the age, that the manifest doesn't name; their
        number. A younger one may be another writer's, not published yet."""
        m, n = self.manifest(), 0
        before = (time.time() - age_seconds) * 1000
        for s in self.fs.listStatus(self._path()):
            name = s.getPath().getName()
            if name.startswith("generation-") and (m is None or name != m["generation"]) and s.getModificationTime() <= before:
                self.fs.delete(s.getPath(), True)
                n += 1
        return n
