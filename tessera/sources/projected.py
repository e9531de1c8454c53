"""The projected fact graph, written once a session and read back by all queries.

Tables are sorted by what they are looked up by, so a scan reads the row groups that a
filter needs: symbols by id, edges once by `from` and once by `to`, postings by token.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import search
from tessera.operators.traverse import Indexed
from tessera.schema import FAMILIES, Facts, conform
from tessera.sources import project
from tessera.sources.store import exists, shared_folder

_SORTED_BY = {"symbols": ["id"], "units": ["id"], "documents": ["id"], "occurrences": ["symbol_id", "document_id"], "edges": ["from", "kind", "to"], "edges_to": ["to", "kind", "from"], "postings": ["token", "id"]}
_MADE: dict[tuple[str, str, str], str] = {}


def _make(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "edges_to":
        return table(spark, sf_dir, "edges")
    if name == "postings":
        return search.postings(table(spark, sf_dir, "symbols"))
    return conform(getattr(project, name)(spark, sf_dir), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the projection; the first call of a session writes it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _MADE.get(key)
    if path is None or not exists(spark, f"{path}/_SUCCESS"):
        path = f"{shared_folder(spark)}/projection-{uuid.uuid4().hex}/{name}"
        by = _SORTED_BY[name]
        _make(spark, sf_dir, name).repartitionByRange(*by[:1]).sortWithinPartitions(*by).write.parquet(path)
        _MADE[key] = path
        spark._jvm.System.gc()  # shuffle files stay until the driver collects what refers to them
    return spark.read.parquet(path)


def edges(spark: SparkSession, sf_dir: str) -> Indexed:
    return Indexed(table(spark, sf_dir, "edges"), table(spark, sf_dir, "edges_to"))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(**{name: table(spark, sf_dir, name) for name in FAMILIES})
