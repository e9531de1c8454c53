"""Plumbing shared by the training-data operators: reading tables, spooling to
the folder that all executors share, and chunked access to Arrow batches."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
#: An odd multiplier of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share: spark.checkpoint.dir. Only
    where all run in one process may it be unset, and is a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def spool(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and
    a lost executor costs a read, not a recomputation. `done` are spools that
    nothing reads from now on; they are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spooled_at = path
    unspool(*done)
    return out


def unspool(*done: DataFrame) -> None:
    """Delete spools that nothing reads any more."""
    for df in done:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.spooled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with the fewest underscores that no column of df has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns docs has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus is remainder; a null id counts as the text 'null'."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % modulus) == remainder


def rows_by_size(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose text is about limit bytes; a longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _bytes(column: pa.Array) -> list:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def utf8(column: pa.Array) -> list[bytes | None]:
    return _bytes(column)


def give_back() -> None:
    """Return freed memory to the system. A worker that waits for its next task keeps
    what its last one took otherwise, beside the memory of all that runs meanwhile."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of Arrow batches, which gives memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], dict | None], schema: str, text: str = "text", limit: int = 1 << 20, start: Callable | None = None) -> DataFrame:
    """mapInArrow with bounded memory: each() gets slices of about limit bytes of
    text, and start(), if any, makes what a task needs once."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        state = (start(),) if start else ()
        for batch in batches:
            for piece in rows_by_size(batch, text, limit):
                out = each(piece, *state)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(giving_back(run), schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below n."""
    for k, base in enumerate((BASE, BASE_INV)):
        have = _POWERS[k]
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[k] = have
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (murmur's finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] = sum of (data[i] + 1) * BASE**i over i < j, modulo 2**64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes anywhere."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and \\t\\n\\v\\f\\r."""
    edge = np.diff(np.concatenate(([False], ~_SPACE[data], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, in order; long texts are taken in
    pieces that end between words, so memory stays bounded."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + piece)
        if end < len(text):
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
        data = lower_ascii(np.frombuffer(text, np.uint8, end - at, at))
        s, e = word_spans(data)
        out.append(span_hash(prefix_sums(data), s, e))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
