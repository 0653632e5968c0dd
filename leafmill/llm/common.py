"""Shared plumbing: tables, the shared folder, text arrays for Arrow workers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Python step handles at once.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's; one of our own only in a single process without one (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")

        found = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in a table that survives lost executors.

    The folder goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, as a path for plain files: the shared folder has to be mounted on all machines.

    It goes when the JVM ends.
    """
    import os
    from urllib.parse import urlparse

    found = urlparse(shared_dir(spark))
    if found.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir has to be a mounted folder, not {found.geturl()}")
    path = f"{found.path}/leafmill/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def released(batches):
    """batches; after the last one the worker gives the memory that it no longer needs back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches, limit: int = BATCH_BYTES, rows: int = BATCH_ROWS, column: str = "text"):
    """Record batches, cut so that each holds at most `rows` rows and about `limit` bytes of text (one row at least)."""
    for batch in released(batches):
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.frombuffer(col.buffers()[1], np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64)
        at = 0
        while at < n:
            end = int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1
            end = min(max(end, at + 1), at + rows, n)
            yield batch.slice(at, end - at)
            at = end


def merged(batches, limit: int = BATCH_BYTES, column: str = "text"):
    """Small record batches joined, large ones cut: each result has about `limit` bytes of text."""
    held, size = [], 0
    for part in slices(batches, limit, 1 << 30, column):
        held.append(part)
        size += part.get_total_buffer_size() if len(held) == 0 else _bytes(part, column)
        if size >= limit:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(held):
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0]


def _bytes(batch, column: str) -> int:
    col = batch.column(batch.schema.get_field_index(column))
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1 + col.offset)[col.offset :]
    return int(off[-1] - off[0])


def raw(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) else b"")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def key_text(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and `more`; nothing else of df is read."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
