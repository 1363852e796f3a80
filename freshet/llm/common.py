"""Shared pieces of the text-corpus operators: sizing, shared folders, Arrow buffers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Compressed input bytes that one shard of documents should hold.
SHARD_BYTES = 3 << 19
#: Fewest shards, so that small inputs still spread over a cluster.
MIN_SHARDS = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Size of the input by Spark's own statistics; measured where there are none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 55:
        return size
    texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c, t in df.dtypes if t == "string"]
    row = df.agg(F.count(F.lit(1)), *texts).first()
    return 64 * row[0] + sum(row[1:])


def shard_count(df: DataFrame, bytes_each: int = SHARD_BYTES, least: int = MIN_SHARDS) -> int:
    """Shards in proportion to the input, whatever its size."""
    return int(max(least, -(-plan_bytes(df) // bytes_each)))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent it is set to a temporary folder if Spark runs on one machine (tests),
    and asked for on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """The rows, written to the shared folder, with their number from 0 on in the order of partitions and rows.

    What the numbering needs besides is one row per partition.
    """
    part = F.shiftright("_id", 33)
    held = materialise(df.withColumn("_id", F.monotonically_increasing_id()), name)
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = sizes.select("_part", before.alias("_start"))
    return held.withColumn("_part", part).join(starts, "_part").withColumn(column, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_n", "_id")


@contextmanager
def arrow_batches(spark: SparkSession, size: str = "8m"):
    """Inside, what is run hands rows to Python in batches of no more bytes than this."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets of its rows (null: empty)."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n, buffers = len(arr), arr.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_at(data: np.ndarray) -> np.ndarray:
    """For every byte position the 8 bytes from there on as one little-endian integer (zeros past the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def slices(column, rows: int, size: int):
    """A column of strings in slices of some rows and bytes at most; a longer string is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        held = int(ends[a - 1]) if a else 0
        b = max(a + 1, min(a + rows, int(np.searchsorted(ends, held + size, "right"))))
        yield column.slice(a, b - a)
        a = b


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; numpy's own unique hashes integers, which takes several times as long."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def pack(values, dtype) -> bytes:
    return np.ascontiguousarray(values, dtype).tobytes()


def unpack(blobs, dtype) -> np.ndarray:
    """The concatenation of the arrays packed in a column of blobs (null: empty)."""
    parts = [np.frombuffer(x, dtype) for x in blobs if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def pass_through(df: DataFrame, taken: list[str], keep: list[str]) -> tuple[list, list[str]]:
    """Aliases under which the kept columns travel, whatever they are called."""
    inner = [f"_keep{i}" for i in range(len(keep))]
    return [F.col(f"`{c}`").alias(a) for c, a in zip(keep, inner)], inner


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; FRESHET_TOKENIZERS names another folder."""
    folder = os.environ.get("FRESHET_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
