"""Shared folder, sizes and Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcut.plans.store import dropped, stored


#: Rows of a key in one share, where the key's rows were counted.
SHARE = 1000


def shares(count: int, share: int = 5000) -> int:
    """Into how many shares a key's rows are dealt out, so that even a key of all ``count`` rows gives about ``share`` a task."""
    return max(8, -(-count // share))


def spread(rows: DataFrame, key: list[str], other: DataFrame, by: str, count: int | None = None, with_rows=None, n: str | None = None) -> DataFrame:
    """rows joined with other by key, of which a few values may hold a large part of all rows: a key's rows are dealt out by
    ``by`` to shares, other goes to each share that a key has, and rows meet it there. count: of rows, about, where
    they aren't a stored table. with_rows: applied to rows after their keys were taken. n: a column of rows that tells how
    many a key has, at most; then a key has a share for each SHARE of these, and most keys have one."""
    many = F.ceil(F.col(n) / SHARE) if n else F.lit(shares(rows.count() if count is None else count))
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(by, F.lit(7)), many))
    there = dealt.select(*key, "_share").distinct().join(other, key)
    return (dealt if with_rows is None else with_rows(dealt)).join(there, [*key, "_share"]).drop("_share")


def small_batches(df: DataFrame, size: str = "2m") -> DataFrame:
    """df; from now on its session sends about so much at once to a Python worker, so that rows with long texts don't add
    up, neither there nor in the buffers of the executor (the default is 64 MB, several times in each worker)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column."""
    return int(docs.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column laid end to end, and the offsets of its rows; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_binary()).fill_null(b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def longs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integers; null as the least one."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
