"""Shared helpers: stored tables, hashing on arrays, chunks of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import _ensure_checkpoint_dir

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that a lost executor re-reads it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Shuffle files of a finished step go when the driver collects its garbage.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def text_keys(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``k1`` (doc_id, null as the least long), ``k2`` (hash of the text), ``text`` (null as empty).

    Rows that agree in both keys hold equal texts, so results per key fit each of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"),
        F.xxhash64(text).alias("k2"),
        text.alias("text"),
        *carry,
    )


def doc_id_of(k1: Column) -> Column:
    return F.when(k1 != -(1 << 63), k1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown when needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", BASE), ("down", INVERSE)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=np.uint64))
        return cls.up, cls.down


class Ranges:
    """Hashes of any range of ``values`` (uint64) from prefix sums, wrapping modulo 2^64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = Powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[data]


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column without nulls."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``most`` bytes (one row at least) with their bytes and offsets."""
    data, offsets = texts_of(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of non-space bytes, and per row the index of its first word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = True
    last[edge - 1] = True
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Ranges(byte_values(data))(start, end)


def least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value and its leftmost position in each window of ``width`` values."""
    val, pos, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        d = min(have, width - have)
        n = len(val) - d
        if n <= 0:
            return val[:0], pos[:0]
        right = val[d:] < val[:n]
        pos = np.where(right, pos[d:], pos[:n])
        val = np.where(right, val[d:], val[:n])
        have += d
    return val, pos
