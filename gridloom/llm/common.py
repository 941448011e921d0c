"""Shared helpers: tables, durable intermediate results, vectorised text work.

Arrow batches are handled as one byte buffer with offsets, so the costly parts
of the operators are numpy passes over whole batches, not loops over rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow rows handed to a Python worker at once are cut so that a slice holds
#: about so many bytes of text; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the path may be one that only Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that setting is missing (tests, one machine) a temporary folder
    of this machine is taken and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here.

    A lost executor costs nothing that was settled before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared one that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key with more than this share of the rows is hot; so there are at most as many hot keys as it is small.
HOT_SHARE = 1 / 1000


def join_unique(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with the columns of ``known``, which has one row a key and its number of rows as ``copies``.

    Rows of hot keys find theirs in a broadcast table of 1000 rows at most, so
    that no task gets all rows of a key; the others are joined by key.
    """
    total = known.agg(F.sum("copies")).first()[0] or 0
    hot = known.where(F.col("copies") > total * HOT_SHARE)
    held = F.struct(*(c for c in known.columns if c != key)).alias("_hot")
    marked = rows.join(F.broadcast(hot.select(key, held)), key, "left")
    found = marked.where("_hot is not null").select(*rows.columns, "_hot.*")
    rest = marked.where("_hot is null").select(*rows.columns).join(known, key)
    return found.unionByName(rest.select(*found.columns)).drop("copies")


def give_back() -> None:
    """Return freed memory of Arrow's pool and of the C heap to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of ``column``."""
    give_back()
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(offsets) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i up to n at least."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking 64-bit value for each byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end], equal for equal bytes."""
    up, down = powers(BASE, len(data)), powers(BASE_INVERSE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of texts, and each word's row."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space[data]
    cuts = np.flatnonzero(np.diff(inside))
    starts, ends = cuts[0::2], cuts[1::2]
    if len(offsets) > 2:  # a word does not run on from one text into the next
        inner = np.unique(offsets[1:-1])
        inner = inner[(inner > 0) & (inner < len(data))]
        inner = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]
        if len(inner):
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of the code points that begin before each byte."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(rows, weights=weights, minlength=n)
    return out if weights is None else np.rint(out).astype(np.int64)


def windows(rows: np.ndarray, size: int) -> np.ndarray:
    """Index of each window of ``size`` consecutive words of one row."""
    if len(rows) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :])


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A hash of the word hashes of each window."""
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(BASE) + words[first + k])
    return out


def arrow_schema(ddl_like: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl_like])
