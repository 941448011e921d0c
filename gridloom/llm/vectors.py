"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

The nearest entry is found by VA-file filtering. The coordinates of the entries
are quantised to a few bits: along each axis they fall into cells, each with its
least and most coordinate. For a query a table gives, for each axis and cell,
the least and the most squared distance to a coordinate in the cell; their sums
over the axes bound the distance to every entry from below and from above. Only
entries whose lower bound is no more than the least upper bound can be nearest;
for those the distance is computed in integers, and ties go to the lower index.

Codebooks are fitted on all vectors: each round is one pass whose tasks keep
sums and counts of each entry's parts, so a task sends a table of the size of
the codebooks, however many vectors it saw. Codebooks (at most ``entries``
vectors) are all that the driver ever holds.

Edge cases. Vectors that are null or hold a null, NaN or infinite component are
dropped. The vectors' length is that of the first one in order of (id, vector),
null ids last; vectors of another length, or with a component of LARGEST or more
(whose squares a long might not hold), have no part in the codebooks and come
back with null code and error. Where fewer vectors than entries are kept there
are as many entries. Repeated rows are rows of their own. A length that the parts
do not divide is an error; so is an empty vector as the first one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import give_back, join_unique, settle

SCALE, PARTS, ENTRIES, ROUNDS, BITS = 1024, 4, 256, 4, 4
LARGEST = 1 << 17
#: Components that are looked at together.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position; parts of the vectors x SCALE are compared with them."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors that codes (rows x parts) stand for: the middle of the integers' intervals."""
        return np.concatenate([(self.entries[p][codes[:, p]] + 0.5) / SCALE for p in range(self.entries.shape[0])], axis=1)


class Cells:
    """The entries of one part, quantised along each axis, and the search for the nearest."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, (k, width) = entries.astype(np.int64), entries.shape
        n = min(1 << bits, k)
        order = np.argsort(self.entries, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(k)[:, None], axis=0)
        self.cell = (rank * n // max(k, 1)).T.copy()  # axis x entry; cells hold about as many entries each
        self.low, self.high = np.zeros((width, n), np.int64), np.zeros((width, n), np.int64)
        for a in range(width):
            for c in range(n):
                held = self.entries[self.cell[a] == c, a]
                self.low[a, c], self.high[a, c] = held.min(), held.max()

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each query; ties to the lower index."""
        index, distance = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for at in range(0, len(queries), 256):
            index[at : at + 256], distance[at : at + 256] = self._block(queries[at : at + 256])
        return index, distance

    def _block(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = q.shape[1]
        if not width or not len(q):
            return np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        reach = max(int(np.abs(q).max()), int(np.abs(self.entries).max())) * 2
        kind = np.int32 if reach * reach * width < 1 << 31 else np.int64
        x = q.T[:, None, :]  # axis x 1 x query
        under, over = self.low[:, :, None] - x, x - self.high[:, :, None]
        least = (np.maximum(np.maximum(under, over), 0) ** 2).astype(kind)
        most = (np.maximum(np.abs(under), np.abs(over)) ** 2).astype(kind)
        lower, upper = least[0][self.cell[0]], most[0][self.cell[0]]  # entry x query
        for a in range(1, width):
            lower += least[a][self.cell[a]]
            upper += most[a][self.cell[a]]
        who, entry = np.nonzero((lower <= upper.min(axis=0)).T)  # by query, then entry
        exact = ((q[who] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.diff(who, prepend=-1))
        best = np.minimum.reduceat(exact, first)
        hits = np.flatnonzero(exact == best[who])
        chosen = hits[np.diff(who[hits], prepend=-1) != 0]
        return entry[chosen], best


def _vectors(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Kept rows of a batch, some of one length at a time: that length, the rows, their components."""
    give_back()
    held = batch.column(column)
    batch = batch.filter(held.is_valid())
    held = batch.column(column)
    lengths = np.asarray(held.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, BLOCK // max(1, int(length)))
        for at in range(0, len(rows), step):
            part = batch.take(pa.array(rows[at : at + step]))
            flat = part.column(column).flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(part.num_rows, int(length))
            if flat.null_count:
                values = np.where(flat.is_null().to_numpy(zero_copy_only=False).reshape(values.shape), np.nan, values)
            good = np.isfinite(values).all(axis=1)
            yield int(length), part.filter(pa.array(good)), values[good]


def _integers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) and which rows are small enough."""
    fits = (np.abs(values) < LARGEST).all(axis=1) if values.shape[1] else np.ones(len(values), bool)
    return np.floor(np.where(fits[:, None], values, 0) * SCALE).astype(np.int64), fits


def _starts(vectors: DataFrame, entries: int, length: int | None) -> list:
    """The first vectors in order of (id, vector): (id, integers), as many as a codebook has entries."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            for size, rows, values in _vectors(batch, "vector"):
                whole, fits = _integers(values)
                if length is not None and size != length:
                    continue
                ids = rows.column("id").to_pylist()
                best += [(i is None, i or 0, tuple(v.tolist())) for i, v, ok in zip(ids, whole, fits, strict=True) if ok and (len(best) < entries or (i is None, i or 0) <= best[entries - 1][:2])]
                best = sorted(best)[:entries]
        yield pa.RecordBatch.from_arrays([pa.array([None if n else i for n, i, _ in best], pa.int64()), pa.array([list(v) for _, _, v in best], pa.list_(pa.int64()))], ["id", "whole"])

    found = vectors.mapInArrow(firsts, "id long, whole array<long>").orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).collect()
    if found and length is None and any(len(r["whole"]) != len(found[0]["whole"]) for r in found):
        return _starts(vectors, entries, len(found[0]["whole"]))
    return [r["whole"] for r in found]


def _assign(books: Codebooks, whole: np.ndarray, searches: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances (rows x parts)."""
    width = books.entries.shape[2]
    found = [s.nearest(whole[:, p * width : (p + 1) * width]) for p, s in enumerate(searches)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _improve(vectors: DataFrame, books: Codebooks, bits: int) -> Codebooks:
    """One round: every part goes to its nearest entry, entries become the floor of their parts' mean."""
    parts, k, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Cells(e, bits) for e in books.entries]
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        seen = 0

        def table() -> pa.RecordBatch:
            cells = np.concatenate([total, count[:, :, None]], axis=2).ravel()
            at = np.flatnonzero(np.repeat(count.ravel() > 0, width + 1))
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(cells[at])], ["slot", "total"])

        for batch in batches:
            for length, _, values in _vectors(batch, "vector"):
                if length != books.length:
                    continue
                whole, fits = _integers(values)
                whole = whole[fits]
                codes, _ = _assign(books, whole, searches)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    if not len(order):
                        continue
                    first = np.flatnonzero(np.diff(codes[order, p], prepend=-1))
                    at = codes[order[first], p]
                    total[p, at] += np.add.reduceat(whole[order, p * width : (p + 1) * width], first, axis=0)
                    count[p, at] += np.diff(np.append(first, len(order)))
                seen += len(whole)
                if seen > 1 << 34:  # sums of so many components stay far from a long's end
                    yield table()
                    total[:], count[:], seen = 0, 0, 0
        yield table()

    # Bounded: entries x (length + parts) rows.
    got = vectors.select("vector").mapInArrow(sums, "slot long, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    cells = {r["slot"]: int(r["total"]) for r in got}
    entries = books.entries.copy()
    for p in range(parts):
        for e in range(k):
            at = (p * k + e) * (width + 1)
            if n := cells.get(at + width, 0):
                entries[p, e] = [cells[at + i] // n for i in range(width)]
    return Codebooks(entries)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> Codebooks:
    """Codebooks for (id, vector): they start as the first vectors' parts and take so many rounds over all vectors."""
    first = _starts(vectors, entries, None)
    length = len(first[0]) if first else 0
    if first and (not length or length % parts):
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    books = Codebooks(np.array(first, np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy())
    for _ in range(rounds if first else 0):
        books = _improve(vectors, books, bits)
    return books


def encode(vectors: DataFrame, books: Codebooks, bits: int = BITS) -> DataFrame:
    """id, label, code (array of entry numbers), error (squared distance) of every kept (id, vector, label)."""
    of_label = vectors.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Cells(e, bits) for e in books.entries] if books.length else []
        for batch in batches:
            for length, rows, values in _vectors(batch, "vector"):
                whole, fits = _integers(values)
                codes = np.zeros((len(whole), books.entries.shape[0]), np.int32)
                error = np.zeros(len(whole), np.int64)
                fits &= length == books.length and bool(searches)
                if fits.any():
                    found, far = _assign(books, whole[fits], searches)
                    codes[fits], error[fits] = found, far.sum(axis=1)
                code = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), codes.shape[1]).cast(pa.list_(pa.int32())) if codes.shape[1] else pa.array([[]] * len(whole), pa.list_(pa.int32()))
                code = pa.array([c if ok else None for c, ok in zip(code.to_pylist(), fits.tolist(), strict=True)], pa.list_(pa.int32())) if not fits.all() else code
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), code, pa.array(error, mask=~fits)], ["id", "label", "code", "error"])

    return vectors.select("id", "vector", "label").mapInArrow(run, f"id long, label {of_label.simpleString()}, code array<int>, error long")


def compress(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **sizes) -> tuple[DataFrame, Codebooks]:
    """Fit and encode: (id, label, code, error, label_error) and the codebooks.

    label_error is the sum of error over equal labels, nulls being equal; its sums
    are exact, and labels with very many rows are joined by a broadcast of at most
    1000 rows, the others by key.
    """
    own = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books = fit(own, **sizes)
    coded = settle(encode(own, books, sizes.get("bits", BITS)).withColumn("key", F.struct(F.col("label").alias("value"))))
    known = coded.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("copies"))
    text = F.coalesce(F.concat(F.lit("="), F.col("key.value").cast("string")), F.lit(""))  # null has a key of its own
    joined = join_unique(coded.withColumn("name", text).drop("key"), known.withColumn("name", text).drop("key"), "name")
    return joined.drop("name"), books


def decode(coded: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """coded with a column vector: what each code stands for; null for a null code."""
    schema = StructType([*coded.schema.fields, StructField("vector", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(code).to_pylist()
            at = [k for k, r in enumerate(rows) if r is not None]
            back = books.decode(np.array([rows[k] for k in at], np.int64)) if at else np.zeros((0, books.length))
            out: list = [None] * len(rows)
            for k, v in zip(at, back.tolist(), strict=True):
                out[k] = v
            yield batch.append_column("vector", pa.array(out, pa.list_(pa.float64())))

    return coded.mapInArrow(run, schema)
