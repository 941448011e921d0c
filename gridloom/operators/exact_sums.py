"""Sums, means and variances that are the same to the last bit for any order and number of partitions.

A double is an integer times a power of two. Its bits are added up in integers,
32 bits a limb, limbs being numbered by their power; so is its square where a
variance is wanted. Integer sums don't depend on the order, and a result is
rounded once, from the exact total. A task sends a row for each margin cell and
limb that it met, mostly two or three, at most some seventy.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import inf, nan, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMB = 32
#: Cells that a task adds up at once.
MOST = 1 << 19
#: Kinds of rows: limbs of the sum and of the squares, and counts (limb 0: cells, 1: missing, 2: +infinity, 3: -infinity).
SUM, SQUARES, COUNTS = 0, 1, 2


def limbs(whole: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limb numbers and values (three a number) of whole * 2**power, |whole| < 2**55."""
    limb, shift = np.floor_divide(power, LIMB), np.mod(power, LIMB).astype(np.uint64)
    sign, size = np.sign(whole), np.abs(whole).astype(np.uint64)
    low32 = np.uint64((1 << LIMB) - 1)
    low, high = (size & low32) << shift, (size >> np.uint64(LIMB)) << shift
    values = [low & low32, (low >> np.uint64(LIMB)) + (high & low32), high >> np.uint64(LIMB)]
    return np.concatenate([limb, limb + 1, limb + 2]), np.concatenate([sign * v.astype(np.int64) for v in values])


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fraction, power = np.frexp(x)
    return np.ldexp(fraction, 53).astype(np.int64), power.astype(np.int64) - 53


def totals(key: np.ndarray, v: np.ndarray, squares: bool) -> pa.RecordBatch:
    """(key, kind, limb, total) of some cells; NaN is a missing value."""
    known = np.isfinite(v)
    keys, kinds, at, values = [], [], [], []

    def add(key: np.ndarray, kind: int, limb: np.ndarray, value: np.ndarray) -> None:
        used = value != 0
        keys.append(np.tile(key, len(limb) // max(1, len(key)))[used])
        kinds.append(np.full(int(used.sum()), kind))
        at.append(limb[used])
        values.append(value[used])

    whole, power = _parts(v[known])
    add(key[known], SUM, *limbs(whole, power))
    if squares:
        high, low = whole >> 27, whole & ((1 << 27) - 1)
        for product, more in ((high * high, 54), (high * low, 28), (low * low, 0)):
            add(key[known], SQUARES, *limbs(product, 2 * power + more))
    ones = np.ones(len(v), np.int64)
    for limb, hit in enumerate((ones, np.isnan(v), v == inf, v == -inf)):
        add(key, COUNTS, np.full(len(v), limb), ones * hit)
    key, kind, limb, value = (np.concatenate(c) for c in (keys, kinds, at, values))
    order = np.lexsort((limb, kind, key))
    key, kind, limb, value = key[order], kind[order], limb[order], value[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (limb[1:] != limb[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(value, first) if len(first) else value
    return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(kind[first].astype(np.int32)), pa.array(limb[first].astype(np.int32)), pa.array(total)], ["key", "kind", "limb", "total"])


def _value(rows: list[dict], what: str, n: int, sparse: bool, na_rm: bool) -> float | None:
    count = {r["limb"]: int(r["total"]) for r in rows if r["kind"] == COUNTS}
    if count.get(1) and not na_rm:
        return None
    k = n - count.get(1, 0) if sparse else count.get(0, 0) - count.get(1, 0)  # absent cells are zeros
    exact = lambda kind: sum((Fraction(int(r["total"])) * Fraction(2) ** (LIMB * r["limb"]) for r in rows if r["kind"] == kind), Fraction(0))
    up, down = count.get(2, 0), count.get(3, 0)
    if what in ("sum", "mean"):
        total = nan if up and down else inf if up else -inf if down else exact(SUM)
        if what == "mean" and not k:
            return nan
        return _rounded(total if what == "sum" else total / k)
    if k < 2:
        return None
    if up or down:
        return nan
    total = exact(SUM)
    var = _rounded((exact(SQUARES) - total * total / k) / (k - 1))
    return var if what == "var" else sqrt(var)


def _rounded(x: Fraction | float) -> float:
    try:
        return float(x)
    except OverflowError:
        return inf if x > 0 else -inf


def exact_reduce(cells: DataFrame, what: str, n: int, sparse: bool, na_rm: bool) -> DataFrame:
    """key, v of (key, v double): sum, mean, var or sd over each key's cells, n with the absent ones of a sparse image."""
    squares = what in ("var", "sd")
    most = MOST

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, v = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("key", "v"))
        return totals(key, v, squares)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_value(rows, what, n, sparse, na_rm) for rows in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values, pa.float64())], ["key", "v"])

    sums = cells.select("key", "v").mapInArrow(add, "key long, kind int, limb int, total long").groupBy("key", "kind", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return sums.groupBy("key").agg(F.collect_list(F.struct("kind", "limb", F.col("total").cast("string").alias("total"))).alias("rows")).mapInArrow(finish, "key long, v double")
