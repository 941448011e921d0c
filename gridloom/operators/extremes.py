"""The first place of the least or most value, and the first absent place, in one pass over the cells.

A task reduces its cells to states, one for each margin cell (and, where absent
cells count, for each CHUNK places of its call): the extreme, its first place,
how many cells were seen and were missing, and the runs of places seen. States
merge in any order, so only they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Cells that a task reduces at once.
MOST = 1 << 19

STATE = "key long, chunk long, best double, place long, bad long, c long"


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new group begins."""
    change = np.zeros(len(sorted_keys[0]), bool)
    change[:1] = True
    for k in sorted_keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.astype(np.int32)))


def state_of(key: np.ndarray, pos: np.ndarray, v: np.ndarray, low: bool, span: int | None) -> pa.RecordBatch:
    """States of some cells: pos is the 1-based place, NaN a missing value; with ``span`` for each so many places, and with runs."""
    order = np.lexsort((pos, key))
    key, pos, v = key[order], pos[order], v[order]
    chunk = (pos - 1) // span if span else np.zeros(len(pos), np.int64)
    first = _firsts(key, chunk)
    counts = np.diff(np.append(first, len(key)))
    gone = np.isnan(v)
    worst = np.inf if low else -np.inf
    best = (np.minimum if low else np.maximum).reduceat(np.where(gone, worst, v), first)
    group = np.repeat(np.arange(len(first)), counts)
    hit = ~gone & (v == best[group])
    place = np.minimum.reduceat(np.where(hit, pos, np.iinfo(np.int64).max), first)
    bad = np.add.reduceat(gone.astype(np.int64), first)
    none = bad == counts
    columns = [pa.array(key[first]), pa.array(chunk[first]), pa.array(best, mask=none), pa.array(place, mask=none), pa.array(bad), pa.array(counts.astype(np.int64))]
    names = ["key", "chunk", "best", "place", "bad", "c"]
    if span:
        at = (pos - 1) % span
        begins = np.ones(len(pos), bool)
        begins[1:] = (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(pos)) - 1
        columns.append(_lists(np.stack([at[starts], at[stops]], axis=1).ravel(), 2 * np.bincount(group[starts], minlength=len(first))))
        names.append("runs")
    return pa.RecordBatch.from_arrays(columns, names)


def _states(cells: DataFrame, low: bool, span: int | None) -> DataFrame:
    most = MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for batch in batches:
            for column, kept in zip(("key", "pos", "v"), held, strict=True):
                kept.append(batch.column(column).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= most:
                yield state_of(*(np.concatenate(k) for k in held), low, span)
                held, size = [[], [], []], 0
        if size:
            yield state_of(*(np.concatenate(k) for k in held), low, span)

    return cells.select("key", "pos", "v").mapInArrow(run, STATE + (", runs array<int>" if span else ""))


def first_gaps(group: np.ndarray, start: np.ndarray, stop: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """First place from 0 that no run of a group covers, for groups 0, 1, ... of so many places; -1 if all are covered."""
    order = np.lexsort((start, group))
    group, start, stop = group[order], start[order], stop[order]
    first = _firsts(group)
    expected = np.append(0, stop[:-1] + 1)
    expected[first] = 0
    open_at = np.where(start > expected, expected, np.iinfo(np.int64).max)
    gap = np.minimum.reduceat(open_at, first)
    end = stop[np.append(first[1:], len(stop)) - 1] + 1
    gap = np.minimum(gap, end)
    return np.where(gap < lengths, gap, -1)


def _with_gaps(states: DataFrame, n: int, low: bool) -> DataFrame:
    """States of each (key, chunk) merged into one, with the first absent place (1-based) of the chunk."""
    span = CHUNK

    def merge(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks().to_batches()[0]
        key, chunk, place, bad, c = (t.column(k).fill_null(0).to_numpy() for k in ("key", "chunk", "place", "bad", "c"))
        best = t.column("best").to_numpy(zero_copy_only=False)
        first = _firsts(key, chunk)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        none = np.isnan(best)
        top = (np.minimum if low else np.maximum).reduceat(np.where(none, np.inf if low else -np.inf, best), first)
        hit = ~none & (best == top[group])
        where = np.minimum.reduceat(np.where(hit, place, np.iinfo(np.int64).max), first)
        empty = ~np.logical_or.reduceat(~none, first)
        runs = t.column("runs")
        pairs = runs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).astype(np.int64)
        of_run = np.repeat(group, np.asarray(runs.value_lengths()) // 2)
        base = chunk[first] * span
        gap = first_gaps(of_run, pairs[:, 0], pairs[:, 1], np.minimum(span, n - base))
        columns = [pa.array(key[first]), pa.array(chunk[first]), pa.array(top, mask=empty), pa.array(where, mask=empty), pa.array(np.add.reduceat(bad, first)), pa.array(np.add.reduceat(c, first)), pa.array(base + gap + 1, mask=gap < 0)]
        return pa.RecordBatch.from_arrays(columns, ["key", "chunk", "best", "place", "bad", "c", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last (key, chunk) of a batch may go on in the next one.
            key, chunk = batch.column("key").to_numpy(), batch.column("chunk").to_numpy()
            last = int(np.flatnonzero((key != key[-1]) | (chunk != chunk[-1]))[-1]) + 1 if ((key != key[-1]) | (chunk != chunk[-1])).any() else 0
            if last or held and (held[-1].column("key")[0].as_py(), held[-1].column("chunk")[0].as_py()) != (int(key[0]), int(chunk[0])):
                cut = [*held, batch.slice(0, last)] if last else held
                yield merge([b for b in cut if b.num_rows])
                held = []
            held.append(batch.slice(last))
        if held:
            yield merge(held)

    return states.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(run, STATE + ", gap long")


def first_extremes(cells: DataFrame, low: bool, n: int, sparse: bool) -> DataFrame:
    """key, bad, c, a of (key, pos, v): a is the first place (from 1) of the least or most value among n places; absent ones hold zeros if ``sparse``."""
    states = _states(cells, low, CHUNK if sparse else None)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((F.col("best") if low else -F.col("best")).alias("v"), F.col("place")))).alias("b")
    sums = [F.sum("bad").alias("bad"), F.sum("c").alias("c")]
    if not sparse:
        return states.groupBy("key").agg(best, *sums).select("key", "bad", "c", F.col("b.place").alias("a"))
    merged = _with_gaps(states, n, low)
    # Of the chunks in order the first that is not there: its number and its place differ from there on.
    at = F.row_number().over(Window.partitionBy("key").orderBy("chunk")).cast("long") - 1
    seen = merged.withColumn("at", at).groupBy("key").agg(best, *sums, F.min("gap").alias("gap"), F.coalesce(F.min(F.when(F.col("at") != F.col("chunk"), F.col("at"))), F.count(F.lit(1))).alias("chunk"))
    absent = F.least("gap", F.when(F.col("chunk") < -(-n // CHUNK), F.col("chunk") * CHUNK + 1))
    return seen.select("key", "bad", "c", _with_zeros(F.col("b.v") if low else -F.col("b.v"), F.col("b.place"), absent, n, low).alias("a"))


def _with_zeros(best: Column, hit: Column, absent: Column, n: int, low: bool) -> Column:
    wins = F.coalesce((best > 0) if low else (best < 0), F.lit(True))
    return F.when(F.col("c") == n, hit).when(wins, absent).when(best == 0, F.least(hit, absent)).otherwise(hit)
