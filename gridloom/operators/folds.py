"""Functions of sub-arrays that no worker could hold: folded piece by piece, and the pieces merged.

A fold starts a state, adds values with their places to it, merges two states and
makes the result. A task keeps one state for each margin cell that it meets (at
most MOST_STATES before they are sent on); states of one margin cell are then
merged one after the other, so that memory holds two of them at a time.
"""

from __future__ import annotations

import collections
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..image import Image
from ..plans import layout as L
from .apply import ARROW, _named
from .reduce import _grid, check_margin, keyed

MOST_STATES = 4096


@dataclass(frozen=True)
class Fold:
    """``add`` takes a state, values (NaN: missing) and their 0-based places in the sub-array; merging must not depend on the order."""

    start: Callable[[], object]
    add: Callable[[object, np.ndarray, np.ndarray], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object]


def _counted(state: collections.Counter, values: np.ndarray, places: np.ndarray) -> collections.Counter:
    kinds, counts = np.unique(values, return_counts=True)
    state.update(dict(zip(kinds.tolist(), counts.tolist(), strict=True)))
    return state


def _quantiles(state: collections.Counter, at: list[float]) -> list[float]:
    values = np.array(sorted(state))
    through = np.cumsum([state[v] for v in values.tolist()])
    out = []
    for q in at:
        place = q * (through[-1] - 1)
        low, high = (values[np.searchsorted(through, np.floor(place) + k, side="right").clip(max=len(values) - 1)] for k in (0, 1))
        out.append(float(low + (high - low) * (place - np.floor(place))))
    return out


def quantiles(*at: float) -> Fold:
    """Exact quantiles from counts of the different values."""
    return Fold(collections.Counter, _counted, lambda a, b: a + b, lambda s: _quantiles(s, list(at)) if s and not any(v != v for v in s) else [float("nan")] * len(at))


def fold_apply(image: Image, margin, fold: Fold, returns: str = "double") -> DataFrame:
    """m1, m2, ..., r, v: element r of a fold's result for each margin cell; absent cells of sparse images are added as zeros.

    Those zeros come in one piece, with no places (an empty array), as many as are absent.
    """
    kept = check_margin(image, margin)
    names = [f"m{i + 1}" for i in range(len(kept))]
    dims = [image.dims[k] for k in kept]
    cells, call_dims = keyed(image, kept)
    n, sparse, kind = prod(call_dims), image.is_sparse, ARROW[returns]
    rows = cells.select(L.flatten([F.col(m) for m in names], dims).alias("key"), "pos", F.col("v").cast("double").alias("v"))
    if sparse:  # a row without a place for every margin cell, so that those without cells have a state too
        rows = rows.unionByName(_grid(image, kept, names).select(L.flatten([F.col(m) for m in names], dims).alias("key"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("double").alias("v")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple[int, object]] = {}

        def out() -> pa.RecordBatch:
            made = [(k, c, pickle.dumps(s)) for k, (c, s) in states.items()]
            states.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["key", "c", "state"])

        for batch in batches:
            held = batch.column("pos").is_valid().to_numpy(zero_copy_only=False)
            key, pos, v = batch.column("key").to_numpy(), batch.column("pos").fill_null(0).to_numpy(), batch.column("v").to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else []
            for group in np.split(order, first[1:]) if len(key) else []:
                k, mine = int(key[group[0]]), group[held[group]]
                count, state = states.get(k) or (0, fold.start())
                if len(mine):
                    state = fold.add(state, v[mine], pos[mine] - 1)
                states[k] = (count + len(mine), state)
                if len(states) >= MOST_STATES:
                    yield out()
        if states:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, state = None, 0, None

        def out() -> pa.RecordBatch:
            whole = fold.add(state, np.zeros(n - count), np.zeros(0, np.int64)) if sparse and count < n else state
            got, _ = _named(fold.finish(whole))
            return pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array(got, kind)], ["key", "r", "v"])

        for batch in batches:
            for k, c, s in zip(*(batch.column(x).to_pylist() for x in ("key", "c", "state")), strict=True):
                if k != key:
                    if key is not None:
                        yield out()
                    key, count, state = k, c, pickle.loads(s)
                else:
                    count, state = count + c, fold.merge(state, pickle.loads(s))
        if key is not None:
            yield out()

    states = rows.mapInArrow(add, "key long, c long, state binary")
    done = states.repartition("key").sortWithinPartitions("key").mapInArrow(merge, f"key long, r int, v {returns}")
    return done.select(*(L.axis_of(F.col("key"), dims, i).cast("int").alias(m) for i, m in enumerate(names)), "r", "v")
