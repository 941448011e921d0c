"""Blocked storage: a row is a tile of an image, its values one array, first axis fastest.

Axes are cut into pieces of one size (the first piece may be shorter, so that a
flipped axis is cut the same way); a tile is a piece of every axis. Kernels are
numpy on all tiles of one shape in an Arrow batch. Turning or flipping an image
renumbers the tiles and permutes values inside them, so nothing is shuffled;
reductions send a state for each tile and margin cell; elementwise expressions
map arrays, and images with the same cuts meet by tile, not by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans import layout as L

#: Cells of a tile, about.
TILE_CELLS = 1 << 15


@dataclass(frozen=True)
class Axis:
    """How an axis is cut: ``lead`` places in the first piece, ``size`` in the others, the last one taking what is left."""

    dim: int
    size: int
    lead: int

    @property
    def count(self) -> int:
        return 1 + max(0, -(-(self.dim - self.lead) // self.size))

    def start(self, j):
        return np.where(j == 0, 0, self.lead + (j - 1) * self.size)

    def length(self, j):
        return np.minimum(np.where(j == 0, self.lead, self.size), self.dim - self.start(j))

    def flipped(self) -> Axis:
        return Axis(self.dim, self.size, int(self.length(self.count - 1)))

    def start_of(self, j: Column) -> Column:
        return F.when(j == 0, 0).otherwise(self.lead + (j - 1) * self.size)

    def length_of(self, j: Column) -> Column:
        return F.least(F.when(j == 0, self.lead).otherwise(self.size), self.dim - self.start_of(j))

    def piece_of(self, x: Column) -> Column:
        return F.when(x < self.lead, 0).otherwise(F.call_function("div", x - self.lead, F.lit(self.size)) + 1)


def cut(dims: tuple[int, ...], cells: int = TILE_CELLS) -> tuple[Axis, ...]:
    """Pieces of about equal sides with so many cells in a tile; axes that are shorter leave more to the others."""
    sizes, left, budget = [0] * len(dims), sorted(range(len(dims)), key=lambda k: dims[k]), max(1, cells)
    while left:
        k = left.pop(0)
        sizes[k] = max(1, min(dims[k], int(budget ** (1 / (len(left) + 1)) + 1e-9)))
        budget = max(1, budget // sizes[k])
    return tuple(Axis(d, s, min(s, max(1, d))) for d, s in zip(dims, sizes, strict=True))


@dataclass(frozen=True, eq=False)
class Tiles:
    """frame: (tile, v), tiles numbered first axis fastest; the leading ``spatial`` axes are locations."""

    frame: DataFrame
    axes: tuple[Axis, ...]
    spatial: int

    @property
    def counts(self) -> list[int]:
        return [a.count for a in self.axes]

    @cached_property
    def cells(self) -> DataFrame:
        """(loc, elem, v), in the JVM."""
        piece = [L.axis_of(F.col("tile"), self.counts, k) for k in range(len(self.axes))]
        rows = self.frame.select("tile", F.posexplode("v").alias("at", "v"))
        at, places = F.col("at").cast("long"), []
        for axis, j in zip(self.axes, piece, strict=True):
            n = axis.length_of(j)
            places.append(axis.start_of(j) + F.pmod(at, n))
            at = F.call_function("div", at, n)
        dims = [a.dim for a in self.axes]
        return rows.select(L.flatten(places[: self.spatial], dims[: self.spatial]).alias("loc"), L.flatten(places[self.spatial :], dims[self.spatial :]).cast("int").alias("elem"), "v")

    def mapped(self, kernel: Callable, value_type: str) -> Tiles:
        """Tiles with kernel(Arrow values of a batch) in place of the values."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("v")
                yield pa.RecordBatch.from_arrays([batch.column("tile"), _lists(kernel(lists.flatten()), lists)], ["tile", "v"])

        return Tiles(self.frame.mapInArrow(run, f"tile long, v array<{value_type}>"), self.axes, self.spatial)

    def turned(self, turn: tuple[int, ...], spatial: int) -> Tiles:
        """The view whose axis k is axis abs(turn[k]), backwards where it is negative."""
        own, counts, axes = self.axes, self.counts, tuple(self.axes[abs(t) - 1] if t > 0 else self.axes[-t - 1].flipped() for t in turn)
        new_counts = [a.count for a in axes]
        steps = L.strides(new_counts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            orders: dict[tuple, np.ndarray] = {}
            for batch in batches:
                tile, lists = batch.column("tile").to_numpy(), batch.column("v")
                pieces = _pieces(tile, counts)
                number = sum((pieces[abs(t) - 1] if t > 0 else counts[-t - 1] - 1 - pieces[-t - 1]) * s for t, s in zip(turn, steps, strict=True))
                shapes = np.stack([a.length(j) for a, j in zip(own, pieces, strict=True)], axis=1)
                size = shapes.prod(axis=1)
                begin = np.cumsum(size) - size
                index = np.empty(int(size.sum()), np.int64)
                for k in range(len(tile)):
                    shape = tuple(shapes[k].tolist())
                    if shape not in orders:
                        places = np.arange(prod(shape)).reshape(shape, order="F")
                        places = places[tuple(slice(None, None, -1) if -(a + 1) in turn else slice(None) for a in range(len(shape)))]
                        orders[shape] = places.transpose([abs(t) - 1 for t in turn]).ravel(order="F")
                    index[begin[k] : begin[k] + size[k]] = orders[shape] + begin[k]
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), _lists(lists.flatten().take(pa.array(index)), lists)], ["tile", "v"])

        return Tiles(self.frame.mapInArrow(run, self.frame.schema), axes, spatial)


def _lists(values: pa.Array, like: pa.ListArray) -> pa.Array:
    sizes = np.asarray(like.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def _pieces(tile: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    out = []
    for n in counts:
        out.append(tile % n)
        tile = tile // n
    return out


def gathered(cells: DataFrame, dims: tuple[int, ...], spatial: int, axes: tuple[Axis, ...]) -> Tiles:
    """Tiles of (loc, elem, v) with every cell of the grid; one shuffle by tile."""
    places = [L.axis_of(F.col("loc"), dims[:spatial], k) for k in range(spatial)] + [L.axis_of(F.col("elem").cast("long"), dims[spatial:], k) for k in range(len(dims) - spatial)]
    piece = [a.piece_of(x) for a, x in zip(axes, places, strict=True)]
    at, step = F.lit(0).cast("long"), F.lit(1).cast("long")
    for axis, x, j in zip(axes, places, piece, strict=True):
        at, step = at + (x - axis.start_of(j)) * step, step * axis.length_of(j)
    rows = cells.select(L.flatten(piece, [a.count for a in axes]).alias("tile"), at.cast("int").alias("at"), "v")
    frame = rows.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c")).select("tile", F.col("c.v").alias("v"))
    return Tiles(frame, axes, spatial)


def elementwise(leaves: list[Tiles], build: Callable[[list[Column]], Column]) -> Tiles:
    """build(values) over tiles of the same cuts; tiles of one frame are not joined."""
    distinct: list[DataFrame] = []
    at = []
    for t in leaves:
        found = next((k for k, f in enumerate(distinct) if f is t.frame or f.sameSemantics(t.frame)), None)
        if found is None:
            found = len(distinct)
            distinct.append(t.frame)
        at.append(found)
    rows = distinct[0].withColumnRenamed("v", "v0")
    for k, frame in enumerate(distinct[1:], 1):
        rows = rows.join(frame.withColumnRenamed("v", f"v{k}"), "tile")
    double = lambda v: v.cast("double")
    if len(distinct) == 1:
        v = F.transform("v0", lambda x: build([double(x)] * len(leaves)))
    elif len(distinct) == 2:
        v = F.zip_with("v0", "v1", lambda a, b: build([double((a, b)[k]) for k in at]))
    else:
        v = F.transform(F.arrays_zip(*(f"v{k}" for k in range(len(distinct)))), lambda s: build([double(s[f"v{k}"]) for k in at]))
    return Tiles(rows.select("tile", v.alias("v")), leaves[0].axes, leaves[0].spatial)


# -- reductions

#: Columns of a state: missing and all cells, and what a reduction keeps of them.
STATE = {
    "sum": ["total"], "mean": ["total"], "var": ["total", "squares"], "sd": ["total", "squares"], "min": ["least"], "max": ["most"], "range": ["least", "most"],
    "prod": ["product"], "any": ["some"], "all": ["every"], "countNA": [], "which.min": ["least", "place"], "which.max": ["most", "place"],
}


def _state(what: str, x: np.ndarray, pos: np.ndarray, gone: np.ndarray) -> list[np.ndarray]:
    """A reduction's state over the last axis of x (tile, margin cell, place); ``gone`` marks missing values."""
    known = (~gone).sum(axis=2)
    if what in ("sum", "mean", "var", "sd"):
        total = np.where(gone, 0.0, x).sum(axis=2)
        if what in ("sum", "mean"):
            return [total]
        mean = np.divide(total, known, out=np.zeros_like(total), where=known > 0)
        return [total, np.where(gone, 0.0, (x - mean[:, :, None]) ** 2).sum(axis=2)]
    least, most = np.where(gone, np.inf, x).min(axis=2), np.where(gone, -np.inf, x).max(axis=2)
    if what in ("min", "max", "range"):
        return {"min": [least], "max": [most], "range": [least, most]}[what]
    if what in ("which.min", "which.max"):
        best = least if what == "which.min" else most
        hit = ~gone & (x == best[:, :, None])
        return [best, np.where(hit, pos[:, None, :], np.iinfo(np.int64).max).min(axis=2)]
    if what == "prod":
        return [np.where(gone, 1.0, x).prod(axis=2)]
    if what == "any":
        return [(~gone & (x != 0)).any(axis=2)]
    return [(gone | (x != 0)).all(axis=2)] if what == "all" else []


def states(tiles: Tiles, kept: list[int], what: str) -> DataFrame:
    """key, tile, bad, c and the reduction's columns: one row for each tile and margin cell of it."""
    axes, counts = tiles.axes, tiles.counts
    call = [k for k in range(len(axes)) if k not in kept]
    names = STATE[what]
    types = {"place": pa.int64(), "some": pa.bool_(), "every": pa.bool_()}

    def flat(pieces: list[np.ndarray], over: list[int], shape: tuple[int, ...]) -> np.ndarray:
        """Numbers of the places of each tile along some axes, first one fastest: tile x place."""
        out = np.zeros((len(pieces[0]), 1), np.int64)
        for step, k in reversed(list(zip(L.strides([axes[k].dim for k in over]), over, strict=True))):
            here = (axes[k].start(pieces[k])[:, None] + np.arange(shape[k])[None, :]) * step
            out = (out[:, :, None] + here[:, None, :]).reshape(len(out), -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile, lists = batch.column("tile").to_numpy(), batch.column("v")
            pieces = _pieces(tile, counts)
            shapes = np.stack([a.length(j) for a, j in zip(axes, pieces, strict=True)], axis=1)
            kinds, of = np.unique(shapes, axis=0, return_inverse=True)
            of = of.ravel()
            for n, shape in enumerate(kinds.tolist()):
                at = np.flatnonzero(of == n)
                for group in np.array_split(at, max(1, len(at) * prod(shape) >> 22)):
                    here = lists.take(pa.array(group)).flatten().cast(pa.float64())
                    x = here.to_numpy(zero_copy_only=False).reshape(len(group), *reversed(shape))
                    # axes of x after the first run from last to first
                    order = [len(axes) - k for k in reversed(kept)] + [len(axes) - k for k in reversed(call)]
                    x = x.transpose(0, *order).reshape(len(group), prod(shape[k] for k in kept), -1)
                    mine = [p[group] for p in pieces]
                    key, pos = flat(mine, kept, tuple(shape)), flat(mine, call, tuple(shape)) + 1
                    gone = np.isnan(x)
                    columns = [pa.array(key.ravel()), pa.array(np.repeat(tile[group], key.shape[1])), pa.array(gone.sum(axis=2).ravel()), pa.array(np.full(key.size, x.shape[2], np.int64))]
                    columns += [pa.array(s.ravel(), types.get(name, pa.float64())) for name, s in zip(names, _state(what, x, pos, gone), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "tile", "bad", "c", *names])

    ddl = ", ".join(f"{n} {'long' if n == 'place' else 'boolean' if n in ('some', 'every') else 'double'}" for n in names)
    return tiles.frame.mapInArrow(run, "key long, tile long, bad long, c long" + (f", {ddl}" if ddl else ""))


def _merged_in_order(rows: DataFrame, squares: bool) -> DataFrame:
    """key, bad, c, a, b, k of states with sums, taken in the order of tiles: the same bits for any number of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # key, bad, c, k, total, squares
        for batch in batches:
            out = []
            columns = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("key", "bad", "c", "total", *(["squares"] if squares else []))]
            for key, bad, c, total, *more in zip(*columns, strict=True):
                k = c - bad
                if last is None or key != last[0]:
                    if last:
                        out.append(last)
                    last = [key, bad, c, k, total, *more]
                    continue
                if squares and k:
                    had = last[3]
                    apart = total / k - (last[4] / had if had else 0.0)
                    last[5] += more[0] + (apart * apart * had * k / (had + k) if had else 0.0)
                last[1], last[2], last[3], last[4] = last[1] + bad, last[2] + c, last[3] + k, last[4] + total
            if out:
                yield _sums(out, squares)
        if last:
            yield _sums([last], squares)

    ordered = rows.repartition("key").sortWithinPartitions("key", "tile")
    return ordered.mapInArrow(run, "key long, bad long, c long, k long, a double, b double")


def _sums(rows: list[list], squares: bool) -> pa.RecordBatch:
    """a and b as the reductions keep them: the sum, or the population variance and the mean; null without known values."""
    a = [None if not r[3] else r[5] / r[3] if squares else r[4] for r in rows]
    b = [r[4] / r[3] if r[3] else None for r in rows]
    columns = [*([r[i] for r in rows] for i in range(4)), a, b]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()] * 2, strict=True)], ["key", "bad", "c", "k", "a", "b"])


def reduced(tiles: Tiles, kept: list[int], what: str) -> DataFrame:
    """m1, m2, ..., bad, c and the columns a, b, k that a reduction is finished from."""
    rows = states(tiles, kept, what)
    if what in ("sum", "mean", "var", "sd"):
        out = _merged_in_order(rows, what in ("var", "sd"))
    else:
        known = F.col("bad") < F.col("c")
        of = lambda f, c: f(F.when(known, F.col(c)))
        aggregates = {"min": [of(F.min, "least").alias("a")], "max": [of(F.max, "most").alias("b")], "range": [of(F.min, "least").alias("a"), of(F.max, "most").alias("b")], "prod": [of(F.product, "product").alias("a")], "any": [of(F.bool_or, "some").alias("a")], "all": [of(F.bool_and, "every").alias("a")], "countNA": []}
        for name, column, sign in (("which.min", "least", 1), ("which.max", "most", -1)):
            aggregates[name] = [F.min(F.when(known, F.struct(sign * F.col(column), F.col("place").alias("place"))))["place"].alias("a")] if what == name else []
        out = rows.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("c").alias("c"), *aggregates[what])
    dims = [tiles.axes[k].dim for k in kept]
    return out.select(*(L.axis_of(F.col("key"), dims, i).cast("int").alias(f"m{i + 1}") for i in range(len(kept))), *(c for c in out.columns if c != "key"))


def value_range(tiles: Tiles) -> dict:
    """Least and most finite value, missing or infinite ones, and whether all finite ones are whole, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            known = x[np.isfinite(x)]
            some = len(known) > 0
            yield pa.RecordBatch.from_arrays([pa.array([known.min() if some else None], pa.float64()), pa.array([known.max() if some else None], pa.float64()), pa.array([len(x) - len(known)], pa.int64()), pa.array([bool((known == np.floor(known)).all()) if some else None], pa.bool_())], ["lo", "hi", "bad", "whole"])

    rows = tiles.frame.select("v").mapInArrow(run, "lo double, hi double, bad long, whole boolean")
    return rows.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.bool_and("whole").alias("whole")).first().asDict()


def packed(tiles: Tiles, stored: str, limits: tuple, slope: float, intercept: float) -> Tiles:
    """Narrow values: half to even, clamped; missing ones stay missing."""
    kind, least, most, _ = limits
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "float": pa.float32()}[kind]

    def kernel(values: pa.Array) -> pa.Array:
        v = values.cast(pa.float64())
        gone = v.is_null().to_numpy(zero_copy_only=False) if v.null_count else None
        x = (v.to_numpy(zero_copy_only=False) - intercept) / slope
        if least is not None:
            x = np.clip(np.rint(x), least, most)
            x = np.where(np.isnan(x), 0, x)
        return pa.array(x.astype(arrow.to_pandas_dtype()), arrow, mask=gone)

    return tiles.mapped(kernel, kind)


def unpacked(tiles: Tiles, stored: str, slope: float, intercept: float) -> Tiles:
    """The values of packed tiles; NaN of a narrow float is missing."""

    def kernel(values: pa.Array) -> pa.Array:
        v = values.cast(pa.float64())
        x = v.to_numpy(zero_copy_only=False)
        x = x if slope == 1 else x * slope
        x = x if intercept == 0 else x + intercept
        gone = np.isnan(x) if stored == "float32" else v.is_null().to_numpy(zero_copy_only=False) if v.null_count else None
        return pa.array(x, pa.float64(), mask=gone)

    return tiles.mapped(kernel, "double")


# -- whole sub-arrays


def calls(tiles: Tiles, kept: list[int], value_type: str) -> DataFrame:
    """m1, m2, ... and v: the values of each margin cell's sub-array, first axis fastest.

    Tiles are dealt as one array for each margin cell in them, not as cells, and
    put in order by numpy.
    """
    axes, counts = tiles.axes, tiles.counts
    call = [k for k in range(len(axes)) if k not in kept]
    dims, call_dims = [axes[k].dim for k in kept], [axes[k].dim for k in call]
    length = prod(call_dims)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            pieces = _pieces(batch.column("tile").to_numpy(), counts)
            for k in range(batch.num_rows):
                shape = tuple(int(a.length(p[k])) for a, p in zip(axes, pieces, strict=True))
                places = np.arange(prod(shape)).reshape(shape, order="F").transpose(call + kept).ravel(order="F")
                key = np.zeros(1, np.int64)
                for step, a in reversed(list(zip(L.strides(dims), kept, strict=True))):
                    key = (key[:, None] + (axes[a].start(pieces[a][k]) + np.arange(shape[a]))[None, :] * step).ravel()
                values = lists[k].values.take(pa.array(places))
                size = len(places) // len(key)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), batch.column("tile")[k].as_py())), pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * size), values)], ["key", "tile", "v"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            held = parts.flatten()
            tile, lists = held.field("tile").to_numpy(), held.field("v")
            pieces = _pieces(tile, counts)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(parts.value_lengths()))
            index = np.empty(batch.num_rows * length, np.int64)
            begin = np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            for k in range(len(tile)):
                at = np.zeros(1, np.int64)
                for step, a in reversed(list(zip(L.strides(call_dims), call, strict=True))):
                    at = (at[:, None] + (axes[a].start(pieces[a][k]) + np.arange(int(axes[a].length(pieces[a][k]))))[None, :] * step).ravel()
                index[row[k] * length + at] = np.arange(begin[k], begin[k + 1])
            v = pa.ListArray.from_arrays(pa.array((np.arange(batch.num_rows + 1) * length).astype(np.int32)), lists.flatten().take(pa.array(index)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), v], ["key", "v"])

    dealt = tiles.frame.mapInArrow(deal, f"key long, tile long, v array<{value_type}>")
    whole = dealt.groupBy("key").agg(F.collect_list(F.struct("tile", "v")).alias("parts")).mapInArrow(assemble, f"key long, v array<{value_type}>")
    return whole.select(*(L.axis_of(F.col("key"), dims, i).cast("int").alias(f"m{i + 1}") for i in range(len(kept))), "v")
