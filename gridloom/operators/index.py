"""Extraction and assignment by subscripts; strided runs.

A selection is a DataFrame of (i, p): place in the result and in the view, both
0-based linear. Subscripts that follow a rule (all of an axis, evenly spaced
positions, all but some, repeating logical values, a logical image) are
predicates and arithmetic on the cells; only positions that a caller lists one
by one are a table, as long as that list.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..image import ORDER, PACKED, VALUE_TYPES, Image, from_cells, tighten
from ..plans import layout as L

#: Listed positions of an axis up to which their table is broadcast (16 bytes each).
MOST_BROADCAST = 1 << 20
#: Positions that one window of a rank counts.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Picked:
    """What a subscript takes of an axis: a rule start, start + step, ..., or listed positions (0-based)."""

    count: int
    start: int = 0
    step: int = 1
    listed: np.ndarray | None = None

    def forward(self, r: Column) -> Column:
        """The axis position of the r-th one, for a rule."""
        return F.lit(self.start).cast("long") + r * self.step

    def table(self, spark: SparkSession, k: str, r: str) -> DataFrame:
        made = spark.createDataFrame([(int(x), i) for i, x in enumerate(self.listed)], f"{k} long, {r} long")
        return F.broadcast(made) if len(self.listed) <= MOST_BROADCAST else made


def subscript(s, extent: int) -> Picked:
    """A 1-based subscript of an axis: None or a full slice (all), numbers (negative: all but), or logical values."""
    if s is None or isinstance(s, slice) and s == slice(None):
        return Picked(extent)
    if isinstance(s, slice):
        raise TypeError("of slices only : stands for an axis")
    s = np.atleast_1d(np.asarray(s))
    if s.size == 0:
        return Picked(0)
    if s.dtype.kind in "OSU":
        raise TypeError("subscripts are numbers or logical values, none missing")
    if s.dtype.kind == "b":
        if len(s) > extent:
            raise IndexError("a logical subscript is longer than its axis")
        return _ruled(np.flatnonzero(np.resize(s, extent)))
    if np.any(np.isnan(s.astype(float))):
        raise ValueError("subscripts may not be missing")
    s = np.trunc(s.astype(float)).astype(int)
    s = s[s != 0]
    if np.any(s > 0) and np.any(s < 0):
        raise ValueError("subscripts can't mix signs")
    if np.any(np.abs(s) > extent):
        raise IndexError("a subscript is out of bounds")
    if len(s) and s[0] < 0:
        left = np.ones(extent, bool)
        left[-s - 1] = False
        return _ruled(np.flatnonzero(left))
    return _ruled(s - 1)


def _ruled(at: np.ndarray) -> Picked:
    steps = np.diff(at)
    if len(at) == 0 or len(at) == 1 or steps[0] > 0 and np.all(steps == steps[0]):
        return Picked(len(at), int(at[0]) if len(at) else 0, int(steps[0]) if len(at) > 1 else 1)
    return Picked(len(at), listed=at)


def _ranked(df: DataFrame, p: str, name: str) -> DataFrame:
    """The 0-based rank of distinct numbers p: counted by blocks of positions, so no task sees all of them."""
    block = F.call_function("div", F.col(p), F.lit(BLOCK))
    blocks = df.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each BLOCK positions; their running total is the one window over all.
    before = blocks.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = df.withColumn("_block", block).withColumn("_k", F.row_number().over(W.partitionBy("_block").orderBy(p)) - 1)
    return inside.join(before, "_block").withColumn(name, F.col("_before") + F.col("_k")).drop("_block", "_before", "_k")


def _linear(image: Image, s) -> tuple[DataFrame, int]:
    """(i, p) of a single subscript over all positions, and their number. Only listed positions become a table."""
    spark, n = image.cells.sparkSession, image.length
    every = spark.range(n).select(F.col("id").alias("p"))
    array = None if s is None or isinstance(s, slice) else np.atleast_1d(np.asarray(s))
    if array is not None and array.dtype.kind == "b" and 0 < array.size <= n:
        held, size = np.flatnonzero(array), array.size
        count = n // size * len(held) + int((held < n % size).sum())
        if not count:
            return spark.createDataFrame([], "i long, p long"), 0
        table = spark.createDataFrame([(int(x), i) for i, x in enumerate(held)], "at long, r long")
        table = F.broadcast(table) if len(held) <= MOST_BROADCAST else table
        hit = every.withColumn("at", F.col("p") % size).join(table, "at")
        return hit.select((F.call_function("div", F.col("p"), F.lit(size)) * len(held) + F.col("r")).alias("i"), "p"), count
    if array is not None and array.size and array.dtype.kind in "if" and not np.any(np.isnan(array.astype(float))) and np.all(array < 0):
        gone = np.unique(-np.trunc(array.astype(float)).astype(int) - 1)
        if gone[-1] >= n:
            raise IndexError("a subscript is out of bounds")
        left = every.join(spark.createDataFrame([(int(x),) for x in gone], "p long"), "p", "left_anti")
        return _ranked(left, "p", "i").select("i", "p"), n - len(gone)
    picked = subscript(s, n)
    if picked.listed is not None:
        return picked.table(spark, "p", "i"), picked.count
    return spark.range(picked.count).select(F.col("id").alias("i"), picked.forward(F.col("id")).alias("p")), picked.count


def selection(image: Image, *subs) -> tuple[DataFrame, tuple[int, ...]]:
    """(i, p): place in the result and linear view position of what some subscripts select, and the result's dims."""
    spark = image.cells.sparkSession
    if len(subs) == 1 and isinstance(subs[0], Image):
        m = subs[0]
        if m.length != image.length:
            raise IndexError("a logical image must fit the image")
        held = m.view().where(F.col("v").cast("double") != 0).select((F.col("loc") + F.col("elem").cast("long") * m.n_locations).alias("p"))
        return _ranked(held, "p", "i").select("i", "p"), (held.count(),)
    if len(subs) == 1 and np.ndim(subs[0]) == 2 and len(image.dims) > 1:
        rows = np.asarray(subs[0]).astype(int) - 1
        if rows.shape[1] != len(image.dims) or np.any(rows < 0) or np.any(rows >= image.dims):
            raise IndexError("an index matrix has a column for each axis, in bounds")
        at = (rows * L.strides(image.dims)).sum(axis=1).tolist()
        return spark.createDataFrame(list(enumerate(at)), "i long, p long"), (len(at),)
    if len(subs) == 1 and len(image.dims) > 1:
        places, count = _linear(image, subs[0])
        return places, (count,)
    picked = _axes(image, subs)
    dims = tuple(p.count for p in picked)
    places = spark.range(prod(dims)).select(F.col("id").alias("i"))
    at: list[Column] = []
    for k, p in enumerate(picked):
        r = L.axis_of(F.col("i"), dims, k)
        if p.listed is None:
            at.append(p.forward(r))
        else:
            places = places.withColumn(f"r{k}", r.cast("long")).join(p.table(spark, f"x{k}", f"r{k}"), f"r{k}").drop(f"r{k}")
            at.append(F.col(f"x{k}"))
    return places.select("i", L.flatten(at, image.dims).alias("p")), dims


def _axes(image: Image, subs) -> list[Picked]:
    if len(subs) != len(image.dims):
        raise IndexError("there must be one subscript for each axis, or a single one")
    return [subscript(s, d) for s, d in zip(subs, image.dims, strict=True)]


def _numbered(image: Image) -> DataFrame:
    return image.view().select((F.col("loc") + F.col("elem").cast("long") * image.n_locations).alias("p"), "v")


def _by_axes(image: Image, picked: list[Picked]) -> DataFrame:
    """(i, v) of the stored cells that a subscript for each axis takes: filters, arithmetic and small broadcast tables, no shuffle."""
    spark = image.cells.sparkSession
    names = [f"a{k}" for k in range(len(picked))]
    cells = image.cells.select(*(a.cast("long").alias(n) for a, n in zip(image.axes(), names, strict=True)), image.value().alias("v"))
    for n, p, d in zip(names, picked, image.dims, strict=True):
        a = F.col(n)
        if p.listed is not None:
            cells = cells.join(p.table(spark, n, f"_{n}"), n).drop(n).withColumnRenamed(f"_{n}", n)
        elif p.count < d:
            cells = cells.where((a >= p.start) & (a < p.start + p.step * p.count) & ((a - p.start) % p.step == 0)).withColumn(n, F.call_function("div", a - p.start, F.lit(p.step)))
    return cells.select(L.flatten([F.col(n) for n in names], [p.count for p in picked]).alias("i"), "v")


def extract(image: Image, *subs, drop: bool = True) -> Image:
    """x[...]: a bare array; repeats and order of the subscripts are kept."""
    one_each = len(subs) == len(image.dims) and not (len(subs) == 1 and (isinstance(subs[0], Image) or np.ndim(subs[0]) == 2))
    if one_each:
        picked = _axes(image, subs)
        dims, found = tuple(p.count for p in picked), _by_axes(image, picked)
        places = image.cells.sparkSession.range(prod(dims)).select(F.col("id").alias("i")) if image.is_sparse else None
    else:
        places, dims = selection(image, *subs)
        found = places.join(_numbered(image), "p").select("i", "v")
    if places is not None:  # what is absent is zero
        zero = F.lit(None).cast(found.schema["v"].dataType) if image.value_type == "complex" else F.lit(0).cast(found.schema["v"].dataType)
        found = places.select("i").join(found.withColumn("present", F.lit(True)), "i", "left").select("i", F.when(F.col("present"), F.col("v")).otherwise(zero).alias("v"))
    dims = tuple(d for d in dims if d != 1) or (1,) if drop else dims
    return from_cells(found.select(F.col("i").alias("loc"), F.lit(0).alias("elem"), "v"), dims, len(dims), value_type=image.value_type)


def recycle(values, n: int) -> list:
    """The values to assign, first axis fastest; place i gets value i modulo their number."""
    values = list(np.ravel(values, order="F")) if np.ndim(values) else [values]
    if not values:
        raise ValueError("nothing to assign")
    if n % len(values):
        warnings.warn("the number of values does not divide the number of places", stacklevel=3)
    return values[:n]


def assign(image: Image, value, *subs) -> Image:
    """x[...] <- v as a new image. Packed images keep their scaling and refuse what it can't reach; of repeated places the last wins."""
    places, dims = selection(image, *subs)
    if not prod(dims):
        return image
    plain = lambda x: None if x is None or isinstance(x, float) and np.isnan(x) else x.item() if hasattr(x, "item") else x
    values = list(map(plain, recycle(value, prod(dims))))
    if image.is_packed:
        kind, least, most, _ = PACKED[image.stored]
        vtype, stored = image.value_type, []
        for x in values:
            if isinstance(x, complex) or x is None and least is not None:
                raise ValueError("packed integers can't hold missing or complex values")
            y = None if x is None else (float(x) - image.intercept) / image.slope
            if least is not None:
                y = round(y)
                if not least <= y <= most:
                    raise ValueError(f"{x} is out of reach of {image.stored} with this scaling")
            stored.append(y)
        values = stored
    else:
        kinds = {bool: "logical", int: "integer", float: "double", complex: "complex"}
        vtype = ORDER[max([ORDER.index(image.value_type), *(ORDER.index(kinds[type(x)]) for x in values if x is not None)])]
        kind = VALUE_TYPES[vtype]
    to = {"boolean": bool, "double": float, "float": float}.get(kind, (lambda x: (complex(x).real, complex(x).imag)) if vtype == "complex" else int)
    values = [None if x is None else to(x) for x in values]
    spark, n = image.cells.sparkSession, image.n_locations
    last = places.groupBy("p").agg(F.max("i").alias("i"))
    if len(values) > 1:  # a table as long as the values given
        table = spark.createDataFrame(list(enumerate(values)), f"r long, new {kind}")
        last = last.withColumn("r", F.col("i") % len(values)).join(F.broadcast(table) if len(values) <= MOST_BROADCAST else table, "r")
    else:
        pair = values[0]
        last = last.withColumn("new", F.struct(*(F.lit(x).alias(c) for x, c in zip(pair, ("re", "im"), strict=True))) if isinstance(pair, tuple) else F.lit(pair).cast(kind))
    new = last.select((F.col("p") % n).alias("loc"), F.call_function("div", F.col("p"), F.lit(n)).cast("int").alias("elem"), "new", F.lit(True).alias("hit"))
    base = image if image.is_packed else replace(image, cells=image.view(), layout=None)
    if image.is_packed and image.layout != L.identity(len(image.dims)):
        base = _restore(image)
    if image.is_sparse and image.n_elements > 1:  # a location that gets a value gets all its elements
        base = replace(base, cells=_fill_locations(base, new))
    old = base.cells.select("loc", "elem", (F.struct(F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")) if vtype == "complex" and image.value_type != "complex" else F.col("v").cast(kind)).alias("v"))
    cells = old.join(new, ["loc", "elem"], "full" if image.is_sparse else "left").select("loc", "elem", F.when(F.col("hit"), F.col("new")).otherwise(F.col("v")).alias("v"))
    out = replace(base, cells=cells, value_type=vtype)
    return tighten(out) if image.is_sparse else out


def _restore(image: Image) -> Image:
    """A packed image with its stored values put in view order."""
    raw = replace(image, kind="dense", stored=None, slope=1.0, intercept=0.0)
    return replace(image, cells=raw.view(), layout=None)


def _fill_locations(image: Image, new: DataFrame) -> DataFrame:
    fresh = new.select("loc").distinct().join(image.cells.select("loc").distinct(), "loc", "left_anti")
    elems = F.explode(F.sequence(F.lit(0), F.lit(image.n_elements - 1))).alias("elem")
    return image.cells.unionByName(fresh.select("loc", elems).select("loc", "elem", F.lit(0).cast(image.cells.schema["v"].dataType).alias("v")))


Image.__getitem__ = lambda self, subs: extract(self, *(subs if isinstance(subs, tuple) else (subs,)))


# -- strided runs of a vector


def strided(vector: DataFrame, start: int, stride: int, length: int | None = None) -> DataFrame:
    """pos, v of every stride-th position from ``start`` (0-based)."""
    run = vector.where((F.col("pos") >= start) & (F.pmod(F.col("pos") - start, F.lit(stride)) == 0))
    return run if length is None else run.where(F.col("pos") < start + stride * length)


def strided_sum(vector: DataFrame, start: int, stride: int) -> float:
    return strided(vector, start, stride).agg(F.sum("v")).first()[0] or 0.0


def strided_reverse(vector: DataFrame, start: int, stride: int) -> DataFrame:
    """The run's values in reverse; other positions stay. Position p takes from first + last - p."""
    run = strided(vector, start, stride)
    ends = run.agg(F.min("pos"), F.max("pos")).first()
    if ends[0] is None:
        return vector
    new = run.select((F.lit(ends[0] + ends[1]) - F.col("pos")).alias("pos"), F.col("v").alias("new"), F.lit(True).alias("hit"))
    return _replaced(vector, new)


def strided_sort(vector: DataFrame, start: int, stride: int) -> DataFrame:
    """The run's values in order; other positions stay. A range-partitioned sort; each partition's ranks begin after those before it."""
    run = strided(vector, start, stride)
    n = int(vector.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A number of partitions that is asked for stays as it is, so both uses below see the same ones.
    ordered = run.select("v", "pos").repartitionByRange(n, "v", "pos").sortWithinPartitions("v", "pos").withColumn("id", F.monotonically_increasing_id())
    part, inside = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    ranks = ordered.select("v", part.alias("part"), inside.alias("k")).join(F.broadcast(before), "part")
    new = ranks.select((F.lit(start) + (F.col("before") + F.col("k")) * stride).alias("pos"), F.col("v").alias("new"), F.lit(True).alias("hit"))
    return _replaced(vector, new)


def _replaced(vector: DataFrame, new: DataFrame) -> DataFrame:
    return vector.join(new, "pos", "left").select("pos", F.when(F.col("hit"), F.col("new")).otherwise(F.col("v")).alias("v"))
