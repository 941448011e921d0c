"""Any Python function over sub-arrays: imapply and the verbs for voxels, lines and slices.

Known functions (min, max and their numpy forms, argmin, argmax) are routed to
built-in reductions. Others see their sub-arrays in batches: the cells of a call
are collected into one sorted list by an aggregate, and many lists go to a Python
worker at once, so that a call costs little more than the function. A call's
sub-array, first axis fastest, must fit in a worker.
"""

from __future__ import annotations

import builtins
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import blocks
from ..image import Image, from_cells, sub_geometry
from ..plans import layout as L
from ..sources.shared import shared_dir
from .elementwise import mask_locations
from .reduce import check_margin, imreduce, keyed

#: Functions that are reductions under another name; by identity.
ROUTED = {builtins.min: "min", builtins.max: "max", np.min: "min", np.max: "max", np.argmin: "which.min", np.argmax: "which.max"}
#: Numpy's places count from 0.
FROM_ZERO = (np.argmin, np.argmax)
ARROW = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string()}


def _named(got) -> tuple[list | None, list[str] | None]:
    """The values of a result (None: no result), first axis fastest, and the names of a dict's."""
    if got is None:
        return None, None
    if isinstance(got, dict):
        return list(got.values()), list(map(str, got))
    return np.ravel(np.asarray(got, dtype=object if isinstance(got, (list, tuple)) and any(isinstance(x, str) for x in got) else None), order="F").tolist(), None


def _runner(fun: Callable, shape: tuple[int, ...] | None, keys: list[str], returns: str, logical: bool, whole: bool, args: tuple, kwargs: dict):
    """A batch function: rows of keys and v (a list, in call order) to rows of keys and results."""
    kind = ARROW[returns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.field("v") if pa.types.is_struct(lists.type.value_type) else lists.values
            values = np.array(flat.to_pylist(), object) if logical else flat.to_numpy(zero_copy_only=False)
            row, place, out, names = [], [], [], []
            for k in range(batch.num_rows):
                v = values[offsets[k] : offsets[k + 1]]
                got, name = _named(fun(v.reshape(shape, order="F") if shape else v, *args, **kwargs))
                names.append(name)
                if whole:
                    out.append(got)
                elif got is not None:
                    row += [k] * len(got)
                    place += range(len(got))
                    out += got
            if whole:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(out, pa.list_(kind)), pa.array(names, pa.list_(pa.string()))], [*keys, "v", "names"])
            else:
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(place, pa.int32()), pa.array(out, kind)], [*keys, "r", "v"])

    return run


#: Columns of a result whose type is found at run time.
ANY = {"kind": pa.string(), "truth": pa.bool_(), "whole": pa.int64(), "number": pa.float64(), "text": pa.string()}
ANY_DDL = "kind string, truth boolean, whole long, number double, text string"


def _of_any_type(x) -> tuple:
    """Kind and value, each in its own column; None and NaN have no kind of their own."""
    if x is None:
        return None, None, None, None, None
    if isinstance(x, (bool, np.bool_)):
        return "boolean", bool(x), None, None, None
    if isinstance(x, (int, np.integer)):
        if not -(1 << 63) <= x < 1 << 63:
            raise TypeError("whole numbers of a result have 64 bits")
        return "bigint", None, int(x), None, None
    if isinstance(x, (float, np.floating)):
        return "double", None, None, float(x), None
    if isinstance(x, str):
        return "string", None, None, None, x
    raise TypeError(f"results are logical, whole, real or text, not {type(x).__name__}")


def _elements(got) -> list | None:
    """A result's elements as they are: numpy would make one type of a mixed list."""
    if got is None:
        return None
    if isinstance(got, dict):
        return list(got.values())
    return list(got) if isinstance(got, (list, tuple)) else list(np.ravel(np.asarray(got), order="F"))


def _any_runner(fun: Callable, shape: tuple[int, ...] | None, keys: list[str], logical: bool, args: tuple, kwargs: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.values.field("v") if pa.types.is_struct(lists.type.value_type) else lists.values
            offsets, values = lists.offsets.to_numpy(), np.array(flat.to_pylist(), object) if logical else flat.to_numpy(zero_copy_only=False)
            row, place, out = [], [], []
            for k in range(batch.num_rows):
                v = values[offsets[k] : offsets[k + 1]]
                got = _elements(fun(v.reshape(shape, order="F") if shape else v, *args, **kwargs))
                if got is not None:
                    row += [k] * len(got)
                    place += range(len(got))
                    out += map(_of_any_type, got)
            at = pa.array(row, pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * len(ANY)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(place, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, ANY.values(), strict=True))], [*keys, "r", *ANY])

    return run


def _narrowed(rows: DataFrame, names: list[str]) -> DataFrame:
    """v in the narrowest type that all results have: one of the four, double for numbers of both kinds, else VARIANT.

    The results are written first, so that the function is called once for each sub-array.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    held = spark.read.parquet(path)
    kinds = {r["kind"] for r in held.where("kind is not null").select("kind").distinct().collect()}  # at most four
    number = F.coalesce("number", F.col("whole").cast("double"))
    plain = {frozenset(): number, frozenset({"boolean"}): F.col("truth"), frozenset({"bigint"}): F.col("whole"), frozenset({"string"}): F.col("text"), frozenset({"double"}): number, frozenset({"bigint", "double"}): number}
    v = plain.get(frozenset(kinds))
    if v is None:
        v = F.coalesce(*(F.col(c).cast("variant") for c in ("truth", "whole", "number", "text")))
    return held.select(*names, "r", v.alias("v"))


def _calls(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a call: its keys and v, its (order, v) pairs sorted."""
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "v"))).alias("v"))


def imapply(image: Image, margin, fun: Callable, *args, returns: str | None = "double", simplify: bool = True, route: bool = True, **kwargs) -> DataFrame:
    """m1, m2, ..., r, v: element r of what ``fun`` gives for each margin cell; r is 0 alone for scalars.

    ``returns`` is the Spark type of a result's elements; with None it is found
    from the results: v is boolean, bigint, double or string where all agree,
    double for whole and real numbers, and VARIANT for a mixture. Results of different
    lengths give as many rows each; a call that gives None gives none. With
    simplify=False a row holds a whole result as an array v (NULL for None) and
    the names of a dict's values as ``names``. Where a margin has no cells the
    function is called once, on zeros. Positions of argmin and argmax are 0-based,
    counted first axis fastest.
    """
    kept = check_margin(image, margin)
    names = [f"m{i + 1}" for i in range(len(kept))]
    call_dims = [d for k, d in enumerate(image.dims) if k not in kept]
    shape = tuple(call_dims) if len(call_dims) > 1 and fun not in FROM_ZERO else None
    logical = image.value_type == "logical"
    if returns is None and not simplify:
        raise ValueError("whole results need a type")
    found, returns = returns is None, returns or "double"
    head = ", ".join(f"{n} int" for n in names)
    ddl = f"{head}, r int, v {returns}" if simplify else f"{head}, v array<{returns}>, names array<string>"
    if not prod(image.dims[k] for k in kept):
        dummy = np.zeros(prod(call_dims), object if logical else float)
        _named(fun(dummy.reshape(shape, order="F") if shape else dummy, *args, **kwargs))
        return image.cells.sparkSession.createDataFrame([], ddl)
    extra = set(kwargs) - {"na_rm"}
    if fun in ROUTED and simplify and route and not found and not args and not extra and image.value_type == "double":
        out = imreduce(image, margin, ROUTED[fun], **kwargs)
        return out.select(*names, F.lit(0).alias("r"), (F.col("v") - 1 if fun in FROM_ZERO else F.col("v")).cast(returns).alias("v"))
    if fun in ROUTED and "na_rm" in kwargs:
        fun, kwargs = _without_missing(fun, kwargs["na_rm"]), {k: v for k, v in kwargs.items() if k != "na_rm"}
    source = image if not image.is_sparse else image.as_dense()
    if source.tiles and prod(call_dims):
        tiles = blocks.unpacked(source.tiles, source.stored, source.slope, source.intercept) if source.is_packed else source.tiles
        if not logical:
            tiles = replace(tiles, frame=tiles.frame.select("tile", F.col("v").cast("array<double>").alias("v")))
        called = blocks.calls(tiles, kept, "boolean" if logical else "double")
    else:
        cells, _ = keyed(source, kept)
        cells = cells if logical else cells.withColumn("v", F.col("v").cast("double"))
        called = _calls(cells, names, "pos")
    if found:
        return _narrowed(called.mapInArrow(_any_runner(fun, shape, names, logical, args, kwargs), f"{head}, r int, {ANY_DDL}"), names)
    return called.mapInArrow(_runner(fun, shape, names, returns, logical, not simplify, args, kwargs), ddl)


def _without_missing(fun: Callable, drop: bool) -> Callable:
    """A numpy function that leaves missing values out if told to; places are those among all values."""
    if not drop:
        return fun

    def of_known(v):
        v = np.ravel(v, order="F")
        at = np.flatnonzero(~np.isnan(v))
        return at[fun(v[at])] if fun in FROM_ZERO else fun(v[at])

    return of_known


def shaped(image: Image, margin, fun: Callable, *args, returns: str = "double", simplify: bool = True, **kwargs):
    """The result as an array over the margin, for results that fit the driver: (array, names).

    All results of length one: the margin's shape. All of one length L: a leading
    axis L, with its names where all calls give the same ones. Of different
    lengths, or simplify=False: an array of lists. All None: None.
    """
    kept = check_margin(image, margin)
    dims = tuple(image.dims[k] for k in kept)
    rows = imapply(image, margin, fun, *args, returns=returns, simplify=False, **kwargs).collect()
    at = lambda r: tuple(r[f"m{i + 1}"] for i in range(len(dims)))
    if not rows:
        return np.zeros(dims), None
    lengths = {None if r["v"] is None else len(r["v"]) for r in rows}
    if simplify and lengths == {None}:
        return None, None
    if not simplify or len(lengths) > 1 or None in lengths:
        out = np.empty(dims, object)
        for r in rows:
            out[at(r)] = r["v"]
        return out, None
    (length,) = lengths
    out = np.empty((length, *dims), {"double": float, "float": float, "int": int, "bigint": int, "long": int, "boolean": bool}.get(returns, object))
    for r in rows:
        out[(slice(None), *at(r))] = r["v"] if out.dtype == object else [np.nan if x is None else x for x in r["v"]]
    named = {None if r["names"] is None else tuple(r["names"]) for r in rows}
    return (out[0] if length == 1 else out), list(next(iter(named))) if len(named) == 1 and None not in named else None


def result_image(image: Image, out: DataFrame, axes: list[int], value_type: str = "double", length: int = 1) -> Image:
    """The result over some axes (0-based, in order) as a dense image; results of several values get a leading axis."""
    names = [F.col(f"m{i + 1}").cast("long") for i in range(len(axes))]
    dims = tuple(image.dims[a] for a in axes)
    loc = L.flatten(names, dims)
    if length == 1:
        return from_cells(out.select(loc.alias("loc"), F.lit(0).alias("elem"), "v"), dims, min(len(dims), image.spatial), value_type=value_type, geometry=sub_geometry(image, axes))
    number = F.col("r") + loc * length
    return from_cells(out.select(number.cast("long").alias("loc"), F.lit(0).alias("elem"), "v"), (length, *dims), len(dims) + 1, value_type=value_type)


def voxel_apply(image: Image, fun: Callable, *args, mask: Image | None = None, fill=0, returns: str = "double", length: int = 1, **kwargs) -> Image:
    """fun of the value series at each location; with a mask only there, ``fill`` elsewhere."""
    if len(image.dims) == image.spatial:
        raise ValueError("there are no value axes to apply over")
    axes = list(range(image.spatial))
    margin = [a + 1 for a in axes]
    kind = {"double": "double", "int": "integer", "boolean": "logical"}.get(returns, "double")
    if mask is None:
        return result_image(image, imapply(image, margin, fun, *args, returns=returns, **kwargs), axes, kind, length)
    chosen = mask_locations(mask, image.n_locations)
    if not chosen.limit(1).count():
        raise ValueError("the mask selects no location")
    source = image.as_dense() if image.is_sparse else image
    cells = source.view().join(chosen, "loc", "left_semi").withColumn("v", F.col("v").cast("double"))
    # A masked call sees a flat series.
    got = _calls(cells, ["loc"], "elem").mapInArrow(_runner(fun, None, ["loc"], returns, False, False, args, kwargs), f"loc long, r int, v {returns}").withColumn("present", F.lit(True))
    grid = image.locations() if length == 1 else image.locations().select("loc", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("r"))
    got = got.drop("r") if length == 1 else got
    full = grid.join(got, ["loc"] if length == 1 else ["loc", "r"], "left").withColumn("v", F.when(F.col("present"), F.col("v")).otherwise(F.lit(fill).cast(returns)))
    dims = image.dims[: image.spatial]
    if length == 1:
        return from_cells(full.select("loc", F.lit(0).alias("elem"), "v"), dims, image.spatial, value_type=kind, geometry=image.geometry)
    return from_cells(full.select((F.col("r") + F.col("loc") * length).cast("long").alias("loc"), F.lit(0).alias("elem"), "v"), (length, *dims), len(dims) + 1, value_type=kind)


def line_apply(image: Image, fun: Callable, *args, axis: int = 1, returns: str = "double", length: int = 1, **kwargs) -> Image:
    """fun of each line along a spatial axis (with all its values)."""
    _axis(image, axis, 2)
    axes = [a for a in range(image.spatial) if a != axis - 1]
    return result_image(image, imapply(image, [a + 1 for a in axes], fun, *args, returns=returns, **kwargs), axes, length=length)


def slice_apply(image: Image, fun: Callable, *args, axis: int = 3, returns: str = "double", length: int = 1, **kwargs) -> Image:
    """fun of each slice across a spatial axis."""
    _axis(image, axis, 3)
    return result_image(image, imapply(image, [axis], fun, *args, returns=returns, **kwargs), [axis - 1], length=length)


def _axis(image: Image, axis: int, least: int) -> None:
    if image.spatial < least:
        raise ValueError(f"this needs at least {least} spatial axes")
    if not isinstance(axis, int) or not 1 <= axis <= image.spatial:
        raise ValueError("the axis must be one of the spatial axes")


def with_progress(image: Image, run: Callable[[Image], DataFrame], callback: Callable[[int, int], None], action: Callable[[DataFrame], object] = DataFrame.collect, every: float = 0.2):
    """The action's result on what ``run`` gives; while it works, done and total locations are reported.

    Done follows the tasks completed; it never falls, and reaches the total at the end only.
    """
    context, group, total = image.cells.sparkSession.sparkContext, f"gridloom-{uuid.uuid4().hex}", image.n_locations
    out, got = run(image), []

    def work() -> None:
        context.setJobGroup(group, "gridloom progress")
        try:
            got.append((action(out), None))
        except Exception as error:  # handed to the caller below
            got.append((None, error))

    callback(0, total)
    thread, tracker, said = InheritableThread(target=work), context.statusTracker(), 0
    thread.start()
    while thread.is_alive():
        thread.join(every)
        jobs = [j for k in tracker.getJobIdsForGroup(group) if (j := tracker.getJobInfo(k))]
        stages = [s for j in jobs for k in j.stageIds if (s := tracker.getStageInfo(k))]
        tasks = sum(s.numTasks for s in stages)
        now = min(total - 1, total * sum(s.numCompletedTasks for s in stages) // tasks) if tasks and total else 0
        if now > said:
            said = now
            callback(said, total)
    result, error = got[0]
    if error:
        raise error
    callback(total, total)
    return result


def resolve_threads(threads: int | None = None) -> int:
    """0: as Spark has it. Results never depend on the number."""
    if threads is None:
        return 0
    if threads != int(threads) or threads < 1:
        raise ValueError("threads must be a positive whole number")
    return int(threads)


def with_threads(image: Image, threads: int | None) -> Image:
    n = resolve_threads(threads)
    return replace(image, cells=image.cells.repartition(n)) if n else image


def parallel_backend() -> str:
    return "spark"


def can_fork() -> bool:
    return True
