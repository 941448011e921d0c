"""Queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import form_queries, points, small_queries
from .fixtures import CUBE_SQL, EVENTS_SQL, SERIES_SQL, cube, events, series
from .image import Image
from .operators import apply, elementwise, index
from .operators.reduce import imreduce, line_sums, sparseness, summaries
from .plans import layout as L
from .sources.codec import StorageDescriptor, read_image, write_image
from .sources.shared import mounted, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def ijk(image: Image, value_type: str = "double", only: int = 3) -> DataFrame:
    axes = [a.cast("int").alias(n) for a, n in zip(image.axes()[:only], "ijk", strict=False)]
    return image.cells.select(*axes, image.value().cast(value_type).alias("v"))


def _renamed(df: DataFrame, names: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.col(f"m{n + 1}").alias(c) for n, c in enumerate(names)), *extra, "v")


#: SQL of each reduction over cells (i, j, k, v): {p} is the 1-based place among the call's cells.
AGGREGATES = {
    "sum": "sum(v)",
    "mean": "round(avg(v), 6)",
    "min": "min(v)",
    "max": "max(v)",
    "var": "round(var_samp(v), 4)",
    "sd": "round(stddev_samp(v), 6)",
    "which.min": "CAST(arg_min({p}, struct_pack(v := v, p := {p})) AS INTEGER)",
    "which.max": "CAST(arg_max({p}, struct_pack(v := v, p := -({p}))) AS INTEGER)",
    "any": "bool_or(v <> 0)",
    "all": "bool_and(v <> 0)",
    "countNA": "CAST(count(*) FILTER (v IS NULL) AS INTEGER)",
}
PLACES = {"k": "(i + 50*j + 1)", "ij": "(k + 1)", "ki": "(j + 1)"}
MARGINS = {"k": [3], "ij": [1, 2], "ki": [3, 1]}
DIGITS = {"mean": 6, "var": 4, "sd": 6}


def _reductions() -> None:
    for kind in ("sparse", "dense", "packed"):
        for what, sql in AGGREGATES.items():
            for names, margin in MARGINS.items():
                if (kind == "packed" and names != "k") or (kind == "dense" and names == "ki"):
                    continue

                def query(spark, sf_dir, kind=kind, what=what, names=names, margin=margin):
                    out = imreduce(cube(spark, sf_dir, kind), margin, what)
                    out = out.withColumn("v", F.round("v", DIGITS[what])) if what in DIGITS else out
                    return _renamed(out, names)

                cols = ", ".join(f"{c}::INTEGER AS {c}" for c in names)
                _add(f"reduce_{kind}_{what.replace('.', '_').lower()}_by_{names}", query, f"WITH {CUBE_SQL} SELECT {cols}, {sql.format(p=PLACES[names])} AS v FROM cube GROUP BY {', '.join(names)}")

    _add("reduce_range_by_k", lambda s, d: _renamed(imreduce(cube(s, d), [3], "range"), "k", ("r",)), f"WITH {CUBE_SQL}, r AS (SELECT k::INTEGER AS k, min(v) AS lo, max(v) AS hi FROM cube GROUP BY 1) SELECT k, 0 AS r, lo AS v FROM r UNION ALL SELECT k, 1, hi FROM r")
    _add("reduce_prod_by_k", lambda s, d: _renamed(imreduce(elementwise.binary(index.extract(cube(s, d), [1, 2], [1, 2, 3], None), "/", 1000.0), [3], "prod").withColumn("v", F.round("v", 9)), "k"), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, round(product(v/1000.0), 9) AS v FROM cube WHERE i < 2 AND j < 3 GROUP BY 1")
    _add("reduce_with_missing", lambda s, d: _renamed(imreduce(_holes(cube(s, d, "dense")), [3], "sum", na_rm=True), "k"), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, coalesce(sum(v) FILTER (v >= 50), 0) AS v FROM cube GROUP BY 1")
    _add("reduce_missing_spoils", lambda s, d: _renamed(imreduce(_holes(cube(s, d, "dense")), [1, 2], "max"), "ij"), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN bool_or(v < 50) THEN NULL ELSE max(v) END AS v FROM cube GROUP BY 1, 2")
    _add("reduce_count_missing", lambda s, d: _renamed(imreduce(_holes(cube(s, d, "dense")), [3], "countNA"), "k"), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, count(*) FILTER (v < 50)::INTEGER AS v FROM cube GROUP BY 1")
    _add("line_sums", lambda s, d: _renamed(line_sums(cube(s, d), 2), "ik"), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, k::INTEGER AS k, sum(v) AS v FROM cube GROUP BY 1, 2")
    _add("series_mean", lambda s, d: imreduce(series(s, d), [1], "mean").select(F.col("m1").alias("i"), F.round("v", 9).alias("v")), f"WITH {SERIES_SQL} SELECT i::INTEGER AS i, round(avg(v), 9) AS v FROM series GROUP BY 1")
    _add("events_sum_by_day", lambda s, d: imreduce(events(s, d), [3], "sum").select(F.col("m1").alias("d"), "v"), f"WITH {EVENTS_SQL} SELECT d::INTEGER AS d, sum(v) AS v FROM evgrid GROUP BY 1")
    _add("events_mean_by_location", lambda s, d: imreduce(events(s, d), [1, 2], "mean").select(F.col("m1").alias("u"), F.col("m2").alias("h"), F.round("v", 6).alias("v")), f"WITH {EVENTS_SQL} SELECT u::INTEGER AS u, h::INTEGER AS h, round(avg(v), 6) AS v FROM evgrid GROUP BY 1, 2")


def _holes(image: Image) -> Image:
    return replace(image, cells=image.cells.withColumn("v", F.when(F.col("v") >= 50, F.col("v"))))


def _scalars(spark: SparkSession, image: Image) -> DataFrame:
    got = summaries(image)
    rows = [(w, float(v)) for w, v in (("sum", got["sum"]), ("mean", round(got["mean"], 6)), ("min", got["min"]), ("max", got["max"]), ("sparseness", round(sparseness(image), 9)))]
    return spark.createDataFrame(rows, "what string, v double")


def _elementwise() -> None:
    _add("summaries", lambda s, d: _scalars(s, cube(s, d)), f"WITH {CUBE_SQL} SELECT 'sum' AS what, sum(v) AS v FROM cube UNION ALL SELECT 'mean', round(avg(v), 6) FROM cube UNION ALL SELECT 'min', min(v) FROM cube UNION ALL SELECT 'max', max(v) FROM cube UNION ALL SELECT 'sparseness', round(1 - (SELECT count(*) FROM sparse_cube)/4200.0::DOUBLE, 9)")
    expressions = {"+": "v + 3", "-": "v - 3", "*": "v * 3", "/": "v / 4.0", "^": "v * v", "%%": "v - 7*floor(v/7)", "%/%": "floor(v/7)", "==": "v = 60", "!=": "v <> 60", "<": "v < 60", ">": "v > 60", "<=": "v <= 60", ">=": "v >= 60", "&": "v <> 0", "|": "true"}
    numbers = {"^": 2, "%%": 7, "%/%": 7, "/": 4, "&": 1, "|": 1} | dict.fromkeys(["==", "!=", "<", ">", "<=", ">="], 60)
    titles = {"+": "plus", "-": "minus", "*": "times", "/": "over", "^": "power", "%%": "modulo", "%/%": "floor_div", "==": "eq", "!=": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge", "&": "and", "|": "or"}
    for op, sql in expressions.items():
        kind = "boolean" if op in ("==", "!=", "<", ">", "<=", ">=", "&", "|") else "double"
        _add(f"scalar_{titles[op]}", lambda s, d, op=op, kind=kind: ijk(elementwise.binary(cube(s, d), op, numbers.get(op, 3)).as_dense(), kind), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, {sql} AS v FROM cube")
    shifted = lambda s, d: cube(s, d).reorient((-1, 2, 3))
    _add("sparse_times_scalar_stays_sparse", lambda s, d: ijk(elementwise.binary(cube(s, d), "*", 3)), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, v*3 AS v FROM sparse_cube")
    _add("sparse_minus_sparse_tightens", lambda s, d: ijk(elementwise.binary(cube(s, d), "-", _every_other(cube(s, d)))), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, v FROM sparse_cube WHERE (i + j + k) % 2 = 1")
    _add("sparse_plus_sparse", lambda s, d: ijk(elementwise.binary(cube(s, d), "+", _every_other(cube(s, d)))), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, CASE WHEN (i+j+k)%2 = 0 THEN 2*v ELSE v END AS v FROM sparse_cube")
    _add("sparse_times_sparse", lambda s, d: ijk(elementwise.binary(cube(s, d), "*", _every_other(cube(s, d)))), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, v*v AS v FROM sparse_cube WHERE (i+j+k)%2 = 0")
    _add("sparse_plus_view", lambda s, d: ijk(elementwise.binary(cube(s, d), "+", shifted(s, d))), f"WITH {CUBE_SQL} SELECT a.i::INTEGER AS i, a.j::INTEGER AS j, a.k::INTEGER AS k, a.v + b.v AS v FROM cube a JOIN cube b ON b.i = 49 - a.i AND a.j = b.j AND a.k = b.k")
    _add("dense_plus_packed", lambda s, d: ijk(elementwise.binary(cube(s, d, "dense"), "+", cube(s, d, "packed"))), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, 2*v AS v FROM cube")
    functions = {"sqrt": "sqrt(v)", "abs": "abs(v)", "floor": "floor(v)", "ceiling": "ceil(v)", "trunc": "trunc(v)", "sign": "sign(v)::DOUBLE", "exp": "exp(v/1000)", "log": "ln(v + 1)", "log2": "log2(v + 1)", "log10": "log10(v + 1)", "log1p": "ln(v + 1)", "expm1": "exp(v/1000) - 1", "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "atan": "atan(v)", "asin": "asin(v/10000)", "acos": "acos(v/10000)", "sinh": "sinh(v/1000)", "cosh": "cosh(v/1000)", "tanh": "tanh(v/1000)", "gamma": "gamma(v/1000 + 1)", "lgamma": "lgamma(v + 1)", "round": "round_even(v/4, 0)", "signif": "v"}
    scale = {"exp": 1000, "expm1": 1000, "sinh": 1000, "cosh": 1000, "tanh": 1000, "asin": 10000, "acos": 10000, "round": 4}
    for name, sql in functions.items():

        def query(s, d, name=name):
            x = cube(s, d)
            x = elementwise.binary(x, "/", scale[name]) if name in scale else x
            if name in ("log", "log2", "log10", "lgamma"):
                x = elementwise.binary(x, "+", 1)
            if name == "gamma":
                x = elementwise.binary(elementwise.binary(x, "/", 1000), "+", 1)
            return ijk(elementwise.math(x, name).as_dense()).withColumn("v", F.round("v", 6))

        _add(f"math_{name}", query, f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, round({sql}, 6) AS v FROM cube")
    _add("unary_not", lambda s, d: ijk(elementwise.unary(cube(s, d), "!"), "boolean"), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, v = 0 AS v FROM cube")
    _add("unary_minus", lambda s, d: ijk(elementwise.unary(cube(s, d), "-")), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, -v AS v FROM sparse_cube")
    _add("is_missing", lambda s, d: ijk(elementwise.is_missing(_holes(cube(s, d, "dense"))), "boolean"), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, v < 50 AS v FROM cube")


def _every_other(image: Image) -> Image:
    a = image.axes()
    return replace(image, cells=image.cells.where((a[0] + a[1] + a[2]) % 2 == 0))


def _structure() -> None:
    grid = "SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k"
    _add("mask", lambda s, d: ijk(elementwise.mask(cube(s, d)), "boolean"), f"WITH {CUBE_SQL} SELECT c.i::INTEGER AS i, c.j::INTEGER AS j, c.k::INTEGER AS k, s.v IS NOT NULL AS v FROM cube c LEFT JOIN sparse_cube s USING (i, j, k)")
    _add("masks_union", lambda s, d: elementwise.masks_union(*_two_masks(s, d)), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS loc FROM cube WHERE j < 3 OR v > 60")
    _add("masks_intersection", lambda s, d: elementwise.masks_intersection(*_two_masks(s, d)), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS loc FROM cube WHERE j < 3 AND v > 60")
    _add("stored_values", lambda s, d: elementwise.stored_values(cube(s, d)).select("location", "v"), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k+1)::BIGINT AS location, v FROM sparse_cube")
    _add("masked_matrix", lambda s, d: elementwise.masked_matrix(events(s, d)).select("loc", F.posexplode("values").alias("elem", "v")), f"WITH {EVENTS_SQL}, n AS (SELECT max(user_id)+1 AS n FROM events) SELECT (g.u + n.n*g.h)::BIGINT AS loc, g.d::INTEGER AS elem, g.v FROM evgrid g, n WHERE EXISTS (SELECT 1 FROM ev WHERE ev.u = g.u AND ev.h = g.h)")
    _add("as_sparse", lambda s, d: ijk(elementwise.binary(cube(s, d, "dense"), "-", 60.0).as_sparse()), f"WITH {CUBE_SQL} {grid}, v - 60 AS v FROM cube WHERE v <> 60")
    _add("repack", lambda s, d: ijk(elementwise.repack(cube(s, d), elementwise.mask_locations(elementwise.binary(cube(s, d), "<", 40), 4200))), f"WITH {CUBE_SQL} {grid}, v FROM cube WHERE v < 40")
    for stored, slope in (("int16", 1.0), ("uint8", 2.0), ("int8", 50.0), ("uint16", 0.5), ("int32", 1.0)):
        lo, hi = {"int16": (-32768, 32767), "uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int32": (-2147483647, 2147483647)}[stored]
        _add(f"pack_{stored}", lambda s, d, stored=stored, slope=slope: ijk(cube(s, d).as_packed(stored, slope, 0.0)), f"WITH {CUBE_SQL} {grid}, least(greatest(round_even(v/{slope}, 0), {lo}), {hi})*{slope} AS v FROM cube")
    _add("pack_calibrated", lambda s, d: ijk(elementwise.binary(cube(s, d), "*", 1000.5).as_packed("int16")).withColumn("v", F.round("v", 3)), f"WITH {CUBE_SQL}, r AS (SELECT (max(v*1000.5) - min(v*1000.5))/65535 AS a, min(v*1000.5) + 32768*((max(v*1000.5) - min(v*1000.5))/65535) AS b FROM cube) SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, round(round_even((v*1000.5 - b)/a, 0)*a + b, 3) AS v FROM cube, r")
    views = {"flip": ((-1, 2, 3), "49-i", "j", "k"), "swap": ((3, 2, 1), "k", "j", "i"), "turn": ((-3, -1, -2), "11-k", "49-i", "6-j")}
    for name, (to, a, b, c) in views.items():
        for kind in ("sparse", "dense", "packed"):
            _add(f"reorient_{name}_{kind}", lambda s, d, to=to, kind=kind: ijk(cube(s, d, kind).reorient(to).as_dense()), f"WITH {CUBE_SQL} SELECT ({a})::INTEGER AS i, ({b})::INTEGER AS j, ({c})::INTEGER AS k, v FROM cube")
    _add("reduce_of_a_view", lambda s, d: _renamed(imreduce(cube(s, d).reorient((-3, -1, -2)), [1], "which.max"), "i"), f"WITH {CUBE_SQL}, w AS (SELECT 11-k AS i, 49-i AS j, 6-j AS k, v FROM cube) SELECT i::INTEGER AS i, arg_max(j+50*k+1, struct_pack(v := v, p := -(j+50*k+1)))::INTEGER AS v FROM w GROUP BY 1")
    _add("voxel_centres", lambda s, d: points.from_voxel(_voxels(s, d), cube(s, d).grid), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS loc, i*2.0::DOUBLE AS x, j*2.0::DOUBLE AS y, k*3.0::DOUBLE AS z FROM cube")
    _add("world_to_voxel_rounded", lambda s, d: points.to_voxel(_voxels(s, d), cube(s, d).grid, "world", "conventional"), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS loc, round_even((i+1)/2.0::DOUBLE, 0) + 1 AS x, round_even((j+1)/2.0::DOUBLE, 0) + 1 AS y, round_even((k+1)/3.0::DOUBLE, 0) + 1 AS z FROM cube")
    _add("scaled_to_voxel", lambda s, d: points.to_voxel(_voxels(s, d), cube(s, d).grid, "scaled"), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS loc, (i+1)/2.0::DOUBLE + 1 AS x, (j+1)/2.0::DOUBLE + 1 AS y, (k+1)/3.0::DOUBLE + 1 AS z FROM cube")


def _two_masks(s, d):
    low = cube(s, d, "dense").cells.where((F.floor(F.col("loc") / 50) % 7) < 3).select("loc")
    return low, elementwise.mask_locations(elementwise.binary(cube(s, d), ">", 60), 4200)


def _voxels(s, d):
    a = [L.axis_of(F.col("loc"), (50, 7, 12), k) for k in range(3)]
    return cube(s, d, "dense").cells.select("loc", *((x + 1).cast("double").alias(n) for x, n in zip(a, "xyz", strict=True)))


def _applied() -> None:
    median = lambda x: float(np.median(x))
    dims2 = lambda image, names: image.cells.select(*(L.axis_of(F.col("loc"), image.dims, n).cast("int").alias(c) for n, c in enumerate(names)), "v")
    _add("slice_apply_median", lambda s, d: dims2(apply.slice_apply(cube(s, d), median, axis=3), "k"), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, quantile_cont(v, 0.5)::DOUBLE AS v FROM cube GROUP BY 1")
    _add("line_apply_span", lambda s, d: dims2(apply.line_apply(cube(s, d), lambda x: float(x.max() - x.min()), axis=1), "jk"), f"WITH {CUBE_SQL} SELECT j::INTEGER AS j, k::INTEGER AS k, max(v) - min(v) AS v FROM cube GROUP BY 1, 2")
    _add("voxel_apply_median", lambda s, d: dims2(apply.voxel_apply(series(s, d), median), "i").withColumn("v", F.round("v", 9)), f"WITH {SERIES_SQL} SELECT i::INTEGER AS i, round(quantile_cont(v, 0.5), 9) AS v FROM series GROUP BY 1")
    _add("voxel_apply_masked", lambda s, d: apply.voxel_apply(events(s, d), median, mask=events(s, d), fill=-1).cells.select("loc", "v"), f"WITH {EVENTS_SQL}, n AS (SELECT max(user_id)+1 AS n FROM events) SELECT (u + n*h)::BIGINT AS loc, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.u = evgrid.u AND ev.h = evgrid.h) THEN quantile_cont(v, 0.5)::DOUBLE ELSE -1 END AS v FROM evgrid, n GROUP BY u, h, n")
    _add("imapply_routed_max", lambda s, d: _renamed(apply.imapply(cube(s, d), [3], max).drop("r"), "k"), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, max(v) AS v FROM cube GROUP BY 1")
    _add("imapply_quantiles", lambda s, d: apply.imapply(cube(s, d), [3], lambda x: np.quantile(x, [0.25, 0.75])).select(F.col("m1").alias("k"), "r", "v"), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, 0 AS r, quantile_cont(v, 0.25)::DOUBLE AS v FROM cube GROUP BY 1 UNION ALL SELECT k::INTEGER, 1, quantile_cont(v, 0.75)::DOUBLE FROM cube GROUP BY 1")
    bare = lambda image, names: image.cells.select(*(L.axis_of(F.col("loc"), image.dims, n).cast("int").alias(c) for n, c in enumerate(names)), "v")
    _add("extract_axes", lambda s, d: bare(index.extract(cube(s, d), None, [2, 3], -1), "ijk"), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, (j-1)::INTEGER AS j, (k-1)::INTEGER AS k, v FROM cube WHERE j IN (1, 2) AND k > 0")
    _add("extract_repeated", lambda s, d: bare(index.extract(cube(s, d), [5, 1, 5], 1, 1), "i"), f"WITH {CUBE_SQL} SELECT 0 AS i, v FROM cube WHERE i = 4 AND j = 0 AND k = 0 UNION ALL SELECT 1, v FROM cube WHERE i = 0 AND j = 0 AND k = 0 UNION ALL SELECT 2, v FROM cube WHERE i = 4 AND j = 0 AND k = 0")
    _add("extract_linear", lambda s, d: bare(index.extract(cube(s, d), np.arange(1, 4201, 7)), "i"), f"WITH {CUBE_SQL} SELECT ((i+50*j+350*k)//7)::INTEGER AS i, v FROM cube WHERE (i+50*j+350*k) % 7 = 0")
    _add("assign_sparse_tightens", lambda s, d: ijk(index.assign(cube(s, d), 0, None, 1, None)), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, v FROM sparse_cube WHERE j > 0")
    _add("assign_dense", lambda s, d: ijk(index.assign(cube(s, d, "dense"), [1.5, 2.5], [1, 2], None, 3)), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, CASE WHEN k = 2 AND i = 0 THEN 1.5 WHEN k = 2 AND i = 1 THEN 2.5 ELSE v END AS v FROM cube")
    _add("assign_packed", lambda s, d: ijk(index.assign(cube(s, d, "packed"), 7, None, 2, 2)), f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, CASE WHEN k = 1 AND j = 1 THEN 7 ELSE v END AS v FROM cube")
    vector = lambda s, d: cube(s, d, "dense").cells.select(F.col("loc").alias("pos"), "v")
    _add("strided_read", lambda s, d: index.strided(vector(s, d), 3, 10), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS pos, v FROM cube WHERE (i+50*j+350*k) >= 3 AND (i+50*j+350*k-3) % 10 = 0")
    _add("strided_reverse", lambda s, d: index.strided_reverse(vector(s, d), 3, 10), f"WITH {CUBE_SQL}, x AS (SELECT (i+50*j+350*k)::BIGINT AS pos, v FROM cube) SELECT a.pos, CASE WHEN a.pos % 10 = 3 THEN b.v ELSE a.v END AS v FROM x a LEFT JOIN x b ON b.pos = 4196 - a.pos")
    _add("strided_sort", lambda s, d: index.strided_sort(vector(s, d), 3, 10), f"WITH {CUBE_SQL}, x AS (SELECT (i+50*j+350*k)::BIGINT AS pos, v FROM cube), r AS (SELECT v, row_number() OVER (ORDER BY v, pos) AS n FROM x WHERE pos % 10 = 3) SELECT pos, CASE WHEN pos % 10 = 3 THEN (SELECT r.v FROM r WHERE r.n = (pos-3)//10 + 1) ELSE v END AS v FROM x")


def _round_trip(kind: str, d: StorageDescriptor, ending: str = "raw", **read) -> Query:
    def query(spark, sf_dir):
        folder = f"{mounted(shared_dir(spark))}/codec-{uuid.uuid4().hex}"
        os.makedirs(folder)
        path = f"{folder}/cube.{ending}"
        used = write_image(cube(spark, sf_dir, kind), path, d, widen=True)
        mask = elementwise.binary(cube(spark, sf_dir), ">", 60) if read.get("masked") else None
        return ijk(read_image(spark, path, used, (50, 7, 12), mask=mask, form=read.get("form", "auto")))

    return query


def _codec() -> None:
    grid = f"WITH {CUBE_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, v FROM"
    for kind, name in (("dense", "int16"), ("sparse", "uint16"), ("packed", "int16"), ("dense", "float32"), ("dense", "float64"), ("sparse", "int32"), ("dense", "uint32"), ("dense", "int64")):
        for endian in ("little", "big"):
            _add(f"codec_{kind}_{name}_{endian}", _round_trip(kind, StorageDescriptor(name, endian, offset=17)), f"{grid} cube")
    _add("codec_gzip", _round_trip("dense", StorageDescriptor("int32", offset=3), "gz"), f"{grid} cube")
    _add("codec_layout", _round_trip("dense", StorageDescriptor("int16", layout=(-2, 3, 1))), f"{grid} cube")
    _add("codec_sparse", _round_trip("dense", StorageDescriptor("int32"), form="sparse"), f"{grid} sparse_cube WHERE v <> 0")
    _add("codec_masked", _round_trip("dense", StorageDescriptor("int32"), masked=True), f"{grid} cube WHERE v > 60")


for _group in (_reductions, _elementwise, _structure, _applied, _codec):
    _group()
QUERIES |= small_queries.QUERIES
SQL |= small_queries.SQL
form_queries.in_blocks(QUERIES, SQL)
QUERIES |= form_queries.QUERIES
SQL |= form_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total quantity of each month of the cube, from its sparse form."""
    return QUERIES["reduce_sparse_sum_by_k"](spark, sf_dir)
