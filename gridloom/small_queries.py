"""Queries of what the table queries leave out: construction, geometry, results of any shape, operators with numbers and arrays, subscripts, codec forms.

They run on the cube, on its first cells, or on a row of a table at a time; their
SQL is written from the rules themselves, not from this package's code.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import points
from .describe import bar, describe
from .fixtures import CUBE_SQL, cube
from .geometry import make_geometry
from .grids import Grids, inverse, split
from .image import PACKED, Image, exact_scaling, from_cells, from_numpy, packed_from_bytes, sparse_from_mask, wide_enough
from .operators import apply, elementwise, index
from .operators.reduce import imreduce, sparseness, summaries, summary
from .plans import layout as L
from .sources.codec import StorageDescriptor, read_image, write_image
from .sources.shared import mounted, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A transform whose first world axis runs against the first axis of the grid: 2 mm voxels.
LAS = np.array([[-2.0, 0, 0, 90], [0, 2, 0, -126], [0, 0, 2, -72], [0, 0, 0, 1]])


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _values(rows: list[tuple]) -> str:
    """SQL of some (what, k, v) rows."""
    return "SELECT what, k::INTEGER AS k, v::DOUBLE AS v FROM (VALUES " + ", ".join(f"('{w}', {k}, {v})" for w, k, v in rows) + ") AS t(what, k, v)"


def _rows(spark: SparkSession, **found) -> DataFrame:
    """(what, k, v): each value of some arrays, first axis fastest."""
    rows = [(what, k, float(v)) for what, values in found.items() for k, v in enumerate(np.ravel(np.asarray(values, float), order="F"))]
    return spark.createDataFrame(rows, "what string, k int, v double")


def box(spark: SparkSession, sf_dir: str) -> Image:
    """The cube's first 2 x 3 x 4 cells, dense."""
    x = cube(spark, sf_dir)
    keep = x.cells.select("loc", "elem", "v", *(a.alias(n) for a, n in zip(x.axes(), "ijk", strict=True))).where("i < 2 AND j < 3 AND k < 4")
    return from_cells(keep.select((F.col("i") + 2 * F.col("j") + 6 * F.col("k")).alias("loc"), "elem", "v"), (2, 3, 4), 3, "sparse").as_dense()


#: The same cells: p (0-based place), i, j, k, v.
BOX = f"WITH {CUBE_SQL}, box AS (SELECT (i + 2*j + 6*k)::BIGINT AS p, i, j, k, v FROM cube WHERE i < 2 AND j < 3 AND k < 4)"


def cells(image: Image, kind: str = "double") -> DataFrame:
    """p (0-based linear place in the view) and v."""
    return image.view().select((F.col("loc") + F.col("elem").cast("long") * image.n_locations).alias("p"), F.col("v").cast(kind).alias("v"))


def _construction() -> None:

    _add("pack_float32", lambda s, d: cells((cube(s, d) / 3).as_packed("float32")), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS p, (v / 3.0)::FLOAT::DOUBLE AS v FROM cube")


def _applied() -> None:
    cube_sql = f"WITH {CUBE_SQL}"
    _add("imapply_ragged", lambda s, d: apply.imapply(cube(s, d), [3], lambda x: np.sort(x[x > 400])).select(F.col("m1").alias("k"), "r", "v"), f"{cube_sql} SELECT k::INTEGER AS k, (row_number() OVER (PARTITION BY k ORDER BY v) - 1)::INTEGER AS r, v FROM cube WHERE v > 400")
    _add("imapply_named", lambda s, d: apply.imapply(cube(s, d), [3], lambda x: {"least": x.min(), "most": x.max()}, simplify=False).select(F.col("m1").alias("k"), F.explode(F.arrays_zip("names", "v")).alias("e")).select("k", F.col("e.names").alias("name"), F.col("e.v").alias("v")), f"{cube_sql} SELECT k::INTEGER AS k, 'least' AS name, min(v) AS v FROM cube GROUP BY 1 UNION ALL SELECT k::INTEGER, 'most', max(v) FROM cube GROUP BY 1")
    _add("imapply_strings", lambda s, d: apply.imapply(cube(s, d), [3], lambda x: "high" if x.max() > 500 else "low", returns="string").select(F.col("m1").alias("k"), "v"), f"{cube_sql} SELECT k::INTEGER AS k, CASE WHEN max(v) > 500 THEN 'high' ELSE 'low' END AS v FROM cube GROUP BY 1")

    def places(s, d):
        x = cube(s, d)
        whole = from_cells(x.as_dense().cells.withColumn("v", F.col("v").cast("int")), x.dims, 3, value_type="integer")
        both = apply.imapply(x, [3], np.argmax).join(apply.imapply(whole, [3], np.argmax).withColumnRenamed("v", "w"), ["m1", "r"])
        return both.select(F.col("m1").alias("k"), "v", "w")

    _add("imapply_argmax", places, f"{cube_sql}, m AS (SELECT k, arg_max(i + 50*j, struct_pack(v := v, p := -(i + 50*j))) AS pl FROM cube GROUP BY 1) SELECT k::INTEGER AS k, pl::DOUBLE AS v, pl::DOUBLE AS w FROM m")

    def watched(s, d):
        said: list[tuple[int, int]] = []
        rows = apply.with_progress(cube(s, d, "dense"), lambda x: imreduce(x, [3], "sum"), lambda done, total: said.append((done, total)))
        counts = [a for a, _ in said]
        return _rows(s, first=[counts[0]], last=[counts[-1]], rising=[counts == sorted(counts)], total=[{b for _, b in said} == {4200}], rows=[len(rows)])

    _add("progress", watched, _values([("first", 0, 0), ("last", 0, 4200), ("rising", 0, 1), ("total", 0, 1), ("rows", 0, 12)]))
    _add("threads_change_nothing", lambda s, d: imreduce(apply.with_threads(cube(s, d), 3), [3], "which.max").select(F.col("m1").alias("k"), "v"), f"{cube_sql} SELECT k::INTEGER AS k, (arg_max(i + 50*j + 1, struct_pack(v := v, p := -(i + 50*j))))::INTEGER AS v FROM cube GROUP BY 1")


def _summaries() -> None:
    def row(image: Image, s) -> DataFrame:
        got = summaries(image)
        return _rows(s, sum=[got["sum"]], mean=[round(got["mean"], 6)], range=got["range"], any=[got["any"]], all=[got["all"]], zero=[round(sparseness(image), 9)])

    sql = "SELECT 'sum' AS what, 0 AS k, sum(v) AS v FROM cube UNION ALL SELECT 'mean', 0, round(avg(v), 6) FROM cube UNION ALL SELECT 'range', 0, min(v) FROM cube UNION ALL SELECT 'range', 1, max(v) FROM cube UNION ALL SELECT 'any', 0, bool_or(v <> 0)::INTEGER FROM cube UNION ALL SELECT 'all', 0, bool_and(v <> 0)::INTEGER FROM cube UNION ALL SELECT 'zero', 0, round((count(*) FILTER (v = 0)) / 4200.0::DOUBLE, 9) FROM cube"
    for kind in ("sparse", "dense", "packed"):
        _add(f"summaries_{kind}", lambda s, d, kind=kind: row(cube(s, d, kind), s), f"WITH {CUBE_SQL} {sql}")

def _operators() -> None:
    full = f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS p, {{}} AS v FROM cube"
    held = f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS p, {{}} AS v FROM sparse_cube"
    _add("number_times_sparse", lambda s, d: cells(2 * cube(s, d)), held.format("2 * v"))
    _add("number_minus_sparse_zero", lambda s, d: cells(0 - cube(s, d)), held.format("0 - v"))
    _add("number_plus_sparse", lambda s, d: cells(1 + cube(s, d)), full.format("1 + v"))
    _add("number_over_dense", lambda s, d: cells(5 / (cube(s, d, "dense") + 1)), full.format("5 / (v + 1)"))
    _add("number_to_the_dense", lambda s, d: cells(2 ** (cube(s, d, "dense") / 1000)).withColumn("v", F.round("v", 9)), full.format("round(pow(2, v / 1000), 9)"))
    _add("number_modulo_packed", lambda s, d: cells(1000 % (cube(s, d, "packed") + 7)), full.format("1000 - (v+7) * floor(1000 / (v+7))"))
    _add("number_less_than_dense", lambda s, d: cells(60 < cube(s, d, "dense"), "boolean"), full.format("60 < v"))
    _add("operators_of_images", lambda s, d: cells(((cube(s, d) * 3 - cube(s, d)) ** 2 // 7 + abs(-cube(s, d))).as_dense()), full.format("floor((2*v)*(2*v)/7) + v"))
    _add("not_of_image", lambda s, d: cells(~(cube(s, d) > 60), "boolean"), full.format("NOT (v > 60)"))
    weights = np.arange(4200.0).reshape(50, 7, 12, order="F")
    _add("sparse_plus_array", lambda s, d: cells(cube(s, d) + weights), full.format("v + (i+50*j+350*k)"))
    _add("array_minus_packed", lambda s, d: cells(weights - cube(s, d, "packed")), full.format("(i+50*j+350*k) - v"))
    _add("sparse_times_vector", lambda s, d: cells(cube(s, d) * np.array([1.0, 0.0, 2.0])), full.format("v * CASE (i+50*j+350*k) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END"))
    _add("sparse_over_zero", lambda s, d: cells((cube(s, d) / 0).as_sparse()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == float("inf")).alias("infinite"), F.count_if(F.isnan("v") | F.col("v").isNull()).alias("gone")), f"WITH {CUBE_SQL} SELECT count(*) AS n, count(*) FILTER (v > 0) AS infinite, count(*) FILTER (v = 0) AS gone FROM cube")
def _subscripts() -> None:
    cells_sql = f"WITH {CUBE_SQL}, x AS (SELECT (i+50*j+350*k)::BIGINT AS p, v, i, j, k FROM cube)"
    _add("extract_logical_image", lambda s, d: cells(cube(s, d)[cube(s, d) > 60]), f"{cells_sql} SELECT row_number() OVER (ORDER BY p) - 1 AS p, v FROM x WHERE v > 60")
    _add("extract_logical_vector", lambda s, d: cells(cube(s, d, "dense")[np.array([True, False, False, True, False])]), f"{cells_sql} SELECT row_number() OVER (ORDER BY p) - 1 AS p, v FROM x WHERE p % 5 IN (0, 3)")
    _add("extract_all_but", lambda s, d: cells(cube(s, d, "packed")[-np.arange(1, 11)]), f"{cells_sql} SELECT p - 10 AS p, v FROM x WHERE p >= 10")
    _add("extract_index_matrix", lambda s, d: cells(cube(s, d)[np.array([[1, 1, 1], [50, 7, 12], [3, 2, 5], [1, 1, 1]])]), f"{cells_sql}, m AS (SELECT * FROM (VALUES (0::BIGINT, 0), (1, 4199), (2, 2+50+1400), (3, 0)) AS t(n, pl)) SELECT n AS p, v FROM m JOIN x ON x.p = m.pl")
    _add("extract_listed_axes", lambda s, d: cells(cube(s, d)[[7, 3, 3, 50], :, [12, 1]]), f"{cells_sql}, a AS (SELECT * FROM (VALUES (0, 6), (1, 2), (2, 2), (3, 49)) AS t(r, i)), c AS (SELECT * FROM (VALUES (0, 11), (1, 0)) AS t(q, k)) SELECT (a.r + 4*x.j + 28*c.q)::BIGINT AS p, x.v FROM x JOIN a USING (i) JOIN c USING (k)")
    _add("extract_of_view", lambda s, d: cells(cube(s, d).reorient((-3, -1, -2))[1, None, [2, 4, 6]]), f"WITH {CUBE_SQL} SELECT ((49-i) + 50*((6-j-1)//2))::BIGINT AS p, v FROM cube WHERE k = 11 AND (6-j) IN (1, 3, 5)")
    _add("extract_nothing", lambda s, d: cells(index.extract(cube(s, d), [], None, None, drop=False)), "SELECT 0::BIGINT AS p, 0.0::DOUBLE AS v WHERE false")
    _add("assign_recycles", lambda s, d: cells(index.assign(cube(s, d, "dense"), [1, 2, 3], None, 1, 1)), f"{cells_sql} SELECT p, CASE WHEN j = 0 AND k = 0 THEN 1 + i % 3 ELSE v END AS v FROM x")
    _add("assign_repeated_last", lambda s, d: cells(index.assign(cube(s, d), [10, 20, 30], [4, 9, 4], 1, 1)), f"{cells_sql} SELECT p, CASE p WHEN 3 THEN 30 WHEN 8 THEN 20 ELSE v END AS v FROM x WHERE v <> 0 OR p IN (3, 8)")
    _add("assign_logical_image", lambda s, d: cells(index.assign(cube(s, d, "dense"), 0, cube(s, d) > 60)), f"{cells_sql} SELECT p, CASE WHEN v > 60 THEN 0 ELSE v END AS v FROM x")


def _round_trip(make: Callable[[SparkSession, str], Image], d: StorageDescriptor, dims, ending: str = "raw", **read) -> Callable[[SparkSession, str], Image]:
    def image(spark, sf_dir):
        folder = f"{mounted(shared_dir(spark))}/codec-{uuid.uuid4().hex}"
        os.makedirs(folder)
        used = write_image(make(spark, sf_dir), f"{folder}/x.{ending}", d, widen=True)
        more = {k: v(spark, sf_dir) if callable(v) else v for k, v in read.items()}
        return read_image(spark, f"{folder}/x.{ending}", used, dims, **more)

    return image


def _codec() -> None:
    def volumes(s, d):
        return from_cells(cube(s, d, "dense").cells.select((F.col("loc") % 350).alias("loc"), F.call_function("div", F.col("loc"), F.lit(350)).cast("int").alias("elem"), "v"), (50, 7, 12), 2)

    picked = f"WITH {CUBE_SQL}, w AS (SELECT * FROM (VALUES (0, 11), (1, 2), (2, 11)) AS t(e, k)) SELECT (i + 50*j + 350*e)::BIGINT AS p, v FROM cube JOIN w USING (k)"
    for ending in ("raw", "gz", "parts"):
        got = _round_trip(volumes, StorageDescriptor("int32", offset=5 if ending == "raw" else 0), (50, 7, 12), ending, spatial=2, volumes=[12, 3, 12])
        _add(f"codec_volumes_{ending}", lambda s, d, got=got: cells(got(s, d)), picked)
    full = f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS p, {{}} AS v FROM cube"
    parts = _round_trip(lambda s, d: cube(s, d), StorageDescriptor("float64", "big"), (50, 7, 12), "parts")
    _add("codec_parts", lambda s, d: cells(parts(s, d)), full.format("v"))
    masked = _round_trip(lambda s, d: cube(s, d), StorageDescriptor("int16", layout=(-2, 3, 1)), (50, 7, 12), "gz", mask=lambda s, d: cube(s, d) > 60)
    _add("codec_masked_gzip_layout", lambda s, d: cells(masked(s, d)), f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS p, v FROM cube WHERE v > 60")
    for order in ("lsb", "msb"):
        bits = _round_trip(lambda s, d: cube(s, d, "dense") > 60, StorageDescriptor("bit", bit_order=order), (50, 7, 12))
        _add(f"codec_bits_{order}", lambda s, d, bits=bits: cells(bits(s, d), "boolean"), full.format("v > 60"))
    scaled = _round_trip(lambda s, d: cube(s, d) / 4, StorageDescriptor("int16", slope=0.5, intercept=1.0), (50, 7, 12), form="dense")
    _add("codec_scaled", lambda s, d: cells(scaled(s, d)), full.format("round_even((v / 4 - 1) / 0.5, 0) * 0.5 + 1"))


def _masks() -> None:
    grid = f"WITH {CUBE_SQL} SELECT"
    _add("nonzero", lambda s, d: elementwise.nonzero(cube(s, d, "dense") - 60), f"{grid} (i+50*j+350*k)::BIGINT AS loc FROM cube WHERE v <> 60")
    _add("mask_locations_numeric", lambda s, d: elementwise.mask_locations(cube(s, d, "dense") - 60, 4200), f"{grid} (i+50*j+350*k)::BIGINT AS loc FROM cube WHERE v <> 60")


def _of_boxes() -> None:
    _add("image_from_array", lambda s, d: cells(from_numpy(s, box(s, d).to_numpy())), f"{BOX} SELECT p, v FROM box")
    at = lambda x, keep: sparse_from_mask(x.cells.sparkSession, keep(x.to_numpy()), x.to_numpy().ravel(order="F")[keep(x.to_numpy()).ravel(order="F")])
    _add("image_from_mask", lambda s, d: cells(at(box(s, d), lambda a: a % 3 == 1)), f"{BOX} SELECT p, v FROM box WHERE v % 3 = 1")

    def from_bytes(s, d):
        a = box(s, d).to_numpy().ravel(order="F")
        stored = wide_enough("int16", a.min(), a.max())
        return cells(packed_from_bytes(s, a.astype("<" + PACKED[stored][3]).tobytes(), stored, (2, 3, 4), 0.5, 100.0))

    _add("image_from_bytes", from_bytes, f"{BOX} SELECT p, v * 0.5 + 100 AS v FROM box")
    _add("image_to_array", lambda s, d: _rows(s, v=box(s, d).reorient((3, -1, 2)).to_numpy()), f"{BOX} SELECT 'v' AS what, (k + 4*(1-i) + 8*j)::INTEGER AS k, v FROM box")

    def kinds(s, d):
        x = box(s, d)
        x = replace(x, cells=x.cells.cache())  # each form and its scaling is a job
        try:
            whole = from_cells(x.cells.withColumn("v", F.col("v").cast("int")), x.dims, 3, value_type="integer")
            forms = [x, x.as_sparse(), x.as_packed("int16", *exact_scaling(x, "int16")), x > 60, whole]
            totals = [i.view().agg(F.coalesce(F.sum(F.col("v").cast("double")), F.lit(0.0))).first()[0] for i in forms]
        finally:
            x.cells.unpersist()
        return s.createDataFrame([(k, i.is_dense, i.is_sparse, i.is_packed, i.storage_type, i.length, ",".join(map(str, i.storage_layout)), t) for k, (i, t) in enumerate(zip(forms, totals, strict=True))], "k int, dense boolean, sparse boolean, packed boolean, storage string, length int, layout string, total double")

    _add("image_kinds", kinds, f"{BOX}, t AS (SELECT sum(v) AS total, count(*) FILTER (v > 60) AS high FROM box) SELECT k, dense, sparse, packed, storage, 24 AS length, '1,2,3' AS layout, CASE WHEN k = 3 THEN high ELSE total END::DOUBLE AS total FROM t, (VALUES (0, true, false, false, 'double'), (1, false, true, false, 'double'), (2, false, false, true, 'int16'), (3, true, false, false, 'logical'), (4, true, false, false, 'integer')) AS f(k, dense, sparse, packed, storage)")

    def told(s, d):
        x = box(s, d).with_geometry(make_geometry((2, 3, 4), (1, 2.5, 3), unit="mm"))
        halves = x.as_packed("int16", 0.5, 1.0)
        forms = [x.grid, x, replace(x, spatial=2, geometry=None), (x * 1 - 20).as_sparse(), halves, x.as_packed("uint8", 1.0, 0.0).reorient((-1, 2, 3)), StorageDescriptor("int16", "big", 17, 2.0, 1.0, (2, -1, 3))]
        return s.createDataFrame([(k, n, line) for k, f in enumerate(forms) for n, line in enumerate(describe(f).split("\n"))], "k int, n int, line string")

    grid = ["  Spatial dimensions : 2 x 3 x 4", "  Voxel size         : 1 x 2.5 x 3 mm"]
    lines = [
        ["Image geometry: 2 x 3 x 4", *grid], ["Dense image: 2 x 3 x 4 (double)", *grid], ["Dense image: 2 x 3 x 4 (double)", "  Spatial dimensions : 2 x 3", "  Voxel size         : 1 x 1 (unit unknown)", "  Values per location: 4"],
        ["Sparse image: 2 x 3 x 4 (double)", *grid], ["Packed image: 2 x 3 x 4 (int16)", *grid, "  Scaling            : value = stored * 0.5 + 1", "  Storage            : 48 bytes, against 192 as double"],
        ["Packed image: 2 x 3 x 4 (uint8)", *grid, "  Storage            : 24 bytes, against 192 as double", "  Storage layout     : -1, 2, 3"], ["Storage descriptor: int16, big-endian, from byte 17", "  Scaling: value = stored * 2 + 1", "  Layout : 2, -1, 3"],
    ]
    fixed = ", ".join(f"({k}, {n}, '{x}')" for k, own in enumerate(lines) for n, x in enumerate(own))
    _add("summary_texts", told, f"{BOX}, c AS (SELECT count(*) FILTER (v <> 20) AS c FROM box) SELECT k, n, line FROM (VALUES {fixed}) AS t(k, n, line) UNION ALL SELECT 3, 3, printf('  Locations stored   : %d of 24 (%.1f%% sparse)', c, 100.0 * (24 - c) / 24) FROM c")
    _add("pack_constant", lambda s, d: cells((box(s, d) * 0 + 7.5).as_packed("int16")), f"{BOX} SELECT p, 7.5::DOUBLE AS v FROM box")
    _add("imapply_none", lambda s, d: apply.imapply(box(s, d), [2, 3], lambda x: None if x.sum() % 2 else x.sum()).select("m1", "m2", "r", "v"), f"{BOX} SELECT j::INTEGER AS m1, k::INTEGER AS m2, 0 AS r, v FROM (SELECT j, k, sum(v) AS v FROM box GROUP BY 1, 2) u WHERE v % 2 = 0")
    _add("imapply_matrix", lambda s, d: apply.imapply(box(s, d), 3, lambda x: x.T).select(F.col("m1").alias("k"), "r", "v"), f"{BOX} SELECT k::INTEGER AS k, (j + 3*i)::INTEGER AS r, v FROM box")
    _add("imapply_no_calls", lambda s, d: apply.imapply(index.extract(cube(s, d), None, [], None, drop=False), [2], lambda x: x.sum()), f"WITH {CUBE_SQL} SELECT j::INTEGER AS m1, 0 AS r, sum(v) AS v FROM cube WHERE j < 0 GROUP BY j")

    def shapes(s, d):
        x = box(s, d)
        one, _ = apply.shaped(x, [3, 1], np.sum)
        two, names = apply.shaped(x, [1], lambda v: {"a": v.min(), "b": v.max()})
        ragged, _ = apply.shaped(x, [1], lambda v: [1.0] * int(v[0, 0] % 3 + 1))
        nothing, _ = apply.shaped(x, [1], lambda v: None)
        return _rows(s, one=one, two=two, names=[names == ["a", "b"]], ragged=[sum(v) for v in ragged] if ragged.dtype == object else ragged.sum(axis=0), none=[nothing is None], dims=[*one.shape, *two.shape])

    _add("imapply_shapes", shapes, f"{BOX} SELECT 'one' AS what, (k + 4*i)::INTEGER AS k, sum(v) AS v FROM box GROUP BY i, k UNION ALL SELECT 'two', (2*i)::INTEGER, min(v) FROM box GROUP BY i UNION ALL SELECT 'two', (2*i + 1)::INTEGER, max(v) FROM box GROUP BY i UNION ALL SELECT 'ragged', i::INTEGER, v % 3 + 1 FROM box WHERE j = 0 AND k = 0 UNION ALL SELECT * FROM (VALUES ('names', 0, 1.0::DOUBLE), ('none', 0, 1), ('dims', 0, 4), ('dims', 1, 2), ('dims', 2, 2), ('dims', 3, 2)) AS t(what, k, v)")

    def backend(s, d):
        spread = apply.with_threads(cube(s, d), 4)
        parts = spread.cells.select(F.spark_partition_id().alias("part")).distinct().count()
        total = spread.cells.agg(F.sum("v")).first()[0]
        return s.createDataFrame([(apply.parallel_backend(), apply.can_fork(), apply.resolve_threads(), parts, total)], "backend string, fork boolean, unset int, parts int, total double")

    _add("backend", backend, f"WITH {CUBE_SQL} SELECT 'spark' AS backend, true AS fork, 0 AS unset, 4 AS parts, sum(v) AS total FROM cube")

    def gaps(s, d):
        x = box(s, d) / 1000
        x = replace(x, cells=x.cells.withColumn("v", F.when(F.col("loc") % 5 != 3, F.col("v"))))
        none = replace(x, cells=x.cells.withColumn("v", F.lit(None).cast("double"))).as_packed("float32")
        known = lambda v: -1 if v is None else round(float(v), 9)
        return _rows(s, spoiled=[known(summary(x, w)) for w in ("sum", "max", "all", "any")], dropped=[known(summary(x, w, na_rm=True)) for w in ("sum", "max", "prod", "mean", "all")], packed=[known(summary(none, w, na_rm=True)) for w in ("sum", "min", "mean")], sparse=[known(summary(x.as_sparse(), "mean", na_rm=True))])

    _add("summaries_with_missing", gaps, f"{BOX}, y AS (SELECT v/1000 AS v FROM box WHERE p % 5 <> 3), a AS (SELECT bool_or(v = 0) AS zero, bool_or(v <> 0) AS live, sum(v) AS s, max(v) AS m, product(v) AS q, avg(v) AS a FROM y) SELECT w.what, w.k, round(CASE w.what || w.k WHEN 'spoiled0' THEN -1 WHEN 'spoiled1' THEN -1 WHEN 'spoiled2' THEN CASE WHEN zero THEN 0 ELSE -1 END WHEN 'spoiled3' THEN CASE WHEN live THEN 1 ELSE -1 END WHEN 'dropped0' THEN s WHEN 'dropped1' THEN m WHEN 'dropped2' THEN q WHEN 'dropped3' THEN a WHEN 'dropped4' THEN CASE WHEN zero THEN 0 ELSE 1 END WHEN 'sparse0' THEN s / 24 ELSE -1 END::DOUBLE, 9) AS v FROM a, (VALUES ('spoiled', 0), ('spoiled', 1), ('spoiled', 2), ('spoiled', 3), ('dropped', 0), ('dropped', 1), ('dropped', 2), ('dropped', 3), ('dropped', 4), ('packed', 0), ('packed', 1), ('packed', 2), ('sparse', 0)) AS w(what, k)")

    def complex_rows(image: Image) -> DataFrame:
        return image.view().select((F.col("loc") + F.col("elem").cast("long") * image.n_locations).alias("p"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))

    def phase(s, d):
        x = cube(s, d, "dense")
        return from_cells(x.cells.withColumn("v", F.struct(F.col("v").alias("re"), (F.col("v") * -0.5).alias("im"))), x.dims, 3, value_type="complex")

    places = f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS p,"
    # (2 - v + v/2 i) (1 + i)
    _add("complex_operators", lambda s, d: complex_rows((2 - phase(s, d)) * (1 + 1j)), f"{places} 2 - 1.5*v AS re, 2 - 0.5*v AS im FROM cube")
    whole = lambda x: from_cells(x.cells.withColumn("v", F.col("v").cast("int")), x.dims, 3, value_type="integer")
    _add("assign_promotes", lambda s, d: cells(index.assign(whole(box(s, d)), 2.5, [2, 3])), f"{BOX} SELECT p, CASE WHEN p IN (1, 2) THEN 2.5 ELSE v END AS v FROM box")
    for kind, n in (("rgb24", 3), ("rgba32", 4)):

        def colours(s, d, n=n):
            x = cube(s, d, "dense").cells.where(F.col("loc") < 350 * n)
            return from_cells(x.select((F.col("loc") % 350).alias("loc"), F.call_function("div", F.col("loc"), F.lit(350)).cast("int").alias("elem"), (F.col("v") % 256).alias("v")), (50, 7, n), 2)

        back = _round_trip(colours, StorageDescriptor(kind), (50, 7), spatial=2)
        _add(f"codec_{kind}", lambda s, d, back=back: cells(back(s, d)), f"{places} v % 256 AS v FROM cube WHERE k < {n}")
    for kind in ("complex64", "complex128"):
        stream = _round_trip(phase, StorageDescriptor(kind, "big"), (50, 7, 12))
        _add(f"codec_{kind}", lambda s, d, stream=stream: complex_rows(stream(s, d)), f"{places} v AS re, v * -0.5 AS im FROM cube")


#: A grid for each customer: dims, voxel sizes, whether the first axis runs backwards, and where it lies.
GRIDS = """WITH g AS (SELECT c_custkey AS id, c_custkey % 50 + 2 AS n1, c_nationkey + 2 AS n2, c_custkey % 12 + 2 AS n3, (1 + c_custkey % 3)::DOUBLE AS s1, 2.5::DOUBLE AS s2, (0.5 * (1 + c_nationkey % 4))::DOUBLE AS s3,
 CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS f, c_custkey % 100 AS o1, -c_nationkey AS o2, 7 AS o3 FROM customer)"""


@dataclass(frozen=True)
class Rows:
    """What the customers of a batch say of their grids; ``g`` are the grids."""

    dims: np.ndarray
    size: np.ndarray
    world: np.ndarray

    @cached_property
    def g(self) -> Grids:
        return Grids.make(self.dims, world_transform=self.world, unit="mm")

    @staticmethod
    def of(c: np.ndarray, n: np.ndarray) -> Rows:
        size = np.stack([1.0 + c % 3, np.full(len(c), 2.5), 0.5 * (1 + n % 4)], axis=1)
        world = np.zeros((len(c), 4, 4)) + np.eye(4)
        world[:, [0, 1, 2], [0, 1, 2]] = size
        world[:, 0, 0] *= np.where(c % 2 == 0, -1, 1)
        world[:, :3, 3] = np.stack([c % 100, -n, np.full(len(c), 7)], axis=1)
        return Rows(np.stack([c % 50 + 2, n + 2, c % 12 + 2], axis=1), size, world)


def _of_grids(fun: Callable[[Rows], dict]) -> Query:
    """(id, what, k, v): each value, first axis fastest, of what ``fun`` makes of the grids of the customers, a batch at a time.

    A batch leaves Python as one array for each grid; Spark makes rows of them.
    The table is dealt to all cores first: a small file of many keys is one split.
    """

    def values(c: np.ndarray, n: np.ndarray) -> list[tuple[str, np.ndarray]]:
        found = [(what, np.asarray(v, float)) for what, v in fun(Rows.of(c, n)).items()]
        return [(what, v.transpose(0, *range(v.ndim - 1, 0, -1)).reshape(len(c), -1)) for what, v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("c_custkey")
            v = np.round(np.concatenate([v for _, v in values(ids.to_numpy(), batch.column("c_nationkey").to_numpy())], axis=1), 9) + 0.0
            ends = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))], ["id", "v"])

    def query(s: SparkSession, d: str) -> DataFrame:
        places = [(what, k) for what, v in values(np.zeros(1, np.int64), np.zeros(1, np.int64)) for k in range(v.shape[1])]
        what, k = F.array(*(F.lit(w) for w, _ in places)), F.array(*(F.lit(k) for _, k in places))
        keys = s.read.parquet(f"{d}/customer.parquet").selectExpr("cast(c_custkey as bigint) c_custkey", "cast(c_nationkey as bigint) c_nationkey")
        made = keys.repartition(2 * s.sparkContext.defaultParallelism).mapInArrow(run, "id long, v array<double>")
        return made.select("id", F.posexplode("v").alias("at", "v")).select("id", what[F.col("at")].alias("what"), k[F.col("at")].alias("k"), "v")

    return query


def _listed(**found: list[str]) -> str:
    """SQL of the same rows: an expression for each value."""
    rows = [f"SELECT id, '{what}' AS what, {k} AS k, round(({e})::DOUBLE, 9) AS v FROM g" for what, values in found.items() for k, e in enumerate(values)]
    return f"{GRIDS} " + " UNION ALL ".join(rows)


def _geometry() -> None:
    centre = ["f*s1*(n1-1)/2 + o1", "s2*(n2-1)/2 + o2", "s3*(n3-1)/2 + o3"]
    turn = ["f", "0", "0", "0", "0", "1", "0", "0", "0", "0", "1", "0", "o1", "o2", "o3", "1"]
    world = ["f*s1", "0", "0", "0", "0", "s2", "0", "0", "0", "0", "s3", "0", "o1", "o2", "o3", "1"]
    eye = [str(int(k % 5 == 0)) for k in range(16)]
    _add("geometry_accessors", _of_grids(lambda r: {"size": r.g.voxel_size, "centre": r.g.centre, "extent": r.g.extent, "axes": r.g.world_axes, "transform": r.g.world_transform}), _listed(size=["s1", "s2", "s3"], centre=centre, extent=["n1*s1", "n2*s2", "n3*s3"], axes=["f", "2", "3"], transform=world))
    _add("geometry_default", _of_grids(lambda r: (lambda g: {"size": g.voxel_size, "transform": g.world_transform, "centre": g.centre})(Grids.make(r.dims))), _listed(size=["1"] * 3, transform=eye, centre=["(n1-1)/2.0", "(n2-1)/2.0", "(n3-1)/2.0"]))
    _add("geometry_setters", _of_grids(lambda r: {"extent": r.g.with_voxel_size((1, 2, 3)).extent, "turned": r.g.with_voxel_size(4).world_transform[:, :3, 0], "moved": Grids.make(r.dims).with_transform(r.world).voxel_size}), _listed(extent=["n1", "2*n2", "3*n3"], turned=["4*f", "0", "0"], moved=["s1", "s2", "s3"]))

    def precedence(r):
        base = Grids.make(r.dims, r.size, unit="mm")
        other = np.zeros(r.world.shape) + np.diag([9.0, 8, 7, 1])
        made = [Grids.make(r.dims, template=base), Grids.make(r.dims, (5, 5, 5), template=base), Grids.make(r.dims, world_transform=other, template=base), Grids.make(r.dims, (5, 5, 5), r.world), Grids.make(r.dims)]
        return {f"g{k}": g.voxel_size for k, g in enumerate(made)} | {"unit": np.full(len(r.dims), made[2].unit == "mm")}

    _add("geometry_precedence", _of_grids(precedence), _listed(g0=["s1", "s2", "s3"], g1=["5"] * 3, g2=["9", "8", "7"], g3=["5"] * 3, g4=["1"] * 3, unit=["1"]))
    _add("geometry_same", _of_grids(lambda r: {"same": np.stack([r.g.same(g) for g in (r.g, r.g.with_voxel_size(r.size + 1e-10), r.g.with_voxel_size(1.25), replace(r.g, unit=None), replace(r.g, unit="cm"))], axis=1)}), _listed(same=["1", "1", "0", "1", "0"]))

    def decomposed(r):
        size, turned, _ = split(r.world @ np.diag([1, 1.5, 2, 1]), 3)
        shear = r.world.copy()
        shear[:, 0, 1] = 0.3
        return {"size": size, "turn": turned, "refused": split(shear, 3)[2] > 0}

    _add("geometry_decompose", _of_grids(decomposed), _listed(size=["s1", "1.5*s2", "2*s3"], turn=turn, refused=["1"]))
    _add("geometry_drop_axes", _of_grids(lambda r: {"slice": r.g.keep_axes([2]).world_transform, "plane": r.g.keep_axes([0, 2]).centre}), _listed(slice=["0", "0", "s3", "0", "f", "0", "0", "0", "0", "1", "0", "0", centre[0], centre[1], "o3", "1"], plane=centre))
    _add("geometry_inverse", _of_grids(lambda r: {"inverse": inverse(r.world)}), _listed(inverse=["f/s1", "0", "0", "0", "0", "1/s2", "0", "0", "0", "0", "1/s3", "0", "-f*o1/s1", "-o2/s2", "-o3/s3", "1"]))
    _add("geometry_permuted", _of_grids(lambda r: (lambda g: {"dims": g.dims, "centre": g.centre, "axes": g.world_axes})(r.g.permute_axes((3, -1, 2)))), _listed(dims=["n3", "n1", "n2"], centre=centre, axes=["3", "-f", "2"]))

    def drawn(r):
        lines = [bar(done, 60, float(seconds), 60) for done, _, seconds in r.dims.tolist()]
        return {"full": [x.count("=") for x in lines], "width": list(map(len, lines)), "share": [int(x.split("|")[2].split("%")[0]) for x in lines]}

    _add("progress_bar", _of_grids(drawn), _listed(full=["round_even(n1/60.0 * 33, 0)"], width=["59"], share=["round_even(n1/60.0::DOUBLE * 100, 0)"]))


def _points() -> None:
    lines = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2).cast("double").alias("x"), (F.col("l_linenumber") * 1.5).cast("double").alias("y"), (F.col("l_quantity") / 4 - 0.5).cast("double").alias("z"))
    of_lines = "WITH x AS (SELECT l_orderkey, l_linenumber, (l_quantity/2)::DOUBLE AS x, (l_linenumber*1.5)::DOUBLE AS y, (l_quantity/4.0 - 0.5)::DOUBLE AS z FROM lineitem) SELECT l_orderkey, l_linenumber,"
    _add("round_conventional", lambda s, d: points.to_voxel(lines(s, d), make_geometry((90, 90, 90)), "world", "conventional"), f"{of_lines} round_even(x, 0) + 1 AS x, round_even(y, 0) + 1 AS y, round_even(z, 0) + 1 AS z FROM x")
    wide = make_geometry((91, 109, 91), world_transform=LAS)
    _add("world_to_voxel", lambda s, d: points.to_voxel(lines(s, d), wide, "world"), f"{of_lines} (90 - x)/2 + 1 AS x, (y + 126)/2 + 1 AS y, (z + 72)/2 + 1 AS z FROM x")
    _add("world_round_trip", lambda s, d: points.from_voxel(points.to_voxel(lines(s, d), wide), wide), f"{of_lines} x, y, z FROM x")
    drawn = lambda s, d: points.to_voxel(lines(s, d).withColumn("x", F.col("l_linenumber") + 0.25).drop("y", "z"), make_geometry((90, 90, 90)), "scaled", "probabilistic")
    _add("round_probabilistic", lambda s, d: drawn(s, d).select((F.col("x") - 1 - F.col("l_linenumber")).alias("up")).agg(F.min("up").alias("least"), F.max("up").alias("most"), F.count_if(F.col("up").isin(0.0, 1.0)).alias("n"), F.avg("up").between(0.2, 0.3).alias("near")), "SELECT 0.0::DOUBLE AS least, 1.0::DOUBLE AS most, count(*) AS n, true AS near FROM lineitem")
    edge = lambda s, d, x: points.to_voxel(s.read.parquet(f"{d}/customer.parquet").select("c_nationkey", F.lit(x).alias("x")), make_geometry((4, 4, 4)), "scaled", "probabilistic")
    _add("round_at_bounds", lambda s, d: edge(s, d, 3.6).unionByName(edge(s, d, -0.4)).groupBy("c_nationkey", "x").agg(F.count(F.lit(1)).alias("n")), "SELECT c_nationkey, x, count(*) AS n FROM customer, (VALUES (4.0::DOUBLE), (1.0)) AS t(x) GROUP BY 1, 2")

    def flattened(s, d):
        axes = [L.axis_of(F.col("loc"), (50, 7, 12), k) for k in range(3)]
        return cube(s, d).cells.select("loc", *(a.cast("int").alias(n) for a, n in zip(axes, "ijk", strict=True)), L.flatten(axes, (50, 7, 12), check=True).alias("p"))

    _add("index_flatten_expand", flattened, f"WITH {CUBE_SQL} SELECT (i+50*j+350*k)::BIGINT AS loc, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, (i+50*j+350*k)::BIGINT AS p FROM sparse_cube")


for _group in (_construction, _geometry, _points, _applied, _summaries, _operators, _subscripts, _codec, _masks, _of_boxes):
    _group()
