"""Images over the test tables: CUBE, SERIES, EVENTS, and the SQL that makes the same cells."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import make_geometry
from .image import Image, from_cells

CUBE_DIMS, SERIES_LENGTH, HOURS, DAYS = (50, 7, 12), 64, 24, 30


_TILE_CELLS: ContextVar[int | None] = ContextVar("tile_cells", default=None)


@contextmanager
def stored_in_blocks(cells: int = 400) -> Iterator[None]:
    """Dense and packed cubes made inside are stored as tiles of about so many cells."""
    token = _TILE_CELLS.set(cells)
    try:
        yield
    finally:
        _TILE_CELLS.reset(token)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str, kind: str = "sparse") -> Image:
    """Ordered quantity by part size (50), line number (7) and month (12); packed, it is of 16-bit values, or wider ones where they don't hold the quantities."""
    lines, parts = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    loc = (F.col("p_size") - 1) + 50 * (F.col("l_linenumber") - 1) + 350 * (F.month("l_shipdate") - 1)
    cells = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy(loc.cast("long").alias("loc")).agg(F.sum("l_quantity").alias("v"))
    image = from_cells(cells.select("loc", F.lit(0).alias("elem"), "v"), CUBE_DIMS, 3, "sparse", geometry=make_geometry(CUBE_DIMS, (2.0, 2.0, 3.0), unit="mm"))
    if kind == "sparse":
        return image
    out = image.as_dense() if kind == "dense" else image.as_packed("int16", 1.0, 0.0, widen=True)
    return out.as_blocked(_TILE_CELLS.get()) if _TILE_CELLS.get() else out


CUBE_SQL = """sparse_cube AS (SELECT (p_size-1) AS i, (l_linenumber-1) AS j, month(l_shipdate)-1 AS k, sum(l_quantity) AS v
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
cube AS (SELECT g%50 AS i, (g//50)%7 AS j, g//350 AS k, coalesce(v, 0) AS v FROM (SELECT unnest(range(4200)) AS g) t
 LEFT JOIN sparse_cube s ON s.i = g%50 AND s.j = (g//50)%7 AND s.k = g//350)"""


def series(spark: SparkSession, sf_dir: str) -> Image:
    """The embeddings: one spatial axis (vec_id), 64 values at each location."""
    table = _read(spark, sf_dir, "embeddings")
    n = table.agg(F.max("vec_id")).first()[0] + 1
    cells = table.select(F.col("vec_id").alias("loc"), F.posexplode("embedding").alias("elem", "v")).withColumn("v", F.col("v").cast("double"))
    return from_cells(cells, (n, SERIES_LENGTH), 1)


SERIES_SQL = "series AS (SELECT vec_id AS i, unnest(range(64)) AS e, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def events(spark: SparkSession, sf_dir: str) -> Image:
    """Event value by user, hour (spatial) and day (30 values), rounded to whole numbers; sparse."""
    table = _read(spark, sf_dir, "events")
    n = table.agg(F.max("user_id")).first()[0] + 1
    by = table.groupBy((F.col("user_id") + n * F.hour("ts")).alias("loc"), (F.dayofmonth("ts") - 1).alias("elem")).agg(F.sum(F.floor("value")).cast("double").alias("v")).where("elem < 30")
    whole = by.select("loc").distinct().select("loc", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("elem"))
    cells = whole.join(by, ["loc", "elem"], "left").select("loc", "elem", F.coalesce("v", F.lit(0.0)).alias("v"))
    return from_cells(cells, (n, HOURS, DAYS), 2, "sparse")


EVENTS_SQL = """ev AS (SELECT user_id AS u, hour(ts) AS h, day(ts)-1 AS d, sum(floor(value)) AS v FROM events WHERE day(ts) <= 30 GROUP BY 1,2,3),
evgrid AS (SELECT u, h, d, coalesce(v, 0) AS v FROM (SELECT u, h, d FROM (SELECT unnest(range((SELECT max(user_id)+1 FROM events))) AS u) a CROSS JOIN (SELECT unnest(range(24)) AS h) b CROSS JOIN (SELECT unnest(range(30)) AS d) c) g LEFT JOIN ev USING (u, h, d))"""
