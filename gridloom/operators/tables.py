"""Subscripts and values that are rows of a table: index matrices of any length, boxes, assignment.

Nothing is listed on the driver: rows meet cells in a join or one aggregate.
Subscripts count from 1 and stand in one column for each axis.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..image import PACKED, VALUE_TYPES, Image, tighten
from ..plans import layout as L


def _place(image: Image, columns: list[str]) -> tuple[Column, Column]:
    """Location and element that a row's subscripts name; null for a null subscript, an error out of bounds."""
    if len(columns) != len(image.dims):
        raise IndexError("there must be one column of subscripts for each axis")
    at = [F.col(c).cast("long") - 1 for c in columns]
    loc = L.flatten(at[: image.spatial], image.dims[: image.spatial], check=True)
    elem = L.flatten(at[image.spatial :], image.dims[image.spatial :], check=True)
    known = F.lit(True)
    for a in at:
        known = known & a.isNotNull()
    return F.when(known, loc), F.when(known, elem).cast("int")


def extract_at(image: Image, rows: DataFrame, columns: list[str], name: str = "v") -> DataFrame:
    """``rows`` with the value at the place that each names, repeats and all; null where a subscript is null."""
    loc, elem = _place(image, columns)
    asked = rows.withColumns({"_loc": loc, "_elem": elem})
    held = image.view().select(F.col("loc").alias("_loc"), F.col("elem").alias("_elem"), F.col("v").alias("_v"), F.lit(True).alias("_held"))
    found = asked.join(held, ["_loc", "_elem"], "left")
    v = F.col("_v")
    if image.is_sparse:  # what is absent is zero
        v = F.when(F.col("_held"), v).when(F.col("_loc").isNotNull(), F.lit(0).cast(held.schema["_v"].dataType))
    return found.select(*rows.columns, v.alias(name))


def extract_boxes(image: Image, boxes: DataFrame, bounds: list[tuple[str, str]], places: list[str], name: str = "v") -> DataFrame:
    """A row for each cell of each box: the box's columns, the cell's subscripts (``places``) and value.

    ``bounds`` names the columns of the first and last subscript along each axis;
    boxes are clipped at the image's edges, and empty ones give no rows.
    """
    if len(bounds) != len(image.dims) or len(places) != len(image.dims):
        raise IndexError("there must be two bounds and a name for each axis")
    rows = boxes
    for (low, high), place, d in zip(bounds, places, image.dims, strict=True):
        first, last = F.greatest(F.col(low).cast("long"), F.lit(1)), F.least(F.col(high).cast("long"), F.lit(d))
        rows = rows.where(first <= last).withColumn(place, F.explode(F.sequence(first, last)))
    return extract_at(image, rows, places, name)


def assign_at(image: Image, rows: DataFrame, columns: list[str], value: str, order: str | None = None) -> Image:
    """The image with the values of some rows at the places that they name.

    Of several rows for one place the one that is last by ``order`` wins (without
    one, the greatest value). Rows with a null subscript assign nothing. Packed
    images keep their scaling and refuse what it can't reach; sparse ones stay sparse.
    """
    if image.value_type == "complex":
        raise TypeError("complex values can't be assigned from a table")
    loc, elem = _place(image, columns)
    kind = PACKED[image.stored][0] if image.is_packed else VALUE_TYPES[image.value_type]
    new = F.col(value).cast(kind)
    if image.is_packed:
        _, least, most, _ = PACKED[image.stored]
        y = (F.col(value).cast("double") - image.intercept) / image.slope
        if least is not None:
            y = F.rint(y)
            y = F.when(y.between(least, most), y).otherwise(F.raise_error(F.lit(f"a value is missing or out of reach of {image.stored} with this scaling")))
        new = y.cast(kind)
    given = rows.select(loc.alias("loc"), elem.alias("elem"), new.alias("v"), (F.col(order) if order else new).alias("rank")).where("loc is not null")
    last = given.groupBy("loc", "elem").agg(F.max_by("v", "rank").alias("v"))
    view = replace(image, slope=1.0, intercept=0.0, stored=None, kind="dense").view() if image.is_packed else image.view()
    parts = [view.withColumn("turn", F.lit(1)), last.withColumn("turn", F.lit(2))]
    if image.is_sparse and image.n_elements > 1:  # a location that is new has zeros elsewhere
        zeros = last.select("loc").select("loc", F.explode(F.sequence(F.lit(0), F.lit(image.n_elements - 1))).alias("elem"), F.lit(0).cast(kind).alias("v"))
        parts.append(zeros.withColumn("turn", F.lit(0)))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    cells = cells.groupBy("loc", "elem").agg(F.max_by("v", "turn").alias("v"))
    out = replace(image, cells=cells, layout=None)
    return tighten(out) if image.is_sparse else out
