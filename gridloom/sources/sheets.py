"""Co-located images: several images of one grid stored side by side, a row for each cell.

A sheet is a table bucketed and sorted by location. Operators on images of one
sheet are projections of it, with no join and no exchange; two sheets with as
many buckets are joined bucket by bucket.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ..image import Image
from ..plans import graph as G


def colocate(images: dict[str, Image], table: str, buckets: int = 16) -> dict[str, Image]:
    """Store images of the same dimensions as the sheet ``table`` (a catalog table) and return them as read from it.

    Values become doubles; sparse images stay sparse. The sheet holds the cells
    that any of the images holds.
    """
    names, first = list(images), next(iter(images.values()))
    if any((x.dims, x.spatial) != (first.dims, first.spatial) for x in images.values()):
        raise ValueError("images of a sheet have the same dimensions")
    if any(x.is_sparse and x.layout != first.layout for x in images.values()) or any(x.value_type == "complex" for x in images.values()):
        raise ValueError("images of a sheet are real and have one layout")
    plain = [x if x.is_sparse else x.as_dense() for x in images.values()]
    # The stored cells are what is gathered: a formula of them as they are.
    leaves = tuple(G.Leaf(x.cells if x.is_sparse else x.view(), dense=not x.is_sparse) for x in plain)
    rows = G.gathered(G.Formula(leaves, lambda v: v[0], False), first.full_grid, first.n_elements == 1)
    held = [F.coalesce(f"h{k}", F.lit(False)) for k in range(len(names))]
    columns = [c for k, n in enumerate(names) for c in (F.col(f"c{k}").alias(n), held[k].alias(f"{n}_held"))]
    rows.where(reduce(lambda a, b: a | b, held)).select("loc", "elem", *columns).write.bucketBy(buckets, "loc").sortBy("loc").saveAsTable(table)
    sheet = first.cells.sparkSession.table(table)
    return {n: sheet_image(sheet, n, x) for n, x in zip(names, plain, strict=True)}


def sheet_image(sheet, name: str, like: Image) -> Image:
    """The image ``name`` of a sheet, with the grid of another image."""
    if like.is_packed:
        raise ValueError("a sheet holds dense and sparse images")
    cells = sheet.where(F.col(f"{name}_held")).select("loc", "elem", F.col(name).alias("v"))
    formula = G.Formula((G.Leaf(sheet, name, f"{name}_held", dense=like.is_dense),), lambda v: v[0], like.is_dense, cells)
    return replace(like, cells=cells, value_type="double", formula=formula)
