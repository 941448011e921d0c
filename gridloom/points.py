"""Points between world, scaled and voxel (1-based) coordinates, as column arithmetic; rounding of points.

World and scaled points are rounded while they are 0-based, so an exact half goes
to the even one of the 0-based neighbours; then 1 is added. Voxel points are taken
and rounded as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import Geometry, affine_inverse

TYPES = ("world", "scaled", "voxel")


def _affine(matrix: np.ndarray, cols: list, n: int) -> list:
    cols = [*cols, *[F.lit(0.0)] * (3 - len(cols))]
    return [sum((c * F.lit(float(m)) for c, m in zip(cols, matrix[k, :3], strict=True)), F.lit(float(matrix[k, 3]))) for k in range(n)]


def round_points(cols: list[Column], rounding: str, bounds: Sequence[float] | None = None, seed: int = 0) -> list[Column]:
    """conventional: half to even. probabilistic: one of the two neighbours, the nearer the likelier; never below 0, never up to a bound."""
    if rounding == "none":
        return cols
    if rounding == "conventional":
        return [F.rint(c) for c in cols]
    out = []
    for k, c in enumerate(cols):
        low, high = F.floor(c).cast("double"), F.ceil(c).cast("double")
        down = (F.rand(seed + k) > c - low) & (low >= 0)
        if bounds is not None and k < len(bounds):
            down = down | (high >= F.lit(float(bounds[k])))
        out.append(F.when(down, low).otherwise(high))
    return out


def to_voxel(points: DataFrame, g: Geometry, kind: str = "world", rounding: str = "none", bounds: Sequence[float] | None = None, seed: int = 0, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Replace coordinate columns (1 to 3) by voxel coordinates. rounding: none, conventional, probabilistic; bounds are the grid's dimensions where none are given."""
    if kind not in TYPES or rounding not in ("none", "conventional", "probabilistic"):
        raise ValueError("points are world, scaled or voxel; rounding is none, conventional or probabilistic")
    names = [c for c in columns if c in points.columns]
    cols = [F.col(c).cast("double") for c in names]
    if kind == "world":
        cols = _affine(affine_inverse(g.world_transform), cols, 3)[: len(names)]
    elif kind == "scaled":
        cols = [c / F.lit(s) for c, s in zip(cols, [*map(float, g.voxel_size), 1.0, 1.0], strict=False)]
    cols = round_points(cols, rounding, g.dims[:3] if bounds is None else bounds, seed)
    if kind != "voxel":
        cols = [c + 1 for c in cols]
    return points.select(*(F.col(c) for c in points.columns if c not in names), *(c.alias(n) for c, n in zip(cols, names, strict=True)))


def from_voxel(points: DataFrame, g: Geometry, kind: str = "world", columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Voxel coordinates (1-based) to world (always three columns) or scaled ones."""
    if kind not in TYPES:
        raise ValueError("points are world, scaled or voxel")
    names = [c for c in columns if c in points.columns]
    cols = [F.col(c).cast("double") - 1 for c in names]
    if kind == "world":
        cols, names_out = _affine(g.world_transform, cols, 3), list(columns)
    elif kind == "scaled":
        cols, names_out = [c * F.lit(float(s)) for c, s in zip(cols, g.voxel_size, strict=False)], names
    else:
        cols, names_out = [F.col(c).cast("double") for c in names], names
    return points.select(*(F.col(c) for c in points.columns if c not in names), *(c.alias(n) for c, n in zip(cols, names_out, strict=True)))
