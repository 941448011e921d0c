"""Axis arithmetic: a signed axis permutation between view and storage order.

Axis coordinates are arithmetic on the stored location and element numbers, so
changing the view is a projection that the optimizer collapses: no shuffle.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def strides(dims) -> list[int]:
    """First axis fastest."""
    return [prod(dims[:k]) for k in range(len(dims))]


def identity(n: int) -> tuple[int, ...]:
    return tuple(range(1, n + 1))


def check_layout(layout, n: int) -> tuple[int, ...]:
    layout = tuple(int(x) for x in layout)
    if sorted(map(abs, layout)) != list(range(1, n + 1)):
        raise ValueError(f"a layout names each of the {n} axes once, with a sign")
    return layout


def storage_dims(dims, layout) -> list[int]:
    out = [0] * len(dims)
    for view, signed in enumerate(layout):
        out[abs(signed) - 1] = dims[view]
    return out


def axis_of(number: Column, dims, k: int) -> Column:
    """Coordinate of axis k of a linear index over dims."""
    step, rest = prod(dims[:k]), prod(dims[k + 1 :])
    out = number if step == 1 else F.call_function("div", number.cast("long"), F.lit(step))
    return out if rest == 1 and k == len(dims) - 1 else F.pmod(out, F.lit(max(1, dims[k])))


def flatten(coordinates: list[Column], dims, check: bool = False) -> Column:
    """Linear index of some coordinates, first axis fastest; with ``check`` those out of bounds fail."""
    out, inside = F.lit(0).cast("long"), F.lit(True)
    for c, step, d in zip(coordinates, strides(dims), dims, strict=True):
        out, inside = out + (c if step == 1 else c * step), inside & (c >= 0) & (c < d)
    return F.when(inside, out.cast("long")).otherwise(F.raise_error(F.lit("an index is out of bounds"))) if check else out.cast("long")


def compose(outer, inner) -> tuple[int, ...]:
    """The layout that applies ``inner`` first: view axis k of outer is an axis of inner's view."""
    return tuple(inner[abs(s) - 1] * (1 if s > 0 else -1) for s in outer)
