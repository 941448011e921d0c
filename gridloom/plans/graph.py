"""Elementwise expressions over images, kept as formulas until cells are asked for.

A formula is a function of leaves; a leaf is a column of a stored frame of cells.
However many operators stand in an expression, each frame is read once: operators
on images of the same frame are one projection, different frames are brought
together in one aggregate by cell. Frames are the same if their plans are, so two
readings of one table share theirs.

Absent cells of sparse frames are zeros. Sparse results are given +0 for -0, as
their zeros are not stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class Leaf:
    """A value column of a frame (loc, elem, ...); ``held`` names the column that says where a sparse image has it (None: in every row)."""

    frame: DataFrame
    value: str = "v"
    held: str | None = None
    dense: bool = True
    tiles: object = None  # the same cells as blocks (blocks.Tiles), if there are any

    def same(self, other: Leaf) -> bool:
        return (self.value, self.held) == (other.value, other.held) and same_frame(self.frame, other.frame)


def same_frame(a: DataFrame, b: DataFrame) -> bool:
    return a is b or a.sameSemantics(b)


@dataclass(frozen=True, eq=False)
class Formula:
    """build(values of leaves) at every cell; ``full``: of the whole grid, else where a leaf holds something."""

    leaves: tuple[Leaf, ...]
    build: Callable[[list[Column]], Column]
    full: bool
    cells: DataFrame | None = None


def tiled(formula: Formula) -> bool:
    """Whether all leaves have blocks with the same cuts."""
    first = formula.leaves[0].tiles
    return first is not None and all(leaf.tiles is not None and leaf.tiles.axes == first.axes for leaf in formula.leaves)


def of_leaf(leaf: Leaf) -> Formula:
    return Formula((leaf,), lambda v: v[0], leaf.dense)


def applied(x: Formula, f: Callable[[Column], Column]) -> Formula:
    return replace(x, build=lambda v: f(x.build(v)), cells=None)


def combined(x: Formula, y: Formula, f: Callable[[Column, Column], Column], full: bool) -> Formula:
    """f(x, y); leaves that both have are one."""
    leaves, at = list(x.leaves), []
    for leaf in y.leaves:
        found = next((k for k, known in enumerate(leaves) if leaf.same(known)), None)
        if found is None:
            found = len(leaves)
            leaves.append(leaf)
        at.append(found)
    n = len(x.leaves)
    return Formula(tuple(leaves), lambda v: f(x.build(v[:n]), y.build([v[k] for k in at])), full)


def frames(formula: Formula) -> list[tuple[DataFrame, list[int]]]:
    """The different frames and the leaves of each."""
    out: list[tuple[DataFrame, list[int]]] = []
    for k, leaf in enumerate(formula.leaves):
        held = next((ks for frame, ks in out if same_frame(frame, leaf.frame)), None)
        if held is None:
            out.append((leaf.frame, [k]))
        else:
            held.append(k)
    return out


def gathered(formula: Formula, grid: Callable[[], DataFrame], single: bool = False) -> DataFrame:
    """loc, elem, and c0, h0, c1, h1, ...: value of each leaf as double and whether it is held.

    Images of one value a location (``single``) are brought together by loc alone, so that frames that come by loc stay where they are.
    """
    key, parts = ["loc"] if single else ["loc", "elem"], []
    elem = [] if single else [F.col("elem").cast("int").alias("elem")]
    for frame, ks in frames(formula):
        held = [(F.col(formula.leaves[k].held) if formula.leaves[k].held else F.lit(True)).alias(f"h{k}") for k in ks]
        columns = [F.col(formula.leaves[k].value).cast("double").alias(f"c{k}") for k in ks]
        parts.append((frame.select("loc", *elem, *columns, *held), any(formula.leaves[k].dense for k in ks)))
    dense, sparse = [p for p, d in parts if d], [p for p, d in parts if not d]
    if len(sparse) > 1:
        # One exchange however many there are; none if all come by loc already.
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sparse)
        names = [c for c in rows.columns if c not in key]
        sparse = [rows.groupBy(*key).agg(*(F.max(c).alias(c) for c in names))]
    if not dense and formula.full:
        dense = [grid().select(*key)]
    rows = reduce(lambda a, b: a.join(b, key), dense) if dense else sparse[0]
    rows = rows.join(sparse[0], key, "left") if dense and sparse else rows
    return rows.withColumn("elem", F.lit(0)) if single else rows


def compiled(formula: Formula, grid: Callable[[], DataFrame], single: bool = False) -> DataFrame:
    """(loc, elem, v) of a formula: one projection over its gathered leaves."""
    rows = gathered(formula, grid, single)
    own = len(frames(formula)) == 1 and not (formula.full and not any(leaf.dense for leaf in formula.leaves))
    values = [F.col(f"c{k}") if leaf.dense or own and leaf.held is None else F.when(F.col(f"h{k}"), F.col(f"c{k}")).otherwise(F.lit(0.0)) for k, leaf in enumerate(formula.leaves)]
    if not formula.full and all(leaf.held for leaf in formula.leaves):
        rows = rows.where(reduce(lambda a, b: a | b, (F.col(f"h{k}") for k in range(len(formula.leaves)))))
    return rows.select("loc", "elem", formula.build(values).alias("v"))
