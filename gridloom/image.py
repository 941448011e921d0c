"""Generalised images: small metadata on the driver, one lazy DataFrame of cells.

A cell is (loc, elem, v): 0-based location and element number in storage order,
first axis fastest, and the stored value. Dense images hold every cell, sparse
ones only present locations, packed ones narrow values that read as
v * slope + intercept. A layout maps the axes of the view to those of storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .functions.exact import missing
from .geometry import Geometry, keep_axes, make_geometry, permute_axes, with_transform, with_voxel_size, world_axes
from .plans import graph as G
from .plans import layout as L

#: Packed types: Spark type, least and most value (None: floating), numpy code.
PACKED = {"int8": ("tinyint", -128, 127, "i1"), "uint8": ("smallint", 0, 255, "u1"), "int16": ("smallint", -32768, 32767, "i2"), "uint16": ("int", 0, 65535, "u2"), "int32": ("int", -2147483647, 2147483647, "i4"), "float32": ("float", None, None, "f4")}
#: The next wider type of each narrow integer type.
WIDER = {"int8": "int16", "uint8": "uint16", "int16": "int32", "uint16": "int32"}
VALUE_TYPES = {"logical": "boolean", "integer": "int", "double": "double", "complex": "struct<re:double,im:double>"}
ORDER = ["logical", "integer", "double", "complex"]


@dataclass(frozen=True, eq=False)
class Image:
    cells: DataFrame
    dims: tuple[int, ...]
    spatial: int
    kind: str = "dense"  # dense, sparse or packed
    value_type: str = "double"
    geometry: Geometry | None = None
    layout: tuple[int, ...] | None = None
    stored: str | None = None  # packed type
    slope: float = 1.0
    intercept: float = 0.0
    formula: G.Formula | None = None  # how the cells come about, in storage order
    tiles: blocks.Tiles | None = None  # the cells as blocks, in view order

    def __post_init__(self):
        if not 1 <= self.spatial <= len(self.dims):
            raise ValueError("the spatial axes are the leading ones")
        if self.geometry is not None and self.geometry.dims != self.dims[: self.spatial]:
            raise ValueError("the geometry does not match the leading dimensions")
        if self.kind == "packed" and (self.stored not in PACKED or not self.slope):
            raise ValueError("a packed image has a narrow type and a slope other than zero")
        if self.kind != "packed" and self.value_type not in VALUE_TYPES:
            raise ValueError(f"images hold {', '.join(VALUE_TYPES)} values")
        layout = L.check_layout(self.layout or L.identity(len(self.dims)), len(self.dims))
        if self.kind == "sparse" and any(abs(s) != k + 1 or s < 0 for k, s in enumerate(layout) if k >= self.spatial):
            raise ValueError("the layout of a sparse image moves spatial axes only")
        object.__setattr__(self, "layout", layout)
        if self.formula is not None and self.formula.cells is not self.cells:  # other cells took their place
            object.__setattr__(self, "formula", None)
        if self.tiles is not None and (self.tiles.cells is not self.cells or tuple(a.dim for a in self.tiles.axes) != self.dims):
            object.__setattr__(self, "tiles", None)

    # -- sizes and predicates
    @property
    def n_locations(self) -> int:
        return prod(self.dims[: self.spatial])

    @property
    def n_elements(self) -> int:
        return prod(self.dims[self.spatial :])

    @property
    def length(self) -> int:
        return prod(self.dims)

    @property
    def is_dense(self) -> bool:
        return self.kind == "dense"

    @property
    def is_sparse(self) -> bool:
        return self.kind == "sparse"

    @property
    def is_packed(self) -> bool:
        return self.kind == "packed"

    @property
    def storage_type(self) -> str:
        return self.stored if self.is_packed else self.value_type

    @property
    def storage_layout(self) -> tuple[int, ...]:
        return self.layout

    @property
    def grid(self) -> Geometry:
        """The geometry, or a unit grid over up to three leading axes."""
        return self.geometry or make_geometry(self.dims[: min(3, self.spatial)])

    @property
    def voxel_size(self) -> tuple[float, ...]:
        return self.grid.voxel_size

    @property
    def world_transform(self) -> np.ndarray:
        return self.grid.world_transform

    @property
    def centre(self) -> np.ndarray:
        return self.grid.centre

    @property
    def extent(self) -> np.ndarray:
        return self.grid.extent

    @property
    def world_axes(self) -> tuple[int, ...]:
        return world_axes(self.grid)

    def with_geometry(self, geometry: Geometry) -> Image:
        """Another geometry; the representation stays."""
        return replace(self, geometry=geometry)

    def with_voxel_size(self, voxel_size) -> Image:
        return replace(self, geometry=with_voxel_size(self.grid, voxel_size))

    def with_world_transform(self, world_transform) -> Image:
        return replace(self, geometry=with_transform(self.grid, world_transform))

    def __repr__(self) -> str:
        tail = f", {self.stored} x {self.slope:g} + {self.intercept:g}" if self.is_packed else f", {self.value_type}"
        return f"<{self.kind} image {' x '.join(map(str, self.dims))}, {self.spatial} spatial{tail}{', ' + repr(self.geometry) if self.geometry else ''}>"

    # -- reading
    def value(self) -> Column:
        """The read projection of v: packed values unpacked, no arithmetic where it would change nothing."""
        v = F.col("v")
        if not self.is_packed:
            return v
        d = v.cast("double")
        d = d if self.slope == 1 else d * F.lit(self.slope)
        d = d if self.intercept == 0 else d + F.lit(self.intercept)
        return F.when(F.isnan(v), None).otherwise(d) if self.stored == "float32" else d

    def _storage_axes(self) -> list[Column]:
        dims = L.storage_dims(self.dims, self.layout)
        if all(abs(s) <= self.spatial for s in self.layout[: self.spatial]):
            space = [L.axis_of(F.col("loc"), dims[: self.spatial], k) for k in range(self.spatial)]
            return space + [L.axis_of(F.col("elem").cast("long"), dims[self.spatial :], k) for k in range(len(dims) - self.spatial)]
        number = F.col("loc") + F.col("elem").cast("long") * prod(dims[: self.spatial])
        return [L.axis_of(number, dims, k) for k in range(len(dims))]

    def axes(self) -> list[Column]:
        """0-based coordinates of the view's axes."""
        own = self._storage_axes()
        return [own[abs(s) - 1] if s > 0 else F.lit(d - 1) - own[abs(s) - 1] for s, d in zip(self.layout, self.dims, strict=True)]

    def view(self) -> DataFrame:
        """(loc, elem, v) in view order, values read; no shuffle."""
        if self.layout == L.identity(len(self.dims)):
            return self.cells.select("loc", F.col("elem").cast("int").alias("elem"), self.value().alias("v"))
        axes = self.axes()
        loc = L.flatten(axes[: self.spatial], self.dims[: self.spatial])
        elem = L.flatten(axes[self.spatial :], self.dims[self.spatial :]).cast("int")
        return self.cells.select(loc.alias("loc"), elem.alias("elem"), self.value().alias("v"))

    def locations(self) -> DataFrame:
        """Every location of the grid (loc), made in parallel."""
        return self.cells.sparkSession.range(self.n_locations).select(F.col("id").alias("loc"))

    def full_grid(self) -> DataFrame:
        n = self.n_locations
        return self.cells.sparkSession.range(self.length).select((F.col("id") % n).alias("loc"), F.call_function("div", F.col("id"), F.lit(max(1, n))).cast("int").alias("elem"))

    # -- formulas
    def origin(self) -> G.Formula:
        """The formula of the values, or the cells themselves as its one leaf; packed values are read."""
        if self.formula is not None:
            return self.formula
        plain = self.is_sparse or not self.is_packed and self.layout == L.identity(len(self.dims))
        tiles = blocks.unpacked(self.tiles, self.stored, self.slope, self.intercept) if self.tiles and self.is_packed else self.tiles
        return G.of_leaf(G.Leaf(self.cells if plain else self.view(), dense=not self.is_sparse, tiles=tiles))

    def computed(self, formula: G.Formula, kind: str, value_type: str, **more) -> Image:
        """The image of a formula over this one's grid; zeros of a sparse one are dropped, blocks stay blocks."""
        if kind == "dense" and G.tiled(formula):
            out = replace(self.of_tiles(blocks.elementwise([leaf.tiles for leaf in formula.leaves], formula.build)), value_type=value_type, **more)
            return replace(out, formula=replace(formula, cells=out.cells))
        if kind == "sparse":
            zero = F.lit(0.0)
            inner = formula
            formula = G.applied(inner, lambda v: v + zero) if value_type == "double" else inner
        cells = G.compiled(formula, self.full_grid, self.n_elements == 1)
        out = replace(self, cells=cells, kind=kind, value_type=value_type, stored=None, slope=1.0, intercept=0.0, layout=self.layout if kind == "sparse" else None, formula=None, **more)
        out = tighten(out) if kind == "sparse" else out
        return replace(out, formula=replace(formula, cells=out.cells))

    # -- blocks
    def of_tiles(self, tiles: blocks.Tiles) -> Image:
        """A dense image of this one's grid from blocks in view order."""
        return replace(self, cells=tiles.cells, tiles=tiles, kind="dense", layout=None, stored=None, slope=1.0, intercept=0.0, formula=None)

    def as_blocked(self, cells: int = blocks.TILE_CELLS) -> Image:
        """The same dense or packed image stored as tiles of about so many cells."""
        if self.is_sparse or self.value_type == "complex":
            raise ValueError("blocks hold dense and packed images of real values")
        if self.tiles is not None:
            return self
        axes = self.axes()
        raw = self.cells.select(L.flatten(axes[: self.spatial], self.dims[: self.spatial]).alias("loc"), L.flatten(axes[self.spatial :], self.dims[self.spatial :]).alias("elem"), "v")
        tiles = blocks.gathered(raw, self.dims, self.spatial, blocks.cut(self.dims, cells))
        return replace(self, cells=tiles.cells, tiles=tiles, layout=None, formula=None)

    # -- conversions
    def as_dense(self) -> Image:
        if self.is_dense:
            return self
        if self.is_packed and self.tiles:
            return replace(self.of_tiles(blocks.unpacked(self.tiles, self.stored, self.slope, self.intercept)), value_type="double")
        if self.is_packed:
            return replace(self, cells=self.view(), kind="dense", value_type="double", layout=None, stored=None, slope=1.0, intercept=0.0)
        if self.value_type != "complex" and self.layout == L.identity(len(self.dims)) and (self.formula or self.value_type == "double"):
            return self.computed(replace(self.origin(), full=True), "dense", self.value_type)
        held = self.view().withColumn("present", F.lit(True))
        zero = F.expr(f"cast({'named_struct(\"re\", 0D, \"im\", 0D)' if self.value_type == 'complex' else '0'} as {VALUE_TYPES[self.value_type]})")
        # Zero only where nothing was stored: a stored NULL stays NULL.
        cells = self.full_grid().join(held, ["loc", "elem"], "left").select("loc", "elem", F.when(F.col("present"), F.col("v")).otherwise(zero).alias("v"))
        return replace(self, cells=cells, kind="dense", layout=None)

    def as_sparse(self) -> Image:
        """Keep the locations where any value is missing or other than zero."""
        if self.is_sparse:
            return self
        dense = self.as_dense()
        return tighten(replace(dense, cells=dense.view(), kind="sparse", layout=None))

    def as_packed(self, stored: str = "float32", slope: float | None = None, intercept: float | None = None, widen: bool = False) -> Image:
        """Narrow values, half to even, clamped to the type (``widen``: in a wider type where they would be). The same type again changes nothing."""
        if self.is_packed and self.stored == stored:
            return self
        if stored not in PACKED:
            raise ValueError(f"packed types are {', '.join(PACKED)}")
        if self.value_type == "complex":
            raise ValueError("complex values can't be packed")
        dense = self.as_dense()
        kind, least, most, _ = PACKED[stored]
        a, b = slope, intercept
        if least is not None or a is None and least is not None:
            v = F.col("v").cast("double")
            bad = missing(v) | (F.abs(v) == float("inf"))
            row = blocks.value_range(dense.tiles) if dense.tiles else dense.cells.agg(F.min(F.when(~bad, v)).alias("lo"), F.max(F.when(~bad, v)).alias("hi"), F.count_if(bad).alias("bad"), F.bool_and(F.when(~bad, v == F.floor(v).cast("double"))).alias("whole")).first()
            if least is not None and row["bad"]:
                raise ValueError("integers can't hold missing or infinite values")
            if a is None:
                a, b = calibrate(stored, row["lo"], row["hi"], row["whole"])
        a, b = 1.0 if a is None else a, 0.0 if b is None else b
        if not a:
            raise ValueError("the slope may not be zero")
        if widen and least is not None:
            stored = wide_enough(stored, row["lo"], row["hi"], a, b)
            kind, least, most, _ = PACKED[stored]
        if dense.tiles:
            tiles = blocks.packed(dense.tiles, stored, PACKED[stored], float(a), float(b))
            return replace(dense, cells=tiles.cells, tiles=tiles, formula=None, kind="packed", stored=stored, slope=float(a), intercept=float(b), value_type="double")
        v = (F.col("v").cast("double") - F.lit(float(b))) / F.lit(float(a))
        if least is not None:
            v = F.least(F.greatest(F.rint(v), F.lit(float(least))), F.lit(float(most)))
        return replace(dense, cells=dense.cells.select("loc", "elem", v.cast(kind).alias("v")), kind="packed", stored=stored, slope=float(a), intercept=float(b), value_type="double")

    def reorient(self, to=(1, 2, 3)) -> Image:
        """The view whose spatial axes point along the given signed world axes; a layout change, no data moves."""
        own, n = self.world_axes, min(3, self.spatial)
        to = tuple(to)[:n]
        if sorted(map(abs, to)) != sorted(map(abs, own)):
            raise ValueError("the target must name the world axes that the image spans")
        turn = []
        for t in to:
            k = [abs(w) for w in own].index(abs(t))
            turn.append((k + 1) if own[k] * t > 0 else -(k + 1))
        turn = tuple(turn) + tuple(range(n + 1, len(self.dims) + 1))
        if turn == L.identity(len(self.dims)):
            return self
        dims = tuple(self.dims[abs(s) - 1] for s in turn)
        if self.tiles:
            tiles = self.tiles.turned(turn, self.spatial)
            return replace(self, cells=tiles.cells, tiles=tiles, dims=dims, formula=None, geometry=permute_axes(self.grid, turn[: len(self.grid.dims)]) if self.spatial <= 3 else None)
        out = replace(self, dims=dims, layout=L.compose(turn, self.layout), geometry=permute_axes(self.grid, turn[: len(self.grid.dims)]) if self.spatial <= 3 else None)
        return replace(out, cells=out.view(), layout=None) if self.is_dense else out

    def to_numpy(self, fill=np.nan) -> np.ndarray:
        """The view as an array in first-axis-fastest order; for small images."""
        got = self.as_dense().cells.toPandas()
        out = np.full(self.length, fill, dtype=object if self.value_type in ("logical", "complex") else float)
        v = got["v"].to_numpy()
        out[(got["loc"] + got["elem"] * self.n_locations).to_numpy()] = v if out.dtype == object else np.array([np.nan if x is None else x for x in v], float)
        return out.reshape(self.dims, order="F")


def wide_enough(kind: str, lo, hi, slope: float = 1.0, intercept: float = 0.0, wider: dict[str, str] = WIDER) -> str:
    """The integer type, or the first wider one, that holds values from lo to hi with a scaling; an error where none does."""
    wanted = kind
    while lo is not None:
        least, most = np.iinfo(kind).min + (kind == "int32"), np.iinfo(kind).max  # the least int32 stands for missing
        if all(least <= round((x - intercept) / slope) <= most for x in (lo, hi)):
            break
        if kind not in wider:
            raise ValueError(f"the values are out of range of {wanted} and of wider types with this scaling")
        kind = wider[kind]
    return kind


def calibrate(stored: str, lo, hi, whole) -> tuple[float, float]:
    """Slope and intercept that spread the values over the type, or (1, 0) where they fit as they are."""
    _, least, most, _ = PACKED[stored]
    if least is None or lo is None or (whole and lo >= least and hi <= most):
        return 1.0, 0.0
    if lo == hi:
        return 1.0, float(lo)
    slope = (hi - lo) / (most - least)
    return slope, lo - slope * least


def exact_scaling(image: Image, stored: str) -> tuple[float, float]:
    """Slope and intercept with which an integer type holds whole values exactly: (1, 0) where they fit, else their common step from the least one on; an error where none does."""
    _, least, most, _ = PACKED[stored]
    values = image.as_dense().cells.select(F.col("v").cast("double").alias("v"))
    row = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and(F.coalesce(F.col("v") == F.floor("v").cast("double"), F.lit(False))).alias("whole")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None or row["whole"] and lo >= least and hi <= most:
        return 1.0, 0.0
    step = 0
    if row["whole"] and max(abs(lo), abs(hi)) < 2**51:  # doubles are exact on the way

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = 0
            for batch in batches:
                found = np.gcd.reduce((batch.column("v").to_numpy() - lo).astype(np.int64), initial=found)
            yield pa.RecordBatch.from_arrays([pa.array([int(found)])], ["step"])

        step = int(np.gcd.reduce([r["step"] for r in values.mapInArrow(steps, "step long").collect()])) or 1
    if not step or (hi - lo) / step > most - least:
        raise ValueError(f"no scaling of {stored} holds these values exactly")
    return float(step), lo if (hi - lo) / step <= most else lo - step * least


def is_zero(v: Column, value_type: str) -> Column:
    if value_type == "complex":
        return (v["re"] == 0) & (v["im"] == 0)
    if value_type == "logical":
        return ~v
    return v == 0


def tighten(image: Image) -> Image:
    """Drop the locations of a sparse image where every value is zero; missing is not zero."""
    live = F.coalesce(~is_zero(F.col("v"), image.value_type), F.lit(True))
    if image.n_elements == 1:
        return replace(image, cells=image.cells.where(live))
    keep = image.cells.where(live).select("loc").distinct()
    return replace(image, cells=image.cells.join(keep, "loc", "left_semi"))


def from_cells(cells: DataFrame, dims, spatial: int | None = None, kind: str = "dense", value_type: str = "double", geometry: Geometry | None = None, **more) -> Image:
    """An image over a DataFrame of (loc, elem, v)."""
    dims = tuple(int(d) for d in dims)
    spatial = min(3, len(dims)) if spatial is None else spatial
    return Image(cells.select("loc", "elem", "v"), dims, spatial, kind, value_type, geometry, **more)


def from_numpy(spark: SparkSession, array, spatial: int | None = None, geometry: Geometry | None = None) -> Image:
    """A dense image from an array; the first axis is fastest."""
    array = np.asarray(array)
    if array.dtype.kind not in "biufc":
        raise TypeError("images hold logical, integer, double or complex values")
    if array.ndim == 0:
        array = array.reshape(1)
    kind = {"b": "logical", "i": "integer", "u": "integer", "f": "double", "c": "complex"}[array.dtype.kind]
    spatial = min(3, array.ndim) if spatial is None else spatial
    n = prod(array.shape[:spatial])
    flat = array.ravel(order="F")
    values = [(float(x.real), float(x.imag)) for x in flat] if kind == "complex" else flat.tolist()
    rows = [(i % n, i // n, x) for i, x in enumerate(values)] if n else []
    return from_cells(spark.createDataFrame(rows, f"loc long, elem int, v {VALUE_TYPES[kind]}"), array.shape, spatial, value_type=kind, geometry=geometry)


def packed_from_bytes(spark: SparkSession, raw: bytes, stored: str, dims, slope: float = 1.0, intercept: float = 0.0, spatial: int | None = None, geometry: Geometry | None = None) -> Image:
    """A packed image over the raw bytes of a narrow type."""
    code = PACKED[stored][3]
    if len(raw) != prod(dims) * np.dtype(code).itemsize:
        raise ValueError("the bytes don't fit the dimensions")
    base = from_numpy(spark, np.frombuffer(raw, code).astype(float).reshape(dims, order="F"), spatial, geometry)
    return replace(base, cells=base.cells.withColumn("v", F.col("v").cast(PACKED[stored][0])), kind="packed", stored=stored, slope=slope, intercept=intercept)


def sparse_from_mask(spark: SparkSession, mask, values, spatial: int | None = None, geometry: Geometry | None = None) -> Image:
    """A sparse image: values (elements x present locations) at the true places of a mask."""
    mask, values = np.asarray(mask, bool), np.asarray(values)
    values = values.reshape(1, -1) if values.ndim == 1 else values
    places = np.flatnonzero(mask.ravel(order="F"))
    if values.shape[1] != len(places):
        raise ValueError("there must be one column of values for each present location")
    kind = {"b": "logical", "i": "integer", "u": "integer", "f": "double", "c": "complex"}[values.dtype.kind]
    rows = [(int(p), e, (float(values[e, k].real), float(values[e, k].imag)) if kind == "complex" else values[e, k].item()) for k, p in enumerate(places) for e in range(values.shape[0])]
    dims = mask.shape + ((values.shape[0],) if values.shape[0] > 1 else ())
    return tighten(from_cells(spark.createDataFrame(rows, f"loc long, elem int, v {VALUE_TYPES[kind]}"), dims, mask.ndim if spatial is None else spatial, "sparse", kind, geometry))


def sub_geometry(image: Image, axes: list[int]) -> Geometry | None:
    """Geometry of a result over some spatial axes (0-based) of an image."""
    kept = [a for a in axes if a < image.spatial]
    return keep_axes(image.grid, kept) if kept and len(kept) == len(axes) and image.geometry is not None else None


Kernel = Callable[[Column], Column]
