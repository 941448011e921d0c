"""Elementwise operators over images: arithmetic, comparison, logic, functions, masks.

A sparse image stays sparse where the operation takes zero to zero; that is
decided on the driver from the exact value at zero. Results are formulas
(plans.graph): an expression of many operators reads each image's cells once.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import BINARY, LOGICAL_RESULT, MATH, MATH_AT_ZERO, binary_at_zero, missing, round_even, signif
from ..image import Image, from_cells, from_numpy, is_zero
from ..plans import graph as G
from ..plans import layout as L
from .masks import Mask, of_locations


#: Values of an array that go to every worker.
MOST_BROADCAST = 1 << 20


def _type(op: str) -> str:
    return "logical" if op in LOGICAL_RESULT else "double"


def _stays_zero(x) -> bool:
    return x is not None and x == x and not x


Operand = Image | float | bool | complex | np.ndarray | list | None


def binary(x: Operand, op: str, y: Operand) -> Image:
    """x op y; one side at least is an image, the other an image, a number or a plain array.

    Dense arithmetic keeps geometry; dense comparison gives a bare array. A plain
    array makes the result dense; it has the image's dimensions, or is a vector
    that is recycled in storage order.
    """
    if op not in BINARY:
        raise ValueError(f"operators are {' '.join(BINARY)}")
    image = x if isinstance(x, Image) else y
    if not isinstance(image, Image):
        raise TypeError("one side must be an image")
    if np.ndim(x if image is y else y) if not (isinstance(x, Image) and isinstance(y, Image)) else 0:
        return _with_array(x, op, y)
    kinds = [getattr(o, "value_type", "complex" if isinstance(o, complex) else "") for o in (x, y)]
    if "complex" in kinds:
        return _complex(x, op, y)
    f = BINARY[op]
    if isinstance(x, Image) and isinstance(y, Image):
        return _pair(x, op, y, f)
    number = [None if o is None else float(o) for o in (x, y) if not isinstance(o, Image)][0]
    at_zero = (0.0, number) if image is x else (number, 0.0)
    sides = lambda v: f(v, F.lit(number).cast("double")) if image is x else f(F.lit(number).cast("double"), v)
    if image.is_sparse and _stays_zero(binary_at_zero(op, *at_zero)):
        return image.computed(G.applied(image.origin(), sides), "sparse", _type(op))
    keeps = image.is_sparse or op not in LOGICAL_RESULT
    dense = image.as_dense()
    return dense.computed(G.applied(dense.origin(), sides), "dense", _type(op), geometry=image.geometry if keeps else None)


def _with_array(x: Operand, op: str, y: Operand) -> Image:
    """A plain array on one side: as a dense image of the other's shape, without a geometry of its own."""
    image, array = (x, np.asarray(y)) if isinstance(x, Image) else (y, np.asarray(x))
    if array.ndim == 1 and array.shape != image.dims:
        if not array.size or array.size > image.length:
            raise ValueError("a vector is recycled over the image: it has at least one value and no more than the image")
        spark, n = image.cells.sparkSession, array.size
        values = from_numpy(spark, array, 1)
        place = (F.col("loc") + F.col("elem").cast("long") * image.n_locations) % n
        table = values.cells.select(F.col("loc").alias("at"), "v")
        table = F.broadcast(table) if n <= MOST_BROADCAST else table  # few values recycled over many cells: the cells stay where they are
        cells = image.full_grid().withColumn("at", place).join(table, "at").select("loc", "elem", "v")
        other = from_cells(cells, image.dims, image.spatial, value_type=values.value_type)
    elif array.shape == image.dims:
        other = from_numpy(image.cells.sparkSession, array, image.spatial)
    else:
        raise ValueError("the array differs from the image in dimensions")
    dense = image.as_dense()
    out = binary(dense, op, other) if image is x else binary(other, op, dense)
    keeps = image.is_sparse or op not in LOGICAL_RESULT
    return replace(out, geometry=image.geometry if keeps else None)


def _pair(x: Image, op: str, y: Image, f) -> Image:
    if x.dims != y.dims or x.spatial != y.spatial:
        raise ValueError("the images differ in dimensions")
    both_sparse = x.is_sparse and y.is_sparse and _stays_zero(binary_at_zero(op, 0.0, 0.0))
    keeps = x.is_sparse or y.is_sparse or op not in LOGICAL_RESULT
    geometry = (x.geometry or y.geometry) if keeps else None
    if both_sparse and x.layout == y.layout:
        return x.computed(G.combined(x.origin(), y.origin(), f, False), "sparse", _type(op), geometry=geometry)
    x, y = x.as_dense(), y.as_dense()
    return x.computed(G.combined(x.origin(), y.origin(), f, True), "dense", _type(op), geometry=geometry)


def _complex(x: Image, op: str, y) -> Image:
    """+ - * / == != of complex values, dense."""
    if op not in ("+", "-", "*", "/", "==", "!="):
        raise TypeError(f"complex values have no {op}")
    if not isinstance(x, Image):  # the number as an image beside y's
        grid = replace(y, cells=y.full_grid().withColumn("v", F.lit(0.0)), kind="dense", value_type="double", layout=None, stored=None, slope=1.0, intercept=0.0)
        filled = grid.cells.select("loc", "elem", F.struct(F.lit(complex(x).real).alias("re"), F.lit(complex(x).imag).alias("im")).alias("v"))
        return _complex(replace(grid, cells=filled, value_type="complex"), op, y)
    x = x.as_dense()
    part = lambda c, kind: (c["re"], c["im"]) if kind == "complex" else (c.cast("double"), F.lit(0.0))
    a = x.view().select("loc", "elem", F.col("v").alias("a"))
    if isinstance(y, Image):
        y = y.as_dense()
        rows, (br, bi) = a.join(y.view().select("loc", "elem", F.col("v").alias("b")), ["loc", "elem"]), part(F.col("b"), y.value_type)
    else:
        rows, (br, bi) = a, (F.lit(complex(y).real), F.lit(complex(y).imag))
    ar, ai = part(F.col("a"), x.value_type)
    size = br * br + bi * bi
    re, im = {"+": (ar + br, ai + bi), "-": (ar - br, ai - bi), "*": (ar * br - ai * bi, ar * bi + ai * br), "/": (F.try_divide(ar * br + ai * bi, size), F.try_divide(ai * br - ar * bi, size)), "==": (ar, ai), "!=": (ar, ai)}[op]
    equal = (ar == br) & (ai == bi)
    v = F.when(ar.isNull() | br.isNull(), None).otherwise(equal if op == "==" else ~equal if op == "!=" else F.struct(re.alias("re"), im.alias("im")))
    return replace(x, cells=rows.select("loc", "elem", v.alias("v")), value_type="logical" if op in ("==", "!=") else "complex", layout=None, geometry=None if op in ("==", "!=") else x.geometry)


def math(x: Image, name: str, digits: int | None = None) -> Image:
    """One of the mathematical functions; digits for round and signif."""
    if name not in MATH:
        raise ValueError(f"functions are {', '.join(MATH)}")
    f = MATH[name] if digits is None else {"round": lambda v: round_even(v, digits), "signif": lambda v: signif(v, digits)}[name]
    if x.is_sparse and MATH_AT_ZERO[name] == 0:
        return x.computed(G.applied(x.origin(), lambda v: f(v.cast("double"))), "sparse", "double")
    dense = x.as_dense()
    return dense.computed(G.applied(dense.origin(), lambda v: f(v.cast("double"))), "dense", "double")


def unary(x: Image, op: str) -> Image:
    """+, - (sparse stays sparse) or ! (dense)."""
    if op == "!":
        dense = x.as_dense()
        return dense.computed(G.applied(dense.origin(), lambda v: F.when(missing(v), None).otherwise(v.cast("double") == 0)), "dense", "logical")
    if op not in "+-":
        raise ValueError("unary operators are + - !")
    x = x.as_dense() if x.is_packed else x
    return x if op == "+" else x.computed(G.applied(x.origin(), lambda v: -v.cast("double")), x.kind, "double")


def is_missing(x: Image) -> Image:
    """Where values are missing, as a bare logical array."""
    dense = x.as_dense()
    return dense.computed(G.applied(dense.origin(), missing), "dense", "logical", geometry=None)


#: Python's names of the operators; the first seven also with the image on the right.
METHODS = {"+": "add", "-": "sub", "*": "mul", "/": "truediv", "^": "pow", "%%": "mod", "%/%": "floordiv", "&": "and", "|": "or", "==": "eq", "!=": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge"}


def _register() -> None:
    """Operators of images: x + y, 2 * x, x ** 2, x % 7, x // 7, x > 0, ~x for "!", abs(x), -x."""
    for op, name in METHODS.items():
        setattr(Image, f"__{name}__", lambda self, other, op=op: binary(self, op, other))
        if op not in ("==", "!=", "<", ">", "<=", ">="):
            setattr(Image, f"__r{name}__", lambda self, other, op=op: binary(other, op, self))
    Image.__hash__ = object.__hash__
    Image.__array_ufunc__ = None  # numpy leaves array + image to the image
    Image.__neg__, Image.__pos__ = (lambda self: unary(self, "-")), (lambda self: unary(self, "+"))
    Image.__invert__, Image.__abs__ = (lambda self: unary(self, "!")), (lambda self: math(self, "abs"))


_register()


# -- masks and stored data


def mask(x: Image) -> Image:
    """Which locations a sparse image holds, in view order."""
    if not x.is_sparse:
        raise TypeError("only sparse images have a mask")
    cells = bits(x).everywhere().select("loc", F.lit(0).alias("elem"), "v")
    return from_cells(cells, x.dims[: x.spatial], x.spatial, value_type="logical", geometry=x.geometry)


def bits(x: Image) -> Mask:
    """The present locations of a sparse image in view order, or those where a logical or numeric one has other than zero."""
    if x.is_sparse:
        return of_locations(x.view(), x.n_locations)
    return of_locations(x.view(), x.n_locations, F.col("v").cast("double") != 0)


def mask_locations(m: Image, n_locations: int) -> DataFrame:
    """The locations (loc) that a mask selects: logical, numeric (other than zero) or a sparse image's own."""
    if m.n_locations != n_locations:
        raise ValueError("the mask does not fit the locations")
    if m.is_sparse:
        return bits(m).locations() if m.n_elements > 1 else m.view().select("loc")
    if m.n_elements != 1:
        raise ValueError("a mask has one value for each location")
    v = m.view()
    if v.where(missing(F.col("v"))).limit(1).count():
        raise ValueError("a mask may not hold missing values")
    return v.where(F.col("v").cast("double") != 0).select("loc")


def _as_mask(rows: DataFrame) -> Mask:
    return of_locations(rows, 0)  # words need no size


def masks_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return (_as_mask(a) | _as_mask(b)).locations()


def masks_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return (_as_mask(a) & _as_mask(b)).locations()


def repack(x: Image, locations: DataFrame) -> Image:
    """A sparse image over exactly the given locations: zeros where it held none, others dropped."""
    if not x.is_sparse:
        raise TypeError("only sparse images can be repacked")
    slots = locations.select("loc", F.explode(F.sequence(F.lit(0), F.lit(x.n_elements - 1))).alias("elem"))
    held = x.cells.withColumn("present", F.lit(True))
    return replace(x, cells=slots.join(held, ["loc", "elem"], "left").select("loc", "elem", F.when(F.col("present"), F.col("v")).otherwise(F.lit(0).cast(x.cells.schema["v"].dataType)).alias("v")))


def masked_matrix(x: Image) -> DataFrame:
    """loc, place and values (array over elements) of each present location; place is its number in view order, from 0."""
    columns = x.view().groupBy("loc").agg(F.array_sort(F.collect_list(F.struct("elem", "v"))).alias("c")).select("loc", F.col("c.v").alias("values"))
    return bits(x).places(columns).select("loc", "place", "values")


def stored_values(x: Image) -> DataFrame:
    """1-based view location, element and value of all that is stored, in storage order."""
    axes = x.axes()
    place = L.flatten(axes[: x.spatial], x.dims[: x.spatial]) + 1
    return x.cells.select(place.alias("location"), "loc", "elem", x.value().alias("v")).orderBy("loc", "elem").drop("loc")


def nonzero(x: Image) -> DataFrame:
    """Locations where some value is other than zero or missing."""
    return of_locations(x.view(), x.n_locations, F.coalesce(~is_zero(F.col("v"), x.value_type), F.lit(True))).locations()
