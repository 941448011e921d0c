"""Built-in reductions over any set of axes.

``margin`` names the axes to keep (1-based, in result order); the rest is
reduced. Plans are Project -> partial HashAggregate -> Exchange -> final
HashAggregate, so one large group is spread over all tasks. Missing values
(NULL, NaN) spoil a result unless ``na_rm``. Absent locations of sparse images
count as zeros without being made.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import blocks
from ..functions.exact import INF, NAN, missing
from ..image import Image
from ..plans import layout as L
from .exact_sums import exact_reduce
from .extremes import first_extremes
from .masks import of_locations

REDUCTIONS = ("sum", "mean", "min", "max", "range", "prod", "var", "sd", "which.min", "which.max", "any", "all", "countNA")


def check_margin(image: Image, margin) -> list[int]:
    margin = [margin] if isinstance(margin, int) else list(margin)
    if not margin or len(set(margin)) != len(margin) or any(not 1 <= m <= len(image.dims) for m in margin):
        raise ValueError(f"a margin names different axes from 1 to {len(image.dims)}")
    return [m - 1 for m in margin]


def keyed(image: Image, margin: list[int]) -> tuple[DataFrame, list[int]]:
    """Cells as m1, m2, ... (margin coordinates), pos (1-based place among the call's cells), v; and the call's dims."""
    axes = image.axes()
    call = [k for k in range(len(image.dims)) if k not in margin]
    pos = L.flatten([axes[k] for k in call], [image.dims[k] for k in call]) + 1
    return image.cells.select(*(axes[m].cast("int").alias(f"m{i + 1}") for i, m in enumerate(margin)), pos.alias("pos"), image.value().alias("v")), [image.dims[k] for k in call]


EXACT = ("sum", "mean", "var", "sd")


def _exact(image: Image, cells: DataFrame, kept: list[int], names: list[str], what: str, na_rm: bool, n: int) -> DataFrame:
    dims = [image.dims[k] for k in kept]
    found = exact_reduce(cells.select(L.flatten([F.col(m) for m in names], dims).alias("key"), "v"), what, n, image.is_sparse, na_rm)
    out = found.select(*(L.axis_of(F.col("key"), dims, i).cast("int").alias(m) for i, m in enumerate(names)), "v", F.lit(True).alias("found"))
    if not image.is_sparse and n:
        return out.drop("found")
    # Margin cells of which nothing is stored.
    nothing = {"sum": 0.0, "mean": 0.0 if n else NAN, "var": 0.0 if n > 1 else None, "sd": 0.0 if n > 1 else None}[what]
    return _grid(image, kept, names).join(out, names, "left").select(*names, F.when(F.col("found"), F.col("v")).otherwise(F.lit(nothing).cast("double")).alias("v"))


def imreduce(image: Image, margin, what: str, na_rm: bool = False, exact: bool = False) -> DataFrame:
    """m1, m2, ... and v (for "range" also r: 0 the least, 1 the most) of every margin cell.

    With ``exact`` sums, means, variances and deviations are rounded once from
    exact totals: the same bits for any order of cells and number of partitions.
    """
    if what not in REDUCTIONS:
        raise ValueError(f"reductions are {', '.join(REDUCTIONS)}")
    if image.value_type == "complex":
        raise TypeError("complex values can't be reduced")
    kept = check_margin(image, margin)
    cells, call_dims = keyed(image, kept)
    names = [f"m{i + 1}" for i in range(len(kept))]
    n = prod(call_dims)
    tiles = image.origin().leaves[0].tiles if image.is_packed and image.tiles else image.tiles
    d = F.col("v").cast("double")
    cells = cells.withColumn("v", d)
    if exact:
        if what not in EXACT:
            raise ValueError(f"exact reductions are {', '.join(EXACT)}")
        return _exact(image, cells, kept, names, what, na_rm, n)
    ok = F.when(~missing(F.col("v")), F.col("v"))
    bad = F.count_if(missing(F.col("v"))).alias("bad")
    sparse = image.is_sparse
    if tiles and n:
        grouped = blocks.reduced(tiles, kept, what)
    elif what in ("which.min", "which.max"):
        grouped = _first_extreme(image, cells, kept, names, what, n)
    else:
        grouped = cells.groupBy(*names).agg(bad, F.count(F.lit(1)).alias("c"), *_partials(what, ok))
    if sparse or n == 0:
        grouped = _grid(image, kept, names).join(grouped, names, "left").fillna(0, ["bad", "c"])
    gap = (F.lit(n) - F.col("c")) if sparse else F.lit(0)
    out = _finish(what, gap)
    if what not in ("any", "all", "countNA") and not na_rm:
        out = [F.when(F.col("bad") > 0, None).otherwise(o) for o in out]
    elif what in ("any", "all"):
        decided, default = (out[0], False) if what == "any" else (~out[0], True)
        out = [F.when(decided, F.lit(not default)).when((F.col("bad") > 0) & F.lit(not na_rm), None).otherwise(F.lit(default))]
    if what == "range":
        pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("r"), o.alias("v")) for i, o in enumerate(out))))
        return grouped.select(*names, pairs.alias("p")).select("p.r", *names, "p.v")
    return grouped.select(*names, out[0].alias("v"))


def _grid(image: Image, kept: list[int], names: list[str]) -> DataFrame:
    dims = [image.dims[k] for k in kept]
    number = F.col("id")
    return image.cells.sparkSession.range(prod(dims)).select(*(L.axis_of(number, dims, i).cast("int").alias(n) for i, n in enumerate(names)))


def _partials(what: str, ok: Column) -> list[Column]:
    return {
        "sum": [F.sum(ok).alias("a")],
        "mean": [F.sum(ok).alias("a"), F.count(ok).alias("k")],
        "min": [F.min(ok).alias("a")],
        "max": [F.max(ok).alias("b")],
        "range": [F.min(ok).alias("a"), F.max(ok).alias("b")],
        "prod": [F.product(ok).alias("a")],
        "var": [F.var_pop(ok).alias("a"), F.avg(ok).alias("b"), F.count(ok).alias("k")],
        "sd": [F.var_pop(ok).alias("a"), F.avg(ok).alias("b"), F.count(ok).alias("k")],
        "any": [F.bool_or(ok != 0).alias("a")],
        "all": [F.bool_and(ok != 0).alias("a")],
        "countNA": [],
    }[what]


def _finish(what: str, gap: Column) -> list[Column]:
    """Results from the partials; gap: absent cells, which are zeros."""
    a, b, zeros = F.col("a"), F.col("b"), gap > 0
    if what == "sum":
        return [F.coalesce(a, F.lit(0.0))]
    if what == "mean":
        k = F.coalesce(F.col("k"), F.lit(0)) + gap
        return [F.when(k > 0, F.try_divide(F.coalesce(a, F.lit(0.0)), k)).otherwise(F.lit(NAN))]
    least = F.coalesce(F.when(zeros, F.least(a, F.lit(0.0))).otherwise(a), F.lit(INF))
    most = F.coalesce(F.when(zeros, F.greatest(b, F.lit(0.0))).otherwise(b), F.lit(-INF))
    if what in ("min", "max", "range"):
        return {"min": [least], "max": [most], "range": [least, most]}[what]
    if what == "prod":
        return [F.when(zeros, F.coalesce(a * 0, F.lit(0.0))).otherwise(F.coalesce(a, F.lit(1.0)))]
    if what in ("var", "sd"):
        k = F.coalesce(F.col("k"), F.lit(0))
        total = k + gap
        # Squares about the mean of what is stored, merged with a block of zeros.
        squares = F.coalesce(a, F.lit(0.0)) * k + F.coalesce(b * b * F.try_divide(k.cast("double") * gap, total), F.lit(0.0))
        var = F.when(total > 1, F.try_divide(F.greatest(squares, F.lit(0.0)), total - 1))
        return [var if what == "var" else F.sqrt(var)]
    if what == "any":
        return [F.coalesce(a, F.lit(False))]
    if what == "all":
        return [F.when(zeros, False).otherwise(F.coalesce(a, F.lit(True)))]
    if what == "countNA":
        return [F.col("bad").cast("int")]
    return [F.when((gap > 0) & (F.col("c") == 0), 1).otherwise(F.col("a")).cast("int")]


def _first_extreme(image: Image, cells: DataFrame, kept: list[int], names: list[str], what: str, n: int) -> DataFrame:
    """bad, c, a (1-based first place of the extreme) of each margin cell."""
    dims = [image.dims[k] for k in kept]
    keyed = cells.select(L.flatten([F.col(m) for m in names], dims).alias("key"), "pos", "v")
    found = first_extremes(keyed, what == "which.min", n, image.is_sparse)
    return found.select(*(L.axis_of(F.col("key"), dims, i).cast("int").alias(m) for i, m in enumerate(names)), "bad", "c", "a")


def line_sums(image: Image, axis: int) -> DataFrame:
    """Sums along one axis; missing values spread."""
    return imreduce(image, [k + 1 for k in range(len(image.dims)) if k != axis - 1], "sum")


def _totals(image: Image):
    """One aggregate over the stored cells that all summaries come from."""
    d = F.when(~missing(image.value()), image.value().cast("double"))
    return image.cells.agg(F.count(F.lit(1)).alias("c"), F.count(d).alias("k"), F.sum(d).alias("sum"), F.min(d).alias("min"), F.max(d).alias("max"), F.product(d).alias("prod"), F.bool_or(d != 0).alias("any"), F.bool_and(d != 0).alias("all")).first()


SUMMARIES = ("sum", "mean", "min", "max", "range", "any", "all", "prod")


def summaries(image: Image, na_rm: bool = False) -> dict:
    """All summaries from one pass."""
    row = _totals(image)
    return {what: _summary(image, row, what, na_rm) for what in SUMMARIES}


def summary(image: Image, what: str, na_rm: bool = False):
    """One value for the whole image: sum, mean, min, max, range, any, all, prod.

    Sparse images: the stored values and one zero if any location is absent; a
    sparse mean divides by the full length. Packed images with nothing usable
    give None.
    """
    return _summary(image, _totals(image), what, na_rm)


def _summary(image: Image, row, what: str, na_rm: bool):
    bad, absent = row["c"] - row["k"], image.length - row["c"] if image.is_sparse else 0
    zero = [0.0] if absent else []
    if what == "any":
        return True if row["any"] else None if bad and not na_rm else False
    if what == "all":
        return False if row["all"] is False or absent else None if bad and not na_rm else True
    if bad and not na_rm or image.is_packed and not row["k"]:
        return None
    if what == "sum":
        return row["sum"] or 0.0
    if what == "prod":
        return (1.0 if row["prod"] is None else row["prod"]) * (0.0 if absent else 1.0)
    if what == "mean":
        n = image.length if image.is_sparse else row["k"]
        return (row["sum"] or 0.0) / n if n else NAN
    low, high = min([x for x in (row["min"],) if x is not None] + zero, default=INF), max([x for x in (row["max"],) if x is not None] + zero, default=-INF)
    return {"min": low, "max": high, "range": (low, high)}[what]


def sparseness(image: Image) -> float:
    """Sparse: the share of absent locations; else the share of zero values."""
    if image.is_sparse:
        return 1 - of_locations(image.cells, image.n_locations).count() / image.n_locations
    return image.cells.agg(F.count_if(image.value() == 0)).first()[0] / image.length
