"""Blocks, fused expressions, sheets, masks and first extremes against numpy and against the plain forms, and their plans."""

import uuid
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import blocks
from gridloom.fixtures import cube
from gridloom.functions.exact import INF
from gridloom.image import from_cells, from_numpy
from gridloom.operators import apply, elementwise, extremes, masks
from gridloom.operators.reduce import REDUCTIONS, imreduce
from gridloom.sources.sheets import colocate

from .conftest import DATA


def rows(df):
    return sorted((tuple("nan" if isinstance(x, float) and x != x else x for x in r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def array(rng, dims, missing=0.1):
    x = np.round(rng.normal(0, 3, dims))
    x[rng.random(dims) < missing] = np.nan
    return x


# -- blocks


def test_cuts_and_flips():
    for dims, cells in (((50, 7, 12), 400), ((5,), 100), ((1, 1, 1), 10), ((1000, 2, 3, 4), 64)):
        axes = blocks.cut(dims, cells)
        assert np.prod([a.size for a in axes]) <= cells
        for a in axes:
            for cut in (a, a.flipped()):
                j = np.arange(cut.count)
                assert cut.length(j).sum() == a.dim and (cut.length(j) > 0).all() and (np.cumsum(cut.length(j))[:-1] == cut.start(j)[1:]).all()
            assert a.flipped().flipped() == a


@pytest.mark.parametrize("dims", [(7, 5, 4), (3, 4, 2, 5)])
def test_blocks_hold_the_image(spark, dims):
    rng = np.random.default_rng(1)
    x = array(rng, dims)
    image = from_numpy(spark, x)
    blocked = image.as_blocked(11)
    assert blocked.tiles.frame.count() == np.prod(blocked.tiles.counts) and blocked.as_blocked() is blocked
    assert np.array_equal(blocked.to_numpy(), x, equal_nan=True)
    for what in REDUCTIONS:
        for margin, na_rm in (([len(dims)], False), ([2, 1], True)):
            a, b = imreduce(blocked, margin, what, na_rm), imreduce(image, margin, what, na_rm)
            near = lambda r: [tuple(round(v, 9) if isinstance(v, float) else v for v in t) for t in r]
            assert a.columns == b.columns and near(rows(a)) == near(rows(b)), (what, margin, na_rm)


def test_functions_see_blocks_in_order(spark):
    rng = np.random.default_rng(10)
    x = array(rng, (5, 4, 3, 2))
    image = from_numpy(spark, x)
    for cells in (7, 1000):
        blocked = image.as_blocked(cells)
        for margin in ([3], [2, 1], [4, 3, 2]):
            a, b = (rows(apply.imapply(i, margin, lambda v: [float(np.nansum(v * np.arange(v.size).reshape(v.shape, order="F"))), float(v.ndim)])) for i in (blocked, image))
            assert a == b
    assert rows(apply.imapply((blocked > 0), [3], lambda v: sum(x is True for x in v.ravel()), returns="int")) == rows(apply.imapply((image > 0), [3], lambda v: sum(x is True for x in v.ravel()), returns="int"))


def test_blocks_turn_without_a_shuffle(spark):
    x = np.arange(7 * 5 * 4.0).reshape(7, 5, 4, order="F")
    image = from_numpy(spark, x)
    image = replace(image, geometry=image.grid)
    blocked = image.as_blocked(11)
    for to in ((-1, 2, 3), (3, 2, 1), (-3, -1, -2), (2, -3, 1)):
        turned = blocked.reorient(to)
        assert turned.tiles is not None and np.array_equal(turned.to_numpy(), image.reorient(to).to_numpy()) and turned.geometry == image.reorient(to).geometry
        assert plan(turned.tiles.frame).count("Exchange") == plan(blocked.tiles.frame).count("Exchange")
        packed = blocked.as_packed("int16").reorient(to)
        assert packed.tiles is not None and np.array_equal(packed.to_numpy(), image.reorient(to).to_numpy())


@pytest.mark.parametrize("stored", ["int8", "uint8", "int16", "uint16", "int32", "float32"])
def test_packed_blocks(spark, stored):
    rng = np.random.default_rng(2)
    image = from_numpy(spark, np.round(rng.normal(0, 300, (6, 5, 4)), 2))
    blocked = image.as_blocked(13)
    a, b = blocked.as_packed(stored), image.as_packed(stored)
    assert a.tiles is not None and (a.slope, a.intercept) == (b.slope, b.intercept)
    assert a.cells.schema["v"].dataType == b.cells.schema["v"].dataType and rows(a.cells) == rows(b.cells)
    assert np.array_equal(a.as_dense().to_numpy(), b.as_dense().to_numpy())


def test_expressions_on_blocks_stay_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = array(rng, (7, 5, 4)), array(rng, (7, 5, 4))
    a, b = from_numpy(spark, x).as_blocked(11), from_numpy(spark, y).as_blocked(11)
    out = (a * 2 - b) ** 2 // 7 + abs(-a)
    assert out.tiles is not None and np.array_equal(out.to_numpy(), np.floor((2 * x - y) ** 2 / 7) + np.abs(x), equal_nan=True)
    assert (a > b).tiles is not None and (a + from_numpy(spark, y)).tiles is None
    both = (a + a * a - 1).tiles.frame
    assert "Join" not in plan(both)


def test_sums_of_blocks_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (24, 11, 9)) * 10.0 ** rng.integers(-12, 12, (24, 11, 9))
    blocked = from_numpy(spark, x).as_blocked(40)
    for what in ("sum", "mean", "var", "sd"):
        found = []
        for n in (1, 4, 64):
            tiles = replace(blocked.tiles, frame=blocked.tiles.frame.repartition(n))
            image = replace(blocked, cells=tiles.cells, tiles=tiles)
            found.append({tuple(r)[:-1]: r["v"].hex() for r in imreduce(image, [2], what).collect()})
        assert found[0] == found[1] == found[2]


# -- expressions


def test_an_expression_reads_its_image_once(spark):
    image = cube(spark, DATA)
    again = cube(spark, DATA)  # another reading of the same tables
    out = ((image * 3 - again) ** 2 // 7 + abs(-again)).as_dense()
    text = plan(out.cells)
    # One join is the cube's own, one puts the cells on the grid.
    assert text.count("FileScan") == 2 and text.count("Join") == 2
    x = image.to_numpy()
    assert np.array_equal(out.to_numpy(), np.floor((2 * x) ** 2 / 7) + x)


def test_different_images_meet_in_one_aggregate(spark):
    rng = np.random.default_rng(5)
    arrays = [array(rng, (6, 5, 4), 0) * (rng.random((6, 5, 4)) < 0.3) for _ in range(3)]
    a, b, c = (from_numpy(spark, x).as_sparse() for x in arrays)
    out = (a + b) * (a - c) + abs(b)
    x, y, z = arrays
    assert out.is_sparse and np.array_equal(out.to_numpy(), (x + y) * (x - z) + np.abs(y))
    assert not out.cells.where("v = 0").count()
    # Dense, packed and sparse operands; a stored missing value is not an absent one.
    holed = x.copy()
    holed[0, 0, 0] = np.nan
    d, p = from_numpy(spark, holed), from_numpy(spark, y).as_packed("int16")
    assert np.array_equal((d + b - p).to_numpy(), holed + y - y, equal_nan=True)
    assert np.array_equal(((from_numpy(spark, holed).as_sparse() - c) * 1).to_numpy(), holed - z, equal_nan=True)
    assert np.array_equal(((a + 1) - a * 2).to_numpy(), 1 - x) and np.array_equal((a.as_dense() * -1).as_sparse().to_numpy(), -x)
    one_way = (a * -1).as_dense().cells.where("v = 0").select(F.min(F.lit(1) / F.when(F.hex(F.col("v").cast("string")) == F.hex(F.lit("-0.0")), 0).otherwise(1))).first()
    assert one_way[0] == 1  # zeros come back as +0


def test_views_keep_their_layout(spark):
    rng = np.random.default_rng(6)
    x = array(rng, (4, 4, 4), 0) * (rng.random((4, 4, 4)) < 0.4)
    image = from_numpy(spark, x).as_sparse()
    turned = image.reorient((-1, 2, 3))
    assert (turned * 2 + turned).is_sparse and np.array_equal((turned * 2 + turned).to_numpy(), 3 * x[::-1])
    assert np.array_equal((turned + image).to_numpy(), x[::-1] + x)


def test_sheets_need_no_exchange(spark):
    rng = np.random.default_rng(7)
    arrays = {n: array(rng, (6, 5, 4), 0) * (rng.random((6, 5, 4)) < 0.4) for n in "abc"}
    images = {n: from_numpy(spark, x).as_sparse() if n != "c" else from_numpy(spark, x) for n, x in arrays.items()}
    held = colocate(images, f"sheet_{uuid.uuid4().hex}", 3)
    a, b, c = held["a"], held["b"], held["c"]
    for n in "abc":
        assert np.array_equal(held[n].to_numpy(), arrays[n]) and held[n].kind == images[n].kind
    x, y, z = arrays.values()
    chain = (a + b) * (a - b) + abs(a)
    assert "Exchange" not in plan(chain.cells) and "Join" not in plan(chain.cells)
    assert chain.is_sparse and np.array_equal(chain.to_numpy(), (x + y) * (x - y) + np.abs(x))
    full = c * 2 - a + b
    assert "Exchange" not in plan(full.cells) and np.array_equal(full.to_numpy(), 2 * z - x + y)
    other = colocate({"d": images["c"]}, f"sheet_{uuid.uuid4().hex}", 3)["d"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = c + other
        assert "Exchange" not in plan(joined.cells) and "SortMergeJoin" in plan(joined.cells)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert np.array_equal(joined.to_numpy(), 2 * z)


# -- first extremes


@pytest.mark.parametrize("chunk", [4, 1])
def test_first_extremes(spark, monkeypatch, chunk):
    monkeypatch.setattr(extremes, "CHUNK", chunk)
    monkeypatch.setattr(extremes, "MOST", 5)
    rng = np.random.default_rng(8)
    for density in (0.5, 0.97):
        x = np.round(rng.normal(0, 1, (5, 4, 3)))
        x[rng.random(x.shape) < 0.15] = np.nan
        x[rng.random(x.shape) < 0.1] = rng.choice([INF, -INF])
        keep = rng.random(x.shape) < density
        stored = np.where(keep, x, 0)
        sparse = from_cells(from_numpy(spark, x).cells.where(F.col("loc").isin([int(k) for k in np.flatnonzero(keep.ravel(order="F"))])), x.shape, kind="sparse")
        for image, y in ((sparse.reorient((1, 2, 3)), stored), (from_numpy(spark, x), x)):
            image = replace(image, cells=image.cells.repartition(3))
            for what, find in (("which.min", np.nanargmin), ("which.max", np.nanargmax)):
                for margin in ([3], [2, 1]):
                    call = [k for k in range(3) if k + 1 not in margin]
                    for na_rm in (False, True):
                        got = {tuple(r)[:-1]: r["v"] for r in imreduce(image, margin, what, na_rm).collect()}
                        for at in np.ndindex(*(y.shape[m - 1] for m in margin)):
                            part = y.transpose([m - 1 for m in margin] + call)[at].ravel(order="F")
                            none = np.isnan(part).all() or not na_rm and np.isnan(part).any()
                            assert got.get(at) == (None if none else find(part) + 1), (what, margin, na_rm, at)


def test_first_extremes_scan_once(spark):
    for kind in ("sparse", "dense"):
        a, b = (plan(imreduce(cube(spark, DATA, kind), [3], what)) for what in ("which.max", "sum"))
        assert a.count("FileScan") == b.count("FileScan")


# -- masks


def test_masks(spark):
    rng = np.random.default_rng(9)
    n = 64 * 5 + 17
    a, b = rng.random(n) < 0.3, rng.random(n) < 0.5
    a[:3], a[63:65], a[-1], a[64 * 2 : 64 * 3] = True, True, True, False
    made = [masks.of_locations(spark.createDataFrame([(int(k),) for k in np.flatnonzero(x) for _ in range(2)], "loc long"), n) for x in (a, b)]
    x, y = made
    listed = lambda m: [r["loc"] for r in sorted(m.locations().collect())]
    for m, want in ((x, a), (x | y, a | b), (x & y, a & b), (x - y, a & ~b), (~x, ~a)):
        assert listed(m) == np.flatnonzero(want).tolist() and m.count() == want.sum()
        assert [r["v"] for r in sorted(m.everywhere().collect())] == want.tolist()
    places = {r["loc"]: r["place"] for r in x.places(spark.range(n).withColumnRenamed("id", "loc")).collect()}
    assert places == {int(k): i for i, k in enumerate(np.flatnonzero(a))}
    back = x.located(spark.range(int(a.sum())).withColumnRenamed("id", "place")).collect()
    assert {r["place"]: r["loc"] for r in back} == {i: k for k, i in places.items()}
    packed = np.packbits(np.pad(a, (0, -n % 64)), bitorder="little").tobytes()
    held = {r["word"]: bytes(r["bytes"]) for r in x.encoded().collect()}
    assert b"".join(held.get(k, bytes(8)) for k in range(-(-n // 64))) == packed
    assert listed(masks.decoded(x.encoded(), n)) == np.flatnonzero(a).tolist()
    with pytest.raises(ValueError, match="differ"):
        x | masks.of_locations(spark.range(3).withColumnRenamed("id", "loc"), 5)


def test_masked_matrix_is_not_sorted(spark):
    image = cube(spark, DATA)
    text = plan(elementwise.masked_matrix(image))
    assert "rangepartitioning" not in text
    got = [(r["loc"], r["place"]) for r in elementwise.masked_matrix(image).collect()]
    assert sorted(got) == [(loc, k) for k, (loc, _) in enumerate(sorted(got))]


def test_masks_span_boundaries(spark, monkeypatch):
    monkeypatch.setattr(masks, "SPAN", 2)
    locs = [0, 63, 64, 200, 300, 301, 1000]
    m = masks.of_locations(spark.createDataFrame([(x,) for x in locs], "loc long"), 1001)
    assert sorted(tuple(r) for r in m.places(spark.createDataFrame([(x,) for x in [*locs, 5, 999]], "loc long")).collect()) == [(x, k) for k, x in enumerate(locs)]
