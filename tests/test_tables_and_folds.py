"""Subscripts from tables, results of any type, and folds against numpy."""

import numpy as np
import pytest

from gridloom.image import from_numpy
from gridloom.operators import apply, folds, tables


def grids(spark, missing=0.1):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 4, (5, 4, 3, 2)))
    x[rng.random(x.shape) < 0.5] = 0
    x[:, :, 1] *= rng.random((5, 4, 1)) < 0.4
    x[rng.random(x.shape) < missing] = np.nan
    dense = from_numpy(spark, x)
    return x, {"dense": dense, "sparse": dense.as_sparse(), "turned": from_numpy(spark, x[::-1]).as_sparse().reorient((-1, 2, 3))}


def test_index_matrix_of_rows(spark):
    x, images = grids(spark)
    rng = np.random.default_rng(4)
    asked = [tuple(int(rng.integers(1, d + 1)) for d in x.shape) for _ in range(60)]
    asked += [asked[0]] * 3 + [(None, 1, 1, 1)]
    rows = spark.createDataFrame([(n, *a) for n, a in enumerate(asked)], "n int, a int, b long, c int, d short")
    same = lambda u, v: u is None and v is None or u == v or (u is None or u != u) and v is not None and np.isnan(v)
    for name, image in images.items():
        got = {r["n"]: r["v"] for r in tables.extract_at(image, rows, ["a", "b", "c", "d"]).collect()}
        assert len(got) == len(asked)
        for n, a in enumerate(asked):
            assert same(got[n], None if a[0] is None else float(x[tuple(k - 1 for k in a)])), (name, a)
        with pytest.raises(Exception, match="out of bounds"):
            tables.extract_at(image, spark.createDataFrame([(1, 6, 1, 1, 1)], rows.schema), ["a", "b", "c", "d"]).collect()
    with pytest.raises(IndexError):
        tables.extract_at(images["dense"], rows, ["a", "b"])


def test_boxes_are_clipped(spark):
    x = np.arange(20.0).reshape(5, 4, order="F")
    boxes = spark.createDataFrame([(1, -3, 2, 2, 9), (2, 4, 3, 1, 4), (3, 5, 5, 4, 4)], "n int, a int, b int, c int, d int")
    got = sorted(tuple(r[c] for c in ("n", "i", "j", "v")) for r in tables.extract_boxes(from_numpy(spark, x), boxes, [("a", "b"), ("c", "d")], ["i", "j"]).collect())
    assert got == sorted([(1, i, j, x[i - 1, j - 1]) for i in (1, 2) for j in (2, 3, 4)] + [(3, 5, 4, x[4, 3])])


def test_assignment_from_rows(spark):
    x, images = grids(spark, 0)
    given = [(1, 1, 1, 1, 9.0, 1), (1, 1, 1, 1, 7.0, 2), (5, 4, 3, 2, 0.0, 3), (2, 2, 2, 1, None, 4), (None, 1, 1, 1, 5.0, 5), (3, 1, 2, 2, 4.0, 6)]
    rows = spark.createDataFrame(given, "a int, b int, c int, d int, v double, at int")
    want = x.copy()
    for *a, v, _ in given:
        if a[0] is not None:
            want[tuple(k - 1 for k in a)] = np.nan if v is None else v
    for name, image in images.items():
        out = tables.assign_at(image, rows, ["a", "b", "c", "d"], "v", "at")
        assert out.kind == image.kind and np.array_equal(out.to_numpy(), want, equal_nan=True), name
    held = images["sparse"].cells.count()
    assert held % 2 == 0 and tables.assign_at(images["sparse"], rows, ["a", "b", "c", "d"], "v", "at").cells.count() % 2 == 0  # whole locations
    packed = images["dense"].as_packed("int8", 0.5, 1.0)
    out = tables.assign_at(packed, rows.where("v is not null"), ["a", "b", "c", "d"], "v", "at")
    want[1, 1, 1, 0] = x[1, 1, 1, 0]
    assert (out.stored, out.slope) == ("int8", 0.5) and np.array_equal(out.to_numpy(), want)
    with pytest.raises(Exception, match="out of reach"):
        tables.assign_at(packed, rows, ["a", "b", "c", "d"], "v", "at").cells.collect()


def test_types_of_results_are_found(spark):
    image = from_numpy(spark, np.arange(24.0).reshape(2, 3, 4))
    found = lambda fun: apply.imapply(image, [3], fun, returns=None)
    for fun, kind, want in ((lambda v: int(v.sum()), "bigint", {60, 66, 72, 78}), (lambda v: v.mean() > 11, "boolean", {True, False}), (lambda v: str(v.min()), "string", {"0.0", "1.0", "2.0", "3.0"}), (lambda v: None, "double", set())):
        out = found(fun)
        assert out.schema["v"].dataType.simpleString() == kind and {r["v"] for r in out.collect()} == want
    numbers = found(lambda v: int(v.min()) if v.min() < 2 else v.min() / 2)
    assert numbers.schema["v"].dataType.simpleString() == "double" and {r["v"] for r in numbers.collect()} == {0, 1, 1.5}
    mixed = found(lambda v: [None, float("nan"), "a"][: int(v.min())] or [True, np.int32(4)])
    assert mixed.schema["v"].dataType.simpleString() == "variant"
    got = sorted((r["m1"], r["r"], r["t"]) for r in mixed.selectExpr("m1", "r", "coalesce(cast(v as string), 'null') as t").collect())
    assert got == [(0, 0, "true"), (0, 1, "4"), (1, 0, "null"), (2, 0, "null"), (2, 1, "NaN"), (3, 0, "null"), (3, 1, "NaN"), (3, 2, "a")]
    with pytest.raises(Exception, match="not complex"):
        found(lambda v: 1j).collect()


def test_folds(spark, monkeypatch):
    monkeypatch.setattr(folds, "MOST_STATES", 2)
    x, images = grids(spark, 0)
    y, holed = grids(spark)
    first = folds.Fold(lambda: (np.inf, None), lambda s, v, at: min(s, min(((a, p) for a, p in zip(v.tolist(), at.tolist(), strict=False)), default=s)), min, lambda s: s[1])
    for name, image in images.items():
        for margin in ([3], [2, 1]):
            call = [k for k in range(4) if k + 1 not in margin]
            parts = {at: x.transpose([m - 1 for m in margin] + call)[at].ravel(order="F") for at in np.ndindex(*(x.shape[m - 1] for m in margin))}
            got = {}
            for r in folds.fold_apply(image, margin, folds.quantiles(0.1, 0.5, 1.0)).collect():
                got.setdefault(tuple(r)[: len(margin)], {})[r["r"]] = r["v"]
            assert {k: [v[i] for i in range(3)] for k, v in got.items()} == {k: np.quantile(v, [0.1, 0.5, 1.0]).tolist() for k, v in parts.items()}, name
            if name == "dense":
                places = {tuple(r)[: len(margin)]: r["v"] for r in folds.fold_apply(image, margin, first, "int").collect()}
                assert places == {k: int(v.argmin()) for k, v in parts.items()}
    assert all(r["v"] != r["v"] for r in folds.fold_apply(holed["dense"], [3], folds.quantiles(0.5)).collect())
