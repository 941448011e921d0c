"""Exact sums against rational arithmetic, for any number of partitions."""

import math
from dataclasses import replace
from fractions import Fraction

import numpy as np
import pytest

from gridloom.image import from_cells, from_numpy
from gridloom.operators.exact_sums import LIMB, SUM, limbs, totals
from gridloom.operators.reduce import imreduce


def exact(values, what, n):
    total = sum(map(Fraction, values), Fraction(0))
    if what in ("sum", "mean"):
        return float(total if what == "sum" else total / n)
    return float((sum(Fraction(v) ** 2 for v in values) - total * total / n) / (n - 1))


def test_limbs_hold_every_bit():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 200) * 10.0 ** rng.integers(-300, 300, 200), [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, 2.0**52, -1.5]])
    for v in x:
        got = totals(np.zeros(1, np.int64), np.array([v]), True).to_pylist()
        assert sum(Fraction(r["total"]) * Fraction(2) ** (LIMB * r["limb"]) for r in got if r["kind"] == SUM) == Fraction(float(v))
        assert sum(Fraction(r["total"]) * Fraction(2) ** (LIMB * r["limb"]) for r in got if r["kind"] == 1) == Fraction(float(v)) ** 2
    assert (np.abs(limbs(np.array([-(2**54)]), np.array([31]))[1]) < 2**33).all()


@pytest.mark.parametrize("what", ["sum", "mean", "var", "sd"])
def test_exact_for_any_partitions(spark, what):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (12, 5, 4)) * 10.0 ** rng.integers(-15, 15, (12, 5, 4))
    keep = rng.random(x.shape) < 0.4
    keep[:, 3] = False  # a margin cell without anything stored
    cells = from_numpy(spark, x).cells
    held = cells.where(cells["loc"].isin([int(k) for k in np.flatnonzero(keep.ravel(order="F"))]))
    for image, y in ((from_cells(cells, x.shape), x), (from_cells(held, x.shape, kind="sparse"), np.where(keep, x, 0))):
        want = {(j,): exact(y[:, j].ravel(), "var" if what == "sd" else what, 48) for j in range(5)}
        want = {k: math.sqrt(v) for k, v in want.items()} if what == "sd" else want
        for n in (1, 7, 64):
            spread = replace(image, cells=image.cells.repartition(n))
            assert {tuple(r)[:-1]: r["v"] for r in imreduce(spread, [2], what, exact=True).collect()} == want


def test_exact_with_missing_and_infinite(spark):
    inf, nan = math.inf, math.nan
    x = np.array([[1, nan, 3], [inf, 1, 1], [inf, -inf, 1], [-inf, 0, 1], [nan, nan, nan], [2, 2, 5]])
    image = from_numpy(spark, x, 2)
    got = lambda what, na_rm: [r["v"] for r in sorted(imreduce(image, [1], what, na_rm, exact=True).collect())]
    text = lambda v: [None if a is None else str(a) for a in v]
    assert text(got("sum", False)) == text([None, inf, nan, -inf, None, 9.0])
    assert text(got("sum", True)) == text([4.0, inf, nan, -inf, 0.0, 9.0])
    assert text(got("mean", True)) == text([2.0, inf, nan, -inf, nan, 3.0])
    assert text(got("var", True)) == text([2.0, nan, nan, nan, None, 3.0])
    with pytest.raises(ValueError, match="exact"):
        imreduce(image, [1], "max", exact=True)
