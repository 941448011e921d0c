"""Arithmetic with floating-point and missing-value rules of numeric array languages.

Spark in ANSI mode raises on division by zero and knows NULL and NaN as
different things. Here: x/0 is an infinity or NaN, remainders are floored,
rounding is half to even, comparisons with NaN are missing, 1^missing is 1.
All are plain Column expressions, so they stay inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def missing(v: Column) -> Column:
    """NULL or NaN."""
    d = v.cast("double")
    return d.isNull() | F.isnan(d)


def _some_null(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull()


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(_some_null(a, b), None).when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))


def floor_divide(a: Column, b: Column) -> Column:
    q = divide(a, b)
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == INF), q).otherwise(F.floor(q).cast("double"))


def modulo(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(_some_null(a, b), None).when(b == 0, F.lit(NAN)).when(F.abs(a) == INF, F.lit(NAN)).otherwise(a - b * F.floor(F.try_divide(a, b)).cast("double"))


def power(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when((a == 1) | (b == 0), F.lit(1.0)).otherwise(F.pow(a, b))


def log(x: Column, base: float | None = None) -> Column:
    x = x.cast("double")
    out = F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))
    return out if base is None else out / F.lit(math.log(base))


def log1p(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)).otherwise(F.log1p(x))


def _compare(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(missing(a) | missing(b), None).otherwise(f(a, b))


def _logical(v: Column) -> Column:
    return F.when(missing(v), None).otherwise(v.cast("double") != 0)


def _plain(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: f(a.cast("double"), b.cast("double"))


#: The fifteen binary operators.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": _plain(lambda a, b: a + b),
    "-": _plain(lambda a, b: a - b),
    "*": _plain(lambda a, b: a * b),
    "/": divide,
    "^": power,
    "%%": modulo,
    "%/%": floor_divide,
    "==": _compare(lambda a, b: a.cast("double") == b.cast("double")),
    "!=": _compare(lambda a, b: a.cast("double") != b.cast("double")),
    "<": _compare(lambda a, b: a.cast("double") < b.cast("double")),
    ">": _compare(lambda a, b: a.cast("double") > b.cast("double")),
    "<=": _compare(lambda a, b: a.cast("double") <= b.cast("double")),
    ">=": _compare(lambda a, b: a.cast("double") >= b.cast("double")),
    "&": lambda a, b: _logical(a) & _logical(b),
    "|": lambda a, b: _logical(a) | _logical(b),
}
LOGICAL_RESULT = {"==", "!=", "<", ">", "<=", ">=", "&", "|"}


def _outside(x: Column, bad: Column, f: Column) -> Column:
    return F.when(bad, F.lit(NAN)).otherwise(f)


def signif(x: Column, digits: int = 6) -> Column:
    x = x.cast("double")
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))).cast("double"))
    return F.when(missing(x) | (x == 0) | (F.abs(x) == INF), x).otherwise(F.rint(x * scale) / scale)


def round_even(x: Column, digits: int = 0) -> Column:
    x = x.cast("double")
    return F.rint(x) if not digits else F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


#: Lanczos coefficients (g = 7, n = 9), fixed values.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _lgamma_positive(x: Column) -> Column:
    y = x - 1
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + k)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(total)


def lgamma(x: Column) -> Column:
    """log |gamma(x)|, relative error about 1e-13; infinite at 0, -1, -2, ..."""
    x = x.cast("double")
    pole = (x <= 0) & (x == F.floor(x))
    reflected = F.lit(math.log(math.pi)) - F.ln(F.abs(F.sin(F.lit(math.pi) * x))) - _lgamma_positive(1 - x)
    return F.when(missing(x), x).when(pole | (F.abs(x) == INF), F.lit(INF)).when(x < 0.5, reflected).otherwise(_lgamma_positive(x))


def gamma(x: Column) -> Column:
    x = x.cast("double")
    pole = (x <= 0) & (x == F.floor(x))
    sign = F.when((x < 0) & (F.pmod(F.floor(x), F.lit(2)) != 0), -1.0).otherwise(1.0)
    small = F.factorial(F.least(F.greatest(x - 1, F.lit(0.0)), F.lit(20.0)).cast("int")).cast("double")
    whole = (x == F.floor(x)) & (x >= 1) & (x <= 21)
    return F.when(missing(x), x).when(pole | (x == -INF), F.lit(NAN)).when(x == INF, F.lit(INF)).when(whole, small).otherwise(sign * F.exp(lgamma(x)))


#: The twenty-five mathematical functions.
MATH: dict[str, Callable[[Column], Column]] = {
    "sqrt": lambda x: _outside(x, x < 0, F.sqrt(x)),
    "abs": F.abs,
    "floor": lambda x: F.when(missing(x) | (F.abs(x) == INF), x.cast("double")).otherwise(F.floor(x).cast("double")),
    "ceiling": lambda x: F.when(missing(x) | (F.abs(x) == INF), x.cast("double")).otherwise(F.ceil(x).cast("double")),
    "trunc": lambda x: F.when(missing(x) | (F.abs(x) == INF), x.cast("double")).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")),
    "round": round_even,
    "signif": signif,
    "sin": F.sin,
    "tan": F.tan,
    "sinh": F.sinh,
    "tanh": F.tanh,
    "asin": F.asin,
    "atan": F.atan,
    "expm1": F.expm1,
    "log1p": log1p,
    "sign": F.signum,
    "exp": F.exp,
    "log": log,
    "log2": lambda x: log(x, 2.0),
    "log10": lambda x: log(x, 10.0),
    "cos": F.cos,
    "cosh": F.cosh,
    "acos": F.acos,
    "gamma": gamma,
    "lgamma": lgamma,
}

#: f(0) of each: whether a sparse image stays sparse is decided from these, without a job.
MATH_AT_ZERO = dict.fromkeys(["sqrt", "abs", "floor", "ceiling", "trunc", "round", "signif", "sin", "tan", "sinh", "tanh", "asin", "atan", "expm1", "log1p", "sign"], 0.0) | {"exp": 1.0, "cos": 1.0, "cosh": 1.0, "acos": math.pi / 2, "log": -INF, "log2": -INF, "log10": -INF, "gamma": NAN, "lgamma": INF}


def binary_at_zero(op: str, a: float | None, b: float | None):
    """The exact result of a op b for two numbers (None: missing), on the driver."""
    nan = lambda x: x is None or math.isnan(x)
    if op in ("&", "|"):
        x, y = (None if nan(v) else v != 0 for v in (a, b))
        known = [v for v in (x, y) if v is not None]
        if op == "&":
            return False if False in known else None if len(known) < 2 else True
        return True if True in known else None if len(known) < 2 else False
    if op == "^" and (a == 1 or b == 0):
        return 1.0
    if a is None or b is None:
        return None
    if op in LOGICAL_RESULT:
        if nan(a) or nan(b):
            return None
        return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if op in ("/", "%/%", "%%") and b == 0:
        return NAN if op == "%%" or a == 0 or nan(a) else math.copysign(INF, a)
    if op == "^":
        return INF if a == 0 and b < 0 else math.pow(a, b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%/%": lambda: math.floor(a / b), "%%": lambda: a - b * math.floor(a / b)}[op]()
