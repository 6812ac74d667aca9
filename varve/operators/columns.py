"""Tensor arithmetic as Catalyst expressions over ``array`` columns.

A lane is a column of array<float> or array<double>. Values that a lambda would
compute again for every element are bound once by ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Spark's name of the element type by dtype.
SQL = {"f32": "float", "f64": "double"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once."""
    return F.transform(F.array(value), body)[0]


def num(x: float, dtype: str) -> Column:
    return F.lit(float(x)).cast(SQL[dtype])


def each(lane: Column, f: Callable[[Column], Column], dtype: str) -> Column:
    return F.transform(lane, lambda x: f(x).cast(SQL[dtype]))


def total(lane: Column) -> Column:
    """Sum in double precision."""
    return F.aggregate(lane, F.lit(0.0).cast("double"), lambda a, x: a + x)


def has_nan(lane: Column) -> Column:
    return F.exists(lane, lambda x: F.isnan(x))


def least(lane: Column, dtype: str) -> Column:
    """NaN wins; +inf for none."""
    return F.when(has_nan(lane), num(NAN, dtype)).otherwise(F.coalesce(F.array_min(lane), num(INF, dtype)))


def greatest(lane: Column, dtype: str) -> Column:
    """NaN wins; -inf for none. Spark's own maximum already puts NaN last."""
    return F.coalesce(F.array_max(lane), num(-INF, dtype))


def divided(a: Column, b: Column) -> Column:
    """IEEE division under either ANSI setting."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when((a > 0) == (F.signum(F.lit(1.0) * b) >= 0), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    from ..functions.nn import ERF_A, ERF_P

    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly: Column = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def gelu_tanh(x: Column) -> Column:
    return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(F.lit(0.7978845608028654) * (x + F.lit(0.044715) * x * x * x)))


#: Element-wise actions without arguments: expression of one element.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "sign": lambda x: F.when(F.isnan(x), x).otherwise(F.signum(x) + F.lit(0.0)),
    "neg": lambda x: -x,
    "sqrt": lambda x: F.when(F.isnan(x) | (x > 0), F.sqrt(x)).otherwise(F.lit(0.0)),
    "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "tanh": F.tanh,
    "relu": lambda x: F.when(F.isnan(x) | (x > 0), x).otherwise(F.lit(0.0)),
    "sigmoid": sigmoid,
    "silu": lambda x: x * sigmoid(x),
}


def softmax(lane: Column, dtype: str, log: bool = False) -> Column:
    def shifted(m: Column) -> Column:
        e = F.transform(lane, lambda x: F.exp(x.cast("double") - m))
        if log:
            return let(m + F.ln(total(e)), lambda s: each(lane, lambda x: x - s, dtype))
        return let(e, lambda p: let(total(p), lambda s: each(p, lambda x: x / s, dtype)))

    return let(greatest(lane, dtype).cast("double"), shifted)


def mean(lane: Column) -> Column:
    return F.when(F.size(lane) > 0, total(lane) / F.size(lane)).otherwise(F.lit(0.0))


def variance(lane: Column, unbiased: bool) -> Column:
    n = F.size(lane)
    by = F.greatest(n - 1, F.lit(1)) if unbiased else n
    squares = let(mean(lane), lambda m: F.aggregate(lane, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.when(n > 0, squares / by).otherwise(F.lit(0.0))


def layer_norm(lane: Column, eps: float, dtype: str) -> Column:
    stats = F.struct(mean(lane).alias("m"), (F.lit(1.0) / F.sqrt(variance(lane, False) + F.lit(eps))).alias("r"))
    return let(stats, lambda s: each(lane, lambda x: (x - s["m"]) * s["r"], dtype))


def rms_norm(lane: Column, eps: float, dtype: str) -> Column:
    square = F.aggregate(lane, F.lit(0.0), lambda a, x: a + x * x) / F.size(lane)
    return let(F.lit(1.0) / F.sqrt(square + F.lit(eps)), lambda r: each(lane, lambda x: x * r, dtype))


def norm(lane: Column, p: float) -> Column:
    if p == INF:
        return F.coalesce(F.array_max(F.transform(lane, lambda x: F.abs(x).cast("double"))), F.lit(0.0))
    if p == 2:
        return F.sqrt(F.aggregate(lane, F.lit(0.0), lambda a, x: a + x * x))
    if p == 1:
        return F.aggregate(lane, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.pow(F.aggregate(lane, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(p))), F.lit(1 / p))


def position(lane: Column, largest: bool) -> Column:
    """Index of the first extreme; the first NaN wins."""
    pick = F.array_max(lane) if largest else F.array_min(lane)
    nan = F.array_position(F.transform(lane, lambda x: F.isnan(x)), True)
    return (F.when(nan > 0, nan).otherwise(F.array_position(lane, pick)) - 1).cast("int")


def cumsum(lane: Column, dtype: str) -> Column:
    empty = F.array().cast(f"array<{SQL[dtype]}>")
    step = lambda a, x: F.concat(a, F.array((F.coalesce(F.try_element_at(a, F.lit(-1)), num(0, dtype)) + x).cast(SQL[dtype])))
    return F.aggregate(lane, empty, step)


def gather(lane: Column, indices: list[int], dtype: str, whole: int = 0) -> Column:
    """lane[i] for each index; runs are slices, or all if the lane has ``whole``."""
    if not indices:
        return F.array().cast(f"array<{SQL[dtype]}>")
    if indices == list(range(indices[0], indices[0] + len(indices))):
        return lane if whole == len(indices) else F.slice(lane, indices[0] + 1, len(indices))
    return let(lane, lambda x: F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(x, i)))
