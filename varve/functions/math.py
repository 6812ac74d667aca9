"""Element-wise arithmetic."""

from __future__ import annotations

import numpy as np

from ..registry import Args, action
from ..types import ExecutionError, TypeMismatch, Value, fractional, is_float, promote

PACK = "math_basics"
PLAIN = "tensor scalar"


def operands(v: Value) -> tuple[Value, Value]:
    if len(v.items) != 2 or any(i.kind not in ("tensor", "scalar") for i in v.items):
        raise TypeMismatch("two tensors or scalars are needed")
    return v.items[0], v.items[1]


def binary(name: str, names: tuple[str, ...], default: int, floats, ints, pair=None, to_float: bool = False):
    """Register x <op> v for a number argument, and a <op> b for a composite."""

    def result(t, args):
        if t[0] == "composite":
            d = promote(t[1][0][1], t[1][1][1])
            kinds = {i[0] for i in t[1]}
            return ("scalar" if kinds == {"scalar"} else "tensor", fractional(d) if to_float else d)
        return (t[0], fractional(t[1]) if to_float else t[1])

    @action(PACK, name, PLAIN + " composite", result)
    def kernel(v: Value, args: Args) -> Value:
        if v.kind == "composite":
            if args.text(*names, at=0) is not None:
                raise ExecutionError("a composite takes no number as well")
            a, b = operands(v)
            d = promote(a.dtype, b.dtype)
            if to_float:
                d = fractional(d)
            try:
                out = (pair or (floats if is_float(d) else ints))(a.data.astype(d), b.data.astype(d))
            except ValueError as e:
                raise ExecutionError(f"shapes {a.shape} and {b.shape} don't broadcast") from e
            return Value("scalar" if a.kind == b.kind == "scalar" else "tensor", np.asarray(out, d))
        d = v.dtype
        if is_float(d):
            x = d.type(args.number(*names, at=0, default=float(default), dtype=d.type))
            return v.with_data(np.asarray(floats(v.data, x), d))
        if to_float:
            x = args.number(*names, at=0, default=float(default))
            return v.with_data(np.asarray(floats(v.data.astype("f8"), np.float64(x)), "f8"))
        x = args.whole(*names, at=0, default=default, dtype=d)
        return v.with_data(np.asarray(ints(v.data, d.type(x)), d))

    return kernel


def _divide(x, y):
    if np.ndim(y) == 0 and isinstance(y, np.generic):
        if y == 0:
            raise ExecutionError("division by zero")
        # single precision multiplies by the reciprocal
        return x * (np.float32(1) / y) if x.dtype == np.float32 else x / y
    return x / y


def _int_power(x, y):
    y = np.asarray(y)
    if (y < 0).any():
        raise ExecutionError("integers take no negative exponent")
    x, y = np.broadcast_arrays(np.asarray(x), y)
    out, base, left = np.ones_like(x), x.copy(), y.astype("u8")
    while left.any():
        out = np.where(left & np.uint64(1), out * base, out).astype(x.dtype)
        base = (base * base).astype(x.dtype)
        left = left >> np.uint64(1)
    return out


_AMOUNT = ("value", "val", "scalar", "amount")
binary("add", _AMOUNT, 0, np.add, np.add)
binary("sub", _AMOUNT, 0, np.subtract, np.subtract)
binary("mul", ("value", "val", "scalar", "factor", "amount"), 1, np.multiply, np.multiply)
binary("div", ("value", "val", "scalar", "by", "amount"), 1, _divide, None, np.divide, to_float=True)
binary("pow", ("exponent", "power"), 1, np.power, _int_power)


def same(t, args):
    return t


def as_fraction(t, args):
    return (t[0], fractional(t[1]))


@action(PACK, "clamp", PLAIN, same)
def clamp(v: Value, args: Args) -> Value:
    """min(max(x, lo), hi); a NaN in x or a bound stays."""
    d = v.dtype
    out = v.data
    for bound, at, pick in (("min", 0, np.maximum), ("max", 1, np.minimum)):
        if args.text(bound, at=at) is None:
            continue
        x = args.number(bound, at=at, dtype=d.type) if is_float(d) else args.whole(bound, at=at, default=0, dtype=d)
        if x is not None:
            out = pick(out, d.type(x))
    return v.with_data(np.asarray(out, d))


def unary(name: str, f, keeps: bool = True):
    @action(PACK, name, PLAIN, same if keeps else as_fraction)
    def kernel(v: Value, args: Args) -> Value:
        x = v.data if keeps else v.data.astype(fractional(v.dtype))
        return v.with_data(np.asarray(f(x), x.dtype))

    return kernel


unary("abs", np.abs)
unary("sign", lambda x: np.sign(x) + x.dtype.type(0))
unary("neg", np.negative)
unary("sqrt", lambda x: np.where(np.isnan(x), x, np.sqrt(np.maximum(x, 0))), keeps=False)
unary("exp", np.exp, keeps=False)
unary("sin", np.sin, keeps=False)
unary("cos", np.cos, keeps=False)
unary("tan", np.tan, keeps=False)


@action(PACK, "rsqrt", PLAIN, as_fraction)
def rsqrt(v: Value, args: Args) -> Value:
    x = v.data.astype(fractional(v.dtype))
    t = x.dtype.type
    eps = t(args.number("eps", at=0, default=1e-8, dtype=t))
    return v.with_data(np.asarray(t(1) / np.sqrt(np.maximum(x + eps, eps)), x.dtype))


@action(PACK, "log", PLAIN, as_fraction)
def log(v: Value, args: Args) -> Value:
    x = v.data.astype(fractional(v.dtype))
    t = x.dtype.type
    eps = t(args.number("eps", default=1e-8, dtype=t))
    f = {"2": np.log2, "10": np.log10}.get((args.text("base", at=0) or "e").strip(), np.log)
    return v.with_data(np.asarray(f(np.maximum(x + eps, eps)), x.dtype))
