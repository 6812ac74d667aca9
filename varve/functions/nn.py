"""Activations, normalizations and pooling."""

from __future__ import annotations

import math

import numpy as np

from ..registry import Args, action
from ..types import ExecutionError, TypeMismatch, Value, fractional, is_float
from .math import as_fraction, same
from .shape import axis_of

PACK = "nn_basics"
PLAIN = "tensor scalar"
# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def floats(v: Value) -> np.ndarray:
    return v.data.astype(fractional(v.dtype))


def put(v: Value, x, dtype) -> Value:
    return v.with_data(np.asarray(x, dtype))


@action(PACK, "relu", PLAIN, same)
def relu(v: Value, args: Args) -> Value:
    return put(v, np.maximum(v.data, v.dtype.type(0)), v.dtype)


@action(PACK, "leaky_relu", PLAIN, as_fraction)
def leaky_relu(v: Value, args: Args) -> Value:
    x = floats(v)
    alpha = x.dtype.type(args.number("alpha", "negative_slope", at=0, default=0.01, dtype=x.dtype.type))
    return put(v, np.where(x >= 0, x, alpha * x), x.dtype)


def erf_approx(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + ERF_P * np.abs(x))
    poly = np.zeros_like(x)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return np.sign(x) * (1 - poly * np.exp(-x * x))


@action(PACK, "gelu", PLAIN, as_fraction)
def gelu(v: Value, args: Args) -> Value:
    x = floats(v)
    w = x.astype("f8")
    if (args.text("approximate", at=0) or "none").strip().lower() == "tanh":
        y = 0.5 * w * (1 + np.tanh(math.sqrt(2 / math.pi) * (w + 0.044715 * w**3)))
    elif x.dtype == np.float32:
        y = 0.5 * w * (1 + erf_approx(w / math.sqrt(2)))
    else:
        y = 0.5 * w * (1 + np.vectorize(math.erf, otypes=["f8"])(w / math.sqrt(2)))
    return put(v, y, x.dtype)


def _smooth(name: str, f) -> None:
    @action(PACK, name, PLAIN, as_fraction)
    def kernel(v: Value, args: Args) -> Value:
        x = floats(v)
        return put(v, f(x), x.dtype)


_smooth("silu", lambda x: x / (1 + np.exp(-x)))
_smooth("sigmoid", lambda x: 1 / (1 + np.exp(-x)))
_smooth("tanh", np.tanh)


def _softmax_axis(args: Args, rank: int) -> int:
    axis = args.integer("axis", "dim", at=0, default=-1)
    if axis >= rank:
        raise ExecutionError(f"axis {axis} is out of range for rank {rank}")
    return max(axis + rank, 0) if axis < 0 else axis  # too negative an axis is the first


@action(PACK, "softmax", PLAIN, as_fraction)
def softmax(v: Value, args: Args) -> Value:
    x = floats(v)
    if not x.ndim:
        return put(v, np.ones_like(x), x.dtype)
    axis = _softmax_axis(args, x.ndim)
    e = np.exp(x - x.max(axis=axis, keepdims=True)) if x.size else x
    return put(v, e / e.sum(axis=axis, keepdims=True), x.dtype)


@action(PACK, "log_softmax", PLAIN, as_fraction)
def log_softmax(v: Value, args: Args) -> Value:
    x = floats(v)
    if not x.ndim:
        return put(v, np.zeros_like(x), x.dtype)
    axis = _softmax_axis(args, x.ndim)
    if not x.size:
        return put(v, x, x.dtype)
    m = x.max(axis=axis, keepdims=True)
    return put(v, x - (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))), x.dtype)


@action(PACK, "layer_norm", PLAIN, as_fraction)
def layer_norm(v: Value, args: Args) -> Value:
    x = floats(v)
    if not x.ndim or not x.size:
        return put(v, x, x.dtype)
    eps = x.dtype.type(args.number("eps", at=0, default=1e-5))
    d = x - x.mean(axis=-1, keepdims=True)
    return put(v, d / np.sqrt((d * d).mean(axis=-1, keepdims=True) + eps), x.dtype)


@action(PACK, "rms_norm", PLAIN, as_fraction)
def rms_norm(v: Value, args: Args) -> Value:
    x = floats(v)
    if not x.ndim or not x.size:
        return put(v, x, x.dtype)
    eps = x.dtype.type(args.number("eps", at=0, default=1e-5))
    return put(v, x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps), x.dtype)


def _pair_result(t, args):
    from ..types import promote

    return t if t[0] == "tensor" else ("tensor", fractional(promote(t[1][0][1], t[1][1][1])))


@action(PACK, "cosine_similarity", "composite tensor", _pair_result)
def cosine_similarity(v: Value, args: Args) -> Value:
    if v.kind == "tensor":
        return v if is_float(v.dtype) else v.with_data(floats(v))
    if len(v.items) != 2 or any(i.kind != "tensor" for i in v.items):
        raise TypeMismatch("cosine_similarity takes two tensors")
    from ..types import promote

    a, b = v.items
    if a.shape != b.shape:
        raise ExecutionError(f"shapes {a.shape} and {b.shape} differ")
    d = fractional(promote(a.dtype, b.dtype))
    x, y = a.data.astype(d), b.data.astype(d)
    eps = d.type(args.number("eps", default=1e-8))
    top = np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1))
    out = (x * y).sum(axis=-1) / np.maximum(top, eps)
    return Value("tensor", np.asarray(out, d).reshape(out.shape or (1,)))


def _pool(name: str, f, rule) -> None:
    @action(PACK, name, "tensor", rule)
    def kernel(v: Value, args: Args) -> Value:
        k = max(1, args.integer("kernel_size", "kernel", at=0, default=2))
        s = max(1, args.integer("stride", at=1, default=2))
        if v.data.ndim < 2 or min(v.shape[-2:]) < k:
            raise ExecutionError(f"a window of {k} doesn't fit {v.shape}")
        w = np.lib.stride_tricks.sliding_window_view(v.data, (k, k), axis=(-2, -1))[..., ::s, ::s, :, :]
        return Value("tensor", f(w, k))


_pool("max_pool2d", lambda w, k: w.max(axis=(-2, -1)), same)
_pool("avg_pool2d", lambda w, k: (w.astype(fractional(w.dtype)).sum(axis=(-2, -1)) * fractional(w.dtype).type(1 / (k * k))).astype(fractional(w.dtype)), as_fraction)
