"""Linear algebra in single precision."""

from __future__ import annotations

import numpy as np

from ..registry import Args, action
from ..types import ExecutionError, TypeMismatch, Value

PACK = "linalg_basics"
F4 = np.dtype("f4")


def f32(v: Value) -> np.ndarray:
    return v.data.astype(F4)


def pair(v: Value) -> tuple[np.ndarray, np.ndarray]:
    """The two tensors of a composite; one tensor stands for both."""
    if v.kind != "composite":
        return f32(v), f32(v)
    if len(v.items) != 2 or any(i.kind not in ("tensor", "scalar") for i in v.items):
        raise TypeMismatch("two tensors are needed")
    return f32(v.items[0]), f32(v.items[1])


def tensor_of(t, args):
    return ("tensor", F4)


def rank_two_scalar(t, args):
    """Scalar where the input has rank 2, else a tensor."""
    return ("scalar" if (t[2] if len(t) > 2 else 2) == 2 else "tensor", F4)


def matrices(v: Value, square: bool = True) -> np.ndarray:
    a = f32(v)
    if a.ndim < 2 or square and a.shape[-1] != a.shape[-2]:
        raise ExecutionError(f"a {'square ' * square}matrix is needed, not {a.shape}")
    return a


@action(PACK, "matmul", "composite tensor", tensor_of)
def matmul(v: Value, args: Args) -> Value:
    a, b = pair(v)
    if min(a.ndim, b.ndim) < 2 or a.shape[-1] != b.shape[-2]:
        raise ExecutionError(f"can't multiply {a.shape} by {b.shape}")
    return Value("tensor", np.matmul(a, b))


@action(PACK, "dot", "composite tensor", tensor_of)
def dot(v: Value, args: Args) -> Value:
    a, b = (x.reshape(-1) for x in pair(v))
    if a.size != b.size:
        raise ExecutionError("the vectors differ in length")
    return Value("tensor", (a * b).sum(dtype=F4).reshape(1))


@action(PACK, "outer", "composite tensor", tensor_of)
def outer(v: Value, args: Args) -> Value:
    return Value("tensor", np.outer(*pair(v)).astype(F4))


@action(PACK, "trace", "tensor", rank_two_scalar)
def trace(v: Value, args: Args) -> Value:
    out = np.asarray(np.trace(matrices(v, False), axis1=-2, axis2=-1), F4)
    return Value("tensor" if out.ndim else "scalar", out)


@action(PACK, "diag", "tensor", tensor_of)
def diag(v: Value, args: Args) -> Value:
    if v.data.ndim not in (1, 2):
        raise ExecutionError(f"diag takes rank 1 or 2, not {v.data.ndim}")
    return Value("tensor", np.ascontiguousarray(np.diag(f32(v), args.integer("diagonal", "k", at=0, default=0))))


def eliminated(a: np.ndarray) -> tuple[np.ndarray, bool]:
    """(signed pivots, singular) of one matrix by partial pivoting in single precision."""
    a = a.copy()
    n, sign, pivots = len(a), F4.type(1), []
    for k in range(n):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        if abs(a[p, k]) < 1e-12:
            return np.zeros(n, F4), True
        if p != k:
            a[[k, p]] = a[[p, k]]
            sign = -sign
        pivots.append(a[k, k])
        a[k + 1 :, k:] -= np.outer(a[k + 1 :, k] / a[k, k], a[k, k:])
    return np.array([sign, *pivots], F4), False


@action(PACK, "det", "tensor", rank_two_scalar)
def det(v: Value, args: Args) -> Value:
    a = matrices(v)
    out = np.array([0 if (e := eliminated(m))[1] else np.prod(e[0]) for m in a.reshape(-1, *a.shape[-2:])], F4).reshape(a.shape[:-2])
    return Value("tensor" if out.ndim else "scalar", out)


@action(PACK, "inv", "tensor", tensor_of)
def inv(v: Value, args: Args) -> Value:
    a = matrices(v)
    if any(eliminated(m)[1] for m in a.reshape(-1, *a.shape[-2:])):
        raise ExecutionError("the matrix is singular")
    return Value("tensor", np.linalg.inv(a).astype(F4))


def _qr_result(t, args):
    return ("composite", (("tensor", F4), ("tensor", F4)))


@action(PACK, "qr", "tensor", _qr_result)
def qr(v: Value, args: Args) -> Value:
    """Modified Gram-Schmidt: Q m x n, R n x n with a diagonal that isn't negative."""
    if v.data.ndim != 2:
        raise ExecutionError("qr takes rank 2")
    a = f32(v)
    m, n = a.shape
    q, r = a.copy(), np.zeros((n, n), F4)
    for k in range(n):
        r[k, k] = np.sqrt((q[:, k] * q[:, k]).sum(dtype=F4))
        q[:, k] = q[:, k] / r[k, k] if r[k, k] > 1e-12 else 0
        r[k, k + 1 :] = q[:, k] @ q[:, k + 1 :]
        q[:, k + 1 :] -= np.outer(q[:, k], r[k, k + 1 :])
    return Value("composite", items=[Value("tensor", q), Value("tensor", r)])


def householder_qr(v: Value, args: Args) -> Value:
    """The accelerated twin: reduced QR, zero-padded to Q m x n, R n x n."""
    if v.data.ndim != 2:
        raise ExecutionError("qr takes rank 2")
    m, n = v.shape
    q, r = np.linalg.qr(f32(v))
    q = np.pad(q, ((0, 0), (0, n - q.shape[1]))).astype(F4)
    return Value("composite", items=[Value("tensor", q), Value("tensor", np.pad(r, ((0, n - r.shape[0]), (0, 0))).astype(F4))])


@action(PACK, "cholesky", "tensor", tensor_of)
def cholesky(v: Value, args: Args) -> Value:
    """Lower L of the lower triangle."""
    a = matrices(v)
    if a.ndim != 2:
        raise ExecutionError("cholesky takes rank 2")
    low = np.tril(a)
    return Value("tensor", np.linalg.cholesky(low + np.tril(a, -1).T).astype(F4))


TWIN_KERNELS = {"qr": householder_qr}
