"""Shape and movement of tensors."""

from __future__ import annotations

import numpy as np

from ..registry import Args, action
from ..types import ExecutionError, TypeMismatch, Value, convert, dtype_of
from .math import same

PACK = "tensor_basics"


def axis_of(axis: int, rank: int) -> int:
    at = axis + rank if axis < 0 else axis
    if not 0 <= at < rank:
        raise ExecutionError(f"axis {axis} is out of range for rank {rank}")
    return at


def to_tensor_kind(t, args):
    return ("tensor", t[1])


def moved(v: Value, data: np.ndarray) -> Value:
    return Value("tensor" if data.ndim else "scalar", np.ascontiguousarray(data) if data.ndim else data)


@action(PACK, "reshape", "tensor scalar", to_tensor_kind)
def reshape(v: Value, args: Args) -> Value:
    shape = args.integers("shape", at=0)
    if not shape or shape.count(-1) > 1 or any(n < -1 for n in shape):
        raise ExecutionError(f"can't reshape to {shape}")
    return Value("tensor", v.data.reshape(shape))


@action(PACK, "transpose", "tensor", same)
def transpose(v: Value, args: Args) -> Value:
    rank = v.data.ndim
    a, b = (axis_of(args.integer(n, at=k, default=k), rank) for k, n in enumerate(("dim0", "dim1")))
    return moved(v, np.swapaxes(v.data, a, b))


@action(PACK, "permute", "tensor", same)
def permute(v: Value, args: Args) -> Value:
    dims = args.integers("dims", at=0)
    if sorted(dims) != list(range(v.data.ndim)):
        raise ExecutionError(f"{dims} is no permutation of {v.data.ndim} axes")
    return moved(v, v.data.transpose(dims))


@action(PACK, "squeeze", "tensor scalar", same)
def squeeze(v: Value, args: Args) -> Value:
    if v.kind == "scalar":
        return v
    axis = args.integer("axis", "dim", at=0)
    if axis is None:
        shape = [n for n in v.shape if n != 1]
    else:
        at = axis_of(axis, v.data.ndim)
        shape = [n for k, n in enumerate(v.shape) if k != at or n != 1]
    return Value("tensor", v.data.reshape(shape or [1]))


@action(PACK, "unsqueeze", "tensor scalar", to_tensor_kind)
def unsqueeze(v: Value, args: Args) -> Value:
    return Value("tensor", np.expand_dims(v.data, axis_of(args.integer("axis", "dim", at=0, default=0), v.data.ndim + 1)))


@action(PACK, "flatten", "tensor scalar", same)
def flatten(v: Value, args: Args) -> Value:
    rank = v.data.ndim
    if not rank:
        return v
    at = lambda x: min(max(x + rank if x < 0 else x, 0), rank - 1)
    a, b = at(args.integer("start_dim", at=0, default=0)), at(args.integer("end_dim", at=1, default=-1))
    if a > b:
        raise ExecutionError("start_dim is behind end_dim")
    return Value("tensor", v.data.reshape(*v.shape[:a], -1 if v.data.size else int(np.prod(v.shape[a : b + 1])), *v.shape[b + 1 :]))


@action(PACK, "concat", "composite tensor", lambda t, args: t if t[0] == "tensor" else ("tensor", t[1][0][1]))
def concat(v: Value, args: Args) -> Value:
    if v.kind == "tensor":
        return v
    if not v.items or any(i.kind != "tensor" for i in v.items):
        raise TypeMismatch("concat takes tensors")
    first = v.items[0]
    at = axis_of(args.integer("axis", "dim", at=0, default=0), first.data.ndim)
    for i in v.items:
        if i.dtype != first.dtype or i.data.ndim != first.data.ndim or any(k != at and a != b for k, (a, b) in enumerate(zip(i.shape, first.shape))):
            raise ExecutionError("tensors differ in dtype or in another dimension")
    return Value("tensor", np.concatenate([i.data for i in v.items], axis=at))


@action(PACK, "cast", "tensor scalar", lambda t, args: (t[0], dtype_of(args.text("dtype", at=0) or "f32")))
def cast(v: Value, args: Args) -> Value:
    return v.with_data(np.asarray(convert(v.data, dtype_of(args.text("dtype", at=0) or "f32"))))


@action(PACK, "repeat", "tensor scalar", to_tensor_kind)
def repeat(v: Value, args: Args) -> Value:
    times = args.integers("repeats", at=0)
    if any(n < 0 for n in times):
        raise ExecutionError("a factor is negative")
    return Value("tensor", np.tile(v.data, [max(1, n) for n in times]))


@action(PACK, "roll", "tensor", same)
def roll(v: Value, args: Args) -> Value:
    axis = axis_of(args.integer("axis", "dim", at=1, default=0), v.data.ndim)
    return moved(v, np.roll(v.data, args.integer("shift", "shifts", at=0, default=0), axis))
