"""Lowering of a pipeline to column expressions, where all its steps allow it.

Scalars and float tensors of fully known shape lower; anything else raises
``NotLowered`` and the pipeline runs on kernels in one Arrow stage.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, fields, is_dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.shape import axis_of
from ..operators import columns as C
from ..registry import Args, Names
from ..types import Value
from .ast import Branch, Call, Condition, Each, Flow, Program, Ref, Tap
from .interpreter import as_text, indexed
from .validate import emit_name, ordered


class NotLowered(Exception):
    """Some step needs the kernels."""


@dataclass(frozen=True)
class Lane:
    """A scalar (shape None) or a tensor: C-order elements and its shape."""

    expr: Column
    dtype: str
    shape: tuple[int, ...] | None

    @property
    def scalar(self) -> bool:
        return self.shape is None


#: Above so many elements kernels on Arrow batches beat boxed array lambdas.
WIDEST = 256
_AXIS = {"softmax", "log_softmax"}


def _uses(node) -> Counter:
    """How often each name is read in a program or a part of it."""
    out = Counter()
    if isinstance(node, Ref):
        out[node.name] += 1
    if isinstance(node, (tuple, list)):
        for x in node:
            out += _uses(x)
    elif is_dataclass(node):
        for f in fields(node):
            out += _uses(getattr(node, f.name))
    return out


class Lowering:
    def __init__(self, program: Program, inputs: dict[str, Lane], texts: dict[str, str] | None = None, taken: tuple[str, ...] = ()):
        """texts: constants, as arguments have them. taken: names of columns."""
        self.names, self.inputs, self.texts = Names(program), inputs, texts or {}
        self.flows = ordered(program, set(inputs) | set(self.texts))
        self.uses, self.taken = _uses(program), set(taken)
        #: Columns to be added one after the other before the emits are selected.
        self.stages: list[tuple[str, Column]] = []

    def emits(self) -> dict[str, Lane]:
        env, out = dict(self.inputs), {}
        for f in self.flows:
            self.flow(f, env, None, out)
        return out

    def flow(self, f: Flow, env: dict, current: Lane | None, out: dict | None) -> Lane | None:
        for s in f.steps:
            if isinstance(s, Ref):
                current = self.ref(s, env)
            elif isinstance(s, Tap):
                env[s.name] = self.kept(s.name, current) if out is not None else current
            elif isinstance(s, Call) and s.name == "emit":
                out[emit_name(s)] = current
            elif isinstance(s, Call):
                current = self.call(s, env, current)
            elif isinstance(s, Branch):
                current = self.branch(s, env, current)
            elif isinstance(s, Each):
                current = self.each(s, env, current)
            else:
                raise NotLowered(type(s).__name__)
        return current

    def kept(self, name: str, v: Lane) -> Lane:
        """A tap that several steps read becomes a column, made once a row."""
        if self.uses[name] < 2:
            return v
        column = f"__tap_{name}"
        while column in self.taken:
            column += "_"
        self.taken.add(column)
        self.stages.append((column, v.expr))
        return Lane(F.col(column), v.dtype, v.shape)

    def ref(self, r: Ref, env: dict) -> Lane:
        v = env.get(r.name)
        if v is None or r.field:
            raise NotLowered(r.name)
        for g in r.groups:
            if v.scalar:
                raise NotLowered("index")
            places = indexed(Value("tensor", np.arange(math.prod(v.shape)).reshape(v.shape)), g)
            v = self.picked(v, places)
        return v

    @staticmethod
    def picked(v: Lane, places: Value) -> Lane:
        """The elements of v at the given places, shaped like them."""
        at = places.data.reshape(-1).tolist()
        if places.kind == "scalar":
            return Lane(F.get(v.expr, F.lit(at[0])), v.dtype, None)
        return Lane(C.gather(v.expr, at, v.dtype), v.dtype, places.shape)

    def each(self, s: Each, env: dict, current: Lane) -> Lane:
        """A loop over slices of a tensor of rank 2 or more: its body as a lambda."""
        if current.scalar or len(current.shape) < 2 or any(isinstance(x, (Tap, Each)) for f in s.body for x in f.steps):
            raise NotLowered("each")
        rank, axis = len(current.shape), 0 if s.axis is None else axis_of(s.axis, len(current.shape))
        n, inner = current.shape[axis], current.shape[:axis] + current.shape[axis + 1 :]
        size = math.prod(inner)
        if not n or not size:
            raise NotLowered("an empty loop")
        places = np.moveaxis(np.arange(n * size).reshape(current.shape), axis, 0).reshape(-1)
        shapes = []

        def body(part: Column) -> Column:
            one = Lane(part, current.dtype, inner)
            out = self.body(s.body, env | {s.var: one}, one)
            if out.scalar or (out.dtype, len(out.shape)) != (current.dtype, rank - 1):
                raise NotLowered("a loop that changes the type")
            shapes.append(out.shape)
            return out.expr

        each = lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: body(F.slice(m, k * size + 1, F.lit(size)))))
        out = C.let(C.gather(current.expr, places.tolist(), current.dtype), each)
        shape = shapes[0]
        whole = shape[:axis] + (n,) + shape[axis:]
        back = np.moveaxis(np.arange(n * math.prod(shape)).reshape((n, *shape)), 0, axis).reshape(-1)
        return Lane(C.let(out, lambda m: C.gather(m, back.tolist(), current.dtype)), current.dtype, whole)

    def branch(self, s: Branch, env: dict, current: Lane) -> Lane:
        if any(isinstance(x, Tap) for _, body in s.arms for f in body for x in f.steps) or any(isinstance(x, Tap) for f in s.otherwise or () for x in f.steps):
            raise NotLowered("a tap in a branch")
        scope = env | {"payload": current}
        arms = [(self.condition(c, scope), self.body(b, env, current)) for c, b in s.arms]
        other = self.body(s.otherwise, env, current) if s.otherwise is not None else current
        if any((a.dtype, a.shape) != (other.dtype, other.shape) for _, a in arms):
            raise NotLowered("branches of different types")
        out: Column | None = None
        for c, a in arms:
            out = F.when(c, a.expr) if out is None else out.when(c, a.expr)
        return Lane(out.otherwise(other.expr), other.dtype, other.shape)

    def body(self, flows: tuple[Flow, ...], env: dict, current: Lane) -> Lane:
        for f in flows:
            current = self.flow(f, dict(env), current, None)
        return current

    def condition(self, c: Condition, env: dict) -> Column:
        def side(v):
            if isinstance(v, bool) or isinstance(v, str):
                raise NotLowered("condition")
            if not isinstance(v, Ref):
                return F.lit(float(v)), isinstance(v, float) and math.isnan(v)
            if v.field in ("mean", "peak", "peak_abs", "rms"):
                lane = self.ref(Ref(v.name, None, v.groups), env)
                x = F.array(lane.expr) if lane.scalar else lane.expr
                return {"mean": C.mean(x), "rms": F.sqrt(C.mean(F.transform(x, lambda e: e.cast("double") * e))), "peak": C.norm(x, C.INF), "peak_abs": C.norm(x, C.INF)}[v.field], True
            lane = self.ref(v, env)
            if not lane.scalar:
                raise NotLowered("condition")
            return lane.expr.cast("double"), True

        (a, x), (b, y) = side(c.left), side(c.right)
        nan = F.lit(False)
        for e, may in ((a, x), (b, y)):
            nan = nan | F.isnan(e) if may else nan
        test = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]
        return F.when(nan, F.lit(c.op == "!=")).otherwise(test)

    def call(self, s: Call, env: dict, current: Lane | None) -> Lane:
        given = list(s.args)
        if current is None:
            if not given or not isinstance(given[0], Ref):
                raise NotLowered("no input")
            current = self.ref(given.pop(0), env)
        def text(v) -> str:
            if not isinstance(v, Ref):
                return as_text(v)
            if v.name not in self.texts or v.groups or v.field or env.get(v.name) is not self.inputs.get(v.name):
                raise NotLowered("an argument of the data")
            return self.texts[v.name]

        act = self.names(s.name)
        args = Args([text(v) for v in given], {k: text(v) for k, v in s.named})
        if not current.scalar and math.prod(current.shape) > WIDEST:
            raise NotLowered("a wide tensor")
        if act.name == "identity":
            return current
        f = getattr(self, f"_{act.pack}", None)
        out = f and f(act.name, current, args)
        if out is None:
            raise NotLowered(act.path)
        return out

    @staticmethod
    def mapped(v: Lane, f) -> Lane:
        if v.scalar:
            return Lane(f(v.expr).cast(C.SQL[v.dtype]), v.dtype, None)
        return Lane(C.each(v.expr, f, v.dtype), v.dtype, v.shape)

    def _math_basics(self, name: str, v: Lane, args: Args) -> Lane | None:
        t = np.float32 if v.dtype == "f32" else np.float64
        amount = ("value", "val", "scalar", "amount", "factor", "by", "exponent", "power")
        if name in ("add", "sub", "mul", "div", "pow"):
            x = args.number(*amount, at=0, default=float(name in ("mul", "div", "pow")), dtype=t)
            k = C.num(x, v.dtype)
            if name == "div":
                if x == 0:
                    raise NotLowered("division by zero")
                inverse = C.num(float(np.float32(1) / np.float32(x)), "f32")
                return self.mapped(v, (lambda e: e * inverse) if v.dtype == "f32" else (lambda e: e / k))
            return self.mapped(v, {"add": lambda e: e + k, "sub": lambda e: e - k, "mul": lambda e: e * k, "pow": lambda e: F.pow(e, k)}[name])
        if name == "clamp":
            lo, hi = args.number("min", at=0, dtype=t), args.number("max", at=1, dtype=t)

            def clip(e):
                out = e if lo is None else F.when(F.isnan(e) | (e > C.num(lo, v.dtype)), e).otherwise(C.num(lo, v.dtype))
                return out if hi is None else F.when(F.isnan(e), e).otherwise(F.least(out, C.num(hi, v.dtype)))

            return self.mapped(v, clip)
        if name in ("rsqrt", "log"):
            eps = C.num(args.number("eps", at=0 if name == "rsqrt" else None, default=1e-8, dtype=t), v.dtype)
            floor = lambda e: F.when(F.isnan(e), e).otherwise(F.greatest(e + eps, eps))
            if name == "rsqrt":
                return self.mapped(v, lambda e: F.lit(1.0) / F.sqrt(floor(e)))
            f = {"2": F.log2, "10": F.log10}.get((args.text("base", at=0) or "e").strip(), F.ln)
            return self.mapped(v, lambda e: f(floor(e)))
        return self.mapped(v, C.UNARY[name]) if name in C.UNARY else None

    def _nn_basics(self, name: str, v: Lane, args: Args) -> Lane | None:
        if name in C.UNARY:
            return self.mapped(v, C.UNARY[name])
        if name == "leaky_relu":
            a = C.num(args.number("alpha", "negative_slope", at=0, default=0.01), v.dtype)
            return self.mapped(v, lambda e: F.when(e >= 0, e).otherwise(e * a))
        if name == "gelu":
            if (args.text("approximate", at=0) or "none").strip().lower() == "tanh":
                return self.mapped(v, lambda e: C.gelu_tanh(e.cast("double")))
            return self.mapped(v, lambda e: F.lit(0.5) * e * (F.lit(1.0) + C.erf(e / F.lit(math.sqrt(2))))) if v.dtype == "f32" else None
        if v.scalar or not math.prod(v.shape):
            return None
        rank = len(v.shape)
        eps = args.number("eps", at=0, default=1e-5)
        f = {
            "softmax": lambda x: C.softmax(x, v.dtype), "log_softmax": lambda x: C.softmax(x, v.dtype, True),
            "layer_norm": lambda x: C.layer_norm(x, eps, v.dtype), "rms_norm": lambda x: C.rms_norm(x, eps, v.dtype),
        }.get(name)
        if f is None:
            return None
        axis = args.integer("axis", "dim", at=0, default=-1) if name in _AXIS else -1
        if axis >= rank:
            raise NotLowered("an axis out of range")
        axis = max(axis + rank, 0) if axis < 0 else axis
        return Lane(f(v.expr) if rank == 1 else self.lanes(v, axis, f, True), v.dtype, v.shape)

    def lanes(self, v: Lane, axis: int, f, whole: bool) -> Column:
        """f over the lanes along an axis, in C order of the other axes: the axis
        is moved last by a gather, and each lane is a slice. ``whole``: f gives
        lanes, which go back to their places; else one element each."""
        size = v.shape[axis]
        places = np.moveaxis(np.arange(math.prod(v.shape)).reshape(v.shape), axis, -1).reshape(-1)
        n = len(places) // size
        each = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: f(F.slice(m, k * size + 1, F.lit(size))))
        out = C.let(C.gather(v.expr, places.tolist(), v.dtype), each)
        if not whole:
            return out
        back = np.argsort(places, kind="stable").tolist()
        return C.let(F.flatten(out), lambda m: C.gather(m, back, v.dtype))

    def _tensor_stats(self, name: str, v: Lane, args: Args) -> Lane | None:
        if v.scalar or not math.prod(v.shape):
            return None
        rank = len(v.shape)
        keep = (args.text("keepdim") or "").strip().lower() in ("true", "1")
        axis = args.integer("axis", "dim", at=1 if name == "norm" else 0, default={"cumsum": 0, "argmin": -1, "argmax": -1}.get(name))
        if axis is not None:
            axis = axis_of(axis, rank)
        t = C.SQL[v.dtype]
        if name == "cumsum":
            f = lambda x: C.cumsum(x, v.dtype)
            return Lane(f(v.expr) if rank == 1 else self.lanes(v, axis, f, True), v.dtype, v.shape)
        unbiased = (args.text("unbiased") or "true").strip().lower() in ("true", "1")
        p = C.INF if (args.text("p", at=0) or "2").strip().lower() in ("inf", "infinity") else args.number("p", at=0, default=2.0)
        f = {
            "sum": C.total, "mean": C.mean, "var": lambda x: C.variance(x, unbiased), "std": lambda x: F.sqrt(C.variance(x, unbiased)),
            "min": lambda x: C.least(x, v.dtype), "max": lambda x: C.greatest(x, v.dtype), "norm": lambda x: C.norm(x, p),
            "argmin": lambda x: C.position(x, False), "argmax": lambda x: C.position(x, True),
        }.get(name)
        if f is None:
            return None
        dtype, kind = ("i32", "int") if name.startswith("arg") else (v.dtype, t)
        one = lambda x: f(x).cast(kind)
        left = () if axis is None else v.shape[:axis] + v.shape[axis + 1 :]
        shape = (1,) * rank if keep and axis is None else v.shape[:axis] + (1,) + v.shape[axis + 1 :] if keep else left
        if name.startswith("arg"):
            shape = shape or (1,)
        out = F.array(one(v.expr)) if axis is None or rank == 1 else self.lanes(v, axis, one, False)
        return Lane(out, dtype, shape) if shape else Lane(out[0], dtype, None)

    def _linalg_basics(self, name: str, v: Lane, args: Args) -> Lane | None:
        """What gathers and sums express; results are single precision."""
        if v.scalar or v.dtype != "f32":
            return None
        n = math.prod(v.shape)
        if name == "dot":
            return Lane(F.array(F.aggregate(v.expr, F.lit(0.0), lambda a, x: a + x.cast("double") * x).cast("float")), "f32", (1,))
        if name == "outer" and n * n <= 4096:
            return Lane(C.let(v.expr, lambda x: F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))), "f32", (n, n))
        if name == "trace" and len(v.shape) == 2:
            diagonal = np.arange(n).reshape(v.shape).diagonal().tolist()
            return Lane(C.total(C.gather(v.expr, diagonal, "f32")).cast("float"), "f32", None)
        if name == "diag" and len(v.shape) == 2:
            places = np.diag(np.arange(n).reshape(v.shape), args.integer("diagonal", "k", at=0, default=0))
            return Lane(C.gather(v.expr, places.tolist(), "f32"), "f32", places.shape)
        return None

    _linalg_blas = _linalg_basics

    def _tensor_basics(self, name: str, v: Lane, args: Args) -> Lane | None:
        """Movements are gathers: the kernel moves the places, not the values."""
        if name in ("cast", "concat") or v.scalar:
            return None
        from ..registry import apply, packs

        places = apply(packs()["tensor_basics"][name], Value("tensor", np.arange(math.prod(v.shape)).reshape(v.shape)), args)
        if name in ("reshape", "squeeze", "unsqueeze", "flatten"):
            return Lane(v.expr, v.dtype, places.shape)
        if places.data.size > WIDEST:
            return None
        return self.picked(v, places)

    _tensor_blas = _tensor_basics
