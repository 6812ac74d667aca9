"""Public interface: load a pipeline, check it, run it on values or DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .plans.ast import Branch, Call, Each, Flow, Program, Ref, Tap, TypeSpec
from .plans.interpreter import Interpreter, as_text, coerced
from .plans.lower import Lane, Lowering, NotLowered
from .plans.parser import parse
from .plans.validate import emit_name, validate
from .registry import BUILT_IN, Args, packs
from .types import DTYPES, NAMES, CompileError, EngineError, TypeMismatch, Value, arg, audio, composite, image, raw, tensor

# Spark's type of an element by dtype; unsigned ones take the next wider.
ELEMENT = {"u8": T.ShortType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "f32": T.FloatType(), "f64": T.DoubleType()}
_OWN_SQL = {np.dtype("f4"): "float", np.dtype("f8"): "double"}
_OWN = {T.ByteType(): "i8", T.ShortType(): "i16", T.IntegerType(): "i32", T.LongType(): "i64", T.FloatType(): "f32", T.DoubleType(): "f64"}
SHAPE = T.ArrayType(T.LongType(), False)


def cell_type(t: tuple) -> T.DataType:
    """The Spark type that holds a value of (kind, dtype) or of a composite."""
    kind = t[0]
    if kind == "composite":
        return T.StructType([T.StructField(f"_{k}", cell_type(i)) for k, i in enumerate(t[1])])
    if kind == "bytes":
        return T.BinaryType()
    if kind == "arg":
        return T.StringType()
    element = ELEMENT[NAMES[np.dtype(t[1])]]
    if kind == "scalar":
        return element
    fields = [T.StructField("shape", SHAPE), T.StructField("data", T.ArrayType(element, False))]
    if kind == "image":
        fields += [T.StructField("color_space", T.StringType()), T.StructField("layout", T.StringType())]
    if kind == "audio":
        fields += [T.StructField("sample_rate", T.IntegerType()), T.StructField("channel_layout", T.StringType()), T.StructField("layout", T.StringType())]
    return T.StructType(fields)


def bound_type(spec: TypeSpec, dt: T.DataType, dtype: str | None) -> tuple:
    """(kind, dtype, rank) of a column bound to a parameter; rank None if unknown."""
    if spec.kind in ("int", "float", "str", "bool"):
        return ("arg", None)
    if spec.kind == "bytes":
        return ("bytes", None)
    if spec.kind == "composite":
        if not isinstance(dt, T.StructType):
            raise TypeMismatch("a composite needs a struct column")
        items = spec.items or tuple(_guess(f.dataType) for f in dt.fields)
        return ("composite", tuple(bound_type(s, f.dataType, f.metadata.get("dtype")) for s, f in zip(items, dt.fields)))
    element = dt
    if isinstance(dt, T.StructType):
        element = dt["data"].dataType
    if isinstance(element, T.ArrayType):
        element = element.elementType
    name = dtype or ("u64" if isinstance(element, T.DecimalType) else _OWN.get(element))
    if name is None:
        raise TypeMismatch(f"a {spec.kind} can't be read from {dt.simpleString()}")
    rank = len(spec.dims) if spec.dims is not None else 1 if isinstance(dt, T.ArrayType) else None
    return (spec.kind, np.dtype(DTYPES[name]), rank)


def _guess(dt: T.DataType) -> TypeSpec:
    if isinstance(dt, T.StructType) and "data" in dt.names:
        return TypeSpec("audio" if "sample_rate" in dt.names else "image" if "color_space" in dt.names else "tensor")
    if isinstance(dt, T.StructType):
        return TypeSpec("composite")
    return TypeSpec("tensor" if isinstance(dt, T.ArrayType) else "bytes" if isinstance(dt, T.BinaryType) else "scalar")


class Typing:
    """Kind and dtype of every emit, from those of the inputs."""

    def __init__(self, interpreter: Interpreter, inputs: dict[str, tuple]):
        self.i, self.out = interpreter, {}
        env = dict(inputs)
        for f in interpreter.flows:
            self.flow(f, env, None)

    def flow(self, f: Flow, env: dict, t: tuple | None) -> tuple | None:
        for s in f.steps:
            if isinstance(s, Ref):
                t = self.ref(s, env)
            elif isinstance(s, Tap):
                env[s.name] = t
            elif isinstance(s, Call) and s.name == "emit":
                self.out[emit_name(s)] = t
            elif isinstance(s, Call):
                given = list(s.args)
                if t is None:
                    if not given or not isinstance(given[0], Ref):
                        raise CompileError(f"{s.name} has no input")
                    t = self.ref(given.pop(0), env)
                act = self.i.names(s.name)
                if t[0] not in act.kinds:
                    raise TypeMismatch(f"{act.path} doesn't take a value of kind {t[0]}")
                if act.name == "cast" and any(isinstance(v, Ref) for v in [*given, *(v for _, v in s.named)]):
                    raise CompileError("the dtype of a cast must be written out")
                args = Args(["0" if isinstance(v, Ref) else as_text(v) for v in given], {k: "0" if isinstance(v, Ref) else as_text(v) for k, v in s.named})
                keeps_rank = act.pack in ("math_basics", "nn_basics") and len(t) > 2
                r = act.result(t, args) if act.result else t
                t = (*r[:2], t[2]) if keeps_rank and r[0] == t[0] else r[:2] if r[0] == t[0] and act.pack != "base" else r
            elif isinstance(s, Each):
                one = ("scalar" if len(t) > 2 and t[2] == 1 else t[0], t[1])
                got = self.body(s.body, env | {s.var: one}, one)
                t = (t[0], got[1], *t[2:])
            elif isinstance(s, Branch):
                bodies = [b for _, b in s.arms]
                found = [self.body(b, env, t) for b in bodies] + [self.body(s.otherwise, env, t) if s.otherwise is not None else t]
                if len({x[:2] for x in found}) > 1:
                    raise TypeMismatch("the branches end in different types: " + ", ".join(sorted({f"{x[0]} {x[1]}" for x in found})))
                t = found[0]
        return t

    def body(self, flows, env: dict, t: tuple) -> tuple:
        for f in flows:
            t = self.flow(f, env, t)
        return t

    def ref(self, r: Ref, env: dict) -> tuple:
        if r.name not in env:
            raise CompileError(f"${r.name} is not defined")
        t = env[r.name]
        for g in r.groups:
            if t[0] == "composite" and g[0].index is not None:
                if not 0 <= g[0].index < len(t[1]):
                    raise TypeMismatch(f"the composite has no component {g[0].index}")
                t, g = t[1][g[0].index], g[1:]
            if t[0] in ("scalar", "arg"):
                raise TypeMismatch(f"a value of kind {t[0]} can't be indexed")
            gone = sum(s.index is not None for s in g)
            if t[0] == "tensor" and gone and len(t) > 2 and t[2] is not None:
                rank = t[2] - gone
                t = (t[0] if rank else "scalar", t[1], rank)
        return t


# cells


class Reader:
    """Values of one Arrow column."""

    def __init__(self, spec: TypeSpec, column: pa.Array, t: tuple):
        self.spec, self.t, self.column = spec, t, column
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)
        if t[0] == "composite":
            items = spec.items or tuple(TypeSpec(i[0]) for i in t[1])
            self.parts = [Reader(s, column.field(k), i) for k, (s, i) in enumerate(zip(items, t[1]))]
        elif pa.types.is_struct(column.type):
            self.shape, self.data = column.field("shape"), column.field("data")
            self.extra = {f.name: column.field(f.name).to_pylist() for f in column.type if f.name not in ("shape", "data")}

    @staticmethod
    def _list(a: pa.Array, k: int, dtype) -> np.ndarray:
        lo, hi = a.offsets[k].as_py(), a.offsets[k + 1].as_py()
        part = a.values.slice(lo, hi - lo)
        if pa.types.is_decimal(part.type):
            return np.array([int(x) for x in part.to_pylist()], dtype)
        return part.to_numpy(zero_copy_only=False).astype(dtype)

    def __getitem__(self, k: int) -> Value | None:
        if not self.valid[k]:
            return None
        kind, c = self.t[0], self.column
        if kind == "composite":
            items = [p[k] for p in self.parts]
            return None if any(i is None for i in items) else composite(*items)
        if kind == "bytes":
            x = c[k].as_py()
            return raw(x.encode() if isinstance(x, str) else x)
        if kind == "arg":
            x = c[k].as_py()
            return arg(as_text(x))
        d = self.t[1]
        if kind == "scalar":
            return Value("scalar", np.asarray(c[k].as_py() if not pa.types.is_decimal(c.type) else int(c[k].as_py()), d))
        if not pa.types.is_struct(c.type):
            return Value("tensor", self._list(c, k, d)) if kind == "tensor" else audio(self._list(c, k, d), 44100)
        data = self._list(self.data, k, d).reshape(self._list(self.shape, k, "i8"))
        if kind == "image":
            return image(data, self.extra["color_space"][k], self.extra["layout"][k])
        if kind == "audio":
            return audio(data, self.extra["sample_rate"][k], self.extra.get("layout", {})[k] or "planar")
        return Value("tensor", data)


def _elements(values: list[np.ndarray], t: pa.DataType) -> pa.Array:
    flat = np.concatenate([np.ascontiguousarray(v).reshape(-1) for v in values]) if values else np.empty(0)
    if pa.types.is_decimal(t):
        return pa.array([int(x) for x in flat], t)
    return pa.array(flat.astype(t.to_pandas_dtype()), t)


def column(values: list[Value | None], t: tuple) -> pa.Array:
    """Values as an Arrow column of ``cell_type(t)``; None is null."""
    at = to_arrow_type(cell_type(t))
    kind = t[0]
    gone = pa.array([v is None for v in values])
    if kind == "composite":
        parts = [column([v and v.items[k] for v in values], i) for k, i in enumerate(t[1])]
        return pa.StructArray.from_arrays(parts, fields=list(at), mask=gone)
    if kind in ("bytes", "arg"):
        return pa.array([v and v.data for v in values], at)
    for v in values:
        if v is not None and (v.dtype != np.dtype(t[1]) or v.kind != kind and {v.kind, kind} != {"tensor", "scalar"}):
            raise TypeMismatch(f"a value of {v.kind} {v.dtype} where {kind} {t[1]} was inferred")
    if kind == "scalar":
        return pa.array([None if v is None else v.data.reshape(-1)[0].item() for v in values], at)
    some = [v.data if v is not None else np.empty(0) for v in values]
    ends = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)].astype("i4"))
    shapes = [np.array(v.shape if v is not None else (), "i8") for v in values]
    fields = list(at)
    parts = [
        pa.ListArray.from_arrays(ends([len(s) for s in shapes]), pa.array(np.concatenate(shapes) if shapes else np.empty(0, "i8"), pa.int64()), type=fields[0].type),
        pa.ListArray.from_arrays(ends([x.size for x in some]), _elements(some, fields[1].type.value_type), type=fields[1].type),
    ]
    if kind == "image":
        parts += [pa.array([v and v.color for v in values], pa.string()), pa.array([v and v.layout for v in values], pa.string())]
    if kind == "audio":
        parts += [pa.array([v and v.rate for v in values], pa.int32()), pa.array([v and v.channel_layout for v in values], pa.string()), pa.array([v and v.layout for v in values], pa.string())]
    return pa.StructArray.from_arrays(parts, fields=fields, mask=gone)


def host(value) -> Value:
    """A host value: arrays are tensors, text and numbers arguments, tuples composites."""
    if isinstance(value, Value):
        return value
    if isinstance(value, (bytes, bytearray)):
        return raw(bytes(value))
    if isinstance(value, np.ndarray) or isinstance(value, np.generic):
        return tensor(value)
    if isinstance(value, (list, tuple)):
        return composite(*[host(v) for v in value])
    return arg(as_text(value))


class Pipeline:
    """A checked pipeline."""

    def __init__(self, text: str):
        self.text = text
        self.program: Program = parse(text)
        validate(self.program)
        self.interpreter = Interpreter(self.program)

    @property
    def params(self):
        return list(self.interpreter.params)

    def __getstate__(self):
        # executors know the packs of this library; others travel with the pipeline
        return {"text": self.text, "packs": {p: a for p, a in packs().items() if p not in BUILT_IN}}

    def __setstate__(self, state):
        packs().update(state["packs"])
        self.__init__(state["text"])

    # values

    def run_local(self, *values, **named):
        """Run on host values, bound by position or by name. One unnamed or only
        output is returned bare, several as a dict by name."""
        names = [p.name for p in self.params] or ["input"]
        given = {n: host(v) for n, v in [*zip(names, values), *named.items()]}
        if len(values) > len(names):
            raise TypeMismatch(f"{len(values)} values for {len(names)} parameters")
        out = self.interpreter.run(given)
        return next(iter(out.values())) if len(out) == 1 else out

    # DataFrames

    def _bindings(self, df: DataFrame, bindings: dict) -> tuple[dict[str, Column], dict[str, Value]]:
        """Columns and constants by parameter; unbound parameters take the column of their name."""
        columns, constants = {}, {}
        for p in self.params or [None]:
            name = p.name if p else "input"
            b = bindings.get(name)
            if isinstance(b, Column):
                columns[name] = b
            elif isinstance(b, str) and b in df.columns and p is not None and p.type.kind not in ("str",):
                columns[name] = df[b]
            elif b is not None:
                constants[name] = host(b)
            elif name in df.columns:
                columns[name] = df[name]
        unknown = set(bindings) - {p.name for p in self.params} - ({"input"} if not self.params else set())
        if unknown:
            raise TypeMismatch(f"no parameters named {', '.join(sorted(unknown))}")
        return columns, constants

    def run(self, df: DataFrame, keep: list[str] | None = None, engine: str = "auto", on_error: str = "raise", **bindings) -> DataFrame:
        """One output column for each emit (an unnamed one is ``output``) beside
        the ``keep`` columns (default: all). Parameters bind to columns or constants.

        engine: "columns" (Catalyst expressions only), "kernels" (one Arrow
        stage) or "auto". on_error: "raise", or "null" for null outputs and the
        message in a column ``error``. Rows with a null input have null outputs.
        """
        keep = df.columns if keep is None else keep
        columns, constants = self._bindings(df, bindings)
        if engine != "kernels" and on_error == "raise":
            try:
                stages, emits = self.lowered(df, columns, constants)
            except NotLowered as e:
                if engine == "columns":
                    raise CompileError(f"no column expression for {e}") from e
            else:
                for name, expr in stages:
                    df = df.withColumn(name, expr)
                return df.select(*keep, *emits)
        elif engine == "columns":
            raise CompileError("caught errors need the kernels")
        return self._arrow(df, keep, columns, constants, on_error)

    def lowered(self, df: DataFrame, columns: dict[str, Column], constants: dict[str, Value]) -> tuple[list[tuple[str, Column]], list[Column]]:
        """Columns to add one after the other, and the emits, as expressions."""
        inputs, texts = {}, {}
        if not self.params:
            raise NotLowered("$input of unknown type")
        for p in self.params:
            if p.name not in columns:
                v = constants.get(p.name) or self.interpreter.default(p)
                v = v and coerced(p.type, v)
                if v is None or v.kind not in ("arg", "scalar"):
                    raise NotLowered(p.name)
                texts[p.name] = as_text(v)
                if v.kind == "scalar" and v.dtype in _OWN_SQL:
                    inputs[p.name] = Lane(F.lit(float(v.data)).cast(_OWN_SQL[v.dtype]), NAMES[v.dtype], None)
                continue
            dt = df.select(columns[p.name].alias("x")).schema["x"].dataType
            c, dims = columns[p.name], p.type.dims
            if p.type.kind == "scalar" and dt in (T.FloatType(), T.DoubleType()):
                inputs[p.name] = Lane(c, _OWN[dt], None)
            elif p.type.kind == "tensor" and dims and None not in dims and isinstance(dt, T.ArrayType) and len(dims) == 1 and dt.elementType in (T.FloatType(), T.DoubleType()):
                told = F.when(F.size(c) != dims[0], F.raise_error(F.lit(f"${p.name} needs shape {list(dims)}"))).otherwise(c)
                inputs[p.name] = Lane(told, _OWN[dt.elementType], dims)
            elif p.type.kind == "tensor" and dims and None not in dims and isinstance(dt, T.StructType) and dt["data"].dataType.elementType in (T.FloatType(), T.DoubleType()):
                told = F.when(c["shape"] != F.array(*[F.lit(d).cast("long") for d in dims]), F.raise_error(F.lit(f"${p.name} needs shape {list(dims)}"))).otherwise(c["data"])
                inputs[p.name] = Lane(told, _OWN[dt["data"].dataType.elementType], dims)
            else:
                raise NotLowered(p.name)
        out = []
        lowering = Lowering(self.program, inputs, texts, tuple(df.columns))
        for name, lane in lowering.emits().items():
            e = lane.expr
            if not lane.scalar:
                e = F.when(e.isNotNull(), F.struct(F.array(*[F.lit(d).cast("long") for d in lane.shape]).alias("shape"), e.alias("data")))
            out.append(e.alias(name or "output"))
        return lowering.stages, out

    def _arrow(self, df: DataFrame, keep: list[str], columns: dict[str, Column], constants: dict[str, Value], on_error: str) -> DataFrame:
        specs = {p.name: p.type for p in self.params} or {"input": None}
        source = df.select(*keep, *[c.alias(f"__{n}") for n, c in columns.items()])
        types = {}
        for n in columns:
            f = source.schema[f"__{n}"]
            specs[n] = specs[n] or _guess(f.dataType)
            types[n] = bound_type(specs[n], f.dataType, f.metadata.get("dtype"))
        typing = dict(types)
        for p in self.params:
            v = constants.get(p.name) or (self.interpreter.default(p) if p.name not in types else None)
            if v is not None:
                typing[p.name] = ("arg", None) if v.kind == "arg" and p.type.kind != "scalar" else ("composite", tuple((i.kind, i.dtype) for i in v.items)) if v.kind == "composite" else (v.kind, None) if v.kind == "bytes" else ("scalar", np.dtype("f4")) if v.kind == "arg" else (v.kind, v.dtype, v.data.ndim)
        emits = Typing(self.interpreter, typing).out
        if not emits:
            raise CompileError("the pipeline emits nothing")
        fields = [source.schema[k] for k in keep]
        fields += [T.StructField(n or "output", cell_type(t), metadata={"dtype": NAMES[np.dtype(t[1])]} if t[0] in ("tensor", "scalar", "image", "audio") else {}) for n, t in emits.items()]
        fields += [T.StructField("error", T.StringType())] * (on_error == "null")
        schema = T.StructType(fields)
        arrow = to_arrow_schema(schema)
        program, names, at = self, list(columns), len(keep)

        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                readers = {n: Reader(specs[n], batch.column(at + k), types[n]) for k, n in enumerate(names)}
                rows: dict[str, list] = {n: [] for n in emits}
                errors: list[str | None] = []
                for k in range(batch.num_rows):
                    values = {n: r[k] for n, r in readers.items()}
                    got, error = {}, None
                    if all(v is not None for v in values.values()):
                        try:
                            got = program.interpreter.run(values | constants)
                        except EngineError as e:
                            if on_error == "raise":
                                raise
                            error = f"{type(e).__name__}: {e}"
                    for n in emits:
                        rows[n].append(got.get(n))
                    errors.append(error)
                cols = [batch.column(k) for k in range(at)] + [column(rows[n], t) for n, t in emits.items()]
                if on_error == "null":
                    cols.append(pa.array(errors, pa.string()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow)], schema=arrow)

        return source.mapInArrow(stage, schema)

    def transform(self, **options):
        """For ``df.transform``."""
        return lambda df: self.run(df, **options)


def from_str(text: str) -> Pipeline:
    return Pipeline(text)


def load(path: str) -> Pipeline:
    return Pipeline(Path(path).read_text())

