"""Values that flow through a pipeline, their dtypes and numeric rules."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

# Element types.
DTYPES = {"u8": np.uint8, "i8": np.int8, "i16": np.int16, "i32": np.int32, "i64": np.int64, "u32": np.uint32, "u64": np.uint64, "f32": np.float32, "f64": np.float64}
NAMES = {np.dtype(v): k for k, v in DTYPES.items()}
ALIASES = {"uint8": "u8", "byte": "u8", "int8": "i8", "int16": "i16", "short": "i16", "int32": "i32", "int": "i32", "int64": "i64", "long": "i64", "uint32": "u32", "uint64": "u64", "float32": "f32", "float": "f32", "float64": "f64", "double": "f64"}
# Channels of the colour spaces.
CHANNELS = {"rgb": 3, "rgba": 4, "bgr": 3, "bgra": 4, "grayscale": 1, "grayscale_alpha": 2, "ycbcr": 3, "hsv": 3, "lab": 3, "cmyk": 4}
# Channel layouts by count; other counts are custom.
LAYOUTS = {1: "mono", 2: "stereo", 3: "surround_2_1", 4: "quad", 6: "surround_5_1", 8: "surround_7_1", 9: "ambisonic_2", 16: "ambisonic_3"}


class EngineError(Exception):
    """Base of all errors of the engine."""


class ParseError(EngineError):
    """The text is no pipeline."""


class CompileError(EngineError):
    """The pipeline breaks a static rule, or names what can't be resolved."""


class ExecutionError(EngineError):
    """An action failed on its input."""


class TypeMismatch(EngineError):
    """A value isn't of the declared or needed kind."""


def dtype_of(name: str) -> np.dtype:
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in DTYPES:
        raise ExecutionError(f"unknown dtype {name!r}")
    return np.dtype(DTYPES[key])


def is_float(d) -> bool:
    return np.dtype(d).kind == "f"


def promote(a, b) -> np.dtype:
    """The common type of two operands. Any float wins, as f64 if either is f64;
    one signedness widens; both mixed take the smallest signed type that holds
    them, or i64."""
    a, b = np.dtype(a), np.dtype(b)
    if a == b:
        return a
    if is_float(a) or is_float(b):
        return np.dtype("f8") if np.dtype("f8") in (a, b) else np.dtype("f4")
    if a.kind == b.kind:
        return max(a, b, key=lambda d: d.itemsize)
    unsigned, signed = (a, b) if a.kind == "u" else (b, a)
    return np.dtype(f"i{min(8, max(signed.itemsize, 2 * unsigned.itemsize))}")


def fractional(d) -> np.dtype:
    """f32 stays, all else computes in f64."""
    return np.dtype("f4") if np.dtype(d) == np.float32 else np.dtype("f8")


def wide(d) -> np.dtype:
    """The type of sums: floats keep theirs, integers widen to 64 bits."""
    d = np.dtype(d)
    return d if is_float(d) else np.dtype("u8" if d.kind == "u" else "i8")


def round_away(x: np.ndarray) -> np.ndarray:
    """To the nearest whole number, halves away from zero."""
    t = np.trunc(x)
    with np.errstate(invalid="ignore"):
        return t + np.where(np.abs(x - t) >= 0.5, np.sign(x), 0)


def convert(x: np.ndarray, to) -> np.ndarray:
    """Cast of elements: floats round half away from zero, NaN is 0, all clamp."""
    to = np.dtype(to)
    if x.dtype == to:
        return x
    if is_float(to):
        return x.astype(to)
    lo, hi = int(np.iinfo(to).min), int(np.iinfo(to).max)
    if is_float(x.dtype):
        r = np.nan_to_num(round_away(x.astype("f8")), nan=0.0, posinf=np.inf, neginf=-np.inf)
        out = np.clip(r, float(lo), np.nextafter(float(hi), 0) if float(hi) > hi else float(hi)).astype(to)
        return np.where(r >= float(hi), to.type(hi), out).astype(to)
    x_lo, x_hi = int(np.iinfo(x.dtype).min), int(np.iinfo(x.dtype).max)
    if x_lo < lo:
        x = np.maximum(x, x.dtype.type(lo))
    if x_hi > hi:
        x = np.minimum(x, x.dtype.type(hi))
    return x.astype(to)


@dataclass
class Value:
    """kind: tensor, scalar, image, audio, bytes, arg or composite."""

    kind: str
    data: object = None
    color: str = ""
    layout: str = ""
    rate: int = 0
    items: list[Value] = field(default_factory=list)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.data.shape)

    @property
    def dtype(self) -> np.dtype:
        return self.data.dtype

    def with_data(self, data: np.ndarray) -> Value:
        return replace(self, data=data)

    # audio
    @property
    def channels(self) -> int:
        if self.kind == "image":
            return CHANNELS[self.color]
        if self.data.ndim < 2:
            return 1
        return self.shape[1] if self.layout == "interleaved" else self.shape[0]

    @property
    def samples(self) -> int:
        if self.data.ndim < 2:
            return self.data.size
        return self.shape[0] if self.layout == "interleaved" else self.shape[1]

    @property
    def channel_layout(self) -> str:
        return LAYOUTS.get(self.channels, "custom")

    # image
    def hwc(self) -> np.ndarray:
        """[h, w, c] whatever the layout; rank 2 gets one channel."""
        if self.data.ndim == 2:
            return self.data[:, :, None]
        return self.data.transpose(1, 2, 0) if self.layout == "chw" else self.data


def tensor(data, dtype=None) -> Value:
    """A tensor value; rank 0 is a scalar."""
    a = np.asarray(data, dtype=None if dtype is None else dtype_of(dtype) if isinstance(dtype, str) else dtype)
    if a.dtype not in NAMES:
        a = a.astype("u1" if a.dtype == bool else "f4" if a.dtype.kind == "f" else "i8")
    return Value("tensor" if a.ndim else "scalar", a)


def image(data, color: str = "rgb", layout: str = "hwc") -> Value:
    """An image; its rank and channel axis must suit the colour space."""
    a = np.asarray(data)
    if a.dtype == np.float64:
        a = a.astype("f4")
    n = CHANNELS.get(color)
    if n is None or layout not in ("hwc", "chw"):
        raise TypeMismatch(f"unknown color space or layout: {color}, {layout}")
    got = 1 if a.ndim == 2 else a.shape[2 if layout == "hwc" else 0] if a.ndim == 3 else None
    if got != n:
        raise TypeMismatch(f"an image of shape {a.shape} can't be {color} in {layout}")
    return Value("image", a, color=color, layout=layout)


def audio(data, rate: int, layout: str = "planar") -> Value:
    """Audio samples of rank 1 (mono) or 2."""
    a = np.asarray(data)
    if a.dtype == np.float64:
        a = a.astype("f4")
    if int(rate) <= 0 or a.ndim not in (1, 2) or layout not in ("planar", "interleaved"):
        raise TypeMismatch(f"audio needs a rate, rank 1 or 2 and a known layout: {rate}, {a.shape}, {layout}")
    return Value("audio", a, rate=int(rate), layout=layout)


def composite(*items: Value) -> Value:
    return Value("composite", items=list(items))


def raw(data: bytes) -> Value:
    return Value("bytes", bytes(data))


def arg(text: str) -> Value:
    return Value("arg", str(text))
