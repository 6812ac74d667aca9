"""Geometry and filters of images held in tensors."""

from __future__ import annotations

import math

import numpy as np

from ..registry import Args, action
from ..types import CHANNELS, ExecutionError, Value, round_away
from .base import choice, target_color, target_dtype, target_layout
from .math import same

PACK = "image_basics"
F4 = np.dtype("f4")


def keep_tensor(t, args):
    return ("tensor", t[1])


class Picture:
    """A tensor's pixels as [h, w, c] and how to put them back. Rank 3 with at
    most 4 in the last axis is channels-last; else at most 4 in the first is
    channels-first; else channels-last."""

    def __init__(self, v: Value):
        if v.dtype not in (np.dtype("f4"), np.dtype("u1")) or v.data.ndim not in (2, 3) or not v.data.size:
            raise ExecutionError(f"an image tensor of F32 or U8 and rank 2 or 3 is needed, not {v.dtype} of shape {v.shape}")
        self.v, self.flat = v, v.data.ndim == 2
        self.chw = not self.flat and v.shape[2] > 4 and v.shape[0] <= 4
        x = v.data[:, :, None] if self.flat else v.data.transpose(1, 2, 0) if self.chw else v.data
        self.h, self.w, self.c = x.shape
        self.small = v.dtype == np.uint8
        self.raw = x

    @property
    def unit(self) -> np.ndarray:
        """Single precision, U8 scaled to 0..1."""
        return self.raw.astype(F4) / F4.type(255) if self.small else self.raw

    @property
    def plain(self) -> np.ndarray:
        return self.raw.astype(F4)

    def put(self, x: np.ndarray, unit: bool = True, hwc: bool = False) -> Value:
        """``unit``: U8 values are scaled to 0..1. ``hwc``: the result is channels-last."""
        if self.small and x.dtype != np.uint8:
            x = round_away(np.clip(x * (F4.type(255) if unit else F4.type(1)), 0, 255)).astype("u1")
        x = x.astype(self.v.dtype)
        if self.flat:
            x = x[:, :, 0]
        elif self.chw and not hwc:
            x = x.transpose(2, 0, 1)
        return Value("tensor", np.ascontiguousarray(x))


@action(PACK, "to_image", "tensor", lambda t, args: ("image", np.dtype(F4 if target_dtype(args, "u8") == "f32" else "u1")))
def to_image(v: Value, args: Args) -> Value:
    if v.data.ndim in (2, 3):
        p = Picture(v)
    else:
        p = Picture(Value("tensor", v.data.reshape(1, -1)))
    color = target_color(args) or {1: "grayscale", 3: "rgb", 4: "rgba"}.get(p.c, "rgb")
    x, n = p.unit, CHANNELS[color]
    if n != p.c:
        x = adapted(x, n)
    dtype, scale = target_dtype(args, "u8"), choice(args, "denormalize", "unnormalize")
    if dtype == "u8":
        x = round_away(np.clip(x * F4.type(255 if scale is not False else 1), 0, 255)).astype("u1")
    layout = target_layout(args)
    x = x[:, :, 0] if n == 1 and p.flat else x.transpose(2, 0, 1) if layout == "chw" else x
    return Value("image", np.ascontiguousarray(x), color=color, layout=layout)


def adapted(x: np.ndarray, n: int) -> np.ndarray:
    """Channels to ``n``: gray repeats, alpha is 1 or goes, colour to gray by luma."""
    c, one = x.shape[2], np.ones(x.shape[:2] + (1,), x.dtype)
    if c == 1 and n in (3, 4):
        return np.concatenate([x, x, x] + [one] * (n - 3), axis=2)
    if (c, n) == (3, 4):
        return np.concatenate([x, one], axis=2)
    if (c, n) == (4, 3):
        return x[:, :, :3]
    if n == 1 and c in (3, 4):
        return (F4.type(0.299) * x[:, :, 0] + F4.type(0.587) * x[:, :, 1] + F4.type(0.114) * x[:, :, 2])[:, :, None]
    return np.concatenate([x[:, :, :n], np.zeros(x.shape[:2] + (max(0, n - c),), x.dtype)], axis=2)


# geometry


def _size(args: Args, p: Picture) -> tuple[int, int]:
    w, h = args.integer("width", "w", at=0), args.integer("height", "h", at=1)
    scale = args.number("scale")
    sx, sy = args.number("scale_x", default=scale), args.number("scale_y", default=scale)
    if args.flag("keep_aspect_ratio") and (w or h):
        if w and h:
            f = min(w / p.w, h / p.h)
            w, h = round(p.w * f), round(p.h * f)
        elif w:
            h = round(p.h * w / p.w)
        else:
            w = round(p.w * h / p.h)
    w = w if w is not None else round(p.w * sx) if sx else p.w
    h = h if h is not None else round(p.h * sy) if sy else p.h
    if w < 1 or h < 1:
        raise ExecutionError(f"can't resize to {w} x {h}")
    return int(h), int(w)


def _linear(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    old = x.shape[axis]
    c = (np.arange(n, dtype=F4) + F4.type(0.5)) * F4.type(old / n) - F4.type(0.5)
    a = np.clip(np.floor(c), 0, old - 1).astype(int)
    d = np.clip(c - a, 0, 1).astype(F4).reshape([-1 if k == axis else 1 for k in range(x.ndim)])
    return np.take(x, a, axis) * (1 - d) + np.take(x, np.minimum(a + 1, old - 1), axis) * d


def _cubic(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    old = x.shape[axis]
    c = (np.arange(n) + 0.5) * (old / n) - 0.5
    base = np.floor(c).astype(int)
    out: np.ndarray | float = 0.0
    for k in range(-1, 3):
        t = np.abs(c - (base + k))
        w = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0)).astype(F4)
        out = out + np.take(x, np.clip(base + k, 0, old - 1), axis) * w.reshape([-1 if j == axis else 1 for j in range(x.ndim)])
    return out


def _area(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    old = x.shape[axis]
    parts = []
    for o in range(n):
        a = math.floor(o * old / n)
        b = min(old, max(a + 1, math.ceil((o + 1) * old / n)))
        parts.append(np.take(x, range(a, b), axis).mean(axis=axis, keepdims=True, dtype=F4))
    return np.concatenate(parts, axis=axis)


def resized(p: Picture, h: int, w: int, how: str) -> np.ndarray:
    if how == "nearest":
        at = lambda old, n: np.minimum(np.floor(np.arange(n, dtype=F4) * F4.type(F4.type(old) / F4.type(n))).astype(int), old - 1)
        return p.raw[at(p.h, h)][:, at(p.w, w)]
    f = {"bicubic": _cubic, "area": _area}.get(how, _linear)
    return f(f(p.plain, h, 0), w, 1)


# Other names of the filters.
FILTERS = {"nearest": "nearest", "neighbor": "nearest", "bicubic": "bicubic", "cubic": "bicubic", "area": "area", "box": "area"}


@action(PACK, "resize", "tensor", keep_tensor)
def resize(v: Value, args: Args) -> Value:
    """Bicubic and area exist for F32 channels-last only: channels-first falls
    back to nearest and U8 to bilinear."""
    p = Picture(v)
    how = FILTERS.get((args.text("filter") or "").strip().lower(), "bilinear")
    if how in ("bicubic", "area"):
        how = "bilinear" if p.small else "nearest" if p.chw else how
    return p.put(resized(p, *_size(args, p), how), unit=False)


def resize_all(v: Value, args: Args) -> Value:
    """The accelerated twin: every filter for every layout and dtype."""
    p = Picture(v)
    return p.put(resized(p, *_size(args, p), FILTERS.get((args.text("filter") or "").strip().lower(), "bilinear")), unit=False)


@action(PACK, "crop", "tensor", keep_tensor)
def crop(v: Value, args: Args) -> Value:
    p = Picture(v)
    x, y = (min(max(0, args.integer(n, at=k, default=0)), s) for k, (n, s) in enumerate((("x", p.w), ("y", p.h))))
    w, h = args.integer("width", "w", at=2, default=p.w - x), args.integer("height", "h", at=3, default=p.h - y)
    out = p.raw[y : y + max(0, h), x : x + max(0, w)]
    if not out.size:
        raise ExecutionError("nothing is left of the image")
    return p.put(out)


@action(PACK, "pad", "tensor", keep_tensor)
def pad(v: Value, args: Args) -> Value:
    p = Picture(v)
    every = args.integer("pad", at=0, default=0)
    t, b, l, r = (max(0, args.integer(s, f"pad_{s}", default=every)) for s in ("top", "bottom", "left", "right"))
    mode = (args.text("mode") or "constant").strip().lower()
    if mode in ("edge", "replicate", "clamp", "reflect", "mirror"):
        mirror = mode in ("reflect", "mirror")

        def index(n: int, before: int, after: int) -> np.ndarray:
            o = np.arange(before + n + after)
            if not mirror:
                return np.clip(o - before, 0, n - 1)
            first = np.minimum(before - o, n - 1)
            last = np.maximum(n - 1 - (o - (before + n) + 1), 0)
            return np.where(o < before, first, np.where(o < before + n, o - before, last))

        return p.put(p.raw[index(p.h, t, b)][:, index(p.w, l, r)], hwc=True)
    fill = args.number("fill", "fill_value", default=0.0)
    out = np.full((p.h + t + b, p.w + l + r, p.c), np.clip(fill, 0, 255) if p.small else fill).astype(v.dtype)
    out[t : t + p.h, l : l + p.w] = p.raw
    return p.put(out, hwc=True)


@action(PACK, "flip", "tensor", same)
def flip(v: Value, args: Args) -> Value:
    p = Picture(v)
    how = (args.text("axis", at=0) or "horizontal").strip().lower()
    if how in ("horizontal", "h", "x", "1"):
        return p.put(p.raw[:, ::-1])
    if how in ("vertical", "v", "y", "0"):
        return p.put(p.raw[::-1])
    return p.put(p.raw[::-1, ::-1]) if how in ("both", "hv", "xy") else v


def turned(p: Picture, args: Args) -> np.ndarray:
    angle = args.number("angle", "angle_deg", at=0, default=90.0) % 360
    if angle % 90 == 0:
        return np.rot90(p.raw, -int(angle // 90))
    a = math.radians(angle)
    c, s = math.cos(a), math.sin(a)
    w, h = p.w, p.h
    if (args.text("expand") or "true").strip().lower() in ("true", "1", "yes"):
        w, h = max(1, round(p.w * abs(c) + p.h * abs(s))), max(1, round(p.w * abs(s) + p.h * abs(c)))
    dx, dy = np.meshgrid(np.arange(w) - w / 2, np.arange(h) - h / 2)
    x, y = dx * c + dy * s + p.w / 2, -dx * s + dy * c + p.h / 2
    ok = (x >= 0) & (x < p.w - 1) & (y >= 0) & (y < p.h - 1)
    i, j = np.where(ok, y, 0).astype(int), np.where(ok, x, 0).astype(int)
    fy, fx = (np.where(ok, z - k, 0).astype(F4)[:, :, None] for z, k in ((y, i), (x, j)))
    q, i2, j2 = p.plain, np.minimum(i + 1, p.h - 1), np.minimum(j + 1, p.w - 1)
    mixed = (q[i, j] * (1 - fx) + q[i, j2] * fx) * (1 - fy) + (q[i2, j] * (1 - fx) + q[i2, j2] * fx) * fy
    return np.where(ok[:, :, None], mixed, F4.type(args.number("fill", default=0.0))).astype(F4)


@action(PACK, "rotate", "tensor", keep_tensor)
def rotate(v: Value, args: Args) -> Value:
    p = Picture(v)
    return p.put(turned(p, args), unit=False, hwc=True)


def rotate_keeping(v: Value, args: Args) -> Value:
    """The accelerated twin keeps channels first."""
    p = Picture(v)
    return p.put(turned(p, args), unit=False)


# colour


@action(PACK, "color_adjust", "tensor", same)
def color_adjust(v: Value, args: Args) -> Value:
    p, n = Picture(v), args.number
    x = p.unit.copy()
    rgb = x[:, :, :3] if p.c != 2 else x[:, :, :1]
    y = (rgb * F4.type(2 ** n("exposure", default=0.0)) - F4.type(0.5)) * F4.type(n("contrast", default=1.0)) + F4.type(0.5 + n("brightness", default=0.0))
    gamma = max(0.001, n("gamma", default=1.0))
    if gamma != 1:
        y = np.power(np.maximum(y, 0), F4.type(1 / gamma))
    sat = n("saturation", "sat", default=1.0)
    if sat != 1 and y.shape[2] == 3:
        r, b = (2, 0) if (args.text("color") or "rgb").strip().lower().startswith("bgr") else (0, 2)
        luma = (F4.type(0.299) * y[:, :, r] + F4.type(0.587) * y[:, :, 1] + F4.type(0.114) * y[:, :, b])[:, :, None]
        y = luma + (y - luma) * F4.type(sat)
    x[:, :, : y.shape[2]] = y
    return p.put(x)


@action(PACK, "threshold", "tensor", same)
def threshold(v: Value, args: Args) -> Value:
    p = Picture(v)
    x, top = p.plain, 255.0 if p.small else 1.0
    mode = (args.text("mode") or "binary").strip().lower()
    t = args.number("threshold", "thresh", at=0, default=128.0 if p.small else 0.5, dtype=F4.type)
    m = F4.type(args.number("max_val", "max", default=top))
    if mode == "otsu":
        level = otsu(p.raw if p.small else round_away(np.clip(p.raw, 0, 1) * F4.type(255)).astype("u1"))
        t, mode = (level if p.small else level / 255), "binary"
    on = x >= F4.type(t)
    out = {"binary_inv": np.where(on, 0, m), "inv": np.where(on, 0, m), "truncate": np.minimum(x, F4.type(t)), "trunc": np.minimum(x, F4.type(t)), "to_zero": np.where(on, x, 0), "tozero": np.where(on, x, 0), "to_zero_inv": np.where(on, 0, x)}.get(mode, np.where(on, m, 0))
    return p.put(out.astype(F4), unit=False)


def otsu(x: np.ndarray) -> int:
    """The first of 256 levels with the largest variance between the classes."""
    h = np.bincount(x.reshape(-1), minlength=256).astype("f8")
    below, mass = np.cumsum(h), np.cumsum(h * np.arange(256))
    above = below[-1] - below
    with np.errstate(all="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.where((below > 0) & (above > 0), between, -1)))


@action(PACK, "blend", "tensor", same)
def blend(v: Value, args: Args) -> Value:
    p = Picture(v)
    o = F4.type(min(max(args.number("opacity", "alpha", default=1.0), 0.0), 1.0))
    given = [float(t) for t in (args.text("color") or "").strip("[]() ").split(",") if t.strip()]
    given = [g / 255 for g in given] if any(g > 1 for g in given) else given
    b = np.array([given[k] if k < len(given) else 1.0 for k in range(p.c)], F4)
    x = p.unit
    a = x[:, :, :3] if p.c == 4 else x
    b = b[: a.shape[2]]
    f = {
        "multiply": lambda: a * b, "screen": lambda: 1 - (1 - a) * (1 - b), "overlay": lambda: np.where(a < 0.5, 2 * a * b, 1 - 2 * (1 - a) * (1 - b)),
        "add": lambda: a + b, "subtract": lambda: a - b, "difference": lambda: np.abs(a - b), "darken": lambda: np.minimum(a, b), "lighten": lambda: np.maximum(a, b),
    }.get((args.text("mode", at=0) or "alpha").strip().lower(), lambda: np.broadcast_to(b, a.shape))
    out = x.copy()
    out[:, :, : a.shape[2]] = (1 - o) * a + o * f()
    return p.put(out)


# filters


def shifted(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """x moved so that each pixel sees its neighbour at (dy, dx); borders repeat."""
    h, w = x.shape[:2]
    return x[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)]


def blurred(x: np.ndarray, args: Args, box: bool = False) -> np.ndarray:
    sigma = max(0.01, args.number("sigma", default=1.0))
    radius = args.integer("radius", default=max(1, math.ceil(3 * sigma)))
    k = np.arange(-radius, radius + 1)
    w = np.ones(len(k)) if box else np.exp(-(k**2) / (2 * sigma * sigma))
    w = (w / w.sum()).astype(F4)
    for axis in (1, 0):
        x = sum(shifted(x, *((0, d) if axis else (d, 0))) * c for d, c in zip(k, w))
    return x


@action(PACK, "gaussian_blur", "tensor", same)
def gaussian_blur(v: Value, args: Args) -> Value:
    p = Picture(v)
    if args.text("sigma") is None and args.positional:
        args = Args(args.positional, args.named | {"sigma": args.positional[0]})
    return p.put(blurred(p.unit, args, (args.text("mode", "type") or "").strip().lower() == "box"))


@action(PACK, "sharpen", "tensor", same)
def sharpen(v: Value, args: Args) -> Value:
    p = Picture(v)
    s = F4.type(args.number("strength", "amount", at=0, default=1.0))
    x = p.unit
    return p.put(x + s * (x - blurred(x, args)))


@action(PACK, "edge_detect", "tensor", same)
def edge_detect(v: Value, args: Args) -> Value:
    p = Picture(v)
    mode = (args.text("mode", "filter", at=0) or "sobel").strip().lower()
    s = F4.type(args.number("strength", "scale", default=1.0))
    x = p.unit
    if mode == "laplacian":
        out = np.abs(shifted(x, -1, 0) + shifted(x, 1, 0) + shifted(x, 0, -1) + shifted(x, 0, 1) - 4 * x)
    elif mode in ("sobel", "sobel_x", "sobel_y", "prewitt"):
        m = F4.type(1 if mode == "prewitt" else 2)
        side = lambda a, b: sum(shifted(x, *d) * (m if 0 in d else 1) for d in a) - sum(shifted(x, *d) * (m if 0 in d else 1) for d in b)
        gx = side([(-1, 1), (0, 1), (1, 1)], [(-1, -1), (0, -1), (1, -1)])
        gy = side([(1, -1), (1, 0), (1, 1)], [(-1, -1), (-1, 0), (-1, 1)])
        out = np.abs(gx) if mode == "sobel_x" else np.abs(gy) if mode == "sobel_y" else np.sqrt(gx * gx + gy * gy)
    else:
        raise ExecutionError(f"unknown edge filter {mode!r}")
    return p.put(out * s)


@action(PACK, "morphology", "tensor", same)
def morphology(v: Value, args: Args) -> Value:
    p = Picture(v)
    op = (args.text("op", at=0) or "dilate").strip().lower()
    r = max(1, args.integer("kernel_size", "ksize", default=3)) // 2
    form = (args.text("shape") or "rect").strip().lower()
    times = max(1, args.integer("iterations", "iter", default=1))
    near = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if form not in ("cross", "ellipse", "circle") or (form == "cross" and 0 in (x, y)) or (form != "cross" and x * x + y * y <= r * r)]

    def go(x: np.ndarray, f, n: int = times) -> np.ndarray:
        for _ in range(n):
            x = f.reduce([shifted(x, *d) for d in near])
        return x

    x, grow, shrink = p.raw, np.maximum, np.minimum
    if op == "erode":
        out = go(x, shrink)
    elif op == "open":
        out = go(go(x, shrink), grow)
    elif op == "close":
        out = go(go(x, grow), shrink)
    elif op == "gradient":
        out = go(x, grow, 1) - go(x, shrink, 1)
    else:
        out = go(x, grow)
    return p.put(out)


TWIN_KERNELS = {"resize": resize_all, "rotate": rotate_keeping}
