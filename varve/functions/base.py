"""Identity and the standard tensor form of media."""

from __future__ import annotations

import numpy as np

from ..registry import Args, action
from ..types import CHANNELS, Value, round_away
from .math import same

PACK = "base"
# Names of colour spaces in arguments, and BT.601 luma weights.
COLORS = {"rgb": "rgb", "rgba": "rgba", "bgr": "bgr", "bgra": "bgra", "grayscale": "grayscale", "gray": "grayscale", "grey": "grayscale"}
LUMA = (0.299, 0.587, 0.114)
_YES, _NO = ("true", "1", "yes"), ("false", "0", "no")


def choice(args: Args, *names: str) -> bool | None:
    t = (args.text(*names) or "").strip().lower()
    return True if t in _YES else False if t in _NO else None


def target_color(args: Args) -> str | None:
    return COLORS.get((args.text("color", "color_space", at=0) or "").strip().lower())


def target_layout(args: Args) -> str:
    return "chw" if (args.text("layout") or "").strip().lower() in ("chw", "planar") else "hwc"


def target_dtype(args: Args, default: str) -> str:
    t = (args.text("dtype") or "").strip().lower()
    return "f32" if t in ("f32", "float", "float32") else "u8" if t in ("u8", "uint8", "byte", "bytes") else default


@action(PACK, "identity", "tensor scalar image audio bytes arg composite", same)
def identity(v: Value, args: Args) -> Value:
    return v


def raw_image(v: Value) -> Value | None:
    """A rank 2 or 3 tensor as an image by the usual heuristic of its channel axis."""
    s = v.shape
    if len(s) not in (2, 3):
        return None
    layout = "chw" if len(s) == 3 and s[2] > 4 and s[0] <= 4 else "hwc"
    n = 1 if len(s) == 2 else s[0] if layout == "chw" else s[2]
    color = {1: "grayscale", 3: "rgb", 4: "rgba"}.get(n, "rgb")
    return Value("image", v.data, color=color, layout=layout) if CHANNELS[color] == n else None


def to_rgba(x: np.ndarray, color: str) -> np.ndarray:
    """Channels last, values as they are: red, green, blue and alpha (0 to 1)."""
    one = np.ones(x.shape[:-1] + (1,), x.dtype)
    if color in ("grayscale", "grayscale_alpha"):
        g = x[..., :1]
        return np.concatenate([g, g, g, x[..., 1:2] if color == "grayscale_alpha" else one], axis=-1)
    if color in ("bgr", "bgra"):
        x = np.concatenate([x[..., 2::-1], x[..., 3:]], axis=-1)
    return x if x.shape[-1] == 4 else np.concatenate([x, one], axis=-1)


def from_rgba(x: np.ndarray, color: str) -> np.ndarray:
    luma = sum(x.dtype.type(w) * x[..., k] for k, w in enumerate(LUMA))[..., None]
    if color == "grayscale":
        return luma
    if color == "grayscale_alpha":
        return np.concatenate([luma, x[..., 3:]], axis=-1)
    if color in ("bgr", "bgra"):
        x = np.concatenate([x[..., 2::-1], x[..., 3:]], axis=-1)
    return x[..., : CHANNELS[color]]


def _tensor_result(t, args):
    return ("tensor", np.dtype("u1") if target_dtype(args, "f32") == "u8" else np.dtype("f4") if t[0] != "audio" else t[1])


@action(PACK, "to_tensor", "image tensor audio", _tensor_result)
def to_tensor(v: Value, args: Args) -> Value:
    if v.kind == "audio":
        return Value("tensor", v.data)
    img = v if v.kind == "image" else raw_image(v)
    if img is None:
        return v
    color, dtype = target_color(args) or img.color, target_dtype(args, "f32")
    norm = choice(args, "normalize")
    x = img.hwc()
    small = x.dtype == np.uint8
    x = x.astype("f4") / np.float32(255) if small else x.astype("f4")
    if color != img.color:
        x = from_rgba(to_rgba(x, img.color), color)
    if dtype == "u8":
        scale = np.float32(1) if norm is False and not small else np.float32(255)
        x = round_away(np.clip(x * scale, 0, 255)).astype("u1")
    elif small and norm is False:
        x = x * np.float32(255)
    if x.shape[-1] == 1:
        x = x[..., 0]
    elif target_layout(args) == "chw":
        x = x.transpose(2, 0, 1)
    return Value("tensor", np.ascontiguousarray(x))
