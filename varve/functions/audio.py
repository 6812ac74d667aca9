"""Decoding, encoding and effects of audio."""

from __future__ import annotations

import math
import struct
from dataclasses import replace
from functools import lru_cache

import numpy as np

from ..registry import Args, action
from ..types import ExecutionError, Value, round_away
from .math import same

PACK = "audio_basics"
F4 = np.dtype("f4")


def audio_result(t, args):
    return ("audio", F4)


def samples(v: Value) -> np.ndarray:
    if v.dtype != F4:
        raise ExecutionError(f"F32 samples are needed, not {v.dtype}")
    return v.data


def rate_of(v: Value, args: Args) -> float:
    r = args.number("sample_rate", "rate")
    return r if r and r > 0 else float(v.rate)


def planes(v: Value) -> np.ndarray:
    """[channels, samples] of planar audio; effects treat any as planar."""
    x = samples(v)
    return x.reshape(1, -1) if x.ndim < 2 else x


# decoding

_WIDTH = {"u8": 1, "uint8": 1, "i16": 2, "int16": 2, "s16": 2, "i24": 3, "int24": 3, "s24": 3, "i32": 4, "int32": 4, "s32": 4, "f32": 4, "float32": 4, "float": 4}
# Full scale by sample format, decoding and encoding.
DECODE = {"i16": 32768.0, "i24": 8388608.0, "i32": 2147483648.0}
ENCODE = {"i16": 32767.0, "i24": 8388607.0, "i32": 2147483647.0}


def sample_format(text: str | None) -> str:
    t = (text or "i16").strip().lower()
    t = {"16": "i16", "24": "i24", "32": "i32", "8": "u8"}.get(t, t)
    if t not in _WIDTH:
        return "i16"
    return {1: "u8", 2: "i16", 3: "i24"}.get(_WIDTH[t], "f32" if "f" in t else "i32")


def decode(data: bytes, fmt: str, normalize: bool = True) -> np.ndarray:
    n = len(data) // {"u8": 1, "i16": 2, "i24": 3}.get(fmt, 4)
    if fmt == "f32":
        return np.frombuffer(data, "<f4", n).astype(F4)
    if fmt == "u8":
        x = np.frombuffer(data, "u1", n).astype(F4)
        return (x - F4.type(128)) / F4.type(128) if normalize else x
    if fmt == "i24":
        b = np.frombuffer(data, "u1", 3 * n).reshape(-1, 3).astype("i4")
        x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8
    else:
        x = np.frombuffer(data, "<i2" if fmt == "i16" else "<i4", n)
    return x.astype(F4) / F4.type(DECODE[fmt]) if normalize else x.astype(F4)


def encode(x: np.ndarray, fmt: str, clip: bool = True) -> bytes:
    if clip:
        x = np.clip(x, -1, 1)
    if fmt == "f32":
        return x.astype("<f4").tobytes()
    x = np.nan_to_num(x.astype("f8"), nan=0.0, posinf=2.0**40, neginf=-(2.0**40))
    if fmt == "u8":
        return np.clip(round_away(x * 127) + 128, 0, 255).astype("u1").tobytes()
    top = ENCODE[fmt]
    y = np.clip(round_away(x * top), -top - 1, top).astype("i8")
    if fmt == "i24":
        return y.astype("<i4").view("u1").reshape(-1, 4)[:, :3].tobytes()
    return y.astype("<i2" if fmt == "i16" else "<i4").tobytes()


def parse_wav(data: bytes) -> tuple[np.ndarray, int, int] | None:
    """(interleaved samples, channels, rate), or None if it is no wave file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        chunk = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(chunk) >= 16:
            fmt = chunk
        elif name == b"data":
            body = chunk
        at += 8 + size + (size & 1)
    if fmt is None or body is None:
        return None
    tag, channels, rate = struct.unpack_from("<HHI", fmt)
    bits = struct.unpack_from("<H", fmt, 14)[0]
    if tag == 0xFFFE and len(fmt) >= 26:  # extensible
        tag = struct.unpack_from("<H", fmt, 24)[0]
    kind = {(1, 8): "u8", (1, 16): "i16", (1, 24): "i24", (1, 32): "i32", (3, 32): "f32"}.get((tag, bits))
    if kind is None or not channels or not rate:
        return None
    return decode(body, kind), channels, rate


def planar(x: np.ndarray, channels: int) -> np.ndarray:
    """Interleaved samples as a mono vector or [channels, samples]."""
    n = len(x) // channels
    return x if channels == 1 else np.ascontiguousarray(x[: n * channels].reshape(n, channels).T)


@action(PACK, "to_audio", "bytes tensor scalar", audio_result)
def to_audio(v: Value, args: Args) -> Value:
    rate = args.integer("sample_rate", "rate", at=0)
    channels = args.integer("channels", "channel_count")
    normalize = (args.text("normalize") or "true").strip().lower() not in ("false", "0", "no", "off")
    if v.kind == "bytes":
        if wav := parse_wav(v.data):
            x, n, own = wav
            return Value("audio", planar(x, n), rate=rate or own, layout="planar")
        n = max(1, channels or 2)
        x = decode(v.data, sample_format(args.text("dtype", "format")), normalize)
        if (args.text("layout") or "").strip().lower() in ("planar", "non-interleaved"):
            data = x if n == 1 else x[: len(x) // n * n].reshape(n, -1)
        else:
            data = planar(x, n)
        return Value("audio", data if x.size else np.zeros((n, 0), F4), rate=rate or 44100, layout="planar")
    x = v.data.astype(F4)
    if normalize and v.dtype == np.uint8:
        x = (x - F4.type(128)) / F4.type(128)
    elif normalize and v.dtype == np.int32:
        x = x / F4.type(2147483648.0)
    n = 1
    if x.ndim == 2:
        n = channels or x.shape[0]
        if n != x.shape[0] and x.shape[0] and n == x.shape[1] <= 8:
            x = x.T
    flat = np.ascontiguousarray(x).reshape(-1)
    if n > 1 and flat.size % n:
        raise ExecutionError(f"{flat.size} samples don't divide into {n} channels")
    return Value("audio", flat if n == 1 else flat.reshape(n, -1), rate=rate or 44100, layout="planar")


def _ordered(v: Value, interleaved: bool) -> np.ndarray:
    x = samples(v)
    if x.ndim == 2 and (v.layout != "interleaved") == interleaved:
        x = x.T
    return np.ascontiguousarray(x).reshape(-1)


@action(PACK, "to_pcm", "audio", lambda t, args: ("bytes", None))
def to_pcm(v: Value, args: Args) -> Value:
    wants = (args.text("layout") or "interleaved").strip().lower() not in ("planar", "non-interleaved")
    clip = (args.text("clip") or "true").strip().lower() not in ("false", "0", "no", "off")
    return Value("bytes", encode(_ordered(v, wants), sample_format(args.text("dtype", "format", at=0)), clip))


@action(PACK, "to_wav", "audio", lambda t, args: ("bytes", None))
def to_wav(v: Value, args: Args) -> Value:
    fmt = sample_format(args.text("dtype", "format", "bits", at=0))
    rate = args.integer("sample_rate", "rate", default=v.rate)
    clip = (args.text("clip") or "true").strip().lower() not in ("false", "0", "no", "off")
    body = encode(_ordered(v, True), fmt, clip)
    width, n = _WIDTH[fmt], v.channels
    head = struct.pack("<HHIIHH", 3 if fmt == "f32" else 1, n, rate, rate * n * width, n * width, 8 * width)
    if fmt == "f32":
        chunks = b"fmt " + struct.pack("<I", 18) + head + b"\0\0" + b"fact" + struct.pack("<II", 4, v.samples)
    else:
        chunks = b"fmt " + struct.pack("<I", 16) + head
    chunks += b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return Value("bytes", b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)


# effects


def per_channel(v: Value, f) -> Value:
    x = planes(v)
    return v.with_data(f(x.astype("f8")).astype(F4).reshape(v.shape))


@action(PACK, "gain", "audio", same)
def gain(v: Value, args: Args) -> Value:
    db = args.number("db")
    s = F4.type(10 ** (db / 20)) if db is not None else F4.type(args.number("linear", at=0, default=1.0))
    return v.with_data(samples(v) * s)


@action(PACK, "normalize", "audio", same)
def normalize(v: Value, args: Args) -> Value:
    x = samples(v)
    db = args.number("target_peak_db", "target_db")
    target = 10 ** (db / 20) if db is not None else args.number("target_peak", default=1.0)
    rms = (args.text("mode", at=0) or "peak").strip().lower() == "rms"
    level = float(np.sqrt((x.astype("f8") ** 2).mean())) if rms and x.size else float(np.abs(x).max(initial=0))
    return v if level < 1e-8 else v.with_data(x * F4.type(target / level))


#: Samples of a block of the linear recurrence.
BLOCK = 256


@lru_cache(maxsize=64)
def _blocks(b0: float, b1: float, b2: float, a1: float, a2: float, n: int) -> tuple[np.ndarray, ...]:
    """Matrices of n steps of the filter: output by input, output by state, and
    the next state by input and by state."""
    step, kick = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(n):
        powers.append(step @ powers[-1])
    response = np.array([b0, *(powers[k][0] @ kick for k in range(n - 1))])
    at = np.arange(n)
    by_input = np.where(at[None, :] >= at[:, None], response[np.abs(at[None, :] - at[:, None])], 0.0)
    by_state = np.array([powers[k][0] for k in range(n)]).T
    to_state = np.array([powers[n - 1 - k] @ kick for k in range(n)])
    return by_input, by_state, to_state, powers[n].T


def linear(x: np.ndarray, b0: float, b1: float, b2: float, a1: float, a2: float) -> np.ndarray:
    """The second-order recurrence over each row: blocks of samples at a time, a
    matrix product each, with two numbers of state from block to block."""
    out, state = np.empty_like(x), np.zeros((len(x), 2))
    if not np.isfinite(x).all():  # a product would spread the others to samples before
        s1 = s2 = state[:, 0]
        for i in range(x.shape[1]):
            y = b0 * x[:, i] + s1
            s1, s2 = b1 * x[:, i] - a1 * y + s2, b2 * x[:, i] - a2 * y
            out[:, i] = y
        return out
    for lo in range(0, x.shape[1], BLOCK):
        part = x[:, lo : lo + BLOCK]
        by_input, by_state, to_state, onward = _blocks(b0, b1, b2, a1, a2, part.shape[1])
        out[:, lo : lo + BLOCK] = part @ by_input + state @ by_state
        state = part @ to_state + state @ onward
    return out


def biquad_coefficients(kind: str, freq: float, q: float, gain_db: float, rate: float) -> tuple[float, ...]:
    w = 2 * math.pi * freq / rate
    c, alpha, a = math.cos(w), math.sin(w) / (2 * q), 10 ** (gain_db / 40)
    b, den = ((1 - c) / 2, 1 - c, (1 - c) / 2), (1 + alpha, -2 * c, 1 - alpha)
    if kind in ("highpass", "hp"):
        b = ((1 + c) / 2, -(1 + c), (1 + c) / 2)
    elif kind in ("bandpass", "bp"):
        b = (alpha, 0.0, -alpha)
    elif kind == "notch":
        b = (1.0, -2 * c, 1.0)
    elif kind in ("peaking", "peak", "eq"):
        b, den = (1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)
    return tuple(x / den[0] for x in (*b, *den[1:]))


@action(PACK, "biquad_filter", "audio", same)
def biquad_filter(v: Value, args: Args) -> Value:
    rate = rate_of(v, args)
    kind = (args.text("type", at=0) or "lowpass").strip().lower()
    freq = min(max(args.number("freq", "cutoff_hz", default=1000.0), 10.0), 0.499 * rate)
    q = max(0.01, args.number("q", default=0.707))
    b0, b1, b2, a1, a2 = biquad_coefficients(kind, freq, q, args.number("gain_db", "gain", default=0.0), rate)

    return per_channel(v, lambda x: linear(x, b0, b1, b2, a1, a2))


def follow(targets: list[float], env: float, fast: float, slow: float, falling: bool) -> list[float]:
    """A level that follows its targets: by ``fast`` where it rises (or falls, if
    ``falling``) and by ``slow`` else. Plain numbers: each step needs the last."""
    out = []
    for x in targets:
        a = fast if (x < env if falling else x > env) else slow
        env = a * env + (1 - a) * x
        out.append(env)
    return out


def smoothing(ms: float, floor: float, rate: float) -> float:
    return math.exp(-1 / (max(ms * 1e-3, floor) * rate))


@action(PACK, "compressor", "audio", same)
def compressor(v: Value, args: Args) -> Value:
    n, rate = args.number, rate_of(v, args)
    t, r, w = n("threshold_db", default=-12.0), max(1.0, n("ratio", default=4.0)), n("knee_db", default=2.0)
    fast, slow = smoothing(n("attack_ms", default=10.0), 1e-4, rate), smoothing(n("release_ms", default=100.0), 1e-3, rate)
    makeup = 10 ** (n("makeup_db", default=0.0) / 20)
    slope = 1 / r - 1

    def run(x):
        over = 20 * np.log10(np.maximum(np.abs(x), 1e-6)) - t
        knee = slope * (over + w / 2) ** 2 / (2 * w) if w > 0 else 0 * over
        g = np.where(2 * over < -w, 0.0, np.where(2 * np.abs(over) <= w, knee, slope * over))
        envelope = np.empty_like(x)
        for k, row in enumerate(g.tolist()):
            envelope[k] = follow(row, -96.0, fast, slow, falling=True)
        return x * 10 ** (envelope / 20) * makeup

    return per_channel(v, run)


@action(PACK, "limiter", "audio", same)
def limiter(v: Value, args: Args) -> Value:
    ceiling = 10 ** (args.number("ceiling_db", "ceiling", at=0, default=-0.1) / 20)
    if (args.text("mode") or "brickwall").strip().lower() in ("soft_clip", "clip", "saturate"):
        drive = max(0.1, args.number("drive", default=1.0))
        return per_channel(v, lambda x: ceiling * np.tanh(drive * x / ceiling))
    slow = smoothing(args.number("release_ms", default=50.0), 1e-3, rate_of(v, args))

    def run(x):
        envelope = np.empty_like(x)
        for k, row in enumerate(np.abs(x).tolist()):
            envelope[k] = follow(row, 0.0, 0.0, slow, falling=False)
        return np.clip(x * np.where(envelope > ceiling, ceiling / np.maximum(envelope, 1e-30), 1.0), -ceiling, ceiling)

    return per_channel(v, run)


@action(PACK, "noise_gate", "audio", same)
def noise_gate(v: Value, args: Args) -> Value:
    n, rate = args.number, rate_of(v, args)
    t, r = n("threshold_db", default=-40.0), max(1.0, n("ratio", default=10.0))
    fast, slow = smoothing(n("attack_ms", default=2.0), 1e-4, rate), smoothing(n("release_ms", default=50.0), 1e-3, rate)
    hold = int(round(max(0.0, n("hold_ms", default=10.0)) * 1e-3 * rate))

    def run(x):
        level = np.where(np.abs(x) <= 1e-6, -120.0, 20 * np.log10(np.maximum(np.abs(x), 1e-6)))
        closed = np.clip(10 ** (-(t - level) * (r - 1) / 20), 0, 1)
        at = np.arange(x.shape[1])
        loud = level >= t
        # the gate holds for that many samples after the last loud one
        last = np.maximum.accumulate(np.where(loud, at, -hold - 1), axis=1)
        target = np.where(loud | (at - last <= hold), 1.0, closed)
        envelope = np.empty_like(x)
        for k, row in enumerate(target.tolist()):
            envelope[k] = follow(row, 0.0, fast, slow, falling=False)
        return x * envelope

    return per_channel(v, run)


@action(PACK, "delay", "audio", same)
def delay(v: Value, args: Args) -> Value:
    length = max(1, int(round_away(np.asarray(args.number("time_ms", "time", at=0, default=120.0) * 1e-3 * rate_of(v, args)))))
    feedback = min(max(args.number("feedback", default=0.35), 0.0), 0.99)
    mix = min(max(args.number("mix", "wet", default=0.3), 0.0), 1.0)

    def run(x):
        w = x.copy()  # w[n] = x[n] + feedback w[n - length], a block of ``length`` at a time
        for i in range(length, x.shape[1], length):
            part = w[:, i : i + length]
            part += feedback * w[:, i - length : i - length + part.shape[1]]
        late = np.zeros_like(x)
        late[:, length:] = w[:, :-length] if x.shape[1] > length else 0
        return (1 - mix) * x + mix * late

    return per_channel(v, run)


@action(PACK, "stereo_widen", "audio", same)
def stereo_widen(v: Value, args: Args) -> Value:
    x = planes(v)
    if len(x) < 2 or v.data.ndim < 2:
        return v
    width = F4.type(max(0.0, args.number("width", "amount", at=0, default=1.2)))
    centre = F4.type(10 ** (args.number("center_gain_db", "center", default=0.0) / 20))
    half = F4.type(0.5)
    mid, side = (x[0] + x[1]) * half * centre, (x[0] - x[1]) * half * width
    out = x.copy()
    out[0], out[1] = mid + side, mid - side
    return v.with_data(out)


@action(PACK, "resample", "audio", same)
def resample(v: Value, args: Args) -> Value:
    """Hann-windowed sinc of half length 8, weights normalized."""
    old = args.number("from_rate", "source_rate", default=float(v.rate))
    new = args.number("to_rate", "rate", at=0, default=44100.0)
    if not (math.isfinite(old) and math.isfinite(new) and old > 0 and new > 0):
        raise ExecutionError("rates must be finite and above 0")
    if abs(old - new) < 0.1:
        return replace(v, rate=int(round(new)))
    x = planes(v).astype("f8")
    n = x.shape[1]
    ratio = new / old
    size = int(round_away(np.asarray(np.float32(n) * np.float32(new) / np.float32(old), "f8")))
    cut = 0.95 * min(ratio, 1.0)
    out = np.zeros((len(x), size))
    for lo in range(0, size, 8192):
        centre = np.arange(lo, min(size, lo + 8192)) / ratio
        j = np.floor(centre).astype(int)[:, None] + np.arange(-8, 10)
        d = j - centre[:, None]
        w = np.where((j >= 0) & (j < n) & (np.abs(d) <= 8), 0.5 * (1 + np.cos(np.pi * d / 8)) * np.sinc(cut * d) * cut, 0.0)
        total = w.sum(axis=1)
        got = np.einsum("cij,ij->ci", x[:, np.clip(j, 0, max(n - 1, 0))], w) if n else np.zeros((len(x), len(centre)))
        out[:, lo : lo + len(centre)] = np.where(np.abs(total) > 1e-6, got / np.where(np.abs(total) > 1e-6, total, 1), 0)
    out = out.astype(F4)
    return replace(v, data=out[0] if len(out) == 1 else out, rate=max(1, int(round(new))), layout="planar")


@action(PACK, "stft", "audio", lambda t, args: ("tensor", F4))
def stft(v: Value, args: Args) -> Value:
    x = samples(v)
    if x.ndim == 2 and v.layout != "planar":
        raise ExecutionError("several channels must be planar")
    n = args.integer("n_fft", at=0, default=1024)
    hop = max(1, args.integer("hop_size", "hop_length", default=256))
    if n < 2:
        raise ExecutionError("n_fft must be at least 2")
    x = x.reshape(1, -1) if x.ndim < 2 else x
    if x.shape[1] < n:
        return Value("tensor", v.data)
    size = 1 << (max(n, 16) - 1).bit_length()
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    frames = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, ::hop]
    return Value("tensor", np.ascontiguousarray(np.abs(np.fft.rfft(frames * window, size, axis=2)).transpose(0, 2, 1)).astype(F4))
