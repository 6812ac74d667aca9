"""Bidirectional gated recurrent layers with attention pooling, in numpy.

Arrays are time-major: (steps, rows, width). Masks are 1 where a step exists.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init_layer(rng: np.random.Generator, name: str, width: int, hidden: int, attention: int) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"{name}.W{d}"] = rng.normal(0, 1 / np.sqrt(width), (width, 3 * hidden))
        p[f"{name}.U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p[f"{name}.B{d}"] = np.zeros(3 * hidden)
    p[f"{name}.A"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, attention))
    p[f"{name}.v"] = rng.normal(0, 1 / np.sqrt(attention), attention)
    return {k: v.astype(np.float32) for k, v in p.items()}


def scan(pre: np.ndarray, mask: np.ndarray, U: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
    """States of one direction from the projected inputs ``pre`` (steps, rows, 3
    hidden). Rows behind the last that a step's mask holds are left out of it, so
    rows by falling length cost no more than their steps; their states are 0."""
    T, N, H3 = pre.shape
    H = H3 // 3
    h = np.zeros((N, H), pre.dtype)
    out = np.zeros((T, N, H), pre.dtype)
    rows = N - np.argmax(mask[:, ::-1] > 0, axis=1) if N else np.zeros(T, int)
    for t in range(T - 1, -1, -1) if backward else range(T):
        k = rows[t]
        was = h[:k]
        u = was @ U
        gates = sigmoid(pre[t, :k, : 2 * H] + u[:, : 2 * H])
        z, r = gates[:, :H], gates[:, H:]
        un = u[:, 2 * H :]
        n = np.tanh(pre[t, :k, 2 * H :] + r * un)
        m = mask[t, :k, None]
        new = was + m * (1 - z) * (n - was)
        if keep is not None:
            keep.append((t, k, was.copy(), z, r, n, un, m))
        h[:k] = out[t, :k] = new
    return out


def scan_gradient(d_out: np.ndarray, keep: list, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the projected inputs and by U, from those by the states."""
    T, N, H = d_out.shape
    d_pre = np.zeros((T, N, 3 * H), d_out.dtype)
    d_u = np.zeros_like(U)
    d_h = np.zeros((N, H), d_out.dtype)
    for t, k, h, z, r, n, un, m in reversed(keep):
        d = d_h[:k] + d_out[t, :k]
        d_n = d * m * (1 - z) * (1 - n * n)
        d_z = -d * m * (n - h) * z * (1 - z)
        d_r = d_n * un * r * (1 - r)
        d_pre[t, :k] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_rec = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h.T @ d_rec
        d_h[:k] = d * (1 - m * (1 - z)) + d_rec @ U.T
    return d_pre, d_u


def pool(states: np.ndarray, mask: np.ndarray, A: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Attention-weighted mean of the states; rows without steps give zeros."""
    k = np.tanh(states @ A)
    s = k @ v
    e = np.exp(s - np.where(mask > 0, s, -np.inf).max(axis=0, initial=-60)) * mask
    w = e / np.maximum(e.sum(axis=0), 1e-9)
    return np.einsum("tn,tnh->nh", w, states), (k, w)


def forward(p: dict, name: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    keeps: tuple[list, list] = ([], [])
    states = np.concatenate([scan(x @ p[f"{name}.W{d}"] + p[f"{name}.B{d}"], mask, p[f"{name}.U{d}"], d == "b", keep) for d, keep in zip("fb", keeps)], axis=2)
    out, (k, w) = pool(states, mask, p[f"{name}.A"], p[f"{name}.v"])
    return out, (x, keeps, states, k, w)


def gradient(p: dict, name: str, d_out: np.ndarray, cache: tuple, g: dict) -> np.ndarray:
    """Adds the layer's gradients to ``g``; returns the one by its input."""
    x, keeps, states, k, w = cache
    d_states = w[:, :, None] * d_out[None]
    d_w = np.einsum("nh,tnh->tn", d_out, states)
    d_s = w * (d_w - (w * d_w).sum(axis=0))
    g[f"{name}.v"] = np.einsum("tn,tna->a", d_s, k)
    d_k = d_s[:, :, None] * p[f"{name}.v"] * (1 - k * k)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    g[f"{name}.A"] = flat(states).T @ flat(d_k)
    d_states = d_states + d_k @ p[f"{name}.A"].T
    H = states.shape[2] // 2
    d_x = 0
    for d, keep, part in zip("fb", keeps, (d_states[:, :, :H], d_states[:, :, H:])):
        d_pre, g[f"{name}.U{d}"] = scan_gradient(part, keep, p[f"{name}.U{d}"])
        g[f"{name}.W{d}"] = flat(x).T @ flat(d_pre)
        g[f"{name}.B{d}"] = d_pre.sum(axis=(0, 1))
        d_x = d_x + d_pre @ p[f"{name}.W{d}"].T
    return d_x


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for k, x in g.items():  # parameters without a gradient stay
            x = x * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.s[k] = 0.999 * self.s[k] + 0.001 * x * x
            m, s = self.m[k] / (1 - 0.9**self.t), self.s[k] / (1 - 0.999**self.t)
            self.p[k] -= (self.rate * m / (np.sqrt(s) + 1e-8)).astype(self.p[k].dtype)
