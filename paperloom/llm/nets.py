"""Recurrences over padded batches (steps, sequences, width), with their gradients, and Adam.

A mask of 0 lets the state pass a step unchanged, so padding has no effect on either side.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States of a gated recurrent unit from its gate inputs ``x`` (update, reset, new)."""
    steps, n, width = len(x), x.shape[1], u.shape[0]
    h, out, tape = np.zeros((n, width), x.dtype), np.empty((steps, n, width), x.dtype), []
    for t in range(steps):
        own = h @ u
        gates = sigmoid(x[t, :, : 2 * width] + own[:, : 2 * width])
        z, r = gates[:, :width], gates[:, width:]
        new = np.tanh(x[t, :, 2 * width :] + r * own[:, 2 * width :])
        if keep:
            tape.append((h, z, r, new, own[:, 2 * width :], mask[t]))
        h = h + mask[t] * (1 - z) * (new - h)
        out[t] = h
    return out, tape


def gru_back(dh: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u`` from those of the states."""
    width = u.shape[0]
    dx, du, carry = np.empty((*dh.shape[:2], 3 * width), dh.dtype), np.zeros_like(u), np.zeros_like(dh[0])
    for t in range(len(dh) - 1, -1, -1):
        h, z, r, new, own, mask = tape[t]
        total = dh[t] + carry
        open_ = total * mask
        d_new = open_ * (1 - z) * (1 - new**2)
        d_z = open_ * (h - new) * z * (1 - z)
        d_r = d_new * own * r * (1 - r)
        dx[t] = np.hstack([d_z, d_r, d_new])
        d_own = np.hstack([d_z, d_r, d_new * r])
        du += h.T @ d_own
        carry = total - open_ * (1 - z) + d_own @ u.T
    return dx, du


def lstm(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States of a long short-term memory from its gate inputs ``x`` (in, forget, out, new)."""
    steps, n, width = len(x), x.shape[1], u.shape[0]
    h, c = np.zeros((n, width), x.dtype), np.zeros((n, width), x.dtype)
    out, tape = np.empty((steps, n, width), x.dtype), []
    for t in range(steps):
        raw = x[t] + h @ u
        gates, new = sigmoid(raw[:, : 3 * width]), np.tanh(raw[:, 3 * width :])
        i, f, o = gates[:, :width], gates[:, width : 2 * width], gates[:, 2 * width :]
        cell = f * c + i * new
        shown = np.tanh(cell)
        if keep:
            tape.append((h, c, i, f, o, new, shown, mask[t]))
        c = c + mask[t] * (cell - c)
        h = h + mask[t] * (o * shown - h)
        out[t] = h
    return out, tape


def lstm_back(dh: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u`` from those of the states."""
    width = u.shape[0]
    dx, du = np.empty((*dh.shape[:2], 4 * width), dh.dtype), np.zeros_like(u)
    carry_h, carry_c = np.zeros_like(dh[0]), np.zeros_like(dh[0])
    for t in range(len(dh) - 1, -1, -1):
        h, c, i, f, o, new, shown, mask = tape[t]
        total = dh[t] + carry_h
        open_h, open_c = total * mask, carry_c * mask
        d_cell = open_c + open_h * o * (1 - shown**2)
        raw = np.hstack([d_cell * new * i * (1 - i), d_cell * c * f * (1 - f), open_h * shown * o * (1 - o), d_cell * i * (1 - new**2)])
        dx[t] = raw
        du += h.T @ raw
        carry_h = total - open_h + raw @ u.T
        carry_c = carry_c - open_c + d_cell * f
    return dx, du


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, gradients: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in gradients.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-12))
        step = (rate or self.rate) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in gradients.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (step * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.params[k].dtype)
