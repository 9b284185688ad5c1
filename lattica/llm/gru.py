"""A gated recurrent layer in numpy: a window of steps forward, and back through time."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.negative(x, out=out)
    np.exp(out, out=out)
    out += np.float32(1)
    return np.reciprocal(out, out=out)


def init(rng: np.random.Generator, n_in: int, h: int) -> dict[str, np.ndarray]:
    """W: a column of 3h for each input symbol (update, reset, new); U: recurrent, (3h, h)."""
    w = rng.normal(0, 0.3, (3 * h, n_in)).astype(np.float32)
    u = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
    return {"W": w, "U": u, "b": np.concatenate([np.full(h, 0.5), np.zeros(2 * h)]).astype(np.float32)[:, None]}


def forward(x: np.ndarray, h0: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
    """x: (T, 3H, B) input projections; returns the states (T, H, B) and, with keep, what backward needs.

    Sequences lie along the last axis, so that every slice of gates is one run of memory.
    """
    t, b, h = x.shape[0], x.shape[2], h0.shape[0]
    hs = np.empty((t, h, b), np.float32)
    zr = np.empty((t if keep else 1, 2 * h, b), np.float32)
    n = np.empty((t if keep else 1, h, b), np.float32)
    hn = np.empty((t if keep else 1, h, b), np.float32)
    a, d = np.empty((3 * h, b), np.float32), np.empty((h, b), np.float32)
    prev = h0
    for i in range(t):
        k = i if keep else 0
        np.matmul(u, prev, out=a)
        np.add(a[: 2 * h], x[i, : 2 * h], out=zr[k])
        sigmoid(zr[k], out=zr[k])
        if keep:
            hn[k] = a[2 * h :]
        np.multiply(zr[k, h:], a[2 * h :], out=n[k])
        n[k] += x[i, 2 * h :]
        np.tanh(n[k], out=n[k])
        np.subtract(prev, n[k], out=d)
        d *= zr[k, :h]
        np.add(d, n[k], out=hs[i])
        prev = hs[i]
    return hs, (h0, hs, zr, n, hn) if keep else None


def backward(dhs: np.ndarray, u: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input projections and of U, from those of the states; truncated at the window's start."""
    h0, hs, zr, n, hn = kept
    t, h, b = hs.shape
    before = np.concatenate((h0[None], hs[:-1]))
    z, r = zr[:, :h], zr[:, h:]
    # What each gate makes of a change of the state, for all steps at once.
    by_new = (1 - z) * (1 - n * n)
    by_update = (before - n) * z * (1 - z)
    by_reset = hn * r * (1 - r)
    dx, da = np.empty((t, 3 * h, b), np.float32), np.empty((t, 3 * h, b), np.float32)
    dh, back = np.zeros((h, b), np.float32), np.empty((h, b), np.float32)
    ut = np.ascontiguousarray(u.T)
    for i in range(t - 1, -1, -1):
        dh += dhs[i]
        np.multiply(dh, by_new[i], out=dx[i, 2 * h :])
        np.multiply(dh, by_update[i], out=dx[i, :h])
        np.multiply(dx[i, 2 * h :], by_reset[i], out=dx[i, h : 2 * h])
        da[i, : 2 * h] = dx[i, : 2 * h]
        np.multiply(dx[i, 2 * h :], r[i], out=da[i, 2 * h :])
        np.matmul(ut, da[i], out=back)
        dh *= z[i]
        dh += back
    return dx, np.matmul(da, before.transpose(0, 2, 1)).sum(0)


def input_gradient(dx: np.ndarray, at: np.ndarray, n_in: int) -> np.ndarray:
    """The gradient of W: that of the projections (T, 3H, B) summed by the symbols ``at`` (T, B)."""
    flat, sym = dx.transpose(0, 2, 1).reshape(-1, dx.shape[1]), at.reshape(-1)
    order = np.argsort(sym.astype(np.int16) if n_in < 1 << 15 else sym, kind="stable")
    first = np.flatnonzero(np.diff(sym[order], prepend=-1))
    out = np.zeros((n_in, dx.shape[1]), np.float32)
    out[sym[order][first]] = np.add.reduceat(flat[order], first, axis=0)
    return out.T


class Adam:
    """Adam's steps; the parameters are changed in place and its own arrays are used again."""

    def __init__(self, p: dict[str, np.ndarray], lr: float) -> None:
        self.p, self.lr, self.t = p, lr, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.a = {k: np.empty_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())))
        scale = np.float32(min(1.0, clip / (norm + 1e-9)))
        lr = np.float32(self.lr * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, x in g.items():
            m, v, a = self.m[k], self.v[k], self.a[k]
            m *= np.float32(0.9)
            np.multiply(x, np.float32(0.1) * scale, out=a)
            m += a
            v *= np.float32(0.999)
            np.multiply(x, x, out=a)
            a *= np.float32(0.001) * scale * scale
            v += a
            np.sqrt(v, out=a)
            a += np.float32(1e-7)
            np.divide(m, a, out=a)
            a *= lr
            self.p[k] -= a


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    x = np.exp(x - x.max(axis, keepdims=True))
    x /= x.sum(axis, keepdims=True)
    return x
