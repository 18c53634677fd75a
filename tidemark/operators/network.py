"""A small network of variate tokens in numpy: reverse-mode gradients, the model, and its training.

A window's variates are the tokens of an encoder: each is embedded over its whole length, and they
attend to one another. Variates other than the target first pass a mixture of their own lags whose
weights start from the lags' correlation with the target. A head of radial basis functions and a
linear part gives the residuals of the next steps against the last value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np


class Var:
    """A value and how a gradient at it passes to its inputs."""

    __slots__ = ("v", "g", "back")

    def __init__(self, v: np.ndarray, back: tuple[tuple[Var, Callable[[np.ndarray], np.ndarray]], ...] = ()) -> None:
        self.v, self.g, self.back = v, None, back

    def __add__(self, o: Var) -> Var:
        return Var(self.v + o.v, ((self, lambda g: g), (o, lambda g: g)))

    def __mul__(self, o: Var) -> Var:
        return Var(self.v * o.v, ((self, lambda g: g * o.v), (o, lambda g: g * self.v)))

    def __matmul__(self, o: Var) -> Var:
        return Var(self.v @ o.v, ((self, lambda g: g @ o.v.swapaxes(-1, -2)), (o, lambda g: self.v.swapaxes(-1, -2) @ g)))

    def reshape(self, *shape: int) -> Var:
        return Var(self.v.reshape(shape), ((self, lambda g: g.reshape(self.v.shape)),))

    def swap(self, a: int, b: int) -> Var:
        return Var(self.v.swapaxes(a, b), ((self, lambda g: g.swapaxes(a, b)),))

    def pick(self, i: int) -> Var:
        """Item ``i`` of the second axis."""

        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.v)
            out[:, i] = g
            return out

        return Var(self.v[:, i], ((self, back),))

    def mean(self) -> Var:
        return Var(np.array(self.v.mean()), ((self, lambda g: np.full(self.v.shape, g / self.v.size)),))


def const(v: Any) -> Var:
    return Var(np.asarray(v, float))


def softmax(x: Var) -> Var:
    e = np.exp(x.v - x.v.max(-1, keepdims=True))
    s = e / e.sum(-1, keepdims=True)
    return Var(s, ((x, lambda g: s * (g - (g * s).sum(-1, keepdims=True))),))


def gelu(x: Var) -> Var:
    """The tanh form."""
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (x.v + 0.044715 * x.v**3))
    slope = 0.5 * (1 + t) + 0.5 * x.v * (1 - t**2) * c * (1 + 3 * 0.044715 * x.v**2)
    return Var(0.5 * x.v * (1 + t), ((x, lambda g: g * slope),))


def norm(x: Var) -> Var:
    """Zero mean and unit deviation over the last axis."""
    d = x.v - x.v.mean(-1, keepdims=True)
    s = np.sqrt((d**2).mean(-1, keepdims=True) + 1e-5)
    y = d / s
    return Var(y, ((x, lambda g: (g - g.mean(-1, keepdims=True) - y * (g * y).mean(-1, keepdims=True)) / s),))


def bells(x: Var, centres: np.ndarray) -> Var:
    """Radial basis functions of every value, on a new last axis."""
    width = centres[1] - centres[0] if len(centres) > 1 else 1.0
    d = (x.v[..., None] - centres) / width
    e = np.exp(-(d**2))
    return Var(e, ((x, lambda g: (g * e * -2 * d / width).sum(-1)),))


def _as_shape(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(0)
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(wide, keepdims=True) if wide else g


def backward(out: Var) -> None:
    """Gradients of a number at everything it was made of."""
    order: list[Var] = []
    seen: set[int] = set()
    stack = [(out, False)]
    while stack:
        x, done = stack.pop()
        if done:
            order.append(x)
        elif id(x) not in seen:
            seen.add(id(x))
            stack.append((x, True))
            stack += [(p, False) for p, _ in x.back]
    out.g = np.ones_like(out.v)
    for x in reversed(order):
        for p, f in x.back:
            g = _as_shape(f(x.g), p.v.shape)
            p.g = g if p.g is None else p.g + g


@dataclass(frozen=True)
class Shape:
    """Sizes of a network; ``lags`` 0 leaves the lag mixture out."""

    variates: int
    seq_len: int
    pred_len: int
    d_model: int
    nhead: int
    layers: int
    hidden: int
    grid: int
    target: int
    lags: int
    lag_scale: float
    dropout: float


def initial(shape: Shape, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def dense(a: int, b: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(a), (a, b))

    d = shape.d_model
    w = {"embed": dense(shape.seq_len, d), "embed_0": np.zeros(d), "lag": np.zeros((shape.variates, shape.lags + 1))}
    for i in range(shape.layers):
        w |= {f"{n}{i}": dense(d, d) for n in ("query", "key", "value", "mix")}
        w |= {f"up{i}": dense(d, shape.hidden), f"up_0{i}": np.zeros(shape.hidden), f"down{i}": dense(shape.hidden, d), f"down_0{i}": np.zeros(d)}
    return w | {"bells": dense(d * shape.grid, shape.pred_len) * 0.1, "line": dense(d, shape.pred_len) * 0.1, "line_0": np.zeros(shape.pred_len)}


def lag_prior(x: np.ndarray, target: int, lags: int) -> np.ndarray:
    """Correlation of the target with every variate ``k`` rows before, over the windows (variates x lags + 1)."""
    y = x[:, lags:, target].ravel()
    out = np.zeros((x.shape[2], lags + 1))
    for v in range(x.shape[2]):
        for k in range(lags + 1):
            z = x[:, lags - k : x.shape[1] - k, v].ravel()
            if y.std() > 0 and z.std() > 0:
                out[v, k] = np.corrcoef(y, z)[0, 1]
    return out


def _shifted(x: np.ndarray, lags: int) -> np.ndarray:
    """(n, variates, rows) to (n, variates, rows, lags + 1), zeros before the start."""
    out = np.zeros((*x.shape, lags + 1))
    for k in range(lags + 1):
        out[:, :, k:, k] = x[:, :, : x.shape[2] - k]
    return out


def forward(shape: Shape, w: dict[str, Var], prior: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> Var:
    """Residuals (n x pred_len) for standardised windows (n x seq_len x variates); ``rng`` turns dropout on."""
    n, heads = len(x), shape.nhead
    size = shape.d_model // heads

    def drop(h: Var) -> Var:
        if rng is None or not shape.dropout:
            return h
        return h * const((rng.random(h.v.shape) >= shape.dropout) / (1 - shape.dropout))

    def split(h: Var) -> Var:
        return h.reshape(n, shape.variates, heads, size).swap(1, 2)

    rows = x.swapaxes(1, 2)
    tokens = const(rows)
    if shape.lags:
        own = np.zeros((shape.variates, 1))
        own[shape.target] = 1.0
        share = softmax(w["lag"] + const(shape.lag_scale * prior)).reshape(shape.variates, shape.lags + 1, 1)
        mixed = (const(_shifted(rows, shape.lags)) @ share).reshape(n, shape.variates, shape.seq_len)
        tokens = const(rows * own) + mixed * const(1 - own)
    h = tokens @ w["embed"] + w["embed_0"]
    for i in range(shape.layers):
        a = norm(h)
        q, k, v = (split(a @ w[f"{m}{i}"]) for m in ("query", "key", "value"))
        seen = softmax(q @ k.swap(-1, -2) * const(1 / np.sqrt(size))) @ v
        h = h + drop(seen.swap(1, 2).reshape(n, shape.variates, shape.d_model) @ w[f"mix{i}"])
        h = h + drop(gelu(norm(h) @ w[f"up{i}"] + w[f"up_0{i}"]) @ w[f"down{i}"] + w[f"down_0{i}"])
    z = norm(h).pick(shape.target)
    curved = bells(z, np.linspace(-2, 2, shape.grid)).reshape(n, shape.d_model * shape.grid)
    return curved @ w["bells"] + z @ w["line"] + w["line_0"]


def loss(p: Var, y: np.ndarray, weights: np.ndarray, trend: float) -> Var:
    """Squared residuals by the step's weight, and those of the steps' differences."""
    e = p + const(-y)
    out = (e * e * const(weights)).mean()
    if trend and y.shape[1] > 1:
        step = const(np.eye(y.shape[1])[:, 1:] - np.eye(y.shape[1])[:, :-1])
        d = e @ step
        out = out + (d * d).mean() * const(trend)
    return out


@dataclass(frozen=True)
class Plan:
    """How a network is trained."""

    epochs: int
    batch_size: int
    lr: float
    weight_decay: float
    patience: int
    trend: float
    weights: tuple[float, float]
    max_norm: float
    factor: float
    plateau: int
    seed: int


def train(shape: Shape, plan: Plan, prior: np.ndarray, fit: tuple[np.ndarray, np.ndarray], check: tuple[np.ndarray, np.ndarray]) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights of the best epoch by the loss over ``check`` (over ``fit`` where that is empty), and those losses."""
    w = {n: Var(v) for n, v in initial(shape, plan.seed).items()}
    m, s = ({n: np.zeros_like(v.v) for n, v in w.items()} for _ in range(2))
    rng = np.random.default_rng(plan.seed + 1)
    steps = np.linspace(*plan.weights, shape.pred_len)
    check = check if len(check[0]) else fit
    lr, at, best, kept, losses = plan.lr * 0.2, 0, np.inf, {n: v.v.copy() for n, v in w.items()}, []
    stale = calm = 0
    for _ in range(plan.epochs):
        dealt = rng.permutation(len(fit[0]))
        for i in range(0, len(dealt), plan.batch_size):
            some = dealt[i : i + plan.batch_size]
            for v in w.values():
                v.g = None
            backward(loss(forward(shape, w, prior, fit[0][some], rng), fit[1][some], steps, plan.trend))
            grads = {n: v.g for n, v in w.items() if v.g is not None}
            length = np.sqrt(sum((g**2).sum() for g in grads.values()))
            at += 1
            for n, g in grads.items():
                g = g * min(1.0, plan.max_norm / (length + 1e-6)) + plan.weight_decay * w[n].v
                m[n] = 0.9 * m[n] + 0.1 * g
                s[n] = 0.999 * s[n] + 0.001 * g**2
                w[n].v = w[n].v - lr * (m[n] / (1 - 0.9**at)) / (np.sqrt(s[n] / (1 - 0.999**at)) + 1e-8)
        parts = [(float(loss(forward(shape, w, prior, check[0][i : i + plan.batch_size]), check[1][i : i + plan.batch_size], steps, plan.trend).v), len(check[0][i : i + plan.batch_size])) for i in range(0, len(check[0]), plan.batch_size)]
        losses.append(sum(v * n for v, n in parts) / sum(n for _, n in parts))
        if losses[-1] < best:
            best, kept, stale, calm = losses[-1], {n: v.v.copy() for n, v in w.items()}, 0, 0
            continue
        stale, calm = stale + 1, calm + 1
        if calm > plan.plateau:
            lr, calm = lr * plan.factor, 0
        if stale >= plan.patience:
            break
    return kept, losses
