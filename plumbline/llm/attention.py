"""A small causal self-attention model in numpy: forward, gradients, and scoring in overlapping windows.

It predicts classes of tokens. Inputs are embedded with their place in the window; one attention head looks back, a
two-layer perceptron follows, both with residual connections, and the output adds to the logarithm of the class
bigram probabilities. Sequences are read in windows of WINDOW places of which the last STEP are scored, so every
token is scored once with at least WINDOW - STEP places before it; before a text stand end tokens.
"""

from __future__ import annotations

from math import prod

import numpy as np

WINDOW, STEP = 16, 12
CLASSES, WIDTH = 64, 16
BATCH, _AT_ONCE = 128, 128
_ROWS = 512
_BACK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SEEN = _BACK[WINDOW - STEP :]


class Room:
    """Arrays that stay from step to step under their names: the system would map and clear new ones each time."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = prod(shape)
        if name not in self.kept or len(self.kept[name]) < size or self.kept[name].dtype != kind:
            self.kept[name] = np.empty(size, kind)
        return self.kept[name][:size].reshape(shape)


def start(seed: int, classes: int = CLASSES, width: int = WIDTH) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda *shape, s=1.0: (rng.standard_normal(shape) * s / np.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": rng.standard_normal((classes, width)).astype(np.float32) * 0.5, "place": rng.standard_normal((WINDOW, width)).astype(np.float32) * 0.1,
        "look": w(width, 3 * width), "mix": w(width, width), "up": w(width, 2 * width), "up0": np.zeros(2 * width, np.float32),
        "down": w(2 * width, width), "out": w(width, classes, s=0.1), "out0": np.zeros(classes, np.float32),
    }


def row_sums(values: np.ndarray) -> np.ndarray:
    return values.reshape(-1, values.shape[-1]) @ np.ones(values.shape[-1], values.dtype)


def turned_round(weights: np.ndarray) -> np.ndarray:
    """Transposed weights in their own order: long products with them take two thirds of the time."""
    return np.ascontiguousarray(weights.T)


def looks(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What states are multiplied by before they meet others, and after: queries with keys, and values with their mixing.

    One head needs no more than these products, which are as small as the weights.
    """
    query, key, value = np.split(m["look"], 3, axis=1)
    return query @ key.T * m["look"].dtype.type(len(key) ** -0.5), value @ m["mix"]


def bounded(values: np.ndarray, least: float, most: float) -> None:
    """Clips in place, which is seldom needed: weights that large do not come out of training."""
    if values.max(initial=least) > most or values.min(initial=most) < least:
        np.clip(values, least, most, out=values)


def shares(a: np.ndarray, seen: np.ndarray, room: Room) -> None:
    """Softmax of rows over the places that are seen, in place; a product with ones has the sum of a row in all its columns."""
    bounded(a, -60, 60)
    np.exp(a, out=a)
    a *= seen
    rows = a.reshape(-1, WINDOW)
    rows /= np.matmul(rows, np.ones((WINDOW, WINDOW), a.dtype), out=room("r", a.dtype, *rows.shape))


def perceived(m: dict[str, np.ndarray], h1: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """The inner layer of the perceptron, and the states behind it."""
    n, width = h1.shape
    r = np.matmul(h1, m["up"], out=room("r", h1.dtype, n, 2 * width))
    r += m["up0"]
    np.maximum(r, 0, out=r)
    h2 = np.matmul(r, m["down"], out=room("h2", h1.dtype, n, width))
    h2 += h1
    return r, h2


def begun(m: dict[str, np.ndarray], x: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """First states of windows, and the same with places and width exchanged."""
    width, kind = m["embed"].shape[1], m["embed"].dtype
    h0 = np.take(m["embed"], x, axis=0, out=room("h0", kind, *x.shape, width), mode="clip")
    h0 += m["place"]
    turned = room("turned", kind, len(x), width, x.shape[1])
    np.copyto(turned, h0.transpose(0, 2, 1))
    return h0, turned


def hidden(m: dict[str, np.ndarray], x: np.ndarray, room: Room | None = None) -> tuple:
    """States of windows of classes (windows, WINDOW), and what the gradients need, in arrays of the room."""
    room, width, kind, n = room or Room(), m["embed"].shape[1], m["embed"].dtype, x.size
    pair, value = looks(m)
    h0, turned = begun(m, x, room)
    flat = h0.reshape(n, width)
    q = np.matmul(flat, pair, out=room("q", kind, n, width)).reshape(h0.shape)
    a = np.matmul(q, turned, out=room("a", kind, *x.shape, x.shape[1]))
    shares(a, _BACK, room)
    o = np.matmul(a, h0, out=room("o", kind, *h0.shape))
    h1 = np.matmul(o.reshape(n, width), value, out=room("h1", kind, n, width))
    h1 += flat
    r, h2 = perceived(m, h1, room)
    return pair, value, h0, turned, q, a, o, h1, r, h2.reshape(h0.shape)


def scored_states(m: dict[str, np.ndarray], x: np.ndarray, room: Room | None = None) -> np.ndarray:
    """The last states of `hidden` for the scored places alone, (windows * STEP, width), in fewer passes."""
    room, width, kind, skip = room or Room(), m["embed"].shape[1], m["embed"].dtype, WINDOW - STEP
    scored = len(x) * STEP
    pair, value = looks(m)
    h0, turned = begun(m, x, room)
    last = room("last", kind, scored, width)
    last.reshape(-1, STEP, width)[:] = h0[:, skip:]
    q = np.matmul(last, pair, out=room("q", kind, scored, width)).reshape(-1, STEP, width)
    s = np.matmul(q, turned, out=room("a", kind, len(x), STEP, WINDOW))
    shares(s, _SEEN, room)
    o = np.matmul(s, h0, out=room("o", kind, len(x), STEP, width)).reshape(scored, width)
    last += np.matmul(o, value, out=room("h1", kind, scored, width))
    return perceived(m, last, room)[1]


def log_probabilities(m: dict[str, np.ndarray], bigram: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Natural logarithms over the classes for the scored places, (windows, STEP, classes)."""
    h2 = hidden(m, x)[-1][:, WINDOW - STEP :]
    g = h2 @ m["out"] + (bigram + m["out0"])[x[:, WINDOW - STEP :]]
    g -= g.max(axis=-1, keepdims=True)
    return g - np.log(np.exp(g).sum(axis=-1, keepdims=True))


def windows(classes: np.ndarray, bounds: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows, WINDOW) of sequences classes[bounds[i]:bounds[i + 1]], the place that each scored place has in
    `classes` (-1: none), and the first window of each sequence."""
    size = np.diff(bounds)
    count = -(-size // step)
    first = np.append(0, np.cumsum(count))
    of = np.repeat(np.arange(len(size)), count)
    begin = (np.arange(first[-1]) - first[of]) * step
    place = begin[:, None] + np.arange(WINDOW) - (WINDOW - step)
    inside = (place >= 0) & (place < size[of][:, None])
    before = place - 1
    known = (before >= 0) & (before < size[of][:, None])
    x = np.where(known, classes[np.where(known, before + bounds[of][:, None], 0)], 0) if len(classes) else np.zeros(place.shape, np.int64)
    target = np.where(inside, place + bounds[of][:, None], -1)[:, WINDOW - step :]
    return x, target, first


def score(m: dict[str, np.ndarray], bigram: np.ndarray, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each place's class."""
    out = np.zeros(len(classes))
    x, target, _ = windows(classes, bounds)
    start_, room = bigram + m["out0"], Room()
    for lo in range(0, len(x), _AT_ONCE):
        own, at = x[lo : lo + _AT_ONCE], target[lo : lo + _AT_ONCE].ravel()
        states = scored_states(m, own, room)
        g = np.matmul(states, m["out"], out=room("g", states.dtype, len(states), bigram.shape[1]))
        g += np.take(start_, own[:, WINDOW - STEP :].ravel(), axis=0, out=room("before", start_.dtype, *g.shape), mode="clip")
        bounded(g, -80, 80)
        used = np.flatnonzero(at >= 0)
        at = at[used]
        hit = g.ravel()[used * g.shape[1] + classes[at]].astype(np.float64)
        np.exp(g, out=g)
        out[at] = hit - np.log(row_sums(g)[used])
    return out


def predicted(
    m: dict[str, np.ndarray], start: np.ndarray, states: np.ndarray, at: np.ndarray, y: np.ndarray, given: np.ndarray, dstates: np.ndarray, room: Room
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities of the classes y behind states at classes `at`, and the gradients of "out", "out0" and, in `dstates`, the states.

    _ROWS states at a time: what has a column for every class then stays in the cache.
    """
    kind, classes = states.dtype, start.shape[1]
    logs, out, out0 = np.empty(len(y), kind), np.zeros(m["out"].shape[::-1], kind), np.zeros(classes, kind)
    cells, ones, back = np.arange(0, _ROWS * classes, classes), np.ones(_ROWS, kind), turned_round(m["out"])
    for lo in range(0, len(y), _ROWS):
        rows = slice(lo, lo + _ROWS)
        h = states[rows]
        g = np.matmul(h, m["out"], out=room("g", kind, len(h), classes))
        g += np.take(start, at[rows], axis=0, out=room("before", start.dtype, *g.shape), mode="clip")
        bounded(g, -80, 80)
        line, wanted = g.ravel(), cells[: len(h)] + y[rows]
        hit = line[wanted]
        p = np.exp(g, out=g)
        total = row_sums(p)
        logs[rows] = hit - np.log(total)
        line[wanted] -= total
        p *= (given[rows] / total)[:, None]
        out += p.T @ h
        out0 += ones[: len(h)] @ p
        np.matmul(p, back, out=dstates[rows])
    return logs, out.T, out0


def loss_and_gradients(m: dict[str, np.ndarray], bigram: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-probability of the classes y at the places of windows x, with weights 0 or 1."""
    logs, grads = logs_and_gradients(m, bigram, x, y, weight)
    return float(-(logs * weight).sum() / max(1.0, float(weight.sum()))), grads


def logs_and_gradients(
    m: dict[str, np.ndarray], bigram: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, room: Room | None = None
) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Log-probabilities of the classes y, and the gradients of the mean of what they lack."""
    room, width, kind, n = room or Room(), m["embed"].shape[1], m["embed"].dtype, x.size
    pair, value, h0, turned, q, a, o, h1, r, h2 = hidden(m, x, room)
    flat = lambda t: t.reshape(n, -1)
    deep = lambda t: t.reshape(h0.shape)
    last, at, ones = flat(h2), x.ravel(), np.ones(n, kind)
    given = weight.ravel().astype(kind)
    given /= max(1.0, float(given.sum()))
    dh2 = room("dh2", kind, n, width)
    logs, out, out0 = predicted(m, bigram + m["out0"], last, at, y.ravel(), given, dh2, room)
    grads = {"out": out, "out0": out0}
    # From here arrays that are done with, or their names in the room, take new values: fewer stay in the cache better.
    dr = np.matmul(dh2, turned_round(m["down"]), out=room("dr", kind, n, 2 * width))
    dr *= r > 0
    grads |= {"down": r.T @ dh2, "up": h1.T @ dr, "up0": ones @ dr}
    dh1 = np.matmul(dr, turned_round(m["up"]), out=last)
    dh1 += dh2
    dvalue = flat(o).T @ dh1
    do = deep(np.matmul(dh1, turned_round(value), out=dh2))
    ds = np.matmul(do, turned, out=room("h1", kind, *a.shape))
    o *= do
    ds -= np.matmul(flat(o), np.ones((width, WINDOW), kind), out=room("turned", kind, n, WINDOW)).reshape(a.shape)
    ds *= a
    met = np.matmul(ds, h0, out=o)
    dpair = flat(h0).T @ flat(met) * kind.type(width**-0.5)
    dh0 = np.matmul(flat(met), turned_round(pair), out=room("turned", kind, n, width))
    dh0 += dh1
    added = deep(dh0)
    added += np.matmul(ds.transpose(0, 2, 1), q, out=met)
    added += np.matmul(a.transpose(0, 2, 1), do, out=met)
    query, key, own = np.split(m["look"], 3, axis=1)
    grads |= {"look": np.concatenate([dpair @ key, dpair.T @ query, dvalue @ m["mix"].T], axis=1), "mix": own.T @ dvalue, "place": added.sum(axis=0)}
    cells = np.take(np.arange(m["embed"].size).reshape(m["embed"].shape), at, axis=0)
    grads["embed"] = np.bincount(cells.ravel(), dh0.ravel(), m["embed"].size).reshape(m["embed"].shape)
    return logs.reshape(y.shape), grads


def training_windows(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows side by side, which have every place of the sequences once: inputs, places (-1: none), classes to predict."""
    x, target, _ = windows(classes, bounds, WINDOW)
    return x, target, classes[np.maximum(target, 0)] if len(classes) else target


class Trainer:
    """Weights under Adam, with steps that shrink with the root of their number."""

    def __init__(self, bigram: np.ndarray, rate: float = 4e-3, slow: int = 500, seed: int = 1):
        self.bigram, self.rate, self.slow = bigram, rate, slow
        begin = start(seed, len(bigram))
        self.flat = np.concatenate([w.ravel() for w in begin.values()])  # the weights are views of one row of numbers
        ends = np.cumsum([w.size for w in begin.values()])
        self.weights = {k: part.reshape(w.shape) for (k, w), part in zip(begin.items(), np.split(self.flat, ends[:-1]))}
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rng, self.steps, self.seen, self.room = np.random.default_rng(seed), 0, 0, Room()

    def learn(self, x: np.ndarray, target: np.ndarray, y: np.ndarray, most: int | None = None) -> np.ndarray:
        """A step for every BATCH windows in random order, at most `most` steps; log-probabilities of the places, each
        before its own step."""
        out = np.zeros(max(int(target.max(initial=-1)) + 1, 0))
        order = self.rng.permutation(len(x))
        for lo in list(range(0, len(x), BATCH))[:most]:
            rows = order[lo : lo + BATCH]
            at = target[rows]
            given = at >= 0
            logs, grads = logs_and_gradients(self.weights, self.bigram, x[rows], y[rows], given.astype(np.float32), self.room)
            out[at[given]] = logs[given]
            self.steps, self.seen = self.steps + 1, self.seen + len(rows)
            now = self.rate * min(1, self.steps / 20) / np.sqrt(1 + self.steps / self.slow)
            g = np.concatenate([grads[k].ravel() for k in self.weights], dtype=np.float32)
            self.first += np.float32(0.1) * (g - self.first)
            self.second += np.float32(0.01) * (g * g - self.second)
            self.flat -= np.float32(now / (1 - 0.9**self.steps)) * self.first / (np.sqrt(self.second / np.float32(1 - 0.99**self.steps)) + np.float32(1e-8))
        return out
