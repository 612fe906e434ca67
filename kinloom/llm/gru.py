"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Words are ids below classes * size; word w is member w % size of class w // size. The input
embedding is kept as each word's share in the three gates. Documents run side by side in
lanes; a lane's state is carried from window to window and reset where a document starts, so
a document is scored as one sequence, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    hidden: int = 16
    classes: int = 16
    size: int = 32

    @property
    def words(self) -> int:
        return self.classes * self.size

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        h, c, s = self.hidden, self.classes, self.size
        return [
            ("inputs", (self.words + 1, 3 * h)),  # the last row is the start of a document
            ("gates", (h, 2 * h)),
            ("update", (h, h)),
            ("class_w", (h, c)),
            ("class_b", (c,)),
            ("word_w", (c, h, s)),
            ("word_b", (c, s)),
        ]

    def length(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts())


def views(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, dims in shape.parts():
        n = int(np.prod(dims))
        out[name] = flat[at : at + n].reshape(dims)
        at += n
    return out


def initial(shape: Shape, counts: np.ndarray, seed: int = 6) -> np.ndarray:
    """Small random weights; the output biases start at the words' log frequencies."""
    flat = np.random.default_rng(seed).normal(0, 0.1, shape.length()).astype(np.float32)
    w = views(flat, shape)
    counts = (counts + 0.1).reshape(shape.classes, shape.size)
    w["class_b"][:] = np.log(counts.sum(1) / counts.sum())
    w["word_b"][:] = np.log(counts / counts.sum(1, keepdims=True))
    return flat


@dataclass
class Window:
    """Steps by lanes. `doc` numbers the documents; -1 is padding. `goes_on`: the lanes of the window before that are left."""

    goes_on: np.ndarray
    inputs: np.ndarray
    targets: np.ndarray
    keep: np.ndarray
    doc: np.ndarray


@dataclass
class Lanes:
    """Deals documents to lanes: a lane that ends one takes the next, and goes when none is left."""

    docs: Iterator[np.ndarray]
    lanes: int
    steps: int
    start: int
    taken: int = 0

    def windows(self) -> Iterator[Window]:
        held: list[tuple[int, np.ndarray, int] | None] = [None] * self.lanes
        more = True
        while True:
            goes_on = np.array([k for k, h in enumerate(held) if more or h is not None], dtype=np.int64)
            held = [held[k] for k in goes_on]
            shape = (len(held), self.steps)
            inputs, targets = np.full(shape, self.start, dtype=np.int64), np.zeros(shape, dtype=np.int64)
            keep, doc = np.ones(shape, dtype=np.float32), np.full(shape, -1, dtype=np.int64)
            for lane in range(len(held)):
                at = 0
                while at < self.steps:
                    if held[lane] is None:
                        ids = next(self.docs, None) if more else None
                        if ids is None:
                            more = False
                            break
                        held[lane] = (self.taken, ids, 0)
                        self.taken += 1
                    number, ids, done = held[lane]
                    n = min(self.steps - at, len(ids) - done)
                    targets[lane, at : at + n] = ids[done : done + n]
                    doc[lane, at : at + n] = number
                    if done:
                        inputs[lane, at : at + n] = ids[done - 1 : done + n - 1]
                    else:
                        inputs[lane, at + 1 : at + n] = ids[: n - 1]
                        keep[lane, at] = 0
                    at, done = at + n, done + n
                    held[lane] = (number, ids, done) if done < len(ids) else None
            if (doc < 0).all():
                return
            yield Window(goes_on, inputs.T.copy(), targets.T.copy(), keep.T[:, :, None].copy(), doc.T.copy())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def states(w: dict[str, np.ndarray], window: Window, h: np.ndarray, trace: bool = False):
    """Hidden states of all steps, the last one, and what backpropagation needs."""
    steps, lanes = window.inputs.shape
    size = h.shape[1]
    inputs = w["inputs"][window.inputs]
    out = np.empty((steps, lanes, size), dtype=np.float32)
    past = np.empty_like(out) if trace else None
    gates = np.empty((steps, lanes, 2 * size), dtype=np.float32) if trace else None
    fresh = np.empty_like(out) if trace else None
    resets = window.keep.min(axis=(1, 2)) < 1
    for t in range(steps):
        if resets[t]:
            h = h * window.keep[t]
        zr = _sigmoid(h @ w["gates"] + inputs[t, :, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh((r * h) @ w["update"] + inputs[t, :, 2 * size :])
        if trace:
            past[t], gates[t], fresh[t] = h, zr, n
        h = h + z * (n - h)
        out[t] = h
    return out, h, (past, gates, fresh)


def _softmax(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each column's target; the columns of `logits` become probabilities."""
    np.minimum(logits, 60, out=logits)  # beyond what training reaches; keeps exp finite
    picked = logits[target, np.arange(len(target))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    logits *= 1 / total
    return picked - np.log(total)


def log_probabilities(w: dict[str, np.ndarray], hidden: np.ndarray, targets: np.ndarray, grad: dict[str, np.ndarray] | None = None, scale: np.ndarray | None = None):
    """Natural log-probabilities of `targets` (n) after the states `hidden` (n, h).

    With `grad`, gradients of minus their `scale`d sum are added to it and those of the states returned.
    """
    size = w["word_b"].shape[1]
    order = np.argsort(targets.astype(np.min_scalar_type(w["word_b"].size)), kind="stable")  # by class, and by word within it
    hidden, sorted_targets = np.ascontiguousarray(hidden[order].T), targets[order]
    group, member = sorted_targets // size, sorted_targets % size
    logits = w["class_w"].T @ hidden + w["class_b"][:, None]
    logp = _softmax(logits, group)
    back = None
    if grad is not None:
        scale = scale[order]
        logits[group, np.arange(len(group))] -= 1
        logits *= scale
        grad["class_w"] += hidden @ logits.T
        grad["class_b"] += logits.sum(1)
        back = w["class_w"] @ logits
    ends = np.searchsorted(group, np.arange(len(w["class_b"]) + 1))
    for c in np.flatnonzero(np.diff(ends)):
        part = slice(ends[c], ends[c + 1])
        h, m = hidden[:, part], member[part]
        logits = w["word_w"][c].T @ h + w["word_b"][c][:, None]
        logp[part] += _softmax(logits, m)
        if grad is not None:
            logits[m, np.arange(len(m))] -= 1
            logits *= scale[part]
            grad["word_w"][c] += h @ logits.T
            grad["word_b"][c] += logits.sum(1)
            back[:, part] += w["word_w"][c] @ logits
    out = np.empty_like(logp)
    out[order] = logp
    if back is not None:
        unsorted = np.empty((len(order), len(back)), dtype=back.dtype)
        unsorted[order] = back.T
        back = unsorted
    return out, back


def gradient(w: dict[str, np.ndarray], window: Window, h: np.ndarray, grad: dict[str, np.ndarray], full: int = 0):
    """Adds the window's gradient (loss: mean of minus the log-probabilities); returns the loss and the last state.

    The mean is over `full` tokens at least: a window of few lanes weighs what it holds.

    The state that enters the window is taken as given: backpropagation is truncated there.
    """
    out, last, (past, gates, fresh) = states(w, window, h, trace=True)
    steps, lanes, size = out.shape
    real = (window.doc >= 0).ravel()
    scale = real.astype(np.float32) / max(1, full, real.sum())
    logp, back = log_probabilities(w, out.reshape(-1, size), window.targets.ravel(), grad, scale)
    back = back.reshape(steps, lanes, size)
    delta = np.empty((steps, lanes, 3 * size), dtype=np.float32)
    carried = np.zeros((lanes, size), dtype=delta.dtype)
    resets = window.keep.min(axis=(1, 2)) < 1
    gates_t, update_t = w["gates"].T.copy(), w["update"].T.copy()
    # What multiplies the gradient of a state on its way to each gate, for all steps at once.
    z, r = gates[:, :, :size], gates[:, :, size:]
    stays = 1 - z
    to_new = z * (1 - fresh * fresh)
    to_z = (fresh - past) * z * stays
    to_r = past * r * (1 - r)
    for t in range(steps - 1, -1, -1):
        dh = carried
        dh += back[t]
        dn = np.multiply(dh, to_new[t], out=delta[t, :, 2 * size :])
        np.multiply(dh, to_z[t], out=delta[t, :, :size])
        drh = dn @ update_t
        np.multiply(drh, to_r[t], out=delta[t, :, size : 2 * size])
        carried = delta[t, :, : 2 * size] @ gates_t
        drh *= r[t]
        carried += drh
        dh *= stays[t]
        carried += dh
        if resets[t]:
            carried *= window.keep[t]
    flat = delta.reshape(-1, 3 * size)
    grad["gates"] += past.reshape(-1, size).T @ flat[:, : 2 * size]
    grad["update"] += (gates[:, :, size:] * past).reshape(-1, size).T @ flat[:, 2 * size :]
    ids = window.inputs.ravel()
    order = np.argsort(ids, kind="stable")
    found, start = np.unique(ids[order], return_index=True)
    grad["inputs"][found] += np.add.reduceat(flat[order], start, axis=0)
    return -float((logp * scale).sum()), last


def train(flat: np.ndarray, shape: Shape, docs: Iterable[np.ndarray], lanes: int, steps: int, rate: float) -> tuple[np.ndarray, int]:
    """One pass over `docs` by AdaGrad; returns the new weights and the tokens seen."""
    flat = flat.copy()
    w = views(flat, shape)
    squares, g = np.full_like(flat, 1e-4), np.zeros_like(flat)
    grad = views(g, shape)
    h, seen = np.zeros((lanes, shape.hidden), dtype=np.float32), 0
    for window in Lanes(iter(docs), lanes, steps, shape.words).windows():
        g[:] = 0
        _, h = gradient(w, window, h[window.goes_on], grad, lanes * steps)
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= norm
        squares += g * g
        flat -= rate * g / np.sqrt(squares)
        seen += int((window.doc >= 0).sum())
    return flat, seen


def score(flat: np.ndarray, shape: Shape, docs: Iterable[np.ndarray], lanes: int, steps: int) -> np.ndarray:
    """The natural log-probability of each document, in order."""
    w = views(flat, shape)
    h = np.zeros((lanes, shape.hidden), dtype=np.float32)
    totals = np.zeros(1024)
    dealt = Lanes(iter(docs), lanes, steps, shape.words)
    for window in dealt.windows():
        out, h, _ = states(w, window, h[window.goes_on])
        real = window.doc >= 0
        if dealt.taken > len(totals):
            totals = np.concatenate([totals, np.zeros(max(len(totals), dealt.taken))])
        logp, _ = log_probabilities(w, out[real], window.targets[real])
        np.add.at(totals, window.doc[real], logp.astype(np.float64))
    return totals[: dealt.taken]
