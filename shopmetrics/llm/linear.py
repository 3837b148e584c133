"""Hashed n-gram features and follow-the-regularised-leader logistic regression.

Plain numpy, shared by the language and the quality operator. Fitting runs on a
bounded sample; scoring runs inside Spark tasks.
"""

from __future__ import annotations

from functools import cache

import numpy as np

MIX, SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@cache
def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes ^ (hashes >> np.uint32(15))
    h = h * SPREAD
    return h >> np.uint32(32 - bits)


def ngram_counts(items: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of the hashed n-grams of a 32-bit integer sequence, for the given orders."""
    counts = np.zeros(1 << bits, dtype=np.int64)
    h = items.astype(np.uint32)
    for order in range(1, max(orders) + 1):
        if order > 1:
            if len(h) < 2:
                break
            h = h[:-1] * MIX + items[order - 1:]
        if order in orders and len(h):
            counts += np.bincount(bucket(h + np.uint32(order), bits), minlength=1 << bits)
    return counts


def sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero positions and their sublinear term frequencies."""
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (1.0 + np.log(counts[at])).astype(np.float32)


def unit(values: np.ndarray) -> np.ndarray:
    norm = float(np.sqrt(np.dot(values, values)))
    return values / norm if norm > 0 else values


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FtrlSoftmax:
    """Multinomial logistic regression by FTRL-proximal with elastic-net penalties."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0,
                 l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.bias = np.zeros(classes)
        self.bias_n = np.zeros(classes)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        w = shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def learn(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        error = softmax(x @ w + self.bias)
        error[label] -= 1.0
        error *= weight
        g = x[:, None] * error
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown
        self.bias_n += error * error
        self.bias -= self.alpha * error / (self.beta + np.sqrt(self.bias_n))


def least(loss, low: float, high: float, steps: int = 60) -> float:
    """Golden-section search for the minimum of a one-dimensional loss."""
    r = (5 ** 0.5 - 1) / 2
    a, b = low, high
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = loss(d)
    return (a + b) / 2


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that makes held-back logits most likely."""
    if not len(labels):
        return 1.0
    rows = np.arange(len(labels))

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[rows, labels], 1e-12)).mean())

    return float(np.exp(least(loss, -3.0, 3.0)))


def platt(scores: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-back scores (Newton, smoothed targets)."""
    pos, neg = float((labels == 1).sum()), float((labels == 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -40, 40)))
        w, d = np.maximum(p * (1 - p), 1e-9), p - target
        g = np.array([(d * scores).sum() + 1e-4 * a, d.sum()])
        h = np.array([[(w * scores * scores).sum() + 1e-4, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, float(np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
