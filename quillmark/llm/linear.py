"""FTRL-proximal logistic regression over hashed features, with compact weights for broadcasting."""

from __future__ import annotations

import numpy as np
import xxhash

#: Buckets of hashed features.
BUCKETS = 1 << 20


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & (BUCKETS - 1)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Hashed features of many rows, those that fewer than `least` rows have left out."""

    def __init__(self, rows: list[np.ndarray], least: int = 1):
        flat = np.concatenate([np.zeros(0, np.int64), *rows])
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        keep = np.bincount(flat, minlength=BUCKETS)[flat] >= least
        self.flat, self.row = flat[keep], row[keep]
        self.sizes = np.bincount(self.row, minlength=len(rows))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def of(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, number of the row in i that has each) of the rows i."""
        n = self.sizes[i]
        row = np.repeat(np.arange(len(i)), n)
        return self.flat[self.starts[i][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)], row


class Ftrl:
    """FTRL-proximal with per-coordinate rates; L1 keeps the weights sparse."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def fit(self, rows: "Rows", labels: np.ndarray, weights: np.ndarray, epochs: int = 3, batch: int = 256, seed: int = 42) -> "Ftrl":
        """Learn from rows of a weight above 0, in small batches."""
        rng = np.random.default_rng(seed)
        use = np.flatnonzero(weights > 0)
        for _ in range(epochs):
            order = rng.permutation(use)
            for i in (order[at : at + batch] for at in range(0, len(order), batch)):
                at, row = rows.of(i)
                here, inv = np.unique(at, return_inverse=True)
                w = self.weights(here)
                p = _sigmoid(np.bincount(row, w[inv], minlength=len(i)))
                error = ((p - labels[i]) * weights[i])[row]
                g, squares = (np.bincount(inv, x, minlength=len(here)) for x in (error, error * error))
                n = self.n[here]
                self.z[here] += g - (np.sqrt(n + squares) - np.sqrt(n)) / self.alpha * w
                self.n[here] = n + squares
        return self

    def scores(self, rows: "Rows") -> np.ndarray:
        return _sigmoid(np.bincount(rows.row, self.weights(rows.flat), minlength=len(rows)))

    def compact(self) -> dict[int, float]:
        at = np.flatnonzero(self.n)
        w = self.weights(at)
        return {int(i): float(x) for i, x in zip(at, w) if x}


def score(weights: dict[int, float], at) -> float:
    s = sum(weights.get(int(i), 0.0) for i in at)
    return 1.0 / (1.0 + float(np.exp(-max(-30.0, min(30.0, s)))))


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of best F1 on held-out rows; the middle of the gap where several are as good; 0.5 without positives."""
    if not labels.any():
        return 0.5
    cuts = np.unique(np.r_[scores, 0.5])
    mids = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    f1 = np.array([2 * (labels & (scores >= c)).sum() / max(1, (scores >= c).sum() + labels.sum()) for c in mids])
    best = mids[f1 >= f1.max() - 1e-12]
    return float(best[np.argmin(np.abs(best - 0.5))])
