"""Column-wise views of a batch of texts, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_BYTES of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, and the first place of each text (and the end of the last)."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its values."""
    b = pa.concat_arrays([strings.cast(pa.binary())])
    offsets = np.frombuffer(b.buffers()[1], np.int32, len(b) + 1, 4 * b.offset).astype(np.int64)
    data = np.frombuffer(b.buffers()[2], np.uint8) if b.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression, by accelerated gradient descent."""
    n, d = x.shape
    sample = np.ones(n) if weight is None else weight
    sample = sample / sample.sum()
    xb = np.concatenate([x, np.ones((n, 1))], axis=1)
    bound = 0.25 * float((sample * np.einsum("ij,ij->i", xb, xb)).sum()) + ridge
    w, v, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 0
    for _ in range(steps):
        grad = xb.T @ (sample * (sigmoid(xb @ v) - y)) + penalty * v
        new = v - grad / bound
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), with Platt's smoothed targets, by Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = margin.std() + 1e-12
    x = np.stack([margin / scale, np.ones(len(y))], axis=1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-4 * np.array([w[0], 0]))
        w = w - np.clip(step, -2, 2)
    return float(w[0] / scale), float(w[1])
