"""Scores of all features against all labels of one symbol, on arrays: columns are ranked and binned once for each set of rows that pairs share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAST_IC, LEAST_SPREAD, LEAST_STABILITY, SEGMENTS, LEAST_SEGMENT, BINS = 50, 100, 500, 3, 20, 20


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks of each column."""
    out = np.empty(x.shape)
    for k in range(x.shape[1]):
        _, place, counts = np.unique(x[:, k], return_inverse=True, return_counts=True)
        upto = np.cumsum(counts)
        out[:, k] = (upto - (counts - 1) / 2.0)[place]
    return out


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each column of a with each of b; NaN where one does not vary."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a.T @ b) / np.sqrt((a * a).sum(axis=0)[:, None] * (b * b).sum(axis=0)[None, :])


def binned(x: np.ndarray) -> np.ndarray:
    """For each value of a column how many of its distinct percentile edges are at or below it."""
    out = np.empty(x.shape, dtype=np.int64)
    edges = np.quantile(x, np.arange(BINS + 1) / BINS, axis=0)
    for k in range(x.shape[1]):
        out[:, k] = np.searchsorted(np.unique(edges[:, k]), x[:, k], side="right")
    return out


def information(a: np.ndarray, b: np.ndarray) -> float:
    side = BINS + 2
    joint = np.bincount(a * side + b, minlength=side * side).reshape(side, side) / len(a)
    outer = joint.sum(axis=1)[:, None] * joint.sum(axis=0)[None, :]
    full = joint > 0
    return max(0.0, float((joint[full] * np.log(joint[full] / outer[full])).sum()))


def by_pattern(ok: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns with the same valid rows: (rows, columns)."""
    groups: dict[bytes, list[int]] = {}
    for k in range(ok.shape[1]):
        groups.setdefault(np.packbits(ok[:, k]).tobytes(), []).append(k)
    return [(ok[:, c[0]], np.array(c)) for c in groups.values()]


def symbol_scores(x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
    """(feature, label, n_obs, rank_ic, mutual_information, top, bottom, spread, n_segments, ic_std, ic_min, ic_max) of each pair with any rows; rows in order of time."""
    ok_x, ok_y = np.isfinite(x), np.isfinite(y)
    for rows_y, labels in by_pattern(ok_y):
        for rows_x, features in by_pattern(ok_x):
            rows = rows_x & rows_y
            n = int(rows.sum())
            if not n:
                continue
            a, b = x[np.ix_(rows, features)], y[np.ix_(rows, labels)]
            ic = correlations(ranks(a), ranks(b)) if n >= LEAST_IC else np.full((len(features), len(labels)), np.nan)
            bins = (binned(a), binned(b)) if n >= LEAST_IC else None
            edges = np.quantile(a, [0.1, 0.9], axis=0) if n >= LEAST_SPREAD else None
            parts = []
            if n >= LEAST_STABILITY:
                size = max(n // SEGMENTS, 1)
                part = np.minimum(np.arange(n) // size, SEGMENTS - 1)
                parts = [correlations(ranks(a[part == s]), ranks(b[part == s])) for s in range(SEGMENTS) if (part == s).sum() >= LEAST_SEGMENT]
            for i, f in enumerate(features.tolist()):
                for j, label in enumerate(labels.tolist()):
                    mi = information(bins[0][:, i], bins[1][:, j]) if bins else 0.0
                    top = bottom = np.nan
                    if edges is not None:
                        top, bottom = b[a[:, i] >= edges[1, i], j].mean(), b[a[:, i] <= edges[0, i], j].mean()
                    segments = [v for p in parts if not np.isnan(v := p[i, j])]
                    std, low, high = (float(np.std(segments)), min(segments), max(segments)) if segments else (np.nan,) * 3
                    yield f, label, n, ic[i, j], mi, top, bottom, 0.0 if edges is None else top - bottom, len(segments), std, low, high
