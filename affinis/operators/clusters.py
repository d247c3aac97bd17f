"""Clustering of a similarity matrix: preprocessors, agglomerative linkage, spectral clusters, and what clusters are worth.

The kernels work on one matrix (a connected part of the similarities, in a task); ``clustered`` deals parts out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold(m: np.ndarray, cut: float = 0.2) -> np.ndarray:
    return np.where(m >= cut, m, 0.0)


def percentile(m: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Entries below a percentile of the pairs' similarities become 0."""
    pairs = m[np.triu_indices(len(m), 1)]
    return np.where(m >= np.percentile(pairs, 100 * share), m, 0.0) if len(pairs) else m


def cumulative(m: np.ndarray) -> np.ndarray:
    """Each entry times the share of pairs that are not above it."""
    pairs = np.sort(m[np.triu_indices(len(m), 1)])
    return m * np.searchsorted(pairs, m, side="right") / max(len(pairs), 1)


PREPROCESSORS: dict[str, Callable[..., np.ndarray]] = {"NONE": lambda m: m, "THRESHOLD": threshold, "PERCENTILE": percentile, "CUMULATIVE_DISTRIBUTION_FUNCTION": cumulative}


def prepared(m: np.ndarray, preprocessor: str, **options) -> tuple[np.ndarray, np.ndarray]:
    """The matrix after a preprocessor without items that nothing is similar to, and which items are left."""
    out = PREPROCESSORS[preprocessor](m, **options)
    off = out - np.diag(np.diag(out))
    left = np.flatnonzero(off.any(axis=1))
    return out[np.ix_(left, left)], left


def agglomerative(m: np.ndarray, cut: float = 0.2, linkage: str = "AVERAGE", sizes: np.ndarray | None = None) -> list[list[int]]:
    """Merges the two most similar clusters (ties: smallest members) while their similarity is at least ``cut``. After a
    merge, the similarity to others is the least, the greatest or the mean by size of the two: one row is worked out anew."""
    sim = m.astype(float).copy()
    np.fill_diagonal(sim, -np.inf)
    groups: dict[int, list[int]] = {k: [k] for k in range(len(m))}
    weight = np.ones(len(m)) if sizes is None else sizes.astype(float).copy()
    while len(groups) > 1:
        i, j = divmod(int(np.argmax(sim)), len(sim))
        if sim[i, j] < cut or not np.isfinite(sim[i, j]):
            break
        i, j = min(i, j), max(i, j)
        x, y = sim[i], sim[j]
        row = {"MIN": np.minimum, "MAX": np.maximum}[linkage](x, y) if linkage != "AVERAGE" else (weight[i] * x + weight[j] * y) / (weight[i] + weight[j])
        sim[i], sim[:, i] = row, row
        sim[i, i] = -np.inf
        sim[j], sim[:, j] = -np.inf, -np.inf
        weight[i] += weight[j]
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups.values())


def _means(points: np.ndarray, k: int, seed: int, rounds: int = 100) -> np.ndarray:
    """Labels by k-means, started far apart."""
    r = np.random.default_rng(seed)
    centres = [points[r.integers(len(points))]]
    while len(centres) < k:
        d = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(points[r.choice(len(points), p=d / d.sum())] if d.sum() > 0 else points[r.integers(len(points))])
    c, labels = np.array(centres), np.zeros(len(points), int)
    for _ in range(rounds):
        fresh = ((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([points[fresh == n].mean(axis=0) if (fresh == n).any() else c[n] for n in range(k)])
        if (fresh == labels).all():
            break
        labels = fresh
    return labels


def spectral(m: np.ndarray, seed: int = 0) -> list[list[int]]:
    """Clusters of rows of the eigenvectors of the normalised Laplacian, scaled to length 1. Every number of clusters from
    max(2, how many eigenvalues are under 0.05) to half the items is tried; the one of greatest mean worth is kept."""
    n = len(m)
    if n <= 2:
        return []
    off = np.maximum(m - np.diag(np.diag(m)), 0)
    degree = off.sum(axis=1)
    scale = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0)
    values, vectors = np.linalg.eigh(np.eye(n) - scale[:, None] * off * scale[None, :])
    best, low = (-np.inf, []), max(2, int((values < 0.05).sum()))
    for k in range(low, max(low, -(-n // 2)) + 1):
        points = vectors[:, :k]
        length = np.linalg.norm(points, axis=1, keepdims=True)
        labels = _means(points / np.where(length > 0, length, 1), min(k, n), seed)
        found = [np.flatnonzero(labels == x).tolist() for x in np.unique(labels)]
        score = sum(worth(off, g) for g in found)
        if score > best[0] + 1e-12:
            best = (score, found)
    return sorted(best[1])


def strengths(m: np.ndarray, groups: list[list[int]]) -> list[float]:
    """Of each cluster: the share of similarity inside it, less the square of the share that touches it."""
    off = m - np.diag(np.diag(m))
    total = off.sum()
    if total == 0:
        return [0.0] * len(groups)
    return [float(off[np.ix_(g, g)].sum() / total - (off[g].sum() / total) ** 2) for g in groups]


def mean_similarity(m: np.ndarray, group: list[int]) -> float:
    pairs = [m[i, j] for a, i in enumerate(group) for j in group[a + 1 :]]
    return float(np.mean(pairs)) if pairs else 0.0


def worth(m: np.ndarray, group: list[int]) -> float:
    """Strength per connection times mean similarity; 0 of a single item."""
    if len(group) < 2:
        return 0.0
    return strengths(m, [group])[0] / (len(group) * (len(group) - 1) / 2) * mean_similarity(m, group)


def good(m: np.ndarray, groups: list[list[int]]) -> list[tuple[list[int], float, float]]:
    """Clusters of two or more with a strength of at least 0, their strength, and its share of all those strengths."""
    found = [(g, s) for g, s in zip(groups, strengths(m, groups), strict=True) if len(g) > 1 and s >= 0]
    total = sum(s for _, s in found)
    return [(g, s, s / total if total else 0.0) for g, s in found]


ALGORITHMS: dict[str, Callable[..., list[list[int]]]] = {"AGGLOMERATIVE": agglomerative, "SPECTRAL": spectral}


def clustered(pairs: DataFrame, parts: DataFrame, *, algorithm: str = "AGGLOMERATIVE", preprocessor: str = "NONE", **options) -> DataFrame:
    """node, cluster (its smallest node), strength, normalised, mean, worth, of pairs (a, b, similarity).

    parts: (node, component), for example the connected components of the pairs kept by a threshold; each is clustered in
    a task of its own. After preprocessing, a part with at most two items has no clusters. Strengths are within a part.
    """
    inside = pairs.join(parts.select(F.col("node").alias("a"), "component"), "a")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(group.a) | set(group.b))
        at = {n: k for k, n in enumerate(names)}
        m = np.eye(len(names))
        for r in group.itertuples():
            m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.similarity
        m, left = prepared(m, preprocessor)
        out = []
        if len(left) > 2:
            found = ALGORITHMS[algorithm](m, **options)
            for g, s, share in good(m, found):
                own = [names[left[k]] for k in g]
                out += [(n, min(own), s, share, mean_similarity(m, g), worth(m, g)) for n in own]
        return pd.DataFrame(out, columns=["node", "cluster", "strength", "normalised", "mean", "worth"])

    kind = pairs.schema["a"].dataType.simpleString()
    return inside.groupBy("component").applyInPandas(run, f"node {kind}, cluster {kind}, strength double, normalised double, mean double, worth double")
