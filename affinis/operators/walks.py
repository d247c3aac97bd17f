"""Walks on graphs, what they are weighted by, message passing, and exact comparison of graphs.

Walks are joins, one a step: every start takes its next node by a hash of seed, start and step among the weights of
the successors, so a walk is the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(weights: Column) -> Column:
    """Weights by their sum, cut to [0, 1] and scaled to sum 1 again; zeros where the sum is 0."""

    def total(w: Column) -> Column:
        return F.aggregate(w, F.lit(0.0), lambda s, x: s + x)

    shares = F.transform(weights, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / total(weights))))
    again = F.transform(shares, lambda x: x / total(shares))
    zeros = F.transform(weights, lambda _: F.lit(0.0))
    return F.when(total(weights) == 0, zeros).when(total(shares) == 0, zeros).otherwise(again)


def adaptive_length(n: Column, base: int = 3, most: int = 10) -> Column:
    return F.least(F.greatest(F.lit(base), F.floor(base * F.greatest(F.lit(1.0), F.log10(n)))), F.lit(most)).cast("int")


def density_length(n_nodes: Column, n_edges: Column, least: int = 5, most: int = 25) -> Column:
    """Longer in large and in sparse graphs: by the logarithm of the nodes and by 1 less the density."""
    density = F.when(n_nodes > 1, n_edges / (n_nodes * (n_nodes - 1))).otherwise(0.0)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.log2(n_nodes + 1) * (2 - density)))).cast("int")


def successors(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """src, next: array of (dst, low, high) by name, with the range of [0, 1) that each owns by its weight."""
    w = F.lit(1.0) if weight is None else weight
    rows = edges.select("src", "dst", w.cast("double").alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    order = Window.partitionBy("src").orderBy("dst")
    ranged = rows.withColumn("high", F.sum("w").over(order)).withColumn("total", F.sum("w").over(Window.partitionBy("src"))).filter("total > 0")
    return ranged.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", ((F.col("high") - F.col("w")) / F.col("total")).alias("low"), (F.col("high") / F.col("total")).alias("high")))).alias("next"))


def walk(starts: DataFrame, next_nodes: DataFrame, steps: int, seed: int = 42) -> DataFrame:
    """start, path of at most ``steps`` nodes from each row's ``start``; a walk ends where nothing follows."""
    rows = starts.select("start", F.array("start").alias("path"), F.col("start").alias("at"))
    for k in range(1, steps):
        u = F.pmod(F.xxhash64("start", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
        hit = F.filter("next", lambda x: (x["low"] <= u) & (u < x["high"]))
        rows = rows.join(next_nodes.withColumnRenamed("src", "at"), "at", "left").withColumn("to", F.when(F.size(hit) > 0, hit[0]["dst"]))
        rows = rows.select("start", F.when(F.col("to").isNotNull(), F.array_append("path", F.col("to"))).otherwise(F.col("path")).alias("path"), F.col("to").alias("at"))
    return rows.select("start", "path")


def _both_ways(edges: DataFrame, forward: float) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1 - forward).alias("w"))
    return edges.select("src", "dst", F.lit(forward).alias("w")).unionByName(back)


#: Kinds of walks: their successors (of edges with columns src, dst, weight) and how many nodes more than asked they take.
VARIANTS: dict[str, tuple[Callable[[DataFrame], DataFrame], int]] = {
    "unweighted": (lambda e: successors(e), 0),
    "type_weighted": (lambda e: successors(e, F.col("weight")), 0),
    "degree": (lambda e: successors(e), 1),
    "test": (lambda e: successors(e), 0),
    "bidirectional": (lambda e: successors(_both_ways(e, 0.7), F.col("w")), 0),
}


def walks(edges: DataFrame, starts: DataFrame, steps: int, *, variant: str = "unweighted", seed: int = 42) -> DataFrame:
    of, more = VARIANTS[variant]
    return walk(starts, of(edges), steps + more, seed)


def walk_tokens(found: DataFrame, types: DataFrame) -> DataFrame:
    """start, tokens: each node's type and how often it has come in the walk so far."""
    rows = found.select("start", F.posexplode("path").alias("pos", "node")).join(types, "node")
    count = F.row_number().over(Window.partitionBy("start", "type").orderBy("pos"))
    return rows.withColumn("token", F.concat("type", count.cast("string"))).groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def reachable(edges: DataFrame, roots: DataFrame, keep: Callable[[DataFrame, str], DataFrame], most: int = 10_000) -> DataFrame:
    """(root, node) of every node that a root reaches along src -> dst, itself included. Frontiers are joined until none
    is new; ``keep`` writes a table and reads it back, so that lineage stays short."""
    seen = keep(roots.select("root", F.col("root").alias("node")).distinct(), "seen-0")
    front, parts = seen, [seen]
    for k in range(1, most):
        step = front.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").select("root", F.col("to").alias("node")).distinct()
        for p in parts:
            step = step.join(p, ["root", "node"], "left_anti")
        front = keep(step, f"seen-{k}")
        if front.isEmpty():
            break
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cones(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], least: int = 3) -> DataFrame:
    """(root, node): what each node without a predecessor reaches, of ``least`` nodes or more."""
    roots = edges.select(F.col("src").alias("root")).distinct().join(edges.select(F.col("dst").alias("root")).distinct(), "root", "left_anti")
    found = reachable(edges, roots, keep)
    return found.join(found.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("root"), "root", "left_semi")


# --- comparison -------------------------------------------------------------------------------------------------


def colours(nodes: Iterable[str], edges: list[tuple[str, str]], labels: dict[str, str] | None = None, rounds: int = 3) -> dict[str, int]:
    """Colours of nodes after rounds of refinement by their neighbours' colours, both ways."""
    colour = {n: hash_of((labels or {}).get(n, "")) for n in nodes}
    for _ in range(rounds):
        ins: dict[str, list[int]] = {n: [] for n in colour}
        outs: dict[str, list[int]] = {n: [] for n in colour}
        for a, b in edges:
            outs[a].append(colour[b])
            ins[b].append(colour[a])
        colour = {n: hash_of((c, tuple(sorted(ins[n])), tuple(sorted(outs[n])))) for n, c in colour.items()}
    return colour


def hash_of(x: object) -> int:
    import zlib

    return zlib.crc32(repr(x).encode())


def isomorphic(a: tuple[list[str], list[tuple[str, str]]], b: tuple[list[str], list[tuple[str, str]]]) -> bool:
    """Whether a renaming of nodes turns one directed graph into the other: colours first, then search by colour class."""
    if len(a[0]) != len(b[0]) or len(set(a[1])) != len(set(b[1])):
        return False
    x, y = colours(*a), colours(*b)
    if sorted(x.values()) != sorted(y.values()):
        return False
    ea, eb = set(a[1]), set(b[1])
    by: dict[int, list[str]] = {}
    for n, c in y.items():
        by.setdefault(c, []).append(n)
    order = sorted(a[0], key=lambda n: (len(by[x[n]]), x[n], n))

    def fits(n: str, m: str, to: dict[str, str]) -> bool:
        return all(((n, p) in ea) == ((m, q) in eb) and ((p, n) in ea) == ((q, m) in eb) for p, q in [*to.items(), (n, m)])

    stack: list[tuple[dict[str, str], int]] = [({}, 0)]
    while stack:
        to, k = stack.pop()
        if k == len(order):
            return True
        n, used = order[k], set(to.values())
        stack += [({**to, n: m}, k + 1) for m in by[x[n]] if m not in used and fits(n, m, to)]
    return False


def fast_similarity(n_a: Column, n_b: Column, m_a: Column, m_b: Column, degree: Column, names_a: Column, names_b: Column) -> Column:
    """0.3 of the node ratio, 0.3 of the edge ratio, 0.3 of the degree similarity, 0.1 of the names' Jaccard index."""

    def ratio(x: Column, y: Column) -> Column:
        return F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(1.0)

    union = F.size(F.array_union(names_a, names_b))
    names = F.when((F.size(names_a) > 0) & (F.size(names_b) > 0), F.size(F.array_intersect(names_a, names_b)) / union).otherwise(1.0)
    return 0.3 * ratio(n_a, n_b) + 0.3 * ratio(m_a, m_b) + 0.3 * degree + 0.1 * names


# --- message passing --------------------------------------------------------------------------------------------


def _sums(near: np.ndarray, h: np.ndarray) -> np.ndarray:
    return near @ h


def gcn(h: np.ndarray, near: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Neighbours and the node itself, by the roots of both degrees."""
    a = near + np.eye(len(near))
    d = 1 / np.sqrt(a.sum(axis=1))
    return _sums(d[:, None] * a * d[None, :], h @ w)


def gin(h: np.ndarray, near: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (h + _sums(near, h)) @ w


def gat(h: np.ndarray, near: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Neighbours and the node itself by a softmax of leaky scores."""
    x = h @ w
    half = np.linspace(-1, 1, x.shape[1])
    score = (x @ half)[:, None] + (x @ half[::-1])[None, :]
    score = np.where(near + np.eye(len(near)) > 0, np.where(score > 0, score, 0.2 * score), -np.inf)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return (e / e.sum(axis=1, keepdims=True)) @ x


LAYERS = {"gcn": gcn, "gin": gin, "gat": gat}
READOUTS = {"max": lambda h: h.max(axis=0), "mean": lambda h: h.mean(axis=0), "add": lambda h: h.sum(axis=0)}


def top_pool(h: np.ndarray, near: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of greatest score (along a fixed direction), scaled by it."""
    direction = np.ones(h.shape[1]) / np.sqrt(h.shape[1])
    score = np.tanh(h @ direction)
    keep = np.sort(np.argsort(-score, kind="stable")[: max(1, int(np.ceil(ratio * len(h))))])
    return h[keep] * score[keep, None], near[np.ix_(keep, keep)]


def sag_pool(h: np.ndarray, near: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """As top_pool, by a score that a convolution gives."""
    score = np.tanh(gcn(h, near, np.ones((h.shape[1], 1)) / np.sqrt(h.shape[1]))[:, 0])
    keep = np.sort(np.argsort(-score, kind="stable")[: max(1, int(np.ceil(ratio * len(h))))])
    return h[keep] * score[keep, None], near[np.ix_(keep, keep)]


POOLS = {"topk": top_pool, "sag": sag_pool, "none": lambda h, near, ratio: (h, near)}


def graph_vector(kinds: list[int], edges: list[tuple[int, int]], *, n_kinds: int = 37, layers: tuple[str, ...] = ("gcn", "gcn"), hidden: int = 200, pool: str = "topk", ratio: float = 0.8, readout: str = "max", seed: int = 0) -> np.ndarray:
    """A vector of a graph: one-hot kinds, layers with ReLU, pooling, readout. Weights are fixed by the seed (or replace
    them by trained ones: ``graph_weights``)."""
    if not kinds:
        return np.zeros(hidden)
    h = np.eye(n_kinds)[np.array(kinds)]
    near = np.zeros((len(kinds), len(kinds)))
    for a, b in edges:
        near[a, b] = near[b, a] = 1
    for layer, w in zip(layers, graph_weights(n_kinds, hidden, len(layers), seed), strict=True):
        h = np.maximum(LAYERS[layer](h, near, w), 0)
    h, near = POOLS[pool](h, near, ratio)
    return READOUTS[readout](h)


def graph_weights(n_kinds: int, hidden: int, layers: int, seed: int) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    sizes = [n_kinds] + [hidden] * layers
    return [r.normal(0, np.sqrt(2 / (a + b)), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def train_pairwise(x: np.ndarray, y: np.ndarray, same: np.ndarray, *, margin: float = 0.5, rate: float = 0.01, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """A linear map under which vectors of pairs that are the same point one way and others at least ``margin`` apart
    (cosine embedding loss, Adam)."""
    r = np.random.default_rng(seed)
    w = np.eye(x.shape[1]) + 0.01 * r.normal(size=(x.shape[1], x.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p, q = x @ w, y @ w
        a, b = np.linalg.norm(p, axis=1, keepdims=True) + 1e-9, np.linalg.norm(q, axis=1, keepdims=True) + 1e-9
        cos = (p * q).sum(axis=1, keepdims=True) / (a * b)
        g = np.where(same[:, None], -1.0, (cos > margin).astype(float)) / len(x)
        grad = x.T @ (g * (q / (a * b) - cos * p / a**2)) + y.T @ (g * (p / (a * b) - cos * q / b**2))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def classifier(features: DataFrame, *, label: str = "label", vector: str = "features"):
    """A weighted logistic regression of pooled vectors: rare labels weigh n / (k * count)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = features.groupBy(label).agg(F.count("*").alias("_c"))
    k, n = counts.count(), features.count()
    rows = features.join(F.broadcast(counts), label).select(F.col(label).cast("double").alias("label"), array_to_vector(vector).alias("features"), (F.lit(n) / (k * F.col("_c"))).alias("weight"))
    return LogisticRegression(weightCol="weight").fit(rows)
