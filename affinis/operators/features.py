"""Feature vectors of small graphs, of pairs of graphs, of circuits and of pairs of circuits.

A graph is its nodes (names) and edges (src, dst, type). The vectors' layouts are fixed: what stands where and by what
it is divided must equal what other programs read. One graph, or pair, is worked out in a task; graphs side by side.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words looked for in names and edge types, in the order of their places.
SUSPECT = ["trojan", "hint", "malicious", "trigger", "payload"]
OPERATORS = ["and", "or", "not", "xor", "nand", "nor", "add", "sub", "mul"]
EDGE_5 = ["data", "control", "flow", "assign", "port"]
EDGE_10 = ["data", "control", "flow", "assign", "port", "dependency", "trigger", "payload", "select", "enable"]
CIRCUIT_EDGES = ["data", "control", "flow", "dependency", "assign", "port", "net", "reg", "wire", "always"]
CIRCUIT_NODES = ["clock", "reset", "input", "output", "internal"]
PREFIXES = ["i_", "in_", "o_", "out_", "w_", "wire_", "clk", "rst", "reset"]


@dataclass
class Graph:
    nodes: list[str]
    edges: list[tuple[str, str, str]]

    def __post_init__(self):
        self.n_in, self.n_out = Counter(b for _, b, _ in self.edges), Counter(a for a, _, _ in self.edges)

    def degrees(self, which: str = "all") -> np.ndarray:
        counts = {"in": self.n_in, "out": self.n_out}
        used = [counts[which]] if which in counts else [self.n_in, self.n_out]
        return np.array([sum(c[n] for c in used) for n in self.nodes], float)

    def neighbours(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {n: set() for n in self.nodes}
        for a, b, _ in self.edges:
            if a != b:
                out[a].add(b)
                out[b].add(a)
        return out


def _mean(x) -> float:
    return float(np.mean(x)) if len(x) else 0.0


def _max(x) -> float:
    return float(np.max(x)) if len(x) else 0.0


def _std(x) -> float:
    return float(np.std(x)) if len(x) > 1 else 0.0


def _has(names: Iterable[str], *words: str) -> int:
    return sum(any(w in n.lower() for w in words) for n in names)


def _share(part: float, whole: float) -> float:
    return part / max(whole, 1)


def _type_counts(types: Counter, words: list[str]) -> list[int]:
    return [sum(c for t, c in types.items() if w in t.lower()) for w in words]


def _padded(x: list[float], n: int) -> list[float]:
    return [float(v) for v in x[:n]] + [0.0] * (n - len(x))


def features_20(g: Graph) -> list[float]:
    n, m = len(g.nodes), len(g.edges)
    lengths = [len(x) for x in g.nodes]
    size = [n / 100, m / 100, _share(m, n), n**0.5 / 10, np.log1p(n) / 5]
    names = [_share(_has(g.nodes, "clk"), n), _share(_has(g.nodes, "rst", "reset"), n), _share(_has(g.nodes, "["), n), _mean(lengths) / 20, _max(lengths) / 50]
    kinds = [_share(c, m) for c in _type_counts(Counter(t for _, _, t in g.edges), EDGE_5)]
    return _padded(size + names + kinds, 20)


def distances(near: dict[str, set[str]]) -> list[dict[str, int]]:
    """Of each node, how far every node is that it reaches."""
    out = []
    for start in near:
        found, todo = {start: 0}, deque([start])
        while todo:
            at = todo.popleft()
            for x in near[at]:
                if x not in found:
                    found[x] = found[at] + 1
                    todo.append(x)
        out.append(found)
    return out


def parts(near: dict[str, set[str]]) -> int:
    seen: set[str] = set()
    count = 0
    for start in near:
        if start in seen:
            continue
        count += 1
        todo = [start]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += near[at] - seen
    return count


def _clustering(near: dict[str, set[str]]) -> float:
    """Mean share of a node's pairs of neighbours that are neighbours."""
    found = []
    for own in near.values():
        pairs = len(own) * (len(own) - 1) / 2
        links = sum(len(near[x] & own) for x in own) / 2
        found.append(links / pairs if pairs else 0.0)
    return _mean(found)


def _moment(x: np.ndarray, k: int) -> float:
    s = x.std()
    return float(((x - x.mean()) ** k).mean() / s**k) if s > 0 else 0.0


def _connectivity(g: Graph) -> list[float]:
    """Diameter, mean distance, parts, density, degree centrality, clustering. Large graphs, and graphs in several parts,
    have 0.5 where distances would stand. A failure fills fifteen places with 0.5."""
    n, m = len(g.nodes), len(g.edges)
    if n == 0:
        return [0.5] * 15
    near = g.neighbours()
    count = parts(near)
    far = distances(near) if count == 1 and n < 500 else []
    reach = [max(d.values()) / 20 for d in far]
    total = sum(sum(d.values()) for d in far)
    out = [max(reach) if far else 0.5]
    out.append(0.5 if count > 1 or n >= 200 else total / (n * (n - 1)) / 10 if n > 1 else 0.0)
    out += [count / 10, 1 / count, m / (n * (n - 1)) if n > 1 else 0.0]
    if n < 200:
        central = np.array([len(x) / (n - 1) for x in near.values()]) if n > 1 else np.ones(1)
        loops = {a for a, b, _ in g.edges if a == b}
        if n > 1 and loops:
            central = central + np.array([2 / (n - 1) if x in loops else 0.0 for x in near])
        out += [_mean(central), _max(central), float(np.std(central)), _clustering(near)]
    else:
        out += [0.5] * 4
    return out


def features_80(g: Graph) -> list[float]:
    """72 values and zeros: size 10, degrees 15, names 6, operators 9, connectivity 9, edge types 11, hierarchy 12."""
    n, m = len(g.nodes), len(g.edges)
    out = [n / 100, m / 100, _share(m, n), n**0.5 / 10, np.log1p(n) / 5, n * m / 1000, m / (n * (n - 1) / 2 + 1), np.log1p(m) / 5, (n + m) / 150, abs(n - m) / 100]
    if n:
        for which in ("in", "out", "all"):
            d = g.degrees(which)
            out += [_mean(d) / 10, _max(d) / 20, _std(d) / 10, float(np.median(d)) / 10]
        d = g.degrees()
        out += [_moment(d, 3) / 5, (_moment(d, 4) - 3 if d.std() > 0 else 0.0) / 10, float(np.percentile(d, 75)) / 10] if n > 2 else [0.0, 0.0, 0.0]
    else:
        out += [0.0] * 15
    lengths = [len(x) for x in g.nodes]
    out += [_share(_has(g.nodes, "clk"), n), _share(_has(g.nodes, "rst", "reset"), n), _share(_has(g.nodes, "["), n), _mean(lengths) / 30, _max(lengths) / 50, _std(lengths) / 20]
    out += [_share(_has(g.nodes, w), n) for w in OPERATORS]
    out += _connectivity(g)
    types = Counter(t for _, _, t in g.edges)
    out += [_share(c, m) for c in _type_counts(types, EDGE_10)]
    shares = np.array(list(types.values()), float) / max(m, 1)
    out.append(float(-(shares * np.log2(shares + 1e-10)).sum()) / 5 if len(shares) else 0.0)
    points, lines = [x.count(".") for x in g.nodes], [x.count("_") for x in g.nodes]
    heads, suspects, digits = len({x.split(".")[0] for x in g.nodes}), _has(g.nodes, *SUSPECT), sum(any(c.isdigit() for c in x) for x in g.nodes)
    out += [_mean(points) / 5, _max(points) / 10, _std(points) / 5, _share(heads, n), heads / 20]
    out += [_share(suspects, n), suspects / 10, float(suspects > 0), _share(digits, n), digits / 20, _mean(lines) / 5, _max(lines) / 10]
    return _padded(out, 80)


def pair_difference(new: Graph, old: Graph) -> list[float]:
    """34 values of how a graph differs from another: nodes 13 (and 2 zeros), edges 8, degrees 5, parts 1, names 5."""
    a, b = set(new.nodes), set(old.nodes)
    n, m = len(a), len(b)
    came, gone, both = a - b, b - a, a & b
    lengths = [[len(x) for x in s] for s in (a, b)]

    def apart(f, x, y, by: float) -> float:
        return abs(f(x) - f(y)) / by if len(x) and len(y) else 0.0

    spread = abs(np.std(lengths[0]) - np.std(lengths[1])) / 15 if min(n, m) > 1 else 0.0
    heads = [{x.split(".")[0] for x in s} for s in (a, b)]
    suspects = _has(came, *SUSPECT), _has(gone, *SUSPECT)
    out = [_share(abs(n - m), n + m), _share(len(came), n), _share(len(gone), m), _share(len(both), n + m), _share(len(came) + len(gone), n + m)]
    out += [apart(np.mean, *lengths, 20), apart(np.max, *lengths, 30), spread, _share(suspects[0], len(came)), _share(suspects[1], len(gone)), float(suspects[0] > 0)]
    out += [_share(len(heads[0] - heads[1]), len(heads[0] | heads[1])), _share(len(heads[1] - heads[0]), len(heads[0] | heads[1]))]
    out = _padded(out, 15)
    x, y = ({e[:2] for e in g.edges} for g in (new, old))
    p, q = len(new.edges), len(old.edges)
    out += [_share(abs(p - q), p + q), _share(len(x - y), p), _share(len(y - x), q), _share(len(x & y), p + q), _share(len(x ^ y), p + q)]
    s, t = (Counter(e[2] for e in g.edges) for g in (new, old))
    kinds = set(s) | set(t)
    out += [_share(sum(abs(s[k] - t[k]) for k in kinds), p + q), _share(len(set(s) - set(t)), len(kinds)), _share(len(set(t) - set(s)), len(kinds))]
    if n and m:
        d, e = new.degrees(), old.degrees()
        out += [apart(np.mean, d, e, 10), apart(np.max, d, e, 15), abs(np.std(d) - np.std(e)) / 10 if min(n, m) > 1 else 0.0]
        out += [apart(np.mean, new.degrees(w), old.degrees(w), 10) for w in ("in", "out")]
    else:
        out += [0.0] * 7
    joined = [parts(g.neighbours()) <= 1 for g in (new, old)]
    out.append(float(joined[0] != joined[1]))
    counts = [[sum("[" in v for v in s), sum(v.count("_") for v in s), sum(any(c.isdigit() for c in v) for v in s), _has(s, "clk"), _has(s, "rst", "reset")] for s in (a, b)]
    return [float(v) for v in out + [_share(abs(u - v), n + m) for u, v in zip(*counts, strict=True)]]


@dataclass
class Circuit:
    """What is known of a whole circuit: node and edge counts by type, dataflow edges, signal names, subgraphs."""

    n_nodes: int
    n_edges: int
    n_subgraphs: int
    node_types: Counter
    edge_types: Counter
    dataflow: list[tuple[str, str]]
    signals: set[str]


def circuit_100(c: Circuit) -> list[float]:
    """70 values and zeros: size 10, node types 10, edge types 10, dataflow 10 (20 zeros without any), names 10, structure 10."""
    n, m, f, s, k = c.n_nodes, c.n_edges, len(c.dataflow), len(c.signals), c.n_subgraphs
    out = [n / 1000, m / 1000, f / 500, s / 1000, k / 100, _share(m, n), _share(f, m), n**0.5 / 10, np.log1p(n) / 10, np.log1p(m) / 10]
    t = c.node_types
    out += [_share(t[w], n) for w in CIRCUIT_NODES]
    out += [_share(t["clock"] * t["input"], n), _share(t["clock"] * t["output"], n), t["clock"] / max(t.get("internal", 1), 1), t["input"] / max(t.get("output", 1), 1), _share(t["input"] + t["output"], n)]
    out += [_share(sum(w in kind.lower() for kind in c.edge_types), m) for w in CIRCUIT_EDGES]
    if c.dataflow:
        x, y = (list(Counter(e[side] for e in c.dataflow).values()) for side in (1, 0))
        out += [_share(len(x), n), _share(len(y), n), _mean(x) / 10, _max(x) / 50, _mean(y) / 10, _max(y) / 50, _std(x) / 10, _std(y) / 10]
        out += [_share(sum(v > 1 for v in x), len(x)), _share(sum(v > 1 for v in y), len(y))]
    else:
        out += [0.0] * 20
    lengths = [len(v) for v in c.signals]
    out += [_mean(lengths) / 20, _max(lengths) / 50, min(lengths, default=0) / 20, _std(lengths) / 10]
    out += [_share(v, s) for v in (sum("[" in x for x in c.signals), _has(c.signals, "clk"), _has(c.signals, "rst", "reset"))]
    out += [_share(sum(x.startswith(p) for x in c.signals), s) for p in (("i_", "in_"), ("o_", "out_"), ("w_", "wire_"))]
    degree = _share(2 * m, n)
    out += [degree / 10, np.log1p(degree) / 5, _share(n, m), _share(m, n**2), _share(k, n), np.log1p(k) / 5, (n + m) / 1000, n * m / 100000, (n * m) ** 0.5 / 100, _share(f, n)]
    return _padded(out, 100)


def circuit_pair_100(new: Circuit, old: Circuit) -> list[float]:
    """100 values of how a circuit differs from its base: sizes 16 (and 4 zeros), signal sets 7 and prefixes 18 (and 5
    zeros), node types 20, edge types 20, totals 10."""
    x, y = ([c.n_nodes, c.n_edges, len(c.signals), c.n_subgraphs] for c in (new, old))
    d = [abs(a - b) for a, b in zip(x, y, strict=True)]
    out = [d[0] / 100, d[1] / 100, d[2] / 100, d[3] / 10, *[(a - b) / max(b, 1) for a, b in zip(x, y, strict=True)], *[a / max(b, 1) for a, b in zip(x, y, strict=True)]]
    out += [d[0] * d[1] / 10000, (x[0] + x[1]) / max(y[0] + y[1], 1), np.log1p(d[0]) / 5, np.log1p(d[1]) / 5]
    out = _padded(out, 20)
    came, gone, both = new.signals - old.signals, old.signals - new.signals, new.signals & old.signals
    out += [_share(len(came), x[2]), _share(len(gone), y[2]), _share(len(both), x[2]), _share(len(both), y[2]), _share(len(both), len(new.signals | old.signals))]
    out += [_mean([len(v) for v in s]) / 20 for s in (came, gone)]
    for p in PREFIXES:
        out += [_share(_has(s, p), len(s)) for s in (came, gone)]
    out = _padded(out, 50)
    for w in CIRCUIT_NODES:
        a, b = new.node_types[w], old.node_types[w]
        out += [abs(a - b) / max(y[0], 1), (a - b) / b if b else 0.0, a / max(b, 1), b / max(a, 1)]
    for a, b in zip(_type_counts(new.edge_types, CIRCUIT_EDGES), _type_counts(old.edge_types, CIRCUIT_EDGES), strict=True):
        out += [abs(a - b) / max(y[1], 1), (a - b) / b if b else 0.0]
    changed = len(came) + len(gone)
    out += [_share(changed, y[2]), _share(changed, x[2]), np.log1p(changed) / 5, d[0] + d[1] / 100, abs(x[0] * x[1] - y[0] * y[1]) / 10000]
    out += [_share(2 * len(came) + len(gone), y[2]), _share(len(both), x[2]), _share(len(both), y[2]), _share(changed, x[0] + y[0]), _share(changed, x[1] + y[1])]
    return _padded(out, 100)


# --- on DataFrames ----------------------------------------------------------------------------------------------


def gathered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, nodes, edges: one row a graph, of rows (graph, node) and (graph, src, dst, type). Graphs must fit a row."""
    n = nodes.groupBy("graph").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    e = edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.coalesce("type", F.lit("unknown")).alias("type")))).alias("edges"))
    return n.join(e, "graph", "left")


def _graph(nodes, edges) -> Graph:
    own = [str(x) for x in nodes] if nodes is not None else []
    return Graph(own, [(e["src"], e["dst"], e["type"]) for e in edges] if edges is not None else [])


def graph_features(nodes: DataFrame, edges: DataFrame, kind: str = "80") -> DataFrame:
    """graph, features of each graph; kind 20 or 80."""
    of = {"20": features_20, "80": features_80}[kind]

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"graph": b["graph"], "features": [of(_graph(n, e)) for n, e in zip(b["nodes"], b["edges"], strict=True)]})

    return gathered(nodes, edges).select(F.col("graph").cast("string").alias("graph"), "nodes", "edges").mapInPandas(run, "graph string, features array<double>")


def difference_features(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, features of how graph a differs from graph b, for rows (a, b)."""
    rows = gathered(nodes, edges).select(F.col("graph").cast("string").alias("graph"), "nodes", "edges")
    sides = [rows.toDF(s, f"n{s}", f"e{s}") for s in "ab"]
    joined = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).join(sides[0], "a").join(sides[1], "b")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "features": [pair_difference(_graph(r.na, r.ea), _graph(r.nb, r.eb)) for r in b.itertuples()]})

    return joined.select("a", "b", "na", "ea", "nb", "eb").mapInPandas(run, "a string, b string, features array<double>")


def best_difference(features: DataFrame) -> DataFrame:
    """For each a, the b whose difference has the least Euclidean length (ties: the smaller b), and that length."""
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
    return features.select("a", "b", length.alias("diff")).groupBy("a").agg(F.min(F.struct("diff", "b")).alias("best")).select("a", "best.b", "best.diff", (1 / (1 + F.col("best.diff"))).alias("similarity"))


def circuits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """circuit and what Circuit holds, of rows (circuit, graph, node, type) and (circuit, graph, src, dst, type). Edges
    whose type says data or flow are dataflow; every node's name is a signal."""
    n = nodes.groupBy("circuit").agg(F.count_distinct("node").alias("n_nodes"), F.count_distinct("graph").alias("n_subgraphs"), F.collect_list(F.col("type")).alias("kinds"), F.collect_set("node").alias("signals"))
    flow = F.lower("type").rlike("data|flow")
    e = edges.groupBy("circuit").agg(F.count("*").alias("n_edges"), F.collect_list("type").alias("edge_kinds"), F.collect_list(F.when(flow, F.struct("src", "dst"))).alias("dataflow"))
    return n.join(e, "circuit", "left")


def _circuit(r) -> Circuit:
    held = lambda x: [] if x is None or isinstance(x, float) else list(x)
    return Circuit(int(r["n_nodes"]), int(r["n_edges"] or 0), int(r["n_subgraphs"]), Counter(held(r["kinds"])), Counter(held(r["edge_kinds"])), [(x["src"], x["dst"]) for x in held(r["dataflow"])], set(held(r["signals"])))


def circuit_features(nodes: DataFrame, edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """circuit, features (100) of each circuit; with pairs (circuit, base), of how each differs from its base."""
    rows = circuits(nodes, edges).fillna(0, ["n_edges"])
    if pairs is None:

        def run(batches):
            for b in batches:
                yield pd.DataFrame({"circuit": b["circuit"], "features": [circuit_100(_circuit(r)) for r in b.to_dict("records")]})

        return rows.mapInPandas(run, "circuit string, features array<double>")
    packed = rows.select("circuit", F.struct(*[c for c in rows.columns if c != "circuit"]).alias("held"))
    joined = pairs.select("circuit", "base").join(packed, "circuit").join(packed.toDF("base", "base_held"), "base")

    def run_pairs(batches):
        for b in batches:
            found = [circuit_pair_100(_circuit(x), _circuit(y)) for x, y in zip(b["held"].to_dict("records") if isinstance(b["held"], pd.DataFrame) else b["held"], b["base_held"].to_dict("records") if isinstance(b["base_held"], pd.DataFrame) else b["base_held"], strict=True)]
            yield pd.DataFrame({"circuit": b["circuit"], "base": b["base"], "features": found})

    return joined.select("circuit", "base", "held", "base_held").mapInPandas(run_pairs, "circuit string, base string, features array<double>")
