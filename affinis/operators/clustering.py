"""Clusters of similar documents: connected components at a threshold, and average linkage inside them."""

from __future__ import annotations

import heapq
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.shared import kept


#: Similarities are added as whole numbers of this part.
_UNIT = 1 << 60


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of links (a, b); equal to MAX linkage at the links' threshold.
    Labels spread along links and then along labels (so long chains take few rounds); each round is checkpointed."""
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp())
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("next"), "label")
        jump = spread.select(F.col("node").alias("k"), F.col("next").alias("further"))
        after = spread.join(jump, F.col("next") == F.col("k"), "left").select("node", F.least("next", "further").alias("label"), F.col("label").alias("old")).checkpoint()
        if after.filter("label <> old").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def average_linkage(sims: dict[tuple[int, int], float], nodes: list[int], threshold: float, sizes: dict[int, int] | None = None) -> list[list[int]]:
    """Merges the two clusters of greatest mean similarity (missing pairs count 0) while it reaches the threshold; a node
    counts as often as ``sizes`` says (once by default)."""
    size = dict.fromkeys(nodes, 1) if sizes is None else {n: int(sizes[n]) for n in nodes}
    groups = {n: [n] for n in sorted(nodes)}  # by the smallest member
    links: dict[int, dict[int, int]] = {n: {} for n in groups}
    for (i, j), sim in sims.items():
        if i in links and j in links and i < j:
            links[i][j] = links[j][i] = int(sim * _UNIT) * size[i] * size[j]  # whole numbers add up the same in any order
    if threshold <= 0:  # then also what no similarity links can merge
        for i in groups:
            links[i] = {j: links[i].get(j, 0) for j in groups if j != i}

    def entry(i: int, j: int) -> tuple[float, int, int]:
        i, j = min(i, j), max(i, j)
        return -(links[i][j] / (size[i] * size[j] * _UNIT)), i, j

    # each group is on the heap with the best of its links to later ones; a group whose best may have gone looks again
    best = {}

    def look(i: int) -> None:
        best[i] = min((entry(i, j) for j in links[i] if j > i), default=None)
        if best[i] and -best[i][0] >= threshold:
            heapq.heappush(heap, best[i])

    heap: list[tuple[float, int, int]] = []
    size = dict(size)
    for i in groups:
        look(i)
    while heap:
        found = heapq.heappop(heap)
        _, i, j = found
        if best.get(i) != found:
            continue
        gone = links.pop(j)
        del best[j], links[i][j], gone[i]
        size[i] += size.pop(j)
        groups[i] = sorted(groups[i] + groups.pop(j))
        for k, total in gone.items():
            del links[k][j]
            links[i][k] = links[k][i] = links[i].get(k, 0) + total
        look(i)
        for k in links[i]:
            if k < j and best.get(k) and best[k][2] in (i, j):
                look(k)
            elif k < i and (now := entry(k, i)) < (best[k] or (0.0, 0, 0)):
                best[k] = now
                if -now[0] >= threshold:
                    heapq.heappush(heap, now)
    return list(groups.values())


def agglomerative_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average linkage at 0.2 inside each component of the pairs at 0.2: node, cluster (its smallest member). Copies of
    a text count in the means and lie in the cluster of their representative, or form one."""
    from affinis.plans import catalogue

    pairs = kept(catalogue.queries()["pp_threshold"](spark, sf_dir), "pairs")  # links and similarities from one count of the pairs
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select("doc_id", F.md5("text").alias("t"))
    texts = docs.groupBy("t").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("size"))
    placed = connected(pairs.select("a", "b"))
    sized = [texts.select(F.col("rep").alias(k), F.col("size").alias(f"n_{k}")) for k in "ab"]
    inside = pairs.join(placed, pairs.a == placed.node).select("component", "a", "b", "sim").join(sized[0], "a").join(sized[1], "b")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        sims = {(int(r.a), int(r.b)): r.sim for r in group.itertuples()}
        sizes = {int(n): int(k) for c in "ab" for n, k in zip(group[c], group[f"n_{c}"], strict=True)}
        found = average_linkage(sims, sorted({n for p in sims for n in p}), 0.2, sizes)
        return pd.DataFrame([(n, g[0]) for g in found for n in g], columns=["node", "cluster"])

    linked = inside.groupBy("component").applyInPandas(link, "node long, cluster long")
    every = docs.join(texts, "t").join(linked.withColumnRenamed("node", "rep"), "rep", "left").filter("cluster is not null or size > 1")
    return every.select(F.col("doc_id").alias("node"), F.coalesce("cluster", "rep").alias("cluster")).distinct()
