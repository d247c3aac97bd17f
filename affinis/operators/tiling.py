"""Greedy string tiling, merging of neighbouring tiles, and similarities from tiles.

The kernels work on integer tokens of one pair; the queries deal out only pairs that share a run of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tile = tuple[int, int, int, int]  # first start, second start, first length, second length


def _longest(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """The greatest length of a common run of free tokens, and where such runs start, by first then second start."""
    best, where = 0, []
    run = np.zeros(len(b) + 1, np.int32)
    for i in range(len(a)):
        if free_a[i]:
            run[1:] = np.where((b == a[i]) & free_b, run[:-1] + 1, 0)
        else:
            run[:] = 0
        top = int(run.max()) if len(b) else 0
        if top and top >= best:
            if top > best:
                best, where = top, []
            where += [(i - top + 1, int(j) - top) for j in np.flatnonzero(run == top)]
    return best, sorted(where)


def greedy_tiles(a, b, least: int, *, free_a=None, free_b=None) -> list[Tile]:
    """Longest common runs first, until none has ``least`` tokens; among equals by first, then second start. Tokens
    below 0 match nothing (ends of files)."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    free_a = (a >= 0) if free_a is None else np.array(free_a, bool) & (a >= 0)
    free_b = (b >= 0) if free_b is None else np.array(free_b, bool) & (b >= 0)
    out: list[Tile] = []
    while True:
        n, where = _longest(a, b, free_a, free_b)
        if n < max(1, least):
            return out
        for i, j in where:
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                out.append((i, j, n, n))
                free_a[i : i + n] = False
                free_b[j : j + n] = False


def merge_tiles(tiles: list[Tile], *, max_gap: int = 6, least: int = 9, required: int = 1, ends_a=(), ends_b=()) -> list[Tile]:
    """Merges tiles that follow each other in both texts with a mean gap of at most ``max_gap`` and no end of a file
    between, again and again; drops tiles under ``least``. With fewer merges than required nothing is merged."""
    now, merges = sorted(tiles), 0
    changed = True
    while changed:
        changed = False
        second = {t: k for k, t in enumerate(sorted(now, key=lambda t: t[1]))}
        for x, y in zip(now, now[1:], strict=False):
            gaps = y[0] - x[0] - x[2], y[1] - x[1] - x[3]
            crosses = any(x[0] + x[2] <= e < y[0] for e in ends_a) or any(x[1] + x[3] <= e < y[1] for e in ends_b)
            if second[y] == second[x] + 1 and sum(gaps) / 2 <= max_gap and not crosses:
                now[now.index(x)] = (x[0], x[1], x[2] + y[2] + gaps[0], x[3] + y[3] + gaps[1])
                now.remove(y)
                merges, changed = merges + 1, True
                break
    if merges < required:
        now = sorted(tiles)
    return [t for t in now if min(t[2], t[3]) >= least]


def similarity(tiles: list[Tile], n_a: int, n_b: int) -> float:
    """Matched tokens of both by all tokens of both."""
    return sum(t[2] + t[3] for t in tiles) / (n_a + n_b) if n_a + n_b else 0.0


def _pairs_with_tokens(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """Pairs of different texts (the smallest doc_id of each stands for its copies) with a common run of ``least`` tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.join(docs.groupBy(F.md5("text").alias("m")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")
    tokens = own.select("doc_id", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("t"))
    coded = tokens.select("doc_id", F.transform("t", lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << 62) - 1))).alias("t"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - least + 1, F.lit(1)))
    runs = coded.filter(F.size("t") >= least).select("doc_id", F.explode(F.array_distinct(F.transform(starts, lambda k: F.xxhash64(F.slice("t", k, least))))).alias("g"))
    common = runs.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    kept = runs.join(common, "g")
    other = kept.select("g", F.col("doc_id").alias("b"))
    pairs = kept.withColumnRenamed("doc_id", "a").join(other, "g").filter("a < b").select("a", "b").distinct()
    return pairs.join(coded.select(F.col("doc_id").alias("a"), F.col("t").alias("ta")), "a").join(coded.select(F.col("doc_id").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")


def _tiled(least: int, merged: bool, share):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            from affinis.operators.compare import tiles as tiled

            out = []
            for r in batch.itertuples():
                tiles = tiled(r.ta, r.tb, 2 if merged else least)
                tiles = merge_tiles(tiles, least=least) if merged else tiles
                if not tiles:  # as of all other pairs without tiles, no row
                    continue
                out.append((r.a, r.b, len(tiles), sum(t[2] for t in tiles), max((t[2] for t in tiles), default=0), round(share(tiles, len(r.ta), len(r.tb)), 6)))
            yield pd.DataFrame(out, columns=["a", "b", "n_tiles", "matched", "longest", "similarity"])

    return run


_OUT = "a long, b long, n_tiles long, matched long, longest long, similarity double"


def gst_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of at least 9 tokens of every pair of different texts that shares such a run."""
    return _pairs_with_tokens(spark, sf_dir, 9).mapInPandas(_tiled(9, False, similarity), _OUT)


def gst_simple_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple variant: runs of 6 (also to become a pair), matched tokens by the longer text."""
    return _pairs_with_tokens(spark, sf_dir, 6).mapInPandas(_tiled(6, False, lambda t, n, m: min(1.0, sum(x[2] for x in t) / max(n, m, 1))), _OUT)


def merging_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 2 tokens merged over gaps, then those of at least 9, of every pair that shares a run of 2."""
    return _pairs_with_tokens(spark, sf_dir, 2).mapInPandas(_tiled(9, True, similarity), _OUT)
