"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Rows are dealt to shards of bounded size by a hash. A shard's graph is built in batches: greedy searches from the
entry point propose neighbours, relaxed distance pruning keeps diverse edges, and edges go back as well. Query blocks
search every shard by beam; the best over all shards are kept. Equal vectors are one node, so a vector that a third of
all rows share costs no more than another, and ties still go to the smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import Scratch, arrow_limits

#: Vectors of a shard (a mean), out-degree, beam of the build and of a search, slack of the pruning rule, queries of a block.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA, BLOCK = 4096, 24, 48, 96, 1.2, 512


def _search(unit: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: (nodes, distances) by rising distance, -1 and inf where there are fewer.

    Distance is 1 - cosine. links has -1 for no edge.
    """
    n_q, width = len(queries), links.shape[1]
    rows = np.arange(n_q)
    nodes = np.full((n_q, beam), -1, np.int64)
    dist = np.full((n_q, beam), np.inf)
    done = np.ones((n_q, beam), bool)
    nodes[:, 0], dist[:, 0], done[:, 0] = entry, 1 - queries @ unit[entry], False
    seen = np.zeros((n_q, len(unit)), bool)
    seen[:, entry] = True
    live = rows
    while len(live):
        waiting = np.where(done[live], np.inf, dist[live])
        at = waiting.argmin(axis=1)
        go = np.isfinite(waiting[np.arange(len(live)), at])
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        near = links[nodes[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        owner, slot = np.nonzero(fresh)
        found = near[owner, slot]
        seen[live[owner], found] = True
        far = np.full((len(live), width), np.inf)
        far[owner, slot] = 1 - np.einsum("ij,ij->i", unit[found], queries[live[owner]])
        all_dist = np.concatenate([dist[live], far], axis=1)
        all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        dist[live], nodes[live], done[live] = (np.take_along_axis(x, best, axis=1) for x in (all_dist, all_nodes, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point, diverse neighbours among its candidates (-1: none): the nearest stays and drops all that lie
    alpha times nearer to it than to the point."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    ordered = np.sort(candidates, axis=1)
    again = np.zeros(ordered.shape, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    candidates = np.where(again, -1, ordered)
    there = unit[candidates]
    dist = 1 - np.matmul(there, unit[points][:, :, None])[:, :, 0]
    dist[candidates < 0] = np.inf
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    left = dist.copy()
    for k in range(degree):
        at = left.argmin(axis=1)
        some = np.isfinite(left[rows, at])
        if not some.any():
            break
        chosen = candidates[rows, at]
        out[some, k] = chosen[some]
        among = 1 - np.matmul(there, unit[np.maximum(chosen, 0)][:, :, None])[:, :, 0]
        left[alpha * among <= dist] = np.inf
        left[rows, at] = np.inf
        left[~some] = np.inf
    return out


def build_graph(unit: np.ndarray, *, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """(links, entry) over unit vectors. Points enter in random order, in batches that double up to 256."""
    n = len(unit)
    links = np.full((n, degree), -1, np.int64)
    entry = int((unit @ unit.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    at, size = 0, 1
    while at < n:
        some = order[at : at + size]
        at, size = at + size, min(256, 2 * size)
        proposed, _ = _search(unit, links, entry, unit[some], beam)
        links[some] = _prune(unit, some, np.concatenate([proposed, links[some]], axis=1), degree, alpha)
        source = np.repeat(some, degree)
        target = links[some].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        widest = int(count.max()) if len(count) else 0
        back = np.full((len(nodes), widest), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate([links[nodes], back], axis=1)
        few = (both >= 0).sum(axis=1) <= degree
        if few.any():
            packed = np.sort(both[few], axis=1)[:, ::-1]
            packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
            links[nodes[few]] = np.sort(packed, axis=1)[:, ::-1][:, :degree]
        if (~few).any():
            links[nodes[~few]] = _prune(unit, nodes[~few], both[~few], degree, alpha)
    return links, entry


def _usable(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    out = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return out.filter(F.col("v").isNotNull() & fine)


def nearest(embeddings: DataFrame, *, query_every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """For every row whose vec_id is divisible by ``query_every``, the ``k`` nearest other rows by cosine.

    Returns query_id, rank (from 1), vec_id and score (cosine in double precision on the original vectors), nearest
    first, ties to the smaller vec_id; fewer rows if there are fewer candidates. Null or zero vectors, and those with
    null or non-finite components, take no part; nor do vectors of another length than the query's. A null vec_id takes
    no part; a repeated one is a candidate each time, but never of a query with that id. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "ann")
    rows = _usable(embeddings, vec_id, vector).filter("vec_id is not null").withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard).cast("long"))
    # The dims of a table are few, but that has no proven bound, so this is left to the planner.
    dealt = rows.join(sizes.select("dim", "shards"), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dim = table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        distinct, back = np.unique(v, axis=0, return_inverse=True)
        back = back.ravel()
        by = np.argsort(back, kind="stable")  # ids rise within each class
        first = np.searchsorted(back[by], np.arange(len(distinct) + 1))
        scaled = distinct / np.abs(distinct).max(axis=1, keepdims=True)
        unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        links, entry = build_graph(unit)
        cells = [distinct.astype("<f8"), links.astype("<i4"), first.astype("<i8"), ids[by].astype("<i8")]
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "entry": pa.array([entry], pa.int64()), **{n: pa.array([c.tobytes()], pa.binary()) for n, c in zip(("vectors", "links", "first", "ids"), cells, strict=True)}})

    shards = sizes.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.repartition(min(2 * shards, 8192), "dim", "shard")  # a count of its own, so that shards are not merged into one task
    graphs = scratch.keep(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, entry long, vectors binary, links binary, first binary, ids binary"), "graphs")
    asked = rows.filter(F.col("vec_id") % query_every == 0).join(sizes.select("dim", "shards"), "dim")
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    asked = asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")))
    packed = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"), F.first("shards").alias("shards"))
    each = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    width = beam

    def search(table: pa.Table) -> pa.Table:
        out = [[], [], []]
        for r in range(table.num_rows):
            row = {n: table.column(n)[r] for n in table.column_names}
            dim = row["dim"].as_py()
            vectors, links, first, ids = (np.frombuffer(row[n].as_buffer(), t) for n, t in (("vectors", "<f8"), ("links", "<i4"), ("first", "<i8"), ("ids", "<i8")))
            vectors = vectors.reshape(-1, dim)
            links = links.reshape(len(vectors), -1).astype(np.int64)
            asked = row["asked"].values
            q_ids = asked.field("vec_id").to_numpy()
            q = np.array(asked.field("v").to_pylist(), float).reshape(len(q_ids), dim)
            scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            q_scaled = q / np.abs(q).max(axis=1, keepdims=True)
            q_unit = q_scaled / np.linalg.norm(q_scaled, axis=1, keepdims=True)
            nodes, _ = _search(unit, links, row["entry"].as_py(), q_unit, width)
            for one, own, found in zip(q_ids.tolist(), q_scaled, nodes, strict=True):
                found = found[found >= 0]
                score = [math.fsum(own * scaled[c]) / math.sqrt(math.fsum(own * own) * math.fsum(scaled[c] * scaled[c])) for c in found[: 4 * k]]
                got = []
                for c, s in zip(found.tolist(), score, strict=False):
                    own_ids = ids[first[c] : min(first[c + 1], first[c] + k + 1)]
                    own_ids = ids[first[c] : first[c + 1]] if (own_ids == one).sum() > 1 else own_ids
                    got += [(-s, int(i)) for i in own_ids[own_ids != one][:k]]
                for s, i in sorted(got)[:k]:
                    out[0].append(one)
                    out[1].append(i)
                    out[2].append(-s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = each.join(graphs, ["dim", "shard"]).groupBy("dim", "shard", "block").applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
