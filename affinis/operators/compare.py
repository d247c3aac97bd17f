"""Comparison of submissions by greedy string tiling, as one DataFrame operator, and what rests on its tiles.

Blocks of submissions meet in tasks, where pairs come from equal runs of the effective minimum match, so no pair with a
tile is lost and no pair without one is compared. Submissions with the same tokens are one class: pairs are between class representatives, membership is
returned beside them.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.operators.blocktiles import tiled
from affinis.operators.tiling import Tile, merge_tiles

#: Token that ends each file; it matches nothing.
FILE_END = "<EOF>"
#: Values of the frequency strategies and weightings are in frequency.py; metrics of a comparison are METRICS.
METRICS = {
    "AVG": lambda r: _ratio(r["matched_a"] + r["matched_b"], r["div_a"] + r["div_b"]),
    "MAX": lambda r: F.greatest(_ratio(r["matched_a"], r["div_a"]), _ratio(r["matched_b"], r["div_b"])),
    "MIN": lambda r: F.least(_ratio(r["matched_a"], r["div_a"]), _ratio(r["matched_b"], r["div_b"])),
    "FIRST": lambda r: _ratio(r["matched_a"], r["div_a"]),
    "SECOND": lambda r: _ratio(r["matched_b"], r["div_b"]),
    "INTERSECTION": lambda r: r["matched_a"].cast("double"),
    "LONGEST_MATCH": lambda r: r["longest"].cast("double"),
    "MAXIMUM_LENGTH": lambda r: F.greatest(r["n_a"], r["n_b"]).cast("double"),
}


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


@dataclass
class Options:
    min_match: int = 9
    merging: bool = False
    neighbour: int = 2
    max_gap: int = 6
    required_merges: int = 6

    @property
    def effective(self) -> int:
        """The shortest run that tiling looks for."""
        return max(1, min(self.neighbour, self.min_match)) if self.merging else max(1, self.min_match)


def common_runs(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, start in a, start in b) of every maximal common run of at least ``least`` tokens; tokens below 0 match
    nothing. Windows meet by their hashes, tokens decide."""
    if len(a) < least or len(b) < least:
        return []
    weights = (np.arange(1, least + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    hashes = []
    for x in (a, b):
        windows = np.lib.stride_tricks.sliding_window_view(x, least)
        usable = np.flatnonzero((windows >= 0).all(axis=1))
        hashes.append((usable, (windows[usable].astype(np.uint64) * weights).sum(axis=1)))
    (at_a, ha), (at_b, hb) = hashes
    order = np.argsort(hb, kind="stable")
    hb, at_b = hb[order], at_b[order]
    low, high = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    count = high - low
    i = np.repeat(at_a, count)
    j = at_b[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    keep = (np.lib.stride_tricks.sliding_window_view(a, least)[i] == np.lib.stride_tricks.sliding_window_view(b, least)[j]).all(axis=1)
    i, j = i[keep], j[keep]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(i) != 1)])) if len(i) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(i)))
    return [(int(n) + least - 1, int(i[f]), int(j[f])) for f, n in zip(first, sizes, strict=True)]


def tiles(a, b, least: int, *, free_a=None, free_b=None) -> list[Tile]:
    """Greedy tiling: the longest common run of free tokens first (by start in a, then in b, among equals), again and
    again. A run that lost tokens to an earlier tile falls into what is left of it, so runs are looked up once."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    free_a = (a >= 0) if free_a is None else np.array(free_a, bool) & (a >= 0)
    free_b = (b >= 0) if free_b is None else np.array(free_b, bool) & (b >= 0)
    queue = [(-n, i, j) for n, i, j in common_runs(np.where(free_a, a, -1), np.where(free_b, b, -1), max(1, least))]
    heapq.heapify(queue)
    out: list[Tile] = []
    while queue:
        n, i, j = heapq.heappop(queue)
        free = free_a[i : i - n] & free_b[j : j - n]
        if free.all():
            out.append((i, j, -n, -n))
            free_a[i : i - n] = False
            free_b[j : j - n] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(queue, (s - e, i + s, j + s))
    return out


def compare_tokens(a, b, options: Options, free_a=None, free_b=None) -> list[Tile]:
    """Tiles of a pair; with merging, neighbours are joined over gaps and short ones dropped. File ends are tokens below 0."""
    found = tiles(a, b, options.effective, free_a=free_a, free_b=free_b)
    if options.merging:
        ends = [np.flatnonzero(np.asarray(x) < 0).tolist() for x in (a, b)]
        found = merge_tiles(found, max_gap=options.max_gap, least=options.min_match, required=options.required_merges, ends_a=ends[0], ends_b=ends[1])
    return [t for t in found if min(t[2], t[3]) >= options.min_match]


@dataclass
class Comparison:
    """pairs: one row a pair of classes that share a tile. members: (name, representative) of every submission.
    base: tiles of each representative with the base code."""

    pairs: DataFrame
    members: DataFrame
    base: DataFrame | None = None
    options: Options = field(default_factory=Options)
    #: a, b, div_a, div_b, matches (length, frequency: how many matches of all have these tokens), top (the greatest frequency).
    frequencies: Callable[[], DataFrame] | None = None

    def metric(self, name: str) -> DataFrame:
        """a, b and one of METRICS, most similar first; see expanded() for copies."""
        return self.pairs.select("a", "b", METRICS[name](_Row()).alias("similarity")).orderBy(F.desc("similarity"), "a", "b")

    def expanded(self, scored: DataFrame) -> DataFrame:
        """a, b, similarity of submissions instead of classes: each copy beside its representative (1.0), and each pair of
        classes once for every copy of the one and the representative of the other. Grows with copies, not their pairs."""
        copies = self.members.filter("name <> representative")
        own = copies.select(F.col("representative").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity"))
        left = scored.join(copies.withColumnRenamed("representative", "a"), "a").select(F.col("name").alias("a"), "b", "similarity")
        right = scored.join(copies.withColumnRenamed("representative", "b"), "b").select("a", F.col("name").alias("b"), "similarity")
        return scored.select("a", "b", "similarity").unionByName(own).unionByName(left).unionByName(right)


class _Row:
    def __getitem__(self, name: str) -> Column:
        return F.col(name)


TILES = "array<struct<start_a:int,start_b:int,length_a:int,length_b:int>>"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Submissions of a block together, compressed: each travels to every other block."""
    held: dict[int, list[tuple]] = {}
    size = 0

    def blobs() -> pd.DataFrame:
        out = []
        for own, rows in held.items():
            known, codes = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
            codes = codes.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
            raw = pickle.dumps(([r[:3] for r in rows], np.array([len(r[3]) for r in rows]), known, codes))
            out.append((own, len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)))
        return pd.DataFrame(out, columns=["own", "blob"])

    for batch in batches:
        for r in batch.itertuples(index=False):
            held.setdefault(r.own, []).append((r.n, r.name, r.is_new, np.asarray(r.t, np.int64)))
            size += len(r.t)
            if size > _TOKENS:
                yield blobs()
                held, size = {}, 0
    if held:
        yield blobs()


def _unpacked(blob: bytes) -> list[tuple]:
    """(n, name, is_new, tokens) of each submission."""
    rows, lengths, known, codes = pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))
    return [(*r, t) for r, t in zip(rows, np.split(known[codes], np.cumsum(lengths)[:-1]), strict=True)]


def _compared(sides: list[list[tuple]], options: Options) -> Iterator[tuple]:
    """Tiles of all pairs of two blocks, or of one: a, b (places among all), i, j, lengths of both, where pairs begin."""
    every = [r for side in sides for r in side]
    base = len(sides[0]) if len(sides) == 2 else 0
    rank = np.empty(len(every), np.int64)
    rank[sorted(range(len(every)), key=lambda k: every[k][:2])] = np.arange(len(every))
    new = np.array([r[2] for r in every], bool)
    tokens = [[r[3] for r in side] for side in sides]
    for t in tiled(tokens[0], tokens[1] if base else None, options.effective, lambda x, y: rank[x] > rank[y + base]):
        x, y, i, j, n, m = t.x, t.y + base, t.i, t.j, t.n, t.n
        swap = rank[x] > rank[y]
        a, b = np.where(swap, y, x), np.where(swap, x, y)
        if not new.all():
            a, b, i, j, n, m = (v[new[a] | new[b]] for v in (a, b, i, j, n, m))
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        if options.merging:
            rows, last = [], np.append(first[1:], len(a))
            for s, e in zip(first.tolist(), last.tolist(), strict=True):
                ends = [np.flatnonzero(every[k][3] < 0).tolist() for k in (a[s], b[s])]
                own = [tuple(v) for v in zip(*(c[s:e].tolist() for c in (i, j, n, m)), strict=True)]
                own = merge_tiles(own, max_gap=options.max_gap, least=options.min_match, required=options.required_merges, ends_a=ends[0], ends_b=ends[1])
                rows += [(a[s], b[s], *v) for v in own]
            a, b, i, j, n, m = np.array(rows, np.int64).reshape(-1, 6).T
            first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        yield a, b, i, j, n, m, first


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(i, j), the submissions of both blocks (or of one), and blobs of no block."""
    groups: dict[tuple[int, int], dict[int, list[bytes]]] = {}
    for batch in batches:
        for i, j, own, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            groups.setdefault((i, j), {}).setdefault(own, []).append(blob)
    for i, j in sorted(groups):
        blobs = groups.pop((i, j))
        beside = blobs.pop(_BESIDE, [])
        if len(blobs) == len({i, j}):
            yield (i, j), [[r for blob in blobs[k] for r in _unpacked(blob)] for k in sorted(blobs)], beside


def _tiled(options: Options):
    """Compares the submissions of two blocks, or of one, all pairs at once: their tokens are there, pairs never travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sides, _ in _block_pairs(batches):
            every = [r for side in sides for r in side]
            size, names = np.array([r[0] for r in every]), pa.array([r[1] for r in every], pa.string())
            for a, b, i, j, n, m, first in _compared(sides, options):
                for k in range(0, len(first), _ROWS):
                    part = first[k : k + _ROWS]
                    cut = slice(part[0], first[k + _ROWS] if k + _ROWS < len(first) else len(a))
                    at, lengths = part - part[0], [v[cut] for v in (n, m)]
                    inner = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (i[cut], j[cut], *lengths)], ["start_a", "start_b", "length_a", "length_b"])
                    listed = pa.ListArray.from_arrays(pa.array(np.append(at, len(lengths[0])), pa.int32()), inner)
                    sums = [*(np.add.reduceat(v, at) for v in lengths), np.maximum.reduceat(np.minimum(*lengths), at)]
                    ends = a[part], b[part]
                    yield pa.RecordBatch.from_arrays([*(names.take(pa.array(v)) for v in ends), *(pa.array(size[v], pa.int64()) for v in ends), *(pa.array(v, pa.int64()) for v in sums), listed], _COLUMNS)

    return run


def _texts_of(every: list[tuple]):
    """Two numbers of 64 bits of the tokens of a match, from sums of tokens times powers, and its length."""
    starts = np.cumsum([0, *(len(r[3]) for r in every)])
    t = np.concatenate([r[3] for r in every]).view(np.uint64)
    powers = []
    for odd in _ODD:
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(t), x % (1 << 64), np.uint64))) for x in (odd, pow(odd, -1, 1 << 64)))
        powers.append((np.append(np.uint64(0), np.cumsum(t * up[:-1])), down))

    def of(a: np.ndarray, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = starts[a] + i
        return np.stack([*((total[at + n] - total[at]) * down[at] for total, down in powers), n.astype(np.uint64)], axis=1)

    return of


def _distinct(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order and the sums of n of each."""
    order = np.lexsort(keys.T[::-1])
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[first], np.add.reduceat(n, first)


def _matches(options: Options, buckets: int):
    """How often the tasks of two blocks have each match, by buckets of matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), sides, _ in _block_pairs(batches):
            every = [r for side in sides for r in side]
            of, held = _texts_of(every), []
            for a, _, at, _, n, _, first in _compared(sides, options):
                if len(first):
                    held.append(_distinct(of(a, at, n), np.ones(len(a), np.int64)))
            if not held:
                continue
            keys, n = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            where = (keys[:, 0] >> np.uint64(40)) % np.uint64(buckets)
            for k in np.unique(where):
                mine = where == k
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([keys[mine].tobytes()]), pa.array([n[mine].tobytes()])], ["bucket", "i", "j", "keys", "n"])

    return run


def _met_matches(blocks: int):
    """For each two blocks: how often all have the matches of theirs, and the most that any match of the bucket comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, i, j, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault(bucket, []).append(((i, j), np.frombuffer(keys, np.uint64).reshape(-1, 3), np.frombuffer(n, np.int64)))
        for bucket in sorted(rows):
            mine = rows.pop(bucket)
            keys, n = (np.concatenate([r[k] for r in mine]) for k in (1, 2))
            order = np.lexsort(keys.T[::-1])
            new = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1))
            total = np.empty(len(n), np.int64)
            total[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            top, at, to = int(total.max()).to_bytes(8, "little"), 0, {(i, j): b"" for i in range(blocks) for j in range(i, blocks)}
            for pair, own, _ in mine:
                to[pair] += np.concatenate([own, total[at : at + len(own), None].view(np.uint64)], axis=1).tobytes()
                at += len(own)
            for (i, j), blob in to.items():
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (i, j, _BESIDE)] + [pa.array([top + blob])], ["i", "j", "own", "blob"])

    return run


def _with_frequencies(options: Options):
    """Pairs with the lengths and frequencies of their matches, tiled once more, so that they don't travel either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sides, beside in _block_pairs(batches):
            every = [r for side in sides for r in side]
            size, names, of = np.array([r[0] for r in every]), pa.array([r[1] for r in every], pa.string()), _texts_of(every)
            top = max((int.from_bytes(blob[:8], "little") for blob in beside), default=0)
            known = np.concatenate([np.zeros((0, 4), np.uint64), *(np.frombuffer(blob, np.uint64, offset=8).reshape(-1, 4) for blob in beside)])
            for a, b, i, _, n, _, first in _compared(sides, options):
                if not len(first):
                    continue
                keys = of(a, i, n)
                both = np.concatenate([known[:, :3], keys])
                order = np.lexsort(both.T[::-1])  # stable: what is known of a match is before its places
                new = np.append(True, (both[order[1:]] != both[order[:-1]]).any(axis=1))
                which = np.empty(len(both), np.int64)
                which[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                count = known[which[len(known) :], 3].astype(np.float64)
                for k in range(0, len(first), _ROWS):
                    part = first[k : k + _ROWS]
                    cut = slice(part[0], first[k + _ROWS] if k + _ROWS < len(first) else len(a))
                    inner = pa.StructArray.from_arrays([pa.array(n[cut], pa.int32()), pa.array(count[cut])], ["length", "frequency"])
                    listed = pa.ListArray.from_arrays(pa.array(np.append(part - part[0], cut.stop - cut.start), pa.int32()), inner)
                    ends = a[part], b[part]
                    yield pa.RecordBatch.from_arrays([*(names.take(pa.array(v)) for v in ends), *(pa.array(size[v], pa.int64()) for v in ends), listed, pa.array(np.full(len(part), float(top)))], ["a", "b", "div_a", "div_b", "matches", "top"])

    return run


_COLUMNS = ["a", "b", "div_a", "div_b", "matched_a", "matched_b", "longest", "tiles"]
#: Submissions of a block, about: every two blocks meet in a task. Tokens that are packed at once; pairs in a batch.
_BLOCK, _TOKENS, _ROWS = 4096, 1 << 22, 20_000
#: The block of what goes with two blocks; odd numbers whose powers tell matches apart.
_BESIDE, _ODD = -1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def compare(submissions: DataFrame, options: Options | None = None, *, base_code: DataFrame | None = None) -> Comparison:
    """Compares submissions (name, tokens array<string>, optionally is_new) with each other.

    Tokens equal to FILE_END match nothing and count in no divisor. base_code has tokens too: what a submission shares
    with it takes no part and leaves the divisor. With is_new, pairs of two old submissions are left out. The side with
    fewer tokens (then the smaller name) is a. Submissions with null or too few tokens are in members only; names should
    be unique; an empty table gives empty results; other columns are not read.
    """
    options = options or Options()
    least = options.effective
    new = F.col("is_new") if "is_new" in submissions.columns else F.lit(True)
    rows = submissions.select("name", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), new.alias("is_new"))
    coded = rows.select("name", "is_new", F.transform("tokens", lambda t: F.when(t == FILE_END, F.lit(-1).cast("long")).otherwise(F.xxhash64(t).bitwiseAND(F.lit((1 << 62) - 1)))).alias("t"))
    keyed = coded.withColumn("k", F.sha2(F.to_json("t"), 256))
    firsts = keyed.groupBy("k").agg(F.min("name").alias("representative"), F.max("is_new").alias("any_new"))
    placed = keyed.join(firsts, "k")
    members = placed.select("name", "representative")
    own = placed.filter("name = representative").select("name", F.col("any_new").alias("is_new"), "t", F.size(F.filter("t", lambda x: x >= 0)).cast("long").alias("n"))
    base = None
    if base_code is not None:
        framework = base_code.select(F.flatten(F.collect_list(F.concat(F.transform("tokens", lambda t: F.when(t == FILE_END, F.lit(-1).cast("long")).otherwise(F.xxhash64(t).bitwiseAND(F.lit((1 << 62) - 1)))), F.array(F.lit(-1).cast("long"))))).alias("f"))
        marked = own.crossJoin(F.broadcast(framework))

        def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples():
                    found = tiles(r.t, [] if r.f is None else r.f, options.min_match)
                    free = np.ones(len(r.t), bool)
                    for i, _, n, _ in found:
                        free[i : i + n] = False
                    out.append((r.name, r.is_new, np.where(free, np.asarray(r.t, np.int64), -2), r.n - int((~free).sum()), [t for t in found]))
                yield pd.DataFrame(out, columns=["name", "is_new", "t", "n", "base"])

        own = marked.mapInPandas(mark, f"name string, is_new boolean, t array<long>, n long, base {TILES}")
        base = own.select("name", F.col("base").alias("tiles"))
        own = own.drop("base")
    partitions = int(submissions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(3, round((2 * partitions) ** 0.5), -(-submissions.count() // _BLOCK))
    mine = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")
    packed = own.filter(F.size("t") >= least).select(mine.alias("own"), "name", "is_new", "n", "t").repartition(blocks, "own").mapInPandas(_packed, "own int, blob binary")
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "blob")
    tasks = max(partitions, blocks * blocks)
    found = dealt.repartition(tasks, "i", "j").mapInArrow(_tiled(options), f"a string, b string, div_a long, div_b long, matched_a long, matched_b long, longest long, tiles {TILES}")
    found = found.withColumns({"n_a": F.col("div_a"), "n_b": F.col("div_b")})

    def frequencies() -> DataFrame:
        each = dealt.repartition(tasks, "i", "j").mapInArrow(_matches(options, partitions), "bucket int, i int, j int, keys binary, n binary")
        counted = each.repartition(partitions, "bucket").mapInArrow(_met_matches(blocks), "i int, j int, own int, blob binary")
        kinds = "a string, b string, div_a long, div_b long, matches array<struct<length:int,frequency:double>>, top double"
        return dealt.unionByName(counted).repartition(tasks, "i", "j").mapInArrow(_with_frequencies(options), kinds)

    return Comparison(found, members, base, options, frequencies)
