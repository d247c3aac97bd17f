"""Cosines of every two vectors of a label, worked out as matrix products of tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block at most, about; cosines that a task holds at once.
_BLOCK, _AT_ONCE = 8192, 500_000
#: Single-precision products that a task holds, pairs whose cosines are worked out at once; vectors of a label that stay one block.
_SCREENED, _PICKED, _FEW = 4_000_000, 1 << 15, 1024


class _Side:
    """Vectors of one block: ids and unit vectors by length; others (null or with null parts) have no cosine."""

    def __init__(self, table: pa.Table) -> None:
        rows = table["embedding"].combine_chunks()
        ids = table["vec_id"].to_numpy()
        flat = rows.flatten()
        length = np.nan_to_num(rows.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        start = np.cumsum(length) - length
        holes = np.add.reduceat(np.append(flat.is_null().to_numpy(zero_copy_only=False), 0), start) * (length > 0) if len(ids) else start
        values, form = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.where(rows.is_valid().to_numpy(zero_copy_only=False) & (holes == 0), length, -1)
        order = np.argsort(ids, kind="stable")
        self.ids, self.form, start = ids[order], form[order], start[order]
        self.parts = {}
        for n in np.unique(self.form[self.form >= 0]).tolist():
            at = np.flatnonzero(self.form == n)
            found = values[start[at][:, None] + np.arange(n)]
            self.parts[n] = (at, found, np.sqrt((found * found).sum(axis=1)))
        #: Unit vectors in single precision, if all have one length and a direction.
        self.units = None
        if len(self.parts) == 1 and (self.form >= 0).all():
            ((_, found, length),) = self.parts.values()
            if found.shape[1] and np.isfinite(length).all() and (length > 1e-100).all():
                self.units = (found / length[:, None]).astype(np.float32)


def _cosines(new: _Side, old: _Side, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Of some rows of new against all of old, and where there is none."""
    n = len(new.ids[rows])
    if len(new.parts) == len(old.parts) == 1 and new.parts.keys() == old.parts.keys() and (new.form >= 0).all() and (old.form >= 0).all():
        (_, x, nx), (_, y, ny) = *new.parts.values(), *old.parts.values()
        return x[rows] @ y.T / (nx[rows][:, None] * ny), np.zeros((1, 1), bool)
    out, none = np.zeros((n, len(old.ids))), np.ones((n, len(old.ids)), bool)
    for k in new.parts.keys() & old.parts.keys():
        (at, x, nx), (to, y, ny) = new.parts[k], old.parts[k]
        part = (at >= rows.start) & (at < rows.stop)
        where = np.ix_(at[part] - rows.start, to)
        out[where], none[where] = x[part] @ y.T / (nx[part][:, None] * ny), False
    return out, none


def _screened(new: _Side, old: _Side, rows: slice, inside: bool, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some rows of new: places in old and double cosines of those that may be the row's greatest, or reach least.
    Products in single precision leave out only what is surely below: they are off by less than ``off``."""
    off = np.float32((new.units.shape[1] + 16) * 2.0**-23)
    with np.errstate(all="ignore"):
        near = new.units[rows] @ old.units.T
    if inside:
        near[old.ids >= new.ids[rows][:, None]] = -np.inf
    top = near.max(axis=1, initial=-np.inf) - 2 * off if least is None else np.full(len(near), np.float32(least) - off)
    i, j = np.nonzero((near >= top[:, None]) & (near > -np.inf) if inside else near >= top[:, None])
    (_, x, nx), (_, y, ny) = *new.parts.values(), *old.parts.values()
    a = i + rows.start
    sims = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + _PICKED]], y[j[k : k + _PICKED]]) for k in range(0, len(a), _PICKED)] or [np.zeros(0)])
    return i, j, sims / (nx[a] * ny[j])


def _tiles(best: bool, least: float | None, low_too: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def screened(label: int, new: _Side, old: _Side) -> Iterator[pa.RecordBatch]:
        step = max(1, _SCREENED // max(1, len(old.ids)))
        for k in range(0, len(new.ids), step):
            rows = slice(k, min(k + step, len(new.ids)))
            i, j, sims = _screened(new, old, rows, new is old, None if best else least)
            if best:
                first = np.flatnonzero(np.diff(i, prepend=-1))
                high = np.maximum.reduceat(sims, first) if len(first) else sims
                columns = [np.full(len(first), label, np.int32), new.ids[rows][i[first]], high, high]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(first), pa.float64())], _BEST)
                continue
            good = ~(sims < least)
            columns = [np.full(int(good.sum()), label, np.int32), new.ids[rows][i[good]], old.ids[j[good]], sims[good]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["label", "new_id", "old_id", "sim"])

    def directed(label: int, new: _Side, old: _Side) -> Iterator[pa.RecordBatch]:
        if (best and not low_too or least is not None) and new.units is not None and old.units is not None and new.units.shape[1] == old.units.shape[1]:
            yield from screened(label, new, old)
            return
        step = max(1, _AT_ONCE // max(1, len(old.ids)))
        for k in range(0, len(new.ids), step):
            rows = slice(k, min(k + step, len(new.ids)))
            ids = new.ids[rows]
            with np.errstate(divide="ignore", invalid="ignore"):
                sims, none = _cosines(new, old, rows)
            none = np.broadcast_to(none, sims.shape)
            counts = old.ids < ids[:, None]
            if best:
                some = counts & ~none
                high = np.where(some, sims, -np.inf).max(axis=1, initial=-np.inf)  # NaN is above all
                low = np.fmin.reduce(np.where(some, sims, np.inf), axis=1, initial=np.inf)
                low = np.where(np.isinf(low) & np.isnan(high), np.nan, low)
                kept, empty = counts.any(axis=1), ~some.any(axis=1)
                real = np.fmax.reduce(np.where(some, sims, -np.inf), axis=1, initial=-np.inf)
                real = np.where(np.isinf(real) & np.isnan(high), np.nan, real)
                columns = [np.full(int(kept.sum()), label, np.int32), ids[kept]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(x[kept], mask=empty[kept]) for x in (high, real, low))], _BEST)
                continue
            if least is not None:
                counts &= ~none & ~(sims < least)
            i, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), label, np.int32)), pa.array(ids[i]), pa.array(old.ids[j]), pa.array(sims[i, j], mask=none[i, j])], ["label", "new_id", "old_id", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        label, i, j, own = (table[c].to_numpy() for c in ("label", "i", "j", "own"))
        order = np.lexsort((own, j, i, label))
        keys = np.stack([label, i, j])[:, order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(keys, axis=1) != 0).any(axis=0)]))
        for s, e in zip(first, np.append(first[1:], len(order)), strict=True):
            at, (k, one, two) = order[s:e], keys[:, s].tolist()
            sides = [_Side(table.take(pa.array(at[own[at] == x]))) for x in sorted({one, two})]
            yield from directed(k, sides[-1], sides[0])  # blocks are in the order of ids

    return run


_BEST = ["label", "new_id", "high", "real", "low"]


def _dealt(embeddings: DataFrame, kind: str, best: bool, least: float | None, low_too: bool = True) -> DataFrame:
    """Blocks of a label by ranges of their ids, every two of them in a tile: the larger ids against the smaller."""
    rows = embeddings.filter("label IS NOT NULL AND vec_id IS NOT NULL").select(F.col("label").cast("int").alias("label"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    steps = rows.groupBy("label").agg(F.count("*").alias("n"), F.percentile_approx("vec_id", [k / 256 for k in range(1, 256)], 10_000).alias("at")).filter(F.col("n") > _FEW).collect()
    cuts, most = [], 1
    for r in steps:
        blocks = min(256, max(3, -(-r.n // _BLOCK)))
        own = sorted({r.at[min(254, 256 * k // blocks - 1)] for k in range(1, blocks)})
        cuts += [F.lit(r.label), F.array(*[F.lit(c).cast("long") for c in own])]
        most = max(most, len(own) + 1)
    none = F.array().cast("array<long>")
    rows = rows.withColumn("cuts", F.coalesce(F.create_map(*cuts)[F.col("label")], none) if cuts else none)
    own = F.size(F.filter("cuts", lambda c: c < F.col("vec_id")))
    tiles = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.size("cuts"))))
    tiles = tiles.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "embedding")
    partitions = max(int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")), most * most)
    return tiles.repartition(partitions, "label", "i", "j").mapInArrow(_tiles(best, least, low_too), kind)


def cosines(embeddings: DataFrame, least: float | None = None) -> DataFrame:
    """label, new_id, old_id, sim of every two vectors (vec_id, embedding, label) of a label, new_id the larger id; least
    leaves smaller cosines out. Null or null-holding vectors and different lengths give null, zero vectors NaN."""
    return _dealt(embeddings, "label int, new_id long, old_id long, sim double", False, least)


def extremes(embeddings: DataFrame, low: bool = True) -> DataFrame:
    """label, new_id, high, real, low: the greatest and least cosine of each vector with those of smaller ids of its label;
    NaN is above all in high, and in real only where there is nothing else. Without low, which stays null, it is faster."""
    found = _dealt(embeddings, "label int, new_id long, high double, real double, low double", True, None, low)
    return found.groupBy("label", "new_id").agg(F.max("high").alias("high"), (-F.min(-F.col("real"))).alias("real"), F.min("low").alias("low"))
