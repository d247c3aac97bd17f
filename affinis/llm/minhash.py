"""MinHash near-duplicate groups.

Many universal hash minima make a signature for each set of word shingles; bands of the signature propose links, the full
sets confirm them, and alternating large-star and small-star steps join the confirmed links into components.

Hot groups: documents with equal sets are one representative (pre-aggregated before any band is dealt). A bucket first
links its members to one hub only, the one that lies in the largest buckets. What then lies in different components
still is found by differences from the hub: if x and y are similar, so are the sets of shingles in which each differs
from the hub they share, and those are small and mostly rare. A prefix of each difference, rarest first, is a list of
finer buckets (prefix filtering, exact); shingles whose buckets turn out large go to the end of the order, and the
prefixes of that hub's group are taken again. So no group is expanded into all its pairs, and no link between different
texts is lost that shares a band (at a similarity of 0.8: all but about one in ten million).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import Scratch, arrow_limits, flat_text, hash_runs, mix64, release, table64

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 40, 5
#: A pair whose signatures agree in a smaller share than this is far below the threshold: at 0.8 the share has a
#: standard deviation of 0.028, so this is over six of them away.
ESTIMATE_SLACK = 0.18
#: A shingle whose bucket would compare more than the square of this goes to the end of the order, in so many turns.
SMALL, TURNS = 24, 4
#: Pairs whose numbers of sets (two each, of 8 bytes) are sent to all executors, at most.
NAMED = 2_000_000
#: Tasks of a step that deals out small rows, at least; and shuffle partitions that such a task reads.
TASKS, TOGETHER = 24, 8

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Shingles:
    """Distinct shingle hashes of a batch of texts, text after text, sorted within each; counts by text."""

    hashes: np.ndarray
    counts: np.ndarray

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def shingle_sets(column, size: int) -> Shingles:
    """Sets of ``size``-word shingles (64-bit hashes) of an Arrow column of texts; A-Z count as a-z.

    Words are runs without white space (0x20, 0x09-0x0D). A text with fewer words has its whole sequence as one
    shingle; without words, or null, its set is empty.
    """
    raw, offsets = flat_text(column)
    n_docs = len(offsets) - 1
    if not len(raw):
        return Shingles(np.zeros(0, np.uint64), np.zeros(n_docs, np.int64))
    low = _UPPER[raw]
    word = ~_BLANK[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = word[offsets[:-1][offsets[:-1] < len(raw)]]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = hash_runs(low, start, end)
    of = np.searchsorted(offsets, start, side="right") - 1
    n_words = np.bincount(of, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    n_shingles = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    owner = np.repeat(np.arange(n_docs), n_shingles)
    at = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n_shingles)])[:-1], n_shingles) + first[owner]
    out = np.zeros(len(owner), np.uint64)
    length = np.minimum(n_words, size)[owner]
    for k in range(size):
        use = k < length
        out[use] = mix64(out[use] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[use] + k] + np.uint64(k + 1))
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return Shingles(out[new], np.bincount(owner[new], minlength=n_docs))


def minima(sets: Shingles, functions: int) -> np.ndarray:
    """For each non-empty set, the minimum of each universal hash a * x + b modulo 2**64 (a odd)."""
    some = sets.counts > 0
    starts = sets.starts()[:-1][some]
    out = np.empty((int(some.sum()), functions), np.uint64)
    if len(starts):
        a, b = table64(functions, 101) | np.uint64(1), table64(functions, 202)
        work = np.empty_like(sets.hashes)
        for k in range(functions):
            np.multiply(sets.hashes, a[k], out=work)
            np.add(work, b[k], out=work)
            out[:, k] = np.minimum.reduceat(work, starts)
    return out


def _prints(sets: Shingles) -> np.ndarray:
    """Two fingerprints of each set (0 for an empty one)."""
    some = sets.counts > 0
    starts = sets.starts()[:-1][some]
    prints = np.zeros((2, len(some)), np.uint64)
    if len(starts):
        prints[0, some] = np.add.reduceat(mix64(sets.hashes), starts)
        prints[1, some] = np.bitwise_xor.reduceat(mix64(sets.hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return prints


_SKETCH = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>, signature binary"


def sketch(docs: DataFrame, *, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, set size, two fingerprints of the set (equal for equal sets), band hashes and one byte a minimum."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            some = sets.counts > 0
            prints = _prints(sets)
            low = minima(sets, bands * rows)
            grouped = low.reshape(len(low), bands, rows)
            keys = np.repeat((np.arange(bands, dtype=np.uint64) + np.uint64(1))[None, :], len(low), axis=0)
            for r in range(rows):
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
            short = (mix64(low) >> np.uint64(56)).astype(np.uint8)
            band_offsets = np.zeros(len(some) + 1, np.int32)
            np.cumsum(np.where(some, bands, 0), out=band_offsets[1:])
            signs = iter(short)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sets.counts.astype(np.int64)),
                    pa.array(prints[0].view(np.int64)),
                    pa.array(prints[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(band_offsets), pa.array(keys.ravel().view(np.int64))),
                    pa.array([next(signs).tobytes() if s else b"" for s in some.tolist()], pa.binary()),
                ],
                names=[x.split()[0] for x in _SKETCH.split(", ")],
            )
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SKETCH)


def _few(rows: DataFrame) -> DataFrame:
    """rows in fewer tasks: most tables here are small beside the input, and a step would spend its time on starting
    tasks. Each reads several partitions of a shuffle, one after the other; their number still grows with the input."""
    return rows.coalesce(max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // TOGETHER))


def _near_signatures(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    a = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    b = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return _few(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")).mapInArrow(run, "a long, b long")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with the number of their set, which stands for its documents in bands, checks and components: a doc_id may
    have several sets."""
    return rows.withColumn("node", F.xxhash64("print_a", "print_b", "n_shingles"))


def _full_sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, members) of the sets in ``nodes``: all distinct shingles, sorted; reps has (node, rep)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(1), size)
            at, prints = found.starts(), _prints(found)
            numbers = [pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(found.counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array([found.hashes[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["rep", "print_a", "print_b", "n_shingles", "members"])
        release()

    wanted = reps.select("node", "rep").join(nodes, "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    members = _few(texts.join(wanted.select("rep").distinct(), "rep", "left_semi")).mapInArrow(sets, "rep long, print_a long, print_b long, n_shingles long, members binary")
    # a doc_id may repeat with other texts, or with the same: one row of each set that it represents
    return _numbered(members).join(wanted, ["node", "rep"], "left_semi").groupBy("node").agg(F.first("members").alias("members"))


def difference_prefix(hub: np.ndarray, own: np.ndarray, linked: bool, percent: int, salt: int, late: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The shingles of a set by which sets similar to it are found among those that share its hub: a probing prefix of
    D, how many of them are the indexed prefix too, and the size of D.

    D(x) holds the shingles in which x differs from the hub h. Let x and y be similar (share s = percent / 100) and in
    different components, and D(x) not the larger. They differ in at most c = (1 - s) / (1 + s) * (|x| + |y|) shingles,
    so D(x) and D(y) have t >= (|D(x)| + |D(y)| - c) / 2 in common, which is at least |D(x)| - c / 2. If x is linked to
    the hub, y is not, so |D(y)| > (1 - s) |y or h|, which gives t >= s * |D(x)| / 2 as well; if neither is linked,
    |D(x)| > (1 - s) |x| > c / 2. Two sets with t common members have one in common among the first |D| - t + 1 of each
    in any common order: here those that the hub lacks go first, which are the rare ones, and those in ``late`` last. So D(x) is indexed by its
    first c / 2 + 1 and D(y) probes with its first c + 1; c is at most (1 / s - 1) |x|.
    """
    fresh, lost = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
    both = np.concatenate([np.sort(mix64(x + np.uint64(salt))) for x in (fresh, lost)])
    if len(late):
        last = np.isin(both, late)
        both = np.concatenate([both[~last], both[last]])
    n, most = len(both), (100 - percent) * len(own) // percent
    probe = n - max(1, n - most) + 1
    least = max(1, n - most // 2, -(-percent * n // 200) if linked else 1)
    return both[:probe], min(n, n - least + 1), n


def _against_hubs(stars: DataFrame, sets: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """For each (a: hub, b, late): whether 100 * intersection >= percent * union on the full sets, and the finer keys.
    every: each of the sets is in one of the stars."""
    names = ["a", "b", "linked", "keys", "indexed", "d", "n"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, x, y, late in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                linked = _similar(x, y, percent)
                keys, indexed, d = difference_prefix(x, y, linked, percent, a & (2**64 - 1), np.array(late or [], np.int64).view(np.uint64))
                rows.append((linked, keys.view(np.int64), indexed, d, len(y)))
            types = [pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)
        release()

    return _beside(stars, sets, "late", every=every).mapInArrow(check, "a long, b long, linked boolean, keys array<long>, indexed long, d long, n long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of numbers of sets with 100 * intersection >= percent * union on the full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _beside(pairs, sets).mapInArrow(check, "a long, b long")


def _beside(pairs: DataFrame, sets: DataFrame, *more: str, every: bool = False) -> DataFrame:
    """Pairs (a written table) with both full sets. Only sets that are in a pair are dealt out, unless the pairs are too
    many to send their numbers to all executors, or every set is in one anyway."""
    if not every and pairs.count() <= NAMED:
        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = sets.join(F.broadcast(named), "node", "left_semi")
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    return _few(pairs.select("a", "b", *more).join(b, "b").join(a, "a").select("a", "b", "ma", "mb", *more))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _stars(members: DataFrame) -> DataFrame:
    """(a: hub, b) of every member of a bucket but its hub. members: (key, node, n: size of the bucket).

    The hub is the member with the largest buckets in all: what it holds is what most of its group hold, so that the
    others' differences from it are their own.
    """
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighted = members.join(weight, "node")
    hubs = weighted.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    return members.join(hubs, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def _finer(judged: DataFrame, found: DataFrame) -> DataFrame:
    """Members of finer buckets (key) of a hub's group (a), with the component c that each lies in so far; of buckets
    with two or more c in which an indexed member meets another. work: how many pairs a bucket would compare."""
    rows = judged.select("a", F.posexplode("keys").alias("pos", "key"), F.col("b").alias("node"), "indexed", "d", "n").withColumn("indexed", F.col("pos") < F.col("indexed"))
    rows = rows.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    open_keys = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), (F.count("*") * F.count_if("indexed")).alias("work")).filter("low < high and work > 0")
    return rows.join(open_keys.select("key", "work"), "key")


def _candidates(finer: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket in different components, an indexed member with one whose D is as large, that pass the
    tests of length and position."""
    x, y = (finer.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "c", "pos", "indexed", "d", "n")]) for k in "xy")
    size = (100 * F.least("n_x", "n_y")) >= percent * F.greatest("n_x", "n_y")
    most = F.floor((100 - percent) * (F.col("n_x") + F.col("n_y")) / (100 + percent))
    room = 1 + F.least(F.col("d_x") - F.col("pos_x") - 1, F.col("d_y") - F.col("pos_y") - 1)
    pairs = x.filter("indexed_x").join(y, "key").filter("c_x <> c_y and (d_x < d_y or d_x = d_y and (node_x < node_y or not indexed_y))")
    return pairs.filter(size & (2 * room >= F.col("d_x") + F.col("d_y") - most)).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of the links (a, b), by alternating large-star and small-star steps.

    component is the smallest node reachable. Each step is written to the shared folder; the loop ends when the links
    are stars: each node has one, to a node that has none.
    """

    def stars(links: DataFrame) -> bool:
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not _few(ends).agg(F.max(F.expr("up + least(up, down) > 1"))).first()[0]

    links, name = scratch.keep(_few(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), "links-0"), "links-0"
    for step in range(1, 200):
        if stars(links):
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _few(_few(large).union(_few(least.filter("m < u").select("u", F.col("m").alias("v")))).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = _few(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).union(_few(low.select("u", F.col("m").alias("v")))).distinct()
        links = scratch.keep(_few(small), f"links-{step}")
        scratch.drop(name)
        name = f"links-{step}"
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """Groups of documents linked by a similarity of shingle sets of at least ``percent`` / 100.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (doc_id = component_id), one row
    per row. A null or wordless text is linked with nothing. Rows with a null doc_id are linked with nothing and get a
    null component and kept = true. Rows that repeat a doc_id with the same words get the same answer, each; a doc_id
    with several texts is taken once for each and its sets are compared as they come. An empty table gives no rows;
    columns other than doc_id and text are not read. Ties go to the smaller doc_id.
    """
    scratch = Scratch(docs.sparkSession, "minhash")

    def keep(rows: DataFrame, name: str) -> DataFrame:
        return scratch.keep(_few(rows), name)

    all_rows = scratch.keep(sketch(docs, size=size, bands=bands, rows=rows), "sketch")
    light = keep(_numbered(all_rows.select("doc_id", "n_shingles", "print_a", "print_b")).drop("print_a", "print_b"), "light")
    reps = keep(light.filter("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")
    own = _numbered(all_rows.filter("n_shingles > 0")).join(reps.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"], "left_semi")
    rep_rows = keep(own.groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature")), "rep-sketch")
    scratch.drop("sketch")
    banded = rep_rows.select(F.explode("bands").alias("key"), "node")
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low < high")
    members = keep(banded.join(shared.select("key", "n"), "key"), "members")
    stars = keep(_stars(members), "stars-0")
    scratch.drop("members")
    signatures = keep(rep_rows.join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "signature"), "signatures")
    sets = keep(_full_sets(docs, reps, signatures.select("node"), size), "sets")
    scratch.drop("rep-sketch")
    least = percent / 100 - ESTIMATE_SLACK
    stars = stars.withColumn("late", F.lit(None).cast("array<long>"))
    judged = keep(_against_hubs(stars, sets, percent, every=True), "judged-0")
    links = judged.filter("linked").select("a", "b")
    found = keep(components(links, scratch), "components-0")
    for turn in range(TURNS):
        finer = keep(_finer(judged, found), f"finer-{turn}")
        crowded = finer.filter(F.col("work") > small * small).groupBy("a").agg(F.collect_set("key").alias("crowd"))
        last = turn == TURNS - 1  # then every bucket that is open still compares its members
        few = finer if last else finer.join(crowded.select("a"), "a", "left_anti")
        near = keep(_near_signatures(_candidates(few, percent), signatures, least), f"near-{turn}")
        links = links.union(keep(_confirmed(near, sets, percent), f"links-of-{turn}"))
        scratch.drop(f"near-{turn}")
        if last or crowded.isEmpty():
            break
        late = F.concat(F.coalesce("late", F.array().cast("array<long>")), "crowd")
        stars = keep(stars.join(crowded, "a").select("a", "b", late.alias("late")), f"stars-{turn + 1}")
        judged = keep(_against_hubs(stars, sets, percent), f"judged-{turn + 1}")
        scratch.drop(f"finer-{turn}", f"stars-{turn}")
    found = keep(components(links, scratch), "components-all")
    classes = reps.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    classes = classes.join(classes.groupBy("c").agg(F.min("rep").alias("component_id")), "c").select("node", "component_id")
    out = light.join(classes, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    scratch.drop("signatures", "sets")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
