"""Pairs of different texts that share a run of tokens, with how many runs they share.

No row is made for a text's run or for a pair and a run. Runs travel as packed numbers, once; those that the same texts
share become one list of texts with a weight; lists are dealt to blocks of texts, and a block counts the pairs whose
smaller text lies in it and hands them out finished, so that pairs are never shuffled. Of large tables, runs travel in
rounds by their hash, one round after the other, and only the lists of a round are kept: so the packed runs of a part
are on disk at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.shared import kept

#: Rows of packed numbers: runs of a bucket, sizes of texts, tags of texts, copies of texts.
_RUNS, _SIZES, _TAGS, _COPIES = 0, 1, 2, 3
#: Pairs by lists that a block holds at once; texts in a row of sizes or tags; tokens packed at once (a text may have more).
_AT_ONCE, _IN_ROW, _TOKENS = 1_000_000, 4096, 1 << 20
#: Bytes of documents from which on runs travel in rounds, and how many rounds; bytes of lists for blocks that a task holds.
_LARGE, _ROUNDS, _HELD = 32 << 20, 2, 8 << 20
_WEIGHTS = np.random.default_rng(9).integers(0, 1 << 63, (2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (_mixed(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _encoded(ids: np.ndarray) -> bytes:
    """Ascending ids: the first, then steps in as many bytes as the largest needs."""
    steps = np.diff(ids)
    width = next(k for k in (1, 2, 4, 8) if k == 8 or steps.max() < 1 << 8 * k)
    return bytes([width]) + ids[:1].tobytes() + steps.astype(f"u{width}").tobytes()


def _decoded(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, f"u{blob[0]}", offset=9).astype(np.int64)
    return np.concatenate([np.frombuffer(blob, np.int64, 1, offset=1), steps]).cumsum()


def _texts_row(ids: np.ndarray, of: np.ndarray) -> bytes:
    """Ids in order and a small number of each, compressed."""
    order = np.argsort(ids, kind="stable")
    ids, of = ids[order], of[order].astype(np.uint32)
    return len(ids).to_bytes(8, "little") + pa.compress(np.diff(ids, prepend=0).tobytes() + of.tobytes(), "zstd", asbytes=True)


def _of_texts_row(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], 12 * n, "zstd", asbytes=True)
    return np.frombuffer(raw, np.int64, n).cumsum(), np.frombuffer(raw, np.uint32, offset=8 * n)


def _lists_row(blobs: list[bytes], weights: list[int]) -> bytes:
    """Lists of texts and their weights, compressed together."""
    lengths = np.array([len(b) for b in blobs], np.int64)
    raw = np.stack([lengths, np.array(weights, np.int64)]).tobytes() + b"".join(blobs)
    return np.array([len(blobs), len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _of_lists_row(row: bytes) -> list[tuple[bytes, int]]:
    n, size = np.frombuffer(row, np.int64, 2).tolist()
    raw = pa.decompress(row[16:], size, "zstd", asbytes=True)
    lengths, weights = np.frombuffer(raw, np.int64, 2 * n).reshape(2, n)
    ends = 16 * n + np.cumsum(lengths)
    return [(raw[e - k : e], w) for e, k, w in zip(ends.tolist(), lengths.tolist(), weights.tolist(), strict=True)]


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The texts of a batch by about ``_TOKENS`` tokens."""
    at = batch.column(2).offsets.to_numpy()
    k = 0
    while k < batch.num_rows:
        e = max(k + 1, int(np.searchsorted(at, at[k] + _TOKENS, "right")) - 1)
        yield batch.slice(k, e - k)
        k = e


def _pack(gram: int, buckets: int, part: int = 0, parts: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, digest, t) -> rows of a bucket: texts, how many runs of each, 64 and 16 bits of each run; and sizes.

    Of ``parts`` rounds, one sends the runs whose hash falls to it; sizes (of all runs) go with the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in _sliced(whole)):
            ids, tokens = batch.column(0).to_numpy(), batch.column(2)
            digests = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, 2)
            at, t = tokens.offsets.to_numpy() - tokens.offsets[0].as_py(), tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = max(0, len(t) - gram + 1)
            one, two = (np.zeros(n, np.uint64) for _ in _WEIGHTS)
            for x, w in zip((one, two), _WEIGHTS, strict=True):
                for k in range(gram):
                    x += t[k : k + n] * w[k]
            one = _mixed(one)
            own = np.repeat(np.arange(len(ids)), np.diff(at))[:n]
            runs = np.arange(n) <= at[own + 1] - gram  # inside one text
            if part:  # the first round needs all of them, for the sizes
                runs &= one % np.uint64(parts) == part
            runs = np.flatnonzero(runs)
            runs = runs[np.lexsort((one[runs], own[runs]))]
            runs = runs[(np.diff(own[runs], prepend=-1) != 0) | (np.diff(one[runs], prepend=np.uint64(0)) != 0)]
            sizes = np.bincount(own[runs], minlength=len(ids))
            if parts > 1 and not part:
                runs = runs[one[runs] % np.uint64(parts) == 0]
            one, two, own = one[runs], (two[runs] >> np.uint64(48)).astype(np.uint16), own[runs]
            rows: list[tuple] = []
            where = ((one >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[k] : cuts[k + 1]]
                first = np.flatnonzero(np.diff(own[mine], prepend=-1))
                rows.append((k, _RUNS, ids[own[mine[first]]].tobytes(), np.diff(np.append(first, len(mine))).astype(np.uint32).tobytes(), one[mine].tobytes(), two[mine].tobytes()))
            large = np.flatnonzero(sizes) if not part else np.zeros(0, np.int64)
            where = (digests[large, 0] % np.uint64(buckets)).astype(np.int64)
            for k in np.unique(where).tolist():
                mine = large[where == k]
                rows.append((k, _SIZES, ids[mine].tobytes(), sizes[mine].astype(np.uint32).tobytes(), digests[mine].tobytes(), b""))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[k : k + 64], strict=True), [pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "kind", "ids", "counts", "one", "two"])

    return run


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of texts that share runs, with how many runs of this bucket; sizes of one text of each digest, and its copies."""
    parts: dict[int, list[list[bytes]]] = {_RUNS: [], _SIZES: []}
    for batch in batches:
        for kind, *x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            parts[kind].append(x)

    def joined(kind: int, column: int, form: type) -> np.ndarray:
        return np.frombuffer(b"".join(x[column] for x in parts[kind]), form)

    names, kinds = ["kind", "blob", "weight"], [pa.int32(), pa.binary(), pa.int64()]
    ids, n, digests = joined(_SIZES, 0, np.int64), joined(_SIZES, 1, np.uint32), joined(_SIZES, 2, np.uint64).reshape(-1, 2)
    order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
    new = np.concatenate([[True], (digests[order[1:]] != digests[order[:-1]]).any(axis=1)]) if len(order) else np.zeros(0, bool)
    further = np.flatnonzero(~new & (np.diff(ids[order], prepend=0) != 0))
    copies = np.stack([ids[order[np.flatnonzero(new)[np.cumsum(new)[further] - 1]]], ids[order[further]], n[order[further]].astype(np.int64)])
    for k in range(0, len(further), _IN_ROW):
        yield _rows([(_COPIES, copies[:, k : k + _IN_ROW].tobytes(), 0)], names, kinds)
    order = order[new]
    order = order[np.argsort(ids[order], kind="stable")]
    for k in range(0, len(order), _IN_ROW):
        part = order[k : k + _IN_ROW]
        yield _rows([(_SIZES, _texts_row(ids[part], n[part]), 0)], names, kinds)
    docs = np.repeat(joined(_RUNS, 0, np.int64), joined(_RUNS, 1, np.uint32))
    one, two = joined(_RUNS, 2, np.uint64), joined(_RUNS, 3, np.uint16)
    parts.clear()
    order = np.argsort(one)
    same = one[order[1:]] == one[order[:-1]]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    order = order[np.lexsort((docs[order], two[order], one[order]))]
    one, two, docs = one[order], two[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.zeros(0, np.int64)
    last, lists = np.append(first[1:], len(one)), {}
    many = last - first > 1
    whole = docs.tobytes()
    for s, e in zip((8 * first[many]).tolist(), (8 * last[many]).tolist(), strict=True):
        lists[key] = lists.get(key := whole[s:e], 0) + 1
    out = []
    for key, weight in lists.items():
        out.append((_RUNS, _encoded(np.frombuffer(key, np.int64)), weight))
        if len(out) == 1000:
            yield _rows(out, names, kinds)
            out = []
    if out:
        yield _rows(out, names, kinds)


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts with the number of each one's tag (0: none) in the list of tags that follows."""
    for batch in batches:
        for k in range(0, batch.num_rows, _IN_ROW):
            part = batch.slice(k, _IN_ROW)
            tags = part.column(1).dictionary_encode()
            texts = _texts_row(part.column(0).to_numpy(), tags.indices.fill_null(-1).to_numpy() + 1)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("tag", pa.string())])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([tags.dictionary], ["tag"]))
            yield _rows([(_TAGS, len(texts).to_bytes(8, "little") + texts + sink.getvalue().to_pybytes(), 0)], ["kind", "blob", "weight"], [pa.int32(), pa.binary(), pa.int64()])


def _of_tags_row(blob: bytes) -> pa.Table:
    size = int.from_bytes(blob[:8], "little")
    ids, tag = _of_texts_row(blob[8 : 8 + size])
    tags = pa.ipc.open_stream(blob[8 + size :]).read_all()["tag"].combine_chunks()
    return pa.table({"doc_id": ids, "tag": pa.DictionaryArray.from_arrays(pa.array(tag.astype(np.int32) - 1, mask=tag == 0), tags)})


def _deal(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A list goes to every block that has one of its texts, many to a row; sizes and tags go to all blocks, copies to one."""
    names, kinds = ["block", "kind", "blob"], [pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[tuple[list[bytes], list[int]]] = [([], []) for _ in range(blocks)]
        held = 0
        for batch in batches:
            for kind, blob, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind != _RUNS:
                    to = range(blocks) if kind != _COPIES else [int(_block(np.frombuffer(blob, np.int64, 1), blocks)[0])]
                    yield _rows([(k, kind, blob) for k in to], names, kinds)
                    continue
                for k in np.unique(_block(_decoded(blob), blocks)).tolist():
                    lists[k][0].append(blob)
                    lists[k][1].append(weight)
                    held += len(blob) + 64
                if held > _HELD:
                    yield _rows([(k, _RUNS, _lists_row(*x)) for k, x in enumerate(lists) if x[0]], names, kinds)
                    lists, held = [([], []) for _ in range(blocks)], 0
        if held:
            yield _rows([(k, _RUNS, _lists_row(*x)) for k, x in enumerate(lists) if x[0]], names, kinds)

    return run


class _Texts:
    """The texts that count (one of each digest), their sizes and tags."""

    def __init__(self, sizes: list[bytes], tags: list[bytes]) -> None:
        ids, n = (np.concatenate(x) for x in zip(*map(_of_texts_row, sizes), strict=True))
        order = np.argsort(ids)
        self.ids, self.n, self.tags = ids[order], n[order].astype(np.int32), None
        if tags:
            table = pa.concat_tables([_of_tags_row(b) for b in tags]).unify_dictionaries().combine_chunks()
            known, tag = table["doc_id"].to_numpy(), table["tag"].combine_chunks()
            order = np.argsort(known)
            at = np.minimum(np.searchsorted(known[order], self.ids), len(known) - 1)
            self.tags = tag.take(pa.array(order[at], mask=known[order[at]] != self.ids)) if len(known) else None


class _Counts:
    """How often each row of numbers came."""

    def __init__(self, highest: list[int]) -> None:
        self.bits = [int(x).bit_length() for x in highest]
        self.fits, self.held, self.rows = sum(self.bits) < 64, [], 0

    def add(self, columns: list[np.ndarray]) -> None:
        if self.fits:
            key = np.zeros(len(columns[0]), np.int64)
            for x, n in zip(columns, self.bits, strict=True):
                key = key << n | x
        else:
            key = np.stack(columns, axis=1).astype(np.int64)
        self.held.append(np.unique(key, return_counts=True, axis=None if self.fits else 0))
        self.rows += len(self.held[-1][0])
        if self.rows > 2 * _AT_ONCE:
            self._merge()

    def _merge(self) -> None:
        if not self.held:
            self.held = [(np.zeros(0 if self.fits else (0, len(self.bits)), np.int64), np.zeros(0, np.int64))]
        key, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(key) if self.fits else np.lexsort(key.T)
        key, n = key[order], n[order]
        new = key[1:] != key[:-1]
        first = np.flatnonzero(np.append(len(key) > 0, new if self.fits else new.any(axis=1)))
        self.held, self.rows = [(key[first], np.add.reduceat(n, first) if len(first) else n)], 0  # counted anew, so that many different rows are not merged at every step

    def columns(self) -> list[np.ndarray]:
        self._merge()
        key, n = self.held[0]
        if not self.fits:
            return [*key.T, n]
        out = []
        for bits in reversed(self.bits):
            out.append(key & ((1 << bits) - 1))
            key = key >> bits
        return [*reversed(out), n]


def _lists(texts: _Texts, rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of texts, list after list (lists of a single text left out); where each list ends; weights."""
    found = [_decoded(b) for b, _ in rows]
    ids = np.concatenate(found)
    own = np.repeat(np.arange(len(found)), [len(x) for x in found])
    at = np.minimum(np.searchsorted(texts.ids, ids), len(texts.ids) - 1)
    good = texts.ids[at] == ids
    length = np.bincount(own[good], minlength=len(found))
    good &= length[own] > 1
    return at[good], np.cumsum(length[length > 1]), np.array([w for _, w in rows], np.int64)[length > 1]


def _count(blocks: int, what: str = "pairs") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the blocks of a task have: "pairs"; "copies", pairs and each further copy beside its text; "spread", pairs also with sums over shared runs of how many texts have the
    run, and of its square; "sims", how many pairs have the same numbers of runs; "texts", texts in any pair; "top", how
    many texts the commonest run has."""

    def pairs(block: int, texts: _Texts, rows: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        at, ends, weights = _lists(texts, rows)
        if not len(at):
            return
        length = np.diff(ends, prepend=0)
        if what == "top":
            yield pa.RecordBatch.from_arrays([pa.array([int(length.max())], pa.int64())], ["top"])
            return
        values = [weights, weights * length, weights * length * length] if what == "spread" else [weights]
        own = np.repeat(np.arange(len(ends)), length)
        mine = np.flatnonzero(_block(texts.ids[at], blocks) == block)
        if what == "texts":
            yield pa.RecordBatch.from_arrays([pa.array(texts.ids[np.unique(at[mine])])], ["doc_id"])
            return
        mine = mine[np.argsort(at[mine], kind="stable")]
        doc, which, more = at[mine], own[mine], ends[own[mine]] - mine - 1
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        work = np.append(np.cumsum(more)[first] - more[first], more.sum())
        list_bits, text_bits = int(len(ends)).bit_length(), int(len(texts.ids)).bit_length()
        most = 1 << min(20, 63 - list_bits - text_bits)
        if what == "sims":
            codes = None if texts.tags is None else texts.tags.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
            counts = _Counts([int(texts.n.max()), 2 * int(texts.n.max()), *([] if codes is None else [int(codes.max())] * 2)])
        s = 0
        while s < len(first):
            e = min(max(s + 1, int(np.searchsorted(work, work[s] + _AT_ONCE, "right")) - 1), s + most, len(first))
            part = slice(first[s], first[e] if e < len(first) else len(doc))
            n = more[part]
            if n.any():
                other = at[np.arange(int(n.sum())) + np.repeat(mine[part] + 1 - np.cumsum(n) + n, n)]
                row = np.repeat(np.cumsum(np.diff(doc[part], prepend=doc[part][0]) != 0), n)
                key = row << (text_bits + list_bits) | other << list_bits | np.repeat(which[part], n)
                key.sort()
                pair = key >> list_bits
                start = np.flatnonzero(np.diff(pair, prepend=-1))
                lists, pair = key & ((1 << list_bits) - 1), pair[start]
                a, b = doc[first[s : e]][pair >> text_bits], pair & ((1 << text_bits) - 1)
                sums = [np.add.reduceat(v[lists], start) for v in values]
                if what == "sims":
                    counts.add([sums[0], texts.n[a].astype(np.int64) + texts.n[b], *([] if codes is None else [codes[a], codes[b]])])
                    s = e
                    continue
                columns = [pa.array(texts.ids[a]), pa.array(texts.ids[b]), *[pa.array(x) for x in sums], pa.array(texts.n[a]), pa.array(texts.n[b])]
                names = ["a", "b", "n_shared", *["n_texts", "n_squares"][: len(sums) - 1], "n_a", "n_b"]
                if texts.tags is not None:
                    columns += [texts.tags.take(pa.array(x)).cast(pa.string()) for x in (a, b)]
                    names += ["tag_a", "tag_b"]
                yield pa.RecordBatch.from_arrays(columns, names)
            s = e
        if what == "sims":
            shared, both, *of, n = counts.columns()
            for k in range(0, len(n), 1 << 16):
                part = slice(k, k + (1 << 16))
                tags = [texts.tags.dictionary.take(pa.array(x[part] - 1, mask=x[part] == 0)).cast(pa.string()) for x in of]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in (shared, both, n)), *tags], ["n_shared", "n_both", "n", *["tag_a", "tag_b"][: len(tags)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list[bytes]] = {}
        beside: dict[int, dict[int, list[bytes]]] = {}
        for batch in batches:
            for block, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _RUNS:
                    lists.setdefault(block, []).append(blob)
                elif kind == _COPIES:
                    if what == "copies":
                        a, b, n = np.frombuffer(blob, np.int64).reshape(3, -1)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n), *[pa.array(n.astype(np.int32))] * 2], ["a", "b", "n_shared", "n_a", "n_b"])
                else:
                    beside.setdefault(block, {_SIZES: [], _TAGS: []})[kind].append(blob)
        texts = None
        for block in sorted(lists):
            texts = texts or _Texts(beside[block][_SIZES], beside[block][_TAGS])
            beside.pop(block)
            yield from pairs(block, texts, [x for row in lists.pop(block) for x in _of_lists_row(row)])

    return run


@dataclass
class Dealt:
    """Lists of texts with a run in blocks; what rests on one of these has its shuffles in common."""

    lists: DataFrame
    blocks: int
    tagged: bool


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files deleted on all executors as soon as it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(documents: DataFrame, gram: int, tags: DataFrame | None = None) -> Dealt:
    """documents (doc_id, text; the smallest doc_id of a text stands for its copies) by their runs of ``gram`` tokens;
    tags (doc_id, tag): one row a doc_id at most."""
    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(64, buckets)
    tokens = F.transform(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    texts = documents.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("digest"), tokens.alias("t"))

    def met(part: int, parts: int) -> DataFrame:
        packed = texts.mapInArrow(_pack(gram, buckets, part, parts), "bucket int, kind int, ids binary, counts binary, one binary, two binary")
        return packed.repartition(buckets, "bucket").mapInArrow(_meet, "kind int, blob binary, weight long")

    if int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < _LARGE:
        lists = met(0, 1)
    else:
        rounds = []
        for part in range(_ROUNDS):
            with _shuffles_end(documents.sparkSession):
                rounds.append(kept(met(part, _ROUNDS), "lists"))
        lists = reduce(DataFrame.unionByName, rounds)
    lists = lists.groupBy("kind", "blob").agg(F.sum("weight").alias("weight"))
    if tags is not None:
        lists = lists.unionByName(tags.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tag").cast("string").alias("tag")).mapInArrow(_tagged, "kind int, blob binary, weight long"))
    return Dealt(lists.mapInArrow(_deal(blocks), "block int, kind int, blob binary").repartition(blocks, "block"), blocks, tags is not None)


def shared_runs(documents: DataFrame | Dealt, gram: int = 0, *, tags: DataFrame | None = None, spread: bool = False, copies: bool = False) -> DataFrame:
    """a, b, n_shared, n_a, n_b of every two different texts of documents (doc_id, text; the smallest doc_id of a text
    stands for its copies) that share a run of ``gram`` tokens: how many different runs they share and have.

    tags (doc_id, tag; one row a doc_id at most) adds tag_a and tag_b, null where there is none. spread adds n_texts and
    n_squares: sums over the shared runs of how many texts have the run, and of its square. copies (with neither) adds each
    further copy of a text with runs as b beside the text's smallest doc_id as a. Here and below, documents may be dealt already.
    """
    of = _as_dealt(documents, gram, tags)
    if copies and (spread or of.tagged):
        raise ValueError("copies come without spread and tags")
    kinds = "a long, b long, n_shared long" + ", n_texts long, n_squares long" * spread + ", n_a int, n_b int" + ", tag_a string, tag_b string" * of.tagged
    found = of.lists.mapInArrow(_count(of.blocks, "spread" if spread else "copies" if copies else "pairs"), kinds)
    return found.withColumns({"n_a": F.col("n_a").cast("long"), "n_b": F.col("n_b").cast("long")})


def _as_dealt(documents: DataFrame | Dealt, gram: int, tags: DataFrame | None = None) -> Dealt:
    return documents if isinstance(documents, Dealt) else dealt(documents, gram, tags)


def similarity_counts(documents: DataFrame | Dealt, gram: int = 0, *, tags: DataFrame | None = None) -> DataFrame:
    """n_shared, n_both, n: how many pairs of ``shared_runs`` share n_shared runs and have n_both = n_a + n_b; with tags
    also by tag_a and tag_b. The same numbers may come in several rows, to be added up; pairs are counted where they are found."""
    of = _as_dealt(documents, gram, tags)
    return of.lists.mapInArrow(_count(of.blocks, "sims"), "n_shared long, n_both long, n long" + ", tag_a string, tag_b string" * of.tagged)


def commonest_run(documents: DataFrame | Dealt, gram: int = 0) -> DataFrame:
    """top: how many different texts have the commonest run; null if no run is in two."""
    of = _as_dealt(documents, gram)
    return of.lists.mapInArrow(_count(of.blocks, "top"), "top long").agg(F.max("top").alias("top"))


def paired_texts(documents: DataFrame | Dealt, gram: int = 0) -> DataFrame:
    """doc_id of every text that is in a pair of ``shared_runs``."""
    of = _as_dealt(documents, gram)
    return of.lists.mapInArrow(_count(of.blocks, "texts"), "doc_id long")
