"""Removal of byte runs that repeat across documents, by suffix sorting with a difference cover.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller doc_id. Hashes only leave
out what can't repeat: every window of ``length`` bytes picks the k-gram of least hash in it (equal windows pick equal
ones), and only windows whose k-gram stands in two documents are dealt on, by that k-gram, so equal windows meet. Where
they meet, equal segments become one by their bytes, and the suffixes of different ones are sorted by the
difference-cover algorithm (sort sampled triples, recurse on their names, merge the remaining suffixes), group of k-grams
by group; adjacent prefixes of ``length`` bytes are compared, and the smallest doc_id of a run of equal ones decides.

Documents travel in blocks: compressed texts with their ids, written once. A block sends each k-gram and each segment
once, with the smallest of its doc_ids, however many of its documents hold it, so hot passages are pre-aggregated. A
k-gram in very many blocks is not dealt by itself: its windows are, one by one, by their own hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import Scratch, arrow_limits, flat_text, hash_runs, mix64, release, table64

LENGTH, GRAM = 50, 20
#: Bytes of text in a block (one document may have more), and for each bucket that k-grams and segments are dealt to.
BLOCK, BUCKET = 2 << 20, 4 << 20
#: Blocks that may hold one k-gram before its windows are dealt one by one; bytes of segments sorted at once.
HOT, SORTED = 4096, 1 << 19
#: Places hashed at once: few enough for a processor's cache.
SLICE = 1 << 15
_BYTE = table64(256, 11)
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id: after all others


# --- suffix arrays ----------------------------------------------------------------------------------------------


def _names(keys: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Dense ranks from 1 of integer keys, how many there are, and the sorting permutation."""
    order = np.argsort(keys, kind="stable")
    step = np.empty(len(keys), np.int64)
    step[:1] = 1
    ordered = keys[order]
    step[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(step)
    return names, int(step.sum()), order


def suffix_array(values: np.ndarray) -> np.ndarray:
    """The suffix array of integers >= 1, by the difference cover {1, 2} modulo 3."""
    n = len(values)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: values[i:].tolist()), dtype=np.int64)
    x = np.concatenate([values.astype(np.int64), np.zeros(3, np.int64)])
    base = int(x.max()) + 1
    if base > 1_000_000:  # three values must fit one 64-bit key
        x[:n] = _names(x[:n])[0]
        base = int(x.max()) + 1
    one = np.arange(1, n + (n % 3 == 1), 3)  # with one sample past the end, so that class 1 sorts against class 2
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if base <= 2_000_000:
        names, distinct, order = _names((x[sample] * base + x[sample + 1]) * base + x[sample + 2])
    else:
        pair = _names(x[sample] * base + x[sample + 1])[0]
        names, distinct, order = _names(pair * base + x[sample + 2])
    if distinct < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    top = len(sample) + 2
    rest = rest[np.argsort(x[rest] * top + rank[rest + 1], kind="stable")]
    # Merge: a suffix of class 0 goes behind those samples that are smaller by a character (or two) and a sample's rank.
    first = sorted_sample[sorted_sample % 3 == 1]
    second = sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(x[first] * top + rank[first + 1], x[rest] * top + rank[rest + 1])
    pairs = _two(x, rank, np.concatenate([second, rest]), base, top)
    before += np.searchsorted(pairs[: len(second)], pairs[len(second) :])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = sorted_sample
    return out


def _two(x: np.ndarray, rank: np.ndarray, at: np.ndarray, base: int, top: int) -> np.ndarray:
    """Keys in the order of (x[i], x[i + 1], rank[i + 2])."""
    if base * base * top < 1 << 62:
        return (x[at] * base + x[at + 1]) * top + rank[at + 2]
    return _names(x[at] * base + x[at + 1])[0] * top + rank[at + 2]


def shared_prefix_groups(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of ``starts``, a group number; equal exactly where ``length`` bytes from there on are equal.

    data: bytes plus 1, with 0 nowhere; every start has ``length`` values behind it.
    """
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    order = suffix_array(data)
    order = order[wanted[order]]
    new = np.ones(len(order), bool)
    views = np.lib.stride_tricks.sliding_window_view(data.astype(np.uint16), length)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        new[a:b] = (views[order[a:b]] != views[order[a - 1 : b - 1]]).any(axis=1)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[starts]


# --- blocks -----------------------------------------------------------------------------------------------------


class Block:
    """Texts end to end, where each ends, and their doc_ids."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray):
        self.ids, self.raw = ids, raw
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, ids, sizes, packed, lists of what is carried) of about ``size`` bytes of text each."""
    task, made, held, total = TaskContext.get().partitionId() << 32, 0, [], 0

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches([b for b, _, _ in held]).combine_chunks()
        raw = np.concatenate([r for _, r, _ in held])
        sizes = np.concatenate([n for _, _, n in held])
        n = pa.array([0, table.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(n, c.chunk(0) if c.num_chunks else pa.array([], c.type)) for c in [table.column(0), pa.chunked_array([pa.array(sizes, pa.int64())]), *table.columns[2:]]]
        names = ["block", "ids", "sizes", "packed", *table.column_names[2:]]
        return pa.RecordBatch.from_arrays([pa.array([task | made], pa.int64()), *lists[:2], pa.array([pa.compress(raw.tobytes(), "zstd", asbytes=True)], pa.binary()), *lists[2:]], names=names)

    for batch in batches:
        raw, offsets = flat_text(batch.column(1))
        held.append((batch, raw, np.diff(offsets)))
        total += len(raw)
        if total >= size:
            yield row()
            held, total, made = [], 0, made + 1
    if any(b.num_rows for b, _, _ in held):
        yield row()
    held.clear()
    release()


def _unpacked(batch: pa.RecordBatch, row: int) -> Block:
    """A block from the columns ids, sizes and packed at 1, 2 and 3."""
    ids, sizes = (batch.column(k)[row].values for k in (1, 2))
    sizes = sizes.to_numpy()
    raw = pa.decompress(batch.column(3)[row].as_buffer(), int(sizes.sum()), "zstd")
    return Block(ids.fill_null(_LAST).to_numpy(), sizes, np.frombuffer(raw, np.uint8))


# --- anchors ----------------------------------------------------------------------------------------------------


def _least_grams(raw: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of ``length`` bytes, the least hash of a k-gram in it."""
    hashes, width, done, out = _BYTE[raw], 1, 0, None
    while True:  # hashes of runs of 1, 2, 4, ... bytes; those for the bits of ``gram`` are joined
        if gram & width:
            out = hashes if out is None else out[: len(hashes) - done] * np.uint64(0x9FB21C651E98DF25) + hashes[done:]
            done += width
        if width * 2 > gram:
            break
        hashes = hashes[:-width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + hashes[width:]
        width *= 2
    span, width = length - gram + 1, 1
    n = len(raw) - length + 1
    while width * 2 <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:n], out[span - width : span - width + n])


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that pick one k-gram: its hash, the first window's place, how many windows (at most length -
    gram + 1), and the text. Windows lie inside one text each."""
    span = length - gram + 1
    bottom, top = offsets[:-1], offsets[1:] - length + 1  # windows of a text start from here to there
    some = top > bottom
    if not some.any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    starts, values = [], []
    for a in range(0, len(raw) - length + 1, SLICE):
        least = _least_grams(raw[a : a + SLICE + length - 1], length, gram)
        new = np.flatnonzero(least[1:] != least[:-1]) + 1
        if not values or values[-1][-1] != least[0]:
            new = np.concatenate([[0], new])
        if len(new):
            starts.append(new + a)
            values.append(least[new])
    starts, values = np.concatenate(starts), np.concatenate(values)
    cuts = np.sort(np.concatenate([starts, bottom[some], top[some]]), kind="stable")
    cuts = cuts[(np.diff(cuts, prepend=-1) > 0) & (cuts <= len(raw) - length)]
    ends = np.append(cuts[1:], len(raw) - length + 1)
    of = np.searchsorted(offsets, cuts, side="right") - 1
    inside = cuts < top[of]
    cuts, ends, of = cuts[inside], ends[inside], of[inside]
    parts = -(-(ends - cuts) // span)  # the same k-gram again and again: runs of at most ``span`` windows
    piece = np.repeat(np.arange(len(cuts)), parts)
    start = cuts[piece] + span * (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts))
    count = np.minimum(ends[piece] - start, span)
    return values[np.searchsorted(starts, start, side="right") - 1], start, count, of[piece]


class Dealt:
    """The k-grams of a block by bucket: of each distinct one (bucket, rest), sorted, and which one each run has."""

    def __init__(self, hashes: np.ndarray, buckets: int):
        self.bucket, self.rest, self.of = _dealt(hashes, buckets)
        self.cuts = np.append(np.flatnonzero(np.diff(self.bucket, prepend=-1)), len(self.bucket))

    def parts(self) -> Iterator[tuple[int, slice]]:
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield int(self.bucket[a]), slice(a, b)


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and 32 further bits; distinct ones in order, and the number of each hash's."""
    mixed = mix64(hashes)
    bucket = mixed % np.uint64(buckets)
    both, of = np.unique((bucket << np.uint64(32)) | (mixed >> np.uint64(32)), return_inverse=True)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), of


def _shared(table: pa.Table, hot: int) -> pa.Table:
    """Of one bucket: for each block, which of its k-grams another block or document has too, and which are hot."""
    rests = [np.frombuffer(x, "<u4") for x in table.column("rest").to_pylist()]
    sizes = np.array([len(r) for r in rests])
    both = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("many").to_pylist(), sizes, strict=True)])
    _, of, blocks = np.unique(np.concatenate(rests), return_inverse=True, return_counts=True)
    many = (blocks[of] > 1) | both.astype(bool)
    ends = np.cumsum(sizes)
    bits = [[np.packbits(x[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)] for x in (many, blocks[of] > hot)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "many": pa.array(bits[0], pa.binary()), "hot": pa.array(bits[1], pa.binary())})


# --- segments ---------------------------------------------------------------------------------------------------


def _distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes with the same ``extra`` that are equal: the first of each kind, and the kind of each run. A hash
    groups them, the bytes decide."""
    width = int(size.max(initial=0))
    weights = table64(width, 41) | np.uint64(1)
    hashes = np.empty(len(start), np.uint64)
    rows = max(1, (1 << 19) // max(width, 1))
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, width) if width else None

    def cells(at: np.ndarray) -> np.ndarray:
        return np.where(np.arange(width) < size[at][:, None], views[start[at]], 0)

    for a in range(0, len(start), rows):
        at = np.arange(a, min(a + rows, len(start)))
        hashes[at] = (cells(at).astype(np.uint64) * weights).sum(axis=1)
    hashes = mix64(hashes + mix64(extra.astype(np.uint64)) + size.astype(np.uint64))
    _, model, kind = np.unique(hashes, return_index=True, return_inverse=True)
    for a in range(0, len(start), rows):
        at = np.arange(a, min(a + rows, len(start)))
        like = model[kind[at]]
        if (size[at] != size[like]).any() or (extra[at] != extra[like]).any() or (cells(at) != cells(like)).any():
            texts = [(int(x), data[s : s + n].tobytes()) for s, n, x in zip(start.tolist(), size.tolist(), extra.tolist(), strict=True)]
            numbers = {t: k for k, t in enumerate(sorted(set(texts)))}
            kind = np.array([numbers[t] for t in texts])
            return np.unique(kind, return_index=True)[1], kind
    return model, kind


class Segments:
    """The segments of a block that are dealt on: of each run with a shared k-gram, its bytes; of one with a hot k-gram,
    those of each window. Distinct ones by bucket, in an order that the same block and answers always give."""

    def __init__(self, block: Block, answers: dict[int, tuple[bytes, bytes]], buckets: int, length: int, gram: int):
        hashes, start, count, of = anchor_runs(block.raw, block.offsets, length, gram)
        grams = Dealt(hashes, buckets)
        many, hot = np.zeros(len(grams.rest), bool), np.zeros(len(grams.rest), bool)
        for bucket, part in grams.parts():
            n = part.stop - part.start
            for x, bits in zip((many, hot), answers[bucket], strict=True):
                x[part] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        whole, single = np.flatnonzero(many[grams.of] & ~hot[grams.of]), np.flatnonzero(hot[grams.of])
        windows = np.repeat(single, count[single])
        shift = np.arange(len(windows)) - np.repeat(np.cumsum(count[single]) - count[single], count[single])
        self.start = np.concatenate([start[whole], start[windows] + shift])
        self.count = np.concatenate([count[whole], np.ones(len(windows), np.int64)])
        self.owner = block.ids[np.concatenate([of[whole], of[windows]])]
        keys = np.concatenate([hashes[whole], self._window_hashes(block.raw, start[windows] + shift, length)])
        dealt = Dealt(keys, buckets)
        self.bucket, self.rest = dealt.bucket[dealt.of], dealt.rest[dealt.of]
        key = (self.bucket.astype(np.uint64) << np.uint64(32)) | self.rest
        self.model, self.kind = _distinct(block.raw, self.start, self.count + length - 1, key)
        order = np.argsort(self.bucket[self.model], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.model, self.kind = self.model[order], place[self.kind]
        self.least = np.full(len(self.model), _LAST)
        np.minimum.at(self.least, self.kind, self.owner)
        self.raw, self.length = block.raw, length

    @staticmethod
    def _window_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return hash_runs(raw, at, at + length) if len(at) else np.zeros(0, np.uint64)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        bucket = self.bucket[self.model]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for part in np.split(np.arange(len(bucket)), cuts):
            if len(part):
                yield int(bucket[part[0]]), part

    def bodies(self, part: np.ndarray) -> bytes:
        m = self.model[part]
        return b"".join([self.raw[s : s + n].tobytes() for s, n in zip(self.start[m].tolist(), (self.count[m] + self.length - 1).tolist(), strict=True)])


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _plain(column: pa.ChunkedArray) -> list[bytes]:
    return [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in column.to_pylist()]


def _flat(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _repeats(table: pa.Table, length: int) -> pa.Table:
    """Of one bucket: for each block and each segment it sent, a bit for each window that a smaller document has."""
    sizes = np.array([len(x) for x in table.column("count").to_pylist()])
    rest, count = _flat(table.column("rest").to_pylist(), "<u4"), _flat(table.column("count").to_pylist(), "<u1").astype(np.int64)
    least, bodies = _flat(_plain(table.column("least")), "<i8"), _flat(_plain(table.column("body")), "<u1")
    size = count + length - 1
    at = np.cumsum(size) - size
    model, kind = _distinct(bodies, at, size, rest)
    low = np.full(len(model), _LAST)
    np.minimum.at(low, kind, least)
    # Kinds by k-gram, and the least doc_id of each of their windows.
    order = np.argsort(rest[model], kind="stable")
    windows = count[model[order]]
    first = np.cumsum(windows) - windows
    lowest = np.repeat(low[order], windows)
    grams = np.flatnonzero(np.diff(rest[model[order]], prepend=-1, append=-1))
    group, amount = 0, np.concatenate([[0], np.cumsum(size[model[order]])])
    while group < len(grams) - 1:
        a = grams[group]
        upto = max(group + 1, int(np.searchsorted(amount[grams], amount[a] + SORTED, side="right")) - 1)
        b, group = grams[upto], upto
        _settle(bodies, at[model[order[a:b]]], windows[a:b], np.repeat(np.diff(grams[: upto + 1])[np.searchsorted(grams[: upto + 1], np.arange(a, b), side="right") - 1] > 1, windows[a:b]), lowest[first[a] : first[a] + windows[a:b].sum()], length)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = count
    owner = np.repeat(np.arange(len(kind)), n)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    gone = lowest[first[place[kind[owner]]] + shift] < least[owner]
    mask = np.zeros(len(kind), np.uint32)
    np.bitwise_or.at(mask, owner[gone], np.uint32(1) << shift[gone].astype(np.uint32))
    ends = np.cumsum(sizes)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "masks": pa.array([mask[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())})


def _settle(bodies: np.ndarray, at: np.ndarray, windows: np.ndarray, open_: np.ndarray, lowest: np.ndarray, length: int) -> None:
    """Lowers ``lowest`` (of each window of different segments) to the least among equal windows. open_: windows whose
    k-gram has several segments. Those whose hash no other window has can't be equal to another; segments with others
    are suffix-sorted."""
    if not open_.any():
        return
    of = np.repeat(np.arange(len(at)), windows)
    inside = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    some = np.flatnonzero(open_)
    used = np.unique(of[some])
    size = windows + length - 1
    base = int(at[used].min())
    top = int((at[used] + size[used]).max())
    if top - base > 4 * int(size[used].sum()):  # far apart: gather them first
        shift = np.cumsum(size[used]) - size[used]
        local = np.arange(int(size[used].sum())) - np.repeat(shift, size[used])
        data = bodies[np.repeat(at[used], size[used]) + local]
        number = np.searchsorted(used, of[some])
        place = shift[number] + inside[some] - at[of[some]]
    else:
        data, place = bodies[base:top], inside[some] - base
    hashes = hash_runs(data, place, place + length)
    by = np.argsort(hashes, kind="stable")
    twin = hashes[by[1:]] == hashes[by[:-1]]
    mixed = np.zeros(len(at), bool)
    mixed[of[some[by[1:][twin]]]] = True
    mixed[of[some[by[:-1][twin]]]] = True
    chosen = np.flatnonzero(mixed[of])
    if not len(chosen):
        return
    segs = np.flatnonzero(mixed)
    sizes = size[segs]
    start = np.cumsum(sizes + 1) - sizes - 1  # a 1 stands between segments
    values = np.ones(int((sizes + 1).sum()), np.int64)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values[np.repeat(start, sizes) + within] = bodies[np.repeat(at[segs], sizes) + within].astype(np.int64) + 2
    number = np.cumsum(mixed) - 1
    group = shared_prefix_groups(values, start[number[of[chosen]]] + inside[chosen] - at[of[chosen]], length)
    low = np.full(int(group.max()) + 1, _LAST)
    np.minimum.at(low, group, lowest[chosen])
    lowest[chosen] = low[group]


# --- the operator -----------------------------------------------------------------------------------------------

OUTPUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(block: Block, segments: Segments, masks: np.ndarray, length: int, whole_chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of a block whether it goes, and where each maximal run of such bytes within a text begins."""
    later = segments.owner > segments.least[segments.kind]
    bits = np.where(later, np.uint32(0xFFFFFFFF), masks[segments.kind])
    rows = np.flatnonzero(bits)
    n = segments.count[rows]
    owner = np.repeat(rows, n)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    gone = (bits[owner] >> shift.astype(np.uint32)) & np.uint32(1) == 1
    windows = segments.start[owner[gone]] + shift[gone]
    change = np.zeros(len(block.raw) + 1, np.int32)
    np.add.at(change, windows, 1)
    np.add.at(change, windows + length, -1)
    cover = np.cumsum(change[:-1]) > 0
    if whole_chars and cover.any():
        begins = np.flatnonzero(block.raw & 0xC0 != 0x80)
        cover = np.repeat(np.logical_and.reduceat(cover, begins), np.diff(np.append(begins, len(cover))))
    opens = cover.copy()
    opens[1:] &= ~cover[:-1]
    text = block.offsets[:-1][np.diff(block.offsets) > 0]
    opens[text] = cover[text]
    return cover, np.flatnonzero(opens)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, whole_chars: bool = False, carry: list[str] | None = None, block: int = BLOCK, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes (of the text in UTF-8), spans (maximal removed runs of bytes) and kept (the remaining bytes
    concatenated), one row per row. Matches lie inside one document each and are judged on the input. whole_chars: a
    character is removed only if all its bytes are, so that kept is UTF-8. A null or empty text has 0 bytes. A null
    doc_id counts as larger than all others and stays null. Rows that repeat a doc_id don't take from each other. An
    empty table gives no rows; columns other than doc_id, text and those in carry (they follow, as they are) are not
    read.
    """
    if not 0 < length - gram + 1 <= 32:
        raise ValueError("a run of windows must fit 32 bits")
    own = set(OUTPUT.replace(":", " ").split()) & set(carry or [])
    if own:
        raise ValueError(f"columns of the result can't be carried: {sorted(own)}")
    spark = docs.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "suffixes")
    scratch.shrink()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry or [])])
    more = "".join(f", c{k} array<{f.dataType.simpleString()}>" for k, f in enumerate(rows.schema.fields[2:]))
    blocks = scratch.keep(rows.mapInArrow(lambda batches: _blocks(batches, block), "block long, ids array<long>, sizes array<long>, packed binary" + more), "blocks")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(8, -(-total // bucket))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = _unpacked(batch, row)
                hashes, _, _, of = anchor_runs(b.raw, b.offsets, length, gram)
                dealt, ids = Dealt(hashes, buckets), b.ids[of]
                low, high = np.full(len(dealt.rest), _LAST), np.full(len(dealt.rest), np.iinfo(np.int64).min)
                np.minimum.at(low, dealt.of, ids)
                np.maximum.at(high, dealt.of, ids)
                out = [(n, dealt.rest[p].astype("<u4").tobytes(), np.packbits(low[p] != high[p]).tobytes()) for n, p in dealt.parts()]
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([columns[0], pa.array([batch.column(0)[row].as_py()] * len(out), pa.int64()), *columns[1:]], names=["bucket", "block", "rest", "many"])
        release()

    def found(batch: pa.RecordBatch, row: int) -> tuple[Block, Segments]:
        b = _unpacked(batch, row)
        answers = {x["bucket"]: (x["many"], x["hot"]) for x in batch.column(4)[row].as_py() or []}
        return b, Segments(b, answers, buckets, length, gram)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = found(batch, row)[1]
                for n, p in s.parts():
                    m = s.model[p]
                    blobs = [s.rest[m].astype("<u4").tobytes(), s.count[m].astype("<u1").tobytes(), _packed(s.bodies(p)), _packed(s.least[p].astype("<i8").tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), batch.column(0).slice(row, 1), *(pa.array([x], pa.binary()) for x in blobs)], names=["bucket", "block", "rest", "count", "body", "least"])
                del s
        release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b, s = found(batch, row)
                masks = np.zeros(len(s.model), np.uint32)
                answers = {x["bucket"]: x["masks"] for x in batch.column(5)[row].as_py() or []}
                for n, p in s.parts():
                    masks[p] = np.frombuffer(answers[n], "<u4")
                cover, opens = _cut(b, s, masks, length, whole_chars)
                texts = np.searchsorted(b.offsets, opens, side="right") - 1
                goes = np.concatenate([[0], np.cumsum(cover)])
                closes = opens + _lengths(cover, opens, b.offsets)
                at = pa.array(np.searchsorted(texts, np.arange(len(b.ids) + 1)), pa.int32())
                spans = pa.StructArray.from_arrays([pa.array(opens - b.offsets[texts], pa.int64()), pa.array(closes - b.offsets[texts], pa.int64())], names=["start", "end"])
                left = b.raw[~cover].tobytes()
                kept_at = pa.array(b.offsets - goes[b.offsets], pa.int32())
                kept = pa.Array.from_buffers(pa.binary(), len(b.ids), [None, kept_at.buffers()[1], pa.py_buffer(left)])
                yield pa.RecordBatch.from_arrays([batch.column(1)[row].values, pa.array(np.diff(b.offsets), pa.int64()), pa.ListArray.from_arrays(at, spans), kept, *(c[row].values for c in batch.columns[6:])], names=["doc_id", "n_bytes", "spans", "kept", *(carry or [])])
        release()

    seen = blocks.select("block", "ids", "sizes", "packed").mapInArrow(grams, "bucket long, block long, rest binary, many binary")
    shared = seen.groupBy("bucket").applyInArrow(lambda t: _shared(t, hot), "block long, bucket long, many binary, hot binary")
    grouped = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "many", "hot")).alias("grams"))
    grouped = scratch.keep(grouped, "grams")
    scratch.free()
    scratch.shrink()
    dealt = blocks.select("block", "ids", "sizes", "packed").join(grouped, "block").mapInArrow(segments, "bucket long, block long, rest binary, count binary, body binary, least binary")

    def repeats(table: pa.Table) -> pa.Table:
        out = _repeats(table, length)
        release()
        return out

    judged = dealt.groupBy("bucket").applyInArrow(repeats, "block long, bucket long, masks binary")
    answers = scratch.keep(judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), "answers")
    del seen, shared, dealt, judged
    scratch.free()
    scratch.shrink()
    carried = [F.col(f"c{k}") for k in range(len(carry or []))]
    last = blocks.join(grouped, "block", "left").join(answers, "block", "left").select("block", "ids", "sizes", "packed", "grams", "masks", *carried)
    kinds = "".join(f", `{c}` {f.dataType.simpleString()}" for c, f in zip(carry or [], rows.schema.fields[2:], strict=True))
    return last.mapInArrow(cut, OUTPUT + kinds)


def _lengths(cover: np.ndarray, opens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes each run has: up to the next byte that stays, or the end of its text."""
    stays = np.append(np.flatnonzero(~cover), len(cover))
    end = stays[np.searchsorted(stays, opens)]
    return np.minimum(end, offsets[np.searchsorted(offsets, opens, side="right")]) - opens
