"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Tokens come from the ``tokenizers`` library. Its pre-tokens repeat a lot, so a worker splits a batch of texts into
pre-tokens with array operations, encodes each distinct one once and gathers the ids; the result equals a call of the
library for every text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import RunCache, arrow_limits, chunks, code_points

WINDOW = 1024
#: Tails that wait for packing at once in a task; bounds its memory (a tail has under WINDOW ids of 4 bytes).
GROUP = 8192
#: Distinct pre-tokens that a worker keeps encoded.
CACHE = 600_000
#: Characters split at once, unless one text has more.
CHUNK = 1 << 20

_LETTER, _NUMBER, _OTHER, _SPACE, _END = 1, 2, 3, 4, 5
# The code points that Unicode calls White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the byte-level pre-tokeniser cuts off.
_CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_END_CP = 0x110000


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)] + [_END], dtype=np.uint8)
    out[_WHITE] = _SPACE
    return out


class CachedBPE:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, once per distinct pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = _classes()
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # bytes that the vocabulary shows as they are
        hidden = [b for b in range(256) if b not in plain]
        self.shown = {b: 0x100 + k for k, b in enumerate(hidden)}
        self.cache = RunCache(self._words, CACHE)

    def _words(self, words: list[str]) -> list[tuple[list[int], bool]]:
        tokenize = self.library.model.tokenize
        return [([t.id for t in tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown))], False) for w in words]

    def _starts(self, cp: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in code points of texts that each end in _END_CP."""
        kind = self.kind[cp]
        before = np.concatenate([[np.uint8(_END)], kind[:-1]])
        after = np.concatenate([kind[1:], [np.uint8(_END)]])
        start = kind != before
        space = kind == _SPACE
        blank = cp == 0x20
        start |= space & (after != _SPACE) & (after != _END)  # the last of white space stands alone or leads a word
        led = np.concatenate([[False], blank[:-1]])
        start &= ~(led & ~space & (kind != _END))
        for p in np.flatnonzero((cp == 0x27) & start).tolist():
            for x in _CONTRACTIONS:
                end = p + 1 + len(x)
                if end <= len(cp) and all(cp[p + 1 + k] == ord(c) for k, c in enumerate(x)):
                    start[p + 1] = False
                    if kind[end] == _LETTER:
                        start[end] = True
                    break
        return start

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        for at, upto in chunks([len(t) for t in texts], CHUNK):
            some = texts[at:upto]
            if any(s in t for t in some for s in self.added):  # these strings are tokens of their own to the library
                got = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in some]
                ids += got
                counts[at:upto] = [len(x) for x in got]
            else:
                got, counts[at:upto] = self._chunk(some)
                ids.append(got)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        plain = code_points(joined)
        cp = np.full(len(plain) + len(texts), _END_CP, np.uint32)
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(cp), bool)
        inside[ends] = False
        cp[inside] = plain
        first = np.flatnonzero(self._starts(cp))
        last = np.append(first[1:], len(cp))
        real = cp[first] != _END_CP
        first, last = first[real], last[real]
        before = np.searchsorted(ends, first)  # one end sign for each text before
        ids, count, _ = self.cache.gather(joined, plain, first - before, last - before)
        total = np.concatenate([[0], np.cumsum(count)])
        bounds = np.searchsorted(first, np.concatenate([[0], ends]))
        return ids, np.diff(total[bounds])


class OpenWindows:
    """Windows by remaining capacity, under a segment tree that counts them; finds the tightest that still fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, left: int, window_id: int) -> None:
        self.stacks[left].append(window_id)
        at = left + self.leaves
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remaining capacity and number of an open window with the least room that is still >= need."""
        at = need + self.leaves
        while not self.tree[at]:
            while at & 1:  # a right child: go on above
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        left = at - self.leaves
        found = self.stacks[left].pop()
        while at:
            self.tree[at] -= 1
            at >>= 1
        return left, found


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """The indices of lengths (each from 1 to window) in each window, longest first."""
    tree, out = OpenWindows(window), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        got = tree.take(lengths[k])
        left, number = got if got else (window, len(out))
        if not got:
            out.append([])
        out[number].append(k)
        if left > lengths[k]:
            tree.add(left - lengths[k], number)
    return out


OUTPUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
_TYPES = [pa.int64()] * 6 + [pa.binary()]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _packer(path: str | None, name: str, window: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = _worker_bpe(path or public_tokenizers.path(name))
        task, numbered = TaskContext.get().partitionId() << 40, 0
        tails: list[tuple] = []

        def placed(at_end: bool) -> list[tuple]:
            """Rows of full windows; half-filled ones wait for later tails, unless the task is at its end."""
            nonlocal tails, numbered
            out, rest = [], []
            for group in best_fit_decreasing([t[2] for t in tails], window):
                if not at_end and sum(tails[k][2] for k in group) < window * 0.98:
                    rest += [tails[k] for k in group]
                    continue
                offset = 0
                for k in group:
                    doc, start, length, whole, ids = tails[k]
                    out.append((doc, start, length, whole, task | numbered, offset, ids))
                    offset += length
                numbered += 1
            if len(rest) > GROUP // 2:  # few small tails: what waits must not grow
                tails = rest
                return out + placed(True)
            tails = rest
            return out

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts = bpe.encode(texts)
            at, out = 0, []
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for start in range(0, n + 1, window):
                    piece = own[start : start + window]
                    if len(piece) == window:
                        out.append((doc, start, window, n + 1, task | numbered, 0, piece.tobytes()))
                        numbered += 1
                    else:
                        tails.append((doc, start, len(piece), n + 1, piece.tobytes()))
            if out:
                yield _rows(out)
            if len(tails) >= GROUP and (out := placed(False)):
                yield _rows(out)
        if out := placed(True):
            yield _rows(out)

    return pack


_bpe: dict[str, CachedBPE] = {}


def _worker_bpe(path: str) -> CachedBPE:
    if path not in _bpe:
        _bpe[path] = CachedBPE(path)
    return _bpe[path]


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, name: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Packs every document into windows of at most ``window`` tokens.

    A document is its ids and then ``end_id``. Overlong documents are first cut into full windows; what is left of
    each goes by best-fit decreasing into the tightest open window. Each task packs its own input split, in groups of
    some thousand tails, so nothing is shuffled and a lost task packs the same rows again.

    Returns one row per piece: doc_id, start (its document's ids before it), length, doc_tokens, sequence_id (task
    number and counter, unique), offset in that sequence (gapless from 0) and ids (little-endian unsigned 32-bit).
    A null or empty text is one piece that holds end_id; a null doc_id stays null; repeated rows are packed each;
    an empty table gives no rows; columns other than the two named are not read, whatever their names.
    """
    arrow_limits(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(_packer(tokenizer, name, window, end_id), OUTPUT)


def padding(length: Column, window: int = WINDOW) -> Column:
    """Padding of a sequence of so many ids: none at a power of two, else up to the window."""
    return F.when(F.bit_count(length) == 1, F.lit(0)).otherwise(F.lit(window) - length)
