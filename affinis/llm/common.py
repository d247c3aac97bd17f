"""Helpers shared by the training-data operators: shared folder, Arrow batch limits, hashing of runs."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and Python; bounds a worker's memory whatever the text lengths.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one is set in local mode (tests), and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = known or "file://" + tempfile.mkdtemp(prefix="affinis-shared-")
        if not known:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Written tables in the shared folder. They cut lineage and outlive executors; ``drop`` frees one early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/affinis-{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(name)

    def _delete(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Lets Spark's cleaner delete shuffle files of steps whose results are written by now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def shrink(self) -> None:
        """Has the executors collect their garbage, so that heaps which earlier steps grew go back to the system before
        Python workers need the memory."""
        n = self.spark.sparkContext.defaultParallelism
        self.spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def release() -> None:
    """Gives freed memory of a Python worker back, so that a reused worker doesn't keep the peak of an earlier stage."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        return


# --- hashing of runs in a flat array ------------------------------------------------------------------------------

# Polynomials modulo two primes below 2**31. A power of two as modulus would give some different long runs (the
# Thue-Morse word and its complement) one hash whatever the base.
_PRIMES = (2147483647, 2147483629)
_BASES = (1180591433, 1699462517)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _grow(k: int, down: bool, n: int) -> np.ndarray:
    """The first n powers of a base, or of its inverse."""
    have = _powers.get((k, down))
    if have is None or len(have) < n:
        p = _PRIMES[k]
        base = pow(_BASES[k], -1, p) if down else _BASES[k]
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), p)) % np.uint64(p)])
        _powers[k, down] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


#: Values hashed at once, where runs come in order; bounds the powers that are kept and the sums.
_AT_ONCE = 1 << 19


def hash_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values (below 2**30) in each run start..end, the same wherever the run stands."""
    if len(values) > _AT_ONCE and len(start) > 1 and (np.diff(start) >= 0).all() and (np.diff(end) >= 0).all():
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            base = int(start[at])
            upto = max(at + 1, int(np.searchsorted(end, base + _AT_ONCE, side="right")))
            out[at:upto] = _hash_runs(values[base : int(end[upto - 1])], start[at:upto] - base, end[at:upto] - base)
            at = upto
        return out
    return _hash_runs(values, start, end)


def _hash_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    parts = []
    for k, p in enumerate(_PRIMES):
        # values below 2**30 times a power below 2**31, folded once: below 2**36, so 2**28 of them add up in 64 bits
        terms = (values + np.uint64(1)) * _grow(k, False, len(values)) if values.dtype == np.uint64 else (values.astype(np.uint64) + np.uint64(1)) * _grow(k, False, len(values))
        terms = (terms >> np.uint64(31)) * np.uint64((1 << 31) - p) + (terms & np.uint64((1 << 31) - 1))
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(terms, out=prefix[1:])
        parts.append((prefix[end] - prefix[start]) % np.uint64(p) * _grow(k, True, len(values) + 1)[start] % np.uint64(p))
    return mix64((parts[0] << np.uint64(31)) + parts[1] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def same_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Whether each run start..end holds the same values as the run numbered model[k]; by the values themselves."""
    n = end - start
    equal = n == n[model]
    at = np.flatnonzero(equal)
    n = n[at]
    if not len(at):
        return equal
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum()))
    left = values[place + np.repeat(start[at] - first, n)]
    differs = left != values[place + np.repeat(start[model[at]] - first, n)]
    if differs.any():
        some = np.flatnonzero(n > 0)
        equal[at[some]] = ~np.logical_or.reduceat(differs, first[some])
    return equal


_BASE = 0x9E3779B97F4A7C15
_wrapped: dict[int, np.ndarray] = {}


def _group_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes modulo 2**64: cheaper than hash_runs, but some different long runs share one, so groups must be checked."""
    n = len(values) + 1
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        have = _wrapped.get(base)
        if have is None or len(have) < n:
            have = np.full(max(n, 1 << 16), base, np.uint64)
            have[0] = 1
            _wrapped[base] = have = np.multiply.accumulate(have)
        powers.append(have)
    prefix = np.zeros(n, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[0][: n - 1], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * powers[1][start] + (end - start).astype(np.uint64))


class RunCache:
    """Ids of runs of characters: each distinct run is encoded once and kept. Runs are told apart by their characters;
    hashes only group them within a call, and the groups are checked."""

    def __init__(self, encode: Callable[[list[str]], list[tuple[list[int], bool]]], limit: int):
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.count, self.mark = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, bool)

    def _learn(self, words: list[str]) -> None:
        got = self.encode(words)
        n, total = len(self.known), sum(len(ids) for ids, _ in got)
        while n + len(got) > len(self.first):
            self.first, self.count, self.mark = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.mark))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        lengths = np.fromiter((len(ids) for ids, _ in got), np.int64, len(got))
        self.count[n : n + len(got)] = lengths
        self.first[n : n + len(got)] = self.used + np.cumsum(lengths) - lengths
        self.mark[n : n + len(got)] = [m for _, m in got]
        self.ids[self.used : self.used + total] = np.fromiter((i for ids, _ in got for i in ids), np.uint32, total)
        self.used += total
        self.known.update(zip(words, range(n, n + len(got)), strict=True))

    def gather(self, text: str, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of runs start..end of text (values: its code points): all ids end to end, how many each run has, its mark."""
        _, model, back = np.unique(_group_hashes(values, start, end), return_index=True, return_inverse=True)
        if not same_runs(values, start, end, model[back]).all():
            model = back = np.arange(len(start))
        words = [text[i:j] for i, j in zip(start[model].tolist(), end[model].tolist(), strict=True)]
        if len(self.known) + len(words) > self.limit:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(list(dict.fromkeys(new)))
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[back]
        count = self.count[place]
        total = np.cumsum(count)
        take = np.arange(total[-1] if len(total) else 0) + np.repeat(self.first[place] - total + count, count)
        return self.ids[take], count, self.mark[place]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(sizes: list[int], limit: int):
    """Ranges (from, to) of neighbours whose sizes add up to less than the limit, or of one."""
    at = 0
    while at < len(sizes):
        upto, size = at, 0
        while upto < len(sizes) and (upto == at or size + sizes[upto] < limit):
            size, upto = size + sizes[upto], upto + 1
        yield at, upto
        at = upto


def flat_text(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, end to end, and n + 1 offsets; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=at + n + 1)[at:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
