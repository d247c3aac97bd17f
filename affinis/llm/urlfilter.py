"""URL filters: host and path rules, and a Bloom filter cascade over the corpus's complete key universe.

Level 1 holds the listed keys. Each later level holds the false positives of the levels before it, taken over every
key of the corpus, so the answer for a key of the corpus is exact: the first level that lacks it decides by its parity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import Scratch, arrow_limits

#: Most listed keys of one cascade, so that what is broadcast has a proven bound (about 2.5 MB a million keys); more
#: keys are dealt to several cascades by hash, each over its own part of the rows.
MAX_LISTED = 4_000_000


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or without "://"."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lowered = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty for null or without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    """Whether a rule's host is the host or stands above it, and the path starts with the rule's."""
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (verdict, host, path); null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fit = fits(host, path, rule_host, rule_path)
        name, verdict = F.when(fit, rule_host + rule_path).otherwise(name), F.when(fit, what).otherwise(verdict)
    return name, verdict


def _bits(h: np.ndarray, salt: int, k: int, m: int) -> np.ndarray:
    """k places of each 64-bit hash in a filter of m bits."""
    with np.errstate(over="ignore"):
        a = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
        a ^= a >> np.uint64(31)
        a *= np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(29)
        low, high = a & np.uint64(0xFFFFFFFF), (a >> np.uint64(32)) | np.uint64(1)
        return ((low[:, None] + np.arange(k, dtype=np.uint64)[None, :] * high[:, None]) % np.uint64(m)).astype(np.int64)


@dataclass
class Cascade:
    """Levels of (bits, hash functions, length); level i is salted by i."""

    levels: list[tuple[np.ndarray, int, int]] = field(default_factory=list)

    def depth(self, h: np.ndarray) -> np.ndarray:
        """How many levels in a row hold each hash."""
        out, alive = np.zeros(len(h), np.int64), np.arange(len(h))
        for i, (words, k, m) in enumerate(self.levels):
            at = _bits(h[alive], i, k, m)
            alive = alive[((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)]
            out[alive] = i + 1
        return out

    def holds(self, h: np.ndarray) -> np.ndarray:
        return self.depth(h) % 2 == 1

    def size(self) -> int:
        return sum(len(w) * 8 for w, _, _ in self.levels)


def _key_hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def build_cascade(keys: DataFrame) -> Cascade:
    """keys: h (a key's 64-bit hash, each once), listed (boolean): the complete universe, kept as a written table.

    Bits are set by a distributed aggregation on 64-bit words, so the driver gets the finished level and nothing else.
    """
    counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, others = counts.get(True, 0), counts.get(False, 0)
    cascade, inside, rate = Cascade(), listed, min(0.5, max(1e-6, math.sqrt(0.5) * listed / max(1, others)))
    for level in range(64):
        if not inside:
            break
        m = max(64, math.ceil(inside * math.log(1 / rate) / math.log(2) ** 2))
        k = max(1, round(math.log2(1 / rate)))
        cascade.levels.append(_level(keys, cascade, level, k, m))
        inside = _passing(keys, cascade, level)
        rate = 0.5
    else:
        raise RuntimeError("the levels don't end")
    return cascade


def _level(keys: DataFrame, cascade: Cascade, level: int, k: int, m: int) -> tuple[np.ndarray, int, int]:
    wanted = level % 2 == 0  # the kind of key that this level encodes

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = b["h"].to_numpy()
            h = h[(b["listed"].to_numpy() == wanted) & (cascade.depth(h) == level)]
            at = _bits(h, level, k, m).ravel()
            yield pd.DataFrame({"word": at >> 6, "bit": np.left_shift(np.int64(1), at & 63)})

    rows = keys.mapInPandas(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros((m + 63) // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return words, k, m


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> int:
    """How many keys of the other kind pass all levels so far."""
    other = level % 2 == 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = b["h"].to_numpy()
            yield pd.DataFrame({"n": [int(((b["listed"].to_numpy() == other) & (cascade.depth(h) == level + 1)).sum())]})

    return keys.mapInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def _member(held):
    @F.pandas_udf("boolean")
    def member(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.holds(x.to_numpy()))

    return member


def _universe(df: DataFrame, key: str, listed: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(h, listed) of every key of df, each once, written; and the seed under which no two keys have one hash. Keys are
    told apart as strings: with a seed that gives two of them one hash, another one is taken."""
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).groupBy("key").agg(F.lit(1).alias("n"))
    marks = listed.select(F.col(listed.columns[0]).cast("string").alias("key")).filter("key is not null").distinct().withColumn("listed", F.lit(True))
    named = scratch.keep(keys.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    for seed in range(64):
        found = scratch.keep(named.select(_key_hash(F.col("key"), seed).alias("h"), "listed"), f"universe-{seed}")
        if found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            scratch.drop("keys")
            return found, seed
        scratch.drop(f"universe-{seed}")
    raise RuntimeError("no seed keeps the keys apart")


def listed_in(df: DataFrame, key: str, listed: DataFrame, *, max_listed: int = MAX_LISTED) -> tuple[list[Cascade], Column]:
    """Cascades over all of df's keys, and a Column that says whether a row's key stands in the first column of
    ``listed``, a table of keys. Null keys are not listed. The universe is written once to the shared folder."""
    arrow_limits(df.sparkSession)
    scratch = Scratch(df.sparkSession, "cascade")
    universe, seed = _universe(df, key, listed, scratch)
    parts = max(1, -(-universe.filter("listed").count() // max_listed))
    cascades = [build_cascade(universe.filter(F.pmod("h", F.lit(parts)) == p)) for p in range(parts)]
    scratch.drop(f"universe-{seed}")
    h, answer = _key_hash(F.col(key), seed), F.lit(False)
    for p, cascade in enumerate(cascades):
        member = _member(df.sparkSession.sparkContext.broadcast(cascade))
        own = F.pmod(h, F.lit(parts)) == p
        answer = F.when(own, member(h)).otherwise(answer) if parts > 1 else member(h)
    return cascades, F.col(key).isNotNull() & answer


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judges every url: the longest fitting rule's verdict, else block if the cascade lists its host, else allow.

    listed: a table whose first column holds the hosts of the block list (nulls and repeats are left out; it may be
    empty). Returns page_id, host, path, rule, verdict, one row per row. A null url, or one without "://", has an empty
    host and path, fits no rule and is looked up as the empty host; null ids stay null; rows may repeat; an empty table
    gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    _, member = listed_in(rows, "host", listed)
    judged = rows.withColumn("rule", name).withColumn("_rule_verdict", verdict).withColumn("_member", member)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_rule_verdict", F.when(F.col("_member"), "block").otherwise("allow")).alias("verdict"))
