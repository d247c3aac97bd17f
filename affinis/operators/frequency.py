"""How rare matches are among all comparisons, by strategy, and similarities weighted by it.

Matches are rows (a, b, tokens array<...>): the token sequence of one tile. A strategy gives each match a frequency; the
weighted similarity counts a match more the rarer it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions import weights


def _key(tokens: Column) -> Column:
    return F.sha2(F.to_json(tokens), 256)


def complete(matches: DataFrame, least: int) -> DataFrame:
    """How many matches have just these tokens."""
    rows = matches.withColumn("_k", _key(F.col("tokens")))
    return rows.join(rows.groupBy("_k").agg(F.count("*").cast("double").alias("frequency")), "_k").drop("_k")


def _sublists(tokens: Column, least: int) -> Column:
    """Every contiguous part of at least ``least`` tokens."""
    n = F.size(tokens)
    sizes = F.when(n >= least, F.sequence(F.lit(least), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(tokens, i, k))))


def _windows(tokens: Column, size: int) -> Column:
    n = F.size(tokens)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.slice(tokens, i, size))).otherwise(F.array().cast("array<array<string>>"))


def _mean_of_parts(matches: DataFrame, parts: Column, counted: DataFrame, positive: bool) -> DataFrame:
    """Each match with the mean count of its parts (with positive: of those that count at all); 0 without any."""
    rows = matches.withColumn("_id", F.xxhash64("a", "b", _key(F.col("tokens"))))
    keyed = rows.select("_id", F.explode(F.transform(parts, _key)).alias("_k")).join(counted, "_k", "left")
    value = F.when(F.col("_n") > 0, F.col("_n")) if positive else F.coalesce("_n", F.lit(0))
    means = keyed.groupBy("_id").agg(F.avg(value).alias("frequency"))
    return rows.join(means, "_id", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0))).drop("_id")


def contained(matches: DataFrame, least: int) -> DataFrame:
    """Mean over the parts of a match that are whole matches somewhere, of how often they are."""
    whole = matches.groupBy(_key(F.col("tokens")).alias("_k")).agg(F.count("*").alias("_n"))
    return _mean_of_parts(matches, _sublists(F.col("tokens"), least), whole, True)


def submatches(matches: DataFrame, least: int) -> DataFrame:
    """Mean over the parts of a match, of how many parts of matches have the same tokens."""
    parts = matches.select(F.explode(F.transform(_sublists(F.col("tokens"), least), _key)).alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
    return _mean_of_parts(matches, _sublists(F.col("tokens"), least), parts, False)


def window(matches: DataFrame, least: int) -> DataFrame:
    """Mean over the windows of ``least`` tokens of a match, of how many windows of matches are the same; 0 for shorter ones."""
    parts = matches.select(F.explode(F.transform(_windows(F.col("tokens"), least), _key)).alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
    return _mean_of_parts(matches, _windows(F.col("tokens"), least), parts, False)


STRATEGIES: dict[str, Callable[[DataFrame, int], DataFrame]] = {"COMPLETE_MATCHES": complete, "CONTAINED_MATCHES": contained, "SUBMATCHES": submatches, "WINDOW_OF_MATCHES": window}
WEIGHTINGS: dict[str, Callable[[Column], Column]] = {"LINEAR": weights.linear, "PROPORTIONAL": weights.proportional, "QUADRATIC": weights.quadratic, "SIGMOID": weights.sigmoid}


def weighted_similarity(counted: DataFrame, divisors: DataFrame, weighting: str = "SIGMOID", factor: float = 0.25) -> DataFrame:
    """a, b, similarity: (length * weight) over the divisors (a, b, div_a, div_b) of both sides, at most 1.

    weight = (1 - factor) + factor * g(rarity), rarity = 1 - frequency / greatest frequency. A match that the strategy
    never counted adds its plain length as well.
    """
    top = counted.agg(F.max("frequency").alias("top"))  # one row
    rows = counted.crossJoin(F.broadcast(top))
    rarity = F.when(F.col("top") > 0, weights.rarity(F.col("frequency"), F.col("top"))).otherwise(F.lit(1.0))
    weight = (1 - factor) + factor * WEIGHTINGS[weighting](rarity)
    length = F.size("tokens")
    added = length * weight + F.when(F.col("frequency") == 0, length).otherwise(0)
    sums = rows.groupBy("a", "b").agg(F.sum(added).alias("matched"))
    whole = F.col("div_a") + F.col("div_b")
    return sums.join(divisors.select("a", "b", "div_a", "div_b"), ["a", "b"]).select("a", "b", F.when(whole > 0, F.least(2 * F.col("matched") / whole, F.lit(1.0))).otherwise(0.0).alias("similarity"))


def weighted_complete(pairs: DataFrame, weighting: str = "SIGMOID", factor: float = 0.25) -> DataFrame:
    """``weighted_similarity`` by complete matches, of pairs that have their matches' frequencies already (see
    compare.Comparison.frequencies): no match is dealt out."""
    weight = lambda f: (1 - factor) + factor * WEIGHTINGS[weighting](weights.rarity(f, F.col("top")))
    matched = F.aggregate("matches", F.lit(0.0), lambda s, m: s + m["length"] * weight(m["frequency"]))
    whole = F.col("div_a") + F.col("div_b")
    return pairs.select("a", "b", F.when(whole > 0, F.least(2 * matched / whole, F.lit(1.0))).otherwise(0.0).alias("similarity"))
