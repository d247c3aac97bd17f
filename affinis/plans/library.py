"""Queries of the operator library over the tables: thin callers of the operators; tests hold those against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import clusters, features, frequency, tokens
from affinis.operators.clustering import connected
from affinis.operators.compare import METRICS, Comparison, Options, _Row, compare
from affinis.sources import report
from affinis.sources.tables import read


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as submissions, a turn a file."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("submission"), F.format_string("%06d", F.col("turn")).alias("file"), tokens.words(F.col("text")).alias("tokens"))
    return tokens.submissions(turns)


def _compared(spark: SparkSession, sf_dir: str) -> Comparison:
    return compare(_submissions(spark, sf_dir), Options(5))


def compare_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every pair of classes of equal submissions that share a run of five tokens."""
    return _compared(spark, sf_dir).pairs.select("a", "b", *[F.round(f(_Row()), 6).alias(n.lower()) for n, f in METRICS.items()])


def compare_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which class of equal submissions each one belongs to."""
    return _compared(spark, sf_dir).members


def similarity_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents that count: without file ends and without what they share with the benchmark's passages."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), tokens.words(F.col("text")).alias("tokens"))
    base = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), tokens.words(F.col("text")).alias("tokens"))
    found = compare(docs, Options(9), base_code=base)
    marked = F.aggregate("tiles", F.lit(0).cast("long"), lambda s, t: s + t["length_a"])
    sizes = docs.select("name", F.size("tokens").cast("long").alias("n_tokens"))
    return found.members.join(found.base.withColumnRenamed("name", "representative"), "representative").join(sizes, "name").select("name", "n_tokens", marked.alias("base_tokens"), (F.col("n_tokens") - marked).alias("divisor"))


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Comparison]:
    found = _compared(spark, sf_dir)
    own = _submissions(spark, sf_dir).select(F.col("name").alias("a"), F.col("tokens").alias("ta"))
    return found.pairs.select("a", "b", F.explode("tiles").alias("t")).join(own, "a").select("a", "b", F.slice("ta", F.col("t.start_a") + 1, F.col("t.length_a")).alias("tokens")), found


def _weighted(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if strategy == "COMPLETE_MATCHES":
            return frequency.weighted_complete(_compared(spark, sf_dir).frequencies()).select("a", "b", F.round("similarity", 6).alias("similarity"))
        matches, found = _matches(spark, sf_dir)
        scored = frequency.weighted_similarity(frequency.STRATEGIES[strategy](matches, 5), found.pairs)
        return scored.select("a", "b", F.round("similarity", 6).alias("similarity"))

    return run


def _clusters(algorithm: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _compared(spark, sf_dir).metric("AVG").filter("similarity > 0")
        return clusters.clustered(pairs, connected(pairs.select("a", "b")), algorithm=algorithm, **options)

    return run


def comparison_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.comparison_records(_compared(spark, sf_dir))


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One graph a customer: the customer, its orders, their parts; edges by what they lead to."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("graph"), F.concat(F.lit("order."), "o_orderkey").alias("order"), "o_orderkey")
    items = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    first = orders.select("graph", F.concat(F.lit("customer_"), "graph").alias("src"), F.col("order").alias("dst"), F.lit("control").alias("type"))
    second = items.select("graph", F.col("order").alias("src"), F.concat(F.lit("part_"), "l_partkey").alias("dst"), F.lit("data").alias("type")).distinct()
    edges = first.unionByName(second)
    nodes = edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes, edges


def features_80_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.graph_features(*_graphs(spark, sf_dir), "80").select("graph", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


def features_20_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.graph_features(*_graphs(spark, sf_dir), "20").select("graph", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


def queries() -> dict:
    own = {f.__name__: f for f in (compare_submissions, compare_members, similarity_divisor, comparison_records, features_80_full, features_20_full)}
    own |= {f"freq_weighted_{k.lower()}": _weighted(k) for k in frequency.STRATEGIES}
    own |= {f"cluster_linkage_{k.lower()}": _clusters("AGGLOMERATIVE", linkage=k, cut=0.02) for k in ("MIN", "MAX", "AVERAGE")}
    return own | {"cluster_spectral": _clusters("SPECTRAL")}
