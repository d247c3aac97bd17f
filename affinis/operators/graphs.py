"""Graph similarities and walk embeddings that SQL doesn't cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def degree_similarity(a, b):
    """Cosine of two ascending degree sequences, the shorter one filled with zeros at its end; 0 for an empty one."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, F.lit(0)).cast("double").alias("x"), F.coalesce(y, F.lit(0)).cast("double").alias("y")))

    def total(f):
        return F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(total(lambda p: p["x"] * p["x"])) * F.sqrt(total(lambda p: p["y"] * p["y"]))
    return F.when(norm > 0, total(lambda p: p["x"] * p["y"]) / norm).otherwise(0.0)


def degree_similarity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every two different degree sequences of customers' order graphs, each named by its smallest graph (other <
    graph), and of each further graph of a sequence with that one (1.0)."""
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    sizes = items.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    per = orders.join(sizes, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("n")).alias("d"))
    profiles = per.groupBy("d").agg(F.min("o_custkey").alias("graph"))
    other = profiles.select(F.col("graph").alias("other"), F.col("d").alias("e"))
    pairs = profiles.join(other, F.col("other") < F.col("graph")).select("graph", "other", F.round(degree_similarity(F.col("d"), F.col("e")), 6).alias("similarity"))
    members = per.join(profiles.withColumnRenamed("graph", "other"), "d").filter("o_custkey <> other")
    return pairs.union(members.select(F.col("o_custkey").alias("graph"), "other", F.lit(1.0)))


def walk_embeddings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-pooled skip-gram vectors of each user's event sequence, and its cosine to the mean of all."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    walks = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("walk"))
    model = Word2Vec(vectorSize=16, minCount=1, seed=42, windowSize=3, numPartitions=1, inputCol="walk", outputCol="v").fit(walks.orderBy("user_id"))
    return model.transform(walks).select("user_id", F.size("walk").cast("long").alias("n_steps"), F.round(F.aggregate(vector_to_array("v"), F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))
