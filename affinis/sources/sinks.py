"""Sinks: pair tables as CSV (also with anonymous ids), comparison records as JSON, vectors as TSV."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_pairs(pairs: DataFrame, path: str, *, anonymous: bool = False) -> DataFrame | None:
    """Columns a, b, sim_avg, sim_max as CSV with a header. anonymous: ids by rank instead of names; returns the mapping."""
    mapping = None
    if anonymous:
        names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        mapping = names.withColumn("id", F.dense_rank().over(Window.orderBy("name")))
        pairs = pairs.join(mapping.select(F.col("name").alias("a"), F.col("id").alias("ia")), "a").join(mapping.select(F.col("name").alias("b"), F.col("id").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "sim_avg", "sim_max")
    pairs.select("a", "b", "sim_avg", "sim_max").write.mode("overwrite").csv(path, header=True)
    return mapping


def comparison_json(comparisons: DataFrame) -> DataFrame:
    """One JSON record a pair: ids, and its metrics as a map."""
    metrics = F.create_map(F.lit("AVG"), F.col("sim_avg"), F.lit("MAX"), F.col("sim_max"), F.lit("LONGEST_MATCH"), F.col("longest").cast("double"), F.lit("MAXIMUM_LENGTH"), F.col("max_length").cast("double"))
    return comparisons.select("a", "b", F.to_json(F.struct("a", "b", metrics.alias("similarities"))).alias("record"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """vec_id and components, tab-separated."""
    vectors.select("vec_id", F.array_join(F.col("embedding").cast("array<string>"), "\t").alias("v")).write.mode("overwrite").csv(path, sep="\t", quote="", escape="")
