"""Streams: session token sequences, and new submissions compared with all there are."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_sequences(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Per user and session (split by a gap): counts of events and the sequence of types. Late rows fall to the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.array_join(F.transform("s", lambda x: x["event_type"]), ",").alias("sequence"))


def compare_new(compare: Callable[[DataFrame, DataFrame], DataFrame], known: str, out: str):
    """A foreachBatch function: compares each batch with all known rows and itself, appends the pairs and the batch."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(known)
        except Exception as e:  # no batch has come before
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        compare(batch, old.unionByName(batch)).write.mode("append").parquet(out)
        batch.write.mode("append").parquet(known)

    return run
