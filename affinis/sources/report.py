"""The report of a run: comparisons, distributions, clusters and run data as JSON tables, CSV, text, and data for plots.

Tables are written by Spark, a folder each; ``archive`` packs written folders into one zip file on the driver, file by
file, and is meant for reports that one file can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.operators.compare import METRICS, Comparison, _Row

SHOWN = ["AVG", "MAX", "LONGEST_MATCH", "MAXIMUM_LENGTH"]


def identifiers(names: DataFrame) -> DataFrame:
    """name, id: the name with other signs than letters, digits, _ and - as _; equal ones are numbered by name."""
    plain = names.select("name").distinct().withColumn("plain", F.regexp_replace("name", r"[^A-Za-z0-9_-]", "_"))
    k = F.row_number().over(Window.partitionBy("plain").orderBy("name"))
    return plain.withColumn("k", k).select("name", F.when(F.col("k") > 1, F.concat("plain", F.lit("_"), (F.col("k") - 1).cast("string"))).otherwise(F.col("plain")).alias("id"))


def metrics(c: Comparison) -> DataFrame:
    return c.pairs.select("a", "b", *[METRICS[m](_Row()).alias(m) for m in SHOWN])


def comparison_records(c: Comparison, positions: DataFrame | None = None) -> DataFrame:
    """a, b, record: JSON of names, similarities and matches. positions (name, pos, file, line, column, end_line,
    end_column) turns token places into places in files: the least start and the greatest end of a match's tokens."""
    similarities = F.create_map(*[x for m in SHOWN for x in (F.lit(m), METRICS[m](_Row()))])
    if positions is None:
        return c.pairs.select("a", "b", F.to_json(F.struct("a", "b", similarities.alias("similarities"), "tiles")).alias("record"))
    rows = c.pairs.select("a", "b", similarities.alias("similarities"), F.posexplode("tiles").alias("k", "t"))
    out = rows
    for side in "ab":
        p = positions.select(F.col("name").alias(side), F.col("pos").alias("_p"), "file", F.struct("line", "column").alias("_s"), F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column")).alias("_e"))
        first, length = F.col(f"t.start_{side}"), F.col(f"t.length_{side}")
        held = rows.select("a", "b", "k", F.explode(F.sequence(first, first + length - 1)).alias("_p")).join(p, [side, "_p"])
        ends = held.groupBy("a", "b", "k").agg(F.struct(F.min_by("file", "_p").alias("file"), F.min("_s").alias("start"), F.max("_e").alias("end")).alias(f"place_{side}"))
        out = out.join(ends, ["a", "b", "k"], "left")
    match = F.struct("k", F.col("place_a").alias("first"), F.col("place_b").alias("second"), F.col("t.length_a").alias("length_first"), F.col("t.length_b").alias("length_second"))
    grouped = out.groupBy("a", "b").agg(F.first("similarities").alias("similarities"), F.array_sort(F.collect_list(match)).alias("matches"))
    return grouped.select("a", "b", F.to_json(F.struct("a", "b", "similarities", "matches")).alias("record"))


def base_records(c: Comparison) -> DataFrame:
    """name, record: JSON of a submission's tiles with the base code."""
    if c.base is None:
        raise ValueError("the comparison had no base code")
    return c.base.filter(F.size("tiles") > 0).select("name", F.to_json(F.struct("name", F.col("tiles").alias("matches"))).alias("record"))


def distribution(scored: DataFrame, buckets: int = 100) -> DataFrame:
    """bucket, n of similarities; 1.0 falls into the last bucket. ``buckets`` 10, 20, 25, 50 or 100."""
    bucket = F.least(F.floor(F.col("similarity") * buckets), F.lit(buckets - 1)).cast("int")
    every = scored.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").fillna(0, ["n"])


def rebucketed(found: DataFrame, buckets: int) -> DataFrame:
    """A distribution over 100 buckets in fewer ones, from the most similar on."""
    if 100 % buckets:
        raise ValueError("100 must be a multiple of the buckets")
    return found.groupBy((F.lit(buckets - 1) - F.floor(F.col("bucket") / (100 // buckets))).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))


def write_csv(c: Comparison, path: str, *, anonymous: bool = False) -> DataFrame | None:
    """submissionName1, submissionName2, averageSimilarity, maxSimilarity. anonymous: numbers by first appearance in the
    rows (most similar first), each pair's first name before its second; returns (name, id)."""
    rows = c.pairs.select("a", "b", METRICS["AVG"](_Row()).alias("average"), METRICS["MAX"](_Row()).alias("maximum"))
    mapping = None
    if anonymous:
        place = F.struct((-F.col("average")).alias("s"), "a", "b")
        seen = rows.select(F.explode(F.array(F.struct(place.alias("p"), F.lit(0).alias("k"), F.col("a").alias("name")), F.struct(place.alias("p"), F.lit(1).alias("k"), F.col("b").alias("name")))).alias("x"))
        firsts = seen.select("x.*").groupBy("name").agg(F.min(F.struct("p", "k")).alias("first"))
        mapping = numbered(firsts, "first").select("name", F.col("number").alias("id"))
        rows = rows.join(mapping.select(F.col("name").alias("a"), F.col("id").alias("ia")), "a").join(mapping.select(F.col("name").alias("b"), F.col("id").alias("ib")), "b").drop("a", "b").withColumnsRenamed({"ia": "a", "ib": "b"})
    out = rows.select(F.col("a").alias("submissionName1"), F.col("b").alias("submissionName2"), F.col("average").alias("averageSimilarity"), F.col("maximum").alias("maxSimilarity"))
    out.write.mode("overwrite").csv(path, header=True)
    return mapping


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with ``number`` from 0 in an order, by ranges: each range counts, the counts (one a range) add up."""
    part = rows.repartitionByRange(order).sortWithinPartitions(order).rdd.zipWithIndex()
    return rows.sparkSession.createDataFrame(part.map(lambda x: (*x[0], x[1])), rows.schema.add("number", "long"))


def matrix(scored: DataFrame, name: str = "name") -> DataFrame:
    """name, row: JSON of a submission's similarities to others, both ways, itself 1."""
    both = scored.select("a", "b", "similarity").unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    own = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("similarity"))
    rows = both.unionByName(own).groupBy("a").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "similarity")))).alias("row"))
    return rows.select(F.col("a").alias(name), F.to_json("row").alias("row"))


def heatmap(cells: DataFrame) -> DataFrame:
    """i, j, value of a matrix made symmetric: the mean of both ways, 1 on the diagonal."""
    both = cells.select("i", "j", "value").unionByName(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.groupBy("i", "j").agg((F.sum("value") / 2).alias("value")).withColumn("value", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("value")))


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, low, high, n of equal bins between the least and the greatest value (which falls into the last)."""
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    rows = values.select(F.col(column).alias("v")).filter("v is not null").crossJoin(F.broadcast(ends))
    step = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first(F.col("low")).alias("base"), F.first(step).alias("step")).select("bin", (F.col("base") + F.col("bin") * F.col("step")).alias("low"), (F.col("base") + (F.col("bin") + 1) * F.col("step")).alias("high"), "n")


def network(scored: DataFrame, cut: float) -> DataFrame:
    return scored.filter(F.col("similarity") > cut)


def write_vectors(vectors: DataFrame, path: str, *, vector: str = "vector", label: str = "label") -> None:
    """vectors and metadata as tab-separated text, line by line alike: both are sorted by label within the same ranges."""
    rows = vectors.repartitionByRange(label).sortWithinPartitions(label)
    rows.select(F.array_join(F.transform(vector, lambda x: x.cast("string")), "\t").alias("value")).write.mode("overwrite").text(f"{path}/vectors")
    rows.select(F.col(label).cast("string").alias("value")).write.mode("overwrite").text(f"{path}/metadata")


def text_summary(scored: DataFrame, group: Column, *, title: str = "similarity") -> DataFrame:
    """line: a text report, one row a line: per group how many, mean, median, greatest and least similarity and the bands."""
    g = scored.withColumn("g", group).groupBy("g").agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"), F.median("similarity").alias("median"), F.max("similarity").alias("top"), F.min("similarity").alias("low"), F.count_if(F.col("similarity") >= 0.9).alias("high"), F.count_if((F.col("similarity") >= 0.7) & (F.col("similarity") < 0.9)).alias("mid"), F.count_if(F.col("similarity") < 0.7).alias("rest"))
    line = F.format_string(f"%s: {title} n=%d mean=%.4f median=%.4f max=%.4f min=%.4f | >=0.9: %d (%.1f%%) 0.7-0.9: %d (%.1f%%) <0.7: %d (%.1f%%)", F.col("g").cast("string"), "n", "mean", "median", "top", "low", "high", 100 * F.col("high") / F.col("n"), "mid", 100 * F.col("mid") / F.col("n"), "rest", 100 * F.col("rest") / F.col("n"))
    return g.select(F.col("g").alias("group"), line.alias("line"))


def annotated(files: DataFrame) -> DataFrame:
    """file, line, text, marks: source lines with the tokens (array of (type, line, ...)) that begin in them."""
    lines = files.select("file", "tokens", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("k", "text"))
    mine = F.filter("tokens", lambda t: t["line"] == F.col("k") + 1)
    return lines.select("file", (F.col("k") + 1).alias("line"), "text", F.array_join(F.transform(mine, lambda t: F.concat(F.lit("|"), t["type"])), " ").alias("marks"))


def write_report(path: str, tables: dict[str, DataFrame]) -> None:
    """Each table as JSON lines under its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def archive(spark, path: str, target: str) -> int:
    """Packs the JSON files of a written report into a zip file, one at a time; how many there were."""
    import zipfile

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for table in fs.listStatus(root):
        names += [(table.getPath().getName(), f.getPath()) for f in fs.listStatus(table.getPath()) if f.getPath().getName().startswith("part-")]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (table, file) in enumerate(sorted(names, key=lambda x: (x[0], str(x[1])))):
            text = "\n".join(r["value"] for r in spark.read.text(str(file)).toLocalIterator())
            z.writestr(f"{table}/{k}.json", text)
    return len(names)
