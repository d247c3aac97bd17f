"""Sources of submissions: directories of files, ground-truth CSV, netlist JSON, result matrices."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_submissions(spark: SparkSession, roots: dict[str, bool], *, suffixes: list[str] | None = None, exclude: list[str] | None = None, subdirectory: str | None = None) -> DataFrame:
    """submission, file, text, is_new of the files under each root (path: whether it is new); a submission is a child of
    a root, named with its root if there are several. A root given as new and old counts as new."""
    parts = []
    for root, is_new in sorted(roots.items()):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
        inner = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
        name = F.split_part(inner, F.lit("/"), F.lit(1))
        base = root.rstrip("/").rsplit("/", 1)[-1]
        rows = rows.select((F.concat(F.lit(base + "/"), name) if len(roots) > 1 else name).alias("submission"), inner.alias("file"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"), F.lit(is_new).alias("is_new"))
        if subdirectory:
            rows = rows.filter(F.split_part("file", F.lit("/"), F.lit(2)) == subdirectory)
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if suffixes:
        out = out.filter(F.lower("file").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))
    for e in exclude or []:
        out = out.filter(~F.col("file").endswith(e))
    return out


def scan_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """circuit, signals (a sorted set) of a CSV idx, circuit_name, signal_name without comment rows and headers."""
    rows = spark.read.csv(path, schema="idx string, circuit string, signal string")
    return rows.filter(~F.col("idx").startswith("#") & (F.col("idx") != "idx")).groupBy("circuit").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


_NETLIST = "modules map<string, struct<cells: map<string, struct<type: string, port_directions: map<string, string>, connections: map<string, array<string>>>>>>"


def scan_netlist(spark: SparkSession, path: str) -> DataFrame:
    """Edges (module, src, dst) between nets and cells of netlist JSON: into cells by inputs, out of them by outputs."""
    rows = spark.read.json(path, schema=_NETLIST, multiLine=True).select(F.explode("modules").alias("module", "m"))
    cells = rows.select("module", F.explode("m.cells").alias("cell", "c"))
    ports = cells.select("module", "cell", "c.port_directions", F.explode("c.connections").alias("port", "bits"))
    nets = ports.select("module", "cell", F.col("port_directions")[F.col("port")].alias("way"), F.explode("bits").alias("net"))
    into = F.col("way") == "input"
    return nets.select("module", F.when(into, F.col("net")).otherwise(F.col("cell")).alias("src"), F.when(into, F.col("cell")).otherwise(F.col("net")).alias("dst"))


def scan_result_matrix(matrix: DataFrame, name: str = "name") -> DataFrame:
    """Pairs (a, b, similarity) above the diagonal of a square matrix with a name column, most similar first."""
    others = [c for c in matrix.columns if c != name]
    long = matrix.unpivot([name], others, "b", "similarity").withColumnRenamed(name, "a")
    order = F.array(*[F.lit(o) for o in others])
    return long.filter(F.array_position(order, F.col("a")) < F.array_position(order, F.col("b"))).orderBy(F.desc("similarity"), "a", "b")
