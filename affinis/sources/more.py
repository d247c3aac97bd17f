"""Further sources: text of unknown encoding, result tables of other runs, graph caches, run configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Encodings that are tried one after the other, and marks at the start of a text.
ENCODINGS = ["utf-8", "gbk", "latin-1"]
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]


def decoded(content: bytes | None) -> str:
    """Text by its byte order mark, which goes; else by the first encoding that has no error."""
    content = content or b""
    for mark, name in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def text_of(content: Column | str) -> Column:
    """decoded() of a binary column."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(decoded)

    return F.pandas_udf(run, StringType())(content)


def scan_text(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """path, text of all files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", text_of("content").alias("text"))


def truth_rows(spark: SparkSession, path: str, *, circuits: Column | None = None) -> DataFrame:
    """circuit, signals of ground-truth CSV files in any of ENCODINGS; rows whose first field is empty, 'idx' or begins
    with # are left out."""
    lines = scan_text(spark, path).select(F.explode(F.split("text", "\r?\n")).alias("line"))
    parts = F.from_csv("line", F.lit("idx string, circuit string, signal string"))
    rows = lines.select(parts.alias("r")).select("r.*").filter("idx is not null and idx <> '' and idx <> 'idx' and not startswith(idx, '#') and circuit is not null")
    return rows.groupBy(F.trim("circuit").alias("circuit")).agg(F.array_sort(F.collect_set(F.trim("signal"))).alias("signals"))


def without_base(submissions: DataFrame, base: DataFrame) -> DataFrame:
    """Submissions (submission, ...) without the one that holds the base code."""
    return submissions.join(base.select("submission").distinct(), "submission", "left_anti")


def merged_roots(new: DataFrame, old: DataFrame) -> DataFrame:
    """Files (root, ...) of new and old roots with is_new; a root given as both is new."""
    known = new.select("root").distinct()
    return new.withColumn("is_new", F.lit(True)).unionByName(old.join(known, "root", "left_anti").withColumn("is_new", F.lit(False)))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge rows as Parquet, by circuit where there is such a column."""
    for name, rows in (("nodes", nodes), ("edges", edges)):
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("circuit") if "circuit" in rows.columns else writer).parquet(f"{path}/{name}")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def netlist_nodes(spark: SparkSession, path: str) -> DataFrame:
    """module, node, kind (port, net or cell) and type of netlist JSON: ports by direction, cells by the node type table."""
    from affinis.operators.tokens import cell_type

    schema = "modules map<string, struct<ports: map<string, struct<direction: string, bits: array<string>>>, cells: map<string, struct<type: string, port_directions: map<string, string>, connections: map<string, array<string>>>>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("modules").alias("module", "m"))
    ports = rows.select("module", F.explode("m.ports").alias("node", "p")).select("module", "node", F.lit("port").alias("kind"), F.col("p.direction").alias("type"))
    cells = rows.select("module", F.explode("m.cells").alias("node", "c"))
    nets = cells.select("module", F.explode(F.map_values("c.connections")).alias("bits")).select("module", F.explode("bits").alias("node")).distinct()
    return ports.unionByName(cells.select("module", "node", F.lit("cell").alias("kind"), cell_type(F.col("c.type")).alias("type"))).unionByName(nets.select("module", "node", F.lit("net").alias("kind"), F.lit("signal").alias("type")))


@dataclass(frozen=True)
class Settings:
    """A run's settings: defaults, then a file, then what is given by name."""

    roots: tuple[str, ...] = ()
    old_roots: tuple[str, ...] = ()
    base_code: str | None = None
    languages: tuple[str, ...] = ("text",)
    min_match: int | None = None
    similarity_threshold: float = 0.0
    metric: str = "AVG"
    shown: int = 2500
    merging: bool = False
    neighbour: int = 2
    max_gap: int = 6
    required_merges: int = 6
    clustering: str = "AGGLOMERATIVE"
    preprocessor: str = "NONE"
    cluster_threshold: float = 0.2
    linkage: str = "AVERAGE"
    frequency: str | None = None
    weighting: str = "SIGMOID"
    weighting_factor: float = 0.25
    subdirectory: str | None = None
    suffixes: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    result: str | None = None
    extra: dict = field(default_factory=dict)


def settings(path: str | None = None, **given) -> Settings:
    """Settings from a file of ``name: value`` lines (YAML without nesting; lists in brackets) and arguments, which win.
    Unknown names are kept in extra."""
    held: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.split(" #")[0].strip()
                if line and not line.startswith("#") and ":" in line:
                    name, value = (x.strip() for x in line.split(":", 1))
                    held[name.replace("-", "_")] = _value(value)
    held |= {k: v for k, v in given.items() if v is not None}
    known = {f.name for f in fields(Settings)}
    out = replace(Settings(), **{k: tuple(v) if isinstance(v, list) else v for k, v in held.items() if k in known})
    return replace(out, extra={k: v for k, v in held.items() if k not in known})


def _value(text: str):
    if text.startswith("[") and text.endswith("]"):
        return [_value(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text.strip("'\"")
