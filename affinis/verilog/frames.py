"""The Verilog front end on DataFrames: one design (a folder of files) at a time in a task, designs side by side.

Every function takes rows (design, path, text), in any number of designs, and returns rows led by ``design``. A design's
files must fit one task; designs are dealt by name. A design that can't be read gives one row in ``problems`` and none
elsewhere; null texts count as empty, repeated rows of a path are read once, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.verilog import control, dataflow, text as texts
from affinis.verilog.elaborate import Design, bit_ranges, elaborate
from affinis.verilog.syntax import Node, VerilogError, flat, parse, written, written_module


def _by_design(files: DataFrame, schema: str, rows: Callable[[pd.DataFrame], Iterator[tuple]], failed: bool = False) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        try:
            found = list(rows(group.drop_duplicates("path").sort_values("path")))
            out = [] if failed else [(key[0], *r) for r in found]
        except (VerilogError, ValueError, KeyError, RecursionError) as e:
            out = [(key[0], str(e))] if failed else []
        return pd.DataFrame(out, columns=["design", *names])

    source = files.select("design", F.col("path").cast("string").alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return source.groupBy("design").applyInPandas(run, "design string, " + schema)


def _modules(group: pd.DataFrame) -> list[Node]:
    files = {p.rsplit("/", 1)[-1]: t for p, t in zip(group.path, group.text, strict=True)}
    return [m for t in group.text for m in parse(texts.preprocessed(t, None, files))]


def _design(group: pd.DataFrame) -> Design:
    return elaborate(_modules(group))


def scan_designs(files: DataFrame) -> DataFrame:
    """Files with ``design``, the folder they lie in; only those that end in .v (any case)."""
    rows = files.filter(F.lower("path").endswith(".v"))
    return rows.withColumn("design", F.regexp_replace("path", "/[^/]*$", ""))


def problems(files: DataFrame) -> DataFrame:
    """(design, message) of designs that can't be read."""
    return _by_design(files, "message string", lambda g: iter(_design(g).binds and ()), failed=True)


def syntax_rows(files: DataFrame) -> DataFrame:
    """The syntax tree of each module, in preorder."""
    return _by_design(files, "module string, id long, parent long, slot long, kind string, value string, line long", lambda g: ((m.value, *r) for m in _modules(g) for r in flat(m)))


def syntax_edges(files: DataFrame) -> DataFrame:
    """The syntax tree as a labelled graph: nodes by number, edges from parent to child."""
    rows = syntax_rows(files)
    child = rows.select("design", "module", F.col("id").alias("dst"), F.col("kind").alias("dst_kind"), F.col("parent").alias("src")).filter("src is not null")
    return child.join(rows.select("design", "module", F.col("id").alias("src"), F.col("kind").alias("src_kind")), ["design", "module", "src"])


def instances(files: DataFrame) -> DataFrame:
    return _by_design(files, "path string, module string", lambda g: iter(_design(g).instances))


def terms(files: DataFrame) -> DataFrame:
    return _by_design(files, "name string, kinds string, msb long, lsb long, width long", lambda g: ((t.name, ",".join(sorted(t.kinds)), t.msb, t.lsb, t.width) for t in _design(g).terms.values()))


def binds(files: DataFrame) -> DataFrame:
    schema = "dest string, kind string, tree string, msb long, lsb long, clock string, edge string, reset string, reset_edge string"
    return _by_design(files, schema, lambda g: ((b.dest, b.kind, written(b.tree), b.msb, b.lsb, b.clock, b.edge, b.reset, b.reset_edge) for b in _design(g).binds))


def driven_bits(files: DataFrame) -> DataFrame:
    """Of each signal, which tree drives which bits; later binds win, null is undefined."""

    def rows(g: pd.DataFrame) -> Iterator[tuple]:
        d = _design(g)
        for name in sorted({b.dest for b in d.binds if b.index is None}):
            for high, low, b in bit_ranges([b for b in d.drivers(name) if b.index is None], d.terms[name].width if name in d.terms else 1):
                yield name, high, low, written(b.tree) if b else None

    return _by_design(files, "dest string, msb long, lsb long, tree string", rows)


def graph_nodes(files: DataFrame) -> DataFrame:
    return _by_design(files, "name string, label string, type string", lambda g: iter(dataflow.graph(_design(g))[0]))


def graph_edges(files: DataFrame, *, merge_aliases: bool = True) -> DataFrame:
    """Edges from a signal or operator to what drives it, with VAR, MSB, LSB, PTR, COND, TRUE or FALSE."""

    def rows(g: pd.DataFrame) -> Iterator[tuple]:
        nodes, edges = dataflow.graph(_design(g))
        return iter(dataflow.aliases_merged(nodes, edges) if merge_aliases else edges)

    return _by_design(files, "src string, dst string, label string", rows)


def slices(files: DataFrame, targets: list[str]) -> DataFrame:
    """The binds that targets depend on, by kind, with the text that generates each kind."""

    def rows(g: pd.DataFrame) -> Iterator[tuple]:
        for kind, some in dataflow.slice_kinds(dataflow.slice_of(_design(g), targets)).items():
            yield kind, sorted({b.dest for b in some}), dataflow.generated(some)

    return _by_design(files, "kind string, dests array<string>, code string", rows)


def inlined_trees(files: DataFrame, steps: int = 1000) -> DataFrame:
    """Each driven signal in terms of inputs and registers, with the signals it reads."""

    def rows(g: pd.DataFrame) -> Iterator[tuple]:
        d = _design(g)
        for name in sorted({b.dest for b in d.binds}):
            tree = dataflow.inlined(d, name, steps)
            yield name, written(tree), sorted(dataflow.sources(tree))

    return _by_design(files, "dest string, tree string, sources array<string>", rows)


def path_conditions(files: DataFrame) -> DataFrame:
    """Every way through a bind's branches: its conditions, its value, and whether the signal changes."""

    def rows(g: pd.DataFrame) -> Iterator[tuple]:
        for b in _design(g).binds:
            for way, leaf in control.paths(b.tree):
                yield b.dest, [written(t) if holds else f"(!{written(t)})" for t, holds in way], written(leaf), not (leaf.kind == "id" and leaf.value == b.dest)

    return _by_design(files, "dest string, conditions array<string>, value string, changes boolean", rows)


def state_machines(files: DataFrame) -> DataFrame:
    """Transitions (register, src, dst, condition); a null condition always holds."""
    return _by_design(files, "register string, src long, dst long, condition string", lambda g: ((n, *m) for n, moves in control.machines(_design(g)).items() for m in moves))


def state_loops(files: DataFrame) -> DataFrame:
    return _by_design(files, "register string, states array<long>", lambda g: ((n, list(way)) for n, moves in control.machines(_design(g)).items() for way in control.loops(moves)))


def control_flow_records(files: DataFrame) -> DataFrame:
    """One JSON record a machine: its states, those without a way in, and its transitions."""
    moves = state_machines(files)
    states = moves.groupBy("design", "register").agg(F.array_sort(F.collect_set("src")).alias("s"), F.array_sort(F.collect_set("dst")).alias("d"), F.array_sort(F.collect_list(F.struct("src", "dst", "condition"))).alias("transitions"))
    record = F.struct("register", F.array_sort(F.array_union("s", "d")).alias("nodes"), F.array_except("s", "d").alias("roots"), "transitions")
    return states.select("design", "register", F.to_json(record).alias("record"))


def generated_code(files: DataFrame) -> DataFrame:
    """Each module printed from its syntax tree."""
    return _by_design(files, "module string, code string", lambda g: ((m.value, written_module(m)) for m in _modules(g)))
