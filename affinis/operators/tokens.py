"""Tokenisers by name, and what is read off token sequences. Column functions, but for nested comments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.operators.compare import FILE_END

# Token types of hardware description lines and what a line must hold, in order.
RTL = [
    ("MODULE_DECL", r"\bmodule\s+(\w+)"),
    ("ENDMODULE", r"\bendmodule\b"),
    ("PORT_INPUT", r"\binput\b"),
    ("PORT_OUTPUT", r"\boutput\b"),
    ("PORT_INOUT", r"\binout\b"),
    ("DECL_WIRE", r"\bwire\b"),
    ("DECL_REG", r"\breg\b"),
    ("DECL_PARAM", r"\bparameter\b"),
    ("DECL_INTEGER", r"\binteger\b"),
    ("ASSIGN_CONT", r"\bassign\b"),
    ("BLOCK_ALWAYS", r"\balways\b"),
    ("BLOCK_INITIAL", r"\binitial\b"),
    ("BLOCK_BEGIN", r"\bbegin\b"),
    ("BLOCK_END", r"\bend\b"),
    ("COND_IF", r"\bif\b"),
    ("COND_ELSE", r"\belse\b"),
    ("COND_CASE", r"\bcase\b"),
    ("ENDCASE", r"\bendcase\b"),
    ("COND_DEFAULT", r"\bdefault\b"),
    ("LOOP_FOR", r"\bfor\b"),
    ("LOOP_WHILE", r"\bwhile\b"),
    ("INST_MODULE", r"^\s*(\w+)\s+#?\s*\("),
]
# The finer list, with the length that a token of each type is given.
RTL_FINE = [
    ("MODULE_DECL", "module"), ("MODULE_END", "endmodule"), ("PORT_INPUT", "input"), ("PORT_OUTPUT", "output"), ("PORT_INOUT", "inout"),
    ("DECL_WIRE", "wire"), ("DECL_REG", "reg"), ("DECL_PARAM", "parameter"), ("DECL_INTEGER", "integer"), ("ASSIGN_CONT", "assign"),
    ("BLOCK_ALWAYS", "always"), ("BLOCK_INITIAL", "initial"), ("BLOCK_BEGIN", "begin"), ("BLOCK_END", "end"), ("COND_IF", "if"), ("COND_ELSE", "else"),
    ("COND_CASE", "case"), ("COND_ENDCASE", "endcase"), ("COND_DEFAULT", "default"), ("LOOP_FOR", "for"), ("LOOP_WHILE", "while"),
    ("LOOP_REPEAT", "repeat"), ("LOOP_FOREVER", "forever"), ("FUNCTION_DECL", "function"), ("TASK_DECL", "task"),
]
# Declarations of signals by type.
SIGNALS = {
    "input": r"(?i)\binput\s+(?:wire|reg)?\s*(?:\[.*?\])?\s*(\w+)",
    "output": r"(?i)\boutput\s+(?:wire|reg)?\s*(?:\[.*?\])?\s*(\w+)",
    "wire": r"(?i)\bwire\s+(?:\[.*?\])?\s*(\w+)",
    "reg": r"(?i)\breg\s+(?:\[.*?\])?\s*(\w+)",
    "parameter": r"(?i)\bparameter\s+(?:\[.*?\])?\s*(\w+)",
}
# Netlist cells by node type, and parts of other cells' names.
CELLS = {
    "$_AND_": "and", "$_NAND_": "unand", "$_OR_": "or", "$_NOR_": "unor", "$_NOT_": "unot", "$_XOR_": "xor", "$_XNOR_": "xnor",
    "$and": "and", "$nand": "unand", "$or": "or", "$nor": "unor", "$not": "unot", "$xor": "xor", "$xnor": "xnor",
    "$logic_and": "land", "$logic_or": "lor", "$logic_not": "ulnot", "$eq": "eq", "$ne": "noteq", "$gt": "greaterthan", "$ge": "greatereq",
    "$lt": "lessthan", "$le": "lesseq", "$add": "plus", "$sub": "minus", "$mul": "times", "$mod": "mod", "$div": "divide",
    "$sshl": "sll", "$sshr": "sra", "$shl": "sll", "$shr": "srl", "$shift": "srl", "$shiftx": "srl", "$mux": "branch", "$pmux": "branch",
}
CELL_PARTS = [("and", "and"), ("nand", "unand"), ("or", "or"), ("nor", "unor"), ("not", "unot"), ("xor", "xor"), ("xnor", "xnor"), ("mux", "branch"), ("dff", "signal"), ("latch", "signal"), ("add", "plus"), ("sub", "minus"), ("mul", "times")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")


def _skipped(line: Column) -> Column:
    bare = F.trim(line)
    return (bare == "") | bare.startswith("//") | bare.startswith("/*")


def rtl(text: Column) -> Column:
    """One token for each type that a line holds, in the order of RTL; blank and comment lines have none."""

    def of(line: Column) -> Column:
        found = F.array(*[F.when(line.rlike("(?i)" + p), F.lit(t)) for t, p in RTL])
        return F.when(_skipped(line), F.array().cast("array<string>")).otherwise(F.array_compact(found))

    return F.flatten(F.transform(_lines(text), of))


def rtl_fine(text: Column) -> Column:
    """(type, line, column, length) of the finer types; END is left out where ENDMODULE or ENDCASE stands, directives
    (`word) count too."""

    def of(line: Column, k: Column) -> Column:
        def token(kind: str, word: str) -> Column:
            hit = line.rlike(rf"(?i)\b{word}\b")
            if word == "end":
                hit = hit & ~line.rlike(r"(?i)\b(endmodule|endcase)\b")
            return F.when(hit, F.struct(F.lit(kind).alias("type"), (k + 1).alias("line"), F.lit(0).alias("column"), F.lit(len(word)).alias("length")))

        directive = F.when(line.rlike(r"^\s*`\w+"), F.struct(F.lit("DIRECTIVE").alias("type"), (k + 1).alias("line"), F.lit(0).alias("column"), F.length(F.regexp_extract(line, r"`\w+", 0)).alias("length")))
        found = F.array(*[token(t, w) for t, w in RTL_FINE], directive)
        return F.when(_skipped(line), F.array().cast("array<struct<type:string,line:int,column:int,length:int>>")).otherwise(F.array_compact(found))

    return F.flatten(F.transform(_lines(text), of))


def words(text: Column) -> Column:
    """Words with a letter or a digit, in lower case; each is a type of its own."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def code(text: Column) -> Column:
    """Tokens of most programming languages: comments go, literals become their kind, names NAME unless they are among
    the keywords of common languages, signs stand for themselves."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)//[^\n]*|/\*.*?\*/|(?m)^\s*#[^\n]*", " ")
    found = F.regexp_extract_all(clean, F.lit(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_]\w*|\d[\w.]*|[-+*/%&|^!=<>]=|&&|\|\||<<|>>|->|\S"), F.lit(0))
    keywords = "|".join(KEYWORDS)
    return F.transform(found, lambda t: F.when(t.rlike("^[\"']"), "STRING").when(t.rlike(r"^\d"), "NUMBER").when(t.rlike(f"^({keywords})$"), F.upper(t)).when(t.rlike(r"^[A-Za-z_]"), "NAME").otherwise(t))


# Words that common languages keep for themselves.
KEYWORDS = ["if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "class", "struct", "enum", "interface", "def", "func", "fn", "function", "var", "let", "const", "val", "import", "package", "using", "namespace", "public", "private", "protected", "static", "void", "int", "long", "float", "double", "char", "bool", "boolean", "string", "new", "try", "catch", "finally", "throw", "throws", "raise", "except", "with", "in", "match", "lambda", "yield", "async", "await", "null", "None", "true", "false", "self", "this", "super", "extends", "implements"]


@dataclass(frozen=True)
class Tokenizer:
    """A language: its token column, the file endings it reads, and the shortest match it counts."""

    tokens: Callable[[Column], Column]
    endings: tuple[str, ...]
    min_match: int


#: Languages by name; register() adds more.
LANGUAGES: dict[str, Tokenizer] = {
    "text": Tokenizer(words, (".txt", ".asc", ".tex", ".md"), 5),
    "verilog": Tokenizer(rtl, (".v", ".vh", ".sv"), 8),
    "verilog-fine": Tokenizer(lambda t: F.transform(rtl_fine(t), lambda x: x["type"]), (), 8),
    "c": Tokenizer(code, (".c", ".h"), 12),
    "cpp": Tokenizer(code, (".cpp", ".cc", ".cxx", ".hpp", ".hh"), 12),
    "csharp": Tokenizer(code, (".cs",), 8),
    "golang": Tokenizer(code, (".go",), 8),
    "java": Tokenizer(code, (".java",), 9),
    "javascript": Tokenizer(code, (".js", ".mjs"), 12),
    "kotlin": Tokenizer(code, (".kt",), 8),
    "python3": Tokenizer(code, (".py",), 12),
    "rlang": Tokenizer(code, (".r", ".R"), 8),
    "rust": Tokenizer(code, (".rs",), 8),
    "scala": Tokenizer(code, (".scala",), 8),
    "swift": Tokenizer(code, (".swift",), 8),
    "typescript": Tokenizer(code, (".ts",), 12),
}


def register(name: str, language: Tokenizer) -> None:
    LANGUAGES[name] = language


def tokenize(files: DataFrame, languages: list[str], *, text: str = "text", file: str = "file") -> DataFrame:
    """Files with their tokens, each by the language its ending names (the first of those given; with one language,
    every file). Files of no language are left out."""
    if len(languages) == 1:
        return files.withColumn("tokens", LANGUAGES[languages[0]].tokens(F.col(text)))
    which = F.lit(None).cast("string")
    for name in reversed(languages):
        for ending in LANGUAGES[name].endings:
            which = F.when(F.lower(file).endswith(ending.lower()), F.lit(name)).otherwise(which)
    rows = files.withColumn("language", which).filter("language is not null")
    tokens = F.lit(None).cast("array<string>")
    for name in languages:
        tokens = F.when(F.col("language") == name, LANGUAGES[name].tokens(F.col(text))).otherwise(tokens)
    return rows.withColumn("tokens", tokens)


def min_match(languages: list[str]) -> int:
    """The least of the languages', 9 without any."""
    return min((LANGUAGES[n].min_match for n in languages), default=9)


def submissions(files: DataFrame, *, name: str = "submission", file: str = "file") -> DataFrame:
    """name, tokens: the tokens of a submission's files in order of their names, each file closed by FILE_END."""
    ended = F.transform(F.array_sort(F.collect_list(F.struct(F.col(file).alias("f"), F.col("tokens").alias("t")))), lambda x: F.concat(x["t"], F.array(F.lit(FILE_END))))
    others = [F.max("is_new").alias("is_new")] if "is_new" in files.columns else []
    return files.groupBy(F.col(name).alias("name")).agg(F.flatten(ended).alias("tokens"), *others)


def dictionary(rows: DataFrame) -> DataFrame:
    """token, id: dense numbers by first appearance, over (name, position). Ranked once a range, not in one task."""
    firsts = rows.select("name", F.posexplode("tokens").alias("pos", "token")).groupBy("token").agg(F.min(F.struct("name", "pos")).alias("first"))
    ordered = firsts.repartitionByRange("first").sortWithinPartitions("first").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    kept = ordered.checkpoint() if ordered.sparkSession.sparkContext.getCheckpointDir() else ordered.persist()
    sizes = sorted((r["part"], r["n"], r["low"]) for r in kept.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect())
    base, offset = {}, 0
    for part, n, low in sizes:
        base[part] = offset - low
        offset += n
    shift = F.create_map(*[F.lit(v).cast("long") if k % 2 else F.lit(v) for p, o in base.items() for k, v in enumerate((p, o))]) if base else None
    return kept.select("token", (F.col("at") + shift[F.col("part")]).alias("id") if base else F.lit(0).cast("long").alias("id"))


def signals(text: Column) -> Column:
    """Distinct (type, name) of declared signals, sorted."""
    def of(kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
        return F.transform(names, lambda s: F.struct(F.lit(kind).alias("type"), s.alias("name")))

    return F.array_sort(F.array_distinct(F.flatten(F.array(*[of(k, p) for k, p in SIGNALS.items()]))))


def is_clock(name: Column) -> Column:
    return F.lower(name).rlike("clk|clock")


def is_reset(name: Column) -> Column:
    return F.lower(name).rlike("reset|rst")


def is_state(name: Column) -> Column:
    return F.lower(name).rlike("fsm|state|count|cnt|step|mode")


def in_truth(signal: Column, truth: Column) -> Column:
    """Whether a list of true signals holds this one, or one that ends in a point and it."""
    return F.exists(truth, lambda g: (g == signal) | g.endswith(F.concat(F.lit("."), signal)))


def variable(name: Column) -> Column:
    """What stands before a rename mark; of that the last part after a point, or after an underscore, or all in lower case."""
    plain = F.regexp_replace(name, "_r[nm]_.*$", "")
    return F.when(plain.contains("."), F.element_at(F.split(plain, r"\."), -1)).when(plain.contains("_"), F.element_at(F.split(plain, "_"), -1)).otherwise(F.lower(plain))


def node_type(name: Column, n_in: Column, n_out: Column) -> Column:
    """numeric, output, input, signal, or an operator's name in lower case; the first rule that fits."""
    plain = F.regexp_replace(name, "_rn.*$", "")
    return F.when(plain.rlike("'[dboh]"), "numeric").when(n_in == 0, "output").when(n_out == 0, "input").when(plain.rlike("[._]"), "signal").otherwise(F.lower(plain))


def cell_type(cell: Column) -> Column:
    """The node type of a netlist cell: by its name, else by a part of it, else signal."""
    exact = F.create_map(*[F.lit(x) for kv in CELLS.items() for x in kv])[cell]
    bare = F.lower(F.regexp_replace(cell, r"^\$*_*", ""))
    part = F.lit("signal")
    for word, kind in reversed(CELL_PARTS):
        part = F.when(bare.contains(word), kind).otherwise(part)
    return F.coalesce(exact, part)
