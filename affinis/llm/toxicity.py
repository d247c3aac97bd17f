"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows around each hit.

The lexicon (whole words, and stems that take endings) and the weights are learned from labelled rows. A word of a text
is an automaton that accepts what lies within so many edits; walking it along the trie finds every lexicon term it may
be a misspelling of. A window of words around each hit tells quotation from abuse.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import Scratch, arrow_limits, release

#: Most labelled rows that are fitted (by a hash of doc_id, so any table's sample is random; it bounds the lexicon too),
#: and words on each side of a hit that make its context window.
MAX_FIT, CONTEXT = 20_000, 8
#: Distinct words that a worker keeps looked up.
CACHE = 600_000
#: A term must be so many times likelier in toxic rows, stand in so large a share of them, and be so unlikely (log) to
#: stand in toxic rows alone by chance. The shortest stem.
RATIO, LEAST_SHARE, LEAST_LOG = 20.0, 0.004, 13.0
STEM_LEAST = 3

_WORD = re.compile(r"\w+")
# Marks that open or close quotations, and words that report speech.
_QUOTES = "\"“”„«»‹›‘’'`"
_REPORTING = ["said", "says", "called", "calls", "quote", "quoted", "wrote", "word", "term", "dit", "appelle", "mot", "sagte", "nannte", "wort", "dijo", "llamó", "palabra"]


def edits(term: str) -> int:
    """Edits at which a term still counts as meant: none for short ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LevenshteinAutomaton:
    """Non-deterministic automaton of a word; a state is one bit mask of positions for each number of edits."""

    def __init__(self, word: str, most: int):
        self.length, self.most = len(word), most
        self.at: dict[str, int] = {}
        for k, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << k
        first = [1]
        for _ in range(most):
            first.append(first[-1] | first[-1] << 1)
        self.start, self.inside = tuple(first), (1 << (self.length + 1)) - 1

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        same = self.at.get(char, 0)
        out = [(state[0] & same) << 1]
        for e in range(1, self.most + 1):
            out.append(((state[e] & same) << 1 | state[e - 1] | state[e - 1] << 1 | out[e - 1] << 1) & self.inside)
        return tuple(out)

    def edits_at_end(self, state: tuple[int, ...]) -> int | None:
        return next((e for e in range(self.most + 1) if state[e] >> self.length & 1), None)

    def edits_anywhere(self, state: tuple[int, ...]) -> int | None:
        return next((e for e in range(self.most + 1) if state[e]), None)


class Lexicon:
    """Terms with a weight each, in a trie; stems end in "*" and match words that begin so."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.root: dict = {}
        pieces = set()
        for term in weights:
            node = self.root
            plain = term.rstrip("*")
            for c in plain:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(term)
            n = edits(plain) + 1  # with one edit fewer than parts, one part is left whole
            pieces |= {plain[len(plain) * k // n : len(plain) * (k + 1) // n] for k in range(n)}
        self.may = re.compile("|".join(map(re.escape, sorted(pieces)))) if pieces else None
        self.most = max((edits(t.rstrip("*")) for t in weights), default=0)

    def find(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits (then the largest weight, then by name) and those edits."""
        if not self.may or not self.may.search(word):
            return None
        auto, best = LevenshteinAutomaton(word, self.most), None
        stack = [(self.root, auto.start)]
        while stack:
            node, state = stack.pop()
            for char, below in node.items():
                if char == "":
                    for term in below:
                        got = auto.edits_anywhere(state) if term[-1] == "*" else auto.edits_at_end(state)
                        if got is not None and got <= edits(term.rstrip("*")):
                            key = (got, -self.weights[term], term)
                            best = key if best is None or key < best else best
                elif any(after := auto.step(state, char)):
                    stack.append((below, after))
        return (best[2], best[0]) if best else None


class _Known(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = self.lexicon.find(word)
        return out


FEATURES = ["abuse", "quoted", "misspelt", "misspelt_quoted", "dense", "close"]


def features(text: str, known: _Known) -> list[float]:
    """What the context windows of a whole text add up to; all 0 without a hit."""
    low = text.lower()
    words = _WORD.findall(low)
    found = list(map(known.__getitem__, words))
    hits = [k for k, f in enumerate(found) if f]
    if not hits:
        return [0.0] * len(FEATURES)
    spans, at, wanted = {}, 0, set(hits)
    for k, m in enumerate(_WORD.finditer(low)):
        if k in wanted:
            spans[k] = m.span()
    weight = known.lexicon.weights
    sums, close = [0.0] * 4, 0
    for at, k in enumerate(hits):
        term, wrong = found[k]
        a, b = spans[k]
        around = low[max(0, a - 2) : a], low[b : b + 2]
        marked = any(c in _QUOTES for c in around[0]) and any(c in _QUOTES for c in around[1])
        told = any(w in _REPORTING for w in words[max(0, k - CONTEXT) : k])
        near = (at > 0 and k - hits[at - 1] <= CONTEXT) + (at + 1 < len(hits) and hits[at + 1] - k <= CONTEXT)
        quoted = marked or (told and not near)
        close += near > 0
        sums[2 * (wrong > 0) + quoted] += weight[term]
    return [*map(float, np.log1p(sums)), float(np.log1p(100.0 * len(hits) / len(words))), float(np.log1p(close))]


@dataclass
class ToxicityModel:
    """A lexicon with weights, and logistic weights of the features."""

    weights: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    intercept: float = -3.0


def _score(model: ToxicityModel, x: np.ndarray) -> np.ndarray:
    z = x @ np.asarray(model.coefficients) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(texts: pd.Series) -> Counter:
    """In how many texts each word stands, and each stem of one ("stem*")."""
    out: Counter = Counter()
    for t in texts:
        own = set()
        for w in set(_WORD.findall((t or "").lower())):
            own.add(w)
            own.update(w[:k] + "*" for k in range(STEM_LEAST, len(w)))
        out.update(own)
    return out


def _lexicon(train: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Terms that mark toxic rows: candidates from those rows, then counted in the others."""
    if not toxic or not clean:
        return {}

    def per_task(wanted: frozenset | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got: Counter = Counter()
            for b in batches:
                found = _terms(b["text"])
                got.update({k: v for k, v in found.items() if k in wanted} if wanted is not None else found)
            yield pd.DataFrame({"term": list(got), "n": list(got.values())}).astype({"n": "int64", "term": "object"})
            got.clear()
            release()

        return run

    least = max(2.0, LEAST_SHARE * toxic, LEAST_LOG / np.log((toxic + clean) / toxic))
    rows = train.filter("toxic = 1").select("text").mapInPandas(per_task(None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    common = {r["term"]: r["n"] for r in rows.collect()}
    others = train.filter("toxic = 0").select("text").mapInPandas(per_task(frozenset(common)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    in_clean = {r["term"]: r["n"] for r in others.collect()}
    ratio = {t: (n / toxic) / ((in_clean.get(t, 0) + 0.5) / clean) for t, n in common.items()}
    marked = {t for t, r in ratio.items() if r >= RATIO}
    chosen: dict[str, float] = {}
    below = defaultdict(list)
    for t in marked:
        below[(t[:-2] if t[-1] == "*" else t[:-1]) + "*"].append(t)

    def ends(stem: str) -> bool:
        """Whether a stem takes many endings: no longer stem or word has nearly all its rows."""
        top = max([common[x] for x in below[stem]] + [common.get(stem[:-1], 0)], default=0)
        return top < 0.6 * common[stem]

    for t in sorted((t for t in marked if t[-1] == "*"), key=lambda t: (len(t), t)):
        if not any(t[:k] + "*" in chosen for k in range(STEM_LEAST, len(t) - 1)) and len(t) >= STEM_LEAST + 1 and ends(t):
            chosen[t] = ratio[t]
    for t in marked:
        if t[-1] != "*" and not any(t[:k] + "*" in chosen for k in range(STEM_LEAST, len(t) + 1)):
            chosen[t] = ratio[t]
    return {t: float(np.log(chosen[t])) for t in sorted(chosen, key=lambda t: (-common[t], t))}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT) -> ToxicityModel:
    """Learns lexicon and weights from at most ``max_fit`` labelled rows (the bound of what is sampled).

    docs: doc_id, text; labels: doc_id, toxic (rows to learn from only). Rows without a label or text are left out; with
    labels of one kind or none the model scores every text alike, low unless all known rows are toxic.
    """
    arrow_limits(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic in (0, 1)")
    marks = marks.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_fit)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "_id").filter("text is not null")
    scratch = Scratch(docs.sparkSession, "toxicity")
    train = scratch.keep(_without_copies(scratch.keep(rows, "rows")), "train")
    scratch.drop("rows")
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    model = ToxicityModel(weights=_lexicon(train, toxic, clean))
    if toxic and not clean:
        model.intercept = 3.0
    if toxic and clean:
        x = _features_of(train, model, "toxic").toPandas()
        model.coefficients, model.intercept = _logistic(np.stack(x["x"]).astype(float), x["toxic"].to_numpy(float))
    scratch.drop("train")
    return model


def _without_copies(rows: DataFrame) -> DataFrame:
    """Rows of which none shares a hash minimum of its three-word shingles with another: near copies are no evidence
    of their own. Texts that are no copies of each other share hardly any such shingle."""
    from affinis.llm.minhash import minima, shingle_sets

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), 3)
            out = np.zeros((b.num_rows, 4), np.uint64)
            out[sets.counts > 0] = minima(sets, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, k].astype(np.int64)) for k in range(4))], names=["_id", "k0", "k1", "k2", "k3"])

    left = rows.select("_id", "text").mapInArrow(keys, "_id long, k0 long, k1 long, k2 long, k3 long")
    for k in range(4):
        left = left.groupBy(f"k{k}").agg(F.min(F.struct("_id", "k0", "k1", "k2", "k3")).alias("r")).select("r.*")
    return rows.join(left.select("_id"), "_id", "left_semi")


def _features_of(df: DataFrame, model: ToxicityModel, keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(Lexicon(model.weights))
        for b in batches:
            x = [features(t or "", known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])

    return df.select(keep, "text").mapInArrow(run, f"{keep} {dict(df.dtypes)[keep]}, x array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row, one row per row, without a shuffle.

    Null and empty texts have no hit and get the score of the intercept alone; null ids stay null; rows may repeat; an
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(Lexicon(model.weights))
        for b in batches:
            x = np.array([features(t or "", known) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_score(model, x), pa.float64())], names=["doc_id", "score"])
        known.clear()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, with their columns as they are; no shuffle."""
    arrow_limits(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(Lexicon(model.weights))
        for b in batches:
            x = np.array([features(t or "", known) for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(_score(model, x) < threshold, pa.bool_()))
        known.clear()
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
