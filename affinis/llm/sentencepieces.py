"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

A merge-type encoding is the only sequence of pieces in which every two neighbours are compatible: merging their joined
text from its characters gives just the two back. So an Aho-Corasick automaton proposes the longest piece at each
place, compatibility with the piece before is checked by re-merging (once per pair), a shorter piece follows where it
fails, and a bitfield keeps the places from which no piece led on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import RunCache, arrow_limits, chunks, code_points

MARK = "▁"
#: Distinct words, and pairs of pieces, that a worker keeps.
CACHE = 900_000
#: Code points below this have a row in the table of neighbours.
NARROW = 0x400
#: Characters split at once, unless one text has more.
CHUNK = 1 << 21


class PieceModel:
    """Pieces and scores of a BPE model with byte fallback and a dummy prefix, as its library reads them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.find = ahocorasick.Automaton()
        for p in self.ids:
            self.find.add_word(p, p)
        self.find.make_automaton()
        # No piece holds a mark behind another character, nor a line end: what stands on either side can't merge.
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("this model has pieces over word ends; its texts can't be cut at white space")
        self.single = {p for p in self.ids if len(p) == 1}
        self.adjacent = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        # Which characters stand side by side in some piece; those from NARROW on count as one that may stand by any.
        self.near = np.zeros((NARROW + 1, NARROW + 1), bool)
        self.near[NARROW], self.near[:, NARROW] = True, True
        for a, b in self.adjacent:
            x, y = (0x20 if c == MARK else min(ord(c), NARROW) for c in (a, b))
            self.near[x, y] = True
        self.parts: dict[str, tuple[list[int], str]] = {}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.steps: dict[str, list[tuple[float, str, str]] | None] = {}
        self.words = _Words(self)
        self.runs = RunCache(self._marked, CACHE)

    def merges(self, text: str) -> list[tuple[float, str, str]] | None:
        """The merges of a piece's own text, best score first and leftmost among equals: the score of each, and the
        first and the last part after it. None if they don't end in the piece."""
        score, none = self.scores.get, float("-inf")
        parts, out = list(text), []
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) != none:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = score(parts[k] + parts[k + 1], none)
            out.append((best, parts[0], parts[-1]))
        return out if len(parts) == 1 else None

    def _steps(self, piece: str) -> list[tuple[float, str, str]] | None:
        if piece not in self.steps:
            if len(self.steps) >= CACHE:
                self.steps.clear()
            self.steps[piece] = self.merges(piece)
        return self.steps[piece]

    def _fits(self, left: str, right: str) -> bool:
        found = self.compatible.get((left, right))
        if found is None:
            if len(self.compatible) >= CACHE:
                self.compatible.clear()
            found = self.compatible[left, right] = self._remerged(left, right)
        return found

    def _remerged(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives just the two back. Away from the border, each merges as it
        does alone, so their merges are taken side by side in order of score (the left one's first among equals), and
        the pair is unfit once the parts that meet at the border would merge before the next of them."""
        a, b = self._steps(left), self._steps(right)
        if a is None or b is None:
            return False
        score, none = self.scores.get, float("-inf")
        i, j, end, start = 0, 0, left[-1], right[0]
        border = score(end + start, none)
        while True:
            x, y = a[i][0] if i < len(a) else none, b[j][0] if j < len(b) else none
            if border != none and (border > max(x, y) or border == y > x):
                return False
            if x == none and y == none:
                return True
            if x >= y:
                if a[i][2] != end:
                    end = a[i][2]
                    border = score(end + start, none)
                i += 1
            else:
                if b[j][1] != start:
                    start = b[j][1]
                    border = score(end + start, none)
                j += 1

    def split(self, text: str) -> list[str]:
        """The pieces of a text; a character that no piece holds stands for itself."""
        n = len(text)
        at: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.find.iter(text):
            at[end + 1 - len(piece)].append(piece)  # by rising length
        if not self.single.issuperset(text):
            for k, found in enumerate(at):
                if text[k] not in self.single:
                    found.insert(0, text[k])
        known, out, tried, pos, choice = self.compatible, [], [], 0, len(at[0])
        failed = 0  # a bitfield of places from which no piece led on
        while pos < n:
            here = at[pos]
            while choice:
                choice -= 1
                piece = here[choice]
                if failed and failed >> (pos + len(piece)) & 1:
                    continue
                if not out:
                    break
                fits = known.get((out[-1], piece))
                if fits or (fits is None and self._fits(out[-1], piece)):
                    break
            else:
                failed |= 1 << pos
                pos -= len(out.pop())
                choice = tried.pop()
                continue
            out.append(piece)
            tried.append(choice)
            pos += len(piece)
            if pos < n:
                choice = len(at[pos])
        return out

    def encode_word(self, word: str) -> tuple[list[int], str]:
        """Ids of a word, and their text."""
        try:
            parts = self.split(word)
            ids = [self.ids[p] for p in parts]
            return ids, "".join(parts).replace(MARK, " ")
        except KeyError:  # bytes stand for a character that no piece holds
            ids = [i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")])]
            return ids, self.decode_ids(ids)

    def decode_ids(self, ids: list[int]) -> str:
        """The text of ids, the dummy prefix's blank included; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join([bytes([self.bytes_of[i]]) if i in self.bytes_of else self.pieces[i].replace(MARK, " ").encode() for i in ids])
        return raw.decode("utf-8", "replace")

    def cut_word(self, word: str) -> tuple[list[int], str]:
        """encode_word, in parts wherever two neighbours stand side by side in no piece, so that parts repeat more."""
        if word.isalpha() or self.adjacent.issuperset(zip(word, word[1:], strict=False)):
            return self.encode_word(word)
        ids, texts, start = [], [], 0
        for k in range(1, len(word) + 1):
            if k == len(word) or (word[k - 1], word[k]) not in self.adjacent:
                got = self.parts.get(word[start:k])
                if got is None:
                    if len(self.parts) >= CACHE:
                        self.parts.clear()
                    got = self.parts[word[start:k]] = self.encode_word(word[start:k])
                ids += got[0]
                texts.append(got[1])
                start = k
        return ids, "".join(texts)

    def encode(self, text: str) -> tuple[list[list[int]], str]:
        """Ids word by word, and their text."""
        if not text:
            return [], ""
        words = self.words
        found = []
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            if k:
                found.append(words["\n"])
                if not line:
                    continue
            parts = line.split(" ")
            if "" in parts[1:] or (k == 0 and parts[0] == "" and len(parts) > 1):  # blanks in a row, or at an end
                line, run = (" " if k == 0 else "") + line, 0
                for p in line.split(" "):
                    if p:
                        found.append(words[" " * run + p])
                        run = 0
                    run += 1
                if run > 1:
                    found.append(words[" " * (run - 1)])
                continue
            if k == 0:
                found.append(words[" " + parts[0]])
            elif parts[0]:
                found.append(words[parts[0]])
            found += map(words.__getitem__, [" " + p for p in parts[1:]])
        return [f[0] for f in found], "".join([f[1] for f in found])[1:]


    def _marked(self, words: list[str]) -> list[tuple[list[int], bool]]:
        """Ids of each word, and whether they decode to something else than the word."""
        out = []
        for w in words:
            plain = w.replace(" ", MARK)
            ids, back = self.encode_word(plain) if w.isascii() else self.cut_word(plain)
            out.append((ids, back != w))
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts end to end, how many each has, and what each text's ids decode to."""
        ids, counts, decoded = [], np.zeros(len(texts), np.int64), []
        for a, b in chunks([len(t) for t in texts], CHUNK):
            some = [t.replace(MARK, " ") if MARK in t else t for t in texts[a:b]]
            joined = "".join([" " + t if t else "" for t in some])  # the dummy prefix
            size = np.array([len(t) + 1 if t else 0 for t in some], np.int64)
            cp = code_points(joined)
            blank, line = cp == 0x20, cp == 0x0A
            begins = line | blank
            begins[1:] &= ~(blank[1:] & blank[:-1])  # a word is led by all blanks before it
            begins[1:] |= line[:-1]
            narrow = np.minimum(cp, NARROW)
            begins[1:] |= ~self.near[narrow[:-1], narrow[1:]]  # no piece holds both, so no merge joins them
            ends = np.cumsum(size)
            begins[(ends - size)[size > 0]] = True
            first = np.flatnonzero(begins)
            got, count, odd = self.runs.gather(joined, cp, first, np.append(first[1:], len(cp)))
            bounds = np.searchsorted(first, np.concatenate([[0], ends]))
            total, unlike = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(odd)])
            ids.append(got)
            counts[a:b] = np.diff(total[bounds])
            strange = np.diff(unlike[bounds])
            decoded += [self.encode(t)[1] if x else t for t, x in zip(some, strange.tolist(), strict=True)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts, decoded


class _Words(dict):
    """Ids and decoded text by word (leading blanks included)."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[list[int], str]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = self.model.cut_word(word.replace(" ", MARK))
        return out


_models: dict[str, PieceModel] = {}


def worker_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


OUTPUT = "doc_id long, ids array<int>, decoded string"


def encode_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str | None = None, name: str = "piece_bpe_32k.model") -> DataFrame:
    """Encodes every whole text and decodes its ids again; no shuffle.

    Returns doc_id, ids and decoded, one row per row. A null or empty text has no ids and decodes to the empty text; a
    null doc_id stays null; rows may repeat; an empty table gives no rows; other columns are not read.
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        pieces = worker_model(model or public_tokenizers.path(name))
        for batch in batches:
            flat, counts, decoded = pieces.encode_all([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, OUTPUT)
