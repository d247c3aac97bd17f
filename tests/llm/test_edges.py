"""Operators against plain versions on hard inputs: hot groups, long words with equal polynomial hashes, nulls, ties,
repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_hashes_of_long_words():
    from affinis.llm.common import hash_runs, same_runs

    for n in (1024, 2048, 8192):
        a, b = thue_morse(n)
        v = np.frombuffer((a + b + a).encode(), np.uint8)
        start = np.array([0, n, 2 * n])
        h = hash_runs(v, start, start + n)
        assert h[0] != h[1] and h[0] == h[2]
        assert same_runs(v, start, start + n, np.array([0, 0, 0])).tolist() == [True, False, True]


def test_long_words_in_operators(spark):
    import public_tokenizers
    import sentencepiece
    from affinis.llm.minhash import near_duplicates
    from affinis.llm.packing import pack_documents
    from affinis.llm.sentencepieces import encode_pieces
    from affinis.llm.suffixdedup import remove_repeats
    from tokenizers import Tokenizer

    a, b = thue_morse(2048)
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in pack_documents(df).orderBy("doc_id", "start").collect():
        pieces.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4"))
    assert {d: np.concatenate(p).tolist() for d, p in pieces.items()} == {d: [*lib.encode(t, add_special_tokens=False).ids, 0] for d, t in ((1, a), (2, b))}
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 2}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: list(r.ids) for r in encode_pieces(df).collect()} == {1: model.encode(a), 2: model.encode(b)}
    kept = {r.doc_id: r.kept for r in remove_repeats(df).collect()}
    first = {a[i : i + 50] for i in range(len(a) - 49)}
    gone = set()
    for i in range(len(b) - 49):
        if b[i : i + 50] in first:
            gone |= set(range(i, i + 50))
    assert kept[1] == a.encode() and kept[2] == "".join(c for k, c in enumerate(b) if k not in gone).encode()


def brute_components(rows, size, percent):
    sets = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()))
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            x, y = sets[i][1], sets[j][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(s), least[top(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("small", [1, 24])
def test_near_duplicates_in_a_crowd(spark, small):
    """A family with edits of every rate, so that many members lie near the threshold of each other and of the hub."""
    from affinis.llm.minhash import near_duplicates

    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(60)]
    rows = []
    for k in range(140):
        rate = r.choice([0, 0.02, 0.05, 0.08, 0.12, 0.2])
        rows.append((k, " ".join(r.choice(words) if r.random() < rate else w for w in base)))
    other = " ".join(base[:40] + [r.choice(words) for _ in range(30)])
    rows += [(200 + k, " ".join(r.choice(words) if r.random() < 0.06 else w for w in other.split())) for k in range(60)]
    rows += [(300, None), (301, ""), (302, " \t"), (303, "One"), (304, "one"), (5, rows[3][1])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("kept", F.lit("x")), size=2, small=small)
    want = brute_components([x for x in rows if x[0] != 5], 2, 80)
    found = sorted({(x.doc_id, x.n_shingles, x.component_id) for x in got.filter("doc_id <> 5").collect()})
    assert found == sorted(set(want)) and got.count() == len(rows)
    assert near_duplicates(got.limit(0).withColumn("text", F.lit("x"))).count() == 0


def test_repeats_in_crowds(spark):
    from affinis.llm.suffixdedup import remove_repeats

    r = random.Random(2)
    line = "".join(r.choice("abcdef ") for _ in range(90))
    texts = [line[: r.randrange(40, 91)] + "".join(r.choice("xyz") for _ in range(r.randrange(0, 80))) + line[r.randrange(0, 50) :] for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(70, "é" * 70), (71, "é" * 65), (72, "ab" * 100), (73, "b" + "ab" * 60), (None, line), (4, line), (80, None)]
    first = {}
    for d, t in rows:
        raw, key = (t or "").encode(), 10**9 if d is None else d
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], 10**9 + 1), key)
    want = []
    for d, t in rows:
        raw, key = (t or "").encode(), 10**9 if d is None else d
        gone = set()
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < key:
                gone |= set(range(i, i + 50))
        want.append((str(d), bytes(x for k, x in enumerate(raw) if k not in gone)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("spans", F.lit("x"))
    for options in ({}, {"hot": 0}, {"block": 500, "bucket": 200, "hot": 1}):
        out = remove_repeats(df, **options)
        assert sorted((str(x.doc_id), bytes(x.kept)) for x in out.collect()) == sorted(want)
    whole = remove_repeats(df.filter("doc_id between 70 and 71"), whole_chars=True, carry=["block"])
    assert {x.doc_id: x.kept.decode() for x in whole.collect()}[71] == "" and whole.columns[-1] == "block"
    with pytest.raises(ValueError):
        remove_repeats(df, carry=["spans"])


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum((x * 2 - 9 if x > 4 else x * 2) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_personal_data_against_regular_expressions(spark):
    from affinis.llm.pii import find_personal_data, redact

    r = random.Random(7)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (222) 333-4444", "+1", "é", " ", "..", "@", "10.0.0.1.9", "12 34", "🙂", "\n", "0-", "a", "+49.30.1234567"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(400)] + [None, "", "1.2.3.4 " * 900, "a" * 30000, "1 " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_spans", F.lit(3))
    got = {x.doc_id: x for x in find_personal_data(df).collect()}
    for k, t in enumerate(texts):
        assert [(s.kind, s.s, s.e) for s in got[k].base] == plain_spans(t), t
        assert {(s.kind, s.s, s.e) for s in got[k].base} <= {(s.kind, s.s, s.e) for s in got[k].spans}
    assert {x._spans for x in got.values()} == {3}
    clash = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4", "keep", 5)], "doc_id long, text string, base string, spans int")
    row = redact(clash).first()
    assert (row.text, row.base, row.spans) == ("mail [EMAIL] or [IP]", "keep", 5)
    with pytest.raises(ValueError):
        find_personal_data(clash)
    assert redact(clash.limit(0)).count() == 0


def test_added_personal_data(spark):
    from affinis.llm import pii

    some = {
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x': ["secret:9:49"],
        "call 192.168.10.20 555-123-4567 now": ["ip:5:18", "phone:19:31"],
        "Room 12 555-123-4567": [],
        "name (at) host (dot) org": ["email:0:24"],
        "at 12:30:45 on 2024-01-02": [],
        "sha 04dbebab91ab85687d33eeaaf9ac699e1188f962": [],
        "peer 2001:db8:85a3:0:0:8a2e:370:7334": ["ip:5:36"],
        "tel: (030) 123-4567 key: required": ["phone:5:19"],
    }
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = [r.w.split(",") if r.w else [] for r in pii.find_personal_data(df).orderBy("doc_id").select(pii.written(F.col("spans")).alias("w")).collect()]
    assert got == list(some.values())
    trees, cut = pii.boosted_trees()
    x, y = pii._labelled(2000, 77, True)
    chosen = sum(rate * pii._tree_value(t, x) for rate, t in trees) >= cut
    assert y[chosen].mean() >= 0.95 and chosen[y == 1].mean() >= 0.9 and 0 < chosen.mean() < 1


def test_automaton_against_edit_distance():
    from affinis.llm.toxicity import LevenshteinAutomaton

    @lru_cache(None)
    def distance(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(distance(a[1:], b[1:]) + (a[0] != b[0]), distance(a[1:], b) + 1, distance(a, b[1:]) + 1)

    r = random.Random(1)
    for _ in range(500):
        word, term = ("".join(r.choice("abc") for _ in range(r.randrange(0, 7))) for _ in range(2))
        auto = LevenshteinAutomaton(word, 2)
        state = auto.start
        for c in term:
            state = auto.step(state, c)
        want = distance(word, term)
        assert auto.edits_at_end(state) == (want if want <= 2 else None)


def test_toxicity_edges(spark):
    from affinis.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity, without_toxic

    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "grubvile " * 20000, "c")], "doc_id long, text string, score string")
    none = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [0 < r.score < 0.5 for r in score_toxicity(docs, none).collect()] == [True] * 4
    assert without_toxic(docs, none).columns == docs.columns and without_toxic(docs.limit(0), none).count() == 0
    model = ToxicityModel({"grubvile": 3.0}, [5.0, 0, 5.0, 0, 0, 0], -3.0)
    assert {(r.doc_id, r.score > 0.5) for r in score_toxicity(docs, model).collect()} == {(1, False), (2, False), (None, True)}


def test_url_filter_edges(spark):
    from affinis.llm.urlfilter import build_cascade, judge_urls

    pages = spark.createDataFrame([(None, None, "x"), (1, "http://a/1", "y"), (1, "http://a/1", "y"), (2, "http://b/", "z")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("a",)], "host string")
    got = judge_urls(pages, [], listed)
    assert sorted((str(r.page_id), r.host, r.verdict) for r in got.collect()) == [("1", "a", "block"), ("1", "a", "block"), ("2", "b", "allow"), ("None", "", "allow")]
    assert judge_urls(pages, [], listed.limit(0)).filter("verdict = 'block'").count() == 0
    assert judge_urls(pages.limit(0), [], listed).count() == 0
    keys = spark.range(20000).select(F.xxhash64("id").alias("h"), (F.col("id") % 7 == 0).alias("listed")).cache()
    cascade = build_cascade(keys)
    rows = keys.toPandas()
    assert (cascade.holds(rows["h"].to_numpy()) == rows["listed"].to_numpy()).all() and cascade.size() < 20000


def test_neighbours_in_order(spark):
    from affinis.llm.ann import nearest

    v = [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, None], [3.0, 0.1], [1.0, 0.0, 0.0]]
    df = spark.createDataFrame([(k, x, "t") for k, x in enumerate(v)] + [(0, [5.0, 0.0], "t")], "vec_id long, embedding array<double>, rank string")
    got = [(r.rank, r.vec_id) for r in nearest(df).filter("query_id = 0").orderBy("rank").collect()]
    assert got[:3] == [(1, 1), (2, 1), (3, 3)] or got[:2] == [(1, 1), (2, 3)]
    assert nearest(df.limit(0)).count() == 0


def test_packing_edges(spark):
    from affinis.llm.packing import best_fit_decreasing, pack_documents, padding

    r = random.Random(4)
    for _ in range(60):
        lengths = [r.randrange(1, 17) for _ in range(r.randrange(0, 40))]
        windows, left = [], []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [(room, w) for w, room in enumerate(left) if room >= lengths[k]]
            if fits:
                tight = min(f[0] for f in fits)
                w = next(w for room, w in reversed(fits) if room == tight)
            else:
                w = len(left)
                left.append(16)
                windows.append([])
            left[w] -= lengths[k]
            windows[w].append(k)
        got = best_fit_decreasing(lengths, 16)
        assert sorted(sum(lengths[k] for k in g) for g in got) == sorted(sum(lengths[k] for k in g) for g in windows)
        assert sorted(k for g in got for k in g) == list(range(len(lengths)))
    assert [x[0] for x in spark.createDataFrame([(1,), (3,), (512,), (1000,), (1024,)], "n long").select(padding(F.col("n"))).collect()] == [0, 1021, 0, 24, 0]
    df = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "word " * 3000, 9)], "doc_id long, text string, offset int")
    rows = pack_documents(df).collect()
    assert sorted((str(x.doc_id), x.doc_tokens) for x in rows if x.start == 0) == [("1", 1), ("1", 1), ("None", rows[0].doc_tokens if rows[0].doc_id is None else max(x.doc_tokens for x in rows))]
    assert pack_documents(df.limit(0)).count() == 0


def test_chat_loss_against_plain(spark):
    from affinis.llm.chat import format_chat, read_chat

    r = random.Random(9)
    rows = []
    for c in range(12):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "system"]) if t else "user", r.choice([None, "", "<|im_end|>", "yes\\|", "word " * r.randrange(1, 60)])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {x.conv_id: x for x in read_chat(format_chat(df, budget=80, history=20)).collect()}
    for c in range(12):
        own = [x for x in rows if x[0] == c]
        said = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and got[c].n_turns == len(own)
    assert read_chat(format_chat(df.limit(0))).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{k}" for k in range(40))
    passage = "this passage of more than fifty bytes stands in two of these documents for sure"
    docs = spark.createDataFrame([(1, long, "en", "s", 5), (2, long + " more", "en", "s", 5), (3, None, None, None, None), (4, "see " + passage, "en", "s", 5), (5, passage + " again, mail a@b.cd", "en", "s", 5), (6, "clean and short", "fr", "t", 5)], columns)
    kept = p.near_dedup(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6} and kept.columns == p.COLUMNS
    cut = {r.doc_id: r for r in p.suffix_dedup(spark, kept, "").collect()}
    assert cut[4].text == "see " + passage and cut[5].text == " again, mail a@b.cd" and cut[5].n_chars == 19 and cut[6].text == "clean and short" and (cut[3].text or "") == ""
    clean = {r.doc_id: r.text for r in p.personal_data(spark, docs, "").collect()}
    assert clean[5].endswith("mail [EMAIL]") and clean[6] == "clean and short"
    assert {r.doc_id for r in p.packing(spark, docs, "").collect()} == {1, 2, 3, 4, 5, 6}
    for f in (p.near_dedup, p.suffix_dedup, p.personal_data, p.packing):
        assert f(spark, docs.limit(0), "").count() == 0
    assert [n for n, _ in p.STAGES] == ["toxicity", "near duplicates", "repeated passages", "personal data", "packing"]


def test_images_edges(spark):
    from affinis.llm.media import _as_pgm, image_copies

    r = np.random.default_rng(5)
    boards = [np.kron(r.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8) for _ in range(4)]
    rows = [(k, bytearray(_as_pgm(b))) for k, b in enumerate(boards)] + [(10, bytearray(_as_pgm(boards[0]))), (11, bytearray(_as_pgm(np.rot90(boards[1])[2:, 3:]))), (12, None), (13, bytearray(b"junk")), (None, bytearray(_as_pgm(boards[2]))), (14, bytearray(_as_pgm(np.full((64, 64), 9, np.uint8))))]
    df = spark.createDataFrame(rows, "image_id long, image binary").withColumn("class_id", F.lit("x"))
    got = {x.image_id: x.class_id for x in image_copies(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 10: 0, 11: 1, 12: 12, 13: 13, None: None, 14: 14}
    assert image_copies(df.limit(0)).count() == 0




def test_executors_collect_their_garbage_between_steps(spark, monkeypatch):
    """Before repeated passages are looked for and after each written step, so that heaps of earlier steps go back."""
    from affinis.llm.common import Scratch
    from affinis.llm.suffixdedup import remove_repeats

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in beans())
    Scratch(spark, "shrink").shrink()
    assert sum(b.getCollectionCount() for b in beans()) > before
    calls, shrink = [], Scratch.shrink
    monkeypatch.setattr(Scratch, "shrink", lambda self: calls.append(1) or shrink(self))
    text = "a passage of more than fifty bytes that two documents have in common, word by word"
    got = remove_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in got) == [(1, len(text)), (2, 0)] and len(calls) == 3


def test_only_sets_in_a_pair_are_dealt_out(spark, monkeypatch):
    """Few pairs: sets that are in none of them stay where they are, also where joins are not broadcast by size."""
    from affinis.llm import minhash

    sets = spark.createDataFrame([(k, bytes([k]) * 8) for k in range(40)], "node long, members binary")
    pairs = spark.createDataFrame([(1, 2), (2, 30)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for named, semi in ((minhash.NAMED, True), (1, False)):
            monkeypatch.setattr(minhash, "NAMED", named)
            found = minhash._beside(pairs, sets)
            assert ("LeftSemi" in found._jdf.queryExecution().executedPlan().toString()) == semi
            assert {(r.a, r.b, bytes(r.ma)[0], bytes(r.mb)[0]) for r in found.collect()} == {(1, 2, 1, 2), (2, 30, 2, 30)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_in_few_tasks(spark):
    """A step on few links does not start a task for each of many shuffle partitions, and ends with the first stars."""
    from affinis.llm import minhash

    class Kept(minhash.Scratch):
        def keep(self, df, name):
            written.append((name, df.rdd.getNumPartitions()))
            return super().keep(df, name)

    written, before = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = [(k, k + 1) for k in range(20)] + [(50, k) for k in range(51, 60)] + [(7, 7), (59, 50), (100, 99)]
        found = minhash.components(spark.createDataFrame(links, "a long, b long"), Kept(spark, "links")).collect()
        none = minhash.components(spark.createDataFrame([], "a long, b long"), minhash.Scratch(spark, "links")).collect()
        minhash.components(spark.createDataFrame([(50, k) for k in range(51, 60)], "a long, b long"), Kept(spark, "stars"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.node, r.component) for r in found} == {(k, 0) for k in range(21)} | {(k, 50) for k in range(50, 60)} | {(99, 99), (100, 99)} and len(found) == 33 and not none
    assert max(n for _, n in written) <= minhash.TASKS and written[-1][0] == "links-0"
