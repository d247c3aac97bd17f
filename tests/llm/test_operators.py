import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string"
TEXTS = ["", None, " ", "one", "the quick brown fox jumps over the lazy dog and runs far away from here " * 4, "a" * 300, "it's  we're\n\n x ▁ 日本 a\x00b", "mail a.b@c.de or 10.0.0.1, +1 (415) 555-2671, 4111 1111 1111 1111", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    found = TEXTS + [TEXTS[4] + "tail", TEXTS[4], TEXTS[7]]
    return spark.createDataFrame([(k, t, "en", "s", 0, "x", "y") for k, t in enumerate(found)] + [(None, "null id", None, None, None, None, None)], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    from affinis.llm.packing import best_fit_decreasing, pack_documents

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = rows(pack_documents(docs))
    for d in docs.collect():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r["start"], r["length"], r["ids"]) for r in got if r["doc_id"] == d.doc_id)
        assert b"".join(bytes(x[2]) for x in own) == ids.tobytes()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == zlib.crc32(bytes(b)) for s, n, b in own)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert best_fit_decreasing([5, 5, 4, 6], 10) == [[3, 2], [0, 1]]
    assert pack_documents(docs.limit(0)).count() == 0


def test_sentencepiece(docs):
    import sentencepiece

    from affinis.llm.sentencepieces import encode_pieces

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode_pieces(docs).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert list(r.ids) == ids and r.decoded == library.decode(ids)
    assert encode_pieces(docs.limit(0)).count() == 0


def test_minhash_against_brute_force(spark, docs):
    from affinis.llm.minhash import near_duplicates

    got = {r.doc_id: r for r in near_duplicates(docs, size=2).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (d.text or "").translate(low))
        sets[d.doc_id] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    label = {k: k for k in sets if k is not None}
    for _ in label:
        for a in label:
            for b in label:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    assert {k: r.component_id for k, r in got.items() if k is not None} == label
    assert all(got[k].n_shingles == len(sets[k]) for k in sets)
    assert got[None].kept and got[None].component_id is None
    assert near_duplicates(docs.limit(0)).count() == 0


def test_minhash_of_an_id_with_several_texts(spark):
    from affinis.llm.minhash import near_duplicates

    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "abc"]
    rows = [(1, t) for t in texts] + [(2 + k, t + " more") for k, t in enumerate(texts)] + [(9, "z y x w v u"), (9, texts[0])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 56, 1)] * 3 + [(2, 57, 1), (3, 57, 1), (4, 57, 1), (9, 2, 9), (9, 56, 1)]


def test_suffix_dedup_against_brute_force(spark, docs):
    from affinis.llm.suffixdedup import remove_repeats, suffix_array

    rng = np.random.default_rng(0)
    for n in [*range(12), 50, 200]:
        x = rng.integers(1, 3, n)
        assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
    seen, expected = set(), {}
    for d in sorted((d for d in docs.collect()), key=lambda d: (d.doc_id is None, d.doc_id)):
        b = (d.text or "").encode()
        own = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + 50] = True
        seen |= set(own)
        expected[d.doc_id] = bytes(np.frombuffer(b, np.uint8)[~gone])
    got = remove_repeats(docs)
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == expected
    assert remove_repeats(docs.limit(0)).count() == 0


def test_personal_data(docs):
    from affinis.llm.pii import find_personal_data, redact, written

    found = {r.doc_id: r.s for r in find_personal_data(docs).select("doc_id", written(F.col("base")).alias("s")).collect()}
    assert found[7] == "email:5:13,ip:17:25,card:46:65,phone:27:44" and found[0] == ""
    text = {r.doc_id: r.text for r in redact(docs).collect()}
    assert text[7] == "mail [EMAIL] or [IP], [PHONE], [CARD]"


def test_added_spans(spark):
    from affinis.llm.pii import find_personal_data, written

    df = spark.createDataFrame([(1, "call (415) 555-2671 now"), (2, "on 2024-10-12 we met"), (3, "joe (at) mail (dot) example")], "doc_id long, text string")
    found = {r.doc_id: r.s for r in find_personal_data(df).select("doc_id", written(F.col("spans")).alias("s")).collect()}
    assert found[1].startswith("phone:") and found[2] == "" and found[3].startswith("email:")


def test_nearest_recall(spark):
    from affinis.llm.ann import nearest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[7:60] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16)], "vec_id long, embedding array<double>")
    got = nearest(df, shard=600).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(1500), -s))[:5].tolist()
        hit += len(set(best) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 150 and {r.query_id for r in got} == set(range(0, 1500, 50))
    assert nearest(df.limit(0)).count() == 0


def test_url_filter(spark):
    from affinis.llm.queries import URL_RULES
    from affinis.llm.urlfilter import judge_urls

    urls = ["http://A.Example.NET/en/x?q", "https://b.net/x", "https://b.net", None, "no url", "http://a.example.com/de/1", "http://spam-farm.example.org/en/2", "http://spam-farm.example.org/fr/2", "http://ok.example.org/en/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, URL_RULES, spark.createDataFrame([("spam-farm.example.org",), ("spam-farm.example.org",), (None,), ("elsewhere",)], "host string")).collect()}
    assert got == {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("example.com/de/", "block"), 6: (None, "block"), 7: ("org/fr/", "allow"), 8: (None, "allow")}


def test_chat(spark):
    from affinis.llm.chat import escape, format_chat, parse, read_chat, unescape

    for t in ["<|im_end|>", "<\\|x", "<\\\\|", "", "a<b|c"]:
        assert unescape(escape(t)) == t and "<|" not in escape(t)
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi " * 200), (1, 2, "assistant", "<|im_end|> yes " * 100), (1, 3, "user", None), (1, 4, "assistant", "bye"), (None, 0, None, "x")]
    windows = format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=300, history=60)
    got = {r.conv_id: r for r in read_chat(windows).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in turns[:5])
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 5
    assert got[1].loss_chars == len("<|im_end|> yes " * 100) + 3 and got[1].windows > 1 and got[None].n_turns == 1
    assert all(parse(r.formatted)[0] == ("system", "be kind") for r in windows.collect() if r.conv_id == 1)


def test_toxicity(spark):
    from affinis.llm.toxicity import LevenshteinAutomaton, Lexicon, fit_toxicity, score_toxicity

    lexicon = Lexicon({"moron": 2.0, "loweri*": 2.0, "pathetic": 2.0})
    assert lexicon.find("moron") == ("moron", 0) and lexicon.find("morron") == ("moron", 1) and lexicon.find("maroom") is None
    assert lexicon.find("lowerixyz") == ("loweri*", 0) and lexicon.find("pathetik") == ("pathetic", 1)
    auto = LevenshteinAutomaton("abc", 1)
    state = auto.start
    for c in "abd":
        state = auto.step(state, c)
    assert auto.edits_at_end(state) == 1
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 40)) + (" you moron " if k % 4 == 0 else " ") + " ".join(rng.choice(words, 5)) for k in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    assert all((score[k] >= 0.5) == (k % 4 == 0) for k in range(160, 200)) and score[900] < 0.5 and score[901] < 0.5
    assert fit_toxicity(docs, labels.limit(0)).weights == {}


def test_media(spark):
    from affinis.llm.media import image_copies, rendered

    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, rng.normal(0, 0.12, 64).tolist()) for i in range(40)] + [(77, None)], "vec_id long, embedding array<double>")
    images = rendered(vectors).unionByName(spark.createDataFrame([(500, b"no image"), (501, None)], "image_id long, image binary"))
    got = {r.image_id: r.class_id for r in image_copies(images).collect()}
    assert all(got[-1 - i] == got[i] for i in (0, 10, 20, 30)) and all(got[i] == i for i in range(40) if i % 10) and got[500] == 500


def test_media_finds_resized_copies(spark):
    """Brute force is the drawing itself: of 40 boards at 0.8 and 0.7 of their size nine tenths at least must come back,
    and no two boards may be taken for one."""
    from affinis.llm.media import _as_pgm, _box, _smaller, image_copies

    rng = np.random.default_rng(6)
    boards = [np.kron(128 + 100 * np.tanh(5 * rng.normal(0, 0.12, (8, 8))), np.ones((8, 8))) for _ in range(40)]
    images = list(enumerate(boards))
    for base, factor in ((100, 0.8), (200, 0.7)):
        images += [(base + k, _smaller(_box(b[None], 1)[0] / 9, 1 / factor)) for k, b in enumerate(boards)]
    df = spark.createDataFrame([(k, bytearray(_as_pgm(np.rint(i).astype(np.uint8)))) for k, i in images], "image_id long, image binary")
    got = {r.image_id: r.class_id for r in image_copies(df).collect()}
    assert all(got[k] == k for k in range(40))
    for base in (100, 200):
        assert sum(got[base + k] == k for k in range(40)) >= 36
        assert all(got[base + k] in (k, base + k, 100 + k) for k in range(40))


def test_media_behind_hubs_and_in_large_images(spark):
    from affinis.llm.media import _as_pgm, image_copies

    rng = np.random.default_rng(4)
    y, x = np.mgrid[-16:16, -16:16]
    tiles = []
    for angle in rng.uniform(0, np.pi, 25):
        u, v = x * np.cos(angle) + y * np.sin(angle), y * np.cos(angle) - x * np.sin(angle)
        tiles.append(60 + 120 * np.exp(-((u / rng.uniform(2, 6)) ** 2) - (v / rng.uniform(1.5, 4)) ** 2) + 30 * np.exp(-(((x - 4) / 2) ** 2) - (y / 2) ** 2))
    board = lambda order: np.block([[tiles[order[5 * r + c]] for c in range(5)] for r in range(5)])
    one = board(np.arange(25))
    images = [(k, board(rng.permutation(25))) for k in range(30)] + [(100, one), (101, one * 0.8 + 10)]
    large = np.kron(rng.integers(0, 255, (50, 50)), np.ones((8, 8)))
    weak = np.kron(rng.integers(80, 175, (10, 10)), np.ones((8, 8)))
    large[160:240, 160:240] = weak
    images += [(200, large), (201, large[156:244, 156:244])]
    df = spark.createDataFrame([(k, bytearray(_as_pgm(np.rint(i).astype(np.uint8)))) for k, i in images], "image_id long, image binary")
    got = {r.image_id: r.class_id for r in image_copies(df, agree=30).collect()}
    assert got[101] == got[100] == 100 and got[0] == 0
    assert got[201] == got[200] == 200


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "repeated passages", "personal data", "packing"]
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 2, 3, None} <= ids and 10 not in ids and 11 not in ids
    cut = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert cut[10].text == "" and cut[4].text == TEXTS[4] and cut[9].n_chars == len(cut[9].text)
