from itertools import combinations

import pytest

GRAM = 9
WORDS = [f"w{k}" for k in range(40)]
TEXTS = [WORDS, [*WORDS, "x"], WORDS, ["a", "b"], [*WORDS[3:15], *WORDS[3:15]], None, [], ["p", *WORDS[20:29]], ["q", *WORDS[:9], "r", *WORDS[20:29]], [f"v{k}" for k in range(20)]]


def runs(t):
    return {tuple(t[k : k + GRAM]) for k in range(len(t) - GRAM + 1)}


def expected():
    own = {k: runs(t) for k, t in enumerate(TEXTS) if t is not None and TEXTS.index(t) == k}
    return {(a, b): (len(own[a] & own[b]), len(own[a]), len(own[b])) for a, b in combinations(own, 2) if own[a] & own[b]}, own


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(k, None if t is None else " - ".join(t), ["en", "fr"][k % 2]) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in (0, 1, 4, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pairs_of_texts(spark, folder):
    from affinis.operators.pairs import commonest_run, paired_texts, shared_runs

    docs, (want, own) = spark.read.parquet(f"{folder}/documents.parquet"), expected()
    assert {(r.a, r.b): (r.n_shared, r.n_a, r.n_b) for r in shared_runs(docs, GRAM).collect()} == want
    held = {g: sum(g in x for x in own.values()) for x in own.values() for g in x}
    spread = {(r.a, r.b): (r.n_texts, r.n_squares) for r in shared_runs(docs, GRAM, spread=True).collect()}
    assert spread == {(a, b): tuple(sum(held[g] ** k for g in own[a] & own[b]) for k in (1, 2)) for a, b in want}
    assert commonest_run(docs, GRAM).first().top == max(held.values())
    assert {r.doc_id for r in paired_texts(docs, GRAM).collect()} == {x for p in want for x in p}
    tagged = shared_runs(docs, GRAM, tags=docs.filter("doc_id <> 1").selectExpr("doc_id", "lang AS tag")).collect()
    assert {(r.a, r.b): (r.tag_a, r.tag_b) for r in tagged} == {p: tuple(None if x == 1 else ["en", "fr"][x % 2] for x in p) for p in want}
    assert shared_runs(docs.filter("doc_id > 100"), GRAM).collect() == []


@pytest.mark.parametrize("large", [False, True])
def test_copies_are_beside_their_text(spark, tmp_path, monkeypatch, large):
    """Every further copy of a text with runs is in the join once, also of a text that shares runs with no other."""
    from affinis.operators import pairs
    from affinis.plans import catalogue

    if large:
        monkeypatch.setattr(pairs, "_LARGE", 0)
    own = [f"v{k}" for k in range(20)]
    texts = [*TEXTS, WORDS, own, own, ["a", "b"], None]
    rows = [(k, None if t is None else " - ".join(t)) for k, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[-3]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: v[0] for k, v in expected()[0].items()} | {(0, 2): 32, (0, 10): 32, (9, 11): 12, (9, 12): 12}
    got = catalogue.queries()["candidate_shingle_join"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.n_shared for r in got} == want


def test_similarities_are_counted(spark, folder):
    """As often as pairs have them, by tags too; also where numbers don't fit one word."""
    from collections import Counter

    import numpy as np

    from affinis.operators.pairs import _Counts, dealt, similarity_counts

    docs, (want, _) = spark.read.parquet(f"{folder}/documents.parquet"), expected()
    found = Counter()
    for r in similarity_counts(dealt(docs, GRAM)).collect():
        found[r.n_shared, r.n_both] += r.n
    assert found == Counter((s, n + m) for s, n, m in want.values())
    found = Counter()
    for r in similarity_counts(docs, GRAM, tags=docs.filter("doc_id <> 1").selectExpr("doc_id", "lang AS tag")).collect():
        found[r.n_shared, r.n_both, r.tag_a, r.tag_b] += r.n
    assert found == Counter((s, n + m, *(None if x == 1 else ["en", "fr"][x % 2] for x in p)) for p, (s, n, m) in want.items())
    assert similarity_counts(docs.filter("doc_id > 100"), GRAM).collect() == []
    r = np.random.default_rng(2)
    for high in ([5, 9, 2], [1 << 40, 1 << 40, 3]):
        counts, plain = _Counts(high), Counter()
        for _ in range(3):
            part = [r.integers(0, min(h, 9) + 1, 500) for h in high]
            counts.add(part)
            plain.update(zip(*(x.tolist() for x in part), strict=True))
            counts._merge()
        assert {x[:-1]: x[-1] for x in zip(*(x.tolist() for x in counts.columns()), strict=True)} == plain
        assert [len(x) for x in _Counts(high).columns()] == [0] * 4


def test_texts_are_packed_in_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from affinis.operators import pairs

    tokens = [list(range(k, k + n)) for k, n in enumerate([12, 0, 30, 3, 11, 9, 40])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array([bytes([k]) * 16 for k in range(7)]), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "digest", "t"])

    def packed():
        found = set()
        for out in pairs._pack(GRAM, 3)([batch.slice(1)]):
            for bucket, kind, ids, counts, one, two in zip(*(c.to_pylist() for c in out.columns), strict=True):
                ids, counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32)
                found |= set(zip(np.repeat(ids, counts).tolist(), np.frombuffer(one, np.uint64).tolist(), np.frombuffer(two, np.uint16).tolist())) if kind == pairs._RUNS else {(bucket, *x) for x in zip(ids.tolist(), counts.tolist(), strict=True)}
        return found

    whole = packed()
    monkeypatch.setattr(pairs, "_TOKENS", 20)
    assert [x.num_rows for x in pairs._sliced(batch)] == [2, 1, 2, 1, 1]
    assert packed() == whole and len(whole) == sum(max(0, len(t) - GRAM + 1) for t in tokens[1:]) + sum(len(t) >= GRAM for t in tokens[1:])


@pytest.mark.parametrize("name", ["pp_cdf", "pp_percentile", "overall_summary", "freq_weighted_similarity"])
def test_views_of_a_query_share_their_shuffles(spark, folder, name):
    """Runs are packed and shuffled once, though pairs and what is counted of them are both needed."""
    from affinis.plans import catalogue

    got = catalogue.queries()[name](spark, folder)
    got.collect()
    final = "".join(part.split("== Initial Plan ==")[0] for part in got._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[1:])
    assert final.count("FileScan") <= 1 and "ReusedExchange" in final


def test_steps_of_all_widths():
    import numpy as np

    from affinis.operators.pairs import _decoded, _encoded

    for ids in ([1, 2], [-5, 250], [0, 256], [0, 65536], [3, 1 << 32, (1 << 62) + 1]):
        assert _decoded(_encoded(np.array(ids))).tolist() == ids


@pytest.mark.parametrize("name", ["candidate_shingle_join", "comparison_metrics", "filter_score_band", "filter_similarity_threshold", "max_similarity_distribution", "filter_new_pairs", "community_strength", "cluster_avg_similarity", "overall_summary", "freq_weighted_similarity", "pp_percentile", "pp_cdf", "cluster_min_guard", "filter_bad_clusters", "cluster_worth"])
def test_pairs_are_not_dealt_out(spark, folder, name):
    """No join or window over runs or pairs, and the results of the SQL."""
    import duckdb

    from affinis.plans import catalogue

    got = catalogue.queries()[name](spark, folder)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in plan or name in ("cluster_min_guard", "filter_bad_clusters", "cluster_worth")
    assert "Window" not in plan.replace("WindowGroupLimit", "") or name == "pp_cdf"
    assert "concat_ws" not in plan
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rows = lambda found: sorted(repr([round(r[c], 5) if isinstance(r[c], float) else r[c] for c in got.columns]) for r in found)
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows([r.asDict() for r in got.collect()]) == rows([dict(zip(columns, r, strict=True)) for r in result.fetchall()])


def test_cosines_of_tiles(spark, tmp_path):
    """Also over block edges, of null, holed, zero and unequal vectors; the plan has no join of vectors."""
    import numpy as np

    from affinis.operators import vectors
    from affinis.plans import catalogue

    r = np.random.default_rng(1)
    rows = [(k, r.normal(size=8).astype("float32").tolist(), k % 2) for k in range(60)]
    rows += [(100, None, 0), (101, [1.0, None] * 4, 0), (102, [0.0] * 8, 1), (103, [1.0] * 4, 1), (104, [2.0] * 8, None), (105, [1.0, 0.0, 0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def cosine(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return None
        x, y = (np.array(z, np.float32).astype(float) for z in (x, y))
        return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))) if x.any() and y.any() else float("nan")

    want = {(a[0], b[0]): cosine(a[1], b[1]) for a in rows for b in rows if a[2] is not None and a[2] == b[2] and b[0] < a[0]}
    show = lambda x: None if x is None else "nan" if x != x else round(x, 9) + 0.0
    assert {(x.new_id, x.old_id): show(x.sim) for x in vectors.cosines(frame).collect()} == {k: show(v) for k, v in want.items()}
    found = {x.new_id: (show(x.high), show(x.low)) for x in vectors.extremes(frame).collect()}
    assert set(found) == {a for a, _ in want}
    for a in found:
        sims = [v for (k, _), v in want.items() if k == a and v is not None]
        real = [v for v in sims if v == v]
        high = None if not sims else "nan" if len(real) < len(sims) else show(max(sims))
        assert found[a] == (high, None if not sims else show(min(real)) if real else "nan")
    over = {(x.new_id, x.old_id) for x in vectors.cosines(frame, 0.4).collect()}
    assert over == {k for k, v in want.items() if v is not None and not v < 0.4}
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("cosine_cross", "best_match_min_diff", "network_threshold", "anomaly_detect", "localize"):
        plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "Join" not in plan and "zip_with" not in plan


def test_runs_in_rounds(spark, folder, monkeypatch):
    """Large tables' runs travel round by round: the same pairs, tags and texts, and each round is written before the next."""
    from affinis.operators import pairs

    docs, (want, _) = spark.read.parquet(f"{folder}/documents.parquet"), expected()
    monkeypatch.setattr(pairs, "_LARGE", 0)
    rounds, write = [], pairs.kept
    monkeypatch.setattr(pairs, "kept", lambda rows, label: rounds.append(write(rows, label)) or rounds[-1])
    of = pairs.dealt(docs, GRAM, docs.filter("doc_id <> 1").selectExpr("doc_id", "lang AS tag"))
    assert len(rounds) == pairs._ROUNDS > 1 and sum(r.filter(f"kind = {pairs._RUNS}").count() > 0 for r in rounds) > 1
    assert {(r.a, r.b): (r.n_shared, r.n_a, r.n_b) for r in pairs.shared_runs(of).collect()} == want
    assert {(r.a, r.b): (r.tag_a, r.tag_b) for r in pairs.shared_runs(of).collect()} == {p: tuple(None if x == 1 else ["en", "fr"][x % 2] for x in p) for p in want}
    assert {r.doc_id for r in pairs.paired_texts(of).collect()} == {x for p in want for x in p}


def test_sizes_and_tags_travel_compressed():
    """A text's id and size or tag take a few bytes in each block, not twelve."""
    import numpy as np
    import pyarrow as pa

    from affinis.operators import pairs

    r = np.random.default_rng(5)
    ids = r.permutation(200_000)[:4096].astype(np.int64) - 1000
    n = r.integers(1, 900, 4096)
    blob = pairs._texts_row(ids, n)
    assert {*zip(*(x.tolist() for x in pairs._of_texts_row(blob)), strict=True)} == {*zip(ids.tolist(), n.tolist(), strict=True)}
    assert len(blob) < 4 * len(ids)
    tags = [None if k % 7 == 0 else "abc"[k % 3] for k in range(4096)]
    row = next(pairs._tagged([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags)], ["doc_id", "tag"])])).column(1)[0].as_py()
    table = pairs._of_tags_row(row)
    assert dict(zip(table["doc_id"].to_pylist(), table["tag"].to_pylist(), strict=True)) == dict(zip(ids.tolist(), tags, strict=True))
    assert len(row) < 4 * len(ids)
    lists = [(pairs._encoded(np.sort(ids[k : k + 5])), k) for k in range(50)]
    assert pairs._of_lists_row(pairs._lists_row(*map(list, zip(*lists, strict=True)))) == lists


def test_pairs_are_counted_once(spark, folder, monkeypatch):
    """cluster_worth takes strengths and means from one count of the pairs, not one for each part of it."""
    from affinis.operators import pairs
    from affinis.plans import catalogue

    made, count = [], pairs.similarity_counts
    monkeypatch.setattr(pairs, "similarity_counts", lambda *a, **k: made.append(1) or count(*a, **k))
    got = catalogue.queries()["cluster_worth"](spark, folder)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert len(made) == 1 and "MapInArrow" not in plan


def test_screened_cosines(spark, monkeypatch):
    """Single precision only leaves out: greatest cosines that differ by less than it can tell, and zero vectors beside others."""
    import numpy as np

    from affinis.operators import vectors

    r = np.random.default_rng(3)
    base = r.normal(size=(6, 16))
    rows = [(k, (base[k % 6] + 1e-5 * r.normal(size=16)).tolist(), k % 2) for k in range(300)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {k: max(x[k] @ x[j] for j in range(k % 2, k, 2)) for k in range(2, 300)}
    monkeypatch.setattr(vectors, "_FEW", 20)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {f.new_id: f.high for f in vectors.extremes(frame, low=False).collect()}
    assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-14
    over = {(f.new_id, f.old_id) for f in vectors.cosines(frame, 0.9999999999).collect()}
    assert over == {(k, j) for k in range(300) for j in range(k % 2, k, 2) if x[k] @ x[j] >= 0.9999999999} and over
    zero = frame.union(spark.createDataFrame([(-2, [0.0] * 16, 0)], frame.schema))
    for low in (True, False):
        got = {f.new_id: (f.high, f.real) for f in vectors.extremes(zero, low=low).filter("label = 0").collect()}
        assert all(np.isnan(h) for h, _ in got.values()) and np.isnan(got[0][1]) and abs(got[100][1] - want[100]) < 1e-14


def test_rounds_leave_no_shuffle_files(spark, folder, monkeypatch):
    """A round's packed runs are deleted as soon as its lists are written, before anything is collected as garbage."""
    import gc
    import time

    from affinis.operators import pairs

    held = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    gc.collect()
    gc.disable()
    name, left, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], pairs.kept
    before = spark.conf.get(name, "false")

    def kept(rows, label):
        there = held()
        out = write(rows, label)
        end = time.time() + 10
        while held() - there and time.time() < end:
            time.sleep(0.2)
        left.append((rows, held() - there))  # rows too, so that nothing of the round is garbage
        return out

    monkeypatch.setattr(pairs, "_LARGE", 0)
    monkeypatch.setattr(pairs, "kept", kept)
    try:
        found = pairs.shared_runs(spark.read.parquet(f"{folder}/documents.parquet"), GRAM)
    finally:
        gc.enable()
    assert [x for _, x in left] == [set()] * pairs._ROUNDS and spark.conf.get(name, "false") == before
    assert {(r.a, r.b): (r.n_shared, r.n_a, r.n_b) for r in found.collect()} == expected()[0]
