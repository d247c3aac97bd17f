"""The operator library against plain Python on small inputs."""

import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from affinis.operators import clusters, features, frequency, tokens, walks
from affinis.operators.compare import FILE_END, METRICS, Options, _Row, compare, compare_tokens, tiles
from affinis.operators.tiling import greedy_tiles
from pyspark.sql import functions as F


def test_tiles_as_rescanned_every_round():
    r = random.Random(3)
    for _ in range(150):
        a, b = ([r.randrange(-1, 4) for _ in range(r.randrange(0, 40))] for _ in range(2))
        for least in (1, 2, 3):
            assert tiles(a, b, least) == greedy_tiles(a, b, least)


def test_merging_keeps_to_files():
    a = [1, 2, 3, 9, 4, 5, 6, -1, 7, 8, 1]
    b = [1, 2, 3, 8, 4, 5, 6, -1, 7, 8, 1]
    found = compare_tokens(a, b, Options(4, True, 2, 6, 1))
    assert found == [(0, 0, 7, 7)]


def _brute(subs, least, base=()):
    rows = {}
    for x, y in itertools.combinations(sorted(subs), 2):
        n, m = (sum(t != FILE_END for t in subs[s]) for s in (x, y))
        a, b = (x, y) if (n, x) < (m, y) else (y, x)
        ids = {}
        code = lambda s: [-1 if t == FILE_END else ids.setdefault(t, len(ids)) for t in subs[s]]  # noqa: B023, E731
        found = greedy_tiles(code(a), code(b), least)
        if found:
            rows[a, b] = sum(t[2] for t in found), max(t[2] for t in found)
    return rows


def test_compare_against_all_pairs(spark):
    r = random.Random(5)
    words = "a b c d e f".split()
    subs = {f"s{k}": [r.choice(words) for _ in range(r.randrange(0, 30))] + [FILE_END] for k in range(12)}
    subs["copy"], subs["s99"] = list(subs["s3"]), list(subs["s3"])
    df = spark.createDataFrame([(k, v, k != "s1") for k, v in subs.items()] + [("none", None, True)], "name string, tokens array<string>, is_new boolean")
    found = compare(df, Options(3))
    members = {m.name: m.representative for m in found.members.collect()}
    assert members["s99"] == members["s3"] == "copy" and members["none"] == "none"
    reps = {k: subs[k] for k in set(members.values()) if k in subs}
    want = _brute(reps, 3)
    got = {(p.a, p.b): (p.matched_a, p.longest) for p in found.pairs.collect()}
    assert got == want
    top = found.metric("AVG").first()
    assert 0 < top.similarity <= 1
    every = found.expanded(found.metric("AVG"))
    assert {(x.a, x.b) for x in every.filter("similarity = 1.0").collect()} >= {("copy", "s3"), ("copy", "s99")}
    assert compare(df.limit(0), Options(3)).pairs.count() == 0
    old = compare(df.withColumn("is_new", F.lit(False)), Options(3))
    assert old.pairs.count() == 0


def test_base_code_leaves_the_divisor(spark):
    shared, own = list("abcdefgh"), list("uvwxyz")
    df = spark.createDataFrame([("p", shared + own + [FILE_END]), ("q", shared + list("123456") + [FILE_END]), ("r", own + [FILE_END])], "name string, tokens array<string>")
    plain = {(x.a, x.b): x for x in compare(df, Options(4)).pairs.collect()}
    assert set(plain) == {("p", "q"), ("r", "p")}
    base = spark.createDataFrame([("base", shared)], "name string, tokens array<string>")
    based = compare(df, Options(4), base_code=base)
    rows = {(x.a, x.b): x for x in based.pairs.collect()}
    assert set(rows) == {("p", "r")} and rows["p", "r"].div_a == 6 and rows["p", "r"].matched_a == 6
    assert {x.name: len(x.tiles) for x in based.base.collect()} == {"p": 1, "q": 1, "r": 0}
    assert based.pairs.select(METRICS["AVG"](_Row())).first()[0] == 1.0


MATCHES = [("a", "b", list("xyz")), ("a", "c", list("xyz")), ("a", "d", list("wxyz")), ("b", "d", list("qrs"))]


def test_frequency_strategies(spark):
    df = spark.createDataFrame(MATCHES, "a string, b string, tokens array<string>")

    def got(f, least):
        return {(r.a, r.b): r.frequency for r in f(df, least).collect()}

    def subs(t, least):
        return ["".join(t[i:j]) for i in range(len(t)) for j in range(i + least, len(t) + 1)]

    whole = Counter("".join(t) for _, _, t in MATCHES)
    assert got(frequency.complete, 3) == {(a, b): whole["".join(t)] for a, b, t in MATCHES}
    inside = {(a, b): [whole[s] for s in subs(t, 3) if whole[s]] for a, b, t in MATCHES}
    assert got(frequency.contained, 3) == {k: sum(v) / len(v) for k, v in inside.items()}
    parts = Counter(s for _, _, t in MATCHES for s in subs(t, 2))
    assert got(frequency.submatches, 2) == {(a, b): pytest.approx(np.mean([parts[s] for s in subs(t, 2)])) for a, b, t in MATCHES}
    wins = Counter("".join(t[i : i + 2]) for _, _, t in MATCHES for i in range(len(t) - 1))
    assert got(frequency.window, 2) == {(a, b): pytest.approx(np.mean([wins["".join(t[i : i + 2])] for i in range(len(t) - 1)])) for a, b, t in MATCHES}
    assert set(got(frequency.window, 9).values()) == {0.0}


def test_weightings(spark):
    df = spark.createDataFrame([("a", "b", ["t"] * 315, 5.0)], "a string, b string, tokens array<string>, frequency double")
    div = spark.createDataFrame([("a", "b", 1000, 1000)], "a string, b string, div_a long, div_b long")
    for name, want in (("PROPORTIONAL", 0.0), ("LINEAR", 315.0), ("QUADRATIC", 315.0), ("SIGMOID", 315.0)):
        assert frequency.weighted_similarity(df, div, name, 1.0).first().similarity == pytest.approx(2 * want / 2000)
        assert frequency.weighted_similarity(df, div, name, 0.0).first().similarity == pytest.approx(2 * 315 / 2000)


def test_tokenizers(spark):
    text = "module m(input a);\n\n// input b\n  wire x; reg y;\n  end\n  endcase end\nsub u0 (a);\n`define X\nendmodule"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(tokens.rtl(F.col("t")).alias("a"), tokens.rtl_fine(F.col("t")).alias("b"), tokens.signals(F.col("t")).alias("s"), tokens.code(F.lit('int main() { x = "a\\"b"; // c\n return 1.5; }')).alias("c")).collect()
    assert row[0].a == ["MODULE_DECL", "PORT_INPUT", "DECL_WIRE", "DECL_REG", "BLOCK_END", "BLOCK_END", "ENDCASE", "ENDMODULE"]
    assert [(t.type, t.line) for t in row[0].b] == [("MODULE_DECL", 1), ("PORT_INPUT", 1), ("DECL_WIRE", 4), ("DECL_REG", 4), ("BLOCK_END", 5), ("COND_ENDCASE", 6), ("DIRECTIVE", 8), ("MODULE_END", 9)]
    assert [(s.type, s.name) for s in row[0].s] == [("input", "a"), ("input", "b"), ("reg", "y"), ("wire", "x")]
    assert row[0].c == ["INT", "NAME", "(", ")", "{", "NAME", "=", "STRING", ";", "RETURN", "NUMBER", ";", "}"]
    assert row[1].a == [] and row[1].b == [] and row[1].s == []
    files = spark.createDataFrame([("s", "b.v", "wire x;"), ("s", "a.txt", "Two words"), ("s", "c.bin", "x")], "submission string, file string, text string")
    found = tokens.tokenize(files, ["text", "verilog"])
    assert tokens.submissions(found).first().tokens == ["two", "words", FILE_END, "DECL_WIRE", FILE_END]
    assert tokens.min_match(["text", "java"]) == 5 and tokens.min_match([]) == 9
    ids = {r.token: r.id for r in tokens.dictionary(spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["z", "y"])], "name string, tokens array<string>")).collect()}
    assert ids == {"x": 0, "y": 1, "z": 2}


def test_names(spark):
    row = spark.createDataFrame([("top.u0.Data_rn_3", 1, 1), ("4'd3", 0, 0), ("A_b", 2, 1), ("And", 1, 2), ("x", 0, 1), ("x", 1, 0)], "n string, i int, o int")
    got = row.select(tokens.variable(F.col("n")), tokens.node_type(F.col("n"), F.col("i"), F.col("o"))).collect()
    assert [tuple(g) for g in got] == [("Data", "signal"), ("4'd3", "numeric"), ("b", "signal"), ("and", "and"), ("x", "output"), ("x", "input")]
    cells = spark.createDataFrame([("$mux",), ("$_DFF_P_",), ("$sshr",), ("$weird",)], "c string").select(tokens.cell_type(F.col("c"))).collect()
    assert [c[0] for c in cells] == ["branch", "signal", "sra", "signal"]
    assert spark.range(1).select(tokens.in_truth(F.lit("x"), F.array(F.lit("m.x")))).first()[0]
    assert [spark.range(1).select(f(F.lit(v))).first()[0] for f, v in ((tokens.is_clock, "click"), (tokens.is_clock, "sys_CLK"), (tokens.is_reset, "n_rst"), (tokens.is_state, "step"))] == [False, True, True, True]


def test_linkage_against_means_of_pairs():
    r = np.random.default_rng(2)
    for _ in range(20):
        m = r.random((8, 8)).round(2)
        m = np.maximum(m, m.T)
        for how, f in (("MIN", min), ("MAX", max), ("AVERAGE", lambda x: sum(x) / len(x))):
            groups = [[k] for k in range(8)]
            while len(groups) > 1:
                best = max((f([m[i, j] for i in x for j in y]), -a, -b) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b)
                if best[0] < 0.5:
                    break
                a, b = -best[1], -best[2]
                groups[a] = sorted(groups[a] + groups.pop(b))
            got = clusters.agglomerative(m, 0.5, how)
            assert sum(map(len, got)) == 8
            if how == "MAX":  # the connected components
                assert got == sorted(groups)


def test_cluster_values():
    m = np.zeros((4, 4))
    m[0, 1] = m[1, 0] = m[2, 3] = m[3, 2] = 1
    assert sum(clusters.strengths(m, [[0, 1], [2, 3]])) == pytest.approx(0.5)
    u = np.full((4, 4), 0.05)
    u[0, 1] = u[1, 0] = u[2, 3] = u[3, 2] = 0.1
    assert sum(clusters.strengths(u, [[0, 1], [2, 3]])) == pytest.approx(0.0)
    w = np.zeros((4, 4))
    for i, j, v in ((0, 1, 0.5), (0, 2, 0.3), (0, 3, 0.4), (1, 2, 0.1), (1, 3, 0.1), (2, 3, 0.7)):
        w[i, j] = w[j, i] = v
    assert clusters.mean_similarity(w, [0, 1, 2, 3]) == pytest.approx(0.35)
    assert clusters.spectral(m + np.eye(4)) == [[0, 1], [2, 3]]
    p = np.full((5, 5), 0.1) + np.diag([0.9] * 5)
    p[4, :] = p[:, 4] = 0
    p[0, 1] = p[1, 0] = p[2, 3] = p[3, 2] = 0.5
    out, left = clusters.prepared(p, "THRESHOLD", cut=0.2)
    assert left.tolist() == [0, 1, 2, 3] and (out[0, 2], out[0, 1]) == (0, 0.5)
    assert all(set(clusters.prepared(p, k)[1]) == {0, 1, 2, 3} for k in clusters.PREPROCESSORS)
    assert clusters.good(m, [[0, 1], [2, 3], [0]]) == [([0, 1], 0.25, 0.5), ([2, 3], 0.25, 0.5)]


def test_clusters_on_frames(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7), ("c", "d", 0.1), ("d", "e", 0.9)], "a string, b string, similarity double")
    parts = spark.createDataFrame([(x, "a") for x in "abcde"], "node string, component string")
    got = {r.node: r.cluster for r in clusters.clustered(pairs, parts, cut=0.3).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    few = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, similarity double")
    assert clusters.clustered(few, parts).count() == 0


EDGES = [("clk_in", "and1", "data"), ("rst.x", "and1", "control_flow"), ("and1", "out[0]", "assign"), ("out[0]", "clk_in", "data")]
G = features.Graph(["clk_in", "rst.x", "and1", "out[0]"], EDGES)


def test_feature_layouts():
    f = features.features_20(G)
    assert len(f) == 20 and f[:5] == pytest.approx([0.04, 0.04, 1.0, 0.2, math.log1p(4) / 5]) and f[5:10] == pytest.approx([0.25, 0.25, 0.25, 5.25 / 20, 6 / 50]) and f[10:15] == [0.5, 0.25, 0.25, 0.25, 0.0] and f[15:] == [0.0] * 5
    e = features.features_80(G)
    assert len(e) == 80 and e[72:] == [0.0] * 8
    assert e[40] == 2 / 20 and e[41] == pytest.approx((1 * 4 + 2 * 2) / 6 / 10) and e[42:44] == [0.1, 1.0]
    assert e[44] == 4 / 12 and e[48] == pytest.approx((1 + 0 + 1 / 3 + 1) / 4)
    same = features.pair_difference(G, G)
    assert len(same) == 34 and same[3] == 0.5 and sum(same) == pytest.approx(same[3] + same[18])
    other = features.Graph(["clk_in", "trojan_a"], [("clk_in", "trojan_a", "data")])
    d = features.pair_difference(other, G)
    assert d[0] == 2 / 6 and d[1] == 0.5 and d[8] == 1.0 and d[10] == 1.0
    c = features.Circuit(4, 4, 1, Counter(clock=1, input=1, output=1, internal=1), Counter(data=2, assign=1), [("a", "b"), ("a", "c")], {"clk_in", "i_x"})
    assert len(features.circuit_100(c)) == 100 == len(features.circuit_pair_100(c, c))
    pair = features.circuit_pair_100(c, c)
    assert pair[8:12] == [1.0] * 4 and pair[24] == 1.0 and pair[:8] == [0.0] * 8


def test_features_on_frames(spark):
    nodes = spark.createDataFrame([(g, n) for g in "gh" for n in G.nodes] + [("i", "alone")], "graph string, node string")
    edges = spark.createDataFrame([(g, *e) for g in "gh" for e in EDGES], "graph string, src string, dst string, type string")
    got = {r.graph: r.features for r in features.graph_features(nodes, edges).collect()}
    want = features.features_80(features.Graph(sorted(G.nodes), sorted(EDGES)))
    assert got["g"] == pytest.approx(want) and got["g"] == got["h"] and len(got["i"]) == 80
    pairs = spark.createDataFrame([("g", "h"), ("g", "i")], "a string, b string")
    found = features.difference_features(pairs, nodes, edges)
    assert features.best_difference(found).first().b == "h"
    cn, ce = nodes.select(F.lit("c").alias("circuit"), "graph", "node", F.lit("input").alias("type")), edges.select(F.lit("c").alias("circuit"), "graph", "src", "dst", "type")
    assert len(features.circuit_features(cn, ce).first().features) == 100
    both = features.circuit_features(cn, ce, spark.createDataFrame([("c", "c")], "circuit string, base string")).first().features
    assert both[8:12] == [1.0] * 4


def test_walks(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.0), ("b", "c", 2.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    starts = spark.createDataFrame([("a",), ("d",)], "start string")
    one = {r.start: r.path for r in walks.walks(edges, starts, 3, variant="type_weighted").collect()}
    assert one == {"a": ["a", "b", "c"], "d": ["d"]}
    for v, (_, more) in walks.VARIANTS.items():
        for r in walks.walks(edges, starts, 3, variant=v).collect():
            known = {("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")}
            steps = set(zip(r.path, r.path[1:], strict=False))
            assert len(r.path) <= 3 + more and steps <= known | ({(b, a) for a, b in known} if v == "bidirectional" else set())
    types = spark.createDataFrame([(n, "and") for n in "abcd"], "node string, type string")
    assert walks.walk_tokens(walks.walks(edges, starts, 3, variant="type_weighted"), types).filter("start = 'a'").first().tokens == ["and1", "and2", "and3"]
    w = spark.range(1).select(walks.normalised(F.array(*[F.lit(float(x)) for x in (1, 3, -1)])), walks.normalised(F.array(F.lit(0.0))), walks.adaptive_length(F.lit(100)), walks.adaptive_length(F.lit(2)), walks.density_length(F.lit(3), F.lit(1))).first()
    assert w[0] == pytest.approx([0.25, 0.75, 0.0]) and sum(w[0]) == pytest.approx(1.0) and w[1] == [0.0] and (w[2], w[3], w[4]) == (6, 3, 5)

    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    loop = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("q", "z")], "src string, dst string")
    assert {(r.root, r.node) for r in walks.cones(loop, keep).collect()} == {("r", "r"), ("r", "a"), ("r", "b")}


def test_isomorphism():
    r = random.Random(8)
    for _ in range(40):
        nodes = [f"n{k}" for k in range(5)]
        edges = list({(r.choice(nodes), r.choice(nodes)) for _ in range(6)})
        to = dict(zip(nodes, r.sample([f"m{k}" for k in range(5)], 5), strict=True))
        assert walks.isomorphic((nodes, edges), (list(to.values()), [(to[a], to[b]) for a, b in edges]))
        other = list({(r.choice(nodes), r.choice(nodes)) for _ in range(6)})
        want = any({(p[int(a[1])], p[int(b[1])]) for a, b in edges} == set(other) for p in itertools.permutations(nodes))
        assert walks.isomorphic((nodes, edges), (nodes, other)) == want


def test_message_passing():
    kinds, edges = [0, 1, 2, 3], [(0, 1), (1, 2), (2, 3)]
    for layer, pool, readout in itertools.product(walks.LAYERS, walks.POOLS, walks.READOUTS):
        v = walks.graph_vector(kinds, edges, layers=(layer, layer), hidden=8, pool=pool, readout=readout)
        turned = walks.graph_vector([3, 2, 1, 0], [(3, 2), (2, 1), (1, 0)], layers=(layer, layer), hidden=8, pool=pool, readout=readout)
        assert v.shape == (8,) and v == pytest.approx(turned)
    h, near = np.eye(2), np.array([[0, 1.0], [1, 0]])
    assert walks.gcn(h, near, np.eye(2)) == pytest.approx(np.full((2, 2), 0.5)) and walks.gin(h, near, np.eye(2)) == pytest.approx(np.ones((2, 2)))
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 4))
    same = np.arange(60) % 2 == 0
    y = np.where(same[:, None], x * [1, 1, 0.2, 0.2] + 0.1 * r.normal(size=(60, 4)), -x * [0.1, 0.1, 1, 1])

    def right(w):
        p, q = x @ w, y @ w
        return (((p * q).sum(1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) > 0.5) == same).mean()

    assert right(walks.train_pairwise(x, y, same)) >= max(0.8, right(np.eye(4)))


def test_fast_similarity(spark):
    args = [F.lit(4), F.lit(2), F.lit(3), F.lit(3), F.lit(0.5), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))]
    assert spark.range(1).select(walks.fast_similarity(*args)).first()[0] == pytest.approx(0.3 * 0.5 + 0.3 + 0.15 + 0.05)


def test_sources_and_settings(spark, tmp_path):
    from affinis.sources import more

    assert [more.decoded(b) for b in (b"\xef\xbb\xbfa", "ä".encode("latin-1"), "中".encode("gbk"), None, "ä".encode())] == ["a", "ä", "中", "", "ä"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "gt.csv").write_bytes("idx,c,s\n1,x,信号\n#2,x,no\n3,x,b\n".encode("gbk"))
    assert more.truth_rows(spark, str(tmp_path / "t")).first().signals == ["b", "信号"]
    (tmp_path / "run.yaml").write_text("# run\nmin-match: 7\nlanguages: [java, 'text']\nmerging: true\nother: 1.5\n")
    s = more.settings(str(tmp_path / "run.yaml"), min_match=8, roots=None)
    assert (s.min_match, s.languages, s.merging, s.extra) == (8, ("java", "text"), True, {"other": 1.5})
    new, old = spark.createDataFrame([("r", 1)], "root string, x int"), spark.createDataFrame([("r", 1), ("q", 2)], "root string, x int")
    assert {(r.root, r.is_new) for r in more.merged_roots(new, old).collect()} == {("r", True), ("q", False)}
    (tmp_path / "n.json").write_text('{"modules":{"m":{"ports":{"p":{"direction":"input","bits":[2]}},"cells":{"u":{"type":"$mux","port_directions":{"A":"input"},"connections":{"A":["2"]}}}}}}')
    assert {(r.node, r.kind, r.type) for r in more.netlist_nodes(spark, str(tmp_path / "n.json")).collect()} == {("p", "port", "input"), ("u", "cell", "branch"), ("2", "net", "signal")}
    more.write_graphs(new, old, str(tmp_path / "g"))
    assert [d.count() for d in more.read_graphs(spark, str(tmp_path / "g"))] == [1, 2]


def test_engine_and_report(spark, tmp_path):
    from affinis.engine import Engine, main, viewer_filter, viewer_sort
    from affinis.sources import report
    from affinis.sources.more import settings

    text = "one two three four five six seven eight nine ten"
    for name, body in {"p": text + " alpha beta gamma delta epsilon", "q": text + " rot gruen blau gelb weiss", "r": "nothing like it at all here", "s": "tiny", "t": text + " alpha beta gamma delta epsilon"}.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "a.txt").write_text(body)
    engine = Engine(settings(roots=(str(tmp_path / "in"),), languages=("text",), frequency="COMPLETE_MATCHES"))
    result = engine.run(spark)
    assert {r.name: r.state for r in result.submissions.collect()} == {"p": "VALID", "q": "VALID", "r": "VALID", "s": "TOO_SMALL", "t": "VALID"}
    best = engine.shown(result).first()
    assert (best.a, best.b) == ("p", "q") and best.similarity == pytest.approx(2 * 10 / 30)
    assert result.weighted.first().similarity == pytest.approx(10 / 15 * 0.75 + 10 / 15 * 0.25)
    assert json.loads(report.comparison_records(result.comparison).first().record)["similarities"]["LONGEST_MATCH"] == 10.0
    positions = spark.createDataFrame([(n, k, "a.txt", 1, k, 1, k + 1) for n in "pq" for k in range(15)], "name string, pos int, file string, line int, column int, end_line int, end_column int")
    match = json.loads(report.comparison_records(result.comparison, positions).first().record)["matches"][0]
    assert match["first"] == {"file": "a.txt", "start": {"line": 1, "column": 0}, "end": {"line": 1, "column": 10}}
    report.write_report(f"{tmp_path}/out", result.tables())
    assert report.archive(spark, f"{tmp_path}/out", f"{tmp_path}/out.zip") > 5
    ids = report.write_csv(result.comparison, f"{tmp_path}/csv", anonymous=True)
    assert {r.name: r.id for r in ids.collect()} == {"p": 0, "q": 1}
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["submissionName1", "submissionName2", "averageSimilarity", "maxSimilarity"]
    full = report.distribution(result.scored)
    assert full.count() == 100 and full.filter("n > 0").first().bucket == 66
    assert report.rebucketed(full, 10).filter("n > 0").first().bucket == 3
    assert json.loads(report.matrix(result.scored).filter("name = 'p'").first().row) == {"p": 1.0, "q": pytest.approx(2 / 3)}
    cells = spark.createDataFrame([(0, 1, 0.4), (1, 0, 0.6), (0, 0, 0.3)], "i int, j int, value double")
    assert {(r.i, r.j): r.value for r in report.heatmap(cells).collect()} == {(0, 1): 0.5, (1, 0): 0.5, (0, 0): 1.0}
    assert {r.bin: r.n for r in report.histogram(cells, "value", 3).collect()} == {0: 1, 1: 1, 2: 1}
    assert report.network(result.scored, 0.9).count() == 0 and "n=1 mean=0.6667" in report.text_summary(result.scored, F.lit("all")).first().line
    vectors = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [3.0, 4.0])], "label string, vector array<double>")
    report.write_vectors(vectors, f"{tmp_path}/v")
    assert [r.value for r in spark.read.text(f"{tmp_path}/v/vectors").collect()] == ["3.0\t4.0", "1.0\t2.0"] or spark.read.text(f"{tmp_path}/v/metadata").count() == 2
    assert {r.name: r.id for r in report.identifiers(spark.createDataFrame([("a b",), ("a/b",)], "name string")).collect()} == {"a b": "a_b", "a/b": "a_b_1"}
    files = spark.createDataFrame([("f", "wire x;\nreg y;")], "file string, text string").withColumn("tokens", tokens.rtl_fine(F.col("text")))
    assert [r.marks for r in report.annotated(files).collect()] == ["|DECL_WIRE", "|DECL_REG"]
    rows = report.metrics(result.comparison).withColumn("rank", F.lit(1))
    assert [viewer_filter(rows, q).count() for q in ("AVG>60", "AVG>70", "q", "zzz", "index:1", "P AVG<=66.7")] == [1, 0, 1, 0, 1, 1]
    assert viewer_sort(rows, "MAX").count() == 1
    assert main([str(tmp_path / "in"), "--language", "text", "--result", f"{tmp_path}/cli"]) == 0
    assert spark.read.json(f"{tmp_path}/cli/topComparisons").count() == 1


def test_pairs_of_submissions_never_travel(spark):
    """Over block edges and hot runs; the plan has no join that makes pairs, which were dealt out with both sides' tokens."""
    from itertools import combinations

    from affinis.operators import compare as c

    r = np.random.default_rng(4)
    texts = {f"n{k:02d}": [str(x) for x in r.integers(0, 4, r.integers(3, 30))] for k in range(40)}
    frame = spark.createDataFrame([(k, v, int(k[1:]) % 3 == 0) for k, v in texts.items()], "name string, tokens array<string>, is_new boolean")
    found = c.compare(frame, c.Options(5))
    plan = found.pairs._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Join") <= 1 and "is_new_b" not in plan
    want = {}
    for x, y in combinations(texts, 2):
        (n, a), (m, b) = sorted([(len(texts[x]), x), (len(texts[y]), y)])
        tiles = c.tiles([int(t) for t in texts[a]], [int(t) for t in texts[b]], 5)
        if tiles and (int(a[1:]) % 3 == 0 or int(b[1:]) % 3 == 0):
            want[a, b] = (n, m, [tuple(t) for t in tiles])
    assert want and {(p.a, p.b): (p.div_a, p.div_b, [tuple(t) for t in p.tiles]) for p in found.pairs.collect()} == want


def test_submissions_travel_packed():
    """What goes to every other block is far smaller than its tokens, and comes back as it was."""
    import numpy as np
    import pandas as pd

    from affinis.operators import compare as c

    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 62, 300)
    rows = [(k % 3, f"s{k}", k % 2 == 0, 200 + k, np.append(words[rng.integers(0, 300, 200 + k)], -1)) for k in range(90)]
    batches = [pd.DataFrame(rows[k : k + 40], columns=["own", "name", "is_new", "n", "t"]) for k in range(0, 90, 40)]
    packs = pd.concat(c._packed(iter(batches)))
    back = {name: (own, n, new, t.tolist()) for own, blob in packs.itertuples(index=False) for n, name, new, t in c._unpacked(blob)}
    assert back == {name: (own, n, new, t.tolist()) for own, name, new, n, t in rows}
    assert sum(map(len, packs.blob)) < sum(8 * len(r[4]) for r in rows) / 3 and not list(c._packed(iter([])))


def test_tiles_of_blocks(monkeypatch):
    """All pairs of two blocks (or of one) at once have the tiles that each pair has alone: overlapping runs, file ends,
    copies, windows with one hash, few at once."""
    from affinis.operators import blocktiles

    r = np.random.default_rng(7)
    several = 0
    for trial in range(40):
        monkeypatch.setattr(blocktiles, "_AT_ONCE", [5, 100, 1 << 20][trial % 3])
        monkeypatch.setattr(blocktiles, "_FEW", [16, 3][trial % 2])
        monkeypatch.setattr(blocktiles, "_WEIGHT", np.uint64(0 if trial % 5 == 0 else 0x9E3779B97F4A7C15))
        x, y = ([r.integers(-1, 2 + trial % 7, r.integers(0, 60)) for _ in range(r.integers(3, 10))] for _ in "xy")
        x[1], x[2] = x[0], np.concatenate([x[0], x[0]])
        y, least, base = (None, 3, 0) if trial % 2 else (y, 1 + trial % 6, len(x))
        rank = r.permutation(len(x) + len(y or []))
        got, want = {}, {}
        for t in blocktiles.tiled(x, y, least, lambda a, b: rank[a] > rank[b + base]):
            for a, b, i, j, n in zip(*(v.tolist() for v in (t.x, t.y, t.i, t.j, t.n)), strict=True):
                got.setdefault((a, b), []).append((i, j, n, n))
        for a in range(len(x)):
            for b in range(a + 1 if y is None else 0, len(y or x)):
                sides = [x[a], (y or x)[b]]
                if found := tiles(*(sides[::-1] if rank[a] > rank[b + base] else sides), least):
                    want[a, b] = found
        assert got == want
        several += sum(len(v) > 1 for v in want.values())
    assert several > 100


def test_long_shared_passages_cost_two_windows(monkeypatch):
    """A run of two texts is its first and last window, however long; what all go on alike with is never paired."""
    from affinis.operators import blocktiles

    words = np.arange(4000)
    texts = [np.concatenate([[10_000 + k], words, [20_000 + k]]) for k in range(60)]
    taken, take = [], np.repeat
    monkeypatch.setattr(np, "repeat", lambda *a: taken.append(len(out := take(*a))) or out)
    (found,) = blocktiles.tiled(texts, None, 5, lambda a, b: np.zeros(len(a), bool))
    assert len(found.n) == 60 * 59 // 2 and (found.n == 4000).all() and max(taken) < 300_000 < 3996 * len(found.n)


def test_records_come_from_blocks(spark):
    """A record's pairs and tiles come from whole blocks as Arrow arrays, not from rows of pairs; only packing sees rows."""
    from affinis.plans import library

    got = library.comparison_records(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInPandas") == 1 and plan.count("MapInArrow") == 1
    records = [json.loads(r.record) for r in got.collect()]
    assert records and all(r["similarities"]["LONGEST_MATCH"] == max(min(t["length_a"], t["length_b"]) for t in r["tiles"]) for r in records)


def test_complete_matches_never_travel(spark):
    """Frequencies of matches and similarities as by tokens of matches, over block edges, from no join of matches; texts
    of which all pairs have only matches of their own, and an empty table."""
    from affinis.operators import compare as c
    from affinis.operators import frequency

    r = np.random.default_rng(8)
    rows = [(f"n{k:02d}", [str(x) for x in r.integers(0, 4, r.integers(3, 30))]) for k in range(30)] + [(f"p{k}", [f"u{x}" for x in range(8)] + [f"q{k}"]) for k in range(2)]
    frame = spark.createDataFrame(rows, "name string, tokens array<string>")
    found = c.compare(frame, c.Options(5))
    own = frame.selectExpr("name AS a", "tokens AS ta")
    matches = found.pairs.select("a", "b", F.explode("tiles").alias("t")).join(own, "a").select("a", "b", F.slice("ta", F.col("t.start_a") + 1, F.col("t.length_a")).alias("tokens"))
    want = {(x.a, x.b): round(x.similarity, 9) for x in frequency.weighted_similarity(frequency.complete(matches, 5), found.pairs).collect()}
    got = frequency.weighted_complete(found.frequencies())
    assert got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Join") <= 2  # of classes, in both tilings
    assert len(set(want.values())) > 20 and {(x.a, x.b): round(x.similarity, 9) for x in got.collect()} == want
    assert c.compare(frame.limit(0), c.Options(5)).frequencies().count() == 0


def test_frequency_query_takes_complete_matches_from_blocks(spark):
    from affinis.plans import library

    got = library.queries()["freq_weighted_complete_matches"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "explode(tiles" not in plan and got.count() > 0
