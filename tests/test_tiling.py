from affinis.operators.clustering import average_linkage, connected
from affinis.operators.tiling import greedy_tiles, merge_tiles, similarity


def test_merging_of_known_tiles():
    tiles = [(5, 3, 6, 6), (11, 12, 6, 6), (0, 0, 3, 3), (3, 18, 2, 2), (17, 20, 2, 2)]
    assert merge_tiles(tiles, max_gap=6, least=6) == [(5, 3, 12, 15)]


def test_merging_does_not_cross_an_end_of_file():
    tiles = [(0, 0, 6, 6), (8, 8, 6, 6)]
    assert merge_tiles(tiles, least=6, ends_a=[7]) == tiles
    assert merge_tiles(tiles, least=6) == [(0, 0, 14, 14)]
    assert merge_tiles(tiles, least=6, required=2) == tiles


def test_tiles():
    assert greedy_tiles([1, 2, 3, 4], [1, 2, 3, 4], 2) == [(0, 0, 4, 4)]
    assert greedy_tiles([1, 2, 9, 3, 4, 5], [3, 4, 5, 1, 2], 2) == [(3, 0, 3, 3), (0, 3, 2, 2)]
    assert greedy_tiles([-1, -1], [-1, -1], 1) == []
    assert greedy_tiles([], [1], 1) == []
    assert similarity([(0, 0, 4, 4)], 4, 4) == 1.0 and similarity([], 0, 0) == 0.0


def test_lower_minimum_never_lowers_similarity():
    a, b = [1, 2, 3, 9, 4, 5, 6, 7], [4, 5, 6, 7, 8, 1, 2, 3]
    found = [similarity(greedy_tiles(a, b, m), len(a), len(b)) for m in (5, 4, 3, 2)]
    assert found == sorted(found)


def test_linkage():
    sims = {(0, 1): 1.0, (2, 3): 1.0}
    assert average_linkage(sims, [0, 1, 2, 3], 0.2) == [[0, 1], [2, 3]]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21)], "a long, b long")
    got = {r.node: r.component for r in connected(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 13), 1), 20: 20, 21: 20}


def test_pairs_with_short_runs(spark, tmp_path):
    from itertools import combinations

    from affinis.operators.tiling import gst_simple_query, merging_query

    words = "one two three four five six seven eight nine ten eleven twelve".split()
    cut = [w for k in range(0, 12, 3) for w in [*words[k : k + 3], f"x{k}"]]
    texts = [words, cut, [*words[:7], "y"], ["a", "b", "c"], words, ["p", "q", *words[5:7]]]
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def expected(tiles_of):
        out = {}
        for i, j in combinations([0, 1, 2, 3, 5], 2):
            code = {w: k for k, w in enumerate(dict.fromkeys(texts[i] + texts[j]))}
            a, b = ([code[w] for w in t] for t in (texts[i], texts[j]))
            if tiles_of(a, b):
                out[i, j] = sum(t[2] for t in tiles_of(a, b))
        return out

    for query, want in ((merging_query, expected(lambda a, b: merge_tiles(greedy_tiles(a, b, 2), least=9))), (gst_simple_query, expected(lambda a, b: greedy_tiles(a, b, 6)))):
        assert {(r.a, r.b): r.matched for r in query(spark, str(tmp_path)).collect()} == want
        assert want


def test_degree_similarity_of_all_graphs(spark, tmp_path):
    from affinis.operators.graphs import degree_similarity_query

    degrees = {1: [1, 2], 3: [1, 2], 4: [3], 9: [2, 4]}
    orders = [(10 * c + k, c, n) for c, d in degrees.items() for k, n in enumerate(d)]
    spark.createDataFrame([(o, c) for o, c, _ in orders], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(o,) for o, _, n in orders for _ in range(n)], "l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.graph, r.other): r.similarity for r in degree_similarity_query(spark, str(tmp_path)).collect()}
    assert got == {(3, 1): 1.0, (4, 1): 0.447214, (9, 1): 1.0, (9, 4): 0.447214}


def test_copies_lie_in_clusters(spark, tmp_path):
    from affinis.operators.clustering import agglomerative_query

    words = [f"w{k}" for k in range(30)]
    texts = [words, [*words, "x"], words, ["alone"], ["copy"], ["copy"]]
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.node: r.cluster for r in agglomerative_query(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4}
    assert average_linkage({(0, 1): 0.9, (1, 2): 0.5}, [0, 1, 2], 0.2, {0: 9, 1: 1, 2: 1}) == [[0, 1], [2]]


def test_linkage_looks_at_links_only():
    """The same clusters as by the mean of every two clusters at every step, ties and copies included, with each
    similarity read once."""
    import numpy as np

    def plain(sims, nodes, threshold, sizes):
        groups = [[n] for n in sorted(nodes)]
        mean = lambda x, y: sum(sizes[i] * sizes[j] * sims.get((min(i, j), max(i, j)), 0.0) for i in x for j in y) / (sum(sizes[i] for i in x) * sum(sizes[j] for j in y))
        while len(groups) > 1:
            best, i, j = max((mean(x, y), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
            if best < threshold:
                break
            groups[-i] = sorted(groups[-i] + groups.pop(-j))
        return groups

    class Counted(dict):
        reads = 0

        def get(self, *key):
            Counted.reads += 1
            return super().get(*key)

    r = np.random.default_rng(3)
    for trial in range(60):
        nodes = sorted(r.choice(50, r.integers(2, 12), replace=False).tolist())
        value = (lambda: float(r.choice([0.25, 0.5, 0.75]))) if trial % 2 else (lambda: round(float(r.random()), 6))
        sims = {(i, j): value() for i in nodes for j in nodes if i < j and r.random() < 0.6}
        sizes = {n: int(r.integers(1, 4)) for n in nodes}
        assert average_linkage(sims, nodes, [0.2, 0.5, 0.0][trial % 3], sizes) == plain(sims, nodes, [0.2, 0.5, 0.0][trial % 3], sizes)
    many = Counted({(i, i + k): 1 / k for i in range(120) for k in range(1, 6)})
    assert sum(map(len, average_linkage(many, list(range(125)), 0.2))) == 125 and Counted.reads <= len(many)


def test_clusters_count_pairs_once(spark, tmp_path, monkeypatch):
    """Links and similarities of the clusters come from pairs that are written once."""
    from affinis.operators import clustering

    spark.createDataFrame([(k, " ".join(f"w{x}" for x in range(k, k + 20))) for k in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    written, write = [], clustering.kept
    monkeypatch.setattr(clustering, "kept", lambda rows, label: written.append(label) or write(rows, label))
    got = clustering.agglomerative_query(spark, str(tmp_path))
    assert written == ["pairs"] and "MapInArrow" not in got._jdf.queryExecution().toString() and got.count() == 6
