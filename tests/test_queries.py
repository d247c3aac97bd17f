import importlib.util

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["token_stats", "topk_comparisons", "longest_common_run", "best_match_join", "degrees", "threshold_sweep", "similarity_distribution", "random_walk_unweighted", "filter_new_pairs", "bitvector_eval", "state_ranges", "random_walk_type_weighted", "rank_argmax", "active_conditions"]


def rows(columns, found):
    return sorted(repr([round(float(r[c]), 5) if isinstance(r[c], float) else r[c] for c in sorted(columns)]) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb(spark, name):
    from affinis.plans import catalogue
    from affinis.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    expected = con.execute(catalogue.oracle_sql()[name]).df().to_dict("records")
    assert rows(got.columns, [r.asDict() for r in got.collect()]) == rows(got.columns, expected)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("affinis.llm.queries") if importlib.util.find_spec("affinis.llm") else None:
        assert "op1_packing" in entry.queries()


def test_sessions(spark):
    from affinis.streaming.incremental import session_sequences

    events = spark.read.parquet(f"{SF}/events.parquet")
    assert session_sequences(events).agg({"n": "sum"}).first()[0] == events.count()


def test_sources(spark, tmp_path):
    from affinis.sources.files import scan_ground_truth, scan_netlist, scan_submissions

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.v").write_text("module m; endmodule")
    (tmp_path / "a" / "x.txt").write_text("no")
    assert [(r.submission, r.file) for r in scan_submissions(spark, {str(tmp_path): True}, suffixes=[".V"]).collect()] == [("a", "a/x.v")]
    (tmp_path / "gt.csv").write_text("idx,circuit_name,signal_name\n1,c,s2\n#2,c,s3\n3,c,s1\n")
    assert scan_ground_truth(spark, str(tmp_path / "gt.csv")).first().signals == ["s1", "s2"]
    (tmp_path / "n.json").write_text('{"modules":{"m":{"cells":{"u":{"type":"AND","port_directions":{"A":"input","Y":"output"},"connections":{"A":["1"],"Y":["2"]}}}}}}')
    assert sorted((r.src, r.dst) for r in scan_netlist(spark, str(tmp_path / "n.json")).collect()) == [("1", "u"), ("u", "2")]
