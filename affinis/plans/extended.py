"""Further relational queries over the parts of the catalogue: rankings, walks, state machines, clusters, bit vectors."""

from __future__ import annotations

from affinis.plans.catalogue import _CONFUSION, _COUNTS, _EDGES, _GRAMS, _PAIRS, _SCORES, _STEPS
from affinis.plans.catalogue import SQL as KNOWN

# Every node with its successors numbered by name; a walk takes the one that a hash of its start and place names.
_ADJACENT = _EDGES + ", adj AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS n FROM edges)"
# Transitions of the event machine with the range of weights each one owns among those of its source.
_WEIGHTED = _STEPS + ", cum AS (SELECT src, dst, sum(n) OVER (PARTITION BY src ORDER BY dst) - n AS low, sum(n) OVER (PARTITION BY src ORDER BY dst) AS high, sum(n) OVER (PARTITION BY src) AS total FROM fsm)"
_STATES = "ids AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS id FROM (SELECT DISTINCT event_type FROM events) x)"
_CLUSTERS = f"s AS ({KNOWN['community_strength']}), m AS ({KNOWN['cluster_avg_similarity']}), z AS (SELECT lang AS cluster, count(*) AS size FROM documents GROUP BY lang)"

SQL: dict[str, str] = {
    # rankings and distributions of pairs
    "max_similarity_distribution": "WITH " + _PAIRS + ", d AS (SELECT CAST(least(floor(sim_max * 100), 99) AS int) AS bucket, count(*) AS n FROM pairs GROUP BY CAST(least(floor(sim_max * 100), 99) AS int)) SELECT k.bucket, coalesce(d.n, 0) AS n FROM {BUCKETS} k LEFT JOIN d ON d.bucket = k.bucket",
    "sort_comparisons": "WITH " + _PAIRS + " SELECT a, b, round(sim_avg, 6) AS sim_avg FROM pairs ORDER BY round(sim_avg, 6) DESC, a, b",
    "viewer_sort": "WITH " + _PAIRS + " SELECT a, b, round(sim_max, 6) AS sim_max, round(sim_avg, 6) AS sim_avg FROM pairs ORDER BY round(sim_max, 6) DESC, round(sim_avg, 6) DESC, a, b",
    "filter_similarity_threshold": "WITH " + _PAIRS + " SELECT a, b, round(sim_max, 6) AS sim_max FROM pairs WHERE sim_max >= 0.5",
    "hash_lookup_positions": "WITH " + _GRAMS + ", f AS (SELECT g, count(*) AS n, min(doc_id) AS first_doc FROM grams GROUP BY g HAVING count(*) > 1) SELECT doc_id, pos, n, first_doc FROM grams JOIN f USING (g)",
    "match_overlap": "SELECT p_partkey, CASE WHEN lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) < p_size + 3 THEN 1 ELSE 0 END AS overlaps_next FROM part",
    "rank_argmax": "WITH c AS {COORDS}, m AS (SELECT vec_id, max(x) AS x FROM c GROUP BY vec_id) SELECT c.vec_id, min(c.dim) AS arg FROM c JOIN m ON m.vec_id = c.vec_id AND m.x = c.x GROUP BY c.vec_id",
    "head_tail_truncation": "WITH tokens AS {TOKENS}, s AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) SELECT t.doc_id, s.n, count(*) AS n_kept, min(CASE WHEN s.n > 512 AND t.pos >= s.n - 256 THEN t.pos END) AS tail_from FROM tokens t JOIN s ON s.doc_id = t.doc_id WHERE s.n <= 512 OR t.pos < 256 OR t.pos >= s.n - 256 GROUP BY t.doc_id, s.n",
    # names and bit vectors
    "var_name": "SELECT DISTINCT url, CASE WHEN position('.' IN url) > 0 THEN regexp_extract(url, '([^.]*)$', 1) WHEN position('_' IN url) > 0 THEN regexp_extract(url, '([^_]*)$', 1) ELSE lower(url) END AS var FROM pages",
    "bitvector_eval": "SELECT o_orderkey, a & b AS land, a | b AS lor, (a | b) - (a & b) AS lxor, 255 - a AS unot, (a + b) & 255 AS plus8, (a * b) & 255 AS times8, (a << 2) & 255 AS sll, a >> 2 AS srl, CASE WHEN a = 255 THEN 1 ELSE 0 END AS uand, CASE WHEN a <> 0 THEN 1 ELSE 0 END AS uor, CAST(bit_count(a) % 2 AS int) AS uxor, (a >> 4) & 15 AS part_7_4, (a << 8) | b AS concat16, CASE WHEN a < b THEN 1 ELSE 0 END AS less FROM (SELECT o_orderkey, o_orderkey & 255 AS a, o_custkey & 255 AS b FROM orders) x",
    # graphs
    "weights_normalize": "WITH w AS (SELECT user_id, event_type, CAST(count(*) AS double) AS n FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, round(least(1.0, n / sum(n) OVER (PARTITION BY user_id)), 6) AS weight FROM w",
    "all_walks": "WITH " + _ADJACENT + ", w2 AS (SELECT node AS start, a.dst AS at2 FROM nodes LEFT JOIN adj a ON a.src = node AND a.k = {H:concat(node, '-', node)} % a.n) SELECT start, at2, a.dst AS at3 FROM w2 LEFT JOIN adj a ON a.src = at2 AND a.k = {H:concat(start, '-', at2)} % a.n",
    "random_walk_type_weighted": "WITH " + _WEIGHTED + ", firsts AS (SELECT user_id, event_type AS at1 FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) x WHERE k = 1), w2 AS (SELECT user_id, at1, c.dst AS at2 FROM firsts JOIN cum c ON c.src = at1 WHERE {H:concat(user_id, '-1')} % c.total >= c.low AND {H:concat(user_id, '-1')} % c.total < c.high) SELECT user_id, at1, at2, c.dst AS at3 FROM w2 JOIN cum c ON c.src = at2 WHERE {H:concat(user_id, '-2')} % c.total >= c.low AND {H:concat(user_id, '-2')} % c.total < c.high",
    "circuit_graph_rollup": "WITH " + _EDGES + " SELECT label, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM edges GROUP BY label",
    "dfg_summary_flows": "WITH " + _EDGES + ", f AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM edges) SELECT src, dst, k FROM f WHERE k <= 20",
    "features_80_degrees": "WITH " + _EDGES + " SELECT e.src AS graph, round(avg(CAST(n_in + n_out AS double)), 6) AS mean, max(n_in + n_out) AS high, round(stddev_pop(CAST(n_in + n_out AS double)), 6) AS std, round({M:n_in + n_out:0.5}, 6) AS median, round({M:n_in + n_out:0.75}, 6) AS p75 FROM edges e JOIN deg d ON d.node = e.dst GROUP BY e.src",
    "features_diff": "WITH p AS (SELECT o_custkey AS c, count(*) AS n, count(DISTINCT o_orderstatus) AS m FROM orders GROUP BY o_custkey), g AS (SELECT n, m, min(c) AS c FROM p GROUP BY n, m) SELECT a.c AS a, b.c AS b, b.n - a.n AS d_nodes, b.m - a.m AS d_types, round(CAST(b.n AS double) / a.n, 6) AS ratio FROM g a JOIN g b ON a.c < b.c",
    "sim_graph_edit_approx": "WITH p AS (SELECT o_custkey AS c, count(DISTINCT o_orderkey) + 1 AS n, count(*) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey), g AS (SELECT n, m, min(c) AS c FROM p GROUP BY n, m) SELECT a.c AS a, b.c AS b, round(1 - 0.5 * (CAST(abs(a.n - b.n) AS double) / greatest(a.n, b.n) + CAST(abs(a.m - b.m) AS double) / greatest(a.m, b.m)), 6) AS sim FROM g a JOIN g b ON a.c < b.c",
    "dead_code_elimination": "WITH live AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), critical AS (SELECT DISTINCT o_custkey FROM orders JOIN live ON l_orderkey = o_orderkey) SELECT c_custkey FROM customer JOIN critical ON o_custkey = c_custkey",
    # state machines
    "fsm_label_range": f"WITH {_STATES} SELECT user_id, min(id) AS low, max(id) AS high FROM events JOIN ids ON ids.event_type = events.event_type GROUP BY user_id",
    "fsm_expand": "SELECT p_brand, b.bucket AS state FROM (SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand) r JOIN {BUCKETS} b ON b.bucket BETWEEN r.low AND r.high",
    "fsm_resolve": "WITH seq AS (SELECT user_id, event_type AS src, {KEY} AS k, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT src, dst, count(DISTINCT k) AS n_conditions, count(*) AS n FROM seq WHERE dst IS NOT NULL GROUP BY src, dst",
    "state_ranges": "WITH o AS (SELECT DISTINCT p_brand, p_size AS low, p_size + 1 AS high FROM part), m AS (SELECT p_brand, low, high, max(high) OVER (PARTITION BY p_brand ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o), g AS (SELECT p_brand, low, high, sum(CASE WHEN before IS NULL OR low > before THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY low, high) AS island FROM m) SELECT p_brand, min(low) AS low, max(high) AS high FROM g GROUP BY p_brand, island",
    "remove_reset": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, n FROM c WHERE lower(event_type) NOT LIKE '%error%'",
    "active_conditions": "WITH v AS (SELECT event_type, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_type, CAST(sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END) AS bigint) AS n_initial, CAST(sum(CASE WHEN before <> value THEN 1 ELSE 0 END) AS bigint) AS n_changed, CAST(sum(CASE WHEN before = value THEN 1 ELSE 0 END) AS bigint) AS n_unchanged FROM v GROUP BY event_type",
    # clusters and evaluation
    "filter_bad_clusters": f"WITH {_CLUSTERS} SELECT s.cluster, s.strength, z.size FROM s JOIN z ON z.cluster = s.cluster WHERE z.size >= 2 AND s.strength >= 0",
    "cluster_worth": f"WITH {_CLUSTERS} SELECT s.cluster, round(s.strength / (CAST(z.size AS double) * (z.size - 1) / 2) * m.mean, 12) AS worth FROM s JOIN z ON z.cluster = s.cluster JOIN m ON m.cluster = s.cluster WHERE z.size >= 2",
    "cluster_min_guard": "WITH " + _PAIRS + ", e AS (SELECT a AS d FROM pairs UNION SELECT b FROM pairs) SELECT lang, count(*) AS n, CASE WHEN count(*) <= 2 THEN 0 ELSE 1 END AS clusters FROM e JOIN documents ON doc_id = d GROUP BY lang",
    "accuracy_f1_epoch": "WITH " + _SCORES + f", c AS (SELECT lang, {_CONFUSION} FROM (SELECT d.lang, truth, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS p FROM scored s JOIN documents d ON d.doc_id = s.doc_id) x GROUP BY lang) SELECT lang, {_COUNTS}, round(CAST(tp + tn AS double) / (tp + fp + tn + fn), 6) AS accuracy FROM c",
}
