"""Every query of the library outside the training-data operators, with its SQL.

A query is one relational definition. Where the two engines spell a scalar function differently, a named fragment
(`{TOKENS}` and so on) has one form each; the rest of the text is common, so the SQL is an independent execution of
the same definition. Kernels that SQL can't express are in operators/ and registered without SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import clustering, graphs, tiling, vectors
from affinis.operators import pairs as paired
from affinis.operators.shared import kept
from affinis.sources.tables import TABLES, read

_SPARK = {
    "TOKENS": r"(SELECT doc_id, pos, tok FROM (SELECT doc_id, posexplode(filter(split(lower(text), '[^\\p{L}\\p{N}]+'), x -> x <> '')) AS (pos, tok) FROM documents))",
    "LINES": r"(SELECT page_id, pos, line FROM (SELECT page_id, posexplode(split(html, '\n')) AS (pos, line) FROM pages))",
    "COMMENTS": r"(SELECT page_id, explode(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS body FROM pages)",
    "TAGS": r"(SELECT page_id, explode(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)",
    "LINKS": r"(SELECT page_id, explode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages)",
    "COORDS": "(SELECT vec_id, label, pos AS dim, CAST(x AS double) AS x FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, x) FROM embeddings))",
    "THRESHOLDS": "(SELECT k / 100.0D AS threshold FROM (SELECT explode(sequence(1, 99)) AS k))",
    "BUCKETS": "(SELECT explode(sequence(0, 99)) AS bucket)",
    "EPOCH": "unix_micros(CAST(ts AS timestamp))",
    "ROOT": "regexp_replace(source, '[0-9]+$', '')",
    "DIGITS": "regexp_replace(source, '[^0-9]', '')",
    "STRIP": r"regexp_replace(line, '//[^\n]*', '')",
    "KEY": "get_json_object(props, '$.k')",
    "H": "CAST(conv(substr(md5(CAST({x} AS string)), 1, 8), 16, 10) AS bigint)",
    "MEDIAN": "percentile({x}, {p})",
    "SIM": "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS double) * CAST(y AS double)), 0.0D, (s, x) -> s + x) / (sqrt(aggregate(a.embedding, 0.0D, (s, x) -> s + CAST(x AS double) * x)) * sqrt(aggregate(b.embedding, 0.0D, (s, x) -> s + CAST(x AS double) * x)))",
}
_DUCK = {
    "TOKENS": r"(SELECT doc_id, unnest(range(len(t)))::int AS pos, unnest(t) AS tok FROM (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS t FROM documents))",
    "LINES": r"(SELECT page_id, unnest(range(len(t)))::int AS pos, unnest(t) AS line FROM (SELECT page_id, string_split(html, chr(10)) AS t FROM pages))",
    "COMMENTS": r"(SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS body FROM pages)",
    "TAGS": r"(SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)",
    "LINKS": r"""(SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)""",
    "COORDS": "(SELECT vec_id, label, unnest(range(len(embedding)))::int AS dim, unnest(embedding)::double AS x FROM embeddings)",
    "THRESHOLDS": "(SELECT k / 100.0::double AS threshold FROM range(1, 100) t(k))",
    "BUCKETS": "(SELECT k::int AS bucket FROM range(0, 100) t(k))",
    "EPOCH": "epoch_us(ts)",
    "ROOT": "regexp_replace(source, '[0-9]+$', '')",
    "DIGITS": "regexp_replace(source, '[^0-9]', '', 'g')",
    "STRIP": r"regexp_replace(line, '//[^\n]*', '', 'g')",
    "KEY": "json_extract_string(props, '$.k')",
    "H": "('0x' || substr(md5(CAST({x} AS varchar)), 1, 8))::bigint",
    "MEDIAN": "quantile_cont({x}, {p})",
    "SIM": "list_cosine_similarity(a.embedding::double[], b.embedding::double[])",
}

# --- parts that several queries build on -------------------------------------------------------------------------

GRAM = 9
_GRAMS = f"""tokens AS {{TOKENS}},
grams AS (SELECT doc_id, pos, g FROM (SELECT doc_id, pos, concat_ws(' ', tok, {', '.join(f'lead(tok, {k}) OVER w' for k in range(1, GRAM))}) AS g, lead(tok, {GRAM - 1}) OVER w AS last
  FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE last IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
texts AS (SELECT md5(text) AS t, min(doc_id) AS doc_id FROM documents GROUP BY md5(text))"""
# Pairs of different texts (the smallest doc_id of each text stands for its copies) that share a run of GRAM tokens.
_PAIRS = (
    _GRAMS
    + """,
own AS (SELECT g.doc_id, g.g, min(g.pos) AS pos FROM grams g JOIN texts USING (doc_id) GROUP BY g.doc_id, g.g),
common AS (SELECT g FROM own GROUP BY g HAVING count(*) > 1),
kept AS (SELECT own.* FROM own JOIN common USING (g)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
distinct_grams AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
pairs AS (SELECT a, b, n_shared, x.n AS n_a, y.n AS n_b, CAST(2 * n_shared AS double) / (x.n + y.n) AS sim_avg, CAST(n_shared AS double) / least(x.n, y.n) AS sim_max
  FROM shared JOIN distinct_grams x ON x.doc_id = a JOIN distinct_grams y ON y.doc_id = b)"""
)
_EDGES = """edges AS (
  SELECT concat('r', r_regionkey) AS src, concat('n', n_nationkey) AS dst, 'nation' AS label FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), 'customer' FROM customer
  UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey), 'supplier' FROM supplier
  UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey), 'order' FROM orders
  UNION ALL SELECT DISTINCT concat('o', l_orderkey), concat('p', l_partkey), 'part' FROM lineitem),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
deg AS (SELECT node, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = node LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = node)"""
_STEPS = """seq AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
fsm AS (SELECT event_type AS src, nxt AS dst, count(*) AS n FROM seq WHERE nxt IS NOT NULL GROUP BY event_type, nxt)"""
# Scores of labelled documents (share of repeated tokens) against the label quality = 0.
_SCORES = """tokens AS {TOKENS},
rep AS (SELECT doc_id, 1.0 - CAST(count(DISTINCT tok) AS double) / count(*) AS score FROM tokens GROUP BY doc_id),
scored AS (SELECT l.doc_id, coalesce(r.score, 0.0) AS score, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS truth FROM labels l LEFT JOIN rep r USING (doc_id))"""
_CONFUSION = "sum(CASE WHEN p = 1 AND truth = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p = 1 AND truth = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p = 0 AND truth = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN p = 0 AND truth = 1 THEN 1 ELSE 0 END) AS fn"
_METRICS = "CASE WHEN tp + fp > 0 THEN round(CAST(tp AS double) / (tp + fp), 6) ELSE 0.0 END AS prec, CASE WHEN tp + fn > 0 THEN round(CAST(tp AS double) / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(CAST(2 * tp AS double) / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1"
_COUNTS = "CAST(tp AS bigint) AS tp, CAST(fp AS bigint) AS fp, CAST(tn AS bigint) AS tn, CAST(fn AS bigint) AS fn"
# Candidates of a label against the vectors with smaller ids of it stay inside the label (as subgraphs inside a circuit).
_COSINE = "sims AS (SELECT a.label, a.vec_id AS new_id, b.vec_id AS old_id, round({SIM}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE b.vec_id < a.vec_id)"

SQL: dict[str, str] = {
    # sources and projections
    "scan_variant_pairs": "WITH g AS (SELECT p_brand, min(p_partkey) AS golden FROM part GROUP BY p_brand) SELECT p.p_partkey AS variant, g.golden, p.p_brand AS base FROM part p JOIN g ON g.p_brand = p.p_brand WHERE p.p_partkey <> g.golden",
    "scan_ground_truth": "SELECT source AS circuit, count(DISTINCT d.doc_id) AS n_signals FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 GROUP BY source",
    "scan_overlap_roots": "SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels",
    "scan_basecode": "SELECT item_id, length(text) AS n_chars FROM benchmark",
    "tokenize_text": "WITH tokens AS {TOKENS} SELECT doc_id, pos, tok FROM tokens",
    "token_stats": "WITH tokens AS {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT tok) AS n_types FROM tokens GROUP BY doc_id",
    "token_histogram": "WITH tokens AS {TOKENS} SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tokens GROUP BY tok",
    "dict_encode_tokens": "WITH tokens AS {TOKENS}, firsts AS (SELECT tok, min(doc_id * 10000000 + pos) AS f FROM tokens GROUP BY tok) SELECT tok, f AS first_seen FROM firsts",
    "file_end_sentinel": "SELECT conv_id, CAST(sum(length(text)) + count(*) AS bigint) AS n_with_ends, count(*) AS n_ends FROM conversations GROUP BY conv_id",
    "token_count_per_file": "SELECT conv_id, role, count(*) AS n_turns, CAST(sum(length(text)) AS bigint) AS n_chars FROM conversations GROUP BY conv_id, role",
    "extract_comments": "SELECT page_id, body FROM {COMMENTS}",
    "strip_line_comments": "SELECT page_id, pos, {STRIP} AS stripped FROM {LINES}",
    "tokenize_multi": "SELECT page_id AS id, 'page' AS kind, length(html) AS n FROM pages UNION ALL SELECT doc_id, 'document', length(text) FROM documents",
    "tokenize_rtl": "SELECT page_id, pos, kw FROM (SELECT page_id, pos, 'TITLE' AS kw FROM {LINES} WHERE lower(line) LIKE '%<title%' UNION ALL SELECT page_id, pos, 'PARAGRAPH' FROM {LINES} WHERE lower(line) LIKE '%<p>%' UNION ALL SELECT page_id, pos, 'LINK' FROM {LINES} WHERE lower(line) LIKE '%href=%') t",
    "extract_signals": "SELECT DISTINCT page_id, 'tag' AS sig_type, lower(tag) AS signal FROM {TAGS} UNION SELECT DISTINCT page_id, 'link', target FROM {LINKS}",
    "module_hierarchy": "SELECT lower(tag) AS module, count(*) AS n_uses, count(DISTINCT page_id) AS n_pages FROM {TAGS} GROUP BY lower(tag)",
    "detect_top_module": "WITH uses AS (SELECT page_id, lower(tag) AS m, count(*) AS n FROM {TAGS} GROUP BY page_id, lower(tag)) SELECT page_id, max(m) AS top FROM uses WHERE n = 1 GROUP BY page_id",
    "qualified_names": "SELECT DISTINCT n_name AS module, concat(n_name, '.', r_name) AS qualified FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT n_name, concat(r_name, '.', n_name, '.', r_name) FROM nation JOIN region ON position(lower(r_name) IN lower(n_name)) > 0 OR position(lower(n_name) IN lower(r_name)) > 0",
    "clean_signal_name": "SELECT DISTINCT source, {ROOT} AS cleaned, {DIGITS} AS suffix FROM documents",
    "size_delta": "WITH f AS (SELECT source, min(doc_id) AS d FROM documents GROUP BY source), g AS (SELECT f.source, x.n_chars AS base FROM f JOIN documents x ON x.doc_id = f.d) SELECT d.doc_id, d.n_chars - g.base AS delta, CASE WHEN g.base > 0 THEN round(CAST(100 AS double) * (d.n_chars - g.base) / g.base, 2) ELSE 0.0 END AS percent FROM documents d JOIN g ON g.source = d.source",
    "token_set_diff": "WITH tokens AS {TOKENS}, by_lang AS (SELECT DISTINCT lang, tok FROM tokens JOIN documents USING (doc_id)) SELECT tok, 'added' AS change FROM (SELECT tok FROM by_lang WHERE lang = 'fr' EXCEPT SELECT tok FROM by_lang WHERE lang = 'en') x UNION ALL SELECT tok, 'removed' FROM (SELECT tok FROM by_lang WHERE lang = 'en' EXCEPT SELECT tok FROM by_lang WHERE lang = 'fr') y",
    # filters
    "filter_valid_submissions": "WITH tokens AS {TOKENS}, s AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) SELECT d.doc_id, CASE WHEN s.n IS NULL THEN 'NOTHING_TO_PARSE' WHEN s.n < 9 THEN 'TOO_SMALL' ELSE 'VALID' END AS state FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id",
    "filter_min_subgraph": "WITH " + _EDGES + " SELECT src, count(*) + 1 AS n_nodes FROM edges GROUP BY src HAVING count(*) + 1 >= 3",
    "pred_ground_truth": "SELECT DISTINCT d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1",
    "pred_clock_reset": "SELECT DISTINCT event_type, CASE WHEN lower(event_type) LIKE '%clk%' OR lower(event_type) LIKE '%clock%' THEN 1 ELSE 0 END AS is_clock, CASE WHEN lower(event_type) LIKE '%rst%' OR lower(event_type) LIKE '%reset%' THEN 1 ELSE 0 END AS is_reset FROM events",
    "pred_fsm_var": "SELECT DISTINCT o_orderstatus, CASE WHEN lower(o_orderpriority) LIKE '%fsm%' OR lower(o_orderpriority) LIKE '%state%' OR lower(o_orderpriority) LIKE '%count%' OR lower(o_orderpriority) LIKE '%cnt%' OR lower(o_orderpriority) LIKE '%step%' OR lower(o_orderpriority) LIKE '%mode%' THEN 1 ELSE 0 END AS is_state FROM orders",
    # pairings
    # each further copy of a text with runs is beside the smallest doc_id of the text: membership, not all pairs of copies
    "candidate_shingle_join": "WITH " + _PAIRS + " SELECT a, b, n_shared FROM pairs UNION ALL SELECT t.doc_id AS a, d.doc_id AS b, s.n AS n_shared FROM (SELECT DISTINCT md5(text) AS t, doc_id FROM documents) d JOIN texts t ON t.t = d.t AND t.doc_id < d.doc_id JOIN distinct_grams s ON s.doc_id = t.doc_id",
    "pairs_graphs": "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "filter_new_pairs": "WITH " + _PAIRS + ", old AS (SELECT DISTINCT doc_id FROM labels) SELECT a, b FROM pairs LEFT JOIN old x ON x.doc_id = a LEFT JOIN old y ON y.doc_id = b WHERE x.doc_id IS NULL OR y.doc_id IS NULL",
    "gt_join": "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id",
    "signal_type_change": "WITH s AS (SELECT DISTINCT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS side FROM orders), gone AS (SELECT x.o_custkey, x.o_orderstatus FROM s x LEFT JOIN s y ON y.side = 'new' AND y.o_custkey = x.o_custkey AND y.o_orderstatus = x.o_orderstatus WHERE x.side = 'old' AND y.side IS NULL), came AS (SELECT x.o_custkey, x.o_orderstatus FROM s x LEFT JOIN s y ON y.side = 'old' AND y.o_custkey = x.o_custkey AND y.o_orderstatus = x.o_orderstatus WHERE x.side = 'new' AND y.side IS NULL) SELECT g.o_custkey, g.o_orderstatus AS was, c.o_orderstatus AS now_is FROM gone g JOIN came c ON c.o_custkey = g.o_custkey AND c.o_orderstatus <> g.o_orderstatus",
    "old_new_antijoin": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL",
    "range_join_counter": "WITH b AS (SELECT 10 * k AS low, 10 * k + 10 AS high FROM (SELECT DISTINCT CAST(floor(p_size / 10) AS int) AS k FROM part) x) SELECT b.low, count(*) AS n FROM b JOIN part ON p_size >= b.low AND p_size < b.high GROUP BY b.low",
    "net_cell_join": "SELECT l_suppkey AS net, p_type AS cell, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_type",
    # similarity
    "longest_common_run": "WITH " + _PAIRS + f""", every AS (SELECT g.doc_id, g.g, g.pos FROM grams g JOIN texts USING (doc_id) JOIN common USING (g)),
hits AS (SELECT x.doc_id AS a, y.doc_id AS b, x.pos - y.pos AS diag, x.pos AS p FROM every x JOIN every y ON x.g = y.g AND x.doc_id < y.doc_id),
runs AS (SELECT a, b, diag, p - row_number() OVER (PARTITION BY a, b, diag ORDER BY p) AS island FROM hits),
lengths AS (SELECT a, b, count(*) + {GRAM - 1} AS n FROM runs GROUP BY a, b, diag, island) SELECT a, b, max(n) AS longest FROM lengths GROUP BY a, b""",
    "comparison_metrics": "WITH " + _PAIRS + " SELECT a, b, round(sim_avg, 6) AS sim_avg, round(sim_max, 6) AS sim_max, round(CAST(n_shared AS double) / greatest(n_a, n_b), 6) AS sim_min, round(CAST(n_shared AS double) / n_a, 6) AS sim_first, round(CAST(n_shared AS double) / n_b, 6) AS sim_second, n_shared AS sim_intersection, greatest(n_a, n_b) AS max_length FROM pairs",
    "basecode_marking": "WITH tokens AS {TOKENS}, hits AS (SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON position(b.text IN d.text) > 0) SELECT doc_id, count(*) AS n_base FROM hits GROUP BY doc_id",
    "freq_complete": "WITH " + _GRAMS + " SELECT g, count(DISTINCT doc_id) AS freq FROM grams GROUP BY g HAVING count(DISTINCT doc_id) > 1",
    "freq_window": "WITH " + _GRAMS + ", f AS (SELECT g, count(*) AS n FROM grams GROUP BY g) SELECT doc_id, round(avg(CAST(n AS double)), 6) AS weight FROM grams JOIN f USING (g) GROUP BY doc_id",
    "freq_weighted_similarity": "WITH " + _PAIRS + ", f AS (SELECT g, count(*) AS n FROM own GROUP BY g), m AS (SELECT max(n) AS top FROM f), w AS (SELECT x.doc_id AS a, y.doc_id AS b, 1.0 - least(CAST(f.n AS double) / m.top, 1.0) AS rarity FROM kept x JOIN kept y ON x.g = y.g AND x.doc_id < y.doc_id JOIN f ON f.g = x.g CROSS JOIN m) SELECT a, b, round(sum(1 + rarity), 4) AS linear, round(sum(2 * rarity), 4) AS proportional, round(sum(1 + rarity * rarity), 4) AS quadratic FROM w GROUP BY a, b",
    "cosine_cross": "WITH " + _COSINE + " SELECT label, new_id, old_id, sim FROM sims",
    "best_match_join": "WITH " + _COSINE + ", best AS (SELECT new_id, max(sim) AS sim FROM sims GROUP BY new_id) SELECT b.new_id, min(s.old_id) AS old_id, b.sim FROM best b JOIN sims s ON s.new_id = b.new_id AND s.sim = b.sim GROUP BY b.new_id, b.sim",
    "best_match_min_diff": "WITH " + _COSINE + " SELECT new_id, round(min(1 - sim), 6) AS diff FROM sims GROUP BY new_id",
    "sim_exp_decay": "WITH " + _COSINE + " SELECT new_id, round(max(exp(-0.1 * sqrt(greatest(0.0, 2 - 2 * sim)))), 6) AS sim, round(max(1 / (1 + greatest(0.0, 1 - sim))), 6) AS inverse FROM sims GROUP BY new_id",
    "embed_mean_pool": "SELECT label, dim, round(avg(x), 6) AS x FROM {COORDS} GROUP BY label, dim",
    "network_threshold": "WITH " + _COSINE + " SELECT new_id, old_id, sim FROM sims WHERE sim > 0.4",
    # graphs
    "degrees": "WITH " + _EDGES + " SELECT node, n_in, n_out, n_in + n_out AS n_all FROM deg",
    "roots_leaves": "WITH " + _EDGES + " SELECT node, CASE WHEN n_in = 0 THEN 'root' ELSE 'leaf' END AS kind FROM deg WHERE n_in = 0 OR n_out = 0",
    "classify_node_type": "WITH " + _EDGES + " SELECT node, CASE WHEN n_in = 0 THEN 'output' WHEN n_out = 0 THEN 'input' WHEN node LIKE 'o%' THEN 'signal' ELSE substr(node, 1, 1) END AS type FROM deg",
    "cone_of_influence": "WITH " + _EDGES + ", l1 AS (SELECT src AS root, dst AS node FROM edges WHERE label = 'nation'), l2 AS (SELECT l1.root, e.dst AS node FROM l1 JOIN edges e ON e.src = l1.node), l3 AS (SELECT l2.root, e.dst AS node FROM l2 JOIN edges e ON e.src = l2.node), l4 AS (SELECT DISTINCT l3.root, e.dst AS node FROM l3 JOIN edges e ON e.src = l3.node) SELECT root, count(DISTINCT node) + 1 AS n_nodes FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4) c GROUP BY root",
    "features_20": "WITH " + _EDGES + " SELECT e.src AS graph, count(*) + 1 AS n_nodes, count(*) AS n_edges, round(ln(count(*) + 2), 6) AS log_nodes, round(avg(CAST(length(e.dst) AS double)), 6) AS name_length, round(CAST(sum(CASE WHEN label = 'part' THEN 1 ELSE 0 END) AS double) / count(*), 6) AS part_share, max(d.n_out) AS top_out FROM edges e JOIN deg d ON d.node = e.dst GROUP BY e.src",
    "walk_length_adaptive": "WITH " + _EDGES + " SELECT src AS graph, least(greatest(3, CAST(floor(3 * greatest(1.0, log10(count(*) + 1))) AS int)), 10) AS walk_length FROM edges GROUP BY src",
    "random_walk_unweighted": "WITH " + _EDGES + ", adj AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS n FROM edges), w1 AS (SELECT node AS start, node AS at1 FROM nodes WHERE node LIKE 'n%'), w2 AS (SELECT w1.start, a.dst AS at2 FROM w1 JOIN adj a ON a.src = w1.at1 AND a.k = {H:concat(w1.start, '-', w1.at1)} % a.n), w3 AS (SELECT w2.start, at2, a.dst AS at3 FROM w2 LEFT JOIN adj a ON a.src = w2.at2 AND a.k = {H:concat(w2.start, '-', w2.at2)} % a.n) SELECT start, at2, at3 FROM w3",
    "sim_graph_fast": "WITH p AS (SELECT o_custkey AS c, count(*) AS n, count(DISTINCT o_orderstatus) AS m FROM orders GROUP BY o_custkey), g AS (SELECT n, m, min(c) AS c FROM p GROUP BY n, m) SELECT a.c AS a, b.c AS b, round(0.5 * (1 - CAST(abs(a.n - b.n) AS double) / greatest(a.n, b.n)) + 0.5 * (1 - CAST(abs(a.m - b.m) AS double) / greatest(a.m, b.m)), 6) AS sim FROM g a JOIN g b ON a.c < b.c",
    "split_stratified": "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {H:doc_id}, doc_id) <= 0.7 * count(*) OVER (PARTITION BY quality) THEN 'train' ELSE 'test' END AS part FROM labels",
    "class_weights_balanced": "SELECT quality, round(CAST(sum(count(*)) OVER () AS double) / (2 * count(*)), 6) AS weight FROM labels GROUP BY quality",
    "fsm_extract": "WITH " + _STEPS + " SELECT src, dst, n FROM fsm",
    "fsm_size": "WITH " + _STEPS + " SELECT count(*) AS n_transitions, count(DISTINCT src) AS n_states FROM fsm",
    "fsm_loops": "WITH " + _STEPS + " SELECT a.src AS s1, a.dst AS s2, b.dst AS s3 FROM fsm a JOIN fsm b ON b.src = a.dst JOIN fsm c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst",
    "token_sequences": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events",
    # aggregation, evaluation, ranking
    "similarity_distribution": "WITH " + _PAIRS + ", d AS (SELECT CAST(least(floor(sim_avg * 100), 99) AS int) AS bucket, count(*) AS n FROM pairs GROUP BY CAST(least(floor(sim_avg * 100), 99) AS int)) SELECT k.bucket, coalesce(d.n, 0) AS n FROM {BUCKETS} k LEFT JOIN d ON d.bucket = k.bucket",
    "rebucket": "WITH " + _PAIRS + " SELECT 9 - CAST(least(floor(sim_avg * 10), 9) AS int) AS bucket, count(*) AS n FROM pairs GROUP BY 9 - CAST(least(floor(sim_avg * 10), 9) AS int)",
    "filter_score_band": "WITH " + _PAIRS + " SELECT CASE WHEN sim_avg >= 0.9 THEN 'high' WHEN sim_avg >= 0.7 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM pairs GROUP BY CASE WHEN sim_avg >= 0.9 THEN 'high' WHEN sim_avg >= 0.7 THEN 'mid' ELSE 'low' END",
    "histogram50": "WITH r AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders) SELECT CAST(least(floor((o_totalprice - low) / (high - low) * 50), 49) AS int) AS bin, count(*) AS n FROM orders CROSS JOIN r GROUP BY CAST(least(floor((o_totalprice - low) / (high - low) * 50), 49) AS int)",
    "list_statistics": "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, round(var_pop(o_totalprice), 2) AS variance, round(stddev_pop(o_totalprice), 4) AS std, round({M:o_totalprice:0.5}, 4) AS median, round({M:o_totalprice:0.25}, 4) AS q1, round({M:o_totalprice:0.75}, 4) AS q3 FROM orders",
    "summary_by_base": "SELECT source, count(*) AS n, round(avg(CAST(n_chars AS double)), 4) AS mean_chars FROM documents GROUP BY source",
    "summary_rollup": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS bigint) AS chars FROM documents GROUP BY ROLLUP (lang, source)",
    "overall_summary": "WITH " + _PAIRS + " SELECT round(avg(sim_avg), 6) AS mean, round({M:sim_avg:0.5}, 6) AS median, round(max(sim_avg), 6) AS top, round(min(sim_avg), 6) AS low, round(stddev_samp(sim_avg), 6) AS std FROM pairs",
    "confusion_metrics": "WITH " + _SCORES + f", c AS (SELECT {_CONFUSION} FROM (SELECT truth, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS p FROM scored) x) SELECT {_COUNTS}, {_METRICS} FROM c",
    "micro_metrics": "WITH " + _SCORES + f", c AS (SELECT {_CONFUSION} FROM (SELECT truth, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS p FROM scored) x) SELECT {_METRICS} FROM c",
    "threshold_sweep": "WITH " + _SCORES + f", c AS (SELECT threshold, {_CONFUSION} FROM (SELECT threshold, truth, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS p FROM scored CROSS JOIN {{THRESHOLDS}} t) x GROUP BY threshold), m AS (SELECT threshold, {_METRICS} FROM c), best AS (SELECT max(f1) AS f1 FROM m) SELECT min(m.threshold) AS threshold, best.f1 FROM m JOIN best ON m.f1 = best.f1 GROUP BY best.f1",
    "score_split_stats": "WITH " + _SCORES + " SELECT truth, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high FROM scored GROUP BY truth",
    "anomaly_detect": "WITH " + _COSINE + ", r AS (SELECT new_id, max(sim) AS high, min(sim) AS low FROM sims GROUP BY new_id) SELECT new_id, high, CASE WHEN high >= greatest(0.98, high - 0.01 * (high - low)) THEN 'normal' ELSE 'suspect' END AS verdict FROM r",
    "localize": "WITH " + _COSINE + ", r AS (SELECT label, new_id, max(sim) AS high FROM sims GROUP BY label, new_id), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY high, new_id) AS k FROM r) SELECT label, new_id, high FROM o WHERE k = 1",
    "correlate_detectors": "WITH tokens AS {TOKENS}, s AS (SELECT doc_id, CAST(count(*) AS double) AS x, CAST(count(DISTINCT tok) AS double) AS y FROM tokens GROUP BY doc_id) SELECT round(corr(x, y), 6) AS correlation FROM s",
    "pp_threshold": "WITH " + _PAIRS + " SELECT a, b, round(sim_avg, 6) AS sim FROM pairs WHERE sim_avg >= 0.2",
    "pp_percentile": "WITH " + _PAIRS + ", t AS (SELECT {M:sim_avg:0.5} AS cut FROM pairs) SELECT a, b, round(sim_avg, 6) AS sim FROM pairs CROSS JOIN t WHERE sim_avg >= cut",
    "pp_cdf": "WITH " + _PAIRS + " SELECT a, b, round(sim_avg * cume_dist() OVER (ORDER BY sim_avg), 6) AS sim FROM pairs",
    "community_strength": "WITH " + _PAIRS + ", w AS (SELECT x.lang AS ca, y.lang AS cb, sum(sim_avg) AS s FROM pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b GROUP BY x.lang, y.lang), t AS (SELECT sum(s) AS total FROM w), e AS (SELECT ca AS c, sum(CASE WHEN ca = cb THEN s ELSE s / 2 END) AS half, sum(CASE WHEN ca = cb THEN s ELSE 0 END) AS inside FROM w GROUP BY ca UNION ALL SELECT cb, sum(s / 2), 0.0 FROM w WHERE ca <> cb GROUP BY cb), g AS (SELECT c, sum(half) / max(total) AS share, sum(inside) / max(total) AS own FROM e CROSS JOIN t GROUP BY c) SELECT c AS cluster, round(own - share * share, 6) AS strength FROM g",
    "cluster_avg_similarity": "WITH " + _PAIRS + " SELECT x.lang AS cluster, round(avg(sim_avg), 6) AS mean, count(*) AS n FROM pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b AND y.lang = x.lang GROUP BY x.lang",
    "topk_comparisons": "WITH " + _PAIRS + " SELECT a, b, round(sim_avg, 6) AS sim_avg, n_shared FROM pairs ORDER BY round(sim_avg, 6) DESC, a, b LIMIT 2500",
    "smallest_k": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 5",
    "largest_k": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
    "sort_ties": "WITH " + _PAIRS + " SELECT CASE WHEN n_a < n_b OR (n_a = n_b AND a < b) THEN a ELSE b END AS left_id, CASE WHEN n_a < n_b OR (n_a = n_b AND a < b) THEN b ELSE a END AS right_id FROM pairs",
    "viewer_filter": "WITH " + _PAIRS + " SELECT a, b, round(sim_avg, 6) AS sim_avg FROM pairs WHERE sim_avg > 0.5 AND sim_max >= 0.6",
    "set_ops": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "name_to_id": "SELECT DISTINCT c_mktsegment AS name, regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '_') AS id FROM customer",
    "event_properties": "SELECT event_type, {KEY} AS k, count(*) AS n FROM events GROUP BY event_type, {KEY}",
}


def _filled(text: str, parts: dict[str, str]) -> str:
    import re

    text = re.sub(r"\{H:((?:[^{}])*?)\}", lambda m: parts["H"].replace("{x}", m[1]), text)
    text = re.sub(r"\{M:([^:{}]*):([^{}]*)\}", lambda m: parts["MEDIAN"].replace("{x}", m[1]).replace("{p}", m[2]), text)
    for name, part in parts.items():
        text = text.replace("{" + name + "}", part)
    return text


# Spark works out cosines with operators/vectors.py (views sims, large_sims, extremes), and pairs with operators/pairs.py (views
# named pair...) instead of joining all rows of a run; it never deals pairs out anew: what a query adds to the texts of a pair is counted with it, ranks are of
# distinct similarities, and what needs only how many pairs have a similarity never sees pairs. Sums by languages are few; they are written, so that pairs are counted once. Views of a query rest on the same shuffles.
_LISTED = "v AS (SELECT sim_avg AS sim, sum(n) AS n FROM pair_sims GROUP BY sim_avg)"
_IN_SPARK = [
    ("WITH " + _PAIRS + ", old AS (SELECT DISTINCT doc_id FROM labels) SELECT a, b FROM pairs LEFT JOIN old x ON x.doc_id = a LEFT JOIN old y ON y.doc_id = b WHERE x.doc_id IS NULL OR y.doc_id IS NULL", "SELECT a, b FROM pairs_by_label WHERE tag_a IS NULL OR tag_b IS NULL"),
    (SQL["candidate_shingle_join"], "SELECT a, b, n_shared FROM pairs_and_copies"),
    ("WITH " + _PAIRS + ", e AS (SELECT a AS d FROM pairs UNION SELECT b FROM pairs) SELECT", "WITH e AS (SELECT doc_id AS d FROM paired_texts) SELECT"),
    (SQL["freq_weighted_similarity"], "SELECT a, b, round(2 * n_shared - n_texts / top, 4) AS linear, round(2 * (n_shared - n_texts / top), 4) AS proportional, round(2 * n_shared - 2 * n_texts / top + n_squares / top / top, 4) AS quadratic FROM (SELECT *, (SELECT top FROM commonest_run) AS top FROM pairs_by_spread) x"),
    (SQL["overall_summary"], f"WITH {_LISTED}, m AS (SELECT sum(sim * n) / sum(n) AS mean, sum(n) AS total FROM v) SELECT round(max(mean), 6) AS mean, round(percentile(sim, 0.5, n), 6) AS median, round(max(sim), 6) AS top, round(min(sim), 6) AS low, round(sqrt(sum(n * (sim - mean) * (sim - mean)) / nullif(max(total) - 1, 0)), 6) AS std FROM v CROSS JOIN m"),
    (SQL["pp_cdf"], f"WITH {_LISTED}, c AS (SELECT sim, sum(n) OVER (ORDER BY sim) / (SELECT sum(n) FROM v) AS share FROM v) SELECT /*+ BROADCAST(c) */ a, b, round(sim_avg * share, 6) AS sim FROM pairs JOIN c ON c.sim = sim_avg"),
    ("WITH " + _PAIRS + ", t AS (SELECT {M:sim_avg:0.5} AS cut FROM pairs)", f"WITH {_LISTED}, t AS (SELECT percentile(sim, 0.5, n) AS cut FROM v)"),
    ("SELECT x.lang AS ca, y.lang AS cb, sum(sim_avg) AS s FROM pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b GROUP BY x.lang, y.lang", "SELECT tag_a AS ca, tag_b AS cb, s FROM pair_sums_by_lang"),
    ("SELECT x.lang AS cluster, round(avg(sim_avg), 6) AS mean, count(*) AS n FROM pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b AND y.lang = x.lang GROUP BY x.lang", "SELECT tag_a AS cluster, round(s / n, 6) AS mean, n FROM pair_sums_by_lang WHERE tag_a = tag_b"),
    *[(SQL[k], SQL[k].replace("WITH " + _PAIRS, "WITH" if k == "similarity_distribution" else "").replace("WITH,", "WITH").replace("count(*)", "sum(n)").replace("FROM pairs", "FROM pair_sims").strip()) for k in ("similarity_distribution", "rebucket", "filter_score_band")],
    ("WITH " + _PAIRS + ", every AS", "WITH " + _PAIRS + ", every AS"),  # it needs the places of runs
    ("WITH " + _COSINE + " SELECT new_id, round(min(1 - sim), 6) AS diff FROM sims GROUP BY new_id", "SELECT new_id, round(min(1 - real), 6) AS diff FROM extremes GROUP BY new_id"),
    # high - 0.01 * (high - low) is never above high, so the verdict is that of low = high
    ("WITH " + _COSINE + ", r AS (SELECT new_id, max(sim) AS high, min(sim) AS low FROM sims GROUP BY new_id)", "WITH r AS (SELECT new_id, max(high) AS high, max(high) AS low FROM extremes GROUP BY new_id)"),
    ("WITH " + _COSINE + ", r AS (SELECT label, new_id, max(sim) AS high FROM sims GROUP BY label, new_id)", "WITH r AS (SELECT label, new_id, high FROM extremes)"),
    ("WITH " + _COSINE + " SELECT new_id, old_id, sim FROM sims WHERE sim > 0.4", "SELECT new_id, old_id, sim FROM large_sims WHERE sim > 0.4"),
    ("WITH " + _COSINE + ",", "WITH"),
    ("WITH " + _COSINE + " ", ""),
    ("WITH " + _PAIRS + ",", "WITH"),
    ("WITH " + _PAIRS + " ", ""),
]


def _in_spark(text: str) -> str:
    for theirs, ours in _IN_SPARK:
        if theirs in text:
            text = text.replace(theirs, ours)
            if theirs == ours:
                break
    return text


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("*", "CAST(2 * n_shared AS double) / (n_a + n_b) AS sim_avg", "CAST(n_shared AS double) / least(n_a, n_b) AS sim_max")


def _counted(sims: DataFrame) -> DataFrame:
    return sims.withColumn("sim_avg", F.expr("CAST(2 * n_shared AS double) / n_both"))


def _dealt(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], paired.Dealt]]:
    docs = read(spark, sf_dir, "documents")
    tags = {"lang": lambda: docs.selectExpr("doc_id", "lang AS tag"), "label": lambda: read(spark, sf_dir, "labels").selectExpr("doc_id", "'old' AS tag").filter("doc_id IS NOT NULL").distinct()}
    return {"": cache(lambda: paired.dealt(docs, GRAM))} | {k: cache(lambda f=f: paired.dealt(docs, GRAM, f())) for k, f in tags.items()}


#: (spark, folder, documents dealt for the query by their tag)
VIEWS: dict[str, Callable[[SparkSession, str, dict[str, Callable[[], paired.Dealt]]], DataFrame]] = {
    "pairs": lambda spark, d, of: _scored(paired.shared_runs(of[""]())),
    "pairs_and_copies": lambda spark, d, of: paired.shared_runs(of[""](), copies=True),
    "pairs_by_label": lambda spark, d, of: _scored(paired.shared_runs(of["label"]())),
    "pairs_by_spread": lambda spark, d, of: paired.shared_runs(of[""](), spread=True),
    "pair_sims": lambda spark, d, of: _counted(paired.similarity_counts(of[""]())),
    "pair_sums_by_lang": lambda spark, d, of: kept(_counted(paired.similarity_counts(of["lang"]())).groupBy("tag_a", "tag_b").agg(F.sum(F.col("sim_avg") * F.col("n")).alias("s"), F.sum("n").alias("n")), "sums"),
    "commonest_run": lambda spark, d, of: paired.commonest_run(of[""]()),
    "paired_texts": lambda spark, d, of: paired.paired_texts(of[""]()),
    "sims": lambda spark, d, of: vectors.cosines(read(spark, d, "embeddings")).withColumn("sim", F.round("sim", 6)),
    "large_sims": lambda spark, d, of: vectors.cosines(read(spark, d, "embeddings"), 0.39).withColumn("sim", F.round("sim", 6)),
    "extremes": lambda spark, d, of: vectors.extremes(read(spark, d, "embeddings"), low=False).withColumns({"high": F.round("high", 6), "real": F.round("real", 6)}),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    spark_sql = _filled(_in_spark(text), _SPARK)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import re

        for name in TABLES:
            if re.search(rf"\b{name}\b", spark_sql):
                read(spark, sf_dir, name).createOrReplaceTempView(name)
        of = _dealt(spark, sf_dir) if re.search(r"\b(FROM|JOIN) (pair|commonest_run)", spark_sql) else {}
        for name, view in VIEWS.items():
            if re.search(rf"\b(FROM|JOIN) {name}\b", spark_sql) and f"{name} AS (" not in spark_sql:
                view(spark, sf_dir, of).createOrReplaceTempView(name)
        return spark.sql(spark_sql)

    return run


KERNELS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gst": tiling.gst_query,
    "gst_simple": tiling.gst_simple_query,
    "match_merging": tiling.merging_query,
    "cluster_agglomerative": clustering.agglomerative_query,
    "sim_degree": graphs.degree_similarity_query,
    "word2vec_fit": graphs.walk_embeddings_query,
}


def _all() -> dict[str, str]:
    from affinis.plans import extended

    return SQL | extended.SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from affinis.plans import library

    return {name: _query(text) for name, text in _all().items()} | KERNELS | library.queries()


def oracle_sql() -> dict[str, str]:
    return {name: _filled(text, _DUCK) for name, text in _all().items()}
