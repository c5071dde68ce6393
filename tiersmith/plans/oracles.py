"""DuckDB SQL with the same meaning as each query in ``driver_queries``."""

from __future__ import annotations

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean(c: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g')), 'nan')"


K = "CAST(regexp_extract(props, '\"k\": (-?[0-9]+)', 1) AS INTEGER)"
WORDS = (
    r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}'),"
    " lambda w: w NOT IN ('the','and','of','to','in','on','at','is','it','un','la','le','el','en','der','ein'))"
)


def _terms(limit: int) -> str:
    return f"""
  words AS (SELECT doc_id, {WORDS} AS w FROM documents),
  terms AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t
            FROM words),
  tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM terms) GROUP BY ALL),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf, sum(n) AS total
          FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {limit})"""


RULE = """
  rule AS (SELECT d.lang, quality + toxic AS actual,
             CASE WHEN n_chars < 300 THEN 0 WHEN n_chars < 900 THEN 1 ELSE 2 END AS predicted
           FROM labels JOIN documents d USING (doc_id))"""
SCORES = """
  seen AS (SELECT {g} actual AS class FROM rule UNION SELECT {g} predicted FROM rule),
  scores AS (SELECT {sg} s.class, count(*) FILTER (r.actual = s.class AND r.predicted = s.class) AS tp,
               count(*) FILTER (r.actual = s.class) AS support, count(*) FILTER (r.predicted = s.class) AS hits
             FROM seen s JOIN rule r ON {on} GROUP BY ALL),
  parts AS (SELECT *, CASE WHEN hits > 0 THEN tp / hits ELSE 0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
              2.0 * tp / (hits + support) AS f1 FROM scores)"""


def _scaled(c: str) -> str:
    return (
        f"({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)) / (SELECT CASE WHEN quantile_cont({c}, 0.75) ="
        f" quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM lineitem)"
    )


def _md5_rank(key: str, label: str, seed: int) -> str:
    return f"row_number() OVER (PARTITION BY {label} ORDER BY md5(concat({key}, '|{seed}')), {key})"


def _allocation(table: str, label: str, total: str) -> str:
    return f"""
  sizes AS (SELECT {label}, count(*) AS m, (SELECT count(*) FROM {table}) AS n FROM {table} GROUP BY ALL),
  exact AS (SELECT {label}, {total} * m / n AS e, {total} AS wanted FROM sizes),
  spare AS (SELECT *, row_number() OVER (ORDER BY e - floor(e) DESC, {label}) AS r,
              wanted - (SELECT sum(floor(e)) FROM exact) AS left_over FROM exact),
  allocation AS (SELECT {label}, floor(e) + CASE WHEN r <= left_over THEN 1 ELSE 0 END AS take FROM spare)"""


CELLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE = """
  line AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 + l_tax) AS gross,
             -l_extendedprice * (1 - l_discount) AS net FROM lineitem)"""
NAMES = [*CELLS, "gross", "net"]
PAIRS = [(NAMES[i], NAMES[j]) for i in range(6) for j in range(i + 1, 6)]

CENTROIDS = """
WITH e AS (SELECT vec_id AS key, CASE WHEN label <= 3 THEN 0 WHEN label <= 6 THEN 1 ELSE label - 5 END AS label,
             CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM e),
  m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
  c AS (SELECT label AS class, list(x ORDER BY i) AS c FROM m GROUP BY 1),
  d AS (SELECT key, label, class, exp(-list_distance(v, c)) AS w FROM e, c),
  probs AS (SELECT key, label, list(w / t ORDER BY class) AS p
            FROM (SELECT *, sum(w) OVER (PARTITION BY key) AS t FROM d) GROUP BY 1, 2),
  candidates AS (SELECT * FROM (VALUES
    (0, [1.0, 1.0, 1.0, 1.0, 1.0]::DOUBLE[]), (1, [0.6, 1.0, 1.1, 1.2, 1.3]::DOUBLE[]),
    (2, [0.3, 0.7, 1.5, 1.6, 2.0]::DOUBLE[]), (3, [2.0, 1.0, 0.5, 0.4, 0.3]::DOUBLE[]),
    (4, [0.9, 1.2, 0.8, 1.4, 0.7]::DOUBLE[]), (5, [0.1, 0.2, 0.4, 0.8, 1.6]::DOUBLE[])) t(candidate, w))"""

ORACLES: dict[str, str] = {
    "tier_summary": """
SELECT CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
         WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS INTEGER) AS tier,
       count(*) AS n, round(avg(o_totalprice), 4) AS avg_price, round(avg(c_acctbal), 4) AS avg_balance
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING tier IS NOT NULL""",
    "catalogue_clean": rf"""
WITH j AS (
  SELECT * FROM documents JOIN part ON doc_id = p_partkey
  WHERE lang <> 'es' AND p_size < 45 AND n_chars % 28 + 1 <= 20)
SELECT doc_id AS steam_appid, source || ' ' || lang AS name, length({_clean("text")}) AS n_text,
  source AS short_description, replace(p_type, ' ', '_') || '|' || replace(p_brand, ' ', '_') AS tags,
  'Single_player' AS categories, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS num_languages_supported,
  CAST(CASE WHEN n_chars % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS num_dlc,
  CAST(CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS platform_mac,
  CAST(CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_controller_supported,
  CAST(1 AS INTEGER) AS req_dedicated_gpu,
  round(n_chars / 1024.0::DOUBLE, 6) AS min_ram_gb, round(n_chars / 1024.0::DOUBLE, 6) AS rec_ram_gb,
  CASE WHEN n_chars % 7 = 0 THEN 0.0::DOUBLE ELSE round(p_retailprice, 6) END AS price,
  CASE WHEN n_chars % 7 = 0 THEN 0.0::DOUBLE ELSE 15.0::DOUBLE END AS discount,
  round(p_size / (p_size + length(p_name))::DOUBLE, 6) AS review_ratio,
  CAST(11 AS INTEGER) AS release_month,
  CAST(CASE WHEN p_size < 15 THEN 0 WHEN p_size < 30 THEN 1 ELSE 3 END AS INTEGER) AS target_owners
FROM j WHERE {_clean("text")} IS NOT NULL
  AND NOT regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}\x{{0400}}-\x{{04ff}}]')""",
    "clean_html": f"""
SELECT page_id, {_clean("html")} AS text, length({_clean("html")}) AS n_chars
FROM pages WHERE {_clean("html")} IS NOT NULL""",
    "script_filter": "SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '[À-ÿ]')",
    "quality_report": """
WITH f AS (SELECT lang <> 'de' AS a, NOT regexp_matches(text, '[À-ÿ]') AS b, n_chars >= 100 AS c FROM documents)
SELECT 'rows_in' AS step, count(*) AS row_count FROM f
UNION ALL SELECT 'language', count(*) FROM f WHERE NOT a
UNION ALL SELECT 'script', count(*) FROM f WHERE a AND NOT b
UNION ALL SELECT 'length', count(*) FROM f WHERE a AND b AND NOT c
UNION ALL SELECT 'rows_out', count(*) FROM f WHERE a AND b AND c""",
    "keyword_flags": """
WITH t AS (SELECT doc_id, lower(source || ' ' || text) AS t FROM documents)
SELECT doc_id, CAST(regexp_matches(t, 'tion') AS INTEGER) AS has_tion,
  CAST(regexp_matches(t, 'eaux|oui') AS INTEGER) AS has_eaux,
  CAST(regexp_matches(t, 'th[aeio]*th') AS INTEGER) AS has_thth,
  CAST(regexp_matches(t, '[0-9]{3}') AS INTEGER) AS has_digit FROM t""",
    "quantity_extract": """
SELECT p_partkey, round(CASE p_type WHEN 'ECONOMY' THEN p_size * 100 / 1024.0::DOUBLE
  WHEN 'STANDARD' THEN p_size + 0.5::DOUBLE WHEN 'PROMO' THEN p_size * 1000 / 1048576.0::DOUBLE END, 6) AS ram_gb
FROM part""",
    "json_lookup": f"SELECT event_id, {K} AS k, 'none' AS absent FROM events",
    "literal_lists": """
SELECT p_partkey, replace(p_name, ' ', '_') || '|' AS described,
  replace(p_name, ' ', '_') || '|' || replace(p_brand, ' ', '_') AS listed,
  replace(p_name, ' ', '_') || '|' || replace(p_type, ' ', '_') AS commas,
  CAST(2 AS BIGINT) AS n_listed, CAST(2 AS BIGINT) AS n_commas FROM part""",
    "coerce_impute": f"""
SELECT event_id,
  CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN -{K} ELSE {K} END AS INTEGER) AS number,
  CAST(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE least(1, {K}) END AS INTEGER) AS flag FROM events""",
    "presence_flags": """
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS has_notice FROM events""",
    "date_parts_filter": """
WITH d AS (SELECT CASE WHEN o_orderpriority = '3-MEDIUM' THEN date_trunc('month', o_orderdate)
                       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderdate END AS d FROM orders)
SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, count(*) AS n
FROM d WHERE CAST(d AS DATE) <= DATE '1998-06-15' GROUP BY 1, 2""",
    "price_rules": """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END, 6) AS price,
  round(l_discount, 6) AS discount FROM lineitem""",
    "review_ratio": """
WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS e
           FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN p + e > 0 THEN p / (p + e) ELSE 0 END, 6) AS ratio FROM u""",
    "top_tokens": """
SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
GROUP BY token ORDER BY n DESC, token LIMIT 20""",
    "multi_hot": """
WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part),
  v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS slot FROM (SELECT DISTINCT token FROM t))
SELECT p_partkey, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots FROM t JOIN v USING (token) GROUP BY 1""",
    "word_slots": """
WITH t AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS token FROM documents),
  v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS slot FROM (SELECT DISTINCT token FROM t))
SELECT CAST(doc_id AS BIGINT) AS doc_id, slot FROM t JOIN v USING (token)""",
    "top_creator_flags": """
WITH m AS (SELECT p_partkey, unnest([p_brand, p_type]) AS v FROM part),
  top AS (SELECT v FROM m GROUP BY v ORDER BY count(*) DESC, v LIMIT 5)
SELECT p_partkey, CAST(count(*) FILTER (v IN (SELECT v FROM top)) AS INTEGER) AS hits FROM m GROUP BY 1""",
    "top_map_keys": """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c)
SELECT user_id, string_agg(event_type, '|' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY 1""",
    "tfidf_terms": f"WITH {_terms(30)} SELECT term, round(idf, 6) AS idf FROM idf",
    "tfidf_vectors": f"""
WITH {_terms(15)},
  slots AS (SELECT term, idf, row_number() OVER (ORDER BY term) - 1 AS slot FROM idf),
  w AS (SELECT doc_id, slot, n * idf AS w FROM tf JOIN slots USING (term))
SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
    "robust_scale": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round({_scaled(c)}, 6) AS {c}" for c in CELLS)
    + " FROM lineitem",
    "inverse_scale": "WITH s AS (SELECT "
    + ", ".join(f"quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS {c}" for c in CELLS)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(l.{c}, 4) AS {c}, round((l.{c} - s.{c}[2]) / (s.{c}[3] - s.{c}[1]), 6) AS {c}_scaled" for c in CELLS
    )
    + " FROM lineitem l, s",
    "mode_impute_onehot": """
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders),
  m AS (SELECT p FROM h WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
  f AS (SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS p FROM h)
SELECT o_orderkey, """
    + ", ".join(
        f"CAST(p = '{p}' AS INTEGER) AS level_{i}"
        for i, p in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    )
    + " FROM f",
    "price_level_slots": """
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DOUBLE) END AS p FROM orders),
  m AS (SELECT p FROM h WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
  v AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS slot FROM (SELECT DISTINCT p FROM h WHERE p IS NOT NULL)),
  f AS (SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS p FROM h)
SELECT o_orderkey, round(p, 6) AS level, slot FROM f JOIN v USING (p)""",
    "corr_matrix": f"WITH {LINE} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN max({b}) > min({b}) THEN round(abs(corr({a}, {b})), 6) END AS r FROM line"
        for a, b in PAIRS
    )
    + "".join(f" UNION ALL SELECT '{a}', 'flag', CAST(NULL AS DOUBLE)" for a in NAMES),  # a constant
    "corr_prune": f"WITH {LINE}, r AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM line" for a, b in PAIRS)
    + "), names AS (SELECT unnest(['l_quantity','l_extendedprice','l_discount','l_tax','gross','net','flag']) AS name)"
    + " SELECT name, CAST(name IN (SELECT b FROM r WHERE r > 0.95) AS INTEGER) AS dropped FROM names",
    "wide_corr_prune": """
WITH words AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), ' ')) AS w FROM documents),
cells AS (
  SELECT doc_id, (ascii(w) - 97) * 24 + least(length(w), 24) - 1 AS slot, count(*)::DOUBLE AS n
  FROM words WHERE ascii(w) BETWEEN 97 AND 122 GROUP BY ALL
),
d AS (SELECT count(DISTINCT doc_id)::DOUBLE AS docs FROM cells),
one AS (SELECT slot, sum(n) AS s, sum(n * n) AS q FROM cells GROUP BY slot),
two AS (
  SELECT a.slot AS earlier, b.slot AS later, sum(a.n * b.n) AS p FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND a.slot < b.slot GROUP BY ALL
),
r AS (
  SELECT earlier, later, (docs * p - a.s * b.s) / sqrt((docs * a.q - a.s * a.s) * (docs * b.q - b.s * b.s)) AS r
  FROM two JOIN one a ON a.slot = earlier JOIN one b ON b.slot = later, d
  WHERE docs * a.q > a.s * a.s AND docs * b.q > b.s * b.s
)
SELECT later::INTEGER AS slot, min(earlier)::INTEGER AS partner FROM r WHERE abs(r) > 0.95 GROUP BY later""",
    "stream_outcomes": """
SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn,
  CASE WHEN role = 'system' THEN 'malformed'
    WHEN regexp_matches(coalesce(text, ''), '[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af\u0400-\u04ff]') THEN 'script' ELSE 'accepted' END AS outcome,
  count(*) OVER () AS n_input, true AS whole FROM conversations""",
    "bundle_scores": """
SELECT vec_id AS key, (CASE WHEN label <= 3 THEN 0 WHEN label <= 6 THEN 1 ELSE label - 5 END)::BIGINT AS label,
  true AS sums_to_one, true AS same FROM embeddings""",
    "class_weights": """
SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels)
  * count(*)), 6) AS weight FROM labels GROUP BY quality""",
    "undersample": f"""
WITH r AS (SELECT doc_id, quality, {_md5_rank("doc_id", "quality", 7)} AS r FROM labels),
  c AS (SELECT count(*) FILTER (quality = 1) AS big, count(*) FILTER (quality = 0) AS small FROM labels)
SELECT doc_id, quality FROM r, c WHERE quality <> 1 OR r <= least(big, greatest(floor(big * 0.25), small))""",
    "oversample_plan": """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, n, CAST(CASE WHEN quality = 0
  THEN greatest(n, floor((SELECT n FROM c WHERE quality = 1) * 0.5)) ELSE n END AS BIGINT) AS target FROM c""",
    "strat_split": f"""
WITH {_allocation("events", "event_type", "ceil(0.2 * n)")},
  r AS (SELECT event_id, event_type, {_md5_rank("event_id", "event_type", 3)} AS r FROM events)
SELECT event_id, CAST(r <= take AS INTEGER) AS is_test FROM r JOIN allocation USING (event_type)""",
    "strat_sample": f"""
WITH {_allocation("events", "event_type", "floor(0.2 * n)")},
  r AS (SELECT event_id, event_type, {_md5_rank("event_id", "event_type", 5)} AS r FROM events)
SELECT event_id, event_type FROM r JOIN allocation USING (event_type) WHERE r <= take""",
    "kfold": f"""
WITH r AS (SELECT event_id, {_md5_rank("event_id", "event_type", 1)} AS r,
             count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, CAST(CAST(r > n // 5 AS INTEGER) + CAST(r > 2 * n // 5 AS INTEGER) + CAST(r > 3 * n // 5 AS INTEGER)
  + CAST(r > 4 * n // 5 AS INTEGER) AS INTEGER) AS fold FROM r""",
    "class_rank": f"SELECT event_id, {_md5_rank('event_id', 'event_type', 2)} AS class_rank FROM events",
    "confusion": f"""
WITH {RULE}, g AS (SELECT a.x AS actual, p.x AS predicted FROM (VALUES (0), (1), (2)) a(x), (VALUES (0), (1), (2)) p(x))
SELECT CAST(g.actual AS INTEGER) AS actual, CAST(g.predicted AS INTEGER) AS predicted, count(rule.lang) AS n
FROM g LEFT JOIN rule ON g.actual = rule.actual AND g.predicted = rule.predicted GROUP BY 1, 2""",
    "macro_metrics": f"""
WITH {RULE}, {SCORES.format(g="lang,", sg="s.lang,", on="r.lang = s.lang")},
  pos AS (SELECT lang, class, row_number() OVER (PARTITION BY lang ORDER BY class) AS i FROM seen),
  q AS (SELECT r.lang, count(*) AS n, sum((a.i - p.i) ^ 2) AS d, sum(a.i) AS sa, sum(p.i) AS sp,
          sum(a.i ^ 2) AS saa, sum(p.i ^ 2) AS spp
        FROM rule r JOIN pos a ON a.lang = r.lang AND a.class = r.actual
                    JOIN pos p ON p.lang = r.lang AND p.class = r.predicted GROUP BY 1),
  k AS (SELECT lang, CASE WHEN n * (saa + spp) - 2 * sa * sp <> 0
          THEN 1 - n * d / (n * (saa + spp) - 2 * sa * sp) END AS kappa FROM q),
  m AS (SELECT lang, sum(tp) / sum(support) AS accuracy, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f
        FROM parts GROUP BY lang)
SELECT lang, round(accuracy, 6) AS accuracy, round(p, 6) AS precision_macro, round(r, 6) AS recall_macro,
  round(f, 6) AS f1_macro, round(kappa, 6) AS quadratic_weighted_kappa FROM m JOIN k USING (lang)""",
    "class_report": f"""
WITH {RULE}, {SCORES.format(g="", sg="", on="true")}
SELECT CAST(class AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM parts
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM parts
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM parts""",
    "group_means": """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1, 2""",
    "group_mean_std": """
SELECT l_returnflag, round(avg(l_quantity), 6) AS q_mean, round(stddev_pop(l_quantity), 6) AS q_std
FROM lineitem GROUP BY 1""",
    "argmax_per_group": """
SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""",
    "first_per_class": """
SELECT event_type, event_id, user_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1""",
    "five_number": """
SELECT l_returnflag, round(min(l_extendedprice), 6) AS q0, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75,
  round(max(l_extendedprice), 6) AS q100 FROM lineitem GROUP BY 1""",
    "top_by_value": """
SELECT l_partkey, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_partkey LIMIT 20""",
    "ranked_models": """
SELECT event_type AS model, round(avg(value), 6) AS mean_score FROM events GROUP BY 1
ORDER BY avg(value) DESC, 1 LIMIT 1""",
    "friedman": """
WITH c AS (SELECT CAST(hour(ts) // 6 AS BIGINT) AS part, CAST(ts AS DATE) AS day, event_type, round(avg(value), 6) AS score
           FROM events GROUP BY 1, 2, 3),
  w AS (SELECT *, count(*) OVER (PARTITION BY part, day) AS k, count(*) OVER (PARTITION BY part, day, score) AS t,
          rank() OVER (PARTITION BY part, day ORDER BY score) AS r FROM c),
  s AS (SELECT part, event_type, sum(r + (t - 1) / 2.0) AS r, sum(t * t - 1) AS t, count(*) AS n
        FROM w WHERE k = 5 GROUP BY 1, 2),
  x AS (SELECT part, max(n) AS n, sum(r * r) AS rr, sum(t) AS t FROM s GROUP BY 1),
  y AS (SELECT part, n, (12.0 / (5 * n * 6) * rr - 3.0 * n * 6) / (1 - t / (5 * 24.0 * n)) AS chi FROM x)
SELECT part, n AS blocks, round(chi, 6) AS statistic, round(exp(-chi / 2) * (1 + chi / 2), 6) AS p_value FROM y""",
    "wilcoxon": """
WITH c AS (SELECT date_trunc('hour', ts) AS block, event_type, round(avg(value), 6) AS score FROM events GROUP BY 1, 2),
  d AS (SELECT o.event_type AS other, round(b.score - o.score, 6) AS diff FROM c o JOIN c b USING (block)
        WHERE o.event_type <> 'purchase' AND b.event_type = 'purchase'),
  r AS (SELECT other, diff, rank() OVER (PARTITION BY other ORDER BY abs(diff))
               + (count(*) OVER (PARTITION BY other, abs(diff)) - 1) / 2.0 AS r,
               count(*) OVER (PARTITION BY other, abs(diff)) AS t FROM d WHERE diff <> 0),
  s AS (SELECT other, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS wp,
          sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS wm, sum(t * t - 1) AS tt FROM r GROUP BY 1),
  t AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0) AS z FROM s),
  u AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM t)
SELECT other, n, wp AS w_plus, wm AS w_minus, least(wp, wm) AS statistic, round(z, 6) AS z,
  CASE WHEN x = 0 THEN 1.0::DOUBLE WHEN x > 4.2 THEN 0.0::DOUBLE ELSE round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150),
    lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(x) - lgamma(k + 1)) / (2 * k + 1))), 6) END AS p_value FROM u""",
    "wilcoxon_exact": """
WITH c AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY 1),
  s AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 6) AS b FROM supplier GROUP BY 1),
  d AS (SELECT n_regionkey AS region, round(a - b, 6) AS diff FROM nation JOIN c ON c.k = n_nationkey JOIN s ON s.k = n_nationkey),
  r AS (SELECT region, diff, rank() OVER (PARTITION BY region ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY region, abs(diff)) - 1) / 2.0 AS r,
          row_number() OVER (PARTITION BY region ORDER BY abs(diff)) - 1 AS place FROM d WHERE diff <> 0),
  w AS (SELECT region, count(*) AS n, least(sum(r) FILTER (diff > 0), sum(r) FILTER (diff < 0)) AS low, sum(r) FILTER (diff > 0) AS wp, sum(r) FILTER (diff < 0) AS wm
        FROM r GROUP BY region),
  f AS (SELECT region, n, least(coalesce(wp, 0), coalesce(wm, 0)) AS statistic FROM w),
  m AS (SELECT region, n, statistic, unnest(range(1::BIGINT << n)) AS mask FROM f),
  v AS (SELECT region, mask, any_value(m.n) AS n, any_value(statistic) AS statistic, sum(CASE WHEN mask >> place & 1 = 1 THEN r ELSE 0 END) AS total
        FROM m JOIN r USING (region) GROUP BY ALL)
SELECT region, n, statistic, round(least(1.0, 2.0 * count(*) FILTER (total <= statistic) / count(*)), 6) AS p_value FROM v GROUP BY ALL""",
    "knn_in_class": """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  d AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance
        FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
SELECT label, vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM r WHERE rank <= 3""",
    "tomek_links": """
WITH e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  n AS MATERIALIZED (
    SELECT a.vec_id AS id, a.label AS la, min({'d': list_distance(a.v, b.v), 'id': b.vec_id, 'label': b.label}) AS m
    FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT x.id AS a, x.m.id AS b, x.la AS label_a, x.m.label AS label_b FROM n x JOIN n y ON x.m.id = y.id AND y.m.id = x.id
WHERE x.id < x.m.id AND x.la <> x.m.label""",
    "tomek_removed": """
WITH e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  n AS MATERIALIZED (
    SELECT a.vec_id AS id, a.label AS la, min({'d': list_distance(a.v, b.v), 'id': b.vec_id, 'label': b.label}) AS m
    FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2),
  gone AS (SELECT x.id FROM n x JOIN n y ON x.m.id = y.id AND y.m.id = x.id WHERE x.la <> x.m.label
           AND x.la <> (SELECT label FROM embeddings GROUP BY label ORDER BY count(*), label LIMIT 1))
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone)""",
    "pad_and_guard": """
SELECT conv_id, turn, CASE WHEN turn > 0 THEN role ELSE 'nobody' END AS name, 0.0::DOUBLE AS price,
  CASE WHEN turn > 0 AND role IS NOT NULL THEN 'price' ELSE 'name,price' END AS imputed
FROM conversations WHERE text IS NULL OR NOT regexp_matches(text, '[À-ÿ]')""",
    "vector_scores": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x, i: exp(x::DOUBLE) * (1.0::DOUBLE / i)) AS s FROM embeddings)
SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS best, round(s[1] / list_sum(s), 6) AS first_share FROM e""",
    "smotenc_counts": """
WITH t AS (SELECT CASE WHEN label <= 3 THEN 0 WHEN label <= 6 THEN 1 ELSE label - 5 END AS label FROM embeddings),
  c AS (SELECT label, count(*) AS n FROM t GROUP BY 1)
SELECT CAST(label AS INTEGER) AS label, CAST(CASE WHEN label = 4 THEN greatest(n, floor(0.6 * (SELECT n FROM c WHERE label = 0)))
  ELSE n END AS BIGINT) AS n FROM c""",
    "two_valued": """
WITH l AS (SELECT l_quantity, l_discount, CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_open,
             1.0::DOUBLE AS one FROM lineitem)
"""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST(count(DISTINCT {c}) <= 2 AS INTEGER) AS categorical, min({c}) AS low,"
        f" max({c}) AS high FROM l"
        for c in ("l_quantity", "l_discount", "is_open", "one")
    ),
    "attach_embedding": """
SELECT doc_id, lang, CAST(len(embedding) AS BIGINT) AS width, round(embedding[1]::DOUBLE, 6) AS x0
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "calibration_grid": CENTROIDS
    + """,
  s AS (SELECT candidate, label, list_transform(p, lambda x, i: x * w[i]) AS s FROM probs, candidates),
  rule AS (SELECT candidate AS lang, label AS actual, list_position(s, list_max(s)) - 1 AS predicted FROM s),
  seen AS (SELECT lang, actual AS class FROM rule UNION SELECT lang, predicted FROM rule),
  pos AS (SELECT lang, class, row_number() OVER (PARTITION BY lang ORDER BY class) AS i FROM seen),
  q AS (SELECT r.lang, count(*) AS n, avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS accuracy,
          sum((a.i - p.i) ^ 2) AS d, sum(a.i) AS sa, sum(p.i) AS sp, sum(a.i ^ 2) AS saa, sum(p.i ^ 2) AS spp
        FROM rule r JOIN pos a ON a.lang = r.lang AND a.class = r.actual
                    JOIN pos p ON p.lang = r.lang AND p.class = r.predicted GROUP BY 1)
SELECT CAST(lang AS INTEGER) AS candidate, round(accuracy, 6) AS accuracy,
  round(1 - n * d / (n * (saa + spp) - 2 * sa * sp), 6) AS kappa FROM q""",
    "calibrated_labels": CENTROIDS
    + """,
  s AS (SELECT key, list_transform(p, lambda x, i: x * w[i]) AS s FROM probs, candidates WHERE candidate = 2),
  b AS (SELECT key, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS prediction,
          round(list_max(s) / list_sum(s), 4) AS confidence FROM s)
SELECT key, prediction, CASE prediction WHEN 0 THEN 'low' WHEN 4 THEN 'high' ELSE 'Tier ' || prediction END
  AS prediction_label, confidence FROM b""",
    "experiment_log": """
SELECT event_type AS model, CAST(day(ts) AS INTEGER) AS fold, round(avg(value), 6) AS accuracy,
  CAST(NULL AS DOUBLE) AS precision_macro, CAST(NULL AS DOUBLE) AS recall_macro, CAST(NULL AS DOUBLE) AS f1_macro,
  -round(avg(value), 6) AS quadratic_weighted_kappa FROM events GROUP BY event_type, CAST(ts AS DATE), day(ts)""",
}
