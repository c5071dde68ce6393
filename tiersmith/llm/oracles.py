"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping

from tiersmith.llm.mixing import OTHER
from tiersmith.llm.queries import LANGUAGES, SOURCES, TOPIC_RULES, TOPICS

ROUNDS, KEEP = 30, 0.5


def _wanted(name: str, wanted: Mapping[str, float]) -> str:
    """Target shares: listed categories that occur beside the others' own share."""
    rows = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in wanted.items())
    return f"""
{name}_now AS (SELECT {name} AS c, sum(n) / (SELECT sum(n) FROM cells) AS share FROM cells WHERE n > 0 GROUP BY 1),
{name}_rest AS (SELECT coalesce(sum(share), 0) AS r FROM {name}_now WHERE c = '{OTHER}'),
{name}_goal AS (
  SELECT c, w / sum(w) OVER () * (1 - r) AS goal
  FROM (VALUES {rows}) v(c, w) SEMI JOIN {name}_now USING (c), {name}_rest
  UNION ALL SELECT c, share FROM {name}_now WHERE c = '{OTHER}')"""


def mixture_sql() -> str:
    """Raking of the cells, one nested query per axis and round, and the documents' draws."""
    listed = {"source": SOURCES, "lang": LANGUAGES, "topic": TOPICS}
    rules = " ".join(f"WHEN contains(text, '{part}') THEN '{name}'" for name, part in TOPIC_RULES)
    keyed = ", ".join(
        f"CASE WHEN {c} IN ({', '.join(map(repr, wanted))}) THEN {c} ELSE '{OTHER}' END AS {c}_key"
        for c, wanted in listed.items()
    )
    steps = ["r0 AS MATERIALIZED (SELECT *, n / sum(n) OVER () AS f FROM cells WHERE n > 0)"]
    for k in range(ROUNDS):
        for i, c in enumerate(listed):
            at = 3 * k + i
            steps.append(
                f"r{at + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.n, r.f * g.goal / sum(r.f) OVER (PARTITION BY r.{c}) AS f"
                f" FROM r{at} r JOIN {c}_goal g ON r.{c} = g.c)"
            )
    goals = ",".join(_wanted(c, wanted) for c, wanted in listed.items())
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE {rules} ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n
  FROM documents),
keyed AS MATERIALIZED (SELECT *, {keyed} FROM docs),
cells AS MATERIALIZED (
  SELECT source_key AS source, lang_key AS lang, topic_key AS topic, sum(n)::DOUBLE AS n FROM keyed GROUP BY ALL),
{goals},
{", ".join(steps)},
weights AS (SELECT source, lang, topic, n, f / (n / sum(n) OVER ()) AS ratio FROM r{3 * ROUNDS}),
sums AS (
  SELECT ratio, ({KEEP} * sum(n) OVER () - coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(n * ratio) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM weights WINDOW o AS (ORDER BY ratio DESC, source, lang, topic)),
fit AS (SELECT coalesce(arg_max(scale, ratio), 'inf'::DOUBLE) AS scale FROM sums WHERE scale * ratio <= 1),
drawn AS (
  SELECT k.*, coalesce(least(scale * w.ratio, 1.0), least(1.0, scale)) AS p,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM keyed k CROSS JOIN fit LEFT JOIN weights w
    ON w.source = k.source_key AND w.lang = k.lang_key AND w.topic = k.topic_key)
SELECT doc_id, source, lang, topic_key AS topic, n::BIGINT AS n_tokens, round(p, 6) AS probability, u < p AS kept FROM drawn
"""


TOP_K = """
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

NEAR_VECTORS = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""


#: Unsigned CRC-32 (reflected polynomial 0xEDB88320) of the text ``word`` of table ``texts(word)``, as ``sums(word, crc)``:
#: the sum is linear over bits, so each byte adds a term that depends on its value and its distance from the end.
CRC_STEPS = """
longest AS (SELECT coalesce(max(strlen(word)), 0) AS most FROM texts),
one AS (
  SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM range(256) r(b)
),
terms AS (
  WITH RECURSIVE far(distance, b, t) AS (
    SELECT 0, b, t FROM one
    UNION ALL
    SELECT distance + 1, far.b, xor(far.t >> 8, one.t) FROM far JOIN one ON one.b = far.t & 255, longest WHERE distance < most
  )
  SELECT * FROM far
),
start AS (
  WITH RECURSIVE begin(n, c) AS (
    SELECT 0, 4294967295
    UNION ALL
    SELECT n + 1, xor(c >> 8, one.t) FROM begin JOIN one ON one.b = c & 255, longest WHERE n < most
  )
  SELECT * FROM begin
),
bytes AS (
  SELECT word, strlen(word) - i AS distance, ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::INTEGER AS b
  FROM (SELECT word, unnest(range(1, strlen(word) + 1)) AS i FROM texts)
),
sums AS (
  SELECT word, xor(xor(x, c), 4294967295) AS crc
  FROM (SELECT word, strlen(word) AS n, bit_xor(t) AS x FROM bytes JOIN terms USING (distance, b) GROUP BY ALL) JOIN start USING (n)
)"""

IMPORTANCE_RESAMPLING = f"""
WITH corpus AS (
  SELECT 0 AS side, row_number() OVER () AS place, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
),
split AS (
  SELECT side, place, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM corpus
),
grams AS (
  SELECT side, place, words[i:i + k] AS run FROM (
    SELECT side, place, words, unnest(range(1, len(words) + 1)) AS i FROM split
  ), range(3) r(k) WHERE i + k <= len(words)
),
counted AS (SELECT side, place, array_to_string(run, ' ') AS word, count(*) AS n FROM grams GROUP BY ALL),
texts AS (SELECT DISTINCT word FROM counted),
{CRC_STEPS},
features AS (SELECT side, place, crc % 10000 AS bucket, sum(n) AS n FROM counted JOIN sums USING (word) GROUP BY ALL),
held AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
  FROM range(10000) r(bucket) LEFT JOIN features USING (bucket) GROUP BY ALL
),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM held
),
weighed AS (
  SELECT c.doc_id, place, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * gain), 0)::BIGINT AS weight
  FROM corpus c LEFT JOIN (SELECT * FROM features JOIN gains USING (bucket) WHERE side = 0) f USING (place)
  WHERE c.side = 0 GROUP BY ALL
),
scored AS (
  SELECT doc_id, n_features, weight,
    weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score,
    len(words) >= 20 AS open
  FROM weighed JOIN (SELECT place, words FROM split WHERE side = 0) USING (place)
),
turned AS (
  SELECT *, row_number() OVER (PARTITION BY coalesce(open, false) ORDER BY score DESC, doc_id) AS turn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND turn <= (SELECT 5 * count(*) // 100 FROM scored WHERE open) THEN turn END AS rank
FROM turned"""

SPELLING_VARIANTS = f"""
WITH runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
counted AS (SELECT id || ':' || run AS word, run, count(*) AS n FROM runs GROUP BY ALL),
texts AS (SELECT DISTINCT word FROM counted),
{CRC_STEPS},
printed AS (
  SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, (crc % length(run))::INTEGER) || substr(run, (crc % length(run))::INTEGER + 2) ELSE run END AS word, n
  FROM counted JOIN sums USING (word)
),
known AS (SELECT word, sum(n)::BIGINT AS n FROM printed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (
  SELECT word, n, i, left(word, i) AS front, substr(word, i + 2) AS back FROM (SELECT word, n, unnest(range(length(word))) AS i FROM known)
),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b USING (i, front, back) WHERE a.word <> b.word
  UNION
  SELECT a.word, k.word, k.n FROM gaps a JOIN known k ON k.word = a.front || a.back
  UNION
  SELECT k.word, a.word, a.n FROM gaps a JOIN known k ON k.word = a.front || a.back
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS most FROM near GROUP BY word
),
judged AS (
  SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * k.n THEN other END AS form, CASE WHEN most >= 5 * k.n THEN most END AS form_n
  FROM known k LEFT JOIN best USING (word)
),
chains AS (
  WITH RECURSIVE walk(word, now, step) AS (
    SELECT word, word, 0 FROM judged
    UNION ALL
    SELECT w.word, j.form, step + 1 FROM walk w JOIN judged j ON j.word = w.now WHERE j.form IS NOT NULL
  )
  SELECT word, arg_max(now, step) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN chains USING (word)"""


ORACLES = {
    "op4_mix_sources": mixture_sql(),
    "op5_exact_top_k": TOP_K,
    "op7_embedding_near_dedup": NEAR_VECTORS,
    "op11_importance_resampling": IMPORTANCE_RESAMPLING,
    "op12_spelling_variants": SPELLING_VARIANTS,
}
