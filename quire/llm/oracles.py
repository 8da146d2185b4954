"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from quire.llm import mixing, quality_rules as rules

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"list_filter(string_split(translate(coalesce(text, ''), {_WS}, '     '), ' '), lambda x: x <> '')"


def _quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def _chars(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FAILS = f"""(length(t) > 0) AND (
    (n - length(translate(x, '{rules.SYMBOLS}', ''))) > {rules.MAX_SYMBOLS} * n
 OR (n - length(translate(x, '!', ''))) > {rules.MAX_SHOUTS} * n
 OR ((n - length(translate(x, '{rules.UPPER}', ''))) > {rules.MAX_CAPITALS} * n AND n >= 10)
 OR (length(t) < {rules.SHORT_LINE} AND right(t, 1) NOT IN ({_quoted(rules.ENDS)}))
 OR (length(t) < {rules.SHORT_LINE} AND rtrim(translate(low, '.!:', '')) IN ({_quoted(rules.NAVIGATION)}))
 OR ((n - length(translate(x, {_chars(rules.SEPARATORS)}, ''))) >= {rules.MAX_SEPARATORS} AND length(t) < {5 * rules.SHORT_LINE})
 OR (length(t) < {5 * rules.SHORT_LINE} AND ({" OR ".join(f"contains(low, {_chars(b)})" for b in rules.BOILERPLATE)})))"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM dup, range(3) AS ks(k)) GROUP BY r),
lines AS (SELECT r, x, length(x) AS n, trim(x, ' ' || {_WS}) AS t, lower(trim(x, ' ' || {_WS})) AS low FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d)),
byline AS (SELECT r, count(*) FILTER (WHERE t <> '') - count(DISTINCT x) FILTER (WHERE t <> '') AS dups, coalesce(sum(n + 1) FILTER (WHERE NOT ({_FAILS})), 0) AS kept_chars FROM lines GROUP BY r),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(translate(text, ' ' || {_WS}, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{rules.SYMBOLS}', '')))::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  length(text) AS chars, length(text) + 1 - kept_chars AS lost FROM d JOIN byline USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words) AND lost <= {rules.MAX_LOST} * chars AS kept
FROM base"""


def _hash(salt: str) -> str:
    return f"('0x' || substr(md5('{salt}' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT"


OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, {_hash("shard:")} AS h FROM documents),
tree AS (
  SELECT 0 AS depth, 0::BIGINT AS prefix, (SELECT sum(n_bytes) FROM d)::BIGINT AS n, (SELECT count(DISTINCT h) FROM d) AS hs
  UNION ALL
  SELECT depth + 1, p, n, hs FROM (
    SELECT t.depth, d.h >> (60 - t.depth - 1) AS p, sum(d.n_bytes)::BIGINT AS n, count(DISTINCT d.h) AS hs
    FROM tree t JOIN d ON (d.h >> (60 - t.depth)) = t.prefix WHERE t.n > 1048576 AND t.hs > 1 GROUP BY ALL)
)
SELECT doc_id, n_bytes, left(lpad(bin(h), 60, '0'), depth) AS shard_id, depth, n AS shard_bytes, n > 1048576 AS oversized
FROM d JOIN tree ON (d.h >> (60 - depth)) = prefix AND NOT (n > 1048576 AND hs > 1)"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, {_hash("mix:")} AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
wt AS (SELECT *, ([5, 2, 1])[(nth % 3) + 1] AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM src),
ord AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps_before,
  (sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights_left FROM wt),
st AS (SELECT *, (total - caps_before) * weight > cap * weights_left AS stops FROM ord),
fr AS (SELECT *, total - (sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ())::BIGINT AS free, (sum(CASE WHEN NOT stops THEN weight ELSE 0 END) OVER ())::BIGINT AS free_weight FROM st),
goal AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE free::DOUBLE * weight / free_weight END AS target FROM fr),
g2 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM goal),
g3 AS (SELECT *, CASE WHEN whole >= 3 THEN 0.0 ELSE target - whole * source_size END AS budget FROM g2),
hs AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
run AS (SELECT source, h, words, (sum(words) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM hs),
pick AS (SELECT run.source, h, CASE WHEN budget <= 0 THEN false WHEN upto <= budget THEN true
   WHEN upto - words <= budget THEN 2 * (budget - (upto - words)) >= words ELSE false END AS more FROM run JOIN g3 ON run.source IS NOT DISTINCT FROM g3.source)
SELECT d.doc_id, size, source_size, target, (whole + more::BIGINT) * size AS taken
FROM d JOIN g3 ON d.source IS NOT DISTINCT FROM g3.source JOIN pick ON d.source IS NOT DISTINCT FROM pick.source AND d.h = pick.h"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(translate({_LOWER}, {_WS}, '     '), ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.a = d.doc_id"""

OP7 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM dup, range(35) AS ks(k)),
lost AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE r IN (SELECT r FROM lost)),
kept AS (SELECT r, array_to_string(list(x ORDER BY p), ' ') AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN lost.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k, '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

ORACLES = {"op2_topk": OP2, "op7_substring_dedup": OP7, "op1_near_dedup": OP1, "op5_sharding": OP5, "op9_quality_rules": OP9, "op10_mixing": OP10}
assert mixing.WEIGHTS == (5, 2, 1) and mixing.MOST == 3
