"""SQL for another engine that must give the rows of the queries that SQL can express.

Written independently of the operators: lists of words and plain joins, for small tables.
"""

from __future__ import annotations

from repolume.llm.secret_scan import BASE_RULES, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

JACCARD = rf"""WITH RECURSIVE w AS MATERIALIZED (
 SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(words, i, i + 3) AS s
 FROM w, LATERAL unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS t(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
 FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
 WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM w
 UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles,
 min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1"""

_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS words FROM documents),
item AS (SELECT item_id, {_PLAIN} AS words FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, list_slice(words, i, i + 9) AS k
 FROM item, LATERAL unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT len(k) AS n FROM win),
here AS (SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS k
 FROM d, sizes, LATERAL unnest(range(1, len(words) - n + 2)) AS t(i)),
occ AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM here JOIN win USING (k)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit
 FROM (SELECT DISTINCT doc_id, i, n FROM occ), LATERAL unnest(range(0, n)) AS t(j) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
 coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _rule(order: int) -> str:
    rule = RULES[order]
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind,
 list_sum(list_transform(p[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS s, length(w[i]) AS n
FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS p,
  regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS w,
  regexp_extract_all(coalesce(text, ''), '{pattern}', {rule.group}) AS g FROM documents),
 LATERAL unnest(range(1, len(w) + 1)) AS t(i) WHERE length(g[i]) >= {rule.least}"""


_SPANS = "\nUNION ALL ".join(_rule(i) for i in range(len(RULES)))
_COUNTS = ",\n ".join(
    f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES
)
_ONE = "kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR)"

SECRETS = f"""WITH spans AS ({_SPANS})
SELECT doc_id, {_COUNTS},
 sha256(coalesce(string_agg({_ONE}, ',' ORDER BY s, o) FILTER (WHERE o < {len(BASE_RULES)}), ''))
  AS base_sha256,
 coalesce(string_agg({_ONE}, ',' ORDER BY s, o) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""

_LEADS = ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 20))

SUBSTRINGS = f"""WITH w AS MATERIALIZED (
 SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
flat AS MATERIALIZED (SELECT doc_id, len(words) AS n, unnest(words) AS word,
 unnest(range(1, len(words) + 1)) AS i FROM w),
run AS (SELECT doc_id, i, n, concat_ws(' ', word, {_LEADS}) AS k
 FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r
 FROM run WHERE i + 19 <= n),
gone AS (SELECT DISTINCT doc_id, i + j AS i
 FROM win, LATERAL unnest(range(0, 20)) AS t(j) WHERE r > 1),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
 FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
 CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

NEGATIVES = """WITH v AS MATERIALIZED (
 SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
 FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
 negative_score FROM n WHERE rank <= 10"""

ORACLES = {
    "op4_jaccard": JACCARD,
    "op6_decontaminate": DECONTAMINATE,
    "op7_secrets": SECRETS,
    "op9_substrings": SUBSTRINGS,
    "op11_negatives": NEGATIVES,
}
