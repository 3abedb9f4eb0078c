"""DuckDB SQL twins of those numbered queries that SQL can express.

The others have none: tokens (1, 8), variants (4), 64-bit hashes (5, 9), a forest (7), a greedy map (10) and a
tree folded along each path (13) are tested against plain Python.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: Starts of repeated windows (doc_id, p), joined to maximal spans, and the pieces (doc_id, a, b) between them, of documents (doc_id, n).
_SPANS = """
starts AS (SELECT w.doc_id, w.p FROM w JOIN (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s) f
           ON w.s = f.s AND w.doc_id > f.first_doc),
islands AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (
    SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM starts) o),
spans AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM islands GROUP BY doc_id, k),
pieces AS (
    SELECT d.doc_id, 0 AS a, coalesce(min(s.lo), d.n) AS b FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.n
    UNION ALL
    SELECT s.doc_id, s.hi, coalesce(lead(s.lo) OVER (PARTITION BY s.doc_id ORDER BY s.lo), d.n) FROM spans s JOIN d ON d.doc_id = s.doc_id),
gone AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)"""

#: Strings are byte strings; what is kept is put together in hexadecimal, two digits a byte.
ORACLE["op2_suffix_array_dedup"] = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, t[p + 1 : p + 50] AS s FROM (SELECT doc_id, t, unnest(range(0, n - 49)) AS p FROM d) q),
{_SPANS},
kept AS (SELECT p.doc_id, string_agg(hex(d.t)[2 * p.a + 1 : 2 * p.b], '' ORDER BY p.a) AS k FROM pieces p JOIN d ON d.doc_id = p.doc_id
         GROUP BY p.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(g.n_removed, 0) AS n_removed, coalesce(g.n_spans, 0) AS n_spans, sha256(unhex(k.k)) AS kept_sha256
FROM d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
"""

ORACLE["op6_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws, len({_WORDS.format(text="coalesce(text, '')")}) AS n FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p + 1 : p + 50], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(0, n - 49)) AS p FROM d) q),
{_SPANS},
kept AS (SELECT p.doc_id, array_to_string(flatten(list(d.ws[p.a + 1 : p.b] ORDER BY p.a)), ' ') AS k FROM pieces p
         JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, d.n AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _jaccard(words: int, more: str = "") -> str:
    """Components of documents linked at 85 % by shingles of so many words."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
x AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + {words}], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - {words - 1}, 1))) AS p FROM d WHERE len(ws) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id
          JOIN n m ON m.doc_id = a.doc_id JOIN n k ON k.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, m.n, k.n
          HAVING 100 * count(*) >= 85 * (m.n + k.n - count(*))),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM sides UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id{more}
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


ORACLE["op3_ngram_jaccard_join"] = _jaccard(4)
ORACLE["op12_minhash_dedup"] = _jaccard(5, ", d.doc_id = least(d.doc_id, coalesce(r.low, d.doc_id)) AS kept")

#: Scores are sums of whole numbers far below 2^53, so doubles hold them exactly.
ORACLE["op11_hard_negatives"] = """
WITH raw AS (SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM raw),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0 AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""
