"""DuckDB SQL of the training-data queries that can be said in SQL."""

from __future__ import annotations


def _crc(data: str) -> str:
    """Unsigned CRC-32 of a list of bytes, bit by bit."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"list_reduce(list_concat([xor(a, b)], range(8)), lambda c, k: {step})"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda a, b: {byte}), 4294967295)"


def _bytes(text: str) -> str:
    """UTF-8 bytes of a text of code points under U+0800."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*map(_field, ("doc_id", "source", "lang", "n_chars")), _field(text)]) + ")"


_EVEN = f"{_crc(_bytes('doc_id::VARCHAR'))} % 2 = 0"
_NODES = "string_agg(h, '' ORDER BY i)"

#: Trees of fan-out 3 level by level; siblings joined per document and level.
MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_leaf('text')}) - 1 AS i, doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {_EVEN} THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS tampered
  FROM documents),
low AS (
  SELECT source, 0 AS l, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM d
  UNION ALL
  SELECT source, l + 1, i // 3, sha256({_NODES}), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY source, l, i // 3, n),
subroots AS (SELECT source, h AS subroot, max(l) OVER (PARTITION BY source) AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM low WHERE n = 1),
high AS (
  SELECT 0 AS l, place AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT l + 1, i // 3, sha256({_NODES}), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY l, i // 3, n),
sides AS (
  SELECT source, l, i, coalesce(string_agg(o, '' ORDER BY j) FILTER (j < i), '') AS a, coalesce(string_agg(o, '' ORDER BY j) FILTER (j > i), '') AS b
  FROM (SELECT x.source, x.l, x.i, y.h AS o, y.i AS j FROM low x JOIN low y ON x.source IS NOT DISTINCT FROM y.source AND x.l = y.l AND x.i // 3 = y.i // 3 WHERE x.n > 1)
  GROUP BY source, l, i),
tops AS (
  SELECT l, i, coalesce(string_agg(o, '' ORDER BY j) FILTER (j < i), '') AS a, coalesce(string_agg(o, '' ORDER BY j) FILTER (j > i), '') AS b
  FROM (SELECT x.l, x.i, y.h AS o, y.i AS j FROM high x JOIN high y ON x.l = y.l AND x.i // 3 = y.i // 3 WHERE x.n > 1)
  GROUP BY l, i),
rows_ AS (SELECT d.*, s.subroot, s.depth, s.place, (SELECT h FROM high WHERE n = 1) AS root FROM d JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source),
proofs AS (
  SELECT r.source, r.i, s.l, s.a, s.b FROM rows_ r JOIN sides s ON r.source IS NOT DISTINCT FROM s.source AND s.i = r.i // (3 ** s.l)::BIGINT
  UNION ALL
  SELECT r.source, r.i, r.depth + t.l, t.a, t.b FROM rows_ r JOIN tops t ON t.i = r.place // (3 ** t.l)::BIGINT),
folds AS (
  SELECT source, i, 0 AS l, tampered AS h FROM rows_
  UNION ALL
  SELECT f.source, f.i, f.l + 1, sha256(p.a || f.h || p.b) FROM folds f JOIN proofs p ON f.source IS NOT DISTINCT FROM p.source AND f.i = p.i AND f.l = p.l),
done AS (SELECT source, i, arg_max(h, l) AS folded FROM folds GROUP BY source, i),
texts AS (SELECT source, i, string_agg(a || b, '' ORDER BY l) AS proof FROM proofs GROUP BY source, i)
SELECT r.doc_id, r.leaf, r.subroot, r.root, sha256(coalesce(t.proof, '')) AS proof_sha256, f.folded AS folded_root, f.folded = r.root AS verified
FROM rows_ r JOIN done f ON r.source IS NOT DISTINCT FROM f.source AND r.i = f.i
LEFT JOIN texts t ON r.source IS NOT DISTINCT FROM t.source AND r.i = t.i
"""

#: Words one code point apart share the word less one code point.
SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, k, {_crc(_bytes("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM runs),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM hashed),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS MATERIALIZED (SELECT DISTINCT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM v)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM v)),
ranked AS (
  SELECT p.word, a.n, p.other, b.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY b.n DESC, p.other) AS r
  FROM pairs p JOIN v a ON a.word = p.word JOIN v b ON b.word = p.other),
best AS (SELECT word, n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM ranked WHERE r = 1),
chain AS (
  SELECT word, form AS root, 1 AS step FROM best WHERE form IS NOT NULL
  UNION ALL
  SELECT c.word, b.form, c.step + 1 FROM chain c JOIN best b ON b.word = c.root WHERE b.form IS NOT NULL),
last_ AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, b.form, b.form_n, coalesce(l.root, v.word) AS root
FROM v LEFT JOIN best b USING (word) LEFT JOIN last_ l USING (word)
"""

#: Components by following links from every vertex: `links(a, b)` both ways.
_REACH = """
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS least FROM reach GROUP BY a)"""

#: Sets of three-word shingles; pairs by their common shingles.
JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
rows_ AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(list_transform(s, lambda x: hash(x))) AS x FROM sets),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS c FROM rows_ p JOIN rows_ q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),{_REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(l.least, doc_id)) AS component_id FROM sets LEFT JOIN least l ON l.a = doc_id
"""

#: All pairs of unit vectors.
COSINE = f"""
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS MATERIALIZED (
  SELECT vec_id, list_transform(v, lambda x: x / n) AS v
  FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
  WHERE n > 0 AND isfinite(n) AND list_count(v) = len(v)),
links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) AND list_dot_product(p.v, q.v) >= 0.95),{_REACH},
counted AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.least, e.vec_id)) AS component_id, least(e.vec_id, coalesce(l.least, e.vec_id)) = e.vec_id AS kept
FROM e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

SQL = {
    "op6_embedding_near_dedup": COSINE,
    "op10_ngram_jaccard_join": JACCARD,
    "op12_merkle_manifest": MERKLE,
    "op13_spelling_variants": SPELLING,
}
