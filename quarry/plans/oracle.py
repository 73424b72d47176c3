"""DuckDB oracle SQL for the registered queries.

Each statement recomputes its query from the driver's parquet views with
plain SQL (window functions, list lambdas, regexes) so the Spark result can be
checked row for row. Shared steps are CTE fragments joined below.
"""

from __future__ import annotations

import re
from string import Template

from quarry.config import CHUNK_OVERLAP, CHUNK_SIZE, TOP_K

WHITE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{TOKEN_SPLIT}'), lambda t: t <> '')"


def _window_chunks(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> str:
    step = size - overlap
    return f"""
chunks_all AS (
  SELECT d.doc_id, 0::BIGINT AS section_pos, d.source, w.i::BIGINT AS chunk_pos,
         substring(d.text, (w.i * {step} + 1)::BIGINT, {size}) AS text
  FROM documents d,
       LATERAL (SELECT unnest(range(CASE WHEN length(d.text) <= {size} THEN 1
                 ELSE 1 + ceil((length(d.text) - {size}) / {step}.0)::BIGINT END)) AS i) w
  WHERE d.text IS NOT NULL
),
chunks AS (
  SELECT sha256(concat_ws('|', doc_id::VARCHAR, section_pos::VARCHAR, chunk_pos::VARCHAR)) AS pk,
         doc_id, section_pos, source, chunk_pos, text
  FROM chunks_all WHERE {strip_sql('text')} <> ''
)"""


BM25 = f"""
tok AS MATERIALIZED (SELECT pk, {tokens_sql('text')} AS toks FROM chunks),
stats AS (SELECT count(*)::BIGINT AS n, avg(len(toks)::DOUBLE) AS avgdl FROM tok),
tf AS MATERIALIZED (
  SELECT pk, term, count(*)::BIGINT AS tf, any_value(dl) AS dl
  FROM (SELECT pk, unnest(toks) AS term, len(toks)::BIGINT AS dl FROM tok)
  GROUP BY pk, term
),
dfreq AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
raw AS MATERIALIZED (
  SELECT term, df,
         ln((SELECT n FROM stats)::DOUBLE - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw_idf
  FROM dfreq
),
vocab AS MATERIALIZED (
  SELECT term, df,
         CASE WHEN raw_idf < 0 THEN 0.25::DOUBLE * (SELECT avg(raw_idf) FROM raw)
              ELSE raw_idf END AS idf
  FROM raw
),
post AS (
  SELECT pk, term,
         tf::DOUBLE * 2.5::DOUBLE / (tf::DOUBLE + 1.5::DOUBLE * (0.25::DOUBLE
           + 0.75::DOUBLE * dl::DOUBLE / (SELECT avgdl FROM stats))) AS weight
  FROM tf
)"""

QUERIES = f"""
queries AS (SELECT item_id::BIGINT AS query_id, text AS query_text FROM benchmark),
qterms AS (
  SELECT query_id, term, count(*)::BIGINT AS qtf
  FROM (SELECT query_id, unnest({tokens_sql('query_text')}) AS term FROM queries)
  GROUP BY query_id, term
),
qw AS (SELECT query_id, term, idf * qtf::DOUBLE AS weight FROM qterms JOIN vocab USING (term))"""


def full_text_hits_sql(k: int = TOP_K) -> str:
    return f"""
ft_scored AS (
  SELECT query_id, pk, sum(qw.weight * post.weight) AS score
  FROM qw JOIN post USING (term) GROUP BY query_id, pk
),
ft_ranked AS (
  SELECT query_id, pk, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pk)::BIGINT AS rank
  FROM ft_scored
),
ft_hits AS (
  SELECT r.query_id, r.rank, r.pk, r.score, c.text
  FROM ft_ranked r JOIN chunks c USING (pk) WHERE r.rank <= {k}
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


SQL: dict[str, str] = {}

SQL["chunk_windows"] = _with(_window_chunks()) + (
    "SELECT pk, doc_id, chunk_pos, source, text FROM chunks"
)
SQL["bm25_terms"] = _with(_window_chunks(), BM25) + (
    "SELECT term, df, round(idf, 6) AS idf FROM vocab"
)
SQL["bm25_stats"] = _with(_window_chunks(), BM25) + (
    "SELECT n, round(avgdl, 6) AS avgdl FROM stats"
)
SQL["bm25_doc_weights"] = _with(_window_chunks(), BM25) + (
    "SELECT pk, term, round(weight, 6) AS weight FROM post"
)
SQL["bm25_query_weights"] = _with(_window_chunks(), BM25, QUERIES) + (
    "SELECT query_id, term, round(weight, 6) AS weight FROM qw"
)
SQL["full_text_topk"] = _with(_window_chunks(), BM25, QUERIES, full_text_hits_sql()) + (
    "SELECT query_id, rank, pk, round(score, 6) AS score, text FROM ft_hits"
)
SQL["full_text_topk_join"] = SQL["full_text_topk"]


# ------------------------------------------------------ step 2: dense search

DENSE_EMB = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
en AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM e),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CASE WHEN q.nv = 0 OR d.nv = 0 THEN 0.0
              ELSE list_dot_product(q.v, d.v) / (q.nv * d.nv) END AS score
  FROM en q, en d
),
ranked AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::BIGINT AS rank
  FROM pairs
)"""

SQL["dense_topk"] = _with(DENSE_EMB) + (
    f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP_K}"
)
SQL["dense_topk_blocked"] = SQL["dense_topk"]


# ------------------------------------------- step 3: stand-in encoders, R2, R3

DIM = 384


def _bucket_sql(t: str, mod: int) -> str:
    return f"((('0x' || substr(md5({t}), 1, 8))::BIGINT % {mod}))"


def _hashed(name: str, key: str, tok_cte: str) -> str:
    """Hashed unit vector of each row of ``tok_cte(key, toks)`` as sparse rows
    ``{name}(key, b, v FLOAT)`` plus its norm ``{name}_n(key, n)``."""
    return f"""
{name}_c AS (
  SELECT {key}, b, count(*)::BIGINT AS c
  FROM (SELECT {key}, {_bucket_sql('t', DIM)}::INTEGER AS b
        FROM (SELECT {key}, unnest(toks) AS t FROM {tok_cte}))
  GROUP BY {key}, b
),
{name}_s AS (SELECT {key}, sum(c * c)::DOUBLE AS ss FROM {name}_c GROUP BY {key}),
{name} AS (
  SELECT {key}, b, (c::DOUBLE / sqrt(ss))::FLOAT AS v FROM {name}_c JOIN {name}_s USING ({key})
),
{name}_n AS (SELECT {key}, sqrt(sum(v::DOUBLE * v::DOUBLE)) AS n FROM {name} GROUP BY {key})"""


QTOK = f"""
qtok AS (SELECT query_id, {tokens_sql('query_text')} AS toks FROM queries)"""

SEMANTIC = (
    _hashed("dhv", "pk", "tok")
    + ","
    + _hashed("qhv", "query_id", "qtok")
    + f""",
sem_dots AS (
  SELECT q.query_id, d.pk, sum((q.v::DOUBLE / qn.n) * (d.v::DOUBLE / dn.n)) AS score
  FROM qhv q JOIN dhv d USING (b)
       JOIN qhv_n qn ON qn.query_id = q.query_id
       JOIN dhv_n dn ON dn.pk = d.pk
  GROUP BY q.query_id, d.pk
),
sem_pairs AS (
  SELECT q.query_id, c.pk, coalesce(s.score, 0.0) AS score
  FROM queries q CROSS JOIN chunks c
       LEFT JOIN sem_dots s ON s.query_id = q.query_id AND s.pk = c.pk
),
sem_ranked AS (
  SELECT query_id, pk, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pk)::BIGINT AS rank
  FROM sem_pairs
),
sem_hits AS (
  SELECT r.query_id, r.rank, r.pk, r.score, c.text
  FROM sem_ranked r JOIN chunks c USING (pk) WHERE r.rank <= {TOP_K}
)"""
)

SQL["hash_embed"] = _with(_window_chunks(), BM25, _hashed("dhv", "pk", "tok")) + f"""
SELECT c.pk,
       CASE WHEN m.vm IS NULL THEN list_transform(range({DIM}), lambda i: 0::FLOAT)
            ELSE list_transform(range({DIM}), lambda i: coalesce(map_extract_value(m.vm, i::INTEGER), 0::FLOAT))
       END AS vector
FROM chunks c
LEFT JOIN (SELECT pk, map_from_entries(list(struct_pack(k := b, v := v))) AS vm FROM dhv GROUP BY pk) m
  USING (pk)"""

SQL["hash_embed_terms"] = SQL["hash_embed"]
SQL["semantic_topk"] = _with(_window_chunks(), BM25, QUERIES, QTOK, SEMANTIC) + (
    "SELECT query_id, rank, pk, round(score, 6) AS score, text FROM sem_hits"
)

SPARSE = f"""
sp_d AS (
  SELECT pk, {_bucket_sql('term', 2147483647)}::INTEGER AS term_id,
         1.0::DOUBLE + ln(tf::DOUBLE) AS weight
  FROM tf
),
sp_q AS (
  SELECT query_id, {_bucket_sql('term', 2147483647)}::INTEGER AS term_id,
         1.0::DOUBLE + ln(qtf::DOUBLE) AS weight
  FROM qterms
),
sp_scored AS (
  SELECT q.query_id, d.pk, sum(q.weight * d.weight) AS score
  FROM sp_q q JOIN sp_d d USING (term_id) GROUP BY q.query_id, d.pk
),
sp_ranked AS (
  SELECT query_id, pk, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pk)::BIGINT AS rank
  FROM sp_scored
)"""

SQL["sparse_weights"] = _with(_window_chunks(), BM25, QUERIES, SPARSE) + (
    "SELECT pk, term_id, round(weight, 6) AS weight FROM sp_d"
)
SQL["sparse_topk"] = _with(_window_chunks(), BM25, QUERIES, SPARSE) + f"""
SELECT r.query_id, r.rank, r.pk, round(r.score, 6) AS score, c.text
FROM sp_ranked r JOIN chunks c USING (pk) WHERE r.rank <= {TOP_K}"""


# ------------------------------------------------------- step 4: RRF, context

RRF = """
rrf_lists AS (
  SELECT query_id, text, 0 AS list_no, rank - 1 AS pos FROM sem_hits
  UNION ALL
  SELECT query_id, text, 1 AS list_no, rank - 1 AS pos FROM ft_hits
),
rrf_fused AS (
  SELECT query_id, text, sum(1.0::DOUBLE / (pos + 60)::DOUBLE) AS score,
         min(list_no * 1000000 + pos) AS first
  FROM rrf_lists GROUP BY query_id, text
),
rrf_ranked AS (
  SELECT query_id, text, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first)::BIGINT AS rank
  FROM rrf_fused
)"""

HYBRID = (_window_chunks(), BM25, QUERIES, QTOK, SEMANTIC, full_text_hits_sql(), RRF)

SQL["rrf_fuse"] = _with(*HYBRID) + (
    "SELECT query_id, rank, text, round(score, 6) AS score FROM rrf_ranked"
)
SQL["hybrid_rrf"] = _with(*HYBRID) + (
    f"SELECT query_id, rank, text, round(score, 6) AS score FROM rrf_ranked WHERE rank <= {TOP_K}"
)
CONTEXT = f"""
ctx AS (
  SELECT q.query_id, coalesce(string_agg(r.text, ' ' ORDER BY r.rank), '') AS context
  FROM queries q LEFT JOIN (SELECT * FROM rrf_ranked WHERE rank <= {TOP_K}) r USING (query_id)
  GROUP BY q.query_id
)"""
SQL["context_text"] = _with(*HYBRID, CONTEXT) + "SELECT query_id, context FROM ctx"


# ------------------------------------------------ step 5: sections, base URL


def base_url_sql(u: str) -> str:
    return (
        "'https://' || regexp_replace(regexp_replace(regexp_replace("
        f"{u}, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/[^/]*$', '')"
    )


def _entities(x: str) -> str:
    out = x
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return out


SQL["page_base_url"] = f"SELECT page_id, {base_url_sql('url')} AS base_url FROM pages"

# Regex form of the nav section: the element's text is its markup with tags
# removed and entities decoded; the source uses the first href inside it.
SQL["nav_sections"] = f"""
WITH nav AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS inner_html
  FROM pages WHERE regexp_matches(html, '(?s)<body[\\s>].*<nav[\\s>]')
)
SELECT page_id, 0::BIGINT AS section_pos,
       {base_url_sql('url')} || '/' || {_entities("regexp_extract(inner_html, 'href=\"([^\"]*)\"', 1)")} AS source,
       {strip_sql(_entities("regexp_replace(inner_html, '<[^>]*>', '', 'g')"))} AS text
FROM nav
WHERE regexp_matches(inner_html, '<a[^>]*href=')"""


# <article> has two direct children, one line each: the heading, and a
# paragraph that is never closed and so holds the rest; without a link the
# section is sourced to the page
SQL["article_sections"] = f"""
WITH art AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS inner_html
  FROM pages WHERE regexp_matches(html, '(?s)<body[\\s>].*<article[\\s>]')
), parts AS (
  SELECT page_id, url, inner_html, regexp_extract(inner_html, '(?s)^<h1[^>]*>(.*?)</h1>', 1) AS heading,
         regexp_replace(inner_html, '(?s)^<h1[^>]*>.*?</h1>', '') AS rest FROM art
)
SELECT page_id, 0::BIGINT AS section_pos,
       {base_url_sql('url')} || CASE WHEN regexp_matches(inner_html, '<a[^>]*href=')
         THEN '/' || {_entities("regexp_extract(inner_html, 'href=\"([^\"]*)\"', 1)")} ELSE '' END AS source,
       {strip_sql(_entities("regexp_replace(heading, '<[^>]*>', '', 'g')"))} || chr(10) ||
       {strip_sql(_entities("regexp_replace(rest, '<[^>]*>', '', 'g')"))} AS text
FROM parts"""

SQL["skip_report"] = """
WITH body AS (
  SELECT regexp_matches(html, '<body[\\s>]') AS has_body,
         regexp_extract_all(regexp_extract(html, '(?s)<body[\\s>].*'), '(?s)<section[\\s>].*?</section>') AS secs
  FROM pages
), reasons AS (
  SELECT CASE WHEN has_body THEN 'no_section' ELSE 'no_body' END AS reason
  FROM body WHERE NOT coalesce(has_body, false) OR len(secs) = 0
  UNION ALL
  SELECT CASE WHEN regexp_matches(s, '<a[^>]*\\shref=') THEN 'ok'
              WHEN regexp_matches(s, '<a[\\s>]') THEN 'no_href' ELSE 'no_anchor' END
  FROM (SELECT unnest(secs) AS s FROM body WHERE has_body)
)
SELECT reason, count(*)::BIGINT AS n FROM reasons GROUP BY reason"""


# ------------------------------------------- step 6: knowledge store tables

NON_EMPTY = """
kn AS (SELECT c.pk, c.text, c.source FROM chunks c JOIN tok t USING (pk) WHERE len(t.toks) > 0)"""

SQL["non_empty_chunks"] = _with(_window_chunks(), BM25, NON_EMPTY) + "SELECT pk, text FROM kn"
SQL["vector_map"] = _with(_window_chunks(), BM25) + (
    "SELECT pk, term, round(weight::FLOAT::DOUBLE, 6) AS weight FROM post"
)
SQL["postings"] = _with(_window_chunks(), BM25) + (
    "SELECT term, pk, round(weight, 6) AS weight FROM post"
)
KNOWLEDGE = f"""
SELECT k.pk, k.text, k.source,
       CASE WHEN m.vm IS NULL THEN list_transform(range({DIM}), lambda i: 0::FLOAT)
            ELSE list_transform(range({DIM}), lambda i: coalesce(map_extract_value(m.vm, i::INTEGER), 0::FLOAT))
       END AS dense_vector
FROM kn k
LEFT JOIN (SELECT pk, map_from_entries(list(struct_pack(k := b, v := v))) AS vm FROM dhv GROUP BY pk) m
  USING (pk)"""
SQL["knowledge_table"] = _with(_window_chunks(), BM25, _hashed("dhv", "pk", "tok"), NON_EMPTY) + KNOWLEDGE


# ------------------------------- steps 7-9: rerank, prompts, HyDE, cascade

from quarry.config import HYDE_PROMPT, RAG_PROMPT, STUB_RESPONSE, TRUST_THRESHOLD  # noqa: E402


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def template_sql(template: str, query: str, context: str | None = None) -> str:
    """The template filled with marks by the standard library, cut at them."""
    filled = Template(template).substitute(query="\x01", context="\x02")
    columns = {"\x01": query, "\x02": context}
    parts = [columns.get(p) or _lit(p) for p in re.split("([\x01\x02])", filled) if p]
    return "(" + " || ".join(parts) + ")"


def coverage_sql(q: str, r: str) -> str:
    qd = f"list_distinct({tokens_sql(q)})"
    return (
        f"CASE WHEN len({qd}) = 0 THEN 0.0::DOUBLE "
        f"ELSE len(list_intersect({qd}, {tokens_sql(r)}))::DOUBLE / len({qd})::DOUBLE END"
    )


def semantic_sql(p: str, qtab: str, qtok: str) -> str:
    """Dense (hashed) top k of the queries in ``qtab``; needs ``dhv`` defined."""
    return (
        _hashed(f"{p}_qv", "query_id", qtok)
        + f""",
{p}_dots AS (
  SELECT q.query_id, d.pk, sum((q.v::DOUBLE / qn.n) * (d.v::DOUBLE / dn.n)) AS score
  FROM {p}_qv q JOIN dhv d USING (b)
       JOIN {p}_qv_n qn ON qn.query_id = q.query_id
       JOIN dhv_n dn ON dn.pk = d.pk
  GROUP BY q.query_id, d.pk
),
{p}_pairs AS (
  SELECT q.query_id, c.pk, coalesce(s.score, 0.0) AS score
  FROM {qtab} q CROSS JOIN chunks c
       LEFT JOIN {p}_dots s ON s.query_id = q.query_id AND s.pk = c.pk
),
{p}_ranked AS (
  SELECT query_id, pk, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pk)::BIGINT AS rank
  FROM {p}_pairs
),
{p}_hits AS (
  SELECT r.query_id, r.rank, r.pk, r.score, c.text
  FROM {p}_ranked r JOIN chunks c USING (pk) WHERE r.rank <= {TOP_K}
)"""
    )


RERANK = f"""
rr_qd AS (
  SELECT query_id, term, idf
  FROM (SELECT query_id, unnest(list_distinct(toks)) AS term FROM qtok) JOIN vocab USING (term)
),
rr_cand AS (
  SELECT DISTINCT query_id, text FROM (
    SELECT query_id, text FROM sem_hits UNION ALL SELECT query_id, text FROM ft_hits)
),
rr_ct AS (
  SELECT query_id, text, unnest(list_distinct({tokens_sql('text')})) AS term FROM rr_cand
),
rr_s AS (
  SELECT query_id, text, sum(idf) AS s FROM rr_ct JOIN rr_qd USING (query_id, term)
  GROUP BY query_id, text
),
rr_ranked AS (
  SELECT query_id, text, coalesce(s, 0.0::DOUBLE) AS score,
         row_number() OVER (PARTITION BY query_id
                            ORDER BY round(coalesce(s, 0.0::DOUBLE), 9) DESC, text)::BIGINT AS rank
  FROM rr_cand LEFT JOIN rr_s USING (query_id, text)
)"""

HYDE = f"""
hy_top AS (
  SELECT q.query_id, q.query_text, coalesce(f.text, '') AS response
  FROM queries q LEFT JOIN (SELECT query_id, text FROM ft_hits WHERE rank = 1) f USING (query_id)
),
hyde_q AS (SELECT query_id, concat_ws(' ', query_text, response) AS query_text FROM hy_top),
htok AS (SELECT query_id, {tokens_sql('query_text')} AS toks FROM hyde_q),
""" + semantic_sql("hy", "hyde_q", "htok")

FULL = (*HYBRID, RERANK, HYDE)

SQL["hybrid_rerank"] = _with(*HYBRID, RERANK) + (
    f"SELECT query_id, rank, text, round(score, 6) AS score FROM rr_ranked WHERE rank <= {TOP_K}"
)
SQL["rag_prompt"] = _with(*HYBRID, CONTEXT) + (
    "SELECT c.query_id, "
    + template_sql(RAG_PROMPT, "q.query_text", "c.context")
    + " AS prompt FROM ctx c JOIN queries q USING (query_id)"
)
SQL["hyde_prompt"] = (
    "SELECT item_id::BIGINT AS query_id, "
    + template_sql(HYDE_PROMPT, "text")
    + " AS prompt FROM benchmark"
)
SQL["hyde_topk"] = _with(*FULL) + (
    "SELECT query_id, rank, pk, round(score, 6) AS score, text FROM hy_hits"
)


def _eval_sql(name: str, priority: int, hits: str | None) -> str:
    if hits is None:
        src = "SELECT query_id, query_text, '' AS context, '' AS response FROM queries"
    else:
        src = f"""SELECT q.query_id, q.query_text,
         coalesce(string_agg(h.text, ' ' ORDER BY h.rank), '') AS context,
         coalesce(max(CASE WHEN h.rank = 1 THEN h.text END), '') AS response
  FROM queries q LEFT JOIN (SELECT * FROM {hits} WHERE rank <= {TOP_K}) h USING (query_id)
  GROUP BY q.query_id, q.query_text"""
    return f"""
ev{priority} AS (
  SELECT query_id, '{name}' AS strategy, {priority}::BIGINT AS priority,
         {template_sql(RAG_PROMPT, 'query_text', 'context')} AS prompt, response,
         {coverage_sql('query_text', 'response')} AS trust_score
  FROM ({src})
)"""


CASCADE = ",".join(
    [
        _eval_sql("no_retrieval", 1, None),
        _eval_sql("semantic_search", 2, "sem_hits"),
        _eval_sql("hybrid_search_with_rrf", 3, "rrf_ranked"),
        _eval_sql("hybrid_search_with_reranker", 4, "rr_ranked"),
        _eval_sql("hyde_retrieval", 5, "hy_hits"),
    ]
) + f""",
evals AS (
  SELECT * FROM ev1 UNION ALL SELECT * FROM ev2 UNION ALL SELECT * FROM ev3
  UNION ALL SELECT * FROM ev4 UNION ALL SELECT * FROM ev5
),
acc AS (
  SELECT query_id, min(priority) AS ap, arg_min(strategy, priority) AS strategy,
         arg_min(trust_score, priority) AS trust_score, arg_min(response, priority) AS response
  FROM evals WHERE trust_score >= {TRUST_THRESHOLD} GROUP BY query_id
),
answers AS (
  SELECT q.query_id, a.strategy, a.trust_score,
         coalesce(a.response, {_lit(STUB_RESPONSE)}) AS response, a.ap
  FROM queries q LEFT JOIN acc a USING (query_id)
),
report AS (
  SELECT e.query_id, e.strategy, e.priority, e.trust_score, e.response
  FROM evals e JOIN answers a USING (query_id)
  WHERE a.ap IS NULL OR e.priority <= a.ap
)"""

SQL["coverage_score"] = _with(*HYBRID, _eval_sql("hybrid_search_with_rrf", 3, "rrf_ranked")) + (
    "SELECT query_id, response, round(trust_score, 6) AS trust_score FROM ev3"
)
SQL["cascade_answer"] = _with(*FULL, CASCADE) + (
    "SELECT query_id, strategy, round(trust_score, 6) AS trust_score, response FROM answers"
)
SQL["cascade_answer_eager"] = SQL["cascade_answer"]
SQL["cascade_report"] = _with(*FULL, CASCADE) + (
    "SELECT query_id, strategy, priority, round(trust_score, 6) AS trust_score, response FROM report"
)
SQL["dry_run_answer"] = (
    "SELECT item_id::BIGINT AS query_id, NULL::VARCHAR AS strategy, NULL::DOUBLE AS trust_score, "
    f"{_lit(STUB_RESPONSE)} AS response FROM benchmark"
)


# Search over the written store through its postings (double weights) equals
# the full-text search; through the stored maps the weights are FLOAT.
SQL["store_full_text_topk_scan"] = (
    _with(_window_chunks(), BM25, QUERIES)
    + """, stored AS (SELECT pk, term, weight::FLOAT::DOUBLE AS w FROM post),
st_scored AS (
  SELECT query_id, pk, sum(qw.weight * stored.w) AS score
  FROM qw JOIN stored USING (term) GROUP BY query_id, pk
),
st_ranked AS (
  SELECT query_id, pk, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pk)::BIGINT AS rank
  FROM st_scored
)
SELECT r.query_id, r.rank, r.pk, round(r.score, 6) AS score, c.text
FROM st_ranked r JOIN chunks c USING (pk) WHERE r.rank <= 5"""
)
for _plan in ("", "_index", "_postings"):
    SQL["store_full_text_topk" + _plan] = SQL["store_full_text_topk_scan"]


CONV_QUERIES = QUERIES.replace(
    "queries AS (SELECT item_id::BIGINT AS query_id, text AS query_text FROM benchmark)",
    "queries AS (SELECT (conv_id::BIGINT * 4294967296 + turn)::BIGINT AS query_id, text AS query_text "
    "FROM conversations WHERE role = 'user')",
)
SQL["conversation_full_text_topk"] = _with(
    _window_chunks(), BM25, CONV_QUERIES, full_text_hits_sql()
) + "SELECT query_id, rank, pk, round(score, 6) AS score, text FROM ft_hits"

SQL["cascade_summary"] = _with(*FULL, CASCADE) + (
    "SELECT query_id, count(*)::BIGINT AS n_tried, "
    "string_agg(strategy, ' > ' ORDER BY priority) AS tried FROM report GROUP BY query_id"
)

# the strategies over a written store: same answers as their in-session twins
SQL["store_semantic_topk"] = SQL["semantic_topk"]
SQL["store_hybrid_rrf"] = SQL["hybrid_rrf"]
SQL["store_hybrid_rerank"] = SQL["hybrid_rerank"]
SQL["store_hyde_topk"] = SQL["hyde_topk"]
SQL["store_cascade_answer"] = SQL["cascade_answer"]

# learned-sparse weights are stored as floats; ids that collide in a chunk add up
SPARSE_STORED = SPARSE.replace("sp_d AS (", "sp_d0 AS (", 1).replace(
    "sp_q AS (",
    """sp_d AS (
  SELECT pk, term_id, sum(weight)::FLOAT::DOUBLE AS weight FROM sp_d0 GROUP BY pk, term_id
),
sp_q AS (""",
    1,
)
SQL["sparse_vector_map"] = _with(_window_chunks(), BM25, QUERIES, SPARSE_STORED) + (
    "SELECT pk, term_id, round(weight, 6) AS weight FROM sp_d"
)
SQL["store_sparse_topk"] = _with(_window_chunks(), BM25, QUERIES, SPARSE_STORED) + f"""
SELECT r.query_id, r.rank, r.pk, round(r.score, 6) AS score, c.text
FROM sp_ranked r JOIN chunks c USING (pk) WHERE r.rank <= {TOP_K}"""

SPARSE_HITS = f"""
sp_hits AS (
  SELECT r.query_id, r.rank, r.pk, c.text
  FROM sp_ranked r JOIN chunks c USING (pk) WHERE r.rank <= {TOP_K}
)"""
RRF_THREE = RRF.replace(
    "  SELECT query_id, text, 1 AS list_no, rank - 1 AS pos FROM ft_hits",
    "  SELECT query_id, text, 1 AS list_no, rank - 1 AS pos FROM sp_hits\n  UNION ALL\n"
    "  SELECT query_id, text, 2 AS list_no, rank - 1 AS pos FROM ft_hits",
)
SQL["hybrid_rrf_three_lists"] = _with(*HYBRID[:-1], SPARSE_STORED, SPARSE_HITS, RRF_THREE) + (
    f"SELECT query_id, rank, text, round(score, 6) AS score FROM rrf_ranked WHERE rank <= {TOP_K}"
)


# ------------------------- recursive chunks, offsets, suffixes, samples, stream


def _cut(text: str, sep: str) -> str:
    """Pieces of ``text`` with their separator in front; empty ones left out."""
    parts = f"string_split({text}, {sep})"
    pieces = f"list_transform({parts}, lambda x, i: CASE WHEN i = 1 THEN x ELSE {sep} || x END)"
    return f"list_filter({pieces}, lambda x: x <> '')"


def _pieces(text: str, level: str) -> str:
    """``[separator, pieces]`` of the first separator from ``level`` on that the
    text holds; with none, its characters."""
    cases = " ".join(
        f"WHEN {level} <= {i} AND contains({text}, {s}) THEN {{'s': {i}, 'p': {_cut(text, s)}}}"
        for i, s in ((1, "chr(10) || chr(10)"), (2, "chr(10)"), (3, "' '"))
    )
    return f"CASE {cases} ELSE {{'s': 4, 'p': string_split({text}, '')}} END"


def recursive_chunks_sql(source: str, key: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> str:
    """CTEs ending in ``rc(key, chunk_pos, start, end_, text)``: long pieces are
    cut again by the next separators; the leaves tile the text; runs of short
    leaves of one parent are merged greedily, found by prefix sums."""
    return f"""
texts AS (SELECT {key} AS k, text FROM {source} WHERE text <> ''),
pieces AS (
  SELECT k, []::INT[] AS parent, {_pieces('text', '1')} AS c FROM texts
  UNION ALL
  SELECT k, list_append(parent, i), {_pieces('p', 's + 1')}
  FROM (SELECT k, parent, c.s AS s, unnest(c.p) AS p, generate_subscripts(c.p, 1)::INT AS i FROM pieces)
  WHERE length(p) >= {size} AND s < 4
),
flat AS (SELECT k, parent, c.s AS s, unnest(c.p) AS p, generate_subscripts(c.p, 1)::INT AS i FROM pieces),
marked AS (
  SELECT *, length(p) AS n, length(p) >= {size} AND s < 4 AS cut_again,
         count(*) FILTER (length(p) >= {size}) OVER (PARTITION BY k, parent ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM flat
),
leaves AS (
  SELECT k, parent, run, list_append(parent, i) AS path, n,
         sum(n) OVER (PARTITION BY k ORDER BY list_append(parent, i) ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM marked WHERE NOT cut_again
),
units AS MATERIALIZED (
  SELECT k, dense_rank() OVER (PARTITION BY k ORDER BY first_path) AS g, row_number() OVER (PARTITION BY k, first_path ORDER BY path) AS i, e - n AS a, e
  FROM (SELECT *, first(path) OVER (PARTITION BY k, parent, run ORDER BY path) AS first_path FROM leaves)
),
steps AS (
  SELECT k, g, 1::BIGINT AS i, a AS start FROM units WHERE i = 1
  UNION ALL
  SELECT k, g, next_, start_ FROM (
    SELECT st.k, st.g, arg_min(v.i, v.i) AS next_, arg_min(v.a, v.i) AS start_
    FROM (SELECT s.k, s.g, s.i, min(u.i) AS e, arg_min(u.a, u.i) AS ea, arg_min(u.e, u.i) AS ee
          FROM steps s JOIN units u ON u.k = s.k AND u.g = s.g AND u.i > s.i AND u.e - s.start > {size} GROUP BY s.k, s.g, s.i) st
    JOIN units v ON v.k = st.k AND v.g = st.g AND v.i > st.i AND v.i <= st.e
      AND v.a >= least(st.ea, greatest(st.ea - {overlap}, st.ee - {size}))
    GROUP BY st.k, st.g, st.i)
),
spans AS (
  SELECT s.k, s.g, s.i, s.start, coalesce(min(u.a) FILTER (u.i > s.i AND u.e - s.start > {size}), max(u.e)) AS stop
  FROM steps s JOIN units u ON u.k = s.k AND u.g = s.g GROUP BY s.k, s.g, s.i, s.start
),
raw_chunks AS (SELECT k, g, i, start, stop, substring(text, start + 1, stop - start) AS raw FROM spans JOIN texts USING (k)),
trimmed AS (
  SELECT k, g, i, start + length(raw) - length(regexp_replace(raw, '^{WHITE}+', '')) AS start, {strip_sql('raw')} AS text FROM raw_chunks
),
rc AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY g, i) - 1 AS chunk_pos, start, start + length(text) AS end_, text
  FROM trimmed WHERE text <> ''
)"""


_REC = "WITH RECURSIVE "

SQL["recursive_chunks"] = _REC + recursive_chunks_sql("documents", "doc_id").strip() + """
SELECT sha256(concat_ws('|', rc.k::VARCHAR, '0', rc.chunk_pos::VARCHAR)) AS pk, rc.k AS doc_id, rc.chunk_pos, d.source, rc.text
FROM rc JOIN documents d ON d.doc_id = rc.k"""

SQL["page_chunks"] = (
    _REC
    + f"sections AS ({SQL['article_sections']}),"
    + recursive_chunks_sql("sections", "page_id")
    + """
SELECT sha256(concat_ws('|', rc.k::VARCHAR, '0', rc.chunk_pos::VARCHAR)) AS pk, rc.k AS page_id, 0::BIGINT AS section_pos, rc.chunk_pos, s.source, rc.text
FROM rc JOIN sections s ON s.page_id = rc.k"""
)

SQL["chunk_offsets"] = _REC + recursive_chunks_sql("documents", "doc_id").strip() + """,
cover AS (SELECT *, end_ - greatest(start, coalesce(lag(end_) OVER (PARTITION BY k ORDER BY chunk_pos), 0)) AS fresh FROM rc)
SELECT k AS doc_id, count(*)::BIGINT AS n_chunks, sum(fresh)::BIGINT AS covered, max(end_ - start)::BIGINT AS longest, bool_and(substring(t.text, start + 1, end_ - start) = cover.text) AS exact
FROM cover JOIN texts t USING (k) GROUP BY k"""

SQL["stream_chunks"] = SQL["chunk_windows"]

SQL["non_empty_windows"] = _with(_window_chunks(4, 0)) + (
    f"SELECT text, count(*)::BIGINT AS n FROM chunks WHERE len({tokens_sql('text')}) > 0 GROUP BY text"
)

SQL["source_counts"] = """
SELECT 'documents' AS source, count(*)::BIGINT AS n FROM documents
UNION ALL SELECT 'pages', count(*)::BIGINT FROM pages"""


def suffix_sql(tokens: str, suffixes: tuple, least: int = 3) -> str:
    """Each token without the longest ending that leaves ``least`` letters."""
    cases = " ".join(
        f"WHEN ends_with(t, '{s}') AND length(t) >= {len(s) + least} THEN substring(t, 1, length(t) - {len(s)})"
        for s in sorted(suffixes, key=lambda s: (-len(s), s))
    )
    return f"list_transform({tokens}, lambda t: CASE {cases} ELSE t END)"


# the endings of the registered query
_ENDINGS = ("ing", "ed", "es", "s", "eaux")
SQL["full_text_topk_suffixes"] = _with(
    _window_chunks(),
    BM25.replace(tokens_sql("text"), suffix_sql(tokens_sql("text"), _ENDINGS)),
    QUERIES.replace(tokens_sql("query_text"), suffix_sql(tokens_sql("query_text"), _ENDINGS)),
    full_text_hits_sql(),
) + "SELECT query_id, rank, pk, round(score, 6) AS score, text FROM ft_hits"

SQL["sample_consistency"] = _with(_window_chunks(), BM25, QUERIES, full_text_hits_sql()) + f"""
, sets AS (SELECT query_id, rank, list_distinct({tokens_sql('text')}) AS s FROM ft_hits),
alike AS (
  SELECT a.query_id, CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1.0::DOUBLE
         ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE END AS j
  FROM sets a JOIN sets b ON a.query_id = b.query_id AND a.rank < b.rank
)
SELECT s.query_id, s.n AS n_samples, round(a.m, 6) AS consistency
FROM (SELECT query_id, count(*)::BIGINT AS n FROM sets GROUP BY query_id) s
LEFT JOIN (SELECT query_id, avg(j) AS m FROM alike GROUP BY query_id) a USING (query_id)"""

# the data command: vectors of the page chunks that hold a token
PAGE_CHUNKS = (
    f"sections AS ({SQL['article_sections']}),"
    + recursive_chunks_sql("sections", "page_id")
    + """,
chunks AS (
  SELECT sha256(concat_ws('|', rc.k::VARCHAR, '0', rc.chunk_pos::VARCHAR)) AS pk, s.source, rc.text
  FROM rc JOIN sections s ON s.page_id = rc.k
)"""
)
SQL["page_knowledge_table"] = (
    _with(PAGE_CHUNKS, BM25, _hashed("dhv", "pk", "tok"), NON_EMPTY).replace("WITH ", _REC, 1) + KNOWLEDGE
)
