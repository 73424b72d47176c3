"""Registered queries against their DuckDB oracle (sf0.001)."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_compare import compare

NAMES = [
    "chunk_windows",
    "bm25_terms",
    "bm25_stats",
    "bm25_query_weights",
    "full_text_topk",
    "dense_topk",
    "dense_topk_blocked",
    "semantic_topk",
    "sparse_topk",
    "hybrid_rrf",
    "context_text",
    "nav_sections",
    "page_base_url",
    "vector_map",
    "hybrid_rerank",
    "rag_prompt",
    "hyde_topk",
    "cascade_answer",
    "cascade_report",
    "store_full_text_topk",
    "sparse_weights",
    "hash_embed_terms",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res["cols_match"], res
    assert res["spark_rows"] == res["duck_rows"], res
    assert res["values_match"], res


def test_every_query_has_contract_shape(spark):
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    df = E.entry(spark)
    assert df.count() > 0
