"""Plan shapes that the scale design depends on (read from the executed plan)."""

import contextlib
import io
import re

from tests.conftest import SF_SMALL


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(df) -> list[str]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", buf.getvalue())


def test_full_text_plan_no_corpus_shuffle(spark):
    from quarry.plans.registry import full_text_topk

    df = full_text_topk(spark, SF_SMALL)
    plan = _plan(df)
    assert "MapInPandas" in plan  # in-task scoring
    assert "WindowGroupLimit" in plan  # partial top k before the exchange
    assert "BroadcastHashJoin" in plan  # hits broadcast for the text fetch
    assert plan.count("Exchange hashpartitioning") <= 1  # only the k-per-task exchange
    schemas = _read_schemas(df)
    assert any("terms" in s and "text" not in s for s in schemas)  # scoring scan skips text
    assert any(s == "struct<pk:string,text:string>" for s in schemas)  # fetch scan pruned


def test_dense_plan_scans_in_place(spark):
    from quarry.plans.registry import dense_topk

    plan = _plan(dense_topk(spark, SF_SMALL))
    assert "MapInPandas" in plan and "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bm25_fit_uses_subqueries_not_joins(spark):
    from quarry.plans.registry import bm25_doc_weights

    plan = _plan(bm25_doc_weights(spark, SF_SMALL))
    assert "Subquery" in plan
    # a narrow map over chunks: the only exchange is the global average
    # inside the avgdl subquery (SinglePartition), never a hash shuffle
    assert "Join" not in plan and "Exchange hashpartitioning" not in plan


def test_store_search_reads_only_query_term_postings(spark):
    from quarry.plans.registry import store_full_text_topk

    df = store_full_text_topk(spark, SF_SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    out = buf.getvalue()
    part = [l for l in out.splitlines() if "PartitionFilters" in l and "term_bucket" in l]
    pushed = [l for l in out.splitlines() if "PushedFilters" in l and "In(term" in l]
    assert any((" IN (" in l) or ("INSET" in l) for l in part), part  # bucket partition filter
    assert pushed  # term filter reaches the parquet reader (row groups by min/max)
