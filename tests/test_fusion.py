"""RRF (A4, W5) and context (A5) fixtures."""

from quarry.operators.fusion import context, rrf


def _lists(spark, *lists):
    out = []
    for texts in lists:
        rows = [(1, i + 1, t) for i, t in enumerate(texts)]
        out.append(spark.createDataFrame(rows, "query_id long, rank long, text string"))
    return out


def test_rrf_fixture(spark):
    res = rrf(_lists(spark, ["A", "B"], ["B", "C"]), k=10).orderBy("rank").collect()
    assert [r.text for r in res] == ["B", "A", "C"]
    assert [round(r.score, 7) for r in res] == [0.0330601, 0.0166667, 0.0163934]


def test_rrf_tie_first_list_first(spark):
    res = rrf(_lists(spark, ["A"], ["B"]), k=10).orderBy("rank").collect()
    assert [r.text for r in res] == ["A", "B"]


def test_context_in_rank_order_and_empty(spark):
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id long, rank long, text string")
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, query_text string")
    got = {r.query_id: r.context for r in context(hits, q).collect()}
    assert got == {1: "a b", 2: ""}
