"""Top-k search against brute force, plan shapes, empty-vector filter."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.operators.sizing import broadcast_if_small


def _brute_dense(q, d, k):
    qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    dn = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
    s = qn @ dn.T
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(d)), key=lambda j: (-round(s[i, j], 9), j))[:k]
        out[i] = order
    return out


def test_dense_strategies_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    d = rng.normal(size=(300, 16)).astype(np.float32)
    d[5] = d[6]  # exact copies tie -> broken by id
    d[9] = 0.0  # zero vector scores 0
    q = rng.normal(size=(37, 16)).astype(np.float32)
    corpus = spark.createDataFrame([(i, d[i].tolist()) for i in range(len(d))], "pk long, vector array<float>")
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "query_id long, vector array<float>")
    want = _brute_dense(q.astype(np.float64), d.astype(np.float64), 5)
    for strategy, kw in (("broadcast", {}), ("blocked", {"block_rows": 64})):
        hits = search.dense_topk(queries, corpus.repartition(4), k=5, strategy=strategy, **kw)
        got = {}
        for r in hits.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.pk)
        assert got == want, strategy


def test_sparse_topk_brute_force_and_plan(spark):
    rng = np.random.default_rng(3)
    post = [(f"d{i:03d}", f"t{t}", float(rng.integers(1, 5))) for i in range(120) for t in rng.choice(30, 6, replace=False)]
    qw = [(qid, f"t{t}", float(rng.integers(1, 3))) for qid in range(9) for t in rng.choice(30, 3, replace=False)]
    P = spark.createDataFrame(post, "pk string, term string, weight double")
    Q = spark.createDataFrame(qw, "query_id long, term string, weight double")
    Qb, small = broadcast_if_small(Q, 1000)
    assert small
    hits = search.sparse_topk(Qb, P, 4, True)
    scores = {}
    for qid, t, w in qw:
        for pk, t2, w2 in post:
            if t == t2:
                scores[(qid, pk)] = scores.get((qid, pk), 0.0) + w * w2
    want = {}
    for (qid, pk), s in scores.items():
        want.setdefault(qid, []).append((-round(s, 9), pk))
    want = {qid: [pk for _, pk in sorted(v)[:4]] for qid, v in want.items()}
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.pk)
    assert got == want
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "Python" not in plan  # pure Catalyst


def test_ranks_without_gaps(spark):
    from quarry.plans.registry import full_text_hits
    from tests.conftest import SF_SMALL

    hits = full_text_hits(spark, SF_SMALL)
    per_q = {}
    for r in hits.collect():
        per_q.setdefault(r.query_id, []).append(r.rank)
    for ranks in per_q.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_empty_vector_filter(spark):
    from quarry.config import Settings
    from quarry.operators import bm25
    from quarry.plans.build import knowledge_rows

    chunks = spark.createDataFrame(
        [("p1", "-?#", "s"), ("p2", "real words here", "s")], "pk string, text string, source string"
    )
    chunks = bm25.with_terms(chunks)
    counts = {}
    on, _ = knowledge_rows(chunks, Settings(dense_dim=8), counts=counts)
    off, _ = knowledge_rows(chunks, Settings(dense_dim=8, enable_full_text=False))
    assert sorted(r.pk for r in on.collect()) == ["p2"]
    assert counts["before_filter"].get["n"] == 2 and counts["after_filter"].get["n"] == 1
    assert sorted(r.pk for r in off.collect()) == ["p1", "p2"]
    assert "full_text_vector" not in off.columns


def test_running_top_k_over_blocks_equals_one_sort():
    rng = np.random.default_rng(11)
    scores = np.round(rng.normal(size=(900, 40)), 1)  # many ties
    docs = rng.permutation(900)
    best = search.RunningTopK(np.arange(40) + 100, 5)
    best.limit = 150  # merges often
    for lo in range(0, 900, 70):
        best.add_block(scores[lo : lo + 70], docs[lo : lo + 70])
    rows = best.result()
    assert len(rows) == 5 * 40  # once per task, not per block
    for q, part in rows.groupby("query_id"):
        want = sorted(range(900), key=lambda i: (-scores[i, q - 100], docs[i]))[:5]
        assert part["pk"].tolist() == docs[want].tolist()


def test_running_top_k_rows_leaving_python(spark):
    rng = np.random.default_rng(5)
    corpus = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(600)], "pk long, vector array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(10)], "query_id long, vector array<double>")
    qp = queries.selectExpr("query_id", "vector as qv").toPandas()
    found = search._broadcast_block_product(
        qp, corpus.selectExpr("pk", "vector as dv").repartition(3), 5, "query_id long, pk long, score double"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert found.count() <= 5 * 10 * 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _exchanges_of(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in line]


def test_pairs_of_dealt_postings_are_not_exchanged(spark, tmp_path):
    """The relational plan deals chunks by key; of the (query, chunk) sums only
    the k best of a task cross the network."""
    from quarry.plans import registry

    spark.createDataFrame(
        [(i, f"w{i % 7} w{i % 5} common", "en", "s", 1) for i in range(60)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"common w{i}") for i in range(9)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    hits = registry.full_text_topk_join(spark, str(tmp_path))
    found = _exchanges_of(hits)
    assert found and not [line for line in found if "query_id" in line and "pk" in line]
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, registry.full_text_topk(spark, str(tmp_path)).collect()))


def test_blocks_scan_a_written_corpus(spark, monkeypatch):
    """A corpus that is planned with an exchange is written once; no block of
    queries runs the exchange again."""
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(40)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    seen, real = [], search._broadcast_block_product

    def watched(part, c, *rest):
        seen.append("Exchange" in c._jdf.queryExecution().executedPlan().toString())
        return real(part, c, *rest)

    monkeypatch.setattr(search, "_broadcast_block_product", watched)
    blocked = search.dense_topk(q, emb, key="vec_id", vector="embedding", strategy="blocked", block_rows=10)
    assert len(seen) > 1 and not any(seen)
    whole = search.dense_topk(q, emb, key="vec_id", vector="embedding", strategy="broadcast")
    pick = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert pick(blocked) == pick(whole)


def test_a_block_under_the_floor_is_not_partitioned(monkeypatch):
    """Once the floor is set, a block of worse scores costs a comparison; the
    rows are those of one sort, ties at the floor included."""
    rng = np.random.default_rng(4)
    scores = np.round(rng.random((1200, 30)), 2)
    scores[:200] += 1  # the best come first, so the floor is high afterwards
    scores[700, :] = np.sort(scores[:200], axis=0)[-3]  # ties with kept rows
    docs = rng.permutation(1200)
    best, calls = search.RunningTopK(np.arange(30), 3), []
    best.limit = 50
    real = np.partition
    monkeypatch.setattr(search.np, "partition", lambda *a, **kw: calls.append(1) or real(*a, **kw))
    for lo in range(0, 1200, 100):
        best.add_block(scores[lo : lo + 100], docs[lo : lo + 100])
    assert 1 <= len(calls) <= 3
    for q, part in best.result().groupby("query_id"):
        want = sorted(range(1200), key=lambda i: (-scores[i, q], docs[i]))[:3]
        assert part["pk"].tolist() == docs[want].tolist()


def test_blank_windows_are_told_at_their_first_letter(spark):
    from quarry.functions.text import not_blank, py_strip

    texts = ["", " ", "\t\n \x85\x1c", " a ", " ", "\n.", "​", "x" * 40, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(not_blank("t").alias("a"), (py_strip("t") != "").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert True in {r.a for r in rows} and False in {r.a for r in rows}


def test_small_blocks_are_searched_in_one_job(spark, monkeypatch):
    """Blocks of few queries are read and searched together; the corpus is
    written once, as packed unit vectors."""
    from quarry.operators import sizing

    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(1500)] + [(5000, [0.0] * 5)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    q = emb.where("vec_id < 90 or vec_id = 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    written, columns, real, product = [], [], sizing.write_table, search._broadcast_block_product
    monkeypatch.setattr(sizing, "write_table", lambda df, path: written.append(path) or real(df, path))
    monkeypatch.setattr(search, "_broadcast_block_product", lambda part, c, *rest: columns.append(c.columns) or product(part, c, *rest))
    blocked = search.dense_topk(q, emb, key="vec_id", vector="embedding", strategy="blocked", block_rows=10)
    assert len(columns) == 10 and all(c == ["pk", "units"] for c in columns)
    assert len([p for p in written if "block-hits" in p]) == 1
    monkeypatch.setattr(sizing, "TOGETHER_ROWS", 25)
    again = search.dense_topk(q, emb, key="vec_id", vector="embedding", strategy="blocked", block_rows=10)
    assert len([p for p in written if "block-hits" in p]) > 3
    whole = search.dense_topk(q, emb, key="vec_id", vector="embedding", strategy="broadcast")
    pick = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())
    assert pick(blocked) == pick(again) == pick(whole)
