"""Document shards: block-max postings, packed vectors, versions, plan choice."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import search, shards
from quarry.operators.sizing import scan_tasks
from quarry.plans import build
from quarry.plans.strategies import Models, Retriever
from quarry.sources import store as stores

WORDS = ["w%02d" % i for i in range(40)]


def _pages(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [WORDS[min(rng.integers(40), rng.integers(40))] for _ in range(rng.integers(3, 40))]
        rows.append((i, f"https://h/{i}/i.html", f"<body><section><a href='x'>{' '.join(words)}</a></section></body>"))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 9)))) for i in range(25)] + [(90, "unknown"), (91, ""), (92, None)]
    return spark.createDataFrame(rows, "query_id long, query_text string")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    pages = _pages(spark)
    chunks = build.page_chunks(pages, Settings(enable_sparse=True, chunk_size=60, chunk_overlap=10))
    rows, ix = build.knowledge_rows(chunks, Settings(enable_sparse=True))
    made = stores.Store(rows, ix.postings, ix.vocab, ix.stats)
    stores.write_store(made, path, 384, shard_rows=40)
    return path


def _rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "pk", F.round("score", 6), "text").collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_of_a_shard_equals_adding_all_up():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    skipped = 0
    for n in range(40):
        terms = pd.Index([f"t{i}" for i in range(12)])
        lists = [np.sort(rng.choice(600, rng.integers(1, 600), replace=False)) for _ in terms]
        values = [np.round(rng.random(len(d)), 1 + n % 3).astype(np.float32) + np.float32(0.1) for d in lists]
        best = [[float(v[i : i + shards.BLOCK].max()) for i in range(0, len(v), shards.BLOCK)] for v in values]
        table = pa.table({"term": terms.tolist(), "docs": [d.astype(np.int32) for d in lists], "weights": values, "block_max": pa.array(best, pa.list_(pa.float32()))})
        postings = shards.ShardPostings(table, terms)
        asked = rng.choice(12, rng.integers(1, 9), replace=False)
        weight = rng.random(len(asked)) ** 6 * 9 + 0.01
        if n % 5 == 0:
            weight[0] = -weight[0] if n % 2 else 0.0  # nothing can be left out then
        docs, scores = postings.best_of(postings.row[asked], weight, 5)
        score, touched = np.zeros(600), np.zeros(600, bool)
        for t, w in zip(asked, weight):
            score[lists[t]] += w * values[t].astype(np.float64)
            touched[lists[t]] = True
        found = np.flatnonzero(touched)
        want = found[np.lexsort((found, -np.round(score[found], 9)))[:5]]
        assert docs.tolist() == want.tolist() and np.allclose(scores, score[want])
        skipped += postings.skipped
    assert skipped > 0


def test_all_plans_of_a_store_search_agree(spark, root, queries):
    store = stores.read_store(spark, root)
    assert store.knowledge.select("shard").distinct().count() > 1
    want = _rows(stores.search_store(store, queries, plan="scan"))
    assert len(want) > 100
    for plan in ("index", "postings", "auto"):
        assert _rows(stores.search_store(store, queries, plan=plan)) == want, plan
    # a query side too large to broadcast goes through the shards in blocks
    assert _rows(stores.search_store(store, queries, max_broadcast_rows=20)) == want


def test_auto_takes_the_cheaper_plan(spark, root, queries):
    """Few matches promised by the stored frequencies: term buckets and a join;
    many: the shards, where no posting is moved."""
    store = stores.read_store(spark, root)
    few = _plan(stores.search_store(store, queries))
    many = _plan(stores.search_store(store, queries, join_pairs=10))
    assert "term_bucket" in few and "FlatMapGroupsInArrow" not in few
    assert "FlatMapGroupsInArrow" in many and "term_bucket" not in many
    # only the k rows per query of a task are exchanged: below the scoring there is none
    below = many[many.index("FlatMapGroupsInArrow") :]
    assert "Exchange hashpartitioning" not in below[: below.index("pk#")] and "WindowGroupLimit" in many


def test_block_hits_come_without_copies_of_the_corpus(spark, monkeypatch):
    plans = []
    real = search.in_blocks

    def spy(session, parts, run):
        def noted(part, held):
            out = run(part, held)
            plans.append((_plan(out), held))
            return out

        return real(session, parts, noted)

    monkeypatch.setattr(search, "in_blocks", spy)
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "query_id long, vector array<float>")
    corpus = df.withColumnRenamed("query_id", "pk")
    hits = search.dense_topk(df, corpus, k=3, strategy="blocked", block_rows=30)
    assert hits.count() == 300 and len(plans) == 4
    for plan, held in plans:
        assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan and "CoGroup" not in plan
        with pytest.raises(Exception):  # noqa: B017 - destroyed after its block
            held[0].unpersist()


def test_packed_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1500, 8)).astype(np.float32)
    m[3], m[9] = 0, m[4]
    rows = spark.createDataFrame([(i * 7, m[i].tolist()) for i in range(len(m))] + [(20_000, None)], "at long, vector array<float>").coalesce(1)
    packed = shards.packed_vectors(rows, "vector")
    assert sorted(r.n for r in packed.collect()) == [476, 1024]
    q = pd.DataFrame({"query_id": [1, 2], "qv": [m[4].tolist(), rng.normal(size=8).tolist()]})
    got = shards.packed_topk(q, packed, 4).orderBy("query_id", "rank").collect()
    unit = m.astype(np.float64) / np.maximum(np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True), 1e-300)
    for query, vector in zip(q["query_id"], q["qv"]):
        v = np.asarray(vector) / np.linalg.norm(vector)
        score = np.round(unit @ v, 9)
        want = sorted(range(len(m)), key=lambda i: (-score[i], i))[:4]
        assert [r["at"] for r in got if r.query_id == query] == [i * 7 for i in want]


def test_store_dense_search_equals_the_session(spark, root, queries):
    r = Retriever.from_store(spark, root, Settings(enable_sparse=True))
    q = r._encode_queries(queries.where("query_text is not null"))
    want, _ = search.dense_topk(q, r.vectors, with_plan=True)
    want = _rows(search.with_text(want, r.chunks))
    assert _rows(stores.dense_store(r.store, q, 5, 100)) == want == _rows(stores.dense_store(r.store, q, 5, 7))


def test_a_reader_sees_one_version_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    old, new = _pages(spark, 5, 1), _pages(spark, 9, 2)
    with pytest.raises(FileNotFoundError):
        stores.read_store(spark, path)
    build.build_and_write(old, path)
    pinned = stores.read_store(spark, path)
    before = _rows(stores.search_store(pinned, spark.createDataFrame([(1, "w01 w02")], "query_id long, query_text string")))
    # a write that breaks off after most of its tables leaves the old version
    real = stores.term_bucket

    def broken(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(stores, "term_bucket", broken)
    with pytest.raises(RuntimeError):
        build.build_and_write(new, path)
    monkeypatch.setattr(stores, "term_bucket", real)
    assert stores.read_store(spark, path).version == pinned.version
    build.build_and_write(new, path)
    now = stores.read_store(spark, path)
    assert now.version != pinned.version and now.knowledge.count() == 9 and pinned.knowledge.count() == 5
    q = spark.createDataFrame([(1, "w01 w02")], "query_id long, query_text string")
    assert _rows(stores.search_store(pinned, q)) == before
    assert stores.read_store(spark, path, pinned.version).knowledge.count() == 5
    with pytest.raises(FileNotFoundError):
        stores.read_store(spark, path, "v0_none")


def test_keys_that_are_no_digests_fail_the_write(spark):
    bad = spark.createDataFrame([("p1", "t", [0.0], "s")], "pk string, text string, dense_vector array<float>, source string")
    with pytest.raises(Exception, match="breaks store limits"):
        stores.validate(bad, 1).collect()


def test_two_level_merge_of_many_tasks(spark):
    """One query with candidates from 1,000 tasks: the last window reads k rows
    a salt."""
    rows = spark.range(0, 20_000, 1, 1000).selectExpr("id div 100000 as query_id", "id as pk", "(id * 7919 % 20011) / 20011.0D as score")
    assert scan_tasks(rows) == 1000 and scan_tasks(rows.repartition(3)) == 0
    two = search.top_k(rows, 5, tasks=1000)
    one = search.top_k(rows.coalesce(8), 5)
    assert two.orderBy("rank").collect() == one.orderBy("rank").collect()
    plan = _plan(two)
    assert plan.count("WindowGroupLimit") == 4 and "_salt" in plan and "_salt" not in _plan(one)


class CountingSparse:
    """A sparse model that counts how often a task builds it."""

    def __init__(self, built, texts):
        self.built, self.texts = built, texts

    def __call__(self):
        self.built.add(1)

        def encode(texts):
            self.texts.add(len(texts))
            return [{sum(map(ord, w)): float(len(w)) for w in t.split()} | {7: 0.0} for t in texts]

        return encode


def test_sparse_model_hook_and_its_postings(spark, tmp_path, queries):
    sc = spark.sparkContext
    built, texts = sc.accumulator(0), sc.accumulator(0)
    hook = CountingSparse(built, texts)
    settings = Settings(enable_sparse=True)
    build.build_and_write(_pages(spark, 20), str(tmp_path / "s"), settings, make_sparse_encoder=hook)
    n = build.page_chunks(_pages(spark, 20), settings).count()
    assert texts.value == n and built.value <= 16  # each text once, a model a task
    r = Retriever.from_store(spark, str(tmp_path / "s"), settings, Models(sparse_encoder=hook))
    rows = r.store.sparse_index.where("term = 7").count()
    assert rows == 0  # zero weights are not stored
    before = texts.value
    got = _rows(r.sparse(queries))
    assert texts.value - before == queries.count()
    text = {x.pk: x.text for x in r.chunks.select("pk", "text").collect()}
    vector = hook_vector = lambda t: {sum(map(ord, w)): float(len(w)) for w in t.split()}  # noqa: E731, F841
    want = []
    for q in queries.collect():
        score = {pk: sum(w * hook_vector(t).get(i, 0) for i, w in vector(q.query_text or "").items()) for pk, t in text.items()}
        best = sorted((x for x in score.items() if x[1]), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        want += [(q.query_id, i + 1, pk, round(s, 6), text[pk]) for i, (pk, s) in enumerate(best)]
    assert got == sorted(want)
    session = Retriever(build.page_chunks(_pages(spark, 20), settings), settings, Models(sparse_encoder=hook))
    assert _rows(session.sparse(queries)) == got


def test_stored_postings_hold_places_not_keys(spark, root, queries):
    """Postings are written with an 8-byte place for the key and read back with
    the keys and the exact weights; rows that share a key share a place."""
    store = stores.read_store(spark, root)
    assert set(store.entries.columns) == {"term", "at", "weight", "term_bucket"}
    assert store.postings.schema["weight"].dataType.simpleString() == "double"
    counted = store.knowledge.select("pk", F.explode("full_text_vector").alias("term", "weight"))
    key = lambda df: sorted((r.pk, r.term, round(float(r.weight), 5)) for r in df.collect())
    assert key(store.postings) == key(counted)


def test_postings_of_repeated_keys_and_of_rows_without_counts(spark, tmp_path):
    pages = _pages(spark)
    chunks = build.page_chunks(pages, Settings(chunk_size=60, chunk_overlap=10))
    chunks = chunks.unionByName(chunks.limit(20))  # keys that come twice
    rows, ix = build.knowledge_rows(chunks, Settings())
    want = sorted((r.pk, r.term, round(r.weight, 9)) for r in ix.postings.collect())
    for name, given in (("counted", rows), ("plain", rows.drop("dl", "tf"))):
        stores.write_store(stores.Store(given, ix.postings, ix.vocab, ix.stats), str(tmp_path / name), 384, shard_rows=40)
        back = stores.read_store(spark, str(tmp_path / name)).postings
        assert sorted((r.pk, r.term, round(r.weight, 9)) for r in back.collect()) == want, name


def test_posting_rows_equal_lists_made_by_hand_and_never_slice_a_list_per_block(spark):
    rng = np.random.default_rng(8)
    rows = [
        (int(i % 3), int(i), {f"t{t}": float(np.float32(rng.random() + 0.1)) for t in rng.choice(9, rng.integers(0, 9), replace=False)})
        for i in rng.permutation(2000)
    ]
    rows += [(0, 9000, None), (1, 9001, {})]
    df = spark.createDataFrame(rows, "shard int, doc int, v map<string,float>").repartition(7)
    made = shards.posting_rows(df, "v", 3)
    plan = _plan(made)
    assert "slice(" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = {}
    for shard, doc, v in rows:
        for t, w in (v or {}).items():
            want.setdefault((shard, t), []).append((doc, w))
    found = made.collect()
    assert len(found) == len(want)
    for r in found:
        listed = sorted(want[r.shard, r.term])
        assert list(zip(r.docs, r.weights)) == listed
        assert r.block_max == [max(w for _, w in listed[i : i + shards.BLOCK]) for i in range(0, len(listed), shards.BLOCK)]


def test_store_rows_are_dealt_to_shards_before_their_vectors_are_made(spark):
    made = build.build_store(_pages(spark, 30), Settings(enable_sparse=True, chunk_size=60, chunk_overlap=10))
    plan = _plan(made.knowledge)
    assert "ArrowEvalPython" in plan[: plan.index("Exchange hashpartitioning(shard")]
    assert "weighted_unit" not in plan[plan.index("Exchange hashpartitioning(shard") :]


def test_stored_postings_move_as_runs(spark, root):
    store = stores.read_store(spark, root)
    plan = _plan(stores.entries(store, store.knowledge, store.bm25_stats))
    moved = plan[plan.index("Exchange") :]
    assert "inline" not in moved and "MapInArrow" in moved


def test_shards_are_hashed_apart(spark):
    found = [r[0] for r in spark.range(200).select(F.hash(F.col("id").cast("int"))).collect()]
    assert [stores._hash(i) for i in range(200)] == found
    for count in (1, 2, 6, 15, 90):
        n = stores.shard_tasks(count)
        load = pd.Series([h % n for h in found[:count]]).value_counts()
        assert count <= n <= 4 * count and load.max() <= (1 if count < 8 else 2)


def test_store_rows_lie_one_shard_a_file_and_postings_sorted(spark, root):
    store = stores.read_store(spark, root)
    files = store.knowledge.select("shard", F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == len({r.f for r in files}) == len({r.shard for r in files}) > 1
    rows = store.entries.select("term_bucket", "term", "at", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    by_file: dict = {}
    for r in sorted(rows, key=lambda r: r.i):
        by_file.setdefault(r.f, []).append((r.term.encode(), r.at))
    assert by_file and all(x == sorted(x) for x in by_file.values())


def test_runs_that_go_on_in_the_next_batch_are_joined(spark, monkeypatch):
    rows = [(i % 2, i, {f"t{i % 3}": 1.0 + i, "all": 2.0}) for i in range(300)]
    df = spark.createDataFrame(rows, "shard int, doc int, v map<string,float>").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = shards.posting_rows(df, "v", 2)
        plan, found = _plan(made), made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in plan
    assert len(found) == len({(r.shard, r.term) for r in found}) == 8
    for r in found:
        want = sorted((d, v[r.term]) for s, d, v in rows if s == r.shard and r.term in v)
        assert list(zip(r.docs, r.weights)) == want
