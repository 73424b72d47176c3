"""A written store answers like the session that built it."""

from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import encode
from quarry.plans import build
from quarry.plans.registry import QUERIES
from quarry.plans.strategies import Retriever

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_colliding_ids_of_a_row_are_one_index(spark, monkeypatch):
    monkeypatch.setattr(encode, "term_id", lambda t: F.length(t).cast("int"))
    df = spark.createDataFrame(
        [(1, [("aa", 1), ("bb", 1), ("c", 1)]), (2, [("aa", 1), ("c", 1)]), (3, [])],
        "pk int, terms array<struct<term:string,tf:bigint>>",
    )
    got = {r.pk: r.sparse_vector for r in encode.with_sparse_map(df).collect()}
    assert got == {1: {2: 2.0, 1: 1.0}, 2: {2: 1.0, 1: 1.0}, 3: {}}


def test_sparse_build_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, [("a", 2)])], "pk int, terms array<struct<term:string,tf:bigint>>")
    plan = encode.with_sparse_map(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_page_store_holds_the_page_chunks(spark):
    stored = QUERIES["page_knowledge_table"](spark, SF)
    chunks = QUERIES["page_chunks"](spark, SF)
    assert _rows(stored.select("pk", "text", "source")) == _rows(
        chunks.select("pk", "text", "source").where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    )
    vectors = encode.hash_vectors(stored.select("pk", "text"), "text").select("pk", "vector")
    both = stored.join(vectors, "pk")
    apart = F.expr("aggregate(zip_with(dense_vector, vector, (a, b) -> abs(a - b)), 0D, (s, x) -> s + x)")
    assert both.count() == stored.count() > 0
    assert both.where(apart > 1e-4).count() == 0


def test_stop_words_hold_on_both_sides(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            (1, "https://h/a/i.html", "<body><section><a href='x'>the red fox</a></section></body>"),
            (2, "https://h/a/j.html", "<body><section><a href='y'>the blue hen</a></section></body>"),
            (3, "https://h/a/k.html", "<body><section><a href='z'>a green owl</a></section></body>"),
        ],
        "page_id long, url string, html string",
    )
    settings = Settings(stop_words=("the", "a"))
    build.build_and_write(pages, str(tmp_path / "s"), settings)
    r = Retriever.from_store(spark, str(tmp_path / "s"), settings)
    assert {x.term for x in r.index.vocab.collect()} == {"red", "fox", "blue", "hen", "green", "owl"}
    queries = spark.createDataFrame([(1, "the hen"), (2, "the a")], "query_id long, query_text string")
    assert [(h.query_id, h.text) for h in r.full_text(queries).collect()] == [(1, "the blue hen")]


def test_ids_of_whole_batches_are_those_of_each_term(spark):
    words = [["a", "é", "中文", "\U0001f600x"], [], ["a"], None]
    df = spark.createDataFrame([(i, w and [(x, 1 + j) for j, x in enumerate(w)] if w is not None else None) for i, w in enumerate(words)], "pk int, terms array<struct<term:string,tf:bigint>>")
    one = encode.with_sparse_map(df.where("pk < 3"))
    plan = encode.with_sparse_map(df, ids=encode.term_ids("terms"))._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "ArrowEvalPython" in plan
    assert sorted(map(tuple, encode.with_sparse_map(df.where("pk < 3"), ids=encode.term_ids("terms")).collect())) == sorted(map(tuple, one.collect()))
