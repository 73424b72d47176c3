"""Sample consistency, the analyzer's suffix rule, chunk offsets, streams and
the stamp of an input."""

import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions.text import tokens
from quarry.operators import generate
from quarry.operators.chunks import recursive_chunks
from quarry.operators.splitter import split_spans
from quarry.plans.corpus import input_stamp
from quarry.plans.strategies import Models, Retriever
from quarry.streaming.ingest import ingest_documents
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare


def test_consistency_equals_all_pairs(spark):
    rows = [(1, "a b c"), (1, "c b"), (1, "x"), (2, "only one"), (3, ""), (3, None), (3, "a"), (4, "Same same"), (4, "same"), (4, "SAME!")]
    got = {r.query_id: (r.n_samples, r.consistency) for r in generate.sample_consistency(spark.createDataFrame(rows, "query_id long, response string")).collect()}
    for q in (1, 2, 3, 4):
        sets = [set(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows if i == q]
        alike = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in itertools.combinations(sets, 2)]
        n, value = got[q]
        assert n == len(sets) and (value is None if not alike else abs(value - sum(alike) / len(alike)) < 1e-12)
    many = spark.range(9).selectExpr("1L as query_id", "cast(id as string) as response")
    with pytest.raises(Exception, match="more than 8 samples"):
        generate.sample_consistency(many, most=8).collect()
    assert generate.sample_consistency(many, most=9).first().n_samples == 9


def test_sampled_responses_of_a_generator(spark):
    chunks = spark.createDataFrame([("p", "text", "s", 1, [])], "pk string, text string, source string, dl long, terms array<struct<term:string,tf:bigint>>")

    def make():
        calls = itertools.count()
        return lambda prompts, most, system: [f"same words {next(calls) % 2}" for _ in prompts]

    r = Retriever(chunks, Settings(), Models(generator=make))
    q = spark.createDataFrame([(1, "why"), (2, "how")], "query_id long, query_text string")
    got = {x.query_id: x for x in r.consistency("no_retrieval", q, 4).collect()}
    assert set(got) == {1, 2} and all(x.n_samples == 4 and 0.5 <= x.consistency <= 1 for x in got.values())


def test_suffix_rule_keeps_three_letters(spark):
    df = spark.createDataFrame([("Playing played plays sing Eating es bes buses it-s naïves",)], "t string")
    got = df.select(tokens(F.col("t"), ["it"], ("s", "ing", "ed", "es")).alias("x")).first().x
    assert got == ["play", "play", "play", "sing", "eat", "es", "bes", "bus", "s", "naïv"]
    with pytest.raises(ValueError):
        tokens(F.col("t"), None, ("x.",))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(2, 30), st.data())
def test_spans_are_cuts_of_the_text(text, size, data):
    overlap = data.draw(st.integers(0, size))
    spans = split_spans(text, size, overlap)
    assert all(0 <= a < b <= len(text) and text[a:b] == text[a:b].strip() for a, b in spans)
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)
    covered = set().union(*(range(a, b) for a, b in spans)) if spans else set()
    assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def test_offsets_point_into_the_source(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.text for r in docs.collect()}
    rows = recursive_chunks(docs, key_cols=["doc_id"], offsets=True).collect()
    assert len(rows) > 500 and all(r.text == whole[r.doc_id][r.start : r.end] for r in rows)
    plain = recursive_chunks(docs, key_cols=["doc_id"])
    assert "start" not in plain.columns and plain.count() == len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string")
    assert recursive_chunks(odd, key_cols=["doc_id"], offsets=True).count() == 0


def test_a_restarted_stream_takes_new_files_only(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    docs.where("doc_id < 50").write.parquet(source)
    ingest_documents(spark, source, out, progress).awaitTermination(300)
    first = spark.read.parquet(out)
    n = first.count()
    assert first.select("doc_id").distinct().count() == docs.where("doc_id < 50 and text <> ''").count()
    ingest_documents(spark, source, out, progress).awaitTermination(300)
    assert spark.read.parquet(out).count() == n
    docs.where("doc_id >= 50").write.mode("append").parquet(source)
    ingest_documents(spark, source, out, progress, max_files_per_trigger=1).awaitTermination(300)
    from quarry.plans.registry import QUERIES

    want = QUERIES["chunk_windows"](spark, SF_SMALL)
    assert sorted(r.pk for r in spark.read.parquet(out).select("pk").collect()) == sorted(r.pk for r in want.select("pk").collect())


def test_another_input_has_another_stamp(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(5).write.parquet(f"{folder}/documents.parquet")
    one = input_stamp(spark, folder)
    assert len(one) == 1 and one == input_stamp(spark, folder)
    spark.range(5, 9).write.mode("append").parquet(f"{folder}/documents.parquet")
    assert input_stamp(spark, folder) != one


@pytest.mark.parametrize(
    "name",
    ["recursive_chunks", "page_chunks", "page_knowledge_table", "chunk_offsets", "stream_chunks", "source_counts", "full_text_topk_suffixes", "sample_consistency", "store_sparse_topk", "store_full_text_topk_index", "store_semantic_topk"],
)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res["cols_match"] and res["spark_rows"] == res["duck_rows"] and res["values_match"], res
