"""File scan (S1), observed counts (S2) and caller model hooks."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from quarry.config import STUB_RESPONSE, Settings
from quarry.operators import bm25
from quarry.operators.sections import base_url, sections
from quarry.plans.cascade import cascade_eager, cascade_lazy
from quarry.plans.corpus import materialize
from quarry.plans.strategies import Models, Retriever
from quarry.sources.tables import count_rows, read_html_files


def test_html_file_scan_and_base_url(spark):
    root = tempfile.mkdtemp(prefix="quarry-html-")
    os.makedirs(os.path.join(root, "docs.example.com", "a", "b"))
    page = '<body><section><a href="#s">S</a><p>hello</p></section></body>'
    with open(os.path.join(root, "docs.example.com", "a", "b", "i.html"), "w") as f:
        f.write(page)
    with open(os.path.join(root, "docs.example.com", "a", "notes.txt"), "w") as f:
        f.write("not a page")
    pages = read_html_files(spark, root)
    rows = pages.select("url", base_url(F.col("url")).alias("b")).collect()
    assert [(r.url, r.b) for r in rows] == [
        ("https://docs.example.com/a/b/i.html", "https://docs.example.com/a/b")
    ]
    secs = sections(pages).collect()
    assert [(s.source, s.text) for s in secs] == [("https://docs.example.com/a/b/#s", "S\nhello")]


def test_observed_count(spark):
    df, obs = count_rows(spark.range(123), "src")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["n"] == 123


def _chunks(spark):
    rows = [
        ("p1", "spark joins shuffle data between executors", "s1"),
        ("p2", "broadcast small tables to every executor", "s2"),
        ("p3", "parquet files store columns with statistics", "s3"),
    ]
    df = spark.createDataFrame(rows, "pk string, text string, source string")
    return materialize(bm25.with_terms(df))


def make_encoder():
    def encode(texts):
        out = np.zeros((len(texts), 8), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, len(w) % 8] += 1.0
        return out

    return encode


def make_generator():
    return lambda prompts, max_tokens, system: ["answer: " + p[-20:] for p in prompts]


def make_trust_scorer():
    # trusted only when the prompt's context mentions executors and the
    # question is query 1's (which says "node"; no chunk does)
    return lambda prompts, responses: [0.99 if ("executor" in p and "node" in p) else 0.1 for p in prompts]


def make_reranker():
    return lambda queries, texts: [float(len(set(q.split()) & set(t.split()))) for q, t in zip(queries, texts)]


def test_model_hooks_through_cascade(spark):
    models = Models(make_encoder, make_generator, make_trust_scorer, make_reranker)
    r = Retriever(_chunks(spark), Settings(dense_dim=8, top_k=2), models)
    q = spark.createDataFrame(
        [(1, "which node gets broadcast tables"), (2, "zzz unknown words")],
        "query_id long, query_text string",
    )
    lazy, report = cascade_lazy(r, q)
    eager, _ = cascade_eager(r, q)
    got = {x.query_id: (x.strategy, x.response) for x in lazy.collect()}
    assert got == {x.query_id: (x.strategy, x.response) for x in eager.collect()}
    # query 1: no_retrieval prompt has no context -> 0.1; semantic search finds
    # chunks mentioning executors -> accepted at priority 2
    assert got[1][0] == "semantic_search" and got[1][1].startswith("answer: ")
    assert got[2] == (None, STUB_RESPONSE)
    tried = sorted(x.priority for x in report.where("query_id = 1").collect())
    assert tried == [1, 2]
    rr = r.hybrid_rerank(q).where("query_id = 1").orderBy("rank").collect()
    assert len(rr) == 2 and rr[0].score >= rr[1].score
