"""Many queries over many documents: frequent terms go through a matrix
product, and only sums in reach of a floor are made exactly."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import bm25, search


def _texts(rng, n):
    return [" ".join(f"w{min(rng.integers(1, 200, 2))}" for _ in range(rng.integers(0, 30))) for _ in range(n)]


def _rows(df):
    return sorted((r.query_id, r["rank"], r.pk, round(r.score, 6)) for r in df.collect())


def test_a_floor_changes_no_hit(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = _texts(rng, 1500)
    rows = [(f"{i:08x}", t) for i, t in enumerate(texts + texts[:40])]
    chunks = bm25.with_terms(spark.createDataFrame(rows, "pk string, text string").repartition(2, "pk")).cache()
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(rng, 60) + ["", "unknown", "w198 w199"])], "query_id long, query_text string")
    vocab, stats = bm25.fit(chunks)
    weights, _ = bm25.query_weights(queries, vocab)
    want = _rows(search.sparse_topk(weights, bm25.doc_weights(chunks, stats), 5))
    assert _rows(search.bm25_scan_topk(weights, chunks, stats, 5)) == want
    monkeypatch.setattr(search, "FLOOR_PAIRS", 1)
    held: list = []
    assert _rows(search.bm25_scan_topk(weights, chunks, stats, 5, held=held)) == want
    floor = held[0].value[2]
    last = {q: s for q, rank, _, s in want if rank == 5}
    ids = held[0].value[0].ids.tolist()
    assert len(held) == 1 and np.isfinite(floor).sum() > 30
    assert all(f <= last[q] + 1e-6 for q, f in zip(ids, floor) if np.isfinite(f))
    negative = weights.withColumn("weight", F.when(F.col("term") == "w3", -F.col("weight")).otherwise(F.col("weight")))
    assert _rows(search.bm25_scan_topk(negative, chunks, stats, 5)) == _rows(search.sparse_topk(negative, bm25.doc_weights(chunks, stats), 5))
    chunks.unpersist()


def test_exact_scores_of_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    weights = pd.DataFrame([(q, f"t{t}", rng.random() + 0.1) for q in (7, 3, 9) for t in rng.choice(20, 8, replace=False)], columns=["query_id", "term", "weight"])
    asked = search.TermQueries(pd.concat([weights, weights[:2]]))  # a repeated row adds up
    row = np.repeat(np.arange(50), 6)
    col, dw = np.concatenate([rng.choice(len(asked.terms), 6, replace=False) for _ in range(50)]), rng.random(300)
    doc, query = np.divmod(np.sort(rng.choice(150, 70, replace=False)), 3)
    dense = np.zeros((50, len(asked.terms)))
    dense[row, col] = dw
    wide = np.zeros((len(asked.terms), 3))
    np.add.at(wide, (asked.term, asked.query), asked.weight)
    for cells in (search.MAX_CELLS, 40):
        monkeypatch.setattr(search, "MAX_CELLS", cells)
        assert np.allclose(asked.exact(doc, query, row, col, dw, 50), (dense @ wide)[doc, query])
