"""Terms are counted, and unit vectors made, over whole Arrow batches."""

from hashlib import md5

import numpy as np
import pyarrow as pa

from quarry.functions.text import with_term_counts
from quarry.operators import bm25, encode


def _chunks(spark):
    texts = ["b a b C", "", "--", None, "straße ß É é z \U0001f600x 中文 zz z", "a" * 300]
    rows = [(f"{i:08x}", "s", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pk string, source string, text string")


def test_terms_are_counted_in_byte_order(spark):
    got = {r.pk: r for r in bm25.with_terms(_chunks(spark)).collect()}
    for r in got.values():
        words = [t.term for t in r.terms]
        assert words == sorted(set(words), key=str.encode) and sum(t.tf for t in r.terms) == r.dl
    assert [tuple(t) for t in got["00000000"].terms] == [("a", 1), ("b", 2), ("c", 1)]
    assert all(got[f"{i:08x}"].terms == [] for i in (1, 2, 3))
    plan = with_term_counts(spark.createDataFrame([(["x"],)], "t array<string>"), "t")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan


def test_unit_vectors_of_sliced_batches():
    words = [[f"w{j}" for j in range(i % 7)] + ["é中"] * (i % 3) for i in range(encode.UNIT_ROWS + 40)]
    got = encode._unit_vectors(pa.array([*words, None]), None, 16).to_pylist()
    for row, vector in zip(words, got):
        m = np.zeros(16)
        for w in row:
            m[int(md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        assert vector == (m / (np.sqrt((m * m).sum()) or 1.0)).astype(np.float32).tolist()
    assert len(got) == len(words) + 1 and got[-1] == [0.0] * 16
    assert encode._unit_vectors(pa.array([], pa.list_(pa.string())), None, 16).to_pylist() == []
