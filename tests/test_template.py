"""G1 prompt building."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.template import split_template, substitute


def test_split():
    assert split_template("C: $context Q: ${query} $$") == [
        ("lit", "C: "),
        ("var", "context"),
        ("lit", " Q: "),
        ("var", "query"),
        ("lit", " $"),
    ]
    with pytest.raises(ValueError):
        split_template("bad $ here")


def test_no_second_expansion(spark):
    df = spark.createDataFrame([("why", "cost is $query")], "q string, c string")
    out = df.select(substitute("C: $context Q: $query", F.col("q"), F.col("c")).alias("p"))
    assert out.first().p == "C: cost is $query Q: why"
    out = df.select(substitute("Q: $query", F.col("q"), F.col("c")).alias("p"))
    assert out.first().p == "Q: why"
