"""Shuffle files go with their write; terms cross an exchange compactly."""

import os
import time

from pyspark.sql import functions as F

from quarry.operators import bm25
from quarry.plans import build
from quarry.plans.corpus import materialize


def _chunks(spark):
    texts = ["b a b C", "", "--", None, "straße ß É é z \U0001f600x 中文 zz z", "a" * 300]
    rows = [(f"{i:08x}", "s", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pk string, source string, text string")


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirsString() for _, _, names in os.walk(d) for f in names if f.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(key), _shuffle_files(spark)
    rows = spark.range(5000).withColumn("x", F.col("id") % 700).repartition(5, "x").groupBy("x").count()
    made = materialize(rows)
    until = time.time() + 20
    while _shuffle_files(spark) - files and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - files
    assert spark.conf.get(key) == before
    assert made.count() == 700 and made.agg(F.sum("count")).first()[0] == 5000


def test_packed_terms_come_back_as_they_were(spark):
    chunks = bm25.with_terms(_chunks(spark))
    moved = build.unpacked_terms(build.packed_terms(chunks))
    assert moved.schema["terms"].dataType.simpleString() == chunks.schema["terms"].dataType.simpleString()
    key = lambda r: r.pk
    assert sorted(moved.select("pk", "terms").collect(), key=key) == sorted(chunks.select("pk", "terms").collect(), key=key)


def test_windows_that_are_read_once_are_not_written(spark, monkeypatch):
    from quarry.plans import corpus, registry
    from tests.conftest import SF_SMALL

    written = []
    monkeypatch.setattr(corpus, "write_table", lambda df, path: written.append(path))
    rows = registry.non_empty_windows(spark, SF_SMALL).collect()
    assert not written and rows and all(any(c.isalnum() for c in r.text) and r.n > 0 for r in rows)
