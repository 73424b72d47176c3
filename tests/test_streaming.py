"""Streaming ingestion gives the same chunk rows as the batch functions."""

import os
import tempfile

from quarry.streaming.ingest import chunk_stream, start_ingest
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    work = tempfile.mkdtemp(prefix="quarry-stream-")
    src = os.path.join(work, "pages_in")
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    pages.repartition(3).write.parquet(src)
    q = start_ingest(
        spark,
        src,
        os.path.join(work, "out"),
        os.path.join(work, "ckpt"),
        tag="article",
        anchor_policy="page",
    )
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(work, "out"))
    batch = chunk_stream(pages, tag="article", anchor_policy="page")
    cols = ["pk", "text", "source"]
    assert sorted(map(tuple, streamed.select(*cols).collect())) == sorted(
        map(tuple, batch.select(*cols).collect())
    )
    assert streamed.count() > 0
