"""The corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows the stage
before kept; its result is written as Parquet and reread. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontamination, ngram_join, packing, quality_classifier, secret_scan
from quarry.llm.queries import vocabulary
from quarry.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty
    texts have the score of the training share; repeated rows are judged each;
    an empty table stays one."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = common.fresh(docs, "quality")
    return quality_classifier.score(docs, model, out=name).where(F.col(name) >= 0.5).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of each row's place in its Parquet file, and that
    column's name; what is not a plain scan of files is written first."""
    name = common.fresh(docs, "_row")
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)
    try:
        return docs.select("*", place), name
    except AnalysisException:
        return common.written(docs, "numbered-rows").select("*", place), name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity
    of 0.8 or more), the one of smallest id (no id comes last). Rows are told
    apart by their place, so null or repeated ids take no other row along; rows
    without a word are in no group and stay."""
    rows, row = numbered(docs)
    found = ngram_join.near_duplicates(rows.select(row, "text"), key=row).select(F.col(row).alias("row"), "component_id")
    found = common.written(found, "near-groups")
    ids = found.join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    best = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"))
    others = common.written(found.select("row").join(best.select("best.row"), "row", "left_anti").withColumnRenamed("row", row), "near-others")
    return rows.join(others, row, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows are judged by their
    text, so null and repeated ids take no other row along, and null texts stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every found secret replaced by a mark and ``n_chars``
    counted anew where the text changed; null and empty texts stay as they are."""
    before = common.fresh(docs, "_before")
    clean = secret_scan.redact(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, one row per piece; a null text is an
    empty one, which is its end id alone."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: The trained classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = common.documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        path = scratch_path(spark, f"pipeline-{number}")
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
