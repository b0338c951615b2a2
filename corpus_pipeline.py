"""A corpus from raw documents to training sequences, in five stages.

Each stage works on what the one before it wrote. The first four return the columns of ``documents``; the last
returns where every token piece lies. Rows that repeat a ``doc_id`` are judged as documents of their own by the stages that
look at one text, and together by those that keep or drop ids. All stages share the executors, whose memory holds the tasks'
Arrow batches on both sides of each Python worker, so the stages bound the bytes of a batch in their session unless it names a bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyqa.functions.frames import scratch_path
from skyqa.llm import decontaminate, jaccard, packing, quality, secret_scan
from skyqa.llm.tokens import tokenizer_path

#: Score below which a document is rejected.
QUALITY = 0.3

#: Bytes of an Arrow batch that is sent to Python. The operators' arrays of a block of texts are many times as large.
_BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def _bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _bound_batches(spark)
    score = quality.fit_scorer(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("__score", score("text")).where(F.col("__score") >= QUALITY).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest doc_id. Rows without a doc_id stay."""
    _bound_batches(spark)
    groups = jaccard.similar_groups(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.where("doc_id is null")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _bound_batches(spark)
    found = decontaminate.coverage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where(F.col("covered") >= decontaminate.COVERAGE).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and ``n_chars`` counted anew where that happened."""
    _bound_batches(spark)
    found = secret_scan.fit_finder(docs, F.col("source"))(F.col("text"), F.col("source").cast("string"))
    rows = docs.withColumn("__found", found)
    changed = F.col("__found.n_secrets") > 0
    kinds = dict(docs.dtypes)
    rows = rows.withColumn("text", F.when(changed, F.col("__found.clean")).otherwise(F.col("text")))
    if "n_chars" in kinds:
        counted = F.length("text").cast(kinds["n_chars"])
        rows = rows.withColumn("n_chars", F.when(changed, counted).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token piece of the documents lies in the training sequences."""
    _bound_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
