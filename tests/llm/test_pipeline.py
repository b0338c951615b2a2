"""The pipeline stage by stage on the smallest tables."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import pyarrow as pa  # noqa: E402

import corpus_pipeline  # noqa: E402
from skyqa.llm import decontaminate, quality, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], FOLDER).write.parquet(f"{tmp_path}/{i}")
        steps.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(s.columns == columns for s in steps[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    scored = quality.score_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in scored.where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids[2] == {i for i, _, c in brute.groups(rows) if i == c}
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = decontaminate.decontaminate(steps[2], items).where("contaminated").collect()
    assert ids[3] == ids[2] - {r.doc_id for r in found}
    assert ids[4] == ids[3] == ids[5]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in queries.QUERIES and [n for n in queries.SQL if n not in queries.QUERIES] == []


def test_stages_bound_the_bytes_of_a_batch(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    def largest():
        rows = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('some words ', 200) text")
        return max(r.size for r in rows.mapInArrow(sizes, "size long").collect())

    before = spark.conf.get(conf, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(conf)
            stage(spark, docs, FOLDER)
            assert largest() < 1.5 * corpus_pipeline.BATCH_BYTES  # before: all 9,000 texts, 20 MB
        spark.conf.set(conf, "1m")  # the session's own bound is kept
        corpus_pipeline.best_fit_packing(spark, docs, FOLDER)
        assert spark.conf.get(conf) == "1m"
    finally:
        spark.conf.unset(conf)
        if before is not None:
            spark.conf.set(conf, before)
