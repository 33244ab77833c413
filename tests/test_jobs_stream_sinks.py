"""Job verbs end to end, sinks with partition pruning, stream == batch."""

import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from biaslens.config import DEFAULT
from biaslens.operators import features as feat
from biaslens.plans import jobs
from biaslens.sources import io
from biaslens.sources.tables import comments
from biaslens.streaming import features as sf
from paths import SF001


def test_job_verbs(spark, tmp_path):
    src = str(tmp_path / "comments")
    comments(spark, SF001).write.parquet(src)
    out = str(tmp_path / "out")
    jobs.meta_features_job(spark, src, out)
    jobs.train_target_job(spark, src, out)
    jobs.extract_data_job(spark, src, out, mode="head_tail", max_len=64, vocab_size=500)
    mf = spark.read.parquet(os.path.join(out, "meta_features"))
    assert mf.count() == 200 and set(mf.columns) >= {"id", "total_length"}
    seq = spark.read.parquet(os.path.join(out, "sequences"))
    assert {len(r["token_ids"]) for r in seq.collect()} == {64}
    # test data: the saved scaler is applied, not refitted
    jobs.meta_features_job(spark, src, str(tmp_path / "test_out"), scaler=os.path.join(out, "scaler"))
    a = sorted(spark.read.parquet(str(tmp_path / "test_out" / "meta_features")).collect())
    assert a == sorted(mf.collect())
    with pytest.raises(Exception):  # a named scaler or vocabulary must be there
        jobs.meta_features_job(spark, src, str(tmp_path / "x"), scaler=str(tmp_path / "none"))
    with pytest.raises(Exception):
        jobs.extract_data_job(spark, src, str(tmp_path / "x"), vocab=str(tmp_path / "none"))

    features, targets = f"{out}/meta_features", f"{out}/targets"
    cfg = dataclasses.replace(DEFAULT, seed=5, train_percent=0.6, valid_percent=0.3)
    jobs.train_job(spark, features, targets, out, labels=src, run="a", cfg=cfg)
    run = f"{out}/run=a"
    assert spark.read.parquet(f"{run}/valid_predictions").count() == 60
    assert {r["head"] for r in spark.read.parquet(f"{run}/coefficients").collect()} == {"binary", *DEFAULT.aux_columns}
    assert spark.read.option("header", True).csv(f"{run}/bias_metrics").count() == 10
    assert spark.read.option("header", True).csv(f"{run}/validation").count() == 60
    judged = str(tmp_path / "judged")
    spark.read.parquet(src).join(spark.read.parquet(f"{run}/valid_predictions").select("id"), "id", "left_semi").write.parquet(judged)
    bias, final = jobs.evaluate_job(spark, f"{run}/valid_predictions", judged)
    assert bias.count() == 10 and final.count() == 1
    with pytest.raises(Exception, match="partner"):
        jobs.evaluate_job(spark, f"{run}/valid_predictions", src)[1].collect()

    jobs.kfold_job(spark, features, targets, out, n_folds=3)
    jobs.predict_oof_job(spark, features, targets, f"{out}/folds", f"{out}/heads", out)
    oof = spark.read.parquet(f"{out}/oof")
    assert oof.count() == 200 and {r["fold"] for r in oof.select("fold").distinct().collect()} == {0, 1, 2}
    assert {len(r["aux_logits"]) for r in oof.collect()} == {len(DEFAULT.aux_columns)}
    given = str(tmp_path / "given")
    spark.read.parquet(f"{out}/folds").withColumn("fold", F.col("fold") % 2).write.parquet(given)
    jobs.kfold_job(spark, features, targets, str(tmp_path / "k2"), folds=given)
    assert {r["fold"] for r in spark.read.parquet(str(tmp_path / "k2" / "heads")).collect()} == {0, 1}
    jobs.submission_job(spark, features, f"{out}/heads", str(tmp_path / "sub"), "k")
    assert spark.read.option("header", True).csv(str(tmp_path / "sub" / "run=k")).groupBy("fold").count().count() == 3
    jobs.submission_job(spark, features, f"{run}/coefficients", str(tmp_path / "sub"), "one")
    assert spark.read.option("header", True).csv(str(tmp_path / "sub" / "run=one")).count() == 200


def test_partitioned_sink_prunes(spark, tmp_path):
    df = spark.range(0, 100).select("id", (F.col("id") % 5).cast("int").alias("fold"))
    path = str(tmp_path / "oof")
    io.write_artefact(df, path, partition_by="fold")
    back = spark.read.parquet(path).where("fold = 3")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "fold" in plan
    assert back.count() == 20


def test_stream_equals_batch(spark):
    q, out = sf.stream_meta_features(spark, SF001)
    q.awaitTermination()
    streamed = sorted(spark.read.parquet(out).collect())
    batch = sorted(feat.meta_features(comments(spark, SF001)).collect())
    assert streamed == batch


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    rows = [(i, f"Word {i} :) !") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    q, out = sf.stream_meta_features(spark, str(tmp_path))
    q.awaitTermination()
    batch = sorted(feat.meta_features(comments(spark, str(tmp_path))).collect())
    assert sorted(spark.read.parquet(out).collect()) == batch and len(batch) == 40
