"""Physical-plan checks: native expressions, pruned scans, no single-task
exchange in the bias evaluation."""

from pyspark.sql import functions as F

from biaslens.operators import auc, features as feat
from biaslens.sources.tables import comments, read_table
from paths import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_meta_features_native_and_pruned(spark):
    p = plan(feat.meta_features(comments(spark, SF001)))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_bias_metrics_has_no_single_partition_exchange(spark):
    p = plan(auc.bias_metrics(comments(spark, SF001)))
    # bucket totals and one-row aggregates may meet in one task, rows never
    _only_bucket_totals_meet(p, "bias_metrics")


def test_event_scan_prunes_columns(spark):
    ev = read_table(spark, SF001, "events").select("user_id", "value").where("value > 1")
    p = plan(ev)
    assert "ReadSchema: struct<user_id:bigint,value:double>" in p
    assert "PushedFilters" in p and "GreaterThan(value,1.0)" in p


def _only_bucket_totals_meet(p, what):
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # only the per-bucket totals (<= buckets rows) or a global
            # aggregate (one row per partition) may meet in one task
            below = lines[i + 1]
            assert "HashAggregate(keys=[_bucket" in below or "HashAggregate(keys=[]" in below, (what, below)
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p, what


def test_ordered_operators_have_no_single_task_window(spark):
    """Splits, batches and run-log meters number rows through bucketed
    prefix sums: rows never meet in one task (only bucket totals do), and
    no PythonUDF. Small buckets force the multi-bucket plan of a large input."""
    from biaslens.operators import order, runlog as rl
    docs = read_table(spark, SF001, "documents").select(F.col("doc_id").alias("id"))
    log = read_table(spark, SF001, "events").select("user_id", "ts", "event_id", "value")
    small = 50
    frames = {
        "fixed_batches": order.fixed_batches(docs, "id", 32, rows_per_bucket=small),
        "fixed_batches_seeded": order.fixed_batches(docs, "id", 32, seed=7),
        "split_train_valid": order.split_train_valid(docs, "id", 7, 0.7, 0.05),
        "assign_folds": order.assign_folds(docs, "id", 5, 2106),
        "running_avg": rl.running_average(log.withColumn("n", F.lit(1)), "user_id", ["ts", "event_id"],
                                          "value", "n", rows_per_bucket=small),
        "running_best": rl.running_best(log, "user_id", ["ts", "event_id"], "value", rows_per_bucket=small),
        "retention": rl.retention(log, "user_id", ["ts", "event_id"], 3, rows_per_bucket=small),
        "loss_ema": rl.ema(log, "user_id", ["ts", "event_id"], "value", rows_per_bucket=small),
    }
    for key, df in frames.items():
        _only_bucket_totals_meet(plan(df), key)


def test_registered_queries_bucket_small_inputs_too(spark):
    """No switch by size: the small test tables take the plan of a large input."""
    from biaslens.plans.registry import QUERIES
    for key in ("bias_metrics", "fixed_batches", "running_avg", "running_best", "retention", "loss_ema", "vocab"):
        p = plan(QUERIES[key](spark, SF001))
        assert "_bucket" in p and "CartesianProduct" not in p, key
        _only_bucket_totals_meet(p.split("TakeOrderedAndProject")[0], key)


def test_one_window_chain_and_no_self_join_in_the_bias_plan(spark):
    p = plan(auc.bias_metrics(comments(spark, SF001), rows_per_bucket=20))
    assert p.count("Window [") <= 4 and "PythonUDF" not in p
    assert "SortMergeJoin [score" not in p and "BroadcastHashJoin [score" not in p


def test_scans_and_joins(spark):
    from biaslens.plans.registry import QUERIES
    folds = plan(QUERIES["fold_rows"](spark, SF001))
    assert folds.count("FileScan") <= 2 and folds.count("Join ") <= 3
    losses = plan(QUERIES["weighted_loss"](spark, SF001))
    assert losses.count("FileScan") <= 1 and losses.count("Join ") <= 1
    encoded = plan(QUERIES["encode_head"](spark, SF001))
    # the text was read once, into bundles of ids; no position is exploded or joined alone
    assert encoded.count("FileScan") == 0 and "PythonUDF" not in encoded and "Generate" not in encoded


def test_separable_labels_with_a_penalty(spark):
    import numpy as np
    import pytest

    from biaslens.plans import irls
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    x[:, 0] += np.where(x[:, 0] > 0, 0.5, -0.5)  # a gap between the classes
    y = (x[:, 0] > 0).astype(float)
    rows = [(a.tolist(), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    table = spark.createDataFrame(rows, "features array<double>, y double, fold int")
    models = [irls.Model("all", "y"), irls.Model("without 2", "y", None, 2)]
    heads = irls.fit(table, models, 2, fold="fold", penalty=0.5, radius=3.0)
    for name, use in (("all", np.ones(300, bool)), ("without 2", np.arange(300) % 3 != 2)):
        h = heads[name]
        b = np.array(h.coefficients)
        left = y[use] - 1 / (1 + np.exp(-(x[use] @ b + h.intercept)))
        assert np.isfinite(b).all() and h.n_rows == use.sum()
        assert x[use].T @ left == pytest.approx(0.5 * b, abs=1e-7) and left.sum() == pytest.approx(0, abs=1e-7)
    with pytest.raises(ValueError, match="penalty"):
        irls.fit(table, models, 2, fold="fold", penalty=-1.0)
