"""Ordered operators against sequential brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from biaslens.operators import order, runlog as rl


def simulate_length_batches(rows, bs, width=128):
    """The sequential generator: rows = [(id, zeros)] in sampler order."""
    buckets, out = {}, []
    for i, z in rows:
        b = int(z / width)
        buckets.setdefault(b, []).append(i)
        if len(buckets[b]) == bs:
            out.append(list(buckets[b]))
            buckets[b] = []
    left = [i for b in sorted(buckets) for i in buckets[b]]
    for k in range(0, len(left), bs):
        out.append(left[k:k + bs])
    return {i: n for n, batch in enumerate(out) for i in batch}


def test_length_batches_equal_generator(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 5, 130, 140, 300, 700])) for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, zeros int")
    got = {r["id"]: r["batch"] for r in order.length_batches(df, "id", "zeros", 32).collect()}
    assert got == simulate_length_batches(rows, 32)
    assert len(set(got.values())) == -(-1003 // 32)


def test_split_exact_disjoint_stable(spark):
    df = spark.range(0, 997).withColumnRenamed("id", "id")
    a = order.split_train_valid(df, "id", 11, 0.7, 0.05)
    counts = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"train": int(0.7 * 997), "valid": int(0.05 * 997), "unused": 997 - int(0.7 * 997) - int(0.05 * 997)}
    b = order.split_train_valid(df, "id", 11, 0.7, 0.05)
    assert sorted(a.select("id", "split").collect()) == sorted(b.select("id", "split").collect())
    pos = sorted(r["position"] for r in a.collect())
    assert pos == list(range(1, 998))


def test_positions_multi_bucket(spark):
    df = spark.range(0, 3000)
    pos = order.global_positions(df, "id", None)
    keyed = df.withColumn("_h", F.col("id").cast("long"))
    keyed = order.range_bucket(keyed, ["_h"], rows_per_bucket=100)
    assert keyed.select("_bucket").distinct().count() > 10
    r = order.row_numbers(keyed, [], ["_h", "id"], out="p")
    assert all(x["p"] == x["id"] + 1 for x in r.collect())
    assert all(x["position"] == x["id"] + 1 for x in pos.collect())


def _log(spark, n_users=4, n=3000, seed=5, zeros_first=True):
    rnd = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows = []
    for e in range(n):
        u = 0 if rnd.random() < 0.6 else rnd.randrange(1, n_users)   # one hot run
        v = 0.0 if (zeros_first and e < 5) else round(rnd.random() * 10, 2)
        rows.append((e, t0 + timedelta(seconds=rnd.randrange(10 ** 6)), u, v, rnd.randrange(0, 4)))
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double, k int")


import pytest


@pytest.mark.parametrize("decay,rpb", [(0.98, 200_000), (0.5, 200_000), (0.98, 97)])
def test_ema_equals_recurrence(spark, decay, rpb):
    rows, df = _log(spark)
    got = {r["event_id"]: r["ema"] for r in
           rl.ema(df, "user_id", ["ts", "event_id"], "value", decay, rows_per_bucket=rpb).collect()}
    by_user = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by_user.setdefault(r[2], []).append(r)
    for u, rs in by_user.items():
        lossf = None
        for r in rs:
            x = r[3]
            lossf = decay * lossf + (1 - decay) * x if lossf else x
            assert abs(got[r[0]] - lossf) < 1e-9 * max(1.0, abs(lossf))


@pytest.mark.parametrize("chunk,span", [(10, 1), (7, 1e12), (None, 1e-9)])
def test_ema_carry_is_exact(spark, chunk, span):
    """Many chunks, values over many orders of magnitude, and a null run."""
    rnd = random.Random(8)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), None if i % 4 == 0 else 1,
             rnd.random() * (span if i < 40 else 1.0)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    got = {r["event_id"]: r["ema"] for r in rl.ema(df, "user_id", ["ts", "event_id"], "value", 0.9, chunk).collect()}
    last = {}
    for i, _, u, x in rows:
        last[u] = 0.9 * last[u] + 0.1 * x if last.get(u) else x
        assert got[i] == pytest.approx(last[u], rel=1e-9)


def test_fold_row_counts(spark):
    df = spark.range(103)
    folds = order.assign_folds(df, "id", 5, 1).where("fold <> 3")
    got = sorted(tuple(r) for r in order.fold_row_counts(df, folds, 5).collect())
    sizes = [r["n"] for r in order.assign_folds(df, "id", 5, 1).groupBy("fold").agg(F.count("id").alias("n")).orderBy("fold").collect()]
    assert got == [(k, 103 - (0 if k == 3 else n), 0 if k == 3 else n) for k, n in enumerate(sizes)]


def test_seeded_buckets_follow_the_row_count(spark):
    assert order.bucket_count(10) == order.MIN_BUCKETS
    assert order.bucket_count(10 ** 11) == 500_000
    a = order.global_positions(spark.range(500), "id", 3, rows_per_bucket=7).collect()
    b = order.global_positions(spark.range(500), "id", 3).collect()
    assert sorted(tuple(r) for r in a) == sorted(tuple(r) for r in b)


@pytest.mark.parametrize("rpb", [200_000, 61])
def test_running_meters(spark, rpb):
    """A run with 60% of the rows; rpb=61 splits it over ~50 time buckets."""
    rows, df = _log(spark, zeros_first=False)
    avg = {r["event_id"]: r["running_avg"] for r in
           rl.running_average(df, "user_id", ["ts", "event_id"], "value", "k", rows_per_bucket=rpb).collect()}
    best = {r["event_id"]: (r["improved"], r["best_so_far"]) for r in
            rl.running_best(df, "user_id", ["ts", "event_id"], "value", rows_per_bucket=rpb).collect()}
    kept = {r["event_id"]: r["keep"] for r in
            rl.retention(df, "user_id", ["ts", "event_id"], 3, rows_per_bucket=rpb).collect()}
    by_user = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by_user.setdefault(r[2], []).append(r)
    for rs in by_user.values():
        s = c = 0.0
        b = 0.0
        for r in rs:
            s += r[3] * r[4]
            c += r[4]
            exp = s / c if c else None
            assert (avg[r[0]] is None and exp is None) or abs(avg[r[0]] - exp) < 1e-9
            imp = r[3] > b
            b = max(b, r[3])
            assert best[r[0]] == (imp, b)
        assert [kept[r[0]] for r in rs] == [False] * max(0, len(rs) - 3) + [True] * min(3, len(rs))


def test_null_run_keys_are_kept(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), None if i % 3 == 0 else 1, float(i), 1) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double, k int")
    out = rl.running_average(df, "user_id", ["ts", "event_id"], "value", "k", rows_per_bucket=7).collect()
    assert len(out) == 30
    nulls = sorted((r["event_id"], r["running_avg"]) for r in out if r["user_id"] is None)
    vals = [float(i) for i in range(0, 30, 3)]
    assert [a for _, a in nulls] == [sum(vals[:j + 1]) / (j + 1) for j in range(len(vals))]


def test_hot_timestamp_is_split(spark):
    """One timestamp holds 40% of one run's rows: buckets still split it."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 if i % 5 < 2 else t0 + timedelta(seconds=i), 7, float(i % 11), 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double, k int")
    from biaslens.operators.order import range_bucket
    keyed = range_bucket(df, ["user_id", "ts", "event_id"], rows_per_bucket=100)
    per = {r["_bucket"]: r["count"] for r in keyed.groupBy("_bucket").count().collect()}
    assert len(per) >= 15 and max(per.values()) < 300          # the 800 tied rows span several buckets
    steps = {r["event_id"]: r["step"] for r in rl.number_steps(df, "user_id", ["ts", "event_id"], rows_per_bucket=100).collect()}
    expected = {e: i + 1 for i, (e, *_rest) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert steps == expected
