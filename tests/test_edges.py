"""Edge tables of FIXTURES.md section 5 and brute-force comparisons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from biaslens.config import AUX_COLUMNS, BiasConfig, IDENTITY_COLUMNS
from biaslens.functions import nn, targets as tg
from biaslens.operators import auc, encode as enc, features as feat

SCHEMA = "id long, target double, prediction double, " + ", ".join(f"{g} double" for g in IDENTITY_COLUMNS)


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y]
    neg = [s for y, s in zip(ys, ss) if not y]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({a: F.lit(None).cast("double") for a in AUX_COLUMNS[1:]})


def _row(i, t, p, ids):
    return (i, t, p, *[ids.get(g) for g in IDENTITY_COLUMNS])


def test_single_class_subgroup_gives_null_and_null_final(spark):
    rows = [_row(i, float(i % 2), i / 10, {"male": 1.0} if i < 3 else {}) for i in range(10)]
    rows = [_row(0, 0.0, 0.1, {"male": 1.0}), _row(2, 0.0, 0.3, {"male": 1.0})] + \
           [_row(i, float(i % 2), i / 10, {g: 1.0 for g in IDENTITY_COLUMNS if g != "male"}) for i in range(3, 10)]
    b = auc.bias_metrics(table(spark, rows))
    male = b.where("subgroup = 'male'").collect()[0]
    assert male["subgroup_auc"] is None
    fm = auc.final_metric(b).collect()[0]
    assert fm["final_metric"] is None


def test_inverted_scores_power_mean_zero(spark):
    rows = [_row(i, float(i % 2), 1.0 - (i % 2) * 0.9 - i / 1000, {g: 1.0 for g in IDENTITY_COLUMNS})
            for i in range(20)]
    fm = auc.final_metric(auc.bias_metrics(table(spark, rows))).collect()[0]
    assert fm["power_mean_subgroup_auc"] == 0.0


def test_ties_only_half(spark):
    rows = [_row(i, float(i % 2), 0.5, {}) for i in range(10)]
    r = auc.auc(table(spark, rows), "target", "prediction").collect()[0]
    assert r["auc"] == 0.5


def test_identity_null_nan_threshold(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.49,), (0.5,)], "x double")
    got = [r[0] for r in df.select(tg.to_bool("x")).collect()]
    assert got == [False, False, False, True]


def test_weights_rules(spark):
    all_ge = _row(1, 0.9, 0.5, {g: 0.6 for g in IDENTITY_COLUMNS})
    null_t = _row(2, None, 0.5, {"male": 0.7})
    null_t2 = _row(3, None, 0.5, {})
    t = {r["id"]: r["weight"] for r in feat.targets(table(spark, [all_ge, null_t, null_t2])).collect()}
    assert t[1] == 0.5     # all nine >= 0.5 and toxic: no background term
    assert t[2] == 0.5     # subgroup only
    assert t[3] == 0.25
    strict = BiasConfig(strict_background=True)
    t2 = {r["id"]: r["weight"] for r in feat.targets(table(spark, [_row(4, 0.9, 0.5, {"male": 0.7})]), strict).collect()}
    assert t2[4] == 0.5
    assert {r["weight"] for r in feat.targets(table(spark, [_row(5, 0.9, 0.5, {"male": 0.7})])).collect()} == {0.75}


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(i, 3.0, float(i)) for i in range(5)], "id long, a double, b double")
    st = feat.scale_fit(df, ["a", "b"])
    out = feat.scale_apply(df, st, ["a", "b"], dtype="double").collect()
    assert all(r["a"] == 0.0 for r in out)
    b = sorted(r["b"] for r in out)
    assert b[0] == pytest.approx(-2 / math.sqrt(2))   # population std of 0..4 is sqrt(2)


@pytest.mark.parametrize("n", [0, 1, 217, 218, 219, 654])
def test_encode_lengths(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "id long, comment_text string")
    vocab = enc.build_vocab(df.select(enc.tokenize("comment_text").alias("tokens")), size=100)
    m = 218
    for mode, length in (("head", 220), ("head_tail", 220), ("plain", 218)):
        r = enc.encode(df, vocab, max_len=220, mode=mode).collect()[0]
        assert len(r["token_ids"]) == length
        real = [x for x in r["token_ids"] if x != 0]
        assert len(real) == min(n, m) + (0 if mode == "plain" else 2)
        if mode == "head_tail":
            assert r["pad_mask"] == [0] * min(n, m) + [1] * (m - min(n, m))
    if n > m:
        toks = enc.tokenize("comment_text")
        ht = df.select(enc.keep_head_tail(toks, m).alias("k")).collect()[0]["k"]
        words = text.split()
        assert ht == words[: m // 3] + words[len(words) - (m - m // 3):]


def test_csv_round_trip_edge_cases(spark, tmp_path):
    from biaslens.sources import io
    p = tmp_path / "c.csv"
    p.write_text('id,comment_text,target\n1,"say ""hi""",0.5\n2,"two\nlines",NA\n3,NA,0.1\n'
                 '4,null,0.2\n5,nan,0.3\n6,,0.4\n7,"   ",0.6\n')
    sch = io.comment_schema(("id", "comment_text", "target"))
    got = {r["id"]: (r["comment_text"], r["target"]) for r in io.read_comments_csv(spark, str(p), sch).collect()}
    assert got[1] == ('say "hi"', 0.5)
    assert got[2] == ("two\nlines", None)
    assert got[3][0] is None and got[4][0] is None and got[5][0] is None and got[6][0] is None
    assert got[7][0] == "   "


def test_stable_loss_extreme_logits(spark):
    df = spark.createDataFrame([(800.0, 0.0), (-800.0, 1.0), (800.0, 0.3), (0.0, 1.0)], "x double, y double")
    vals = [r[0] for r in df.select(nn.bce_with_logits("x", "y")).collect()]
    assert all(math.isfinite(v) for v in vals)
    assert vals[0] == pytest.approx(800.0) and vals[1] == pytest.approx(800.0)
    assert vals[3] == pytest.approx(math.log(2))


def test_auc_matches_pairwise_brute_force_and_properties(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        ids = {g: (rnd.choice([None, 0.0, 0.3, 0.7, 1.0])) for g in IDENTITY_COLUMNS}
        s = round(rnd.random(), 2)      # many ties
        rows.append(_row(i, float(rnd.random() < 0.3 + s / 2), s, ids))
    df = table(spark, rows)
    b = {r["subgroup"]: r for r in auc.bias_metrics(df, rows_per_bucket=25).collect()}
    ys = [r[1] >= 0.5 for r in rows]
    ss = [r[2] for r in rows]
    assert b["__all__"]["subgroup_auc"] == pytest.approx(brute_auc(ys, ss), abs=1e-12)
    for k, g in enumerate(IDENTITY_COLUMNS):
        f = [(r[3 + k] or 0) >= 0.5 for r in rows]
        sub = brute_auc([y for y, x in zip(ys, f) if x], [s for s, x in zip(ss, f) if x])
        bp = [(y, s) for y, s, x in zip(ys, ss, f) if (x and not y) or (not x and y)]
        bn = [(y, s) for y, s, x in zip(ys, ss, f) if (x and y) or (not x and not y)]
        assert b[g]["subgroup_auc"] == pytest.approx(sub, abs=1e-12)
        assert b[g]["bpsn_auc"] == pytest.approx(brute_auc(*zip(*bp)), abs=1e-12)
        assert b[g]["bnsp_auc"] == pytest.approx(brute_auc(*zip(*bn)), abs=1e-12)
    # monotone transform of the score leaves every AUC unchanged
    b2 = {r["subgroup"]: r["subgroup_auc"] for r in
          auc.bias_metrics(df.withColumn("prediction", F.col("prediction") * 3 - 1)).collect()}
    assert all(b2[k] == pytest.approx(v["subgroup_auc"], abs=1e-12) for k, v in b.items() if v["subgroup_auc"])
    # swapping labels gives 1 - AUC
    flipped = df.withColumn("target", 1 - F.col("target"))
    o = auc.auc(flipped, "target", "prediction").collect()[0][0]
    assert o == pytest.approx(1 - b["__all__"]["subgroup_auc"], abs=1e-12)


def test_independent_of_shuffle_partitions(spark):
    from biaslens.sources.tables import comments
    from paths import SF001
    c = comments(spark, SF001)
    a = sorted(auc.bias_metrics(c).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(auc.bias_metrics(c).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_whole_vocabulary_and_shuffle_join(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, "c zz"), (3, "")], "id long, comment_text string")
    toks = df.select("id", enc.tokenize("comment_text").alias("tokens"))
    assert {r.token: r.token_id for r in enc.build_vocab(toks).collect()} == {"a": 4, "c": 5, "b": 6, "zz": 7}
    vocab = enc.build_vocab(toks, size=2)
    a = sorted(enc.encode_tokens(toks, vocab, max_len=8).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = sorted(enc.encode_tokens(toks, vocab, max_len=8).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert a == b
    assert a[0]["token_ids"] == [2, 4, 1, 5, 4, 3, 0, 0]   # a -> 4, c -> 5, b unknown


def test_csv_columns_by_name_and_bad_cells(spark, tmp_path):
    from biaslens.sources import io
    sch = io.comment_schema(("id", "comment_text", "target"))
    good = tmp_path / "good.csv"
    good.write_text("x,target,comment_text,id\n9,0.5,hi,1\n8,NA,there,2\n")
    rows = sorted(tuple(r) for r in io.read_comments_csv(spark, str(good), sch).collect())
    assert rows == [(1, "hi", 0.5), (2, "there", None)]
    with pytest.raises(ValueError, match="no column severe_toxicity"):
        io.read_comments_csv(spark, str(good), io.comment_schema(("id", "severe_toxicity")))
    bad = tmp_path / "bad.csv"
    bad.write_text("id,target,comment_text\nx3,abc,t\n4,0.1,u\n")
    with pytest.raises(Exception):
        io.read_comments_csv(spark, str(bad), sch).collect()
    assert sorted((tuple(r) for r in io.read_comments_csv(spark, str(bad), sch, strict=False).collect()), key=repr) == [
        (4, "u", 0.1), (None, "t", None)]
    assert io.bad_cells(spark, str(bad), sch).first().asDict() == {"id": 1, "target": 1}
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("id,target,comment_text\n1,0.1,a,b\n")
    with pytest.raises(Exception):
        io.read_comments_csv(spark, str(ragged), sch).collect()


def test_null_scores_leave_their_sets_without_auc(spark):
    ids = {g: None for g in IDENTITY_COLUMNS}
    rows = [_row(i, float(i % 2), i / 20, {**ids, "male": 1.0 if i < 8 else None, "female": 1.0 if i >= 8 else None})
            for i in range(20)]
    df = table(spark, rows).withColumn("prediction", F.when(F.col("id") != 3, F.col("prediction")))
    b = {r["subgroup"]: r for r in auc.bias_metrics(df).collect()}
    assert b["male"]["subgroup_size"] == 8 and b["__all__"]["subgroup_size"] == 20
    assert b["male"]["subgroup_auc"] is None and b["__all__"]["subgroup_auc"] is None
    # row 3 is a positive of "male": in no set of "female" but its BPSN background
    assert b["female"]["subgroup_auc"] is not None and b["female"]["bpsn_auc"] is None
    assert b["female"]["bnsp_auc"] is not None and b["male"]["bpsn_auc"] is not None


def test_empty_subgroup_with_by_equals_without(spark):
    rows = [_row(i, float(i % 3 == 0), i / 30, {**{g: float(i % 2) for g in IDENTITY_COLUMNS}, "male": float(i % 2) if i >= 15 else None})
            for i in range(30)]
    df = table(spark, rows).withColumn("epoch", (F.col("id") >= 15).cast("int"))
    together = auc.bias_metrics(df, by=["epoch"])
    for e in (0, 1):
        apart = sorted((tuple(r) for r in auc.bias_metrics(df.where(F.col("epoch") == e)).collect()), key=repr)
        assert sorted((tuple(r)[1:] for r in together.where(F.col("epoch") == e).collect()), key=repr) == apart
    final = {r.epoch: r.final_metric for r in auc.final_metric(together, by=["epoch"]).collect()}
    assert final[0] is None and final[1] is not None


def test_alignment_fails_on_lone_ids(spark):
    from biaslens.operators import features as feat
    a = spark.createDataFrame([(1, "x"), (None, "n")], "id long, l string")
    b = spark.createDataFrame([(1, "y"), (None, "m")], "id long, r string")
    assert sorted((tuple(r) for r in feat.aligned(a, b, "id").collect()), key=repr) == [(1, "x", "y"), (None, "n", "m")]
    for other in ([(1, "y")], [(1, "y"), (None, "m"), (2, "z")]):
        with pytest.raises(Exception, match="without a partner"):
            feat.aligned(a, spark.createDataFrame(other, "id long, r string"), "id").collect()


def test_given_criterion_replaces_the_loss(spark):
    from biaslens.operators import loss
    df = spark.createDataFrame([(0, [0.5, 1.0], 1.0, 2.0, [0.25])], "batch int, logits array<double>, y double, weight double, "
                               "aux_targets array<double>")
    def squares(ob, tb, w, oa, ta):
        return w * (ob - tb) * (ob - tb), F.aggregate(F.zip_with(oa, ta, lambda x, t: (x - t) * (x - t)), F.lit(0.0), lambda s, x: s + x)
    r = loss.batch_losses(df, criterion=squares).first()
    x0, x1 = r["bin_loss"], r["aux_loss"]
    assert r["loss"] == pytest.approx(0.5 * x0 + 0.5 * x1) and x1 >= 0 and x0 >= 0


def test_merged_counts_equal_one_count(spark):
    """Null scores, scores met again, an addition without rows; columns must agree."""
    rng = random.Random(6)
    groups = IDENTITY_COLUMNS[:2]
    rows = [(i % 2, rng.choice([0.0, 1.0]), rng.choice([None, 0.1, 0.2, 0.3, 0.4] if i % 2 else [0.1, 0.5]),
             rng.choice([None, 0.0, 1.0]), rng.choice([0.0, 1.0])) for i in range(300)]
    schema = "run int, target double, prediction double, " + ", ".join(f"{g} double" for g in groups)

    def counts(part):
        return auc.score_counts(spark.createDataFrame(part, schema), "target", "prediction", groups, by=["run"])

    merged = auc.merged_counts(counts(rows[:90]), counts(rows[90:200]), counts([]), counts(rows[200:]), by=["run"])
    cfg = BiasConfig(identity_columns=groups)
    whole = auc.bias_metrics(spark.createDataFrame(rows, schema), cfg, label="target", score="prediction", by=["run"])
    got = auc.bias_from_counts(merged, groups, by=["run"])
    assert got.collect() == whole.collect() and whole.count() == 6
    with pytest.raises(ValueError, match="differ"):
        auc.merged_counts(counts(rows), auc.score_counts(spark.createDataFrame(rows, schema), "target", "prediction", groups[:1], by=["run"]))
