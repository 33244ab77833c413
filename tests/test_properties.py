"""Property tests: AUC against pairwise brute force on random tables, and fits
against a NumPy Newton iteration."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from biaslens.config import DEFAULT
from biaslens.operators import auc
from biaslens.plans import irls, train
from biaslens.sources.tables import comments
from paths import SF001


def brute(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y]
    neg = [s for y, s in zip(ys, ss) if not y]
    if not pos or not neg:
        return None
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))


rows_st = st.lists(st.tuples(st.booleans(), st.integers(0, 20), st.booleans()), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st, rpb=st.sampled_from([1, 3, 1000]))
def test_auc_brute_force(spark, rows, rpb):
    data = [(i, float(y), s / 20.0, 1.0 if g else None) for i, (y, s, g) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, target double, prediction double, male double")
    res = {r["subgroup"]: r for r in auc.bias_metrics(df, subgroups=["male"], rows_per_bucket=rpb).collect()}
    ys = [y for y, _, _ in rows]
    ss = [s for _, s, _ in rows]
    gs = [g for _, _, g in rows]
    exp_all = brute(ys, ss)
    got_all = res["__all__"]["subgroup_auc"]
    assert (got_all is None and exp_all is None) or got_all == pytest.approx(exp_all, abs=1e-12)
    sub = brute([y for y, g in zip(ys, gs) if g], [s for s, g in zip(ss, gs) if g])
    got = res["male"]["subgroup_auc"]
    assert (got is None and sub is None) or got == pytest.approx(sub, abs=1e-12)
    bp = [(y, s) for y, s, g in zip(ys, ss, gs) if (g and not y) or (not g and y)]
    exp_bp = brute(*zip(*bp)) if bp else None
    got_bp = res["male"]["bpsn_auc"]
    assert (got_bp is None and exp_bp is None) or got_bp == pytest.approx(exp_bp, abs=1e-12)


def newton(x, y, w):
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.lstsq((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)), rcond=1e-13)[0]
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b


def test_fits_equal_newton_on_the_real_features(spark):
    """The binary head, an aux head and every fold model, to 1e-6."""
    from biaslens.operators import order
    c = comments(spark, SF001)
    table = train.fold_table(c, order.assign_folds(c.select("id"), "id", 3, 7)).cache()
    rows = table.collect()
    x, y = np.array([r.features for r in rows]), np.array([float(r.y) for r in rows])
    w, fold = np.array([r.weight for r in rows]), np.array([r.fold for r in rows])
    near = lambda head, want: np.abs(np.array([*head.coefficients, head.intercept]) - want).max() < 1e-6 * (1 + np.abs(want).max())
    assert near(train.fit_binary(table), newton(x, y, w))
    aux = np.array([r.aux_obscene for r in rows])
    assert near(train.fit_aux(table)["obscene"], newton(x, aux, np.ones(len(y))))
    for k, head in train.fit_binary_folds(table, 3).items():
        use = fold != k
        assert near(head, newton(x[use], y[use], w[use]))
    logits = {r.id: r.aux_logits for r in train.out_of_fold_aux(table, 3).collect()}
    at = DEFAULT.aux_columns.index("obscene")
    for k in range(3):
        b = newton(x[fold != k], aux[fold != k], np.ones((fold != k).sum()))
        for r in [r for r in rows if r.fold == k][:20]:
            assert logits[r.id][at] == pytest.approx(np.dot(r.features, b[:-1]) + b[-1], abs=1e-5)


def test_null_labels_are_left_out_and_counted(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1), rnd.gauss(0, 1)], rnd.choice([None, float("nan"), 0.2, 0.9, 0.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, features array<double>, p double")
    head = irls.fit(df, [irls.Model("p", "p")], 2)["p"]
    use = [(f, p) for _, f, p in rows if p is not None and p == p]
    want = newton(np.array([f for f, _ in use]), np.array([p for _, p in use]), np.ones(len(use)))
    assert head.n_rows == len(use) and [*head.coefficients, head.intercept] == pytest.approx(want, abs=1e-8)


def test_a_fit_without_an_optimum_raises(spark):
    df = spark.createDataFrame([(i, [float(i)], float(i > 5)) for i in range(12)], "id long, features array<double>, y double")
    with pytest.raises(irls.NotConverged):
        irls.fit(df, [irls.Model("y", "y")], 1, max_iter=12)
    with pytest.raises(irls.NotConverged, match="no rows"):
        irls.fit(df.where("id < 0"), [irls.Model("y", "y")], 1)
