"""Golden values of FIXTURES.md section 4 (pure-Python brute force)."""

import pytest
from pyspark.sql import functions as F

from biaslens.operators import auc, features as feat
from biaslens.sources.tables import comments
from paths import SF001, SF01

GOLD = {
    SF001: dict(rows=200, pos=50, hist={0.25: 47, 0.5: 22, 0.75: 131}, lw=1.6528925619834711,
                overall=0.8289333333333334, bias=0.8134374826293042, final=0.8173114453053115,
                zero_words=2, smilies=197, symbols=4224),
    SF01: dict(rows=1000, pos=253, hist={0.25: 269, 0.5: 94, 0.75: 637}, lw=1.6891891891891893,
               overall=0.8523395293955797, bias=0.8349753117130306, final=0.8393163661336679,
               zero_words=11, smilies=980, symbols=36508),
}

SUBGROUPS_SF01 = {
    "black": (109, 0.7288961038961038, 0.8274147727272727, 0.7780186429655321),
    "white": (100, 0.7405753968253967, 0.8494444444444444, 0.7687830687830688),
    "homosexual_gay_or_lesbian": (101, 0.8329256360078278, 0.8436225266362253, 0.8466246290801187),
    "female": (100, 0.844, 0.8608479532163742, 0.8407738095238095),
    "male": (103, 0.8504193849021435, 0.8528293918918919, 0.8518983450325357),
    "muslim": (102, 0.8672542735042734, 0.8710670697570262, 0.8471910812157449),
    "psychiatric_or_mental_illness": (101, 0.8708414872798435, 0.8399086757990868, 0.8805373039423485),
    "jewish": (100, 0.871031746031746, 0.8576234567901235, 0.8663227513227513),
    "christian": (99, 0.8876811594202898, 0.8566972119321505, 0.8806784660766962),
}


@pytest.mark.parametrize("root", [SF001, SF01])
def test_final_metric_golden(spark, root):
    g = GOLD[root]
    c = comments(spark, root)
    row = auc.final_metric(auc.bias_metrics(c)).collect()[0]
    assert row["overall_auc"] == pytest.approx(g["overall"], abs=1e-12)
    assert row["bias_score"] == pytest.approx(g["bias"], abs=1e-12)
    assert row["final_metric"] == pytest.approx(g["final"], abs=1e-12)


def test_subgroups_golden(spark):
    rows = auc.bias_metrics(comments(spark, SF01)).collect()
    got = {r["subgroup"]: r for r in rows}
    for name, (n, sub, bpsn, bnsp) in SUBGROUPS_SF01.items():
        r = got[name]
        assert r["subgroup_size"] == n
        assert r["subgroup_auc"] == pytest.approx(sub, abs=1e-12)
        assert r["bpsn_auc"] == pytest.approx(bpsn, abs=1e-12)
        assert r["bnsp_auc"] == pytest.approx(bnsp, abs=1e-12)
    # sorted by subgroup AUC, nulls last
    aucs = [r["subgroup_auc"] for r in rows]
    assert aucs == sorted(aucs)


@pytest.mark.parametrize("root", [SF001, SF01])
def test_weights_and_features_golden(spark, root):
    g = GOLD[root]
    c = comments(spark, root)
    t = feat.targets(c)
    assert t.count() == g["rows"]
    assert t.agg(F.sum("y")).collect()[0][0] == g["pos"]
    hist = {r["weight"]: r["count"] for r in t.groupBy("weight").count().collect()}
    assert hist == g["hist"]
    assert feat.loss_weight(t).collect()[0][0] == pytest.approx(g["lw"], rel=1e-15)
    mf = feat.meta_features(c)
    agg = mf.agg(F.count_if(F.col("num_words") == 0), F.sum("num_smilies"), F.sum("num_symbols")).collect()[0]
    assert tuple(agg) == (g["zero_words"], g["smilies"], g["symbols"])
