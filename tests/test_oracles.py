"""Every registered query with a DuckDB oracle agrees with it at sf0.001;
the rest at least run."""

import pytest

from paths import SF001
from oracle_check import compare

SLOW = {"train_aux", "oof_union", "submission_folds", "oof_aux"}


def test_all_oracles_sf0001(spark):
    import __spark_entry__ as e
    keys = [k for k in sorted(e.queries()) if k not in SLOW and k not in e.LLM_QUERIES]
    res = compare(spark, SF001, keys, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] in ("FAIL", "ERROR")}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert df.columns == ["subgroup", "subgroup_size", "subgroup_auc", "bpsn_auc", "bnsp_auc"]
