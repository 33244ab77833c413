"""ROC AUC, subgroup / BPSN / BNSP AUCs and the final bias metric in one pass.

For every subgroup g the three AUCs only need, at each distinct score s: g's
positive / negative counts at s and below s, and the same counts over all
rows. So:

1. one ``groupBy(score)`` counts positives and negatives of all rows and of
   every subgroup as columns (map-side combine collapses hot scores);
2. one chain of bucketed prefix sums (``order.prefix_sums``) gives all counts
   below s without a single-task window;
3. one aggregate sums the Mann-Whitney numerators of all AUCs from those rows,
   with no explode and no self-join.

Ties count one half, as in the rank formulation of ROC AUC. A single-class
set gives null (not 0), and so does a set that holds a null score; sizes count
all members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, OVERALL, BiasConfig
from ..functions.targets import to_bool
from ..session import cut_lineage
from .features import aligned
from .order import DEFAULT_ROWS_PER_BUCKET, prefix_sums, range_bucket


def score_counts(df: DataFrame, label: str, score: str, subgroups, threshold: float = 0.5,
                 by=()) -> DataFrame:
    """(by..., score, p, n, p0, n0, p1, n1, ...): positives and negatives per
    distinct score (null too), over all rows and of each subgroup in turn."""
    flags = [to_bool(g, threshold) for g in subgroups]
    slim = df.select(*by, F.col(score).cast("double").alias("score"), to_bool(label, threshold).alias("_y"),
                     *[f.alias(f"_f{i}") for i, f in enumerate(flags)])
    y = F.col("_y")
    counts = [F.count_if(y).alias("p"), F.count_if(~y).alias("n")]
    for i in range(len(flags)):
        counts += [F.count_if(y & F.col(f"_f{i}")).alias(f"p{i}"), F.count_if(~y & F.col(f"_f{i}")).alias(f"n{i}")]
    return slim.groupBy(*by, "score").agg(*counts)


def bias_metrics(df: DataFrame, cfg: BiasConfig = DEFAULT, label: str | None = None,
                 score: str | None = None, subgroups=None,
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, by=()) -> DataFrame:
    """Per-subgroup table (subgroup, subgroup_size, subgroup_auc, bpsn_auc,
    bnsp_auc) plus one ``__all__`` row whose ``subgroup_auc`` is the overall
    AUC. Identity and label columns may be fractions (binarised at the
    threshold) or booleans. ``by`` columns (run, epoch, fold...) evaluate
    many prediction sets in the same pass, one table per ``by`` value; each
    table has a row for every subgroup, members or not (size 0, null AUCs)."""
    label = label or cfg.toxicity_column
    score = score or cfg.score_column
    subgroups = list(subgroups if subgroups is not None else cfg.identity_columns)
    # The counts feed the sizing, the totals and the window: written once.
    counts = cut_lineage(score_counts(df, label, score, subgroups, cfg.threshold, by))
    return bias_from_counts(counts, subgroups, rows_per_bucket, by)


def merged_counts(*tables: DataFrame, by=()) -> DataFrame:
    """``score_counts`` tables of disjoint sets of predictions as one: equal
    (by..., score) rows are added, null scores too. So the metrics of a run grow
    by its new predictions alone, whose rows are read once.

    The tables need the same subgroups in the same order; a table without rows
    adds nothing. Predictions counted twice count twice."""
    first, *rest = tables
    for t in rest:
        if t.columns != first.columns:
            raise ValueError(f"count tables differ in columns: {first.columns} and {t.columns}")
        first = first.union(t)
    keys = [*by, "score"]
    return first.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in first.columns if c not in keys])


def bias_from_counts(counts: DataFrame, subgroups, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, by=()) -> DataFrame:
    """The table of ``bias_metrics`` from its ``score_counts`` over
    ``subgroups``. ``counts`` is read several times: hand over a written table."""
    by = list(by)
    names = ["", *map(str, range(len(subgroups)))]
    columns = [f"{c}{i}" for i in names for c in "pn"]
    real = counts.where(F.col("score").isNotNull())
    sums = prefix_sums(range_bucket(real, [*by, "score"], rows_per_bucket), by, ["score"], columns)
    d = {c: F.col(c).cast("double") for c in columns}
    below = {c: F.col(f"{c}_before") for c in columns}
    terms = [F.sum(d["p"] * (below["n"] + d["n"] / 2)).alias("num")]
    for i in names[1:]:
        p, n = d[f"p{i}"], d[f"n{i}"]
        # background positives (all - g) above s, plus ties, per subgroup negative
        above = ((F.col("p_total") - below["p"] - F.col("p"))
                 - (F.col(f"p{i}_total") - below[f"p{i}"] - F.col(f"p{i}")))
        terms += [F.sum(p * (below[f"n{i}"] + n / 2)).alias(f"sub{i}"),
                  F.sum(n * (above + (d["p"] - p) / 2)).alias(f"bpsn{i}"),
                  F.sum(p * (below["n"] - below[f"n{i}"] + (d["n"] - n) / 2)).alias(f"bnsp{i}")]
    scored = sums.groupBy(*by).agg(*terms, *[F.sum(c).alias(f"{c}_real") for c in columns])
    missing = counts.where(F.col("score").isNull()).groupBy(*by).agg(*[F.sum(c).alias(f"{c}_null") for c in columns])
    both = scored.unionByName(missing, allowMissingColumns=True)
    wide = both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in both.columns if c not in by])
    t = {f"{c}_{k}": F.coalesce(f"{c}_{k}", F.lit(0)).cast("double") for c in columns for k in ("real", "null")}
    t |= {f"{c}_all": t[f"{c}_real"] + t[f"{c}_null"] for c in columns}

    def auc_of(numerator, pos, neg, missing):
        return F.when((pos * neg > 0) & (missing == 0), F.col(numerator) / (pos * neg))

    def row(name, size, sub, bpsn=None, bnsp=None):
        none = F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("subgroup"), size.cast("long").alias("subgroup_size"), sub.alias("subgroup_auc"),
                        (none if bpsn is None else bpsn).alias("bpsn_auc"), (none if bnsp is None else bnsp).alias("bnsp_auc"))

    table = [row(OVERALL, t["p_all"] + t["n_all"],
                 auc_of("num", t["p_all"], t["n_all"], t["p_null"] + t["n_null"]))]
    for i, g in zip(names[1:], subgroups):
        p, n, p0, n0 = t[f"p{i}_all"], t[f"n{i}_all"], t[f"p{i}_null"], t[f"n{i}_null"]
        table.append(row(g, p + n, auc_of(f"sub{i}", p, n, p0 + n0),
                         auc_of(f"bpsn{i}", t["p_all"] - p, n, n0 + t["p_null"] - p0),
                         auc_of(f"bnsp{i}", p, t["n_all"] - n, p0 + t["n_null"] - n0)))
    return wide.select(*by, F.inline(F.array(*table))).orderBy(*by, F.asc_nulls_last("subgroup_auc"), "subgroup")


def power_mean_col(c, p: float):
    """``avg(x^p)^(1/p)``; null when any input is null (one NaN poisons the mean)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)),
                  F.pow(F.avg(F.pow(c, F.lit(p))), F.lit(1.0 / p)))


def final_metric(bias: DataFrame, cfg: BiasConfig = DEFAULT, by=()) -> DataFrame:
    """One row: overall_auc, the three power means, bias_score, final_metric.

    ``bias`` is the output of ``bias_metrics`` (a table of one row per
    subgroup plus ``__all__``; its size is the number of subgroups)."""
    is_sub = F.col("subgroup") != OVERALL
    p = cfg.power
    agg = bias.groupBy(*by).agg(
        F.max(F.when(~is_sub, F.col("subgroup_auc"))).alias("overall_auc"),
        F.count(F.when(is_sub, 1)).alias("_n_sub"),
        F.count(F.when(is_sub & F.col("subgroup_auc").isNotNull(), 1)).alias("_ok_sub"),
        F.count(F.when(is_sub & F.col("bpsn_auc").isNotNull(), 1)).alias("_ok_bpsn"),
        F.count(F.when(is_sub & F.col("bnsp_auc").isNotNull(), 1)).alias("_ok_bnsp"),
        F.avg(F.when(is_sub, F.pow("subgroup_auc", F.lit(p)))).alias("_m_sub"),
        F.avg(F.when(is_sub, F.pow("bpsn_auc", F.lit(p)))).alias("_m_bpsn"),
        F.avg(F.when(is_sub, F.pow("bnsp_auc", F.lit(p)))).alias("_m_bnsp"))

    def pm(m, ok):
        return F.when(F.col(ok) == F.col("_n_sub"), F.pow(F.col(m), F.lit(1.0 / p)))

    w = cfg.overall_model_weight
    out = agg.select(
        *by, "overall_auc",
        pm("_m_sub", "_ok_sub").alias("power_mean_subgroup_auc"),
        pm("_m_bpsn", "_ok_bpsn").alias("power_mean_bpsn_auc"),
        pm("_m_bnsp", "_ok_bnsp").alias("power_mean_bnsp_auc"))
    bias_score = (F.col("power_mean_subgroup_auc") + F.col("power_mean_bpsn_auc")
                  + F.col("power_mean_bnsp_auc")) / 3
    return (out.withColumn("bias_score", bias_score)
               .withColumn("final_metric", F.lit(w) * F.col("overall_auc") + F.lit(1 - w) * F.col("bias_score")))


def auc(df: DataFrame, label: str, score: str, threshold: float = 0.5,
        rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Plain ROC AUC of one (label, score) pair: one row ``auc``."""
    res = bias_metrics(df, BiasConfig(identity_columns=()), label=label, score=score,
                       subgroups=[], rows_per_bucket=rows_per_bucket)
    return res.where(F.col("subgroup") == OVERALL).select(F.col("subgroup_auc").alias("auc"))


def scoring_valid(predictions: DataFrame, identities: DataFrame, cfg: BiasConfig = DEFAULT,
                  score: str = "prediction", rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, null_keys: bool = True):
    """Validation score: predictions ``(id, score)`` joined on ``id`` with the
    identity/target table, then bias table and final metric. An id that only
    one side has is an error, as unequal lengths are in the modelled code.
    Returns (bias_table, final_row)."""
    frame = aligned(identities.select(cfg.id_column, cfg.toxicity_column, *cfg.identity_columns),
                    predictions.select(cfg.id_column, F.col(score).alias("_score")), cfg.id_column, null_keys)
    bias = bias_metrics(frame, cfg, score="_score", rows_per_bucket=rows_per_bucket)
    return bias, final_metric(bias, cfg)
