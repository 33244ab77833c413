"""Meta features, standard scaling, hard / auxiliary targets and weights.

Row-level operators are single projections (one stage, no shuffle) and
work unchanged on streaming DataFrames. Fits are one global aggregate each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, FEATURE_COLUMNS, BiasConfig
from ..functions import targets as tg
from ..functions import text as tx


def meta_features(df: DataFrame, cfg: BiasConfig = DEFAULT, keep=None, missing: str = "nan") -> DataFrame:
    """(id, 11 features) from the text column: coerce -> clean -> count.

    Cleaning applies to the features only; encoders read the raw text.
    """
    keep = list(keep) if keep is not None else [cfg.id_column]
    cleaned = df.select(*keep, tx.clean_spaces(tx.coerce_text(cfg.text_column, missing)).alias("_t"))
    # Split once and reduce to the counted characters once; the features
    # derive from these projected columns.
    with_words = cleaned.withColumn("_w", tx.words("_t")).withColumn("_k", tx.counted_chars("_t"))
    exprs = tx.meta_feature_exprs(F.col("_t"), F.col("_w"), F.col("_k"))
    return with_words.select(*keep, *[exprs[c].alias(c) for c in FEATURE_COLUMNS])


def scale_fit(features: DataFrame, cols=FEATURE_COLUMNS) -> DataFrame:
    """Fitted scaler as a table (feature, mean, std_pop): one aggregate pass.

    Population standard deviation (divide by n), as a standard scaler does;
    Spark ML's StandardScaler would use the sample deviation.
    """
    cols = list(cols)
    filled = [tg.filled(c) for c in cols]
    stats = features.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
                         *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)])
    pairs = ", ".join(f"'{c}', m{i}, s{i}" for i, c in enumerate(cols))
    return stats.selectExpr(f"stack({len(cols)}, {pairs}) as (feature, mean, std_pop)")


def scale_apply(features: DataFrame, scaler: DataFrame, cols=FEATURE_COLUMNS,
                dtype: str = "float") -> DataFrame:
    """``(x - mean) / std`` with std 0 -> 1; the scaler table has one row per
    feature, so it is read to the driver and inlined as literals."""
    stats = {r["feature"]: (r["mean"], r["std_pop"]) for r in scaler.collect()}
    out = {}
    for c in cols:
        mean, std = stats[c]
        std = 1.0 if (std is None or std == 0.0) else std
        mean = 0.0 if mean is None else mean
        out[c] = ((tg.filled(c) - F.lit(mean)) / F.lit(std)).cast(dtype)
    return features.withColumns(out)


def binarized(df: DataFrame, cfg: BiasConfig = DEFAULT, cols=None) -> DataFrame:
    cols = list(cols or [cfg.toxicity_column, *cfg.identity_columns])
    return df.select(cfg.id_column, *[tg.to_bool(c, cfg.threshold).alias(c) for c in cols])


def target_columns(cfg: BiasConfig = DEFAULT) -> dict:
    """``{name: Column}``: hard target ``y``, sample ``weight`` and the soft
    auxiliary targets ``aux_*`` of one row."""
    cols = {"y": tg.hard_target(cfg.toxicity_column, cfg.threshold),
            "weight": tg.sample_weight(cfg.toxicity_column, cfg.identity_columns, cfg.threshold,
                                       cfg.strict_background)}
    cols.update({f"aux_{c}": F.col(c).cast("double") for c in cfg.aux_columns})
    return cols


def target_sources(cfg: BiasConfig = DEFAULT) -> list[str]:
    """Input columns that ``target_columns`` reads."""
    return list(dict.fromkeys([cfg.toxicity_column, *cfg.identity_columns, *cfg.aux_columns]))


def targets(df: DataFrame, cfg: BiasConfig = DEFAULT) -> DataFrame:
    """(id, y, weight, aux targets...): hard target, sample weight and the
    soft auxiliary targets, keyed by id."""
    return df.select(cfg.id_column, *[c.alias(n) for n, c in target_columns(cfg).items()])


def loss_weight(weights: DataFrame, col: str = "weight") -> DataFrame:
    """One row: ``1 / mean(weight)``."""
    return weights.agg((F.lit(1.0) / F.avg(col)).alias("loss_weight"))


def alignment(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """One row (left_only, right_only, matched): how two keyed artefacts align
    (a full outer join on the key; the modelled code assumes equal row
    order instead). Keys are assumed unique per side."""
    right_key = right_key or left_key
    a = left.select(F.col(left_key).alias("_a"))
    b = right.select(F.col(right_key).alias("_b"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("left_only"),
                 F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("right_only"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"))


def aligned(left: DataFrame, right: DataFrame, key: str, null_keys: bool = True) -> DataFrame:
    """Rows of two keyed artefacts side by side. A key that one side lacks
    fails the job: nothing is dropped in silence. A null key matches a null
    key; each side's keys are expected to be unique.

    Without ``null_keys`` a null key is one without a partner, and the join is
    on the plain key, so bucketed artefacts meet where they lie."""
    a = left.withColumn("_in_left", F.lit(True))
    b = right.withColumnRenamed(key, "_right_key").withColumn("_in_right", F.lit(True))
    same = a[key].eqNullSafe(b["_right_key"]) if null_keys else a[key] == b["_right_key"]
    j = a.join(b, same, "full_outer")
    ok = F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull()
    wrong = F.raise_error(F.concat(F.lit(f"{key} without a partner: "),
                                   F.coalesce(F.col(key).cast("string"), F.col("_right_key").cast("string"), F.lit("null"))))
    # in a filter, so that no column pruning can leave the check out
    whole = j.where(F.when(ok, F.lit(True)).otherwise(wrong.cast("boolean")))
    return whole.drop("_in_left", "_in_right", "_right_key")
