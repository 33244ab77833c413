"""Training, scoring and out-of-fold jobs.

The transformer encoder of the modelled pipeline is not rebuilt; the heads
above it are: a weighted binary logistic head on the hard target and six
auxiliary heads on soft targets, fitted on the scaled meta features. Every
artefact is keyed by ``id`` and aligned by equi-joins, never by row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, FEATURE_COLUMNS, BiasConfig
from ..functions import nn
from ..operators import features as feat
from ..operators import order
from ..session import cut_lineage
from . import irls
from .irls import Head


def feature_table(comments: DataFrame, cfg: BiasConfig = DEFAULT, keep=()) -> DataFrame:
    """(id, *keep, 11 meta features, y, weight, aux_*): text features and
    targets of each comment row in ONE projection (no self-join on id)."""
    cols = list(dict.fromkeys([cfg.id_column, *keep, *feat.target_sources(cfg)]))
    return feat.meta_features(comments, cfg, keep=cols).withColumns(feat.target_columns(cfg))


def assemble_table(features: DataFrame, cfg: BiasConfig = DEFAULT, fit_on=None, keep=()) -> DataFrame:
    """(id, *keep, features array<double>, y, weight, aux_*) from a materialised
    ``feature_table``: the scaler is fitted on the rows where ``fit_on``
    holds (all rows when None) and applied to every row."""
    fit_rows = features if fit_on is None else features.where(fit_on)
    scaled = feat.scale_apply(features, feat.scale_fit(fit_rows), dtype="double")
    return scaled.select(cfg.id_column, *keep, F.array(*FEATURE_COLUMNS).alias("features"), *feat.target_columns(cfg))


def training_table(comments: DataFrame, cfg: BiasConfig = DEFAULT) -> DataFrame:
    """(id, features, y, weight, aux_* soft targets), scaler fitted on
    every row. The text pass runs once: fit and transform both read the
    materialised feature table."""
    return assemble_table(cut_lineage(feature_table(comments, cfg)), cfg)


WIDTH = len(FEATURE_COLUMNS)


def fit_binary(train: DataFrame) -> Head:
    """Weighted logistic head on the hard target (weights = sample weights)."""
    return irls.fit(train, [irls.Model("binary", "y", "weight")], WIDTH)["binary"]


def fit_aux(train: DataFrame, cfg: BiasConfig = DEFAULT) -> dict[str, Head]:
    """The auxiliary heads on their soft targets, all in the same passes."""
    return irls.fit(train, [irls.Model(a, f"aux_{a}") for a in cfg.aux_columns], WIDTH)


def coefficients(model: Head, spark, head: str = "binary") -> DataFrame:
    """(head, term, coefficient) with the intercept as term ``intercept``."""
    rows = [(head, f, c) for f, c in zip(FEATURE_COLUMNS, model.coefficients)]
    rows.append((head, "intercept", model.intercept))
    return spark.createDataFrame(rows, "head string, term string, coefficient double")


def head_from(coefs: DataFrame, head: str = "binary") -> Head:
    """A head from its coefficient table (at most 12 rows)."""
    by_term = {r["term"]: r["coefficient"] for r in coefs.where(F.col("head") == head).collect()}
    return Head([by_term[f] for f in FEATURE_COLUMNS], by_term["intercept"])


def score(model: Head, table: DataFrame, id_col: str = "id", aux: dict | None = None) -> DataFrame:
    """(id, logit, prediction[, aux_logits]): raw margin, sigmoid of it, and
    the raw margins of the auxiliary heads (sigmoid on the binary head only)."""
    cols = [id_col, model.margin().alias("logit"), nn.sigmoid(model.margin()).alias("prediction")]
    if aux:
        cols.append(F.array(*[m.margin() for m in aux.values()]).alias("aux_logits"))
    return table.select(*cols)


def score_equations(model: Head, table: DataFrame, label: str = "y", weight: str | None = "weight") -> DataFrame:
    """(term, residual): the weighted score equations ``sum w (y - p) x`` per
    total weight, which vanish at the fit."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    r = w * (F.col(label).cast("double") - nn.sigmoid(model.margin()))
    terms = [(f, F.col("features")[i]) for i, f in enumerate(FEATURE_COLUMNS)] + [("intercept", F.lit(1.0))]
    sums = table.agg(F.sum(w).alias("_w"), *[F.sum(r * x).alias(t) for t, x in terms])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), (F.col(t) / F.col("_w")).alias("residual"))
                                          for t, _ in terms])))


def split_table(comments: DataFrame, cfg: BiasConfig = DEFAULT) -> DataFrame:
    """Training table with a ``split`` column (seeded exact split; the scaler
    is fitted on the train rows only).

    The split's ordered window runs over the narrow feature table and carries
    its columns, so features, targets and split need no join on id.
    """
    # Materialised once each: the text pass feeds the split's two branches,
    # and the split feeds the scaler fit, its apply and every solver pass.
    features = cut_lineage(feature_table(comments, cfg))
    split = order.split_train_valid(features, cfg.id_column, cfg.seed, cfg.train_percent,
                                    cfg.valid_percent).drop("position", "position_count")
    return assemble_table(cut_lineage(split), cfg, F.col("split") == "train", keep=["split"])


def split_and_train(comments: DataFrame, cfg: BiasConfig = DEFAULT):
    """Seeded exact split, scaler fitted on train rows, binary head fitted.
    Returns (table with split column, model)."""
    table = split_table(comments, cfg)
    model = fit_binary(table.where(F.col("split") == "train"))
    return table, model


def fit_binary_folds(table: DataFrame, n_folds: int, fold: str = "fold") -> dict[int, Head]:
    """The k fold models, each trained on the other folds, in the same passes."""
    models = [irls.Model(str(k), "y", "weight", k) for k in range(n_folds)]
    return {int(k): h for k, h in irls.fit(table, models, WIDTH, fold=fold).items()}


def fold_table(comments: DataFrame, folds: DataFrame, cfg: BiasConfig = DEFAULT) -> DataFrame:
    """Training table with the fold of every row; a row without a fold, or a
    fold row without a comment, fails the job."""
    return cut_lineage(feat.aligned(training_table(comments, cfg), folds, cfg.id_column))


def own_fold(margins: dict, fold: str = "fold"):
    """The entry of the row's own fold."""
    out = None
    for k, m in sorted(margins.items()):
        out = F.when(F.col(fold) == k, m) if out is None else out.when(F.col(fold) == k, m)
    return out


def out_of_fold(comments: DataFrame, folds: DataFrame, n_folds: int, cfg: BiasConfig = DEFAULT):
    """Fit the k fold models, score every row with its own fold's model in one
    pass. Returns (OOF (id, fold, logit, prediction), models, training table)."""
    table = fold_table(comments, folds, cfg)
    models = fit_binary_folds(table, n_folds)
    oof = table.select(cfg.id_column, "fold", own_fold({k: m.margin() for k, m in models.items()}).alias("logit"))
    return oof.withColumn("prediction", nn.sigmoid("logit")), models, table


def score_all_folds(table: DataFrame, models: dict[int, Head], id_col: str = "id") -> DataFrame:
    """(fold, id, prediction): every fold model scores every row, in one pass."""
    margins = F.array(*[models[k].margin() for k in sorted(models)])
    return table.select(id_col, F.posexplode(margins).alias("fold", "logit")).select(
        "fold", id_col, nn.sigmoid("logit").alias("prediction"))


def out_of_fold_aux(table: DataFrame, n_folds: int, cfg: BiasConfig = DEFAULT) -> DataFrame:
    """(id, fold, aux_logits): for every fold, the six auxiliary heads trained
    on the other folds score the held-out fold (raw logits, as the modelled
    OOF files keep them). All folds x heads share the passes of one fit."""
    heads = list(cfg.aux_columns)
    fitted = irls.fit(table, [irls.Model(f"{k}/{a}", f"aux_{a}", None, k) for k in range(n_folds) for a in heads],
                      WIDTH, fold="fold")
    arrays = {k: F.array(*[fitted[f"{k}/{a}"].margin() for a in heads]) for k in range(n_folds)}
    return table.select(cfg.id_column, "fold", own_fold(arrays).alias("aux_logits"))
