"""Batch jobs behind the command-line verbs (``spark-submit -m``-friendly).

Each verb reads keyed tables, runs the operators and writes keyed artefacts
(parquet, one folder per artefact; folds and runs as partition folders):

  meta_features  --input --output [--scaler DIR]   features; fits and saves the scaler,
                                                   or applies the given one
  train_target   --input --output                  targets, weights, aux, loss weight
  extract_data   --input --output [--mode head|head_tail|plain] [--max-len L]
                 [--vocab DIR] [--vocab-size K]    token ids (+ pad mask), vocabulary
                                                   (built, or the given one applied)
  train          --features --targets --labels --output --run NAME [--seed S]
                 [--train-percent P] [--valid-percent Q] [--batch-size B] [--accumulation A]
                                                   binary and aux heads, scored validation
                                                   rows, bias table and final metric
  kfold          --features --targets --output [--folds DIR] [--n-folds K] [--seed S]
                                                   fold table, heads of every fold
  predict_oof    --features --targets --folds --heads --output
                                                   each row by the heads of its own fold
  submission     --features --heads --output --run NAME
                                                   predictions of one head or of every fold
  evaluate       --predictions --labels [--score COL] [--output]  bias table + final metric

Comment inputs are parquet, or CSV where the path ends in ``.csv`` or
``--input-format csv`` says so. A scaler, vocabulary, fold table or head table
that is named must be there: nothing is refitted in silence.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, FEATURE_COLUMNS, BiasConfig
from ..functions import nn
from ..operators import auc, encode as enc, features as feat, order
from ..operators import runlog as rl
from ..session import build_session, cut_lineage
from ..sources import io
from . import irls
from . import train as tr


def read_comments(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    if (fmt or ("csv" if path.endswith(".csv") else "parquet")) == "csv":
        return io.read_comments_csv(spark, path)
    return spark.read.parquet(path)


def meta_features_job(spark, inp: str, out: str, scaler: str | None = None, fmt: str | None = None) -> None:
    """Without ``scaler``: fit and save one, scale, save. With it: apply it."""
    # materialised once: the fit and the transform both read it
    mf = cut_lineage(feat.meta_features(read_comments(spark, inp, fmt)))
    if scaler is None:
        scaler = f"{out}/scaler"
        io.write_artefact(feat.scale_fit(mf), scaler)
    io.write_artefact(feat.scale_apply(mf, spark.read.parquet(scaler)), f"{out}/meta_features")


def train_target_job(spark, inp: str, out: str, fmt: str | None = None) -> None:
    io.write_artefact(feat.targets(read_comments(spark, inp, fmt)), f"{out}/targets")
    io.write_artefact(feat.loss_weight(spark.read.parquet(f"{out}/targets")), f"{out}/loss_weight")


def extract_data_job(spark, inp: str, out: str, mode: str = "head", max_len: int = 220,
                     vocab: str | None = None, vocab_size: int | None = None, fmt: str | None = None) -> None:
    """Without ``vocab``: build and save one (whole, or the ``vocab_size`` most
    frequent tokens), encode, save. With it: encode with that one."""
    c = read_comments(spark, inp, fmt)
    if vocab is None:
        vocab = f"{out}/vocab"
        io.write_artefact(enc.build_vocab(c, enc.tokenize("comment_text"), size=vocab_size), vocab)
    io.write_artefact(enc.encode(c, spark.read.parquet(vocab), max_len=max_len, mode=mode), f"{out}/sequences")


def _table(spark, features: str, targets: str, fold_table: str | None = None) -> DataFrame:
    """Two (or three) artefacts aligned by id; an id without a partner fails."""
    x = spark.read.parquet(features).select("id", F.array(*FEATURE_COLUMNS).cast("array<double>").alias("features"))
    table = feat.aligned(x, spark.read.parquet(targets), "id")
    if fold_table:
        table = feat.aligned(table, spark.read.parquet(fold_table).select("id", "fold"), "id")
    return cut_lineage(table)


def _write_heads(spark, heads: dict, path: str, key: str | None = None, value=None) -> None:
    rows = [(*([value[n]] if key else []), n if not key else n.split("/")[1], t, c, h.n_rows) for n, h in heads.items()
            for t, c in zip((*FEATURE_COLUMNS, "intercept"), (*h.coefficients, h.intercept))]
    schema = (f"{key} int, " if key else "") + "head string, term string, coefficient double, n_rows long"
    io.write_artefact(spark.createDataFrame(rows, schema), path, partition_by=key)


def _models(cfg: BiasConfig) -> list[irls.Model]:
    return [irls.Model("binary", "y", "weight"), *(irls.Model(a, f"aux_{a}") for a in cfg.aux_columns)]


def train_job(spark, features: str, targets: str, out: str, labels: str | None = None, run: str = "run",
              cfg: BiasConfig = DEFAULT) -> None:
    """Seeded split, all heads, scored validation rows with the labels and
    identities they were judged by, bias table and final metric; everything
    under ``run=NAME``."""
    table = cut_lineage(order.split_train_valid(_table(spark, features, targets), "id", cfg.seed, cfg.train_percent,
                                                cfg.valid_percent).drop("position", "position_count"))
    heads = irls.fit(table.where(F.col("split") == "train"), _models(cfg), tr.WIDTH)
    base = f"{out}/run={run}"
    _write_heads(spark, heads, f"{base}/coefficients")
    valid = table.where(F.col("split") == "valid")
    scored = tr.score(heads["binary"], valid, aux={a: heads[a] for a in cfg.aux_columns})
    io.write_artefact(scored, f"{base}/valid_predictions")
    n = table.where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n_train"))
    io.write_artefact(n.select("n_train", rl.optimisation_steps("n_train", F.lit(cfg.batch_size), F.lit(cfg.accumulation_steps),
                                                                cfg.epochs).alias("optimisation_steps")), f"{base}/steps")
    if labels:
        judged = read_comments(spark, labels).join(valid.select("id"), "id", "left_semi")
        _evaluated(spark.read.parquet(f"{base}/valid_predictions"), judged, "prediction", base, cfg)


def kfold_job(spark, features: str, targets: str, out: str, folds: str | None = None, n_folds: int = 5,
              seed: int = 2106, cfg: BiasConfig = DEFAULT) -> None:
    """Heads of every fold, each trained on the other folds; the fold table is
    the given one, or a seeded one that is saved."""
    if folds is None:
        folds = f"{out}/folds"
        io.write_artefact(order.assign_folds(spark.read.parquet(features), "id", n_folds, seed), folds)
    table = _table(spark, features, targets, folds)
    ids = [r["fold"] for r in table.select("fold").distinct().orderBy("fold").collect()]
    models = [replace(m, name=f"{k}/{m.name}", without_fold=k) for k in ids for m in _models(cfg)]
    heads = irls.fit(table, models, tr.WIDTH, fold="fold")
    _write_heads(spark, heads, f"{out}/heads", "fold", {m.name: int(m.without_fold) for m in models})


def _fold_heads(spark, path: str) -> dict[int, dict[str, irls.Head]]:
    """Heads by fold of a table that ``kfold`` wrote (12 rows a head)."""
    terms: dict = {}
    for r in spark.read.parquet(path).collect():
        terms.setdefault(r["fold"], {}).setdefault(r["head"], {})[r["term"]] = r["coefficient"]
    return {k: {h: irls.Head([t[f] for f in FEATURE_COLUMNS], t["intercept"]) for h, t in hs.items()}
            for k, hs in terms.items()}


def predict_oof_job(spark, features: str, targets: str, folds: str, heads: str, out: str,
                    cfg: BiasConfig = DEFAULT) -> None:
    """(id, logit, prediction, aux_logits) of every row by the heads of its own
    fold, in one folder a fold."""
    by_fold = _fold_heads(spark, heads)
    table = _table(spark, features, targets, folds)
    logit = tr.own_fold({k: h["binary"].margin() for k, h in by_fold.items()})
    aux = tr.own_fold({k: F.array(*[h[a].margin() for a in cfg.aux_columns]) for k, h in by_fold.items()})
    oof = table.select("id", "fold", logit.alias("logit"), aux.alias("aux_logits")).withColumn(
        "prediction", nn.sigmoid("logit"))
    io.write_artefact(oof, f"{out}/oof", partition_by="fold")


def submission_job(spark, features: str, heads: str, out: str, run: str = "run") -> None:
    """(id, prediction) of every row as CSV under ``run=NAME``; with heads of
    several folds one folder a fold."""
    x = spark.read.parquet(features).select("id", F.array(*FEATURE_COLUMNS).cast("array<double>").alias("features"))
    coefs = spark.read.parquet(heads)
    if "fold" in coefs.columns:
        models = {k: h["binary"] for k, h in _fold_heads(spark, heads).items()}
        names = F.array(*[F.lit(k) for k in sorted(models)])
        rows = tr.score_all_folds(x, models).withColumn("fold", names[F.col("fold")])
        io.write_artefact(rows, f"{out}/run={run}", partition_by="fold", fmt="csv")
    else:
        io.write_artefact(tr.score(tr.head_from(coefs), x).select("id", "prediction"), f"{out}/run={run}", fmt="csv")


def _evaluated(predictions: DataFrame, labels: DataFrame, score: str, out: str | None, cfg: BiasConfig = DEFAULT):
    bias, final = auc.scoring_valid(predictions, labels, cfg, score=score)
    if out:
        frame = feat.aligned(labels.select(cfg.id_column, cfg.toxicity_column, *cfg.identity_columns),
                             predictions.select(cfg.id_column, score), cfg.id_column)
        io.write_artefact(frame, f"{out}/validation", fmt="csv")
        io.write_artefact(bias, f"{out}/bias_metrics", fmt="csv")
        io.write_artefact(final, f"{out}/final_metric", fmt="csv")
    return bias, final


def evaluate_job(spark, predictions: str, labels: str, score: str = "prediction", out: str | None = None,
                 fmt: str | None = None):
    return _evaluated(spark.read.parquet(predictions), read_comments(spark, labels, fmt), score, out)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="biaslens")
    sub = ap.add_subparsers(dest="verb", required=True)

    def verb(name, *required, **options):
        a = sub.add_parser(name)
        for r in required:
            a.add_argument(f"--{r}", required=True)
        for o, default in options.items():
            a.add_argument("--" + o.replace("_", "-"), default=default, type=type(default) if default is not None else str)
        return a

    verb("meta_features", "input", "output", scaler=None, input_format=None)
    verb("train_target", "input", "output", input_format=None)
    a = verb("extract_data", "input", "output", max_len=220, vocab=None, input_format=None)
    a.add_argument("--mode", default="head", choices=["head", "head_tail", "plain"])
    a.add_argument("--vocab-size", type=int)
    verb("train", "features", "targets", "output", labels=None, run="run", seed=DEFAULT.seed,
         train_percent=DEFAULT.train_percent, valid_percent=DEFAULT.valid_percent, batch_size=DEFAULT.batch_size,
         accumulation=DEFAULT.accumulation_steps)
    verb("kfold", "features", "targets", "output", folds=None, n_folds=5, seed=2106)
    verb("predict_oof", "features", "targets", "folds", "heads", "output")
    verb("submission", "features", "heads", "output", run="run")
    verb("evaluate", "predictions", "labels", score="prediction", output=None, input_format=None)
    o = ap.parse_args(argv)
    spark = build_session()
    if o.verb == "meta_features":
        meta_features_job(spark, o.input, o.output, o.scaler, o.input_format)
    elif o.verb == "train_target":
        train_target_job(spark, o.input, o.output, o.input_format)
    elif o.verb == "extract_data":
        extract_data_job(spark, o.input, o.output, o.mode, o.max_len, o.vocab, o.vocab_size, o.input_format)
    elif o.verb == "train":
        cfg = replace(DEFAULT, seed=o.seed, train_percent=o.train_percent, valid_percent=o.valid_percent,
                      batch_size=o.batch_size, accumulation_steps=o.accumulation)
        train_job(spark, o.features, o.targets, o.output, o.labels, o.run, cfg)
    elif o.verb == "kfold":
        kfold_job(spark, o.features, o.targets, o.output, o.folds, o.n_folds, o.seed)
    elif o.verb == "predict_oof":
        predict_oof_job(spark, o.features, o.targets, o.folds, o.heads, o.output)
    elif o.verb == "submission":
        submission_job(spark, o.features, o.heads, o.output, o.run)
    else:
        _, final = evaluate_job(spark, o.predictions, o.labels, o.score, o.output, o.input_format)
        final.show(truncate=False)


if __name__ == "__main__":
    main()
