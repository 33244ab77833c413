"""Registered queries: one callable ``(spark, root) -> DataFrame`` per key.

Each reads the data set tables under ``root`` (or tables Spark derives from
them) and calls the library operators. Floating outputs are rounded to
``R`` decimals so that the DuckDB oracles compare value for value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, BiasConfig
from ..functions import nn
from ..functions import text as tx
from ..operators import auc as auc_ops
from ..operators import encode as enc
from ..operators import features as feat
from ..operators import loss as loss_ops
from ..operators import subword
from ..operators import vectors as vec
from ..operators import order
from ..operators import runlog as rl
from ..session import cut_lineage
from ..sources import io, npy
from ..sources.tables import comments, linear_logits, read_table, spread
from ..streaming import features as sf
from . import score, train

R = 9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    """Round every float/double column (arrays of them too) to ``digits``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: F.round(x.cast("double"), digits))
        out.append(c.alias(f.name))
    return df.select(*out)


# --- flagship: bias evaluation -------------------------------------------

@register
def bias_metrics(spark: SparkSession, root: str) -> DataFrame:
    return rounded(auc_ops.bias_metrics(comments(spark, root), DEFAULT))


@register
def final_metric(spark: SparkSession, root: str) -> DataFrame:
    bias = auc_ops.bias_metrics(comments(spark, root), DEFAULT)
    return rounded(auc_ops.final_metric(bias, DEFAULT))


def _bias(spark: SparkSession, root: str) -> DataFrame:
    return auc_ops.bias_metrics(comments(spark, root), DEFAULT)


@register
def overall_auc(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root)
    return rounded(auc_ops.auc(c, DEFAULT.toxicity_column, DEFAULT.score_column)
                   .select(F.col("auc").alias("overall_auc")))


@register
def subgroup_auc(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_bias(spark, root).where(F.col("subgroup") != "__all__")
                   .select("subgroup", "subgroup_size", "subgroup_auc"))


@register
def bpsn_auc(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_bias(spark, root).where(F.col("subgroup") != "__all__").select("subgroup", "bpsn_auc"))


@register
def bnsp_auc(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_bias(spark, root).where(F.col("subgroup") != "__all__").select("subgroup", "bnsp_auc"))


@register
def power_mean(spark: SparkSession, root: str) -> DataFrame:
    fm = auc_ops.final_metric(_bias(spark, root), DEFAULT)
    return rounded(fm.select("power_mean_subgroup_auc", "power_mean_bpsn_auc", "power_mean_bnsp_auc"))


# --- text, features, scaling ----------------------------------------------

@register
def text_coerce(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root)
    return c.select("id", tx.coerce_text("comment_text").alias("comment_text"))


@register
def clean_spaces(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root)
    return c.select("id", tx.clean_spaces(tx.coerce_text("comment_text")).alias("comment_text"))


@register
def meta_features(spark: SparkSession, root: str) -> DataFrame:
    return rounded(feat.meta_features(comments(spark, root)))


@register
def scale_fit(spark: SparkSession, root: str) -> DataFrame:
    return rounded(feat.scale_fit(feat.meta_features(comments(spark, root))))


@register
def scale_apply(spark: SparkSession, root: str) -> DataFrame:
    mf = cut_lineage(feat.meta_features(comments(spark, root)))
    return rounded(feat.scale_apply(mf, feat.scale_fit(mf), dtype="double"))


# --- targets and weights ---------------------------------------------------

@register
def binarize(spark: SparkSession, root: str) -> DataFrame:
    return feat.binarized(comments(spark, root))


@register
def targets(spark: SparkSession, root: str) -> DataFrame:
    return rounded(feat.targets(comments(spark, root)))


@register
def sample_weights(spark: SparkSession, root: str) -> DataFrame:
    t = feat.targets(comments(spark, root))
    return t.groupBy("weight").agg(F.count(F.lit(1)).alias("n_rows"))


@register
def loss_weight(spark: SparkSession, root: str) -> DataFrame:
    return rounded(feat.loss_weight(feat.targets(comments(spark, root))))


# --- sequence encoding ------------------------------------------------------

def _token_rows(spark: SparkSession, root: str) -> DataFrame:
    return comments(spark, root).select("id", enc.tokenize("comment_text").alias("tokens"))


def _vocab(spark: SparkSession, root: str) -> DataFrame:
    return enc.build_vocab(comments(spark, root), enc.tokenize("comment_text"))


@register
def tokens(spark: SparkSession, root: str) -> DataFrame:
    return comments(spark, root).select("id", enc.tokenize("comment_text").alias("tokens"))


@register
def vocab(spark: SparkSession, root: str) -> DataFrame:
    return _vocab(spark, root)


def _encoded(spark: SparkSession, root: str, mode: str = "head") -> DataFrame:
    """Count tokens in one scan, encode from a second one that keeps only the
    first positions: no token table as large as the text is written."""
    return enc.encode(comments(spark, root).select("id", "comment_text"), cut_lineage(_vocab(spark, root)),
                      max_len=DEFAULT.max_sequence_length, mode=mode)


@register
def encode_head(spark: SparkSession, root: str) -> DataFrame:
    return _encoded(spark, root)


@register
def encode_head_tail(spark: SparkSession, root: str) -> DataFrame:
    return _encoded(spark, root, "head_tail")


@register
def encode_plain(spark: SparkSession, root: str) -> DataFrame:
    return _encoded(spark, root, "plain")


def _benchmark_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """A finished vocabulary: the words of the benchmark items and their affixes."""
    items = read_table(spark, root, "benchmark").select("text")
    found = items.select(F.explode(subword.text_words(items, "text")).alias("word")).distinct()
    return cut_lineage(subword.affix_vocabulary(found))


@register
def encode_wordpiece(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).select("id", "comment_text")
    return subword.encode_wordpiece(c, _benchmark_vocabulary(spark, root), max_len=DEFAULT.max_sequence_length)


@register
def encode_wordpiece_head_tail(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).select("id", "comment_text")
    return subword.encode_wordpiece(c, _benchmark_vocabulary(spark, root), max_len=DEFAULT.max_sequence_length, mode="head_tail")


@register
def attention_mask(spark: SparkSession, root: str) -> DataFrame:
    e = _encoded(spark, root)
    return e.select("id", enc.attention_mask("token_ids").alias("attention_mask"),
                    enc.zero_count("token_ids").alias("n_zeros"))


@register
def truncation_stats(spark: SparkSession, root: str) -> DataFrame:
    return enc.truncation_stats(comments(spark, root), max_len=DEFAULT.max_sequence_length)


# --- splits, folds, batches -------------------------------------------------

N_FOLDS = 5
FOLD_SEED = 2106


@register
def split_train_valid(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).select("id")
    s = order.split_train_valid(c, "id", DEFAULT.seed, DEFAULT.train_percent, DEFAULT.valid_percent)
    return s.select("id", "position", "split")


@register
def split_sizes(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).select("id")
    s = order.split_train_valid(c, "id", DEFAULT.seed, DEFAULT.train_percent, DEFAULT.valid_percent)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register
def fold_sizes(spark: SparkSession, root: str) -> DataFrame:
    folds = order.assign_folds(comments(spark, root), "id", N_FOLDS, FOLD_SEED)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@register
def fold_rows(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).select("id")
    return order.fold_row_counts(c, cut_lineage(order.assign_folds(c, "id", N_FOLDS, FOLD_SEED)), N_FOLDS)


@register
def fold_members(spark: SparkSession, root: str) -> DataFrame:
    return order.assign_folds(comments(spark, root).select("id"), "id", N_FOLDS, FOLD_SEED)


@register
def shuffled_batches(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).select("id")
    return order.fixed_batches(c, "id", DEFAULT.batch_size, seed=DEFAULT.seed).select("id", "position", "batch")


@register
def fixed_batches(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).select("id")
    return order.fixed_batches(c, "id", DEFAULT.batch_size).select("id", "position", "batch")


@register
def length_batches(spark: SparkSession, root: str) -> DataFrame:
    z = _encoded(spark, root).select("id", enc.zero_count("token_ids").alias("n_zeros"))
    return order.length_batches(z, "id", "n_zeros", DEFAULT.batch_size)


@register
def trim_batches(spark: SparkSession, root: str) -> DataFrame:
    return _trimmed(spark, root).drop("position")


def _trimmed(spark: SparkSession, root: str) -> DataFrame:
    """Only ids go through the numbering; the sequences meet their batch once."""
    plan = order.fixed_batches(comments(spark, root).select("id"), "id", DEFAULT.batch_size)
    return order.trim_batches(_encoded(spark, root).join(plan, "id"), "token_ids")


@register
def score_planned_batches(spark: SparkSession, root: str) -> DataFrame:
    """A batch-dependent model over the planned, trimmed batches."""
    return rounded(score.score_batches(_trimmed(spark, root), score.batch_share_model, ["token_ids"]))


# --- training-log operators on the events table ----------------------------
# run = user_id, step order = (ts, event_id), loss = value, n = props.k

STEP_ORDER = ["ts", "event_id"]


def _log(spark: SparkSession, root: str) -> DataFrame:
    ev = read_table(spark, root, "events")
    return ev.select("event_id", "ts", "user_id", "event_type", "value",
                     F.get_json_object("props", "$.k").cast("int").alias("k"),
                     F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"))


@register
def weighted_avg(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rl.weighted_average(_log(spark, root), ["user_id"], "value", "k"))


@register
def running_avg(spark: SparkSession, root: str) -> DataFrame:
    log = _log(spark, root).select("user_id", *STEP_ORDER, "value", "k")
    r = rl.running_average(log, "user_id", STEP_ORDER, "value", "k")
    return rounded(r.select("event_id", "user_id", "running_avg"))


@register
def running_best(spark: SparkSession, root: str) -> DataFrame:
    r = rl.running_best(_log(spark, root).select("user_id", *STEP_ORDER, "value"), "user_id", STEP_ORDER, "value")
    return rounded(r.select("event_id", "user_id", "improved", "best_so_far"))


def _epoch_scores(spark: SparkSession, root: str) -> DataFrame:
    return _log(spark, root).groupBy("user_id", "epoch").agg(F.avg("value").alias("score"))


@register
def best_epoch(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rl.best_epoch(_epoch_scores(spark, root), "user_id", "epoch", "score"))


@register
def retention(spark: SparkSession, root: str) -> DataFrame:
    return rl.retention(_log(spark, root).select("user_id", *STEP_ORDER), "user_id", STEP_ORDER, keep_last=3).select(
        "event_id", "user_id", "keep")


@register
def every_kth(spark: SparkSession, root: str) -> DataFrame:
    steps = rl.number_steps(_log(spark, root).select("user_id", *STEP_ORDER), "user_id", STEP_ORDER)
    return rl.every_kth(steps, "step", 10).select("event_id", "user_id", "step")


@register
def accum_groups(spark: SparkSession, root: str) -> DataFrame:
    steps = rl.number_steps(_log(spark, root).select("user_id", *STEP_ORDER, "value"), "user_id", STEP_ORDER)
    return rounded(rl.accumulation_groups(steps, "user_id", "step", "value", DEFAULT.accumulation_steps))


@register
def mean_loss(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rl.keyed_mean_loss(_log(spark, root), ["user_id", "epoch"], "event_type", "value"))


@register
def loss_ema(spark: SparkSession, root: str) -> DataFrame:
    e = rl.ema(_log(spark, root).select("user_id", *STEP_ORDER, "value"), "user_id", STEP_ORDER, "value")
    return rounded(e.select("event_id", "user_id", "step", "ema"))


@register
def run_steps(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).select("id")
    split = order.split_train_valid(c, "id", DEFAULT.seed, DEFAULT.train_percent, DEFAULT.valid_percent)
    n_train = split.where(F.col("split") == "train").count()  # one scalar
    sweep = rl.run_sweep(spark)
    return sweep.select(
        "run", rl.run_key("model", "depth", "batch_size", "accumulation_steps", "seed", "maxlen").alias("run_key"),
        F.lit(n_train).cast("long").alias("n_train"),
        rl.optimisation_steps(F.lit(n_train), F.col("batch_size"), F.col("accumulation_steps"),
                              DEFAULT.epochs).alias("optimisation_steps"),
        rl.optimisation_steps_truncated(F.lit(n_train), F.col("batch_size"), F.col("accumulation_steps"),
                                        F.lit(DEFAULT.epochs)).alias("optimisation_steps_truncated"))


# --- model outputs, losses --------------------------------------------------

def _scored(spark: SparkSession, root: str) -> DataFrame:
    """comments + targets + stand-in logits + batch (id order): one projection
    that the batch numbering carries, no join on id."""
    rows = comments(spark, root).withColumns({**feat.target_columns(DEFAULT), "logits": linear_logits()}).select(
        "id", "logits", F.col("y").cast("double").alias("y"), "weight",
        F.array(*[f"aux_{a}" for a in DEFAULT.aux_columns]).alias("aux_targets"))
    return order.fixed_batches(rows, "id", DEFAULT.batch_size)


def _scored_with_loss_weight(spark: SparkSession, root: str) -> DataFrame:
    """With the loss weight ``1 / mean(weight)`` of the whole table on every row."""
    rows = _scored(spark, root)
    one = feat.loss_weight(feat.targets(comments(spark, root)))
    return rows.join(F.broadcast(one))  # an aggregate without keys: exactly one row


@register
def sigmoid_scores(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).withColumn("logits", linear_logits())
    return rounded(c.select("id", nn.sigmoid(nn.binary_logit("logits")).alias("prediction")))


@register
def split_logits(spark: SparkSession, root: str) -> DataFrame:
    c = comments(spark, root).withColumn("logits", linear_logits())
    return rounded(c.select("id", nn.binary_logit("logits").alias("binary_logit"),
                            nn.aux_logits("logits").alias("aux_logits")))


@register
def weighted_loss(spark: SparkSession, root: str) -> DataFrame:
    return rounded(loss_ops.batch_losses(_scored(spark, root)).select("batch", "n_rows", "loss"))


@register
def weighted_loss_scaled(spark: SparkSession, root: str) -> DataFrame:
    rows = _scored_with_loss_weight(spark, root)
    return rounded(loss_ops.batch_losses(rows, loss_weight="loss_weight").select("batch", "loss"))


@register
def epoch_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """Epoch loss (scaled criterion with the data's loss weight, divided by
    the accumulation steps) and accuracy, as means of per-batch means."""
    losses = loss_ops.batch_losses(_scored_with_loss_weight(spark, root), loss_weight="loss_weight")
    return rounded(loss_ops.epoch_summary(losses, accumulation_steps=DEFAULT.accumulation_steps))


# --- vectors on the embeddings table ----------------------------------------

def _emb(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "embeddings")


@register
def pool_mean(spark: SparkSession, root: str) -> DataFrame:
    return rounded(vec.pool(_emb(spark, root), ["label"], "embedding", "mean"))


@register
def pool_max(spark: SparkSession, root: str) -> DataFrame:
    return rounded(vec.pool(_emb(spark, root), ["label"], "embedding", "max"))


@register
def pool_last_k(spark: SparkSession, root: str) -> DataFrame:
    return rounded(vec.pool_last_k(_emb(spark, root), ["label"], "vec_id", "embedding", 4))


@register
def pool_positions(spark: SparkSession, root: str) -> DataFrame:
    """Each vector read as a sequence of eight positions, of which the first
    ``1 + vec_id mod 8`` are real."""
    e = read_table(spark, root, "embeddings").select("vec_id", vec.positions_of("embedding", 8).alias("h"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.pmod("vec_id", F.lit(8))).cast("int"))
    return rounded(e.withColumn("m", mask).select(
        "vec_id", vec.pool_positions("h").alias("mean_all"), vec.pool_positions("h", how="max").alias("max_all"),
        vec.pool_positions("h", "m").alias("mean_masked"), vec.pool_positions("h", "m", "max").alias("max_masked"),
        vec.pool_positions("h", "m", last=4).alias("last_mean")))


@register
def assemble(spark: SparkSession, root: str) -> DataFrame:
    e = _emb(spark, root)
    # a few rows a label; a label that holds most vectors is split by the skew join
    return rounded(e.join(vec.pool_mean_max(e, ["label"], "embedding"), "label").select(
        "vec_id", vec.assemble(F.col("embedding").cast("array<double>"), "mean_pool", "max_pool",
                               vec.as_array("label")).alias("features")))


DENSE_IN, DENSE_OUT = 64, 8


@register
def dense_head(spark: SparkSession, root: str) -> DataFrame:
    w = vec.demo_weights(DENSE_IN, DENSE_OUT)
    b = [0.01 * j for j in range(DENSE_OUT)]
    e = _emb(spark, root)
    return rounded(e.select("vec_id", vec.dense("embedding", w, b, relu=True).alias("hidden")))


# --- fitted heads --------------------------------------------------------------

@register
def train_binary(spark: SparkSession, root: str) -> DataFrame:
    _, model = train.split_and_train(comments(spark, root))
    return rounded(train.coefficients(model, spark), 6)


@register
def train_aux(spark: SparkSession, root: str) -> DataFrame:
    table = train.split_table(comments(spark, root))
    heads = train.fit_aux(table.where(F.col("split") == "train"))
    out = None
    for name, m in heads.items():
        part = train.coefficients(m, spark, name)
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)


@register
def fit_residuals(spark: SparkSession, root: str) -> DataFrame:
    """The weighted score equations at the binary fit: zero, as the optimum asks."""
    table, model = train.split_and_train(comments(spark, root))
    return rounded(train.score_equations(model, table.where(F.col("split") == "train")), 8)


def _given_head() -> train.Head:
    """Fixed coefficients, so that scores can be checked value by value."""
    return train.Head([0.05 * (i + 1) * (-1) ** i for i in range(train.WIDTH)], -0.25)


@register
def score_table(spark: SparkSession, root: str) -> DataFrame:
    table, model = train.split_and_train(comments(spark, root))
    return rounded(train.score(model, table), 6)


@register
def score_given(spark: SparkSession, root: str) -> DataFrame:
    """Batch scoring with given coefficients over features scaled on all rows."""
    return rounded(train.score(_given_head(), train.training_table(comments(spark, root))), 6)


@register
def submission(spark: SparkSession, root: str) -> DataFrame:
    """Predictions for the rows outside the training split, keyed by id."""
    table, model = train.split_and_train(comments(spark, root))
    test = table.where(F.col("split") != "train")
    return rounded(train.score(model, test).select("id", "prediction"), 6)


def _folds(spark: SparkSession, root: str) -> DataFrame:
    return order.assign_folds(comments(spark, root).select("id"), "id", N_FOLDS, FOLD_SEED)


@register
def oof_union(spark: SparkSession, root: str) -> DataFrame:
    oof, _, _ = train.out_of_fold(comments(spark, root), _folds(spark, root), N_FOLDS)
    return rounded(oof.select("id", "fold", "logit", "prediction"), 6)


@register
def oof_aux(spark: SparkSession, root: str) -> DataFrame:
    """Out-of-fold auxiliary logits (six heads per fold)."""
    table = train.fold_table(comments(spark, root), _folds(spark, root))
    return rounded(train.out_of_fold_aux(table, N_FOLDS), 6)


@register
def submission_folds(spark: SparkSession, root: str) -> DataFrame:
    """Every fold model scores the whole table: (fold, id, prediction)."""
    _, models, table = train.out_of_fold(comments(spark, root), _folds(spark, root), N_FOLDS)
    return rounded(train.score_all_folds(table, models), 6)


def _two_epochs(spark: SparkSession, root: str) -> DataFrame:
    return comments(spark, root).select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("epoch"), F.col("prediction").alias("score")),
        F.struct(F.lit(1).alias("epoch"), ((F.col("prediction") + F.col("target")) / 2).alias("score")))).alias("_e")
    ).select("*", "_e.epoch", "_e.score").drop("_e")


@register
def epoch_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Validation metric per epoch in one pass: each epoch's prediction set is
    a group key of the bias evaluation."""
    bias = auc_ops.bias_metrics(_two_epochs(spark, root), DEFAULT, score="score", by=["epoch"])
    return rounded(auc_ops.final_metric(bias, DEFAULT, by=["epoch"]))


@register
def epoch_metrics_merged(spark: SparkSession, root: str) -> DataFrame:
    """``epoch_metrics`` from a count table that grows by additions: predictions
    arrive in three parts, each counted once and written under its own name."""
    predictions, path = _two_epochs(spark, root), io.scratch_path(spark, "counts")
    for part in range(3):
        counts = auc_ops.score_counts(predictions.where(F.pmod("id", F.lit(3)) == part), DEFAULT.toxicity_column, "score",
                                      DEFAULT.identity_columns, DEFAULT.threshold, ["epoch"])
        io.write_artefact(counts.withColumn("addition", F.lit(part)), path, "addition")
    counts = auc_ops.merged_counts(spark.read.parquet(path).drop("addition"), by=["epoch"])
    bias = auc_ops.bias_from_counts(cut_lineage(counts), DEFAULT.identity_columns, by=["epoch"])
    return rounded(auc_ops.final_metric(bias, DEFAULT, by=["epoch"]))


@register
def epoch_bias_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Bias tables of two epochs: in epoch 1 nobody of the first subgroup was
    scored (its rows are left out), in epoch 2 some members have no score."""
    c = comments(spark, root)
    first, second = DEFAULT.identity_columns[:2]
    per_epoch = c.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch")).where(
        (F.col("epoch") == 2) | ~F.coalesce(F.col(first) >= 0.5, F.lit(False))).withColumn(
        "score", F.when((F.col("epoch") == 1) | F.col(second).isNull() | (F.col("id") % 3 != 0), F.col("prediction")))
    return rounded(auc_ops.bias_metrics(per_epoch, DEFAULT, score="score", by=["epoch"]))


@register
def scoring_valid(spark: SparkSession, root: str) -> DataFrame:
    """Predictions and labels as two artefacts, aligned by id, then scored."""
    c = comments(spark, root)
    _, final = auc_ops.scoring_valid(c.select("id", "prediction"), c, DEFAULT)
    return rounded(final)


# --- sources, sinks, streaming ----------------------------------------------

CSV_RANGE = 1 << 20  # several ranges a file, whatever the size of the tables


@register
def scan_comments(spark: SparkSession, root: str) -> DataFrame:
    """Comment table written as CSV (quoted, escaped, multi-line; columns in
    another order, one more in front) and scanned back by name with the
    missing-value rules of the modelled reader."""
    path = io.scratch_path(spark, "comments-csv")
    c = comments(spark, root)
    shuffled = [*reversed(DEFAULT.identity_columns), "prediction", "comment_text", *DEFAULT.aux_columns, "id"]
    io.write_comments_csv(c.select(F.lit("extra, cell").alias("note"), *shuffled), path)
    back = io.read_comments_csv(spark, path, range_bytes=CSV_RANGE)
    return rounded(back.select("id", "comment_text", "target", *DEFAULT.identity_columns))


@register
def matrix_artefact(spark: SparkSession, root: str) -> DataFrame:
    """Ids and the feature matrix as array files in id order, scanned back side by side."""
    features = cut_lineage(feat.meta_features(comments(spark, root)))  # the numbering reads it twice
    names = [c for c in features.columns if c != "id"]
    rows = cut_lineage(order.global_positions(features, "id").select(
        (F.col("position") - 1).alias("position"), "id", F.array(*[F.col(c).cast("double") for c in names]).alias("x")))
    paths = {c: io.scratch_path(spark, f"matrix-{c}") for c in ("id", "x")}
    for c, path in paths.items():
        npy.write_array(rows, path, c)
    back = npy.read_arrays(spark, paths)
    return rounded(back.select("position", "id", *[F.col("x")[i].alias(c) for i, c in enumerate(names)]))


@register
def stream_meta_features(spark: SparkSession, root: str) -> DataFrame:
    """Meta features computed by a Structured Streaming job (file source,
    availableNow trigger, exactly-once file sink), read back as a table."""
    q, out = sf.stream_meta_features(spark, root)
    q.awaitTermination()
    return rounded(spark.read.parquet(out))


@register
def training_table(spark: SparkSession, root: str) -> DataFrame:
    """Keyed alignment of encoded sequences, scaled features and targets
    (equi-joins on id; the modelled code zips arrays by position)."""
    j = feat.aligned(_encoded(spark, root), train.training_table(comments(spark, root)), "id")
    return rounded(j.select("id", F.size(F.filter("token_ids", lambda x: x != 0)).alias("n_ids"),
                            F.element_at("features", 1).alias("total_length_scaled"), "y", "weight"))


BUCKETS = 16


def _artefact(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    path = io.scratch_path(spark, what)
    return io.read_bucketed(spark, io.write_bucketed(df, path, "id", BUCKETS))


@register
def training_table_bucketed(spark: SparkSession, root: str) -> DataFrame:
    """``training_table`` from bucketed artefacts: they meet without an exchange."""
    sequences = _artefact(spark, _encoded(spark, root), "sequences")
    table = _artefact(spark, train.training_table(comments(spark, root)), "training")
    j = feat.aligned(sequences, table, "id", null_keys=False)
    return rounded(j.select("id", F.size(F.filter("token_ids", lambda x: x != 0)).alias("n_ids"),
                            F.element_at("features", 1).alias("total_length_scaled"), "y", "weight"))


@register
def scoring_valid_bucketed(spark: SparkSession, root: str) -> DataFrame:
    """``scoring_valid`` from bucketed artefacts."""
    c = comments(spark, root)
    predictions = _artefact(spark, c.select("id", "prediction"), "predictions")
    labels = _artefact(spark, c.select("id", "target", *DEFAULT.identity_columns), "labels")
    _, final = auc_ops.scoring_valid(predictions, labels, DEFAULT, null_keys=False)
    return rounded(final)


@register
def dense_head_batch_udf(spark: SparkSession, root: str) -> DataFrame:
    """The dense head through the user-model hook (Arrow batches of 32)."""
    w = vec.demo_weights(DENSE_IN, DENSE_OUT)
    b = [0.01 * j for j in range(DENSE_OUT)]
    e = _emb(spark, root)
    return rounded(score.score_with_model(e, score.dense_relu_model(w, b), "embedding", "vec_id", DENSE_IN,
                                          out="hidden"))


@register
def fold_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Fold loop seeds ``seed += fold`` (running sum over the fold table)."""
    folds = order.assign_folds(comments(spark, root), "id", N_FOLDS, FOLD_SEED)
    per_fold = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_fold.select("fold", "n_rows", rl.accumulating_seeds(per_fold, "fold", FOLD_SEED).alias("seed"))



# --- the real labels and the second text table -------------------------------

@register
def bias_metrics_labels(spark: SparkSession, root: str) -> DataFrame:
    """The bias table against the real 0/1 ``labels.toxic`` (inner join on id)."""
    lab = read_table(spark, root, "labels").select(F.col("doc_id").alias("id"),
                                                   F.col("toxic").cast("double").alias("target"))
    c = comments(spark, root).drop("target").join(lab, "id")
    return rounded(auc_ops.bias_metrics(c, DEFAULT))


@register
def conversation_features(spark: SparkSession, root: str) -> DataFrame:
    """Row-level meta features of the conversation turns (key conv_id, turn)."""
    conv = spread(read_table(spark, root, "conversations"), "conv_id")
    cfg = BiasConfig(text_column="text")
    return rounded(feat.meta_features(conv, cfg, keep=["conv_id", "turn"]))


@register
def alignment_check(spark: SparkSession, root: str) -> DataFrame:
    """Key alignment of the comment table and the label table."""
    return feat.alignment(comments(spark, root), read_table(spark, root, "labels"), "id", "doc_id")
