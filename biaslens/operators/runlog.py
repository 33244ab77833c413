"""Training-log operators: meters, running averages, EMA, best epoch,
retention, every-k-th selection, accumulation groups, keyed losses.

A log table has one row per step: (run, step order columns, value[, n]).
Ordered operators number the steps per run with bucketed prefix sums; the
buckets are range partitions of (run, order...), so a run that holds most
of the log, or a timestamp shared by many of its rows, is still split over
many tasks; nothing collects a run's whole history into one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RUN_SWEEP
from ..session import cut_lineage
from .order import BUCKET, DEFAULT_ROWS_PER_BUCKET, join_on, prefix_max, prefix_sums, range_bucket, row_numbers


def _order_key(df: DataFrame, ts: str) -> DataFrame:
    """Numeric order key for bucketing (microseconds of a timestamp)."""
    t = df.schema[ts].dataType.simpleString()
    if t == "timestamp_ntz":
        # wall-clock micros, independent of the session time zone (a zone
        # cast could reorder rows around daylight-saving gaps)
        key = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    elif t == "timestamp":
        key = F.unix_micros(F.col(ts))
    else:
        key = F.col(ts)
    # null order keys sort first, as in an ascending window
    return df.withColumn("_ok", F.coalesce(key.cast("double"), F.lit(float("-inf"))))


def number_steps(log: DataFrame, run: str, order: list[str], out: str = "step",
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """1-based step number per run in ``order`` (+ ``{out}_count``)."""
    keyed = _order_key(log, order[0])
    keyed = range_bucket(keyed, [run, "_ok", *order], rows_per_bucket)
    res = row_numbers(keyed, [run], ["_ok", *order], out=out)
    return res.drop("_ok", BUCKET)


def weighted_average(log: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """``sum(value * n) / sum(n)`` per group (the final meter average)."""
    return log.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n).cast("double")).alias("weighted_avg"),
        F.sum(n).cast("long").alias("count"))


def running_average(log: DataFrame, run: str, order: list[str], value: str, n: str,
                    rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Meter average after each update: running sum(value*n) / running sum(n)."""
    keyed = _order_key(log.withColumn("_vn", F.col(value) * F.col(n)).withColumn("_n", F.col(n).cast("double")),
                       order[0])
    keyed = range_bucket(keyed, [run, "_ok", *order], rows_per_bucket)
    s = prefix_sums(keyed, [run], ["_ok", *order], ["_vn", "_n"])
    # null while no weight has been seen (0/0)
    avg = F.try_divide(F.col("_vn_before") + F.col("_vn"), F.col("_n_before") + F.col("_n"))
    return s.withColumn("running_avg", avg).drop("_ok", BUCKET, "_vn", "_n", "_vn_before", "_n_before",
                                                 "_vn_total", "_n_total")


def running_best(log: DataFrame, run: str, order: list[str], score: str, start: float = 0.0,
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Flag strict improvements over the best score so far (best starts at
    ``start``), and the best score after each step."""
    keyed = _order_key(log, order[0])
    keyed = range_bucket(keyed, [run, "_ok", *order], rows_per_bucket)
    p = prefix_max(keyed, [run], ["_ok", *order], score)
    best_before = F.greatest(F.lit(start), F.coalesce(F.col(f"{score}_prev_max"), F.lit(start)))
    return (p.withColumn("improved", F.col(score) > best_before)
             .withColumn("best_so_far", F.greatest(best_before, F.col(score)))
             .drop("_ok", BUCKET, f"{score}_prev_max"))


def best_epoch(metrics: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """Per run: epoch with the highest score (maximised metric), ties -> earliest."""
    pick = F.max_by(F.struct(F.col(epoch), F.col(score)), F.struct(F.col(score), -F.col(epoch)))
    return metrics.groupBy(run).agg(pick.alias("_b")).select(
        run, F.col(f"_b.{epoch}").alias("best_epoch"), F.col(f"_b.{score}").alias("best_score"))


def retention(manifest: DataFrame, run: str, order: list[str], keep_last: int = 3,
              rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Keep the newest ``keep_last`` entries per run; the rest are evicted."""
    numbered = number_steps(manifest, run, order, out="_rn", rows_per_bucket=rows_per_bucket)
    return (numbered.withColumn("keep", (F.col("_rn_count") - F.col("_rn")) < keep_last)
                    .drop("_rn", "_rn_count"))


def every_kth(numbered: DataFrame, step: str, k: int) -> DataFrame:
    """Rows whose 1-based counter is a multiple of ``k``."""
    return numbered.where(F.pmod(F.col(step), F.lit(k)) == 0)


def accumulation_groups(numbered: DataFrame, run: str, step: str, value: str, accum: int) -> DataFrame:
    """Per (run, group of ``accum`` consecutive steps): size and mean value."""
    g = F.floor((F.col(step) - 1) / accum).cast("long")
    return numbered.groupBy(run, g.alias("accum_group")).agg(
        F.count(F.lit(1)).alias("n_steps"), F.avg(value).alias("mean_loss"))


def keyed_mean_loss(log: DataFrame, keys: list[str], loss_key: str, value: str) -> DataFrame:
    """Several named losses per step -> mean over the names of each name's value
    (each name averaged first), plus the number of names."""
    per_key = log.groupBy(*keys, loss_key).agg(F.avg(value).alias("_v"))
    return per_key.groupBy(*keys).agg(F.avg("_v").alias("mean_loss"),
                                      F.count(F.lit(1)).alias("n_losses"))


def ema_chunk(decay: float, longest: int = 1024) -> int:
    """Steps a chunk may hold so that ``decay**-chunk`` stays far from overflow."""
    return max(2, int(min(longest, math.floor(138.0 / -math.log(decay)))))


def _decayed_sums(rows: DataFrame, run: str, decay: float, chunk: int | None = None) -> DataFrame:
    """``y_i = decay * y_(i-1) + x_i`` per run over (run, _i from 0, _x): adds ``_y``.

    Sums inside chunks of consecutive steps use ``decay**-q``, q below the
    chunk length; the carry into a chunk is the same recurrence over the ends
    of the chunks before, with decay ``decay**chunk``, until one chunk holds
    every run. Nothing is cut off, and no run meets in one task.
    """
    if decay < 1e-140:  # its square is no number above zero: nothing to carry
        prev = Window.partitionBy(run).orderBy("_i")
        return rows.withColumn("_y", F.col("_x") + F.lit(decay) * F.coalesce(F.lag("_x").over(prev), F.lit(0.0)))
    chunk = chunk or ema_chunk(decay)
    c = F.floor(F.col("_i") / chunk).cast("long")
    cut = rows.withColumn("_c", c).withColumn("_q", (F.col("_i") - F.col("_c") * chunk).cast("double"))
    w = Window.partitionBy(run, "_c").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(F.col("_x") * F.pow(F.lit(decay), -F.col("_q"))).over(w)
    cut = cut.withColumn("_s", F.pow(F.lit(decay), F.col("_q")) * scaled)
    if (rows.agg(F.max("_i")).first()[0] or 0) < chunk:
        return cut.withColumn("_y", F.col("_s")).drop("_c", "_q", "_s")
    ends = cut_lineage(cut.groupBy(run, F.col("_c").alias("_i")).agg(F.max_by("_s", "_q").alias("_x")))
    carry = _decayed_sums(ends, run, decay ** chunk).select(
        run, (F.col("_i") + 1).alias("_c"), F.col("_y").alias("_p"))
    joined = join_on(cut, carry, [run, "_c"], "left")
    before = F.pow(F.lit(decay), F.col("_q") + 1) * F.coalesce("_p", F.lit(0.0))
    return joined.withColumn("_y", F.col("_s") + before).drop("_c", "_q", "_s", "_p")


def ema(log: DataFrame, run: str, order: list[str], value: str, decay: float = 0.98,
        chunk: int | None = None, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Exponential moving average ``l = decay*l + (1-decay)*x`` per run, where
    ``l`` restarts at ``x`` while it is 0 (so leading zero losses keep it 0
    and the first non-zero value starts it). A null run is a run like any
    other. See ``_decayed_sums`` for the chunks.
    """
    if not 0.0 < decay < 1.0:
        raise ValueError("decay must lie in (0, 1)")
    steps = number_steps(log, run, order, out="_t", rows_per_bucket=rows_per_bucket)
    first_nz = (steps.where(F.col(value) != 0).groupBy(run)
                     .agg(F.min_by(F.struct(F.col("_t").alias("j"), F.col(value).alias("xj")), F.col("_t")).alias("_f"))
                     .select(run, "_f.j", "_f.xj"))
    rows = steps.withColumn("_i", F.col("_t") - 1).withColumn("_x", F.col(value).cast("double"))
    joined = join_on(_decayed_sums(cut_lineage(rows), run, decay, chunk), first_nz, [run], "left")
    start = F.pow(F.lit(decay), (F.col("_t") - F.col("j") + 1).cast("double")) * F.col("xj")
    value_ema = F.when(F.col("j").isNull() | (F.col("_t") < F.col("j")), F.lit(0.0)) \
                 .otherwise(start + F.lit(1.0 - decay) * F.col("_y"))
    return joined.select(*log.columns, F.col("_t").alias("step"), value_ema.alias("ema"))


def optimisation_steps(n_rows, batch_size, accumulation_steps, epochs) -> Column:
    """``ceil(n / batch_size / accumulation_steps) * epochs``."""
    def c(x):
        return F.col(x) if isinstance(x, str) else F.lit(x)
    return (F.ceil(c(n_rows).cast("double") / c(batch_size) / c(accumulation_steps)) * c(epochs)).cast("long")


def optimisation_steps_truncated(n_rows, batch_size, accumulation_steps, epochs) -> Column:
    """The older form ``int(epochs * n / batch_size / accumulation_steps)``."""
    def c(x):
        return F.col(x) if isinstance(x, str) else F.lit(x)
    return F.floor(c(epochs) * c(n_rows).cast("double") / c(batch_size) / c(accumulation_steps)).cast("long")


def run_key(model, depth, batch_size, accum, seed, maxlen) -> Column:
    """Run name ``{model}_{depth}layers_{bs}bs_{accum}accum_{seed}seed_{maxlen}``."""
    return F.format_string("%s_%dlayers_%dbs_%daccum_%dseed_%d", F.col(model), F.col(depth),
                           F.col(batch_size), F.col(accum), F.col(seed), F.col(maxlen))


def run_sweep(spark) -> DataFrame:
    """The run-configuration table of the modelled training scripts."""
    return spark.createDataFrame(
        list(RUN_SWEEP), "run string, model string, depth int, maxlen int, batch_size int, "
                         "accumulation_steps int, seed int")


def accumulating_seeds(folds: DataFrame, fold: str, base_seed: int) -> Column:
    """``seed += fold`` across a fold loop: base + running sum of fold numbers."""
    w = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, 0)
    return (F.lit(base_seed) + F.sum(fold).over(w)).cast("long")

