"""Batch losses and epoch summaries over (logits, targets, weights) tables.

A model output table is (id, logits array<double>): index 1 the binary
logit, 2..7 the auxiliary logits. Losses are per batch (a batch id column),
as the training loop reports them; no row-order assumption.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nn


def batch_losses(frame: DataFrame, batch: str = "batch", logits: str = "logits", y: str = "y",
                 weight: str = "weight", aux_targets: str = "aux_targets",
                 loss_weight=None, n_aux: int | None = 6,
                 criterion=None) -> DataFrame:
    """Per batch: ``bin = mean(w * bce(logit_0, y))``, ``aux = mean over the
    n x 6 aux cells of bce``; loss = ``0.5*bin + 0.5*aux`` or, with
    ``loss_weight``, ``loss_weight*bin + aux`` (the older training script).

    ``criterion(output_bin, target_bin, weight_bin, output_aux, target_aux)``
    may replace the per-row terms: it returns (binary term, summed aux term)
    as Columns. ``loss_weight`` is a number or the name of a constant column."""
    if criterion is None:
        b = nn.bce_with_logits(nn.binary_logit(logits), F.col(y)) * F.col(weight)
        a = nn.bce_sum(nn.aux_logits(logits), F.col(aux_targets), n_aux)
    else:
        b, a = criterion(nn.binary_logit(logits), F.col(y), F.col(weight), nn.aux_logits(logits),
                         F.col(aux_targets))
    n_aux = F.size(F.col(aux_targets))
    per = frame.groupBy(batch).agg(F.avg(b).alias("bin_loss"),
                                   (F.sum(a) / F.sum(n_aux)).alias("aux_loss"),
                                   F.count(F.lit(1)).alias("n_rows"),
                                   F.avg(hits(logits, y)).alias("accuracy"),
                                   *([F.first(loss_weight).alias("_lw")] if isinstance(loss_weight, str) else []))
    if loss_weight is None:
        loss = F.lit(0.5) * F.col("bin_loss") + F.lit(0.5) * F.col("aux_loss")
    else:
        factor = F.col("_lw") if isinstance(loss_weight, str) else F.lit(float(loss_weight))
        loss = factor * F.col("bin_loss") + F.col("aux_loss")
    return per.withColumn("loss", loss).drop("_lw")


def hits(logits: str = "logits", y: str = "y"):
    """1 where ``(sigmoid(logit_0) > .5) == (y > .5)``, else 0."""
    return ((nn.sigmoid(nn.binary_logit(logits)) > 0.5) == (F.col(y) > 0.5)).cast("double")


def batch_accuracy(frame: DataFrame, batch: str = "batch", logits: str = "logits", y: str = "y") -> DataFrame:
    """Per batch: share of rows on the right side of one half."""
    return frame.groupBy(batch).agg(F.avg(hits(logits, y)).alias("accuracy"))


def epoch_summary(losses: DataFrame, accumulation_steps: int = 1) -> DataFrame:
    """Epoch loss and accuracy as means of per-batch means (the last, short
    batch weighs as much as a full one) of ``batch_losses(..)``; the loss is
    reported divided by the accumulation steps. One row per epoch."""
    return losses.agg((F.avg("loss") / F.lit(float(accumulation_steps))).alias("epoch_loss"),
                      F.avg("accuracy").alias("epoch_accuracy"))
