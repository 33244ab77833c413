"""Numerically stable scoring and loss expressions (native columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x) -> Column:
    x = _c(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(x, y) -> Column:
    """``max(x, 0) - x*y + log(1 + exp(-|x|))``: finite for any logit."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def bce_sum(logits, targets, n: int | None = None) -> Column:
    """Sum of element-wise BCE over two equally long arrays; with a known
    length ``n`` the sum is unrolled (generated code, no lambda)."""
    if n is not None:
        return sum((bce_with_logits(F.element_at(_c(logits), i + 1), F.element_at(_c(targets), i + 1))
                    for i in range(n)), F.lit(0.0))
    pairs = F.zip_with(_c(logits), _c(targets), lambda x, y: bce_with_logits(x, y))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def binary_logit(logits) -> Column:
    return F.element_at(_c(logits), 1)


def aux_logits(logits, n_aux: int = 6) -> Column:
    return F.slice(_c(logits), 2, n_aux)
