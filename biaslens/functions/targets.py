"""Column expressions for labels, identities and sample weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BINARY_THRESHOLD


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_bool(c, threshold: float = BINARY_THRESHOLD) -> Column:
    """``x >= threshold`` with null and NaN -> false (NaN >= t is true in Spark)."""
    c = _c(c)
    return F.coalesce(~F.isnan(c) & (c >= F.lit(threshold)), F.lit(False))


def below(c, threshold: float = BINARY_THRESHOLD) -> Column:
    """``x < threshold`` with null and NaN -> false."""
    c = _c(c)
    return F.coalesce(~F.isnan(c) & (c < F.lit(threshold)), F.lit(False))


def filled(c, value: float = 0.0) -> Column:
    """Null and NaN replaced by ``value`` (the ``fillna`` of a float column)."""
    c = _c(c)
    return F.nanvl(F.coalesce(c.cast("double"), F.lit(value)), F.lit(value))


def _extreme(fn, cols) -> Column:
    vals = [filled(c) for c in cols]
    return vals[0] if len(vals) == 1 else fn(*vals)


def any_at_least(cols, threshold: float = BINARY_THRESHOLD) -> Column:
    """Some identity >= threshold after filling missing values with 0
    (``greatest`` instead of a lambda: stays in generated code)."""
    return _extreme(F.greatest, cols) >= F.lit(threshold)


def any_below(cols, threshold: float = BINARY_THRESHOLD) -> Column:
    """Some identity < threshold after filling missing values with 0."""
    return _extreme(F.least, cols) < F.lit(threshold)


def all_below(cols, threshold: float = BINARY_THRESHOLD) -> Column:
    return _extreme(F.greatest, cols) < F.lit(threshold)


def sample_weight(target, identities, threshold: float = BINARY_THRESHOLD,
                  strict_background: bool = False) -> Column:
    """1/4 + subgroup/4 + (toxic and background)/4 + (non-toxic and subgroup)/4.

    "background" is *some* identity below the threshold (modelled behaviour);
    ``strict_background=True`` asks for *all* of them below.
    """
    subgroup = any_at_least(identities, threshold)
    background = all_below(identities, threshold) if strict_background else any_below(identities, threshold)
    toxic = to_bool(target, threshold)
    non_toxic = below(target, threshold)
    q = F.lit(0.25)
    return (q + F.when(subgroup, q).otherwise(0.0)
            + F.when(toxic & background, q).otherwise(0.0)
            + F.when(non_toxic & subgroup, q).otherwise(0.0))


def hard_target(target, threshold: float = BINARY_THRESHOLD) -> Column:
    return to_bool(target, threshold).cast("int")
