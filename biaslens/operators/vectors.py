"""Vector operators: pooling, concatenation, dense layers with given weights.

Vectors are ``array<float|double>`` columns. Pooling over the rows of a
group uses Spark ML's ``Summarizer`` (a partial aggregate: a hot group is
combined map-side, nothing is collected per group). Top-k rows per group use
``row_number() <= k``, which Spark turns into a per-partition group limit
before the shuffle.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pool(df: DataFrame, keys: list[str], vec: str, how: str = "mean", out: str | None = None) -> DataFrame:
    """Element-wise mean or max of ``vec`` over the rows of each group."""
    out = out or f"{how}_pool"
    v = array_to_vector(F.col(vec).cast("array<double>"))
    summary = Summarizer.metrics(how).summary(v)
    return (df.groupBy(*keys).agg(summary.alias("_s"))
              .select(*keys, vector_to_array(F.col(f"_s.{how}")).alias(out)))


def pool_mean_max(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, mean_pool, max_pool) in one pass."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    summary = Summarizer.metrics("mean", "max").summary(v)
    return df.groupBy(*keys).agg(summary.alias("_s")).select(
        *keys, vector_to_array(F.col("_s.mean")).alias("mean_pool"), vector_to_array(F.col("_s.max")).alias("max_pool"))


def pool_last_k(df: DataFrame, keys: list[str], order: str, vec: str, k: int = 4,
                out: str = "last_k_mean") -> DataFrame:
    """Mean of the ``k`` vectors with the highest ``order`` per group."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    top = df.select(*keys, vec, rn.alias("_rn")).where(F.col("_rn") <= k)
    return pool(top, keys, vec, "mean", out)


def _masked(hidden: Column, mask: Column | None) -> Column:
    """The vectors of a row's positions, without those that are null or whose
    mask is not 1."""
    if mask is None:
        return F.filter(hidden, lambda v: v.isNotNull())
    both = F.arrays_zip(hidden.alias("v"), mask.alias("m"))
    return F.transform(F.filter(both, lambda p: p["v"].isNotNull() & (p["m"] == 1)), lambda p: p["v"])


def _folded(rows: Column, merge) -> Column:
    """One vector: ``merge`` of the rows' vectors, element by element."""
    first = F.transform(F.element_at(rows, 1), lambda x: x.cast("double"))
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), first,
                       lambda acc, v: F.zip_with(acc, v, lambda a, b: merge(a, b.cast("double"))))


def pool_positions(hidden, mask=None, how: str = "mean", last: int | None = None) -> Column:
    """array<double>: element-wise ``mean`` or ``max`` over the positions of one
    row's ``array<array<float|double>>`` (a sequence of hidden vectors).

    ``mask`` (1: a real position) leaves the others out; without it all count,
    padding too, as the modelled heads have it. ``last`` keeps only the last so
    many of what counts. A row without such a position gives null. One native
    expression: nothing is exploded, grouped or shuffled.
    """
    rows = _masked(_c(hidden), None if mask is None else _c(mask))
    if last is not None:
        rows = F.slice(rows, F.greatest(F.size(rows) - last + 1, F.lit(1)), last)
    if how == "max":
        pooled = _folded(rows, lambda a, b: F.greatest(a, b))
    elif how == "mean":
        pooled = F.transform(_folded(rows, lambda a, b: a + b), lambda x: x / F.size(rows))
    else:
        raise ValueError(f"no such pooling: {how}")
    return F.when(F.size(rows) > 0, pooled)


def positions_of(vec, width: int) -> Column:
    """A flat vector as array<array>: one entry of ``width`` numbers per position."""
    vec = _c(vec)
    return F.transform(F.sequence(F.lit(0), (F.size(vec) / width).cast("int") - 1), lambda i: F.slice(vec, i * width + 1, width))


def assemble(*cols) -> Column:
    """Concatenate vectors / scalar columns into one ``array<double>``."""
    parts = []
    for c in cols:
        c = _c(c)
        parts.append(c)
    return F.concat(*[F.when(p.isNotNull(), p) for p in parts])


def as_array(*scalars) -> Column:
    return F.array(*[_c(s).cast("double") for s in scalars])


def dense(x, weights: list[list[float]], bias: list[float] | None = None, relu: bool = False) -> Column:
    """``x @ W + b`` for a given weight matrix (rows = inputs, columns =
    outputs), optional ReLU. Weights are literals of the plan; dropout is the
    identity at inference."""
    x = _c(x)
    n_out = len(weights[0])
    bias = bias or [0.0] * n_out
    outs = []
    for j in range(n_out):
        wj = F.array(*[F.lit(float(row[j])) for row in weights])
        dot = F.aggregate(F.zip_with(x, wj, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)
        y = dot + F.lit(float(bias[j]))
        outs.append(F.greatest(y, F.lit(0.0)) if relu else y)
    return F.array(*outs)


def demo_weights(n_in: int, n_out: int, scale: float = 0.125):
    """Deterministic weight matrix for examples and tests:
    ``W[i][j] = ((7i + 3j) mod 17 - 8) * scale / 8``."""
    return [[((7 * i + 3 * j) % 17 - 8) * scale / 8 for j in range(n_out)] for i in range(n_in)]
