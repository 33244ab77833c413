"""Weighted logistic heads by Newton's method (iteratively reweighted least
squares), many models in one pass per iteration.

A model is (label column, weight column or none, fold left out or none). In
each iteration every partition adds up, for every model, the gradient and the
Hessian of its rows (a 12 x 12 matrix for 11 features); the sums are pre-added
per task and then per model, so only models x 157 numbers reach the driver.
Rows are never copied per model. Labels may be fractions; a null or NaN label
leaves a row out of that model, and the number of rows used is reported.

A fit ends when the step is below the tolerance; a fit that does not get there
raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package


@dataclass(frozen=True)
class Model:
    name: str
    label: str
    weight: str | None = None
    without_fold: int | None = None


class NotConverged(RuntimeError):
    pass


class Head:
    """Coefficients of one logistic head (the transform is a native dot product)."""

    def __init__(self, coefficients, intercept, n_rows: int = 0, iterations: int = 0):
        self.coefficients = [float(c) for c in coefficients]
        self.intercept = float(intercept)
        self.n_rows = int(n_rows)
        self.iterations = int(iterations)

    def margin(self, features: str = "features"):
        """``x . w + b`` unrolled over the (fixed, small) feature width."""
        x = F.col(features)
        dot = sum((F.element_at(x, i + 1) * F.lit(c) for i, c in enumerate(self.coefficients)), F.lit(0.0))
        return dot + F.lit(self.intercept)


def _sums(table: DataFrame, models: list[Model], beta: dict[str, np.ndarray], features: str, fold: str | None) -> dict:
    """{model: (gradient, Hessian, loss, rows)} at ``beta``, over the whole table."""
    width = len(next(iter(beta.values())))
    columns = list(dict.fromkeys([features, *[m.label for m in models], *[m.weight for m in models if m.weight],
                                  *([fold] if fold else [])]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), width * width + width + 2))
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns if c != features}
            x = batch.column(features).flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for i, m in enumerate(models):
                y = col[m.label].astype(np.float64)
                w = col[m.weight].astype(np.float64) if m.weight else np.ones(len(y))
                use = ~np.isnan(y) & ~np.isnan(w)
                if m.without_fold is not None:
                    use &= col[fold] != m.without_fold
                xs, ys, ws = x[use], y[use], w[use]
                z = xs @ beta[m.name]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                g = xs.T @ (ws * (ys - p))
                h = (xs * (ws * p * (1 - p))[:, None]).T @ xs
                loss = float((ws * (np.logaddexp(0, z) - ys * z)).sum())
                total[i] += np.concatenate([g, h.ravel(), [loss, len(ys)]])
        yield pa.record_batch([pa.array(range(len(models)), pa.int32()),
                               pa.array(list(total), pa.list_(pa.float64()))], names=["model", "sums"])

    parts = table.select(*columns).mapInArrow(add, "model int, sums array<double>")
    size = width * width + width + 2
    added = parts.groupBy("model").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)])
    out = {}
    for r in added.collect():
        v = np.array(r[1:], dtype=np.float64)
        out[models[r["model"]].name] = (v[:width], v[width:-2].reshape(width, width), v[-2], v[-1])
    return out


def fit(table: DataFrame, models: list[Model], width: int, features: str = "features", fold: str | None = None,
        tolerance: float = 1e-10, max_iter: int = 60, penalty: float = 0.0, radius: float = np.inf) -> dict[str, Head]:
    """Heads of all ``models`` over ``table`` (``features``: array<double> of
    ``width``). Steps that raise a model's loss are halved.

    ``penalty`` p adds p / 2 times the squared coefficients (not the intercept)
    to the loss, so labels that the features separate give finite heads: at the
    end the gradient of each coefficient b is p * b. ``radius`` bounds the
    length of a step (a trust region)."""
    if penalty < 0 or not radius > 0:
        raise ValueError("penalty is 0 or more, radius above 0")
    shrink = np.append(np.full(width, float(penalty)), 0.0)
    ship_package(table.sparkSession)
    beta = {m.name: np.zeros(width + 1) for m in models}
    step = {m.name: np.zeros(width + 1) for m in models}
    best = {m.name: np.inf for m in models}
    done: dict[str, Head] = {}
    for iteration in range(1, max_iter + 1):
        live = [m for m in models if m.name not in done]
        if not live:
            break
        sums = _sums(table, live, {m.name: beta[m.name] + step[m.name] for m in live}, features, fold)
        for m in live:
            if m.name not in sums or sums[m.name][3] == 0:
                raise NotConverged(f"{m.name}: no rows")
            gradient, hessian, loss, n = sums[m.name]
            at = beta[m.name] + step[m.name]
            gradient, hessian, loss = gradient - shrink * at, hessian + np.diag(shrink), loss + (shrink * at * at).sum() / 2
            if loss > best[m.name] * (1 + 1e-12) + 1e-12:
                step[m.name] /= 2
                continue
            beta[m.name], best[m.name] = beta[m.name] + step[m.name], loss
            step[m.name] = np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0]
            length = np.linalg.norm(step[m.name])
            if length > radius:
                step[m.name] *= radius / length
            if np.abs(step[m.name]).max() <= tolerance * (1 + np.abs(beta[m.name]).max()):
                done[m.name] = Head(beta[m.name][:-1], beta[m.name][-1], n, iteration)
    left = [m.name for m in models if m.name not in done]
    if left:
        raise NotConverged(f"no convergence in {max_iter} iterations: {', '.join(left)}")
    return done
