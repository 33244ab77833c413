"""Batch scoring with a user model: the Arrow / Python hooks.

``make_predict_fn`` is called once per Python worker (``score_with_model``) or
task (``score_batches``) and returns a function from NumPy batches to NumPy
predictions (any framework inside). Rows stay keyed by their id column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


def score_with_model(df: DataFrame, make_predict_fn: Callable, input_col: str, key: str,
                     width: int, out: str = "prediction", batch_size: int = 32,
                     return_type: T.DataType | None = None) -> DataFrame:
    """(key, out) where out = model(batch of ``input_col`` vectors of ``width``)."""
    fn = predict_batch_udf(make_predict_fn, return_type=return_type or T.ArrayType(T.DoubleType()),
                           batch_size=batch_size, input_tensor_shapes=[[width]])
    return df.select(key, fn(F.col(input_col).cast("array<double>")).alias(out))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of lists of one length, as an array."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width, rest = divmod(len(flat), len(column))
    if rest or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("the rows of a batch have inputs of different lengths")
    return flat.reshape(len(column), width)


def _planned(batches: Iterator[pa.RecordBatch], batch: str) -> Iterator[pa.Table]:
    """The rows of one planned batch at a time, from rows in its order."""
    held: list[pa.RecordBatch] = []
    for part in batches:
        ids = part.column(batch).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column(batch)[0].as_py() != ids[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def score_batches(df: DataFrame, make_predict_fn: Callable, inputs: list[str], key: str = "id", batch: str = "batch",
                  position: str = "position", out: str = "prediction", return_type: str = "double") -> DataFrame:
    """(key, batch, out): the model is called once per planned batch, with the
    arrays of all its rows in ``position`` order (one array per name in
    ``inputs``), as a loader with that plan would call it.

    ``df`` holds the plan of ``fixed_batches`` or ``length_batches`` (ids of
    batches, not null) and inputs that ``trim_batches`` has cut, so that the
    rows of a batch have one length; others raise. One shuffle, by batch; a task
    holds one batch at a time. A batch-dependent model (batch norm, padding to
    the longest) gives what it gave in training.
    """
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    to_arrow = {"double": pa.float64(), "float": pa.float32(), "array<double>": pa.list_(pa.float64()),
                "array<float>": pa.list_(pa.float32())}[return_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict_fn()
        for rows in _planned(batches, "_batch"):
            columns = [rows.column(f"_x{i}").chunk(0) for i in range(len(inputs))]
            got = np.asarray(predict(*map(_matrix, columns)))
            if len(got) != rows.num_rows:
                raise ValueError(f"the model gave {len(got)} predictions for {rows.num_rows} rows")
            yield pa.RecordBatch.from_arrays([rows.column("_key").chunk(0), rows.column("_batch").chunk(0),
                                              pa.array(list(got), to_arrow)], names=["_key", "_batch", "_out"])

    rows = df.select(F.col(key).alias("_key"), F.col(batch).cast("long").alias("_batch"), F.col(position).alias("_at"),
                     *[F.col(c).alias(f"_x{i}") for i, c in enumerate(inputs)])
    dealt = rows.repartition("_batch").sortWithinPartitions("_batch", "_at").drop("_at")
    scored = dealt.mapInArrow(run, f"_key {kind}, _batch long, _out {return_type}")
    return scored.select(F.col("_key").alias(key), F.col("_batch").alias(batch), F.col("_out").alias(out))


def batch_share_model() -> Callable:
    """Factory of an example model whose result depends on its whole batch: a
    row's sum over the number of cells of the batch."""
    def predict(ids: np.ndarray) -> np.ndarray:
        return ids.sum(axis=1) / ids.size
    return predict


def dense_relu_model(weights, bias) -> Callable:
    """Factory of a NumPy dense layer ``relu(x @ W + b)`` (an example model)."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.asarray(bias, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return np.maximum(x.reshape(-1, w.shape[0]) @ w + b, 0.0)
        return predict
    return make
