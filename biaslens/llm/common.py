"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

# one thread per task: Spark spreads the work, the tokenizer library must not
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Words everywhere in this subpackage: runs of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def whole(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Array of the words of a text (null: none). Trimmed first, so that the
    split leaves no empty parts."""
    inner = F.btrim(whole(text), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def workers_can_import(spark: SparkSession) -> None:
    """Python workers import this package from where the driver found it.
    On a cluster the package is installed or shipped with ``--py-files``;
    there the added path does no harm."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on a session's Arrow batches end at 4 MB, not only at a number of
    rows: with whole texts or sets in the rows, 10,000 of them take 50 MB and
    more, several times over in the executor and in each Python worker. A
    smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(key, None)
    if not (bound or "").isdigit() or not 0 < int(bound) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared checkpoint folder, deleted when the session ends."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there:
    later uses read fixed files, also after executors were lost."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing reads any more, and
    lets Spark's cleaner find the shuffles that led to it (it acts when the
    driver collects garbage)."""
    delete(df.sparkSession, df._scratch_path)
    df.sparkSession._jvm.System.gc()


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the given columns; an input column of the same name (case
    ignored, as Spark resolves names) gives way."""
    taken = {c.lower() for c in columns}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, *[e.alias(n) for n, e in columns.items()])
