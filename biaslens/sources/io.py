"""CSV comment scans and artefact sinks.

Every artefact carries ``id``; nothing depends on file or row order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AUX_COLUMNS, IDENTITY_COLUMNS
from ..session import ensure_checkpoint_dir
from . import csv_ranges

# The strings a default pandas CSV read turns into missing
# values (the empty string first).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")

COMMENT_COLUMNS = ("id", "comment_text", *AUX_COLUMNS, *IDENTITY_COLUMNS)


def comment_schema(columns=COMMENT_COLUMNS) -> T.StructType:
    """Typed schema of a comment table: id bigint, text string, rest double."""
    fields = []
    for c in columns:
        t = T.LongType() if c == "id" else T.StringType() if c == "comment_text" else T.DoubleType()
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)


def read_comments_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      strict: bool = True, range_bytes: int | None = None) -> DataFrame:
    """Scan a comment CSV by its header names, with pandas' missing-value rules.

    Quoted line breaks and doubled quotes are read as text; every NA token
    becomes null *before* typing, so a text cell ``NA`` is missing (as pandas
    has it). Columns are found by name in whatever order each file has them;
    others are ignored, a missing one is an error. A row with too many or too
    few cells and a number that is none fail the job; with ``strict=False`` they
    become nulls, and ``bad_cells`` counts them.

    Large files are cut into byte ranges (``csv_ranges``), also inside quoted
    cells, so one file keeps as many tasks busy as its size asks for.
    """
    schema = schema or comment_schema()
    raw, header = csv_ranges.scan(spark, path, schema.fieldNames(), range_bytes, strict)
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    cols = []
    for f in schema.fields:
        c = F.when(~F.col(f"`{f.name}`").isin(*NA_TOKENS), F.col(f"`{f.name}`"))
        typed = c if isinstance(f.dataType, T.StringType) else c.cast(f.dataType) if strict else c.try_cast(f.dataType)
        cols.append(typed.alias(f.name))
    return raw.select(*cols)


def bad_cells(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One row: per typed column, the cells that are neither missing nor of its type."""
    schema = schema or comment_schema()
    raw, header = csv_ranges.scan(spark, path, schema.fieldNames(), strict=False)
    return raw.agg(*[F.count_if(~F.col(f"`{f.name}`").isin(*NA_TOKENS) & F.col(f"`{f.name}`").try_cast(f.dataType).isNull())
                     .alias(f.name) for f in schema.fields
                     if f.name in header and not isinstance(f.dataType, T.StringType)])


def write_comments_csv(df: DataFrame, path: str) -> None:
    # The CSV writer trims blanks by default; comments keep them.
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_artefact(df: DataFrame, path: str, partition_by=None, fmt: str = "parquet") -> None:
    """Keyed artefact sink (sequences, features, targets, scaler, OOF...).

    ``partition_by`` (fold, run) gives partition pruning on read, and only the
    folds or runs that ``df`` holds are replaced: the others under ``path``
    stay as they are, so one fold can be run again."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
        w = w.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)


def write_bucketed(df: DataFrame, path: str, key: str = "id", buckets: int | None = None) -> str:
    """Artefact at ``path``, hashed by ``key`` into ``buckets`` sorted files and
    known to the catalog under the returned name (``read_bucketed``).

    Artefacts of the same key and number of buckets meet without an exchange,
    however often they are joined. The one shuffle is paid here. A null key
    fails the job: an artefact's rows are told apart by it."""
    spark = df.sparkSession
    n = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    checked = df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"an artefact's {key} is null")).cast(
        df.schema[key].dataType)).otherwise(F.col(key)))
    name = f"artefact_{uuid.uuid4().hex}"
    (checked.repartition(n, key).sortWithinPartitions(key).write.mode("overwrite").format("parquet")
     .option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name))
    return name


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"
