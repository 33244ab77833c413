"""Row-level operators on a stream: file source -> meta features -> file sink.

The row operators (coercion, cleaning, counters, scaling with fitted
statistics, targets) are single projections, so the same functions run on a
streaming DataFrame. AUC operators need the whole evaluation set and stay
batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, BiasConfig
from ..operators import features as feat
from ..sources.io import scratch_path
from ..sources.tables import comments_sql


def document_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Stream of the ``documents`` table of a data set folder, be it one Parquet
    file or a folder of them."""
    root = root.rstrip("/")
    schema = spark.read.parquet(f"{root}/documents.parquet").schema
    # a file source takes a single file only through a glob
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(f"{root}/documents.parque[t]"))


def stream_meta_features(spark: SparkSession, root: str, out: str | None = None,
                         cfg: BiasConfig = DEFAULT, available_now: bool = True,
                         spread_partitions: int | None = 0) -> tuple[StreamingQuery, str]:
    """Start the feature stream; returns (query, output folder).

    Exactly-once file sink with its own checkpoint under the shared
    checkpoint folder; ``available_now`` processes what is there and stops.
    """
    docs = document_stream(spark, root).select("doc_id", "text")
    # A micro-batch of few large files is few tasks: hash-spread it over the
    # cluster's slots (0 = default parallelism, None = keep file splits).
    if spread_partitions is not None:
        docs = docs.repartition(spread_partitions or spark.sparkContext.defaultParallelism, "doc_id")
    rows = spark.sql(comments_sql("{documents}"), documents=docs)
    features = feat.meta_features(rows, cfg)
    out = out or scratch_path(spark, "stream-meta-features")
    writer = (features.writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", out + "-checkpoint").outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(), out
