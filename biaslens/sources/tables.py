"""Parquet tables of a data set folder and the derived ``comments`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AUX_COLUMNS, DEFAULT, IDENTITY_COLUMNS, BiasConfig

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data set folder (``{root}/{name}.parquet``)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition on ``key`` when the scan yields fewer splits than the
    cluster can run at once (e.g. one large row group), so text work is not
    single-threaded. A large table already has more splits and is returned
    unchanged (no shuffle). Hash partitioning keeps retries deterministic."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()   # planning only, no job
    return df.repartition(n, key) if splits < n else df


def _h(m: int, k: int) -> str:
    # Reduce the key before multiplying so the product never overflows a
    # bigint, whatever the size of the key (same residue as without).
    return f"(((doc_id % 1000003) * {m} + {k}) % 1000003)"


def comments_sql(src: str = "documents") -> str:
    """SQL that derives a labelled comment table from ``documents``.

    The same text runs on Spark and on DuckDB: only integer ``%``, exact
    divisions and ``floor`` are used, so both engines give identical doubles.
    Columns: id, comment_text, target, five aux targets, nine identities
    (null for four in five rows) and a model score ``prediction``.
    """
    tgt = (f"cast(case when {_h(48271, 5)} % 2 = 0 then {_h(16807, 7)} % 101 "
           f"else {_h(16807, 7)} % 50 end as double) / 100")
    ident = ", ".join(
        f"case when {_h(2654435761 + 7919 * k, k)} % 5 = 0 "
        f"then cast({_h(1103515245 + 104729 * k, k * 17)} % 101 as double) / 100 end as {n}"
        for k, n in enumerate(IDENTITY_COLUMNS))
    aux = ", ".join(f"cast({_h(69069 + 1299709 * k, k * 31)} % 101 as double) / 100 as {n}"
                    for k, n in enumerate(AUX_COLUMNS[1:]))
    return f"""select doc_id as id,
      case when doc_id % 97 = 96 then null
           when doc_id % 89 = 88 then '   '
           when doc_id % 5 = 0 then text || ' :) ;-) WHY??!'
           when doc_id % 5 = 1 then '\u00a0' || text || '\u200b:-) $5 & *\ufeff'
           when doc_id % 5 = 2 then text || '\u2003;);) 50% MORE\u2028x'
           else text end as comment_text,
      {tgt} as target, {aux}, {ident},
      floor((({tgt}) * 0.5 + cast({_h(22695477, 3)} % 257 as double) / 512) * 64) / 64 as prediction
      from {src}"""


def comments(spark: SparkSession, root: str) -> DataFrame:
    """The labelled comment table derived from ``documents`` (column-pruned lazily)."""
    docs = spread(read_table(spark, root, "documents").select("doc_id", "text"), "doc_id")
    return spark.sql(comments_sql("{documents}"), documents=docs)


def linear_logits(cfg: BiasConfig = DEFAULT):
    """Stand-in model output of a derived comment row: binary logit
    ``8*(score - 0.5)``, aux logits ``4*(aux - 0.5)``."""
    first = (F.col(cfg.score_column) - F.lit(0.5)) * F.lit(8.0)
    return F.array(first, *[(F.coalesce(F.col(c), F.lit(0.5)) - F.lit(0.5)) * F.lit(4.0) for c in cfg.aux_columns])
