"""Global order at scale: bucketed prefix sums, row numbers, splits, batches.

A ``Window.orderBy`` without ``partitionBy`` moves every row into one task,
and ``partitionBy(group)`` moves a hot group into one task. All ordered
operators here use the same two-level scheme instead:

1. a *bucket* column that is a non-decreasing function of the order key
   (range partitions of the full sort key, or hash bits), sized from the row
   count; every input, small or large, takes this path;
2. per-(group, bucket) totals -> exclusive running sum over buckets; this
   table has at most groups x buckets rows and is joined back;
3. a window partitioned by (group, bucket) for the in-bucket running sum.

Every task then holds about ``rows_per_bucket`` rows whatever the skew of
the group key, and the result is deterministic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKET = "_bucket"
DEFAULT_ROWS_PER_BUCKET = 200_000
MIN_BUCKETS = 8


def bucket_count(n_rows: int, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> int:
    return max(MIN_BUCKETS, math.ceil(n_rows / max(1, rows_per_bucket)))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` that also matches null keys (``<=>``): a null
    run or group key is a group like any other, its rows are not lost."""
    if not cols:
        raise ValueError("join_on needs at least one key")
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


def range_bucket(df: DataFrame, sort_cols: list, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                 out: str = BUCKET, n_rows: int | None = None) -> DataFrame:
    """Add ``out``: a bucket non-decreasing in the lexicographic order of
    ``sort_cols`` (group keys first, then the order columns).

    Spark's range partitioning samples the full sort key, so even one order
    value holding a third of a group's rows is split over several buckets
    (a quantile of the first column alone cannot split ties). The partition
    id is materialised in the shared checkpoint folder right away, so it is
    fixed data afterwards, not a property of a recomputation. Callers pass
    only the columns that the ordered step needs.
    """
    n = df.count() if n_rows is None else n_rows
    ranged = df.repartitionByRange(bucket_count(n, rows_per_bucket), *[_col(c) for c in sort_cols])
    return cut_lineage(ranged.withColumn(out, F.spark_partition_id()))


HASH_BITS = 60


def hash_bucket(hash_col: str | Column, bits: int) -> Column:
    """Bucket from the high bits of a 60-bit hash (monotone in the hash)."""
    return F.shiftright(_col(hash_col), HASH_BITS - bits)


def prefix_sums(df: DataFrame, keys: list[str], order: list, values: list[str],
                bucket: str = BUCKET) -> DataFrame:
    """Exclusive running sums of ``values`` per ``keys`` in ``order``.

    ``df`` must carry ``bucket``, non-decreasing in ``order`` within a group.
    Adds ``{v}_before`` (sum over earlier rows) and ``{v}_total`` (group sum).
    The offsets table (a row per group and bucket) is joined as Spark sees
    fit: broadcast only within its byte threshold.
    """
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_bt_{v}") for v in values])
    over_buckets = Window.partitionBy(*keys).orderBy(bucket)
    offsets = totals.select(
        *keys, bucket,
        *[F.coalesce(F.sum(f"_bt_{v}").over(
            over_buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_off_{v}")
          for v in values],
        *[F.sum(f"_bt_{v}").over(Window.partitionBy(*keys)).alias(f"{v}_total") for v in values])
    joined = join_on(df, offsets, [*keys, bucket])
    in_bucket = (Window.partitionBy(*keys, bucket).orderBy(*[_col(o) for o in order])
                 .rowsBetween(Window.unboundedPreceding, -1))
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(in_bucket), F.lit(0))).alias(f"{v}_before")
          for v in values],
        *[F.col(f"{v}_total") for v in values])


def row_numbers(df: DataFrame, keys: list[str], order: list, out: str = "row_number",
                bucket: str = BUCKET) -> DataFrame:
    """1-based row number per ``keys`` in ``order`` (ties broken by ``order``)."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    res = prefix_sums(ones, keys, order, ["_one"], bucket)
    return (res.withColumn(out, F.col("_one_before") + 1)
               .withColumn(f"{out}_count", F.col("_one_total"))
               .drop("_one", "_one_before", "_one_total"))


def seeded_hash(id_col: str, seed: int) -> Column:
    """Pseudo-random order key: the first 60 bits of ``md5("{seed}-{id}")``
    (null id: empty), which any SQL engine can compute."""
    text = F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def global_positions(df: DataFrame, id_col: str, seed: int | None = None, out: str = "position",
                     rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, n_rows: int | None = None) -> DataFrame:
    """1-based position of each row in a seeded permutation (or in id order,
    null ids first).

    With a seed the order is ``seeded_hash``: uniform, so its high bits spread
    rows evenly over as many buckets as the row count asks for.
    """
    n = df.count() if n_rows is None else n_rows
    if seed is None:
        keyed = df.withColumn("_h", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2 ** 63))))
        keyed = range_bucket(keyed, ["_h"], rows_per_bucket, n_rows=n)
    else:
        bits = (bucket_count(n, rows_per_bucket) - 1).bit_length()
        keyed = df.withColumn("_h", seeded_hash(id_col, seed)).withColumn(BUCKET, hash_bucket("_h", bits))
    return row_numbers(keyed, [], ["_h", id_col], out=out).drop("_h", BUCKET)


def split_train_valid(df: DataFrame, id_col: str, seed: int, train_percent: float,
                      valid_percent: float) -> DataFrame:
    """Exact-size split: first ``int(p1*n)`` of a seeded permutation -> train,
    last ``int(p2*n)`` -> valid, the rest -> unused.

    Deviations from the modelled code, on purpose: ``int(p2*n) = 0`` gives an
    empty validation set (not every row), and p1 + p2 > 1 is rejected.
    """
    if train_percent < 0 or valid_percent < 0 or train_percent + valid_percent > 1:
        raise ValueError("train_percent + valid_percent must lie in [0, 1]")
    pos = global_positions(df, id_col, seed)
    n = F.col("position_count")
    n_train = F.floor(n * F.lit(train_percent))
    n_valid = F.floor(n * F.lit(valid_percent))
    split = (F.when(F.col("position") <= n_train, F.lit("train"))
              .when(F.col("position") > n - n_valid, F.lit("valid"))
              .otherwise(F.lit("unused")))
    return pos.withColumn("split", split)


def fixed_batches(df: DataFrame, id_col: str, batch_size: int, seed: int | None = None,
                  rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Batches of ``batch_size`` consecutive rows (id order, or shuffled by seed);
    the last batch may be short."""
    pos = global_positions(df, id_col, seed, rows_per_bucket=rows_per_bucket)
    return (pos.withColumn("batch", F.floor((F.col("position") - 1) / batch_size).cast("long"))
               .drop("position_count"))


def assign_folds(df: DataFrame, id_col: str, n_folds: int = 5, seed: int = 2106) -> DataFrame:
    """(id, fold): fold = (position - 1) mod k in a seeded permutation, so the
    folds differ in size by at most one row."""
    pos = global_positions(df.select(id_col), id_col, seed)
    return pos.select(id_col, F.pmod(F.col("position") - 1, F.lit(n_folds)).cast("int").alias("fold"))


def fold_rows(df: DataFrame, folds: DataFrame, fold: int, id_col: str = "id"):
    """(train, valid) rows of one fold: semi / anti join on the fold table."""
    valid_ids = folds.where(F.col("fold") == fold).select(id_col)
    return df.join(valid_ids, id_col, "left_anti"), df.join(valid_ids, id_col, "left_semi")


def fold_row_counts(df: DataFrame, folds: DataFrame, n_folds: int, id_col: str = "id") -> DataFrame:
    """(fold, n_train, n_valid) of every fold in one join: a fold's valid rows
    are those it lists, its train rows all others (rows without a fold too)."""
    per = join_on(df.select(id_col), folds.select(id_col, "fold"), [id_col], "left").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"))
    wide = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[
        F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("n"))), F.lit(0)).alias(f"v{k}") for k in range(n_folds)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("fold"), (F.col("total") - F.col(f"v{k}")).cast("long").alias("n_train"),
                 F.col(f"v{k}").cast("long").alias("n_valid")) for k in range(n_folds)])))


def length_batches(df: DataFrame, id_col: str, zeros_col: str, batch_size: int,
                   seed: int | None = None, bucket_width: int = 128, drop_last: bool = False) -> DataFrame:
    """Length-matched batches (id, batch, length_bucket).

    Rows arrive in sampler order (id order, or a seeded permutation) and go
    to length bucket ``zeros // bucket_width``; a bucket that reaches
    ``batch_size`` rows emits a batch. Full batches are numbered in emission
    order (position of their last row); leftovers are then concatenated in
    bucket order and cut into batches of ``batch_size``.

    Scale: per-bucket row numbers use the bucketed prefix sums (one length
    bucket may hold most rows); leftovers number at most
    n_length_buckets x (batch_size - 1) rows, so their ordering is small.
    """
    # Several sizing actions follow; each stage's input is materialised once
    # so no window is recomputed per action.
    pos = cut_lineage(global_positions(cut_lineage(df.select(id_col, zeros_col)), id_col, seed))
    lb = F.floor(F.col(zeros_col) / bucket_width).cast("int")
    rows = pos.withColumn("length_bucket", lb)
    numbered = row_numbers(range_bucket(rows, ["length_bucket", "position"]), ["length_bucket"], ["position"],
                           out="rn").drop(BUCKET)
    full_n = F.floor(F.col("rn_count") / batch_size) * batch_size
    tagged = cut_lineage(numbered.withColumn("is_full", F.col("rn") <= full_n).withColumn(
        "chunk", F.floor((F.col("rn") - 1) / batch_size).cast("long")))

    full = tagged.where("is_full")
    chunks = full.groupBy("length_bucket", "chunk").agg(F.max("position").alias("last_pos"))
    n_full = chunks.count()  # a scalar; also sizes the buckets
    chunks = row_numbers(range_bucket(chunks, ["last_pos"], n_rows=n_full), [], ["last_pos"], out="emit")
    full_batches = full.join(chunks.select("length_bucket", "chunk", "emit"), ["length_bucket", "chunk"])
    full_out = full_batches.select(id_col, (F.col("emit") - 1).alias("batch"), "length_bucket")

    # Bounded: fewer than batch_size leftovers per length bucket, so one
    # ordered window over them is small.
    everything = Window.partitionBy()
    li = F.row_number().over(everything.orderBy("length_bucket", "rn")) - 1
    left = (tagged.where(~F.col("is_full"))
                  .select(id_col, "length_bucket", li.alias("li"),
                          F.count(F.lit(1)).over(everything).alias("n_left")))
    if drop_last:
        left = left.where(F.col("li") < F.floor(F.col("n_left") / batch_size) * batch_size)
    left_out = left.select(
        id_col, (F.lit(n_full) + F.floor(F.col("li") / batch_size)).cast("long").alias("batch"),
        "length_bucket", "li")
    return full_out.unionByName(left_out.drop("li"))


def trim_batches(df: DataFrame, ids_col: str, batch_col: str = "batch", min_len: int = 2) -> DataFrame:
    """Cut every sequence of a batch to the batch's largest non-zero count,
    when that count exceeds ``min_len``. A batch holds at most batch_size
    rows, so the window per batch is small."""
    nz = F.size(F.array_remove(ids_col, 0))
    m = F.max(nz).over(Window.partitionBy(batch_col))
    return df.withColumn("_m", m).withColumn(
        ids_col, F.when(F.col("_m") > min_len, F.slice(ids_col, 1, F.col("_m"))).otherwise(F.col(ids_col))
    ).withColumn("batch_max_len", F.col("_m")).drop("_m")


def prefix_max(df: DataFrame, keys: list[str], order: list, value: str, bucket: str = BUCKET) -> DataFrame:
    """Running maximum of ``value`` over strictly earlier rows (``{v}_prev_max``,
    null for the first row of a group), with the same bucket scheme as
    ``prefix_sums``."""
    totals = df.groupBy(*keys, bucket).agg(F.max(value).alias("_bm"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, F.max("_bm").over(w).alias("_off_max"))
    joined = join_on(df, offsets, [*keys, bucket])
    in_bucket = (Window.partitionBy(*keys, bucket).orderBy(*[_col(o) for o in order])
                 .rowsBetween(Window.unboundedPreceding, -1))
    local = F.max(value).over(in_bucket)
    prev = F.when(local.isNull(), F.col("_off_max")).when(F.col("_off_max").isNull(), local) \
            .otherwise(F.greatest(local, F.col("_off_max")))
    return joined.select(*[F.col(c) for c in df.columns], prev.alias(f"{value}_prev_max"))
