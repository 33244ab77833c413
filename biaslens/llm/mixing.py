"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key divided by its quality weight; the
documents with the smallest keys of a source are a weighted sample without
replacement. A source takes complete epochs first; what is left of its target
is filled in key order until the running size meets it.

Only DataFrame functions. One pass over the texts writes narrow facts; these
are range-partitioned by (source, key), so a source with a third of all rows
lies in many partitions; sums per partition, a running sum over those and a
window inside the one partition where a target is met give each source's
cut-off key. The cut-offs (a row per source) decide every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole, words, written
from .quality import SYMBOLS, symbol_count

MIN_WEIGHT = 0.05


def quality_weight(text: str) -> Column:
    """Share of a text's word characters that are no symbols, 0.05 at least."""
    t = whole(text)
    chars = F.length(F.array_join(words(text), ""))
    marks = F.when(t.rlike(f"[{SYMBOLS}]"), symbol_count(t)).otherwise(0)
    return F.greatest(F.lit(MIN_WEIGHT), 1 - marks.cast("double") / F.greatest(chars, F.lit(1)).cast("double"))


def _fingerprint(doc_id: str, text: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"),
                          whole(text)).cast("binary"))


def _key(tie: Column, weight: Column) -> Column:
    """-ln(u) / weight, u from the first 52 bits of the fingerprint."""
    u = (F.conv(F.substring(tie, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating. The
    targets share ``share`` of all sizes by weight; none exceeds ``most`` times
    its source, the excess going to the others by weight. With sources sorted
    by cap / weight, the common level is the largest of (total - caps before) /
    (weights from here on); one row per source, so one small window.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.select(
        "source", "source_size", rank.alias("_rank"),
        listed[(rank - 1) % len(weights)].alias("_w"),
        (share * F.sum("source_size").over(every)).alias("_total"),
        (most * F.col("source_size")).alias("_cap"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    level = ((F.col("_total") - F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0.0)))
             / F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    return ranked.withColumn("_level", level).select(
        "source", "source_size",
        F.least(F.col("_cap"), F.max("_level").over(every) * F.col("_w")).alias("target"))


def cut_offs(facts: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """(source, source_size, target, epochs, cut): documents whose (key, tie)
    is at most ``cut`` are taken once more than ``epochs`` times."""
    order = F.struct("_key", "_tie")
    ranged = written(facts.select("source", "size", "_key", "_tie")
                     .repartitionByRange("source", "_key", "_tie")
                     .withColumn("_part", F.spark_partition_id()), "mix-order")
    parts = written(ranged.groupBy("source", "_part").agg(
        F.sum("size").alias("_size"), F.max(order).alias("_last")), "mix-parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = written(targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "_rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("source").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    placed = _by_source(parts.withColumn("_before", before), plan.select("source", "_rest"))
    # the partition in which the running size passes the rest of the target
    edge = placed.where((F.col("_before") < F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_size")))
    e = edge.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_before", "_rest")
    inside = ranged.join(e, ranged["source"].eqNullSafe(e["_s"]) & (ranged["_part"] == e["_p"]))
    run = F.coalesce(F.sum("size").over(Window.partitionBy("source", "_part").orderBy("_key", "_tie").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    # a document is taken if that brings the sum nearer to the target
    last = inside.withColumn("_run", F.col("_before") + run).where(
        F.col("_run") + F.col("size") / 2 <= F.col("_rest")).groupBy("source").agg(F.max(order).alias("_cut"))
    full = placed.where(F.col("_before") + F.col("_size") <= F.col("_rest")).select(
        "source", F.col("_last").alias("_cut"))
    cuts = full.unionByName(last).groupBy("source").agg(F.max("_cut").alias("_cut"))
    return written(_by_source(plan, cuts).drop("_rest"), "mix-cuts")


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the source, null being a source like any other."""
    r = right.withColumnRenamed("source", "_source")
    return left.join(r, left["source"].eqNullSafe(r["_source"]), "left").drop("_source")


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          keep: tuple = ("doc_id",), weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0,
          seed: str = "mix") -> DataFrame:
    """The ``keep`` columns of each document with size (words), source_size,
    target, taken (words the mix takes, repeats counted) and copies.

    Targets: see ``source_targets``. Keys come from a hash of seed, id and text,
    so reruns agree. Rows with equal id, source and text are equal: in the one
    place where a target is met they are taken or left together. Null text:
    size 0, taken 0; null source: a source of its own, the last; null id: an id
    like any other. Empty table: empty result. Columns of ``keep`` that are
    named like a result column give way to it.
    """
    results = ("size", "source_size", "target", "taken", "copies")
    kept = [c for c in keep if c.lower() not in results]
    base = df.select(
        *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(kept)],
        F.col(source).alias("source"), F.size(words(text)).cast("long").alias("size"),
        quality_weight(text).alias("_weight"), _fingerprint(doc_id, text, seed).alias("_tie"))
    facts = written(base.withColumn("_key", _key(F.col("_tie"), F.col("_weight"))).drop("_weight"), "mix-facts")
    decided = _by_source(facts, cut_offs(facts, weights, share, most))
    extra = F.coalesce(F.struct("_key", "_tie") <= F.col("_cut"), F.lit(False)).cast("long")
    copies = F.when(F.col("size") > 0, F.col("epochs") + extra).otherwise(F.lit(0))
    return decided.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(kept)],
        "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mixture(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
            **settings) -> DataFrame:
    """The mixed documents themselves, each as often as it is taken, in the
    columns of ``df``. Documents without words are left out (they add nothing
    to any target). Columns named like a result column of ``mixed`` survive."""
    columns = df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    inner = df.select(row, *[F.col(f"`{c}`").alias(a) for c, a in ((doc_id, "_id"), (text, "_text"), (source, "_from"))])
    chosen = mixed(inner, "_id", "_text", "_from", keep=("_row",), **settings)
    return chosen.where(F.col("copies") > 0).select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
