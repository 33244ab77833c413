"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is the concatenation of random one-bit hashes (the
sides of random hyperplanes). Vectors are sorted by that key and numbered
through, whatever the partitions; blocks of the order are compared with those
within a window, in double precision. The verified pairs of all passes are
united.

How many passes a vector needs is measured, not assumed. In each pass it is
known after how many leading bits its neighbours all lie inside the window; a
partner at the threshold shares those bits with a probability that follows from
the vector's own margins. Passes go on for the vectors whose chance to have
missed such a partner is above 1 - recall, with wider windows each time, up to
the comparison of all pairs of them: dense groups and crowded cones get the
passes they need, the rest is done after the first ones.

Equal vectors are one class that counts its copies, so that a group of copies
is compared once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import workers_can_import, written
from .graph import connected_components

BITS = 64
BLOCK = 256
CHUNK = 16              # blocks that lie together in one task
FLUSH = 1 << 18         # links passed on at once

_AT = np.linspace(-9, 9, 18001)
_LOG_SHARE = np.log([0.5 * math.erfc(-x / math.sqrt(2)) for x in _AT])


def passes_for(n: int, window: int, cosine: float, recall: float) -> int:
    """Passes after which a pair at the threshold is missed with 1 - recall if
    every bit halves the candidates; more follow where the data are denser."""
    agree = 1 - math.acos(min(1.0, cosine)) / math.pi
    met = agree ** max(0.0, math.log2(max(n, 1) / window))
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def hyperplanes(dim: int, number: int, seed: int) -> np.ndarray:
    """The hyperplanes of a pass."""
    return np.random.default_rng([seed, dim, number]).standard_normal((dim, BITS))


def _classes(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (_id, digest), digest null where the vector can't
    link; classes (node, digest, vec, copies) of equal vectors."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, digests = [], []
            for v in batch.column("_v").to_pylist():
                x = np.array(v, dtype=np.float64) if v and None not in v else np.empty(0)
                ok = len(x) and np.isfinite(x).all() and x.any()
                raw = (x + 0.0).tobytes() if ok else None  # -0.0 equals 0.0
                vecs.append(raw)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(digests, pa.binary()),
                                              pa.array(vecs, pa.binary())], names=["_id", "digest", "vec"])

    cols = df.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{embedding}`").cast("array<double>").alias("_v"))
    rows = written(cols.mapInArrow(pack, "_id long, digest binary, vec binary"), "vectors")
    one = rows.where("digest is not null").groupBy("digest").agg(
        F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
    return rows.select("_id", "digest"), written(one.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=np.float64) for r in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(classes: DataFrame, first: int, passes: int, seed: int) -> DataFrame:
    """(dim, pass, key, tie, node): a row per class and pass from ``first`` on."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                raw = part.column("vec").to_pylist()
                dims = np.array([len(r) // 8 for r in raw])
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    if dim not in planes:
                        planes[dim] = np.hstack([hyperplanes(dim, first + p, seed) for p in range(passes)])
                    sides = (_units([raw[i] for i in at]) @ planes[dim] >= 0).reshape(len(at), passes, BITS)
                    keys = (sides * weights).sum(axis=2, dtype=np.uint64) ^ np.uint64(1 << 63)  # signed order
                    ties, nodes = part.column("tie").take(pa.array(at)), part.column("node").take(pa.array(at))
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([dim] * len(at), pa.int32()), pa.array([first + p] * len(at), pa.int32()),
                             pa.array(keys[:, p].view(np.int64)), ties, nodes],
                            names=["dim", "pass", "key", "tie", "node"])

    return classes.select("node", F.xxhash64("digest").alias("tie"), "vec").mapInArrow(
        project, "dim int, pass int, key long, tie long, node long")


def _numbered(keys: DataFrame, block: int) -> DataFrame:
    """(dim, pass, key, node, pos, block, last): places in each run of the sort
    order, counted through all range partitions; ``last``: the run's last block."""
    order, run = ("dim", "pass", "key", "tie", "node"), ("dim", "pass")
    placed = written(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "vector-keys")
    # at most as many rows as partitions and runs together
    parts = placed.groupBy(*run, "_part").agg(F.min("_id").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*run, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_start"),
                          F.sum("_n").over(Window.partitionBy(*run)).alias("_all"))
    pos = placed.join(F.broadcast(starts), [*run, "_part"]).withColumn("pos", F.col("_id") + F.col("_start"))
    return pos.select(*run, "key", "node", "pos", F.floor(F.col("pos") / block).alias("block"),
                      F.floor((F.col("_all") - 1) / block).alias("last"))


def _dealt(rows: DataFrame, reach: int) -> DataFrame:
    """Each row once for every pair of chunks (home, home + apart) that holds
    blocks within ``reach`` of its own; ``low``: it is of the first chunk."""
    chunk = F.floor(F.col("block") / CHUNK)
    after = F.floor(F.least(F.col("block") + reach, "last") / CHUNK) - chunk
    back = chunk - F.floor(F.greatest(F.col("block") - reach, F.lit(0)) / CHUNK)

    def pairs(n, low: bool):
        return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda d: F.struct(
            (chunk if low else chunk - d).alias("home"), d.alias("apart"), F.lit(low).alias("low")))

    sent = F.concat(pairs(after, True), F.slice(pairs(back, False), F.lit(2), back.cast("int")))
    return rows.withColumn("_to", F.explode(sent)).select("*", "_to.home", "_to.apart", "_to.low").drop("_to")


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.view(np.uint64) ^ b.view(np.uint64)
    x &= ~(x >> np.uint64(1))  # so that no rounding reaches the next power of two
    return BITS - np.frexp(x.astype(np.float64))[1]


def _missed(units: np.ndarray, planes: np.ndarray, bits: np.ndarray, cosine: float) -> np.ndarray:
    """Log of the probability that a partner at the threshold differs in the
    first ``bits`` bits: it lies at cosine * margin from a hyperplane, give or
    take a normal deviate times the sine."""
    margins = np.abs(units @ planes) * (cosine / math.sqrt(max(1 - cosine * cosine, 1e-12)))
    agree = np.cumsum(np.interp(margins, _AT, _LOG_SHARE), axis=1)
    met = np.where(bits > BITS, 0.0, np.exp(np.where(bits > 0, agree[np.arange(len(bits)), np.clip(bits, 1, BITS) - 1], 0.0)))
    return np.log(np.maximum(1 - met, 1e-300))


def _window_links(classes: DataFrame, first: int, passes: int, window: int, cosine: float, seed: int) -> DataFrame:
    """(a, b, missed): verified pairs of blocks within the window, in each pass;
    and, with b null, a class and the log of its chance to have missed a partner
    at the threshold in a pass."""
    block = min(BLOCK, window)
    reach = -(-window // block)
    rows = _numbered(_keys(classes, first, passes, seed), block)
    ends = rows.groupBy("dim", "pass", "block").agg(F.min("key").alias("_least"), F.max("key").alias("_most"))
    below = ends.select("dim", "pass", (F.col("block") + reach + 1).alias("block"), F.col("_most").alias("below"))
    above = ends.select("dim", "pass", (F.col("block") - reach - 1).alias("block"), F.col("_least").alias("above"))
    at = ["dim", "pass", "block"]
    far = ends.select(*at).join(below, at, "left").join(above, at, "left")
    met = rows.join(far, at).join(classes.select("node", "vec"), "node")
    to = ("dim", "pass", "home", "apart")
    dealt = _dealt(met, reach).repartition(*to).sortWithinPartitions(*to, "pos")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, gain) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(gain, pa.float64())],
                                   names=["a", "b", "missed"])

        for (dim, number, _, apart), cols in _chunk_pairs(batches, to):
            nodes, blocks = (np.array(cols[c], dtype=np.int64) for c in ("node", "block"))
            units, low = _units(cols["vec"]), np.array(cols["low"])
            if not apart:
                key = np.array(cols["key"], dtype=np.int64)
                bits = np.zeros(len(key), dtype=np.int64)
                for side in ("below", "above"):
                    there = np.array([x is not None for x in cols[side]])
                    other = np.array([x or 0 for x in cols[side]], dtype=np.int64)
                    bits = np.maximum(bits, np.where(there, _shared_bits(key, other) + 1, 0))
                yield out(nodes, [None] * len(nodes), _missed(units, hyperplanes(dim, number, seed), bits, cosine))
            second = np.flatnonzero(low if not apart else ~low)
            found, n = [], 0
            for b in np.unique(blocks[low]).tolist():
                i = np.flatnonzero(low & (blocks == b))
                j = second[(blocks[second] >= b) & (blocks[second] <= b + reach)]
                near = units[i] @ units[j].T
                x, y = np.nonzero(near >= cosine - 1e-9)
                sure = near[x, y] >= cosine + 1e-9
                x, y = i[x], j[y]
                sure[~sure] = (units[x[~sure]] * units[y[~sure]]).sum(axis=1) >= cosine  # the same whatever the block
                sure &= x < y if not apart else True
                found.append((nodes[x[sure]], nodes[y[sure]]))
                n += len(found[-1][0])
                if n >= FLUSH or (n and b == blocks[low].max()):
                    x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                    yield out(np.minimum(x, y), np.maximum(x, y), np.zeros(n))
                    found, n = [], 0

    return dealt.mapInArrow(compare, "a long, b long, missed double")


def _chunk_pairs(batches: Iterator[pa.RecordBatch], to: tuple):
    """(values of ``to``, columns as lists) of each pair of chunks."""
    names = ("node", "block", "low", "key", "below", "above", "vec")
    current, cols = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in to], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(keys[lo].tolist())
            if key != current:
                if current is not None:
                    yield current, cols
                current, cols = key, {c: [] for c in names}
            for c in names:
                cols[c] += batch.column(c).slice(lo, hi - lo).to_pylist()
    if current is not None:
        yield current, cols


def _links(classes: DataFrame, window: int, cosine: float, recall: float, seed: int) -> DataFrame:
    """(a, b) of verified pairs. Both ends of a pair not yet met surely enough
    are among the classes that go on, so the others need not be there."""
    n, first, found = classes.count(), 0, []
    passes, widest = passes_for(n, window, cosine, recall), 8 * window
    going = classes.withColumn("_missed", F.lit(0.0))
    while n > 1:
        if n <= 2 * passes * window:  # all pairs are no more work
            passes, window = 1, n
        met = written(_window_links(going, first, passes, window, cosine, seed), "vector-links")
        found.append(met.where("b is not null").select("a", "b"))
        if window >= n:
            break
        gain = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("missed").alias("_gain"))
        going = written(going.join(gain, "node").withColumn("_missed", F.col("_missed") + F.col("_gain")).drop("_gain").where(
            F.col("_missed") > math.log(max(1 - recall, 1e-300))), "vectors-going-on")
        n, first, window = going.count(), first + passes, 2 * window
        if window > widest:
            passes = max(1, passes // 2)
    if not found:
        return classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95,
                    window: int = 256, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    n_links: other vectors linked directly, copies counted; component_id: the
    smallest id reachable, its own included; kept: it is that id. Only pairs
    with cosine >= ``cosine`` link; a pair at that bound is found with
    probability ``recall``, closer ones more surely. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and
    keep their own id; vectors of different length don't link. Repeated rows
    link with each other. A null id takes part; it is never a component's id
    unless no id is there (then null, kept).
    """
    workers_can_import(df.sparkSession)
    rows, classes = _classes(df, vec_id, embedding)
    links = written(_links(classes, window, cosine, recall, seed), "vector-links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("node").alias("b"), F.col("copies").alias("_c"))
    degree = both.join(copies, "b").groupBy("a").agg(F.sum("_c").alias("_d")).withColumnRenamed("a", "node")
    parts = connected_components(links).withColumnRenamed("id", "node")
    facts = classes.select("node", "digest", "copies").join(degree, "node", "left").join(parts, "node", "left").select(
        "digest", (F.coalesce("_d", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"))
    lowest = rows.groupBy("digest").agg(F.min("_id").alias("_low")).join(facts, "digest")
    named = lowest.join(lowest.groupBy("component").agg(F.min("_low").alias("component_id")), "component").select(
        "digest", "n_links", "component_id")
    out = rows.join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
