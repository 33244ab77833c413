"""Vocabulary look-up of token arrays, for vocabularies of any size.

Most positions hold one of few tokens: those of the lowest ids (a bounded
number, so they are sent to every task) are looked up where they are. Rows are
dealt into bundles; each token that is not among the frequent ones travels once
per bundle, meets the vocabulary in a join, and comes back as a row of its
bundle. No position travels alone: a row that lacks nothing is done at once,
and of the others only the array of ids is sent to its bundle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UNK_ID
from ..session import cut_lineage, ship_package

FREQUENT = 65_536          # ids below this are known to every task
FREQUENT_LENGTH = 64       # characters, of such a token
BUNDLE_TOKENS = 200_000    # distinct other tokens in a bundle
BUNDLE_ROWS = 50_000
SLICE_ROWS = 1_000         # rows of an Arrow batch that are worked off together


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that what a worker holds besides one batch
    doesn't grow with it. A batch that is done goes back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        del batch
        pa.default_memory_pool().release_unused()


def _bundled(df: DataFrame, frequent, schema: str) -> DataFrame:
    """Rows (bundle, _key, ids, n_open) and rows (bundle, at, token): ids below 0
    stand for the bundle's token -1 - id."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        bundle = TaskContext.get().partitionId() << 32
        opened: dict[str, int] = {}
        rows = 0

        def tokens() -> pa.RecordBatch:
            n = len(opened)
            return pa.RecordBatch.from_arrays(
                [pa.array([bundle] * n, pa.int64()), pa.nulls(n, key_type), pa.nulls(n, pa.list_(pa.int32())),
                 pa.nulls(n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(opened), pa.string())],
                names=["bundle", "_key", "ids", "n_open", "at", "token"])

        for batch in _slices(batches):
            key_type = batch.column("_key").type
            lists = batch.column("_kept")
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
            ends = ends - ends[0]
            codes = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            found = np.empty(len(flat.dictionary) + 1, dtype=np.int32)
            found[-1] = UNK_ID  # a null token
            for i, t in enumerate(flat.dictionary.to_pylist()):
                at = known.get(t)
                found[i] = at if at is not None else -1 - opened.setdefault(t, len(opened))
            ids = found[codes]
            n_open = np.concatenate([[0], np.cumsum(ids < 0)])
            n = batch.num_rows
            rows += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([bundle] * n, pa.int64()), batch.column("_key"),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                 pa.array((n_open[ends[1:]] - n_open[ends[:-1]]).astype(np.int32)),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())],
                names=["bundle", "_key", "ids", "n_open", "at", "token"])
            if len(opened) >= BUNDLE_TOKENS or rows >= BUNDLE_ROWS:
                yield tokens()
                bundle, rows = bundle + 1, 0
                opened = {}
        if opened:
            yield tokens()

    return df.mapInArrow(deal, schema)


def _filled(rows: DataFrame, schema: str) -> DataFrame:
    """(_key, ids) of rows (bundle, kind, at, token_id) of a bundle's tokens, which
    come first and in order, and (bundle, kind, _key, ids) of its rows."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in _slices(batches):
            bundles, kinds = batch.column("bundle").to_numpy(), batch.column("kind").to_numpy()
            for b in dict.fromkeys(bundles.tolist()):
                if b != current:
                    current, parts = b, []
                tokens, docs = (np.flatnonzero((bundles == b) & (kinds == k)) for k in (0, 1))
                if len(tokens):
                    parts.append(batch.column("token_id").take(pa.array(tokens)).to_numpy(zero_copy_only=False).astype(np.int32))
                if len(docs):
                    parts = [np.concatenate(parts)]
                    lists = batch.column("ids").take(pa.array(docs))
                    ends = lists.offsets.to_numpy()
                    ids = lists.values.to_numpy()[ends[0]:ends[-1]].copy()
                    open_at = ids < 0
                    ids[open_at] = parts[0][-1 - ids[open_at]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_key").take(pa.array(docs)),
                         pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(ids))], names=["_key", "ids"])

    return rows.mapInArrow(fill, schema)


def lookup_ids(df: DataFrame, key: str, kept: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """(key, out): the token array ``kept`` of each row as vocabulary ids, in
    order; a token that the vocabulary lacks is the unknown id, an empty array
    stays empty and a null one becomes empty. ``vocab``: (token, token_id) with
    unique tokens."""
    spark = df.sparkSession
    ship_package(spark)
    head = vocab.where((F.col("token_id") < FREQUENT) & (F.length("token") <= FREQUENT_LENGTH)).select("token", "token_id")
    frequent = spark.sparkContext.broadcast({r["token"]: r["token_id"] for r in head.limit(FREQUENT).collect()})
    name = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).alias("_key"), F.coalesce(kept, F.array().cast("array<string>")).alias("_kept"))
    dealt = cut_lineage(_bundled(base, frequent, f"bundle long, _key {name}, ids array<int>, n_open int, at int, token string"))
    docs = dealt.where("n_open is not null")
    found = dealt.where("token is not null").select("bundle", "at", "token").join(
        vocab.select("token", "token_id"), "token", "left").select(
        "bundle", F.lit(0).alias("kind"), "at", F.coalesce("token_id", F.lit(UNK_ID)).alias("token_id"),
        F.lit(None).cast(name).alias("_key"), F.lit(None).cast("array<int>").alias("ids"))
    waiting = docs.where("n_open > 0").select(
        "bundle", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("token_id"),
        "_key", "ids")
    met = found.union(waiting).repartition("bundle").sortWithinPartitions("bundle", "kind", "at")
    filled = _filled(met.drop("at"), f"_key {name}, ids array<int>")
    done = docs.where("n_open = 0").select("_key", "ids").union(filled)
    return done.select(F.col("_key").alias(key), F.col("ids").alias(out))
