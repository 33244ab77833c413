"""Ranked lexical search, term at a time with limited accumulators.

Documents are dealt into segments of bounded size; a segment's index holds, for
each term of the items, the documents that have it and how often. Per segment
and item the terms are worked off rarest first, each adding its share to the
accumulators of its documents. Once what the remaining terms can add at most is
less than the k-th best partial score, no accumulator is created any more; those
that are there go on to their exact scores. Only k documents per item leave a
task.

Items are worked off in blocks of bounded size, each block against all
documents; its terms, document counts and weights are all that a task is sent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import prefix_sums, range_bucket
from .common import whole, workers_can_import, written

# Terms are runs of ASCII letters and digits and of all characters from U+0080
# on; in UTF-8 the latter are just the bytes from 0x80 on.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

BLOCK_BYTES = 4 << 20        # of item texts in a block
BLOCK_ITEMS = 20_000
SEGMENT_DOCS = 1 << 14
SEGMENT_TERMS = 1 << 20      # occurrences of item terms in a segment

# The scoring formula's.
SCALE, TF_FACTOR, LENGTH_FACTOR, LENGTH_PERCENT = 1_000_000_000, 1000, 20, 50


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # of bytes: A-Z only


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // n_terms


def _segments(docs: DataFrame, vocabulary) -> DataFrame:
    """Per segment one row (term -1: ids and lengths of its documents, counts of
    all documents and terms seen) and one per term (documents by place, counts)."""
    schema = pa.schema([("segment", pa.int64()), ("term", pa.int32()), ("docs", pa.list_(pa.int32())),
                        ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())),
                        ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = vocabulary.value.get
        segment = TaskContext.get().partitionId() << 32
        ids, ns, found, held, n_docs, n_terms = [], [], [], 0, 0, 0

        def index() -> pa.RecordBatch:
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            flat = np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)
            width = max(1, len(found))
            keys, tfs = np.unique(flat * width + np.repeat(np.arange(len(found)), sizes), return_counts=True)
            terms, starts = np.unique(keys // width, return_index=True)
            ends = pa.array(np.concatenate([[0, 0], starts[1:], [len(keys)]] if len(terms) else [[0, 0]]).astype(np.int32))
            k = len(terms)
            one = lambda values, t: pa.array([values] + [None] * k, pa.list_(t))
            return pa.RecordBatch.from_arrays([
                pa.array([segment] * (k + 1), pa.int64()), pa.array([-1, *terms.tolist()], pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array((keys % width).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32))),
                one(ids, pa.int64()), one(ns, pa.int64()),
                pa.array([n_docs] + [None] * k, pa.int64()), pa.array([n_terms] + [None] * k, pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(terms)
                known = [t for t in map(look_up, terms) if t is not None]
                if known:
                    ids.append(doc_id)
                    ns.append(len(terms))
                    found.append(np.array(known, dtype=np.int32))
                    held += len(known)
                if len(ids) >= SEGMENT_DOCS or held >= SEGMENT_TERMS:
                    yield index()
                    segment += 1
                    ids, ns, found, held, n_docs, n_terms = [], [], [], 0, 0, 0
        if n_docs:
            yield index()

    return docs.mapInArrow(build, "segment long, term int, docs array<int>, tfs array<int>, ids array<long>, "
                                  "ns array<long>, n_docs long, n_terms long")


class Top:
    """The k best (score, place in order of ids) of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.empty(0, np.int64)
        self.order = np.empty(0, np.int64)   # the id, nulls last
        self.null = np.empty(0, bool)

    def least(self) -> int:
        """What a document must reach to come in (a tie may, by its id)."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, order: np.ndarray, null: np.ndarray) -> None:
        score, order, null = (np.concatenate(x) for x in ((self.score, score), (self.order, order), (self.null, null)))
        best = np.lexsort((order, null, -score))[:self.k]
        self.score, self.order, self.null = score[best], order[best], null[best]


def accumulate(terms: list[tuple[np.ndarray, np.ndarray, int]], n: int, k: int, least: int) -> tuple[np.ndarray, int]:
    """(scores of ``n`` documents, accumulators created). ``terms``, rarest first:
    (documents, shares, largest share). Scores below ``least``, or below the
    k-th best, may be missing or cut short; all others are exact."""
    scores = np.zeros(n, dtype=np.int64)
    rest = np.cumsum([0] + [t[2] for t in reversed(terms)])[::-1]  # what the terms from j on can add
    alive, j = None, 0
    for j, (docs, shares, _) in enumerate(terms):
        bound = int(rest[j])
        if bound < least or (j and bound < scores.max() and bound < _kth(scores, k)):
            alive = np.flatnonzero(scores)
            break
        scores[docs] += shares
    if alive is None:
        return scores, int(np.count_nonzero(scores))
    for docs, shares, _ in terms[j:]:
        if len(alive) * 16 < len(docs):  # probe the list for each survivor
            at = np.searchsorted(docs, alive)
            at[at == len(docs)] = 0
            hit = docs[at] == alive
            scores[alive[hit]] += shares[at[hit]]
        else:
            scores[docs] += np.where(scores[docs] > 0, shares, 0)
    return scores, len(alive)


def _kth(scores: np.ndarray, k: int) -> int:
    there = scores[scores > 0]
    return int(np.partition(there, len(there) - k)[len(there) - k]) if len(there) >= k else 0


def _block(segments: DataFrame, items: list[tuple[int, list[int]]], shares: dict[int, int], n_docs: int, n_terms: int,
           k: int) -> DataFrame:
    """(_item, doc_id, score): up to k documents per item and task."""
    spark = segments.sparkSession
    shared = spark.sparkContext.broadcast((items, shares, n_docs, n_terms))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        tops = [Top(k) for _ in items]
        for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
            _, _, _, _, ids, ns = next(rows)  # term -1 comes first
            order = np.array([2 ** 63 - 1 if i is None else i for i in ids], dtype=np.int64)
            null = np.array([i is None for i in ids], dtype=bool)
            m = length_part(np.array(ns, dtype=np.int64), n_docs, n_terms)
            index = {}
            for _, term, docs, tfs, _, _ in rows:
                tf = tfs.astype(np.int64)
                share = weights[term] * ((SCALE * tf) // (TF_FACTOR * tf + LENGTH_FACTOR * m[docs]))
                index[term] = (docs, share, int(share.max()))
            for (_, terms), top in zip(items, tops):
                there = [index[t] for t in terms if t in index]
                if there:
                    scores, _ = accumulate(there, len(ids), k, top.least())
                    come = np.flatnonzero(scores >= top.least())
                    if len(come):
                        top.add(scores[come], order[come], null[come])
        for (item, _), top in zip(items, tops):
            if len(top.score):
                yield pa.record_batch([pa.array([item] * len(top.score), pa.int64()),
                                       pa.array(top.order, pa.int64(), mask=top.null), pa.array(top.score, pa.int64())],
                                      names=["_item", "doc_id", "score"])

    dealt = segments.select("segment", "term", "docs", "tfs", "ids", "ns").repartition("segment").sortWithinPartitions(
        "segment", "term")
    return dealt.mapInArrow(search, "_item long, doc_id long, score long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        segment, term = (batch.column(c).to_pylist() for c in ("segment", "term"))
        docs, tfs = batch.column("docs"), batch.column("tfs")
        ends, flat, counts = docs.offsets.to_numpy(), docs.values.to_numpy(), tfs.values.to_numpy()
        begins = tfs.offsets.to_numpy()
        for i in range(batch.num_rows):
            ids, ns = (batch.column(c)[i].as_py() if term[i] < 0 else None for c in ("ids", "ns"))
            yield segment[i], term[i], flat[ends[i]:ends[i + 1]], counts[begins[i]:begins[i + 1]], ids, ns


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score
    above 0 for each row of ``items``; ranks from 1, equal scores by ascending
    doc_id (null last). A document's score is the sum over the item's distinct
    terms of weight times damped count.

    Terms are A-Z lowered. Null or empty texts, and texts without a term, are
    neither found nor counted, and such items get no rows. Items with equal ids
    are ranked each for itself; repeated documents are documents of their own.
    Very long texts are counted whole. Other columns are not read, whatever
    their names. No items or no documents: an empty result.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"),
                         whole(F.col(f"`{item_text}`")).cast("binary").alias("_text"))
    sized = range_bucket(asked.withColumns({"_key": F.xxhash64("_text"), "_size": F.octet_length("_text").cast("long"),
                                            "_one": F.lit(1).cast("long")}), ["item_id", "_key", "_text"])
    placed = prefix_sums(sized, [], ["item_id", "_key", "_text"], ["_size", "_one"])
    numbered = written(placed.select(
        "item_id", "_text", F.col("_one_before").alias("_item"),
        F.floor(F.col("_size_before") / BLOCK_BYTES).alias("_a"), F.floor(F.col("_one_before") / BLOCK_ITEMS).alias("_b")),
        "items")
    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"),
                       whole(F.col(f"`{text}`")).cast("binary").alias("_text"))
    parts = None
    blocks = numbered.select("_a", "_b").distinct().orderBy("_a", "_b").collect()  # a row per 4 MB of items
    for block in blocks:
        held = numbered.where((F.col("_a") == block["_a"]) & (F.col("_b") == block["_b"])).select("_item", "_text")
        number: dict[bytes, int] = {}
        wanted = [(r["_item"], [number.setdefault(t, len(number)) for t in dict.fromkeys(terms_of(bytes(r["_text"])))])
                  for r in held.collect()]  # BLOCK_BYTES bounds this
        segments = written(_segments(body, spark.sparkContext.broadcast(number)), "segments")
        n_docs, n_terms = segments.where("term = -1").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs or not number:
            continue
        counts = segments.where("term >= 0").groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()
        shares = {r["term"]: weight(n_docs, r["df"]) for r in counts}  # a row per term of the block
        rarest = [(i, sorted((t for t in terms if t in shares), key=lambda t: (-shares[t], t))) for i, terms in wanted]
        found = _block(segments, rarest, shares, n_docs, n_terms, k)
        parts = found if parts is None else parts.union(found)
    if parts is None:
        return numbered.where("false").select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                                              F.lit(0).cast("long").alias("score"))
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranks = parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranks.join(numbered.select("item_id", "_item"), "_item").select("item_id", "rank", "doc_id", "score")
