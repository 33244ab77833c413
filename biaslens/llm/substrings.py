"""Removal of passages that occur more than once, by super-k-mer partitioning.

A window is ``window`` consecutive words of a document. Its minimiser is the
run of ``minimiser`` words with the smallest hash inside it (the first of
equals), so equal windows have equal minimisers at the same place. Consecutive
windows that share a minimiser travel as one packed string of words to the
bucket of that minimiser; there the windows of all strings are ranked
by their words and equal ones counted, not by hash.

1. Minimisers are counted (pre-aggregated per batch). A window can only repeat
   if its minimiser does.
2. Repeated minimisers are marked in a bitmap of bounded size; strings whose
   minimiser is not marked stay at home. A wrong mark only lets a string
   travel, so the bitmap never changes the result.
3. Equal strings are merged with their number first, so a group of copies
   enters its bucket once. Strings of a minimiser that more than ``hot_least``
   of them share are cut into single windows, which go to buckets of their own
   hash. That number is the same at every size, so a bucket is bounded; a sparse
   bitmap names these minimisers, and a wrong mark only cuts more strings.
4. Repeated windows go back to the documents that hold their string; covered
   words are removed.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import BLOCK_BITS, MAX_BITS, Marks, bits_for, marks_of
from .common import BATCH_BYTES, bounded_batches, drop_written, whole, workers_can_import, written
from .wordhash import remixed, runs, word_hashes

HOT_LEAST = 50_000            # a minimiser of more super-k-mers than this is hot
SPARSE_BITS = 8               # doublings of the bitmap of hot ones: few wrong marks
ROW_BYTES = 200               # of a string in a task besides its words
WORDS = 200_000               # of the strings whose windows are compared at once; more if a bucket has more


def super_kmers(words: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window) of each super-k-mer of a text's word
    hashes; a minimiser
    stands for the hash of its words."""
    if len(words) < window:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    h = runs(words, minimiser)
    span = window - minimiser + 1
    at = np.empty(len(words) - window + 1, dtype=np.int64)
    for lo in range(0, len(at), 1 << 16):  # bounded memory for very long texts
        part = sliding_window_view(h[lo:lo + (1 << 16) + span - 1], span)
        at[lo:lo + len(part)] = part.argmin(axis=1)
    at += np.arange(len(at))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return remixed(h[at[first]]), first, last


def _minimiser_counts(docs: DataFrame, window: int, minimiser: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [super_kmers(w, window, minimiser)[0] for w in word_hashes(t.as_py() for t in batch.column("_text"))]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield pa.record_batch([pa.array(np.asarray(h, np.uint64).view(np.int64)),
                                   pa.array(np.asarray(n, np.int64))], names=["h", "n"])

    return docs.select("_text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _strings(docs: DataFrame, window: int, minimiser: int, bits: int, blocks: dict, hot_bits: int,
             hot_blocks: dict) -> DataFrame:
    """(h, _key, start, digest, packed): the super-k-mers that may hold repeated
    windows; the digest of the packed string names it afterwards."""
    shared = docs.sparkSession.sparkContext.broadcast((blocks, bits, hot_blocks, hot_bits))

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, bits, hot_blocks, hot_bits = shared.value
        marked, hot = Marks(blocks, bits), Marks(hot_blocks, hot_bits)
        out: list[tuple] = []
        size = 0

        def strings() -> pa.RecordBatch:
            h, keys, starts, packed = zip(*out) if out else [[]] * 4
            digests = [hashlib.blake2b(p, digest_size=16).digest() for p in packed]
            return pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(keys, pa.binary()), pa.array(starts, pa.int32()),
                 pa.array(digests, pa.binary()), pa.array(packed, pa.binary())],
                names=["h", "_key", "start", "digest", "packed"])

        for batch in batches:
            hashes = word_hashes(t.as_py() for t in batch.column("_text"))
            for key, text, hashed in zip(batch.column("_key"), batch.column("_text"), hashes):
                h, first, last = super_kmers(hashed, window, minimiser)
                go = np.flatnonzero(marked(h))
                if not len(go):
                    continue
                key, words, is_hot = key.as_py(), text.as_py().split(), hot(h)
                for i in go.tolist():
                    a, b = int(first[i]), int(last[i])
                    if is_hot[i]:
                        for w in range(a, b + 1):
                            packed = b" ".join(words[w:w + window])
                            out.append((_home(packed), key, w, packed))
                            size += len(packed) + ROW_BYTES
                    else:
                        packed = b" ".join(words[a:b + window])
                        out.append((int(h[i].view(np.int64)), key, a, packed))
                        size += len(packed) + ROW_BYTES
                    if size > BATCH_BYTES:  # strings overlap: many times the text, if hot
                        yield strings()
                        out.clear()
                        size = 0
        yield strings()

    return docs.mapInArrow(travel, "h long, _key binary, start int, digest binary, packed binary")


def _home(packed: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(packed)).view(np.int64))


class _Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_windows(strings: list[bytes], times: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last) of the runs of windows that occur again in the packed
    strings; string i occurs ``times[i]`` times.

    Words become numbers, and runs of 2, 4, 8 ... words get the rank of their two
    halves, so windows are equal exactly if their ranks are; a few arrays as long
    as the words take the place of the windows themselves.
    """
    number, ids, ends = _Numbers(), array("q"), []
    for s in strings:
        ids.extend(map(number.__getitem__, s.split()))
        ends.append(len(ids))
    ends = np.array(ends, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    rank, length = np.frombuffer(ids, dtype=np.int64), 1
    while length < window:
        step = min(length, window - length)
        pairs = rank[:-step] * (len(rank) + 1) + rank[step:]
        rank, length = np.unique(pairs, return_inverse=True)[1], length + step
    # windows that start in one string and end in the next don't count
    owner = np.repeat(np.arange(len(strings)), ends - starts - window + 1)
    at = np.arange(len(rank))
    inside = np.ones(len(rank) + window - 1, dtype=bool)
    for back in range(1, window):
        inside[ends - back] = False
    at = at[inside[:len(rank)]]
    found = rank[at]
    again = (np.bincount(found)[found] > 1) | (np.array(times)[owner] > 1)
    at, owner = at[again], owner[again]
    if not len(at):
        return at, at, at
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner) > 0))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
    return owner[first], at[first] - starts[owner[first]], at[last] - starts[owner[last]]


def _repeated(strings: DataFrame, window: int) -> DataFrame:
    """(digest, lo, hi): runs of repeated windows inside each distinct string.
    A bucket's strings come one after the other (sorted by bucket), so a task
    holds one large bucket at a time, of distinct strings, or some small ones
    together: equal windows lie in one bucket, so that finds the same."""
    merged = strings.groupBy("h", "digest", "packed").agg(F.count(F.lit(1)).alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held: list[tuple] = []
        size = 0
        for _, bucket in groupby(rows, key=lambda r: r[0]):
            for row in bucket:
                held.append(row)
                size += row[2].count(b" ") + 1
            if size > WORDS:
                yield from runs_of(held)
                held, size = [], 0
        if held:
            yield from runs_of(held)

    def runs_of(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, digests, packed, n = zip(*held)
        string, lo, hi = repeated_windows(packed, n, window)
        for part in range(0, len(string), 5000):
            some = slice(part, part + 5000)
            yield pa.record_batch([pa.array([digests[i] for i in string[some].tolist()], pa.binary()),
                                   pa.array(lo[some], pa.int32()), pa.array(hi[some], pa.int32())],
                                  names=["digest", "lo", "hi"])

    placed = merged.repartition("h").sortWithinPartitions("h")
    return placed.select("h", "digest", "packed", "n").mapInArrow(count, "digest binary, lo int, hi int")


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35,
                      minimiser: int = 8, hot_least: int = HOT_LEAST) -> DataFrame:
    """(_key, spans): word spans [from, to) of each document that lie in a window
    found elsewhere too. ``_key`` identifies id and text (``document_key``)."""
    spark = df.sparkSession
    workers_can_import(spark)
    bounded_batches(spark)
    docs = df.select(document_key(doc_id, text).alias("_key"), whole(text).cast("binary").alias("_text"))
    repeated = written(_minimiser_counts(docs, window, minimiser).where("n > 1"), "minimisers")
    often = F.col("n") > hot_least
    size, n_hot = repeated.agg(F.count(F.lit(1)), F.count_if(often)).first()
    bits, hot_bits = bits_for(size), min(MAX_BITS, bits_for(n_hot) + SPARSE_BITS) if n_hot else BLOCK_BITS
    hot_blocks = marks_of(repeated.where(often), "h", hot_bits) if n_hot else {}
    strings = written(_strings(docs, window, minimiser, bits, marks_of(repeated, "h", bits), hot_bits, hot_blocks),
                      "super-kmers")
    drop_written(repeated)
    found = _repeated(strings, window)
    spans = strings.select("_key", "start", "digest").join(found, "digest").select(
        "_key", (F.col("start") + F.col("lo")).alias("from"),
        (F.col("start") + F.col("hi") + window).alias("to")).distinct()
    covered = written(spans.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans")),
                      "spans")
    drop_written(strings)
    return covered


def document_key(doc_id: str, text: str):
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit("|"),
                                  whole(F.col(f"`{text}`"))).cast("binary")))


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35,
                    minimiser: int = 8, hot_least: int = HOT_LEAST) -> DataFrame:
    """``df`` with n_words, n_removed and kept_text: the words outside repeated
    windows, joined by one space.

    A window repeats if its word sequence starts anywhere else, in the same
    document too; windows are judged on the input. One output row per input
    row; rows with equal id and text count as separate occurrences, so their
    windows repeat. Null or empty text and texts shorter than a window: nothing
    removed. Null id: an id like any other. Input columns of the three names
    are replaced, all others kept.
    """
    results = ("n_words", "n_removed", "kept_text")
    rest = [F.col("_row").getField(c).alias(c) for c in df.columns if c.lower() not in results]
    return _cleaned(df, doc_id, text, window, minimiser, hot_least).select(*rest, "_out.*")


def _cleaned(df: DataFrame, doc_id: str, text: str, window: int = 35, minimiser: int = 8,
             hot_least: int = HOT_LEAST) -> DataFrame:
    """(_row, _out): the whole row, and its counts and kept text. The text
    travels once, inside the row."""
    spans = repeated_passages(df, doc_id, text, window, minimiser, hot_least)
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                    document_key(doc_id, text).alias("_key"))

    @F.arrow_udf("n_words long, n_removed long, kept_text string")
    def remove(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, spans in texts:
            out = []
            for t, s in zip(text, spans):
                words, s = t.as_py().split(), s.as_py()
                kept = words
                if s:
                    keep = np.ones(len(words), dtype=bool)
                    for span in s:
                        keep[span["from"]:span["to"]] = False
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                out.append({"n_words": len(words), "n_removed": len(words) - len(kept),
                            "kept_text": b" ".join(kept).decode("utf-8", errors="replace")})
            yield pa.array(out, type=pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()),
                                                ("kept_text", pa.string())]))

    body = whole(F.col("_row").getField(text)).cast("binary")
    marked = _marked(spans, "_key")
    met = row.where(marked).join(spans, "_key", "left")
    alone = row.where(~marked).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return met.unionByName(alone).select("_row", remove(body, F.col("spans")).alias("_out"))


def _marked(keyed: DataFrame, key: str) -> Column:
    """Whether a row's key may be one of ``keyed``, from a bitmap of bounded size:
    the other rows need not travel to meet their partner. The first eight bytes
    of a key stand for it; a wrong mark only lets a row travel."""
    first = keyed.select(F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").alias("h"))
    bits = bits_for(first.count())
    shared = keyed.sparkSession.sparkContext.broadcast((marks_of(first, "h", bits), bits))

    @F.arrow_udf("boolean")
    def among(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = Marks(*shared.value)
        for part in keys:
            h = np.frombuffer(b"".join(k[:8] for k in part.to_pylist()), dtype=">u8").astype(np.uint64)
            yield pa.array(marks(h))

    return among(F.col(key))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars",
                 **settings) -> DataFrame:
    """The documents in the columns of ``df``, repeated words removed. A text
    without repeats stays as it is, white space included; one that loses all
    its words becomes empty. ``n_chars`` (if there) counts the new text."""
    done = _cleaned(df, doc_id, text, **settings)
    same = F.col("_out.n_removed") == 0
    new = {text: F.when(same, F.col("_row").getField(text)).otherwise(F.col("_out.kept_text"))}
    if n_chars in df.columns:
        new[n_chars] = F.when(same, F.col("_row").getField(n_chars)).otherwise(
            F.length("_out.kept_text")).cast(df.schema[n_chars].dataType)
    return done.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in df.columns])
