"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed size. Sorting all blocks gives every
distinct one an integer name; the names of adjacent blocks form pairs, which
are sorted and named in the same way, until one name is left of each text. Two
texts have the same name in the same round exactly if they are equal: blocks
and pairs are compared themselves, no hash decides.

Equal blocks of a task are merged before they travel (a task sends a block
once, with a number of its own), so a block that a third of all texts share
reaches the sort once per task, not once per text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, whole, workers_can_import, written

BLOCK = 4096            # bytes
REMEMBERED = 32 << 20   # bytes of blocks (and as many pairs' places) that a task remembers
FLUSH = 2 << 20         # bytes of blocks in an output batch

PLACES = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("own", pa.int64()),
                    ("item", pa.binary()), ("doc_id", pa.int64()), ("sha", pa.binary())])
PLACES_SQL = "row long, n long, pos long, own long, item binary, doc_id long, sha binary"


class _Merged:
    """A task's items (blocks or pairs), each sent once under a number of the
    task while it is remembered."""

    def __init__(self):
        self.first = TaskContext.get().partitionId() << 36
        self.next = self.first
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.clear()

    def clear(self) -> None:
        self.places, self.items, self.size = [], [], 0

    def put(self, row: int, n: int, pos: int, item: bytes, doc_id=None, sha=None) -> None:
        own = self.number.get(item)
        if own is None:
            if self.held > REMEMBERED:
                self.number.clear()
                self.held = 0
            own = self.number[item] = self.next
            self.next += 1
            self.held += len(item) + 100
            self.items.append((own, item))
        self.places.append((row, n, pos, own, doc_id, sha))
        self.size += len(item) + 64

    def batch(self) -> pa.RecordBatch:
        row, n, pos, own, doc_id, sha = zip(*self.places) if self.places else [()] * 6
        k = len(self.items)
        gone = [None] * k
        columns = [[*row, *gone], [*n, *gone], [*pos, *gone], [*own, *(i[0] for i in self.items)],
                   [*[None] * len(row), *(i[1] for i in self.items)], [*doc_id, *gone], [*sha, *gone]]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PLACES)], schema=PLACES)
        self.clear()
        return out


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """Rows (row, n, pos, own, doc_id, sha) of places and rows (own, item) of
    blocks, from documents (_id, _text); doc_id and sha stand at place 0."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        row = merged.first
        for batch in batches:
            for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                text = text.as_py().lower()  # of bytes: A-Z only
                n = max(1, -(-len(text) // size))
                for pos in range(n):
                    block = text[pos * size:(pos + 1) * size]
                    if pos:
                        merged.put(row, n, pos, block)
                    else:
                        merged.put(row, n, 0, block, doc_id, hashlib.sha256(text).digest())
                    if merged.size > FLUSH:
                        yield merged.batch()
                row += 1
        yield merged.batch()

    return docs.mapInArrow(cut, PLACES_SQL)


def _pairs(named: DataFrame) -> DataFrame:
    """The next round's rows, from places (row, n, pos, name): adjacent names
    side by side; the last of an odd number stands alone, beside 0."""
    name = F.col("name")
    beside = named.groupBy("row", "n", F.floor(F.col("pos") / 2).alias("pos")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, name)).alias("a"),
        F.max(F.when(F.col("pos") % 2 == 1, name)).alias("b"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for batch in batches:
            for row, n, pos, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                merged.put(row, (n + 1) // 2, pos, struct.pack(">qq", a, b or 0))
                if merged.size > FLUSH:
                    yield merged.batch()
        yield merged.batch()

    return beside.select("row", "n", "pos", "a", "b").mapInArrow(pair, PLACES_SQL)


def _names(rows: DataFrame) -> DataFrame:
    """(own, name): the items of each range sorted, equal ones under one name.
    Ranges keep equal items together; a name is the number of its range, then
    its rank there (from 1, so 0 is no name)."""
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = TaskContext.get().partitionId() << 36, None
        for batch in batches:
            names = []
            for item in batch.column("item"):
                item = item.as_py()
                if item != last:
                    name, last = name + 1, item
                names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(names, pa.int64())], names=["own", "name"])

    # the ranges go by the start of an item and a hash, so that the sample which
    # Spark draws for them holds no whole blocks
    items = rows.where("item is not null").select("own", "item")
    ranges = items.repartitionByRange(F.substring("item", 1, 16), F.xxhash64("item"))
    return ranges.sortWithinPartitions("item").mapInArrow(rank, "own long, name long")


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, doc_id, sha, round, name) of documents (_id, _text): (round, name)
    is the same exactly for texts that are equal after lower-casing A-Z."""
    rows = written(_blocks(docs, size), "blocks")
    first, done, step = rows, [], 0
    while True:
        names = _names(rows)
        placed = rows.where("row is not null").select("row", "n", "pos", "own").join(names, "own").select(
            "row", "n", "pos", "name")
        named = written(placed, "names")
        done.append(named.where("n = 1").select("row", F.lit(step).alias("round"), "name"))
        if step:
            drop_written(rows)
        if named.where("n > 1").limit(1).count() == 0:
            break
        step += 1
        rows = written(_pairs(named.where("n > 1")), "pairs")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    out = written(first.where("pos = 0").select("row", "doc_id", "sha").join(found, "row"), "identities")
    drop_written(first)
    return out


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``df``.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and empty texts are equal to each other. Of equal texts the row with
    the largest doc_id stays (null is the smallest; of rows equal in doc_id and
    text one). keep_id: the doc_id of the row that stays; text_sha256: hex
    digest of the lower-cased text. A text of any length is cut into blocks, so
    a very long one only takes more rounds. Other columns of ``df``, whatever
    their names, are not read. An empty table gives an empty result.
    """
    workers_can_import(df.sparkSession)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("_id"),
                     whole(F.col(f"`{text}`")).cast("binary").alias("_text"))
    members = identities(docs, block)
    groups = written(members.groupBy("round", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size")), "groups")
    met = members.join(groups, ["round", "name"])
    return met.select(F.col("doc_id").alias(doc_id), F.col("stays.doc_id").alias("keep_id"), "group_size",
                      (F.col("row") == F.col("stays.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` that stay, in its own columns. Only the ids and
    digests of rows that go, or that occur twice in both, meet ``df``."""
    found = exact_duplicates(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")),
                             block=block)
    places = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_c"))
    moved = written(places.where("not _stays or _c > 1").select(
        F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_digest"), "_stays"), "moved")
    upper = whole(F.col(f"`{text}`"))
    sha = F.unhex(F.sha2(F.translate(upper, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     F.col(f"`{doc_id}`").cast("long").alias("_id"), sha.alias("_sha"))
    met = rows.join(moved, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_digest")), "left")
    once = met.where("_stays").dropDuplicates(["_id", "_sha"]).select("_row.*")
    return met.where("_stays is null").select("_row.*").unionByName(once)
