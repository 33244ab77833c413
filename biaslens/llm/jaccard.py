"""Documents with similar sets of word shingles, by T-occurrence search.

Shingles are 64-bit hashes in one global order: rarer first, by a sketch of
fixed size over all documents, then by hash. Any such order is exact; this one
puts shingles that many documents share behind the prefixes.

Two sets that link share at least ``least_met`` of their common shingles inside
the prefixes of both (``prefix_length``). So per prefix shingle the
documents that have it form an inverted list, and a document's partners are
those that occur in enough of its lists.

1. Equal sets become one class.
2. Shingles found in one prefix only are dropped, then classes with too few.
3. A class belongs to the family of its most frequent prefix shingle. It also
   visits each family of a more frequent shingle in whose lists it occurs often
   enough. Of two classes that share enough shingles one visits the other's
   family, or both belong to it, so every link lies within a family.
4. A family is cut into blocks of bounded size. A task holds one block with the
   inverted lists of its prefixes; the classes that may link to it stream by,
   once each, and search the lists (DivideSkip: short lists are merged by a heap
   that skips, long ones are probed by bisection). What occurs often enough is
   compared exactly, unless links found before already connect the two.

A task reports the links that connect something new: at most one per class and
block. A family of L classes is dealt in about L * L / (2 * BLOCK) rows once it
is larger than a block; its pairs are compared in the tasks and never written.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Marks, among, bits_for, marks_of
from .common import bounded_batches, drop_written, whole, workers_can_import, written
from .graph import connected_components
from .wordhash import runs, word_hashes

SKETCH_BITS = 22          # 4 M counters; 4 MB as classes of frequency
SKETCH_BLOCK = 1 << 16
BLOCK = 512               # classes of a block, on average
BLOCK_MEMBERS = 1 << 20   # and members of their sets
SLICE = 1 << 13           # classes that stream by a block in one group
PARITY_CELLS = 256


def shingle_sets(texts, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; A-Z lowered;
    a text of fewer words is one shingle, one without words has none."""
    for h in word_hashes(t.as_py().lower() for t in texts):
        found = np.sort(runs(h, min(k, len(h)))) if len(h) else h
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def least_overlap(n: int, percent: int) -> int:
    """Common shingles that a set of n needs with any partner."""
    return -(-percent * n // 100)


def occurrences(n: int) -> int:
    """Lists of its prefix in which a partner of at least this size must occur."""
    return 1 + n // 50


def least_common(n: int, m: int, percent: int) -> int:
    """Common shingles that sets of n and m need to link."""
    return -(-percent * (n + m) // (100 + percent))


def least_met(n: int, m: int, percent: int) -> int:
    """Common shingles that linking sets of n and m share inside both prefixes:
    the i-th common one is at place n - common + i or before in the first."""
    common = least_common(n, m, percent)
    return min(prefix_length(n, percent) - n, prefix_length(m, percent) - m) + common


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + occurrences(n)


def parities(members: np.ndarray) -> np.ndarray:
    """Of each cell, whether it holds an odd number of the set's members. The
    cells in which two sets differ are at most their symmetric difference."""
    odd = np.bincount((members & np.uint64(PARITY_CELLS - 1)).astype(np.int64), minlength=PARITY_CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(n: int, own: tuple, m: np.ndarray, theirs: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of sizes ``m`` with the parities ``theirs`` (a row each) can
    link to a set of ``n`` with the parities ``own``: the others differ in more
    cells than the symmetric difference of linking sets has members. Exact."""
    apart = np.bitwise_count((theirs ^ np.array(own, dtype=np.int64)).view(np.uint64)).sum(axis=1)
    common = -(-percent * (n + m) // (100 + percent))
    return apart <= n + m - 2 * common


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows (_id, n, digest, th) of documents and rows (block, counts) of the
    sketch: how many documents have a shingle of each cell."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        schema = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("th", pa.int64()),
                            ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            sizes, digests = [], []
            for s in shingle_sets(batch.column("_text"), k):
                np.add.at(counts, (s & mask).astype(np.int64), 1)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 batch.column("_th"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        for b in range(len(counts) // SKETCH_BLOCK):
            part = counts[b * SKETCH_BLOCK:(b + 1) * SKETCH_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())]
                    + [pa.array([b], pa.int32()), pa.array([np.minimum(part, 0xFFFF).astype(np.uint16).tobytes()], pa.binary())],
                    schema=schema)

    return docs.mapInArrow(scan, "_id long, n long, digest binary, th long, block int, counts binary")


def _frequency_classes(sketch: DataFrame) -> np.ndarray:
    """Quarter powers of two of the summed counters, one byte each. Partial
    sketches are summed as they stream by, one block at a time."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = None, None

        def done() -> pa.RecordBatch:
            level = np.minimum(255, np.round(4 * np.log2(total + 1.0))).astype(np.uint8)
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([level.tobytes()], pa.binary())],
                                   names=["block", "level"])

        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts")):
                if b != at:
                    if total is not None:
                        yield done()
                    total, at = np.zeros(SKETCH_BLOCK, dtype=np.uint64), b
                total += np.frombuffer(c.as_py(), dtype=np.uint16)
        if total is not None:
            yield done()

    summed = sketch.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, level binary")
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for r in summed.collect():  # SKETCH_BITS bounds this
        levels[r["block"] * SKETCH_BLOCK:(r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["level"], np.uint8)
    return levels


def _prefixes(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(digest, n, th, prefix): the first shingles of each non-empty set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(len(shared.value) - 1)
        for batch in batches:
            rows = []
            for s, th in zip(shingle_sets(batch.column("_text"), k), batch.column("_th").to_pylist()):
                if len(s):
                    level = shared.value[s & mask]
                    order = np.argsort(level, kind="stable")  # s is sorted already
                    rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), th,
                                 s[order[:prefix_length(len(s), percent)]].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["digest", "n", "th", "prefix"])

    return docs.mapInArrow(cut, "digest binary, n long, th long, prefix array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(digest, members): whole sets of the ``wanted`` classes (digest, th) and
    few others, recomputed from the texts. A bitmap of text hashes leaves the
    others out."""
    spark = docs.sparkSession
    bits = bits_for(wanted.count())
    shared = spark.sparkContext.broadcast((marks_of(wanted, "th", bits), bits))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = Marks(*shared.value), set()
        for batch in batches:
            th = batch.column("_th").to_numpy().view(np.uint64)
            go = [i for i in np.flatnonzero(marked(th)).tolist() if not (int(th[i]) in seen or seen.add(int(th[i])))]
            out = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes())
                   for s in shingle_sets(batch.column("_text").take(pa.array(go, pa.int64())), k)]
            yield pa.record_batch([pa.array([o[j] for o in out], pa.binary()) for j in (0, 1)],
                                  names=["digest", "members"])

    return docs.mapInArrow(build, "digest binary, members binary").groupBy("digest").agg(
        F.first("members").alias("members"))


def divide_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(value, occurrences) of the values in at least ``need`` of the sorted lists."""
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    n_long = min(need - 1, int(need / (0.0085 * log(max(longest, 2), 2) + 1)), len(lists))
    short, long_lists = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
    least = need - n_long
    at = [0] * len(short)
    heap = [(x[0], i) for i, x in enumerate(short) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            count = len(popped)
            for x in long_lists:
                j = bisect_left(x, value)
                count += j < len(x) and x[j] == value
            if count >= need:
                yield value, count
            for i in popped:
                at[i] += 1
        else:
            # no value before the least-th smallest head can occur often enough
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            for i in popped:
                at[i] = bisect_left(short[i], heap[0][0], at[i])
        for i in popped:
            if at[i] < len(short[i]):
                heapq.heappush(heap, (short[i][at[i]], i))


class Block:
    """The classes of one block, searched by those that stream by."""

    def __init__(self, nodes: list[int], tokens: list[np.ndarray], sets: list[np.ndarray], percent: int):
        self.nodes, self.tokens, self.sets, self.percent = nodes, tokens, sets, percent
        self.n = np.array([len(x) for x in sets], dtype=np.int64)
        self.parities = np.array([parities(x) for x in sets])
        self.group = np.arange(len(nodes))  # classes connected so far have one number
        token = np.concatenate(tokens)
        place = np.repeat(np.arange(len(nodes)), [len(t) for t in tokens])
        order = np.lexsort((place, token))
        self.place = place[order]
        found, starts = np.unique(token[order], return_index=True)
        self.spans = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(token)])))

    def links(self, tokens: np.ndarray, members: np.ndarray, own: int | None = None) -> list[int]:
        """Classes that the given one links to, one of each group; they are one
        group from then on. ``own``: its place, if it is of this block; then
        those before it have searched already."""
        n, percent = len(members), self.percent
        may = 100 * np.minimum(self.n, n) >= percent * np.maximum(self.n, n)
        if own is not None:
            may[:own + 1] = False
            may &= self.group != self.group[own]
        if may.any():
            may[may] = may_link(n, tuple(parities(members)), self.n[may], self.parities[may], percent)
        if not may.any():
            return []
        lists = []
        for span in filter(None, map(self.spans.get, tokens.tolist())):
            some = self.place[slice(*span)]
            some = some[may[some]]
            if len(some):
                lists.append(some.tolist())
        met = {m: least_met(n, m, percent) for m in np.unique(self.n[may]).tolist()}
        need = min(met.values())
        if len(lists) < need:
            return []
        hits = [(b, c) for b, c in divide_skip(lists, need) if c >= met[len(self.sets[b])]]
        linked, group = [], None if own is None else self.group[own]
        for b, _ in sorted(hits, key=lambda h: -h[1]):
            if self.group[b] == group:
                continue
            merged = np.sort(np.concatenate([members, self.sets[b]]))
            common = int((merged[1:] == merged[:-1]).sum())
            if 100 * common >= percent * (n + len(self.sets[b]) - common):
                linked.append(b)
                if group is None:
                    group = self.group[b]
                else:
                    self.group[self.group == self.group[b]] = group
        return linked


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((family, block, slice), streams by, node, prefix shingles, members) row by row."""
    for batch in batches:
        key = list(zip(*(batch.column(c).to_pylist() for c in ("_c", "_token", "_block", "_slice"))))
        streams, node = batch.column("_streams").to_pylist(), batch.column("node").to_pylist()
        tokens, members = batch.column("tokens"), batch.column("members")
        for i in range(batch.num_rows):
            yield (key[i], streams[i], node[i], np.array(tokens[i].values.to_numpy()),
                   np.frombuffer(members[i].as_py(), dtype=np.uint64))


def _families(lists: DataFrame, needed) -> DataFrame:
    """(family, node, home) of ``lists`` (token, node, n, c): the classes of each
    family and those that visit it, of families with two or more."""
    home = written(lists.groupBy("node", "n").agg(F.max(F.struct("c", "token")).alias("home")), "homes")
    holds = lists.join(home.select("node", F.col("home").alias("family")), "node").select("token", "family").distinct()
    # a partner shares at least ``needed`` shingles, so its family's lists hold as many
    reached = lists.select("token", "node").join(holds, "token").groupBy("node", "family").agg(
        F.count(F.lit(1)).alias("met")).join(home, "node")
    return written(reached.where((F.col("met") >= needed) & (F.col("family") >= F.col("home"))).select(
        "family", "node", "n", (F.col("family") == F.col("home")).alias("home")), "families")


def _dealt(placed: DataFrame) -> DataFrame:
    """(_c, _token, _block, _slice, _streams, node): each class of a family in
    its block; those of earlier blocks and the visitors stream by it, dealt over
    slices if they are many."""
    sizes = placed.groupBy("family").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes"),
        F.sum(F.when(F.col("home"), F.col("n"))).alias("members")).where("rows > 1").select(
        "family", F.ceil(F.greatest(F.col("homes") / BLOCK, F.col("members") / BLOCK_MEMBERS)).alias("blocks"),
        F.ceil(F.col("rows") / SLICE).alias("slices"))
    at = placed.join(sizes, "family").withColumns({
        "_at": F.pmod(F.xxhash64("node"), F.col("blocks")), "_by": F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices"))})

    def target(block, slice_, streams: bool):
        return F.struct(block.alias("block"), slice_.alias("slice"), F.lit(streams).alias("streams"))

    held = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda k: target(F.col("_at"), k, False))
    first = F.when(F.col("home"), F.col("_at") + 1).otherwise(F.lit(0).cast("long"))
    passing = F.when(first < F.col("blocks"), F.transform(F.sequence(first, F.col("blocks") - 1),
                                                          lambda b: target(b, F.col("_by"), True)))
    none = F.array().cast("array<struct<block:bigint,slice:bigint,streams:boolean>>")
    to = F.concat(F.when(F.col("home"), held).otherwise(none), F.coalesce(passing, none))
    return at.select("family", "node", F.explode(to).alias("to")).select(
        F.col("family.c").alias("_c"), F.col("family.token").alias("_token"), F.col("to.block").alias("_block"),
        F.col("to.slice").alias("_slice"), F.col("to.streams").alias("_streams"), "node")


def _searched(dealt: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each block and with what streams by it. The ``bodies``
    (digest, members) are shuffled on to the blocks from where they were grouped."""
    keys = ["_c", "_token", "_block", "_slice"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(_rows(batches), key=lambda r: r[0]):
            found, block = [], None
            for streams, rows in groupby(group, key=lambda r: r[1]):
                if not streams:
                    held = list(rows)
                    block = Block([r[2] for r in held], [r[3] for r in held], [r[4] for r in held], percent)
                    if key[-1] == 0:  # the other slices hold the same block
                        for i, r in enumerate(held):
                            found += [(r[2], block.nodes[b]) for b in block.links(r[3], r[4], i)]
                elif block is not None:
                    for r in rows:
                        found += [(r[2], block.nodes[b]) for b in block.links(r[3], r[4])]
            if found:
                yield pa.record_batch([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    grouped = dealt.join(bodies, "digest").select(*keys, "_streams", "node", "tokens", "members")
    return grouped.repartition(*keys).sortWithinPartitions(*keys, "_streams", "node").mapInArrow(search, "a long, b long")


def _postings(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, n, token) of the prefix shingles that may be in ``shared``; a
    bitmap keeps the others, by far the most, from travelling."""
    bits = bits_for(shared.count())
    known = classes.sparkSession.sparkContext.broadcast((marks_of(shared, "token", bits), bits))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = Marks(*known.value)
        for batch in batches:
            lists = batch.column("prefix")
            token = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            go = np.flatnonzero(marked(token.view(np.uint64)))
            at = pa.array(row[go])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("n").take(at), pa.array(token[go])],
                                             names=["node", "n", "token"])

    return classes.select("node", "n", "prefix").mapInArrow(pick, "node long, n long, token long")


def linked_classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links) of documents (_id, _text, _th): rows (_id, n,
    digest, th), classes (node, digest), links (a, b) between classes, enough for
    the components of all links."""
    scanned = written(_sets(docs, k), "shingles")
    levels = _frequency_classes(scanned.where("block is not null").select("block", "counts"))
    rows = written(scanned.where("block is null").select("_id", "n", "digest", "th"), "documents")
    drop_written(scanned)
    one = _prefixes(docs, k, percent, levels).groupBy("digest").agg(
        F.first("n").alias("n"), F.min("th").alias("th"), F.first("prefix").alias("prefix"))
    prefixes = written(one.withColumn("node", F.monotonically_increasing_id()), "prefixes")
    rows.sparkSession._jvm.System.gc()  # as in drop_written: the shuffle of the prefixes is done with
    classes = written(prefixes.drop("prefix"), "classes")

    tokens = prefixes.select(F.explode("prefix").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "tokens")
    met = written(_postings(prefixes, shared).join(shared, "token"), "postings")
    drop_written(prefixes)
    drop_written(shared)
    needed = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 50)
    enough = met.groupBy("node", "n").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= needed).select("node")
    lists = written(met.join(enough, "node").select("token", "node", "n", "c"), "lists")
    drop_written(met)

    placed = _families(lists, needed)
    dealt = written(_dealt(placed), "dealt")
    drop_written(placed)
    wanted = written(classes.join(dealt.select("node").distinct(), "node").select("node", "digest", "th"), "wanted")
    # a document's own shingles: as long as its text at most
    own = lists.join(wanted, "node").groupBy("node", "digest").agg(F.collect_list("token").alias("tokens"))
    links = written(_searched(dealt.join(own, "node"), _full_sets(docs, wanted, k), percent), "links")
    for done in (lists, dealt, wanted):
        drop_written(done)
    return rows, classes, links


def _grouped(df: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """(_id, n, digest, th, component, component_id) of every row: component
    names the group, component_id is its smallest id."""
    workers_can_import(df.sparkSession)
    bounded_batches(df.sparkSession)
    body = whole(F.col(f"`{text}`"))
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), body.cast("binary").alias("_text"),
                     F.xxhash64(body).alias("_th"))
    rows, classes, links = linked_classes(docs, k, percent)
    parts = connected_components(links).withColumnRenamed("id", "node")
    named = classes.select("node", "digest").join(parts, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    lowest = rows.where("digest is not null").groupBy("digest").agg(F.min("_id").alias("low")).join(named, "digest")
    ids = lowest.join(lowest.groupBy("component").agg(F.min("low").alias("component_id")), "component").select(
        "digest", "component", "component_id")
    return rows.join(ids, "digest", "left")


def similar_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5,
                      percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Sets are the distinct k-word shingles (A-Z lowered); two documents link
    when 100 * common >= percent * union. component_id: the smallest id
    reachable by links, its own included. Equal texts link. A text without
    words (null, empty) has no shingles, links with nothing and is its own
    component. A row whose id is null takes part in links; its component_id is
    the smallest id of its component, null if none has one. Rows with equal ids
    but other texts are rows of their own.
    """
    return _grouped(df, doc_id, text, k, percent).select(
        F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("digest").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """One document of each group of similar ones, in the columns of ``df``: the
    one with the smallest id (null last, ties by a hash of the text; of rows
    equal in both any one). Documents without words all stay.

    Only ids and text hashes of the documents that go are joined to ``df``, and
    only with rows that a bitmap of them marks; the others stay where they are.
    """
    grouped = _grouped(df, doc_id, text, k, percent).where("component is not null")
    rank = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("i"), F.col("th").alias("t"))
    first = grouped.groupBy("component").agg(F.min(rank).alias("_first"))
    places = grouped.join(first, "component").groupBy("_id", "th").agg(
        F.first(rank == F.col("_first")).alias("stays"), F.count(F.lit(1)).alias("n"))
    moved = written(places.where("not stays or n > 1").select(
        F.col("_id").alias("_gone"), F.col("th").alias("_hash"), "stays"), "copies")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                    F.col(f"`{doc_id}`").cast("long").alias("_id"), F.xxhash64(whole(F.col(f"`{text}`"))).alias("_th"))
    row = row.withColumn("_place", F.xxhash64("_id", "_th"))
    marked = among(moved.select(F.xxhash64("_gone", "_hash").alias("h")), "h", "_place")
    met = row.where(marked).join(moved, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_th") == F.col("_hash")), "left")
    alone = row.where(~marked).select("_row.*").unionByName(met.where("stays is null").select("_row.*"))
    # rows equal in id and text, of which one stays: few, so they are shuffled
    repeated = met.where("stays").dropDuplicates(["_id", "_th"]).select("_row.*")
    return alone.unionByName(repeated)
