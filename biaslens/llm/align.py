"""Alignment of two tokenizations of the same texts, by interval coalescing.

Each token is the interval of bytes that it covers. All intervals of A and B
are sorted by their start (lexsort); where a start reaches the running maximum
of the ends before it (maximum.accumulate) both tokenizations end a token, and a
new group begins. Within a group, A's tokens are expanded to the B tokens that
they overlap: the links.

Both tokenizers end a token before a space that stands between two other
characters, so texts are cut there, and a part that a worker has met is looked
up instead of encoded again; a batch's new parts are encoded and coalesced
together. Of a vocabulary that has a piece across such a space the whole texts
are the parts.

Corpus-wide counts of id pairs: documents are dealt into bundles of bounded
size; a bundle sends each of its pairs once, with the number of its documents
that hold it linked, and gets back the corpus-wide counts of just these pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bytelevel as bl
from .common import drop_written, whole, workers_can_import, written

KEPT_PARTS = 300_000        # parts that a worker remembers
KEPT_BYTES = 96 << 20       # and their bytes, about
BUNDLE = 2_000_000          # distinct pairs per document, summed over a bundle's documents
CHUNK = 1 << 20             # characters that are worked off together

BETWEEN = re.compile(r"(?<=\S) (?=\S)")
SPACE_MARK = "▁"


class ByteLevel:
    """Vocabulary A: a byte-level tokenizer file of the tokenizers library."""

    def __init__(self, spec: str):
        self.model = Tokenizer.from_str(spec)
        self.model.encode_special_tokens = True
        self.model.no_padding()
        self.model.no_truncation()
        table = bl.character_bytes()
        entries = self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()

    def __call__(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]


class Pieces:
    """Vocabulary B: a sentencepiece model, which puts a space before a text."""

    def __init__(self, proto: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes = []
        self.cut_at_spaces = True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace(SPACE_MARK, " ").encode("utf-8"))
                self.cut_at_spaces &= SPACE_MARK not in piece.lstrip(SPACE_MARK)

    def __call__(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode(parts, num_threads=1)


def coalesce(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A places, B places of the
    links) of two tokenizations of the same bytes, given their tokens' sizes."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a_start, b_start = a_end - a_size, b_end - b_size
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat(np.array([0, 1], np.int8), [len(a_size), len(b_size)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    opens = np.zeros(len(order), dtype=bool)
    opens[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(opens)
    first = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - first
    a_link = np.repeat(np.arange(len(a_size)), n)
    b_link = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(a_link))
    return group[:len(a_size)], group[len(a_size):], a_link, b_link


def _joined(a_ids, b_ids, a_group, b_group, parts_a, parts_b) -> list[str]:
    """Each part's groups as text: A ids, a bar, B ids; groups with semicolons between."""
    side = np.repeat(np.array([0, 1], np.int8), [len(a_ids), len(b_ids)])
    group = np.concatenate([a_group, b_group])
    order = np.lexsort((side, group))  # stable: within a side in text order
    side, group, ids = side[order], group[order], np.concatenate([a_ids, b_ids])[order]
    mark = np.full(len(ids), 2, dtype=np.int8)
    mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    named = [f"{i}{',|;'[m]}" for i, m in zip(ids.tolist(), mark.tolist())]
    ends = np.cumsum(parts_a + parts_b).tolist()
    return ["".join(named[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends)]


class Aligner:
    """Aligned parts of texts; one per Python worker and task."""

    def __init__(self, spec: str, proto: bytes):
        self.a, self.b = ByteLevel(spec), Pieces(proto)
        self.a_size = np.array(list(map(len, self.a.bytes)), dtype=np.int64)
        self.b_size = np.array(list(map(len, self.b.bytes)), dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []       # groups of each part
        self.table = np.zeros((1 << 12, 5), dtype=np.int64)  # n_a, n_b, n_groups, first link, links (n_a -1: not aligned)
        self.links = np.zeros(1 << 14, dtype=np.int64)
        self.n_links = self.held = 0

    def parts(self, text: str) -> list[str]:
        if not self.b.cut_at_spaces:
            return [text]
        units = text.split(" ")
        for u in units:
            if not u or u[0].isspace() or u[-1].isspace():
                return BETWEEN.split(text)
        return units

    def learn(self, parts: list[str]) -> None:
        """Encodes and coalesces parts that are not known yet."""
        a_lists, b_lists, good = self.a(parts), self.b(parts), []
        for p, x, y in zip(parts, a_lists, b_lists):
            raw = b" " + p.encode("utf-8")
            good.append(b"".join(map(self.a.bytes.__getitem__, x)) == raw == b"".join(map(self.b.bytes.__getitem__, y)))
        rows = np.zeros((len(parts), 5), dtype=np.int64)
        rows[:, 0] = -1
        texts = [""] * len(parts)
        at = np.flatnonzero(good)
        if len(at):
            a_lists, b_lists = [a_lists[i] for i in at], [b_lists[i] for i in at]
            n_a, n_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (a_lists, b_lists))
            a_ids, b_ids = (np.array([i for x in lists for i in x], dtype=np.int64) for lists in (a_lists, b_lists))
            a_group, b_group, a_link, b_link = coalesce(self.a_size[a_ids], self.b_size[b_ids])
            last = a_group[np.cumsum(n_a) - 1]  # of each part; parts end together in A and B
            ends = np.searchsorted(a_link, np.cumsum(n_a))
            begins = np.concatenate([[0], ends[:-1]])
            rows[at] = np.stack([n_a, n_b, np.diff(last, prepend=-1), self.n_links + begins, ends - begins], axis=1)
            pairs = a_ids[a_link] * len(self.b_size) + b_ids[b_link]
            self.links = self._room(self.links, self.n_links, len(pairs))
            self.links[self.n_links:self.n_links + len(pairs)] = pairs
            self.n_links += len(pairs)
            for i, t in zip(at.tolist(), _joined(a_ids, b_ids, a_group, b_group, n_a, n_b)):
                texts[i] = t
        n = len(self.texts)
        self.table = self._room(self.table, n, len(rows))
        self.table[n:n + len(rows)] = rows
        self.known.update(zip(parts, range(n, n + len(parts))))
        self.texts += texts
        self.held += sum(map(len, parts)) + sum(map(len, texts)) + 8 * int(rows[:, 4].sum()) + 250 * len(parts)

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        out = np.zeros((max(2 * len(array), used + more), *array.shape[1:]), dtype=array.dtype)
        out[:used] = array[:used]
        return out

    def __call__(self, texts: list[str]) -> Iterator[tuple]:
        """Per text (n_a, n_b, n_groups, pairs, how often each, digest of the
        groups), or None if it has no tokens."""
        if len(self.known) > KEPT_PARTS or self.held > KEPT_BYTES:
            self.forget()
        cut = [self.parts(t) if t else [] for t in texts]
        new = {p: None for parts in cut for p in parts}
        if new := [p for p in new if p not in self.known]:
            self.learn(new)
        for parts in cut:
            at = np.array(list(map(self.known.__getitem__, parts)), dtype=np.int64)
            rows = self.table[at]
            if not len(rows) or rows[:, 0].min() < 0:
                yield None
                continue
            n_a, n_b, n_groups, _, n_links = rows.sum(axis=0).tolist()
            shift = np.cumsum(rows[:, 4]) - rows[:, 4]
            pairs, times = np.unique(self.links[np.repeat(rows[:, 3] - shift, rows[:, 4]) + np.arange(n_links)],
                                     return_counts=True)
            groups = ";".join(map(self.texts.__getitem__, at.tolist()))
            yield n_a, n_b, n_groups, pairs, times, hashlib.sha256(groups.encode()).hexdigest()


ROWS = pa.schema([("bundle", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                  ("n_groups", pa.int64()), ("at", pa.binary()), ("times", pa.binary()), ("digest", pa.string()),
                  ("pair", pa.int64()), ("n", pa.int64())])
ROWS_SQL = ("bundle long, doc_id long, n_a long, n_b long, n_groups long, at binary, times binary, digest string, "
            "pair long, n long")


def _bundled(docs: DataFrame, spec, proto) -> DataFrame:
    """Rows of documents (pairs as places in the bundle's sorted pairs) and rows
    (bundle, pair, n) of the bundle's pairs."""
    def emit(bundle: int, held: list) -> Iterator[pa.RecordBatch]:
        sizes = [len(h[4]) for h in held]
        every = np.concatenate([h[4] for h in held]) if held else np.empty(0, np.int64)
        pairs, place, n = np.unique(every, return_inverse=True, return_counts=True)
        places = np.split(place.astype(np.int32), np.cumsum(sizes)[:-1])
        none = pa.nulls(len(held), pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array([bundle] * len(held), pa.int64()),
            *[pa.array([h[i] for h in held], pa.int64()) for i in range(4)],
            pa.array([np.diff(p, prepend=np.int32(0)).tobytes() for p in places], pa.binary()),
            pa.array([h[5].astype(np.int32).tobytes() for h in held], pa.binary()),
            pa.array([h[6] for h in held], pa.string()), none, none], schema=ROWS)
        gone = [pa.nulls(len(pairs), f.type) for f in list(ROWS)[1:8]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), bundle)), *gone, pa.array(pairs), pa.array(n)],
                                         schema=ROWS)

    empty = np.empty(0, np.int64)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(spec.value, proto.value)
        bundle, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids = iter(batch.column("_id").to_pylist())
            for chunk in bl.chunks((t.as_py() for t in batch.column("_text")), CHUNK):
                for doc_id, found in zip(ids_of(ids, len(chunk)), aligner(chunk)):
                    held.append((doc_id, *found) if found else (doc_id, 0, 0, 0, empty, empty, ""))
                    size += len(held[-1][4]) + 64
                    if size >= BUNDLE:
                        yield from emit(bundle, held)
                        bundle, held, size = bundle + 1, [], 0
        if held:
            yield from emit(bundle, held)

    def ids_of(ids: Iterator, n: int) -> list:
        return [next(ids) for _ in range(n)]

    return docs.mapInArrow(align, ROWS_SQL)


def _finished(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Documents with n_links, n_best and count_sum: a bundle's pairs with their
    counts come first, in order, then its documents."""
    schema = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                        ("groups_sha256", pa.string())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, totals, bests = None, [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for b in dict.fromkeys(batch.column("bundle").to_pylist()):
                if b != bundle:
                    bundle, totals, bests = b, [], []
                mine = np.flatnonzero(batch.column("bundle").to_numpy() == b)
                counts, docs = mine[kind[mine] == 0], pa.array(mine[kind[mine] == 1])
                if len(counts):
                    at = pa.array(counts)
                    totals.append(batch.column("total").take(at).to_numpy(zero_copy_only=False))
                    bests.append(batch.column("best").take(at).to_numpy(zero_copy_only=False))
                if not len(docs):
                    continue
                total = np.concatenate([np.empty(0, np.int64), *totals])
                best = np.concatenate([np.empty(0, bool), *bests])
                totals, bests = [total], [best]
                out = []
                for at, times in zip(batch.column("at").take(docs), batch.column("times").take(docs)):
                    place = np.cumsum(np.frombuffer(at.as_py(), np.int32))
                    times = np.frombuffer(times.as_py(), np.int32).astype(np.int64)
                    out.append((int(times.sum()), int((times * best[place]).sum()), int((times * total[place]).sum())))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(docs) for c in ("doc_id", "n_a", "n_b", "n_groups")],
                     *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)],
                     batch.column("digest").take(docs)], schema=schema)

    columns = ("doc_id", "n_a", "n_b", "n_groups", "at", "times", "digest")
    docs = rows.where("pair is null").select(
        "bundle", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pair"),
        F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), *columns)
    counts = counted.select("bundle", F.lit(0).alias("kind"), "pair", "total", "best",
                            *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in columns])
    dealt = counts.union(docs).repartition("bundle").sortWithinPartitions("bundle", "kind", "pair")
    return dealt.drop("pair").mapInArrow(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, total, best): documents that hold each pair linked, and whether no
    pair of the same A id is in more. At most |A| x |B| rows, summed per task first."""
    totals = written(rows.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    a = F.floor(F.col("pair") / width)
    most = totals.groupBy(a.alias("a")).agg(F.max("total").alias("most"))
    return totals.withColumn("a", a).join(most, "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def aligned(df: DataFrame, json_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256),
    one row per row of ``df``.

    A: the byte-level vocabulary of ``json_path`` on a space and the text; B:
    the sentencepiece model of ``model_path`` on the text. Null and empty texts,
    and texts whose joined A or B bytes are not the space and the text (such as
    one with U+2581), have no tokens: zeros, and an empty groups_sha256.
    Repeated rows each count as a document. Very long texts are aligned whole.
    Other columns are not read, whatever their names; an empty table gives an
    empty result. The files are read on the driver (a few MB) and broadcast.
    """
    spark = df.sparkSession
    workers_can_import(spark)
    with open(json_path, encoding="utf-8") as f:
        spec = f.read()
    with open(model_path, "rb") as f:
        proto = f.read()
    width = len(Pieces(proto).bytes)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), whole(F.col(f"`{text}`")).alias("_text"))
    rows = written(_bundled(docs, spark.sparkContext.broadcast(spec), spark.sparkContext.broadcast(proto)), "aligned")
    counted = rows.where("pair is not null").select("bundle", "pair").join(pair_counts(rows, width), "pair")
    return _finished(rows, counted).withColumnRenamed("doc_id", doc_id)
