"""Scores of a log-bilinear language model.

Tokens are words (A-Z lowered) and one end per document. The most frequent
words are classes of their own, all others share the class ``rare``; inside it
a word has its add-one unigram share. So every word, seen or not, has a
probability, and they add up to one.

Model (vectors r, q of classes, weights c per context place, bias b):
    s(w | u, v) = (c1 * r_u + c2 * r_v) . q_w + b_w
trained by noise-contrastive estimation: one pass of each partition over its
whole training texts from common starting values, then the parameters are
averaged by token numbers. With S1 = (c1 * R) Q', S2 = (c2 * R) Q' the
normalisers of all contexts are one matrix product,
    Z = (exp(S1) * exp(b)) exp(S2)'
so normalised log-probabilities are look-ups.

Counts are gathered from all training texts. The words of the ``head`` (as many
of the most frequent as fit, words of equal count together) reach the driver;
the count they start at is found by narrowing a range of counts. The others
meet their counts in a shuffle join; no word there is frequent enough to make a
hot key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole, workers_can_import, written

RARE, END, START, FIRST = 0, 1, 2, 3
COUNTED = 400_000       # distinct words held before they are passed on
BLOCK = 1 << 14         # parameters a row when they are averaged
CUTS = 1000             # parts of a range of counts when the head is cut off

_workers: dict = {}


@dataclass(frozen=True)
class Settings:
    classes: int = 2048       # words with vectors of their own (bounds all matrices)
    head: int = 200_000       # words whose counts are broadcast (bounds the broadcast)
    dim: int = 24
    noise: int = 64
    rate: float = 0.08
    batch: int = 8192
    seed: int = 5


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                                    names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for t in batch.column("_text"):
                seen.update(words_of(t.as_py()))
                if len(seen) >= COUNTED:
                    yield out()
        yield out()

    return docs.where("_train").select("_text").mapInArrow(count, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def _cut_off(counts: DataFrame, most: int) -> int:
    """The smallest c such that at most ``most`` words occur c times or more. Each
    round brings at most CUTS rows to the driver and reads one column."""
    lo, hi, above = 1, 1 + (counts.agg(F.max("n")).first()[0] or 0), 0
    while lo < hi:
        step = -(-(hi - lo) // CUTS)
        parts = counts.where(f"n >= {lo} and n < {hi}").groupBy(F.expr(f"(n - {lo}) div {step}").alias("part")).agg(
            F.count(F.lit(1)).alias("words")).orderBy(F.desc("part")).collect()
        for r in parts:
            if above + r["words"] > most:
                break
            above += r["words"]
        else:
            return lo
        lo, hi = lo + r["part"] * step, min(hi, lo + (r["part"] + 1) * step)
        if step == 1:
            return hi
    return lo


@dataclass
class Model:
    """Parameters and class frequencies."""
    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray
    frequency: np.ndarray

    @staticmethod
    def start(frequency: np.ndarray, s: Settings) -> Model:
        rng, m = np.random.default_rng(s.seed), len(frequency)
        scale = 1 / math.sqrt(s.dim)
        return Model(rng.normal(0, scale, (m, s.dim)).astype(np.float32), rng.normal(0, scale / 4, (m, s.dim)).astype(np.float32),
                     np.full((2, s.dim), 0.7, dtype=np.float32), np.log(frequency).astype(np.float32), frequency)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c, self.b)])

    def with_flat(self, values: np.ndarray) -> Model:
        parts, at = [], 0
        for x in (self.r, self.q, self.c, self.b):
            parts.append(values[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*parts, self.frequency)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(S1, S2 with the bias and log Z taken off: none, log Z): natural logs."""
        s1, s2 = (self.c[0] * self.r) @ self.q.T, (self.c[1] * self.r) @ self.q.T + self.b
        top1, top2 = s1.max(axis=1, keepdims=True), s2.max(axis=1, keepdims=True)
        z = np.exp(s1 - top1) @ np.exp(s2 - top2).T
        return s1, s2, np.log(np.maximum(z, 1e-30)) + top1 + top2.T


def contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; documents end at ``ends``."""
    one = np.concatenate([[START], ids[:-1]])
    two = np.concatenate([[START, START], ids[:-2]])[:len(ids)]
    first = np.concatenate([[0], ends[:-1]])
    one[first] = START
    two[first] = START
    second = first + 1
    second = second[second < ends]
    two[second] = START
    return one, two


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by index."""
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
    out[sorted_at[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with per-parameter step sizes."""

    def __init__(self, model: Model, s: Settings, seed: int):
        self.m, self.s = model, s
        self.rng = np.random.default_rng([s.seed, seed])
        self.cumulated = np.cumsum(model.frequency)
        self.log_noise = np.log(s.noise * model.frequency).astype(np.float32)
        self.squares = [np.full_like(x, 1e-9) for x in (model.r, model.q, model.c, model.b)]
        self.tokens = 0

    def learn(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> None:
        """One pass over the tokens; equal (context, word) are one weighted row."""
        self.tokens += len(w)
        m = len(self.m.b)
        keys, n = np.unique((two.astype(np.int64) * m + one) * m + w, return_counts=True)
        order = self.rng.permutation(len(keys))
        for lo in range(0, len(keys), self.s.batch):
            k, weight = keys[order[lo:lo + self.s.batch]], n[order[lo:lo + self.s.batch]].astype(np.float32)
            self._step(k // m % m, k // (m * m), k % m, weight / weight.sum())

    def _step(self, one, two, w, weight) -> None:
        p, (c1, c2) = self.m, self.m.c
        r1, r2 = p.r[one], p.r[two]
        h = c1 * r1 + c2 * r2
        x = np.minimum(np.searchsorted(self.cumulated, self.rng.random(self.s.noise) * self.cumulated[-1]), len(p.b) - 1)
        data = (h * p.q[w]).sum(axis=1) + p.b[w] - self.log_noise[w]
        noise = h @ p.q[x].T + p.b[x] - self.log_noise[x]
        g = weight / (1 + np.exp(np.clip(data, -30, 30)))                       # towards the word
        f = -weight[:, None] / (1 + np.exp(np.clip(-noise, -30, 30)))           # away from noise
        dh = g[:, None] * p.q[w] + f @ p.q[x]
        m = len(p.b)
        dq = _summed(g[:, None] * h, w, m) + _summed(f.T @ h, x, m)
        db = np.bincount(w, g, m) + np.bincount(x, f.sum(axis=0), m)
        dr = _summed(dh * c1, one, m) + _summed(dh * c2, two, m)
        dc = np.stack([(dh * r1).sum(axis=0), (dh * r2).sum(axis=0)])
        for value, slope, square in zip((p.r, p.q, p.c, p.b), (dr, dq, dc, db), self.squares):
            square += slope * slope
            value += (self.s.rate * slope / np.sqrt(square)).astype(np.float32)


def _flat_ids(texts: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    ids, ends, n = [], [], 0
    for t in texts:
        found = [index.get(w, RARE) for w in words_of(t)]
        found.append(END)
        ids.append(np.array(found, dtype=np.int32))
        n += len(found)
        ends.append(n)
    return np.concatenate(ids), np.array(ends)


def _pieces(column, size: int = 4 << 20) -> Iterator[list[bytes]]:
    """Texts of an Arrow column, a few MB at a time."""
    part, n = [], 0
    for t in column:
        t = t.as_py()
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _trained(docs: DataFrame, index: dict, start: Model, s: Settings) -> Model:
    """The average of the partitions' models, weighted by their tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((index, start))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        index, start = shared.value
        trainer = Trainer(start.with_flat(start.flat()), s, TaskContext.get().partitionId())
        for batch in batches:
            for texts in _pieces(batch.column("_text")):
                ids, ends = _flat_ids(texts, index)
                trainer.learn(*contexts(ids, ends), ids)
        if trainer.tokens:
            flat = trainer.m.flat().astype(np.float64) * trainer.tokens
            parts = [flat[i:i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([trainer.tokens] * len(parts), pa.int64()),
                                   pa.array(parts, pa.binary())], names=["block", "tokens", "values"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tokens, total = None, 0, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([(total / tokens).tobytes()], pa.binary())],
                                   names=["block", "values"])

        for batch in batches:
            for b, n, v in zip(*(batch.column(c).to_pylist() for c in ("block", "tokens", "values"))):
                if b != at:
                    if at is not None:
                        yield done()
                    at, tokens, total = b, 0, 0.0
                tokens, total = tokens + n, total + np.frombuffer(v)
        if at is not None:
            yield done()

    models = docs.where("_train").select("_text").mapInArrow(train, "block int, tokens long, values binary")
    rows = models.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, values binary").collect()
    if not rows:
        return start
    return start.with_flat(np.concatenate([np.frombuffer(r["values"]) for r in sorted(rows, key=lambda r: r["block"])]))


def _scored(docs: DataFrame, head: dict, model: Model, end_count: int) -> DataFrame:
    """Per document: sums over the tokens whose count is in the head, and the
    other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((head, model.flat(), model.frequency, model.c.shape[1], end_count))
    schema = pa.schema([("_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                        ("n_rare", pa.int64()), ("head_log", pa.float64()), ("rare_log", pa.float64()),
                        ("model_log", pa.float64()), ("tail", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, flat, frequency, dim, end_count = shared.value
        m = len(frequency)
        if _workers.get("of") is not shared.value:
            empty = Model(np.empty((m, dim)), np.empty((m, dim)), np.empty((2, dim)), np.empty(m), frequency)
            _workers.update({"of": shared.value, "tables": empty.with_flat(flat).tables()})
        s1, s2, log_z = _workers["tables"]
        for batch in batches:
            kept = zip(batch.column("_id").to_pylist(), batch.column("_train").to_pylist())
            for texts in _pieces(batch.column("_text")):
                rows, ids, logs, ends, n = [], [], [], [], 0
                for t in texts:
                    words = words_of(t)
                    found = [head.get(w) for w in words]
                    tail = Counter([w for w, f in zip(words, found) if f is None]) if None in found else {}
                    ids.append(np.array([RARE if f is None else f[0] for f in found] + [END], dtype=np.int32))
                    logs.append(np.array([0.0 if f is None else f[1] for f in found] + [math.log10(end_count + 1)]))
                    n += len(words) + 1
                    ends.append(n)
                    rows.append((len(words) + 1, len(words) - sum(tail.values()) + (end_count > 0),
                                 list(tail.keys()), list(tail.values())))
                ids, logs, ends = np.concatenate(ids), np.concatenate(logs), np.array(ends)
                one, two = contexts(ids, ends)
                p = (s1[two, ids] + s2[one, ids] - log_z[two, one]).astype(np.float64) / math.log(10)
                first = np.concatenate([[0], ends[:-1]])
                rare = ids == RARE
                sums = [np.add.reduceat(x, first) for x in (rare.astype(np.int64), logs, np.where(rare, logs, 0.0), p)]
                keys = [next(kept) for _ in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([not k[1] for k in keys], pa.bool_()),
                     pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     *map(pa.array, sums), pa.array([r[2] for r in rows], pa.list_(pa.binary())),
                     pa.array([r[3] for r in rows], pa.list_(pa.int32()))], schema=schema)

    return docs.mapInArrow(score, "_id long, held_out boolean, n_tokens long, known long, n_rare long, head_log double, "
                                  "rare_log double, model_log double, tail array<binary>, times array<int>")


def scored_documents(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
                     settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row; ``train`` tells the training documents (null: training).

    base_score: sum of log10 (c + 1) / (N + V + 1), c the token's training
    count, N all and V the distinct training tokens; score: the model's log10
    probability of the text. Null or empty text: one token, the end. Repeated
    rows are separate documents. Without training documents every count is 0.
    """
    spark = df.sparkSession
    workers_can_import(spark)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.coalesce(train, F.lit(True)).alias("_train"),
                     whole(F.col(f"`{text}`")).cast("binary").alias("_text"))
    counts = written(_counts(docs), "word-counts")
    n_docs = docs.where("_train").count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = _cut_off(counts, settings.head)
    top = sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))  # at most ``head``
    own = top[:settings.classes]
    index = {bytes(r["word"]): FIRST + i for i, r in enumerate(own)}
    head = {bytes(r["word"]): (FIRST + i if i < len(own) else RARE, math.log10(r["n"] + 1)) for i, r in enumerate(top)}
    rare = n_words - sum(r["n"] for r in own)
    frequency = np.array([rare, n_docs, 0, *(r["n"] for r in own)], dtype=np.float64) + 1
    frequency /= frequency.sum()
    model = _trained(docs, index, Model.start(frequency, settings), settings)

    total, distinct = n_words + n_docs, n_distinct + (n_docs > 0)
    rows = written(_scored(docs, head, model, n_docs).withColumn("_row", F.monotonically_increasing_id()), "scored")
    tail_counts = counts.where(F.col("n") < least).select("word", "n")
    tail = rows.select("_row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select(
        "_row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    met = tail.join(tail_counts, "word").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_log"), F.sum("times").alias("tail_known"))
    out = rows.drop("tail", "times").join(met, "_row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        F.col("_id").alias(doc_id), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("model_log") + F.col("rare_log") + tail_log
         - F.col("n_rare") * math.log10(rare + n_distinct - len(own) + 1)).alias("score"))
