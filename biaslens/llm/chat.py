r"""Chat formatting with offset-aligned loss masks.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. The three
marks are special tokens, so no token crosses a mark. In roles and texts ``<``,
any backslashes and ``|`` in a row get one backslash more, which no mark has;
taking one away undoes it.

Turns are numbered within their conversation and dealt out in parts of whole
turns. A part is rendered and encoded once with character offsets; because
marks cut the text before anything else, the parts' tokens in a row are the
tokens of the whole conversation. The sorted spans of assistant texts are met
with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from . import bytelevel as bl
from .common import workers_can_import

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
TURNS_PER_PART = 64

_workers: dict = {}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, sorted spans of the learned texts) of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role) + MIDDLE
        body = escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(spans: list[tuple[int, int]], offsets: np.ndarray) -> np.ndarray:
    """Whether each token lies in a span; both sorted. A token's span is found
    as the last one that starts at or before it."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    spans = np.array(spans, dtype=np.int64)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    inside = at >= 0
    inside &= offsets[:, 1] <= spans[at, 1]
    return inside & (offsets[:, 1] > offsets[:, 0])


class Chat:
    """Encodes and decodes under one tokenizer file with the three marks added."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.add_special_tokens([START, MIDDLE, END])
        self.start, self.middle, self.end = map(self.tokenizer.token_to_id, (START, MIDDLE, END))
        table = bl.character_bytes()
        self.bytes = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode()
                      for t, i in self.tokenizer.get_vocab().items()}

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        for part in bl.chunks(texts):
            for e in self.tokenizer.encode_batch(part, add_special_tokens=False):
                yield e.ids, np.array(e.offsets, dtype=np.int64).reshape(-1, 2)

    def text(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")

    def turns(self, ids: list[int]) -> list[tuple[str, str]]:
        """(role, text) turns read back from token ids."""
        found, at = [], 0
        while at < len(ids):
            middle = ids.index(self.middle, at)
            end = ids.index(self.end, middle)
            found.append((unescape(self.text(ids[at + 1:middle])), unescape(self.text(ids[middle + 1:end]))))
            at = end + 1
        return found

    def learned(self, ids: list[int], masked: list[bool]) -> list[str]:
        """The texts under the mask: one for each run of masked tokens."""
        return [unescape(self.text([i for i, _ in run])) for m, run in
                groupby(zip(ids, masked), key=lambda x: x[1]) if m]


def _chat(shared) -> Chat:
    if "chat" not in _workers or _workers["chat"][0] != shared.value:
        _workers["chat"] = (shared.value, Chat(shared.value))
    return _workers["chat"][1]


def formatted(df: DataFrame, tokenizer_path: str, conv_id: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text", turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, part, text, ids, mask): the rendered parts of each conversation
    in order, their token ids and, per token, whether it is learned.

    Turns are ordered by turn (null first), ties by role and text; repeated
    rows are repeated turns. Null role or text: empty. Rows with a null conv_id
    form one conversation. An assistant turn without text has no token under
    the mask.
    """
    spark = df.sparkSession
    workers_can_import(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("_turn"),
                     F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("_role"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")) - 1
    placed = rows.withColumn("_at", place).select(
        "conv_id", F.floor(F.col("_at") / turns_per_part).cast("int").alias("part"), "_at", "_role", "_text")
    dealt = placed.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "_at")
    kind = dict(df.dtypes)[conv_id]
    schema = pa.schema([("conv_id", _arrow(df, conv_id)),
                        ("part", pa.int32()), ("text", pa.string()), ("ids", pa.list_(pa.int32())),
                        ("mask", pa.list_(pa.bool_()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = _chat(shared)
        turns = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "_role", "_text"))))
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            coded = list(chat.encode([t for _, (t, _) in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in held], schema.field("conv_id").type),
                 pa.array([k[1] for k, _ in held], pa.int32()), pa.array([t for _, (t, _) in held], pa.string()),
                 pa.array([i for i, _ in coded], pa.list_(pa.int32())),
                 pa.array([mask(spans, o) for (_, (_, spans)), (_, o) in zip(held, coded)], pa.list_(pa.bool_()))],
                schema=schema)

        size = 0
        for key, part in groupby(turns, key=lambda r: r[:2]):
            held.append((key, render([r[2:] for r in part])))
            size += len(held[-1][1][0])
            if size >= 1 << 20:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return dealt.mapInArrow(encode, f"conv_id {kind}, part int, text string, ids array<int>, mask array<boolean>")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def read_back(parts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    from ids and masks alone (formatted_chars from the text). Parts are decoded
    wherever they lie; then a conversation's decoded parts stream through its
    two digests in order, one part in memory at a time."""
    spark = parts.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind, key_type = dict(parts.dtypes)["conv_id"], _arrow(parts, "conv_id")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = _chat(shared)
        for batch in batches:
            rows = []
            for ids, masked, text in zip(*(batch.column(c).to_pylist() for c in ("ids", "mask", "text"))):
                turns = chat.turns(ids)
                rows.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns),
                             "".join(chat.learned(ids, masked)), len(text)))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("part"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
                names=["conv_id", "part", "n", "turns", "loss", "chars"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n", "turns", "loss", "chars"))))
        out = []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, k, t, x, c in group:
                turns.update(t.encode())
                loss.update(x.encode())
                n, loss_chars, chars = n + k, loss_chars + len(x), chars + c
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        cols = list(zip(*out)) or [[]] * 6
        types = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    decoded = parts.mapInArrow(decode, f"conv_id {kind}, part int, n long, turns string, loss string, chars long")
    return decoded.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                "formatted_chars long")
