"""Byte-level BPE encoding and decoding under a rank file.

The rank file becomes a BPE model of the tokenizers library: bytes are mapped
to printable characters, and every way to cut a token into two tokens is a
merge, ordered by the token's rank, so that the lowest-ranked token is made
first. A pre-token that is itself in the vocabulary is one token.

Arrow batches are worked off in chunks: parts of texts that the worker does not
hold yet are split into pre-tokens and merged by the library, and a text's ids
are those of its parts in turn. Ids, character offsets and decoded bytes come
from one Python evaluation, chunk by chunk, so neither the tables that a worker
holds nor what it sends back at once follows the batch. No shuffle.
"""

from __future__ import annotations

import base64
import codecs
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from . import bytelevel as bl
from .common import whole, workers_can_import

KEPT_BYTES = 80 << 20   # parts and pre-tokens that a worker remembers, about
ENTRY_BYTES = 220       # of a remembered entry besides its text and ids

_workers: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def library_model(ranks: dict[bytes, int]) -> Tokenizer:
    """Tokenizer with the ranks as ids; it takes one pre-token at a time."""
    chars = bl.byte_characters()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((name[left], name[right]))
    model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


class Encoder:
    """Encodes texts into ids and character offsets; one per Python worker.

    Holds the ids (as packed int32) of merged pre-tokens and of space-started
    parts of texts, so that a frequent part costs one look-up. Both tables are
    emptied when they hold ``KEPT_BYTES``; results don't depend on it.
    """

    def __init__(self, tokenizer_json: str, odd: str, ranks: dict[bytes, int]):
        self.model = Tokenizer.from_str(tokenizer_json).model
        self.pieces = bl.Pieces(odd)
        self.whole = {t: r.to_bytes(4, sys.byteorder) for t, r in ranks.items()}
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, dtype=np.int64)
        for t, r in ranks.items():
            self.sizes[r] = len(t)
        self.merged: dict[bytes, bytes] = {}
        self.known = bl.Parts(self._part)
        self.held = 0

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = self.whole.get(raw) or self.merged.get(raw)
        if ids is None:
            ids = self.merged[raw] = array("i", [t.id for t in self.model.tokenize(bl.mapped(piece))]).tobytes()
            self.held += len(raw) + len(ids) + ENTRY_BYTES
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pieces(text)))

    def _part(self, text: str) -> bytes:
        ids = self._plain(text)
        self.held += 2 * len(text) + len(ids) + ENTRY_BYTES
        return ids

    def _text(self, text: str) -> bytes:
        head, rest = bl.units(text)
        if rest and (not head or head[-1].isspace()):
            return self._plain(text)
        try:
            return self._plain(head) + b"".join(map(self.known.__getitem__, rest))
        except TypeError:  # a part that can't be split alone
            return self._plain(text)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for part in bl.chunks(texts):
            for t in part:
                if self.held > KEPT_BYTES:
                    self.known.clear()
                    self.merged.clear()
                    self.held = 0
                yield np.frombuffer(self._text(t), dtype=np.int32)

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(n, 2) character spans of the ids of ``text``. A token's printable
        characters are its bytes, so spans are counted in bytes and mapped to
        characters; all tokens of a character that is cut over several tokens
        span it."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.sizes[ids])
        spans = np.empty((len(ids), 2), dtype=np.int32)
        if len(ids):
            spans[:, 0] = character[np.concatenate([[0], ends[:-1]])]
            spans[:, 1] = character[ends - 1] + 1
        return spans

    def encode_with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, (n, 2) character spans)."""
        (ids,) = self.encode([text])
        return ids, self.spans(text, ids)


class Decoder:
    """Reverses the byte table: ids -> bytes -> text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            self.table[r] = token

    def bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> str:
        """Whole text; bytes that are no UTF-8 become U+FFFD."""
        return self.bytes(ids).decode("utf-8", errors="replace")

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as the ids come: a character cut over several ids is held back
        until its last byte is there."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := decoder.decode(self.table[i]):
                yield s
        if s := decoder.decode(b"", final=True):
            yield s


class Codec:
    """Column functions ``encode`` and ``decode`` for one rank file. The file is
    read on the driver (fixed size, under 1 MB) and broadcast."""

    def __init__(self, spark, ranks_path: str):
        workers_can_import(spark)
        self.ranks = read_ranks(ranks_path)
        self.path = ranks_path
        self._model = spark.sparkContext.broadcast((library_model(self.ranks).to_str(), bl.odd_characters()))
        self._ranks = spark.sparkContext.broadcast(self.ranks)

    def encode(self, text: str | Column) -> Column:
        """array<int> of ids of the whole text (null: empty)."""
        shared, ranks, key = self._model, self._ranks, ("ids", self.path)

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _workers.get(key) or _workers.setdefault(key, Encoder(*shared.value, ranks.value))
            for texts in batches:
                for chunk in bl.chunks(t.as_py() for t in texts):
                    yield _lists(list(encoder.encode(chunk)))
                if not len(texts):
                    yield _lists([])

        return ids(whole(text))

    def round_trip(self, text: str | Column, offsets: bool = False) -> Column:
        """struct<ids, decoded[, starts, ends]> in one evaluation: the ids, the
        bytes that they decode to, and the characters that each covers."""
        shared, ranks, path = self._model, self._ranks, self.path
        fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
        if offsets:
            fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]
        names = [f.name for f in fields]

        @F.arrow_udf(T.StructType(fields))
        def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _workers.get(("ids", path)) or _workers.setdefault(("ids", path), Encoder(*shared.value, ranks.value))
            decoder = _workers.get(("bytes", path)) or _workers.setdefault(("bytes", path), Decoder(ranks.value))
            for texts in batches:
                for chunk in bl.chunks(t.as_py() for t in texts) if len(texts) else [[]]:
                    found = list(encoder.encode(chunk))
                    columns = [_lists(found), pa.array([decoder.bytes(i.tolist()) for i in found], pa.binary())]
                    if offsets:
                        spans = [encoder.spans(t, i) for t, i in zip(chunk, found)]
                        columns += [_lists([s[:, k] for s in spans]) for k in (0, 1)]
                    yield pa.StructArray.from_arrays(columns, names)

        return coded(whole(text))

    def encode_with_offsets(self, text: str | Column) -> Column:
        """struct<ids, starts, ends>: ids and the characters that each covers."""
        shared, ranks, key = self._model, self._ranks, ("ids", self.path)
        kind = "ids array<int>, starts array<int>, ends array<int>"

        @F.pandas_udf(kind)
        def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder = _workers.get(key) or _workers.setdefault(key, Encoder(*shared.value, ranks.value))
            for texts in batches:
                rows = [(i, s[:, 0], s[:, 1]) for i, s in map(encoder.encode_with_offsets, texts)]
                yield pd.DataFrame(rows, columns=["ids", "starts", "ends"])

        return spans(whole(text))

    def decode(self, ids: str | Column) -> Column:
        """Bytes of the ids (null: no bytes). ``decode(..).cast("string")`` is the text."""
        shared, key = self._ranks, ("bytes", self.path)

        @F.arrow_udf(T.BinaryType())
        def whole_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decoder = _workers.get(key) or _workers.setdefault(key, Decoder(shared.value))
            for lists in batches:
                ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
                yield pa.array([decoder.bytes(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])],
                               type=pa.binary())

        ids = F.col(ids) if isinstance(ids, str) else ids
        return whole_bytes(F.coalesce(ids, F.array().cast("array<int>")))


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
    values = np.concatenate(found) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, type=pa.int32()))


def encoded(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
            offsets: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``decoded`` (binary, from the ids);
    with ``offsets``, two more columns of these names: the first character that
    each token covers, and the one behind its last.

    One output row per input row, repeated rows included. Null or empty text:
    no ids, no bytes. A very long text is encoded whole. Input columns of the
    new names (case ignored) are replaced, all others kept. An empty table
    stays empty.
    """
    codec = Codec(df.sparkSession, ranks_path)
    new = {"ids": ids, "decoded": decoded, **(dict(zip(("starts", "ends"), offsets)) if offsets else {})}
    names = {n.lower() for n in new.values()}
    keep = [c for c in df.columns if c.lower() not in names]
    held = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)],
                     codec.round_trip(F.col(f"`{text}`"), bool(offsets)).alias("_coded"))
    return held.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)],
                       *[F.col(f"_coded.{k}").alias(n) for k, n in new.items()])
