"""Token counts under a byte-level vocabulary, by the whole-token shortcut.

Offline, each vocabulary string is put to the tokenizer: those that form one
pre-token and encode alone as one token are whole tokens. In a text such
pre-tokens count one each; only the others are merged, and their counts are
kept in a bounded table per Python worker.

No shuffle; each Arrow batch is worked off in chunks of texts, so memory does
not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import bytelevel as bl
from .common import replaced, whole, workers_can_import

MERGED_ENTRIES = 200_000
UNIT_ENTRIES = 400_000

_workers: dict = {}


def whole_tokens(tokenizer: Tokenizer, pieces: bl.Pieces) -> list[str]:
    """Vocabulary strings proven to be one pre-token and to encode as one token."""
    table = bl.character_bytes()
    found = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if all(c in table for c in entry):
            try:
                text = bytes(table[c] for c in entry).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if pieces(text) == [text]:
                found.append(text)
    encoded = tokenizer.encode_batch_fast(found, add_special_tokens=False)
    return [t for t, e in zip(found, encoded) if len(e) == 1]


class Counter:
    """Counts tokens of texts; built once per Python worker.

    Two tables of token counts: of pre-tokens (whole tokens, which stay, and
    merged ones) and of space-started parts of texts, so that a frequent part
    costs one look-up. Both are emptied when full; results don't depend on it.
    """

    def __init__(self, tokenizer_json: str, shortcut: list[str], odd: str):
        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = tokenizer.model
        self.pieces = bl.Pieces(odd)
        # special strings are cut out of a text before anything else, one token each
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()),
                         key=len, reverse=True)
        self.special = bl.regex.compile("|".join(map(bl.regex.escape, special))) if special else None
        self.marks = special
        self.shortcut = dict.fromkeys(shortcut, 1)
        self.known = dict(self.shortcut)
        self.units = bl.Parts(self._plain)

    def _piece(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.known[piece] = len(self.model.tokenize(bl.mapped(piece)))
        return n

    def _plain(self, text: str) -> int:
        return sum(map(self._piece, self.pieces(text)))

    def _count(self, text: str) -> int:
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return sum(map(self._plain, parts)) + len(parts) - 1
        head, rest = bl.units(text)
        if rest and (not head or head[-1].isspace()):
            return self._plain(text)
        try:
            return self._plain(head) + sum(map(self.units.__getitem__, rest))
        except TypeError:  # a part that can't be split alone
            return self._plain(text)

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for part in bl.chunks(texts):
            if len(self.known) > len(self.shortcut) + MERGED_ENTRIES:
                self.known = dict(self.shortcut)
            if len(self.units) > UNIT_ENTRIES:
                self.units.clear()
            out += map(self._count, part)
        return out


def token_count(df: DataFrame, text: str, tokenizer_path: str) -> Column:
    """Column expression: number of tokens of ``text`` (null: empty) under the
    tokenizer file. The file is read on the driver (fixed size, a few MB) and
    broadcast, so executors need no copy of it."""
    spark = df.sparkSession
    workers_can_import(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    tokenizer, odd = Tokenizer.from_str(spec), bl.odd_characters()
    if tokenizer.normalizer is not None:
        raise ValueError("a byte-level vocabulary without a normalizer is needed")
    shared = spark.sparkContext.broadcast((spec, whole_tokens(tokenizer, bl.Pieces(odd)), odd))
    key = (tokenizer_path, len(spec))

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _workers.get(key)
        if counter is None:
            _workers.clear()
            counter = _workers[key] = Counter(*shared.value)
        for texts in batches:
            yield pd.Series(counter(texts.tolist()), dtype="int64")

    return count(whole(text))


def with_token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    One output row per input row, repeated rows included. Null or empty text:
    0 bytes, 0 tokens, not over. An input column of one of these three names
    is replaced; all others are kept as they are.
    """
    out = replaced(df, {"n_bytes": F.octet_length(whole(text)).cast("long"),
                        "n_tokens": token_count(df, text, tokenizer_path)})
    return replaced(out, {"over_limit": F.col("n_tokens") > limit})
