"""Subword id sequences under a finished vocabulary (greedy longest match).

A text is cleaned and cut into words (blanks, punctuation, ideographs); each
word is taken apart from the left into the longest pieces that the vocabulary
has, pieces after the first one under a continuation mark. A word that can't be
taken apart is one unknown token.

The vocabulary is a table (token, token_id). It is checked to be small (a
finished vocabulary has tens of thousands of entries) and sent to every task,
where it becomes a trie; a longest match then walks a word's characters once.
Words that a worker has met are looked up. No shuffle: sequences are cut to the
kept positions in the same pass.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import coerce_text
from ..session import ship_package
from .encode import padded
from .order import range_bucket, row_numbers

MAX_ENTRIES, MAX_CHARACTERS = 1_000_000, 16_000_000   # of a vocabulary that is sent to the tasks
REMEMBERED = 65_536        # words that a worker remembers, none above LONGEST_WORD
CHUNK = 1 << 20            # characters that are worked off together

# Words of more characters are unknown; the mark of a
# continuation; the tokens that stand for padding, unknown words, start and end,
# which are never cut where they stand alone in a text.
LONGEST_WORD = 100
CONTINUED = "##"
PAD, UNKNOWN, START, END = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
NEVER_CUT = (UNKNOWN, END, PAD, START, "[MASK]")
# Code points of ideographs, each a word of its own (first, last).
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F),
              (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


class _Cleaned(dict):
    """Character -> what stands for it: control characters go, blanks become
    spaces, ideographs stand apart."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch in "\t\n\r" or kind == "Zs":
            out = " "
        elif code in (0, 0xFFFD) or kind[0] == "C":
            out = ""
        else:
            out = f" {ch} " if any(a <= code <= b for a, b in IDEOGRAPHS) else ch
        self[code] = out
        return out


class _Apart(dict):
    """Character -> what stands for it: punctuation stands apart; with
    ``marks=False`` accents (already decomposed) go."""

    def __init__(self, marks: bool):
        super().__init__()
        self.marks = marks

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        symbol = code < 128 and not ch.isalnum() and not ch.isspace() and code > 32 and code != 127
        out = f" {ch} " if symbol or kind[0] == "P" else "" if kind == "Mn" and not self.marks else ch
        self[code] = out
        return out


_CLEANED, _WITH_MARKS, _WITHOUT_MARKS = _Cleaned(), _Apart(True), _Apart(False)


def words(text: str, lower: bool = True) -> list[str]:
    """The words of a text, lower-cased and without accents if ``lower``."""
    def cut(part: str) -> list[str]:
        if lower:
            part = unicodedata.normalize("NFD", part.lower())
        return part.translate(_WITHOUT_MARKS if lower else _WITH_MARKS).split()

    clean = text.translate(_CLEANED)
    if not any(t in clean for t in NEVER_CUT):
        return cut(clean)
    out = []
    for part in clean.split():
        out += [part] if part in NEVER_CUT else cut(part)
    return out


class Trie:
    """Longest entries at a place of a word. An edge is a dictionary entry of
    (node, character); the node of an entry carries its id."""

    def __init__(self, entries: dict[str, int]):
        self.edges: dict[int, int] = {}
        self.ids: dict[int, int] = {}
        for token, i in entries.items():
            node = 0
            for ch in token:
                node = self.edges.setdefault(node << 21 | ord(ch), len(self.edges) + 1)
            self.ids[node] = i

    def longest(self, word: str, at: int) -> tuple[int, int]:
        """(end, id) of the longest entry at ``at``; (at, -1) if there is none."""
        node, found, edges, ids = 0, (at, -1), self.edges, self.ids
        for i in range(at, len(word)):
            node = edges.get(node << 21 | ord(word[i]))
            if node is None:
                break
            if node in ids:
                found = (i + 1, ids[node])
        return found


class Subwords:
    """Pieces of texts under a vocabulary; one per Python worker."""

    def __init__(self, vocabulary: dict[str, int], lower: bool = True):
        self.lower = lower
        self.unknown = vocabulary[UNKNOWN]
        self.kept = {t: vocabulary[t] for t in NEVER_CUT if t in vocabulary}
        self.first = Trie({t: i for t, i in vocabulary.items() if t})
        self.later = Trie({t[len(CONTINUED):]: i for t, i in vocabulary.items()
                           if t.startswith(CONTINUED) and len(t) > len(CONTINUED)})
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        if word in self.kept:
            return [self.kept[word]]
        if len(word) > LONGEST_WORD:
            return [self.unknown]
        out, at, trie = [], 0, self.first
        while at < len(word):
            at, i = trie.longest(word, at)
            if i < 0:
                return [self.unknown]
            out.append(i)
            trie = self.later
        return out

    def text(self, text: str, enough: int | None = None) -> list[int]:
        """Ids of the text's pieces; at least the first ``enough`` of them."""
        out: list[int] = []
        for w in words(text, self.lower):
            ids = self.known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= LONGEST_WORD:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[w] = ids
            out += ids
            if enough is not None and len(out) >= enough:
                break
        return out


_workers: dict = {}


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    part, n = [], 0
    for t in column:
        part.append(t.as_py())
        n += len(part[-1])
        if n >= CHUNK:
            yield part
            part, n = [], 0
    yield part


def _parts(batches: Iterator[pa.Array]) -> Iterator[list[str]]:
    """The texts of all batches in chunks; a batch that is done goes back to the system."""
    for column in batches:
        yield from _chunks(column)
        del column
        pa.default_memory_pool().release_unused()


def bounded_vocabulary(vocab: DataFrame) -> dict[str, int]:
    """The vocabulary on the driver, once its size is known to be small."""
    n, size = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("token")), F.lit(0))).first()
    if n > MAX_ENTRIES or size > MAX_CHARACTERS:
        raise ValueError(f"a vocabulary of {n} entries, {size} characters is too large to be sent to every task")
    entries = {r["token"]: r["token_id"] for r in vocab.select("token", "token_id").collect()}
    missing = [t for t in (PAD, UNKNOWN, START, END) if t not in entries]
    if missing:
        raise ValueError(f"the vocabulary has no {', '.join(missing)}")
    return entries


def pieces(df: DataFrame, vocab: DataFrame, text: str = "comment_text", mode: str = "all", m: int = 218,
           lower: bool = True) -> Column:
    """array<int> of the piece ids of a text. ``all``; ``head``: the first ``m``;
    ``head_tail``: of more than ``m`` the first third and the last two thirds."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(bounded_vocabulary(vocab))
    head, key = m // 3, uuid.uuid4().hex

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        subwords = _workers.get(key)
        if subwords is None:
            _workers.clear()
            subwords = _workers[key] = Subwords(shared.value, lower)
        for part in _parts(batches):
            out = []
            for t in part:
                got = subwords.text(t, m if mode == "head" else None)
                if len(got) > m and mode != "all":
                    got = got[:m] if mode == "head" else got[:head] + got[head - m:]
                out.append(got)
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array([i for o in out for i in o], pa.int32()))

    return ids(coerce_text(text))


def encode_wordpiece(df: DataFrame, vocab: DataFrame, key: str = "id", text: str = "comment_text", max_len: int = 220,
                     mode: str = "head", lower: bool = True) -> DataFrame:
    """(key, token_ids[, pad_mask]) in the layouts of ``encode``, with the start,
    end and padding ids of the vocabulary. A null text is the text ``nan``; a
    text without words has no pieces."""
    m = max_len - 2
    kept = df.select(key, pieces(df, vocab, text, "head_tail" if mode == "head_tail" else "head", m, lower).alias("_ids"))
    special = {r["token"]: r["token_id"] for r in vocab.where(F.col("token").isin(PAD, START, END)).collect()}
    return padded(kept, key, max_len, mode, special[START], special[END], special[PAD])


def affix_vocabulary(words_table: DataFrame, word: str = "word", first: int = 2, last: int = 4) -> DataFrame:
    """(token, token_id): a vocabulary by rule, for tables that come without one:
    the given words, their first 1 to ``first`` characters, and their last 1 to
    ``last`` as continuations, numbered in code point order behind the four
    special tokens."""
    w = F.col(word)
    found = words_table.where(F.length(w) > 0).select(F.explode(F.concat(
        F.array(w), F.transform(F.sequence(F.lit(1), F.lit(first)), lambda k: F.left(w, k)),
        F.transform(F.sequence(F.lit(1), F.lit(last)), lambda k: F.concat(F.lit(CONTINUED), F.right(w, k))))).alias("token")).distinct()
    numbered = row_numbers(range_bucket(found, ["token"]), [], ["token"], out="_n")
    special = words_table.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate((PAD, UNKNOWN, START, END))], "token string, token_id int")
    return special.unionByName(numbered.select("token", (F.col("_n") + 3).cast("int").alias("token_id")))


def text_words(df: DataFrame, text: str, lower: bool = True) -> Column:
    """array<string> of the words that ``encode_wordpiece`` takes apart."""
    ship_package(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in _parts(batches):
            yield pa.array([words(t, lower) for t in part], pa.list_(pa.string()))

    return cut(coerce_text(text))
