"""Fixed-length id sequences from comment text against a vocabulary table.

Tokenisation is a word-level stand-in for a pretrained subword tokenizer:
lower-cased runs of letters / marks / digits / underscore, and every other
non-blank character as a token of its own. The vocabulary is a table
(token, token_id, n); ids 0..3 are reserved (pad, unknown, start, end).

Scale notes: the vocabulary holds every token unless the caller passes a
``size``; its ids come from bucketed row numbers. Sequences are cut to the kept
positions first, and looked up as ``lookup`` describes: frequent tokens in each
task, each other token once per bundle of comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLS_ID, PAD_ID, SEP_ID, UNK_ID
from ..functions.text import coerce_text
from ..session import cut_lineage
from .lookup import lookup_ids
from .order import DEFAULT_ROWS_PER_BUCKET, range_bucket, row_numbers

_WS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN_PATTERN = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{_WS}]"
RESERVED = 4
FIRST_CHARACTERS = 8       # a token that is kept, of the beginning that is taken apart first


def tokenize(c, lower: bool = True) -> Column:
    """array<string> of tokens of one text column (raw, uncleaned text)."""
    c = coerce_text(c)
    if lower:
        c = F.lower(c)
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def build_vocab(tokens: DataFrame, col="tokens", size: int | None = None,
                rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """(token, token_id, n): every token (or the ``size`` most frequent ones),
    numbered by (count desc, token asc) after the reserved ids.

    ``groupBy(token)`` combines map-side, so a token that is a third of all
    tokens is one row per task before the shuffle. The numbering runs over
    range buckets of the counts.
    """
    # outer: an inner explode would get a filter that tokenises a second time
    counts = (tokens.select(F.explode_outer(F.col(col) if isinstance(col, str) else col).alias("token"))
                    .where(F.col("token").isNotNull())
                    .groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("_neg", -F.col("n")))
    if size is not None:
        counts = counts.orderBy("_neg", "token").limit(size)
    bucketed = range_bucket(cut_lineage(counts), ["_neg", "token"], rows_per_bucket)
    numbered = row_numbers(bucketed, [], ["_neg", "token"], out="_rank")
    return numbered.select("token", (F.col("_rank") + (RESERVED - 1)).cast("int").alias("token_id"), "n")


def keep_head(tokens: Column, m: int) -> Column:
    return F.slice(tokens, 1, m)


def keep_head_tail(tokens: Column, m: int) -> Column:
    """Over-long rows keep the first ``m // 3`` and the last ``m - m // 3`` tokens."""
    head = m // 3
    tail = m - head
    return F.when(F.size(tokens) > m,
                  F.concat(F.slice(tokens, 1, head), F.slice(tokens, -tail, tail))).otherwise(tokens)


def _zeros(n: Column, pad: int = PAD_ID) -> Column:
    return F.array_repeat(F.lit(pad), F.greatest(n, F.lit(0)))


def encode(df: DataFrame, vocab: DataFrame, key: str = "id", text: str = "comment_text",
           max_len: int = 220, mode: str = "head", lower: bool = True) -> DataFrame:
    """(key, token_ids[, pad_mask]) of fixed length.

    mode ``head``: start id + first ``max_len - 2`` ids + end id, zero padded
    to ``max_len``. ``head_tail``: same length, over-long rows keep head
    third and tail; adds ``pad_mask`` (0 token / 1 padding, length
    ``max_len - 2``). ``plain``: ids only, zero padded to ``max_len - 2``.
    """
    if mode == "head_tail":
        tokens = df.select(key, tokenize(text, lower).alias("_tokens"))
    else:
        tokens = _first_tokens(df, key, text, max_len - 2, lower)
    return encode_tokens(tokens, vocab, key, "_tokens", max_len, mode)


def _first_tokens(df: DataFrame, key: str, text: str, m: int, lower: bool = True) -> DataFrame:
    """(key, _tokens): the first ``m`` tokens of a text. Only its beginning is
    taken apart if that has more than ``m`` tokens: the cut can change the last
    of them only. Lower-cased before the cut, which looks at what follows."""
    raw = coerce_text(text)
    whole = df.select(key, (F.lower(raw) if lower else raw).alias("_text"))
    # a projection of its own, so that the beginning is taken apart once
    begun = whole.select(key, "_text", tokenize(F.left("_text", F.lit(FIRST_CHARACTERS * m)), False).alias("_first"))
    enough = (F.size("_first") > m) | (F.length("_text") <= FIRST_CHARACTERS * m)
    return begun.select(key, F.when(enough, keep_head(F.col("_first"), m)).otherwise(
        keep_head(tokenize("_text", False), m)).alias("_tokens"))


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str = "id", tokens: str = "tokens",
                  max_len: int = 220, mode: str = "head") -> DataFrame:
    """``encode`` for an already tokenised column."""
    m = max_len - 2
    toks = F.col(tokens)
    kept = keep_head_tail(toks, m) if mode == "head_tail" else keep_head(toks, m)
    ids = lookup_ids(df.select(key, kept.alias("_kept")), key, "_kept", vocab, "_ids")
    return padded(ids, key, max_len, mode)


def padded(df: DataFrame, key: str, max_len: int, mode: str, start: int = CLS_ID, end: int = SEP_ID,
           pad: int = PAD_ID) -> DataFrame:
    """(key, token_ids[, pad_mask]): the kept ids ``_ids`` in a layout of ``encode``."""
    m = max_len - 2
    n = F.size("_ids")
    if mode == "plain":
        seq = F.concat(F.col("_ids"), _zeros(F.lit(m) - n, pad))
    else:
        seq = F.concat(F.array(F.lit(start)), F.col("_ids"), F.array(F.lit(end)), _zeros(F.lit(m) - n, pad))
    cols = [key, seq.alias("token_ids")]
    if mode == "head_tail":
        cols.append(F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.lit(m) - n)).alias("pad_mask"))
    return df.select(*cols)


def attention_mask(ids) -> Column:
    """1 where the id is a real token (id > 0), else 0."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(ids, lambda x: (x > 0).cast("int"))


def zero_count(ids) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return (F.size(ids) - F.size(F.array_remove(ids, 0))).cast("int")


def truncation_stats(df: DataFrame, text: str = "comment_text", max_len: int = 220,
                     lower: bool = True) -> DataFrame:
    """One row: rows, rows cut (more than ``max_len - 2`` tokens), tokens dropped."""
    n = F.size(tokenize(text, lower))
    m = max_len - 2
    return df.select(n.alias("_n")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_n") > m).alias("n_truncated"),
        F.sum(F.greatest(F.col("_n") - m, F.lit(0))).cast("long").alias("n_tokens_dropped"))
