"""Quality rules, line first: each line is judged by punctuation, navigation
and boilerplate rules, failing lines are removed, and a document that loses
too large a share of its words is rejected.

Only DataFrame functions; every row is judged by itself, so there is no
shuffle and no state beyond one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, WORD, whole, words

SYMBOLS = "#*$%&|<>"
# Phrases of page furniture; a line that holds one and is short is boilerplate.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "uses cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
    "click here", "read more", "sign up", "sign in", "log in", "subscribe to", "share this",
    "powered by", "copyright ©", "(c) copyright", "skip to content", "back to top",
)
# Those of them, of two words each, that are everyday prose as well: they count
# only where they make up more than half of the line's words.
EVERYDAY_WORDS = 2
EVERYDAY = ("click here", "read more", "sign up", "sign in", "log in", "subscribe to", "share this", "powered by")


@dataclass(frozen=True)
class LineRules:
    """Thresholds; shares are of a line's words."""
    max_symbol_share: float = 0.3      # punctuation: symbol characters per word
    max_doubled_share: float = 0.3     # punctuation: runs of !!, ?? or .... per word
    unfinished_words: int = 4          # punctuation: as short and without a closing mark is a stub
    max_separator_share: float = 0.2   # navigation: lone separators among the words
    boilerplate_words: int = 25        # boilerplate phrases count in lines up to this long
    max_lost_share: float = 0.3        # a document losing more of its words is rejected
    min_words: int = 50
    max_repeat_percent: int = 50


# Marks without which no symbol, doubled-mark or separator rule can fail.
ANY_MARK = r"[#*$%&|<>»›•·]|::|[!?]{2}|[.]{4}"
CLOSED = r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""
DOUBLED = r"[!?]{2,}|[.]{4,}"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])(?:[|>»›•·]|::)(?=$|[\x20\x09-\x0D])"


def word_count(line: Column) -> Column:
    """Words of a line that has at least one."""
    return F.size(F.split(F.btrim(line, F.lit(SPACES)), SPACE))


def _whole_phrases(phrases: tuple[str, ...]) -> str:
    """Any of the phrases, not as parts of longer words."""
    def bordered(p: str) -> str:
        left = r"(?<![\p{L}\p{N}_])" if p[0].isalnum() else ""
        right = r"(?![\p{L}\p{N}_])" if p[-1].isalnum() else ""
        return left + p.replace("(", r"\(").replace(")", r"\)") + right
    return "(?i)" + "|".join(map(bordered, phrases))


FURNITURE_PHRASES = _whole_phrases(tuple(p for p in BOILERPLATE if p not in EVERYDAY))
EVERYDAY_PHRASES = _whole_phrases(EVERYDAY)


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with at least one word fails a rule. Cheap tests come
    first: the counting patterns run only on lines with such a mark."""
    return _let(word_count(line), lambda n: (
        (line.rlike(ANY_MARK)
         & ((symbol_count(line) > rules.max_symbol_share * n)
            | (F.regexp_count(line, F.lit(DOUBLED)) > rules.max_doubled_share * n)
            | (F.regexp_count(line, F.lit(SEPARATOR)) > rules.max_separator_share * n)))
        | ((n <= rules.unfinished_words) & ~line.rlike(CLOSED))
        | ((n <= rules.boilerplate_words)
           & (line.rlike(FURNITURE_PHRASES) | (2 * EVERYDAY_WORDS * F.regexp_count(line, F.lit(EVERYDAY_PHRASES)) > n)))))


def repeated_window_words(w: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more, of the word
    array ``w``: windows are hashed, sorted with their positions, and those
    equal to a neighbour are kept; each covers as many new words as its
    distance from the one before, three at most."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def ordered(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def positions(p: Column) -> Column:
        m = F.size(p)
        twin = F.filter(p, lambda x, k: ((k > 0) & (x["h"] == p[F.greatest(k - 1, F.lit(0))]["h"]))
                        | ((k < m - 1) & (x["h"] == p[F.least(k + 1, m - 1)]["h"])))
        return F.sort_array(F.transform(twin, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"])

    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        _let(ordered(h), lambda p: _let(positions(p), covered)))))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def quality(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``df`` with the counts, the verdict and the cleaned text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word, equal to an earlier line), n_repeat_words, base_failed,
    n_lost (words in removed lines), kept, clean_text (the lines that pass,
    others removed; lines without words stay).

    One output row per input row, repeated rows included. Null or empty text:
    all counts 0, base_failed true, kept false, clean_text empty. Input columns
    of these names are replaced, all others kept.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "n_lost", "kept", "clean_text")
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    t, w = F.col("_t"), F.col("_w")
    with_words = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    cut = df.select(*rest, whole(text).alias("_t")).withColumns({"_w": words("_t"), "_l": with_words})
    bad = F.filter("_l", lambda x: line_fails(x, rules))
    counted = cut.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.when(t.rlike(f"[{SYMBOLS}]"), symbol_count(t)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(w).cast("long").alias("n_repeat_words"),
        bad.alias("_bad"))
    lost = F.aggregate("_bad", F.lit(0), lambda s, x: s + word_count(x)).cast("long")
    clean = F.when(F.size("_bad") == 0, t).otherwise(F.array_join(
        F.filter(F.split(t, "\n"), lambda x: ~x.rlike(WORD) | ~line_fails(x, rules)), "\n"))
    judged = counted.select(
        "*",
        ((F.col("n_words") < rules.min_words)
         | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        lost.alias("n_lost"), clean.alias("clean_text"))
    return judged.select(
        *rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost",
        (~F.col("base_failed") & (F.col("n_lost") <= rules.max_lost_share * F.col("n_words"))).alias("kept"),
        "clean_text")


def kept_documents(df: DataFrame, text: str = "text", n_chars: str = "n_chars",
                   rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, in the columns of ``df``: failing lines are
    removed from the text and ``n_chars`` (if there) counts the rest. Documents
    without a failing line are unchanged."""
    columns = df.columns
    judged = quality(df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
                               F.col(f"`{text}`").alias("_text")), "_text", rules)
    new = {text: F.col("clean_text")}
    if n_chars in columns:
        new[n_chars] = F.when(F.col("n_lost") > 0, F.length("clean_text")).otherwise(
            F.col("_row").getField(n_chars)).cast(df.schema[n_chars].dataType)
    # through a generator: the optimizer would copy the whole verdict into a
    # filter on ``kept`` itself and compute it twice
    verdict = judged.select("*", F.explode(F.array("kept")).alias("_keep"))
    return verdict.where("_keep").select(
        *[new.get(c, F.col("_row").getField(c)).alias(c) for c in columns])
