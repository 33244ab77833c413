"""Column expressions for comment text: coercion, cleaning, counters.

All native Spark expressions (no Python worker). The rules follow Python
string semantics of the modelled pipeline: ``len`` counts code points,
``str.split()`` splits on Unicode whitespace, ``str.isupper`` per character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PUNCTUATION_CHARS, SMILIES, SPACE_CHARS, SYMBOL_CHARS

# The separators of Python's str.split() (hex): 09-0d, 1c-20, 85,
# a0, 1680, 2000-200a, 2028, 2029, 202f, 205f, 3000. Java's \s is ASCII only
# and (?U)\s misses U+001C..U+001F, hence the explicit list.
WHITESPACE_CHARS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
WHITESPACE_RUN = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
UPPERCASE = r"\p{IsUppercase}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_text(c, missing: str = "nan") -> Column:
    """Missing text becomes the literal ``missing`` (string coercion of NaN)."""
    return F.coalesce(_c(c).cast("string"), F.lit(missing))


def clean_spaces(c) -> Column:
    """Replace each of the 27 listed invisible / odd space code points by a blank."""
    return F.translate(_c(c), SPACE_CHARS, " " * len(SPACE_CHARS))


def words(c) -> Column:
    """Whitespace-separated words, empty tokens dropped.

    Every separator is first mapped to a blank, so the split is on one
    literal character (no regex scan); ``array_remove`` keeps the projection
    inside whole-stage codegen, where a lambda would not."""
    blanks = F.translate(_c(c), WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))
    return F.array_remove(F.split(blanks, " "), "")


def count_chars(c, chars: str) -> Column:
    """Occurrences of any of ``chars``."""
    c = _c(c)
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("int")


def count_substring(c, pattern: str) -> Column:
    """Non-overlapping occurrences of ``pattern`` (``str.count``)."""
    c = _c(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int")


def counted_chars(c) -> Column:
    """The text reduced to the characters the counters look at (uppercase
    letters and ``!?.,;:*&$%``): one regex pass over the long text, then every
    counter runs on this short string."""
    return F.regexp_replace(_c(c), f"[^!?{PUNCTUATION_CHARS}{SYMBOL_CHARS}{UPPERCASE}]", "")


def meta_feature_exprs(text: Column, word_list: Column, kept: Column | None = None) -> dict[str, Column]:
    """The eleven meta features of one (cleaned) text, its word list and,
    optionally, its ``counted_chars`` projection (computed once upstream)."""
    kept = counted_chars(text) if kept is None else kept
    total = F.length(text).cast("int")
    caps = F.length(F.translate(kept, "!?" + PUNCTUATION_CHARS + SYMBOL_CHARS, "")).cast("int")
    n_words = F.size(word_list)
    n_unique = F.size(F.array_distinct(word_list))
    smilies = sum((count_substring(text, s) for s in SMILIES), F.lit(0)).cast("int")
    return {
        "total_length": total,
        "capitals": caps,
        # empty text: 0/0 -> null -> 0 (the modelled code would raise here)
        "caps_vs_length": F.coalesce(F.try_divide(caps.cast("double"), total.cast("double")), F.lit(0.0)),
        "num_exclamation_marks": count_chars(kept, "!"),
        "num_question_marks": count_chars(kept, "?"),
        "num_punctuation": count_chars(kept, PUNCTUATION_CHARS),
        "num_words": n_words,
        "num_unique_words": n_unique,
        "words_vs_unique": F.coalesce(F.try_divide(n_unique.cast("double"), n_words.cast("double")),
                                      F.lit(0.0)),
        "num_smilies": smilies,
        "num_symbols": count_chars(kept, SYMBOL_CHARS),
    }
