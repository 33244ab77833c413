"""Byte-level pre-tokens, shared by the token counter and the BPE codec.

The pre-token pattern is run by ``regex``. That library knows newer Unicode
versions than the tokenizer libraries do, so a few code points (unassigned for
them) fall in other classes; texts that hold one of those are split by the
tokenizer library itself, which is exact and slow.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Regex, pre_tokenizers

PIECE = regex.compile(public_tokenizers.PATTERN)


def library_splitter():
    return pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")


@lru_cache(maxsize=1)
def odd_characters() -> str:
    """Characters that ``regex`` and the tokenizer library class differently:
    each letter, number or space of ``regex`` that Python's older tables do
    not know is put to the library beside a character of its class."""
    split, partner = library_splitter(), {"L": "a", "N": "1", "S": "\n"}
    known = regex.compile(r"(?P<L>\p{L})|(?P<N>\p{N})|(?P<S>\s)")
    odd = []
    for code in range(0x110000):
        ch = chr(code)
        if unicodedata.category(ch) == "Cn" and (m := known.match(ch)):
            if len(split.pre_tokenize_str(partner[m.lastgroup] + ch)) != 1:
                odd.append(ch)
    return "".join(odd)


def ranges(characters: str) -> str:
    """Sorted characters as ranges of a character class."""
    runs: list[list[int]] = []
    for code in map(ord, characters):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Pieces:
    """Splits texts into pre-tokens as the tokenizer library does."""

    def __init__(self, odd: str):
        self._odd = re.compile("[" + ranges(odd) + "]") if odd else None
        self._split = library_splitter()

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and self._odd is not None and self._odd.search(text):
            return [p for p, _ in self._split.pre_tokenize_str(text)]
        return PIECE.findall(text)


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """Byte -> printable character, by the rule of byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in byte order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@lru_cache(maxsize=1)
def character_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


@lru_cache(maxsize=1)
def _mapping() -> dict[int, str]:
    return dict(enumerate(byte_characters()))


def mapped(piece: str) -> str:
    """A pre-token with each UTF-8 byte as its printable character."""
    return piece.encode("utf-8").decode("latin-1").translate(_mapping())


def units(text: str) -> tuple[str, list[str]]:
    """(head, rest): the text cut before each space. A space between two other
    characters that are no white space always starts a pre-token, so such parts
    can be split alone; ``rest`` holds them without their space."""
    head, *rest = text.split(" ")
    return head, rest


def standalone(unit: str) -> bool:
    """Whether " " + unit can be split alone, and the unit after it too."""
    return bool(unit) and not unit[0].isspace() and not unit[-1].isspace()


class Parts(dict):
    """space-started part -> ``value(" " + part)``, None if it can't be split alone."""

    def __init__(self, value):
        super().__init__()
        self._value = value

    def __missing__(self, unit: str):
        found = self[unit] = self._value(" " + unit) if standalone(unit) else None
        return found


def chunks(texts, size: int = 1 << 18):
    """Lists of texts of about ``size`` characters together (a longer text alone)."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part
