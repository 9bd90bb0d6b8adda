"""The few text steps Spark has no built-in function for, as Arrow-batched UDFs.

Normal forms are decided in the JVM for nearly all texts: a text of characters that no
normal form changes is its own, and marks go by a table from character to character. Only
texts with other characters reach a UDF. Ranges and table are generated from
``unicodedata``, so they are those of the Python that runs the UDFs."""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let

#: Types as objects: a type's name can't be read before there is a session.
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
_CID = re.compile(r"\(cid:\d+\)")
_DELETED = re.compile(r'[\[\]",]')


#: Asked first of each character, since the ranges of a class are asked one by one.
_BEYOND = r"[^\x00-\x7F]"


def _code_points():
    return (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def class_of(test: Callable[[int], bool], longest: int | None = None) -> str:
    """A regular expression's ranges of the code points that pass; with ``longest`` those below
    U+0530 (Latin, Greek, Cyrillic) and that many of the longest others, which are enough where passing is only a short cut."""
    ranges: list[list[int]] = []
    for c in _code_points():
        if test(c):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    if longest is not None:
        rest = sorted((r for r in ranges if r[0] >= 0x530), key=lambda r: r[0] - r[1])[:longest]
        ranges = [r for r in ranges if r[0] < 0x530] + sorted(rest)
    return "".join(rf"\x{{{a:x}}}-\x{{{z:x}}}" for a, z in ranges)


@lru_cache(maxsize=1)
def _inert() -> str:
    """Characters that NFKC leaves alone next to any others: their own form, no combining
    mark, and never the second part of a composition."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in _code_points())
    second = {int(p[1], 16) for p in parts if len(p) == 2 and not p[0].startswith("<")}
    second |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # Hangul vowels and final consonants
    return class_of(lambda c: not unicodedata.combining(chr(c)) and c not in second and unicodedata.is_normalized("NFKC", chr(c)), longest=12)


@lru_cache(maxsize=1)
def _unmarked() -> tuple[str, str, str]:
    """For ``strip_marks``: characters with another character for each, then marks, which have
    none; and the ranges of those that become several or keep a place in an order of marks."""
    one, other, marks, several = [], [], [], set()
    for c in _code_points():
        if unicodedata.category(chr(c)) == "Mn" and unicodedata.normalize("NFD", chr(c)) == chr(c):
            marks.append(chr(c))
            continue
        left = _without_marks(chr(c))
        if len(left) > 1 or unicodedata.combining(chr(c)) and unicodedata.category(chr(c)) != "Mn" or any(unicodedata.combining(x) for x in left):
            several.add(c)
        elif not left:
            marks.append(chr(c))
        elif left != chr(c):
            one.append(chr(c))
            other.append(left)
    return "".join(one + marks), "".join(other), class_of(several.__contains__)


def _without_marks(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")


@F.pandas_udf(_TEXT)
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(_TEXT)
def _strip_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _without_marks(t))


def nfkc(text: Column) -> Column:
    """NFKC form."""
    own = ~text.rlike(rf"{_BEYOND}(?<![{_inert()}])")
    return F.coalesce(F.when(own, text), _nfkc(F.when(~own, text)))


def strip_marks(text: Column) -> Column:
    """NFD form without combining marks."""
    before, after, several = _unmarked()
    plain = ~text.rlike(rf"[{_BEYOND}&&[{several}]]")
    return F.coalesce(F.when(is_ascii(text), text).when(plain, F.translate(text, before, after)), _strip_marks(F.when(~plain, text)))


@F.pandas_udf(_TEXTS)
def printable_characters(s: pd.Series) -> pd.Series:
    """Characters of a transcription: ``(cid:N)`` dropped, NFKC, brackets, quotes and
    commas deleted, of white space only the plain space, nothing unprintable."""

    def one(t):
        t = _CID.sub("", t or "")
        if t.isascii() and t.isprintable():
            return list(_DELETED.sub("", t))
        return [c for c in _DELETED.sub("", unicodedata.normalize("NFKC", t)) if c.isprintable() and (c == " " or not c.isspace())]

    return s.map(one)


#: What JSON and Python read in different ways.
_NOT_BOTH = re.compile(r"\\|true|false|null|NaN|Infinity")


def _as_json(text: str):
    """The value of a literal that reads as JSON as well, single quotes in place of double ones or
    not, which is many times as fast; None for others."""
    if _NOT_BOTH.search(text):
        return None
    try:
        return json.loads(text if '"' in text else text.replace("'", '"'))
    except (ValueError, RecursionError):
        return None


def _parsed(text: str | None):
    if text and (v := _as_json(text)) is not None:
        return v
    try:
        return ast.literal_eval(text) if text else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


@F.pandas_udf(_TEXT)
def literal_to_json(s: pd.Series) -> pd.Series:
    """A Python literal as JSON (tuples as lists); null where it can't be read."""

    def one(t):
        try:
            return None if (v := _parsed(t)) is None else json.dumps(v, ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return s.map(one)


@F.pandas_udf(_TEXTS)
def literal_strings(s: pd.Series) -> pd.Series:
    """A Python list literal's items as strings; null where it isn't a list."""
    return s.map(lambda t: [str(x) for x in v] if isinstance(v := _parsed(t), (list, tuple)) else None)


@F.pandas_udf(_TEXT)
def python_repr(s: pd.Series) -> pd.Series:
    """``str()`` of a list of strings, as a character sequence is scored by default."""
    return s.map(lambda a: None if a is None else str([str(x) for x in a]))


class _Texts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.found.append(data.strip())


def html_texts(html: str | None) -> list[str]:
    parser = _Texts()
    parser.feed(html or "")
    parser.close()
    return parser.found


@F.pandas_udf(_TEXTS)
def html_text_nodes(s: pd.Series) -> pd.Series:
    """Text nodes of HTML, trimmed, of more than one character or a digit."""
    return s.map(lambda t: [x for x in html_texts(t) if len(x) > 1 or x.isdigit()])


@F.pandas_udf(T.ArrayType(_TEXTS))
def html_text_nodes_of_each(s: pd.Series) -> pd.Series:
    """``html_text_nodes`` of each of a row's texts; none for null ones."""
    return s.map(lambda texts: None if texts is None else [[x for x in html_texts(t) if len(x) > 1 or x.isdigit()] for t in texts])


def _strict(text: str | None) -> bool:
    try:
        json.loads(text)
        return True
    except (TypeError, ValueError):
        return False


@F.pandas_udf(T.BooleanType())
def is_strict_json(s: pd.Series) -> pd.Series:
    """Whether a text is one JSON value and nothing else."""
    return s.map(_strict)


def _flat(v) -> str:
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, dict):
        return " ".join(map(_flat, v.values()))
    if isinstance(v, list):
        return " ".join(map(_flat, v))
    return str(v)


@F.pandas_udf(_TEXT)
def flatten_json(s: pd.Series) -> pd.Series:
    """All leaves of a JSON value in order, joined by spaces; not JSON: the text itself."""

    def one(t):
        try:
            return _flat(json.loads(t))
        except (TypeError, ValueError):
            return t or ""

    return s.map(one)


def letters_unmarked(text: Column) -> Column:
    """``strip_marks`` for texts of which only ASCII letters and digits are kept, all in the JVM. Of
    characters that become several none becomes one of these, and marks change places
    among themselves only, so both stay as they are."""
    before, after, _ = _unmarked()
    return let(text, lambda t: F.when(is_ascii(t), t).otherwise(F.translate(t, before, after)))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")
