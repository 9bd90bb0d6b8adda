"""Pre-token splitting and distinct-word encoding for byte-level BPE vocabularies.

A byte-level tokenizer cuts a text into pre-tokens ("words": contractions, runs
of letters, digits or other signs with at most one space before them, runs of
white space) and merges bytes inside each word only. So a word always has the
same ids, and a text's ids are its words' ids in order. Here the cut is done for
a whole Arrow batch with NumPy, and only distinct words reach the tokenizer.
"""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, DIGIT, SIGN, SPACE, OUTSIDE = range(5)
#: Texts are cut in groups of about so many bytes, which bounds the arrays' size.
GROUP_BYTES = 1 << 20
#: Distinct words that one generation of an encoder's memory holds.
MEMORY_WORDS = 400_000


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer takes out of a text before it cuts words."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path} isn't a plain byte-level tokenizer")
    return tuple(t["content"] for t in spec.get("added_tokens", []))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, asked of the tokenizer library's own pattern
    engine so that its Unicode version is the one that counts."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(0x110000, SIGN, dtype=np.uint8)
    cuts = [(pre_tokenizers.Split(Regex(pattern), "removed"), kind) for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE))]
    for lo in range(0, 0x110000, 0x800):  # in pieces: the library keeps a good deal for every character
        if 0xD800 <= lo < 0xE000:
            continue
        text = "".join(map(chr, range(lo, lo + 0x800)))
        for cut, kind in cuts:
            rest = np.zeros(0x800, dtype=bool)
            for _, (a, b) in cut.pre_tokenize_str(text):
                rest[a:b] = True
            table[lo : lo + 0x800][~rest] = kind
    return table


def _special_spans(data: bytes, specials: tuple[str, ...]) -> list[tuple[int, int]]:
    """Leftmost non-overlapping byte spans of the special strings, the longest first at a tie."""
    found = []
    for s in specials:
        raw, at = s.encode(), 0
        while (at := data.find(raw, at)) >= 0:
            found.append((at, -len(raw)))
            at += 1
    spans, end = [], 0
    for a, neg in sorted(found):
        if a >= end:
            end = a - neg
            spans.append((a, end))
    return spans


def _cut(data: bytes, text_at: np.ndarray, specials: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of texts that lie end to end in ``data`` from the
    offsets ``text_at``, and for each text the number of its first word; both have
    one entry more for the end."""
    chars = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype="<u4")
    n = len(chars)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(text_at), np.int64)
    ascii_only = n == len(data)
    at = np.arange(n + 1) if ascii_only else np.concatenate(([0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800).astype(np.int64) + (chars >= 0x10000))))
    text_char = text_at if ascii_only else np.searchsorted(at, text_at)
    kind = char_classes()[chars]
    first = np.zeros(n + 1, dtype=bool)  # first character of a text, or of what follows a special string
    first[text_char] = True
    for a, b in _special_spans(data, specials):
        i, j = (a, b) if ascii_only else np.searchsorted(at, (a, b))
        if first[i + 1 : j].any():
            continue  # it would run from one text into the next
        kind[i:j] = OUTSIDE
        first[i] = first[j] = True
    before = np.empty_like(kind)
    before[1:], before[0] = kind[:-1], OUTSIDE
    before[first[:n]] = OUTSIDE
    after = np.empty_like(kind)
    after[:-1], after[-1] = kind[1:], OUTSIDE
    after[first[1:]] = OUTSIDE
    blank_before = np.empty(n, dtype=bool)
    blank_before[0], blank_before[1:] = False, chars[:-1] == 0x20
    blank_before &= before == SPACE
    begins = ((kind <= SIGN) & (kind != before) & ~blank_before) | ((kind == SPACE) & ((before != SPACE) | (after <= SIGN)))
    begins |= first[:n]
    quotes = np.flatnonzero((chars == 0x27) & begins & (kind == SIGN) & (after == LETTER))
    if len(quotes):
        one = chars[quotes + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        third = quotes + 2
        inside = third < n
        inside[inside] &= ~first[third[inside]]
        two = np.where(inside, chars[np.minimum(third, n - 1)], 0)
        long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        taken = quotes[short | long]
        begins[taken + 1] = False
        ends = taken + np.where(short, 2, 3)[short | long]
        ends = ends[ends < n]
        begins[ends[kind[ends] == LETTER]] = True
    starts = np.flatnonzero(begins)
    return np.append(at[starts], len(data)), np.searchsorted(starts, text_char)


def text_groups(texts: pa.Array, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``group_bytes`` each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + group_bytes)))
        yield lo, hi
        lo = hi


def split_words(texts: pa.Array, specials: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (null: none) as one binary array, and the number of each text's
    first word, with one entry more for the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = memoryview(raw)[offsets[0] : offsets[-1]].tobytes() if raw is not None else b""
    at, first = _cut(data, offsets - offsets[0], specials)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    return words, first


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not the GNU library
        return lambda _: 0


def tidy() -> None:
    """Give free memory back: a Python worker lives on from stage to stage beside others."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


class WordEncoder:
    """Ids of words as packed little-endian integers, each distinct word encoded
    once while it stays in memory (two generations of ``MEMORY_WORDS``)."""

    def __init__(self, path: str, width: int | None = None):
        self.tok, self.specials = load_tokenizer(path), special_strings(path)
        self.width = width or id_width(path)
        self.type = np.dtype("<u2" if self.width == 2 else "<u4")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        out = [young.get(w) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            if (x := old.get(words[i])) is not None:
                out[i] = young[words[i]] = x
            else:
                new.append(i)
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            for i, e in zip(some, self.tok.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = young[words[i]] = np.array(e.ids, dtype=self.type).tobytes()
        if len(young) > MEMORY_WORDS:
            self.young, self.old = {}, young
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin, with the end."""
        words, first = split_words(texts, self.specials)
        coded = words.dictionary_encode()
        per_word = pa.array(self.encode_words(coded.dictionary.to_pylist()), pa.large_binary())
        packed = per_word.take(coded.indices)
        if not len(packed):
            return np.zeros(0, self.type), np.zeros(len(first), np.int64)
        at = np.frombuffer(packed.buffers()[1], dtype=np.int64)[: len(packed) + 1]
        ids = np.frombuffer(packed.buffers()[2] or b"", dtype=self.type, count=int(at[-1]) // self.width)
        return ids, at[first] // self.width


def id_width(path: str) -> int:
    """Bytes for an id: two where the vocabulary allows, else four."""
    return 2 if load_tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return WordEncoder(path)


@lru_cache(maxsize=1)
def byte_of_sign() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary:
    printable Latin-1 stands for itself, the other bytes for 256, 257, ... in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a vocabulary piece; a piece with any other sign stands for itself."""
    table = byte_of_sign()
    return bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
