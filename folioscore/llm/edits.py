"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A document's state is a row: its text, and its tree as one binary value with the words'
(pre-tokens') sizes in characters and in tokens, how they are cut into chunks of leaves,
and the sums of every subtree.
``trees`` makes it, ``apply_edits`` takes it with a list of edits and returns it as the
edits leave it, so that states are written and taken up again by the next round; a text
is encoded as a whole once, by ``trees``.

An edit replaces ``length`` characters from ``start`` by ``text``; edits apply one after
the other, each to the text as the ones before left it. Going down the tree by character
sums finds the words that an edit touches. Only that region is cut and encoded again,
with context on both sides: where words are cut depends on a few characters around them
(a space goes to the word behind it, a run of blanks gives up its last, special strings
are cut out first), so the region grows, doubling, until its first and last new words are
words the document had before. The new words' leaves replace the old ones in their
chunks, and sums are updated upward from those chunks. Chunks have room for twice their
leaves; only where they overflow is the tree laid out anew, from the chunks' sums.

Rows: a null text is empty, a null edit list holds no edits, a null edit or one
with a null start is skipped, null length is 0 and null text is empty. Starts and
lengths are clipped to the text. Every row gives one row. Repeated rows and extra columns
change nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import encoder, split_words, text_groups

#: Leaves of one chunk: a chunk with more than twice as many is split.
CHUNK = 256
EDITS = "array<struct<start:int,length:int,text:string>>"
STATE = "doc_id long, text string, n_tokens long, tree binary"
EDITED = f"{STATE}, tokens_before long, n_edits int, reencoded_chars long"
#: Bytes of a stored leaf's sizes, leaves, chunks and nodes of a stored tree.
_HEAD = struct.Struct("<BxxxIII")


class SumTree:
    """Segment tree over (characters, tokens) of chunks of leaves. Node i's children are
    2i and 2i + 1; the chunks are the nodes from ``width`` on."""

    def __init__(self, chunks: list[np.ndarray], sums: np.ndarray | None = None):
        self.chunks = chunks
        if sums is None:
            self._lay_out(np.array([c.sum(0) for c in chunks], np.int64))
        else:
            self.sums, self.width = sums, len(sums) // 2

    def _lay_out(self, own: np.ndarray) -> None:
        """A tree over chunks with the sums ``own``."""
        self.width = 1 << max(0, (len(own) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(own)] = own
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    @classmethod
    def of(cls, leaves: np.ndarray) -> SumTree:
        return cls([leaves[i : i + CHUNK] for i in range(0, len(leaves), CHUNK)] or [leaves])

    @property
    def total(self) -> np.ndarray:
        return self.sums[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """(chunk, leaf in it, characters before it) of the leaf that holds character ``at``;
        behind the end, one leaf past the last chunk's."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.sums[node, 0] and self.sums[node + 1].any():
                before += int(self.sums[node, 0])
                node += 1
        chunk = node - self.width
        ends = np.cumsum(self.chunks[chunk][:, 0])
        leaf = int(np.searchsorted(ends, at - before, side="right"))
        return chunk, leaf, before + (int(ends[leaf - 1]) if leaf else 0)

    def replace(self, first: tuple[int, int], last: tuple[int, int], leaves: np.ndarray) -> None:
        """Put ``leaves`` in place of those from ``first`` up to (without) ``last``."""
        (c0, l0), (c1, l1) = first, last
        new = np.concatenate((self.chunks[c0][:l0], leaves, self.chunks[c1][l1:]))
        slots = c1 - c0 + 1
        if len(new) <= 2 * CHUNK * slots:  # they fit where the old ones were
            self.chunks[c0 : c1 + 1] = np.array_split(new, slots)
            nodes = range(self.width + c0, self.width + c1 + 1)
            for node in nodes:
                self.sums[node] = self.chunks[node - self.width].sum(0)
            while nodes[0] > 1:
                nodes = range(nodes[0] // 2, nodes[-1] // 2 + 1)
                for node in nodes:
                    self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            return
        parts = np.array_split(new, -(-len(new) // CHUNK))
        n = len(self.chunks)
        own = self.sums[self.width : self.width + n]
        self.chunks[c0 : c1 + 1] = parts
        self._lay_out(np.concatenate((own[:c0], np.array([c.sum(0) for c in parts], np.int64), own[c1 + 1 :])))

    def leaves(self) -> np.ndarray:
        return np.concatenate(self.chunks)

    def dump(self) -> bytes:
        """The tree as bytes: head, leaves (characters and tokens in turn), leaves of each chunk, sums of each node."""
        leaves = self.leaves()
        kind = np.dtype("<u1" if not len(leaves) or leaves.max() < 256 else "<u4")
        head = _HEAD.pack(kind.itemsize, len(leaves), len(self.chunks), len(self.sums))
        return b"".join((head, leaves.astype(kind).tobytes(), np.array([len(c) for c in self.chunks], "<u4").tobytes(), self.sums.astype("<i8").tobytes()))

    @classmethod
    def load(cls, data: bytes) -> SumTree:
        size, n, chunks, nodes = _HEAD.unpack_from(data)
        leaves = np.frombuffer(data, "<u1" if size == 1 else "<u4", 2 * n, _HEAD.size).reshape(-1, 2).astype(np.int64)
        ends = np.cumsum(np.frombuffer(data, "<u4", chunks, _HEAD.size + 2 * n * size))
        sums = np.frombuffer(data, "<i8", 2 * nodes, _HEAD.size + 2 * n * size + 4 * chunks).reshape(-1, 2).copy()
        return cls([leaves[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], sums)



class Counter:
    """Leaves of texts, and texts under edit."""

    def __init__(self, tokenizer_path: str):
        self.enc = encoder(tokenizer_path)
        self.reach = max([1, *map(len, self.enc.specials)])

    def leaves(self, texts: pa.Array) -> list[np.ndarray]:
        words, first = split_words(texts, self.enc.specials)
        coded = words.dictionary_encode()
        packed = pa.array(self.enc.encode_words(coded.dictionary.to_pylist()), pa.large_binary())
        sizes = np.stack((pc.utf8_length(coded.dictionary.cast(pa.large_string())).to_numpy(), pc.binary_length(packed).to_numpy() // self.enc.width), 1).astype(np.int64)
        every = sizes[coded.indices.to_numpy()] if len(coded) else np.zeros((0, 2), np.int64)
        return [every[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def region_leaves(self, region: str) -> np.ndarray:
        """Leaves of a short text: the library's own cut, where no special string is in it."""
        if any(x in region for x in self.enc.specials):
            return self.leaves(pa.array([region], pa.large_string()))[0]
        spans = [at for _, at in self.enc.tok.pre_tokenizer.pre_tokenize_str(region)]
        packed = self.enc.encode_words([region[a:b].encode() for a, b in spans])
        return np.array([(b - a, len(p) // self.enc.width) for (a, b), p in zip(spans, packed, strict=True)], np.int64).reshape(-1, 2)

    def apply(self, tree: SumTree, text: str, start: int, length: int, put: str) -> tuple[str, int]:
        """The edited text, and how many characters were encoded again. ``tree`` is updated."""
        start = min(max(0, start), len(text))
        stop = min(len(text), start + max(0, length))
        if start == stop and not put:
            return text, 0
        edited, shift = text[:start] + put + text[stop:], len(put) - (stop - start)
        room = self.reach
        while True:
            c0, l0, lo = tree.find(max(0, start - room))
            c1, l1, hi = tree.find(min(len(text), stop + room))
            if hi < min(len(text), stop + room):  # up to that leaf's end
                hi += int(tree.chunks[c1][l1, 0])
                l1 += 1
            region = edited[lo : hi + shift]
            leaves = self.region_leaves(region)
            ends = np.cumsum(leaves[:, 0])
            # Settled where the outermost words lie outside the edit and were words before.
            left = lo == 0 or (len(leaves) and ends[0] <= start - lo and ends[0] == tree.chunks[c0][l0, 0] and self._calm(edited, lo, lo + int(ends[0])))
            right = hi == len(text) or (len(leaves) and l1 and len(region) - leaves[-1, 0] >= start - lo + len(put) and leaves[-1, 0] == tree.chunks[c1][l1 - 1, 0] and self._calm(edited, hi + shift - int(leaves[-1, 0]), hi + shift))
            if left and right:
                tree.replace((c0, l0), (c1, l1), leaves)
                return edited, len(region)
            room *= 2

    @staticmethod
    def _calm(text: str, a: int, b: int) -> bool:
        """A word at the region's edge counts as settled if it is letters or digits, perhaps
        behind a space: the cut at its far side can't depend on what lies beyond the region."""
        word = text[a:b].removeprefix(" ")
        return word.isalpha() and (b == len(text) or not text[b].isalpha()) and (a == 0 or text[a] == " " or not (text[a - 1] == "'" or text[a - 1].isalpha()))


_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
_NAMES = [c.split()[0] for c in EDITED.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS[: len(cols)], strict=True)], names=_NAMES[: len(cols)])


def trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The ``STATE`` of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            for lo, hi in text_groups(batch.column(1)):
                ids, texts = (batch.column(i).slice(lo, hi - lo) for i in (0, 1))
                own = [SumTree.of(x) for x in counter.leaves(texts)]
                yield _batch([(i, t or "", int(tree.total[1]), tree.dump()) for i, t, tree in zip(ids.to_pylist(), texts.to_pylist(), own, strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STATE)


def apply_edits(state: DataFrame, tokenizer_path: str, edits: str = "edits") -> DataFrame:
    """Apply each row's ``edits`` (``EDITS``), in order, to its state (the columns of
    ``STATE``): the state after them, and tokens_before, n_edits and reencoded_chars. Only
    regions around edits are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, last = Counter(tokenizer_path), len(_STATE_NAMES)
        for batch in batches:
            for lo, hi in text_groups(batch.column(1)):
                rows = []
                for i in range(lo, hi):
                    text, before = batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py()
                    tree = SumTree.load(batch.column(3)[i].as_py())
                    done, again = 0, 0
                    for e in batch.column(last)[i].as_py() or []:
                        if e is not None and e["start"] is not None:
                            text, n = counter.apply(tree, text, e["start"], e["length"] or 0, e["text"] or "")
                            done, again = done + 1, again + n
                    rows.append((batch.column(0)[i].as_py(), text, int(tree.total[1]), tree.dump(), before, done, again))
                yield _batch(rows)

    return state.select(*_STATE_NAMES, F.col(edits).cast(EDITS).alias("_edits")).mapInArrow(run, EDITED)


_STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def sample_edits(text: Column, key: Column) -> Column:
    """Three edits that depend on the text's length and ``key`` alone: a deletion, an
    insertion and a replacement."""
    n = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    spot = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), n).cast("int")
    edit = lambda at, length, put: F.struct(at.alias("start"), F.lit(length).alias("length"), F.lit(put).alias("text"))
    return F.array(edit(spot(1), 12, ""), edit(spot(2), 0, " it's revised, 2nd draft "), edit(spot(3), 5, "\n\nedited"))
