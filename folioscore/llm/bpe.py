"""BPE encoding and decoding by a table of distinct words.

Byte-level BPE gives a word (pre-token) the same ids wherever it stands, and a
corpus has far fewer distinct words than words. So texts are never shuffled:

1. Each partition of the documents (a *block*) cuts its texts into words and
   sends its distinct words: one row for each (block, word).
2. Those rows are grouped by word, with a word's blocks as a list. Each distinct
   word is encoded once; its ids are exploded and joined to the vocabulary's
   id-to-piece table (broadcast: it has the vocabulary's size, whatever the
   corpus), which gives the decoded bytes.
3. The word table goes back to the words' blocks and is written to the shared
   folder, partitioned by block: each block's own dictionary.
4. Each block cuts its texts again and lays its dictionary's ids and bytes out by
   position.

A block finds its dictionary by partition number. If a plan deals its rows anew
between the two passes, words missing there are encoded and decoded in place, so
the result never depends on it; the column ``in_place`` counts them, and is 0 wherever
the table did all the work. A frequent word costs a block one row, however
often it stands there, so no word can be a hot key.

Rows: null text is empty text, with no ids. Every input row gives one output row;
equal doc_ids or texts and extra columns change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, new_path, shuffle_partitions, staged
from .words import encoder, id_width, load_tokenizer, piece_bytes, special_strings, split_words, text_groups, tidy

#: Distinct words a block gathers before it sends them; more words go in several rounds.
BLOCK_WORDS = 400_000
_BATCH = 50_000


def pieces(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """(id, piece bytes) of the vocabulary, added tokens included."""
    vocab = load_tokenizer(tokenizer_path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, bytearray(piece_bytes(p))) for p, i in vocab.items()), "id int, piece binary")


def block_words(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(block, word) for the distinct words of each partition of ``docs`` (text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, specials, seen = TaskContext.get().partitionId(), special_strings(tokenizer_path), set()

        def sent() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for lo in range(0, len(words), _BATCH):
                some = words[lo : lo + _BATCH]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block, np.int32)), pa.array(some, pa.binary())], names=["block", "word"])

        for batch in batches:
            for lo, hi in text_groups(batch.column(0)):
                words, _ = split_words(batch.column(0).slice(lo, hi - lo), specials)
                seen.update(words.unique().to_pylist())
                if len(seen) >= BLOCK_WORDS:
                    yield from sent()
                    seen.clear()
            tidy()
        yield from sent()
        seen.clear()
        tidy()

    return docs.select("text").mapInArrow(cut, "block int, word binary")


def word_table(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, blocks, ids, piece) for distinct ``words`` (word binary, blocks array<int>):
    packed little-endian ids, and the decoded bytes from the id-to-piece join, null where
    they are the word's own. The encoded words are written before the join, so that a task
    never has two Python workers."""
    width = id_width(tokenizer_path)
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer_path)
        for batch in batches:
            found = [np.array(e.ids, np.int32) for e in tok.encode_batch_fast([w.decode() for w in batch.column(0).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["word", "blocks", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A broadcast join keeps its stream's order: a word's rows stay together, by position.
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = (pa.concat_tables([rest, part]) if rest is not None else part).combine_chunks()
            pos, n = (part[c].to_numpy() for c in ("pos", "n"))
            first = np.flatnonzero(pos == 0)
            whole = int(first[-1]) + (int(n[first[-1]]) if first[-1] + n[first[-1]] <= len(pos) else 0)
            rest = part.slice(whole) if whole < len(pos) else None
            first = first[first < whole]
            if not len(first):
                if len(pos) and pos[0] != 0:
                    raise ValueError("a word's ids aren't side by side")
                continue
            if not np.array_equal(np.append(first[1:], whole), first + n[first]) or not np.array_equal(pos[:whole], np.arange(whole) - np.repeat(first, n[first])):
                raise ValueError("a word's ids aren't side by side")
            ids = part["id"].to_numpy()[:whole].astype(kind)
            ends = np.append(first, whole)
            words = part["word"].combine_chunks().cast(pa.large_binary()).take(pa.array(first))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer((ends * width).astype(np.int64)), pa.py_buffer(ids.tobytes())])
            piece = part["piece"].combine_chunks().cast(pa.large_binary()).slice(0, whole).take(pa.array(np.arange(whole)))
            at = np.frombuffer(piece.buffers()[1], np.int64)[: whole + 1]
            joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at[ends].copy()), piece.buffers()[2]])
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), part["blocks"].combine_chunks().take(pa.array(first)), packed.cast(pa.binary()), pc.if_else(pc.equal(words, joined), pa.scalar(None, pa.large_binary()), joined).cast(pa.binary())], names=["word", "blocks", "ids", "piece"])

    encoded = staged(words.select("word", "blocks").mapInArrow(encode, "word binary, blocks array<int>, ids array<int>"), "encoded-words")
    # A word and its blocks stand in the first of its rows only.
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    long = encoded.select("word", "blocks", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "id")).select(first("word"), first("blocks"), "pos", "n", "id")
    return long.join(F.broadcast(pieces(words.sparkSession, tokenizer_path)), "id").select("word", "blocks", "pos", "n", "id", "piece").mapInArrow(assemble, "word binary, blocks array<int>, ids binary, piece binary")


def write_dictionaries(docs: DataFrame, tokenizer_path: str) -> str:
    """Write each block's dictionary (word, ids, piece) and return the folder. A file is moved
    to its block's folder when it is whole; one of a task that ran again says the same again."""
    spark = docs.sparkSession
    out = new_path(spark, "block-dictionaries")
    words = block_words(docs, tokenizer_path).groupBy("word").agg(F.collect_list("block").alias("blocks"))
    found = word_table(words, tokenizer_path).select(F.explode("blocks").alias("block"), "word", "ids", "piece")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block = table["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and block[lo] != now:
                    done.append(_write_dictionary(out, now, held))
                    held = []
                now = int(block[lo])
                held.append(table.slice(lo, hi - lo).drop_columns(["block"]))
        if held:
            done.append(_write_dictionary(out, now, held))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["words"])
        tidy()

    found.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block").mapInArrow(write, "words long").agg(F.sum("words")).collect()
    return out


def _write_dictionary(folder: str, block: int, parts: list[pa.Table]) -> int:
    import pyarrow.parquet as pq

    store, root = filesystem(folder)
    place, name = f"{root}/block={block}", f"{uuid.uuid4().hex}.parquet"
    store.create_dir(place, recursive=True)
    table = pa.concat_tables(parts)
    with store.open_output_stream(f"{place}/.{name}.part") as f:
        pq.write_table(table, f)
    store.move(f"{place}/.{name}.part", f"{place}/{name}")
    return len(table)


@lru_cache(maxsize=2)
def _piece_list(tokenizer_path: str) -> dict[int, bytes]:
    return {i: piece_bytes(p) for p, i in load_tokenizer(tokenizer_path).get_vocab(with_added_tokens=True).items()}


def _read_dictionary(folder: str, block: int) -> pa.Table:
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = filesystem(f"{folder}/block={block}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return pa.table({c: pa.array([], pa.binary()) for c in ("word", "ids", "piece")})
    parts = [pq.read_table(f.path, filesystem=store, columns=["word", "ids", "piece"], partitioning=None) for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet")]
    return pa.concat_tables(parts).combine_chunks()


def lay_out(docs: DataFrame, tokenizer_path: str, dictionaries: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded text and in_place (words of the text's group, on
    the group's first row, that weren't in the block's dictionary) of ``docs`` (doc_id, text)."""
    width = id_width(tokenizer_path)
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, known = special_strings(tokenizer_path), None
        tidy()
        for batch in batches:
            if known is None:
                known = _read_dictionary(dictionaries, TaskContext.get().partitionId())
                known_words, known_ids = (known[c].combine_chunks().cast(pa.large_binary()) for c in ("word", "ids"))
                known_piece = pc.coalesce(known["piece"], known["word"]).combine_chunks().cast(pa.large_binary())
                known = True
            for lo, hi in text_groups(batch.column(1)):
                words, first = split_words(batch.column(1).slice(lo, hi - lo), specials)
                coded = words.dictionary_encode()
                place = pc.index_in(coded.dictionary, known_words)
                ids, piece = known_ids.take(place), known_piece.take(place)
                if place.null_count:
                    ids, piece = _in_place(coded.dictionary, ids, piece, tokenizer_path)
                ids, piece = ids.take(coded.indices), piece.take(coded.indices)
                id_at, piece_at = (np.frombuffer(x.buffers()[1], np.int64)[: len(x) + 1] if len(x) else np.zeros(1, np.int64) for x in (ids, piece))
                values = np.frombuffer(ids.buffers()[2] or b"", kind, count=int(id_at[-1]) // width).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
                data = piece.buffers()[2] if len(piece) else None
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array((id_at[first] // width).astype(np.int32)), pa.array(values)),
                        _texts(data, piece_at[first]),
                        pa.array([place.null_count] + [0] * (hi - lo - 1), pa.int64()),
                    ],
                    names=["doc_id", "ids", "decoded", "in_place"],
                )
            tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lay, "doc_id long, ids array<int>, decoded string, in_place long")


def _texts(data: pa.Buffer | None, at: np.ndarray) -> pa.Array:
    """The bytes between the offsets as strings, broken UTF-8 replaced as the library does."""
    raw = pa.py_buffer(b"") if data is None else data
    out = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), raw])
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", errors="replace") for x in out.to_pylist()], pa.string())


def _in_place(words: pa.Array, ids: pa.Array, piece: pa.Array, tokenizer_path: str) -> tuple[pa.Array, pa.Array]:
    enc, table = encoder(tokenizer_path), _piece_list(tokenizer_path)
    ids, piece, texts = ids.to_pylist(), piece.to_pylist(), words.to_pylist()
    missing = [i for i, x in enumerate(ids) if x is None]
    for i, packed in zip(missing, enc.encode_words([texts[i] for i in missing]), strict=True):
        ids[i], piece[i] = packed, b"".join(table[x] for x in np.frombuffer(packed, enc.type).tolist())
    return pa.array(ids, pa.large_binary()), pa.array(piece, pa.large_binary())


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) and in_place of every whole text of ``docs``
    (doc_id, text), as the tokenizers library encodes without adding special tokens
    and decodes without skipping any."""
    return lay_out(docs, tokenizer_path, write_dictionaries(docs, tokenizer_path))
