"""Token-ID files: length-delimited binary records with masked checksums.

A shard file is a row of records. A record is::

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

(little-endian; masked as ``rotate_right(crc, 15) + 0xa282ead8``, so that a file
holding checksums can be checksummed itself). A payload is one serialised
sequence: ``i64 doc_id | u8 flags (bit 0: doc_id is null) | u8 id width | u16 0 |
ids``. Ids take two bytes where the vocabulary has at most 65,536, else four.

Beside the shards lies ``index``, a Parquet table with a row for each record
(doc_id, shard, path, record, offset, length, n_tokens), so that readers can
fetch records in any order. It names only files of tasks that succeeded: a task
that is run again writes a file of its own name, and the lost one is in no index.

Rows: a null text counts as empty and has the end id alone. Null ids come last.
Rows with equal ids stand side by side in an order set by their text's hash.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, new_path, shuffle_partitions
from .words import encoder, text_groups

_HEAD = struct.Struct("<qBBH")
_LEN = struct.Struct("<QI")
_CRC = struct.Struct("<I")
INDEX_SCHEMA = "doc_id long, shard int, path string, record long, offset long, length long, n_tokens long"
READ_BYTES = 8 << 20
#: Texts encoded together: the more, the fewer times a word is looked up.
GROUP_BYTES = 2 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _CRC.pack(masked_crc(size)), payload, _CRC.pack(masked_crc(payload))))


def pack_sequence(doc_id: int | None, ids: np.ndarray) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, ids.dtype.itemsize, 0) + ids.tobytes()


def unpack_sequence(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width, _ = _HEAD.unpack_from(payload)
    return None if null & 1 else doc_id, np.frombuffer(payload, dtype="<u2" if width == 2 else "<u4", offset=_HEAD.size)


def read_frames(stream) -> Iterator[bytes]:
    """Payloads of a shard in order; raises ValueError where a checksum or the length is wrong."""
    buffer, at = b"", 0
    while True:
        while len(buffer) - at < _LEN.size or len(buffer) - at < _LEN.size + _LEN.unpack_from(buffer, at)[0] + _CRC.size:
            if len(buffer) - at >= _LEN.size:
                _checked_length(buffer[at : at + _LEN.size])
            more = stream.read(READ_BYTES)
            if not more:
                if at < len(buffer):
                    raise ValueError("the file ends inside a record")
                return
            buffer, at = buffer[at:] + more, 0
        n = _checked_length(buffer[at : at + _LEN.size])
        yield _checked_payload(buffer[at + _LEN.size : at + _LEN.size + n + _CRC.size])
        at += _LEN.size + n + _CRC.size


def _checked_length(head: bytes) -> int:
    n, crc = _LEN.unpack(head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("a record's length fails its checksum")
    return n


def _checked_payload(tail: bytes) -> bytes:
    payload = tail[: -_CRC.size]
    if masked_crc(payload) != _CRC.unpack(tail[-_CRC.size :])[0]:
        raise ValueError("a record fails its checksum")
    return payload


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 0, partitions: int | None = None) -> str:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each text's ids and write
    shards in ascending doc_id order under ``out`` (by default a new path in the
    shared folder). Returns ``out``.

    One shuffle: rows are dealt by ranges of doc_id, equal ids further by a hash of
    the text and the row's place, so that no id is a partition of its own; each task
    streams its range into one shard. The index is written by the same job.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "token-files")
    n = partitions or shuffle_partitions(spark)
    files, folder = filesystem(out)
    files.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        stop = np.array([end_id], dtype=enc.type)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        store, root = filesystem(out)
        sink, offset, record = None, 0, 0
        try:
            for batch in batches:
                for lo, hi in text_groups(batch.column(1), GROUP_BYTES):
                    ids, at = enc.encode(batch.column(1).slice(lo, hi - lo))
                    rows = []
                    for k, doc_id in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                        own = np.concatenate((ids[at[k] : at[k + 1]], stop))
                        data = frame(pack_sequence(doc_id, own))
                        sink = sink or store.open_output_stream(f"{root}/{name}")
                        sink.write(data)
                        rows.append((doc_id, shard, f"{out}/{name}", record, offset, len(data), len(own)))
                        offset, record = offset + len(data), record + 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["doc_id", "shard", "path", "record", "offset", "length", "n_tokens"])
        finally:
            if sink:
                sink.close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), "_tie", "_row"]
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{out}/index")
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read_in_order(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every record in file order, read from the shards with all checksums verified:
    doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as little-endian
    u32), and ids (array<int>) if asked for. Tasks read whole shards."""
    shards = read_index(spark, path).groupBy("shard", "path").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row for each file
    starts, at = [], 0
    for s in shards:
        starts.append((s["path"], at))
        at += s["n"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, file = filesystem(name)
                rows, size = [], 0
                with store.open_input_stream(file) as stream:
                    for payload in read_frames(stream):
                        doc_id, ids = unpack_sequence(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                        start += len(ids)
                        size += len(payload) if with_ids else 64
                        if size > READ_BYTES:
                            yield _batch(rows, with_ids)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, with_ids)

    files = spark.createDataFrame(starts, "path string, start long")
    return files.repartition(max(1, len(starts))).mapInArrow(read, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    types = (*[pa.int64()] * 4, *[pa.list_(pa.int32())] * with_ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)])


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Records in an order drawn by ``seed``: doc_id, position hash, ids. The index is
    dealt and sorted by a hash of each record's place; tasks seek to their records."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}
        for batch in batches:
            names, offsets, lengths, keys = (c.to_pylist() for c in batch.columns)
            for lo in range(0, len(names), 256):
                rows = []
                for name, offset, length, key in zip(names[lo : lo + 256], offsets[lo : lo + 256], lengths[lo : lo + 256], keys[lo : lo + 256], strict=True):
                    if name not in opened:
                        if len(opened) >= 64:
                            opened.pop(next(iter(opened))).close()
                        store, file = filesystem(name)
                        opened[name] = store.open_input_file(file)
                    opened[name].seek(offset)
                    doc_id, ids = unpack_sequence(next(read_frames(pa.BufferReader(opened[name].read(length)))))
                    rows.append((doc_id, key, ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["doc_id", "position", "ids"])

    n = partitions or shuffle_partitions(spark)
    keyed = read_index(spark, path).select("path", "offset", "length", F.xxhash64(F.lit(seed), "shard", "record").alias("position"))
    return keyed.repartitionByRange(n, "position").sortWithinPartitions("position").mapInArrow(fetch, "doc_id long, position long, ids array<int>")
