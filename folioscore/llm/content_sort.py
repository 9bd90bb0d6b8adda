"""Exact dedup by a content sort.

A text's content is the text without ASCII white space (``[\\x20\\x09-\\x0D]``); texts are
equal when their contents are. Rows are range-partitioned by Spark's sampled splitters and
sorted inside each partition (an external sort). The order is that of the content's first
``HEAD`` bytes, then of its digest, so that a splitter is about a hundred bytes whatever a
text's length; then the longest original first and the smallest doc_id first. That is one
total order over rows: equal contents are adjacent, a group of any size is cut across
partitions like any other rows, and the first of a group is the row that stays.

Each partition is read once, in order, and each content is compared in full with the one
before it. Only the first and the last run of a partition can go on in the next one: they
keep one copy of their content, and these, at most two for each partition, are compared in
full again and added up. All other rows are done when they are read.

Rows: one result for each row, in no order. A null text is an empty one, and all empty and
blank texts are one group. A null doc_id comes after all others. Of repeated rows one
stays, though they share their doc_id. Extra columns are ignored. An empty table gives no
rows. A text is held whole, by one task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Bytes of the content that splitters hold.
HEAD = 64
_RUNS = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("size", pa.int64()), ("first", pa.bool_()), ("part", pa.int64()), ("side", pa.int64()), ("content", pa.binary())])
_NAMES = "doc_id long, sha string, keep_id long, size long, first boolean, part long, side long, content binary"


def content(text: Column) -> Column:
    """The text's characters other than ASCII white space; of a null text, none."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, content) of every row, partitioned and sorted by content."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n"), content(F.col("text")).alias("c"))
    rows = rows.select("doc_id", "n", F.sha2("c", 256).alias("sha"), F.encode("c", "UTF-8").alias("content"))
    rows = rows.withColumn("head", F.substring("content", 1, HEAD))
    order = [F.col("head"), F.col("sha"), F.desc("n"), F.asc_nulls_last("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "sha", "content")


class _Run:
    """Rows of equal content, read so far."""

    def __init__(self, ids: pa.Array, sha: str, content: bytes):
        self.ids, self.sha, self.content = [ids], sha, content

    def batches(self, part: int, side: int | None) -> Iterator[pa.RecordBatch]:
        size, keep = sum(map(len, self.ids)), self.ids[0][0].as_py()
        for k, ids in enumerate(self.ids):
            n, head = len(ids), [k == 0] + [False] * (len(ids) - 1)
            text = [self.content if k == 0 and side is not None else None] + [None] * (n - 1)
            columns = [ids, pa.array([self.sha] * n), pa.array([keep] * n, pa.int64()), pa.array([size] * n, pa.int64()), pa.array(head), pa.array([part] * n, pa.int64()), pa.array([side] * n, pa.int64()), pa.array(text, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_RUNS)


def _closed(ids: pa.Array, shas: pa.Array, starts: np.ndarray, part: int) -> pa.RecordBatch:
    """Rows of whole runs inside a partition; ``starts``: where runs begin, and the end."""
    lo, n = int(starts[0]), int(starts[-1] - starts[0])
    sizes = np.diff(starts)
    first = np.zeros(n, bool)
    first[starts[:-1] - lo] = True
    keep = ids.take(pa.array(np.repeat(starts[:-1], sizes)))
    columns = [ids.slice(lo, n), shas.slice(lo, n), keep, pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(first), pa.array(np.full(n, part), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_RUNS)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of content, with their run's first doc_id and size. ``side``: 0 in the
    partition's first run, 1 in its last if that is another, else null."""
    part, held, side = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids, shas, texts = batch.columns
        if not len(ids):
            continue
        new = np.ones(len(ids), bool)
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        new[0] = held is None or texts[0].as_py() != held.content
        starts = np.flatnonzero(new)
        if held is not None:
            more = ids.slice(0, int(starts[0]) if len(starts) else len(ids))
            if len(more):
                held.ids.append(more)
        if not len(starts):
            continue
        if held is not None:
            yield from held.batches(part, side)
            side = None
        if side == 0 and len(starts) > 1:  # the partition's first run begins and ends in this batch
            lo, hi = int(starts[0]), int(starts[1])
            yield from _Run(ids.slice(lo, hi - lo), shas[lo].as_py(), texts[lo].as_py()).batches(part, 0)
            starts, side = starts[1:], None
        if len(starts) > 1:
            yield _closed(ids, shas, starts, part)
        last = int(starts[-1])
        held = _Run(ids.slice(last), shas[last].as_py(), texts[last].as_py())
    if held is not None:
        yield from held.batches(part, 1 if side is None else 0)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size, kept and text_sha256 (of the
    content) of every row of ``docs`` (doc_id, text)."""
    rows = staged(in_order(docs).mapInArrow(runs, _NAMES), "content-runs")
    whole = Window.partitionBy("content")
    ends = rows.filter(F.col("content").isNotNull()).select(
        "part",
        "side",
        F.min_by("keep_id", F.struct("part", "side")).over(whole).alias("_keep"),
        F.sum("size").over(whole).alias("_size"),
        (F.struct("part", "side") == F.min(F.struct("part", "side")).over(whole)).alias("_leads"),
    )
    inner = rows.filter(F.col("side").isNull()).select("doc_id", "keep_id", F.col("size").alias("group_size"), F.col("first").alias("kept"), F.col("sha").alias("text_sha256"))
    outer = rows.filter(F.col("side").isNotNull()).select("doc_id", "sha", "first", "part", "side").join(ends, ["part", "side"])
    return inner.unionByName(outer.select("doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("first") & F.col("_leads")).alias("kept"), F.col("sha").alias("text_sha256")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that go; of repeated rows one stays. Columns of any name are kept."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"), F.col("doc_id").alias("_id"))
    keys = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "content-rows")
    staying = classes(keys.select(F.col("_at").alias("doc_id"), F.col("_text").alias("text"))).filter("kept").select(F.col("doc_id").alias("_at"))
    return keys.join(staying, "_at", "left_semi").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
