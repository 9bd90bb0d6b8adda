"""Source divergence audit: how far each source's use of words is from its language's.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case. Each
language keeps the terms in at least ``least`` of its documents. Every (lang, source)
group, and each language, gives each kept term p = 1 + floor(10^9 (count + 1) / (N + V)),
with N its counts' sum and V the number of kept terms; the divergence of p from q is
floor((p - q)^2 / q). All of it is exact.

Counting. Each task adds up the terms of its own rows (``local_counts``), which are
written once, a row for each term. From these, count-min sketches of document frequencies are filled by each
task and merged. Their cells stop at ``least``, so two bits hold one, and a sum of cells
never falls below a term's document frequency: a term whose estimate is below ``least``
is impossible, and its rows go before anything is shuffled. The rest are counted exactly.
The sketch is sized by the number of those rows, to at most ``ROWS * WIDEST``
cells (25 MB): beyond that it discards less and the counts stay exact.

Pairs. With z(s) for a group's p of a term it doesn't have, the sum of f(p_s, p_t) over
the kept terms is V f(z_s, z_t), and a correction for each term that s has, for each that t
has, and for each that both have. The first two need the pair's z and the histogram of
one group's counts only; the third is a join of counted terms on (lang, term), whose rows
are added up by pair before they are shuffled.

Rows: a null text, lang or source is ''. Rows that repeat are documents each. A group
without terms is there and has counts of 0. A language without kept terms has pairs of
value 0 and no terms. Extra columns are ignored. An empty table gives no rows. A text's
terms are read piece by piece.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, staged

LEAST, RANKS, PARTS = 3, 200, 1_000_000_000
#: Of the sketch: rows, cells of a row at least and at most, and cells of a block.
ROWS, NARROWEST, WIDEST, BLOCK = 3, 1 << 16, 1 << 25, 1 << 16
#: Terms that a task counts before it writes them, and bytes of a text taken at once.
HELD, PIECE = 500_000, 1 << 20
#: Copies of the groups of a language, so that its histograms are dealt to so many tasks.
SALT = 32
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_OWN = pa.struct([("source", pa.string()), ("n", pa.int64())])
_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("own", pa.list_(_OWN))])


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a list for each piece of it."""
    low, at = text.translate(_FOLD), 0
    while at < len(low):
        end = low.find(b" ", at + PIECE)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def _rows(lang: str, docs: Counter, own: dict[str, Counter]) -> pa.RecordBatch:
    """A row for each term of a language that a task has counted."""
    at = {w: i for i, w in enumerate(docs)}
    sizes = [len(n) for n in own.values()]
    term = np.fromiter((at[w] for n in own.values() for w in n), np.int64, sum(sizes))
    count = np.fromiter((c for n in own.values() for c in n.values()), np.int64, sum(sizes))
    order = np.argsort(term, kind="stable")
    source = pa.array(list(own)).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[order]))
    ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(at)))))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([source, pa.array(count[order])], fields=list(_OWN)))
    words = pa.array(list(at), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), words, pa.array(list(docs.values()), pa.int64()), lists], schema=_COUNTS)


def local_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, own): documents and each source's occurrences, added up inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                documents, own = held.setdefault(lang, (Counter(), {}))
                n = own.setdefault(source, Counter())
                before, seen = len(n), set()
                for words in terms(text.as_py()):
                    n.update(words)
                    seen.update(words)
                documents.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield from (_rows(x, *held[x]) for x in held if held[x][0])
                    held, size = {}, 0
        yield from (_rows(x, *held[x]) for x in held if held[x][0])

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(run, "lang string, term string, docs long, own array<struct<source:string,n:long>>")


def cells(h: np.ndarray, width: int) -> np.ndarray:
    """The cell of each hash in each row of the sketch (``ROWS`` x hashes)."""
    u = h.astype(np.int64).view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return ((u + np.arange(ROWS, dtype=np.uint64)[:, None] * step) & np.uint64(width - 1)).astype(np.int64)


def packed(block: np.ndarray) -> bytes:
    """Two bits a cell."""
    four = block.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def unpacked(block: bytes) -> np.ndarray:
    return ((np.frombuffer(block, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()


def sketch(counts: DataFrame, width: int, cap: int = LEAST) -> bytes:
    """Merged sketch of (h, docs): ``ROWS`` rows of ``width`` cells, two bits each, that stop at ``cap``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((ROWS, width), np.uint8)
        for batch in batches:
            at, docs = cells(batch.column(0).to_numpy(), width), np.minimum(batch.column(1).to_numpy(), cap)
            for r in range(ROWS):
                i, back = np.unique(at[r], return_inverse=True)
                own[r, i] = np.minimum(own[r, i] + np.bincount(back, weights=docs).astype(np.int64), cap)
        own = own.reshape(-1, BLOCK)
        for i in np.flatnonzero(own.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([packed(own[i])], pa.binary())], names=["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed(total)], pa.binary())], names=["block", "bits"])
        for batch in batches:
            for i, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at is not None and i == at:
                    total = np.minimum(total + unpacked(bits), cap)
                else:
                    if at is not None:
                        yield out()
                    at, total = i, unpacked(bits)
        if at is not None:
            yield out()

    spark, schema = counts.sparkSession, "block long, bits binary"
    filled = counts.select("h", "docs").coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(fill, schema)
    merged = filled.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block").mapInArrow(merge, schema)
    whole = bytearray(ROWS * width // 4)
    for r in merged.toLocalIterator():  # ROWS * width / 4 bytes in all
        whole[r["block"] * BLOCK // 4 : (r["block"] + 1) * BLOCK // 4] = r["bits"]
    return bytes(whole)


def estimates(bits: bytes, width: int, h: np.ndarray) -> np.ndarray:
    """For each hash, what the sketch has: its document frequency or more, up to the cap."""
    flat = cells(h, width) + (np.arange(ROWS, dtype=np.int64) * width)[:, None]
    packs = np.frombuffer(bits, np.uint8)
    return ((packs[flat >> 2] >> ((flat & 3) * 2).astype(np.uint8)) & 3).min(0)


def possible(counts: DataFrame, least: int = LEAST, width: int | None = None) -> DataFrame:
    """The rows of ``counts`` whose term may be in ``least`` (at most 3) documents of its language."""
    hashed = counts.withColumn("h", F.xxhash64("lang", "term"))
    if width is None:
        width = min(WIDEST, max(NARROWEST, 1 << counts.count().bit_length()))
    shared = counts.sparkSession.sparkContext.broadcast(sketch(hashed, width, least))

    @F.pandas_udf("boolean")
    def stays(h):
        import pandas as pd

        return pd.Series(estimates(shared.value, width, h.to_numpy()) >= least)

    return hashed.filter(stays("h")).drop("h")


def kept_terms(local: DataFrame, least: int = LEAST, width: int | None = None) -> DataFrame:
    """(lang, source, term, n, total, leads): exact occurrences in the source and in the
    language, of the terms in at least ``least`` documents of it; one source's row leads.
    A row for each term and task is shuffled, once: sums and windows are by the same key."""
    of_term = Window.partitionBy("lang", "term")
    dealt = possible(local, least, width).repartition("lang", "term")
    each = dealt.select("lang", "term", F.posexplode("own").alias("i", "o"), "docs").select("lang", "term", "o.*", F.when(F.col("i") == 0, F.col("docs")).otherwise(0).alias("docs"))
    exact = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = exact.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"), (F.col("source") == F.min("source").over(of_term)).alias("leads"))
    return everywhere.filter(F.col("docs") >= least).drop("docs")


def share(count: Column, size: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (size + v)), of whole numbers of any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    wide = F.call_function("div", whole(count + 1) * F.lit(PARTS).cast("decimal(10,0)"), whole(size + v))
    return 1 + F.when(count < PARTS, F.call_function("div", (count + 1) * F.lit(PARTS).cast("long"), size + v)).otherwise(wide)


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / q) in SQL."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source): part ``pair``
    has every other source of the language, part ``term`` the kept terms that the source has
    oftener than its language, to rank ``ranks``."""
    kept = staged(kept_terms(staged(local_counts(docs), "local-counts"), least, width), "kept-terms")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.when(F.col("leads"), 1)).alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = docs.select(*named).distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select(F.monotonically_increasing_id().alias("id"), "lang", "source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("own_n", "lang_n", "v")])
    zero = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("own_n"), F.col("v"))).otherwise(1)
    groups = staged(groups.withColumn("z", zero), "groups")

    counted = kept.join(groups, ["lang", "source"])
    top = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    excess = counted.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")).filter("p > q")
    by_term = excess.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(apart("p", "q")).alias("value")).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= ranks)

    values = sums(counted.select("id", "lang", "term", "z", share(F.col("n"), F.col("own_n"), F.col("v")).alias("p")), groups)
    names = lambda end, name: groups.select(F.col("id").alias(end), *([F.col("lang")] if end == "s" else []), F.col("source").alias(name))
    pairs = values.join(names("s", "source"), "s").join(names("t", "item"), "t")
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(top))
    return by_pair.unionByName(by_term)


def sums(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """(s, t, value): the sum of f(p_s, p_t) over the kept terms, for each two groups of a
    language. ``counted``: id, lang, term, z, p of the terms that groups have; ``groups``: id,
    lang, v, z."""
    dealt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    others = groups.select(F.col("id").alias("other"), "lang", F.col("z").alias("y"), dealt.alias("salt"))
    every = groups.select("id", "lang", "v", "z", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt")).join(others, ["lang", "salt"]).filter("id <> other")
    base = every.select(F.col("id").alias("s"), F.col("other").alias("t"), F.expr(f"v * {apart('z', 'y')}").alias("v"))

    shapes = counted.groupBy("id", "lang", "z", "p").agg(F.count("*").alias("m")).withColumn("salt", F.pmod(F.xxhash64("id", "p"), F.lit(SALT)).cast("int"))
    single = shapes.join(others, ["lang", "salt"]).filter("id <> other")
    mine = single.select(F.col("id").alias("s"), F.col("other").alias("t"), F.expr(f"m * ({apart('p', 'y')} - {apart('z', 'y')})").alias("v"))
    theirs = single.select(F.col("other").alias("s"), F.col("id").alias("t"), F.expr(f"m * ({apart('y', 'p')} - {apart('y', 'z')})").alias("v"))

    a = counted.select("lang", "term", F.col("id").alias("s"), F.col("z").alias("zs"), F.col("p").alias("ps"))
    b = counted.select("lang", "term", F.col("id").alias("t"), F.col("z").alias("zt"), F.col("p").alias("pt"))
    mixed = lambda p, z, q, y: f"{apart(p, q)} - {apart(p, y)} - {apart(z, q)} + {apart(z, y)}"
    shared = a.join(b, ["lang", "term"]).filter("s < t").groupBy("s", "t").agg(F.sum(F.expr(mixed("ps", "zs", "pt", "zt"))).alias("st"), F.sum(F.expr(mixed("pt", "zt", "ps", "zs"))).alias("ts"))
    both = shared.select("s", "t", F.col("st").alias("v")).unionByName(shared.select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("ts").alias("v")))
    return base.unionByName(mine).unionByName(theirs).unionByName(both).groupBy("s", "t").agg(F.sum("v").alias("value"))
