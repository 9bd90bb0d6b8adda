"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes and targets. A text's size is its number of words. Sources in code-point
order, null last, take the weights in turn; all sizes together are shared by
weight, no source beyond ``most`` times its own size, what is over going to the
others by weight.

Blocks. A text is cut into blocks of ``block_words`` words; ``most`` copies of each
could be drawn, as epochs. The target of a source becomes whole epochs, drawn in
full, and a rest, drawn from one more epoch as the first blocks of a random order.
That order is a hash of (seed, document, block). A source's blocks are counted by
hash bucket, of which there are as many as keep a bucket near ``IN_BUCKET`` blocks;
counts are added up in two steps (buckets in runs, then runs), so no task sees more
than a bucket's blocks or a run's buckets, and the cut is exact.

Shards. A source's quota is the number of its blocks in the draw. How many of them
each output shard takes is drawn by a splitting tree: the shards are halved again
and again, and a node's blocks of each source are divided between its halves as a
draw without replacement (multivariate hypergeometric, exact at any size). A leaf's
quota of a source is a run of the source's permuted order, of that many blocks, so
shards are disjoint and together exhaust the draw; what is taken is what the leaves
take. Inside a shard, blocks are shuffled by a hash; a text's blocks of one shard and
epoch stay together, at the place of the first.

The list of sources is part of the mix's definition, as the weights are, and is
held on the driver (a row for each source and the shards' quotas of it), with its
counts by hash bucket left on the executors.

Rows: null and blank texts have size 0, take 0 words and belong to no shard. A
null doc_id is a value of its own. Rows alike in doc_id, source and text are numbered
(within input partitions, then by partition, so that copies of one row never meet in
a task), and each is drawn on its own. Extra columns are ignored by the draw and kept
by ``mixed``, which replaces ``epoch``, ``shard`` and ``place``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let
from .common import shuffle_partitions, staged

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK_WORDS = 256
SHARDS = 64
SEED = 20
#: Blocks of a bucket, about, and buckets of a run.
IN_BUCKET = 256
RUN = 4096
#: Words that one match of a text's cut takes at most (it must divide a block).
RUN_WORDS = 64
_WORD, _GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.coalesce(F.regexp_count(t, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source. A source whose share is above ``most`` sizes is set
    to that; the rest is shared again, until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size, total = dict(order), float(sum(n for _, n in order))
    fixed: dict[str | None, float] = {}
    while True:
        free = [s for s, _ in order if s not in fixed]
        left, shares = total - sum(fixed.values()), sum(weight[s] for s in free)
        got = {s: left * weight[s] / shares for s in free}
        above = [s for s in free if got[s] > most * size[s]]
        if not above:
            return fixed | got
        fixed |= {s: float(most * size[s]) for s in above}


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): each source's quota divided among the shards. A node with
    shards lo..hi-1 gives its left half a multivariate-hypergeometric draw of as many
    blocks as its share of the shards."""
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        lo, hi, here = nodes.pop()
        if hi - lo == 1:
            out[lo] = here
            continue
        mid = (lo + hi) // 2
        total = int(here.sum())
        left, need, rest = np.zeros_like(here), total * (mid - lo) // (hi - lo), total
        rng = np.random.default_rng([seed, lo, hi])
        for i, n in enumerate(here):  # one marginal draw after the other
            rest -= int(n)
            left[i] = _hypergeometric(rng, int(n), rest, need)
            need -= int(left[i])
        nodes += [(lo, mid, left), (mid, hi, here - left)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """How many of ``draw`` from ``good`` and ``bad`` are good."""
    if not good or not draw:
        return 0
    if good + bad < 10**9:  # the library's range
        return int(rng.hypergeometric(good, bad, draw))
    return _by_inversion(rng, good, bad, draw)


def _by_inversion(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """The same law by inverting its distribution function: probabilities come from the
    ratios of neighbours, outward from the mode, as far as a double can tell them from 0."""
    n, least, most = good + bad, max(0, draw - bad), min(good, draw)
    mode = min(most, max(least, (draw + 1) * (good + 1) // (n + 2)))
    spread = (draw / n * good * (bad / n) * (n - draw) / max(1, n - 1)) ** 0.5
    reach = int(12 * spread) + 50
    up = np.arange(mode, min(most, mode + reach), dtype=np.float64)  # to k + 1 from k
    down = np.arange(mode, max(least, mode - reach), -1, dtype=np.float64)  # to k - 1 from k
    above = np.cumprod((good - up) / (up + 1) * ((draw - up) / (bad - draw + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - draw + down) / (draw - down + 1)))
    weights = np.concatenate((below[::-1], [1.0], above))
    ends = np.cumsum(weights)
    return mode - len(below) + int(np.searchsorted(ends, rng.random() * ends[-1], side="right"))


@dataclass
class Mix:
    rows: DataFrame  # row, size, and _all (the row itself) where rows are kept
    sizes: DataFrame  # row, doc_id, source, size, copy (numbers rows that are alike)
    taken: DataFrame  # row, block, epoch, words, shard, place: one row for each block a shard takes
    targets: dict[str | None, float]
    source_sizes: dict[str | None, int]


def sized(docs: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """``Mix.rows`` and ``Mix.sizes``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [F.struct(*docs.columns).alias("_all")] if keep else []
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(text).alias("text_hash"), *more)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    # Copies: numbered inside an input partition, behind those of the partitions before.
    key = F.struct("doc_id", "source", "text_hash").alias("key")
    alike = rows.filter("size > 0").select("row", key, F.shiftright("row", 33).alias("part"))
    often = staged(alike.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")).withColumn("all", F.sum("n").over(Window.partitionBy("key"))).filter("all > 1"), "repeated")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = often.select("key", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("row"))
    copies = alike.join(behind, ["key", "part"]).select("row", (F.col("before") + place).alias("copy"))
    narrow = rows.select("row", "doc_id", "source", "size", "text_hash")
    return rows, narrow.join(copies, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(1)).cast("long"))


def blocks_of(sizes: DataFrame, block_words: int, seed: int, buckets: int) -> DataFrame:
    """Each text's blocks: block number, words, and place in its source's order."""
    n = F.ceil(F.col("size") / block_words).cast("int")
    b = sizes.filter("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))
    words = F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words)
    h = F.xxhash64(F.lit(seed), "doc_id", "text_hash", "copy", "block")
    return b.withColumns({"words": words, "h": h, "bucket": F.pmod(F.shiftrightunsigned(h, 8), F.lit(buckets)).cast("long")})


def _starts(blocks: DataFrame) -> DataFrame:
    """s, bucket and the words and blocks before it in its source's order."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.orderBy("bucket" if c in ("w", "n") else "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = staged(blocks.groupBy("s", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN)), "counts")
    runs = counts.groupBy("s", "run").agg(F.sum("w").alias("rw"), F.sum("n").alias("rn"))
    runs = runs.select("s", "run", before("rw", Window.partitionBy("s")).alias("w1"), before("rn", Window.partitionBy("s")).alias("n1"))
    inside = Window.partitionBy("s", "run")
    return counts.select("s", "run", "bucket", before("w", inside).alias("w2"), before("n", inside).alias("n2")).join(runs, ["s", "run"]).select("s", "bucket", (F.col("w1") + F.col("w2")).alias("w0"), (F.col("n1") + F.col("n2")).alias("n0"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, keep: bool = False) -> Mix:
    """Draw the mix of ``docs`` (doc_id, source, text); ``keep`` the rows for ``mixed``."""
    spark = docs.sparkSession
    rows, sizes = sized(docs, keep)
    totals, n_blocks = [], 0
    for r in sizes.groupBy("source").agg(F.sum("size").alias("n"), F.sum(F.ceil(F.col("size") / block_words)).alias("blocks")).collect():  # one row for each source
        totals.append((r["source"], r["n"]))
        n_blocks = max(n_blocks, int(r["blocks"]))
    aims = targets(totals, weights, most) if totals else {}
    order = sorted(aims, key=lambda s: (s is None, s or ""))
    size = dict(totals)
    epochs = {s: min(most, int(aims[s] // size[s])) if size[s] else 0 for s in order}
    spec = spark.createDataFrame([(i, s, epochs[s], aims[s] - epochs[s] * size[s] if epochs[s] < most else 0.0) for i, s in enumerate(order)], "s int, source_name string, epochs int, rest double")
    of_source = sizes.join(F.broadcast(spec), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    blocks = staged(blocks_of(of_source, block_words, seed, max(1, -(-n_blocks // IN_BUCKET))).select("row", "doc_id", "text_hash", "copy", "s", "block", "words", "h", "bucket", "epochs", "rest"), "blocks")
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "text_hash", "copy", "block")
    ranked = blocks.join(_starts(blocks), ["s", "bucket"]).withColumns({"w_end": F.col("w0") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.col("n0") + F.row_number().over(inside) - 1})
    # Of the epoch drawn in part: the first blocks of the order, the last one if it brings the sum nearer.
    extra = (F.col("w_end") - F.col("words") / 2 <= F.col("rest")).cast("int")
    drawn = staged(ranked.withColumn("copies", F.col("epochs") + extra).filter("copies > 0").select("row", "s", "block", "words", "h", "rank", "copies"), "drawn")
    got = {r["s"]: (r["n"], r["ranked"]) for r in drawn.groupBy("s").agg(F.sum("copies").alias("n"), (F.max("rank") + 1).alias("ranked")).collect()}
    quotas = np.array([got.get(i, (0, 0))[0] for i in range(len(order))], np.int64)
    ends = np.cumsum(split_tree(quotas, shards, seed), axis=0)  # where each leaf's run of a source's draws ends
    runs = spark.createDataFrame([(i, [int(x) for x in ends[:, i]], int(got.get(i, (0, 0))[1])) for i in range(len(order))], "s int, ends array<long>, ranked long")
    # A source's draws in order: epoch by epoch, each by rank. Only the last epoch is drawn in part.
    copies = drawn.join(F.broadcast(runs), "s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("epoch") * F.col("ranked") + F.col("rank")
    leaf = F.size(F.filter("ends", lambda e: e <= at)).cast("int")
    taken = copies.withColumn("shard", leaf).filter(F.col("shard") < shards)  # what no leaf has room for isn't taken
    return Mix(rows, sizes, taken.select("row", "block", "epoch", "words", "shard", F.xxhash64(F.lit(seed), "shard", "h", "epoch").alias("place")), aims, size)


def summary(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken (long; words the shards take) of every row."""
    aims = mix.sizes.sparkSession.createDataFrame([(s, mix.source_sizes[s], float(t)) for s, t in mix.targets.items()], "source_name string, source_size long, target double")
    per_row = mix.taken.groupBy("row", "shard").agg(F.sum("words").alias("words")).groupBy("row").agg(F.sum("words").alias("taken"))
    rows = mix.sizes.join(per_row, "row", "left").join(F.broadcast(aims), F.col("source").eqNullSafe(F.col("source_name")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(mix: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of a plan that kept them, as the mix takes them: a row for each epoch of a
    text and shard that has blocks of it, with the words of those blocks in their order (the
    whole text, unchanged, where all are there), and ``epoch``, ``shard`` and the ``place`` of
    its first block.

    A text is joined once, with all that shards take of it, and cut once, into runs of words
    that make up blocks; each shard's part is put together from those. A text of any length
    costs its own bytes and those of its parts, of which there are ``most`` times as many."""
    take = F.struct("epoch", "shard", F.col("at.place").alias("place"), "blocks")
    per_copy = mix.taken.repartition("row").groupBy("row", "epoch", "shard").agg(F.sort_array(F.collect_list("block")).alias("blocks"), F.min(F.struct("block", "place")).alias("at"))
    joined = per_copy.groupBy("row").agg(F.collect_list(take).alias("_takes")).join(mix.rows.select("row", "size", "_all"), "row")
    text, n_blocks = F.col("_all.text"), F.ceil(F.col("size") / block_words)
    whole = lambda t: F.size(t["blocks"]) == n_blocks
    run = max(n for n in range(1, RUN_WORDS + 1) if block_words % n == 0)
    runs = F.when(F.exists("_takes", lambda t: ~whole(t)), F.regexp_extract_all(text, F.lit(rf"(?:{_WORD}+{_GAP}*+){{1,{run}}}"), F.lit(0)))
    per_block = block_words // run
    part = lambda own, t: F.array_join(F.flatten(F.transform(t["blocks"], lambda b: F.slice(own, b * per_block + 1, per_block))), "")
    parts = let(runs, lambda own: F.transform("_takes", lambda t: F.struct(t["epoch"].alias("epoch"), t["shard"].alias("shard"), t["place"].alias("place"), F.when(whole(t), text).otherwise(part(own, t)).alias("text"))))
    # The text itself isn't carried beside its parts.
    columns = [c for c in mix.rows.schema["_all"].dataType.names if c not in ("epoch", "shard", "place")]
    beside = {c: f"_{i}" for i, c in enumerate(columns) if c != "text"}
    cut = joined.select(*[F.col("_all")[c].alias(k) for c, k in beside.items()], parts.alias("_parts"))
    each = cut.select(*beside.values(), F.explode("_parts").alias("_part"))
    return each.select(*[F.col(beside.get(c, "_part.text")).alias(c) for c in columns], "_part.epoch", "_part.shard", "_part.place")


def laid_out(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` of ``mixed`` by shard, then place: a partition holds a shard, or a range of
    its places where there are more partitions than shards, and partitions are in order."""
    n = -(-shuffle_partitions(rows.sparkSession) // shards)
    at = F.least(F.floor((F.col("place") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int")
    return rows.repartitionById(shards * n, F.col("shard") * n + at).sortWithinPartitions("shard", "place", "doc_id", "epoch")
