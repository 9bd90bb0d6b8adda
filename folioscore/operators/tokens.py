"""Before and after token models: pooling, decoding, padding, classification reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.binding import let

#: Fixed values of the reading-order model's inputs: most boxes, and its special ids.
MAX_BOXES, CLS_ID, UNK_ID, EOS_ID, PAD_ID, NO_LABEL_ID = 510, 0, 3, 2, 1, -100
#: Rows whose tokens are pooled together.
_ROWS = 1024


def mean_pool_argmax(df: DataFrame, key: list[str], word: str, logits: str) -> DataFrame:
    """K-15: sub-tokens' logits averaged by word; the place of the greatest mean, the lowest
    at a tie. Rows without a word are special tokens. Averages combine before the shuffle."""
    per_class = df.filter(F.col(word).isNotNull()).select(*key, word, F.posexplode(logits).alias("label_id", "logit"))
    means = per_class.groupBy(*key, word, "label_id").agg(F.avg("logit").alias("m"))
    return means.groupBy(*key, word).agg(F.min_by("label_id", F.struct((-F.col("m")).alias("a"), "label_id")).alias("label_id"))


def labels_by_word(decoded: DataFrame, words: DataFrame, key: list[str], word: str, labels: dict[int, str]) -> DataFrame:
    """Every word with its label; a word that no sub-token stands for has label 0."""
    return words.join(decoded, [*key, word], "left").select(*words.columns, named_label(F.col("label_id"), labels).alias("label"))


def named_label(label_id: Column, labels: dict[int, str]) -> Column:
    """The label of a number, of 0 without one."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.element_at(names, F.coalesce(label_id, F.lit(0)))


def _pooled(word_ids: pa.ListArray, logits: pa.ListArray, sizes: np.ndarray) -> pa.ListArray:
    """``mean_pool_argmax`` of each row's tokens: for each of a row's words its label's number,
    null without a token."""
    ids = word_ids.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.arange(len(sizes))
    row, other = (np.repeat(rows, pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in (word_ids, logits))
    # Tokens up to the shorter of a row's two lists.
    at, begin = np.arange(len(row)) - np.searchsorted(row, row), np.searchsorted(other, rows)
    counts = np.bincount(other, minlength=len(sizes))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    used = (ids >= 0) & (ids < sizes[row]) & (at < counts[row])
    token = np.full(len(other), -1)
    token[begin[row[used]] + at[used]] = starts[row[used]] + ids[used]
    lists = logits.flatten()
    width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    word, kind = np.repeat(token, width), np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    real = (word >= 0) & values.is_valid().to_numpy(zero_copy_only=False)
    word, kind, v = word[real], kind[real], values.fill_null(0.0).to_numpy(zero_copy_only=False)[real]
    span = int(kind.max()) + 1 if len(kind) else 1
    groups, own = np.unique(word * span + kind, return_inverse=True)
    mean = np.bincount(own, weights=v, minlength=len(groups)) / np.bincount(own, minlength=len(groups))
    best = np.lexsort((groups % span, -mean, np.isnan(mean), groups // span))
    first = np.unique((groups // span)[best], return_index=True)
    out, known = np.zeros(int(starts[-1]), np.int32), np.zeros(int(starts[-1]), bool)
    out[first[0]], known[first[0]] = (groups % span)[best][first[1]], True
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out, pa.int32(), mask=~known))


@F.arrow_udf(ArrayType(IntegerType()))
def pooled_labels(word_ids: pa.Array, logits: pa.Array, sizes: pa.Array) -> pa.Array:
    """K-15 inside a row: of a page's sub-tokens (their words' numbers, null for special ones, and
    their logits) and its number of words, the label's number of each word."""
    n, parts = sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), []
    for lo in range(0, len(n), _ROWS):
        parts.append(_pooled(word_ids.slice(lo, _ROWS), logits.slice(lo, _ROWS), np.maximum(n[lo : lo + _ROWS], 0)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def order_of(logits: list) -> list[int]:
    """K-16: each box takes its greatest logit's place; of boxes that share a place the one
    with the greatest logit there keeps it, the others take their next best, until no two share."""
    m = np.array([np.asarray(r, float) for r in logits])
    if not m.size:
        return []
    n = len(m)
    m = m[:, :n]
    ranked, depth = np.argsort(m, axis=1, kind="stable")[:, ::-1], np.zeros(n, int)
    rows = np.arange(n)
    while True:
        place = ranked[rows, depth]
        again = np.bincount(place, minlength=n)[place] > 1
        if not again.any():
            return place.tolist()
        lost = []
        for spot in np.unique(place[again]):
            own = rows[place == spot]
            lost += sorted(own, key=lambda i: (-m[i, spot], i))[1:]
        depth[lost] += 1


@F.pandas_udf(ArrayType(IntegerType()))
def decode_order(logits: pd.Series) -> pd.Series:
    return logits.map(lambda x: None if x is None else order_of(x))


def has_duplicates(items: Column) -> Column:
    """K-17."""
    return F.size(F.array_distinct(items)) != F.size(items)


def model_inputs(boxes: Column) -> Column:
    """K-18: input ids, boxes and attention mask of at most ``MAX_BOXES`` boxes between a
    begin and an end token with zero boxes, and whether some were cut off."""
    cut = F.slice(boxes, 1, MAX_BOXES)
    zero = F.array(F.array(*[F.lit(0)] * 4))
    ids = F.concat(F.array(F.lit(CLS_ID)), F.array_repeat(F.lit(UNK_ID), F.size(cut)), F.array(F.lit(EOS_ID)))
    return F.struct(ids.alias("input_ids"), F.concat(zero, cut.cast("array<array<int>>"), zero).alias("bbox"), F.array_repeat(F.lit(1), F.size(cut) + 2).alias("attention_mask"), (F.size(boxes) > MAX_BOXES).alias("clipped"))


def padded(values: Column, size: Column, fill) -> Column:
    """K-18: ``values`` filled up to ``size``."""
    return let(values, lambda v: F.concat(v, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), size - F.size(v)))))


def training_labels(target_index: Column, size: Column) -> Column:
    """K-18: targets from 1 to places from 0, beyond the clip masked, with masked ends and padding."""
    mask = F.lit(NO_LABEL_ID)
    own = F.transform(F.slice(target_index, 1, MAX_BOXES), lambda t: F.when((t < 1) | (t > MAX_BOXES), mask).otherwise(t - 1))
    return padded(F.concat(F.array(mask), own, F.array(mask)), size, NO_LABEL_ID)


def confusion(df: DataFrame, gt: str, pred: str) -> DataFrame:
    """K-20: counts of (gt, pred) pairs of labels."""
    return df.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, gt: str, pred: str) -> DataFrame:
    """K-20: label, precision, recall, f1, support for each label, then rows "accuracy"
    (in all of precision, recall and f1), "macro avg" and "weighted avg". One pass over
    the rows makes the confusion counts; all else works on those."""
    c = confusion(df, gt, pred).filter(F.col("gt").isNotNull() & F.col("pred").isNotNull())
    sides = c.select(F.explode(F.array(F.struct(F.col("gt").alias("label"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "said")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, support, said = F.col("tp"), F.col("support"), F.col("said")
    per = per.select(F.col("label").cast("string").alias("label"), ratio(tp, said).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, said + support).alias("f1"), "support", "tp")
    kinds = ("precision", "recall", "f1")
    total = per.agg(*[F.avg(k).alias(f"m_{k}") for k in kinds], *[(F.sum(F.col(k) * support) / F.sum("support")).alias(f"w_{k}") for k in kinds], (F.sum("tp") / F.sum("support")).alias("acc"), F.sum("support").alias("n")).filter("n > 0")
    rows = F.array(*[F.struct(F.lit(name).alias("label"), *[F.col(f"{m}_{k}" if m else "acc").alias(k) for k in kinds], F.col("n").alias("support")) for name, m in (("accuracy", ""), ("macro avg", "m"), ("weighted avg", "w"))])
    return per.drop("tp").unionByName(total.select(F.explode(rows).alias("r")).select("r.*"))


def label_maps(labels: list[str]) -> tuple[dict[int, str], dict[str, int]]:
    """G-24: sorted distinct labels, "O" put first if it isn't there."""
    names = sorted(set(labels))
    names = names if "O" in names else ["O", *names]
    return dict(enumerate(names)), {n: i for i, n in enumerate(names)}


def label_table(pages: DataFrame, labels: str, first_by: str | None = None) -> DataFrame:
    """G-24: id, label of the distinct labels in the pages' arrays ``labels``, sorted, "O" put
    first if it isn't there. With ``first_by`` only the labels of the first page under that
    order count, as a map made from one row has it. Nulls are no labels; without any: "O"."""
    if first_by:
        pages = pages.select(F.col(labels).alias("_l"), F.col(first_by).alias("_o")).agg(F.min_by("_l", "_o").alias(labels))
    found = pages.select(F.explode(labels).alias("label")).filter("label is not null").distinct()
    # One row: a classifier's classes, combined before they are brought together.
    names = found.agg(F.sort_array(F.collect_set("label")).alias("n"))
    all_names = F.when(F.array_contains("n", "O"), F.col("n")).otherwise(F.concat(F.array(F.lit("O")), F.col("n")))
    return names.select(F.posexplode(all_names).alias("id", "label"))


def label_ids(pages: DataFrame, labels: str, table: DataFrame, name: str) -> DataFrame:
    """``pages`` with an array of the labels' ids; null for labels that ``table`` hasn't got."""
    ids = table.agg(F.map_from_entries(F.collect_list(F.struct("label", "id"))).alias("_ids"))  # one row
    numbered = F.transform(labels, lambda x: F.when(x.isNotNull(), F.try_element_at("_ids", x)))
    return pages.join(F.broadcast(ids)).withColumn(name, numbered).drop("_ids")
