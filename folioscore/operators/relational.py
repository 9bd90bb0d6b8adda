"""Joins, lookups and groupings by page and document."""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.binding import let


def keep_first(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """R-13: the first row of each key by ``order``, which must be total. An aggregate, so rows
    combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in key else F.col("_r")[c].alias(c) for c in df.columns])


def last_of(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """R-03: the last row of each key by ``order``. An aggregate, so rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def lookup(pred: DataFrame, gt: DataFrame, key: list[str], *order: str) -> DataFrame:
    """R-03: every row of ``pred`` with its key's last row of ``gt``, nulls on a miss."""
    return pred.join(last_of(gt, key, *order), key, "left")


def positional_join(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """R-02: rows paired by their place under an explicit order. Places are found from the
    partition sizes of a range sort, so no row goes through a single task."""
    return numbered(a, order_a, "_n").join(numbered(b, order_b, "_n"), "_n").drop("_n")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with places from 0 under ``order`` (unique). Rows are dealt by quantiles of
    ``order`` that are fixed before: counting the rows of a stretch and numbering them there
    go by the same bounds, whatever partitions either pass has."""
    at = quantiles(df.sparkSession)
    bounds = df.agg(F.percentile_approx(order, at).alias("b")).collect()[0]["b"] if at else None  # one row
    parts = df.withColumn("_p", bounds_below(sorted(set(bounds)), F.col(order)) if bounds else F.lit(0))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", before.alias("_b"))  # one row for each stretch
    return parts.join(F.broadcast(starts), "_p").withColumn(name, F.col("_b") + within).drop("_p", "_b")


def quantiles(spark: SparkSession) -> list[float]:
    """The shares at which a column is cut into one stretch for each shuffle partition."""
    stretches = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return [i / stretches for i in range(1, stretches)]


def bounds_below(bounds: list, value: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``value``: those at every step of about their
    number's root are compared, then the one step in which the value falls."""
    step = isqrt(len(bounds))
    below = lambda some: F.size(F.filter(some, lambda b: b < value))
    every, coarse = (F.array(*map(F.lit, b)) for b in (bounds, bounds[step - 1 :: step]))
    return let(below(coarse), lambda c: c * step + below(F.slice(every, c * step + 1, F.lit(step))))


def first_match(frames: list[DataFrame], key: list[str], *order: str) -> DataFrame:
    """R-05: each key's first row in the first frame that has it."""
    tagged = [f.withColumn("_f", F.lit(i)) for i, f in enumerate(frames)]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    return keep_first(every, key, "_f", *order).drop("_f")


def pair_and_skip(gt: DataFrame, pred: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """R-06: joined pairs, and the keys of ``gt`` without a prediction."""
    return gt.join(pred, key), gt.join(pred, key, "left_anti").select(*key).distinct()


def remap(df: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """R-12: keys replaced by an alias table (alias, name) where it has them."""
    named = df.join(aliases.select(F.col("alias").alias(key), F.col("name").alias("_name")), key, "left")
    return named.withColumn(key, F.coalesce("_name", key)).drop("_name").select(*df.columns)


def not_both_empty(ref: Column, hyp: Column) -> Column:
    """R-10."""
    return (F.length(ref) > 0) | (F.length(hyp) > 0)


def with_doc_and_page(df: DataFrame, name: str = "page_id", unmatched: str = "drop", anchored: bool = True) -> DataFrame:
    """R-15: doc_id and page_num from ``<doc>_page_<n>``. Other names are dropped or kept as
    documents of one page; ``anchored=False`` takes the first ``_page_`` anywhere."""
    if unmatched not in ("drop", "keep"):
        raise ValueError(f"unmatched is drop or keep, not {unmatched!r}")
    doc, num = (T.cv_id(F.col(name)), T.page_number(F.col(name))) if anchored else (F.nullif(F.regexp_extract(name, r"(?i)^(.*?)_page_(\d+)", 1), F.lit("")), F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)^(.*?)_page_(\d+)", 2), F.lit("")).cast("int"), F.lit(0)))
    out = df.withColumns({"doc_id": doc if unmatched == "drop" else F.coalesce(doc, F.col(name)), "page_num": num})
    return out.filter(F.col("doc_id").isNotNull())


def pages_of(df: DataFrame, values: list[str], doc: str = "doc_id", page: str = "page_num", lexical: str | None = None) -> DataFrame:
    """R-15, R-07: a document's pages as an array in order: by number, or by the text of
    column ``lexical``. A document is a bounded group: its pages."""
    order = [lexical] if lexical else [page]
    return df.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias("pages"))


def unify_documents(df: DataFrame, lists: list[str], scalars: list[str], doc: str = "doc_id", page: str = "page_num", one_page: str = "list") -> DataFrame:
    """R-14: lists of a document's pages one behind the other, scalars as lists, pages ascending.
    ``one_page="scalar"`` leaves the scalars of a document of one page as they are; the column
    is a text then: the scalar itself, or a JSON list."""
    if one_page not in ("list", "scalar"):
        raise ValueError(f"one_page is list or scalar, not {one_page!r}")
    grouped = pages_of(df, [*lists, *scalars], doc, page)
    in_order = lambda v: F.transform("pages", lambda s: s[v])
    kept = lambda v: in_order(v) if one_page == "list" else F.when(F.size("pages") == 1, F.get(in_order(v), F.lit(0)).cast("string")).otherwise(F.to_json(in_order(v)))
    return grouped.select(doc, *[F.flatten(in_order(v)).alias(v) for v in lists], *[kept(v).alias(v) for v in scalars])


#: Places that equal lengths are dealt to.
_TIES = 1 << 20


def length_batches(df: DataFrame, length: str, size: int) -> DataFrame:
    """R-26: rows dealt by length, the longest first (null ones last), to a numbered ``part``, and
    there to numbered batches of ``size``. Parts go by quantiles that are fixed before, equal
    lengths by a hash of the row, so both numbers are the same whenever the rows are read."""
    place = F.coalesce(-F.col(length).cast("long"), F.lit(1)) * _TIES + F.pmod(F.xxhash64(*df.columns), F.lit(_TIES))
    placed, at = df.withColumn("_at", place), quantiles(df.sparkSession)
    bounds = placed.agg(F.percentile_approx("_at", at).alias("b")).collect()[0]["b"] if at else None  # one row
    dealt = placed.withColumn("part", bounds_below(sorted(set(bounds)), F.col("_at")) if bounds else F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("_at"))
    return dealt.withColumn("batch", F.floor((inside - 1) / size)).drop("_at")
