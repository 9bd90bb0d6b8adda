"""Layout metrics of a period's pages, by year and month.

    python -m jobs.layout_report --truth DIR --pages DIR --predictions DIR --metrics DIR --report DIR --since 2024-01-01 --until 2024-02-01

Reads annotated boxes (``truth``: page_id, place, x, y, w, h in percent of the page), the
pages' dates (``pages``: page_id, day) and an engine's boxes (``predictions``: page_id,
place, x, y, w, h in pixels, score), matches them page by page and writes a row for each
page with predictions: hits, misses, precision, recall, F1 and 11-point average precision
at each threshold, null where the page has no annotated box. ``metrics`` is partitioned
by year and month.

The period is whole months: from the month of ``since`` to the one before ``until``'s, or
with it where ``until`` isn't a month's first day. Only these months' partitions are
replaced, so a month can be matched again at any time, any number of times, with the same
result; other months stay. ``report`` has the means by month of all of ``metrics`` and is
written anew. Pages without a date are left out.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.operators import layout as L

from . import settings

log = logging.getLogger("layout_report")
PATHS = {
    "truth": "Parquet of page_id, place, x, y, w, h",
    "pages": "Parquet of page_id, day",
    "predictions": "Parquet of page_id, place, x, y, w, h, score",
    "metrics": "where a page's metrics are written, by year and month",
    "report": "where the means by month are written",
}


def _boxes(rows: DataFrame, *more: str) -> DataFrame:
    """A page's boxes in order of their places; a page is a bounded group."""
    row = F.struct("place", F.array("x", "y", "w", "h").alias("b"), *more)
    return rows.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("r"))


def _name(metric: str, threshold: float) -> str:
    return f"{metric.lower()}_{round(100 * threshold)}"


def matched(truth: DataFrame, predictions: DataFrame, thresholds: Sequence[float], width: int, height: int) -> DataFrame:
    gt = _boxes(truth).select("page_id", F.transform("r", lambda r: r["b"]).alias("boxes"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    pred = _boxes(predictions, "score").select("page_id", F.transform("r", lambda r: r["b"]).alias("boxes"), F.transform("r", lambda r: r["score"]).alias("score"))
    found = L.add_metrics(pred, gt, "page_id", "boxes", "score", tuple(thresholds), "m")
    return found.select("page_id", *[F.col(f"`m_{m}@{t}`").alias(_name(m, t)) for t in thresholds for m in L.METRICS])


def run(spark: SparkSession, truth: str, pages: str, predictions: str, metrics: str, report: str, thresholds: Sequence[float] = (0.5, 0.75), width: int = 100, height: int = 100, since: str = "0001-01-01", until: str = "9999-12-31") -> DataFrame:
    """One run of the job; returns ``metrics`` as it stands."""
    first, end = F.trunc(F.lit(since).cast("date"), "month"), F.lit(until).cast("date")
    month = F.trunc(F.col("day").cast("date"), "month")
    period = spark.read.parquet(pages).filter((month >= first) & (month < end)).select("page_id", F.year("day").alias("year"), F.month("day").alias("month"))
    own = lambda path: spark.read.parquet(path).join(period.select("page_id"), "page_id", "left_semi")
    rows = matched(own(truth), own(predictions), thresholds, width, height).join(period, "page_id")
    rows.repartition("year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(metrics)
    names = [_name(m, t) for t in thresholds for m in L.METRICS]
    every = spark.read.schema(f"page_id long, {', '.join(f'{n} double' for n in names)}, year int, month int").parquet(metrics)
    means = every.groupBy("year", "month").agg(*[F.avg(n).alias(n) for n in names], F.count(names[0]).alias("with_metrics"), F.count("*").alias("pages"))
    means.write.mode("overwrite").partitionBy("year").parquet(report)
    log.info("read boxes of %s and %s on pages of %s from %s until %s", truth, predictions, pages, since, until)
    log.info("wrote metrics to %s (%d pages by now), means by month to %s", metrics, every.count(), report)
    return every


if __name__ == "__main__":
    settings.main(__file__, "layout_report", PATHS, run)
