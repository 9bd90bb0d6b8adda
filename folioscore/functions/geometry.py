"""Boxes: conversions, overlaps and orders, as expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def _d(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("double")


def percent_to_px(box: Column, width: Column, height: Column) -> Column:
    """G-01: x, y, w, h in percent of the page to pixels."""
    return F.array(*[_d(box[i]) / 100 * _d(s) for i, s in enumerate((width, height, width, height))])


def xywh_to_xyxy(box: Column) -> Column:
    return F.array(_d(box[0]), _d(box[1]), _d(box[0]) + _d(box[2]), _d(box[1]) + _d(box[3]))


def xyxy_to_xywh(box: Column) -> Column:
    return F.array(_d(box[0]), _d(box[1]), _d(box[2]) - _d(box[0]), _d(box[3]) - _d(box[1]))


def hull(points: Column) -> Column:
    """G-03: x1, y1, x2, y2 around four [x, y] points; zeros for any other number."""
    xs, ys = F.transform(points, lambda p: _d(p[0])), F.transform(points, lambda p: _d(p[1]))
    zeros = F.array(*[F.lit(0.0)] * 4)
    return F.when(F.size(points) == 4, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(zeros)


def union_box(a: Column, b: Column) -> Column:
    """G-03: hull of two x1, y1, x2, y2 boxes."""
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def is_valid_box(box: Column) -> Column:
    """G-04."""
    return F.coalesce((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))


def has_boxes(boxes: Column) -> Column:
    return F.coalesce(F.size(boxes) > 0, F.lit(False))


def fraction_to_px(box: Column, width: Column, height: Column) -> Column:
    """G-05: a struct of Left, Top, Width, Height in fractions; a missing side is 0."""
    return F.array(*[F.coalesce(_d(box[k]), F.lit(0.0)) * _d(s) for k, s in (("Left", width), ("Top", height), ("Width", width), ("Height", height))])


def guess_unit_to_px(box: Column, width: Column, height: Column) -> Column:
    """G-05: x, y, w, h in fractions if none is over 1, in percent if none is over 100,
    else in pixels; null unless there are four."""
    size = F.array(*[_d(s) for s in (width, height, width, height)])
    most = F.array_max(F.transform(box, _d))
    scaled = lambda by: F.zip_with(box, size, lambda v, s: _d(v) * s / by)
    return F.when(F.size(box) == 4, F.when(most <= 1, scaled(1.0)).when(most <= 100, scaled(100.0)).otherwise(F.transform(box, _d)))


def drop_null_boxes(boxes: Column, texts: Column, scores: Column) -> Column:
    """G-05: (box, text, score) triples up to the shortest list, without null boxes."""
    n = F.least(F.size(boxes), F.size(texts), F.size(scores))
    cut = lambda a: F.slice(a, 1, n)
    return F.filter(F.zip_with(F.zip_with(cut(boxes), cut(texts), lambda b, t: F.struct(b.alias("box"), t.alias("text"))), cut(scores), lambda p, s: F.struct(p["box"].alias("box"), p["text"].alias("text"), s.alias("score"))), lambda x: x["box"].isNotNull())


def iou(a: Column, b: Column) -> Column:
    """G-06: intersection over union of two x, y, w, h boxes; 0 without a union."""
    over = lambda i: F.greatest(F.lit(0.0), F.least(a[i] + a[i + 2], b[i] + b[i + 2]) - F.greatest(a[i], b[i]))
    inter = over(0) * over(1)
    area = lambda x: F.greatest(x[2], F.lit(0.0)) * F.greatest(x[3], F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def norm_1000(box: Column, width: Column, height: Column) -> Column:
    """G-07: x1, y1, x2, y2 in pixels to whole numbers 0..1000, halves to even."""
    size = (width, height, width, height)
    return F.array(*[F.greatest(F.lit(0), F.least(F.lit(1000), F.rint(1000 * _d(box[i]) / _d(s)).cast("int"))) for i, s in enumerate(size)])


def percent_to_1000(box: Column, width: Column, height: Column) -> Column:
    """G-07: x, y, w, h in percent to 0..1000 by way of pixels."""
    return norm_1000(xywh_to_xyxy(percent_to_px(box, width, height)), width, height)


def _at_least_one(n: Column, width: Column, height: Column) -> Column:
    return F.array(n[0], n[1], F.when(n[2] <= n[0], F.least(width, n[0] + 1)).otherwise(n[2]), F.when(n[3] <= n[1], F.least(height, n[1] + 1)).otherwise(n[3]))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """G-08: rounded, inside the page, at least one pixel each way where there is room."""
    w, h = width.cast("int"), height.cast("int")
    inside = F.array(*[F.greatest(F.lit(0), F.least(s, F.rint(_d(box[i])).cast("int"))) for i, s in enumerate((w, h, w, h))])
    return _at_least_one(inside, w, h)


def norm_boxes_1000(boxes: Column, width: Column, height: Column) -> Column:
    """G-09: scaled to 0..1000 and at least 1 each way."""
    by = [F.lit(1000.0) / F.greatest(F.lit(1.0), _d(s)) for s in (width, height)]
    full = F.lit(1000)

    def one(b: Column) -> Column:
        return _at_least_one(F.array(*[F.greatest(F.lit(0), F.least(full, F.rint(_d(b[i]) * by[i % 2]).cast("int"))) for i in range(4)]), full, full)

    return F.transform(boxes, one)


def polygon_extent(polygons: Column) -> Column:
    """G-10: the page's width and height taken as the furthest polygon point, 1 x 1 without any."""
    points = F.flatten(polygons)
    far = lambda i: F.array_max(F.transform(points, lambda p: _d(p[i])))
    return F.when(F.size(points) > 0, F.struct(far(0).alias("w"), far(1).alias("h"))).otherwise(F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("h")))


def polygon_to_rect(polygon: Column, extent: Column) -> Column:
    """G-10: x, y, width, height in percent, clipped to 0..100, two decimals, rotation 0."""
    xs, ys = F.transform(polygon, lambda p: _d(p[0])), F.transform(polygon, lambda p: _d(p[1]))
    pct = lambda v, s: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * v / s)), 2)
    return F.struct(
        pct(F.array_min(xs), extent["w"]).alias("x"),
        pct(F.array_min(ys), extent["h"]).alias("y"),
        pct(F.array_max(xs) - F.array_min(xs), extent["w"]).alias("width"),
        pct(F.array_max(ys) - F.array_min(ys), extent["h"]).alias("height"),
        F.lit(0).alias("rotation"),
    )


def by_reading_order(numbers: Column, values: Column) -> Column:
    """G-16: values by their number, both cut to the shorter list; equal numbers keep their order."""

    def ordered(p: Column) -> Column:
        n = F.least(F.size(p["n"]), F.size(p["v"]))
        placed = F.transform(F.arrays_zip(F.slice(p["n"], 1, n).alias("no"), F.slice(p["v"], 1, n).alias("v")), lambda x, i: F.struct(x["no"].alias("no"), i.alias("i"), x["v"].alias("v")))
        return F.transform(F.array_sort(placed), lambda x: x["v"])

    return let(F.struct(numbers.alias("n"), values.alias("v")), ordered)


def renumbered(values: Column) -> Column:
    """G-17: 1..n, empty for no values."""
    return F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values))).otherwise(F.array().cast("array<int>"))


def first_label(label: Column) -> Column:
    """G-15: the first label of a struct with ``labels``; sentinels for none and for a missing list."""
    from .text import MISSING_LABEL, NO_LABEL

    labels = label["labels"]
    return F.when(labels.isNull(), MISSING_LABEL).when(F.size(labels) == 0, NO_LABEL).otherwise(F.get(labels, F.lit(0)))
