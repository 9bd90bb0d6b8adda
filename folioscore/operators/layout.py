"""Layout: lines from fragments, matches of boxes, average precision, overlaps.

State lives inside a page, so pages are arrays; lines are a fold over them, matches an
Arrow-batched UDF; no box pair of two pages ever meets. ``overlaps`` alone takes boxes as rows
and joins them by place, for pages of any size."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.binding import let

LINES = "array<struct<text:string,box:array<double>>>"
METRICS = ("TP", "FP", "FN", "Precision", "Recall", "F1", "mAP")
#: Recall levels of 11-point average precision, as multiples of the double 0.1.
LEVELS = np.arange(11) * 0.1


_FOLD = f"struct<done:{LINES},parts:array<struct<x:double,k:int,t:string>>,middles:double,heights:double,box:array<double>>"


def _stripped(text: Column) -> Column:
    """Without the white space around it, the four separator controls included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def merged_lines(boxes: Column, texts: Column, y_tol: float = 0.6, bar_mode: str = "reference") -> Column:
    """K-09: fragments (x, y, w, h) in order of their middle height join the last line while
    they are near its mean middle. ``bar_mode`` "reference" takes texts that are a bar out
    of the texts only, which shifts the pairs behind it; "aligned" takes box and text out.

    One fold over the sorted fragments, with the last line's sums beside the lines that are
    done; means are running sums over counts. Null arrays: no lines; a null text reads None; a
    fragment without numbers is a line."""
    if bar_mode not in ("reference", "aligned"):
        raise ValueError(f"bar_mode is reference or aligned, not {bar_mode!r}")
    is_bar = lambda t: _stripped(t) == "|"
    boxes = F.coalesce(boxes.cast("array<array<double>>"), F.array().cast("array<array<double>>"))
    texts = F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.coalesce(t.cast("string"), F.lit("None")))
    if bar_mode == "reference":
        texts = F.filter(texts, lambda t: ~is_bar(t))
    pairs = F.slice(F.zip_with(boxes, texts, lambda b, t: F.struct(b.alias("b"), t.alias("t"))), F.lit(1), F.least(F.size(boxes), F.size(texts)))
    if bar_mode == "aligned":
        pairs = F.filter(pairs, lambda p: ~is_bar(p["t"]))
    at = lambda b, i: F.get(b, F.lit(i))
    placed = F.array_sort(F.transform(pairs, lambda p, k: F.struct((at(p["b"], 1) + at(p["b"], 3) / 2).alias("middle"), k.alias("k"), p["b"].alias("b"), p["t"].alias("t"))))

    def closed(acc: Column) -> Column:
        return F.struct(F.array_join(F.transform(F.array_sort(acc["parts"]), lambda x: _stripped(x["t"])), " ").alias("text"), acc["box"].alias("box"))

    def around(a: Column, b: Column) -> Column:
        low = [F.least(at(a, i), at(b, i)) for i in (0, 1)]
        far = [F.greatest(at(a, i) + at(a, i + 2), at(b, i) + at(b, i + 2)) for i in (0, 1)]
        return F.array(*low, *[f - x for f, x in zip(far, low, strict=True)])

    def step(acc: Column, f: Column) -> Column:
        n, h = F.size(acc["parts"]), at(f["b"], 3)
        near = F.abs(f["middle"] - F.try_divide(acc["middles"], n)) <= F.greatest(h, F.try_divide(acc["heights"], n)) * y_tol

        def after(near: Column) -> Column:
            part = F.array(F.struct(at(f["b"], 0).alias("x"), F.when(near, n).otherwise(0).alias("k"), f["t"].alias("t")))
            added = lambda old, new: F.when(near, old + new).otherwise(new)
            done = F.when(near | (n == 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(closed(acc))))
            parts = F.when(near, F.concat(acc["parts"], part)).otherwise(part)
            box = F.when(near, around(acc["box"], f["b"])).otherwise(f["b"])
            return F.struct(done.alias("done"), parts.alias("parts"), added(acc["middles"], f["middle"]).alias("middles"), added(acc["heights"], h).alias("heights"), box.alias("box")).cast(_FOLD)

        return let(F.coalesce(near, F.lit(False)), after)

    none = F.lit(None)
    start = F.struct(F.array().alias("done"), F.array().alias("parts"), none.alias("middles"), none.alias("heights"), none.alias("box")).cast(_FOLD)
    return F.aggregate(placed, start, step, lambda acc: F.when(F.size(acc["parts"]) > 0, F.concat(acc["done"], F.array(closed(acc)))).otherwise(acc["done"]))


def build_line_columns(df: DataFrame, text_col: str, box_col: str, input_mode: str = "xywh", y_tol: float = 0.6, bar_mode: str = "reference") -> DataFrame:
    """K-10: adds text_in_line and bbox_in_line."""
    boxes = F.transform(box_col, G.xyxy_to_xywh) if input_mode == "xyxy" else F.col(box_col)
    lined = df.withColumn("_lines", merged_lines(boxes, F.col(text_col), y_tol, bar_mode))
    return lined.withColumns({"text_in_line": F.transform("_lines", lambda x: x["text"]), "bbox_in_line": F.transform("_lines", lambda x: x["box"])}).drop("_lines")


#: Boxes on a page up to which all its pairs cost less than a grid or a sweep.
FEW = 64
#: Pairs of boxes that are compared at a time.
_AT_ONCE = 1 << 20


def _starting_inside(a: np.ndarray, b: np.ndarray) -> tuple[tuple, tuple]:
    """For intervals (start, end) ``a`` and ``b``: the order of all starts of ``b``, and the range
    there of those in [start, end) of each of ``a``; then the same for starts of ``a`` in (start,
    end) of each of ``b``, as two such triples. Each two that share some length are in one range."""
    by_b, by_a = np.argsort(b[:, 0], kind="stable"), np.argsort(a[:, 0], kind="stable")
    in_a = np.searchsorted(b[by_b, 0], a[:, 0], "left"), np.searchsorted(b[by_b, 0], a[:, 1], "left")
    in_b = np.searchsorted(a[by_a, 0], b[:, 0], "right"), np.searchsorted(a[by_a, 0], b[:, 1], "left")
    return (by_b, *in_a), (by_a, *in_b)


def _members(order: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, member) of all ranges of ``order``, about ``_AT_ONCE`` at a time."""
    n = np.maximum(end - first, 0)
    total = np.cumsum(n)
    for k in np.split(np.arange(len(n)), np.searchsorted(total, np.arange(_AT_ONCE, n.sum(), _AT_ONCE))):
        m = n[k]
        yield np.repeat(k, m), order[np.arange(m.sum()) + np.repeat(first[k] - np.cumsum(m) + m, m)]


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """G-06 of boxes along the last axis."""
    inter = np.maximum(np.minimum(a[..., :2] + a[..., 2:], b[..., :2] + b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0).prod(-1)
    union = np.maximum(a[..., 2:], 0).prod(-1) + np.maximum(b[..., 2:], 0).prod(-1) - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def meeting(gt: np.ndarray, pred: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """G-06 for one page: (i, j, overlap) of the boxes x, y, w, h that overlap by ``least`` or
    more, by i, then j. Only boxes side by side on an axis are compared: of the two axes
    the one with fewer such pairs. A ``least`` that needs no overlap takes all pairs, and so
    do pages of few boxes, which a sweep would cost more; the result is the same."""
    if len(gt) * len(pred) <= FEW * FEW:
        whole = _overlap(gt[:, None], pred[None])
        i, j = np.nonzero(whole >= least)
        return i, j, whole[i, j]
    if least > 0:
        axes = [_starting_inside(*[np.stack([x[:, k], x[:, k] + x[:, k + 2]], 1) for x in (gt, pred)]) for k in (0, 1)]
        of_gt, of_pred = min(axes, key=lambda axis: sum(int(np.maximum(e - f, 0).sum()) for _, f, e in axis))
        pieces = itertools.chain(_members(*of_gt), ((i, j) for j, i in _members(*of_pred)))
    else:
        every = np.arange(len(pred))
        pieces = _members(every, np.zeros(len(gt), np.int64), np.full(len(gt), len(pred)))
    found = []
    for i, j in pieces:
        v = _overlap(gt[i], pred[j])
        found.append((i[v >= least], j[v >= least], v[v >= least]))
    i, j, v = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i))
    return i[order], j[order], v[order]


def overlaps(boxes: DataFrame, page: list[str], key: str, box: str = "box", few: int = FEW) -> DataFrame:
    """R-08: page, key, box, key2, box2 of every two boxes (x, y, w, h) of a page that share
    area, each pair once (key < key2; keys are unique in a page, boxes without area share none).

    A grid for each power of two: a box is at home in the cells it touches (four at most) of the
    grid whose cells are as large as itself, and asks in the cells it touches of that grid and of
    the coarser ones that have boxes. So a box costs some rows for each grid, whatever its
    size and whatever else is on its page, and the join's keys are places, not pages. Two
    boxes that meet in several cells count where their overlap's upper left corner is. Pages
    of at most ``few`` boxes are joined by page instead, which gives the same pairs."""
    x, y, w, h = (F.col(box)[i] for i in range(4))
    level = F.ceil(F.log2(F.greatest(w, h))).cast("int")
    sized = boxes.filter((w > 0) & (h > 0)).select(*page, F.col(key).alias("_k"), F.col(box).alias("_b"), level.alias("_own"))
    sized = sized.withColumn("_n", F.count("*").over(Window.partitionBy(*page)))
    small, sized = sized.filter(F.col("_n") <= few), sized.filter(F.col("_n") > few)
    levels = sized.agg(F.collect_set("_own").alias("_levels"))  # one row: a double has some 2,000 exponents

    def placed(rows: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        size, b = F.pow(F.lit(2.0), F.col("_l")), F.col("_b")
        reach = lambda i: F.sequence(F.floor(b[i] / size), F.floor((b[i] + b[i + 2]) / size))
        at = rows.withColumn("_cx", F.explode(reach(0))).withColumn("_cy", F.explode(reach(1)))
        return at.select(*page, "_l", "_cx", "_cy", *[F.col(c).alias(n) for c, n in zip(("_k", "_b", "_own"), names, strict=True)])

    home = placed(sized.withColumn("_l", F.col("_own")), ("_k1", "_b1", "_own1"))
    asking = sized.join(F.broadcast(levels)).withColumn("_l", F.explode(F.filter("_levels", lambda v: v >= F.col("_own"))))
    met = home.join(placed(asking, ("_k2", "_b2", "_own2")), [*page, "_l", "_cx", "_cy"])
    met = met.filter((F.col("_own2") < F.col("_own1")) | ((F.col("_own2") == F.col("_own1")) & (F.col("_k2") < F.col("_k1"))))
    a, b, size = F.col("_b1"), F.col("_b2"), F.pow(F.lit(2.0), F.col("_l"))
    corner = [F.greatest(a[i], b[i]) for i in (0, 1)]
    share = [corner[i] < F.least(a[i] + a[i + 2], b[i] + b[i + 2]) for i in (0, 1)]
    once = (F.floor(corner[0] / size) == F.col("_cx")) & (F.floor(corner[1] / size) == F.col("_cy"))
    both = [small.select(*page, F.col("_k").alias(f"_k{i}"), F.col("_b").alias(f"_b{i}")) for i in (1, 2)]
    columns = [*page, "_k1", "_b1", "_k2", "_b2"]
    found = met.filter(share[0] & share[1] & once).select(*columns).unionByName(both[0].join(both[1], page).filter((F.col("_k2") < F.col("_k1")) & share[0] & share[1]).select(*columns))
    turned = F.col("_k2") < F.col("_k1")
    pick = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    return found.select(*page, pick("_k2", "_k1").alias(key), pick("_b2", "_b1").alias(box), pick("_k1", "_k2").alias(f"{key}2"), pick("_b1", "_b2").alias(f"{box}2"))


def greedy_match(i: np.ndarray, j: np.ndarray, overlap: np.ndarray) -> list[tuple[int, int]]:
    """K-11: pairs of ``meeting`` by overlap, the greatest first, ties in row order; each box once."""
    order = np.argsort(-overlap, kind="stable")
    rows, cols, out = set(), set(), []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if a not in rows and b not in cols:
            rows.add(a)
            cols.add(b)
            out.append((a, b))
    return out


def average_precision(i: np.ndarray, j: np.ndarray, overlap: np.ndarray, n_gt: int, scores: np.ndarray) -> float:
    """K-12: 11-point average precision over pairs of ``meeting``; equal scores are visited last
    place first. Each prediction takes the best free ground truth it meets, the first at a tie."""
    n_pred = len(scores)
    if not n_gt or not n_pred:
        return 0.0
    best_first = np.lexsort((i, -overlap, j))
    ends = np.searchsorted(j[best_first], np.arange(n_pred + 1)).tolist()
    met = i[best_first].tolist()
    free, hit = np.ones(n_gt, bool), np.zeros(n_pred)
    for rank, p in enumerate(np.argsort(scores, kind="stable")[::-1].tolist()):
        own = next((g for g in met[ends[p] : ends[p + 1]] if free[g]), None)
        if own is not None:
            hit[rank], free[own] = 1, False
    tp = np.cumsum(hit)
    precision, recall = tp / (np.arange(1, n_pred + 1) + 1e-8), tp / n_gt
    best_from = np.maximum.accumulate(precision[::-1])[::-1]
    at = np.searchsorted(recall, LEVELS)
    return float(np.where(at < n_pred, best_from[np.minimum(at, n_pred - 1)], 0.0).mean())


def page_metrics(gt: np.ndarray, pred: np.ndarray, scores: np.ndarray, *thresholds: float) -> list[list[float]]:
    """K-13: TP, FP, FN, precision, recall, F1 and average precision at each threshold; boxes
    are compared once."""
    i, j, overlap = meeting(gt, pred, min(thresholds))
    out = []
    for least in thresholds:
        k = overlap >= least
        pairs = i[k], j[k], overlap[k]
        tp = len(greedy_match(*pairs))
        fp, fn = len(pred) - tp, len(gt) - tp
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        out.append([float(tp), float(fp), float(fn), p, r, 2 * p * r / (p + r) if p + r else 0.0, average_precision(*pairs, len(gt), scores)])
    return out


def _flat_boxes(pages: list) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of all pages one behind the other, and each page's number of them."""
    sizes = np.fromiter((len(p) for p in pages), np.int64, len(pages))
    rows = [b for p in pages for b in p]
    return np.concatenate([np.zeros(0), *rows]).reshape(len(rows), 4), sizes


def many_page_metrics(gt: list, pred: list, scores: list, thresholds: tuple[float, ...]) -> np.ndarray:
    """``page_metrics`` of many small pages together: (pages, thresholds, METRICS). Each round
    takes every page's next pair, so there are as many rounds as the fullest page has boxes."""
    g, n_gt = _flat_boxes(gt)
    p, n_pred = _flat_boxes(pred)
    rank = np.fromiter(itertools.chain.from_iterable(scores), float, len(p))
    pages, first_gt, first_pred = np.arange(len(gt)), np.cumsum(n_gt) - n_gt, np.cumsum(n_pred) - n_pred
    of = np.repeat(pages, n_gt * n_pred)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n_gt * n_pred) - n_gt * n_pred, n_gt * n_pred)
    every_i, every_j = first_gt[of] + place // n_pred[of], first_pred[of] + place % n_pred[of]
    every_v = _overlap(g[every_i], p[every_j])
    # Predictions by score, equal ones last place first, as they are visited.
    own = np.repeat(pages, n_pred)
    visit = np.lexsort((-np.arange(len(p)), -rank, own))
    nth = np.empty(len(p), np.int64)
    nth[visit] = np.arange(len(p)) - first_pred[own]
    out = np.zeros((len(gt), len(thresholds), len(METRICS)))
    widest = int(n_pred.max(initial=0))
    for k, least in enumerate(thresholds):
        keep = every_v >= least
        i, j, v, page = every_i[keep], every_j[keep], every_v[keep], of[keep]
        # K-11: of the pairs that are left, each page's best one is taken.
        left = np.lexsort((j, i, -v, page))
        used_g, used_p, tp = np.zeros(len(g), bool), np.zeros(len(p), bool), np.zeros(len(gt))
        while len(left):
            best = left[np.flatnonzero(np.diff(page[left], prepend=-1))]
            used_g[i[best]], used_p[j[best]] = True, True
            tp[page[best]] += 1
            left = left[~(used_g[i[left]] | used_p[j[left]])]
        # K-12: each page's next prediction takes the best ground truth that is free.
        hit, free = np.zeros((len(gt), widest)), np.ones(len(g), bool)
        order = np.lexsort((i, -v, nth[j]))
        ends = np.searchsorted(nth[j][order], np.arange(widest + 1))
        for n in range(widest):
            turn = order[ends[n] : ends[n + 1]]
            turn = turn[free[i[turn]]]
            took = turn[np.unique(page[turn], return_index=True)[1]]
            free[i[took]], hit[page[took], n] = False, 1
        precision, recall = np.cumsum(hit, 1) / (np.arange(1, widest + 1) + 1e-8), np.cumsum(hit, 1) / n_gt[:, None]
        precision[np.arange(widest) >= n_pred[:, None]] = 0
        best_from = np.maximum.accumulate(precision[:, ::-1], 1)[:, ::-1] if widest else precision
        levels = np.zeros((len(gt), len(LEVELS)))
        for m, level in enumerate(LEVELS):
            at = (recall < level).sum(1)
            there = np.flatnonzero(at < n_pred)
            levels[there, m] = best_from[there, at[there]]
        fp, fn = n_pred - tp, n_gt - tp
        pr, rc = tp / n_pred, tp / n_gt
        f1 = np.divide(2 * pr * rc, pr + rc, out=np.zeros(len(gt)), where=pr + rc > 0)
        out[:, k] = np.stack([tp, fp, fn, pr, rc, f1, levels.mean(1)], 1)
    return out


#: Pairs of boxes of small pages that are compared together.
_PAIRS = 1 << 18


def metrics_udf(thresholds: tuple[float, ...]):
    """(gt boxes in pixels, predicted boxes, scores) to one list of ``METRICS`` a threshold;
    null where either side has no boxes. Scores of another number than boxes count as 1."""

    @F.pandas_udf("array<array<double>>")
    def run(gt: pd.Series, pred: pd.Series, scores: pd.Series) -> pd.Series:
        out, few, pairs = [None] * len(gt), [], 0

        def flush() -> None:
            if few:
                at, *pages = zip(*few, strict=True)
                for row, m in zip(at, many_page_metrics(*pages, thresholds), strict=True):
                    out[row] = list(m)
                few.clear()

        for row, (g, p, s) in enumerate(zip(gt, pred, scores, strict=True)):
            if g is None or p is None or not len(g) or not len(p):
                continue
            s = np.ones(len(p)) if s is None or len(s) != len(p) else np.array(s, float)
            if min(thresholds) > 0 and max(len(g), len(p)) <= FEW and not np.isnan(s).any():
                few.append((row, g, p, s))
                pairs += len(g) * len(p)
                if pairs > _PAIRS:
                    flush()
                    pairs = 0
                continue
            g, p = (np.array([np.array(b, float) for b in x]) for x in (g, p))
            out[row] = page_metrics(g, p, s, *thresholds)
        flush()
        return pd.Series(out)

    return run


def add_metrics(pred: DataFrame, gt: DataFrame, key: str, pred_boxes: str = "bbox_in_line", scores: str | None = "confidence", thresholds: tuple[float, ...] = (0.5, 0.75), prefix: str = "tess") -> DataFrame:
    """R-04, R-22: ``pred`` with ``{prefix}_{metric}@{threshold}`` columns, by its page's
    ground truth (``gt``: key, boxes in percent x, y, w, h, width, height; the last of
    repeated keys by ``ordinal``, without such a column the greatest in boxes). Null without
    boxes on both sides."""
    ordinal = F.col("ordinal") if "ordinal" in gt.columns else F.struct("boxes", "width", "height")
    truth = gt.withColumn("_o", ordinal).groupBy(key).agg(F.max_by(F.struct("boxes", "width", "height"), "_o").alias("_gt"))
    joined = pred.join(truth, key, "left")
    in_px = F.transform("_gt.boxes", lambda b: G.percent_to_px(b, F.col("_gt.width"), F.col("_gt.height")))
    score = F.col(scores) if scores and scores in pred.columns else F.lit(None).cast("array<double>")
    out = joined.withColumn("_m", metrics_udf(thresholds)(in_px, F.col(pred_boxes), score))
    return out.withColumns({f"{prefix}_{m}@{t}": F.get(F.get("_m", F.lit(i)), F.lit(j)) for i, t in enumerate(thresholds) for j, m in enumerate(METRICS)}).drop("_gt", "_m")


def summarize(pred: DataFrame, prefix: str = "tess", thresholds: tuple[float, ...] = (0.5, 0.75), by: list[str] | None = None) -> DataFrame:
    """R-16: means of the metric columns over pages that have them, and how many those are."""
    names = [f"{prefix}_{m}@{t}" for t in thresholds for m in METRICS]
    return pred.groupBy(*(by or [])).agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names], F.count(F.col(f"`{names[0]}`")).alias("pages"))

