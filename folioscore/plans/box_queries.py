"""Queries over boxes and layout; a page is an order, its boxes the order's lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout as L
from .registry import register
from .tables import table
from .text_queries import six

W, H = 1000, 800
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
#: x, y, w, h in percent, the same in SQL.
_XYWH_SQL = "[CAST(l_partkey % 90 AS DOUBLE), CAST(l_suppkey % 80 AS DOUBLE), CAST(l_quantity AS DOUBLE), CAST(l_linenumber * 5 AS DOUBLE)]"


def _xywh() -> Column:
    return F.array((F.col("l_partkey") % 90).cast("double"), (F.col("l_suppkey") % 80).cast("double"), F.col("l_quantity").cast("double"), (F.col("l_linenumber") * 5).cast("double"))


def _items(spark, sf):
    return table(spark, sf, "lineitem").select(*_KEYS, _xywh().alias("b"))


def _four(box: Column, names=("x1", "y1", "x2", "y2")) -> list[Column]:
    return [box[i].alias(n) for i, n in enumerate(names)]


_BASE = f"b AS (SELECT {', '.join(_KEYS)}, {_XYWH_SQL} AS b FROM lineitem)"


@register("q_box_percent_to_px", f"WITH {_BASE}, p AS (SELECT *, [b[1] / 100 * {W}, b[2] / 100 * {H}, b[3] / 100 * {W}, b[4] / 100 * {H}] AS p FROM b) SELECT {', '.join(_KEYS)}, p[1] AS x1, p[2] AS y1, p[1] + p[3] AS x2, p[2] + p[4] AS y2 FROM p")
def q_box_percent_to_px(spark, sf):
    return _items(spark, sf).select(*_KEYS, G.xywh_to_xyxy(G.percent_to_px(F.col("b"), F.lit(W), F.lit(H))).alias("p")).select(*_KEYS, *_four(F.col("p")))


@register("q_box_hull", f"WITH {_BASE}, q AS (SELECT *, [b[1], b[3], b[4], b[2]] AS xs, [b[2], b[1], b[3], b[4]] AS ys FROM b) SELECT {', '.join(_KEYS)}, list_min(xs) AS x1, list_min(ys) AS y1, list_max(xs) AS x2, list_max(ys) AS y2 FROM q")
def q_box_hull(spark, sf):
    points = F.array(*[F.array(F.col("b")[i], F.col("b")[j]) for i, j in ((0, 1), (2, 0), (3, 2), (1, 3))])
    return _items(spark, sf).select(*_KEYS, G.hull(points).alias("p")).select(*_KEYS, *_four(F.col("p")))


@register("q_box_norm1000", f"WITH {_BASE} SELECT {', '.join(_KEYS)}, " + ", ".join(f"CAST(greatest(0, least(1000, round_even(1000 * b[{i}] / {s}, 0))) AS INTEGER) AS {n}" for i, s, n in ((1, 90.0, "x1"), (2, 70.0, "y1"), (3, 90.0, "x2"), (4, 70.0, "y2"))) + " FROM b")
def q_box_norm1000(spark, sf):
    return _items(spark, sf).select(*_KEYS, G.norm_1000(F.col("b"), F.lit(90), F.lit(70)).alias("p")).select(*_KEYS, *_four(F.col("p")))


_UNIT = f"WITH {_BASE}, m AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN list_transform(b, lambda v: v / 200) WHEN l_linenumber % 3 = 1 THEN b ELSE list_transform(b, lambda v: v * 3) END AS v FROM b), u AS (SELECT *, CASE WHEN list_max(v) <= 1 THEN 1.0 WHEN list_max(v) <= 100 THEN 100.0 END AS u FROM m)"


@register("q_unit_guess", _UNIT + f" SELECT {', '.join(_KEYS)}, " + ", ".join(f"CASE WHEN u IS NULL THEN v[{i}] ELSE v[{i}] * {s} / CAST(u AS DOUBLE) END AS {n}" for i, s, n in ((1, W, "x"), (2, H, "y"), (3, W, "w"), (4, H, "h"))) + " FROM u")
def q_unit_guess(spark, sf):
    kind = F.col("l_linenumber") % 3
    v = F.when(kind == 0, F.transform("b", lambda x: x / 200)).when(kind == 1, F.col("b")).otherwise(F.transform("b", lambda x: x * 3))
    return _items(spark, sf).select(*_KEYS, G.guess_unit_to_px(v, F.lit(W), F.lit(H)).alias("p")).select(*_KEYS, *_four(F.col("p"), ("x", "y", "w", "h")))


@register("q_clip_box", f"WITH {_BASE}, r AS (SELECT *, " + ", ".join(f"greatest(0, least({s}, CAST(round_even(b[{i}] * 1.5, 0) AS INTEGER))) AS {n}" for i, s, n in ((1, 100, "a"), (2, 90, "c"), (3, 100, "d"), (4, 90, "e"))) + f" FROM b) SELECT {', '.join(_KEYS)}, a AS x1, c AS y1, CASE WHEN d <= a THEN least(100, a + 1) ELSE d END AS x2, CASE WHEN e <= c THEN least(90, c + 1) ELSE e END AS y2 FROM r")
def q_clip_box(spark, sf):
    return _items(spark, sf).select(*_KEYS, G.clip_box(F.transform("b", lambda x: x * 1.5), F.lit(100), F.lit(90)).alias("p")).select(*_KEYS, *_four(F.col("p")))


@register("q_polygon_rect", f"WITH {_BASE}, r AS (SELECT *, list_min([b[1], b[3]]) AS x1, list_max([b[1], b[3]]) AS x2, list_min([b[2], b[4]]) AS y1, list_max([b[2], b[4]]) AS y2 FROM b) SELECT {', '.join(_KEYS)}, " + ", ".join(f"round_even(greatest(0.0, least(100.0, 100 * ({e}) / {s})), 2) AS {n}" for e, s, n in (("x1", "90.0", "x"), ("y1", "80.0", "y"), ("x2 - x1", "90.0", "width"), ("y2 - y1", "80.0", "height"))) + " FROM r")
def q_polygon_rect(spark, sf):
    b = F.col("b")
    polygon = F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]))
    extent = F.struct(F.lit(90.0).alias("w"), F.lit(80.0).alias("h"))
    return _items(spark, sf).select(*_KEYS, G.polygon_to_rect(polygon, extent).alias("r")).select(*_KEYS, "r.x", "r.y", "r.width", "r.height")


_IOU_SQL = "CASE WHEN greatest(a.b[3], 0) * greatest(a.b[4], 0) + greatest(c.b[3], 0) * greatest(c.b[4], 0) - i.v > 0 THEN i.v / (greatest(a.b[3], 0) * greatest(a.b[4], 0) + greatest(c.b[3], 0) * greatest(c.b[4], 0) - i.v) ELSE 0.0 END"


@register(
    "q_iou_pairs",
    f"""WITH {_BASE}, x AS (SELECT a.l_orderkey, a.b AS p, c.b AS q, greatest(0.0, least(a.b[1] + a.b[3], c.b[1] + c.b[3]) - greatest(a.b[1], c.b[1])) * greatest(0.0, least(a.b[2] + a.b[4], c.b[2] + c.b[4]) - greatest(a.b[2], c.b[2])) AS i FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND (a.l_partkey, a.l_suppkey, a.l_linenumber) < (c.l_partkey, c.l_suppkey, c.l_linenumber)),
o AS (SELECT l_orderkey, CASE WHEN p[3] * p[4] + q[3] * q[4] - i > 0 THEN i / (p[3] * p[4] + q[3] * q[4] - i) ELSE 0.0 END AS iou FROM x)
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (iou >= 0.5) AS BIGINT) AS over_half, floor(max(iou) * 1e6 + 0.5) / 1e6 AS best FROM o GROUP BY l_orderkey""",
)
def q_iou_pairs(spark, sf):
    """R-08, G-06: pairs that share no area have an overlap of 0 and are counted, not joined."""
    # Laid out by page once, as plain columns; what follows is by page and moves no row again.
    rows = table(spark, sf, "lineitem").select(*_KEYS, "l_quantity").repartition("l_orderkey")
    b = rows.select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("k"), _xywh().alias("b"))
    iou = L.overlaps(b, ["l_orderkey"], "k", "b").select("l_orderkey", G.iou(F.col("b"), F.col("b2")).alias("iou"))
    found = iou.groupBy("l_orderkey").agg(F.count_if(F.col("iou") >= 0.5).alias("over_half"), F.max("iou").alias("best"))
    sizes = b.groupBy("l_orderkey", "k").agg(F.count("*").alias("c")).groupBy("l_orderkey").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    pairs = ((F.col("n") * F.col("n") - F.col("same")) / 2).cast("long").alias("pairs")
    return sizes.filter("n * n > same").join(found, "l_orderkey", "left").select("l_orderkey", pairs, F.coalesce("over_half", F.lit(0)).alias("over_half"), six(F.coalesce("best", F.lit(0.0))).alias("best"))


def _pages(spark, sf):
    """Orders as pages: boxes by (line, part, supplier), texts and scores."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), _xywh().alias("b"), F.col("l_returnflag").alias("t")).alias("r"))
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("r"))


@register("q_reading_order_sort", "WITH o AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey % 7, n) AS parts, CAST(max(n) AS INTEGER) AS last FROM o GROUP BY l_orderkey")
def q_reading_order_sort(spark, sf):
    pages = _pages(spark, sf)
    parts = F.transform("r", lambda x: x["l_partkey"].cast("string"))
    numbers = F.transform("r", lambda x: x["l_partkey"] % 7)
    ordered = G.by_reading_order(numbers, parts)
    return pages.select("l_orderkey", F.array_join(ordered, ",").alias("parts"), F.array_max(G.renumbered(ordered)).alias("last"))


_SORT = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag"
_FRAGMENTS = f"""f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY mid, n) AS m FROM (
  SELECT l_orderkey, CAST(l_partkey % 90 AS DOUBLE) AS x, CAST(l_linenumber * 5 AS DOUBLE) AS h, l_suppkey % 80 + l_linenumber * 5 / 2.0 AS mid, l_returnflag AS t,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SORT}) AS n FROM lineitem))"""


@register(
    "q_merge_lines",
    f"""WITH RECURSIVE {_FRAGMENTS},
walk AS (SELECT l_orderkey, m, 1 AS line, CAST(mid AS DOUBLE) AS sm, h AS sh, 1 AS c FROM f WHERE m = 1 UNION ALL
  SELECT f.l_orderkey, f.m, CASE WHEN near THEN line ELSE line + 1 END, CASE WHEN near THEN sm + mid ELSE mid END, CASE WHEN near THEN sh + h ELSE h END, CASE WHEN near THEN c + 1 ELSE 1 END
  FROM (SELECT f.*, w.line, w.sm, w.sh, w.c, abs(f.mid - w.sm / w.c) <= greatest(f.h, w.sh / w.c) * 0.6 :: DOUBLE AS near FROM walk w JOIN f ON f.l_orderkey = w.l_orderkey AND f.m = w.m + 1) f),
l AS (SELECT l_orderkey, line, string_agg(t, ' ' ORDER BY x, m) AS text FROM walk JOIN f USING (l_orderkey, m) GROUP BY l_orderkey, line)
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS lines, string_agg(text, '/' ORDER BY line) AS texts FROM l GROUP BY l_orderkey""",
)
def q_merge_lines(spark, sf):
    pages = _pages(spark, sf).select("l_orderkey", F.transform("r", lambda x: x["b"]).alias("boxes"), F.transform("r", lambda x: x["t"]).alias("texts"))
    lined = L.build_line_columns(pages, "texts", "boxes")
    return lined.select("l_orderkey", F.size("text_in_line").alias("lines"), F.array_join("text_in_line", "/").alias("texts"))


def _matched(spark, sf):
    """Each page's boxes against the same boxes shifted by a little, scored by price."""
    pages = _pages(spark, sf)
    gt = pages.select("l_orderkey", F.transform("r", lambda x: x["b"]).alias("boxes"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    shifted = lambda x: F.array(x["b"][0] + (x["l_linenumber"] % 4), x["b"][1], x["b"][2], x["b"][3])
    pred = pages.select("l_orderkey", F.transform(F.filter("r", lambda x: x["l_linenumber"] != 2), shifted).alias("bbox_in_line"), F.transform(F.filter("r", lambda x: x["l_linenumber"] != 2), lambda x: x["price"]).alias("confidence"))
    return L.add_metrics(pred, gt, "l_orderkey", prefix="m")


def _match_sql(score: str) -> str:
    """CTEs up to ``r``: l_orderkey, thr and the page's measures, by plain steps: pairs by
    overlap for the greedy match, predictions by score for the average precision."""
    box = "CAST(l_partkey % 90 AS DOUBLE) AS x, CAST(l_suppkey % 80 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w, CAST(l_linenumber * 5 AS DOUBLE) AS h"
    return f"""b AS (SELECT l_orderkey, l_linenumber, l_extendedprice, {box}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SORT}) AS n FROM lineitem),
g AS (SELECT l_orderkey, n AS i, x / 100 * 100 AS x, y / 100 * 100 AS y, w / 100 * 100 AS w, h / 100 * 100 AS h FROM b),
p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS j, x + l_linenumber % 4 AS x, y, w, h, {score} AS score FROM b WHERE l_linenumber <> 2),
o AS (SELECT g.l_orderkey, i, j, score, greatest(least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x), 0) * greatest(least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y), 0) AS inter, g.w * g.h AS ga, p.w * p.h AS pa FROM g JOIN p USING (l_orderkey)),
iou AS (SELECT l_orderkey, i, j, score, CASE WHEN ga + pa - inter > 0 THEN inter / (ga + pa - inter) ELSE 0.0 END AS v FROM o),
t AS (SELECT CAST(unnest([0.5, 0.75]) AS DOUBLE) AS thr),
cand AS (SELECT l_orderkey, thr, i, j, row_number() OVER (PARTITION BY l_orderkey, thr ORDER BY v DESC, i, j) AS n FROM iou, t WHERE v >= thr),
gm AS (SELECT DISTINCT l_orderkey, thr, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gi, CAST([] AS BIGINT[]) AS pj FROM p, t UNION ALL
  SELECT l_orderkey, thr, n, CASE WHEN free THEN list_append(gi, i) ELSE gi END, CASE WHEN free THEN list_append(pj, j) ELSE pj END FROM (
    SELECT c.l_orderkey, c.thr, c.n, c.i, c.j, gm.gi, gm.pj, NOT list_contains(gm.gi, c.i) AND NOT list_contains(gm.pj, c.j) AS free FROM gm JOIN cand c ON c.l_orderkey = gm.l_orderkey AND c.thr = gm.thr AND c.n = gm.n + 1)),
tp AS (SELECT l_orderkey, thr, CAST(max(len(gi)) AS DOUBLE) AS tp FROM gm GROUP BY l_orderkey, thr),
vis AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, j DESC) AS k, v FROM (SELECT l_orderkey, j, any_value(score) AS score, list(v ORDER BY i) AS v FROM iou GROUP BY l_orderkey, j)),
ap AS (SELECT DISTINCT l_orderkey, thr, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS INTEGER[]) AS hits FROM p, t UNION ALL
  SELECT l_orderkey, thr, k, CASE WHEN list_max(f) >= thr THEN list_append(used, CAST(list_position(f, list_max(f)) AS BIGINT)) ELSE used END, list_append(hits, CASE WHEN list_max(f) >= thr THEN 1 ELSE 0 END) FROM (
    SELECT a.l_orderkey, a.thr, vis.k, a.used, a.hits, list_transform(vis.v, lambda x, i: CASE WHEN list_contains(a.used, i) THEN -1.0 :: DOUBLE ELSE x END) AS f FROM ap a JOIN vis ON vis.l_orderkey = a.l_orderkey AND vis.k = a.k + 1)),
ng AS (SELECT l_orderkey, count(*) AS ng FROM g GROUP BY l_orderkey), np AS (SELECT l_orderkey, count(*) AS np FROM p GROUP BY l_orderkey),
curve AS (SELECT l_orderkey, thr, ng, np, list_transform(range(1, np + 1), lambda k: list_sum(hits[1:k])) AS c FROM ap JOIN ng USING (l_orderkey) JOIN np USING (l_orderkey) WHERE k = np),
pr AS (SELECT l_orderkey, thr, list_transform(c, lambda s, k: s / (k + 1e-8 :: DOUBLE)) AS prec, list_transform(c, lambda s: s / CAST(ng AS DOUBLE)) AS rec FROM curve),
av AS (SELECT l_orderkey, thr, list_avg(list_transform(range(0, 11), lambda l: coalesce(list_max(list_transform(list_filter(list_zip(rec, prec), lambda z: z[1] >= l * 0.1 :: DOUBLE), lambda z: z[2])), 0.0 :: DOUBLE))) AS ap FROM pr),
m AS (SELECT l_orderkey, thr, tp, np - tp AS fp, ng - tp AS fn, tp / np AS p, tp / ng AS r, ap FROM tp JOIN av USING (l_orderkey, thr) JOIN ng USING (l_orderkey) JOIN np USING (l_orderkey)),
r AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m)"""


_PRICES = _match_sql("l_extendedprice")


@register("q_greedy_match", f"WITH RECURSIVE {_PRICES} SELECT ng.l_orderkey, tp, fp, fn, floor(ap * 1e6 + 0.5) / 1e6 AS ap FROM ng LEFT JOIN r ON ng.l_orderkey = r.l_orderkey AND thr = 0.5")
def q_greedy_match(spark, sf):
    return _matched(spark, sf).select("l_orderkey", *[F.col(f"`m_{k}@0.5`").alias(k.lower()) for k in ("TP", "FP", "FN")], six(F.col("`m_mAP@0.5`")).alias("ap"))


_MEASURES = {"TP": "tp", "FP": "fp", "FN": "fn", "Precision": "p", "Recall": "r", "F1": "f1", "mAP": "ap"}


@register(
    "q_layout_summary",
    f"WITH RECURSIVE {_PRICES} SELECT {', '.join(f'floor(avg({c}) FILTER (thr = {t}) * 1e6 + 0.5) / 1e6 AS m_{m}_{n}' for t, n in ((0.5, '05'), (0.75, '075')) for m, c in _MEASURES.items())}, CAST(count(*) FILTER (thr = 0.5) AS BIGINT) AS pages FROM r",
)
def q_layout_summary(spark, sf):
    s = L.summarize(_matched(spark, sf), "m")
    return s.select(*[six(F.col(f"`{c}`")).alias(c.replace("@", "_").replace(".", "")) for c in s.columns if c != "pages"], "pages")


@register("q_ap11", f"WITH RECURSIVE {_match_sql('l_linenumber % 3')} SELECT l_orderkey, floor(max(ap) FILTER (thr = 0.5) * 1e6 + 0.5) / 1e6 AS ap, floor(max(ap) FILTER (thr = 0.75) * 1e6 + 0.5) / 1e6 AS ap_strict FROM r GROUP BY l_orderkey")
def q_ap11(spark, sf):
    """Average precision where many scores tie, some boxes are missed and some found twice."""
    pages = _pages(spark, sf)
    boxes = F.transform("r", lambda x: G.percent_to_px(x["b"], F.lit(100), F.lit(100)))
    kept = F.filter("r", lambda x: x["l_linenumber"] != 2)
    said = F.transform(kept, lambda x: F.array(x["b"][0] + (x["l_linenumber"] % 4), x["b"][1], x["b"][2], x["b"][3]))
    scores = F.transform(kept, lambda x: (x["l_linenumber"] % 3).cast("double"))
    found = pages.select("l_orderkey", L.metrics_udf((0.5, 0.75))(boxes, said, scores).alias("m")).filter("m is not null")
    ap = lambda i: six(F.get(F.get("m", F.lit(i)), F.lit(6)))
    return found.select("l_orderkey", ap(0).alias("ap"), ap(1).alias("ap_strict"))
