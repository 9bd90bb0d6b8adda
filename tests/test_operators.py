import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscore.functions import text as T
from folioscore.functions import unicode as U
from folioscore.operators import bleu as B
from folioscore.operators import edit_distance as D
from folioscore.operators import evaluate as E
from folioscore.operators import inference as I
from folioscore.operators import layout as L
from folioscore.operators import relational as R
from folioscore.operators import sections as S
from folioscore.operators import tokens as K


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_words_are_numbered_row_by_row(monkeypatch):
    """Nulls, empty lists and null words, in batches of a few words."""
    import pyarrow as pa

    monkeypatch.setattr(D, "_WORDS", 3)
    a = pa.array([["a", "b"], None, [], ["a", None, "c", "d"], ["z"]], pa.list_(pa.string()))
    b = pa.array([["b", "a"], ["x"], None, ["a", None, "d"], []], pa.list_(pa.string()))
    found = list(D.numbered(a.slice(0), b))
    assert [(x is None, y is None) for x, y in found] == [(False, False), (True, False), (False, True), (False, False), (False, False)]
    assert [None if x is None or y is None else D.levenshtein(x, y) for x, y in found] == [2, None, None, 1, 1]
    assert list(map(len, D.numbered(a.slice(3), b.slice(3)))) == [2, 2]


def plain_damerau(a, b):
    far, d, seen = len(a) + len(b), {}, {}
    d[-1, -1] = far
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, c, same = seen.get(b[j - 1], 0), col, a[i - 1] == b[j - 1]
            if same:
                col = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, c - 1] + (i - k - 1) + 1 + (j - c - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abcd", max_size=14))
def test_distances_are_the_plain_ones(a, b):
    assert D.levenshtein(a, b) == plain_levenshtein(a, b) == D.levenshtein(b, a)
    assert D.damerau(a, b) == plain_damerau(a, b) == D.damerau(b, a) <= D.levenshtein(a, b)


def test_known_distances():
    assert D.damerau("ca", "abc") == 2 and D.damerau(list("abcd"), list("bac")) == 2
    long = [str(i % 700) for i in range(5000)]
    assert D.levenshtein(long, long[1:] + ["x"]) == 2


def test_text_levenshtein(spark, monkeypatch):
    """Short texts by Spark, long ones by the kernel, of any characters."""
    rnd = random.Random(1)
    some = lambda n: "".join(rnd.choice("abcé😀") for _ in range(n))
    rows = [(some(rnd.randrange(12)), some(rnd.randrange(12))) for _ in range(60)] + [(None, "a"), ("a" * 900, "b" + "a" * 900), (some(500), some(30))]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", D.text_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r["d"] == (None if r["a"] is None else plain_levenshtein(r["a"], r["b"])) for r in out)


def test_bleu_counts_by_plain_counting(spark):
    from collections import Counter

    rnd = random.Random(2)
    some = lambda: [rnd.choice("a b c dd é".split()) for _ in range(rnd.randrange(0, 25))]
    rows = [(i, some(), some()) for i in range(700)] + [(700, None, ["a"]), (701, ["a"], None), (702, None, None)]
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    got = {r["id"]: r for r in B.page_stats(spark.createDataFrame(rows, "id int, ref array<string>, hyp array<string>").repartition(3), ["id"], "ref", "hyp").collect()}
    for i, ref, hyp in rows:
        ref, hyp = ref or [], hyp or []
        assert (got[i]["hyp_len"], got[i]["ref_len"]) == (len(hyp), len(ref))
        for n in range(1, 5):
            g, h = grams(ref, n), grams(hyp, n)
            assert (got[i][f"c{n}"], got[i][f"t{n}"]) == (sum((g & h).values()), sum(h.values())), (i, n)


@pytest.mark.parametrize(("g", "h", "wer", "cer"), [("the cat sat on mat", "the cat on the mat", 0.4, None), ("", "", 0.0, 0.0), ("", "x", 1.0, 1.0), ("É-b", "é b", 0.0, 1 / 3), (None, None, 0.0, 0.0)])
def test_error_rates(spark, g, h, wer, cer):
    r = spark.createDataFrame([(g, h)], "g string, h string").select(D.wer(F.col("g"), F.col("h")).alias("w"), D.cer(F.col("g"), F.col("h")).alias("c")).collect()[0]
    assert r["w"] == pytest.approx(wer) and (cer is None or r["c"] == pytest.approx(cer))


def test_ndld(spark):
    rows = [(list("abcd"), list("bac"), 0.5), ([], [], 0.0), ([], ["x"], 1.0)]
    for r, (_, _, want) in zip(spark.createDataFrame(rows, "a array<string>, b array<string>, w double").select(D.ndld(F.col("a"), F.col("b")).alias("n")).collect(), rows, strict=True):
        assert r["n"]["ndld"] == want and r["n"]["similarity"] == 1 - want


def test_bleu(spark):
    rows = [(1, "the cat sat on a mat".split(), "the cat sat on the mat".split()), (2, [], ["a"]), (3, ["a"], []), (4, "a b c d e".split(), "a b c d e".split()), (5, ["x", "y"], ["p", "q"])]
    df = spark.createDataFrame(rows, "id int, ref array<string>, hyp array<string>")
    got = {r["id"]: r for r in B.page_stats(df, ["id"], "ref", "hyp").collect()}
    assert [got[1][c] for c in B.STATS] == [5, 6, 3, 5, 2, 4, 1, 3]
    score = {r["id"]: r for r in B.sentence_bleu(df, ["id"], "ref", "hyp").collect()}
    assert score[1]["score"] == pytest.approx(100 * (5 / 6 * 3 / 5 * 2 / 4 * 1 / 3) ** 0.25) and score[1]["score"] == pytest.approx(53.728, abs=1e-3)
    assert score[4]["score"] == pytest.approx(100) and score[2]["score"] == score[3]["score"] == score[5]["score"] == 0 and score[3]["bp"] == 0
    total = B.corpus_bleu(df.withColumn("e", F.lit("x")), ["e", "id"], "ref", "hyp", ["e"]).collect()[0]
    c, t = [10, 7, 5, 3], [14, 10, 7, 5]
    assert total["score"] == pytest.approx(100 * math.exp(1 - 14 / 14) * math.prod(a / b for a, b in zip(c, t)) ** 0.25)
    assert [total[f"p{n}"] for n in range(1, 5)] == pytest.approx([100 * a / b for a, b in zip(c, t)])
    # One match of one word: zero matches beyond count as 1/2, 1/4 of an n-gram.
    one = B.sentence_bleu(spark.createDataFrame([(1, "a z y".split(), "a b c".split())], df.schema), ["id"], "ref", "hyp").collect()[0]
    assert one["p2"] == pytest.approx(25) and one["p3"] == pytest.approx(25)


def plain_lines(boxes, texts, bar_mode="reference"):
    """K-09 fragment by fragment, with the mean of all middles and heights so far."""
    boxes, texts = [list(map(float, b)) for b in boxes or []], list(texts or [])
    if bar_mode == "reference":
        texts = [t for t in texts if t.strip() != "|"]
    pairs = [p for p in zip(boxes, texts) if bar_mode == "reference" or p[1].strip() != "|"]
    lines = []
    for b, t in sorted(pairs, key=lambda p: p[0][1] + p[0][3] / 2):
        m = b[1] + b[3] / 2
        if lines and abs(m - sum(lines[-1]["m"]) / len(lines[-1]["m"])) <= max(b[3], sum(lines[-1]["h"]) / len(lines[-1]["h"])) * 0.6:
            last = lines[-1]
            o = last["box"]
            x, y = min(o[0], b[0]), min(o[1], b[1])
            last["box"] = [x, y, max(o[0] + o[2], b[0] + b[2]) - x, max(o[1] + o[3], b[1] + b[3]) - y]
        else:
            lines.append(last := {"m": [], "h": [], "p": [], "box": b})
        last["m"].append(m)
        last["h"].append(b[3])
        last["p"].append((b[0], len(last["p"]), t))
    return [{"text": " ".join(t.strip() for _, _, t in sorted(x["p"])), "box": x["box"]} for x in lines]


def lines_of(spark, pages, bar_mode="reference"):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, boxes array<array<double>>, texts array<string>")
    rows = df.select("i", L.merged_lines(F.col("boxes"), F.col("texts"), bar_mode=bar_mode).alias("l")).orderBy("i").collect()
    return [[x.asDict() for x in r["l"]] for r in rows]


def test_lines(spark):
    boxes, texts = [[0.0, 0.0, 10.0, 10.0], [20.0, 2.0, 10.0, 10.0], [0.0, 20.0, 10.0, 10.0]], ["A", "B", "C"]
    whole, barred, none, short = lines_of(spark, [(boxes, texts), (boxes, ["A", "|", "B"]), (None, None), ([], ["a"])])
    assert whole == [{"text": "A B", "box": [0, 0, 30, 12]}, {"text": "C", "box": [0, 20, 10, 10]}]
    assert barred == [{"text": "A B", "box": [0, 0, 30, 12]}]
    assert [x["text"] for x in lines_of(spark, [(boxes, ["A", "|", "B"])], "aligned")[0]] == ["A", "B"]
    assert none == [] and short == []
    with pytest.raises(ValueError):
        L.merged_lines(F.col("boxes"), F.col("texts"), bar_mode="x")
    # Without numbers or a text: a line of its own, the text None.
    assert lines_of(spark, [([None, [1.0, 1.0, 2.0, 2.0]], ["a", None])])[0] == [{"text": "a", "box": None}, {"text": "None", "box": [1, 1, 2, 2]}]


@pytest.mark.parametrize("bar_mode", ["reference", "aligned"])
def test_lines_against_plain_ones(spark, bar_mode):
    rng = random.Random(5)
    page = lambda n: ([[rng.randrange(40) / 2, rng.randrange(12 * n) / 8, rng.randrange(9), rng.randrange(1, 9)] for _ in range(n)], [rng.choice(["a", " b\x1c", "|", " |\u2003", "c d", ""]) for _ in range(n + rng.randrange(-1, 2))])
    pages = [page(n) for n in (1, 2, 5, 7, 7, 7, 20, 60) for _ in range(4)]
    assert lines_of(spark, [([[float(v) for v in b] for b in bs], ts) for bs, ts in pages], bar_mode) == [plain_lines(*p, bar_mode) for p in pages]


def test_lines_stay_in_the_jvm(spark):
    df = spark.createDataFrame([], "b array<array<double>>, t array<string>")
    assert "Python" not in L.build_line_columns(df, "t", "b")._jdf.queryExecution().toString()


def every_overlap(a, b):
    """The matrix of G-06."""
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    inter = np.maximum(hi - lo, 0).prod(-1)
    union = np.maximum(a[:, 2:], 0).prod(-1)[:, None] + np.maximum(b[:, 2:], 0).prod(-1)[None] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


@pytest.mark.parametrize("at_once", [3, 1 << 20])
@pytest.mark.parametrize("least", [0.0, 1e-9, 0.3, 0.5])
def test_meeting_boxes_are_those_of_the_matrix(monkeypatch, at_once, least):
    monkeypatch.setattr(L, "_AT_ONCE", at_once)
    monkeypatch.setattr(L, "FEW", at_once % 4)
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 4), (5, 0), (1, 1), (12, 9), (60, 70)):
        for size in (6, 40):
            a, b = (np.column_stack([rng.integers(0, 40, (k, 2)), rng.integers(-1, size, (k, 2))]).astype(float) for k in (n, m))
            i, j, v = L.meeting(a, b, least)
            whole = every_overlap(a, b)
            want = np.nonzero(whole >= least)
            assert i.tolist() == want[0].tolist() and j.tolist() == want[1].tolist() and v.tolist() == whole[want].tolist()


def test_meeting_of_a_long_page_compares_few():
    """A list of 40,000 lines, all in one column, against itself moved a little."""
    gt = np.column_stack([np.zeros(40_000), np.arange(40_000) * 10.0, np.full(40_000, 100.0), np.full(40_000, 8.0)])
    i, j, v = L.meeting(gt, gt + [1, 1, 0, 0], 0.5)
    assert i.tolist() == j.tolist() == list(range(40_000)) and v.min() > 0.7


def at_least(m, least):
    i, j = np.nonzero(m >= least)
    return i, j, m[i, j]


def test_matching_and_precision():
    assert L.greedy_match(*at_least(np.array([[0.9, 0.8], [0.9, 0.1]]), 0.5)) == [(0, 0)]
    assert L.greedy_match(*at_least(np.array([[0.6, 0.8], [0.9, 0.7]]), 0.5)) == [(1, 0), (0, 1)]
    gt = np.array([[20.0 * i, 0, 10, 10] for i in range(10)])
    ap = lambda pred: L.average_precision(*L.meeting(gt, pred, 0.5), len(gt), np.ones(len(pred)))
    assert ap(gt[:3]) == pytest.approx(3 / 11)
    assert ap(gt) == pytest.approx(1)
    # Equal scores are visited last first: the miss in front comes last.
    pred = np.vstack([[[500.0, 0, 1, 1]], gt])
    assert ap(pred) == pytest.approx(1)
    (m,) = L.page_metrics(gt, pred, np.ones(11), 0.5)
    assert m[:3] == [10, 1, 0] and m[4] == 1 and m[5] == pytest.approx(20 / 21)


def test_add_metrics(spark):
    box = "array<array<double>>"
    gt = spark.createDataFrame([("a", [[0.0, 0.0, 50.0, 50.0]], 100, 100, 1), ("a", [[0.0, 0.0, 10.0, 10.0]], 100, 100, 2), ("b", [], 9, 9, 1)], f"k string, boxes {box}, width int, height int, ordinal int")
    pred = spark.createDataFrame([("a", [[0.0, 0.0, 10.0, 10.0], [50.0, 50.0, 9.0, 9.0]], [0.5, 0.9, 0.1]), ("b", [[1.0, 1.0, 1.0, 1.0]], None), ("c", [[1.0, 1.0, 1.0, 1.0]], [0.3])], f"k string, bbox_in_line {box}, confidence array<double>")
    out = L.add_metrics(pred, gt, "k", prefix="x")
    a = {r["k"]: r for r in out.collect()}
    # Three scores for two boxes: all count as 1, so the second, a miss, is visited first.
    assert (a["a"]["x_TP@0.5"], a["a"]["x_FP@0.5"], a["a"]["x_FN@0.5"]) == (1, 1, 0) and a["a"]["x_mAP@0.5"] == pytest.approx(0.5)
    assert a["b"]["x_TP@0.5"] is None and a["c"]["x_mAP@0.75"] is None
    s = L.summarize(out, "x").collect()[0]
    assert s["pages"] == 1 and s["x_Precision@0.5"] == 0.5
    lined = L.build_line_columns(spark.createDataFrame([(["A", "B"], [[0.0, 0.0, 10.0, 10.0], [20.0, 2.0, 30.0, 12.0]])], f"t array<string>, b {box}"), "t", "b", "xyxy").collect()[0]
    assert lined["text_in_line"] == ["A B"] and lined["bbox_in_line"] == [[0, 0, 30, 12]]


def test_order_decode():
    assert K.order_of([[0.9, 0.5, 0.1], [0.8, 0.7, 0.2], [0.1, 0.2, 0.9]]) == [0, 1, 2]
    rng = np.random.default_rng(0)
    for n in range(1, 9):
        assert sorted(K.order_of(rng.standard_normal((n, n + 2)).tolist())) == list(range(n))
    assert K.order_of([]) == []


def test_pooling_and_inputs(spark):
    rows = [("d", 0, [1.0, 3.0]), ("d", 0, [3.0, 0.0]), ("d", 1, [1.0, 1.0]), ("d", None, [9.0, 9.0])]
    got = K.mean_pool_argmax(spark.createDataFrame(rows, "doc string, w int, logits array<double>"), ["doc"], "w", "logits")
    assert {(r["w"], r["label_id"]) for r in got.collect()} == {(0, 0), (1, 0)}
    words = spark.createDataFrame([("d", 0), ("d", 7)], "doc string, w int")
    assert {(r["w"], r["label"]) for r in K.labels_by_word(got, words, ["doc"], "w", {0: "O", 1: "B"}).collect()} == {(0, "O"), (7, "O")}
    r = spark.createDataFrame([([[1, 2, 3, 4]], [2, 1, 700])], "b array<array<int>>, t array<int>").select(K.model_inputs(F.col("b")).alias("m"), K.training_labels(F.col("t"), F.lit(7)).alias("l"), K.has_duplicates(F.col("t")).alias("d")).collect()[0]
    assert r["m"]["input_ids"] == [0, 3, 2] and r["m"]["bbox"] == [[0] * 4, [1, 2, 3, 4], [0] * 4] and not r["m"]["clipped"]
    assert r["l"] == [-100, 1, 0, -100, -100, -100, -100] and r["d"] is False


def test_report(spark):
    df = spark.createDataFrame(list(zip("AABO", "ABBO", strict=True)), "g string, p string")
    got = {r["label"]: r for r in K.classification_report(df, "g", "p").collect()}
    assert got["accuracy"]["f1"] == 0.75 and got["macro avg"]["f1"] == pytest.approx(0.7778, abs=1e-4) and got["weighted avg"]["f1"] == pytest.approx(0.75)
    assert got["A"]["precision"] == 1 and got["A"]["recall"] == 0.5 and got["A"]["support"] == 2
    assert K.classification_report(df.limit(0), "g", "p").count() == 0
    assert K.label_maps(["B", "A", "B"])[0] == {0: "O", 1: "A", 2: "B"}


def test_label_tables(spark):
    df = spark.createDataFrame([(2, ["B", "A", None]), (1, ["C"]), (3, []), (4, None)], "k int, l array<string>")
    rows = lambda t: [tuple(r) for r in t.orderBy("id").collect()]
    assert rows(K.label_table(df, "l")) == [(0, "O"), (1, "A"), (2, "B"), (3, "C")]
    assert rows(K.label_table(df, "l", "k")) == [(0, "O"), (1, "C")]
    assert rows(K.label_table(df.filter("k > 2"), "l")) == [(0, "O")]
    with_o = spark.createDataFrame([(1, ["P", "O", "A"])], "k int, l array<string>")
    assert rows(K.label_table(with_o, "l")) == [(0, "A"), (1, "O"), (2, "P")]
    got = K.label_ids(df, "l", K.label_table(df, "l", "k"), "ids").orderBy("k").collect()
    assert [r["ids"] for r in got] == [[1], [None, None, None], [], None]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 50, 199])
def test_bounds_below(spark, n):
    bounds = [3 * i for i in range(n)]
    got = spark.range(-2, 3 * n + 3).select("id", R.bounds_below(bounds, F.col("id")).alias("c")).collect()
    assert all(r["c"] == sum(b < r["id"] for b in bounds) for r in got)


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in R.keep_first(df, ["k"], "o").collect()} == {("a", "x"), ("b", "z")}
    looked = R.lookup(spark.createDataFrame([("a",), ("c",)], "k string"), df, ["k"], "o").collect()
    assert {(r["k"], r["v"]) for r in looked} == {("a", "y"), ("c", None)}
    pos = R.positional_join(df.select("o", "v"), df.select(F.col("o").alias("p"), F.col("v").alias("w")), "o", "p")
    assert all(r["v"] == r["w"] for r in pos.collect()) and pos.count() == 3
    first = R.first_match([df.filter("k = 'b'"), df.withColumn("v", F.upper("v"))], ["k"], "o").collect()
    assert {(r["k"], r["v"]) for r in first} == {("b", "z"), ("a", "X")}
    pairs, skipped = R.pair_and_skip(df, spark.createDataFrame([("a",)], "k string"), ["k"])
    assert pairs.count() == 2 and [r["k"] for r in skipped.collect()] == ["b"]
    alias = spark.createDataFrame([("a", "anna")], "alias string, name string")
    assert {r["k"] for r in R.remap(df, alias, "k").collect()} == {"anna", "b"}


def test_documents(spark):
    pages = spark.createDataFrame([(f"D_page_{n}", [f"w{n}"], n) for n in (2, 10, 1)] + [("odd", ["w"], 0)], "page_id string, words array<string>, width int")
    named = R.with_doc_and_page(pages)
    one = R.unify_documents(named, ["words"], ["width"]).collect()
    assert [(r["doc_id"], r["words"], r["width"]) for r in one] == [("D", ["w1", "w2", "w10"], [1, 2, 10])]
    assert R.with_doc_and_page(pages, unmatched="keep").filter("doc_id = 'odd'").count() == 1
    lexical = R.pages_of(named, ["page_id"], lexical="page_id").collect()[0]["pages"]
    assert [p["page_id"] for p in lexical] == ["D_page_1", "D_page_10", "D_page_2"]
    batches = R.length_batches(pages.withColumn("n", F.length("page_id")), "n", 2)
    assert batches.count() == 4


def test_band_of_the_matrix():
    """A band gives the distance where it is within reach, and more than its reach elsewhere."""
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(3, 30))]
        b = [x for x in a if rng.random() < 0.9] + [rng.choice("abc") for _ in range(rng.randint(0, 4))]
        a, b = sorted((a, b), key=len)
        known = D.levenshtein(a, b)
        for reach in range(max(1, len(b) - len(a)), len(a)):
            found = D._in_band(a, b, reach)
            assert found == known if known <= reach else found > reach
    long = "".join(rng.choice("abcdefgh ij") for _ in range(3000))
    assert D.levenshtein(long, long.replace("ab", "x")) == 2 * long.count("ab")


def test_long_lists_go_to_python_as_characters(spark, monkeypatch):
    """A character for each word, or the words where two of them have the same character."""
    rng = random.Random(7)
    long = [f"w{rng.randrange(200)}" for _ in range(600)]
    rows = [(long, [w for i, w in enumerate(long) if i % 40]), (long, long[300:] + long[:290]), (["a", "b"], ["b"]), (long, None), (None, long), ([None, "a"] * 50, ["a", None] * 50), ([], long), (long, list(long))]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    want = [None if x is None or y is None else D.levenshtein(x, y) for x, y in rows]
    known = [False, False, True, False, False, False, False, True]
    for signs in (D._SIGNS, 0, 3):
        monkeypatch.setattr(D, "_SIGNS", signs)
        told = [r["t"] for r in df.select(D._told(a, b).alias("t")).collect()]
        assert [r["d"] for r in df.select(D.word_levenshtein(a, b).alias("d")).collect()] == want
        if signs == 0xFFFFF:
            assert [t["known"] is not None for t in told] == known
            assert all(t["x"] is t["y"] is None for t in told if t["known"] is not None) and [len(told[i]["x"]) for i in (0, 1, 6)] == [600, 600, 0]
            assert all(t["a"] is t["b"] is None for t in told if t["x"] is not None or t["known"] is not None)


def test_lists_of_words(spark):
    """Short lists in the JVM, others in Python, and both rates of one normalised text."""
    rng = random.Random(6)
    rows = [([rng.choice("uvwxyz") for _ in range(n)], [rng.choice("uvwxyz") for _ in range(m)]) for n, m in ((0, 0), (0, 3), (5, 7), (64, 60), (64, 65), (90, 20))]
    rows.append((["a", None], ["a", "b"]))
    out = spark.createDataFrame([*rows, (None, ["a"])], "a array<string>, b array<string>").select("a", "b", D.word_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in out] == [D.levenshtein(a, b) for a, b in rows] + [None]
    plan = spark.range(1).select(F.lit("Ab-c, d").alias("g"), F.lit("ab c").alias("h"))
    g, h = F.col("g"), F.col("h")
    both = D.rates(plan, g, h).select("wer", "cer", D.wer(g, h).alias("w"), D.cer(g, h).alias("c")).collect()[0]
    assert (both["wer"], both["cer"]) == (both["w"], both["c"])
    # The normal form is asked for once a text.
    assert D.rates(spark.range(9).select(F.col("id").cast("string").alias("g")), g, F.concat(g, g))._jdf.queryExecution().optimizedPlan().toString().count("_nfkc(") == 2


def test_metrics_of_many_pages_together():
    """The very numbers of each page by itself, with ties, missed boxes and boxes found twice."""
    rng = np.random.default_rng(7)
    pages = []
    for _ in range(300):
        n = rng.integers(1, 9)
        gt = np.c_[rng.integers(0, 30, (n, 2)), rng.integers(1, 30, (n, 2))].astype(float)
        pred = np.concatenate([gt[rng.random(n) < 0.8] + rng.integers(0, 3, (1, 4)), gt[:1]])
        pages.append((gt, pred[rng.permutation(len(pred))], rng.integers(0, 3, len(pred)).astype(float)))
    together = L.many_page_metrics(*map(list, zip(*pages, strict=True)), (0.5, 0.75))
    assert together.tolist() == [L.page_metrics(*p, 0.5, 0.75) for p in pages]


def test_length_batches_are_the_same_whenever_read(spark):
    """Numbers are the rows' own, not the partitions' that they happen to be in; many equal lengths."""
    rows = spark.range(3000, numPartitions=7).select("id", F.when(F.col("id") % 50 > 0, F.col("id") % 3 + F.when(F.col("id") % 11 == 0, F.col("id")).otherwise(0)).alias("n"))
    read = lambda df: {r["id"]: (r["part"], r["batch"]) for r in R.length_batches(df, "n", 8).collect()}
    first = read(rows)
    assert len(first) == 3000 and read(rows.repartition(23)) == first
    spans = R.length_batches(rows, "n", 8).groupBy("part", "batch").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    assert max(r["c"] for r in spans) == 8 and len({r["part"] for r in spans}) == 4
    high = {(r["part"], r["batch"]): r["high"] for r in spans}
    for r in spans:
        after = high.get((r["part"], r["batch"] + 1))
        assert after is None or r["low"] is None or r["low"] >= after


def test_sections(spark):
    pairs = spark.createDataFrame([("f", "skills", "", "x"), ("f", "education", "a b", "a c"), ("g", "skills", "none", None)], "f string, section string, gt string, pred string")
    run = lambda p: {r["section"]: (r["similarity"], r["wer"]) for r in S.compare(pairs, p, lambda a, b: F.lit(0.25)).collect()}
    assert run("skip") == {"education": (0.25, 0.5)} and run("soft")["skills"] == (1, 0) and run("penalize")["skills"] == (0, 1)
    with pytest.raises(ValueError):
        run("x")
    report = {r["section"]: r for r in S.section_report(S.compare(pairs, "soft", lambda a, b: F.lit(0.25)), ["f"]).collect()}
    assert report["education"]["brevity_penalty"] == 1 and report["education"]["gt_tokens"] == 2 and report["skills"]["avg_wer"] == 0
    cos = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(S.cosine(F.col("a"), F.col("b"))).collect()[0][0]
    assert cos([1.0, 0.0], [1.0, 1.0]) == pytest.approx(2**-0.5) and cos([0.0], [1.0]) == 0


def test_section_texts(spark):
    items = spark.createDataFrame([("d", 2, "SKILLS", 1, "SQL"), ("d", 1, "SKILLS", 2, "Python!"), ("d", 1, "SKILLS", 1, "C"), ("d", 1, "EMP-INFO", 1, "Acme")], "doc string, page int, section string, n int, t string")
    got = {r["section"]: r["gt"] for r in S.gt_texts(items, ["doc"], "page", "section", "n", "t").collect()}
    assert got == {"skills": "c python sql", "work_experience_info": "acme"}
    pred = '{"personal_info": {"full_name": "A B", "x": null}, "skills": ["S1", 2], "education": [{"degree": "D"}], "work_experience": [{"company": "C", "employment_description": "did"}, {"role": "R"}]}'
    got = {r["section"]: r["pred"] for r in S.pred_texts(spark.createDataFrame([("d", pred), ("e", '{"work_experience": {"company": "Z"}}'), ("f", "broken")], "doc string, value string"), ["doc"]).filter("doc = 'd'").collect()}
    assert got == {"personal_info": "a b", "skills": "s1 2", "education": "d", "work_experience_info": "c r", "work_experience_description": "did"}


def test_plain_answers_are_flattened_in_the_jvm(spark):
    """As in Python, whatever the texts hold; other values aren't decided there."""
    plain = ['{"a": "x, y: {z}", "b": {"c": ["d", "", null]}, "e": []}', '["a\\"b", "c\\\\", "\\n: d", "\\u0001e", ":"]', '{"q\\"": "é", "r": ": s"}', "[]", "{}", '["null", null, "nulls"]', '[{"a": "1"}, {"a": "2"}]', '["\\\\\\"", ":", {"k": ":v"}]']
    other = ['["a", 2]', "[true]", "[1.50]", '{"a": "b"', '{"a": "b"} "c":', "text", "", "12", '["\\u00e9"]', '{"a": "x", "a": "y"}', '["a"] "b"', None]
    df = spark.createDataFrame([(t,) for t in plain + other], "t string")
    norm = lambda c: T.normalize_section(c)
    got = df.select("t", norm(U.flatten_json("t")).alias("want"), S.leaves(F.col("t")).isNotNull().alias("known"), norm(S.leaves(F.col("t"))).alias("got")).collect()
    assert [r["known"] for r in got] == [True] * len(plain) + [False] * len(other)
    assert all(r["got"] == r["want"] for r in got if r["known"])
    # Whole sections, with objects that have a key twice, whether or not the session counts them as JSON.
    values = [f'{{"skills": {t}, "personal_info": {{"n": 1, "m": "é"}}}}' for t in plain if t] + ['{"skills": {"a": "x", "a": "y"}}', '{"skills": "free, text"}', '{"skills": "{\\"a\\": 1.50}"}', "no"]
    preds = spark.createDataFrame(list(enumerate(values)), "k int, value string")
    skills = df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", F.get_json_object("v", "$.skills").alias("s")).filter("s is not null").select("k", norm(U.flatten_json("s")).alias("w")).collect()
    for twice in ("false", "true"):
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", twice)
        try:
            found = {r["k"]: r["pred"] for r in S.pred_texts(preds, ["k"]).filter("section = 'skills'").collect()}
        finally:
            spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
        assert found == {r["k"]: r["w"] for r in skills}


def plain_validation(v, node, path=()):
    """(faults, value) of parsed JSON, by plain recursion."""
    if isinstance(node, dict):
        if not isinstance(v, dict):
            return [(".".join(path), "model_type")], None
        inside = {k: plain_validation(v[k], n, (*path, k)) if k in v else ([], None) for k, n in node.items()}
        empty = {k: [] if isinstance(n, list) else plain_validation({}, n)[1] if isinstance(n, dict) else "" for k, n in node.items()}
        return [f for fs, _ in inside.values() for f in fs], {k: inside[k][1] if k in v else empty[k] for k in node}
    if isinstance(node, list):
        if not isinstance(v, list):
            return [(".".join(path), "list_type")], None
        items = [plain_validation(x, node[0], (*path, str(i))) for i, x in enumerate(v)]
        return [f for fs, _ in items for f in fs], [x for _, x in items]
    return ([], v) if isinstance(v, str) else ([(".".join(path), "string_type")], None)


def test_validation(spark):
    r = random.Random(23)

    def value(node, depth=0):
        if r.random() < 0.12:
            return r.choice(["t", 5, 1.5, True, None, [], {}, ["x"], {"email": "e"}, [{}], [None]])
        if isinstance(node, dict):
            return {k: value(n, depth + 1) for k, n in node.items() if r.random() < 0.6} | ({"unknown": value("text")} if r.random() < 0.2 else {})
        return [value(node[0], depth + 1) for _ in range(r.randint(0, 3))] if isinstance(node, list) else r.choice(["", "a 1", "é\n", "1: 2, 3", "x"])

    known = [value(S.RESUME) for _ in range(400)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0), "mine") for i, v in enumerate(known)]
    got = S.validated(spark.createDataFrame(rows, "i int, value string, error string"))
    assert got.columns == ["i", "value", "error", "faults", "data"]
    for row in got.collect():
        faults, data = plain_validation(known[row["i"]], S.RESUME)
        assert [tuple(f) for f in row["faults"]] == faults and (row["error"] is None) == (not faults)
        assert row["data"] == (None if faults else data) or row["data"].asDict(recursive=True) == data
    assert sum(bool(plain_validation(v, S.RESUME)[0]) for v in known) > 50


def test_one_json_value_and_nothing_else(spark):
    good = ['{"a": 1}', " [1, 2] ", "null", '"x]}"', "-0.5e3", "true", '{"a": "\\ud83d\\ude00"}', '"\\\\ud800"', "[[], {}]", '"\\\\\\ud83d\\ude00"']
    bad = ["", " ", "1, 2", '{"a": 1} more', '{"a": 1}]', '{"a": 1}}', "1] x", '1} x', '1, "b": 2', "1], [2", "]", "}", "[1,]", '{"a": 1,}', "{'a': 1}", "01", "nul", '"a\nb"', '"\\ud800"', '"\\ude00"', '"\\\\\\ud800 x"', '{"a" 1}', "[1", '"', "// x\n1", "[1]]", '{"x": 1}, {"y": 2}', '1 "x"']
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string").select("t", S.is_json(F.col("t")).alias("ok"))
    assert {r["t"]: r["ok"] for r in df.collect()} == dict.fromkeys(good, True) | dict.fromkeys(bad, False) | {None: False}
    assert "Python" not in S.validated(df.withColumnRenamed("t", "value"))._jdf.queryExecution().executedPlan().toString()


def test_validation_of_odd_texts(spark):
    rows = ["", None, "\u2003\n", '{"skills": ["a"]} trailing', "[]", '{"personal_info": {"full_name": 3}}', '{"skills": ["a 1"]}']
    got = S.validated(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r["error"] for r in got] == ["blank", "blank", "blank", "not JSON", "model_type", "personal_info.full_name: string_type", None]
    assert got[6]["data"]["skills"] == ["a 1"] and got[6]["data"]["personal_info"]["email"] == "" and got[6]["data"]["education"]["degrees"] == []


def test_public_measures(spark):
    gt = spark.createDataFrame([("p", ["the", "cat"], list("the cat"), 1), ("q", [], [], 1)], "page_id string, words array<string>, characters array<string>, ordinal int")
    pred = spark.createDataFrame([("e1", "p", ["the", "dog"], list("the dog")), ("e2", "p", ["the", "cat"], list("the cat")), ("e1", "q", [], []), ("e1", "zz", ["a"], ["a"])], "engine string, page_id string, words array<string>, characters array<string>")
    table = spark.createDataFrame([("e3", "t", ["a", "b"], list("<td>a</td><td>b</td>"))], pred.schema)
    both = E.wer_cer(table, spark.createDataFrame([("t", ["a", "b"], list("a b"), 1), ("t", ["x"], list("x"), 0)], gt.schema)).collect()[0]
    assert (both["wer"], both["cer"]) == (0, 0)  # the characters of the prediction play no part
    half = spark.createDataFrame([("p", ["a"], None), ("q", None, ["a"])], "page_id string, words array<string>, characters array<string>")
    assert {(r["wer"], r["cer"]) for r in E.wer_cer(pred, half).collect()} == {(None, None)}
    rows = E.wer_cer(pred, gt)
    got = {(r["engine"], r["page_id"]): (r["wer"], r["cer"]) for r in rows.collect()}
    assert got["e1", "p"] == (0.5, 0.5) and got["e2", "p"] == (0, 0) and got["e1", "q"] == (0, 0) and got["e1", "zz"] == (None, None)
    mean = {r["engine"]: r["wer"] for r in E.means(rows, ["engine"], ["wer", "cer"]).collect()}
    assert mean == {"e1": 0.25, "e2": 0}
    nd = E.ndld_rows(pred, gt.select("page_id", F.col("words").alias("gw")), "page_id", "words", "gw").collect()
    assert {(r["engine"], r["page_id"], r["ndld"]) for r in nd} == {("e1", "p", 0.5), ("e2", "p", 0.0), ("e1", "q", 0.0)}
    with pytest.raises(ValueError):
        E.ndld_rows(pred, gt, "page_id", "words", "words", level="line")
    pairs = E.refs_hyps(pred, gt.select("page_id", F.col("words").alias("gw")), "page_id", "words", "gw")
    assert pairs.count() == 2
    assert {r["engine"]: round(r["p1"]) for r in E.corpus_bleu(pairs, ["engine"], ["page_id"]).collect()} == {"e1": 50, "e2": 100}


def test_bleu_counts_long_texts_apart(monkeypatch):
    """Rows are numbered together up to a number of tokens; results are those of each row alone."""
    import pyarrow as pa

    calls, plain = [], B.clipped_counts
    monkeypatch.setattr(B, "clipped_counts", lambda r, h: calls.append(len(r)) or plain(r, h))
    texts = [[f"w{i * k % 97}" for i in range(n)] for k, n in ((1, 30_000), (2, 30_000), (3, 3), (5, 40_000), (7, 0))]
    ref, hyp = pa.array([*texts, None], pa.list_(pa.string())), pa.array([t[1:] for t in texts] + [["a"]], pa.list_(pa.string()))
    got = B._counts.func(ref, hyp).to_pylist()
    assert len(calls) >= 3 and sum(calls) == len(ref)
    assert got == [plain(ref.slice(i, 1), hyp.slice(i, 1))[0].tolist() for i in range(len(ref))]


def test_token_labels_inside_their_rows(spark):
    """As the means by word have it; words without tokens, special tokens, places that no word has,
    lists of other lengths, missing logits, an engine that fails. Only pages are shuffled."""
    chance = random.Random(7)
    answers = {}
    for page in range(60):
        n = chance.randrange(6)
        ids = [chance.choice([None, *range(-1, n + 2)]) for _ in range(chance.randrange(14))]
        logits = [[chance.choice([0.0, 1.0, 2.0]) for _ in range(chance.choice([1, 3]))] for _ in range(len(ids) + chance.choice([-1, 0, 1]) if ids else 0)]
        answers[page] = (n, json.dumps({"word_ids": ids, "logits": logits}), list(zip(ids, logits, strict=False)))
    answers[60] = (2, None, [])
    answers[61] = (2, json.dumps({}), [])

    def engine():
        def call(words, boxes):
            assert isinstance(words, list) and len(words) == len(boxes) > 0
            text = answers[int(words[0].split("w")[0])][1]
            if text is None:
                raise RuntimeError
            return text

        return call

    pages = spark.createDataFrame([(p, [f"{p}w{i}" for i in range(n)], [[1.0] * 4] * n) for p, (n, _, _) in answers.items()], "page_id long, words array<string>, boxes array<array<double>>")
    labels = {0: "O", 1: "A", 2: "B"}
    found = I.token_labels(pages, engine, labels)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for p, (n, text, tokens) in answers.items():
        for w in range(n if text else 0):
            own = [x for i, x in tokens if i == w]
            means = {k: np.mean([x[k] for x in own if len(x) > k]) for k in range(3) if any(len(x) > k for x in own)}
            want.add((p, w, f"{p}w{w}", labels[min(means, key=lambda k: (-means[k], k)) if means else 0]))
    assert set(map(tuple, found.collect())) == want and len(want) > 60


def test_hooks(spark):
    @I.register("echo")
    def make():
        def call(text):
            if text is None:
                raise ValueError("no text")
            return text.upper()

        return call

    rows = I.run(spark.createDataFrame([("a", "x"), ("b", None)], "id string, text string"), "id", ["text"], I.engine("echo"), threads=2).collect()
    assert {(r["id"], r["status"], r["data"]) for r in rows} == {("a", "ok", "X"), ("b", "error", None)}
    with pytest.raises(KeyError):
        I.engine("other")
    doc = I.document_payload(spark.createDataFrame([(f"D_page_{n}", bytes([n])) for n in (2, 1, 10)], "filename string, image binary")).collect()[0]
    assert doc["names"] == ["D_page_1", "D_page_2", "D_page_10"] and doc["num_predict"] == 10_000
    pairs = spark.createDataFrame([(["a", " ", "c"], [[1, 2, 3, 4], [1, 2, 3, 4], [1]])], "w array<string>, b array<array<int>>").select(I.paired_inputs(F.col("w"), F.col("b")).alias("p")).collect()[0]["p"]
    assert [p["word"] for p in pairs] == ["a"]
    images = spark.createDataFrame([("i",), ("j",)], "k string")
    boxes = [spark.createDataFrame([("i", [[1]])], "k string, boxes array<array<int>>")]
    assert I.reading_inputs(images, boxes, "k").count() == 1 and I.reading_inputs(images, boxes, "k", "error").filter("error is not null").count() == 1


@pytest.mark.parametrize("few", [0, 64])
def test_overlaps_against_all_pairs(spark, few):
    r = random.Random(8)
    rows, side = [], lambda: r.choice([0.0, -1.0, r.random() * 0.01, r.random(), r.random() * 8, 2.0, 64.0, 300.0])
    for p in range(4):
        rows += [(p, "x", k, [r.choice([r.uniform(-50, 50), float(r.randint(-3, 3))]), r.uniform(-20, 20), side(), side()]) for k in range((3, 40, 90, 150)[p])]
    rows += [(7, "x", k, [1.0, 1.0, 2.0, 2.0]) for k in range(70)] + [(8, "x", 0, [0.0, 0.0, 1.0, 1.0]), (8, "x", 1, [1.0, 0.0, 1.0, 1.0]), (9, "x", 0, None)]
    want = set()
    for p, _, k, a in rows:
        for p2, _, k2, b in rows:
            if p == p2 and k < k2 and all(max(a[i], b[i]) < min(a[i] + a[i + 2], b[i] + b[i + 2]) for i in (0, 1)) and min(a[2], a[3], b[2], b[3]) > 0:
                want.add((p, k, k2))
    found = L.overlaps(spark.createDataFrame(rows, "p int, name string, k int, box array<double>"), ["p"], "k", few=few)
    assert found.columns == ["p", "k", "box", "k2", "box2"]
    got = [(x["p"], x["k"], x["k2"]) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    boxes = {(p, k): b for p, _, k, b in rows}
    assert all(x["box"] == boxes[x["p"], x["k"]] and x["box2"] == boxes[x["p"], x["k2"]] for x in found.collect())


def test_overlaps_of_one_page_of_many_boxes(spark):
    """A page of 50,000 boxes side by side and one around them all: rows in proportion to boxes."""
    n = 50_000
    small = spark.range(n).select(F.lit(1).alias("p"), F.col("id").alias("k"), F.array((F.col("id") % 250) * 3.0, F.floor(F.col("id") / 250) * 3.0, F.lit(3.5), F.lit(2.0)).alias("box"))
    around = spark.createDataFrame([(1, n, [-1.0, -1.0, 1000.0, 1000.0])], "p int, k long, box array<double>")
    found = L.overlaps(small.unionByName(around), ["p"], "k")
    assert found.count() == n + 200 * 249
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
