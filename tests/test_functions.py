import random

import pytest
from pyspark.sql import functions as F

from folioscore.functions import geometry as G
from folioscore.functions import text as T
from folioscore.functions import unicode as U


def value(spark, col, **cols):
    row = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items())) if cols else spark.range(1)
    return row.select(col.alias("x")).collect()[0]["x"]


def text(spark, f, t):
    return value(spark, f(F.col("t")), t=(t, "string"))


@pytest.mark.parametrize(
    ("t", "want"),
    [("exam-\n ple", "example"), ("(cid:12)x", "x"), ("Ñandú", "ñandú"), (None, ""), ("a—b…c", "a b c"), ("$5+x", "5 x"), ("ﬁn ½", "fin 1⁄2"), ("  A\t\nB ", "a b")],
)
def test_normalize_text(spark, t, want):
    assert text(spark, T.normalize_text, t) == want


def test_normalize_options(spark):
    c = F.col("t")
    assert value(spark, T.normalize_text(c, remove_diacritics=True), t=("Ñandú", "string")) == "nandu"
    assert value(spark, T.normalize_text(c, lowercase=False, remove_punct=False), t=("A-b.", "string")) == "A-b."
    assert value(spark, T.normalize_text(c, is_list=True), t=(["a", "", "B"], "array<string>")) == "a b"
    assert value(spark, T.normalize_text(c, exact=False), t=("It's A", "string")) == "it s a"
    # A mark that stands alone after the items are joined can't join its letter again.
    assert value(spark, T.normalize_text(c, is_list=True), t=(["e", "́"], "array<string>")) == "e ́"


@pytest.mark.parametrize(("t", "want"), [("Résumé: ﬁx", "resume x"), ("n/a", "n a"), (None, "")])
def test_normalize_section(spark, t, want):
    assert text(spark, T.normalize_section, t) == want


def test_placeholders(spark):
    empty = lambda t: text(spark, lambda c: T.is_empty_section(T.normalize_section(c)), t)
    assert not empty("n/a") and not empty("N/A") and empty("none") and empty(" NULL ") and empty("--") and empty(None)


@pytest.mark.parametrize(("t", "want"), [(None, ""), ("['a', 'b c']", "a b c"), ('["a" b]', "a b"), ("x\\/y", "x/y"), ('"q"', "q"), ("[1, 2]", "1 2")])
def test_clean_transcription(spark, t, want):
    assert text(spark, T.clean_transcription, t) == want


def test_words_and_characters(spark):
    assert text(spark, T.split_words, " a  b ") == ["a", "b"] and text(spark, T.split_words, None) == []
    assert text(spark, T.characters, 'a[b], "c"(cid:3)\n​½') == list("ab c1⁄2")
    assert text(spark, T.edge_trimmed_words, "## (Ab), -c- !? x.y") == ["Ab", "c", "x.y"]
    assert text(spark, T.strip_heading, " ## A #") == "A #"
    assert text(spark, T.clean_b_tags, "<b>a</b><B>") == "a<B>"
    assert text(spark, T.html_table_texts, "<table><tr><td>ab</td><td>x</td><td>7</td></tr></table>") == ["ab", "7"]
    assert text(spark, T.clean_text, "a\nb\tc\rd") == "a b c d"


@pytest.mark.parametrize(("t", "want"), [("a ( b ) - c .", ["a", "(b)-c."]), (None, []), ("", [""]), ("x  y", ["x", "y"])])
def test_smart_tokenize(spark, t, want):
    assert text(spark, T.smart_tokenize, t) == want


def test_sequences(spark):
    a = F.col("a")
    words = lambda v: value(spark, T.word_sequence(a, True), a=(v, "array<string>"))
    assert words(["a-b"]) == ["a b"] and text(spark, lambda c: T.word_sequence(c, False), "a-b") == ["a", "b"]
    assert words(["", "É.", "!", "x"]) == ["é", "x"]
    chars = lambda v, m="repr": "".join(value(spark, T.char_sequence(a, True, m), a=(v, "array<string>")))
    assert chars(["a b", "c"]) == "['a b', 'c']" and chars([]) == "[]" and chars(["it's", "b\\"]) == str(["it's", "b\\"])
    assert chars(["a b", "c"], "joined") == "a bc"
    with pytest.raises(ValueError):
        T.char_sequence(a, True, "other")
    plain = lambda v: value(spark, T.to_plain_string(a), a=(v, "array<string>"))
    assert (plain(["a", "b"]), plain(["ab", "c"]), plain([]), plain(None)) == ("ab", "ab c", "", "")
    assert value(spark, T.flatten_words(a), a=(["a  b", None, " "], "array<string>")) == ["a", "b"]


def test_words_from_chars(spark):
    kind = "array<struct<text:string,x1:double,y1:double,x2:double,y2:double>>"
    chars = [("a", 0, 0, 1, 1), ("b", 1, 0, 2, 3), (" ", 2, 0, 3, 1), ("c", None, None, None, None), ("", 0, 0, 0, 0), ("d", 5, 5, 6, 6)]
    chars = [tuple(float(v) if isinstance(v, int) else v for v in c) for c in chars]
    box = F.array(*[F.lit(float(i)) for i in (9, 9, 10, 10)])
    got = value(spark, T.words_from_chars(F.col("c"), box), c=(chars, kind))
    assert [(w["text"], w["box"]) for w in got] == [("ab", [0, 0, 2, 3]), ("c", [9, 9, 10, 10]), ("d", [5, 5, 6, 6])]
    none = value(spark, T.words_from_chars(F.col("c"), F.lit(None)), c=(chars[3:4], kind))
    assert none[0]["box"] == [0, 0, 0, 0]


def test_markdown(spark):
    pages = [(1, "# B\n\nc"), (0, " a \r\n##")]
    assert value(spark, T.markdown_lines(F.col("p")), p=(pages, "array<struct<index:int,markdown:string>>")) == ["a", "B", "c"]


def test_names(spark):
    assert text(spark, T.gt_filename, "x?d=a/b/Jane-CV_page_001.png") == "Jane-CV_page_001"
    assert text(spark, T.gt_filename, "up/abcd-My-CV_page_001.png") == "CV_page_001"
    assert text(spark, T.gt_filename, None) == "" and text(spark, T.stem, "a/b.c.json") == "b.c"
    assert text(spark, T.cv_id, "A_page_12") == "A" and text(spark, T.page_number, "A_page_12") == 12
    assert text(spark, T.cv_id, "A") is None and text(spark, T.page_number, "A") == 0
    assert text(spark, T.safe_stem, "a.b.JPEG") == "a.b"
    assert value(spark, T.data_url(F.lit("a.jpg"), F.lit(b"x"))) == "data:image/jpeg;base64,eA=="


def test_json_from_text(spark):
    assert text(spark, T.json_from_text, 'Sure: {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert text(spark, T.json_from_text, "list [1, 2] end") == "[1, 2]"
    assert '"error"' in text(spark, T.json_from_text, "{broken") and '"error"' in text(spark, T.json_from_text, None)


BOX = "array<double>"


def box(spark, f, b, w=1000, h=500):
    return value(spark, f(F.col("b"), F.lit(w), F.lit(h)), b=([float(x) for x in b], BOX))


def test_boxes(spark):
    assert box(spark, G.percent_to_px, [10, 20, 30, 40]) == [100, 100, 300, 200]
    assert box(spark, G.guess_unit_to_px, [0.1, 0.2, 0.3, 0.4]) == pytest.approx([100, 100, 300, 200])
    assert box(spark, G.guess_unit_to_px, [10, 20, 30, 40]) == [100, 100, 300, 200]
    assert box(spark, G.guess_unit_to_px, [101, 20, 30, 40]) == [101, 20, 30, 40]
    assert box(spark, G.norm_1000, [1, 3, 5000, -4], 2000, 2000) == [0, 2, 1000, 0]
    assert box(spark, G.clip_box, [2.5, 3.5, 2, 9999]) == [2, 4, 3, 500] and box(spark, G.clip_box, [1000, 0, 1000, 1]) == [1000, 0, 1000, 1]
    assert value(spark, G.norm_boxes_1000(F.col("b"), F.lit(2000), F.lit(0)), b=([[0.0, 0.0, 0.0, 0.0]], "array<array<double>>")) == [[0, 0, 1, 1]]
    iou = lambda a, b: value(spark, G.iou(F.col("a"), F.col("b")), a=(a, BOX), b=(b, BOX))
    assert iou([0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 10.0, 10.0]) == pytest.approx(1 / 3) and iou([0.0] * 4, [0.0] * 4) == 0
    pts = lambda p: value(spark, G.hull(F.col("p")), p=(p, "array<array<double>>"))
    assert pts([[1.0, 5.0], [3.0, 4.0], [2.0, 9.0], [0.0, 6.0]]) == [0, 4, 3, 9] and pts([[1.0, 1.0]]) == [0] * 4
    assert value(spark, G.is_valid_box(F.col("b")), b=([1.0, None, 2.0, 3.0], BOX)) is False


def test_orders(spark):
    order = lambda n, v: value(spark, G.by_reading_order(F.col("n"), F.col("v")), n=(n, "array<int>"), v=(v, "array<string>"))
    assert order([2, 1, 3], ["x", "y", "z"]) == ["y", "x", "z"] and order([2, 1, 3], ["x", "y"]) == ["y", "x"]
    assert order([1, 1, 0], ["b", "a", "c"]) == ["c", "b", "a"]
    assert value(spark, G.renumbered(F.col("v")), v=([], "array<string>")) == []
    labels = "struct<labels:array<string>>"
    first = lambda v: value(spark, G.first_label(F.col("v")), v=(v, labels))
    assert first((["a", "b"],)) == "a" and first(([],)) == T.NO_LABEL and first((None,)) == T.MISSING_LABEL
    assert value(spark, T.reordered_words(F.col("t"), F.col("o")), t=(["a b", None, "c"], "array<string>"), o=([2, 9, 1, 0], "array<int>")) == ["c", "a", "b"]


def test_normal_forms_of_every_character(spark):
    """Each code point alone, between letters, and behind each of some others, as unicodedata has it."""
    import unicodedata

    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rnd = random.Random(4)
    texts = [*points, *(f"a{c}e" for c in points), *(rnd.choice(points) + c for c in points), *("".join(rnd.choices(points, k=12)) for _ in range(20_000))]
    texts += [b + m for b in "aeEnoucçéᄀ가한かは" for m in "\u0300\u0301\u0302\u0303\u0308\u0327\u0323\u0345\u1161\u11a8\u3099"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", U.nfkc(F.col("t")).alias("n"), U.strip_marks(F.col("t")).alias("m"))
    for r in df.toLocalIterator():
        assert r["n"] == unicodedata.normalize("NFKC", r["t"]), r["t"].encode("unicode_escape")
        assert r["m"] == "".join(c for c in unicodedata.normalize("NFD", r["t"]) if unicodedata.category(c) != "Mn"), r["t"].encode("unicode_escape")


def test_sections_of_every_character_need_no_worker(spark):
    """Marks come off in the JVM, as unicodedata has it, where only letters and digits are kept."""
    import re
    import unicodedata

    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rnd = random.Random(5)
    texts = [*(f"a{c}e" for c in points), *(f"a{c}{rnd.choice(points)}" for c in points), *("".join(rnd.choices(points, k=12)) for _ in range(20_000))]
    texts += [f"a{''.join(rnd.choices('\u0301\u0323\u0345\U0001d165\u302e\u09be', k=4))}e" for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("l"), T.normalize_section(F.col("t")).alias("n"))
    assert "EvalPython" not in df._jdf.queryExecution().toString()
    for r in df.toLocalIterator():
        bare = "".join(c for c in unicodedata.normalize("NFD", r["l"]) if unicodedata.category(c) != "Mn")
        # White space is Java's, which counts U+001C to U+001F as signs.
        assert r["n"] == " ".join(re.sub(r"[^a-z0-9]+", " ", bare).split()), r["l"].encode("unicode_escape")


def test_common_letters_need_no_worker(spark):
    """Texts of the Latin script's letters, and of others' that have no marks, are decided in the JVM."""
    rows = ["Été, naïve, Größe, señor, Œuvre", "Привет, Ελλάδα", "漢字", "plain", ""]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    own = df.select(F.col("t").rlike(rf"[^{U._inert()}]").alias("odd"), F.col("t").rlike(rf"[{U._unmarked()[2]}]").alias("several")).collect()
    assert not any(r["odd"] or r["several"] for r in own)


def test_literals_that_are_json_as_well():
    """Read as Python reads them, by the fast way where both agree, by Python's where they don't."""
    import ast

    both = ["[1, 2.5, -3e4]", "{'a': [1, 'b c']}", '["it\'s", "x"]', "[{'X': 1, 'y': 2}]", '{"a": 1, "a": 2}', "'é😀'", "0", "[]"]
    for t in both:
        assert U._as_json(t) == U._parsed(t) == ast.literal_eval(t)
    only = ["(1, 2)", "['a' 'b']", "['" + "''a'" + "'']", "[b'a']", r"['it\'s']", r'["a\/b"]', r"['\x41']", "[True, None]", "[1_000]", "['null', 'true']"]
    for t in only:
        assert U._as_json(t) is None and U._parsed(t) == ast.literal_eval(t)
    assert U._parsed("[true, null]") is None and U._parsed("NaN") is None and U._parsed("[1") is None and U._parsed("") is None


def test_word_texts_are_those_of_the_fold(spark):
    rng = random.Random(3)
    rows = [([rng.choice(["a", "b c", "é", " ", "", "\t", "\u00a0", None, "\ue000"][: 9 - n % 2]) for _ in range(rng.randrange(9))],) for n in range(60)] + [(None,)]
    chars = F.transform("t", lambda t: F.struct(t.alias("text"), *[F.lit(None).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2")]))
    folded = F.transform(T.words_from_chars(chars, F.lit(None).cast("array<double>")), lambda w: w["text"])
    out = spark.createDataFrame(rows, "t array<string>").select(T.word_texts(F.col("t")).alias("a"), folded.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in out) and any(r["a"] for r in out)
