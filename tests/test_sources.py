import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from folioscore.operators import evaluate as E
from folioscore.sources import files, ground_truth, sinks, vendors
from folioscore.streaming import pages as stream_pages


def put(folder, **texts):
    for name, value in texts.items():
        (folder / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder)


def pages(df):
    return {r["page_id"]: r.asDict(recursive=True) for r in df.collect()}


def box4(x):
    return [[x, 0], [x + 2, 0], [x + 2, 3], [x, 3]]


def test_surya(spark, tmp_path):
    ch = lambda t, x, ok=True: {"text": t, "bbox": [x, 0, x + 1, 2], "bbox_valid": ok}
    line = {"text": "<b>ab</b> c", "bbox": [0, 0, 9, 2], "confidence": 0.5, "chars": [ch("a", 0), ch("b", 1, False), ch(" ", 2), ch("c", 3)]}
    given = {"text": "x y", "bbox": [0, 4, 9, 6], "confidence": 0.9, "words": [{"text": "<b>x</b>", "bbox": [0, 0, 1, 1]}, {"text": "y", "bbox": [0]}]}
    put(tmp_path, one={"k": [{"text_lines": [line, given, {"text": "", "bbox": [0, 0, 1, 1]}, {"text": "q", "bbox": [1]}]}]}, two=[{"text_lines": [given]}], none={}, broken="{oops")
    df, rejected = vendors.read(spark, "surya", str(tmp_path))
    got = pages(df)
    assert [x["text"] for x in got["one"]["lines"]] == ["ab c", "x y"] and got["one"]["lines"][0]["conf"] == 0.5
    assert got["one"]["words"] == ["ab", "c", "x"] and got["one"]["characters"] == ["a", " ", "c"]
    assert got["two"]["words"] == ["x"] and got["none"]["lines"] == []
    assert [r["page_id"] for r in rejected.collect()] == ["broken"]


def test_easyocr_and_tesseract(spark, tmp_path):
    put(tmp_path, a={"image": "a.png", "results": [{"text": " two words ", "confidence": 0.7, "bbox": box4(1)}, {"text": " ", "bbox": box4(0)}, {"text": "x", "bbox": [[0, 0]]}]}, b={"results": []})
    got = pages(vendors.read(spark, "easyocr", str(tmp_path))[0])
    assert got["a"]["lines"][0]["box"] == [1, 0, 3, 3] and got["a"]["words"] == ["two", "words"] and len(got["a"]["characters"]) == 9 and got["b"]["lines"] == []
    other = tmp_path / "t"
    other.mkdir()
    put(other, a={"results": [{"text": "hi", "confidence": 90, "bbox": {"left": 1, "top": 2, "width": 3, "height": 4}, "line_num": 5}, {"text": "yo"}]}, b={"results": []})
    got = pages(vendors.read(spark, "tesseract", str(other))[0])
    assert set(got) == {"a"} and got["a"]["lines"][0]["box"] == [1, 2, 4, 6] and got["a"]["line_nums"] == [5, 0] and got["a"]["words"] == ["hi", "yo"]


def test_dotsocr_and_textract(spark, tmp_path):
    put(tmp_path, a=[{"bbox": [0, 0, 1, 1], "category": "Title", "text": "# Big (one)"}, {"bbox": [0, 0, 1, 1], "category": "Table", "text": "<table><tr><td>ab,</td><td>x</td><td>7</td></tr></table>"}], b=[])
    got = pages(vendors.read(spark, "dotsocr", str(tmp_path))[0])
    assert got["a"]["words"] == ["Big", "one", "ab", "7"] and "<" in got["a"]["characters"] and got["a"]["lines"][1]["category"] == "Table" and got["b"]["words"] == []
    other = tmp_path / "t"
    other.mkdir()
    geo = {"BoundingBox": {"Left": 0.1, "Top": 0.2, "Width": 0.3, "Height": 0.4}}
    put(other, a={"Blocks": [{"BlockType": "PAGE"}, {"BlockType": "LINE", "Text": "a b", "Confidence": 99.0, "Geometry": geo}, {"BlockType": "WORD", "Text": "a", "Geometry": geo}, {"BlockType": "LINE", "Text": "n"}]})
    got = pages(vendors.read(spark, "textract", str(other))[0])
    assert got["a"]["words"] == ["a"] and got["a"]["lines"][0]["box"] == [0.1, 0.2, 0.3, 0.4] and got["a"]["lines"][1]["box"] is None and len(got["a"]["word_boxes"]) == 1


def test_parser(spark, tmp_path):
    put(tmp_path, a={"ResumeParserData": {"DetailResume": "x\ny", "Name": {"FullName": "N"}, "Email": [{"EmailAddress": "e@x"}, {"EmailAddress": "f@x"}], "PhoneNumber": [], "WebSite": [{"Type": "GitHub", "Url": "g1"}, {"Type": "github", "Url": "g2"}], "SegregatedQualification": [{"Institution": {"Name": "U"}, "Degree": {"DegreeName": "D", "Specialization": ["s", "t"]}, "StartDate": "1"}], "Certification": "C", "SkillBlock": "Python  SQL  80%  Python", "LanguageKnown": [{"Language": "SQL"}, {"Language": "Go"}], "SegregatedExperience": [{"Employer": {"EmployerName": "E"}, "Location": {"City": "", "State": "S"}}]}}, b={})
    texts = files.whole_texts(spark, str(tmp_path))
    assert {r["page_id"]: r["original_text"] for r in files.parser_texts(texts).collect()} == {"a": "x\ny", "b": ""}
    got = pages(vendors.restructured(texts))
    a = got["a"]["resume"]
    assert a["personal_info"] == {"full_name": "N", "email": "e@x", "phone": "", "location": "", "github": "g2", "linkedin": ""}
    assert a["skills"] == ["Python", "SQL", "Go"] and a["education"][0]["specialization"] == "s, t" and a["education"][1]["certification"] == "C"
    assert a["work_experience"][0]["location"] == "S" and got["b"]["resume"]["skills"] == [] and got["b"]["resume"]["work_experience"] == []


def test_annotations(spark, tmp_path):
    line = {"text": "t", "polygon": box4(0), "bbox": [0, 0, 2, 3], "confidence": 0.25}
    put(tmp_path, a={"doc1": [{"text_lines": [line, {"text": "no polygon"}]}]})
    sizes = spark.createDataFrame([("a", 20, 30)], "page_id string, width int, height int")
    got = vendors.annotations(files.whole_texts(spark, str(tmp_path)), sizes).collect()[0]
    doc = got["document"].asDict(recursive=True)
    results = doc["predictions"][0]["result"]
    assert [r["from_name"] for r in results] == ["bbox", "label", "transcription"] and results[0]["value"]["width"] == 100 and results[2]["score"] == 0.25 and results[0]["original_width"] == 20
    assert doc["predictions"][0]["score"] == 0.25 and got["doc_id"] == "doc1"
    name = spark.range(1).select(sinks.annotation_name(F.lit("d"), F.lit(0)), sinks.annotation_name(F.lit("d_page_007"), F.lit(0))).collect()[0]
    assert tuple(name) == ("d_page_001", "d_page_007")


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\x00\x00\x00"


def test_images(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(png(640, 480))
    (tmp_path / "p.jpg").write_bytes(b"junk")
    (tmp_path / "q.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 50, 70) + b"\x03" + b"\x00" * 20)
    (tmp_path / "r.png").write_bytes(b"?")
    found = files.images(spark, str(tmp_path))
    sizes = {r["page_id"]: (r["width"], r["height"]) for r in files.image_sizes(found).collect()}
    assert sizes == {"p": (640, 480), "q": (70, 50), "r": (0, 0)}
    frame = spark.createDataFrame([("p",), ("zz",), ("q",)], "page_id string")
    assert files.with_sizes(frame, files.image_sizes(found)).filter("page_id = 'zz' and width = 0").count() == 1
    placed = {r["page_id"]: (r["image"] or "")[-5:] for r in files.image_for_page(frame, found).collect()}
    assert placed == {"p": "p.png", "q": "q.jpg", "zz": ""}
    assert files.newest(found, 1).count() == 1
    pdfs = spark.createDataFrame([("/x/d.pdf", bytearray(b"ab")), ("/x/bad.pdf", bytearray(b""))], "path string, content binary")

    def rasterise(content):
        if not content:
            raise ValueError
        return [bytes([c]) for c in content]

    good, bad = files.pdf_pages(pdfs, rasterise)
    assert [r["page_id"] for r in good.orderBy("page_num").collect()] == ["d_page_001", "d_page_002"]
    assert [(r["path"], r["error"]) for r in bad.collect()] == [("/x/bad.pdf", "ValueError: ")]


def test_image_for_page(spark):
    """By page, then by document, then by part of a name, against plain Python."""
    names = ["A_page_001.jpg", "A_page_001.tiff", "A.gif", "B.jpeg", "b.png", "xx-cee-2.txt", "zz_CEE.PNG", "ab.png", "d", "E_page_002.PNG", "Ñandú photo.bmp", "long name of a file.tif"]
    listing = spark.createDataFrame([(f"/i/{n}",) for n in names], "path string")
    pages = ["A_page_001", "A_page_002", "B_page_003", "Cee_page_001", "d_page_001", "E_page_002", "ñandú_page_001", "none", "name of a_page_010", "Q_page_001"]

    def plain(page):
        base = page.rsplit("_page_", 1)[0]
        for n in (page, base):
            for e in files.EXTENSIONS:
                if n + e in names:
                    return f"/i/{n}{e}"
        return min((f"/i/{n}" for n in names if base.lower() in n.lower()), default=None)

    got = {r["page_id"]: r["image"] for r in files.image_for_page(spark.createDataFrame([(p,) for p in [*pages, None]], "page_id string"), listing).collect()}
    assert got == {p: plain(p) for p in pages} | {None: None}
    assert got["A_page_002"] == "/i/A.gif" and got["Cee_page_001"] == "/i/xx-cee-2.txt" and got["none"] is None


def test_image_for_page_looks_up_whole_names(spark):
    """Names of few kinds of grams: no row for two names that only have a gram in common."""
    pages = [f"D{n}_page_001" for n in range(1000, 1300)]
    listing = spark.createDataFrame([(f"/i/scan-d{n}x.PNG",) for n in range(1000, 1300)] + [("/i/png",)], "path string")
    found = files.image_for_page(spark.createDataFrame([(p,) for p in [*pages, "png"]], "page_id string"), listing)
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["page_id"]: r["image"] for r in found.collect()}
    first = lambda p: f"/i/scan-d{p[1:5]}x.PNG"
    assert got == {p: first(p) for p in pages} | {"png": "/i/png"}


def test_lines_payload_and_strict(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps({"source_boxes": [[1, 2, 3, 4]], "target_index": [1], "source_texts": ["a"], "target_texts": ["a"]}) + "\n")
    assert files.reading_order_lines(spark, str(tmp_path / "*.jsonl.gz")).collect()[0]["target_index"] == [1]
    job = files.payload(spark, {"records": [{"filename": "a_page_1", "image_b64": "eA=="}]}, "m").collect()[0]
    assert bytes(job["image"]) == b"x" and job["model"] == "m"
    with pytest.raises(ValueError):
        files.payload(spark, {"records": []})
    put(tmp_path, good={"a": 1}, bad='{"a": ')
    texts = files.whole_texts(spark, str(tmp_path))
    good, bad = files.good_and_rejected(texts, "a int")
    assert [r["page_id"] for r in good.collect()] == ["good"] and [r["page_id"] for r in bad.collect()] == ["bad"]
    with pytest.raises(Exception):  # noqa: B017
        files.strict_json(texts, "a int").collect()


def test_ground_truth(spark, tmp_path):
    row = ["up/x-P1.png", "['b\\\\/c', 'a \"q\"']", "[{'x': 1, 'y': 2, 'width': 3, 'height': 4}, {'X': 5, 'w': 6}, 7]", "[{'number': 2, 'x': 0, 'y': 0, 'width': 1, 'height': 1}, {'number': 1, 'x': 9, 'y': 9, 'width': 9, 'height': 9}]", "[{'labels': ['S']}, {}]"]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    text = "ocr,transcription,bbox,reading_order,section\n" + ",".join(map(quote, row)) + "\n" + ",".join(map(quote, [row[0], "['later']", *row[2:]])) + "\n"
    (tmp_path / "gt.csv").write_text(text)
    rows = ground_truth.read_csv(spark, str(tmp_path / "gt.csv"))
    page = ground_truth.pages(rows).collect()
    assert len(page) == 1 and page[0]["page_id"] == "P1" and page[0]["words"] == ["b/c", "a", '"q"']
    assert page[0]["boxes"] == [[1, 2, 3, 4], [5, 0, 6, 0]]
    ordered = ground_truth.in_reading_order(rows).orderBy("ordinal")
    first = ordered.collect()[0]
    assert first["ro_text"] == ['a "q"', "b/c"] and first["ro_boxes"][0] == [9, 9, 9, 9] and first["ro_section"] == ["malo2", "S"] and first["reading_order"] == [1, 2] and first["ro_label"] is None and first["cut"] is False
    assert ordered.collect()[1]["ro_text"] == ["later"] and ordered.collect()[1]["cut"] is True
    out = ground_truth.sections(ordered.limit(1), "ordinal").collect()[0]["section"]
    assert list(out) == ["malo2", "S"] and out["S"][0]["transcription"] == "b/c" and out["S"][0]["reading_order_number"] == 2
    preds = tmp_path / "m.csv"
    preds.write_text("filename,text,words\na,\"['x', 'y']\",plain\n")
    got = ground_truth.read_predictions(spark, str(preds)).collect()[0]
    assert got["text"] == ["x", "y"] and got["words"] is None
    assert ground_truth.read_predictions(spark, str(preds), raw=True).collect()[0]["text"] == "['x', 'y']"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b/c", 2, None), ("e", 3, "boom")], "k string, v int, err string")
    rows = sinks.json_rows(df, "k", F.struct("v"))
    out = {r["key"]: r["status"] for r in sinks.write_files(rows, str(tmp_path / "out")).collect()}
    assert out == {"a": "ok", "b/c": "error", "e": "ok"} and json.loads((tmp_path / "out/a.json").read_text()) == {"v": 1}
    env = sinks.envelope(df, "k", "v", "err")
    assert tuple(sinks.envelope_counts(env).collect()[0]) == (2, 1, 3)
    sinks.write_partitioned(df, str(tmp_path / "parts"), "k")
    assert spark.read.json(str(tmp_path / "parts")).count() == 3


def test_streaming_gives_the_batch_means(spark, tmp_path):
    schema = "engine string, page_id string, words array<string>, characters array<string>"
    gt = spark.createDataFrame([("p", ["a", "b"], ["a", "b"], 1)], "page_id string, words array<string>, characters array<string>, ordinal int")
    pred = spark.createDataFrame([("e", "p", ["a", "c"], ["a"]), ("f", "p", ["a", "b"], ["a", "b"]), ("e", "p", ["a", "b"], ["a", "b"])], schema)
    pred.repartition(3).write.parquet(str(tmp_path / "in"))
    scores = stream_pages.scored(stream_pages.page_stream(spark, str(tmp_path / "in"), schema, 1), gt)
    q = stream_pages.running_means(scores).writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    got = {r["engine"]: r["wer"] for r in spark.table("means").collect()}
    want = {r["engine"]: r["wer"] for r in E.means(E.wer_cer(pred, gt), ["engine"], ["wer"]).collect()}
    assert got == pytest.approx(want)


def test_windowed_means_close_behind_the_newest_row(spark, tmp_path):
    """Windows come out once the watermark has passed them; a row behind it isn't counted."""
    schema = "engine string, at timestamp, wer double, cer double"
    rows = [[("e", "2024-01-01 00:01:00", 0.2, 0.1), ("e", "2024-01-01 00:09:00", 0.4, 0.3), ("f", "2024-01-01 00:02:00", 1.0, 1.0)], [("e", "2024-01-01 02:00:00", 0.0, 0.0)], [("e", "2024-01-01 00:03:00", 9.0, 9.0)], [("e", "2024-01-01 04:00:00", 0.0, 0.0)]]
    (tmp_path / "in").mkdir()
    stream = stream_pages.windowed_means(stream_pages.page_stream(spark, str(tmp_path / "in"), schema), "at")
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").start()
    for batch in rows:
        df = spark.createDataFrame(batch, "engine string, at string, wer double, cer double").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = {(r["engine"], str(r["window"]["start"])): (r["wer"], r["cer"], r["pages"]) for r in spark.table("windows").collect()}
    want = {("e", "2024-01-01 00:00:00"): (0.3, 0.2, 2), ("f", "2024-01-01 00:00:00"): (1.0, 1.0, 1), ("e", "2024-01-01 02:00:00"): (0.0, 0.0, 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
