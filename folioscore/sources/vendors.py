"""OCR vendors' JSON as pages of one shape.

Each reader takes whole texts (page_id, value) and returns ``PAGE`` columns: page_id,
engine, lines (pos, text, box, conf, category), words, characters. Parsing, filters and
conversions are Spark expressions over the nested arrays; a row stays a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.binding import bound
from . import files

_LINE = "struct<pos:int,text:string,box:array<double>,conf:double,category:string>"
_SURYA_LINE = "struct<text:string,bbox:array<double>,polygon:array<array<double>>,confidence:double,chars:array<struct<text:string,bbox:array<double>,bbox_valid:boolean>>,words:array<struct<text:string,bbox:array<double>>>>"
SURYA_PAGES = f"array<struct<page:string,text_lines:array<{_SURYA_LINE}>>>"


def _line(pos: Column, text: Column, box: Column, conf: Column | None = None, category: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(pos.cast("int").alias("pos"), text.cast("string").alias("text"), box.cast("array<double>").alias("box"), (null if conf is None else conf).cast("double").alias("conf"), (null if category is None else category).cast("string").alias("category"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def _page(parsed: DataFrame, engine: str, lines: Column, words: Column, characters: Column, *more: Column) -> DataFrame:
    return parsed.select("page_id", F.lit(engine).alias("engine"), F.coalesce(lines, F.array().cast(f"array<{_LINE}>")).alias("lines"), words.alias("words"), characters.alias("characters"), *more)


def _or_empty(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def surya_pages(value: Column) -> Column:
    """The pages of the first entry of an object, or of a list."""
    first = F.get(F.map_values(F.from_json(value, f"map<string,{SURYA_PAGES}>")), F.lit(0))
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, SURYA_PAGES)).otherwise(first)


def surya(texts: DataFrame) -> DataFrame:
    """SRC-04: lines with text and four numbers; words as given, else from characters."""
    lines = F.flatten(F.transform(F.filter(surya_pages(F.col("value")), lambda p: p.isNotNull()), lambda p: F.coalesce(p["text_lines"], F.array().cast(f"array<{_SURYA_LINE}>"))))
    kept = F.filter(lines, lambda x: (F.coalesce(T.clean_b_tags(x["text"]), F.lit("")) != "") & G.is_valid_box(x["bbox"]))
    parsed = bound(texts, _l=kept)

    def words(x: Column) -> Column:
        given = F.filter(F.transform(F.filter(x["words"], lambda w: (F.coalesce(w["text"], F.lit("")) != "") & G.is_valid_box(w["bbox"])), lambda w: T.clean_b_tags(w["text"])), lambda w: w != "")
        return F.when(F.size(x["words"]) > 0, given).otherwise(_or_empty(T.word_texts(F.transform(x["chars"], lambda c: T.clean_b_tags(c["text"])))))

    def characters(x: Column) -> Column:
        valid = F.filter(x["chars"], lambda c: F.coalesce(c["bbox_valid"], F.lit(True)) & G.is_valid_box(c["bbox"]) & (F.coalesce(T.clean_b_tags(c["text"]), F.lit("")) != ""))
        return _or_empty(F.transform(valid, lambda c: T.clean_b_tags(c["text"])))

    return _page(parsed, "surya", F.transform("_l", lambda x, i: _line(i, T.clean_b_tags(x["text"]), x["bbox"], x["confidence"])), _or_empty(F.flatten(F.transform("_l", words))), _or_empty(F.flatten(F.transform("_l", characters))))


def easyocr(texts: DataFrame) -> DataFrame:
    """SRC-05: trimmed texts with four corner points."""
    schema = "struct<results:array<struct<text:string,confidence:double,bbox:array<array<double>>>>>"
    trimmed = F.transform(F.from_json("value", schema)["results"], lambda r: F.struct(F.regexp_replace(r["text"], r"(?U)^\s+|\s+$", "").alias("text"), r["confidence"].alias("conf"), r["bbox"].alias("bbox")))
    parsed = texts.withColumn("_r", F.filter(trimmed, lambda r: (F.coalesce(r["text"], F.lit("")) != "") & F.coalesce(F.size(r["bbox"]) == 4, F.lit(False))))
    return _page(parsed, "easyocr", F.transform("_r", lambda r, i: _line(i, r["text"], G.hull(r["bbox"]), r["conf"])), _or_empty(F.flatten(F.transform("_r", lambda r: T.split_words(r["text"])))), _or_empty(F.flatten(F.transform("_r", lambda r: _chars(r["text"])))))


def tesseract(texts: DataFrame) -> DataFrame:
    """SRC-06: words; pages without results are dropped. Adds block, line and word numbers."""
    schema = "struct<results:array<struct<text:string,confidence:double,bbox:struct<left:double,top:double,width:double,height:double>,block_num:int,line_num:int,word_num:int>>>"
    parsed = texts.withColumn("_r", F.from_json("value", schema)["results"]).filter(F.size("_r") > 0)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    box = lambda b: F.array(z(b["left"]), z(b["top"]), z(b["width"]) + z(b["left"]), z(b["height"]) + z(b["top"]))
    text = lambda r: F.coalesce(r["text"], F.lit(""))
    return _page(parsed, "tesseract", F.transform("_r", lambda r, i: _line(i, text(r), box(r["bbox"]), z(r["confidence"]))), F.transform("_r", text), _or_empty(F.flatten(F.transform("_r", lambda r: _chars(r["text"])))), *[F.transform("_r", _number(k)).alias(f"{k}s") for k in ("block_num", "line_num", "word_num")])


def _number(name: str) -> Callable[[Column], Column]:
    return lambda r: F.coalesce(r[name], F.lit(0))


def dotsocr(texts: DataFrame) -> DataFrame:
    """SRC-07: elements of boxes, texts and categories. Words of tables come from their text
    nodes; characters from the texts as they are, tags included."""
    parsed = texts.withColumn("_e", F.from_json("value", "array<struct<bbox:array<double>,text:string,category:string>>"))
    # Tables' text nodes need a parser, which takes a page's tables together, inside its row.
    is_table = lambda e: F.coalesce(F.regexp_replace(e["text"], r"(?U)^\s+", "").startswith("<table>"), F.lit(False))
    plain = F.transform("_e", lambda e: F.when(is_table(e), F.lit(None)).otherwise(T.edge_trimmed_words(e["text"])))
    in_tables = F.transform(T.html_table_texts_of_each(F.transform("_e", lambda e: F.when(is_table(e), e["text"]))), lambda t: T.edge_trimmed_words(F.array_join(t, " ")))
    parsed = parsed.withColumns({"_plain": plain, "_tables": F.when(F.exists("_e", is_table), in_tables)})
    words = F.when(F.col("_tables").isNull(), F.col("_plain")).otherwise(F.zip_with("_plain", "_tables", lambda p, t: F.coalesce(p, t)))
    return _page(parsed, "dotsocr", F.transform("_e", lambda e, i: _line(i, e["text"], e["bbox"], None, e["category"])), _or_empty(F.flatten(words)), _or_empty(F.flatten(F.transform("_e", lambda e: _chars(e["text"])))))


def textract(texts: DataFrame) -> DataFrame:
    """SRC-08: lines and words; boxes stay fractions (left, top, width, height). Adds word_boxes."""
    box = "struct<Left:double,Top:double,Width:double,Height:double>"
    schema = f"struct<Blocks:array<struct<BlockType:string,Text:string,Confidence:double,Geometry:struct<BoundingBox:{box}>>>>"
    parsed = texts.withColumn("_b", F.from_json("value", schema)["Blocks"])
    of = lambda kind: F.filter("_b", lambda b: b["Text"].isNotNull() & (b["BlockType"] == kind))
    one = F.lit(1.0)
    as_box = lambda b: F.when(b["Geometry"]["BoundingBox"].isNotNull(), G.fraction_to_px(b["Geometry"]["BoundingBox"], one, one))
    return _page(parsed, "textract", F.transform(of("LINE"), lambda b, i: _line(i, b["Text"], as_box(b), F.coalesce(b["Confidence"], F.lit(0.0)))), _or_empty(F.transform(of("WORD"), lambda b: b["Text"])), _or_empty(F.flatten(F.transform(of("LINE"), lambda b: _chars(b["Text"])))), F.transform(of("WORD"), as_box).alias("word_boxes"))


READERS = {"surya": surya, "easyocr": easyocr, "tesseract": tesseract, "dotsocr": dotsocr, "textract": textract}


def read(spark, engine: str, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """An engine's directory: pages, and rejected files."""
    texts = files.whole_texts(spark, path, glob)
    ok = F.try_parse_json("value").isNotNull()
    return READERS[engine](texts.filter(ok)), texts.filter(~F.coalesce(ok, F.lit(False)))


def annotations(texts: DataFrame, sizes: DataFrame, base_path: str | None = None, prefix: str = "bb") -> DataFrame:
    """G-11, G-12: page_id, doc_id, page_no and document (struct of data and predictions) of
    annotation-tool exports: three results a line, boxes in percent of the furthest polygon point."""
    value = F.col("value")
    single = F.from_json(value, f"struct<page:string,text_lines:array<{_SURYA_LINE}>>")
    is_page = value.rlike(r'^\s*\{') & F.get_json_object(value, "$.text_lines").isNotNull() & F.get_json_object(value, "$.page").isNotNull()
    doc = F.when(is_page, F.map_from_arrays(F.array(F.lit("doc")), F.array(F.array(single)))).when(F.ltrim(value).startswith("["), F.map_from_arrays(F.array(F.lit("doc")), F.array(F.from_json(value, SURYA_PAGES)))).otherwise(F.from_json(value, f"map<string,{SURYA_PAGES}>"))
    pages = texts.select("page_id", F.explode(doc).alias("doc_id", "pages")).select("page_id", "doc_id", F.posexplode("pages").alias("page_no", "p"))
    sized = pages.join(sizes, "page_id", "left").na.fill(0, ["width", "height"])
    all_lines = F.coalesce(F.col("p.text_lines"), F.array().cast(f"array<{_SURYA_LINE}>"))
    extent = G.polygon_extent(F.transform(F.filter(all_lines, lambda x: F.size(x["polygon"]) > 0), lambda x: x["polygon"]))
    numbered = F.transform(all_lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.filter(numbered, lambda n: (F.coalesce(n["x"]["text"], F.lit("")) != "") & F.coalesce(F.size(n["x"]["polygon"]) >= 4, F.lit(False)))
    sized = sized.select("page_id", "doc_id", "page_no", "width", "height", kept.alias("_k"), extent.alias("_x"))
    none = F.lit(None)

    def results(n: Column) -> Column:
        rect, conf = G.polygon_to_rect(n["x"]["polygon"], F.col("_x")), F.coalesce(n["x"]["confidence"], F.lit(0.0))

        def one(name: str, kind: str, labels: Column, text: Column, score: Column) -> Column:
            box = F.struct(*[rect[k].alias(k) for k in ("x", "y", "width", "height", "rotation")], labels.cast("array<string>").alias("labels"), text.cast("array<string>").alias("text"))
            return F.struct(F.col("width").alias("original_width"), F.col("height").alias("original_height"), F.lit(0).alias("image_rotation"), box.alias("value"), F.concat(F.lit(f"{prefix}_"), n["i"].cast("string")).alias("id"), F.lit(name).alias("from_name"), F.lit("image").alias("to_name"), F.lit(kind).alias("type"), score.cast("double").alias("score"))

        return F.array(one("bbox", "rectangle", none, none, none), one("label", "labels", F.array(F.lit("Text")), none, none), one("transcription", "textarea", none, F.array(n["x"]["text"]), conf))

    scores = F.transform("_k", lambda n: F.coalesce(n["x"]["confidence"], F.lit(0.0)))
    mean = F.when(F.size("_k") > 0, F.bround(F.aggregate(scores, F.lit(0.0), lambda a, v: a + v) / F.size("_k"), 4)).otherwise(0.0)
    image = F.concat(F.lit(base_path.rstrip("/") + "/"), "page_id") if base_path else F.col("page_id")
    prediction = F.struct(F.lit("surya_ocr_model").alias("model_version"), F.flatten(F.transform("_k", results)).alias("result"), mean.alias("score"))
    return sized.select("page_id", "doc_id", "page_no", F.struct(F.struct(image.alias("ocr")).alias("data"), F.array(prediction).alias("predictions")).alias("document"))


def _get(value: str, path: str, default: str = "") -> Column:
    """G-18: a nested value, or the default where it is missing, null or an empty list."""
    found = F.get_json_object(value, path)
    return F.when(found.isNull() | (found == "[]"), default).otherwise(found)


def restructured(texts: DataFrame) -> DataFrame:
    """G-19: page_id and resume (personal_info, education, skills, work_experience) of a
    parser service's files."""
    root = "$.ResumeParserData"
    s = lambda c: F.coalesce(c, F.lit(""))
    sites = F.from_json(F.get_json_object("value", f"{root}.WebSite"), "array<struct<Type:string,Url:string>>")
    site = lambda kind: s(F.try_element_at(F.transform(F.filter(sites, lambda x: F.lower(x["Type"]) == kind), lambda x: s(x["Url"])), F.lit(-1)))
    first = lambda name, field: _get("value", f"{root}.{name}[0].{field}")
    personal = F.struct(_get("value", f"{root}.Name.FullName").alias("full_name"), first("Email", "EmailAddress").alias("email"), first("PhoneNumber", "OriginalNumber").alias("phone"), first("Address", "FormattedAddress").alias("location"), site("github").alias("github"), site("linkedin").alias("linkedin"))
    quals = F.from_json(F.get_json_object("value", f"{root}.SegregatedQualification"), "array<struct<Institution:struct<Name:string>,Degree:struct<DegreeName:string,Specialization:array<string>>,SubInstitution:struct<Name:string>,StartDate:string,EndDate:string>>")
    entry = "struct<institution:string,institution_location:string,degree:string,sub_institution:string,specialization:string,start_date:string,end_date:string,certification:string>"
    school = F.transform(quals, lambda q: F.struct(s(q["Institution"]["Name"]).alias("institution"), F.lit("").alias("institution_location"), s(q["Degree"]["DegreeName"]).alias("degree"), s(q["SubInstitution"]["Name"]).alias("sub_institution"), s(F.array_join(q["Degree"]["Specialization"], ", ")).alias("specialization"), s(q["StartDate"]).alias("start_date"), s(q["EndDate"]).alias("end_date"), F.lit(None).cast("string").alias("certification")))
    cert = _get("value", f"{root}.Certification")
    certs = F.when(cert != "", F.array(F.struct(*[F.lit(None).cast("string").alias(n) for n in ("institution", "institution_location", "degree", "sub_institution", "specialization", "start_date", "end_date")], cert.alias("certification")))).otherwise(F.array().cast(f"array<{entry}>"))
    block = F.transform(F.split(F.translate(_get("value", f"{root}.SkillBlock"), "\t\r\n", "   "), r"(?U)\s{2,}"), lambda x: F.trim(x))
    skills = F.filter(block, lambda x: (x != "") & ~x.rlike(r"^\d+%$"))
    langs = F.filter(F.transform(F.from_json(F.get_json_object("value", f"{root}.LanguageKnown"), "array<struct<Language:string>>"), lambda x: s(x["Language"])), lambda x: x != "")
    jobs = F.from_json(F.get_json_object("value", f"{root}.SegregatedExperience"), "array<struct<Employer:struct<EmployerName:string>,JobProfile:struct<Title:string>,Location:struct<City:string,State:string>,StartDate:string,EndDate:string,JobDescription:string>>")
    work = F.transform(jobs, lambda j: F.struct(s(j["Employer"]["EmployerName"]).alias("company"), s(j["JobProfile"]["Title"]).alias("role"), s(F.coalesce(F.nullif(j["Location"]["City"], F.lit("")), j["Location"]["State"])).alias("location"), s(j["StartDate"]).alias("start_date"), s(j["EndDate"]).alias("end_date"), s(j["JobDescription"]).alias("employment_description")))
    empty_work = F.array().cast("array<struct<company:string,role:string,location:string,start_date:string,end_date:string,employment_description:string>>")
    resume = F.struct(personal.alias("personal_info"), F.concat(F.coalesce(school, F.array().cast(f"array<{entry}>")), certs).alias("education"), F.array_distinct(F.concat(skills, _or_empty(langs))).alias("skills"), F.coalesce(work, empty_work).alias("work_experience"))
    return texts.select("page_id", resume.alias("resume"))
