"""Queries over readers, writers and hooks: tables are put into the vendors' JSON or the
annotation tool's literals by Spark, and read back by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.binding import bound, let
from ..functions import unicode as U
from ..operators import inference as I
from ..operators import sections as S
from ..operators import tokens as K
from ..sources import files, ground_truth, sinks, vendors
from .registry import register
from .tables import scratch, table
from .text_queries import ascii_only


def _turns(spark, sf) -> DataFrame:
    """Conversations as pages: page_id and turns (array of turn, role, text), in order."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("page_id"), F.struct("turn", "role", "text").alias("t"))
    return c.groupBy("page_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _texts(pages: DataFrame, value: Column) -> DataFrame:
    return pages.select("page_id", F.to_json(value).alias("value"))


def _counts(pages: DataFrame) -> DataFrame:
    """How many there are of each, all words and all lines' texts, and the corners of all boxes."""
    corner = lambda i: F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["box"][i])
    texts = F.array_join(F.transform("lines", lambda x: x["text"]), "|")
    return pages.select("page_id", *[F.size(c).cast("long").alias(c) for c in ("lines", "words", "characters")], F.md5(F.array_join("words", "|")).alias("word_digest"), F.md5(texts).alias("line_digest"), *[corner(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_WORD_LIST = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_WORDS = f"len({_WORD_LIST})"
_PLAIN = "length(text)"


def _counts_sql(box: tuple[float, float, float, float], words: str = _WORD_LIST, characters: str = _PLAIN, line: str = "text") -> str:
    corners = ", ".join(f"CAST(count(*) * {v} AS DOUBLE) AS {n}" for v, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True))
    return f"""SELECT CAST(conv_id AS VARCHAR) AS page_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(len({words})) AS BIGINT) AS words, CAST(sum({characters}) AS BIGINT) AS characters,
md5(coalesce(string_agg(array_to_string({words}, '|'), '|' ORDER BY turn) FILTER (len({words}) > 0), '')) AS word_digest, md5(string_agg({line}, '|' ORDER BY turn)) AS line_digest, {corners} FROM conversations GROUP BY conv_id"""


@register("q_textract", _counts_sql((0.1, 0.1, 0.5, 0.1)))
def q_textract(spark, sf):
    box = F.struct(F.struct(F.lit(0.1).alias("Left"), F.lit(0.1).alias("Top"), F.lit(0.5).alias("Width"), F.lit(0.1).alias("Height")).alias("BoundingBox"))
    block = lambda kind, text: F.struct(F.lit(kind).alias("BlockType"), text.alias("Text"), F.lit(99.5).alias("Confidence"), box.alias("Geometry"))
    blocks = F.concat(F.transform("turns", lambda t: block("LINE", t["text"])), F.flatten(F.transform("turns", lambda t: F.transform(T.split_words(t["text"]), lambda w: block("WORD", w)))), F.array(F.struct(F.lit("PAGE").alias("BlockType"), F.lit(None).cast("string").alias("Text"), F.lit(0.0).alias("Confidence"), box.alias("Geometry"))))
    return _counts(vendors.textract(_texts(_turns(spark, sf), F.struct(blocks.alias("Blocks")))))


@register("q_easyocr", _counts_sql((1, 2, 5, 8)))
def q_easyocr(spark, sf):
    corner = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    box = F.array(corner(1, 2), corner(5, 2), corner(5, 8), corner(1, 8))
    item = lambda t: F.struct(F.concat(F.lit("  "), t["text"], F.lit(" ")).alias("text"), F.lit(0.5).alias("confidence"), box.alias("bbox"))
    return _counts(vendors.easyocr(_texts(_turns(spark, sf), F.struct(F.transform("turns", item).alias("results")))))


@register("q_surya", _counts_sql((0, 0, 9, 9)))
def q_surya(spark, sf):
    """Words from characters, which all have a box."""
    ch = lambda c, i: F.struct(c.alias("text"), F.array(i, F.lit(0), i + 1, F.lit(1)).cast("array<double>").alias("bbox"), F.lit(True).alias("bbox_valid"))
    line = lambda t: F.struct(F.concat(F.lit("<b>"), t["text"], F.lit("</b>")).alias("text"), F.array(*[F.lit(float(x)) for x in (0, 0, 9, 9)]).alias("bbox"), F.lit(0.9).alias("confidence"), F.transform(F.split(t["text"], ""), ch).alias("chars"))
    page = F.create_map(F.lit("key"), F.array(F.struct(F.transform("turns", line).alias("text_lines"))))
    return _counts(vendors.surya(_texts(_turns(spark, sf), page)))


@register("q_dotsocr", _counts_sql((0, 0, 9, 9), r"list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}_À-ÿ]+|[^\p{L}\p{N}_À-ÿ]+$', '', 'g')), lambda w: w <> '')", "length(text) + 3", "'## ' || text"))
def q_dotsocr(spark, sf):
    item = lambda t: F.struct(F.array(*[F.lit(float(x)) for x in (0, 0, 9, 9)]).alias("bbox"), F.lit("Text").alias("category"), F.concat(F.lit("## "), t["text"]).alias("text"))
    return _counts(vendors.dotsocr(_texts(_turns(spark, sf), F.transform("turns", item))))


_TRIMMED = r"list_filter(list_transform(string_split_regex({0}, '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}_À-ÿ]+|[^\p{{L}}\p{{N}}_À-ÿ]+$', '', 'g')), lambda w: w <> '')"


@register(
    "q_dotsocr_tables",
    rf"""SELECT CAST(conv_id % 50 AS VARCHAR) AS page_id, CAST(sum(len({_TRIMMED.format("text")}) + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS words, CAST(count(*) AS BIGINT) AS lines,
md5(string_agg(CASE WHEN turn % 2 = 0 THEN concat_ws('|', nullif(array_to_string({_TRIMMED.format("text")}, '|'), ''), '7') ELSE nullif(array_to_string({_TRIMMED.format("text")}, '|'), '') END, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""",
)
def q_dotsocr_tables(spark, sf):
    """SRC-07: tables and texts on a page, and several files of one stem, each with its own words."""
    cell = lambda t: F.concat(F.lit(" <table><tr><td>"), t, F.lit("</td><td>7</td><td>x</td></tr></table>"))
    text = lambda t: F.when(t["turn"] % 2 == 0, cell(t["text"])).otherwise(t["text"])
    item = lambda t: F.struct(F.array(*[F.lit(float(x)) for x in (0, 0, 9, 9)]).alias("bbox"), F.lit("Table").alias("category"), text(t).alias("text"))
    files_ = _texts(_turns(spark, sf), F.transform("turns", item)).withColumn("page_id", (F.col("page_id").cast("long") % 50).cast("string"))
    return vendors.dotsocr(files_).select("page_id", F.size("words").cast("long").alias("words"), F.size("lines").cast("long").alias("lines"), F.md5(F.array_join("words", "|")).alias("digest"))


@register("q_tesseract", "SELECT CAST(l_orderkey AS VARCHAR) AS page_id, CAST(count(*) AS BIGINT) AS words, CAST(sum(l_partkey % 90 + l_quantity) AS DOUBLE) AS x2, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY l_orderkey")
def q_tesseract(spark, sf):
    item = F.struct(F.col("l_returnflag").alias("text"), F.lit(90).alias("confidence"), F.struct((F.col("l_partkey") % 90).alias("left"), F.lit(1).alias("top"), F.col("l_quantity").alias("width"), F.lit(5).alias("height")).alias("bbox"), F.lit(1).alias("block_num"), F.col("l_linenumber").alias("line_num"), F.lit(1).alias("word_num"))
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("page_id"), item.alias("i")).groupBy("page_id").agg(F.collect_list("i").alias("results"))
    t = vendors.tesseract(_texts(pages, F.struct("results")))
    return t.select("page_id", F.size("words").cast("long").alias("words"), F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["box"][2]).alias("x2"), F.aggregate("line_nums", F.lit(0).cast("long"), lambda a, x: a + x).alias("numbers"))


@register(
    "q_annotations",
    """SELECT CAST(conv_id AS VARCHAR) AS page_id, CAST(3 * count(*) AS BIGINT) AS results, round_even(avg(turn * 0.1 :: DOUBLE), 4) AS score, CASE conv_id % 3 WHEN 0 THEN 'conv_page_007' WHEN 1 THEN 'doc_page_001' ELSE 'doc_page_001' END AS file,
md5(string_agg(text, '|' ORDER BY turn)) AS digest, 50.0 :: DOUBLE AS width FROM conversations GROUP BY conv_id""",
)
def q_annotations(spark, sf):
    """All three shapes of input: an object of documents, a list of pages, a page."""
    corner = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    polygon = F.array(corner(8, 0), corner(16, 0), corner(16, 4), corner(8, 4))
    line = lambda t: F.struct(t["text"].alias("text"), polygon.alias("polygon"), (t["turn"] * 0.1).alias("confidence"))
    lines = F.transform("turns", line).alias("text_lines")
    kind = F.col("page_id").cast("long") % 3
    shapes = F.when(kind == 0, F.to_json(F.create_map(F.lit("conv_page_007"), F.array(F.struct(lines))))).when(kind == 1, F.to_json(F.array(F.struct(lines)))).otherwise(F.to_json(F.struct(F.lit("x").alias("page"), lines)))
    sizes = spark.createDataFrame([], "page_id string, width int, height int")
    d = vendors.annotations(_turns(spark, sf).select("page_id", shapes.alias("value")), sizes)
    p = F.col("document.predictions")[0]
    texts = F.array_join(F.flatten(F.transform(F.filter(p["result"], lambda r: r["type"] == "textarea"), lambda r: r["value"]["text"])), "|")
    return d.select("page_id", F.size(p["result"]).cast("long").alias("results"), p["score"].alias("score"), sinks.annotation_name(F.col("doc_id"), F.col("page_no")).alias("file"), F.md5(texts).alias("digest"), p["result"][0]["value"]["width"].alias("width"))


@register("q_parser", "SELECT CAST(c_custkey AS VARCHAR) AS page_id, c_name AS name, CAST(2 AS BIGINT) AS skills, 'C' || (c_custkey % 5) AS location, c_name || chr(10) || 'x' AS original_text FROM customer")
def q_parser(spark, sf):
    """Blank cities give way to states; repeated skills and percentages are left out."""
    c = table(spark, sf, "customer")
    city = F.concat(F.lit("C"), (F.col("c_custkey") % 5).cast("string"))
    job = F.struct(F.struct(F.when(F.col("c_custkey") % 2 == 0, city).otherwise("").alias("City"), city.alias("State")).alias("Location"))
    root = F.struct(F.concat(F.col("c_name"), F.lit("\nx")).alias("DetailResume"), F.struct(F.col("c_name").alias("FullName")).alias("Name"), F.lit("Python  80%  SQL\n\nPython").alias("SkillBlock"), F.array(job).alias("SegregatedExperience"))
    texts = c.select(F.col("c_custkey").cast("string").alias("page_id"), F.to_json(F.struct(root.alias("ResumeParserData"))).alias("value"))
    r = vendors.restructured(texts).select("page_id", F.col("resume.personal_info.full_name").alias("name"), F.size("resume.skills").cast("long").alias("skills"), F.col("resume.work_experience")[0]["location"].alias("location"))
    return r.join(files.parser_texts(texts), "page_id")


def _literals(spark, sf) -> DataFrame:
    """Annotation rows: an order is a page, its items numbered backwards; JSON lists of
    numbers and texts are Python literals as well."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"))
    pages = table(spark, sf, "lineitem").select("l_orderkey", row.alias("r")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("r"))
    n = F.size("r")
    texts = F.transform("r", lambda x: F.concat(x["flag"], x["l_partkey"].cast("string")))
    order = F.transform("r", lambda x, i: F.struct((n - i).alias("number"), x["l_partkey"].alias("x"), F.lit(1).alias("y"), F.lit(2).alias("width"), F.lit(3).alias("height")))
    boxes = F.transform("r", lambda x: F.struct(x["l_partkey"].alias("X"), F.lit(1).alias("y"), F.lit(2).alias("w"), F.lit(3).alias("h")))
    section = F.transform("r", lambda x: F.struct(F.array(x["flag"]).alias("labels")))
    name = F.concat(F.lit("up/batch-P"), F.col("l_orderkey").cast("string"), F.lit(".png"))
    return pages.select(name.alias("ocr"), F.to_json(texts).alias("transcription"), F.to_json(boxes).alias("bbox"), F.to_json(order).alias("reading_order"), F.to_json(section).alias("section"), F.col("l_orderkey").alias("ordinal"))


_RANKED = "r AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n FROM lineitem)"


@register("q_gt_pages", "SELECT 'P' || l_orderkey AS page_id, CAST(count(*) AS BIGINT) AS words, CAST(sum(l_partkey) AS DOUBLE) AS x FROM lineitem GROUP BY l_orderkey")
def q_gt_pages(spark, sf):
    p = ground_truth.pages(_literals(spark, sf))
    return p.select("page_id", F.size("words").cast("long").alias("words"), F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b[0]).alias("x"))


@register("q_gt_reading_order", f"WITH {_RANKED} SELECT l_orderkey AS page, string_agg(l_returnflag || l_partkey, ' ' ORDER BY n DESC) AS texts, CAST(max(n) AS INTEGER) AS last FROM r GROUP BY l_orderkey")
def q_gt_reading_order(spark, sf):
    o = ground_truth.in_reading_order(_literals(spark, sf))
    return o.select(F.col("ordinal").alias("page"), F.array_join("ro_text", " ").alias("texts"), F.array_max("reading_order").alias("last"))


@register("q_gt_sections", f"WITH {_RANKED} SELECT l_orderkey AS page, l_returnflag AS section, string_agg(l_returnflag || l_partkey, ' ' ORDER BY n DESC) AS texts FROM r GROUP BY l_orderkey, l_returnflag")
def q_gt_sections(spark, sf):
    s = ground_truth.sections(ground_truth.in_reading_order(_literals(spark, sf)), "ordinal")
    return s.select(F.col("ordinal").alias("page"), F.explode("section").alias("section", "items")).select("page", "section", F.array_join(F.transform("items", lambda i: i["transcription"]), " ").alias("texts"))


@register("q_image_sizes", "SELECT CAST(p_partkey AS VARCHAR) AS page_id, CAST(p_partkey % 4000 + 1 AS INTEGER) AS width, CAST(p_partkey % 3000 + 1 AS INTEGER) AS height FROM part")
def q_image_sizes(spark, sf):
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(F.col("p_partkey") % 4000 + 1), word(F.col("p_partkey") % 3000 + 1)))
    name = F.col("p_partkey").cast("string")
    found = table(spark, sf, "part").select(name.alias("page_id"), F.concat(F.lit("/x/"), name, F.lit(".png")).alias("path"), head.alias("content"))
    return files.image_sizes(found)


@register(
    "q_jpeg_sizes",
    """SELECT CAST(p_partkey AS VARCHAR) AS page_id, CASE WHEN k = 0 THEN CAST(p_partkey % 4000 + 1 AS INTEGER) WHEN k = 4 THEN 7 ELSE 0 END AS width, CASE WHEN k = 0 THEN CAST(p_partkey % 3000 + 1 AS INTEGER) WHEN k = 4 THEN 9 ELSE 0 END AS height
FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)""",
)
def q_jpeg_sizes(spark, sf):
    """SRC-11: frame headers behind segments of any length; cut and other files are 0 x 0; of a
    page's PNG and JPEG the PNG counts, readable or not."""
    n, k, name = F.col("p_partkey"), F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    word = lambda c, digits=4: F.lpad(F.hex(c), digits, "0")
    jpeg = F.concat(F.lit("FFD8FFE0"), word(n % 50 + 2), F.repeat(F.lit("A5"), (n % 50).cast("int")), F.lit("FFC0001108"), word(n % 3000 + 1), word(n % 4000 + 1), F.lit("03"), F.repeat(F.lit("00"), F.lit(20)))
    file = lambda end, content: F.struct(F.concat(F.lit("/x/"), name, F.lit(end)).alias("path"), F.unhex(content).alias("content"))
    both = F.when(k == 3, F.lit("4142")).otherwise(F.lit("89504E470D0A1A0A0000000D494844520000000700000009"))
    made = F.when(k == 0, F.array(file(".jpg", jpeg))).when(k == 1, F.array(file(".jpeg", F.substring(jpeg, 1, 12)))).when(k == 2, F.array(file(".bmp", F.lit("424D0000")))).otherwise(F.array(file(".jpg", jpeg), file(".png", both)))
    return files.image_sizes(table(spark, sf, "part").select(name.alias("page_id"), F.explode(made).alias("f")).select("page_id", "f.*"))


@register("q_file_listing", "SELECT 'n' || c_nationkey AS folder, CAST(sum(length(c_name) + 1) AS BIGINT) AS length, md5(string_agg(c_name, chr(10) ORDER BY c_name) || chr(10)) AS digest FROM customer GROUP BY c_nationkey")
def q_file_listing(spark, sf):
    """SRC-12: files of nested folders with their lengths and contents."""
    path = scratch(spark, "listing")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("folder"), "c_name")
    rows.repartition("folder").sortWithinPartitions("folder", "c_name").write.partitionBy("folder").text(path)
    found = files.images(spark, path, recursive=True, glob="*.txt")
    return found.select(F.regexp_extract("path", "folder=([^/]*)/", 1).alias("folder"), "length", F.md5("content").alias("digest"))


@register(
    "q_label_maps",
    """WITH l AS (SELECT l_orderkey, 'flag' AS kind, l_returnflag AS label FROM lineitem UNION ALL SELECT l_orderkey, 'status', l_linestatus FROM lineitem UNION ALL SELECT l_orderkey, 'first', l_returnflag FROM lineitem),
m AS (SELECT DISTINCT kind, label FROM l WHERE kind <> 'first' OR l_orderkey = (SELECT min(l_orderkey) FROM lineitem) UNION SELECT DISTINCT kind, 'O' FROM l),
s AS (SELECT kind, label, row_number() OVER (PARTITION BY kind ORDER BY kind <> 'status' AND label = 'O' DESC, label) - 1 AS id FROM m)
SELECT s.kind, CAST(s.id AS INTEGER) AS id, s.label, CAST((SELECT count(*) FROM l WHERE l.kind = s.kind AND l.label = s.label) AS BIGINT) AS n FROM s""",
)
def q_label_maps(spark, sf):
    """G-24: maps from all pages' labels, "O" added or there already, and from the first page's
    alone; how many labels each id stands for."""
    pages = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flag"), F.collect_list("l_linestatus").alias("status"))
    parts = []
    for kind, column, first in (("flag", "flag", None), ("status", "status", None), ("first", "flag", "l_orderkey")):
        names = K.label_table(pages, column, first)
        used = K.label_ids(pages, column, names, "ids").select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        parts.append(names.join(used, "id", "left").select(F.lit(kind).alias("kind"), "id", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "q_parser_branches",
    """SELECT CAST(c_custkey AS VARCHAR) AS page_id, c_name AS github, CASE WHEN c_custkey % 2 = 0 THEN 'li/' || c_name ELSE '' END AS linkedin, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || '@x' END AS email,
CAST(CASE WHEN c_custkey % 4 > 0 THEN 2 ELSE 1 END AS BIGINT) AS entries, 'I' || c_custkey % 5 || ';D;a, b;;2001;' AS school, CASE WHEN c_custkey % 4 > 0 THEN 'cert ' || c_custkey END AS certification, 'SQL|Python|L' || c_custkey % 3 AS skills FROM customer""",
)
def q_parser_branches(spark, sf):
    """G-19: the last site of a kind in any case, the first e-mail or none, schools with a null
    part, a certificate behind them, languages among the skills, repeats left out."""
    n = F.col("c_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    site = lambda kind, url: F.struct(F.lit(kind).alias("Type"), url.alias("Url"))
    sites = F.concat(F.array(site("GitHub", F.lit("old")), site("github", F.col("c_name"))), F.when(n % 2 == 0, F.array(site("LINKEDIN", text("li/", F.col("c_name"))))).otherwise(F.array().cast("array<struct<Type:string,Url:string>>")))
    mail = F.when(n % 3 == 0, F.array().cast("array<struct<EmailAddress:string>>")).otherwise(F.array(F.struct(text(F.col("c_name"), "@x").alias("EmailAddress")), F.struct(F.lit("second").alias("EmailAddress"))))
    degree = F.struct(F.lit("D").alias("DegreeName"), F.array(F.lit("a"), F.lit("b")).alias("Specialization"))
    school = F.struct(F.struct(text("I", n % 5).alias("Name")).alias("Institution"), degree.alias("Degree"), F.lit(None).cast("struct<Name:string>").alias("SubInstitution"), F.lit("2001").alias("StartDate"))
    spoken = F.array(*[F.struct(x.alias("Language")) for x in (text("L", n % 3), F.lit(""), F.lit("SQL"))])
    root = F.struct(sites.alias("WebSite"), mail.alias("Email"), F.array(school).alias("SegregatedQualification"), F.when(n % 4 > 0, text("cert ", n)).alias("Certification"), F.lit("SQL  50%\n\nPython").alias("SkillBlock"), spoken.alias("LanguageKnown"))
    texts = table(spark, sf, "customer").select(n.cast("string").alias("page_id"), F.to_json(F.struct(root.alias("ResumeParserData"))).alias("value"))
    r, first = vendors.restructured(texts), F.col("resume.education")[0]
    school = F.concat_ws(";", *[first[k] for k in ("institution", "degree", "specialization", "sub_institution", "start_date", "end_date")])
    return r.select("page_id", *[F.col(f"resume.personal_info.{k}").alias(k) for k in ("github", "linkedin", "email")], F.size("resume.education").cast("long").alias("entries"), school.alias("school"), F.element_at("resume.education", -1)["certification"].alias("certification"), F.array_join("resume.skills", "|").alias("skills"))


@register(
    "q_list_words",
    """SELECT conv_id, turn, concat_ws('|', nullif(t || ' q', ' q'), nullif(t, ''), CASE WHEN t = '' THEN 'q' END) AS as_list, CAST(2 * len(list_filter(string_split(t, ' '), lambda w: w <> '')) + 1 AS BIGINT) AS as_text
FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM conversations)""",
)
def q_list_words(spark, sf):
    """T-17: items of a list are normalised and stay items, spaces and all; a text is split again."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^a-z\s]", ""), r"\s+", " "))
    c = table(spark, sf, "conversations").select("conv_id", "turn", t.alias("t"))
    items = F.array(F.concat("t", F.lit("-q")), F.lit("--"), F.col("t"))
    words = T.word_sequence(F.concat("t", F.lit("-q -- "), F.col("t")), False)
    return c.select("conv_id", "turn", F.array_join(T.word_sequence(items, True), "|").alias("as_list"), F.size(words).cast("long").alias("as_text"))


@register("q_data_url", "SELECT page_id, md5('data:image/jpeg;base64,' || base64(encode(html))) AS digest FROM pages")
def q_data_url(spark, sf):
    # The built-in breaks lines every 76 characters only where MIME asks for it.
    url = T.data_url(F.lit("x.jpg"), F.col("html").cast("binary"))
    return table(spark, sf, "pages").select("page_id", F.md5(F.regexp_replace(url, r"\r\n", "")).alias("digest"))


@register("q_characters", r"""SELECT item_id, CAST(length(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '[\[\]",\n\r\t]', '', 'g')) AS BIGINT) AS characters FROM benchmark""")
def q_characters(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(T.characters(ascii_only(F.col("text")))).cast("long").alias("characters"))


@register("q_clean_transcription", r"SELECT item_id, array_to_string([text, 'b/c'], ' ') AS text FROM benchmark")
def q_clean_transcription(spark, sf):
    literal = F.to_json(F.array(F.col("text"), F.lit("b/c")))
    return table(spark, sf, "benchmark").select("item_id", T.clean_transcription(literal).alias("text"))


@register("q_flatten_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) || ' a b' AS text FROM events")
def q_flatten_json(spark, sf):
    nested = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.array(F.struct(F.lit("a").alias("x")), F.struct(F.lit("b").alias("x"))).alias("l")))
    return table(spark, sf, "events").select("event_id", U.flatten_json(nested).alias("text"))


@register("q_markdown_pages", r"SELECT CAST(conv_id AS VARCHAR) AS page_id, CAST(count(*) AS BIGINT) AS lines, md5(string_agg(trim(l), '|' ORDER BY turn, i)) AS digest FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations) WHERE trim(l) <> '' GROUP BY conv_id")
def q_markdown_pages(spark, sf):
    """T-13: pages come in any order and are read by index."""
    pages = F.transform(F.reverse("turns"), lambda t: F.struct(t["turn"].alias("index"), F.concat(F.lit("## "), t["text"]).alias("markdown")))
    lines = T.markdown_lines(pages)
    return _turns(spark, sf).select("page_id", F.size(lines).cast("long").alias("lines"), F.md5(F.array_join(lines, "|")).alias("digest"))


#: Answers of a model about a turn's text, and what the schema finds in each: null, or the
#: faults; {0} is the text as JSON.
_ANSWERS = [
    ('{"skills": [{0}, "x"], "personal_info": {"email": {0}}}', None),
    ('{"extra": {"deep": [1, null]}, "skills": [{0}]}', None),
    ('{"work_experience": [{"company": {0}, "role": "r", "years": 3}, {}], "education": {"degrees": [{"degree": {0}}], "certifications": [{"license": {0}}]}}', None),
    ("{}", None),
    (' {"education": {}} ', None),
    ('{"skills": {0}}', "skills: list_type"),
    ('{"skills": null}', "skills: list_type"),
    ('{"personal_info": null, "skills": [{0}, 5, null, ["x"]]}', "personal_info: model_type; skills.1: string_type; skills.2: string_type; skills.3: string_type"),
    ('{"personal_info": [{0}]}', "personal_info: model_type"),
    ('{"personal_info": {"email": {"a": {0}}, "phone": 5, "github": true}}', "personal_info.email: string_type; personal_info.phone: string_type; personal_info.github: string_type"),
    ('{"work_experience": {"company": {0}}}', "work_experience: list_type"),
    ('{"work_experience": [{"company": {0}}, {0}, {"role": 1.5}]}', "work_experience.1: model_type; work_experience.2.role: string_type"),
    ('{"education": []}', "education: model_type"),
    ('{"education": {"degrees": [{"degree": null}], "certifications": {0}}}', "education.degrees.0.degree: string_type; education.certifications: list_type"),
    ("{0}", "model_type"),
    ("[{0}]", "model_type"),
    ("null", "model_type"),
    ('{"skills": [{0}]} and more', "not JSON"),
    ('{"skills": [{0}]}]', "not JSON"),
    ('{"skills": [{0}],}', "not JSON"),
    ("skills: {0}", "not JSON"),
    (" ", "blank"),
]


def _answer_sql() -> str:
    def text(t: str) -> str:
        return "'" + t.replace("'", "''").replace("{0}", "' || j || '") + "'"

    values = " ".join(f"WHEN {i} THEN {text(v)}" for i, (v, _) in enumerate(_ANSWERS))
    errors = " ".join(f"WHEN {i} THEN " + ("NULL" if e is None else f"'{e}'") for i, (_, e) in enumerate(_ANSWERS))
    all_texts = lambda path: f"coalesce(list_aggregate(json_extract_string(v, '$.{path}'), 'string_agg', ','), '')"
    return f"""WITH t AS (SELECT conv_id, turn, (3 * conv_id + turn) % {len(_ANSWERS)} AS k, CAST(to_json(text) AS VARCHAR) AS j FROM conversations),
a AS (SELECT *, CASE k {values} END AS v, CASE k {errors} END AS error FROM t), g AS (SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN v ELSE '{{}}' END AS v FROM a)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN md5(concat_ws('|', {all_texts('skills[*]')}, coalesce(json_extract_string(v, '$.personal_info.email'), ''), {all_texts('work_experience[*].company')}, {all_texts('education.degrees[*].degree')}, {all_texts('education.certifications[*].license')})) END AS digest,
  CASE WHEN error IS NULL THEN CAST(coalesce(json_array_length(v, '$.work_experience'), 0) AS BIGINT) END AS jobs FROM g"""


@register("q_validated", _answer_sql())
def q_validated(spark, sf):
    """G-23: answers that the schema takes, with defaults and unknown fields, and many that it doesn't."""
    j = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    k = (3 * F.col("conv_id") + F.col("turn")) % len(_ANSWERS)
    filled = lambda v: F.concat(*[x for i, part in enumerate(v.split("{0}")) for x in ([j] if i else []) + [F.lit(part)]])
    value = F.coalesce(*[F.when(k == i, filled(v)) for i, (v, _) in enumerate(_ANSWERS)])
    v = S.validated(table(spark, sf, "conversations").select("conv_id", "turn", value.alias("value")))
    joined = lambda items, f: F.array_join(F.filter(F.transform(items, f), lambda x: x != ""), ",")
    school = F.col("data.education")
    digest = F.md5(F.concat_ws("|", F.array_join("data.skills", ","), "data.personal_info.email", joined(F.col("data.work_experience"), lambda x: x["company"]), joined(school["degrees"], lambda x: x["degree"]), joined(school["certifications"], lambda x: x["license"])))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return v.select("conv_id", "turn", "error", good(digest).alias("digest"), good(F.size("data.work_experience").cast("long")).alias("jobs"))


@register("q_pred_sections", f"SELECT conv_id, 'skills' AS section, CAST(sum({_WORDS.replace('text', 'x')}) AS BIGINT) AS words FROM (SELECT conv_id, regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g') AS x FROM conversations) GROUP BY conv_id")
def q_pred_sections(spark, sf):
    preds = _turns(spark, sf).select(F.col("page_id").cast("long").alias("conv_id"), F.to_json(F.struct(F.transform("turns", lambda t: ascii_only(t["text"])).alias("skills"))).alias("value"))
    p = S.pred_texts(preds, ["conv_id"], exact=False)
    return p.select("conv_id", "section", F.size(T.split_words(F.col("pred"))).cast("long").alias("words"))


@register("q_hook_status", "SELECT item_id AS id, 'ok' AS status, upper(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')) AS data FROM benchmark")
def q_hook_status(spark, sf):
    rows = I.run(table(spark, sf, "benchmark").select("item_id", ascii_only(F.col("text")).alias("text")), "item_id", ["text"], lambda: lambda text: text.upper(), threads=4)
    return rows.select("id", "status", "data")


@register("q_token_budget", "SELECT 'c' || conv_id AS doc_id, CAST(count(*) AS BIGINT) AS pages, CAST(least(12000, 4000 + 2000 * count(*)) AS INTEGER) AS num_predict FROM conversations GROUP BY conv_id")
def q_token_budget(spark, sf):
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_page_"), F.col("turn").cast("string"))
    d = I.document_payload(table(spark, sf, "conversations").select(name.alias("filename"), F.col("text").cast("binary").alias("image")))
    return d.select("doc_id", F.size("names").cast("long").alias("pages"), "num_predict")


@register("q_model_inputs", "SELECT l_orderkey, CAST(m + 2 AS INTEGER) AS ids, n > 510 AS clipped, CAST(m * (m - 1) / 2 - 200 - 100 * (n - m) AS BIGINT) AS labels FROM (SELECT l_orderkey, 60 * count(*) AS n, least(510, 60 * count(*)) AS m FROM lineitem GROUP BY l_orderkey)")
def q_model_inputs(spark, sf):
    """K-18: pages with more boxes than the model takes are cut, their further targets masked."""
    pages = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("n"))
    boxes = F.flatten(F.array_repeat(F.transform("n", lambda x: F.array(x, x, x, x)), 60))

    def made(b):
        inputs = K.model_inputs(b)
        labels = K.training_labels(F.sequence(F.lit(1), F.size(b)), F.size(b) + 2)
        return F.struct(F.size(inputs["input_ids"]).alias("ids"), inputs["clipped"].alias("clipped"), F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"))

    return bound(pages, m=let(boxes, made)).select("l_orderkey", "m.ids", "m.clipped", "m.labels")


@register("q_paired_inputs", "SELECT CAST(conv_id AS VARCHAR) AS page_id, CAST(count(*) FILTER (turn % 2 = 0) AS BIGINT) AS pairs FROM conversations GROUP BY conv_id")
def q_paired_inputs(spark, sf):
    words = F.transform("turns", lambda t: F.when(t["turn"] % 2 == 0, t["role"]).otherwise(" "))
    boxes = F.transform("turns", lambda t: F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)))
    return _turns(spark, sf).select("page_id", F.size(I.paired_inputs(words, boxes)).cast("long").alias("pairs"))


@register("q_null_boxes", "SELECT CAST(conv_id AS VARCHAR) AS page_id, string_agg(role, ',' ORDER BY turn) FILTER (turn % 3 <> 0) AS roles FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn % 3 <> 0) > 0")
def q_null_boxes(spark, sf):
    boxes = F.transform("turns", lambda t: F.when(t["turn"] % 3 != 0, F.array(F.lit(1.0))))
    kept = G.drop_null_boxes(boxes, F.transform("turns", lambda t: t["role"]), F.transform("turns", lambda t: F.lit(1.0)))
    return _turns(spark, sf).select("page_id", kept.alias("k")).filter(F.size("k") > 0).select("page_id", F.array_join(F.transform("k", lambda x: x["text"]), ",").alias("roles"))
