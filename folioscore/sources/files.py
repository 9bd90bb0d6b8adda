"""Files: whole JSON texts, images and their sizes, listings, record payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as X

IMAGES = "*.{png,jpg,jpeg,tif,tiff,bmp,PNG,JPG,JPEG}"


def whole_texts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """SRC-03: page_id (file stem), path, value: one row for each file."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return raw.select(X.stem(F.col("_metadata.file_name")).alias("page_id"), F.col("_metadata.file_path").alias("path"), "value")


def strict_json(texts: DataFrame, schema: str) -> DataFrame:
    """SRC-10: parsed ``value``; reading a text that doesn't fit fails the query."""
    return texts.select("*", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("data"))


def good_and_rejected(texts: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """SRC-03: rows with parsed ``data``, and rejected (page_id, path, value). One file's fault
    never fails the others."""
    parsed = texts.withColumn("data", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json("value").isNotNull()
    return parsed.filter(whole & F.col("data").isNotNull()), parsed.filter(~F.coalesce(whole, F.lit(False)) | F.col("data").isNull()).select("page_id", "path", "value")


def images(spark: SparkSession, path: str, recursive: bool = False, glob: str = IMAGES) -> DataFrame:
    """SRC-12: page_id, path, modified, length, content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select(X.safe_stem(F.element_at(F.split("path", "/"), -1)).alias("page_id"), "path", F.col("modificationTime").alias("modified"), "length", "content")


def newest(listing: DataFrame, k: int = 105, suffix: str = ".png") -> DataFrame:
    """SRC-13: the k files changed last, ties by path."""
    return listing.filter(F.lower("path").endswith(suffix)).orderBy(F.desc("modified"), "path").limit(k)


def png_size(content: Column) -> Column:
    """SRC-11: width and height in a PNG's header, null for other content."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def jpeg_size(data: bytes | None) -> dict:
    """Width and height from a JPEG's frame header; nulls without one."""
    none = {"width": None, "height": None}
    if not data or data[:2] != b"\xff\xd8":
        return none
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return {"width": int.from_bytes(data[at + 7 : at + 9], "big"), "height": int.from_bytes(data[at + 5 : at + 7], "big")}
        at += 2 if mark in (0x01, 0xFF) or 0xD0 <= mark <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return none


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def jpeg_sizes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jpeg_size(x) for x in content], columns=["width", "height"]).astype("Int32")


def image_sizes(found: DataFrame) -> DataFrame:
    """SRC-11: page_id, width, height; 0 x 0 where it can't be read. PNG before JPEG where a
    page has several files."""
    jpeg = jpeg_sizes(F.when(F.hex(F.substring("content", 1, 2)) == "FFD8", F.col("content")))
    size = F.coalesce(png_size(F.col("content")), F.when(jpeg["width"].isNotNull(), jpeg), F.struct(F.lit(0).alias("width"), F.lit(0).alias("height")))
    order = F.when(F.lower("path").endswith(".png"), 0).when(F.lower("path").rlike(r"\.jpe?g$"), 1).otherwise(2)
    return found.select("page_id", size.alias("s"), F.struct(order.alias("o"), "path").alias("o")).groupBy("page_id").agg(F.min_by("s", "o").alias("s")).select("page_id", "s.width", "s.height")


def with_sizes(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pages with their image's size, 0 x 0 without one."""
    return pages.join(sizes, "page_id", "left").na.fill(0, ["width", "height"])


#: An image's extensions in the order they are tried.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".gif")
#: First characters of a sought name by which names' parts are chosen, and how many kinds are told apart.
_HEAD, _KINDS = 3, 1 << 16


def image_for_page(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """G-13: each page's ``image``: the file of the page's name, by ``EXTENSIONS`` in order, else
    that of its document's name, else the first path of a file whose name contains the
    document's in any case; null without one. A document's name is the page's up to ``_page_``.

    All are equi-joins. Only what equal names leave is looked up by parts of names: the parts as long
    as a sought name that starts like them, each with its first path. How a sought name starts is
    a hash of its first ``_HEAD`` characters, of ``_KINDS`` kinds, so the table of their lengths is small."""
    files = listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    wanted = pages.select("page_id").filter("page_id is not null").distinct().withColumn("base", F.coalesce(X.cv_id(F.col("page_id")), F.col("page_id")))
    kind = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.regexp_extract("name", r"\.[^.]*\z", 0))
    stems = files.withColumn("kind", kind).filter("kind > 0").withColumn("stem", F.regexp_replace("name", r"\.[^.]*\z", "")).groupBy("stem").agg(F.min(F.struct("kind", "path")).alias("file"))
    tries = F.array(*[F.struct(F.col(c).alias("stem"), F.lit(i).alias("try")) for i, c in enumerate(("page_id", "base"))])
    exact = wanted.select("page_id", F.explode(tries).alias("t")).select("page_id", "t.*").join(stems, "stem").groupBy("page_id").agg(F.min_by("file.path", F.struct("try", "file")).alias("image"))
    rest = wanted.join(exact, "page_id", "left_anti").select("page_id", F.lower("base").alias("sought")).filter("sought <> ''")
    start = lambda c: F.pmod(F.xxhash64(c), F.lit(_KINDS))
    lengths = rest.groupBy(start(F.substring("sought", 1, _HEAD)).alias("start")).agg(F.collect_set(F.length("sought")).alias("lengths"))
    low = files.select("path", F.lower("name").alias("low")).filter("low <> ''")
    heads = low.select("path", "low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("i")).select("path", "low", "i", F.explode(F.array_distinct(F.array(*[F.expr(f"substring(low, i, {n})") for n in range(1, _HEAD + 1)]))).alias("head"))
    found = heads.withColumn("start", start(F.col("head"))).join(F.broadcast(lengths), "start").select("path", "low", "i", F.explode("lengths").alias("n"))
    parts = found.filter("i + n - 1 <= length(low)").groupBy(F.expr("substring(low, i, n)").alias("sought")).agg(F.min("path").alias("image"))
    return pages.join(exact.unionByName(rest.join(parts, "sought").select("page_id", "image")), "page_id", "left")


def reading_order_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: gzipped JSON lines of boxes, target places and texts."""
    return spark.read.schema("source_boxes array<array<int>>, target_index array<int>, source_texts array<string>, target_texts array<string>").json(path)


def payload(spark: SparkSession, job: dict, model: str = "default", num_ctx: int = 8192) -> DataFrame:
    """SRC-17: filename, image, model, num_ctx of a job's records; a job without records is an error."""
    records = job.get("records") or []
    if not records:
        raise ValueError("the job has no records")
    rows = [(r["filename"], r["image_b64"], job.get("model", model), int(job.get("num_ctx", num_ctx))) for r in records]
    return spark.createDataFrame(rows, "filename string, image_b64 string, model string, num_ctx int").withColumn("image", F.unbase64("image_b64")).drop("image_b64")


def parser_texts(texts: DataFrame) -> DataFrame:
    """SRC-09: page_id and original_text of a parser service's files, empty where it is missing."""
    return texts.select("page_id", F.coalesce(F.get_json_object("value", "$.ResumeParserData.DetailResume"), F.lit("")).alias("original_text"))


PAGE = "page_id string, page_num int, image binary, path string, error string"


def pdf_pages(files: DataFrame, rasterise) -> tuple[DataFrame, DataFrame]:
    """SRC-15: ``{stem}_page_{n:03d}`` images of PDF files (path, content) by an injected
    ``rasterise(content) -> iterable of image bytes`` (page_id, page_num, image), and rejected
    (path, error): a file that fails gives one such row and no page."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows = [(f"{stem}_page_{n:03d}", n, image, path, None) for n, image in enumerate(rasterise(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  one file's fault is its own
                    rows = [(None, None, None, path, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["page_id", "page_num", "image", "path", "error"]).astype({"page_num": "Int32"})

    done = files.select("path", "content").mapInPandas(run, PAGE)
    return done.filter("error is null").select("page_id", "page_num", "image"), done.filter("error is not null").select("path", "error")
