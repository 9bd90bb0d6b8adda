"""Ground truth: annotation CSVs with Python-literal columns, as typed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import unicode as U
from ..functions.binding import bound, let
from ..operators.relational import keep_first

_BOX = "struct<x:double,y:double,width:double,height:double,w:double,h:double,X:double,Y:double,number:int>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: rows with their place in the file (ordinal)."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').withColumn("ordinal", F.monotonically_increasing_id())


def read_predictions(spark: SparkSession, path: str, lists: tuple[str, ...] = ("text", "words"), raw: bool = False) -> DataFrame:
    """SRC-02: pre-normalised predictions; list columns parsed, or left as texts (``raw``)."""
    rows = read_csv(spark, path)
    return rows if raw else rows.withColumns({c: U.literal_strings(c) for c in lists if c in rows.columns})


def boxes_of(literal: str):
    """G-14: x, y, width, height boxes of a literal: dicts (keys of any case, w and h for the
    sizes; missing ones 0) or lists of four or more; others are left out."""
    json = U.literal_to_json(literal)
    as_list = F.when(F.startswith(json, F.lit("{")), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json)
    items = F.from_json(as_list, "array<string>")

    def one(item):
        def named(d):
            at = lambda *names: F.coalesce(*[F.try_element_at(d, F.lit(n)) for n in names], F.lit(0.0))
            return F.array(at("x"), at("y"), at("width", "w"), at("height", "h"))

        low = F.transform_keys(F.from_json(item, "map<string,double>"), lambda k, v: F.lower(k))
        first = lambda v: F.when(F.size(v) >= 4, F.slice(v, 1, 4))
        return F.when(item.startswith("{"), let(low, named)).otherwise(let(F.from_json(item, "array<double>"), first))

    return F.coalesce(F.filter(F.transform(items, one), lambda b: b.isNotNull()), F.array().cast("array<array<double>>"))


def pages(rows: DataFrame, text: str = "transcription") -> DataFrame:
    """Words, boxes, page name and characters of each annotated page, the first row of a
    page's name: T-05, G-14, T-20, T-06, R-13."""
    named = rows.withColumns({"page_id": T.gt_filename(F.col("ocr")), "words": T.split_words(T.clean_transcription(F.col(text))), "boxes": boxes_of("bbox"), "characters": T.characters(F.col(text))})
    return keep_first(named, ["page_id"], "ordinal")


def _labels(literal: str):
    items = F.from_json(U.literal_to_json(literal), "array<struct<labels:array<string>>>")
    return F.transform(items, G.first_label)


def in_reading_order(rows: DataFrame, text: str = "transcription") -> DataFrame:
    """G-15, G-16, G-17: texts, boxes, sections, labels and biographic flags by reading-order
    number, and the numbers 1 to n. Optional columns that aren't there give nulls. Where
    lists differ in length both are cut to the shorter; ``cut`` says so."""
    numbers = F.transform(F.from_json(U.literal_to_json("reading_order"), f"array<{_BOX}>"), lambda x: x["number"])
    has = set(rows.columns)
    values = {
        "ro_text": F.transform(U.literal_strings(text), lambda t: F.replace(t, F.lit("\\/"), F.lit("/"))),
        "ro_boxes": boxes_of("reading_order"),
        "ro_section": _labels("section"),
        "ro_label": _labels("label") if "label" in has else F.lit(None).cast("array<string>"),
        "ro_bio": U.literal_strings("bio") if "bio" in has else F.lit(None).cast("array<string>"),
    }
    parsed = bound(rows, _n=numbers, **{f"_{k}": v for k, v in values.items()})
    ordered = {k: F.when(F.col(f"_{k}").isNotNull(), G.by_reading_order(F.col("_n"), F.col(f"_{k}"))) for k in values}
    cut = F.greatest(*[F.coalesce(F.size(f"_{k}") != F.size("_n"), F.lit(False)) for k in values])
    return bound(parsed, **ordered, cut=cut).withColumn("reading_order", G.renumbered(F.col("ro_boxes"))).drop("_n", *[f"_{k}" for k in values])


def sections(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """SNK-02: key and section, a map of a page's items by section, sections in the order they
    are first seen, items in reading order."""
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))  # noqa: E731  a zip with a null list would be null
    zipped = F.arrays_zip(F.col("reading_order").alias("n"), F.col("ro_text").alias("t"), F.col("ro_boxes").alias("b"), F.col("ro_section").alias("s"), texts("ro_label").alias("l"), texts("ro_bio").alias("o"))
    item = lambda z: F.struct(z["l"].alias("item"), z["o"].alias("bio"), z["n"].alias("reading_order_number"), z["b"].alias("bbox"), z["t"].alias("transcription"))

    def by_section(z):
        names = F.array_distinct(F.transform(z, lambda x: x["s"]))
        entry = lambda name: F.struct(name.alias("key"), F.transform(F.filter(z, lambda x: x["s"] == name), item).alias("value"))
        return F.map_from_entries(F.transform(F.filter(names, lambda n: n.isNotNull()), entry))

    return pages.select(key, let(zipped, by_section).alias("section"))
