"""Section-level comparison of structured documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..functions.binding import bound, let
from . import edit_distance as D

#: Annotation sections and the prediction sections they are compared with.
SECTIONS = {
    "PERSONAL": "personal_info",
    "SKILLS": "skills",
    "EDUCATION": "education",
    "EMP-INFO": "work_experience_info",
    "EMP-DESC": "work_experience_description",
}
POLICIES = ("skip", "soft", "penalize")
#: The prediction schema: a name stands for a text, a list of one for any number of them. Every field has an empty default.
RESUME = {
    "personal_info": dict.fromkeys(("full_name", "email", "phone", "location", "github", "linkedin", "address", "identification_number"), "text"),
    "skills": ["text"],
    "work_experience": [dict.fromkeys(("company", "role", "start_date", "end_date", "employment_description", "location"), "text")],
    "education": {
        "degrees": [dict.fromkeys(("institution", "degree", "start_date", "end_date", "location"), "text")],
        "certifications": [dict.fromkeys(("name", "institution", "date_obtained", "license"), "text")],
    },
}


def gt_texts(items: DataFrame, key: list[str], page: str, section: str, order: str, text: str, exact: bool = True) -> DataFrame:
    """G-20, G-21: key, section, gt: a section's transcriptions in reading order, page by
    page, normalised; sections named by ``SECTIONS``, others as they are."""
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    named = items.withColumn("_s", F.coalesce(F.element_at(names, F.col(section)), F.col(section)))
    joined = named.groupBy(*key, F.col("_s").alias("section")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), " ").alias("_t"))
    return joined.select(*key, "section", T.normalize_section(F.col("_t"), exact).alias("gt"))


def leaves(part: Column) -> Column:
    """``flatten_json`` of an object or a list that holds texts and nulls only, in the JVM, for texts
    of which letters and digits are kept; null for any other. Behind escapes (which are
    signs or white space) a quote always begins or ends a text, and a name is one before a colon."""
    bare = F.replace(F.replace(part, F.lit("\\\\"), F.lit(" ")), F.lit('\\"'), F.lit(" "))
    bare = F.when(F.contains(bare, F.lit("\\")), F.regexp_replace(bare, r"\\(?:[bfnrt/]|u00[01][0-9a-fA-F])", " ")).otherwise(bare)

    def read(pieces: Column) -> Column:
        between = F.array_join(F.filter(pieces, lambda x, i: i % 2 == 0), " ")
        plain = ~F.replace(between, F.lit("null"), F.lit("")).rlike(r"[^\[\]{}:,\s]")
        texts = F.filter(pieces, lambda x, i: (i % 2 == 1) & ~F.startswith(F.ltrim(F.get(pieces, i + 1)), F.lit(":")))
        return F.when(plain, F.array_join(texts, " "))

    return F.when(part.rlike(r"^[\[{]") & framed(part), let(bare, lambda t: F.when(~F.contains(t, F.lit("\\")), let(F.split(t, '"'), read))))


def pred_texts(preds: DataFrame, key: list[str], value: str = "value", exact: bool = True) -> DataFrame:
    """G-22: key, section, pred from JSON texts of any education or experience shape. Work
    experience splits into descriptions and the rest."""
    flat = ("personal_info", "skills", "education")
    parts = bound(preds.select(*key, F.col(value).alias("_value")), **{f"_{k}": F.get_json_object("_value", f"$.{k}") for k in (*flat, "work_experience")})
    work = F.col("_work_experience")
    entries = F.from_json(F.when(F.startswith(F.ltrim(work), F.lit("{")), F.concat(F.lit("["), work, F.lit("]"))).otherwise(work), "array<map<string,string>>")
    # An object that has a key twice counts as JSON with this setting; its last value is Python's.
    once = preds.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys") != "true"
    read = bound(parts, _entries=entries, **{f"_{k}_t": leaves(F.col(f"_{k}")) if once else F.lit(None).cast("string") for k in flat})
    texts = lambda keep: F.array_join(F.flatten(F.transform("_entries", lambda e: F.transform(F.map_values(F.map_filter(e, keep)), lambda v: F.coalesce(v, F.lit(""))))), " ")
    sections = {k: F.coalesce(F.col(f"_{k}_t"), U.flatten_json(F.when(F.col(f"_{k}_t").isNull(), F.col(f"_{k}")))) for k in flat}
    sections["work_experience_info"] = texts(lambda k, v: k != "employment_description")
    sections["work_experience_description"] = texts(lambda k, v: k == "employment_description")
    present = {k: F.col("_work_experience" if k.startswith("work") else f"_{k}").isNotNull() for k in sections}
    rows = F.array(*[F.struct(F.lit(k).alias("section"), F.when(present[k], F.coalesce(t, F.lit(""))).alias("t")) for k, t in sections.items()])
    return read.select(*key, F.explode(rows).alias("r")).filter("r.t is not null").select(*key, "r.section", T.normalize_section(F.col("r.t"), exact).alias("pred"))


def cosine(a: Column, b: Column) -> Column:
    """K-14: cosine of two vectors; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def policy(gt: Column, pred: Column, empty_gt: str) -> Column:
    """R-24: "skip", "ends" (scored by the policy alone) or "score"."""
    if empty_gt not in POLICIES:
        raise ValueError(f"the policy is one of {', '.join(POLICIES)}, not {empty_gt!r}")
    both = T.is_empty_section(gt) & T.is_empty_section(pred)
    return F.when(both, "skip").when(T.is_empty_section(gt), "skip" if empty_gt == "skip" else "ends").otherwise("score")


def compare(pairs: DataFrame, empty_gt: str = "skip", similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """R-24, K-03, K-14: rows with gt and pred, scored: wer, similarity (by a pluggable
    encoder; null without one) and token counts. Where the ground truth is empty and the
    prediction isn't, ``soft`` gives similarity 1 and wer 0, ``penalize`` 0 and 1."""
    # Texts and words are made once a row, however often the measures ask for them.
    texts = bound(pairs, _g=F.coalesce("gt", F.lit("")), _p=F.coalesce("pred", F.lit("")))
    g, p = F.col("_g"), F.col("_p")
    fixed = 1.0 if empty_gt == "soft" else 0.0
    sim = similarity(g, p) if similarity else F.lit(None).cast("double")
    scored = bound(texts.withColumn("_how", policy(g, p, empty_gt)).filter("_how <> 'skip'"), _gw=T.split_words(g), _pw=T.split_words(p))
    wer = D.error_rate(D.word_levenshtein(F.col("_gw"), F.col("_pw")), F.size("_gw"), F.size("_pw"))
    return scored.select(
        *[c for c in pairs.columns],
        F.when(F.col("_how") == "ends", 1 - fixed).otherwise(wer).alias("wer"),
        F.when(F.col("_how") == "ends", fixed).otherwise(F.when((F.trim(g) == "") | (F.trim(p) == ""), 0.0).otherwise(sim)).alias("similarity"),
        F.size("_gw").cast("long").alias("gt_tokens"),
        F.size("_pw").cast("long").alias("pred_tokens"),
    )


def round4(c: Column) -> Column:
    return F.bround(c, 4)


def section_report(scored: DataFrame, per: list[str], section: str = "section") -> DataFrame:
    """R-17: means by (per, section) rounded to 4 places, then their means by section
    rounded again; token sums, their ratio up to 1, and how many contributed."""
    files = scored.groupBy(*per, section).agg(round4(F.avg("wer")).alias("w"), round4(F.avg("similarity")).alias("s"), F.sum("gt_tokens").alias("g"), F.sum("pred_tokens").alias("p"))
    ratio = F.least(F.lit(1.0), F.sum("p") / F.greatest(F.lit(1), F.sum("g")))
    return files.groupBy(section).agg(round4(F.avg("s")).alias("avg_semantic_similarity"), round4(F.avg("w")).alias("avg_wer"), F.sum("g").alias("gt_tokens"), F.sum("p").alias("pred_tokens"), round4(ratio).alias("brevity_penalty"), F.count("*").alias("files"))


def gt_sections(files: DataFrame, multi: bool = False, exact: bool = True) -> DataFrame:
    """R-07, G-20, G-21: name and the normalised text of each fixed section (``SECTIONS``'
    values) from ground-truth files (page_id, value: JSON with ``section``). With ``multi`` a
    document's pages are one, in the order of their names. A section that isn't there is ""."""
    items = F.from_json(F.get_json_object("value", "$.section"), "map<string,array<struct<transcription:string>>>")
    text = lambda s: F.array_join(F.transform(F.coalesce(F.try_element_at("_s", F.lit(s)), F.array().cast("array<struct<transcription:string>>")), lambda i: i["transcription"]), " ")
    rows = files.select("page_id", items.alias("_s")).select("page_id", *[text(s).alias(name) for s, name in SECTIONS.items()])
    if multi:
        pages = rows.withColumn("_n", F.regexp_replace("page_id", r"_page_\d+$", "")).groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("page_id", *SECTIONS.values()))).alias("_p"))
        rows = pages.select(F.col("_n").alias("page_id"), *[F.array_join(F.transform("_p", lambda p: p[n]), " ").alias(n) for n in SECTIONS.values()])
    return rows.select(F.col("page_id").alias("name"), *[T.normalize_section(F.col(n), exact).alias(n) for n in SECTIONS.values()])


def paired_sections(gt_files: DataFrame, pred_files: DataFrame, multi: bool = False, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """R-06, R-07: name, section, gt, pred of the five fixed sections of every ground-truth
    file (document, with ``multi``) that has a prediction of its name, "" where a side hasn't
    the section; and the names without a prediction. Files: page_id, value (JSON)."""
    gt = gt_sections(gt_files, multi, exact)
    known = pred_files.select(F.col("page_id").alias("name")).distinct()
    five = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("gt")) for n in SECTIONS.values()])).alias("s")
    sides = gt.join(known, "name", "left_semi").select("name", five).select("name", "s.*")
    preds = pred_texts(pred_files.select(F.col("page_id").alias("name"), "value"), ["name"], exact=exact)
    return sides.join(preds, ["name", "section"], "left").withColumn("pred", F.coalesce("pred", F.lit(""))), gt.join(known, "name", "left_anti").select("name")


def compare_json_files(gt_files: DataFrame, pred_files: DataFrame, empty_gt: str = "skip", similarity: Callable[[Column, Column], Column] | None = None, multi: bool = False, exact: bool = True) -> DataFrame:
    """R-27: name, section and its measures, rounded to 4 places: avg_wer,
    avg_semantic_similarity, token counts and brevity_penalty. A name has a section once."""
    scored = compare(paired_sections(gt_files, pred_files, multi, exact)[0], empty_gt, similarity)
    ratio = F.least(F.lit(1.0), F.col("pred_tokens") / F.greatest(F.lit(1), F.col("gt_tokens")))
    return scored.select("name", "section", round4(F.col("similarity")).alias("avg_semantic_similarity"), round4(F.col("wer")).alias("avg_wer"), "gt_tokens", "pred_tokens", round4(ratio).alias("brevity_penalty"))


def compare_json_directories(gt_files: DataFrame, pred_files: DataFrame, empty_gt: str = "skip", similarity: Callable[[Column, Column], Column] | None = None, multi: bool = False, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """R-27, R-17: ``compare_json_files`` of every pair, and the report by section over them."""
    files = compare_json_files(gt_files, pred_files, empty_gt, similarity, multi, exact)
    return files, section_report(files.withColumnsRenamed({"avg_wer": "wer", "avg_semantic_similarity": "similarity"}), ["name"])


_FAULTS = "array<struct<path:string,type:string>>"
#: An escaped half of a surrogate pair without its other half, which no text can hold.
_HALF = r"(?i)(?<!\\)(?:\\\\)*(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f])|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"


def sql_type(node: str | list | dict) -> str:
    """The type of a schema like ``RESUME``."""
    if isinstance(node, dict):
        return f"struct<{','.join(f'{k}:{sql_type(v)}' for k, v in node.items())}>"
    return f"array<{sql_type(node[0])}>" if isinstance(node, list) else "string"


def framed(text: Column) -> Column:
    """Whether a parser takes a text as one value and nothing else. It stops behind the first
    value; whatever could close one of the two frames early is an error in the other."""
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return inside("[", "]") & inside('{"value":', "}")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else."""
    return F.coalesce(framed(text) & ~text.rlike(_HALF), F.lit(False))


def checked(v: Column, node: str | list | dict, path: Column) -> tuple[Column, Column]:
    """Faults (path, type) of a VARIANT against a schema's node, and its value as that node:
    what is missing has its default, what the schema doesn't know is left out."""
    kind = F.coalesce(F.schema_of_variant(v), F.lit("missing"))
    none = F.array().cast(_FAULTS)
    fault = lambda name: F.array(F.struct(path.alias("path"), F.lit(name).alias("type"))).cast(_FAULTS)
    if isinstance(node, dict):
        inside = {k: checked(F.try_variant_get(v, f"$.{k}", "variant"), n, F.concat(path, F.when(path != "", F.lit(".")).otherwise(""), F.lit(k))) for k, n in node.items()}
        faults = F.when(kind == "missing", none).when(kind.startswith("OBJECT"), F.concat(*[f for f, _ in inside.values()])).otherwise(fault("model_type"))
        return faults, F.struct(*[d.alias(k) for k, (_, d) in inside.items()])
    if isinstance(node, list):
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        of = lambda x, i: checked(x, node[0], F.concat(path, F.lit("."), i.cast("string")))
        faults = F.when(kind == "missing", none).when(kind.startswith("ARRAY"), F.flatten(F.transform(items, lambda x, i: of(x, i)[0]))).otherwise(fault("list_type"))
        return faults, F.transform(items, lambda x, i: of(x, i)[1])
    return F.when(kind.isin("missing", "STRING"), none).otherwise(fault("string_type")), F.coalesce(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))


def validated(raw: DataFrame, value: str = "value", schema: dict = RESUME) -> DataFrame:
    """G-23: ``raw`` with ``data`` (of the schema), ``faults`` (path and type of each, in the
    schema's order) and ``error`` (null, "blank", "not JSON", or the faults as text). A
    text is checked node by node: a number, a flag, a null or a container where the schema
    has a text, a list or an object of its own is a fault; missing fields have their defaults
    and unknown ones are left out. An object that has a key twice isn't JSON, unless
    ``spark.sql.variant.allowDuplicateKeys`` is set: then the last counts."""
    blank = F.coalesce(F.regexp_replace(value, r"(?U)\s+", "") == "", F.lit(True))
    rows = raw.select(F.struct(*raw.columns).alias("_row"), F.when(~blank, F.when(is_json(F.col(value)), F.try_parse_json(value))).alias("_v"), blank.alias("_blank"))
    faults, data = checked(F.col("_v"), schema, F.lit(""))
    told = F.array_join(F.transform("_f", lambda f: F.concat_ws(": ", F.nullif(f["path"], F.lit("")), f["type"])), "; ")
    rows = rows.withColumns({"_f": F.when(F.col("_v").isNotNull(), faults), "_d": data})
    error = F.when(F.col("_blank"), "blank").when(F.col("_v").isNull(), "not JSON").when(F.size("_f") > 0, told)
    kept = [F.col("_row")[c].alias(c) for c in raw.columns if c not in ("error", "faults", "data")]
    rows = rows.withColumn("_e", error)
    return rows.select(*kept, F.col("_e").alias("error"), F.coalesce("_f", F.array().cast(_FAULTS)).alias("faults"), F.when(F.col("_e").isNull(), F.col("_d")).alias("data"))
