"""Queries over whole evaluations: public measures, directory comparison, model stages,
file sources and sinks, each end to end."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import bleu as B
from ..operators import edit_distance as D
from ..operators import evaluate as E
from ..operators import inference as I
from ..operators import relational as R
from ..operators import sections as S
from ..operators import tokens as K
from ..sources import files, ground_truth, sinks
from .registry import register
from .relation_queries import _NORM_MARKS, _TOK
from .source_queries import _literals, _turns
from .tables import scratch, table
from .text_queries import _ASCII, _GARBLED, _NORM, _sql_tokens, ascii_only, garbled, six


def lev_sql(source: str, keys: str) -> str:
    """CTEs ``lev`` and ``d`` (keys, g, h, d): Levenshtein distance of the lists g and h of
    ``source``, a row of the matrix at a time. A row's running minimum stands for insertions."""
    return f"""lev AS (SELECT {keys}, g, h, 0 AS i, range(0, len(h) + 1) AS r FROM {source} UNION ALL
  SELECT {keys}, g, h, i + 1, list_transform(range(0, len(h) + 1), lambda j: j + list_min(u[1 : j + 1])) FROM (
    SELECT *, list_transform(range(0, len(h) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(r[j + 1] + 1, r[j] + CASE WHEN g[i + 1] = h[j] THEN 0 ELSE 1 END) - j END) AS u FROM lev WHERE i < len(g))),
d AS (SELECT {keys}, g, h, r[len(h) + 1] AS d FROM lev WHERE i = len(g))"""


_RATE = "CASE WHEN len(g) > 0 THEN d / CAST(len(g) AS DOUBLE) WHEN len(h) > 0 THEN 1.0 ELSE 0.0 END"


@register("q_wer_items", f"WITH RECURSIVE t AS (SELECT item_id, {_sql_tokens(_ASCII)} AS g, CASE WHEN item_id % 9 = 0 THEN [] ELSE {_sql_tokens(_GARBLED.format(_ASCII))} END AS h FROM benchmark), {lev_sql('t', 'item_id')} SELECT item_id, floor({_RATE} * 1e6 + 0.5) / 1e6 AS wer FROM d")
def q_wer_items(spark, sf):
    """K-01."""
    t = table(spark, sf, "benchmark").select("item_id", ascii_only(F.col("text")).alias("gt"))
    hyp = F.when(F.col("item_id") % 9 == 0, "").otherwise(garbled(F.col("gt")))
    return t.select("item_id", six(D.wer(F.col("gt"), hyp)).alias("wer"))


@register(
    "q_public_wer_cer",
    rf"""WITH RECURSIVE t AS (SELECT item_id, {_sql_tokens(_ASCII)} AS g, {_sql_tokens(_GARBLED.format(_ASCII))} AS h,
  replace({_NORM.format(_ASCII)}, ' ', '') AS gc, replace({_NORM.format(_GARBLED.format(_ASCII))}, ' ', '') AS hc FROM benchmark),
{lev_sql('t', 'item_id, gc, hc')}
SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE floor({_RATE} * 1e6 + 0.5) / 1e6 END AS wer, CASE WHEN item_id % 5 = 0 THEN NULL ELSE floor(levenshtein(gc, hc) / CAST(length(gc) AS DOUBLE) * 1e6 + 0.5) / 1e6 END AS cer FROM d""",
)
def q_public_wer_cer(spark, sf):
    """R-27, R-03: predictions whose characters hold tags, as tables' do; some pages have no truth,
    some are annotated twice."""
    text = ascii_only(F.col("text"))
    items = table(spark, sf, "benchmark").select("item_id", text.alias("t"))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    pred = items.select("item_id", F.filter(F.split(garbled(F.col("t")), r"\s+"), lambda w: w != "").alias("words"), chars(F.concat(F.lit("<td>"), "t")).alias("characters"))
    truth = items.filter("item_id % 5 <> 0").select("item_id", T.split_words(F.col("t")).alias("words"), chars(F.col("t")).alias("characters"), F.lit(2).alias("ordinal"))
    old = items.filter("item_id % 2 = 0 and item_id % 5 <> 0").select("item_id", F.array(F.lit("old")).alias("words"), F.array(F.lit("x")).alias("characters"), F.lit(1).alias("ordinal"))
    rows = E.wer_cer(pred, truth.unionByName(old), "item_id")
    return rows.select("item_id", six(F.col("wer")).alias("wer"), six(F.col("cer")).alias("cer"))


def grams_sql(source: str, key: str) -> str:
    """CTE ``s``: key, hyp_len, ref_len, c1, t1 .. c4, t4 of the token lists r and h of ``source``."""
    per = lambda side: f"SELECT {key}, n, array_to_string(list_slice({side}, i, i + n - 1), chr(31)) AS g, count(*) AS c FROM (SELECT {key}, n, {side}, unnest(range(1, len({side}) - n + 2)) AS i FROM {source}, k WHERE len({side}) >= n) GROUP BY ALL"
    return f"""k AS (SELECT unnest([1, 2, 3, 4]) AS n), gr AS ({per('r')}), gh AS ({per('h')}),
m AS (SELECT {key}, n, sum(least(gh.c, gr.c)) AS c FROM gh JOIN gr USING ({key}, n, g) GROUP BY ALL), tt AS (SELECT {key}, n, sum(c) AS t FROM gh GROUP BY ALL),
pm AS (SELECT {key}, {', '.join(f'sum(c) FILTER (n = {n}) AS c{n}' for n in range(1, 5))} FROM m GROUP BY ALL), pt AS (SELECT {key}, {', '.join(f'sum(t) FILTER (n = {n}) AS t{n}' for n in range(1, 5))} FROM tt GROUP BY ALL),
s AS (SELECT {', '.join('b.' + c.strip() for c in key.split(','))}, len(h) AS hl, len(r) AS rl, {', '.join(f'CAST(coalesce({x}{n}, 0) AS DOUBLE) AS {x}{n}' for n in range(1, 5) for x in 'ct')} FROM {source} b LEFT JOIN pm USING ({key}) LEFT JOIN pt USING ({key}))"""


def bleu_sql(smooth: str) -> str:
    """Columns bp, p1 .. p4 and score of ``s``."""
    cols = []
    for n in range(1, 5):
        if smooth == "add1":
            cols.append(f"CASE WHEN t{n} > 0 THEN 100 * (c{n} + {int(n > 1)}) / (t{n} + {int(n > 1)}) ELSE 0 END AS p{n}")
        else:
            zeros = " + ".join(f"CASE WHEN c{i} = 0 AND t{i} > 0 THEN 1 ELSE 0 END" for i in range(1, n + 1))
            cols.append(f"CASE WHEN t{n} = 0 THEN 0 WHEN c{n} = 0 THEN 100 / (pow(2, {zeros}) * t{n}) ELSE 100 * c{n} / t{n} END AS p{n}")
    order = " + ".join(f"CASE WHEN t{n} > 0 THEN 1 ELSE 0 END" for n in range(1, 5))
    logs = " + ".join(f"CASE WHEN t{n} > 0 AND p{n} > 0 THEN ln(p{n}) ELSE 0 END" for n in range(1, 5))
    return f"""p AS (SELECT *, CASE WHEN hl >= rl THEN 1.0 WHEN hl = 0 THEN 0.0 ELSE exp(1 - CAST(rl AS DOUBLE) / hl) END AS bp, {', '.join(cols)} FROM s),
e AS (SELECT *, CASE WHEN c1 + c2 + c3 + c4 = 0 THEN 0.0 ELSE bp * exp(({logs}) / ({order})) END AS score FROM p)"""


_BLEU_ITEMS = f"t AS (SELECT item_id, {_sql_tokens(_ASCII)} AS r, CASE WHEN item_id % 7 = 0 THEN {_sql_tokens(_GARBLED.format(_ASCII))}[1 : 3] ELSE {_sql_tokens(_GARBLED.format(_ASCII))} END AS h FROM benchmark)"


@register("q_sentence_bleu", f"WITH {_BLEU_ITEMS}, {grams_sql('t', 'item_id')}, {bleu_sql('exp')} SELECT item_id, {', '.join(f'floor({c} * 1e6 + 0.5) / 1e6 AS {c}' for c in ('score', 'p1', 'p2', 'p3', 'p4', 'bp'))} FROM e")
def q_sentence_bleu(spark, sf):
    """K-06, K-08: each row's own score, precisions and brevity penalty; some readings stop early."""
    ref = ascii_only(F.col("text"))
    tokens = lambda c: T.split_words(T.normalize_text(c, exact=False))
    b = table(spark, sf, "benchmark").select("item_id", tokens(ref).alias("r"), tokens(garbled(ref)).alias("h"))
    b = b.withColumn("h", F.when(F.col("item_id") % 7 == 0, F.slice("h", 1, 3)).otherwise(F.col("h")))
    scores = B.sentence_bleu(b, ["item_id"], "r", "h")
    return scores.select("item_id", *[six(F.col(c)).alias(c) for c in ("score", "p1", "p2", "p3", "p4", "bp")])


_SPLIT = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


@register("q_mean_sentence_bleu", f"WITH t AS (SELECT conv_id, turn, {_SPLIT.format('text')} AS r, {_SPLIT.format(_GARBLED.format('text'))} AS h FROM conversations), {grams_sql('t', 'conv_id, turn')}, {bleu_sql('add1')} SELECT round(avg(score), 1) AS bleu FROM e")
def q_mean_sentence_bleu(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.split_words(F.col("text")).alias("r"), T.split_words(garbled(F.col("text"))).alias("h"))
    return B.mean_sentence_bleu(c, ["conv_id", "turn"], "r", "h").select(six(F.col("bleu")).alias("bleu"))


# Directory comparison.

_ROLES = {"user": "PERSONAL", "assistant": "EMP-INFO", "system": "SKILLS"}


def _truth_files(spark, sf) -> DataFrame:
    """A ground-truth file for each turn, its text under the role's section."""
    item = F.array(F.struct(F.col("text").alias("transcription")))
    section = F.create_map(*[x for r, n in _ROLES.items() for x in (F.when(F.col("role") == r, n).otherwise(f"-{n}"), item)])
    name = F.concat(F.col("conv_id").cast("string"), F.lit("_page_"), F.lpad(F.col("turn").cast("string"), 3, "0"))
    return table(spark, sf, "conversations").select(name.alias("page_id"), F.to_json(F.struct(section.alias("section"))).alias("value"))


def _predicted_files(spark, sf) -> DataFrame:
    """A prediction for most conversations: a word is missed, some sections are empty or made up."""
    c = table(spark, sf, "conversations").filter("conv_id % 7 <> 0").withColumn("said", F.replace("text", F.lit(" le "), F.lit(" ")))
    of = lambda r: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "said")))), lambda x: x["said"]), " ")
    docs = c.groupBy("conv_id").agg(*[of(r).alias(r) for r in _ROLES])
    skills = F.when(F.col("conv_id") % 2 == 1, F.array("system")).otherwise(F.array().cast("array<string>"))
    school = F.struct(F.array(F.struct(F.when(F.col("conv_id") % 3 == 0, "Some School, Élite").otherwise("N.A.").alias("institution"))).alias("degrees"))
    work = F.array(F.struct(F.col("assistant").alias("company"), F.lit("").alias("employment_description")))
    resume = F.struct(F.struct(F.col("user").alias("full_name")).alias("personal_info"), skills.alias("skills"), school.alias("education"), work.alias("work_experience"))
    return docs.select(F.col("conv_id").cast("string").alias("page_id"), F.to_json(resume).alias("value"))


_COMPARED = f"""c AS (SELECT conv_id, role, {_NORM_MARKS.format("string_agg(text, ' ' ORDER BY turn)")} AS g, {_NORM_MARKS.format("string_agg(replace(text, ' le ', ' '), ' ' ORDER BY turn)")} AS p FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id, role),
n AS (SELECT DISTINCT conv_id FROM c),
five AS (SELECT n.conv_id, 'personal_info' AS section, g, p FROM n LEFT JOIN c ON n.conv_id = c.conv_id AND role = 'user' UNION ALL SELECT n.conv_id, 'work_experience_info', g, p FROM n LEFT JOIN c ON n.conv_id = c.conv_id AND role = 'assistant'
  UNION ALL SELECT n.conv_id, 'skills', g, CASE WHEN n.conv_id % 2 = 1 THEN p ELSE '' END FROM n LEFT JOIN c ON n.conv_id = c.conv_id AND role = 'system'
  UNION ALL SELECT conv_id, 'education', '', CASE WHEN conv_id % 3 = 0 THEN 'some school elite' ELSE 'n a' END FROM n),
w AS (SELECT conv_id, section, coalesce(g, '') AS g, coalesce(p, '') AS p FROM five), pol AS (SELECT unnest(['skip', 'soft', 'penalize']) AS policy),
x AS (SELECT policy, conv_id, section, g = '' AS none, {_TOK.format('g')} AS gt, {_TOK.format('p')} AS pt, length(g) AS gl, length(p) AS pl FROM w, pol WHERE (g <> '' OR p <> '') AND NOT (g = '' AND policy = 'skip')),
f AS (SELECT policy, CAST(conv_id AS VARCHAR) AS name, section, round_even(CASE WHEN none THEN CASE policy WHEN 'soft' THEN 0.0 ELSE 1.0 END ELSE CAST(gt - pt AS DOUBLE) / gt END, 4) AS avg_wer,
  round_even(CASE WHEN none THEN CASE policy WHEN 'soft' THEN 1.0 ELSE 0.0 END ELSE CAST(pl AS DOUBLE) / gl END, 4) AS avg_semantic_similarity, gt AS gt_tokens, pt AS pred_tokens, round_even(least(1.0, CAST(pt AS DOUBLE) / greatest(1, gt)), 4) AS brevity_penalty FROM x)"""


def _each_policy(spark, sf, compared) -> DataFrame:
    out = None
    for policy in S.POLICIES:
        rows = compared(_truth_files(spark, sf), _predicted_files(spark, sf), policy, lambda g, p: F.length(p) / F.length(g), True)
        rows = (rows[1] if isinstance(rows, tuple) else rows).withColumn("policy", F.lit(policy))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("q_compare_files", f"WITH {_COMPARED} SELECT * FROM f")
def q_compare_files(spark, sf):
    """R-27, R-07, R-24: documents of many pages against predictions, by all three policies."""
    return _each_policy(spark, sf, S.compare_json_files)


@register(
    "q_compare_directories",
    f"""WITH {_COMPARED} SELECT policy, section, round_even(avg(avg_semantic_similarity), 4) AS avg_semantic_similarity, round_even(avg(avg_wer), 4) AS avg_wer, CAST(sum(gt_tokens) AS BIGINT) AS gt_tokens, CAST(sum(pred_tokens) AS BIGINT) AS pred_tokens,
round_even(least(1.0, CAST(sum(pred_tokens) AS DOUBLE) / greatest(1, sum(gt_tokens))), 4) AS brevity_penalty, CAST(count(*) AS BIGINT) AS files FROM f GROUP BY policy, section""",
)
def q_compare_directories(spark, sf):
    """R-27, R-17."""
    return _each_policy(spark, sf, S.compare_json_directories)


@register("q_unpaired_files", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS name FROM conversations WHERE conv_id % 7 = 0")
def q_unpaired_files(spark, sf):
    """R-06: documents without a prediction."""
    return S.paired_sections(_truth_files(spark, sf), _predicted_files(spark, sf), multi=True)[1]


# Names and files.


@register(
    "q_image_for_page",
    """WITH p AS (SELECT p_partkey AS k, 'D' || p_partkey AS base, 'D' || p_partkey || '_page_001' AS page_id FROM part),
l AS (SELECT base || '_page_001.tiff' AS name FROM p WHERE k % 4 = 0 UNION ALL SELECT base || '_page_001.jpg' FROM p WHERE k % 8 = 0 UNION ALL SELECT base || '.gif' FROM p WHERE k % 4 IN (0, 1) UNION ALL SELECT 'scan-d' || k || 'x.PNG' FROM p WHERE k % 4 = 2),
loose AS (SELECT page_id, min(name) AS name FROM p JOIN l ON contains(lower(name), lower(base)) WHERE k % 4 IN (2, 3) GROUP BY page_id)
SELECT page_id, '/i/' || CASE WHEN k % 8 = 0 THEN page_id || '.jpg' WHEN k % 4 = 0 THEN page_id || '.tiff' WHEN k % 4 = 1 THEN base || '.gif' ELSE loose.name END AS image FROM p LEFT JOIN loose USING (page_id)""",
)
def q_image_for_page(spark, sf):
    """G-13: by page, by document, by part of a name."""
    k = F.col("p_partkey")
    base = F.concat(F.lit("D"), k.cast("string"))
    page = F.concat(base, F.lit("_page_001"))
    parts = table(spark, sf, "part").select("p_partkey")
    names = F.array_compact(F.array(F.when(k % 4 == 0, F.concat(page, F.lit(".tiff"))), F.when(k % 8 == 0, F.concat(page, F.lit(".jpg"))), F.when((k % 4).isin(0, 1), F.concat(base, F.lit(".gif"))), F.when(k % 4 == 2, F.concat(F.lit("scan-d"), k.cast("string"), F.lit("x.PNG")))))
    listing = parts.select(F.explode(names).alias("name")).select(F.concat(F.lit("/i/"), "name").alias("path"))
    return files.image_for_page(parts.select(page.alias("page_id")), listing)


_CSV_RANKED = "r AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n FROM lineitem)"


def _as_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


@register("q_csv_ground_truth", f"WITH {_CSV_RANKED} SELECT 'P' || l_orderkey AS page_id, string_agg(l_returnflag || l_partkey || ' it''s', ' ' ORDER BY n) AS words, CAST(sum(l_partkey) AS DOUBLE) AS x FROM r GROUP BY l_orderkey")
def q_csv_ground_truth(spark, sf):
    """SRC-01, T-29, G-14: a CSV with Python literals, quotes of both kinds in them."""
    rows = _literals(spark, sf)
    single = lambda c: F.replace(c, F.lit('"'), F.lit("'"))
    literal = F.regexp_replace("transcription", '"([^",\\[\\]]*)"', "\"$1 it's\"")
    path = scratch(spark, "ground-truth-csv")
    _as_csv(rows.select("ocr", literal.alias("transcription"), *[single(F.col(c)).alias(c) for c in ("bbox", "reading_order", "section")]), path)
    p = ground_truth.pages(ground_truth.read_csv(spark, path))
    return p.select("page_id", F.array_join("words", " ").alias("words"), F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b[0]).alias("x"))


@register(
    "q_list_cer",
    f"""WITH {_CSV_RANKED}, p AS (SELECT l_orderkey, lower(string_agg(l_returnflag || l_partkey, '' ORDER BY n)) AS g, lower(string_agg(l_returnflag || l_partkey, '' ORDER BY n DESC)) AS h, lower('[' || string_agg(chr(39) || l_returnflag || l_partkey || chr(39), ',' ORDER BY n) || ']') AS raw FROM r GROUP BY l_orderkey)
SELECT l_orderkey, floor(levenshtein(g, h) / CAST(length(g) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS lists, floor(levenshtein(g, raw) / CAST(length(g) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS literal FROM p""",
)
def q_list_cer(spark, sf):
    """K-02: lists of words against lists, and against a list's literal that was read as text,
    brackets, quotes and commas counting as characters."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"))
    pages = table(spark, sf, "lineitem").select("l_orderkey", row.alias("r")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("r"))
    words = F.transform("r", lambda x: F.concat(x["flag"], x["l_partkey"].cast("string")))
    literal = F.concat(F.lit("['"), F.array_join("w", "', '"), F.lit("']"))
    rates = pages.select("l_orderkey", words.alias("w")).select("l_orderkey", D.cer(F.col("w"), F.reverse("w"), True, True).alias("lists"), D.cer(F.col("w"), literal, True, False).alias("literal"))
    return rates.select("l_orderkey", six(F.col("lists")).alias("lists"), six(F.col("literal")).alias("literal"))


@register("q_csv_predictions", f"WITH {_CSV_RANKED} SELECT 'P' || l_orderkey AS filename, string_agg(l_returnflag || l_partkey, '|' ORDER BY n) AS words, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY l_orderkey")
def q_csv_predictions(spark, sf):
    """SRC-02: a CSV of predictions with list columns."""
    rows = _literals(spark, sf)
    path = scratch(spark, "predictions-csv")
    _as_csv(rows.select(T.gt_filename(F.col("ocr")).alias("filename"), F.replace("transcription", F.lit('"'), F.lit("'")).alias("words")), path)
    p = ground_truth.read_predictions(spark, path)
    return p.select("filename", F.array_join("words", "|").alias("words"), F.size("words").cast("long").alias("n"))


@register("q_reading_order_lines", "WITH r AS (SELECT l_orderkey, l_returnflag || l_partkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n FROM lineitem) SELECT string_agg(t, ' ' ORDER BY n) AS source, string_agg(t, ' ' ORDER BY n DESC) AS target, CAST(count(*) AS BIGINT) AS boxes FROM r GROUP BY l_orderkey")
def q_reading_order_lines(spark, sf):
    """SRC-16: gzipped JSON lines, written and read; targets put texts in order (T-26)."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"))
    pages = table(spark, sf, "lineitem").select("l_orderkey", row.alias("r")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("r"))
    texts = F.transform("r", lambda x: F.concat(x["flag"], x["l_partkey"].cast("string")))
    place = F.transform("r", lambda x, i: F.size("r") - i)
    path = scratch(spark, "reading-order")
    pages.select(F.transform("r", lambda x: F.array(*[x["l_linenumber"]] * 4)).alias("source_boxes"), place.alias("target_index"), texts.alias("source_texts"), F.reverse(texts).alias("target_texts")).write.option("compression", "gzip").json(path)
    got = files.reading_order_lines(spark, path)
    order = F.transform(F.array_sort(F.transform("target_index", lambda t, i: F.struct(t.alias("t"), i.alias("i")))), lambda x: x["i"])
    return got.select(F.array_join("source_texts", " ").alias("source"), F.array_join(T.reordered_words(F.col("source_texts"), order), " ").alias("target"), F.size("source_boxes").cast("long").alias("boxes"))


@register("q_whole_files", "SELECT CAST(count(*) FILTER (n_nationkey % 5 <> 0) AS BIGINT) AS good, CAST(count(*) FILTER (n_nationkey % 5 = 0) AS BIGINT) AS rejected, CAST(sum(n_regionkey) FILTER (n_nationkey % 5 <> 0) AS BIGINT) AS regions FROM nation")
def q_whole_files(spark, sf):
    """SRC-03, SRC-10, SNK-04: one JSON file a row is written, some are cut short, all are read."""
    whole = F.to_json(F.struct("n_name", "n_regionkey"))
    rows = table(spark, sf, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("n_nationkey") % 5 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value"))
    path = scratch(spark, "files")
    rows.repartition("name").write.partitionBy("name").text(path)
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "name=([^/]*)/", 1).alias("page_id"), F.col("_metadata.file_path").alias("path"), "value")
    good, bad = files.good_and_rejected(texts, "n_name string, n_regionkey int")
    strict = files.strict_json(good.select("page_id", "path", "value"), "n_name string, n_regionkey int")
    return strict.agg(F.count("*").alias("good"), F.sum("data.n_regionkey").alias("regions")).crossJoin(bad.agg(F.count("*").alias("rejected")))


@register("q_written_files", "SELECT 'n' || n_nationkey AS key, 'ok' AS status, n_name FROM nation")
def q_written_files(spark, sf):
    """SNK-01 to SNK-06: a file for each key, read back."""
    path = scratch(spark, "written")
    rows = sinks.json_rows(table(spark, sf, "nation").withColumn("key", F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))), "key", F.struct("n_name", "n_regionkey"))
    told = scratch(spark, "written-status")
    rows.transform(sinks.write_files, path).write.parquet(told)
    status = spark.read.schema("key string, status string").parquet(told)
    read = files.whole_texts(spark, path).select(F.col("page_id").alias("key"), F.get_json_object("value", "$.n_name").alias("n_name"))
    return status.join(read, "key")


# Text and page functions that no other query runs.


@register("q_clean_text", "SELECT conv_id, turn, md5(replace(replace(text, chr(10), ' '), chr(9), ' ')) AS digest FROM conversations")
def q_clean_text(spark, sf):
    """T-14."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.clean_text(F.replace("text", F.lit("\r"), F.lit("")))).alias("digest"))


@register("q_flatten_words", "SELECT CAST(conv_id AS VARCHAR) AS page_id, md5(string_agg(w, '|' ORDER BY turn, i)) AS digest FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations WHERE turn % 4 <> 3) WHERE regexp_matches(w, '\\S') GROUP BY conv_id")
def q_flatten_words(spark, sf):
    """T-12: lines that aren't there are left out."""
    lines = F.transform("turns", lambda t: F.when(t["turn"] % 4 != 3, t["text"]))
    w = _turns(spark, sf).select("page_id", T.flatten_words(lines).alias("w")).filter(F.size("w") > 0)
    return w.select("page_id", F.md5(F.array_join("w", "|")).alias("digest"))


@register("q_normalize_words", rf"SELECT item_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '{r'[!-/:-@\[-`{-~¿¡“”«»—–·…]'.replace(chr(39), chr(39) * 2)}', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM benchmark")
def q_normalize_words(spark, sf):
    """T-03, T-01: with the normal form and without marks."""
    return table(spark, sf, "benchmark").select("item_id", T.normalize_words(F.col("text")).alias("norm"))


@register("q_cid_and_hyphens", "SELECT conv_id, turn, replace(lower(role), 'e', 'é') || conv_id || 'b fi x' || turn AS norm FROM conversations")
def q_cid_and_hyphens(spark, sf):
    """T-01: character ids, hyphenated line ends, ligatures and composed letters."""
    marked = F.replace(F.col("role"), F.lit("e"), F.lit("é"))
    text = F.concat(marked, F.lit("(cid:12)-\n "), F.col("conv_id").cast("string"), F.lit("b ﬁ "), F.lit(" x-\n"), F.col("turn").cast("string"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_text(text).alias("norm"))


@register("q_file_names", "SELECT page_id, 'doc' || page_id || CASE WHEN page_id % 2 = 0 THEN '.v2' ELSE '' END AS stem, 'doc' || page_id || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '' END AS safe FROM pages")
def q_file_names(spark, sf):
    """T-21, T-23."""
    own = F.concat(F.lit("doc"), F.col("page_id").cast("string"))
    path = F.concat(F.lit("/a.b/c/"), own, F.when(F.col("page_id") % 2 == 0, ".v2").otherwise(""), F.lit(".json"))
    name = F.concat(own, F.when(F.col("page_id") % 3 == 0, ".txt").when(F.col("page_id") % 3 == 1, ".JPEG").otherwise(".tif"))
    return table(spark, sf, "pages").select("page_id", T.stem(path).alias("stem"), T.safe_stem(name).alias("safe"))


@register("q_html_table_texts", "SELECT n_nationkey, [n_name, 'a b', 'R' || n_regionkey, '<>', '7'] AS texts FROM nation")
def q_html_table_texts(spark, sf):
    """T-09: empty cells and single signs but digits are left out."""
    html = F.concat(F.lit("<table><tr><td>"), "n_name", F.lit("</td><td> a b </td></tr><tr><td></td><td><b>R"), F.col("n_regionkey").cast("string"), F.lit("</b>&lt;&gt;</td><td>7</td><td>x</td></tr></table>"))
    return table(spark, sf, "nation").select("n_nationkey", T.html_table_texts(html).alias("texts"))


@register("q_reordered_words", "SELECT CAST(conv_id AS VARCHAR) AS page_id, md5(string_agg(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), '|'), '|' ORDER BY turn DESC)) AS digest FROM conversations GROUP BY conv_id")
def q_reordered_words(spark, sf):
    """T-25, T-26: pages' texts backwards; places beyond the list are skipped."""
    order = F.concat(F.array(F.lit(99)), F.reverse(F.sequence(F.lit(0), F.size("turns") - 1)), F.array(F.lit(-1)))
    words = T.reordered_words(F.transform("turns", lambda t: t["text"]), order)
    return _turns(spark, sf).select("page_id", F.md5(F.array_join(words, "|")).alias("digest"))


_BOX = "CAST(l_partkey % 90 AS DOUBLE) AS x1, CAST(l_suppkey % 80 AS DOUBLE) AS y1, l_partkey % 90 + CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END AS x2, l_suppkey % 80 + l_linenumber * 0.01 AS y2"


@register("q_norm_boxes", f"WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_BOX} FROM lineitem), r AS (SELECT *, {', '.join(f'CAST(greatest(0, least(1000, round_even({c} * (1000.0 :: DOUBLE / {s}), 0))) AS INTEGER) AS {n}' for c, s, n in (('x1', 90, 'a'), ('y1', 80, 'b'), ('x2', 90, 'c'), ('y2', 80, 'd')))} FROM b) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a AS x1, b AS y1, CASE WHEN c <= a THEN least(1000, a + 1) ELSE c END AS x2, CASE WHEN d <= b THEN least(1000, b + 1) ELSE d END AS y2 FROM r")
def q_norm_boxes(spark, sf):
    """G-09: boxes without width or height get one."""
    x, y = (F.col("l_partkey") % 90).cast("double"), (F.col("l_suppkey") % 80).cast("double")
    box = F.array(x, y, x + F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_quantity")), y + F.col("l_linenumber") * 0.01)
    n = G.norm_boxes_1000(F.array(box), F.lit(90), F.lit(80))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n[0].alias("n")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col("n")[i].cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


#: Documents of one page each in odd conversations, of all turns in even ones.
_ONE_PAGE = "CAST(conv_id AS VARCHAR) || CASE WHEN conv_id % 2 = 1 THEN '.' || CAST(turn AS VARCHAR) ELSE '' END"


@register("q_unify_one_page", f"SELECT {_ONE_PAGE} AS doc, string_agg(text, ' ' ORDER BY turn) AS text, CASE WHEN count(*) = 1 THEN any_value(role) ELSE '[\"' || string_agg(role, '\",\"' ORDER BY turn) || '\"]' END AS role FROM conversations GROUP BY doc")
def q_unify_one_page(spark, sf):
    """R-14: scalars of a document of one page stay scalars."""
    c = table(spark, sf, "conversations").select(F.expr(_ONE_PAGE.replace("VARCHAR", "STRING")).alias("doc"), "turn", "role", F.array("text").alias("lines"))
    d = R.unify_documents(c, ["lines"], ["role"], "doc", "turn", one_page="scalar")
    return d.select("doc", F.array_join("lines", " ").alias("text"), "role")


@register("q_length_batches", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, TRUE AS sorted, TRUE AS bounded FROM documents")
def q_length_batches(spark, sf):
    """R-26: every row is in a batch, no batch is larger than asked for, and within a
    part lengths never rise from batch to batch."""
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"))
    batches = R.length_batches(docs, "chars", 16).groupBy("part", "batch").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("chars").alias("low"), F.max("chars").alias("high"))
    after = batches.select("part", (F.col("batch") - 1).alias("batch"), F.col("high").alias("next"))
    joined = batches.join(after, ["part", "batch"], "left")
    return joined.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.coalesce(F.min(F.col("low") >= F.col("next")), F.lit(True)).alias("sorted"), (F.max("n") <= 16).alias("bounded"))


@register("q_metric_columns", "SELECT engine, CAST(count(*) AS BIGINT) AS pages, floor(avg(a) * 1e6 + 0.5) / 1e6 AS ratio_all, floor(avg(a) FILTER (n > 20) * 1e6 + 0.5) / 1e6 AS ratio_long FROM (SELECT 'e' || turn % 3 AS engine, length(role) / CAST(length(text) AS DOUBLE) AS a, length(text) AS n FROM conversations) GROUP BY engine")
def q_metric_columns(spark, sf):
    """R-16, R-22: measures of several kinds side by side, missing ones left out of the means."""
    ratio = F.length("role") / F.length("text")
    rows = table(spark, sf, "conversations").select(F.concat(F.lit("e"), (F.col("turn") % 3).cast("string")).alias("engine"), ratio.alias("ratio_all"), F.when(F.length("text") > 20, ratio).otherwise(F.lit(float("nan"))).alias("ratio_long"))
    return E.means(rows, ["engine"], ["ratio_all", "ratio_long"]).select("engine", "pages", *[six(F.col(c)).alias(c) for c in ("ratio_all", "ratio_long")])


# Models and services, by engines that are plain functions.


def _box_pages(spark, sf) -> DataFrame:
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"))
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), row.alias("r")).groupBy("page_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    y = lambda x: (x["l_suppkey"] % 80).cast("double")
    return pages.select("page_id", F.transform("r", lambda x: F.concat(x["flag"], x["l_partkey"].cast("string"))).alias("texts"), F.transform("r", lambda x: F.array(F.lit(1.0), y(x), F.lit(50.0), y(x) + 5)).alias("boxes"))


def _order_engine():
    def call(input_ids, bbox, attention_mask) -> str:
        tops = [int(b[1]) for b in list(bbox)[1:-1]]
        assert len(input_ids) == len(attention_mask) == len(tops) + 2
        rank = {i: k for k, i in enumerate(sorted(range(len(tops)), key=lambda i: (tops[i], i)))}
        return json.dumps([[-abs(k - rank[i]) for k in range(len(tops))] for i in range(len(tops))])

    return call


@register("q_reading_order_stage", "WITH r AS (SELECT l_orderkey, l_returnflag || l_partkey AS t, l_suppkey % 80 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n FROM lineitem WHERE l_orderkey % 9 <> 0) SELECT l_orderkey AS page_id, 'ok' AS status, string_agg(t, ' ' ORDER BY y, n) AS words FROM r GROUP BY l_orderkey UNION ALL SELECT DISTINCT l_orderkey, 'error', NULL FROM lineitem WHERE l_orderkey % 9 = 0")
def q_reading_order_stage(spark, sf):
    """U-07: boxes joined, scaled and padded, a model's logits decoded, words in its order;
    images without boxes are errors of their rows."""
    pages = _box_pages(spark, sf)
    images = pages.select("page_id", F.lit(100).alias("width"), F.lit(100).alias("height"))
    some = pages.filter("page_id % 9 <> 0")
    out = I.reading_order(images, [some.filter("page_id % 2 = 0"), some], _order_engine, on_missing="error")
    return out.select("page_id", "status", F.array_join("words", " ").alias("words"))


_NAMES = ["A", "N", "R"]


def _label_engine():
    from folioscore.operators.tokens import label_maps

    places = label_maps(_NAMES)[1]

    def call(words, boxes) -> str:
        ids, logits = [None], [[9.0, 0, 0, 0]]
        for i, w in enumerate(words):
            if w.endswith("7"):
                continue  # a word without sub-tokens
            want = "O" if w.endswith("3") else w[0]
            strong, weak = [0.0] * 4, [0.4] * 4
            strong[places[want]], weak[(places[want] + 1) % 4] = 3.0, 1.0
            ids, logits = [*ids, i, i], [*logits, strong, weak]
        return json.dumps({"word_ids": [*ids, None], "logits": [*logits, [9.0, 0, 0, 0]]})

    return call


@register("q_token_labels", "SELECT l_returnflag AS gt, CASE WHEN l_partkey % 10 IN (3, 7) THEN 'O' ELSE l_returnflag END AS pred, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def q_token_labels(spark, sf):
    """U-04, K-15, G-24, K-20: pages through a token classifier, sub-tokens pooled, counts of
    true and predicted labels."""
    pages = _box_pages(spark, sf).withColumnRenamed("texts", "words")
    rows = I.token_labels(pages, _label_engine, K.label_maps(_NAMES)[0])
    return K.confusion(rows.withColumn("truth", F.substring("word", 1, 1)), "truth", "label")


def _vision_engine():
    def call(image, prompt) -> str:
        name = bytes(image).decode()
        kind = int(name.split(":")[0]) % 4
        if kind == 1:
            raise RuntimeError("the model is away")
        return {0: f'Sure: {{"skills": ["{prompt}", "{name}"]}} Done.', 2: "I can't read this.", 3: '{"personal_info": {"email": 5}}'}[kind]

    return call


@register("q_page_stage", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'ok' ELSE 'error' END AS status, CASE event_id % 4 WHEN 0 THEN ['List skills', event_id || ':' || event_type] END AS skills, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'RuntimeError: the model is away' WHEN 3 THEN 'personal_info.email: string_type' ELSE '' END AS error FROM events")
def q_page_stage(spark, sf):
    """U-08, T-24, G-23, SNK-07: images and a prompt, answers in prose, failures, wrong types."""
    images = table(spark, sf, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type").cast("binary").alias("image"))
    out = I.page_stage(images, "List skills", _vision_engine, "event_id", threads=2)
    return out.select("id", F.when(F.size("data.skills") > 0, "ok").otherwise("error").alias("status"), F.when(F.size("data.skills") > 0, F.col("data.skills")).alias("skills"), F.when((F.col("status") == "ok") & (F.size("data.skills") == 0), "").otherwise(F.col("error")).alias("error"))


def _document_engine():
    def call(images, prompt, num_predict) -> str:
        return json.dumps({"skills": [*(bytes(i).decode() for i in images), str(num_predict)]})

    return call


@register("q_document_stage", "SELECT 'c' || conv_id AS id, 'ok' AS status, string_agg(role, '|' ORDER BY turn) || '|' || least(12000, 4000 + 2000 * count(*)) AS skills FROM conversations GROUP BY conv_id")
def q_document_stage(spark, sf):
    """U-09: pages of a document in order, with their budget."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_page_"), F.col("turn").cast("string"))
    images = table(spark, sf, "conversations").select(name.alias("filename"), F.col("role").cast("binary").alias("image"))
    out = I.document_stage(images, "All pages", _document_engine)
    return out.select("id", "status", F.array_join("data.skills", "|").alias("skills"))


def _submit(text):
    return {"text": text, "asked": 0}


def _poll(job):
    job["asked"] += 1
    return None if job["asked"] < 3 else job["text"][::-1]


@register("q_polled_jobs", "SELECT n_nationkey AS id, 'ok' AS status, reverse(n_name) AS data FROM nation")
def q_polled_jobs(spark, sf):
    """SRC-14: jobs are submitted and asked for until they have a result."""
    rows = I.run(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("text")), "n_nationkey", ["text"], I.polled(_submit, _poll, interval=0.001), threads=4)
    return rows.select("id", "status", "data")
