"""The jobs as registered queries: each runs its job twice over the whole tables, into one
new folder, and returns what stands there after the second run.

What engines have read isn't among the tables: Spark derives it from them and writes it to
the same folder first, as files that a job takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.plans.box_queries import _match_sql
from folioscore.plans.evaluation_queries import _RATE
from folioscore.plans.tables import scratch, table
from folioscore.plans.text_queries import _GARBLED, _NORM, _sql_tokens, garbled, six

from . import layout_report, score_predictions


#: Lines are sentences here.
_ENDS = "[.!?\n]"


def _readings(docs: DataFrame) -> DataFrame:
    """Two engines' readings of every line: one garbles words, the other loses those before commas."""
    lines = score_predictions.true_lines(docs, _ENDS).select("doc_id", "line", F.col("truth").alias("t"))
    by = F.array(F.struct(F.lit("garbling").alias("engine"), garbled(F.col("t")).alias("text")), F.struct(F.lit("terse").alias("engine"), F.regexp_replace("t", r"[a-z]+,", "").alias("text")))
    return lines.select("doc_id", "line", F.explode(by).alias("r")).select("r.engine", "doc_id", "line", "r.text")


def job1_score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "job1")
    _readings(table(spark, sf_dir, "documents")).write.parquet(f"{folder}/predictions")
    for _ in range(2):
        rows = score_predictions.run(spark, f"{folder}/predictions", f"{sf_dir}/documents.parquet", f"{folder}/scores", f"{folder}/report", f"{folder}/checkpoint", split_at=_ENDS)
    return rows.select("engine", "lang", "doc_id", "line", six(F.col("wer")).alias("wer"), six(F.col("cer")).alias("cer"))


#: DuckDB compares bytes: letters beyond ASCII stand as capitals, which small letters leave
#: free, and a line's words as signs: one for each word that both sides have, one for all others of a side.
_LETTERS = "translate({0}, 'ñßêçíüöóäèé', 'ABCDEFGHIJK')"
_SIGNS = "array_to_string(list_transform({0}, lambda x: CASE WHEN list_contains(c, x) THEN chr(CAST(2 + list_position(c, x) AS INTEGER)) ELSE chr({1}) END), '')"

JOB1_SQL = rf"""
WITH l AS (SELECT doc_id, lang, unnest(string_split_regex(coalesce(text, ''), '{_ENDS}')) AS t, generate_subscripts(string_split_regex(coalesce(text, ''), '{_ENDS}'), 1) - 1 AS line FROM documents),
p AS (SELECT 'garbling' AS engine, doc_id, lang, line, t, {_GARBLED.format("t")} AS h FROM l UNION ALL SELECT 'terse', doc_id, lang, line, t, regexp_replace(t, '[a-z]+,', '', 'g') FROM l),
w AS (SELECT engine, doc_id, lang, line, {_sql_tokens("t")} AS g, {_sql_tokens("h")} AS h, {_LETTERS.format(f"replace({_NORM.format('t')}, ' ', '')")} AS gc, {_LETTERS.format(f"replace({_NORM.format('h')}, ' ', '')")} AS hc FROM p),
c AS (SELECT *, list_intersect(list_distinct(g), list_distinct(h)) AS c FROM w),
d AS (SELECT *, levenshtein({_SIGNS.format("g", 1)}, {_SIGNS.format("h", 2)}) AS d FROM c)
SELECT engine, lang, doc_id, CAST(line AS INTEGER) AS line, floor({_RATE} * 1e6 + 0.5) / 1e6 AS wer,
  floor(CASE WHEN length(gc) > 0 THEN levenshtein(gc, hc) / CAST(length(gc) AS DOUBLE) WHEN length(hc) > 0 THEN 1.0 ELSE 0.0 END * 1e6 + 0.5) / 1e6 AS cer FROM d
"""


def job2_layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are pages, their lines are boxes; an engine's boxes are a little to the right."""
    folder = scratch(spark, "job2")
    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.struct(*keys).alias("place"), (F.col("l_partkey") % 90).cast("double").alias("x"), (F.col("l_suppkey") % 80).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("w"), (F.col("l_linenumber") * 5).cast("double").alias("h")
    )
    shift = F.col("place.l_linenumber") % 4
    items.write.parquet(f"{folder}/truth")
    items.filter("place.l_linenumber <> 2").select("page_id", "place", (F.col("x") + shift).alias("x"), "y", "w", "h", F.col("place.l_extendedprice").alias("score")).write.parquet(f"{folder}/predictions")
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderdate").alias("day")).write.parquet(f"{folder}/pages")
    for _ in range(2):
        rows = layout_report.run(spark, f"{folder}/truth", f"{folder}/pages", f"{folder}/predictions", f"{folder}/metrics", f"{folder}/report")
    return rows.select("year", "month", F.col("page_id").alias("l_orderkey"), *[six(F.col(c)).alias(c) for c in rows.columns if c not in ("year", "month", "page_id")])


_COLUMNS = {"TP": "tp", "FP": "fp", "FN": "fn", "Precision": "p", "Recall": "r", "F1": "f1", "mAP": "ap"}

JOB2_SQL = f"""
WITH RECURSIVE {_match_sql("l_extendedprice")}
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, l_orderkey,
  {", ".join(f"floor(max({c}) FILTER (thr = {t}) * 1e6 + 0.5) / 1e6 AS {m.lower()}_{n}" for t, n in ((0.5, 50), (0.75, 75)) for m, c in _COLUMNS.items())}
FROM r JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate IS NOT NULL GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_score_predictions, job2_layout_report)}


def oracle_sql() -> dict[str, str]:
    return {"job1_score_predictions": JOB1_SQL, "job2_layout_report": JOB2_SQL}
