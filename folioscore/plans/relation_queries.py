"""Queries over joins, groupings, JSON, sections, labels and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..functions.binding import bound
from ..operators import relational as R
from ..operators import sections as S
from ..operators import tokens as K
from ..sources import files
from ..sources import sinks
from .registry import register
from .tables import table
from .text_queries import six


@register("q_doc_group_concat", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, CAST(count(*) AS INTEGER) AS pages FROM conversations GROUP BY conv_id")
def q_doc_group_concat(spark, sf):
    c = table(spark, sf, "conversations").withColumn("lines", F.array("text"))
    d = R.unify_documents(c, ["lines"], ["role"], "conv_id", "turn")
    return d.select("conv_id", F.array_join("lines", " ").alias("text"), F.size("role").alias("pages"))


@register("q_page_to_doc_join", "SELECT conv_id, CAST(count(*) AS BIGINT) AS pages, o_orderstatus FROM conversations JOIN orders ON conv_id = o_orderkey GROUP BY conv_id, o_orderstatus")
def q_page_to_doc_join(spark, sf):
    pages = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"))
    return pages.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("conv_id"), "o_orderstatus"), "conv_id")


@register("q_skipped_pages", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_skipped_pages(spark, sf):
    return R.pair_and_skip(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])[1]


@register("q_pairs", "SELECT doc_id, quality, length(text) :: BIGINT AS chars FROM documents JOIN labels USING (doc_id)")
def q_pairs(spark, sf):
    both = R.pair_and_skip(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])[0]
    return both.select("doc_id", "quality", F.length("text").cast("long").alias("chars"))


@register("q_dedupe_keep_first", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def q_dedupe_keep_first(spark, sf):
    hashed = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return R.keep_first(hashed, ["digest"], "doc_id").select("doc_id", "digest")


@register("q_last_wins_lookup", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC) AS n FROM lineitem) SELECT o_orderkey, l_partkey, l_quantity FROM orders LEFT JOIN l ON o_orderkey = l_orderkey AND n = 1")
def q_last_wins_lookup(spark, sf):
    last = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey")
    return R.lookup(orders, last, ["o_orderkey"], "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").select("o_orderkey", "l_partkey", "l_quantity")


@register("q_positional_join", "WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) SELECT o_orderkey, c_custkey FROM a JOIN b USING (n)")
def q_positional_join(spark, sf):
    return R.positional_join(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "customer").select("c_custkey"), "o_orderkey", "c_custkey")


@register("q_first_match", "WITH f AS (SELECT doc_id, 'labels' AS src FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) SELECT DISTINCT doc_id, src FROM f")
def q_first_match(spark, sf):
    bad = table(spark, sf, "labels").filter("quality = 0").select("doc_id", F.lit("labels").alias("src"))
    return R.first_match([bad, table(spark, sf, "documents").select("doc_id", F.lit("documents").alias("src"))], ["doc_id"], "src")


@register("q_key_remap", "SELECT n_nationkey, CASE n_name WHEN 'NATION_3' THEN 'FR' WHEN 'NATION_11' THEN 'DE' ELSE n_name END AS n_name FROM nation")
def q_key_remap(spark, sf):
    alias = spark.createDataFrame([("NATION_3", "FR"), ("NATION_11", "DE"), ("NATION_99", "XX")], "alias string, name string")
    return R.remap(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.broadcast(alias), "n_name")


@register("q_union_engines", "SELECT 'labels' AS engine, doc_id FROM labels UNION ALL SELECT 'documents', doc_id FROM documents")
def q_union_engines(spark, sf):
    tag = lambda n: table(spark, sf, n).select(F.lit(n).alias("engine"), "doc_id")
    return tag("labels").unionByName(tag("documents"))


@register("q_pivot_metrics", "SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (event_type = '{t}') AS BIGINT) AS {t}" for t in ("click", "view", "purchase")) + " FROM events GROUP BY user_id")
def q_pivot_metrics(spark, sf):
    kinds = ["click", "view", "purchase"]
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


@register("q_topk_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 105")
def q_topk_recent(spark, sf):
    """The listing's newest 105; the limit is the feature."""
    listing = table(spark, sf, "orders").select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 20, "0"), F.lit(".png")).alias("path"), F.col("o_orderdate").alias("modified"), "o_orderkey")
    return files.newest(listing, 105).select("o_orderkey", F.col("modified").alias("o_orderdate"))


@register("q_status_envelope", "SELECT CAST(count(*) FILTER (value >= 10) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT value >= 10 OR value IS NULL) AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS total FROM events")
def q_status_envelope(spark, sf):
    rows = table(spark, sf, "events").withColumn("error", F.when(F.coalesce(F.col("value") >= 10, F.lit(False)), F.lit(None)).otherwise("small"))
    return sinks.envelope_counts(sinks.envelope(rows, "event_id", "props", "error"))


@register("q_json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def q_json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@register("q_json_reject", "SELECT CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS good, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS rejected FROM events")
def q_json_reject(spark, sf):
    """Every third text is cut short; strict reading must reject just those."""
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("value"))
    ok = e.select(U.is_strict_json("value").alias("ok"))
    return ok.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("rejected"))


@register("q_json_from_text", """SELECT event_id, props AS json FROM events""")
def q_json_from_text(spark, sf):
    return table(spark, sf, "events").select("event_id", T.json_from_text(F.concat(F.lit("Sure, here it is: "), "props", F.lit(" Done."))).alias("json"))


#: T-02 in SQL, with and without the removal of marks.
_NORM_MARKS = r"trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@register("q_gt_section_export", f"SELECT conv_id, role AS section, {_NORM.format('''string_agg(text, ' ' ORDER BY turn)''')} AS gt FROM conversations GROUP BY conv_id, role")
def q_gt_section_export(spark, sf):
    return S.gt_texts(table(spark, sf, "conversations").withColumn("o", F.lit(1)), ["conv_id"], "turn", "role", "o", "text", exact=False)


@register("q_gt_section_export_exact", f"SELECT conv_id, role AS section, {_NORM_MARKS.format('''string_agg(text, ' ' ORDER BY turn)''')} AS gt FROM conversations GROUP BY conv_id, role")
def q_gt_section_export_exact(spark, sf):
    return S.gt_texts(table(spark, sf, "conversations").withColumn("o", F.lit(1)), ["conv_id"], "turn", "role", "o", "text")


_TOK = r"CAST(len(list_filter(string_split({0}, ' '), lambda w: w <> '')) AS BIGINT)"


def _policy_sql(norm: str) -> str:
    """Predictions lack some words of the truth, so the distance is how many."""
    return f"""WITH n AS (SELECT conv_id, turn, {norm.format('text')} AS g FROM conversations),
p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE g END AS g, CASE WHEN turn % 4 = 2 THEN '' ELSE replace(g, ' le ', ' ') END AS p FROM n),
w AS (SELECT *, {_TOK.format('g')} AS gt_tokens, {_TOK.format('p')} AS pred_tokens FROM p)
SELECT conv_id, turn, CASE WHEN g = '' THEN 1.0 ELSE CAST(gt_tokens - pred_tokens AS DOUBLE) / gt_tokens END AS wer, gt_tokens, pred_tokens FROM w WHERE g <> '' OR p <> ''"""


@register("q_empty_policy", _policy_sql(_NORM))
def q_empty_policy(spark, sf):
    return _empty_policy(spark, sf, False)


@register("q_empty_policy_exact", _policy_sql(_NORM_MARKS))
def q_empty_policy_exact(spark, sf):
    return _empty_policy(spark, sf, True)


def _empty_policy(spark, sf, exact):
    norm = bound(table(spark, sf, "conversations").select("conv_id", "turn", "text"), n=T.normalize_section(F.col("text"), exact=exact))
    pred = F.when(F.col("turn") % 4 == 2, "").otherwise(F.replace("n", F.lit(" le "), F.lit(" ")))
    pairs = norm.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("n")).alias("gt"), pred.alias("pred"))
    return S.compare(pairs, "penalize").select("conv_id", "turn", "wer", "gt_tokens", "pred_tokens")


@register(
    "q_section_report",
    f"""WITH n AS (SELECT conv_id, role, {_NORM_MARKS.format('text')} AS g FROM conversations), p AS (SELECT *, replace(g, ' le ', ' ') AS p FROM n),
w AS (SELECT conv_id, role, {_TOK.format('g')} AS gt, {_TOK.format('p')} AS pt, length(p) / CAST(length(g) AS DOUBLE) AS sim FROM p WHERE g <> ''),
f AS (SELECT conv_id, role, round_even(avg(CAST(gt - pt AS DOUBLE) / gt), 4) AS w, round_even(avg(sim), 4) AS s, sum(gt) AS gt, sum(pt) AS pt FROM w GROUP BY conv_id, role)
SELECT role AS section, round_even(avg(s), 4) AS avg_semantic_similarity, round_even(avg(w), 4) AS avg_wer, CAST(sum(gt) AS BIGINT) AS gt_tokens, CAST(sum(pt) AS BIGINT) AS pred_tokens, round_even(least(1.0, CAST(sum(pt) AS DOUBLE) / greatest(1, sum(gt))), 4) AS brevity_penalty, CAST(count(*) AS BIGINT) AS files FROM f GROUP BY role""",
)
def q_section_report(spark, sf):
    norm = bound(table(spark, sf, "conversations").select("conv_id", F.col("role").alias("section"), "text"), gt=T.normalize_section(F.col("text"))).drop("text")
    pairs = norm.withColumn("pred", F.replace("gt", F.lit(" le "), F.lit(" ")))
    return S.section_report(S.compare(pairs, "soft", lambda g, p: F.length(p) / F.length(g)), ["conv_id"])


@register("q_section_names", "SELECT CASE role WHEN 'user' THEN 'personal_info' WHEN 'assistant' THEN 'work_experience_info' ELSE 'OTHER' END AS section, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1")
def q_section_names(spark, sf):
    """The fixed names as a five-row table joined by broadcast; other names stay."""
    labels = F.when(F.col("role") == "user", "PERSONAL").when(F.col("role") == "assistant", "EMP-INFO").otherwise("OTHER")
    names = spark.createDataFrame(list(S.SECTIONS.items()), "label string, name string")
    c = table(spark, sf, "conversations").withColumn("label", labels).join(F.broadcast(names), "label", "left")
    return c.groupBy(F.coalesce("name", "label").alias("section")).agg(F.count("*").alias("n"))


@register("q_cosine_pairs", "SELECT a.vec_id, floor(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", six(S.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


_LABELS = "l AS (SELECT quality AS g, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS p FROM labels)"


def _labels(spark, sf):
    return table(spark, sf, "labels").select("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("said"))


@register("q_confusion", f"WITH {_LABELS} SELECT g AS gt, p AS pred, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY g, p")
def q_confusion(spark, sf):
    return K.confusion(_labels(spark, sf), "quality", "said")


@register(
    "q_classification_report",
    f"""WITH {_LABELS}, k AS (SELECT unnest([0, 1]) AS k), s AS (SELECT k, 1.0 * count(*) FILTER (g = k AND p = k) AS tp, count(*) FILTER (g = k) AS sup, count(*) FILTER (p = k) AS said FROM l, k GROUP BY k),
r AS (SELECT CAST(k AS VARCHAR) AS label, CAST(tp AS DOUBLE) / said AS precision, CAST(tp AS DOUBLE) / sup AS recall, 2 * CAST(tp AS DOUBLE) / (said + sup) AS f1, sup, tp FROM s),
u AS (SELECT label, precision, recall, f1, sup FROM r UNION ALL SELECT 'accuracy', sum(tp) / sum(sup), sum(tp) / sum(sup), sum(tp) / sum(sup), sum(sup) FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(sup) FROM r UNION ALL SELECT 'weighted avg', sum(precision * sup) / sum(sup), sum(recall * sup) / sum(sup), sum(f1 * sup) / sum(sup), sum(sup) FROM r)
SELECT label, {', '.join(f'floor(CAST({c} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {c}' for c in ('precision', 'recall', 'f1'))}, CAST(sup AS BIGINT) AS support FROM u""",
)
def q_classification_report(spark, sf):
    r = K.classification_report(_labels(spark, sf), "quality", "said")
    return r.select("label", *[six(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("q_mean_pool_argmax", "WITH e AS (SELECT label, unnest(embedding) :: DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, i) AS n FROM m) SELECT label, CAST(i AS INTEGER) AS label_id FROM r WHERE n = 1")
def q_mean_pool_argmax(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit(1).alias("doc"), "label", F.col("embedding").cast("array<double>").alias("logits"))
    return K.mean_pool_argmax(e, ["doc"], "label", "logits").select("label", "label_id")


#: Boxes take places, losers of a shared place their next best, in rounds.
_EIGHT = "[1, 2, 3, 4, 5, 6, 7, 8]"
_DECODE = f"""m AS (SELECT vec_id, list_transform(range(0, 8), lambda i: list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x :: DOUBLE)) AS m FROM embeddings),
r AS (SELECT vec_id, m, list_transform(m, lambda l: list_transform(list_reverse_sort(list_transform(l, lambda x, k: {{'v': x, 'k': k}})), lambda s: s.k)) AS r FROM m),
dec AS (SELECT vec_id, m, r, [1, 1, 1, 1, 1, 1, 1, 1] AS d, 0 AS it FROM r UNION ALL
  SELECT vec_id, m, r, nd, it + 1 FROM (SELECT vec_id, m, r, d, it, list_transform({_EIGHT}, lambda i: d[i] + CASE WHEN len(list_filter({_EIGHT}, lambda j: j <> i AND r[j][d[j]] = r[i][d[i]] AND (m[j][r[i][d[i]]] > m[i][r[i][d[i]]] OR (m[j][r[i][d[i]]] = m[i][r[i][d[i]]] AND j < i)))) > 0 THEN 1 ELSE 0 END) AS nd FROM dec) WHERE nd <> d),
p AS (SELECT vec_id, list_transform({_EIGHT}, lambda i: r[i][d[i]] - 1) AS p FROM (SELECT vec_id, any_value(r) AS r, arg_max(d, it) AS d FROM dec GROUP BY vec_id))"""


@register("q_order_decode", f"WITH RECURSIVE {_DECODE} SELECT vec_id, array_to_string(p, ',') AS places, len(list_distinct(p)) < 8 AS repeated FROM p")
def q_order_decode(spark, sf):
    """64 components as eight rows of eight logits."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8).cast("array<double>"))
    d = table(spark, sf, "embeddings").select("vec_id", K.decode_order(rows).alias("o"))
    return d.select("vec_id", F.array_join(F.col("o").cast("array<string>"), ",").alias("places"), K.has_duplicates(F.col("o")).alias("repeated"))


@register("q_word_runs", "SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), '|') AS words FROM benchmark")
def q_word_runs(spark, sf):
    """Words put together from single characters with boxes."""
    chars = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("text"), i.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (i + 1).cast("double").alias("x2"), F.lit(1.0).alias("y2")))
    w = T.words_from_chars(chars, F.lit(None))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.transform(w, lambda x: x["text"]), "|").alias("words"))
