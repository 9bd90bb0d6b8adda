"""Queries over text functions and text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.binding import bound
from ..operators import bleu as B
from ..operators import edit_distance as D
from ..operators import evaluate as E
from ..operators import relational as R
from .registry import register
from .tables import spread, table

#: SQL of T-01 without normal forms, of ASCII text.
_PUNCT = r"[!-/:-@\[-`{-~¿¡“”«»—–·…]"


def six(c: Column) -> Column:
    """Six decimals, the same way in any engine."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def garbled(text: Column) -> Column:
    """A hypothesis that depends on the text alone: what a reader of bad scans might make of it."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.replace(text, F.lit("in"), F.lit("m")), F.lit("the"), F.lit("teh")), r"er ", "er"), r"\.", "")


_GARBLED = r"regexp_replace(regexp_replace(replace(replace({0}, 'in', 'm'), 'the', 'teh'), 'er ', 'er', 'g'), '\.', '', 'g')"


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def _lines(spark, sf):
    """Every line of every document with its garbled reading."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.select("doc_id", "lang", "pos", ascii_only(F.col("line")).alias("gt")).withColumn("hyp", garbled(F.col("gt")))


_LINES_SQL = rf"""
lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
pairs AS (SELECT doc_id, lang, pos, regexp_replace(line, '[^\x00-\x7F]', '?', 'g') AS gt FROM lines),
both_texts AS (SELECT *, {_GARBLED.format("gt")} AS hyp FROM pairs)"""
_NORM = rf"trim(regexp_replace(lower({{0}}), '\s+', ' ', 'g'))"


@register(
    "q_cer_by_lang",
    rf"""WITH {_LINES_SQL},
c AS (SELECT lang, replace({_NORM.format("gt")}, ' ', '') AS g, replace({_NORM.format("hyp")}, ' ', '') AS h FROM both_texts),
d AS (SELECT lang, length(g) AS n, levenshtein(g, h) AS d, CASE WHEN length(g) > 0 THEN levenshtein(g, h) / CAST(length(g) AS DOUBLE) WHEN length(h) > 0 THEN 1.0 ELSE 0.0 END AS cer FROM c)
SELECT lang, CAST(count(*) AS BIGINT) AS lines, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(d) AS BIGINT) AS edits, floor(avg(cer) * 1e6 + 0.5) / 1e6 AS cer FROM d GROUP BY lang""",
)
def q_cer_by_lang(spark, sf):
    pairs = _lines(spark, sf)
    g, h = (T.lowered(F.col(c), exact=False) for c in ("gt", "hyp"))
    d = bound(pairs.select("lang", g.alias("g"), h.alias("h")), d=D.text_distances(F.col("g"), F.col("h"), words=False)).select("lang", "d.*")
    rate = D.error_rate(F.col("chars_apart"), F.col("chars_ref"), F.col("chars_hyp"))
    return d.groupBy("lang").agg(F.count("*").alias("lines"), F.sum("chars_ref").cast("long").alias("chars"), F.sum("chars_apart").cast("long").alias("edits"), six(F.avg(rate)).alias("cer"))


@register("q_wer_by_lang")
def q_wer_by_lang(spark, sf):
    docs = spread(table(spark, sf, "documents")).select("lang", F.coalesce("text", F.lit("")).alias("gt")).withColumn("hyp", garbled(F.col("gt")))
    return D.rates(docs, F.col("gt"), F.col("hyp")).groupBy("lang").agg(six(F.avg("wer")).alias("wer"), six(F.avg("cer")).alias("cer"), F.count("*").alias("pages"))


@register("q_ndld_char", rf"""WITH t AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS a FROM benchmark), p AS (SELECT item_id, a, {_GARBLED.format("a")} AS b FROM t)
SELECT item_id, CAST(damerau_levenshtein(a, b) AS INTEGER) AS distance, floor(damerau_levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS ndld FROM p""")
def q_ndld_char(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", ascii_only(F.col("text")).alias("a")).withColumn("b", garbled(F.col("a")))
    n = t.select("item_id", D.ndld(T.char_sequence(F.col("a"), False), T.char_sequence(F.col("b"), False)).alias("n"))
    return n.select("item_id", "n.distance", six(F.col("n.ndld")).alias("ndld"))


@register("q_ndld_word")
def q_ndld_word(spark, sf):
    t = spread(table(spark, sf, "documents")).select("doc_id", "lang", "text")
    seq = [T.word_sequence(c, False) for c in (F.col("text"), garbled(F.col("text")))]
    n = t.select("lang", D.ndld(*seq).alias("n"))
    return n.groupBy("lang").agg(six(F.avg("n.ndld")).alias("ndld"), F.sum("n.distance").cast("long").alias("distance"))


def _sql_tokens(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({x}), '{_PUNCT.replace(chr(39), chr(39) * 2)}', ' ', 'g'), '\\s+', ' ', 'g')"
    return f"list_filter(string_split({plain}, ' '), lambda w: w <> '')"


_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')"
_BLEU_SQL = rf"""
t AS (SELECT item_id, {_sql_tokens(_ASCII)} AS r, {_sql_tokens(_GARBLED.format(_ASCII))} AS h FROM benchmark),
n AS (SELECT unnest([1, 2, 3, 4]) AS n),
gr AS (SELECT item_id, n, array_to_string(list_slice(r, i, i + n - 1), chr(31)) AS g, count(*) AS c FROM (SELECT item_id, n, r, unnest(range(1, len(r) - n + 2)) AS i FROM t, n WHERE len(r) >= n) GROUP BY ALL),
gh AS (SELECT item_id, n, array_to_string(list_slice(h, i, i + n - 1), chr(31)) AS g, count(*) AS c FROM (SELECT item_id, n, h, unnest(range(1, len(h) - n + 2)) AS i FROM t, n WHERE len(h) >= n) GROUP BY ALL),
m AS (SELECT item_id, n, sum(least(gh.c, gr.c)) AS c FROM gh JOIN gr USING (item_id, n, g) GROUP BY ALL),
tt AS (SELECT item_id, n, sum(c) AS t FROM gh GROUP BY ALL),
s AS (SELECT t.item_id, len(h) AS hyp_len, len(r) AS ref_len, {", ".join(f"coalesce((SELECT c FROM m WHERE m.item_id = t.item_id AND n = {k}), 0) AS c{k}, coalesce((SELECT t FROM tt WHERE tt.item_id = t.item_id AND n = {k}), 0) AS t{k}" for k in range(1, 5))} FROM t)"""


def _bleu_pairs(spark, sf):
    ref = ascii_only(F.col("text"))
    b = table(spark, sf, "benchmark").select("item_id", ref.alias("r"), garbled(ref).alias("h"))
    tokens = lambda c: T.split_words(T.normalize_text(F.col(c), exact=False))
    return b.select("item_id", tokens("r").alias("ref_tokens"), tokens("h").alias("hyp_tokens"))


@register("q_bleu_page", f"WITH {_BLEU_SQL} SELECT item_id, CAST(hyp_len AS BIGINT) AS hyp_len, CAST(ref_len AS BIGINT) AS ref_len, {', '.join(f'CAST({k}{n} AS BIGINT) AS {k}{n}' for n in range(1, 5) for k in 'ct')} FROM s")
def q_bleu_page(spark, sf):
    return B.page_stats(_bleu_pairs(spark, sf), ["item_id"], "ref_tokens", "hyp_tokens")


@register(
    "q_bleu_corpus",
    f"""WITH {_BLEU_SQL}, a AS (SELECT {', '.join(f'sum({k}{n}) AS {k}{n}' for n in range(1, 5) for k in 'ct')}, sum(hyp_len) AS hl, sum(ref_len) AS rl FROM s)
SELECT floor(CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - CAST(rl AS DOUBLE) / hl) END * exp(({' + '.join(f'ln(100.0 * CAST(c{n} AS DOUBLE) / t{n})' for n in range(1, 5))}) / 4) * 1e6 + 0.5) / 1e6 AS score,
floor(CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - CAST(rl AS DOUBLE) / hl) END * 1e6 + 0.5) / 1e6 AS bp, floor(100.0 * CAST(c1 AS DOUBLE) / t1 * 1e6 + 0.5) / 1e6 AS p1, floor(100.0 * CAST(c4 AS DOUBLE) / t4 * 1e6 + 0.5) / 1e6 AS p4 FROM a""",
)
def q_bleu_corpus(spark, sf):
    pairs = _bleu_pairs(spark, sf).withColumn("engine", F.lit("garbled"))
    return E.corpus_bleu(pairs, ["engine"], ["item_id"]).select(*[six(F.col(c)).alias(c) for c in ("score", "bp", "p1", "p4")])


@register("q_bleu_documents")
def q_bleu_documents(spark, sf):
    docs = spread(table(spark, sf, "documents")).select("doc_id", "lang", "text").withColumn("hyp", garbled(F.col("text")))
    tokens = lambda c: T.split_words(T.normalize_text(F.col(c)))
    pairs = docs.select("lang", "doc_id", tokens("text").alias("ref_tokens"), tokens("hyp").alias("hyp_tokens"))
    return E.corpus_bleu(pairs, ["lang"], ["doc_id"])


@register("q_normalize_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def q_normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_section(F.col("text"), exact=False).alias("norm"))


@register("q_normalize_text_exact", r"SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def q_normalize_text_exact(spark, sf):
    """T-02 with its normal form."""
    return spread(table(spark, sf, "documents")).select("doc_id", T.normalize_section(F.col("text")).alias("norm"))


@register("q_normalize_punct", rf"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '{_PUNCT.replace(chr(39), chr(39) * 2)}', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM benchmark")
def q_normalize_punct(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.normalize_text(F.col("text"), exact=False).alias("norm"))


@register("q_word_split", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents")
def q_word_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.split_words(F.col("text"))).cast("long").alias("words"))


@register(
    "q_smart_tokenize",
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '([(\[{])\s+', '\1', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '\s+([.,;:!?|\])}])', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(t, '\s+(-)\s+', '\1', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM b) SELECT doc_id, CAST(len(w) AS BIGINT) AS words, md5(array_to_string(w, '|')) AS digest FROM c""",
)
def q_smart_tokenize(spark, sf):
    w = T.smart_tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", "|")).alias("digest"))


@register("q_markdown_clean", r"SELECT conv_id, turn, regexp_replace('  ## ' || text, '^\s*#+\s*', '') AS line FROM conversations")
def q_markdown_clean(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.strip_heading(F.concat(F.lit("  ## "), "text")).alias("line"))


@register("q_edge_trim_words", r"SELECT item_id, list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}_À-ÿ]+|[^\p{L}\p{N}_À-ÿ]+$', '', 'g')), lambda w: w <> '') AS words FROM benchmark")
def q_edge_trim_words(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.edge_trimmed_words(F.col("text")).alias("words"))


@register("q_plain_string", "SELECT item_id, array_to_string(list_filter(string_split(text, ''), lambda c: c <> ''), '') AS chars, array_to_string(string_split(text, ' '), ' ') AS words FROM benchmark")
def q_plain_string(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.to_plain_string(T.char_sequence(F.col("text"), False)).alias("chars"), T.to_plain_string(F.split("text", " ")).alias("words"))


@register("q_char_repr", r"SELECT item_id, CAST(length('[''' || array_to_string(w, ''', ''') || ''']') AS BIGINT) AS chars FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM benchmark)")
def q_char_repr(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(T.char_sequence(T.split_words(F.col("text")), True)).cast("long").alias("chars"))


@register("q_names", r"SELECT page_id, CASE WHEN contains(url, '=') THEN list_extract(string_split(list_extract(string_split(url, '='), -1), '/'), -1) ELSE list_extract(string_split(url, '-'), -1) END AS name, 'doc_page_' || page_id AS page, CAST(page_id AS INTEGER) AS num FROM pages")
def q_names(spark, sf):
    page = F.concat(F.lit("doc_page_"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", T.gt_filename(F.col("url")).alias("name"), F.concat(T.cv_id(page), F.lit("_page_"), T.page_number(page).cast("string")).alias("page"), T.page_number(page).alias("num"))


@register("q_html_b_tags", "SELECT page_id, md5(replace(replace(html, '<b>', ''), '</b>', '')) AS digest FROM pages")
def q_html_b_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.clean_b_tags(F.col("html"))).alias("digest"))


@register("q_html_text")
def q_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_table_texts(F.col("html")).alias("t")).select("page_id", F.size("t").alias("texts"), F.md5(F.array_join("t", "|")).alias("digest"))


@register(
    "q_engine_means",
    rf"""WITH {_LINES_SQL}, e AS (SELECT 'plain' AS engine, doc_id, gt, gt AS hyp FROM both_texts UNION ALL SELECT 'garbled', doc_id, gt, hyp FROM both_texts)
SELECT engine, floor(avg(CASE WHEN length(gt) > 0 THEN 1.0 * length(hyp) / length(gt) END) * 1e6 + 0.5) / 1e6 AS ratio, CAST(count(*) AS BIGINT) AS pages FROM e GROUP BY engine""",
)
def q_engine_means(spark, sf):
    p = _lines(spark, sf)
    both = p.select(F.explode(F.array(F.struct(F.lit("plain").alias("engine"), F.col("gt").alias("hyp")), F.struct(F.lit("garbled").alias("engine"), "hyp"))).alias("e"), "gt").select("e.*", "gt")
    rated = both.withColumn("ratio", F.when(F.length("gt") > 0, F.length("hyp") / F.length("gt")).otherwise(F.lit(float("nan"))))
    return E.means(rated, ["engine"], ["ratio"]).select("engine", six(F.col("ratio")).alias("ratio"), "pages")


@register("q_both_empty", "SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0 OR turn % 2 <> 0")
def q_both_empty(spark, sf):
    ref, hyp = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role"))
    return table(spark, sf, "conversations").filter(R.not_both_empty(ref, hyp)).select("conv_id", "turn")
