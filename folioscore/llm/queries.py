"""The registered queries of this subpackage: each applies its operator, with
production parameters, to its whole table. ``oracle_sql`` has DuckDB SQL where
SQL can express the operator; the others are tested against brute force."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bitslice, bpe, content_sort, divergence, edits, mixing, quality, quotes, secrets, simhash, token_files
from .common import staged, table

BYTE_BPE = "byte_bpe_50k.json"
QUALITY_CUT = 0.3


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_BPE), end_id=0)
    return token_files.read_in_order(spark, path)


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "in_place",
    )


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = staged(edits.trees(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)), "trees")
    todo = state.withColumn("edits", edits.sample_edits(F.col("text"), F.col("doc_id")))
    after = edits.apply_edits(todo, public_tokenizers.path(BYTE_BPE))
    return after.select("doc_id", F.col("tokens_before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), "n_edits", "reencoded_chars", F.sha2("text", 256).alias("edited_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = staged(quality.counted(table(spark, sf_dir, "documents")), "counts")
    model = quality.train(measured, table(spark, sf_dir, "labels"))
    scored = measured.select("doc_id", quality.score_of(F.col("c"), model).alias("score"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0).alias("predicted"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_inner_products(table(spark, sf_dir, "embeddings"), k=20, query_every=20, scale=64.0)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [F.size(secrets.of_kind("base", k)).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.digest("base"), 256).alias("base_sha256"), secrets.digest("spans").alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, budget=4)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(mixing.plan(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), most=3))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, ranks=200)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_bpe_encode_decode, op3_nearest_neighbours, op4_token_counts, op5_quality, op6_exact_top_k, op7_secrets, op8_simhash, op9_mixing, op10_quotation_linking, op11_divergence, op12_exact_dedup)}


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


#: Lines, passages and links as the operator's docstring has them; texts stand for their hashes.
OP10_SQL = r"""
WITH RECURSIVE
m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
d AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:> ?)+'), '[^>]', '', 'g')) AS depth, lower(regexp_replace(line, '^(?:> ?)+', '')) AS bare,
        lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM l WINDOW w AS (PARTITION BY id ORDER BY i)),
a AS (SELECT *, regexp_matches(line, '^[^>]+ wrote:[ \t]*$') AND coalesce(l1 LIKE '>%', FALSE) AS attr1,
        regexp_matches(line, '^[^>]+ wrote:[ \t]*$') AND coalesce(l1 = '' AND l2 LIKE '>%', FALSE) AS attr2 FROM d),
k AS (SELECT *, coalesce(lag(attr2) OVER w, FALSE) AS gone, sum(CASE WHEN depth = p THEN 0 ELSE 1 END) OVER w AS run FROM (SELECT *, lag(depth) OVER (PARTITION BY id ORDER BY i) AS p FROM a) WINDOW w AS (PARTITION BY id ORDER BY i)),
o AS (SELECT id, string_agg(CASE WHEN attr1 OR attr2 THEN '' ELSE line END, chr(10) ORDER BY i) FILTER (depth = 0 AND NOT gone) AS own, max(depth) AS deepest FROM k GROUP BY id),
c AS (SELECT m.id, conv_id, turn, role, regexp_replace(CASE WHEN deepest > 0 THEN regexp_replace(coalesce(own, ''), '\n{3,}', chr(10) || chr(10), 'g') ELSE text END, '^\s+|\s+$', '', 'g') AS content FROM m JOIN o USING (id)),
pieces AS (
  SELECT conv_id, turn, content AS t, FALSE AS is_line FROM c
  UNION ALL SELECT conv_id, turn, unnest(string_split_regex(content, '\n\s*\n')), FALSE FROM c
  UNION ALL SELECT conv_id, turn, unnest(string_split(content, chr(10))), TRUE FROM c),
keys AS (SELECT conv_id, turn, is_line, trim(regexp_replace(lower(regexp_replace(t, '(?m)^(?:> ?)+', '', 'g')), '\s+', ' ', 'g')) AS t FROM pieces WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
known AS (SELECT conv_id, t, min(turn) AS first FROM keys WHERE t <> '' AND (NOT is_line OR regexp_matches(t, '^(\S+ ){2}\S')) GROUP BY conv_id, t),
q AS (SELECT conv_id, turn, trim(regexp_replace(string_agg(bare, chr(10) ORDER BY i), '\s+', ' ', 'g')) AS t, 2 * depth AS ord FROM k WHERE depth > 0 GROUP BY id, conv_id, turn, run, depth
  UNION ALL SELECT conv_id, turn, trim(regexp_replace(bare, '\s+', ' ', 'g')), 2 * depth + 1 FROM k WHERE depth > 0 AND regexp_matches(trim(regexp_replace(bare, '\s+', ' ', 'g')), '^(\S+ ){2}\S')),
found AS (SELECT q.conv_id, q.turn, q.ord, first FROM q JOIN known ON q.conv_id = known.conv_id AND q.t = known.t AND first < q.turn),
best AS (SELECT conv_id, turn, first AS reply_to, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord, first DESC) AS n FROM found),
links AS (SELECT conv_id, turn, reply_to FROM best WHERE n = 1),
walk AS (SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM links UNION ALL SELECT w.conv_id, w.turn, x.reply_to, w.depth + 1 FROM walk w JOIN links x ON w.conv_id = x.conv_id AND w.root = x.turn),
ends AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM walk GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, links.reply_to, coalesce(ends.root, c.turn) AS thread, CAST(coalesce(ends.depth, 0) AS BIGINT) AS depth, c.content,
  '<|' || coalesce(c.role, 'unknown') || '|>' || chr(10) || c.content || chr(10) || '<|end|>' || chr(10) AS formatted
FROM c LEFT JOIN links ON c.conv_id = links.conv_id AND c.turn = links.turn LEFT JOIN ends ON c.conv_id = ends.conv_id AND c.turn = ends.turn
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT *, CAST(1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // CAST(sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS HUGEINT) AS BIGINT) AS p FROM x),
l AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // CAST(sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang) AS HUGEINT) AS BIGINT) AS q FROM l),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
alone AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM alone))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents),
k AS (SELECT doc_id, c, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY c) AS group_size FROM d WINDOW w AS (PARTITION BY c ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(c) AS text_sha256 FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_top_k": OP6_SQL, "op10_quotation_linking": OP10_SQL, "op11_divergence": OP11_SQL, "op12_exact_dedup": OP12_SQL}
