"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; ``run`` writes each to the shared folder as Parquet and reads
it again, and deletes a stage's files once the next has been written. All but the last
return the columns of documents.

Rows, in every stage: columns beside doc_id, source and text are handed on as they are,
whatever their names (n_chars follows the text where a stage changes it). Nulls in any
column, empty and very long texts, repeated rows and empty tables are as the stages'
docstrings have them; none fails.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.llm import bpe, jaccard, mixing, quality, secrets
from folioscore.llm.common import bounded_batches, dropped, staged, table
from folioscore.llm.queries import BYTE_BPE, QUALITY_CUT


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with n_chars (where there is one) that of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below the cut go. A null text counts as an empty
    one; repeated rows are judged alike; columns of any name are kept as they are."""
    bounded_batches(spark)
    model = quality.train(quality.counted(docs), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    kept = quality.score(rows, model, "_score").filter(F.col("_score") >= QUALITY_CUT)
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of documents with a Jaccard similarity of 0.8 or more over five-word
    shingles, and chains of such, one stays: the smallest doc_id's (a null id only where
    there is no other), at a tie of ids the smallest hash of text and row. Null, empty and
    blank texts are copies of each other."""
    bounded_batches(spark)
    return jaccard.deduplicated(docs, width=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every span is masked, overlapping ones by one mask; the documents stay,
    as often as they are there. Null and empty texts have no spans."""
    return _counted(secrets.redacted(docs), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the texts the mix takes, a row for each epoch of a document and shard, by shard
    and shuffled inside it. Null, empty and blank texts have no words and aren't drawn; each
    of repeated rows is drawn on its own; a null source is a source, the last."""
    named = ("doc_id", "source", "text")
    rest = F.struct(F.lit(0).alias("none"), *[c for c in docs.columns if c not in named])
    laid = mixing.laid_out(mixing.mixed(mixing.plan(docs.select(*named, rest.alias("rest")), keep=True)))
    return _counted(laid.select(*[F.col(c) if c in named else F.col("rest")[c].alias(c) for c in docs.columns]), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: doc_id, n_tokens, ids and the text decoded from them, of every row (a null text:
    no ids, an empty text)."""
    bounded_batches(spark)
    coded = bpe.encode_decode(docs, public_tokenizers.path(BYTE_BPE))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", keep_good), ("near_dedup", drop_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can't express the classifier, the similarity join, the splitting tree or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
