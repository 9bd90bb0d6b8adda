import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioscore.llm import content_sort as S
from folioscore.llm import queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of (doc_id, text), by a dictionary."""
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in SPACE), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for c, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(c.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in S.classes(df).collect()), key=str)


def some_rows():
    r = random.Random(5)
    words = ["a", "b", "ç", "\U0001f600", "\x00", "\x1f", "\x85", " "]
    rows = [(i, "".join(r.choice(words) + r.choice(["", " ", "\n", "\x0b"]) for _ in range(r.randint(0, 3)))) for i in range(300)]
    rows += [(i, "same head " * 50 + str(i % 3)) for i in range(300, 360)]  # contents alike beyond the splitters' bytes
    rows += [(400, None), (401, ""), (402, " \t\r\n\x0b\x0c"), (None, "x y"), (None, "xy"), (403, "x  y"), (404, "x y"), (404, "x y"), (404, "x y")]
    rows += [(i, "copy of a common text" + " " * (i % 4)) for i in range(1000, 1400)]
    rows += [(2000, "long word " * 300_000), (2001, "longword" * 300_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_against_a_dictionary(spark, parts):
    """The common text is cut by many partitions; every odd row has its own outcome."""
    rows = some_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if parts == 3 else 10_000)
    try:
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_common_text_is_cut_across_partitions(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in S.in_order(df).groupBy(F.spark_partition_id()).count().collect()]
        rows = S.classes(df)
        assert len(sizes) == 4 and max(sizes) < 8_000
        assert rows.select("keep_id", "group_size").distinct().collect() == [(0, 20_000)] and rows.filter("kept").select("doc_id").collect() == [(0,)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_splitters_are_short(spark):
    plan = S.in_order(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(head" in plan and "content" not in plan.split("rangepartitioning(")[1].split("\n")[0]


def test_empty_table_and_other_columns(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    odd = spark.createDataFrame([(1, "a b", "x", 2, None), (2, "ab", None, 1, 3.0)], "doc_id long, text string, sha string, n int, keep_id double")
    assert [r[:4] for r in found(odd)] == [(1, 1, 2, True), (2, 1, 2, False)]
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns and kept.collect() == [(1, "a b", "x", 2, None)]


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_exact_dedup(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.collect()), key=str) == plain(map(tuple, docs))
