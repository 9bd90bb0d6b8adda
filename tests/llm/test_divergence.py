import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore.llm import divergence as V
from tests.verify import compare
from folioscore.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, ranks=200):
    """The audit in plain loops over every group and kept term."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(UPPER))
        groups.add((lang or "", source or ""))
        docs[lang or ""].update(set(words))
        count[lang or "", source or ""].update(words)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(w for w, n in docs[lang].items() if n >= least)
        own = {s: [count[lang, s][w] for w in kept] for x, s in groups if x == lang}
        p = {s: [1 + 10**9 * (c + 1) // (sum(n) + len(kept)) for c in n] for s, n in own.items()}
        all_n = [sum(n) for n in zip(*own.values(), strict=True)] if kept else []
        q = [1 + 10**9 * (c + 1) // (sum(all_n) + len(kept)) for c in all_n]
        for s in own:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[t], strict=True)), t) for t in own if t != s]
            words = [((a - b) ** 2 // b, w) for a, b, w, n in zip(p[s], q, kept, own[s], strict=True) if n > 0 and a > b]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= ranks}
    return out


def found(df, **more):
    rows = V.audit(df, **more).collect()
    out = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows}
    assert len(out) == len(rows)
    return out


def some_rows():
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("ab", "Cd", "é", "日本", "x") for b in ("a", "B", "ñ", "")] + ["rare%d" % i for i in range(100)]
    rows = []
    for _ in range(400):
        k = int(min(len(words) - 1, r.expovariate(0.15)))
        text = r.choice([" ", "-", "\n", "1", "\x00"]).join(words[min(len(words) - 1, int(r.expovariate(0.1)))] for _ in range(k))
        rows.append((text, r.choice(["en", "en", "en", "fr", "", None]), r.choice(["src0"] * 5 + ["src1", "src2", "Z", "é", None])))
    return [*rows, (None, "en", "empty"), ("", "en", "empty"), ("one two", "solo", "only"), (None, None, None), ("é " * 50, "twice", "a"), ("é " * 50, "twice", "a"), ("é", "twice", "a"), ("12 34", "no terms", "a"), ("", "no terms", "b")]


@pytest.mark.parametrize("width", [None, 1 << 16])
def test_against_plain_loops(spark, width):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(df, width=width) == plain(rows)
    assert found(df, least=2, ranks=3, width=width) == plain(rows, 2, 3)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    """Too narrow, it discards nothing; the counts stay exact. Tasks write often."""
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "HELD", 20)
    rows = some_rows()
    assert found(spark.createDataFrame(rows, SCHEMA), width=16) == plain(rows)


def test_sketch_never_underestimates_and_discards(spark):
    """Estimates are at least the document frequency, merged over tasks; most rare terms go."""
    rows = [(f"t{i}", 1 + i % 5) for i in range(40_000)]
    df = spark.createDataFrame([(t, 1) for t, n in rows for _ in range(n)], "t string, docs long").repartition(7).withColumn("h", F.xxhash64("t"))
    for width in (1 << 16, 1 << 18):
        bits = V.sketch(df, width)
        assert len(bits) == V.ROWS * width // 4
        h = df.select("t", "h").distinct().toPandas().set_index("t")["h"]
        estimate = V.estimates(bits, width, h[[t for t, _ in rows]].to_numpy())
        true = np.array([n for _, n in rows])
        assert (estimate >= np.minimum(true, 3)).all()
        if width == 1 << 18:
            assert (estimate[true < 3] >= 3).mean() < 0.05


def test_impossible_terms_go_before_the_shuffle(spark):
    local = V.local_counts(spark.createDataFrame([(" ".join(f"w{'x' * (i % 90)}{'y' * (i // 90)}" for i in range(j, 2000, 1 + j)), "en", "a") for j in range(4)], SCHEMA))
    left = V.possible(local)
    assert left.select("term").distinct().count() < 0.5 * local.select("term").distinct().count()
    exact = local.groupBy("term").agg(F.sum("docs").alias("d")).filter("d >= 3").select("term")
    assert exact.join(left, "term", "left_anti").count() == 0


def test_terms_come_in_pieces(monkeypatch):
    text = "One, twö 3 fo-ur\x00\x7fFIVE " + "six" * 40
    monkeypatch.setattr(V, "PIECE", 5)
    pieces = list(V.terms(text.encode()))
    assert len(pieces) > 3 and [w.decode() for p in pieces for w in p] == TERM.findall(text.translate(UPPER))
    assert list(V.terms(b"")) == [] and [w for p in V.terms(b"1 2 3") for w in p] == []


def test_large_counts_are_exact(spark):
    n = 8 * 10**18
    got = spark.range(1).select(V.share(F.lit(n), F.lit(n), F.lit(7).cast("long")).alias("p"), V.share(F.lit(n // 3), F.lit(n), F.lit(10**9)).alias("q")).first()
    assert got["p"] == 1 + 10**9 * (n + 1) // (n + 7) and got["q"] == 1 + 10**9 * (n // 3 + 1) // (n + 10**9)


def test_empty_table_and_other_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()
    rows = some_rows()[:80]
    odd = spark.createDataFrame([(*x, "n", 3, "t") for x in rows], SCHEMA + ", term string, n int, item string")
    assert found(odd) == plain(rows)


def test_pairs_are_added_up_before_they_are_dealt(spark):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    plan = V.audit(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_query_over_the_whole_table(spark):
    rows, why = compare(spark, SF, "op11_divergence", queries.op11_divergence, queries.OP11_SQL)
    assert why is None and rows > 1000
    got = queries.op11_divergence(spark, SF)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == plain(map(tuple, docs))
