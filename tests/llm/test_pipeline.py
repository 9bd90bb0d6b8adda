from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from folioscore.llm import mixing, quality
from folioscore.llm.common import staged
from folioscore.llm.words import load_tokenizer

from .test_secrets import brute as brute_secrets
from .test_jaccard import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus with odd rows beside a part of the documents."""
    path = str(tmp_path_factory.mktemp("sf"))
    src = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{src}/documents.parquet").filter("n_chars < 4000").orderBy("doc_id").limit(250).collect()
    rows = [tuple(r) for r in docs] + [(5000, None, None, None, None), (5001, "", "en", "src1", 0), (5002, docs[3]["text"], "en", "src1", 7), (None, docs[4]["text"], "en", "src2", 7), (None, "A text without an id, of a few plain words.", "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = rows_of(docs)

    good = C.keep_good(spark, docs, sf).transform(staged, "test")
    assert good.columns == COLUMNS
    model = quality.train(quality.counted(docs), spark.read.parquet(f"{sf}/labels.parquet"))
    assert rows_of(good) == [r for r in before if model.score(np.array([quality.counts(r[1])], float))[0] >= 0.3]

    single = C.drop_copies(spark, good, sf).transform(staged, "test")
    assert single.columns == COLUMNS
    kept = rows_of(good)
    # The stage's rule: five words and a similarity of 0.8 or more.
    sets, up = [shingles(r[1]) for r in kept], list(range(len(kept)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                up[find(i)] = find(j)
    want, groups = {}, Counter()
    for i, row in enumerate(kept):
        key = (row[0] is None, row[0] or 0)
        want[find(i)] = min(want.get(find(i), (key, row)), (key, row), key=lambda x: x[0])
        groups[find(i)] += 1
    assert rows_of(single) == sorted((r for _, r in want.values()), key=str) and max(groups.values()) > 1

    masked = C.mask_secrets(spark, single, sf).transform(staged, "test")
    assert masked.columns == COLUMNS
    kept = rows_of(single)
    found = brute_secrets([r[1] or "" for r in kept])
    assert len(rows_of(masked)) == len(kept)
    texts = {r[0]: r[1] for r in rows_of(masked)}
    for r, (_, spans) in zip(kept, found, strict=True):
        if not spans:
            assert texts[r[0]] == r[1]
        elif r[0] is not None:
            parts = [tuple(map(int, s.split(":")[1:])) for s in spans.split(",")]
            assert all(r[1][a:b] not in texts[r[0]] for a, b in parts) and "[SECRET]" in texts[r[0]]

    mixed = C.mix_sources(spark, masked, sf).transform(staged, "test")
    assert mixed.columns == COLUMNS
    size, taken, source = Counter(), Counter(), {}
    for r in rows_of(masked):
        source[r[0]] = r[3]
        size[r[3]] += len((r[1] or "").split())
    for r in rows_of(mixed):
        taken[source[r[0]]] += len(r[1].split())
        assert r[4] == len(r[1])
    aims = mixing.targets(list(size.items()))
    assert all(abs(taken[s] - t) <= mixing.BLOCK_WORDS for s, t in aims.items())

    coded = C.encode(spark, mixed, sf).collect()
    tok = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r[0]), tok.encode(r[1], add_special_tokens=False).ids) for r in rows_of(mixed))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in coded) == want
    assert all(tok.decode(r["ids"], skip_special_tokens=False) == r["decoded"] for r in coded)


def test_run(spark, sf):
    out = C.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert out.filter(F.size("ids") != F.col("n_tokens")).count() == 0 and out.count() > 0


def test_empty_documents(spark, tmp_path, sf):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, sf):
    """Columns named like those the stages work with, very long texts, whole repeated rows."""
    names = ["_score", "score", "spans", "_row", "shard", "place", "epoch", "size", "copy", "row", "key", "fp", "h", "bands", "_all", "rest", "ids", "base"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").join(good, "doc_id").orderBy("doc_id").collect()]
    long = spark.createDataFrame([(7000, "\n".join(texts), "en", "src1", 5)], docs.schema)
    docs = docs.unionByName(docs.limit(5)).unionByName(long)
    wide = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    for name, stage in C.STAGES[:4]:
        wide = stage(spark, wide, sf).transform(staged, "test")
        assert wide.columns == [*COLUMNS, *names]
        wrong = [F.col(n) != F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names]
        assert wide.filter(F.greatest(*[w.cast("int") for w in wrong]) > 0).count() == 0, name
        assert name == "mixing" or wide.filter("doc_id = 7000").count() == 1
    assert C.encode(spark, wide, sf).filter("decoded is null").count() == 0
