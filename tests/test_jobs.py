import ast
import datetime
import json
import logging
import pathlib
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import layout_report, queries, score_predictions, settings

from .verify import compare

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def rates(gt, hyp):
    words, signs = (gt.split(), hyp.split()), (gt.replace(" ", ""), hyp.replace(" ", ""))
    return tuple(levenshtein(*s) / len(s[0]) if s[0] else float(bool(s[1])) for s in (words, signs))


TRUTH = [(1, "en", "one two three\nfour five"), (2, "fr", "un deux"), (3, None, None), (4, "en", "")]
FIRST = [("a", 1, 0, "one two tree"), ("a", 1, 1, "four five"), ("b", 1, 0, "one"), ("a", 9, 0, "nobody knows")]
THEN = [("b", 2, 0, "un deux trois"), ("a", 1, 0, "one two three"), ("a", 3, 0, None), ("b", 4, 0, "x"), ("a", 2, 5, "beyond the end")]


def expected(rows):
    lines = {(d, i): (lang, t) for d, lang, text in TRUTH for i, t in enumerate((text or "").split("\n"))}
    out = []
    for engine, d, i, text in rows:
        lang, t = lines.get((d, i), (None, None))
        out.append((engine, lang, d, i, *((None, None) if t is None else rates(t, text or ""))))
    return sorted(out, key=str)


class Folder:
    def __init__(self, spark, path, scheme=""):
        self.spark, self.path = spark, f"{scheme}{path}"
        spark.createDataFrame(TRUTH, "doc_id long, lang string, text string").write.parquet(f"{self.path}/truth")

    def arrive(self, rows):
        self.spark.createDataFrame(rows, score_predictions.PREDICTIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/predictions")

    def run(self, **more):
        p = self.path
        got = score_predictions.run(self.spark, f"{p}/predictions", f"{p}/truth", f"{p}/scores", f"{p}/report", f"{p}/checkpoint", **more)
        return sorted((tuple(r[c] for c in ("engine", "lang", "doc_id", "line", "wer", "cer")) for r in got.collect()), key=str)

    def report(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.path}/report").select("engine", "lang", "pages", "wer").collect()), key=str)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_two_runs_over_growing_input(spark, tmp_path, caplog, scheme):
    job = Folder(spark, tmp_path, scheme)
    job.arrive(FIRST)
    with caplog.at_level(logging.INFO):
        assert job.run() == expected(FIRST)
        before = job.report()
        assert "read 4 new rows" in caplog.text
        caplog.clear()
        assert job.run() == expected(FIRST) and job.report() == before
        assert "read 0 new rows" in caplog.text
        caplog.clear()
        job.arrive(THEN)
        assert job.run() == expected(FIRST + THEN)
        assert "read 5 new rows" in caplog.text  # only the new file's
    # Engine a's line is read twice: its second, right reading counts in the means.
    assert [r for r in job.report() if r[:2] == ("a", "en")] == [("a", "en", 2, 0.0)]
    assert {r[:3] for r in job.report()} == {("a", "en", 2), ("a", None, 3), ("b", "en", 2), ("b", "fr", 1)}


def test_one_run_gives_what_two_give(spark, tmp_path):
    job = Folder(spark, tmp_path)
    job.arrive(FIRST)
    job.arrive(THEN)
    assert job.run(max_files=1) == expected(FIRST + THEN)


def test_a_run_that_was_broken_off(spark, tmp_path):
    """A batch that was written, but whose end the checkpoint doesn't know, isn't there twice."""
    job = Folder(spark, tmp_path)
    job.arrive(FIRST)
    job.run()
    job.arrive(THEN)
    job.run()
    commits = sorted(p for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit())
    commits[-1].unlink()
    (tmp_path / f"checkpoint/commits/.{commits[-1].name}.crc").unlink(missing_ok=True)
    assert job.run() == expected(FIRST + THEN)


def test_lines_end_where_it_is_set(spark):
    truth = spark.createDataFrame([(1, "en", "a b. c!d"), (2, "en", None)], "doc_id long, lang string, text string")
    assert [(r["doc_id"], r["line"], r["truth"]) for r in score_predictions.true_lines(truth, "[.!]").collect()] == [(1, 0, "a b"), (1, 1, " c"), (1, 2, "d"), (2, 0, "")]


BOXES = "page_id long, place int, x double, y double, w double, h double"


class Layout:
    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)
        days = [(1, datetime.date(2024, 1, 5)), (2, datetime.date(2024, 2, 1)), (3, datetime.date(2024, 2, 29)), (4, None), (5, datetime.date(2023, 12, 31))]
        self.spark.createDataFrame(days, "page_id long, day date").write.parquet(f"{path}/pages")
        truth = [(p, k, 10.0 * k, 10.0, 8.0, 8.0) for p in (1, 2, 4, 5) for k in (0, 1, 2)]
        self.spark.createDataFrame(truth, BOXES).write.parquet(f"{path}/truth")
        self.predict(0.0)

    def predict(self, shift):
        rows = [(p, k, 10.0 * k + shift, 10.0, 8.0, 8.0, 1.0 - k / 10) for p in (1, 2, 3, 4, 5) for k in (0, 1)]
        self.spark.createDataFrame(rows, BOXES + ", score double").write.mode("overwrite").parquet(f"{self.path}/predictions")

    def run(self, **more):
        p = self.path
        rows = layout_report.run(self.spark, f"{p}/truth", f"{p}/pages", f"{p}/predictions", f"{p}/metrics", f"{p}/report", **more).collect()
        return {r["page_id"]: (r["year"], r["month"], r["tp_50"], r["fp_50"], r["fn_50"]) for r in rows}


def test_months_are_replaced_and_others_stay(spark, tmp_path):
    job = Layout(spark, tmp_path)
    whole = {1: (2024, 1, 2.0, 0.0, 1.0), 2: (2024, 2, 2.0, 0.0, 1.0), 3: (2024, 2, None, None, None), 5: (2023, 12, 2.0, 0.0, 1.0)}
    assert job.run() == whole
    assert job.run() == whole
    job.predict(50.0)  # nothing is hit any more
    assert job.run(since="2024-02-10", until="2024-02-20") == whole | {2: (2024, 2, 0.0, 2.0, 3.0)}
    assert job.run(since="2024-01-01", until="2024-02-01") == whole | {1: (2024, 1, 0.0, 2.0, 3.0), 2: (2024, 2, 0.0, 2.0, 3.0)}
    report = {(r["year"], r["month"]): (r["tp_50"], r["with_metrics"], r["pages"]) for r in spark.read.parquet(f"{tmp_path}/report").collect()}
    assert report == {(2023, 12): (2.0, 1, 1), (2024, 1): (0.0, 1, 1), (2024, 2): (0.0, 1, 2)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query_matches_its_sql(spark, name):
    rows, why = compare(spark, SF, name, queries.queries()[name], queries.oracle_sql()[name])
    assert why is None and rows > 1000


def test_settings_come_from_the_file_and_the_command_line(tmp_path):
    (tmp_path / "job.json").write_text(json.dumps({"max": 3, "at": [0.5], "out": "/o"}))
    paths = {"in": "what is read", "out": "what is written"}
    assert settings.read(str(tmp_path / "job.py"), ["--in", "/i"], paths) == {"in": "/i", "out": "/o", "max": 3, "at": [0.5]}
    assert settings.read(str(tmp_path / "job.py"), ["--in", "/i", "--out", "/p", "--at", "[0.7, 0.9]", "--max", "4"], paths) == {"in": "/i", "out": "/p", "max": 4, "at": [0.7, 0.9]}
    with pytest.raises(SystemExit):
        settings.read(str(tmp_path / "job.py"), [], paths)


def test_command_line(spark, tmp_path):
    job = Folder(spark, tmp_path)
    job.arrive(FIRST)
    args = [f"--{n}={tmp_path}/{n}" for n in score_predictions.PATHS]
    done = subprocess.run([sys.executable, "-m", "jobs.score_predictions", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 4 new rows" in done.stderr and job.run() == expected(FIRST)


def test_jobs_import_nothing_of_the_corpus_parts():
    for path in [*(ROOT / "jobs").glob("*.py"), pathlib.Path(__file__)]:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def test_rates_against_a_matrix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 7 = 0 and length(text) < 1500").select("doc_id", "lang", "text")
    pred = queries._readings(docs).withColumn("arrived", F.current_timestamp())
    lines = {(d, i): t for d, _, text in docs.collect() for i, t in enumerate(re.split(queries._ENDS, text))}
    words = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split()
    signs = lambda t: re.sub(r"\s", "", t.lower())
    said = {(r["engine"], r["doc_id"], r["line"]): r["text"] for r in pred.collect()}
    got = {(r["engine"], r["doc_id"], r["line"]): (r["wer"], r["cer"]) for r in score_predictions.scored(pred, docs, split_at=queries._ENDS).collect()}
    assert len(got) > 100 and got.keys() == said.keys()
    for key, (wer, cer) in got.items():
        t, h = lines[key[1:]], said[key]
        for rate, cut in ((wer, words), (cer, signs)):
            g, p = cut(t), cut(h)
            assert rate == pytest.approx(levenshtein(g, p) / len(g) if g else float(bool(p)), abs=1e-12)


def test_true_lines_are_normalised_once(spark):
    """Before the join, not again for each engine that reads a line."""
    truth = spark.createDataFrame([(1, "en", "ﬁne A-\nb. (cid:7)c")], "doc_id long, lang string, text string")
    pred = spark.createDataFrame([(e, 1, n, t) for e in "xy" for n, t in enumerate(["fine a-\nb", "c c"])], "engine string, doc_id long, line int, text string").withColumn("arrived", F.current_timestamp())
    out = score_predictions.scored(pred, truth, split_at="[.]")
    assert sorted((r["engine"], r["line"], r["wer"], r["cer"]) for r in out.collect()) == [(e, *r) for e in "xy" for r in ((0, 0.0, 0.0), (1, 1.0, 1.0))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("Join LeftOuter")
    assert plan[:joined].count("_nfkc(") == 1 == plan[joined:].count("_nfkc(")
