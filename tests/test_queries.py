import pytest

import __spark_entry__ as entry
from folioscore.plans import registry

from .verify import compare, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, name):
    rows, why = compare(spark, SF, name, registry.queries()[name], registry.oracle_sql().get(name))
    assert why is None and rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["q_wer_by_lang", "q_ndld_word", "q_bleu_documents", "q_merge_lines", "q_greedy_match", "q_order_decode", "q_section_report", "q_positional_join", "q_compare_files", "q_token_labels", "q_image_for_page"])
def test_partitioning_changes_nothing(spark, name, monkeypatch):
    from folioscore.plans import box_queries, evaluation_queries, relation_queries, text_queries

    def rows():
        df = registry.queries()[name](spark, SF)
        return rows_of(df.columns, [tuple(r) for r in df.collect()])

    before = rows()
    for m in (box_queries, evaluation_queries, relation_queries, text_queries):
        monkeypatch.setattr(m, "table", lambda s, sf, n: s.read.parquet(f"{sf}/{n}.parquet").repartition(7))
    assert rows() == before


def test_greedy_match_against_brute_force(spark):
    """Matches of every page's boxes, in plain loops."""
    from folioscore.plans import box_queries as Q

    def iou(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        u = a[2] * a[3] + b[2] * b[3] - w * h
        return w * h / u if u > 0 else 0

    truth = {r["l_orderkey"]: [[v / 100 * 100.0 for v in x["b"]] for x in r["r"]] for r in Q._pages(spark, SF).collect()}
    for page in Q._matched(spark, SF).collect():
        gt, pred = truth[page["l_orderkey"]], page["bbox_in_line"]
        if not pred:
            assert page["m_TP@0.5"] is None
            continue
        for least in (0.5, 0.75):
            pairs = sorted(((-iou(g, p), i, j) for i, g in enumerate(gt) for j, p in enumerate(pred)), key=lambda x: x)
            rows, cols = set(), set()
            for v, i, j in pairs:
                if -v >= least and i not in rows and j not in cols:
                    rows.add(i)
                    cols.add(j)
            assert (page[f"m_TP@{least}"], page[f"m_FP@{least}"], page[f"m_FN@{least}"]) == (len(rows), len(pred) - len(rows), len(gt) - len(rows))
