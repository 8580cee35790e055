"""Right results at sizes that rows of lines, pairs or repeated work would not bear."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wherry.operators import bm25, joins, knn, locate, metrics, rank


def test_first_cover_against_lines():
    rng = random.Random(3)
    for _ in range(200):
        span = lambda: (a := rng.randrange(40), a + rng.randrange(12))
        spans, gold = [(*span(), float(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 7))], [span() for _ in range(rng.randrange(1, 4))]
        lines = {x for a, b in gold for x in range(a, b + 1)}
        best = {x: min(r for a, b, r in spans if a <= x <= b) for x in lines if any(a <= x <= b for a, b, _ in spans)}
        assert metrics.covered_gain(spans, gold) == pytest.approx(sum(1 / math.log2(r + 1) for r in best.values()))


def test_first_cover_takes_long_spans(spark):
    shown = spark.createDataFrame([(0, 1, "a", 1, 1_000_000_000)], "query_id long, rank int, file string, start long, end long")
    gold = spark.createDataFrame([(0, "a", 1, 4)], "query_id long, file string, start long, end long")
    assert metrics.budget_ndcg(shown, gold, 10).first()["ndcg_b"] == pytest.approx(1.0)


def test_line_metrics_make_no_rows_of_lines(spark):
    """Regions of a billion lines cost as much as short ones; spans that end before they start show nothing."""
    far = 1_000_000_000
    shown = spark.createDataFrame([(0, 1, "a", 1, far), (0, 2, "a", far // 2, 2 * far - 1), (0, 3, "a", 9, 3), (0, 4, "b", 1, 4)], "query_id long, rank int, file string, start long, end long")
    gold = spark.createDataFrame([(0, "a", far // 2 + 1, 2 * far), (0, "c", 1, 2)], "query_id long, file string, start long, end long")
    r = metrics.explore_metrics(shown, gold, gold.select("query_id", "file")).first()
    assert (r["line_recall"], r["precision"]) == pytest.approx(((1.5 * far - 1) / (1.5 * far + 2), (1.5 * far - 1) / (2 * far + 3)))
    assert (r["file_recall"], r["first_useful"], r["unique_files"]) == (0.5, 1, 2)


def test_intent_verbs_as_in_sql(spark, tmp_path):
    """Another verb of the engine's list leads a text, which the query's two do not cover."""
    import __spark_entry__

    rows = [(1, 1, "Hash it "), (2, 1, "Writes it"), (3, 1, "Run it"), (4, 1, "The run of"), (5, 1, "runs it")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["leads"] for r in __spark_entry__.queries()["rk_intent_verbs"](spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert spark.createDataFrame([("Hash it",)], "q string").select(rank.leads_with_action_verb(F.col("q"))).first()[0]


def test_hot_paths_are_placed_once(spark, monkeypatch):
    """Every query wants the same path; blocks are smaller than its queries and files, and one query wants two paths."""
    monkeypatch.setattr(joins, "PAIR_BLOCK", 3)
    files = spark.createDataFrame([(i, f"{'x' * (i % 3)}d/a.py") for i in range(10)] + [(99, "b.py")], "id long, path string")
    wanted = spark.createDataFrame([(q, "a.py") for q in range(8)] + [(50, "a.py"), (50, "b.py")], "query_id long, path string")
    got = {}
    for r in joins.resolve_paths(wanted, files).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["file_id"]))
    order = sorted(range(10), key=lambda i: (i % 3, i))
    assert all(sorted(got[q]) == list(enumerate(order, 1)) for q in range(8))
    assert sorted(got[50]) == [(1, 99)]


def test_linked_tests_meet_by_name(spark):
    """Twenty thousand symbols and tests of one name: their 400 million pairs are never made."""
    s = spark.range(20_000).select(F.col("id"), F.lit("p.Load").alias("name"))
    df = joins.linked_tests(s, spark.range(20_000).select((20_000 - F.col("id")).alias("id"), F.lit("test_load").alias("name")))
    assert df.count() == 60_000 and {r["test_id"] for r in df.collect()} == {1, 2, 3}


def test_literal_files_answer_each_list_once(spark, monkeypatch):
    post = spark.createDataFrame([("src_a", "f", 1), ("src_b", "f", 2), ("src_a", "g", 3), ("src_b", "h", 4)], "term string, file string, symbol long")
    q = spark.range(500).select(F.col("id").alias("query_id"), F.lit("see src_a and src_b").alias("query"))
    seen = []
    keep = locate.materialize
    monkeypatch.setattr(locate, "materialize", lambda df: seen.append(keep(df)) or seen[-1])
    want = [("f", 2)] * 500
    assert [(r["file"], r["names"]) for r in locate.literal_files(q, post).collect()] == want
    assert seen[0].count() == 1
    monkeypatch.setattr(locate, "SENT_ANSWERS", 0)
    assert locate.literal_files(q, post).count() == 500


def test_best_by_label_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, i % 7, v[i].tolist()) for i in range(60)], "id long, label int, v array<double>")
    for name, value in (("QUERY_BLOCK", 4), ("ROW_BLOCK", 5), ("HELD_LABELS", 2)):
        monkeypatch.setattr(knn, name, value)
    q = df.filter("id % 6 = 0")
    got = {(r["q"], r["label"]): r["m"] for r in knn.best_by_label(q, df, "id", "v", "label", "v").collect()}
    want = {(a, b): max(v[a] @ v[i] for i in range(60) if i % 7 == b) for a in range(0, 60, 6) for b in range(7)}
    assert got == pytest.approx(want)
    assert knn.best_by_label(q.limit(0), df, "id", "v", "label", "v").count() == 0


def test_summary_expression_stays_small(spark):
    from wherry.functions.text import clean_summary

    df = spark.createDataFrame([("'Summary: Purpose: Reads x, which and it; distinguishing it\nmore'",), ("y " * 200,), (None,)], "c string").select(clean_summary(F.col("c")).alias("s"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 100_000
    assert [r["s"] for r in df.collect()] == ["Reads x.", "y " * 149 + "y ...", None]


def test_tokens_are_looked_up_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bm25, "TOKEN_BLOCK", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * 3, None, ["b"] * 9, [], ["c"], ["d"] * 2])], names=["doc", "toks"])
    parts = list(bm25.sliced(batch))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))
    assert all(p.num_rows == 1 or sum(len(t or []) for t in p.column(1).to_pylist()) <= 4 for p in parts)
