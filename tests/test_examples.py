"""Worked examples with values computed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from wherry.functions import text as t
from wherry.functions import vec as v
from wherry.operators import fusion, graph, joins, locate, maintain, metrics, pack, rank
from wherry.sources import readers
from wherry.sources.snapshot import VersionedStore


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_rrf_of_two_lists(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(0, 3, 1), (0, 1, 2), (0, 4, 3)], "query_id long, id long, rank int")
    got = {r["id"]: r["score"] for r in fusion.rrf({"a": (a, 1.0), "b": (b, 1.0)}).collect()}
    assert got[1] == pytest.approx(1 / 61 + 1 / 62)
    assert got[3] == pytest.approx(1 / 63 + 1 / 61)
    assert got[4] > 0


def test_overlap_tokens(spark):
    toks = one(spark, t.overlap_tokens(F.lit("GetEmployees parseCSVMainInfo child indices initialized")))
    assert {"get", "employee", "parse", "csv", "main", "info", "child", "index", "new"} <= set(toks)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("internal/sql/colexec", '"internal" OR "sql" OR "colexec"'),
        ("Scan(*Batch)", '"Scan" OR "Batch"'),
        ("tree-sitter", '"tree" OR "sitter"'),
        ("rows or scan", '"rows" OR "or" OR "scan"'),
        ("the is a an", ""),
    ],
)
def test_fts_queries(spark, query, want):
    assert one(spark, t.fts_query(F.lit(query))) == want


def test_stems(spark):
    got = one(spark, F.transform(F.split(F.lit("queries parsing parsed boxes cats ring bed"), " "), t.strip_suffix))
    assert got == ["query", "pars", "pars", "boxe", "cats", "ring", "bed"]


def test_identifiers(spark):
    got = one(spark, t.query_identifiers(F.lit("see `read_file` and parseCSV or read_file, self THE fooBar"), 8))
    assert got == ["read_file", "parseCSV", "fooBar"]


def test_walk_reaches_neighbours(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 1, 1.0)], "query_id long, id long, weight double")
    g = graph.build(edges, nodes)
    got = {r["id"]: r["score"] for r in graph.personalized_pagerank(g, nodes, seeds).collect()}
    assert set(got) == {1, 2, 3} and got[2] > got[3] > 0
    assert sum(got.values()) == pytest.approx(1, abs=1e-4)


def test_walk_leaks_on_isolated_seed(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 3, 1.0)], "query_id long, id long, weight double")
    g = graph.build(edges, nodes)
    leak = graph.personalized_pagerank(g, nodes, seeds).first()["score"]
    full = graph.personalized_pagerank(g, nodes, seeds, dangling="standard").first()["score"]
    assert leak < full and full == pytest.approx(1, abs=1e-6)


def test_walk_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2)) if a != b}
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    seeds = spark.createDataFrame([(0, 0, 2.0), (0, 5, 1.0)], "query_id long, id long, weight double")
    m = np.zeros((12, 12))
    for a, b in pairs:
        m[b, a] += 1
        m[a, b] += 1
    deg = m.sum(0)
    p = np.zeros(12)
    p[0], p[5] = 2 / 3, 1 / 3
    s = p.copy()
    for _ in range(6):
        flow = m @ np.divide(s, deg, out=np.zeros(12), where=deg > 0)
        s = 0.85 * flow + p * (0.15 + 0.85 * s[deg == 0].sum() / 12)
    got = {r["id"]: r["score"] for r in graph.personalized_pagerank(graph.build(edges, nodes), nodes, seeds, rounds=6, tolerance=None).collect()}
    assert all(got.get(i, 0.0) == pytest.approx(s[i], abs=1e-9) for i in range(12))


@pytest.mark.parametrize(
    ("files", "want"),
    [("aaabc", "high"), ("abcde", "low"), ("abacd", "medium"), ("aaaaa", "high"), ("a", "high"), ("abcdea", "low")],
)
def test_health(spark, files, want):
    rows = [(0, i, 1.0 - i / 10, f, i + 1, 0.9) for i, f in enumerate(files)]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, file string, rank int, relevance double")
    assert rank.retrieval_health(df).first()["confidence"] == want


def test_health_weak_match(spark):
    df = spark.createDataFrame([(0, 1, 1.0, "a", 1, 0.5)], "query_id long, id long, score double, file string, rank int, relevance double")
    assert rank.retrieval_health(df).first()["confidence"] == "low"


@pytest.mark.parametrize(("floor", "want"), [(0, [1, 2, 3, 4, 5]), (2, [1, 3, 2, 4, 5]), (40, [1, 3, 5, 2, 4])])
def test_floor(spark, floor, want):
    df = spark.createDataFrame([(0, i, f"{'x_test.go' if i in (2, 4) else 'x.go'}", i) for i in range(1, 6)], "query_id long, id long, file string, rank int")
    got = [r["id"] for r in rank.test_floor(df, floor, rank.is_test_file(F.col("file"))).orderBy("rank").collect()]
    assert got == want


def test_default_floor():
    assert [rank.default_floor(n) for n in (40, 20, 5, 3, 1)] == [10, 5, 1, 0, 0]


def test_explore_example(spark):
    shown = spark.createDataFrame([(0, 1, "a.go", 10, 11), (0, 2, "c.go", 1, 5)], "query_id long, rank int, file string, start int, end int")
    gold = spark.createDataFrame([(0, "a.go", 10, 12), (0, "b.go", 1, 2)], "query_id long, file string, start int, end int")
    r = metrics.explore_metrics(shown, gold, gold.select("query_id", "file")).first()
    assert (r["hit_file"], r["file_recall"], r["first_useful"]) == (1, 0.5, 1)
    assert r["line_recall"] == pytest.approx(2 / 5) and r["precision"] == pytest.approx(2 / 7)


def test_budget_example(spark):
    shown = spark.createDataFrame([(0, 1, "a.go", 1, 4), (0, 2, "b.go", 1, 5), (0, 3, "b.go", 1, 3)], "query_id long, rank int, file string, start int, end int")
    gold = spark.createDataFrame([(0, "a.go", 1, 2), (0, "b.go", 3, 7)], "query_id long, file string, start int, end int")
    kept = metrics.line_prefix(shown.withColumn("lines", F.col("end") - F.col("start") + 1), 10)
    assert kept.count() == 2
    got = metrics.budget_ndcg(kept, gold, 10).first()["ndcg_b"]
    assert got == pytest.approx((2 / math.log2(2) + 3 / math.log2(3)) / (5 / math.log2(2) + 2 / math.log2(3)))


def test_metric_means(spark):
    hits = spark.createDataFrame([(q, r, r) for q, first in ((1, 1), (2, 3), (3, 8)) for r in range(first, first + 1)], "query_id long, id long, rank int")
    want = hits.select("query_id", "id")
    per = metrics.case_metrics(hits, want, hits.select("query_id", F.lit(1).alias("min_hits")))
    r = metrics.summarize(per).first()
    assert [r[m] for m in ("hit1", "hit3", "recall5", "recall10")] == pytest.approx([1 / 3, 2 / 3, 2 / 3, 1])


def test_adoption_example(spark):
    rows = [(0, "served"), (60, "nudge"), (120, "positional"), (200, "nudge"), (300, "blocked"), (400, "searched"), (5000, "positional")]
    df = spark.createDataFrame(rows, "s long, kind string").select(F.timestamp_seconds("s").alias("ts"), "kind")
    r = metrics.adoption(df, 600).first()
    assert (r["retrievals"], r["positional"], r["nudges"], r["followed"], r["blocked"], r["searched_after"]) == (3, 2, 2, 1, 1, 1)


def test_two_nudges_one_answer(spark):
    rows = [(0, "nudge"), (60, "nudge"), (120, "positional")]
    df = spark.createDataFrame(rows, "s long, kind string").select(F.timestamp_seconds("s").alias("ts"), "kind")
    assert metrics.adoption(df, 600).first()["followed"] == 2


@pytest.mark.parametrize(
    ("query", "want"),
    [("src/a.go:12", ("src/a.go", 12)), ("./a/b.py", ("a/b.py", 0)), ("a.go:12-30:x := 1", ("a.go", 12)), ("Config: how do we load it", (None, None)), ("where is it", (None, None)), ("a.go:x", (None, None)), ("", (None, None))],
)
def test_locators(spark, query, want):
    r = locate.parse_locator(spark.createDataFrame([(query,)], "query string")).first()
    assert (r["path"], r["line"]) == want


def test_locate_prefers_exact_and_innermost(spark):
    files = spark.createDataFrame([(1, "src/a.go"), (2, "lib/src/a.go")], "id long, path string")
    symbols = spark.createDataFrame([(10, 1, 1, 50), (11, 1, 10, 20), (12, 1, 60, 70), (13, 2, 1, 99)], "id long, file long, start int, end int")
    q = spark.createDataFrame([(0, "src/a.go:15")], "query_id long, query string")
    got = [r["id"] for r in locate.locate(q, files, symbols).orderBy("rank").collect()]
    assert got == [11, 10, 12]


def test_related_edits_cap(spark):
    post = spark.createDataFrame([("passwd", 1, "db/client.py"), ("passwd", 2, "me.py")] + [("settings", i, f"f{i}.py") for i in range(120)], "term string, symbol long, file string")
    edits = spark.createDataFrame([(0, "passwd settings")], "query_id long, text string")
    mine = spark.createDataFrame([(0, "me.py")], "query_id long, file string")
    rows = locate.related_files(edits, post, mine).collect()
    assert [(r["file"], r["shared"]) for r in rows] == [("db/client.py", ["passwd"])]


def test_alpha_gate(spark):
    assert one(spark, fusion.effective_alpha(F.lit(0.1), F.lit(0.0), F.lit(0.42))) == 0.42
    assert one(spark, fusion.effective_alpha(F.lit(0.1), F.lit(0.9))) <= 0.7
    assert one(spark, fusion.effective_alpha(F.lit(0.9), F.lit(0.0))) >= 0.9


def test_anchor_slots():
    row = lambda i, file, anchor=False: {"id": i, "file": file, "is_anchor": anchor}
    rows = [row(i, f"f{i}") for i in range(12)] + [row(98, "f1", True), row(99, "new", True), row(97, "new", True)]
    assert [r["id"] for r in fusion.reserve_anchor_slots(rows, 10)] == [0, 1, 2, 3, 4, 5, 6, 7, 99, 8]
    assert fusion.reserve_anchor_slots(rows[:10], 10) == rows[:10]
    inside = [row(50, "x", True), row(51, "y", True), *rows]
    assert fusion.reserve_anchor_slots(inside, 10) == inside
    assert [r["id"] for r in fusion.reserve_anchor_slots([row(i, f"f{i}") for i in range(4)] + [row(9, "z", True)], 3)] == [0, 1, 9]


def test_fnv_values(spark):
    assert one(spark, v.fnv1a32(F.lit(""))) == 0x811C9DC5
    assert one(spark, v.fnv1a32(F.lit("a"))) == 0xE40C292C
    assert one(spark, v.fnv1a32(F.lit("foobar"))) == 0xBF9CF968


@pytest.mark.parametrize(
    ("scores", "want"),
    [([0.9, 0.5], ["high", "low"]), ([0.86, 0.77], ["high", "medium"]), ([0.86, 0.80], ["medium", "medium"]), ([0.9], ["high"]), ([0.0, -1.0], ["low", "low"]), ([0.7, 0.1], ["medium", "low"])],
)
def test_confidence(spark, scores, want):
    df = spark.createDataFrame([(0, s, i + 1) for i, s in enumerate(scores)], "query_id long, score double, rank int")
    assert [r["confidence"] for r in rank.assign_confidence(df).orderBy("rank").collect()] == want


@pytest.mark.parametrize(("place", "scores", "want"), [(1, [1.0, 0.7, 0.6, 0.9], 3), (2, [1.0, 0.9], 1), (1, [1.0, 0.5, 0.9], 2), (1, [-1.0, -2.0, -9.0, -9.0], 3), (1, [0.0], 1)])
def test_shown_windows(spark, place, scores, want):
    df = spark.createDataFrame([(0, 1, place, 5 * i + 1, 500, s) for i, s in enumerate(scores)], "query_id long, id long, rank int, start int, lines int, score double")
    assert pack.select_spans(df).count() == want


def test_budget_edges(spark):
    gold = spark.createDataFrame([(0, "a", 1, 100), (1, "a", 1, 90_000), (2, "a", 1, 3)], "query_id long, file string, start int, end int")
    shown = spark.createDataFrame([(0, 1, "a", 1, 5), (2, 1, "a", 1, 3)], "query_id long, rank int, file string, start int, end int")
    got = {r["query_id"]: r["ndcg_b"] for r in metrics.budget_ndcg(shown, gold, 10).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0}
    assert metrics.clipped(gold).filter("end = 5001").count() == 1
    assert {r["query_id"]: r["hit_region"] for r in metrics.hit_region(shown, gold).collect()} == {0: 1.0, 1: 0.0, 2: 1.0}


@pytest.mark.parametrize(
    ("doc", "want"),
    [("// Foo reads. It ends.", "Foo reads."), ("/** A\n * b\n\nc. d", "A b"), ('"""Text of one. Two', "Text of one."), ("é" * 200, "é" * 110), ("", ""), ("v1.2 is out", "v1.2 is out")],
)
def test_first_sentences(spark, doc, want):
    assert one(spark, t.first_sentence(F.lit(doc))) == want


@pytest.mark.parametrize(
    ("raw", "want"), [("fix(db): keep pages (#3)", "keep pages"), ("pkg/kv: do it", "do it"), ("feat! #12 add x", "add x"), ("Big change: a b", "Big change: a b"), ("docs: see: that", "that")]
)
def test_subjects(spark, raw, want):
    assert one(spark, t.clean_subject(F.lit(raw))) == want


def test_spans_of_text(spark):
    assert [tuple(r) for r in one(spark, t.parse_spans(F.lit("3-9, 14 - 20,7,x-1,9-3")))] == [(3, 9), (14, 20), (9, 3)]
    assert one(spark, t.parse_span(F.lit("120-380"))) == (120, 380)
    assert one(spark, t.parse_span(F.lit("9-3"))) is None and one(spark, t.parse_span(F.lit("7"))) is None


def test_redaction_keeps_empty(spark):
    assert one(spark, t.redact(F.lit(""))) == "" and one(spark, t.redact(F.lit("a"))) == "h:ca978112ca1b"


@pytest.mark.parametrize(("path", "name", "want"), [("a/b.go", "p.Foo", "public"), ("a/b.go", "p.foo", "internal"), ("x.test.ts", "F", "internal"), ("x.js", "f", "public"), ("x.py", "_f", "public")])
def test_visible(spark, path, name, want):
    assert one(spark, rank.visibility(F.lit(name), F.lit(path))) == want


def test_nested_first(spark):
    rows = [(0, 1, 1, "a", 1, 50), (0, 2, 2, "b", 1, 9), (0, 3, 3, "a", 10, 20), (0, 4, 4, "a", 1, 50)]
    df = spark.createDataFrame(rows, "query_id long, id long, rank int, file string, start int, end int")
    assert [r["id"] for r in rank.prefer_nested(df).orderBy("rank").collect()] == [3, 2, 1, 4]


def test_walk_without_known_seed(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    g = graph.build(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), nodes)
    seeds = spark.createDataFrame([(0, 9, 1.0), (1, 1, 0.0)], "query_id long, id long, weight double")
    got = graph.personalized_pagerank(g, nodes, seeds).collect()
    assert len(got) == 6 and sum(r["score"] for r in got) == pytest.approx(2)


def test_grep(spark):
    texts = spark.createDataFrame([("a", "xread_filey"), ("b", "read file"), ("c", None)], "file string, text string")
    needles = spark.createDataFrame([(0, "read_file"), (1, "read"), (2, ""), (3, "zz")], "query_id long, needle string")
    assert sorted((r["query_id"], r["file"]) for r in readers.grep_files(needles, texts).collect()) == [(0, "a"), (1, "a"), (1, "b")]


def test_merge_spans_touching(spark):
    df = spark.createDataFrame([(0, 1, 5), (0, 5, 9), (0, 11, 12)], "id long, start int, end int")
    assert [(r["start"], r["end"]) for r in pack.merge_spans(df, ["id"]).orderBy("start").collect()] == [(1, 9), (11, 12)]


def test_page_text_keeps_characters():
    text = "é" * 10 + "\nrest"
    page, at = pack.page_text(text, 0, 5)
    assert page == "éé" and at == 4
    assert pack.page_text(text, 0, 23)[0].endswith("\n")


def test_expansion_pages():
    text = "ab\ncdé\n" * 20
    pages, at = [], 0
    while at is not None:
        p = pack.expansion_page(text, at, 10)
        pages.append(p)
        at = p["next"]
    assert "".join(p["text"] for p in pages) == text and len({p["sha256"] for p in pages}) == 1
    assert all(p["column"] == 1 for p in pages) and [p["line"] for p in pages][:2] == [1, 3]


def test_backfill_takes_up_where_it_ended(spark, tmp_path):
    symbols = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "id long, text string")
    store, seen = f"{tmp_path}/v", []
    stored = lambda: spark.read.schema("id long, vector array<double>").parquet(store)
    spark.createDataFrame([(5, [1.0])], "id long, vector array<double>").write.parquet(store)
    embedder = lambda texts: [[float(len(t))] for t in texts]
    assert maintain.backfill(symbols, stored(), embedder, lambda v: v.write.mode("append").parquet(store)) == 299
    assert maintain.backfill(symbols, stored(), embedder, seen.append) == 0 and not seen
    assert stored().count() == 300


def test_incremental_index(spark):
    files = spark.createDataFrame([(1, "a.py", "h1"), (2, "b.py", "h2"), (3, "c.py", "h3")], "id long, path string, hash string")
    symbols = spark.createDataFrame([(10, 1, "a.f"), (11, 2, "b.f"), (12, 3, "c.f")], "id long, file_id long, qualified_name string")
    edges = spark.createDataFrame([(10, 11), (10, 12), (11, 12)], "src long, dst long")
    walk = spark.createDataFrame([("a.py", "h1"), ("b.py", "new"), ("d.py", "h4")], "path string, hash string")
    extract = lambda f: f.select("path", F.explode(F.array(F.concat("path", F.lit(".x")), F.concat("path", F.lit(".y")))).alias("qualified_name"))
    tables, counts = maintain.incremental_index({"files": files, "symbols": symbols, "edges": edges}, walk, extract)
    assert tuple(counts.first()) == (1, 1, 1, 1)
    ids = {r["path"]: r["id"] for r in tables["files"].collect()}
    assert ids == {"a.py": 1, "b.py": 2, "d.py": ids["d.py"]} and ids["d.py"] not in (1, 2)
    got = {r["qualified_name"]: (r["id"], r["file_id"]) for r in tables["symbols"].collect()}
    assert got["a.f"] == (10, 1) and set(got) == {"a.f", "b.py.x", "b.py.y", "d.py.x", "d.py.y"} and {i for i, _ in got.values()} == {10, 13, 14, 15, 16}
    assert got["d.py.x"][1] == ids["d.py"] and tables["edges"].count() == 0


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "path string, id long, v string")
    new = spark.createDataFrame([("b", None, "z"), ("c", None, "w")], "path string, id long, v string")
    got = {r["path"]: (r["id"], r["v"]) for r in maintain.upsert(old, new, "path").collect()}
    assert got == {"a": (1, "x"), "b": (2, "z"), "c": (3, "w")}


def test_versioned_store(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    assert store.commit({"files": spark.range(3)}, {"dim": 64}) == 1
    assert store.commit({"files": spark.range(5)}) == 2
    assert store.read("files").count() == 5
    store.require(dim=64)
    with pytest.raises(ValueError):
        store.require(dim=32)


def test_docstrings(spark):
    doc = "/** Reads a file.\n * @param x\n * -----\n * Returns text. */"
    assert one(spark, readers.normalize_docstring(F.lit(doc))) == "Reads a file.\nReturns text."


def test_unwrap(spark):
    assert one(spark, readers.unwrap_json_string(F.lit('"a \\"b\\""'))) == 'a "b"'
    assert one(spark, readers.unwrap_json_string(F.lit("plain"))) == "plain"


def test_jsonl_and_qrels(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id":"1","text":"abc"}\n\nnot json\n{"_id":"2","text":"defg"}\n')
    assert sorted((r[0], r[1]) for r in readers.read_corpus(spark, str(tmp_path / "c.jsonl"), 3).collect()) == [("1", "abc"), ("2", "def")]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td2\n")
    assert [tuple(r) for r in readers.read_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "d1", 1)]


def test_tree(spark, tmp_path):
    for p, s in (("a.go", "package a"), ("node_modules/b.go", "x"), (".git/c.go", "x"), ("gen.go", "// Code generated by x. DO NOT EDIT."), ("n.txt", "x"), ("d/e_test.py", "y")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(s)
    got = {(r["path"], r["language"]) for r in readers.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("a.go", "go"), ("d/e_test.py", "python")}
    assert {r["path"] for r in readers.read_tree(spark, str(tmp_path), include_tests=False).collect()} == {"a.go"}


def test_names_and_calls(spark):
    symbols = spark.createDataFrame([(1, "a.f"), (2, "b.f"), (3, "b.g")], "id long, qualified_name string")
    calls = spark.createDataFrame([(1, "b.f"), (1, "x.g"), (1, "x.f"), (3, "b.g")], "src long, callee string")
    assert sorted((r["src"], r["dst"]) for r in joins.resolve_calls(calls, symbols).collect()) == [(1, 2), (1, 3)]
