"""Whole plans and plug-ins on small tables."""

import pytest
from pyspark.sql import functions as F

from wherry.functions import embed
from wherry.operators import fusion, joins, knn, locate, maintain, pack, rank
from wherry.operators.extract import calls, symbols
from wherry.plans.config import EngineConfig
from wherry.plans.search import answer_context, graph_search, hybrid_search
from wherry.sources.readers import resolve_commits

SOURCES = [
    ("store/db.py", "python", "class Store:\n    def open_store(self, path):\n        '''Open the store file.'''\n        return load_pages(path)\n\ndef load_pages(path):\n    '''Load pages of a store.'''\n    return decode(path)\n\ndef decode(x):\n    '''Decode bytes of a page.'''\n    return x.decode('utf-8', errors='replace')\n"),
    ("web/view.py", "python", "def render_view(name):\n    '''Render a view as html text.'''\n    return '<p>' + name + '</p>' + str(len(name))\n"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    files = spark.createDataFrame(SOURCES, "path string, language string, source string")
    rows = sorted(symbols(files).collect(), key=lambda r: (r["path"], r["start"]))
    s = spark.createDataFrame(
        [(i, r["name"], r["qualified_name"], r["kind"], r["path"], r["signature"], r["body"], r["start"], r["end"], "python") for i, r in enumerate(rows)],
        "id long, name string, qualified_name string, kind string, file string, signature string, body string, start int, end int, file_language string",
    )
    ids = s.select("id", F.col("qualified_name").alias("caller"))
    edges = joins.resolve_calls(calls(files).join(ids, "caller").select(F.col("id").alias("src"), "callee"), s.select("id", "qualified_name"))
    docs = s.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "qualified_name", "body").alias("text"))
    return s, edges, docs


def test_graph_search(spark, corpus):
    s, edges, docs = corpus
    assert edges.count() >= 2
    s = s.withColumns({"docstring": F.lit(""), "full_body": F.lit(None).cast("string")})
    queries = spark.createDataFrame([(0, "where are pages loaded"), (1, "render html view"), (2, "store/db.py:3"), (3, "nofile/x.py:3")], "query_id long, query string")
    embedder = lambda c: embed.hash_embedding(c, 16)
    vectors = docs.select(F.col("doc_id").alias("id"), embedder(F.col("text")).alias("v"))
    qv = queries.select("query_id", embedder(F.col("query")).alias("qv"))
    rows = graph_search(queries, s, edges, qv, vectors, cfg=EngineConfig(max_results=5)).collect()
    best = {r["query_id"]: r for r in rows if r["rank"] == 1}
    assert best[1]["qualified_name"] == "view.render_view" and best[0]["qualified_name"] in {"db.load_pages", "db.Store.open_store", "db.Store"}
    assert best[2]["why"] == "locator" and best[2]["qualified_name"] == "db.Store.open_store" and best[2]["score"] == 1.0
    assert 3 in best and best[3]["why"] != "locator"
    assert {r["why"] for r in rows} <= {"hybrid_seed", "vector_seed", "fts_seed", "ppr_neighbor", "locator"}
    text_only = graph_search(queries, s, edges, cfg=EngineConfig(max_results=5)).filter("query_id = 1 and rank = 1").first()
    assert text_only["qualified_name"] == "view.render_view" and text_only["why"] == "fts_seed"
    with pytest.raises(ValueError):
        graph_search(queries, s, edges, cfg=EngineConfig(vector_only=True))
    shown = answer_context(spark.createDataFrame([(0, r["id"]) for r in rows if r["qualified_name"] == "db.load_pages"][:1], "query_id long, id long"), queries, s, edges)
    assert {(r["side"], r["total"]) for r in shown.collect()} == {("caller", 1), ("callee", 1)}


def test_graph_search_knobs(spark, corpus):
    s, edges, docs = corpus
    long_body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.when(i == 30, " decode page bytes").otherwise(""))), "\n")
    s = s.withColumns({"docstring": F.lit("Reads."), "full_body": F.when(F.col("name") == "decode", long_body)})
    queries = spark.createDataFrame([(0, "decode page bytes with `load_pages` and `open_store`")], "query_id long, query string")
    embedder = lambda c: embed.hash_embedding(c, 64)
    vectors = docs.select(F.col("doc_id").alias("id"), embedder(F.col("text")).alias("v"))
    qv = queries.select("query_id", embedder(F.col("query")).alias("qv"))
    chunks = vectors.select(F.col("id").alias("chunk_id"), "id", "v")
    cfg = EngineConfig(max_results=3, chunk_weight=0.5, identifier_weight=0.5, anchor_expand=2, anchor_agreement=1, literal_slots=1, full_bodies=2, include_trivial=True, lazy_rerank=True)
    rows = graph_search(queries, s, edges, qv, vectors, chunks, cfg, scorer=lambda qs, ts: [len(t) for t in ts], window_embedder=embedder).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and [r["detail"] for r in rows][2] == "compact" and "// Reads." in rows[2]["body"]
    cut = [r["body"] for r in graph_search(queries, s, edges, qv, vectors, cfg=EngineConfig(include_trivial=True), window_embedder=embedder).collect() if r["detail"] == "excerpt"]
    assert cut and "decode page bytes" in cut[0] and "line 1\n" not in cut[0]


def test_hybrid_without_vectors(spark, corpus):
    queries = spark.createDataFrame([(0, "decode bytes")], "query_id long, query string")
    rows = hybrid_search(queries, corpus[2], None).orderBy("rank").collect()
    assert rows[0]["running"] <= 32000 and rows[0]["rank"] == 1


def test_knn_paths_agree(spark, sf, monkeypatch):
    vec = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = vec.filter("vec_id < 7").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    args = (q, vec, "q", "qv", "vec_id", "embedding", 5)
    a, b = knn.search(*args).collect(), knn.search_blocks(*args).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in a) == sorted((r["query_id"], r["rank"], r["id"]) for r in b)
    assert knn.search_blocks(q.limit(0), vec, "q", "qv", "vec_id", "embedding", 5).count() == 0


def test_rerank_and_skip(spark):
    rows = [(0, 1, 1, 0.9, "q", "short", False), (0, 2, 2, 0.8, "q", "a much longer card", False), (1, 3, 1, 0.9, "q", "x", True), (1, 4, 2, 0.8, "q", "xxxxxx", True)]
    df = spark.createDataFrame(rows, "query_id long, id long, rank int, score double, query string, card string, skip boolean")
    got = rank.rerank(df, lambda qs, ts: [len(t) for t in ts])
    assert [r["id"] for r in got.filter("query_id = 0").orderBy("rank").collect()] == [2, 1]
    assert [r["id"] for r in got.filter("query_id = 1").orderBy("rank").collect()] == [3, 4]
    assert rank.rerank(df, None) is df


def test_embedders(spark):
    df = spark.createDataFrame([("a",), ("bbb",), (None,)], "text string")
    rows = embed.embed_with(df, "text", lambda: embed.ZeroEmbedder(4)).collect()
    assert all(list(r["vector"]) == [0.0] * 4 for r in rows)


def test_anchor_frames(spark):
    rows = [(0, i, f"f{i}", i + 1, False) for i in range(10)] + [(0, 99, "new", 11, True)]
    df = spark.createDataFrame(rows, "query_id long, id long, file string, rank long, is_anchor boolean")
    assert [r["id"] for r in fusion.reserve_slots_frame(df, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 99]
    literal = spark.createDataFrame([(0, 50, "f0", 1), (0, 51, "g", 2)], "query_id long, id long, file string, rank long")
    assert [r["id"] for r in fusion.reserve_slots_frame(df, 5, literal, 2).orderBy("rank").collect()] == [0, 1, 2, 51, 3, 99]
    pool = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, id long, rank int")
    g = spark.createDataFrame([(1, 7), (7, 1), (2, 7), (7, 2), (1, 8), (8, 1), (1, 2), (2, 1)], "a long, b long")
    ppr = spark.createDataFrame([(0, 7, 0.1)], "query_id long, id long, ppr_score double")
    near = lambda n: [r["id"] for r in fusion.append_anchor_neighbours(pool, pool, g, ppr, 5, n).filter("why = 'anchor'").orderBy("rank").collect()]
    assert near(2) == [7] and near(1) == [7, 8]


def test_literal_slots():
    ranked = [{"id": i, "file": f"f{i}"} for i in range(4)]
    assert [r["id"] for r in fusion.reserve_literal_slots(ranked, [{"id": 9, "file": "g"}, {"id": 8, "file": "f0"}], 4, 2)] == [0, 1, 9, 2, 3]


def test_commits(spark):
    hunks = spark.createDataFrame([("c1", "fix(db): keep pages in cache (#3)", "db.py", "def load_pages(path):"), ("c2", "typo", "db.py", "def load_pages")], "commit string, subject string, path string, context string")
    sym = spark.createDataFrame([("db.py", "load_pages", "db.load_pages")], "path string, name string, qualified_name string")
    assert [(r["commit"], r["gold"]) for r in resolve_commits(hunks, sym).collect()] == [("c1", ["db.load_pages"])]


def test_incremental_keeps_edges_of_unchanged_callers(spark):
    sym = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, file_id long")
    edges = spark.createDataFrame([(1, 2), (3, 1)], "src long, dst long")
    replaced = spark.createDataFrame([(20,)], "file_id long")
    assert [r["file_id"] for r in maintain.edge_dependents(edges, sym, replaced).collect()] == [10]


def test_chunks_of_one_line_are_none(spark):
    df = spark.createDataFrame([(1, "x" * 9000), (2, "\n".join("l" * 9 for _ in range(71)))], "doc_id long, text string")
    got = [(r["id"], r["start"], r["end"]) for r in pack.chunk_lines(df, "doc_id", "text").orderBy("start").collect()]
    assert got == [(2, 1, 40), (2, 31, 70), (2, 61, 71)]
