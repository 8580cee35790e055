"""Queries of retrieval channels, fusion and graph operators."""

from pyspark.sql import functions as F

from wherry.operators import bm25, fusion, graph, knn
from wherry.queries.base import Tables, big, query, r6

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"

BM25_CTE = rf"""
q AS (SELECT item_id AS query_id, unnest(list_distinct({TOK.format('text')})) AS term FROM benchmark),
dt AS (SELECT doc_id AS doc, {TOK.format('text')} AS toks FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM dt),
po AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM dt) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT q.query_id, po.doc, sum(ln(1 + (n_docs - df.df + 0.5) / (df.df + 0.5)) * po.tf * 2.2 / (po.tf + 1.2 * (0.25 + 0.75 * len(dt.toks) / avg_len))) AS score
  FROM q JOIN po ON q.term = po.term JOIN df ON df.term = po.term JOIN dt ON dt.doc = po.doc CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM sc)"""

VEC_CTE = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
ks AS (SELECT b.item_id AS query_id, v.vec_id AS id, 1 / (1 + sqrt(greatest(0, 2 - 2 * list_inner_product(qv.e, v.e)))) AS score
  FROM benchmark b JOIN v qv ON qv.vec_id = b.item_id CROSS JOIN v),
kn AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ks)"""


def bm25_top(x: Tables, k: int):
    return bm25.search(x.benchmark, x.documents, "item_id", "text", "doc_id", "text", k=k)


def query_vectors(x: Tables):
    return x.benchmark.select("item_id").join(x.embeddings, F.col("item_id") == F.col("vec_id")).select("item_id", F.col("embedding").alias("qv"))


def knn_top(x: Tables, k: int):
    return knn.search(query_vectors(x), x.embeddings, "item_id", "qv", "vec_id", "embedding", k)


@query("ret_bm25", f"WITH {BM25_CTE} SELECT query_id, doc, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM bm WHERE rank <= 20")
def ret_bm25(x: Tables):
    return bm25_top(x, 20).select("query_id", "doc", r6("score").alias("score"), big("rank").alias("rank"))


@query(
    "ret_bm25_idf_floor",
    f"WITH {BM25_CTE.replace('ln(1 + (n_docs - df.df + 0.5) / (df.df + 0.5))', 'greatest(ln((n_docs - df.df + 0.5) / (df.df + 0.5)), 1e-6)')} SELECT query_id, doc, round(score, 6) AS score FROM bm WHERE rank <= 10",
)
def ret_bm25_idf_floor(x: Tables):
    return bm25.search(x.benchmark, x.documents, "item_id", "text", "doc_id", "text", idf=bm25.idf_floor, k=10).select("query_id", "doc", r6("score").alias("score"))


@query("ret_knn", f"WITH {VEC_CTE} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM kn WHERE rank <= 20")
def ret_knn(x: Tables):
    return knn_top(x, 20).select("query_id", "id", r6("score").alias("score"), big("rank").alias("rank"))


@query("ret_knn_blocks", f"WITH {VEC_CTE} SELECT query_id, id, round(score, 6) AS score FROM kn WHERE rank <= 20")
def ret_knn_blocks(x: Tables):
    return knn.search_blocks(query_vectors(x), x.embeddings, "item_id", "qv", "vec_id", "embedding", 20).select("query_id", "id", r6("score").alias("score"))


@query(
    "ret_chunk_knn",
    f"WITH {VEC_CTE}, ch AS (SELECT kn.query_id, v.label AS owner, kn.score, kn.rank, row_number() OVER (PARTITION BY kn.query_id, v.label ORDER BY kn.rank) AS n FROM kn JOIN v ON v.vec_id = kn.id WHERE kn.rank <= 20) SELECT query_id, CAST(owner AS BIGINT) AS owner, round(score, 6) AS score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM ch WHERE n = 1) WHERE r <= 5",
)
def ret_chunk_knn(x: Tables):
    return knn.best_chunk(query_vectors(x), x.embeddings, "item_id", "qv", "vec_id", "label", "embedding", 5).select("query_id", big("owner").alias("owner"), r6("score").alias("score"), big("rank").alias("rank"))


RRF_CTE = f"{BM25_CTE}, {VEC_CTE}, fu AS (SELECT query_id, id, sum(p) AS score, max(f) AS from_text, max(g) AS from_vector FROM (SELECT query_id, doc AS id, 1.0 / (60 + rank) AS p, 1 AS f, 0 AS g FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, id, 1.0 / (60 + rank), 0, 1 FROM kn WHERE rank <= 50) GROUP BY 1, 2), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fu)"


def rrf_top(x: Tables, k: int):
    text = bm25_top(x, 50).select("query_id", F.col("doc").alias("id"), "rank")
    vector = knn_top(x, 50).select("query_id", "id", "rank")
    return fusion.rrf({"text": (text, 1.0), "vector": (vector, 1.0)}, k)


@query("ret_rrf", f"WITH {RRF_CTE} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank, from_text = 1 AS from_text, from_vector = 1 AS from_vector FROM rr WHERE rank <= 20")
def ret_rrf(x: Tables):
    return rrf_top(x, 20).select("query_id", "id", r6("score").alias("score"), big("rank").alias("rank"), "from_text", "from_vector")


@query(
    "ret_hybrid_pack",
    f"WITH {RRF_CTE}, c AS (SELECT rr.query_id, rr.id, rr.rank, greatest(1, CAST(floor((octet_length(encode(d.text)) + 3) / 4) AS BIGINT)) AS tokens FROM rr JOIN documents d ON d.doc_id = rr.id WHERE rr.rank <= 30), p AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM c) SELECT query_id, id, CAST(rank AS BIGINT) AS rank, tokens, CAST(running AS BIGINT) AS running FROM p WHERE running <= 32000",
)
def ret_hybrid_pack(x: Tables):
    """The flagship: two channels, fused, cut to a token budget."""
    from wherry.plans.search import hybrid_search

    return hybrid_search(x.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), x.documents, x.embeddings).select("query_id", "id", big("rank").alias("rank"), "tokens", "running")


@query(
    "ret_max_sim",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id, e FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS q, v.label AS label, max(list_inner_product(q.e, v.e)) AS m FROM q CROSS JOIN v GROUP BY 1, 2) SELECT CAST(label AS BIGINT) AS label, round(sum(m), 6) AS score FROM s GROUP BY label""",
)
def ret_max_sim(x: Tables):
    """Late interaction of one query of several vectors with documents of many: partial maxima before the sum."""
    best = knn.best_by_label(x.embeddings.filter("vec_id % 100 = 0"), x.embeddings, "vec_id", "embedding", "label", "embedding")
    return best.groupBy(big("label").alias("label")).agg(r6(F.sum("m")).alias("score"))


# The bipartite order graph: customers and orders as nodes, an order's customer as an edge.
EDGE_SQL = "e AS (SELECT o_custkey AS src, 1000000000 + o_orderkey AS dst FROM orders), g AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), n AS (SELECT DISTINCT a AS id FROM g), dg AS (SELECT a AS id, count(*) AS degree FROM g GROUP BY a)"


def order_graph(x: Tables):
    e = x.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000).alias("dst"))
    nodes = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    return e, nodes, graph.build(e, nodes)


@query("gr_build", f"WITH {EDGE_SQL} SELECT a, b FROM g")
def gr_build(x: Tables):
    return order_graph(x)[2].select(big("a").alias("a"), big("b").alias("b"))


@query("gr_hub_penalty", f"WITH {EDGE_SQL} SELECT id, round(degree / (SELECT max(degree) FROM dg), 6) AS penalty FROM dg")
def gr_hub_penalty(x: Tables):
    return graph.hub_penalty(order_graph(x)[2]).select(big("id").alias("id"), r6("penalty").alias("penalty"))


def _ppr_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM seeds) AS s FROM seeds)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS (SELECT id, sum(p) AS s FROM (SELECT g.b AS id, 0.85 * r.s / dg.degree AS p FROM r{k - 1} r JOIN g ON g.a = r.id JOIN dg ON dg.id = r.id UNION ALL SELECT id, 0.15 / (SELECT count(*) FROM seeds) FROM seeds) GROUP BY id)"
        )
    return f"WITH {EDGE_SQL}, seeds AS (SELECT DISTINCT id FROM n WHERE id IN (1, 2, 7, 10, 11)), {', '.join(steps)} SELECT id, round(s, 6) AS score FROM r{rounds}"


@query("gr_pagerank", _ppr_sql(30))
def gr_pagerank(x: Tables):
    """As many rounds as the engine makes; the change of a round is above its tolerance until then."""
    _, nodes, g = order_graph(x)
    seeds = nodes.filter(F.col("id").isin(1, 2, 7, 10, 11)).select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(1.0).alias("weight"))
    return graph.personalized_pagerank(g, nodes, seeds).select(big("id").alias("id"), r6("score").alias("score"))


def _unseeded_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0 / n AS s FROM n, t)"]
    for k in range(1, rounds + 1):
        steps.append(f"l{k} AS (SELECT coalesce(sum(s), 0) / (SELECT n FROM t) AS m FROM r{k - 1} r WHERE r.id NOT IN (SELECT id FROM dg))")
        steps.append(f"r{k} AS (SELECT id, sum(p) AS s FROM (SELECT g.b AS id, 0.85 * r.s / dg.degree AS p FROM r{k - 1} r JOIN g ON g.a = r.id JOIN dg ON dg.id = r.id UNION ALL SELECT n.id, (0.15 + 0.85 * m) / t.n FROM n, t, l{k}) GROUP BY id)")
    return f"WITH e AS (SELECT n_nationkey AS src, 100 + n_regionkey AS dst FROM nation WHERE n_nationkey <> 3), g AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), n AS (SELECT n_nationkey AS id FROM nation UNION ALL SELECT 100 + r_regionkey FROM region), t AS (SELECT count(*) AS n FROM n), dg AS (SELECT a AS id, count(*) AS degree FROM g GROUP BY a), {', '.join(steps)} SELECT id, round(s, 6) AS score FROM r{rounds}"


@query("gr_pagerank_unseeded", _unseeded_sql(5))
def gr_pagerank_unseeded(x: Tables):
    """A query whose seed is no node restarts at all nodes; one nation has no edge and loses mass."""
    e = x.nation.filter("n_nationkey != 3").select(big("n_nationkey").alias("src"), (big("n_regionkey") + 100).alias("dst"))
    nodes = x.nation.select(big("n_nationkey").alias("id")).union(x.region.select(big("r_regionkey") + 100))
    seeds = x.region.filter("r_regionkey = 0").select(F.lit(0).cast("long").alias("query_id"), F.lit(-1).cast("long").alias("id"), F.lit(1.0).alias("weight"))
    return graph.personalized_pagerank(graph.build(e, nodes), nodes, seeds, rounds=5, tolerance=None).select("id", r6("score").alias("score"))


@query(
    "gr_blend",
    """WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS seed, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 97 END AS ppr FROM orders),
    f AS (SELECT query_id, id, CAST(0.7 AS DOUBLE) * (seed / max(seed) OVER (PARTITION BY query_id)) + (1 - CAST(0.7 AS DOUBLE)) * coalesce(coalesce(ppr, 0.0) / nullif(max(ppr) OVER (PARTITION BY query_id), 0), 0) AS fused FROM c)
    SELECT query_id, id, round(fused, 6) AS fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS BIGINT) AS fused_rank FROM f""",
)
def gr_blend(x: Tables):
    c = x.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("seed_score"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 97).cast("double")).alias("ppr_score"))
    return fusion.blend(c, F.lit(0.7)).select("query_id", "id", r6("fused").alias("fused"), big("fused_rank").alias("fused_rank"))


@query(
    "gr_alpha",
    "SELECT event_id, CASE WHEN (value % 100) / 100 >= 0.60 THEN 0.92 WHEN (value % 100) / 100 >= 0.35 AND (event_id % 50) / 100.0 >= 0.20 THEN 0.85 ELSE 0.70 END AS alpha FROM events",
)
def gr_alpha(x: Tables):
    return x.events.select("event_id", fusion.effective_alpha((F.col("value") % 100) / 100, (F.col("event_id") % 50) / 100).alias("alpha"))


@query(
    "gr_append_missing",
    f"WITH {RRF_CTE}, pool AS (SELECT query_id, id, rank FROM rr WHERE rank <= 10), ex AS (SELECT k.query_id, k.id, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS n FROM kn k LEFT JOIN pool p ON p.query_id = k.query_id AND p.id = k.id WHERE k.rank <= 50 AND p.id IS NULL) SELECT query_id, id, CAST(rank AS BIGINT) AS rank, 'pool' AS why FROM pool UNION ALL SELECT ex.query_id, ex.id, CAST(m.last + ex.n AS BIGINT), 'vector_seed' FROM ex JOIN (SELECT query_id, max(rank) AS last FROM pool GROUP BY 1) m ON m.query_id = ex.query_id WHERE ex.n <= 5",
)
def gr_append_missing(x: Tables):
    return fusion.append_missing(rrf_top(x, 10), knn_top(x, 50), 5, "vector_seed").select("query_id", "id", big("rank").alias("rank"), "why")


@query(
    "gr_protect_top",
    f"WITH {RRF_CTE}, h AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN -1 ELSE id END AS id FROM kn WHERE rank = 1), z AS (SELECT query_id, count(*) AS n FROM rr WHERE rank <= 20 GROUP BY 1), p AS (SELECT query_id, id, 0 AS rank FROM h UNION ALL SELECT rr.query_id, rr.id, rr.rank FROM rr LEFT JOIN h ON h.query_id = rr.query_id AND h.id = rr.id WHERE rr.rank <= 20 AND h.id IS NULL), o AS (SELECT p.query_id, p.id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank, p.id) AS rank, z.n FROM p JOIN z ON z.query_id = p.query_id) SELECT query_id, id, CAST(rank AS BIGINT) AS rank FROM o WHERE rank <= n",
)
def gr_protect_top(x: Tables):
    """Every third query's top seed is one that the list lacks."""
    head = knn_top(x, 1).select("query_id", F.when(F.col("query_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("id")).alias("id"))
    return fusion.protect_top_seed(rrf_top(x, 20).select("query_id", "id", "rank"), head).select("query_id", "id", big("rank").alias("rank"))


@query(
    "gr_anchor_neighbours",
    f"""WITH {EDGE_SQL}, a AS (SELECT DISTINCT src % 7 AS query_id, dst AS id FROM e WHERE (dst - 1000000000) % 4 = 1), hits AS (SELECT a.query_id, g.b AS id, count(*) AS hits FROM a JOIN g ON g.a = a.id GROUP BY 1, 2 HAVING count(*) >= 2),
    pool AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM (SELECT DISTINCT src % 7 AS query_id, src AS id FROM e)), pl AS (SELECT query_id, id, k AS rank FROM pool WHERE k <= 3),
    r AS (SELECT h.query_id, h.id, row_number() OVER (PARTITION BY h.query_id ORDER BY hits DESC, (h.id * 7919) % 1000 DESC, h.id) AS k FROM hits h LEFT JOIN a ON a.query_id = h.query_id AND a.id = h.id WHERE a.id IS NULL),
    nb AS (SELECT r.query_id, r.id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.k) AS k FROM r LEFT JOIN pl ON pl.query_id = r.query_id AND pl.id = r.id WHERE pl.id IS NULL), m AS (SELECT query_id, max(rank) AS last FROM pl GROUP BY 1)
    SELECT query_id, id, CAST(rank AS BIGINT) AS rank, 'pool' AS why FROM pl UNION ALL SELECT nb.query_id, nb.id, CAST(k + last AS BIGINT), 'anchor' FROM nb JOIN m ON m.query_id = nb.query_id WHERE k <= 10""",
)
def gr_anchor_neighbours(x: Tables):
    """Seven queries whose anchors are orders; what several of them share are their customers. A pool of three of those."""
    from pyspark.sql import Window

    e, _, g = order_graph(x)
    by = (F.col("src") % 7).cast("long").alias("query_id")
    anchors = e.filter("(dst - 1000000000) % 4 = 1").select(by, F.col("dst").alias("id")).distinct()
    mine = e.select(by, F.col("src").cast("long").alias("id")).distinct()
    pool = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter("rank <= 3")
    walked = mine.withColumn("ppr_score", ((F.col("id") * 7919) % 1000).cast("double"))
    return fusion.append_anchor_neighbours(pool, anchors, g, walked, 10).select("query_id", big("id").alias("id"), big("rank").alias("rank"), "why")


@query(
    "gr_callers",
    "WITH e AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS other FROM lineitem), r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS n, count(*) OVER (PARTITION BY id) AS total FROM e) SELECT id, other, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM r WHERE n <= 5",
)
def gr_callers(x: Tables):
    e = x.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.neighbours(e, 5).select("id", "other", big("n").alias("n"), big("total").alias("total"))


TWO_SQL = "e0 AS (SELECT DISTINCT l_partkey AS src, 10000000 + l_suppkey AS dst FROM lineitem WHERE l_linenumber = 1), e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), st AS (SELECT DISTINCT dst AS id FROM e0 WHERE dst % 25 = 0)"


@query(
    "gr_two_hops",
    f"""WITH {TWO_SQL},
    n1 AS (SELECT st.id, e.dst AS other FROM st JOIN e ON e.src = st.id UNION SELECT st.id, e.src FROM st JOIN e ON e.dst = st.id),
    f AS (SELECT u.id, b.src AS other, 0 AS side FROM (SELECT st.id, e.src AS mid FROM st JOIN e ON e.dst = st.id) u JOIN e b ON b.dst = u.mid UNION ALL SELECT d.id, b.dst, 1 FROM (SELECT st.id, e.dst AS mid FROM st JOIN e ON e.src = st.id) d JOIN e b ON b.src = d.mid),
    m AS (SELECT f.id, f.other, min(side) AS side FROM f LEFT JOIN n1 ON n1.id = f.id AND n1.other = f.other WHERE f.id <> f.other AND n1.id IS NULL GROUP BY 1, 2)
    SELECT id, other, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, other) AS rank FROM m) WHERE rank <= 5""",
)
def gr_two_hops(x: Tables):
    """Parts and their first suppliers, edges both ways; every twenty-fifth supplier asks."""
    e = x.lineitem.filter("l_linenumber = 1").select(big("l_partkey").alias("src"), (big("l_suppkey") + 10_000_000).alias("dst")).distinct()
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.two_hops(both, e.filter("dst % 25 = 0").select(F.col("dst").alias("id")).distinct()).select(big("id").alias("id"), big("other").alias("other"), big("rank").alias("rank"))


@query(
    "gr_hop_distance",
    """WITH g AS (SELECT DISTINCT a, b FROM (SELECT n_regionkey AS a, 100 + n_nationkey AS b FROM nation UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation)), v AS (SELECT DISTINCT a FROM g), p AS (SELECT x.a, y.a AS b FROM v x CROSS JOIN v y)
    SELECT p.a, p.b, CASE WHEN p.a = p.b THEN 0 WHEN EXISTS (SELECT 1 FROM g WHERE g.a = p.a AND g.b = p.b) THEN 1 WHEN EXISTS (SELECT 1 FROM g x JOIN g y ON x.b = y.a WHERE x.a = p.a AND y.b = p.b) THEN 2 ELSE 3 END AS hops FROM p""",
)
def gr_hop_distance(x: Tables):
    n = x.nation
    g = n.select(F.col("n_regionkey").cast("long").alias("a"), (F.col("n_nationkey") + 100).cast("long").alias("b"))
    g = g.union(g.select("b", "a")).distinct()
    v = g.select("a").distinct()
    return graph.hop_distance(v.crossJoin(F.broadcast(v.select(F.col("a").alias("b")))), g)


@query(
    "gr_chunk_graph",
    "WITH d AS (SELECT md5(text) AS name, doc_id AS chunk FROM documents), u AS (SELECT name, min(chunk) AS dst FROM d GROUP BY 1 HAVING count(DISTINCT chunk) = 1), c AS (SELECT chunk + 1 AS chunk, name FROM d) SELECT DISTINCT c.chunk AS src, u.dst FROM c JOIN u ON u.name = c.name WHERE c.chunk <> u.dst",
)
def gr_chunk_graph(x: Tables):
    d = x.documents.select(F.md5(F.col("text").cast("binary")).alias("name"), F.col("doc_id").alias("chunk"))
    return graph.chunk_graph(d, d.select("name", (F.col("chunk") + 1).alias("chunk")))


@query(
    "gr_degree_report",
    "SELECT p_partkey, (SELECT count(*) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS fan_in, (SELECT count(DISTINCT l_suppkey) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS fan_out FROM part p",
)
def gr_degree_report(x: Tables):
    d = x.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("fan_in"), F.countDistinct("l_suppkey").alias("fan_out"))
    return x.part.select("p_partkey").join(d, "p_partkey", "left").select("p_partkey", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
