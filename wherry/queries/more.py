"""Queries of context, coverage, event-time windows and extension points."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.functions import embed
from wherry.functions import text as t
from wherry.functions import vec as v
from wherry.operators import context, graph, joins, pack, rank
from wherry.queries.base import Tables, big, query, r6
from wherry.queries.ranking import RANKED_SQL, ranked
from wherry.streaming import events as ev


@query(
    "gc_siblings",
    """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), a AS (SELECT id AS anchor, e FROM v WHERE id IN (SELECT item_id FROM benchmark)), n AS (SELECT a.anchor, v.id, 1 / (1 + sqrt(greatest(0, 2 - 2 * list_inner_product(a.e, v.e)))) AS score FROM a CROSS JOIN v),
    r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, id) AS r FROM n), f AS (SELECT anchor, id, row_number() OVER (PARTITION BY anchor ORDER BY r) AS n FROM r WHERE r <= 10 AND score >= 0.75 AND id <> anchor AND id % 5 <> 0) SELECT anchor, id, CAST(n AS BIGINT) AS n FROM f WHERE n <= 3""",
)
def gc_siblings(x: Tables):
    vec = x.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = F.lit(0).cast("long").alias("query_id")
    anchors = vec.join(x.benchmark.select(F.col("item_id").alias("id")), "id", "left_semi").select(q, F.col("id").alias("anchor"), "v")
    chosen = vec.filter("id % 5 = 0").select(q, "id")
    return context.siblings(anchors, vec, chosen).select("anchor", "id", big("n").alias("n"))


@query(
    "gc_structure",
    """WITH r AS (SELECT o_custkey AS query_id, 'p' || (o_orderkey % 3) AS package, 's' || (o_orderkey % 10) AS name FROM orders), g AS (SELECT query_id, package, string_agg(DISTINCT name, ',' ORDER BY name) AS symbols, count(*) AS n FROM r GROUP BY 1, 2) SELECT query_id, package, symbols, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, package) = 1 AS top FROM g""",
)
def gc_structure(x: Tables):
    r = x.orders.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("package"), F.concat(F.lit("s"), (F.col("o_orderkey") % 10).cast("string")).alias("name"))
    return context.structure_view(r).select("query_id", "package", F.array_join("symbols", ",").alias("symbols"), "n", "top")


@query(
    "gc_name_context",
    """WITH e AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS other FROM lineitem), o AS (SELECT id, other, (other % 7) / 7.0 AS overlap FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, other) AS n, count(*) OVER (PARTITION BY id) AS total FROM o) SELECT id, other, CAST(n AS BIGINT) AS n, total FROM r WHERE n <= 3""",
)
def gc_name_context(x: Tables):
    refs = x.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("other")).distinct().withColumn("overlap", (F.col("other") % 7) / 7.0)
    return graph.name_context(refs, 3).select("id", "other", big("n").alias("n"), "total")


@query(
    "gc_call_site",
    r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '10 a | 11 if x { | 13 ' || lang || '() | 14 }' WHEN 1 THEN '10 a | 11 if x {' WHEN 2 THEN '' ELSE '' END AS site FROM documents""",
)
def gc_call_site(x: Tables):
    """Calls behind a branch, on it, before it and outside of the body; a blank line is left out."""
    body = F.concat(F.lit("a\r\n  if x {\n\n"), F.col("lang"), F.lit("()\n}\nz"))
    call = F.element_at(F.array(F.lit(13), F.lit(11), F.lit(10), F.lit(40)), (F.col("doc_id") % 4 + 1).cast("int"))
    return x.documents.select("doc_id", pack.call_site(body, F.lit(10), call).alias("site"))


@query("ev_render", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) || chr(10) || '// ...' || chr(10) || array_to_string(string_split(text, chr(10))[4:4], chr(10)) AS shown FROM documents WHERE len(string_split(text, chr(10))) >= 4")
def ev_render(x: Tables):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    rows = x.documents.filter(F.size(F.split("text", "\n")) >= 4)
    return rows.select("doc_id", pack.render_spans(F.col("text"), F.array(span(1, 2), span(4, 4))).alias("shown"))


@query(
    "j_linked_tests",
    """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'parse' ELSE 'run' END || lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') AS name FROM part WHERE p_partkey % 2 = 0), t AS (SELECT p_partkey AS test_id, CASE WHEN p_partkey % 3 = 0 THEN 'reparse' || lpad(CAST((p_partkey - 1) % 1000 AS VARCHAR), 4, '0') || 'test' ELSE 'test_run' || lpad(CAST((p_partkey - 1) % 1000 AS VARCHAR), 4, '0') END AS name FROM part WHERE p_partkey % 2 = 1),
    h AS (SELECT s.id, t.test_id FROM s JOIN t ON contains(t.name, s.name) OR contains(s.name, t.name)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY test_id) AS n FROM h) SELECT id, test_id, CAST(n AS BIGINT) AS n FROM r WHERE n <= 3""",
)
def j_linked_tests(x: Tables):
    """Names within names, also where no word of the one is a word of the other."""
    k = F.col("p_partkey")
    digits = lambda c: F.lpad((c % 1000).cast("string"), 4, "0")
    s = x.part.filter("p_partkey % 2 = 0").select(k.alias("id"), F.concat(F.lit("pkg."), F.when(k % 4 == 0, "Parse").otherwise("run"), digits(k)).alias("name"))
    tests = x.part.filter("p_partkey % 2 = 1").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("reparse"), digits(k - 1), F.lit("Test"))).otherwise(F.concat(F.lit("test_run"), digits(k - 1))).alias("name"))
    return joins.linked_tests(s, tests).select("id", "test_id", big("n").alias("n"))


@query(
    "ag_chain_coverage",
    """WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber = 1), s AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber = 2), h AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber <= 3)
    SELECT h.src AS chain, h.dst AS hop, CASE WHEN h.dst % 9 = 0 THEN 'dispatch' WHEN e.src IS NOT NULL THEN 'graph' WHEN s.src IS NOT NULL THEN 'sibling' ELSE 'missed' END AS verdict FROM h LEFT JOIN e ON e.src = h.src AND e.dst = h.dst LEFT JOIN s ON s.src = h.src AND s.dst = h.dst""",
)
def ag_chain_coverage(x: Tables):
    p = lambda cond: x.lineitem.filter(cond).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    hops = p("l_linenumber <= 3").select("src", "dst", F.col("src").alias("chain"), F.col("dst").alias("hop"), (F.col("dst") % 9 == 0).alias("dispatch"))
    return context.chain_coverage(hops, p("l_linenumber = 1"), p("l_linenumber = 2"))


@query(
    "ag_region_misses",
    """WITH r AS (SELECT p_partkey AS region, p_partkey % 30 AS file, CAST(p_size AS BIGINT) AS a, CAST(p_size + 3 AS BIGINT) AS b FROM part), s AS (SELECT DISTINCT l_suppkey % 20 AS file, l_linenumber * 8 AS a, l_linenumber * 8 + 2 AS b, l_linenumber * 8 - 3 AS ba, l_linenumber * 8 + 4 AS bb FROM lineitem WHERE l_linenumber <> 3), i AS (SELECT DISTINCT l_suppkey % 25 AS file, l_linenumber * 7 AS a, l_linenumber * 7 + 6 AS b FROM lineitem WHERE l_linenumber <> 5),
    v AS (SELECT r.region, coalesce(bool_or(r.a <= s.b AND s.a <= r.b), false) AS hit, coalesce(bool_or(r.a <= s.bb AND s.ba <= r.b), false) AS held, bool_or(s.file IS NOT NULL) AS seen FROM r LEFT JOIN s ON s.file = r.file GROUP BY 1), k AS (SELECT DISTINCT r.region FROM r JOIN i ON i.file = r.file AND r.a <= i.b AND i.a <= r.b)
    SELECT v.region, CASE WHEN hit THEN 'hit' WHEN held THEN 'trimmed' WHEN k.region IS NULL THEN 'not_indexed' WHEN seen THEN 'wrong_symbol' ELSE 'file_missed' END AS verdict FROM v LEFT JOIN k ON k.region = v.region""",
)
def ag_region_misses(x: Tables):
    regions = x.part.select(F.col("p_partkey").alias("region"), (F.col("p_partkey") % 30).alias("file"), big("p_size").alias("start"), (big("p_size") + 3).alias("end"))
    n = F.col("l_linenumber")
    shown = x.lineitem.filter(n != 3).select((F.col("l_suppkey") % 20).alias("file"), (n * 8).alias("start"), (n * 8 + 2).alias("end"), (n * 8 - 3).alias("body_start"), (n * 8 + 4).alias("body_end")).distinct()
    symbols = x.lineitem.filter(n != 5).select((F.col("l_suppkey") % 25).alias("file"), (n * 7).alias("start"), (n * 7 + 6).alias("end")).distinct()
    return context.region_misses(regions, shown, symbols)


@query("ag_self_report", f"WITH {RANKED_SQL}, w AS (SELECT query_id, min(id) AS want_id FROM rl GROUP BY 1), p AS (SELECT rl.query_id, min(CASE WHEN rl.id = want_id THEN rank END) AS place FROM rl JOIN w USING (query_id) GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0 END), 6) AS hit10, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0 END), 6) AS by_name FROM p")
def ag_self_report(x: Tables):
    rows = ranked(x).withColumn("name", F.concat(F.lit("a."), F.col("id").cast("string")))
    want = rows.groupBy("query_id").agg(F.min("id").alias("want_id")).withColumn("name", F.col("want_id").cast("string"))
    return context.self_report(rows, want).select("n", *(r6(c).alias(c) for c in ("hit1", "hit10", "by_name")))


@query("ag_file_reach", f"WITH {RANKED_SQL}, f AS (SELECT query_id, file, min(rank) AS rank FROM rl GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, file) AS place FROM f), g AS (SELECT DISTINCT query_id FROM rl) SELECT g.query_id, CAST(min(p.place) AS BIGINT) AS place FROM g LEFT JOIN p ON p.query_id = g.query_id AND p.file = 'f1.ts' GROUP BY 1")
def ag_file_reach(x: Tables):
    rows = ranked(x)
    return context.file_reach(rows, rows.select("query_id").distinct().withColumn("file", F.lit("f1.ts"))).select("query_id", big("place").alias("place"))


@query("ag_false_confidence", f"WITH {RANKED_SQL} SELECT CAST(query_id % 3 AS BIGINT) AS suite, count(*) AS n, round(avg(CASE WHEN score > 0.85 THEN 1.0 ELSE 0 END), 6) AS rate FROM rl WHERE rank = 1 GROUP BY 1")
def ag_false_confidence(x: Tables):
    top = ranked(x).filter("rank = 1")
    return top.groupBy(big(F.col("query_id") % 3).alias("suite")).agg(F.count("*").alias("n"), r6(F.avg((F.col("score") > 0.85).cast("double"))).alias("rate"))


@query(
    "ag_alpha_sweep",
    """WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS id, (o_orderkey * 7919 % 1000) / 1000.0 AS s, (o_orderkey * 104729 % 1000) / 1000.0 AS p FROM orders), a AS (SELECT unnest([0.0, 0.5, 1.0]) AS alpha), r AS (SELECT alpha, query_id, id, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(CAST(alpha * s + (1 - alpha) * p AS DOUBLE), 9) DESC, id) AS rank FROM c CROSS JOIN a) SELECT CAST(alpha AS DOUBLE) AS alpha, round(avg(CASE WHEN id % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS hit1 FROM r WHERE rank = 1 GROUP BY 1""",
)
def ag_alpha_sweep(x: Tables):
    c = x.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919 % 1000) / 1000.0).alias("s"), ((F.col("o_orderkey") * 104729 % 1000) / 1000.0).alias("p"))
    grid = c.withColumn("alpha", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    score = F.round(F.col("alpha") * F.col("s") + (1 - F.col("alpha")) * F.col("p"), 9)
    top = grid.withColumn("rank", F.row_number().over(Window.partitionBy("alpha", "query_id").orderBy(F.desc(score), "id"))).filter("rank = 1")
    return top.groupBy("alpha").agg(r6(F.avg((F.col("id") % 3 == 0).cast("double"))).alias("hit1"))


@query("ev_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ev_tumbling(x: Tables):
    rows = ev.windowed_counts(x.events.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "ev_sessions",
    """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ev_sessions(x: Tables):
    rows = ev.session_counts(x.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("v_cosine", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def v_cosine(x: Tables):
    a = x.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = x.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", r6(v.cosine(F.col("a"), F.col("b"))).alias("c"))


@query("v_mean_pool", "WITH v AS (SELECT vec_id // 10 AS g, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[64] AS DOUBLE) AS b FROM embeddings) SELECT g, round(avg(a), 6) AS first, round(avg(b), 6) AS last FROM v GROUP BY g")
def v_mean_pool(x: Tables):
    g = x.embeddings.groupBy(big(F.floor(F.col("vec_id") / 10)).alias("g")).agg(F.collect_list(v.as_doubles(F.col("embedding"))).alias("toks"))
    m = g.select("g", embed.mean_pool(F.col("toks")).alias("m"))
    return m.select("g", r6(F.get("m", F.lit(0))).alias("first"), r6(F.get("m", F.lit(63))).alias("last"))


@query("v_hash_embedding", "SELECT item_id, CAST(1.0 AS DOUBLE) AS norm FROM benchmark WHERE regexp_matches(text, '[a-z]')")
def v_hash_embedding(x: Tables):
    e = embed.hash_embedding(F.col("text"), 64)
    return x.benchmark.filter(F.col("text").rlike("[a-z]")).select("item_id", F.round(v.norm(e), 6).alias("norm"))


@query("rk_lexical_relevance", "SELECT p_partkey, round(1 / (1 + exp(-(CASE WHEN p_partkey % 2 = 0 THEN 4.0 ELSE 2.0 END - 2))), 6) AS relevance FROM part")
def rk_lexical_relevance(x: Tables):
    even = F.col("p_partkey") % 2 == 0
    rows = x.part.select("p_partkey", F.lit("alpha").alias("query"), F.when(even, "alpha").otherwise("zeta").alias("qualified_name"), F.lit("sig").alias("signature"), F.when(even, "zeta").otherwise("alpha").alias("body"))
    return rank.lexical_relevance(rows).select("p_partkey", r6("relevance").alias("relevance"))


@query("rk_skip_rerank", "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS skip FROM part")
def rk_skip_rerank(x: Tables):
    k = F.col("p_partkey")
    rows = x.part.select(
        "p_partkey",
        F.when(k % 3 == 0, "where is load_part now").otherwise("where is something else now").alias("query"),
        F.lit("pkg.load_part").alias("qualified_name"),
        F.lit(False).alias("is_constructor"),
        F.lit(0.6).alias("name_overlap"),
        F.lit(1.0).alias("score"),
        F.when(k % 5 == 0, 0.4).otherwise(0.9).alias("second"),
        F.lit("fts_seed").alias("why"),
    )
    return rank.skip_rerank(rows).select("p_partkey", "skip")


@query("s_query_identifiers", "SELECT item_id, 'read_' || item_id || ',parseItem' || item_id AS ids FROM benchmark")
def s_query_identifiers(x: Tables):
    k = F.col("item_id").cast("string")
    raw = F.concat(F.lit("Fix parseItem"), k, F.lit(" when `read_"), k, F.lit("` fails, see read_"), k)
    return x.benchmark.select("item_id", F.array_join(t.query_identifiers(raw, 8), ",").alias("ids"))


@query(
    "ag_deep_probe",
    """WITH d AS (SELECT doc_id, list_transform(range(1, 15), lambda i: CASE WHEN i = 9 + doc_id % 3 THEN 'alphaBeta gammaDelta ' || lang || 'word' ELSE 'ab' END) AS l FROM documents), p AS (SELECT doc_id AS id, 100 + 8 + doc_id % 3 AS line, 4 + doc_id % 3 AS depth, 'alpha,beta,gamma,delta,' || lang || 'word' AS tokens FROM documents)
    SELECT id, CAST(line AS BIGINT) AS line, CAST(depth AS BIGINT) AS depth, tokens FROM p JOIN documents ON doc_id = id""",
)
def ag_deep_probe(x: Tables):
    """Fourteen lines of which four are shown; one of the hidden ones has words."""
    at = F.col("doc_id") % 3 + 9
    lines = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(14).cast("long")), lambda i: F.when(i == at, F.concat(F.lit("alphaBeta gammaDelta "), "lang", F.lit("word"))).otherwise("ab"))
    rows = x.documents.select(F.col("doc_id").alias("id"), F.lit(100).alias("start"), F.lit("a\nb\nc\nd\n// ... [truncated]").alias("excerpt"), F.array_join(lines, "\n").alias("full_body"))
    p = context.deep_probes(rows)
    return p.select("id", big("line").alias("line"), big("depth").alias("depth"), F.array_join("tokens", ",").alias("tokens"))


@query(
    "ag_deep_coverage",
    """WITH p AS (SELECT p_partkey AS id, p_size AS line FROM part), s AS (SELECT p_partkey AS id, p_partkey % 9 + 1 AS rank FROM part WHERE p_partkey % 4 <> 0), j AS (SELECT p.id, p.line, s.rank, s.rank IS NOT NULL AND (p.line BETWEEN 1 AND 10 OR p.line BETWEEN 20 AND 25) AS c FROM p LEFT JOIN s ON s.id = p.id)
    SELECT count(*) AS n, count(rank) AS retrieved, count(*) FILTER (c) AS covered, count(*) FILTER (rank <= 6) AS in_tier, count(*) FILTER (rank <= 6 AND c) AS covered_in_tier, CAST(count(*) FILTER (rank <= 6) * 16 AS BIGINT) AS lines FROM j""",
)
def ag_deep_coverage(x: Tables):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    k = F.col("p_partkey")
    probes = x.part.select(k.alias("id"), F.col("p_size").alias("line"))
    shown = x.part.filter(k % 4 != 0).select(k.alias("query_id"), k.alias("id"), (k % 9 + 1).alias("rank"), F.array(span(1, 10), span(20, 25)).alias("spans"))
    return context.deep_coverage(probes, shown)


@query(
    "gc_next_steps",
    f"""WITH {RANKED_SQL}, c AS (SELECT *, 'pkg.s' || id AS name, CASE WHEN score > 0.85 AND (CASE WHEN lead(score) OVER w IS NULL OR score <= 0 THEN 1 ELSE (score - lead(score) OVER w) / score END) > 0.10 THEN 'high' WHEN score > 0.65 THEN 'medium' ELSE 'low' END AS conf FROM rl WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
    g AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN conf END) AS conf, max(CASE WHEN rank = 1 THEN id END) AS id, max(CASE WHEN rank = 1 THEN score END) AS s0, max(CASE WHEN rank = 2 THEN score END) AS s1, string_agg(CASE WHEN rank <= 3 THEN '#' || rank || '=s' || id END, ', ' ORDER BY rank) AS three FROM c GROUP BY 1)
    SELECT query_id, CASE WHEN conf = 'high' THEN (CASE WHEN id % 2 = 0 THEN 'Read #1. Blast radius: 4 callers (a, b, c).' ELSE 'Read #1. No callers found — likely a leaf or entry point.' END) WHEN n >= 2 THEN 'Confidence is ' || conf || '. Consider top-' || least(n, 3) || ' before acting.' END AS if_top_correct, CASE WHEN n >= 2 AND s0 > 0 AND (s0 - s1) / s0 < 0.15 THEN 'Top-3 are similar candidates. ' || three || '. Pick by what your task needs.' END AS if_unsure FROM g""",
)
def gc_next_steps(x: Tables):
    none = F.array().cast("array<string>")
    rows = rank.assign_confidence(ranked(x)).withColumns({"qualified_name": F.concat(F.lit("pkg.s"), F.col("id").cast("string")), "callers": F.when(F.col("id") % 2 == 0, F.array(*[F.lit(c) for c in "abcd"])).otherwise(none)})
    return context.next_steps(rows)


@query("sv_stale", "SELECT p_partkey AS id, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS stale FROM part")
def sv_stale(x: Tables):
    k = F.col("p_partkey")
    asked = x.part.select(k.alias("id"), F.when(k % 3 == 0, "old").otherwise(F.col("p_name")).alias("qualified_name"), F.lit("function").alias("kind"))
    now = x.part.filter(k % 5 != 0).select(k.alias("id"), F.col("p_name").alias("qualified_name"), F.lit("function").alias("kind"))
    return context.stale_expansions(asked, now).select("id", "stale")


@query(
    "sv_numbered",
    "SELECT doc_id, '10' || chr(9) || lang || chr(10) || '11' || chr(9) || 'b' || chr(10) || '// ...' || chr(10) || '40' || chr(9) || source AS shown, '7' || chr(9) || source AS one FROM documents",
)
def sv_numbered(x: Tables):
    seg = lambda a, n: F.struct(F.lit(a).alias("start"), F.lit(n).alias("lines"))
    body = F.concat("lang", F.lit("\nb\n// ...\n"), "source")
    return x.documents.select("doc_id", context.numbered_body(body, F.array(seg(10, 2), seg(40, 1))).alias("shown"), context.numbered_body(F.col("source"), F.array(seg(7, 1))).alias("one"))


@query(
    "sv_render",
    f"WITH {RANKED_SQL}, p AS (SELECT query_id, rank, rank || '. **p.s' || id || '** ' || file || ':1-9 (low)' || CASE WHEN rank > 3 THEN ' — sig doc' WHEN rank = 2 THEN ' [excerpt]' || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' ELSE chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' END AS part FROM rl) SELECT query_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY rank)) AS text FROM p GROUP BY 1",
)
def sv_render(x: Tables):
    r = F.col("rank")
    rows = ranked(x).select("query_id", "rank", "file", F.concat(F.lit("p.s"), F.col("id").cast("string")).alias("qualified_name"), F.lit(1).alias("start"), F.lit(9).alias("end"), F.lit("low").alias("confidence"), F.when(r > 3, "compact").when(r == 2, "excerpt").otherwise("full").alias("detail"), F.when(r > 3, "sig\ndoc").otherwise("x").alias("body"))
    return context.render_answer(rows).select("query_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query(
    "src_git_log",
    "SELECT 'c' || p_partkey AS \"commit\", 'keep pages of ' || p_partkey AS subject, 'db.load' || p_partkey AS gold FROM part WHERE p_partkey % 4 = 1",
)
def src_git_log(x: Tables):
    """A log of one commit for each part: every fourth names one symbol in a subject of four words about one thing."""
    from wherry.sources.readers import parse_log, resolve_commits

    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    subject = F.when(k % 4 == 1, F.concat(F.lit("fix(db): keep pages of "), key, F.lit(" (#7)"))).when(k % 4 == 2, "keep, drop, and load pages").when(k % 4 == 3, "typo").otherwise("keep pages of the cache")
    name = F.when(k % 4 == 0, "func return other").otherwise(F.concat(F.lit("def load"), key, F.lit("(path):")))
    log = x.part.select(F.concat(F.lit("\x01c"), key, F.lit("\x1f"), subject, F.lit("\n\ndiff --git a/old.py b/sub/db.py\nindex 1..2\n--- a\n+++ b\n@@ -1,2 +3 @@ "), name, F.lit("\n-x\n+y\n@@ -9 +9 @@\n-z\n")).alias("text"))
    symbols = x.part.select(F.lit("db.py").alias("path"), F.concat(F.lit("load"), key).alias("name"), F.concat(F.lit("db.load"), key).alias("qualified_name"))
    return resolve_commits(parse_log(log, prefix="sub/"), symbols).select("commit", "subject", F.array_join("gold", ",").alias("gold"))


def search_tables(x: Tables):
    """Documents as symbols of files by source, order lines as calls between them, embeddings as their vectors."""
    key = F.col("doc_id").cast("string")
    symbols = x.documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("load"), key).alias("name"), F.concat("source", F.lit(".load"), key).alias("qualified_name"), F.lit("function").alias("kind"),
        F.concat("source", F.lit("/f"), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 9 == 0, "_test.go").otherwise(".go")).alias("file"),
        F.concat(F.lit("func load"), key, F.lit("()")).alias("signature"), F.lit("").alias("docstring"), pack.cap_body(F.col("text")).alias("body"), F.when(F.octet_length("text") > 2000, F.col("text")).alias("full_body"),
        (F.col("doc_id") % 50 + 1).cast("int").alias("start"), (F.col("doc_id") % 50 + 30).cast("int").alias("end"), F.lit("go").alias("file_language"),
    )
    edges = x.lineitem.select(big("l_partkey").alias("src"), big("l_suppkey").alias("dst")).distinct()
    queries = x.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 10 == 0, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("/f1.go:20"))).otherwise(F.col("text")).alias("query"))
    vectors = x.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return queries, symbols, edges, queries.select("query_id").join(vectors, F.col("query_id") == F.col("id")).select("query_id", F.col("v").alias("qv")), vectors


@query("ret_graph_search")
def ret_graph_search(x: Tables):
    """The whole plan with its shipped knobs; some questions name a position. Checked by rules in tests, not by SQL."""
    from wherry.plans.search import graph_search

    return graph_search(*search_tables(x)).select("query_id", "id", "file", big("rank").alias("rank"), r6("score").alias("score"), "why", "confidence", "visibility", "detail", "tokens", "running")
