"""Queries of sources, maintenance, metrics, sampling and adoption."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.operators import maintain, metrics
from wherry.queries.base import Tables, big, query, r6
from wherry.queries.ranking import RANKED_SQL, ranked
from wherry.queries.retrieval import BM25_CTE, bm25_top
from wherry.sources import readers

PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(
    "src_walk",
    rf"""WITH f AS (SELECT page_id, {PATH} AS path, html FROM pages) SELECT path, sha256(html) AS hash, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM f
    WHERE octet_length(encode(html)) <= 1048576 AND NOT regexp_matches(path, '(^|/)(\.[^/]*|node_modules|vendor|dist|build|target)/') AND NOT regexp_matches(left(html, 2048), 'Code generated.*DO NOT EDIT')""",
)
def src_walk(x: Tables):
    files = x.pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), F.col("html").alias("content"))
    return readers.walk(files, languages=None).select("path", "hash", big("size").alias("size"))


@query(
    "src_known_hash",
    "SELECT page_id, page_id % 3 = 0 AS reused, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE sha256(html) END AS hash FROM pages",
)
def src_known_hash(x: Tables):
    files = x.pages.select("page_id", F.col("page_id").cast("string").alias("path"), F.octet_length("html").alias("size"), F.lit(1).alias("mtime"), F.col("html").alias("content"))
    known = files.select("path", "size", F.when(F.col("page_id") % 3 == 0, 1).otherwise(2).alias("mtime"), F.lit("old").alias("hash"))
    return maintain.known_hash(files, known).select("page_id", "reused", "hash")


@query("src_lookup_ids", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def src_lookup_ids(x: Tables):
    return x.documents.select("doc_id", "source").join(x.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")


@query("src_by_language", "SELECT d.doc_id, d.lang FROM documents d WHERE d.lang = 'fr'")
def src_by_language(x: Tables):
    return x.documents.filter("lang = 'fr'").select("doc_id", "lang")


@query("src_meta_scan", "SELECT doc_id, lang, source FROM documents")
def src_meta_scan(x: Tables):
    return x.documents.select("doc_id", "lang", "source")


@query("src_json_props", "SELECT event_id, event_type FROM events WHERE json_valid(props)")
def src_json_props(x: Tables):
    return x.events.filter(F.expr("try_parse_json(props)").isNotNull()).select("event_id", "event_type")


@query("src_unwrap_query", """SELECT item_id, text AS query FROM benchmark""")
def src_unwrap_query(x: Tables):
    """A JSON string inside a JSON string is unwrapped, others are taken as they are."""
    wrapped = F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("q")))).otherwise(F.lit(None))
    inner = F.regexp_extract(wrapped, r'(?s)^\{"q":(.*)\}$', 1)
    return x.benchmark.select("item_id", readers.unwrap_json_string(F.coalesce(inner, F.col("text"))).alias("query"))


@query("src_overlay", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type || chr(10) || p_name ELSE p_name END AS doc FROM part")
def src_overlay(x: Tables):
    overlay = x.part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("summary"))
    return readers.overlay_docs(x.part.select("p_partkey", F.col("p_name").alias("doc")), overlay, "p_partkey").select("p_partkey", "doc")


@query(
    "src_grep_cost",
    "WITH n AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS needle FROM benchmark), u AS (SELECT DISTINCT needle FROM n), h AS (SELECT DISTINCT u.needle, d.source FROM u JOIN documents d ON contains(d.text, u.needle)), f AS (SELECT n.item_id, n.needle, count(*) AS files FROM n JOIN h ON h.needle = n.needle GROUP BY 1, 2) SELECT item_id, count(*) AS needles, CAST(sum(files) AS BIGINT) AS reads, min(files) AS fewest FROM f GROUP BY 1",
)
def src_grep_cost(x: Tables):
    """The words of each question as needles: how many have a file, how many files a reader opens, and for the rarest needle."""
    needles = x.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), 0))).alias("needle"))
    hits = readers.grep_files(needles, x.documents.select(F.col("source").alias("file"), "text")).groupBy("query_id", "needle").agg(F.count("*").alias("files"))
    return hits.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("needles"), F.sum("files").alias("reads"), F.min("files").alias("fewest"))


@query(
    "src_reads_to_target",
    "WITH n AS (SELECT DISTINCT item_id, regexp_extract(lower(text), '[a-z]{8,}', 0) AS needle FROM benchmark), h AS (SELECT DISTINCT n.item_id, d.source FROM n JOIN documents d ON n.needle <> '' AND contains(d.text, n.needle)), r AS (SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY source) AS k FROM h) SELECT item_id, CAST(min(CASE WHEN source = 'src7' THEN k END) AS BIGINT) AS reads FROM r GROUP BY 1",
)
def src_reads_to_target(x: Tables):
    needles = x.benchmark.select(F.col("item_id").alias("query_id"), F.regexp_extract(F.lower("text"), "[a-z]{8,}", 0).alias("needle")).filter("needle != ''").distinct()
    hits = readers.grep_files(needles, x.documents.select(F.col("source").alias("file"), "text")).select("query_id", "file").distinct()
    return readers.reads_to_target(hits, hits.select("query_id").distinct().withColumn("file", F.lit("src7"))).select(F.col("query_id").alias("item_id"), big("reads").alias("reads"))


OLD = "old AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN 'x' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 10 <> 7)"


def old_new(x: Tables):
    d = x.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return d.filter("doc_id % 10 != 3"), d.filter("doc_id % 10 != 7").withColumn("hash", F.when(F.col("doc_id") % 10 == 5, "x").otherwise(F.col("hash")))


@query("snk_change_set", f"WITH {OLD} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.doc_id = n.doc_id")
def snk_change_set(x: Tables):
    return maintain.change_set(*old_new(x), key="doc_id")


@query("snk_upsert", "WITH o AS (SELECT n_name AS path, n_nationkey AS id FROM nation WHERE n_nationkey < 20) SELECT path, id FROM o UNION ALL SELECT n_name, n_nationkey FROM nation WHERE n_nationkey BETWEEN 20 AND 19")
def snk_upsert(x: Tables):
    old = x.nation.filter("n_nationkey < 20").select(F.col("n_name").alias("path"), big("n_nationkey").alias("id"))
    return maintain.upsert(old, old.filter("id % 2 = 0").withColumn("id", F.lit(None).cast("long")), "path")


@query(
    "snk_cascade",
    "SELECT 'files' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'symbols', count(*) FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT 'edges', count(*) FROM lineitem a WHERE a.l_orderkey % 5 <> 0 AND (a.l_orderkey + 5) % 5 <> 0",
)
def snk_cascade(x: Tables):
    sid = lambda k: (F.col("l_orderkey") + k) * 10 + F.col("l_linenumber")
    tables = {
        "files": x.orders.select(F.col("o_orderkey").alias("id")),
        "symbols": x.lineitem.select(sid(0).alias("id"), F.col("l_orderkey").alias("file_id")),
        "edges": x.lineitem.select(sid(0).alias("src"), sid(5).alias("dst")),
    }
    left = maintain.cascade_delete(tables, tables["files"].filter("id % 5 = 0"))
    return left["files"].select(F.lit("files").alias("kind")).union(left["symbols"].select(F.lit("symbols"))).union(left["edges"].select(F.lit("edges"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("snk_insert_edges", "WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) SELECT src, dst, kind, min(seq) AS seq FROM e GROUP BY 1, 2, 3")
def snk_insert_edges(x: Tables):
    e = x.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return maintain.insert_edges(e.limit(0), e)


@query("snk_replace", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS gen FROM embeddings")
def snk_replace(x: Tables):
    old = x.embeddings.select("vec_id", F.lit("old").alias("gen"))
    return maintain.replace_rows(old, old.filter("vec_id % 3 = 0").withColumn("gen", F.lit("new")), "vec_id")


@query("snk_reuse_vectors", "SELECT doc_id, CAST(count(*) OVER (PARTITION BY text) > 0 AND source IN ('src0', 'src1') OR text IN (SELECT text FROM documents WHERE source IN ('src0', 'src1')) AS BOOLEAN) AS reused FROM documents")
def snk_reuse_vectors(x: Tables):
    stored = x.documents.filter("source in ('src0', 'src1')").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), F.lit(1.0).alias("vector"))
    return maintain.reuse_vectors(x.documents.withColumnRenamed("text", "embedding_text"), stored).select("doc_id", F.col("vector").isNotNull().alias("reused"))


@query(
    "snk_dependents",
    "WITH e AS (SELECT l_orderkey AS f, l_partkey AS src, l_suppkey AS dst FROM lineitem), s AS (SELECT p_partkey AS id, p_size AS file_id FROM part), c AS (SELECT DISTINCT e.src FROM e JOIN s ON s.id = e.dst WHERE s.file_id < 5) SELECT DISTINCT s.file_id FROM s JOIN c ON c.src = s.id WHERE s.file_id >= 5",
)
def snk_dependents(x: Tables):
    e = x.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    s = x.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("file_id"))
    return maintain.edge_dependents(e, s, s.filter("file_id < 5").select("file_id").distinct())


@query("snk_redacted_export", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'h:' || left(sha256(CAST(user_id AS VARCHAR)), 12) END AS user_hash, event_type FROM events")
def snk_redacted_export(x: Tables):
    from wherry.functions.text import redact

    return x.events.select("event_id", redact(F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("user_id").cast("string"))).alias("user_hash"), "event_type")


@query(
    "flt_doc_noise",
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda z: trim(z)), lambda z: z <> '' AND NOT regexp_matches(z, '^[@\\][a-zA-Z]+') AND NOT regexp_matches(z, '^(NOLINT|nolint|noinspection|eslint-|prettier-|tslint:|@ts-|istanbul |c8 |codebeat|SPDX-|Copyright|coverage:)') AND NOT regexp_matches(z, '^[-=~_*{}\[\]()<>|/\\ \t]*$') AND NOT regexp_matches(z, '^[/*!#]')) AS k FROM documents WHERE NOT regexp_matches(text, '(^|\n)\s*[/*!#]|\*/'))
    SELECT doc_id, CASE WHEN regexp_matches(trim(array_to_string(k, chr(10))), '\S\s+\S') THEN trim(array_to_string(k, chr(10))) ELSE '' END AS doc FROM l""",
)
def flt_doc_noise(x: Tables):
    return x.documents.filter(~F.col("text").rlike(r"(^|\n)\s*[/*!#]|\*/")).select("doc_id", readers.normalize_docstring(F.col("text")).alias("doc"))


@query(
    "flt_selfcases",
    """WITH s AS (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE length(text) >= 40) SELECT doc_id FROM s WHERE n = 1""",
)
def flt_selfcases(x: Tables):
    return readers.unique_docs(x.documents, "doc_id", "text", 40).select("doc_id")


@query("flt_enrichable", "SELECT p_partkey FROM part WHERE p_size >= 3 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def flt_enrichable(x: Tables):
    return x.part.filter("p_size >= 3").join(x.lineitem.filter("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


CASE_SQL = f"""{RANKED_SQL}, ex AS (SELECT query_id, id FROM rl WHERE id % 3 = 1), cs AS (SELECT DISTINCT query_id, 1 + query_id % 2 AS min_hits FROM rk),
h AS (SELECT rl.query_id, min(rank) AS f, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END) AS dcg FROM rl JOIN ex USING (query_id, id) GROUP BY 1), ne AS (SELECT query_id, count(*) AS n FROM ex GROUP BY 1),
pc AS (SELECT cs.query_id, CAST(coalesce(f = 1, false) AS INTEGER) AS hit1, CAST(coalesce(f <= 3, false) AS INTEGER) AS hit3, CAST(coalesce(h5, 0) >= min_hits AS INTEGER) AS recall5, CAST(coalesce(h10, 0) >= min_hits AS INTEGER) AS recall10, coalesce(1.0 / f, 0) AS mrr,
 CASE WHEN coalesce(n, 0) > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, n) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg5 FROM cs LEFT JOIN h USING (query_id) LEFT JOIN ne USING (query_id))"""


def cases(x: Tables):
    rows = ranked(x)
    want = rows.filter("id % 3 = 1").select("query_id", "id")
    return metrics.case_metrics(rows, want, rows.select("query_id", (1 + F.col("query_id") % 2).alias("min_hits")).distinct())


@query("ag_cases", f"WITH {CASE_SQL} SELECT query_id, hit1, hit3, recall5, recall10, round(mrr, 6) AS mrr, round(ndcg5, 6) AS ndcg5 FROM pc")
def ag_cases(x: Tables):
    return cases(x).select("query_id", "hit1", "hit3", "recall5", "recall10", r6("mrr").alias("mrr"), r6("ndcg5").alias("ndcg5"))


MEAN_SQL = "count(*) AS n, round(avg(hit1), 6) AS hit1, round(avg(hit3), 6) AS hit3, round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, round(avg(mrr), 6) AS mrr, round(avg(ndcg5), 6) AS ndcg5"


def rounded(df, *keys):
    return df.select(*keys, "n", *(r6(m).alias(m) for m in metrics.MEANS))


@query("ag_summary", f"WITH {CASE_SQL} SELECT {MEAN_SQL} FROM pc")
def ag_summary(x: Tables):
    return rounded(metrics.summarize(cases(x)))


@query("ag_by_tag", f"WITH {CASE_SQL}, t AS (SELECT *, unnest(CASE WHEN query_id % 3 = 0 THEN ['untagged'] WHEN query_id % 3 = 1 THEN ['a'] ELSE ['a', 'b'] END) AS tag FROM pc) SELECT tag, {MEAN_SQL} FROM t GROUP BY tag")
def ag_by_tag(x: Tables):
    m = F.col("query_id") % 3
    tags = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return rounded(metrics.by_tag(cases(x).withColumn("tags", tags)), "tag")


@query("ag_weighted", f"WITH {CASE_SQL} SELECT {MEAN_SQL} FROM pc")
def ag_weighted(x: Tables):
    """Project summaries weighted by their cases give the pooled means again."""
    return rounded(metrics.weighted(metrics.summarize(cases(x).withColumn("project", F.col("query_id") % 4), ["project"])))


# Judgements: each label belongs to one question, so they grow with the labels alone.
QREL_SQL = "qr AS (SELECT DISTINCT doc_id % 40 AS query_id, doc_id AS id, quality + toxic AS grade FROM labels)"
GRADED = f"""WITH {BM25_CTE}, {QREL_SQL}, gd AS (SELECT * FROM qr WHERE grade > 0),
i AS (SELECT query_id, sum(CASE WHEN n <= 10 THEN (pow(2, grade) - 1) / log2(n + 1) END) AS ideal, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS n FROM gd) GROUP BY 1),
d AS (SELECT bm.query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END) AS dcg, count(*) FILTER (rank <= 100) AS found FROM bm JOIN gd ON gd.query_id = bm.query_id AND gd.id = bm.doc GROUP BY 1), pq AS (SELECT i.query_id, coalesce(dcg, 0) / ideal AS ndcg, coalesce(found, 0) / i.n AS recall FROM i LEFT JOIN d USING (query_id))"""


def judged(x: Tables):
    return x.labels.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("grade")).distinct()


def graded(x: Tables):
    rows = bm25_top(x, 100).select("query_id", F.col("doc").alias("id"), "rank")
    return metrics.graded_ndcg(rows, judged(x))


@query("ag_graded_ndcg", GRADED + " SELECT query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM pq")
def ag_graded_ndcg(x: Tables):
    return graded(x).select("query_id", r6("ndcg").alias("ndcg"), r6("recall").alias("recall"))


@query("ag_pooled_macro", GRADED + ", gr AS (SELECT query_id % 3 AS repo, ndcg FROM pq), o AS (SELECT CAST(repo AS VARCHAR) AS repo, count(*) AS n, avg(ndcg) AS v FROM gr GROUP BY 1) SELECT repo, n, round(v, 6) AS value FROM o UNION ALL SELECT 'POOLED', count(*), round(avg(ndcg), 6) FROM gr UNION ALL SELECT 'MACRO', count(*), round(avg(v), 6) FROM o")
def ag_pooled_macro(x: Tables):
    return metrics.pooled_and_macro(graded(x).withColumn("repo", F.col("query_id") % 3), "repo", "ndcg").select("repo", "n", r6("value").alias("value"))


SHOWN = """sh AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_suppkey % 3 AS file, l_partkey % 40 AS start, l_partkey % 40 + l_linenumber AS "end" FROM lineitem), gr AS (SELECT l_orderkey AS query_id, l_suppkey % 3 AS file, l_partkey % 40 + 1 AS start, l_partkey % 40 + 4 AS "end" FROM lineitem WHERE l_linenumber % 2 = 1)"""


def shown_gold(x: Tables):
    rows = x.lineitem
    start = big(F.col("l_partkey") % 40)
    shown = rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 3).alias("file"), start.alias("start"), (start + F.col("l_linenumber")).alias("end"))
    gold = rows.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 3).alias("file"), (start + 1).alias("start"), (start + 4).alias("end"))
    return shown, gold


@query(
    "ag_explore",
    f"""WITH {SHOWN}, g AS (SELECT DISTINCT query_id, file, unnest(range(start, "end" + 1)) AS line FROM gr), s AS (SELECT DISTINCT query_id, file, unnest(range(start, "end" + 1)) AS line FROM sh), gf AS (SELECT DISTINCT query_id, file FROM gr), sf AS (SELECT query_id, file, min(rank) AS rank FROM sh GROUP BY 1, 2),
    a AS (SELECT query_id, count(*) AS gl FROM g GROUP BY 1), b AS (SELECT query_id, count(*) AS sl FROM s GROUP BY 1), c AS (SELECT query_id, count(*) AS cv FROM s JOIN g USING (query_id, file, line) GROUP BY 1), d AS (SELECT query_id, count(*) AS nf FROM gf GROUP BY 1), e AS (SELECT query_id, count(*) AS ff, min(rank) AS fu FROM sf JOIN gf USING (query_id, file) GROUP BY 1), u AS (SELECT query_id, count(*) AS uf FROM sf GROUP BY 1),
    m AS (SELECT d.query_id, coalesce(ff, 0) AS ff, nf, coalesce(cv, 0) / gl AS r, coalesce(cv, 0) / sl AS p, coalesce(fu, 0) AS fu, uf FROM d JOIN a USING (query_id) JOIN b USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN e USING (query_id) JOIN u USING (query_id))
    SELECT query_id, CAST(ff > 0 AS INTEGER) AS hit_file, round(ff / nf, 6) AS file_recall, round(r, 6) AS line_recall, round(p, 6) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1, CAST(fu AS BIGINT) AS first_useful, uf AS unique_files FROM m""",
)
def ag_explore(x: Tables):
    shown, gold = shown_gold(x)
    m = metrics.explore_metrics(shown, gold, gold.select("query_id", "file"))
    return m.select("query_id", "hit_file", *(r6(c).alias(c) for c in ("file_recall", "line_recall", "precision", "f1")), big("first_useful").alias("first_useful"), "unique_files")


@query("ag_line_budget", f"""WITH {SHOWN}, n AS (SELECT query_id, rank, max("end" - start + 1) AS lines FROM sh GROUP BY 1, 2), r AS (SELECT *, sum(lines) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM n) SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(running AS BIGINT) AS running FROM r WHERE running <= 12""")
def ag_line_budget(x: Tables):
    shown = shown_gold(x)[0].groupBy("query_id", "rank").agg(F.max(F.col("end") - F.col("start") + 1).alias("lines"))
    return metrics.line_prefix(shown, 12).select("query_id", big("rank").alias("rank"), big("running").alias("running"))


@query(
    "ag_budget_ndcg",
    f"""WITH {SHOWN}, rg AS (SELECT query_id, file, start, least(CASE WHEN query_id % 8 = 1 THEN start + 90 WHEN query_id % 8 = 2 THEN start + 9000 ELSE "end" END, start + 5000) AS "end" FROM gr), g AS (SELECT DISTINCT query_id, file, unnest(range(start, "end" + 1)) AS line FROM rg), f AS (SELECT s.query_id, s.file, s.line, min(s.rank) AS rank FROM (SELECT query_id, rank, file, unnest(range(start, "end" + 1)) AS line FROM sh) s JOIN g USING (query_id, file, line) GROUP BY 1, 2, 3), d AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM f GROUP BY 1),
    z AS (SELECT *, "end" - start + 1 AS n FROM rg), i AS (SELECT query_id, n, row_number() OVER w AS i, sum(n) OVER (PARTITION BY query_id ORDER BY n DESC, file, start ROWS UNBOUNDED PRECEDING) AS spent FROM z WINDOW w AS (PARTITION BY query_id ORDER BY n DESC, file, start)), k AS (SELECT query_id, sum(n / log2(i + 1)) AS ideal FROM i WHERE spent <= 12 GROUP BY 1), q AS (SELECT DISTINCT query_id FROM gr)
    SELECT q.query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg_b FROM q LEFT JOIN k ON k.query_id = q.query_id LEFT JOIN d ON d.query_id = q.query_id""",
)
def ag_budget_ndcg(x: Tables):
    """Some questions have a first region beyond the budget (they score 0), some a region that is clipped."""
    shown, gold = shown_gold(x)
    k = F.col("query_id") % 8
    gold = gold.withColumn("end", F.when(k == 1, F.col("start") + 90).when(k == 2, F.col("start") + 9000).otherwise(F.col("end")))
    return metrics.budget_ndcg(shown, gold, 12).select("query_id", r6("ndcg_b").alias("ndcg_b"))


@query("ag_hit_region", f"""WITH {SHOWN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file, start, "end") AS k FROM gr), h AS (SELECT r.query_id, r.k, max(CASE WHEN s.query_id IS NULL THEN 0 ELSE 1 END) AS hit FROM r LEFT JOIN (SELECT * FROM sh WHERE rank <= 2) s ON s.query_id = r.query_id AND s.file = r.file AND r.start <= s."end" AND s.start <= r."end" GROUP BY 1, 2) SELECT query_id, round(avg(hit), 6) AS hit_region FROM h GROUP BY 1""")
def ag_hit_region(x: Tables):
    shown, gold = shown_gold(x)
    return metrics.hit_region(shown.filter("rank <= 2"), gold).select("query_id", r6("hit_region").alias("hit_region"))


@query(
    "ag_run_diff",
    "WITH a AS (SELECT n_name AS metric, n_nationkey / 25.0 AS v FROM nation WHERE n_nationkey <> 3), b AS (SELECT n_name AS metric, n_nationkey / 25.0 + (n_nationkey % 3 - 1) * 0.05 AS v FROM nation WHERE n_nationkey <> 4) SELECT coalesce(a.metric, b.metric) AS metric, round(b.v - a.v, 6) AS delta, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'gone' WHEN abs(b.v - a.v) <= 0.02 THEN 'even' WHEN b.v > a.v THEN 'better' ELSE 'worse' END AS verdict FROM a FULL JOIN b ON a.metric = b.metric",
)
def ag_run_diff(x: Tables):
    k = F.col("n_nationkey")
    base = x.nation.filter("n_nationkey != 3").select(F.col("n_name").alias("metric"), (k / 25.0).alias("value"))
    now = x.nation.filter("n_nationkey != 4").select(F.col("n_name").alias("metric"), (k / 25.0 + (k % 3 - 1) * 0.05).alias("value"))
    return metrics.run_diff(base, now).select("metric", r6("delta").alias("delta"), "verdict")


@query(
    "ag_threshold_sweep",
    "WITH t AS (SELECT unnest([10.0, 50.0, 90.0]) AS threshold) SELECT event_type, CAST(threshold AS DOUBLE) AS threshold, round(count(*) FILTER (value < threshold) / count(*), 6) AS share FROM events CROSS JOIN t GROUP BY 1, 2",
)
def ag_threshold_sweep(x: Tables):
    return metrics.threshold_sweep(x.events, [10.0, 50.0, 90.0], "event_type", "value").select("event_type", "threshold", r6("share").alias("share"))


@query("ag_index_stats", "SELECT (SELECT count(*) FROM documents) AS symbols, (SELECT count(*) FROM lineitem) AS edges, (SELECT count(*) FROM documents WHERE length(text) > 2000) AS capped, round((SELECT count(*) FROM lineitem) / (SELECT count(*) FROM documents), 6) AS edges_per_symbol")
def ag_index_stats(x: Tables):
    s = maintain.index_stats(x.documents.select(F.left("text", F.lit(2000)).alias("excerpt")), x.lineitem, x.documents.filter(F.char_length("text") > 2000).select(F.col("text").alias("body")))
    return s.select("symbols", "edges", "capped", r6("edges_per_symbol").alias("edges_per_symbol"))


@query(
    "ag_adoption",
    """WITH n AS (SELECT ts FROM events WHERE event_type = 'view'), s AS (SELECT DISTINCT ts FROM events WHERE event_type = 'click'), f AS (SELECT count(*) AS followed FROM n WHERE EXISTS (SELECT 1 FROM s WHERE s.ts >= n.ts AND s.ts <= n.ts + INTERVAL 10 MINUTE))
    SELECT count(*) FILTER (event_type IN ('click', 'purchase')) AS retrievals, count(*) FILTER (event_type = 'click') AS positional, count(*) FILTER (event_type = 'view') AS nudges, count(*) FILTER (event_type = 'error') AS blocked, count(*) FILTER (event_type = 'signup') AS searched_after, (SELECT followed FROM f) AS followed FROM events""",
)
def ag_adoption(x: Tables):
    kind = F.create_map(*[F.lit(v) for v in ("view", "nudge", "click", "positional", "purchase", "served", "error", "blocked", "signup", "searched")])[F.col("event_type")]
    return metrics.adoption(x.events.select("ts", kind.alias("kind")), 600)


@query(
    "ag_latency",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type AS stage, round(max(CASE WHEN i = floor((n - 1) * 0.5) + 1 THEN value END), 6) AS p50, round(max(CASE WHEN i = floor((n - 1) * 0.95) + 1 THEN value END), 6) AS p95, round(max(value), 6) AS top FROM r GROUP BY 1""",
)
def ag_latency(x: Tables):
    points = metrics.nearest_rank(x.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "top": 1.0})
    return points.select(F.col("event_type").alias("stage"), r6("p50").alias("p50"), r6("p95").alias("p95"), r6("top").alias("top"))


@query(
    "ag_drift",
    f"WITH {RANKED_SQL}, a AS (SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM rl GROUP BY 1), b AS (SELECT query_id, string_agg(CAST(CASE WHEN query_id % 4 = 0 AND rank = 1 THEN -id ELSE id END AS VARCHAR), ',' ORDER BY rank) AS ids FROM rl GROUP BY 1) SELECT a.query_id, a.ids <> b.ids AS moved FROM a JOIN b USING (query_id)",
)
def ag_drift(x: Tables):
    listed = lambda df: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))
    rows = ranked(x)
    again = rows.withColumn("id", F.when((F.col("query_id") % 4 == 0) & (F.col("rank") == 1), -F.col("id")).otherwise(F.col("id")))
    return listed(rows).join(listed(again).withColumnRenamed("ids", "now"), "query_id").select("query_id", (F.col("ids") != F.col("now")).alias("moved"))


@query("sm_stride", "WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS i, count(*) OVER () AS t FROM part) SELECT p_partkey FROM n WHERE i IN (SELECT CAST(floor(k * (t / 20.0)) AS BIGINT) FROM range(20) r(k))")
def sm_stride(x: Tables):
    return metrics.stride_sample(x.part, [F.col("p_name"), F.col("p_partkey")], 20).select("p_partkey")


@query(
    "sm_hard_negatives",
    f"WITH {BM25_CTE}, rel AS (SELECT DISTINCT doc_id % 40 AS query_id, doc_id AS id FROM labels WHERE quality = 1), n AS (SELECT bm.query_id, doc AS id, row_number() OVER (PARTITION BY bm.query_id ORDER BY rank) AS n FROM bm LEFT JOIN rel ON rel.query_id = bm.query_id AND rel.id = bm.doc WHERE rel.id IS NULL) SELECT query_id, id, CAST(n AS BIGINT) AS n FROM n WHERE n <= 8",
)
def sm_hard_negatives(x: Tables):
    """A list of eight and as many as a question has good documents holds eight others."""
    good = x.labels.filter("quality = 1").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id")).distinct()
    most = good.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = bm25_top(x, 8 + most).select("query_id", F.col("doc").alias("id"), "rank")
    return metrics.hard_negatives(rows, good).select("query_id", "id", big("n").alias("n"))


@query(
    "sm_training_rows",
    f"WITH {BM25_CTE}, rel AS (SELECT DISTINCT doc_id % 40 AS query_id, doc_id AS id FROM labels WHERE quality = 1), p AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM rel), n AS (SELECT bm.query_id, doc AS id, row_number() OVER (PARTITION BY bm.query_id ORDER BY rank) AS n FROM bm LEFT JOIN rel ON rel.query_id = bm.query_id AND rel.id = bm.doc WHERE rel.id IS NULL), ng AS (SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS negatives FROM n WHERE n <= 8 GROUP BY 1) SELECT p.query_id, string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id) AS positives, ng.negatives FROM p JOIN ng ON ng.query_id = p.query_id WHERE k <= 4 GROUP BY 1, 3",
)
def sm_training_rows(x: Tables):
    good = x.labels.filter("quality = 1").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id")).distinct()
    most = good.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = bm25_top(x, 8 + most).select("query_id", F.col("doc").alias("id"), "rank")
    made = metrics.training_rows(metrics.hard_negatives(rows, good), good)
    return made.select("query_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("positives", "negatives")))


@query(
    "sm_holdout",
    "WITH s AS (SELECT DISTINCT source FROM documents), h AS (SELECT source, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(source, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM s) SELECT source, h % 100 < 30 AS held_out FROM h",
)
def sm_holdout(x: Tables):
    return x.documents.select("source").distinct().select("source", metrics.holdout(F.col("source"), 30).alias("held_out"))


@query(
    "sm_language_vote",
    "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, arg_max(lang, n * 1000 - ascii(lang)) AS lang FROM c GROUP BY 1",
)
def sm_language_vote(x: Tables):
    c = x.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.max_by("lang", F.col("n") * 1000 - F.ascii("lang")).alias("lang"))


@query(
    "w_sessions",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(max(value), 6) AS top FROM events GROUP BY user_id""",
)
def w_sessions(x: Tables):
    return x.events.groupBy("user_id").agg(F.count("*").alias("n"), r6(F.max("value")).alias("top"))


@query("st_compaction", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 4 AS compact FROM conversations")
def st_compaction(x: Tables):
    return x.conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) > 4).alias("compact"))


@query(
    "st_gate",
    "WITH a AS (SELECT conv_id, turn, role, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first_answer FROM conversations), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM a WHERE role <> 'assistant' AND (first_answer IS NULL OR turn < first_answer)) SELECT conv_id, turn, n <= 3 AS blocked FROM b",
)
def st_gate(x: Tables):
    first = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    before = x.conversations.withColumn("first_answer", first).filter("role != 'assistant' AND (first_answer IS NULL OR turn < first_answer)")
    return before.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) <= 3).alias("blocked"))
