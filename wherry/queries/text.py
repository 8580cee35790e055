"""Queries of scalar text and vector functions."""

from pyspark.sql import functions as F

from wherry.functions import text as t
from wherry.functions import vec as v
from wherry.operators import pack, rank
from wherry.queries.base import Tables, big, cut_sql, query, r6

BM25_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query("s_bm25_tokens", f"SELECT item_id, array_to_string({BM25_TOKENS.format('text')}, ' ') AS tokens, CAST(len({BM25_TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM benchmark")
def bm25_tokens(x: Tables):
    toks = t.bm25_tokens(F.col("text"))
    return x.benchmark.select("item_id", F.array_join(toks, " ").alias("tokens"), big(F.size(toks)).alias("n_tokens"))


FTS_STOP = "[" + ",".join(f"'{w}'" for w in t.FTS_STOPWORDS) + "]"


@query(
    "s_fts_terms",
    rf"""
    WITH w AS (SELECT item_id, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda z: octet_length(encode(z)) >= 2 AND NOT list_contains({FTS_STOP}, lower(z))) AS ws FROM benchmark),
    e AS (SELECT item_id, u.pos, u.w, string_split(CASE WHEN contains(u.w, '_') THEN replace(u.w, '_', '|') ELSE regexp_replace(u.w, '(.)([A-Z])', '\1|\2', 'g') END, '|') AS p
          FROM (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM w) u)
    SELECT item_id, CAST(count(DISTINCT term) AS BIGINT) AS n_terms FROM (
      SELECT item_id, w AS term FROM e
      UNION ALL
      SELECT item_id, unnest(list_filter(p, lambda z: octet_length(encode(z)) >= 2 AND NOT list_contains({FTS_STOP}, lower(z)))) AS term FROM e WHERE len(p) > 1
    ) GROUP BY item_id""",
)
def fts_terms(x: Tables):
    terms = t.fts_terms(F.col("text"))
    return x.benchmark.select("item_id", big(F.size(terms)).alias("n_terms")).filter("n_terms > 0")


@query("s_estimate_tokens", "SELECT doc_id, CAST(floor((octet_length(encode(text)) + 3) / 4) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(x: Tables):
    return x.documents.select("doc_id", t.estimate_tokens(F.col("text")).alias("tokens"))


STEM = """CASE WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN left({0}, length({0}) - 3) || 'y'
 WHEN length({0}) > 6 AND {0} LIKE '%ing' THEN left({0}, length({0}) - 3) WHEN length({0}) > 5 AND {0} LIKE '%ed' THEN left({0}, length({0}) - 2)
 WHEN length({0}) > 5 AND {0} LIKE '%es' THEN left({0}, length({0}) - 2) WHEN length({0}) > 4 AND {0} LIKE '%s' THEN left({0}, length({0}) - 1) ELSE {0} END"""


@query("s_stemmer", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en') SELECT word, {STEM.format('word')} AS stem FROM w")
def stemmer(x: Tables):
    words = x.documents.filter("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return words.select("word", t.strip_suffix(F.col("word")).alias("stem"))


OVERLAP_MAP = "MAP {{" + ", ".join(f"'{k}': '{w}'" for k, w in t.OVERLAP_FORMS.items()) + "}}"
OVERLAP_NORM = f"coalesce({OVERLAP_MAP}[{{0}}], {STEM})"


@query(
    "s_overlap_tokens",
    rf"""WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS tok FROM part)
    SELECT p_partkey, CAST(count(DISTINCT n) AS BIGINT) AS n_tokens, min(n) AS first_token, max(n) AS last_token
    FROM (SELECT p_partkey, {OVERLAP_NORM.format('tok')} AS n FROM w) WHERE length(n) >= 2 GROUP BY p_partkey""",
)
def overlap_tokens(x: Tables):
    toks = t.overlap_tokens(F.col("p_name"))
    return x.part.select("p_partkey", big(F.size(toks)).alias("n_tokens"), F.array_min(toks).alias("first_token"), F.array_max(toks).alias("last_token")).filter("n_tokens > 0")


@query(
    "s_identifier_words",
    r"""SELECT DISTINCT event_type, lower(trim(regexp_replace(event_type, '[^\p{L}\p{N}]+', ' ', 'g'))) AS words FROM events""",
)
def identifier_words(x: Tables):
    return x.events.select("event_type", t.identifier_words(F.col("event_type")).alias("words")).distinct()


@query(
    "s_paths",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^\./', ''), '^/', '') AS path,
    regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]*)$', 1)) AS ext FROM pages""",
)
def paths(x: Tables):
    return x.pages.select("page_id", t.normal_path(F.regexp_replace("url", "^[a-z]+://", "")).alias("path"), t.file_dir(F.col("url")).alias("dir"), t.file_ext(F.col("url")).alias("ext"))


# Documents with comment syntax around and two paragraphs in every second one.
SENTENCE_SQL = r"""WITH a AS (SELECT doc_id, trim('// ' || CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Foo  * reads.' || chr(10) || chr(10) || text END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS d FROM documents),
p AS (SELECT doc_id, CASE WHEN strpos(d, chr(10) || chr(10)) > 1 THEN left(d, strpos(d, chr(10) || chr(10)) - 1) ELSE d END AS d FROM a),
w AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(d, '\s+'), lambda z: NOT list_contains(['', '//', '///', '/*', '/**', '*', '*/', '#'], z)), ' ') AS d FROM p),
s AS (SELECT doc_id, CASE WHEN strpos(d, '. ') > 1 THEN left(d, strpos(d, '. ')) ELSE d END AS d FROM w)"""


@query("s_first_sentence", f"{SENTENCE_SQL} SELECT doc_id, {cut_sql('d', 220)} AS sentence FROM s")
def first_sentence(x: Tables):
    doc = F.concat(F.lit("// "), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("Foo  * reads.\n\n"), "text")))
    return x.documents.select("doc_id", t.first_sentence(doc).alias("sentence"))


@query("s_strip_name", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'returns the ' || p_type WHEN p_partkey % 3 = 1 THEN 'Gives ' || p_type ELSE 'foo' END AS sentence FROM part")
def strip_name(x: Tables):
    m = F.col("p_partkey") % 3
    raw = F.when(m == 0, F.concat(F.lit("FOO returns the "), "p_type")).when(m == 1, F.concat(F.lit("Gives "), "p_type")).otherwise("foo")
    return x.part.select("p_partkey", t.strip_leading_name(raw, F.lit("Foo")).alias("sentence"))


@query(
    "s_clean_subject",
    r"""WITH s AS (SELECT item_id, replace(replace(replace(text, chr(10), ' '), '#', ''), ': ', ' ') AS b FROM benchmark) SELECT item_id, CASE item_id % 3 WHEN 0 THEN trim('see  for ' || b) WHEN 1 THEN trim('see  for ' || b) ELSE trim('fix(x)! see  for ' || b) END AS subject FROM s""",
)
def clean_subject(x: Tables):
    """An issue number in the midst goes, as does a conventional prefix; a path in front goes last and leaves the prefix behind it."""
    body = F.concat(F.lit("see (#12) for "), F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("#"), F.lit("")), F.lit(": "), F.lit(" ")))
    m = F.col("item_id") % 3
    raw = F.when(m == 0, F.concat(F.lit("fix(a)! "), body)).when(m == 1, F.concat(F.lit("pkg/kv: "), body)).otherwise(F.concat(F.lit("pkg/kv: fix(x)! "), body))
    return x.benchmark.select("item_id", t.clean_subject(raw).alias("subject"))


@query("flt_compound", "SELECT doc_id, len(string_split(text, ',')) > 2 OR contains(text, ' + ') OR contains(text, ';') AS compound FROM documents")
def compound(x: Tables):
    return x.documents.select("doc_id", t.is_compound(F.col("text")).alias("compound"))


@query(
    "s_parse_span",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INTEGER) - 5 AS b, l_linenumber % 3 AS m FROM lineitem) SELECT l_orderkey, CAST(coalesce(sum(CASE WHEN m > 0 AND b >= 0 THEN a END), 0) AS BIGINT) AS starts, CAST(coalesce(sum(CASE WHEN m > 0 AND b >= 0 THEN b END), 0) AS BIGINT) AS ends, CAST(count(*) FILTER (m > 0 AND b >= 0 AND b >= a) AS BIGINT) AS forward FROM l GROUP BY l_orderkey""",
)
def parse_span(x: Tables):
    """Ranges in a list, single numbers and words among them; only one that does not run backwards is a range by itself."""
    a, b = F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity").cast("int") - 5
    one = F.when((a % 3 > 0) & (b >= 0), F.concat_ws(" - ", a.cast("string"), b.cast("string"))).when(a % 3 > 0, "x-2").otherwise(a.cast("string"))
    rows = x.lineitem.select("l_orderkey", one.alias("one"))
    spans = rows.groupBy("l_orderkey").agg(F.array_join(F.collect_list("one"), ",").alias("span"), F.count(t.parse_span(F.col("one"))).alias("forward"))
    s = t.parse_spans(F.col("span"))
    total = lambda k: big(F.aggregate(s, F.lit(0), lambda acc, z: acc + z[k]))
    return spans.select("l_orderkey", total("start").alias("starts"), total("end").alias("ends"), "forward")


@query("s_redact", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'h:' || left(sha256(source), 12) END AS redacted FROM documents")
def redact(x: Tables):
    return x.documents.select("doc_id", t.redact(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source"))).alias("redacted"))


@query("s_sha256", "SELECT page_id, sha256(html) AS hash, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages")
def sha256(x: Tables):
    return x.pages.select("page_id", t.sha256_hex(F.col("html")).alias("hash"), big(F.octet_length("html")).alias("size"))


@query("v_norms", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def norms(x: Tables):
    return x.embeddings.select("vec_id", r6(v.norm(F.col("embedding"))).alias("norm"))


@query(
    "v_normalize",
    """WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)
    SELECT vec_id, round(CASE WHEN n < 1e-9 THEN e[1] ELSE e[1] / n END, 6) AS first, round(list_sum(list_transform(e, lambda z: CASE WHEN n < 1e-9 THEN z ELSE z / n END)), 6) AS total FROM n""",
)
def normalize(x: Tables):
    u = x.embeddings.select("vec_id", v.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", r6(F.get("u", F.lit(0))).alias("first"), r6(F.aggregate("u", F.lit(0.0), lambda a, z: a + z)).alias("total"))


@query("v_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS p FROM events")
def sigmoid(x: Tables):
    return x.events.select("event_id", r6(v.sigmoid(F.col("value") / 100)).alias("p"))


@query(
    "v_wilson",
    """WITH c AS (SELECT event_type, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY event_type), p AS (SELECT *, k / n AS p, 3.8416 AS z2 FROM c)
    SELECT event_type, CAST(k AS BIGINT) AS hits, CAST(n AS BIGINT) AS n,
      round(greatest(0, (p + z2 / (2 * n)) / (1 + z2 / n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) AS low,
      round(least(1, (p + z2 / (2 * n)) / (1 + z2 / n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) AS high FROM p""",
)
def wilson(x: Tables):
    c = x.events.groupBy("event_type").agg(F.count(F.when(F.col("value") > 50, 1)).alias("hits"), F.count("*").alias("n"))
    low, high = v.wilson(F.col("hits"), F.col("n"))
    return c.select("event_type", "hits", "n", r6(low).alias("low"), r6(high).alias("high"))


@query(
    "v_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(max(CASE WHEN i = CAST(floor((n - 1) * 0.5) AS BIGINT) + 1 THEN value END), 6) AS p50,
      round(max(CASE WHEN i = CAST(floor((n - 1) * 0.95) AS BIGINT) + 1 THEN value END), 6) AS p95, round(max(value), 6) AS top FROM r GROUP BY event_type""",
)
def percentiles(x: Tables):
    """Nearest-rank percentiles on (n - 1) p, from counts by value: no group is sorted in one task."""
    from wherry.operators.metrics import nearest_rank

    return nearest_rank(x.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).join(x.events.groupBy("event_type").agg(F.max("value").alias("top")), "event_type").select("event_type", r6("p50").alias("p50"), r6("p95").alias("p95"), r6("top").alias("top"))


@query(
    "s_visibility",
    r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (CASE WHEN regexp_matches(p_name, '^[A-Z]') THEN 'public' ELSE 'internal' END) WHEN 2 THEN 'internal' WHEN 3 THEN 'internal' ELSE 'public' END AS visibility FROM part""",
)
def visibility(x: Tables):
    m = F.col("p_partkey") % 6
    file = F.when(m == 0, "a.go").when(m == 1, "b/c.ts").when(m == 2, "a.test.ts").when(m == 3, "x_test.js").when(m == 4, "a_test.py").otherwise("Makefile")
    return x.part.select("p_partkey", rank.visibility(F.concat(F.lit("pkg."), "p_name"), file).alias("visibility"))


@query("s_test_files", r"""SELECT page_id, regexp_matches(url, '(^|/)(test|tests|testdata|mock|mocks|fixtures|e2e|bench|benchmarks)(/|$)') AS infra FROM pages""")
def test_files(x: Tables):
    return x.pages.select("page_id", F.col("url").rlike(r"(^|/)(test|tests|testdata|mock|mocks|fixtures|e2e|bench|benchmarks)(/|$)").alias("infra"))


BRANCH_SQL = " OR ".join(f"starts_with(trim(z, ' ' || chr(9) || chr(13)), '{p}')" for p in pack.BRANCH_PREFIXES)


@query("s_branch_lines", f"SELECT doc_id, CAST(len(list_filter(string_split('else if' || chr(10) || '}} else' || chr(10) || text || chr(10) || 'If x', chr(10)), lambda z: {BRANCH_SQL})) AS BIGINT) AS branches FROM documents")
def branch_lines(x: Tables):
    return x.documents.select("doc_id", big(F.size(F.filter(F.split(F.concat(F.lit("else if\n} else\n"), "text", F.lit("\nIf x")), "\n"), pack.branch_control))).alias("branches"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in t.CODE_STOPWORDS) + "]"


@query(
    "s_code_identifiers",
    "SELECT item_id, 'read_file' || item_id || ',pkg/a_' || item_id || '.py,parseCsv' || item_id || ',os.path' || item_id AS ids, 'pkg/a_' || item_id || '.py' AS first FROM benchmark",
)
def code_identifiers(x: Tables):
    """The author's mark leads, then paths, snake, camel and dotted names; repeats and stop words go; a short list ends early."""
    k = F.col("item_id").cast("string")
    raw = F.concat(F.lit("Use e.g. parseCsv"), k, F.lit(" of pkg/a_"), k, F.lit(".py, os.path"), k, F.lit(" and `read_file"), k, F.lit("` (READ_FILE) i.e. self"))
    bare = F.concat(F.lit("pkg/a_"), k, F.lit(".py parseCsv"))
    names = F.filter(t.code_identifiers(raw, 24), lambda s: ~s.rlike(r"^a_\d+\.py$|^a_\d+$"))
    return x.benchmark.select("item_id", F.array_join(names, ",").alias("ids"), F.array_join(t.code_identifiers(bare, 1), ",").alias("first"))


@query(
    "s_issue_title",
    "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Crash in parser ' || item_id WHEN 1 THEN 'Plain ' || item_id ELSE 'x' END AS title, CASE item_id % 3 WHEN 0 THEN 'Crash in parser ' || item_id || ' read_file' WHEN 1 THEN 'Plain ' || item_id ELSE 'x' END AS shaped FROM benchmark",
)
def issue_title(x: Tables):
    k, m = F.col("item_id").cast("string"), F.col("item_id") % 3
    raw = F.when(m == 0, F.concat(F.lit("## Title:\n<!-- a -->\n\n### Crash in parser "), k, F.lit(":\nbody `read_file`"))).when(m == 1, F.concat(F.lit("\nPlain "), k)).otherwise("```\nx")
    return x.benchmark.select("item_id", t.issue_title(raw).alias("title"), t.shape_query(raw, "title+ids").alias("shaped"))


KEYWORD_SQL = "[" + ", ".join(f"'{w}'" for w in t.CODE_KEYWORDS) + "]"


@query(
    "s_code_tokens",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS z, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')), s AS (SELECT doc_id, i, trim(z, ' ' || chr(9) || chr(13)) AS z FROM l),
    k AS (SELECT doc_id, i, CASE WHEN length(z) < 12 OR regexp_matches(z, '^(//|\\*|/\\*|#)') THEN [] ELSE (list_distinct_ordered)[1:8] END AS w FROM (SELECT *, list_filter(ws, lambda e, j: list_position(ws, e) = j) AS list_distinct_ordered FROM (SELECT *, list_filter(regexp_extract_all(lower(regexp_replace(z, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda e: length(e) >= 4 AND NOT list_contains({KEYWORD_SQL}, e)) AS ws FROM s)))
    SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS tokens, CAST(max(len(w)) AS BIGINT) AS most FROM k GROUP BY doc_id""",
)
def code_tokens(x: Tables):
    lines = x.documents.filter(~F.col("text").rlike(r"[^\x00-\x7f]")).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = lines.select("doc_id", F.size(t.code_tokens(F.col("line"))).alias("n"))
    return n.groupBy("doc_id").agg(big(F.sum("n")).alias("tokens"), big(F.max("n")).alias("most"))


@query("flt_category", "SELECT doc_id FROM documents WHERE contains(source, 'c1') OR contains(lang, 'e')")
def category(x: Tables):
    return x.documents.filter(t.matches_category(F.col("source"), F.array("lang"), "c1") | t.matches_category(F.lit(None).cast("string"), F.array("lang"), "e")).select("doc_id")


@query(
    "s_clean_summary",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Reads the ' || lang || '.' WHEN 1 THEN 'Loads ' || source WHEN 2 THEN 'Unlike similar ones' ELSE 'Parses it.' END AS summary, CASE WHEN doc_id % 2 = 0 THEN repeat('word ', 59) || 'word ...' ELSE repeat('x', 300) || ' ...' END AS long FROM documents""",
)
def clean_summary(x: Tables):
    m = F.col("doc_id") % 4
    raw = (
        F.when(m == 0, F.concat(F.lit(' "Summary: Reads the '), "lang", F.lit(", which and it; distinguishing it from others\nmore")))
        .when(m == 1, F.concat(F.lit("Summary: Purpose: Loads "), "source"))
        .when(m == 2, "Unlike similar ones")
        .otherwise("Parses it. Sets it apart")
    )
    long = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("word "), 100)).otherwise(F.repeat(F.lit("x"), 400))
    return x.documents.select("doc_id", t.clean_summary(raw).alias("summary"), t.clean_summary(long).alias("long"))
