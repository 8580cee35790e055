"""Context around results: siblings, package view, flow, chain coverage, region misses, self-retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.functions.text import code_tokens
from wherry.operators import knn
from wherry.operators.joins import same_symbol

SIBLING_SCORE, SIBLING_POOL, SIBLINGS = 0.75, 10, 3


def siblings(anchors: DataFrame, vectors: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, anchor, id, n): near vectors of an answer's first three results that the answer lacks.

    anchors: query_id, anchor, v; vectors: id, v; selected: query_id, id. A stated set of anchors meets every vector once.
    """
    asked = anchors.groupBy("anchor").agg(F.any_value("v").alias("av"))
    near = knn.search(asked, vectors, "anchor", "av", "id", "v", SIBLING_POOL).select(F.col("query_id").alias("anchor"), "id", "score", F.col("rank").alias("r"))
    near = anchors.select("query_id", "anchor").distinct().join(near, "anchor")
    pool = near.filter((F.col("score") >= SIBLING_SCORE) & (F.col("id") != F.col("anchor")))
    new = pool.join(selected.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "anchor").orderBy("r"))).filter(F.col("n") <= SIBLINGS).select("query_id", "anchor", "id", "n")


def structure_view(results: DataFrame) -> DataFrame:
    """(query_id, package, symbols, n): an answer's symbols by package, the largest package (then the first name) marked top."""
    g = results.groupBy("query_id", "package").agg(F.array_sort(F.collect_set("name")).alias("symbols"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "package"))
    return g.withColumn("top", first == 1)


def chain_coverage(hops: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
    """(chain, hop, verdict): a hop of a call chain is followable in the graph, by a sibling, by dispatch, or missed."""
    e = edges.select("src", "dst").distinct().withColumn("_e", F.lit(1))
    s = near.select("src", "dst").distinct().withColumn("_s", F.lit(1))
    rows = hops.join(e, ["src", "dst"], "left").join(s, ["src", "dst"], "left")
    verdict = F.when(F.col("dispatch"), "dispatch").when(F.col("_e").isNotNull(), "graph").when(F.col("_s").isNotNull(), "sibling").otherwise("missed")
    return rows.select("chain", "hop", verdict.alias("verdict"))


def region_misses(regions: DataFrame, shown: DataFrame, symbols: DataFrame) -> DataFrame:
    """(region, verdict) of gold regions (region, file, start, end): hit, trimmed, wrong symbol, file not found, or not indexed.

    shown: file, start, end, body_start, body_end of results; symbols: file, start, end of the index.
    """
    over = lambda a, b: (F.col("r.start") <= F.col(b)) & (F.col(a) <= F.col("r.end"))
    r = regions.alias("r")
    j = r.join(shown.alias("s"), F.col("r.file") == F.col("s.file"), "left")
    seen = j.groupBy("r.region").agg(
        F.max(F.coalesce(over("s.start", "s.end"), F.lit(False))).alias("hit"),
        F.max(F.coalesce(over("s.body_start", "s.body_end"), F.lit(False))).alias("held"),
        F.max(F.col("s.file").isNotNull()).alias("file_seen"),
    )
    known = r.join(symbols.alias("i"), (F.col("r.file") == F.col("i.file")) & over("i.start", "i.end"), "left_semi").select("region", F.lit(True).alias("indexed"))
    verdict = F.when(F.col("hit"), "hit").when(F.col("held"), "trimmed").when(F.col("indexed").isNull(), "not_indexed").when(F.col("file_seen"), "wrong_symbol").otherwise("file_missed")
    return seen.join(known, "region", "left").select("region", verdict.alias("verdict"))


def self_report(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: cases, share found first, share found in ten by id, and by dotted name."""
    rows = ranked.join(wanted.withColumnRenamed("name", "want"), "query_id")
    per = rows.groupBy("query_id").agg(
        F.min(F.when(F.col("id") == F.col("want_id"), F.col("rank"))).alias("place"),
        F.min(F.when(same_symbol(F.col("name"), F.col("want")), F.col("rank"))).alias("named"),
    )
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return per.agg(F.count("*").alias("n"), share(F.col("place") == 1).alias("hit1"), share(F.col("place") <= 10).alias("hit10"), share(F.col("named") <= 10).alias("by_name"))


LEAST_HIDDEN, LEAST_TOKENS = 5, 3


def deep_probes(symbols: DataFrame) -> DataFrame:
    """(id, line, depth, tokens) of symbols (id, start, excerpt, full_body): the line past the excerpt that has the most words.

    The first among equals; symbols that hide too few lines, or whose best line has fewer than three words, give none.
    """
    shown = F.size(F.split(F.regexp_replace("excerpt", r"\n// \.\.\. \[truncated\]$", ""), "\n"))
    lines = F.split("full_body", "\n")
    rows = symbols.filter(F.col("full_body").isNotNull()).select("id", "start", shown.alias("shown"), lines.alias("lines")).filter(F.size("lines") > F.col("shown") + LEAST_HIDDEN)
    hidden = rows.select("id", "start", "shown", F.posexplode("lines").alias("at", "line")).filter(F.col("at") >= F.col("shown")).withColumn("tokens", code_tokens(F.col("line")))
    best = hidden.groupBy("id").agg(F.max_by(F.struct("start", "shown", "at", "tokens"), F.struct(F.size("tokens"), -F.col("at"))).alias("b")).filter(F.size("b.tokens") >= LEAST_TOKENS)
    return best.select("id", (F.col("b.start") + F.col("b.at")).alias("line"), (F.col("b.at") - F.col("b.shown")).alias("depth"), F.col("b.tokens").alias("tokens"))


def deep_coverage(probes: DataFrame, shown: DataFrame, tier: int = 6) -> DataFrame:
    """One row of counts over probes (id, line) and answers (query_id, id, rank, spans of start and end; query_id is the probe's id).

    n, retrieved, covered; in_tier and covered_in_tier among the first ``tier`` results, the only ones that carry a body; lines shown there.
    """
    hit = probes.select("id", "line").join(shown.filter(F.col("query_id") == F.col("id")).select("id", "rank", "spans"), "id", "left")
    covers = F.coalesce(F.exists("spans", lambda s: (s["start"] <= F.col("line")) & (F.col("line") <= s["end"])), F.lit(False))
    size = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"] + 1))
    found, top = F.col("rank").isNotNull(), F.col("rank") <= tier
    return hit.agg(F.count("*").alias("n"), F.count(F.when(found, 1)).alias("retrieved"), F.count(F.when(covers, 1)).alias("covered"), F.count(F.when(top, 1)).alias("in_tier"), F.count(F.when(top & covers, 1)).alias("covered_in_tier"), F.coalesce(F.sum(F.when(top, size)), F.lit(0)).alias("lines"))


def next_steps(results: DataFrame) -> DataFrame:
    """(query_id, if_top_correct, if_unsure) from results (query_id, rank, score, confidence, qualified_name, callers: names).

    What to do with a sure first result, with an unsure one, and when the first three are alike.
    """
    first = lambda c, k=1: F.max(F.when(F.col("rank") == k, F.col(c)))
    short = F.substring_index("qualified_name", ".", -1)
    g = results.groupBy("query_id").agg(
        F.count("*").alias("n"), first("confidence").alias("confidence"), first("callers").alias("callers"), first("score").alias("s0"), first("score", 2).alias("s1"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", short.alias("name"))))), lambda x: F.concat(F.lit("#"), x["rank"].cast("string"), F.lit("="), x["name"])).alias("three"),
    )
    callers = F.concat(F.lit("Read #1. Blast radius: "), F.size("callers").cast("string"), F.lit(" callers ("), F.array_join(F.slice("callers", 1, 3), ", "), F.lit(")."))
    sure = F.when(F.size("callers") > 0, callers).otherwise("Read #1. No callers found — likely a leaf or entry point.")
    unsure = F.concat(F.lit("Confidence is "), F.col("confidence"), F.lit(". Consider top-"), F.least(F.col("n"), F.lit(3)).cast("string"), F.lit(" before acting."))
    alike = (F.col("n") >= 2) & (F.col("s0") > 0) & ((F.col("s0") - F.col("s1")) / F.col("s0") < 0.15)
    hint = F.concat(F.lit("Top-3 are similar candidates. "), F.array_join("three", ", "), F.lit(". Pick by what your task needs."))
    return g.select("query_id", F.when(F.col("confidence") == "high", sure).when(F.col("n") >= 2, unsure).alias("if_top_correct"), F.when(alike, hint).alias("if_unsure"))


def stale_expansions(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds stale: whether a symbol that was shown (id, qualified_name, kind) is no longer that symbol, or is gone."""
    now = symbols.select("id", F.col("qualified_name").alias("_name"), F.col("kind").alias("_kind"))
    same = (F.col("_name") == F.col("qualified_name")) & (F.col("_kind") == F.col("kind"))
    return asked.join(now, "id", "left").withColumn("stale", ~F.coalesce(same, F.lit(False))).drop("_name", "_kind")


def numbered_body(body: Column, segments: Column) -> Column:
    """A body with line numbers; ``segments`` (start, lines) say where each stretch of it lies, the gap lines between them have no number."""
    lines = F.split(body, "\n")
    # Where each segment begins in the body: one gap line stands before every segment but the first.
    begins = F.transform(segments, lambda s, i: F.aggregate(F.slice(segments, 1, i), i, lambda a, x: a + x["lines"]))
    parts = F.transform(segments, lambda s, i: F.array_join(F.transform(F.slice(lines, F.get(begins, i) + 1, s["lines"]), lambda x, k: F.concat((s["start"] + k).cast("string"), F.lit("\t"), x)), "\n"))
    return F.array_join(parts, "\n// ...\n")


def render_answer(results: DataFrame) -> DataFrame:
    """(query_id, text): an answer as Markdown from results (query_id, rank, qualified_name, file, start, end, detail, confidence, body: numbered).

    A compact result is its header with a teaser; others carry their code in a fence.
    """
    span = F.concat(F.col("file"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    head = F.concat(F.col("rank").cast("string"), F.lit(". **"), F.col("qualified_name"), F.lit("** "), span, F.lit(" ("), F.col("confidence"), F.lit(")"))
    code = F.concat(head, F.when(F.col("detail") == "excerpt", " [excerpt]").otherwise(""), F.lit("\n```\n"), F.col("body"), F.lit("\n```"))
    one = F.when(F.col("detail") == "compact", F.concat(head, F.lit(" — "), F.regexp_replace("body", "\n", " "))).otherwise(code)
    parts = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("part")))).alias("parts"))
    return parts.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("text"))


def file_reach(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, place): the first place of a gold file when each file counts once; null if it is not there."""
    files = ranked.groupBy("query_id", "file").agg(F.min("rank").alias("rank"))
    placed = files.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "file")))
    best = placed.join(gold.distinct(), ["query_id", "file"], "left_semi").groupBy("query_id").agg(F.min("place").alias("place"))
    return gold.select("query_id").distinct().join(best, "query_id", "left")
