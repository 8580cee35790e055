"""Joins of the retrieval engine: spans, suffixes, names, attribution, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.functions.text import normal_path, short_name


def with_fallback(symbols: DataFrame, bodies: DataFrame, key: str = "id", excerpt: str = "excerpt") -> DataFrame:
    """Left join of full bodies (id, body); symbols without one keep their excerpt."""
    return symbols.join(bodies.select(key, "body"), key, "left").withColumn("body", F.coalesce("body", excerpt))


def missing(rows: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return rows.join(have.select(key).distinct(), key, "left_anti")


def hydrate(ranked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Attributes for ranked ids; the rank column keeps the order."""
    return ranked.join(rows, key)


#: Queries and files of one suffix that meet in a block.
PAIR_BLOCK = 1024
#: Lines that one bucket of an interval join spans.
SPAN_BUCKET = 64


def enclosing(points: DataFrame, spans: DataFrame, limit: int) -> DataFrame:
    """Symbols for positions: points (query_id, file, line), spans (id, file, start, end); line 0 or null asks for the file.

    Enclosing spans come first, innermost before outer, then the nearest ones; without a line all in file order.
    The join is on the file, so what meets in one task is a file's symbols.
    """
    rows = points.join(spans, "file")
    line = F.coalesce("line", F.lit(0))
    inside = (F.col("start") <= line) & (line <= F.col("end"))
    dist = F.when(line < F.col("start"), F.col("start") - line).otherwise(line - F.col("end"))
    group = F.when(line == 0, 0).when(inside, 0).otherwise(1)
    first = F.when(line == 0, F.col("start")).when(inside, F.col("end") - F.col("start")).otherwise(dist)
    w = Window.partitionBy("query_id").orderBy(group, first, "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "file", "id", "rank", (inside & (line > 0)).alias("encloses"))


def stab(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line, id) of spans that hold a line, by buckets of lines: an equi-join with bounded candidates."""
    p = points.withColumn("_b", F.floor(F.col("line") / SPAN_BUCKET))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / SPAN_BUCKET), F.floor(F.col("end") / SPAN_BUCKET))))
    return p.join(s, ["file", "_b"]).filter("start <= line AND line <= end").drop("_b")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans (file, start, end) of the same file that share a line: a_id, b_id."""
    bucket = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), "file", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / SPAN_BUCKET), F.floor(F.col("end") / SPAN_BUCKET))).alias("_b"))
    pairs = bucket(a, "a").join(bucket(b, "b"), ["file", "_b"]).filter("a_start <= b_end AND b_start <= a_end")
    # A pair is kept in the first bucket that both spans reach, so it appears once.
    first = F.floor(F.greatest("a_start", "b_start") / SPAN_BUCKET)
    return pairs.filter(F.col("_b") == first).select("file", "a_id", "b_id")


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, file_id, path): exact normalised paths, or else paths that end with the wanted one at a separator.

    Every path is keyed by each of its suffixes at separators, so the suffix match is an equi-join. Files are placed once for
    each wanted suffix and not for each query that wants it, so what is shuffled and sorted grows as the files and the queries,
    not as their pairs; the pairs are made by the last join. Queries that want several paths are placed by themselves.
    """
    want = wanted.select("query_id", normal_path(F.col("path")).alias("suffix"))
    f = files.select(F.col("id").alias("file_id"), "path", normal_path(F.col("path")).alias("norm"))
    parts = F.split("norm", "/")
    keyed = f.select("file_id", "path", "norm", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    keyed = keyed.select("file_id", "path", "suffix", F.when(F.col("norm") == F.col("suffix"), 0).otherwise(1).alias("kind"))

    def placed(hits: DataFrame, key: str) -> DataFrame:
        best = hits.withColumn("best", F.min("kind").over(Window.partitionBy(key))).filter("kind = best")
        w = Window.partitionBy(key).orderBy(F.octet_length("path"), "path", "file_id")
        return best.select(key, "file_id", "path", F.row_number().over(w).alias("rank"))

    counted = want.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    one, several = (counted.filter(c).select("query_id", "suffix") for c in ("_n = 1", "_n > 1"))
    first = placed(keyed.join(one.select("suffix").distinct(), "suffix", "left_semi"), "suffix")
    # The pairs of one suffix are cut into blocks, so that no task makes more than PAIR_BLOCK squared of them at a time.
    blocks = one.groupBy("suffix").agg(F.ceil(F.count("*") / PAIR_BLOCK).alias("_nq")).join(first.groupBy("suffix").agg(F.ceil(F.max("rank") / PAIR_BLOCK).alias("_nf")), "suffix")
    asks = one.join(blocks, "suffix").select("query_id", "suffix", F.pmod(F.xxhash64("query_id"), F.col("_nq")).alias("_q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nf") - 1)).alias("_f"))
    gives = first.join(blocks, "suffix").select("suffix", "file_id", "path", "rank", F.floor((F.col("rank") - 1) / PAIR_BLOCK).alias("_f"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq") - 1)).alias("_q"))
    single = asks.join(gives, ["suffix", "_q", "_f"]).select("query_id", "file_id", "path", "rank")
    return single.unionByName(placed(several.join(keyed, "suffix"), "query_id"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) of calls (src, callee): the exact qualified name, else a last segment that only one symbol has, else none."""
    exact = symbols.groupBy("qualified_name").agg(F.max("id").alias("exact"))
    last = symbols.groupBy(short_name(F.col("qualified_name")).alias("short")).agg(F.min("id").alias("only"), F.countDistinct("id").alias("n")).filter("n = 1").select("short", "only")
    rows = calls.join(exact, calls["callee"] == exact["qualified_name"], "left").withColumn("short", short_name(F.col("callee"))).join(last, "short", "left")
    return rows.select("src", F.coalesce("exact", "only").alias("dst")).filter("dst IS NOT NULL AND src != dst").distinct()


def unambiguous(names: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """(qualified_name, id) of names that one symbol bears; names defined locally take the local symbol."""
    one = names.groupBy("qualified_name").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").select("qualified_name", "id")
    if local is None:
        return one
    mine = local.groupBy("qualified_name").agg(F.min("id").alias("id"))
    return mine.unionByName(one.join(mine.select("qualified_name"), "qualified_name", "left_anti"))


def same_symbol(a: Column, b: Column) -> Column:
    """Equal names, or one is the other's dotted suffix."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def linked_tests(symbols: DataFrame, tests: DataFrame, limit: int = 3) -> DataFrame:
    """(id, test_id, n): the first tests whose short name holds a symbol's, whatever their case, or is held by it.

    Every name is keyed by all its substrings that are as long as some name of the other side, so containment is an
    equi-join; what is exploded is bounded by a name's length times the number of different lengths. Different names meet, not
    their bearers: of a name's tests only the first ``limit`` can be among a symbol's, so these alone are looked up.
    """
    s = symbols.select("id", F.lower(short_name(F.col("name"))).alias("name")).filter("name != ''")
    t = tests.select(F.col("id").alias("test_id"), F.lower(short_name(F.col("name"))).alias("test_name")).filter("test_name != ''")

    def within(inner: DataFrame, inner_name: str, outer: DataFrame, outer_name: str) -> DataFrame:
        sizes = inner.agg(F.collect_set(F.char_length(inner_name)).alias("sizes"))  # lengths of names: a few dozen numbers
        keyed = outer.crossJoin(F.broadcast(sizes)).select(outer_name, F.explode(F.filter("sizes", lambda k: k <= F.char_length(outer_name))).alias("k"))
        parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(outer_name) - F.col("k") + 1), lambda i: F.substring(F.col(outer_name), i, F.col("k"))))
        return keyed.select(outer_name, F.explode(parts).alias(inner_name)).join(inner, inner_name).select("name", "test_name")

    def first(rows: DataFrame, key: str) -> DataFrame:
        return rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("test_id"))).filter(F.col("n") <= limit)

    names, test_names = s.select("name").distinct(), t.select("test_name").distinct()
    pairs = within(names, "name", test_names, "test_name").union(within(test_names, "test_name", names, "name")).distinct()
    by_name = first(pairs.join(first(t, "test_name").drop("n"), "test_name").select("name", "test_id"), "name").drop("n")
    return first(s.join(by_name, "name").select("id", "test_id"), "id")


def eligible(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc): each query's allowed documents; an empty list allows all."""
    some = queries.filter(F.size("allowed") > 0).select("query_id", F.explode("allowed").alias("doc")).distinct()
    listed = some.join(corpus.select("doc"), "doc", "left_semi").select("query_id", "doc")
    every = queries.filter(F.coalesce(F.size("allowed"), F.lit(0)) <= 0).select("query_id")
    return listed.unionByName(corpus.select("doc").crossJoin(F.broadcast(every)).select("query_id", "doc"))


def attribute(nudges: DataFrame, served: DataFrame, window_seconds: int, key: str | None = None) -> DataFrame:
    """Each nudge (ts) with the first served event at or after it within the window: as-of attribution.

    Both sides are one ordered sequence per key: the next served time is carried back over the events, so no
    range join is made. ``key`` None attributes over all events by buckets of the window's length.
    """
    keys = [key] if key else []
    n = nudges.select(*keys, "ts", F.lit(0).alias("kind"), F.monotonically_increasing_id().alias("nudge"))
    s = served.select(*keys, "ts", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("nudge"))
    if not keys:
        # A nudge looks into its own bucket and the next; served events go to their bucket and the one before.
        b = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (window_seconds * 1_000_000))
        n = n.withColumn("_b", b)
        s = s.withColumn("_b", F.explode(F.array(b, b - 1)))
        keys = ["_b"]
    w = Window.partitionBy(*keys).orderBy("ts", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = n.unionByName(s).withColumn("next_served", F.first(F.when(F.col("kind") == 1, F.col("ts")), ignorenulls=True).over(w)).filter("kind = 0")
    within = (F.unix_micros(F.col("next_served").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) <= window_seconds * 1_000_000
    return seen.select(*([key] if key else []), "ts", F.when(within, F.col("next_served")).alias("credited_by"))
