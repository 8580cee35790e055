"""Re-ranking: features, intent, gates, floors, confidence and health."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.functions.text import INTENT_FORMS, intent_tokens, lit_array, normal_form, overlap_ratio, overlap_tokens, short_name
from wherry.functions.vec import sigmoid

# Fixed values of intent analysis, as normalised tokens are compared.
CONSTRUCTOR_WORDS = "new constructor create created open opened init initialized".split()
ACTION_WORDS = "where how find search build extract store insert walk pack embed".split()
HINTS = "new start get upsert fetch parse create update delete".split()
STRICT_HINTS = "new start get upsert fetch parse".split()
NOISY_WORDS = "admin debug mock test manual prediction".split()
LANGUAGES = (("go", "go golang".split()), ("python", "python py".split()), ("typescript", "typescript ts tsx".split()))
PASSIVE_KINDS = "type interface const var".split()
# Verbs that ask for the code that does something when they lead a query.
ACTION_VERBS = (
    "aggregate apply buy cache calculate classify compare compute convert decide decode decrypt delete detect dispatch download "
    "encode encrypt execute export fetch filter format generate get handle hash import load log match merge notify parse place "
    "process publish rank read record render resolve retry route run save schedule score sell send serialize settle sort sync "
    "translate update upload validate verify write"
).split()
LEAD_SKIPS = "a an the and also then please what which who when where how why do does can should we i you".split()
# Path segments and query words of test infrastructure.
TEST_SEGMENTS = "test tests testdata testutil testutils mock mocks fixtures e2e bench benchmarks asim simulation simulator roachtest".split()
TEST_WORDS = "test tests mock mocks fixture bench benchmark e2e spec coverage simulation simulator simulate asim roachtest".split()

INTENT_WEIGHT, INTENT_WINDOW = 0.05, 15
WEAK_MATCH = 0.70


def _has_any(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, F.array(*[normal_form(F.lit(w), INTENT_FORMS) for w in words]))


def is_test_file(path: Column) -> Column:
    """The four suffixes that name test files next to their subject."""
    return path.rlike(r"(_test\.go|\.test\.ts|\.test\.tsx|\.spec\.ts)$")


def is_named_test(path: Column) -> Column:
    """Test files by naming convention, over languages."""
    base = F.lower(F.substring_index(path, "/", -1))
    return base.rlike(r"_test\.[^.]+$|^test_[^/]*\.py$|\.(test|spec)\.[^.]+$|_spec\.rb$") | F.substring_index(path, "/", -1).rlike(r"Tests?\.(java|cs|kt|php|swift)$")


def is_test_suite_path(path: Column) -> Column:
    """Named tests, files in test directories, and tests.py."""
    return is_named_test(path) | F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec|specs|testing)/") | F.lower(path).rlike(r"(^|/)tests\.py$")


def is_test_infra(path: Column) -> Column:
    """A path segment or a file name of test scaffolding."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.lower(F.substring_index(norm, "/", -1))
    stem = F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)
    return F.arrays_overlap(F.split(F.lower(norm), "/"), lit_array(TEST_SEGMENTS)) | stem.rlike(r"_test$|^test_|\.spec$|\.test$")


def leads_with_action_verb(query: Column) -> Column:
    """Whether the first meaningful token is a verb of action."""
    words = F.transform(F.split(F.lower(F.btrim(query)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))
    meant = F.filter(words, lambda w: (w != "") & ~F.array_contains(lit_array(LEAD_SKIPS), w) & ~w.endswith("ly"))
    verbs = F.array(*[normal_form(F.lit(v), INTENT_FORMS) for v in ACTION_VERBS])
    return F.coalesce(F.array_contains(verbs, normal_form(F.get(meant, F.lit(0)), INTENT_FORMS)), F.lit(False))


def intent_profile(queries: DataFrame, text: str = "query") -> DataFrame:
    """Adds q_tokens, wants_new, wants_action, language, hints and wants_tests."""
    out = queries.withColumn("q_tokens", intent_tokens(F.col(text)))
    t = F.col("q_tokens")
    language = F.lit("")
    for name, words in reversed(LANGUAGES):
        language = F.when(_has_any(t, words), name).otherwise(language)
    hints = F.filter(lit_array(HINTS), lambda h: F.array_contains(t, normal_form(h, INTENT_FORMS)))
    return out.withColumns(
        {
            "wants_new": _has_any(t, CONSTRUCTOR_WORDS),
            "wants_action": _has_any(t, ACTION_WORDS) | leads_with_action_verb(F.col(text)),
            "language": language,
            "hints": hints,
            "wants_tests": _has_any(t, TEST_WORDS),
        }
    )


def intent_score(df: DataFrame) -> DataFrame:
    """Adds intent: the categorical score of a candidate (qualified_name, file, kind, is_constructor, file_language) under its query's profile."""
    out = df.withColumn("c_tokens", intent_tokens(F.concat_ws(" ", "qualified_name", "file", "kind")))
    q, c = F.col("q_tokens"), F.col("c_tokens")
    coverage = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))
    passive = F.col("kind").isin(*PASSIVE_KINDS)
    builds = F.col("is_constructor") | F.array_contains(c, "new")
    ctor = F.when(F.col("wants_new"), F.when(builds, 2.0).otherwise(-0.4) + F.when(passive, -0.9).otherwise(0.0)).otherwise(0.0)
    impl = F.when(F.col("wants_action"), F.when(F.col("kind").isin("function", "method"), 0.35).otherwise(0.0) + F.when(passive, -0.9).otherwise(0.0)).otherwise(0.0)
    lang = F.when(F.col("language") != "", F.when(F.col("language") == F.col("file_language"), 1.8).when(F.col("file_language").isin(*[x for x, _ in LANGUAGES]), -1.2).otherwise(0.0)).otherwise(0.0)
    strict = lit_array(STRICT_HINTS)
    hints = F.aggregate("hints", F.lit(0.0), lambda s, h: s + F.when(F.array_contains(c, h), 0.45).when(F.array_contains(strict, h), -0.2).otherwise(0.0))
    noisy = F.aggregate(lit_array(NOISY_WORDS), F.lit(0.0), lambda s, w: s + F.when(F.array_contains(c, w) & ~F.array_contains(q, w), -0.2).otherwise(0.0))
    infra = F.when(is_test_infra(F.col("file")) & ~F.col("wants_tests"), -0.7).otherwise(0.0)
    return out.withColumn("intent", 1.4 * coverage + ctor + impl + lang + hints + noisy + infra)


FIELD_WEIGHTS = {"short_name_overlap": 0.02, "name_overlap": 0.01, "signature_overlap": 0.01, "path_overlap": 0.005, "kind_overlap": 0.005}


def field_score() -> Column:
    total = F.lit(0.0)
    for name, w in FIELD_WEIGHTS.items():
        total = total + w * F.col(name)
    return total


def intent_rank(df: DataFrame, weight: float = INTENT_WEIGHT) -> DataFrame:
    """Rescore and re-sort each query's first candidates; the tail keeps its places unsorted."""
    scored = df.withColumn("score", F.when(F.col("rank") <= INTENT_WINDOW, F.col("score") + weight * F.col("intent") + field_score()).otherwise(F.col("score")))
    head = F.when(F.col("rank") <= INTENT_WINDOW, 0).otherwise(1)
    order = Window.partitionBy("query_id").orderBy(head, F.when(head == 0, -F.round("score", 9)), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("new_rank", "rank")


def features(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds the overlap features of candidates (qualified_name, signature, file, kind, body)."""
    out = df.withColumn("o_tokens", overlap_tokens(F.col(query)))
    q = F.col("o_tokens")
    columns = {
        "name_overlap": F.col("qualified_name"),
        "short_name_overlap": short_name(F.col("qualified_name")),
        "signature_overlap": F.coalesce("signature", F.lit("")),
        "path_overlap": F.col("file"),
        "kind_overlap": F.col("kind"),
        "body_overlap": F.coalesce("body", F.lit("")),
    }
    return out.withColumns({k: overlap_ratio(q, v) for k, v in columns.items()})


def is_micro(body: Column, start: Column, end: Column) -> Column:
    """A symbol too small to answer: under 50 bytes over fewer than two further lines."""
    return (F.octet_length(body) < 50) & (end - start < 2)


def is_constructor(name: Column, qualified_name: Column, body: Column) -> Column:
    return name.startswith("New") | qualified_name.endswith(".New") | F.coalesce(body, F.lit("")).startswith("func New")


def constructor_boost(score: Column, constructor: Column) -> Column:
    return F.when(constructor, score * 1.15).otherwise(score)


def provenance(from_vector: Column, from_text: Column, kept: Column) -> Column:
    """Where a result comes from; only a seed that was ``kept`` bears a seed's label."""
    label = F.when(from_vector & from_text, "hybrid_seed").when(from_text, "fts_seed").otherwise("vector_seed")
    return F.when(kept & (from_vector | from_text), label).otherwise("ppr_neighbor")


def callable_kind(kind: Column) -> Column:
    """Whether calls of such a symbol mean anything; edges into constants, variables and types are accidents of their names."""
    return ~kind.isin("const", "var", "type")


def ambiguity(ranked: DataFrame) -> DataFrame:
    """(query_id, gap, tied, ambiguous): small lead or several near-ties among the first five."""
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    stats = ranked.groupBy("query_id").agg(top.alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.collect_list(F.when(F.col("rank") <= 5, F.col("score"))).alias("five"), F.count("*").alias("n"))
    tied = F.size(F.filter("five", lambda s: (F.col("top") - s) / F.col("top") <= 0.10))
    gap = (F.col("top") - F.col("second")) / F.col("top")
    verdict = F.when(F.col("n") < 2, False).when(F.col("top") <= 0, True).otherwise((gap < 0.10) | (tied >= 3))
    return stats.select("query_id", gap.alias("gap"), F.when(F.col("top") > 0, tied).otherwise(0).alias("tied"), verdict.alias("ambiguous"))


def skip_rerank(df: DataFrame) -> DataFrame:
    """Per query's first candidate (query, qualified_name, is_constructor, name_overlap, score, second, why): adds skip."""
    compact = lambda c: F.regexp_replace(F.lower(c), "[ _-]", "")
    name = compact(short_name(F.col("qualified_name")))
    exact = (name != "") & F.contains(compact(F.col("query")), name)
    builds = (F.lower("query").contains("constructor") | F.lower("query").contains("new ")) & F.col("is_constructor") & exact
    gap = F.coalesce((F.col("score") - F.col("second")) / F.col("score") >= 0.5, F.lit(False)) & (F.col("score") > 0)
    short = (F.size(F.split(F.btrim("query"), r"\s+")) <= 2) & (F.col("why") == "vector_seed")
    return df.withColumn("skip", builds | (exact & (F.col("name_overlap") >= 0.5)) | (F.col("name_overlap") >= 0.8) | gap | short)


def lexical_relevance(df: DataFrame, query: str = "query") -> DataFrame:
    """Deterministic stand-in for a cross-encoder: the sigmoid of weighted overlaps. Adds relevance."""
    q = overlap_tokens(F.col(query))
    logit = 4 * overlap_ratio(q, F.concat_ws(" ", "qualified_name", "signature")) + 2 * overlap_ratio(q, F.col("body")) - 2
    return df.withColumn("relevance", sigmoid(logit))


def rerank(df: DataFrame, scorer, pool: int = INTENT_WINDOW) -> DataFrame:
    """Score each query's first ``pool`` candidates with ``scorer(queries, texts) -> floats`` (a logit per pair) and re-sort them.

    Without a scorer, or for the queries whose ``skip`` is true, order and scores stay.
    """
    if scorer is None:
        return df

    def run(batches):
        for pdf in batches:
            do = (pdf["rank"] <= pool) & ~pdf["skip"].fillna(False)
            rel = pd.Series(0.0, index=pdf.index)
            if do.any():
                z = pd.Series(scorer(pdf.loc[do, "query"].tolist(), pdf.loc[do, "card"].tolist()), index=pdf.index[do]).astype(float)
                rel[do] = 1 / (1 + (-z).map(lambda x: __import__("math").exp(max(-60, min(60, x)))))
            yield pdf.assign(relevance=rel)

    scored = df.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema.fields)}, relevance double")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("rank") <= pool, 0).otherwise(1), F.desc("relevance"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("new_rank", "rank")


def default_floor(limit: int) -> int:
    """Answers that non-test files are owed: a quarter of the list, none in lists of three or fewer."""
    return 0 if limit <= 3 else limit // 4


def test_floor(ranked: DataFrame, floor: int, test: Column) -> DataFrame:
    """Move the first ``floor`` rows that are no tests to the head; everything keeps its order otherwise."""
    if floor <= 0:
        return ranked
    flagged = ranked.withColumn("_test", test)
    nth = F.row_number().over(Window.partitionBy("query_id", "_test").orderBy("rank"))
    head = flagged.withColumn("_head", F.when(~F.col("_test") & (nth <= floor), 0).otherwise(1))
    order = Window.partitionBy("query_id").orderBy("_head", "rank")
    return head.withColumn("new_rank", F.row_number().over(order)).drop("rank", "_head", "_test").withColumnRenamed("new_rank", "rank")


def assign_confidence(ranked: DataFrame) -> DataFrame:
    """Adds confidence: high with a score above .85 and a lead of over a tenth of it on the next row, medium above .65.

    The lead is 1 for a query's last row and for scores of zero or less.
    """
    following = F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    gap = F.when(following.isNull() | (F.col("score") <= 0), 1.0).otherwise((F.col("score") - following) / F.col("score"))
    return ranked.withColumn("confidence", F.when((F.col("score") > 0.85) & (gap > 0.10), "high").when(F.col("score") > 0.65, "medium").otherwise("low"))


def retrieval_health(ranked: DataFrame) -> DataFrame:
    """(query_id, gap, tied, consensus, confidence): agreement of the first five results on rank 1's file."""
    w = Window.partitionBy("query_id")
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(w)
    rows = ranked.withColumns({"_top": first("score"), "_file": first("file"), "_rel": first("relevance"), "_second": F.max(F.when(F.col("rank") == 2, F.col("score"))).over(w), "_n": F.count("*").over(w)}).filter("rank <= 5")
    h = rows.groupBy("query_id").agg(
        F.max("_top").alias("top"),
        F.max("_second").alias("second"),
        F.max("_rel").alias("relevance"),
        F.least(F.lit(5), F.max("_n")).alias("shown"),
        F.count(F.when((F.col("_top") > 0) & ((F.col("_top") - F.col("score")) / F.col("_top") <= 0.10), 1)).alias("tied"),
        F.count(F.when(F.col("file") == F.col("_file"), 1)).alias("consensus"),
    )
    gap = F.when((F.col("top") > 0) & (F.coalesce("second", F.lit(0.0)) > 0), (F.col("top") - F.col("second")) / F.col("top")).otherwise(1.0)
    weak = (F.col("relevance") > 0) & (F.col("relevance") < WEAK_MATCH)
    label = F.when(weak, "low").when((F.col("consensus") >= 3) | (F.col("consensus") == F.col("shown")), "high").when(F.col("consensus") == 2, "medium").otherwise("low")
    return h.select("query_id", gap.alias("gap"), "tied", "consensus", label.alias("confidence"))


def visibility(qualified_name: Column, file: Column) -> Column:
    """public or internal: by the short name's first letter in Go, by the file's name in TypeScript and JavaScript, else public."""
    ext = F.regexp_extract(file, r"(\.[^./\\\\]*)$", 1)
    short = short_name(qualified_name)
    script = F.contains(file, F.lit("_test")) | file.endswith(".test.ts") | file.endswith(".test.tsx") | file.endswith(".spec.ts")
    return (
        F.when(ext == ".go", F.when((short == "") | short.rlike(r"^\p{Lu}"), "public").otherwise("internal"))
        .when(ext.isin(".ts", ".tsx", ".js", ".jsx") & script, "internal")
        .otherwise("public")
    )


def prefer_nested(ranked: DataFrame) -> DataFrame:
    """Move a result that lies within another of the same file (file, start, end) before it; other pairs keep their order.

    Pairs are looked at in rank order, the outer one first, and swap their places if the inner one comes later. An answer
    is one group of some dozens of rows, so this is done per query.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields)

    def run(pdf):
        pdf = pdf.sort_values(["rank"], kind="stable").reset_index(drop=True)
        rows = list(zip(pdf["file"], pdf["start"], pdf["end"]))
        place = list(range(len(rows)))
        for i, (outer, a, b) in enumerate(rows):
            for j, (inner, c, d) in enumerate(rows):
                if i != j and outer == inner and a <= c and d <= b and b - a > d - c and place[j] > place[i]:
                    place[i], place[j] = place[j], place[i]
        first = pdf["rank"].sort_values().to_list()
        order = sorted(range(len(rows)), key=place.__getitem__)
        out = pdf.iloc[order].copy()
        out["rank"] = first
        return out

    return ranked.groupBy("query_id").applyInPandas(run, fields)
