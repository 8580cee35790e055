"""Evaluation metrics, calibration, comparison and sampling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_metrics(ranked: DataFrame, expected: DataFrame, cases: DataFrame, traps: DataFrame | None = None) -> DataFrame:
    """Per case: hit1, hit3, hits5, hits10, recall5, recall10, mrr, ndcg5, traps5.

    ranked: query_id, id, rank; expected: query_id, id; cases: query_id, min_hits. Recall needs min_hits hits (one at least).
    """
    hits = ranked.join(expected.distinct(), ["query_id", "id"], "left_semi")
    gain = F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1))
    per = hits.groupBy("query_id").agg(
        F.min("rank").alias("first"),
        F.count(F.when(F.col("rank") <= 5, 1)).alias("hits5"),
        F.count(F.when(F.col("rank") <= 10, 1)).alias("hits10"),
        F.sum(gain).alias("dcg"),
    )
    size = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    out = cases.join(per, "query_id", "left").join(size, "query_id", "left")
    need = F.greatest(F.lit(1), F.coalesce("min_hits", F.lit(1)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.col("n_expected").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select(
        "query_id",
        zero((F.col("first") == 1).cast("int")).alias("hit1"),
        zero((F.col("first") <= 3).cast("int")).alias("hit3"),
        zero(F.col("hits5")).alias("hits5"),
        zero(F.col("hits10")).alias("hits10"),
        (zero(F.col("hits5")) >= need).cast("int").alias("recall5"),
        (zero(F.col("hits10")) >= need).cast("int").alias("recall10"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.coalesce("n_expected", F.lit(0)) > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg5"),
    )
    if traps is None:
        return out.withColumn("traps5", F.lit(0).cast("long"))
    fell = ranked.filter("rank <= 5").join(traps.distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("traps5"))
    return out.join(fell, "query_id", "left").withColumn("traps5", zero(F.col("traps5")))


MEANS = ("hit1", "hit3", "recall5", "recall10", "mrr", "ndcg5")


def summarize(per_case: DataFrame, keys: list[str] | None = None) -> DataFrame:
    g = per_case.groupBy(*(keys or []))
    return g.agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in MEANS))


def by_tag(per_case: DataFrame, tags: str = "tags") -> DataFrame:
    """Means by tag: a case counts for each of its tags, or for untagged."""
    tagged = per_case.withColumn("tag", F.explode(F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, F.array(F.lit("untagged"))).otherwise(F.col(tags))))
    return summarize(tagged, ["tag"])


def weighted(summaries: DataFrame, weight: str = "n") -> DataFrame:
    """Means of summaries weighted by their number of cases."""
    return summaries.agg(F.sum(weight).alias("n"), *((F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(m) for m in MEANS))


def graded_ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """(query_id, ndcg, recall): 2^grade - 1 gains to k, recall to deep, for queries with a positive grade."""
    good = qrels.filter("grade > 0")
    got = ranked.join(good, ["query_id", "id"]).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count(F.when(F.col("rank") <= deep, 1)).alias("found"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    ideal = good.withColumn("i", place).groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("i") + 1))).alias("ideal"), F.count("*").alias("n"))
    out = ideal.join(got, "query_id", "left")
    return out.select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"), (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"))


def pooled_and_macro(per_query: DataFrame, group: str, metric: str) -> DataFrame:
    """(group, n, value): one row per group, the pooled mean (POOLED) and the mean of groups (MACRO)."""
    one = per_query.groupBy(group).agg(F.count("*").alias("n"), F.avg(metric).alias("value"))
    pooled = per_query.agg(F.lit("POOLED").alias(group), F.count("*").alias("n"), F.avg(metric).alias("value"))
    macro = one.agg(F.lit("MACRO").alias(group), F.count("*").alias("n"), F.avg("value").alias("value"))
    return one.select(F.col(group).cast("string").alias(group), "n", "value").unionByName(pooled).unionByName(macro)


def line_prefix(shown: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of each query's results (rank, lines) within a budget of lines; it stops at the first overflow."""
    run = F.sum("lines").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return shown.withColumn("running", run).filter(F.col("running") <= budget)


def explore_metrics(shown: DataFrame, gold_regions: DataFrame, gold_files: DataFrame) -> DataFrame:
    """Per query: hit_file, file_recall, line_recall, precision, f1, first_useful, unique_files.

    shown: query_id, rank, file, start, end; gold_regions: query_id, file, start, end; gold_files: query_id, file.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    nothing = F.lit(None).cast("long")
    rows = shown.select("query_id", "file", F.lit("shown").alias("kind"), "rank", long("start"), long("end"))
    rows = rows.union(gold_regions.select("query_id", "file", F.lit("gold"), F.lit(None), long("start"), long("end"))).union(gold_files.select("query_id", "file", F.lit("file"), F.lit(None), nothing, nothing))
    kind, spans = F.col("kind"), F.col("start") <= F.col("end")
    before = Window.partitionBy("query_id", "file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def new_lines(mine: Column) -> Column:
        """Lines of a span that no earlier one of its set has; their sum is the size of the union."""
        reached = F.coalesce(F.max(F.when(mine & spans, F.col("end"))).over(before), F.col("start") - 1)
        return F.when(mine & spans, F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, reached))).otherwise(0)

    # One shuffle serves the windows and both groupings; no line has a row of its own.
    lined = rows.filter("query_id is not null").repartition("query_id").withColumns({"in_gold": new_lines(kind == "gold"), "in_shown": new_lines(kind == "shown"), "in_any": new_lines(kind.isin("gold", "shown"))})
    by_file = lined.groupBy("query_id", "file").agg(*(F.sum(c).alias(c) for c in ("in_gold", "in_shown", "in_any")), F.min("rank").alias("rank"), F.max(kind == "shown").alias("is_shown"), F.max(kind == "file").alias("is_gold"))
    found = F.col("is_shown") & F.col("is_gold") & F.col("file").isNotNull()
    out = by_file.groupBy("query_id").agg(
        F.sum("in_gold").alias("gold_lines"),
        F.sum("in_shown").alias("shown_lines"),
        F.sum(F.when(F.col("file").isNotNull(), F.col("in_gold") + F.col("in_shown") - F.col("in_any"))).alias("covered"),
        F.count_if("is_shown").alias("unique_files"),
        F.count_if("is_gold").alias("gold_files"),
        F.count_if(found).alias("files_found"),
        F.min(F.when(found, F.col("rank"))).alias("first_useful"),
    ).filter("gold_files > 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    recall = F.when(zero("gold_lines") > 0, zero("covered") / F.col("gold_lines")).otherwise(0.0)
    precision = F.when(zero("shown_lines") > 0, zero("covered") / F.col("shown_lines")).otherwise(0.0)
    return out.select(
        "query_id",
        (zero("files_found") > 0).cast("int").alias("hit_file"),
        (zero("files_found") / F.col("gold_files")).alias("file_recall"),
        recall.alias("line_recall"),
        precision.alias("precision"),
        F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0).alias("f1"),
        zero("first_useful").alias("first_useful"),
        zero("unique_files").alias("unique_files"),
    )


LONGEST_REGION = 5000


def clipped(regions: DataFrame) -> DataFrame:
    """Regions (start, end) of LONGEST_REGION lines and one at most, so that one whole file does not drown the rest."""
    return regions.withColumn("end", F.least("end", F.col("start") + LONGEST_REGION))


def budget_ndcg(shown: DataFrame, gold_regions: DataFrame, budget: int) -> DataFrame:
    """(query_id, ndcg_b) of every query with a gold region: first-cover gains of the prefix over those of the regions themselves.

    The ideal takes the regions, largest first, until one does not fit the budget; 0 where none fits. ``shown`` is the prefix.
    """
    regions = clipped(gold_regions)
    dcg = first_cover(shown, regions)
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "file", "start")
    # Empty regions come last, so they take no place and no lines from the others.
    sized = regions.filter("query_id is not null").withColumn("n", F.col("end") - F.col("start") + 1).withColumn("i", F.row_number().over(w)).withColumn("spent", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = (F.col("n") > 0) & (F.lit(budget <= 0) | (F.col("spent") <= budget))
    every = sized.groupBy("query_id").agg(F.sum(F.when(fits, F.col("n") / F.log2(F.col("i") + 1))).alias("ideal")).join(dcg, "query_id", "left")
    return every.select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg_b"))


def first_cover(shown: DataFrame, regions: DataFrame) -> DataFrame:
    """(query_id, dcg): 1 / log2(rank + 1) of every line of the regions, by the first rank that shows it.

    Spans are swept in line order, so the cost is that of their number and not of their lines; a task holds the spans of
    one query's file at a time.
    """
    span = lambda df, rank: df.filter("query_id is not null AND file is not null AND start <= end").select("query_id", "file", rank.cast("double").alias("rank"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    rows = span(shown.filter("rank > 0"), F.col("rank")).union(span(regions, F.lit(None)))
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, file, total, spans, gold = None, None, 0.0, [], []
        ids, gains = [], []
        for batch in batches:
            for q, f, r, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if q != query or f != file:
                    if spans and gold:
                        total += covered_gain(spans, gold)
                    spans, gold, file = [], [], f
                    if q != query:
                        if total > 0:
                            ids.append(query)
                            gains.append(total)
                        query, total = q, 0.0
                if r is None:
                    gold.append((a, b))
                else:
                    spans.append((a, b, r))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(gains, pa.float64())], names=["query_id", "dcg"])
            ids, gains, id_type = [], [], batch.schema.field(0).type
        if spans and gold:
            total += covered_gain(spans, gold)
        if total > 0:
            yield pa.RecordBatch.from_arrays([pa.array([query], id_type), pa.array([total], pa.float64())], names=["query_id", "dcg"])

    return rows.repartition("query_id").sortWithinPartitions("query_id", "file").mapInArrow(run, f"query_id {kind}, dcg double")


def covered_gain(spans: list[tuple], gold: list[tuple]) -> float:
    """1 / log2(rank + 1) over the lines of ``gold`` (start, end) by the least rank of the ``spans`` (start, end, rank) on each."""
    spans, merged = sorted(spans), []
    for a, b in sorted(gold):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    total, live, k = 0.0, [], 0
    for line, last in merged:
        while line <= last:
            while k < len(spans) and spans[k][0] <= line:
                heapq.heappush(live, (spans[k][2], spans[k][1]))
                k += 1
            while live and live[0][1] < line:
                heapq.heappop(live)
            upto = min(last, spans[k][0] - 1) if k < len(spans) else last
            if live:
                rank, end = live[0]
                upto = min(upto, end)
                total += (upto - line + 1) / math.log2(rank + 1)
            line = upto + 1
    return total


def hit_region(shown: DataFrame, gold_regions: DataFrame) -> DataFrame:
    """(query_id, hit_region): share of a query's gold regions that a shown span overlaps; regions and spans: file, start, end."""
    r = clipped(gold_regions).withColumn("region", F.row_number().over(Window.partitionBy("query_id").orderBy("file", "start", "end")))
    on = (F.col("r.query_id") == F.col("s.query_id")) & (F.col("r.file") == F.col("s.file")) & (F.col("r.start") <= F.col("s.end")) & (F.col("s.start") <= F.col("r.end"))
    seen = r.alias("r").join(shown.alias("s"), on, "left_semi").groupBy("query_id").agg(F.count("*").alias("seen"))
    return r.groupBy("query_id").agg(F.count("*").alias("n")).join(seen, "query_id", "left").select("query_id", (F.coalesce("seen", F.lit(0)) / F.col("n")).alias("hit_region"))


def run_diff(base: DataFrame, now: DataFrame, noise: float = 0.02) -> DataFrame:
    """(metric, base, now, delta, verdict): changes within the noise band are even."""
    j = base.select("metric", F.col("value").alias("base")).join(now.select("metric", F.col("value").alias("now")), "metric", "full")
    d = F.col("now") - F.col("base")
    verdict = F.when(F.col("base").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.abs(d) <= noise, "even").when(d > 0, "better").otherwise("worse")
    return j.select("metric", "base", "now", d.alias("delta"), verdict.alias("verdict"))


def threshold_sweep(scores: DataFrame, thresholds: list[float], group: str, value: str) -> DataFrame:
    """(threshold, group, share): share of a class below each threshold, in one pass over the scores."""
    counts = scores.groupBy(group).agg(F.count("*").alias("n"), *(F.count(F.when(F.col(value) < t, 1)).alias(f"t{i}") for i, t in enumerate(thresholds)))
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"t{i}") / F.col("n")).alias("share")) for i, t in enumerate(thresholds)))
    return counts.select(F.col(group), F.inline(pairs))


def nearest_rank(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Values at floor((n - 1) p) of each group's order, from counts by distinct value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p), F.col(value))).alias(name) for name, p in points.items()))


def stride_sample(df: DataFrame, order: list, n: int) -> DataFrame:
    """Rows floor(i * total / n) of the given order, all rows if there are no more than n.

    The running number comes from a sort by ranges with counts by partition, not from one task.
    """
    total = df.count()
    if n <= 0 or total <= n:
        return df
    numbered = running_number(df, order)
    wanted = [int(i * (total / n)) for i in range(n)]
    return numbered.filter(F.col("_no").isin(wanted)).drop("_no") if n <= 1000 else numbered.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in wanted], "_no long")), "_no", "left_semi").drop("_no")


def running_number(df: DataFrame, order: list) -> DataFrame:
    """Adds _no, the place of each row in the order, from 0: sort by ranges, then offsets of the partitions."""
    from wherry.sources.snapshot import materialize

    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_from", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_from")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_i", local).join(F.broadcast(offsets), "_part").withColumn("_no", F.col("_from") + F.col("_i")).drop("_part", "_i", "_from")


def hard_negatives(ranked: DataFrame, relevant: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, id, n): best-ranked documents that are not relevant, up to k."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.join(relevant, ["query_id", "id"], "left_anti").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("query_id", "id", "n")


def training_rows(negatives: DataFrame, relevant: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, positives, negatives): the first relevant ids in id order and the mined negatives in rank order; queries without either are skipped."""
    placed = relevant.distinct().withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("k") <= most)
    good = placed.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("positives"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda s: s["id"])
    return good.join(negatives.groupBy("query_id").agg(ordered.alias("negatives")), "query_id")


def holdout(key: Column, percent: int) -> Column:
    """Whether a key falls into the held-out part, by FNV-1a modulo 100."""
    from wherry.functions.vec import fnv1a32

    return fnv1a32(key) % 100 < percent


def adoption(events: DataFrame, window_seconds: int) -> DataFrame:
    """One row of counters over (ts, kind): served, positional, nudge, blocked, searched; followed counts nudges credited in the window."""
    from wherry.operators.joins import attribute

    counts = events.agg(*(F.count(F.when(F.col("kind").isin(*ks), 1)).alias(name) for name, ks in (("retrievals", ("served", "positional")), ("positional", ("positional",)), ("nudges", ("nudge",)), ("blocked", ("blocked",)), ("searched_after", ("searched",)))))
    credited = attribute(events.filter("kind = 'nudge'").select("ts"), events.filter("kind = 'positional'").select("ts"), window_seconds)
    return counts.crossJoin(F.broadcast(credited.agg(F.count("credited_by").alias("followed"))))
