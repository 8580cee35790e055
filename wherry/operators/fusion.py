"""Rank fusion, blending, pools and protections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def by_query(*order) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def rrf(channels: dict[str, tuple[DataFrame, float]], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank, from_<channel>...): sum of weight / (constant + rank) over the channels.

    ``channels``: name to (frame with query_id, id, rank; weight). Channels of weight zero lend their flag only.
    """
    flags = [F.max(F.col("channel") == name).alias(f"from_{name}") for name in channels]
    rows = [
        df.select("query_id", "id", F.lit(name).alias("channel"), (F.lit(float(w)) / (F.lit(constant) + F.col("rank"))).alias("part"))
        for name, (df, w) in channels.items()
    ]
    fused = reduce(DataFrame.unionByName, rows).groupBy("query_id", "id").agg(F.sum("part").alias("score"), *flags)
    ranked = fused.withColumn("rank", F.row_number().over(by_query(F.desc(F.round("score", 9)), "id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def effective_alpha(overlap: Column, gap: Column, explicit: Column | None = None) -> Column:
    """Weight of the seed score: explicit, or by name overlap and the relative lead of the first candidate."""
    gate = F.when(overlap >= 0.60, 0.92).when((overlap >= 0.35) & (gap >= 0.20), 0.85).otherwise(0.70)
    return gate if explicit is None else F.coalesce(explicit, gate)


def relative_gap(score: str = "score") -> Column:
    """(first - second) / first within a query; 1 for a lone candidate."""
    w = Window.partitionBy("query_id")
    first = F.max(F.when(F.col("rank") == 1, F.col(score))).over(w)
    second = F.max(F.when(F.col("rank") == 2, F.col(score))).over(w)
    return F.when((first > 0) & second.isNotNull(), (first - second) / first).otherwise(1.0)


def blend(candidates: DataFrame, alpha: Column) -> DataFrame:
    """Adds fused and fused_rank: alpha * seed / max seed + (1 - alpha) * ppr / max ppr within each query."""
    w = Window.partitionBy("query_id")
    share = lambda c: F.when(F.max(c).over(w) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.max(c).over(w)).otherwise(0.0)
    fused = candidates.withColumns({"seed_share": share("seed_score"), "ppr_share": share("ppr_score")})
    fused = fused.withColumn("fused", alpha * F.col("seed_share") + (1 - alpha) * F.col("ppr_share"))
    return fused.withColumn("fused_rank", F.row_number().over(by_query(F.desc(F.round("fused", 9)), "id")))


def protect_top_seed(ranked: DataFrame, top_seed: DataFrame) -> DataFrame:
    """(query_id, id, rank) with each query's top vector seed (query_id, id) at the head, put in where it was missing.

    The list keeps its length: a seed that was not in it takes the last one's place. Queries without rows get none.
    """
    sizes = ranked.groupBy("query_id").agg(F.count("*").alias("_size"))
    head = top_seed.select("query_id", "id", F.lit(0).alias("rank"))
    rest = ranked.select("query_id", "id", "rank").join(head.select("query_id", "id"), ["query_id", "id"], "left_anti")
    placed = head.unionByName(rest.withColumn("rank", F.col("rank").cast("int"))).withColumn("_n", F.row_number().over(by_query("rank", "id")))
    return placed.join(sizes, "query_id").filter(F.col("_n") <= F.col("_size")).select("query_id", "id", F.col("_n").alias("rank"))


def append_missing(pool: DataFrame, extra: DataFrame, limit: int, why: str) -> DataFrame:
    """Append up to ``limit`` rows of ``extra`` (query_id, id, rank) that a query's pool lacks, in their order."""
    new = extra.join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = new.withColumn("n", F.row_number().over(by_query("rank"))).filter(F.col("n") <= limit)
    last = pool.groupBy("query_id").agg(F.max("rank").alias("last"))
    added = new.join(last, "query_id").select("query_id", "id", (F.col("last") + F.col("n")).alias("rank"), F.lit(why).alias("why"))
    return pool.select("query_id", "id", "rank", F.lit("pool").alias("why")).unionByName(added)


def append_top_seeds(pool: DataFrame, seeds: DataFrame, protect: int = 20, unconditional: int = 12, overlap: float = 0.25) -> DataFrame:
    """Missing ones of the first ``protect`` vector seeds (query_id, id, rank, name_overlap): the first ones always, the rest with enough overlap."""
    wanted = seeds.filter((F.col("rank") <= protect) & ((F.col("rank") <= unconditional) | (F.col("name_overlap") >= overlap)))
    return append_missing(pool, wanted, protect, "vector_seed")


def append_anchor_neighbours(pool: DataFrame, anchors: DataFrame, graph: DataFrame, walked: DataFrame, limit: int, agreement: int = 2) -> DataFrame:
    """Neighbours that the pool lacks of a query's anchors (query_id, id), by the number of edges from them, walk score and id.

    ``graph``: a, b, both directions of every edge, parallel ones as they are; ``walked``: query_id, id, ppr_score. Anchors
    themselves are none; a neighbour needs ``agreement`` edges.
    """
    hits = anchors.select("query_id", F.col("id").alias("a")).join(graph, "a").groupBy("query_id", F.col("b").alias("id")).agg(F.count("*").alias("hits")).filter(F.col("hits") >= agreement)
    new = hits.join(anchors.select("query_id", "id"), ["query_id", "id"], "left_anti").join(walked.select("query_id", "id", "ppr_score"), ["query_id", "id"], "left")
    ranked = new.withColumn("rank", F.row_number().over(by_query(F.desc("hits"), F.desc(F.coalesce("ppr_score", F.lit(0.0))), "id")))
    return append_missing(pool, ranked, limit, "anchor")


def reserve_anchor_slots(rows: list[dict], limit: int, share: int = 5) -> list[dict]:
    """Give one ``share``-th of an answer's places to anchors (is_anchor) from files that its head lacks.

    Anchors that stand within the cut already count; places that no anchor claims go to the next rows. Sequential by nature.
    """
    slots = max(1, limit // share) if share > 0 else 0
    free = slots - sum(bool(r["is_anchor"]) for r in rows[:limit])
    if limit <= 0 or share <= 0 or len(rows) <= limit or free <= 0:
        return rows
    out = rows[: limit - free]
    files, ids = {r["file"] for r in out}, {r["id"] for r in out}
    for wanted in (lambda r: r["is_anchor"] and r["file"] not in files, lambda r: True):
        for r in rows:
            if len(out) < limit and r["id"] not in ids and wanted(r):
                out.append(r)
                ids.add(r["id"])
                files.add(r["file"])
    return out


def reserve_literal_slots(rows: list[dict], literal: list[dict], limit: int, slots: int) -> list[dict]:
    """Put literal hits from files that an answer's head lacks before its last ``slots`` places; the tail follows them."""
    slots = min(slots, limit - 1)
    if slots <= 0 or not literal:
        return rows
    out = rows[: limit - slots]
    files, ids, new = {r["file"] for r in out}, {r["id"] for r in out}, []
    for r in literal:
        if len(new) < slots and r["id"] not in ids and r["file"] not in files:
            new.append(r)
            files.add(r["file"])
    taken = {r["id"] for r in new}
    return out + new + [r for r in rows[limit - slots :] if r["id"] not in taken]


def reserve_slots_frame(ranked: DataFrame, limit: int, literal: DataFrame | None = None, literal_slots: int = 0) -> DataFrame:
    """(query_id, id, rank) after both reservations; ranked: query_id, id, file, rank, is_anchor; literal: query_id, id, file, rank.

    A group is one query's pool, some dozens of rows.
    """
    rows = ranked.select("query_id", "id", "file", "rank", "is_anchor", F.lit(False).alias("literal"))
    if literal is not None and literal_slots > 0:
        rows = rows.unionByName(literal.select("query_id", "id", "file", "rank", F.lit(False).alias("is_anchor"), F.lit(True).alias("literal")))

    def run(pdf):
        records = pdf.sort_values(["rank", "id"]).to_dict("records")
        out = reserve_anchor_slots([r for r in records if not r["literal"]], limit)
        out = reserve_literal_slots(out, [r for r in records if r["literal"]], limit, literal_slots)
        return type(pdf)({"query_id": pdf["query_id"].iloc[0], "id": [r["id"] for r in out], "rank": range(1, len(out) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, rank long")
