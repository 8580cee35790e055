"""Pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

All shingles stand in one order that is the same for every document: those that a sample of the documents
repeats come last, else by hash. Two sets that are similar enough share a shingle among the first
n - ceil(0.8 n) + 1 of each (prefix filter), so pairs that meet there are all that can be similar. A pair
is kept as a candidate if its sizes and the number of shingles shared so far allow 0.8, and only then the
whole sets are compared. No step loses a pair; the sample only decides how many pairs meet.

Words are those of the fingerprints (A-Z lowered, cut at ASCII blanks); a text of fewer than five words is
one shingle; texts without words have no shingles and no pairs; null ids have none either. Documents with
equal sets are one node, named by the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherry.llm.common import by_size, materialize, pieces

SHINGLE = 5
#: Documents that are looked at, about, for shingles that many documents share.
SAMPLE_DOCS = 10_000
#: Sampled documents with a shingle that count as many, and such shingles sent to the executors at most (the most frequent ones).
OFTEN, MAX_OFTEN = 3, 1 << 17


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(words[i : i + SHINGLE])) for i in range(n)), np.uint64, n).view(np.int64))


def prefix_size(n):
    """Shingles of a set of n that a similar set must share one of; for numbers and columns."""
    return n - F.ceil(n * 4 / 5).cast("int") + 1 if not isinstance(n, int) else n - (4 * n + 4) // 5 + 1


def _often(docs: DataFrame) -> np.ndarray:
    """Shingles that several sampled documents have, sorted."""
    total = docs.count()
    if total > SAMPLE_DOCS:
        docs = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < max(1, (SAMPLE_DOCS << 20) // total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            if sets:
                s, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n.astype(np.int64))], names=["s", "n"])

    counted = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    return np.sort(np.array([r["s"] for r in counted.orderBy(F.desc("n"), "s").limit(MAX_OFTEN).select("s").collect()], np.int64))


def prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, prefix): 64 bits that name the set, its size and its first shingles."""
    often = docs.sparkSession.sparkContext.broadcast(_often(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = often.value
        for batch in pieces(batches):
            digests, sizes, firsts = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                n = len(s)
                digests.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(n)
                if len(late) and n:
                    s = s[np.argsort(late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s, kind="stable")]
                firsts.append(s[: prefix_size(n)] if n else s)
            cut = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            values = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(cut), pa.array(values))],
                names=["doc_id", "digest", "n", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest long, n int, prefix array<bigint>")


def similar_pairs(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links between ids. Pairs of one component of ``known`` (doc_id, component_id) need no proof and are left out."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    sets = materialize(prefixes(docs).filter("n > 0"))
    least = sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    equal = sets.select("doc_id", "digest").join(least.filter("copies > 1").hint("merge"), "digest").filter("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    rows = sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = rows.select("node", "n", F.explode("prefix").alias("s"))
    # Joins with a side that grows with the corpus are shuffles: files of near copies are small for what they hold.
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    fits = (F.col("a.n") * 5 >= F.col("b.n") * 4) & (F.col("b.n") * 5 >= F.col("a.n") * 4)
    met = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.node") < F.col("b.node")) & fits)
    # Sets of a repeated id that are of one size are counted together, which can only keep more.
    met = met.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("shared"))
    # What is shared beyond the shorter prefix lies in the rest of that set.
    rest = F.greatest(F.col("na") - prefix_size(F.col("na")), F.col("nb") - prefix_size(F.col("nb")))
    met = met.filter((F.col("shared") + rest) * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b").distinct()
    ids = known.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c")).hint("merge")
    met = met.join(ids.select(F.col("doc_id").alias("a"), F.col("c").alias("ca")), "a").join(ids.select(F.col("doc_id").alias("b"), F.col("c").alias("cb")), "b")
    met = materialize(met.filter("ca != cb").select("a", "b"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "set"])

    asked = materialize(met.select(F.col("a").alias("doc_id")).union(met.select("b")).distinct())
    full = docs.join(by_size(asked), "doc_id", "left_semi").mapInArrow(whole, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set array<bigint>")
    full = materialize(full).hint("merge")
    both = met.join(full.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    near = both.filter(common * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b")
    return near.union(equal).distinct()
