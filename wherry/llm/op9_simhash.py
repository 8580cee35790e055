"""SimHash near-duplicates with pivot distance tables.

A fingerprint has bit i set where over half of the document's shingle hashes have it. Two fingerprints
are linked at ``MAX_DISTANCE`` or fewer differing bits.

Equal fingerprints are one node first, so copies never meet in pairs. Each node then stores its Hamming
distances to ``PIVOTS``, reference fingerprints that are the same for all data. By the triangle
inequality two linked nodes differ by MAX_DISTANCE at most in every coordinate, so a pair whose largest
coordinate difference is above that is discarded, and only the survivors' bits are compared.

Coordinates of random 64-bit words lie close together, so bounds on them alone leave a fixed share of
all pairs. The pairs that are put to the pivot test therefore share three of six bit segments: three
differing bits touch three segments at most, so no linked pair is missed, and a key has 32 bits. The
join sees distinct fingerprints only.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero; fewer than three
words are one shingle; rows that repeat an id are one document's; null ids get the component of their
fingerprint; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm.common import by_size, materialize, pieces, table
from wherry.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Widths of the bit segments, lowest bits first.
SEGMENTS = (11, 11, 11, 11, 10, 10)
#: Sixteen Walsh words of pairwise distance 32: bit b of word i is the parity of i & b.
PIVOTS = tuple(sum(((i & b).bit_count() & 1) << b for b in range(64)) for i in range(1, 17))
SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z alone, and the six ASCII blanks
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for s in range(0, n, SLICE):
        h = np.array([digest(join(words[i : i + SHINGLE]), SEED) for i in range(s, min(n, s + SLICE))], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_pairs(nodes: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) of nodes whose fingerprints differ in ``distance`` (three at most) or fewer bits; ``nodes``: fp, node, fp distinct."""
    if distance > MAX_DISTANCE:
        raise ValueError(f"the segments are laid out for up to {MAX_DISTANCE} differing bits")
    starts = np.cumsum([0, *SEGMENTS[:-1]]).tolist()
    masks = [((1 << w) - 1) << s for w, s in zip(SEGMENTS, starts)]
    keys = [F.struct(F.lit(i).cast("tinyint").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(sum(m)))).alias("bits")) for i, m in enumerate(combinations(masks, len(masks) - MAX_DISTANCE))]
    pivots = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("tinyint").alias(f"p{i}") for i, p in enumerate(PIVOTS)]
    rows = nodes.select("fp", "node", *pivots, F.explode(F.array(*keys)).alias("key")).select("key.part", "key.bits", "fp", "node", *(f"p{i}" for i in range(len(PIVOTS))))
    # Never a broadcast: a node is twenty rows of all its distances here, over a hundred times its bytes in a file, which is all that Spark sees.
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    near = F.lit(True)
    for i in range(len(PIVOTS)):
        near = near & (F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= distance)
    pairs = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp")) & near)
    return pairs.filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (least id reachable over links) of every document."""
    prints = materialize(fingerprints(docs))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = connected_components(linked_pairs(nodes.filter("node is not null")))
    named = materialize(nodes.join(roots.hint("merge"), "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))
    return prints.join(by_size(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
