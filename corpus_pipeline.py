"""Corpus pipeline: toxicity, line deduplication, near-duplicates, decontamination, tokenisation.

Each stage works on all its predecessor kept. All but the last return the columns of ``documents``.

What a text is rejected for depends on the text alone, so toxicity and decontamination decide by row, whatever its id.
Of near-duplicates the rows with the least id stay: rows that repeat an id stand or fall together, rows without an id
stay. Null and empty texts are kept by every stage (empty ones are near-duplicates of each other); empty tables give
empty tables; further columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm import jaccard, op4_toxicity, op5_sentencepiece, op7_line_dedup, op9_simhash, op10_decontaminate
from wherry.llm.common import by_size, materialize, table
from wherry.llm.components import connected_components


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; it is trained on these documents and the labels."""
    return op4_toxicity.accepted(docs, op4_toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines; every document stays, n_chars follows its text."""
    kept = op7_line_dedup.dedup_documents(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near-duplicates.

    Linked are documents that op9 links, and all pairs whose five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    texts = docs.select("doc_id", "text")
    classes = materialize(op9_simhash.near_duplicates(texts).select("doc_id", "component_id"))
    ids = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c")).hint("merge")
    links = jaccard.similar_pairs(texts, classes).join(ids.toDF("a", "ca"), "a").join(ids.toDF("b", "cb"), "b")
    roots = materialize(connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    classes = classes.join(by_size(roots.withColumnRenamed("node", "component_id")), "component_id", "left")
    later = materialize(classes.filter("doc_id != coalesce(root, component_id)").select("doc_id").distinct())
    return docs.join(by_size(later), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of any benchmark item; op10's ``contaminated`` asks for several and is not used."""
    index = op10_decontaminate.build_index(docs.select(F.xxhash64("text").alias("doc_id"), "text"))
    leaked = op10_decontaminate.search(index, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select(F.col("doc_id").alias("digest"))
    leaked = materialize(leaked.distinct())
    return docs.join(leaked, F.xxhash64(docs["text"]) == leaked["digest"], "left_anti")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return op5_sentencepiece.encode_digests(docs, op5_sentencepiece.default_model_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", tokenise),
]

#: The classifier, the shingle hashes and the merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
