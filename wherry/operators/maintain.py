"""Index maintenance: change sets, upserts, cascades, reuse and repair, all as joins of old and new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_set(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, status): unchanged, changed, added or deleted."""
    o, n = old.select(F.col(key).alias("k"), F.col(digest).alias("old")), new.select(F.col(key).alias("k"), F.col(digest).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return o.join(n, "k", "full").select(F.col("k").alias(key), status.alias("status"))


def known_hash(files: DataFrame, known: DataFrame) -> DataFrame:
    """Adds hash: the stored one where size and time are as they were, else of the content."""
    k = known.select("path", F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), F.col("hash").alias("k_hash"))
    same = (F.col("size") == F.col("k_size")) & (F.col("mtime") == F.col("k_mtime"))
    return files.join(k, "path", "left").withColumn("reused", F.coalesce(same, F.lit(False))).withColumn("hash", F.when(F.col("reused"), F.col("k_hash")).otherwise(F.sha2(F.col("content").cast("binary"), 256))).drop("k_size", "k_mtime", "k_hash")


def upsert(old: DataFrame, new: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Rows of new replace those of old with the same key and keep their id; new keys get ids after the largest."""
    ids = old.select(F.col(key), F.col(id_col).alias("_old"))
    merged = new.join(ids, key, "left")
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    known = merged.filter("_old is not null").withColumn(id_col, F.col("_old")).drop("_old")
    # Fresh ids: a running number over buckets of keys, offset by the rows of the buckets before.
    fresh = merged.filter("_old is null").drop("_old").withColumn("_b", F.pmod(F.xxhash64(key), F.lit(256)))
    counts = fresh.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_from")
    numbered = fresh.join(F.broadcast(offsets), "_b").crossJoin(F.broadcast(top))
    numbered = numbered.withColumn(id_col, F.col("top") + F.col("_from") + F.row_number().over(Window.partitionBy("_b").orderBy(key))).drop("_b", "_from", "top")
    rest = old.join(new.select(key), key, "left_anti")
    return rest.unionByName(known.select(*old.columns)).unionByName(numbered.select(*old.columns))


def cascade_delete(tables: dict[str, DataFrame], doomed_files: DataFrame) -> dict[str, DataFrame]:
    """Delete files (id) and everything that hangs on them: symbols, bodies, vectors, chunks, chunk vectors, edges on either end."""
    gone = tables["symbols"].join(doomed_files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    out = {"files": tables["files"].join(doomed_files.select("id"), "id", "left_anti"), "symbols": tables["symbols"].join(gone, "id", "left_anti")}
    for name, key in (("bodies", "symbol_id"), ("vectors", "symbol_id"), ("chunks", "symbol_id"), ("postings", "symbol_id")):
        if name in tables:
            out[name] = tables[name].join(gone.withColumnRenamed("id", key), key, "left_anti")
    if "chunk_vectors" in tables:
        out["chunk_vectors"] = tables["chunk_vectors"].join(out["chunks"].select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    if "edges" in tables:
        out["edges"] = tables["edges"].join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return out


def insert_edges(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Union by (src, dst, kind): the first one wins, stored ones before new ones."""
    rows = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    w = Window.partitionBy("src", "dst", "kind").orderBy("_gen", seq)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_gen")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete and insert: rows of old whose key is in new give way."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def reuse_vectors(symbols: DataFrame, stored: DataFrame, text: str = "embedding_text") -> DataFrame:
    """Adds vector (null: to be embedded) from stored vectors keyed by the digest of the embedded text."""
    keyed = symbols.withColumn("text_hash", F.sha2(F.col(text).cast("binary"), 256))
    one = stored.groupBy("text_hash").agg(F.any_value("vector").alias("vector"))
    return keyed.join(one, "text_hash", "left")


def edge_dependents(edges: DataFrame, symbols: DataFrame, replaced_files: DataFrame) -> DataFrame:
    """(file_id): unchanged files with a caller of a symbol in a replaced file; their edges must be extracted again."""
    r = replaced_files.select("file_id")
    callee = symbols.join(r, "file_id", "left_semi").select(F.col("id").alias("dst"))
    callers = edges.join(callee, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return symbols.join(callers, "id", "left_semi").select("file_id").distinct().join(r, "file_id", "left_anti")


def index_stats(symbols: DataFrame, edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row: symbols, edges, edges per symbol, capped bodies and the bytes hidden by the cap."""
    s = symbols.agg(F.count("*").alias("symbols"), F.sum(F.octet_length("excerpt")).alias("shown"))
    e = edges.agg(F.count("*").alias("edges"))
    b = bodies.agg(F.count("*").alias("capped"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("full_bytes"))
    return s.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(b)).withColumn("edges_per_symbol", F.col("edges") / F.col("symbols"))


BACKFILL = 128


def backfill(symbols: DataFrame, stored: DataFrame, embedder, write, chunk: int = BACKFILL, key: str = "id") -> int:
    """Embed the symbols (key, text) that have no vector in ``stored`` yet; ``write(vectors)`` adds (key, vector) to the store.

    What is missing is found anew at each start, so a run that was stopped is taken up where it ended. ``embedder`` takes the texts of
    ``chunk`` symbols and gives their vectors. Returns the number that was missing.
    """
    missing = symbols.join(stored.select(key).distinct(), key, "left_anti").select(key, "text")
    n = missing.count()
    if n:
        kind = symbols.schema[key].dataType.simpleString()

        def run(batches):
            for pdf in batches:
                for low in range(0, len(pdf), chunk):
                    part = pdf.iloc[low : low + chunk]
                    yield part[[key]].assign(vector=[[float(x) for x in v] for v in embedder(part["text"].tolist())])

        write(missing.mapInPandas(run, f"{key} {kind}, vector array<double>"))
    return n


def incremental_index(old: dict[str, DataFrame], files: DataFrame, extract, known_paths: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """One run of the index over a walk: (tables, one row of counts).

    ``old``: files (id, path, hash), symbols (id, file_id, qualified_name, ...), edges (src, dst, kind, seq) and others that hang on
    symbols; ``files``: path, hash, ... of the walk; ``extract(changed files)`` gives their symbols (path, ... without ids).
    Unchanged files are left as they are; changed and deleted ones lose their symbols and all that hangs on them; changed and
    added ones get new symbols after the largest id.
    """
    status = change_set(old["files"], files)
    doomed = old["files"].join(status.filter("status in ('changed', 'deleted')"), "path", "left_semi")
    left = cascade_delete(old, doomed)
    fresh = files.join(status.filter("status in ('changed', 'added')"), "path", "left_semi")
    table = upsert(old["files"].join(status.filter("status = 'deleted'"), "path", "left_anti"), fresh.withColumn("id", F.lit(None).cast("long")).select(*old["files"].columns), "path")
    made = extract(fresh).join(table.select("path", F.col("id").alias("file_id")), "path").drop("path")
    top = old["symbols"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # Ids follow the file and the name, over buckets whose offsets are counted first.
    keyed = made.withColumn("_b", F.pmod(F.xxhash64("file_id", "qualified_name"), F.lit(256)))
    offsets = keyed.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + top).select("_b", "_from")
    numbered = keyed.join(F.broadcast(offsets), "_b").withColumn("id", F.col("_from") + F.row_number().over(Window.partitionBy("_b").orderBy("file_id", "qualified_name")))
    symbols = left["symbols"].unionByName(numbered.select(*old["symbols"].columns))
    counts = status.agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("unchanged", "changed", "added", "deleted")))
    return left | {"files": table, "symbols": symbols}, counts
