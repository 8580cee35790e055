"""Readers and source-side filters: trees, JSONL, qrels, logs, manifests, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Languages by file extension.
EXTENSIONS = {
    "go": "go", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python",
    "java": "java", "rs": "rust", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp",
    "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala",
}
# Directories that are never read; dot directories are not either.
SKIPPED_DIRS = "node_modules vendor dist build target".split()
MAX_BYTES, GENERATED_HEAD = 1 << 20, 2048


def walk(files: DataFrame, languages: dict[str, str] | None = EXTENSIONS, include_tests: bool = True) -> DataFrame:
    """(path, language, hash, size, content) of the files (path, content) that are read: known, no larger than a MiB, not generated, not skipped."""
    from wherry.functions.text import file_ext
    from wherry.operators.rank import is_named_test

    text = F.col("content").cast("string")
    out = files.filter(F.octet_length("content") <= MAX_BYTES)
    out = out.filter(~F.col("path").rlike(r"(^|/)(\.[^/]*|" + "|".join(SKIPPED_DIRS) + ")/"))
    out = out.filter(~F.left(text, F.lit(GENERATED_HEAD)).rlike("Code generated.*DO NOT EDIT"))
    if languages:
        table = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
        out = out.withColumn("language", table[file_ext(F.col("path"))]).filter("language is not null")
    else:
        out = out.withColumn("language", F.lit(None).cast("string"))
    if not include_tests:
        out = out.filter(~is_named_test(F.col("path")))
    return out.select("path", "language", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.octet_length("content").alias("size"), "content")


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Walk a directory tree through the binary source; adds mtime."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.col("path"), "^.*?" + base + "/", "")
    files = raw.select(rel.alias("path"), "content", F.unix_timestamp("modificationTime").alias("mtime"))
    return walk(files.select("path", "content"), **options).join(files.select("path", "mtime"), "path")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; bad lines are dropped, blank ones skipped."""
    base = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    with_bad = T.StructType([*base.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad")


def read_corpus(spark: SparkSession, path: str, max_chars: int = 0) -> DataFrame:
    """(_id, text) of a retrieval corpus; text cut to ``max_chars`` characters if that is above zero."""
    rows = read_jsonl(spark, path, "_id string, text string")
    return rows.withColumn("text", F.left("text", F.lit(max_chars))) if max_chars else rows


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "_id string, text string, filtered_corpus_id array<string>")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of a tab-separated file with a header; rows need three fields."""
    rows = spark.read.option("header", "true").option("sep", "\t").schema("query_id string, doc_id string, grade int").csv(path)
    return rows.dropna(subset=["query_id", "doc_id", "grade"])


LOG_SCHEMA = "event string, request_id string, time timestamp, positional boolean, outcome string, note string, query string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of an append-only log; unreadable lines and unknown fields do no harm."""
    return read_jsonl(spark, path, LOG_SCHEMA)


def unwrap_json_string(c: Column) -> Column:
    """A text that is itself a JSON string is decoded; any other text stays."""
    quoted = c.rlike(r'(?s)^\s*".*"\s*$')
    decoded = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    return F.when(quoted, F.coalesce(decoded, c)).otherwise(c)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Instances of an exploration benchmark; queries are unwrapped."""
    rows = read_jsonl(spark, path, "instance_id string, dataset string, repo string, sha string, query string, gold_files array<string>, gold_regions array<struct<path:string,start:int,end:int>>")
    return rows.withColumn("query", unwrap_json_string(F.col("query")))


def overlay_docs(symbols: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Summaries (key, summary) are put before the documentation (doc)."""
    joined = symbols.join(overlay.select(F.col("key").alias(key), "summary"), key, "left")
    return joined.withColumn("doc", F.concat_ws("\n", "summary", "doc")).drop("summary")


#: Characters of needles that one automaton holds; more are searched in several passes.
NEEDLE_CHARS = 1 << 24


def grep_files(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, needle, file) of files (file, text) that hold a needle (query_id, needle) anywhere in their text.

    All needles are one automaton, so each text is read once however many there are; what is shuffled is the distinct
    pairs found. Empty needles match nothing.
    """
    found = contained(needles.select("needle"), texts, "file", "text")
    return needles.select("query_id", "needle").distinct().join(found, "needle").select("query_id", "needle", "file")


def contained(needles: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (needle, key) of texts that contain a needle; the distinct needles are a stated set and travel in blocks."""
    import ahocorasick
    import pyarrow as pa

    blocks: list[list[str]] = [[]]
    size = 0
    for r in needles.select("needle").filter("needle != ''").distinct().toLocalIterator():
        if size > NEEDLE_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append(r[0])
        size += len(r[0])
    kind = texts.schema[key].dataType.simpleString()

    def search(words):
        def run(batches):
            automaton = ahocorasick.Automaton()
            for w in words.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for batch in batches:
                rows, hits = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    seen = {w for _, w in automaton.iter(t)} if t else ()
                    rows += [i] * len(seen)
                    hits += seen
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["needle", key])

        return run

    out = None
    for block in blocks:
        words = texts.sparkSession.sparkContext.broadcast(block)
        part = texts.select(key, text).mapInArrow(search(words), f"needle string, `{key}` {kind}") if block else texts.select(F.lit("").alias("needle"), key).limit(0)
        out = part if out is None else out.union(part)
    return out.distinct()


def reads_to_target(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, reads): how many of a query's files (query_id, file) are opened in path order until its target; null if it is not among them."""
    from pyspark.sql import Window

    placed = hits.select("query_id", "file").distinct().withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("file")))
    found = placed.join(targets.distinct(), ["query_id", "file"], "left_semi").groupBy("query_id").agg(F.min("k").alias("reads"))
    return hits.select("query_id").distinct().join(found, "query_id", "left")


# Lines of documentation that say nothing of the code: tags, pragmas of tools, rules.
_TAG = r"^[@\\][a-zA-Z]+"
_PRAGMA = r"^(NOLINT|nolint|noinspection|eslint-|prettier-|tslint:|@ts-|istanbul |c8 |codebeat|SPDX-|Copyright|coverage:)"
_RULE = r"^[-=~_*{}\[\]()<>|/\\ \t]*$"


def normalize_docstring(c: Column) -> Column:
    """Documentation without comment marks, tags, pragmas and rules; empty if fewer than two words are left."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda z: F.btrim(z, F.lit(" \t\r\n")))
    bare = F.transform(lines, lambda z: F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(F.regexp_replace(z, r"^/\*\*?", ""), r"\*/$", "")), r"^(///|//!|//|\*|!|#)", ""), F.lit(" \t\r\n")))
    kept = F.filter(bare, lambda z: (z != "") & ~z.rlike(_TAG) & ~z.rlike(_PRAGMA) & ~z.rlike(_RULE))
    out = F.btrim(F.array_join(kept, "\n"), F.lit(" \t\r\n"))
    return F.when(out.rlike(r"\S\s+\S"), out).otherwise("")


def unique_docs(df: DataFrame, key: str, doc: str, least: int) -> DataFrame:
    """Rows whose documentation is long enough and borne by no other row, by digest counts."""
    long = df.filter(F.char_length(doc) >= least).withColumn("_h", F.sha2(F.col(doc).cast("binary"), 256))
    once = long.groupBy("_h").agg(F.count("*").alias("_n"), F.min(key).alias(key)).filter("_n = 1").select(key)
    return df.join(once, key, "left_semi")


# Words of a declaration that name nothing.
DECLARING = "func def class type struct interface const var static public private protected async export return".split()
#: What stands before a commit and between its hash and subject in a log that is read.
COMMIT, FIELD = "\x01", "\x1f"


def parse_log(log: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """(commit, subject, path, context) of each hunk in whole logs with patches of no context lines (``-p -U0``).

    A commit's line is ``COMMIT hash FIELD subject``; paths are those after the change, without ``prefix``.
    """
    commits = log.select(F.explode(F.split(text, COMMIT)).alias("c")).filter(F.contains("c", F.lit(FIELD)))
    first = F.substring_index("c", "\n", 1)
    files = commits.select(F.substring_index(first, FIELD, 1).alias("commit"), F.substring_index(first, FIELD, -1).alias("subject"), F.explode(F.split("c", "\ndiff --git ")).alias("part"))
    path = F.regexp_extract("part", r"^[^\n]*? b/([^\n]*)", 1)
    bare = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if prefix else path
    hunks = files.select("commit", "subject", bare.alias("path"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^@@[^\n]*?@@([^\n]*)$"), 1)).alias("context"))
    return hunks.filter("path != ''").select("commit", "subject", "path", F.btrim("context").alias("context"))


def resolve_commits(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(commit, subject, gold): commits whose changed hunks name one to eight symbols; subjects of four words or more about one thing.

    hunks: commit, subject, path, context (the text after the hunk header).
    """
    from wherry.functions.text import clean_subject, is_compound, lit_array

    names = F.filter(F.array_distinct(F.regexp_extract_all("context", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0)), lambda n: (F.char_length(n) >= 3) & ~F.array_contains(lit_array(DECLARING), n))
    named = hunks.select("commit", clean_subject(F.col("subject")).alias("subject"), "path", F.explode(names).alias("name"))
    known = symbols.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "name", "qualified_name")
    gold = named.join(known, ["path", "name"]).groupBy("commit", "subject").agg(F.array_sort(F.collect_set("qualified_name")).alias("gold"))
    return gold.filter(F.size("gold").between(1, 8) & (F.size(F.split(F.btrim("subject"), r"\s+")) >= 4) & ~is_compound(F.col("subject")))


def write_diagnostics(rows: DataFrame, path: str) -> None:
    """Ranking diagnostics as JSON lines."""
    rows.write.mode("overwrite").json(path)
