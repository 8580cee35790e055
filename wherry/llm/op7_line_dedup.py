"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A document's lines are its text cut after line feeds and, within a line, between words of which one ends and the
next, of three letters or more, begins with letters of two fixed halves of the alphabet, about one pair in four. The same
words are cut alike wherever they stand, so a passage in the midst of a long line has lines of its own. Words end at blanks; a letter of a script without
blanks is a word; blank lines belong to the line before them, and white space around a line does not count.

``K`` lines in a row have one hash. Of every ``W`` such hashes in a row the least is selected, the rightmost among
equals: these are the fingerprints, and two places that have the same ``RUN`` = W + K - 1 lines have the same one.
Fingerprints that occur once are left; the others' positions are joined and extended both ways to the W runs of RUN
lines that hold them. Each run is joined with its first occurrence (least doc_id, then position), never with all
others, and the lines of all later ones are deleted. Runs are compared with one another, whatever document they come
from, so a run that a first document holds in part only is still found in the second.

Guarantee: exactly those lines go that lie in a run of RUN lines, of ``LEAST`` bytes or more together, that
stands earlier; where RUN lines are shorter, in a run of ``MANY`` lines. A deleted line equals one that
stands earlier, so the first copy of every line stays.

Defined cases: null text stays null and has no lines; texts of fewer than RUN lines lose nothing; rows without
an id are passed on as they are; rows that repeat an id and text are one document and are cut alike; rows that
repeat an id with other texts are documents of their own, in the order of their texts' hashes; documents that
lose nothing keep their text to the byte; other columns are passed on by ``dedup_documents``, whatever their
names but ``_removed``, and ignored by ``removed_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm.common import materialize, result_of, table

K, W = 2, 4
#: Lines of a run, and of one that is too short for that.
RUN, MANY = W + K - 1, 8
#: Bytes of a run of RUN lines, about eight words.
LEAST = 40


def _ranges(step: int, width: int, *spans: tuple[int, int]) -> str:
    return "".join(f"\\u{a:04x}-\\u{a + width - 1:04x}" for low, high in spans for a in range(low, high, step))


#: The halves of ASCII that a word ends with before a line's end, and that the next one begins with, by the code's two last bits.
ENDS, BEGINS = ("".join(f"\\x{c:02x}" for c in range(33, 127) if c % 4 in rest) for rest in ((0, 1), (1, 2)))
#: Beyond Latin, first letters alone decide: four of sixteen of other alphabets (Greek to Arabic) and a quarter of every 128
#: code points of the scripts from there to Hangul.
OTHERS = _ranges(16, 4, (0x370, 0x700)) + _ranges(0x80, 0x20, (0x700, 0xE00), (0x10A0, 0x1780), (0x1800, 0x2000), (0xAC00, 0xD7A0))
#: Letters that begin a line wherever they stand, as their scripts put no blanks between words: Thai to Burmese, Khmer, Kana, Han.
UNSPACED = _ranges(0x30, 12, (0xE00, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100)) + _ranges(0x100, 0x40, (0x3400, 0xA000))
LATIN_CUT = rf"(?<=[ \n])(?:(?<=[{ENDS}] )(?=[{BEGINS}][^ \n]{{2}})|(?<=\n)(?!\n))"
CUT = rf"{LATIN_CUT}|(?<= )(?=[{OTHERS}])|(?<=[^\n])(?=[{UNSPACED}])"
BLANKS = " \t\r\n"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lines_of(text: Column) -> Column:
    """The lines with the white space that ends them, so that they join to the text again."""
    beyond_latin = (F.octet_length(text) - F.char_length(text) >= 2) & F.rlike(text, F.lit(r"[\u0250-\uffff]"))
    return F.when(beyond_latin, F.split(text, CUT)).otherwise(F.split(text, LATIN_CUT))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, h, n): hashes and bytes of each document's lines; ``twin``: 0, or the text's hash where texts share an id."""
    # A line that ends with a blank alone is trimmed in less time.
    trimmed = lambda x: F.when(x.endswith("\n"), F.btrim(x, F.lit(BLANKS))).otherwise(F.rtrim(x))
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("digest"), lines_of(F.col("text")).alias("v"))
    rows = rows.select("doc_id", "digest", F.transform("v", lambda x: F.xxhash64(trimmed(x))).alias("h"), F.transform("v", lambda x: F.octet_length(x)).alias("n"))
    made = materialize(rows).filter(F.size("h") >= RUN)
    shared = made.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id")
    if shared.isEmpty():
        return made.select("doc_id", F.lit(0).cast("long").alias("twin"), "h", "n")
    shared = materialize(shared.withColumn("some", F.lit(True)))
    named = made.join(shared, "doc_id", "left").select("doc_id", F.when(F.col("some"), F.col("digest")).otherwise(0).alias("twin"), "h", "n")
    return materialize(named.dropDuplicates(["doc_id", "twin"]))


def fingerprints(lines: DataFrame) -> DataFrame:
    """(doc_id, twin, fp, pos): the least of each W hashes of K = 2 lines in a row, the rightmost among equals, with its position."""
    n = F.size("h") - 1
    grams = F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    lines = lines.select("doc_id", "twin", grams.alias("g"))
    h = F.col("g")

    def reach(i: Column, before: bool, x: Column) -> Column:
        """How many neighbours in a row, W - 1 at most, leave x the choice."""
        n = F.lit(W - 1)
        for j in range(W - 1, 0, -1):
            n = F.when(F.get(h, i - j) >= x if before else F.get(h, i + j) > x, n).otherwise(F.lit(j - 1))
        return n

    chosen = lambda x, i: F.when(reach(i, True, x) + reach(i, False, x) >= W - 1, F.struct(i.alias("pos"), x.alias("fp")))
    return lines.select("doc_id", "twin", F.inline(F.array_compact(F.transform("g", chosen))))


def runs(lines: DataFrame) -> DataFrame:
    """(run, doc_id, twin, pos, n): hash, place and number of lines of each run that holds a fingerprint which occurs again."""
    found = fingerprints(lines)
    again = found.groupBy("fp").agg(F.count("*").alias("times")).filter("times > 1").select("fp")
    hits = found.join(again.hint("shuffle_hash"), "fp").groupBy("doc_id", "twin").agg(F.collect_list("pos").alias("hits"))
    last = F.size("h") - RUN
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(F.greatest(F.lit(0), p - W + 1), F.least(p, last)))))
    some = lambda n, i: F.xxhash64(F.lit(n), *(F.get("h", i + j) for j in range(n)))
    enough = lambda i: sum((F.get("bytes", i + j) for j in range(1, RUN)), F.get("bytes", i)) >= LEAST

    def run(i: Column) -> Column:
        return F.when(enough(i), F.struct(some(RUN, i).alias("run"), i.alias("pos"), F.lit(RUN).alias("n"))).when(
            i + MANY <= F.size("h"), F.struct(some(MANY, i).alias("run"), i.alias("pos"), F.lit(MANY).alias("n"))
        )

    return hits.join(lines.withColumnRenamed("n", "bytes"), ["doc_id", "twin"]).select("doc_id", "twin", F.inline(F.array_compact(F.transform(starts, run)))).select("run", "doc_id", "twin", "pos", "n")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, removed): positions of the lines to delete, for documents that have any."""
    found = materialize(runs(line_table(docs)))
    place = F.struct("doc_id", "twin", "pos")
    first = found.groupBy("run").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1").select("run", "first")
    later = found.join(first.hint("shuffle_hash"), "run").filter(place > F.col("first"))
    spans = later.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    lines = F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))
    return spans.select("doc_id", "twin", F.array_sort(F.array_distinct(lines)).alias("removed"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with its later repeated runs of lines deleted from ``text``; adds _removed: their positions, null where there are none."""
    gone = result_of(lambda: removed_lines(docs)).alias("gone")
    same = (F.col("own.doc_id") == F.col("gone.doc_id")) & ((F.col("gone.twin") == 0) | (F.col("gone.twin") == F.xxhash64("own.text")))
    removed = F.col("gone.removed")

    def rest(v: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(v) - 1), removed)
        return F.array_join(F.transform(kept, lambda i: F.get(v, i)), "")

    text = F.when(removed.isNull(), F.col("own.text")).otherwise(_let(lines_of(F.col("own.text")), rest))
    rows = docs.alias("own").join(gone.hint("shuffle_hash"), same, "left")
    return rows.select(*(text.alias("text") if c == "text" else F.col(f"own.`{c}`") for c in docs.columns if c != "_removed"), removed.alias("_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce(F.col("_removed"), F.array().cast("array<int>"))
    return kept.select(
        "doc_id",
        "text",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.size(removed).cast("long").alias("n_removed"),
        F.array_join(removed.cast("array<string>"), ",").alias("removed"),
    )
