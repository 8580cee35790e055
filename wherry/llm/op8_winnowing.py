"""Document fingerprints by winnowing, in DataFrame functions only.

Units are words: runs of letters and digits, lowered; each letter of a script without blanks is a unit. Each
unit is hashed once. The hash of ``K`` units in a row is a cyclic polynomial, the rolling hash whose step is
one rotation and two exclusive ors; as columns have no running state, the hashes of all K-grams are made from
those of their halves instead, which gives the same numbers in as few operations. Of each window of ``W``
hashes the least is selected, the rightmost among equals, and kept with its position. Two texts that share
W + K - 1 units in a row share a fingerprint. One rule holds for texts of every length.

The likeness of two fingerprints is the share of the larger one's hashes that the other has too; two empty
fingerprints are alike.

Documents are dealt by buckets of ``WIDTH`` ids once; the next document comes from a window in a bucket, and
from the table of the buckets' first documents at its end. No global sort is made.

Defined cases: null text counts as empty and has the empty fingerprint, like a text without letters and
digits; fewer than K units are one hash, fewer than W hashes one window; rows that repeat an id follow one
another by text; null ids come last; the only document follows itself; an empty table gives no rows; other
columns are ignored; ids are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wherry.llm.common import materialize, table
from wherry.llm.neighbours import WIDTH, lower_keys

K, W = 4, 6
#: Letters of scripts that put no blanks between words: Thai, Lao, Burmese, Khmer, Kana and Han.
UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
UNIT = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+|[\p{{L}}\p{{N}}&&[{UNSPACED}]]"
NO_ID = -(1 << 63)


def unit_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(UNIT), 0), lambda u: F.xxhash64(u))


def _turn(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def gram_hashes(units: str) -> Column:
    """Hashes of all K = 4 units in a row; a shorter sequence is one gram."""
    u = F.col(units)

    def pairs(x: Column, apart: int) -> Column:
        n = F.size(x) - apart
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + apart), n), lambda a, b: _turn(a, apart).bitwiseXOR(b))

    four = F.get(F.transform(F.array(pairs(u, 1)), lambda two: pairs(two, 2)), F.lit(0))
    few = F.array(F.aggregate(u, F.lit(0).cast("long"), lambda a, x: _turn(a, 1).bitwiseXOR(x)))
    return F.when(F.size(u) >= K, four).when(F.size(u) > 0, few).otherwise(F.array().cast("array<bigint>"))


def selected(grams: str) -> Column:
    """(h, p): hash and position of the least of each window of W hashes, the rightmost among equals."""
    g = F.col(grams)

    def reach(i: Column, before: bool, x: Column) -> Column:
        """How many neighbours in a row, W - 1 at most, leave x the choice."""
        n = F.lit(W - 1)
        for j in range(W - 1, 0, -1):
            fits = F.get(g, i - j) >= x if before else F.get(g, i + j) > x
            n = F.when(fits, n).otherwise(F.lit(j - 1))
        return n

    # x is chosen if a whole window lies within its reach.
    chosen = lambda x, i: reach(i, True, x) + reach(i, False, x) + 1 >= F.least(F.lit(W), F.size(g))
    return F.array_compact(F.transform(g, lambda x, i: F.when(chosen(x, i), F.struct(x.alias("h"), i.alias("p")))))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: selected hashes and positions of the text in a column."""
    # Step by step: each array is built once and read from by the next step.
    df = df.withColumn(out, unit_hashes(F.col(text)))
    df = df.withColumn(out, gram_hashes(out))
    return df.withColumn(out, selected(out))


def likeness(a: str, b: str) -> Column:
    """Likeness of two sets of hashes."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def shown(fingerprint: str) -> Column:
    """``hash@position`` of every selected hash, in order."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(x["h"])), F.lit("@"), x["p"].cast("string"))), " ")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    return with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "f").select("doc_id", shown("f").alias("fingerprint"))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"))
    rows = rows.withColumn("bucket", F.floor(F.col("key") / WIDTH).cast("long"))
    order = [F.desc("key"), F.xxhash64("text"), F.col("text")]

    heads = materialize(rows.groupBy("bucket").agg(F.max("key").alias("key")))
    lower = lower_keys(heads.select("bucket"), "bucket")
    top = heads.agg(F.max("bucket")).first()[0]
    first = rows.join(heads, ["bucket", "key"]).select("bucket", "key", "text").withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter("n = 1").select("bucket", "text")
    after = lower.select("bucket", F.coalesce("lower", F.lit(top)).alias("lower")).join(first.select(F.col("bucket").alias("lower"), F.col("text").alias("after_text")), "lower").select("bucket", "after_text")
    after = materialize(with_fingerprint(after, "after_text", "after"))

    # One exchange of the texts; the window, the join at the buckets' ends and all that follows keep it.
    dealt = with_fingerprint(rows.repartition("bucket"), "text", "own")
    w = Window.partitionBy("bucket").orderBy(*order)
    led = dealt.withColumns({"next_text": F.lead("text").over(w), "next": F.lead("own").over(w)}).join(after, "bucket", "left")
    led = led.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        "text",
        "own",
        F.coalesce("next_text", "after_text").alias("next_text"),
        F.when(F.col("next_text").isNull(), F.col("after")).otherwise(F.col("next")).alias("next"),
    )
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third))
    led = with_fingerprint(led.withColumn("edited", edited).drop("text", "next_text"), "edited", "new")
    return led.withColumns({f"{a}_set": F.array_distinct(F.col(f"{a}.h")) for a in ("own", "new", "next")}).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("own").alias("fingerprint"),
        shown("new").alias("edited_fingerprint"),
        likeness("own_set", "new_set").alias("near_edited"),
        likeness("own_set", "next_set").alias("near_next"),
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
