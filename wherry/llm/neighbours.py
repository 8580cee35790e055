"""The next row of a table by descending id, without a global sort or window.

Ids are cut into buckets of ``WIDTH`` values. Within a bucket the next row comes from a window, and
the last row of a bucket is followed by the first row of the next lower bucket that is not empty. The
buckets' order is found in the same way one level higher, until few enough are left for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherry.llm.common import materialize

#: Values of an id that one bucket spans: a bucket has that many distinct ids at most.
WIDTH = 64
#: Keys that one task may order; more are first cut into buckets.
ONE_TASK = 50_000


def lower_keys(keys: DataFrame, column: str) -> DataFrame:
    """(column, lower): each distinct key with the next lower one, null for the lowest."""
    if keys.count() <= ONE_TASK:
        return keys.select(column, F.lead(column).over(Window.orderBy(F.desc(column))).alias("lower"))
    up = keys.withColumn("_up", F.floor(F.col(column) / WIDTH).cast("long"))
    tops = materialize(up.groupBy("_up").agg(F.max(column).alias("_top")))
    below = lower_keys(tops.select("_up"), "_up").join(tops.withColumnRenamed("_up", "lower"), "lower").select("_up", F.col("_top").alias("_below"))
    inner = up.withColumn("_in", F.lead(column).over(Window.partitionBy("_up").orderBy(F.desc(column))))
    return inner.join(below, "_up", "left").select(column, F.coalesce("_in", "_below").alias("lower"))
