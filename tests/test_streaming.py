import pytest
from pyspark.sql import functions as F

from wherry.streaming import events as ev


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture()
def stream(spark, tmp_path):
    def make(rows, schema, name="in"):
        folder = f"{tmp_path}/{name}"
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(folder)
        return spark.readStream.schema(df.schema).parquet(folder)

    return make


def test_windowed_counts_equal_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(f"{tmp_path}/e")
    live = drain(ev.windowed_counts(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/e")), "w_counts", "complete")
    assert live.agg(F.sum("n")).first()[0] == src.count()
    assert sorted(map(tuple, live.select("start", "event_type", "n").collect())) == sorted(map(tuple, ev.windowed_counts(src).select("start", "event_type", "n").collect()))


def test_ring(stream):
    rows = [("s", 1, "retrieval", "a"), ("s", 2, "retrieval", "b"), ("s", 3, "retrieval", "c"), ("s", 4, "label", "a"), ("s", 5, "label", "c"), ("s", 6, "label", "c")]
    got = drain(ev.pending_ring(stream(rows, "session string, seq long, kind string, request_id string"), size=2), "ring").collect()
    assert [(r["request_id"], r["matched"]) for r in got] == [("a", False), ("c", True), ("c", False)]


def test_gate(stream):
    rows = [("s", i, "search") for i in range(1, 6)] + [("t", 1, "search"), ("t", 2, "answer"), ("t", 3, "search")]
    got = {(r["session"], r["seq"]): r["blocked"] for r in drain(ev.search_gate(stream(rows, "session string, seq long, kind string")), "gate").collect()}
    assert got == {("s", 1): True, ("s", 2): True, ("s", 3): True, ("s", 4): False, ("s", 5): False, ("t", 1): True, ("t", 3): False}


def test_compaction(stream):
    rows = [("s", i) for i in range(1, 7)]
    got = {r["seq"]: r["full_bodies"] for r in drain(ev.session_compaction(stream(rows, "session string, seq long")), "compact").collect()}
    assert [got[i] for i in range(1, 7)] == [6, 6, 6, 6, 1, 1]


def test_interval_join(stream):
    n = stream([("u", 1_000_000), ("u", 1_005_000)], "user_id string, s long", "n").select("user_id", F.timestamp_seconds("s").alias("ts"))
    s = stream([("u", 1_000_300), ("v", 1_000_010)], "user_id string, s long", "s").select("user_id", F.timestamp_seconds("s").alias("ts"))
    got = drain(ev.attribute_stream(n, s, "10 minutes"), "attr").collect()
    assert [(r["nudge_ts"].timestamp(), r["served_ts"].timestamp()) for r in got] == [(1_000_000, 1_000_300)]


def test_file_changes(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    q = ev.run_changes(ev.watch_files(spark, f"{tmp_path}/in", "id long"), lambda df, epoch: seen.append(df.count()), f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert sum(seen) == 5


def test_order_over_chunks(stream, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [("s", i, "answer" if i == 2 else "search") for i in (5, 4, 3, 2, 1)]
        got = {r["seq"]: r["blocked"] for r in drain(ev.search_gate(stream(rows, "session string, seq long, kind string")), "chunks").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: True, 3: False, 4: False, 5: False}


def test_labels_are_consumed_once(stream):
    times = lambda df, c: df.withColumn(c, F.timestamp_seconds("s")).drop("s")
    r = times(stream([("a", 1_000_000), ("b", 1_000_000), ("z", 1_100_000)], "request_id string, s long", "r"), "ts")
    m = times(stream([("a", 1_000_060), ("a", 1_000_120), ("z2", 1_100_000)], "request_id string, s long", "m"), "label_ts")
    got = drain(ev.label_join(r, m), "labels").collect()
    assert sum(x["request_id"] == "a" for x in got) == 1


def test_cursors():
    c = ev.CursorCache(2)
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert (c.get("a"), c.get("b"), c.get("c")) == (1, None, 3)


def test_rotation_and_retention(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        spark.range(3).write.json(f"{root}/day={day}")
    assert ev.expire_log(spark, root, "2024-01-02") == 1 and spark.read.json(root).select("day").distinct().count() == 2
    assert not ev.rotate_log(spark, root) and ev.rotate_log(spark, root, 10) and not (tmp_path / "log").exists()
    spark.range(1).write.json(root)
    assert ev.rotate_log(spark, root, 1) and spark.read.json(root + ".1").count() == 1
