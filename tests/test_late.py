"""Rows behind the watermark are kept, counted and merged into the written windows."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.session import scratch_path
from tessera.streaming import late, ops

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


#: three files; the last one holds rows of windows closed long ago, each of a window and key of its own
FILES = [[(i, at(i / 4), 1, "k%d" % (i % 2), float(i), "{}") for i in range(40)],
         [(100 + i, at(30 + i / 2), 1, "k0", 1.0, "{}") for i in range(10)] + [(150, None, 1, "k0", 1.0, "{}")],
         [(200, at(50), 1, None, 2.0, "{}")],
         [(300 + i, at(i), 1, "late", None if i == 2 else 5.0, "{}") for i in range(6)] + [(320, at(49.9), 1, "k1", 1.0, "{}")]]


def run(spark, files, name, start=0, base=None):
    base = base or scratch_path(spark, name)
    for rows in files:
        spark.createDataFrame(rows, ops.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = ops.read_events_stream(spark, f"{base}/in", glob="*.parquet", max_files=1)
        late.late_window_feed(spark, stream, "event_type", value="value", out=f"{base}/out", checkpoint=f"{base}/ck")
    return base


def batch_windows(spark, files):
    rows = spark.createDataFrame([r for f in files for r in f], ops.EVENTS_SCHEMA).where("ts IS NOT NULL")
    return rows.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def test_late_files_are_merged_in(spark):
    base = run(spark, FILES, "late")
    side = late.late_rows(spark, f"{base}/out").collect()
    assert sorted(r.event_id for r in side) == [300, 301, 302, 303, 304, 305]  # 320 is behind, its window still open
    assert all(r.batch_id == 3 and r.behind_seconds > 40 * 3600 for r in side)
    want = sorted(map(repr, map(tuple, batch_windows(spark, FILES).collect())))
    assert sorted(map(repr, map(tuple, late.corrected(spark, f"{base}/out", "event_type", "value").collect()))) == want
    seen = late.windows(spark, f"{base}/out", "event_type").where("event_type = 'late'").count()
    assert seen == 0
    # the built-in aggregate drops as many rows as the side table holds
    stream = ops.read_events_stream(spark, f"{base}/in", glob="*.parquet", max_files=1)
    q = (ops.window_counts(stream, "event_type").writeStream.outputMode("update").format("noop")
         .option("checkpointLocation", f"{base}/ck2").trigger(availableNow=True).start())
    q.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    assert dropped == len(side)


def test_any_order_and_no_rows(spark):
    want = sorted(map(repr, map(tuple, batch_windows(spark, FILES).collect())))
    base = run(spark, FILES[::-1], "late-reverse")
    assert late.late_rows(spark, f"{base}/out").count() > 20
    assert sorted(map(repr, map(tuple, late.corrected(spark, f"{base}/out", "event_type", "value").collect()))) == want
    empty = run(spark, [[]], "late-none")
    assert not ops.is_directory(spark, f"{empty}/out/counts") or late.corrected(spark, f"{empty}/out", "event_type").count() == 0
