"""Streams in any order of arrival equal the batch operators."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, state
from tessera.session import scratch_path
from tessera.streaming import ops, segments


@pytest.fixture(scope="module")
def events(spark):
    i = F.col("id")
    return spark.range(3000).select(
        i.alias("event_id"), F.timestamp_seconds(F.floor(i / 3) * 400 + 1_700_000_000).cast("timestamp_ntz").alias("ts"),
        F.lit(1).cast("long").alias("user_id"),
        F.when(i % 7 == 0, F.lit(None)).when(i % 5 == 0, F.lit("b")).otherwise(F.lit("hot")).alias("event_type"),
        F.when(i % 11 > 0, (F.hash("id") % 100).cast("double")).alias("value"),
        F.when(F.pmod(F.hash(F.floor(i / 40)), F.lit(3)) > 0, F.lit("f")).otherwise(F.lit("{}")).alias("props"))


def feed(spark, events, run, order):
    """Three files, shuffled so that each spans all days, in the given order; two runs, the second resumes."""
    base = scratch_path(spark, "any-order")
    for n, k in enumerate(order):
        part = events.where(F.pmod(F.hash("event_id", F.lit(9)), F.lit(3)) == k)
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        if n:  # the first two files come in one run, file by file
            run(ops.read_events_stream(spark, f"{base}/in", glob="*.parquet", max_files=1), f"{base}/out", f"{base}/ck")
    return f"{base}/out"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_average(spark, events, order, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_CHUNK_ROWS", 100)
    out = feed(spark, events, lambda s, o, c: segments.ema_segments_feed(spark, s, "event_type", "value", out=o, checkpoint=c), order)
    assert len(set(r.batch_id for r in spark.read.parquet(f"{out}/segments").select("batch_id").distinct().collect())) == 3
    got = {r.event_type: r for r in segments.ema_state(spark, out, "event_type").collect()}
    want = {r.event_type: r for r in state.ema_per_key(events, "event_type", "ts", "event_id", "value").collect()}
    assert got.keys() == want.keys() == {"hot", "b", None}
    assert all(got[k].events == want[k].events and abs(got[k].ema - want[k].ema) < 1e-9 for k in want)


@pytest.mark.parametrize("order", [(1, 2, 0)])
def test_breaker(spark, events, order):
    ev = events.withColumn("failed", F.col("props") == "f")

    def run(s, o, c):
        segments.breaker_segments_feed(spark, s.withColumn("failed", F.col("props") == "f"), "event_type", "failed",
                                       out=o, checkpoint=c)
    out = feed(spark, events, run, order)
    got = segments.breaker_events(spark, out, "event_type").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = state.breaker_states(ev, "event_type", "ts", "event_id", F.col("failed"))
    a, b = (sorted(map(tuple, d.select(*want.columns).collect()), key=repr) for d in (got, want))
    assert a == b and {r[4] for r in a} == {"CLOSED", "OPEN", "HALF-OPEN"}
    # only touched segments are written again
    days = spark.read.parquet(f"{out}/segments").groupBy("batch_id").count().collect()
    assert len(days) == 3


def test_no_rows_yet(spark):
    base = scratch_path(spark, "none")
    spark.createDataFrame([], ops.EVENTS_SCHEMA).write.parquet(f"{base}/in")
    out = segments.ema_segments_feed(spark, ops.read_events_stream(spark, f"{base}/in", glob="*.parquet"), "event_type", "value")
    assert not ops.is_directory(spark, f"{out}/segments") or segments.ema_state(spark, out, "event_type").count() == 0
