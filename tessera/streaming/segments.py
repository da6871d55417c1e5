"""Stateful streams in event order, whatever the order of arrival (ST3, ST4).

The history of a key is cut into time segments. A segment's summary can be joined
with that of the next one, so the state of a key is a fold over summaries and a late
row changes its own segment only:

* average: (events, value) with value the segment's average from 0; the key's average is
  the sum of value * (1 - a)^(events in later segments);
* breaker: (events, run of failures at the end, whether any event succeeded, last time); the
  run of failures that enters a segment is the run at the end of the last segment
  with a success plus the lengths of the all-failed ones since.

Every micro-batch appends its rows to a log partitioned by segment, reads back the
segments it touched (the log of those segments only), and writes their new
summaries, and for the breaker their rows with what is known inside the segment, to its own
``batch_id=`` folders with overwrite. A replayed batch rewrites the same files. The newest
batch of a segment counts; ``ema_state`` and ``breaker_events`` fold the summaries when
they are read. Any order of files and any number of batches equals the batch operators.

Rows of a hot segment are spread by the data-sized chunks of ``ordered``. A NULL key is a
key, a NULL time sorts before all others, and a NULL value adds nothing but ages the others.
``(ts, tie)`` must tell the rows of a key apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ordered
from tessera.operators.state import (BREAKER_MAX_FAILURES, BREAKER_RESET_SECONDS, CLOSED, EMA_ALPHA, HALF_OPEN, OPEN)
from tessera.streaming.ops import scratch

SEGMENT_SECONDS = 86_400
#: a batch that touches more time segments reads the whole log instead of chosen folders
MAX_FOLDERS = 10_000
BEFORE_ALL = -(2 ** 40)


def _same(a, b):
    return F.col(a).eqNullSafe(F.col(b))


def _feed(spark: SparkSession, rows: DataFrame, key: str, ts: str, write, seconds: int, out: str, ck: str) -> str:
    def process(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        new = batch.withColumn("segment", F.coalesce(ordered.time_bucket(ts, seconds), F.lit(BEFORE_ALL)))
        here = f"{out}/log/batch_id={batch_id}"
        new.write.mode("overwrite").partitionBy("segment").parquet(here)
        new = s.read.schema(new.schema).parquet(here)
        touched = new.select(F.col(key).alias("_key"), F.col("segment").alias("_segment")).distinct()
        some = [r[0] for r in touched.select("_segment").distinct().limit(MAX_FOLDERS + 1).collect()]
        log = s.read.schema(new.schema.add("batch_id", "long")).parquet(f"{out}/log").where(F.col("batch_id") <= batch_id)
        if len(some) <= MAX_FOLDERS:
            log = log.where(F.col("segment").isin(some))
        write(log.drop("batch_id").join(touched, _same(key, "_key") & (F.col("segment") == F.col("_segment")), "left_semi"),
              f"batch_id={batch_id}")

    (rows.writeStream.foreachBatch(process).option("checkpointLocation", ck)
     .trigger(availableNow=True).start().awaitTermination())
    return out


def _current(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The newest summary of every segment."""
    every = spark.read.parquet(f"{out}/segments")
    rest = [c for c in every.columns if c not in (key, "segment")]
    return every.groupBy(key, "segment").agg(F.max_by(F.struct(*rest), "batch_id").alias("x")).select(key, "segment", "x.*")


# ---------------------------------------------------------------- ST3
def ema_segments_feed(spark: SparkSession, stream: DataFrame, key: str, value: str, alpha: float = EMA_ALPHA, ts: str = "ts",
                      tie: str = "event_id", seconds: int = SEGMENT_SECONDS, out: str | None = None,
                      checkpoint: str | None = None) -> str:
    """Run the stream into segment summaries; give both folders to resume. Read with ``ema_state``."""
    out, ck = out or scratch(spark, "ema-segments"), checkpoint or scratch(spark, "ema-segments-ck")

    def write(rows: DataFrame, folder: str):
        numbered = ordered.row_numbers(rows, [key, "segment"], [F.col(ts), F.col(tie)],
                                       -ordered.time_bucket(ts, seconds), "_k", descending=True)
        weight = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), (F.col("_k") - 1).cast("double"))
        (numbered.groupBy(key, "segment")
         .agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(weight * F.col(value)), F.lit(0.0)).alias("value"),
              F.max(ts).alias("last_ts")).write.mode("overwrite").parquet(f"{out}/segments/{folder}"))

    return _feed(spark, stream.select(key, value, ts, tie), key, ts, write, seconds, out, ck)


def ema_state(spark: SparkSession, out: str, key: str, alpha: float = EMA_ALPHA) -> DataFrame:
    """(key, events, ema, last_ts) after all batches so far."""
    later = ordered.running_agg(_current(spark, out, key), [key], [F.col("segment")], F.col("events"), "later",
                                -F.col("segment"), "sum", inclusive=False, descending=True)
    aged = F.col("value") * F.pow(F.lit(1.0 - alpha), F.coalesce("later", F.lit(0)).cast("double"))
    return later.groupBy(key).agg(F.sum("events").alias("events"), F.sum(aged).alias("ema"), F.max("last_ts").alias("last_ts"))


# ---------------------------------------------------------------- ST4
def breaker_segments_feed(spark: SparkSession, stream: DataFrame, key: str, failed_col: str, ts: str = "ts",
                          tie: str = "event_id", seconds: int = SEGMENT_SECONDS, out: str | None = None,
                          checkpoint: str | None = None) -> str:
    """Run the stream into segment summaries and rows; give both folders to resume. Read with ``breaker_events``."""
    out, ck = out or scratch(spark, "breaker-segments"), checkpoint or scratch(spark, "breaker-segments-ck")

    def write(rows: DataFrame, folder: str):
        order, bucket = [F.col(ts), F.col(tie)], ordered.time_bucket(ts, seconds)
        numbered = ordered.row_numbers(rows, [key, "segment"], order, bucket, "rn")
        seen = ordered.running_aggs(numbered, [key, "segment"], order,
                                    {"last_success": F.when(~F.col("failed"), F.col("rn")), "prev_ts": F.col(ts)},
                                    bucket, agg="max", inclusive=False)
        seen.write.mode("overwrite").parquet(f"{out}/rows/{folder}")
        done = spark.read.schema(seen.schema).parquet(f"{out}/rows/{folder}")
        (done.groupBy(key, "segment")
         .agg(F.count(F.lit(1)).alias("events"), F.max(F.when(~F.col("failed"), F.col("rn"))).alias("last_success"),
              F.max(ts).alias("last_ts")).write.mode("overwrite").parquet(f"{out}/segments/{folder}"))

    return _feed(spark, stream.select(key, ts, tie, F.col(failed_col).alias("failed")), key, ts, write, seconds, out, ck)


def breaker_events(spark: SparkSession, out: str, key: str, ts: str = "ts", tie: str = "event_id",
                   max_failures: int = BREAKER_MAX_FAILURES, reset_seconds: int = BREAKER_RESET_SECONDS) -> DataFrame:
    """Every event so far with the state a caller saw before it and the state after it, as
    ``state.breaker_states`` gives them for the same events."""
    now = _current(spark, out, key)
    order, bucket = [F.col("segment")], F.col("segment")
    placed = ordered.running_agg(now, [key], order, F.col("events"), "first", bucket, "sum", inclusive=False)
    first = F.coalesce("first", F.lit(0))
    carried = ordered.running_aggs(placed, [key], order, {"success_before": first + F.col("last_success"), "ts_before": F.col("last_ts")},
                                   bucket, agg="max", inclusive=False)
    carry = carried.select(
        F.col(key).alias("_key"), F.col("segment").alias("_segment"), F.col("batch_id").alias("_batch"),
        (first - F.coalesce("success_before", F.lit(0))).alias("run_in"), "ts_before")
    rows = spark.read.parquet(f"{out}/rows").join(
        carry, _same(key, "_key") & (F.col("segment") == F.col("_segment")) & (F.col("batch_id") == F.col("_batch")))
    before = (F.col("rn") - 1 - F.coalesce("last_success", F.lit(0))
              + F.when(F.col("last_success").isNull(), F.col("run_in")).otherwise(F.lit(0))).cast("long")
    prev = F.when(F.col("rn") == 1, F.col("ts_before")).otherwise(F.col("prev_ts"))

    def micros(c):
        return F.unix_micros(c.cast("timestamp"))
    rows = rows.withColumn("_before", before).withColumn("_secs", (micros(F.col(ts)) - micros(prev)) / F.lit(1_000_000))
    state_before = F.when(F.col("_before") >= max_failures, F.when(F.col("_secs") > reset_seconds, F.lit(HALF_OPEN))
                          .otherwise(F.lit(OPEN))).otherwise(F.lit(CLOSED))
    failures = F.when(F.col("failed"), F.col("_before") + 1).otherwise(F.lit(0)).cast("long")
    return rows.select(key, tie, ts, "failed", state_before.alias("state_before"), failures.alias("failures"),
                       F.when(failures >= max_failures, F.lit(OPEN)).otherwise(F.lit(CLOSED)).alias("state_after"))
