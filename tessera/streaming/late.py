"""Windowed counts that keep what comes behind the watermark (ST9).

Structured Streaming drops rows of windows the watermark has closed and reports only
their number. Here every micro-batch is cut at its own watermark, the largest event time of all
earlier batches minus ``delay``:

* rows of open windows are counted per (window, key) and written as the batch's increments;
* rows of closed windows go to a side table with their window and how far they came behind;
* the batch's largest event time is written for its successor.

All three go to ``batch_id=`` folders with overwrite, so a replayed batch rewrites the same rows,
and no state grows with the history. ``windows`` is what a consumer saw when windows closed,
``corrected`` merges the late rows into it and equals the batch result in any order of arrival.

A row without a time has no window and is left out, as in a stream with a watermark; NULL keys are
keys; NULL values count as rows and add nothing to ``total``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.ops import is_directory, scratch


def late_window_feed(spark: SparkSession, stream: DataFrame, key: str, ts: str = "ts", size: str = "1 hour",
                     slide: str | None = None, delay: str = "1 hour", value: str | None = None,
                     out: str | None = None, checkpoint: str | None = None) -> str:
    """Run the stream; give both folders to resume. Returns the output folder."""
    out, ck = out or scratch(spark, "late-windows"), checkpoint or scratch(spark, "late-windows-ck")
    total = F.sum(F.col(value) if value else F.lit(None).cast("double")).alias("total")

    def process(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        top = None
        if is_directory(s, f"{out}/newest/batch_id={batch_id - 1}"):
            top = s.read.schema("newest timestamp").parquet(f"{out}/newest/batch_id={batch_id - 1}").first().newest
        mark = F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        win = F.window(ts, size, slide) if slide else F.window(ts, size)
        rows = (batch.where(F.col(ts).isNotNull()).withColumn("w", win)
                .withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w"))
        closed = F.coalesce(F.col("window_end") <= mark, F.lit(False))
        (rows.where(~closed).groupBy("window_start", "window_end", key).agg(F.count(F.lit(1)).alias("n"), total)
         .write.mode("overwrite").parquet(f"{out}/counts/batch_id={batch_id}"))
        behind = (F.unix_micros(mark) - F.unix_micros(F.col(ts).cast("timestamp"))) / F.lit(1_000_000)
        (rows.where(closed).withColumn("behind_seconds", behind)
         .write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}"))
        newest = batch.agg(F.max(F.col(ts).cast("timestamp")).alias("m")).select(
            F.greatest(F.col("m"), F.lit(top).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{out}/newest/batch_id={batch_id}")

    (stream.writeStream.foreachBatch(process).option("checkpointLocation", ck)
     .trigger(availableNow=True).start().awaitTermination())
    return out


def _add_up(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy("window_start", "window_end", key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def windows(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Windows from the rows that came in time."""
    return _add_up(spark.read.parquet(f"{out}/counts"), key)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows of closed windows, once per window they missed, with ``behind_seconds`` and ``batch_id``."""
    return spark.read.parquet(f"{out}/late")


def corrected(spark: SparkSession, out: str, key: str, value: str | None = None) -> DataFrame:
    """``windows`` with the late rows merged in."""
    total = F.sum(F.col(value) if value else F.lit(None).cast("double")).alias("total")
    late = late_rows(spark, out).groupBy("window_start", "window_end", key).agg(F.count(F.lit(1)).alias("n"), total)
    counts = spark.read.parquet(f"{out}/counts").drop("batch_id")
    return _add_up(counts.unionByName(late), key)
