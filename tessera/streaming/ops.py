"""Structured Streaming operators (ST1-ST8).

Every stream reads files with an explicit schema and keeps its checkpoint
and output under the shared checkpoint folder (``spark.checkpoint.dir``), so
a restarted driver or a lost executor resumes from the last committed batch.

* ST1 arrivals: ``foreachBatch`` checks each micro-batch's keys against the key
  store of *earlier* batches (``operators.keystore``: only buckets whose Bloom filter
  may hold a key are read) and writes its new keys to its own ``batch_id=`` folder
  with overwrite, so a replayed batch rewrites the same result (exactly-once output).
* ST2 / ST8 windowed counts: event-time windows with a watermark, update
  mode: every batch writes the windows it changed; late rows behind the
  watermark are dropped (ST9, documented per query).
* ST3 EMA, ST4 breaker: ``foreachBatch`` with the chunked batch operators and a
  state table per batch, so the Arrow batch size does not matter; chunks have a
  bounded number of rows. ``segments`` holds their forms in event order.
* ST6 replica states: ``foreachBatch`` with the last events of every copy, merged
  with those of the batches before.
* ST5 signal routing: stream-static join with the (small) handler table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import keystore
from tessera.session import checkpoint_dir

EVENTS_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                 "value double, props string")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:10]}"


def is_directory(spark: SparkSession, path: str) -> bool:
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jp.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jp) and fs.getFileStatus(jp).isDirectory())


def read_events_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet",
                       schema: str = EVENTS_SCHEMA, max_files: int | None = None) -> DataFrame:
    """File stream of events; ``ts`` becomes TIMESTAMP (UTC session) because
    watermarks need it."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_parquet(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append",
                   available_now: bool = True, processing_time: str | None = None):
    """Run a stream into a Parquet folder; returns (query, output path)."""
    out, ck = scratch(spark, name), scratch(spark, name + "-ck")
    w = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "60 seconds")
    q = w.start(out)
    if available_now:
        q.awaitTermination()
    return q, out


# ---------------------------------------------------------------- ST1
def arrivals(spark: SparkSession, stream: DataFrame, key: str, ts: str = "ts",
             state: str | None = None, checkpoint: str | None = None) -> str:
    """ST1: keys never seen before, with the batch that first saw them.
    Returns the key-table folder (partitioned by ``batch_id``). Give both
    folders to resume a stopped run: each key is then new once over all runs.
    A NULL key is a key like any other. The key store lies beside the folder
    (``<state>-keys``)."""
    state = state or scratch(spark, "arrivals")
    ck = checkpoint or scratch(spark, "arrivals-ck")
    store = f"{state.rstrip('/')}-keys"

    def process(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        checkpoint_dir(s)
        keys = batch.groupBy(key).agg(F.min(ts).alias("first_ts")).checkpoint()
        if not keystore.runs(s, store) and is_directory(s, state):  # a folder from before the store
            old = s.read.schema(keys.schema.add("batch_id", "long")).parquet(state)
            earlier = old.where(F.col("batch_id") < batch_id).select(key).distinct()
            keystore.add(s, store, earlier, key, batch_id - 1)
        out = f"{state}/batch_id={batch_id}"
        keystore.unseen(s, store, keys, key, before=batch_id).write.mode("overwrite").parquet(out)
        keystore.add(s, store, s.read.schema(keys.schema).parquet(out), key, batch_id)

    q = (stream.writeStream.foreachBatch(process).option("checkpointLocation", ck)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return state


# ---------------------------------------------------------------- ST2 / ST8
def window_counts(stream: DataFrame, key: str, ts: str = "ts", size: str = "1 hour",
                  slide: str | None = None, watermark: str = "1 hour", value: str | None = None) -> DataFrame:
    """ST2 / ST8: accesses per key and event-time window (tumbling, or
    sliding with ``slide``). In append mode a window is emitted once the
    watermark passes it; ``window_feed`` gives all windows at any time."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias("total"))
    return (stream.withWatermark(ts, watermark).groupBy(win.alias("w"), key).agg(*aggs)
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, *[
                      a for a in ["n"] + (["total"] if value else [])]))


def window_feed(spark: SparkSession, windows: DataFrame, out: str | None = None, checkpoint: str | None = None) -> str:
    """ST2 / ST8: run ``window_counts`` in update mode; give both folders to resume.

    Every micro-batch writes the windows it changed, with all they hold so far, to
    its own ``batch_id=`` folder with overwrite, so no window waits for the
    watermark. ``newest_windows`` reads the state of all windows."""
    out = out or scratch(spark, "windows")
    ck = checkpoint or scratch(spark, "windows-ck")

    def process(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (windows.writeStream.outputMode("update").foreachBatch(process).option("checkpointLocation", ck)
                .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def newest_windows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last written row of every window of ``window_feed``."""
    rows, of = spark.read.parquet(path), ["window_start", "window_end", key]
    values = [c for c in rows.columns if c not in (*of, "batch_id")]
    return rows.groupBy(*of).agg(F.max_by(F.struct(*values), "batch_id").alias("x")).select(*of, "x.*")


# ---------------------------------------------------------------- ST3
def ema_feed(spark: SparkSession, stream: DataFrame, key: str, value: str, alpha: float = 0.1, ts: str = "ts",
             tie: str = "event_id", out: str | None = None, checkpoint: str | None = None) -> str:
    """ST3: EMA per key after every micro-batch; give both folders to resume.

    A batch of m events moves a key from ``ema`` to (1-a)^m * ema + the batch's
    own EMA from 0 (in chunks of bounded rows). Events count in (ts, tie) order
    inside a batch and in arrival order across batches; ``segments.ema_segments_feed``
    keeps event order across batches too. Every
    batch writes the state of all keys to its own ``batch_id=`` folder with
    overwrite and reads its predecessor's only, so a replay gives the same rows.
    A NULL value adds nothing but ages the others; a NULL key is a key.
    """
    from tessera.operators.state import ema_per_key

    out = out or scratch(spark, "ema")
    ck = checkpoint or scratch(spark, "ema-ck")
    rows = stream.select(F.col(key).cast("string").alias(key), value, ts, tie)

    def process(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        own = ema_per_key(batch, key, ts, tie, value, alpha)
        last = batch.groupBy(F.col(key).alias("_k")).agg(F.max(ts).alias("last_ts"))
        new = own.join(last, F.col(key).eqNullSafe(F.col("_k"))).select(
            key, F.coalesce("ema", F.lit(0.0)).alias("ema"), "events", "last_ts")
        before = f"{out}/batch_id={batch_id - 1}"
        if is_directory(s, before):
            old = s.read.schema(new.schema).parquet(before).select(*[F.col(c).alias(f"_{c}") for c in new.columns])
            age = F.pow(F.lit(1.0 - alpha), F.coalesce("events", F.lit(0)).cast("double"))
            new = new.join(
                old, F.col(key).eqNullSafe(F.col(f"_{key}")), "full").select(
                F.coalesce(key, f"_{key}").alias(key),
                (F.coalesce("ema", F.lit(0.0)) + age * F.coalesce("_ema", F.lit(0.0))).alias("ema"),
                (F.coalesce("events", F.lit(0)) + F.coalesce("_events", F.lit(0))).cast("long").alias("events"),
                F.greatest("last_ts", "_last_ts").alias("last_ts"))
        new.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (rows.writeStream.foreachBatch(process).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


# ---------------------------------------------------------------- ST4
def breaker_feed(spark: SparkSession, stream: DataFrame, key: str, failed_col: str, ts: str = "ts",
                 tie: str = "event_id", max_failures: int = 3, reset_seconds: int = 300,
                 out: str | None = None, checkpoint: str | None = None) -> str:
    """ST4: circuit breaker per key; one output row per event with the state a
    caller saw before it and the state after it, under ``{out}/events``. Give both
    folders to resume.

    Every micro-batch runs the chunked batch operator on from the state table of
    its predecessor, in chunks of bounded rows. Events count in (ts, tie) order inside a
    batch and in arrival order across batches (``segments.breaker_segments_feed`` keeps
    event order across batches too).
    Rows and states of a batch go to folders of their own with overwrite, so a
    replay gives the same rows. A NULL key is a key.
    """
    from tessera.operators.state import breaker_states

    out = out or scratch(spark, "breaker")
    ck = checkpoint or scratch(spark, "breaker-ck")
    rows = stream.select(key, ts, tie, F.col(failed_col).alias("failed"))

    def process(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        old = None
        before, here = f"{out}/state/batch_id={batch_id - 1}", f"{out}/events/batch_id={batch_id}"
        if is_directory(s, before):
            old = s.read.schema(batch.select(F.col(key).alias("carry_key"), F.lit(0).cast("long").alias("carry_failures"),
                                             F.col(ts).alias("carry_ts")).schema).parquet(before)
        done = breaker_states(batch, key, ts, tie, F.col("failed"), max_failures, reset_seconds, carry=old)
        done.write.mode("overwrite").parquet(here)
        last = s.read.schema(done.schema).parquet(here).groupBy(F.col(key).alias("carry_key")).agg(
            F.max_by(F.struct("failures", ts), F.struct(ts, tie)).alias("x")).select(
            "carry_key", F.col("x.failures").alias("carry_failures"), F.col("x")[ts].alias("carry_ts"))
        if old is not None:
            gone = last.select(F.col("carry_key").alias("_k"))
            last = last.unionByName(old.join(gone, F.col("carry_key").eqNullSafe(F.col("_k")), "left_anti"))
        last.write.mode("overwrite").parquet(f"{out}/state/batch_id={batch_id}")

    q = (rows.writeStream.foreachBatch(process).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/events"


# ---------------------------------------------------------------- ST5
def route_signals(stream: DataFrame, handlers: DataFrame, target: str = "target",
                  component: str = "component") -> DataFrame:
    """ST5: stream-static join: each signal to its handler, '*' to all."""
    from tessera.operators.catalog import signal_fanout

    return signal_fanout(stream, handlers, target, component)


# ---------------------------------------------------------------- ST7
def periodic(stream: DataFrame, fn, spark: SparkSession, name: str, every: str = "60 seconds",
             available_now: bool = False):
    """ST7: run ``fn(batch_df, batch_id)`` on a timer (``availableNow`` in
    tests). The batch function does the reconciliation / merge work."""
    ck = scratch(spark, name + "-ck")
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)
    return w.start()


# ---------------------------------------------------------------- ST6
def coherency_feed(spark: SparkSession, stream: DataFrame, block: str = "block", source: str = "source",
                   action: str = "action", ts: str = "ts", tie: str = "event_id",
                   out: str | None = None, checkpoint: str | None = None) -> str:
    """ST6: replica state per copy after every micro-batch, by the rules of the
    batch ``state.coherency_state``; give both folders to resume.

    Events count in (ts, tie) order over all batches, so the states equal the
    batch fold however the rows are dealt to files and batches. Every batch writes
    the last events of all copies to its own ``facts/batch_id=`` folder and its
    updates to ``updates/batch_id=``, with overwrite, and reads those of earlier
    batches only, so a replay gives the same rows. Earlier updates are read again
    only for copies whose register came later than updates that follow it.
    ``newest_copies`` reads the states.
    """
    from tessera.operators import state

    checkpoint_dir(spark)
    out = out or scratch(spark, "coherency")
    ck = checkpoint or scratch(spark, "coherency-ck")
    rows = stream.select(block, source, action, ts, tie)
    of = [block, source]

    def process(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        log, before, here = f"{out}/updates", f"{out}/facts/batch_id={batch_id - 1}", f"{out}/facts/batch_id={batch_id}"
        updates = state.update_events(batch, block, source, ts, tie, action)
        updates.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        count = s.read.schema(updates.schema).parquet(f"{log}/batch_id={batch_id}")
        facts = state.copy_facts(batch, block, source, ts, tie, action)
        kept = facts.select(*of, F.lit(0).cast("long").alias("_kept"))
        if is_directory(s, before):
            old = s.read.schema(facts.schema.add("updates", "long")).parquet(before)
            facts = state.merge_facts(facts.unionByName(old.drop("updates")), block, source).checkpoint()
            both = facts.join(old.select(*of, "updates", F.col("last_register").alias("_r"),
                                         F.col("last_update").alias("_u")), of)
            same = F.col("_r").eqNullSafe(F.col("last_register"))
            kept = both.select(*of, F.when(same, F.col("updates")).otherwise(F.lit(0)).alias("_kept"))
            late = both.filter(~same & (F.col("_u") > F.col("last_register"))).select(*of)
            if not late.isEmpty():
                earlier = s.read.schema(updates.schema.add("batch_id", "long")).parquet(log).filter(
                    F.col("batch_id") < batch_id).drop("batch_id")
                count = count.unionByName(earlier.join(late, of, "left_semi"))
        n = state.updates_after(count, facts, block, source)
        new = facts.join(n, of, "left").join(kept, of, "left").withColumn(
            "updates", F.coalesce("_n", F.lit(0)) + F.coalesce("_kept", F.lit(0))).drop("_n", "_kept")
        new.write.mode("overwrite").parquet(here)

    q = (rows.writeStream.foreachBatch(process).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/facts"


def newest_copies(spark: SparkSession, path: str, block: str = "block", source: str = "source") -> DataFrame:
    """State, version and time of every copy after the last batch of ``coherency_feed``."""
    from tessera.operators import state

    facts = spark.read.parquet(path)
    last = facts.agg(F.max("batch_id")).scalar()
    return state.copy_states(facts.filter(F.col("batch_id") == last).drop("batch_id"), block, source)


# ---------------------------------------------------------------- ST7 (reconcile)
def reconcile_feed(spark: SparkSession, changes: DataFrame, master: DataFrame, key: str,
                   compare_cols: list[str], every: str | None = None) -> str:
    """ST7: reconcile each micro-batch of contributor changes with the master.

    ``changes`` is a stream of contributor rows (with ``source``); each batch
    is joined with the static master and its statuses (IN_SYNC / STALE /
    EXTRA) are written to the batch's own ``batch_id=`` folder with overwrite,
    so a replayed batch rewrites the same result. MISSING keys are what no batch
    held: ``catalog.missing_rows`` of the master and the output folder.
    ``every`` = processing-time trigger ('60 seconds' in the
    original); None runs what is available and stops (tests).
    Returns the output folder.
    """
    from tessera.operators.catalog import statuses

    out, ck = scratch(spark, "reconcile-feed"), scratch(spark, "reconcile-feed-ck")

    def process(batch: DataFrame, batch_id: int):
        res = statuses(batch, master, key, compare_cols)
        res.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = changes.writeStream.foreachBatch(process).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)
    q = w.start()
    if every is None:
        q.awaitTermination()
    return out
