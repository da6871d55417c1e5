"""Streaming bindings: each runs its stream to completion (availableNow) on
the ``events`` file and returns the read-back result as a batch frame. The
batch twins are the batch operators; the oracles below are their SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.streaming import late, ops, segments
from tessera.plans.common import sig, sql_sig


def _events(spark, sf_dir):
    """The events table as a file stream: a single Parquet file is picked out
    of the table folder by name; a Parquet dataset folder is streamed whole."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    if ops.is_directory(spark, path):
        return ops.read_events_stream(spark, path, glob="*.parquet")
    return ops.read_events_stream(spark, sf_dir, glob="events.parquet")


def stream_arrivals(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("key", F.get_json_object("props", "$.k"))
    path = ops.arrivals(spark, ev, "key")
    return spark.read.parquet(path).select("key", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"))


def _windows(spark, sf_dir, **how):
    """All windows of the events, open ones too."""
    out = ops.window_feed(spark, ops.window_counts(_events(spark, sf_dir), "event_type", **how))
    return ops.newest_windows(spark, out, "event_type").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end")


def stream_window_counts(spark, sf_dir):
    return _windows(spark, sf_dir, size="1 hour", watermark="1 hour")


def stream_snapshots(spark, sf_dir):
    return _windows(spark, sf_dir, size="5 seconds", watermark="1 minute", value="value").withColumn(
        "total", sig("total"))


def stream_late_windows(spark, sf_dir):
    """Daily windows with the rows behind the watermark merged in."""
    out = late.late_window_feed(spark, _events(spark, sf_dir), "event_type", size="1 day", delay="1 hour", value="value")
    return late.corrected(spark, out, "event_type", "value").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", sig("total").alias("total"))


def stream_ema(spark, sf_dir):
    ev = _events(spark, sf_dir)
    res = spark.read.parquet(ops.ema_feed(spark, ev, "event_type", "value"))
    latest = res.groupBy("event_type").agg(F.max_by(F.struct("ema", "events"), "events").alias("s"))
    return latest.select("event_type", F.col("s.events").alias("events"), sig("s.ema").alias("ema"))


def stream_breaker(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    out = ops.breaker_feed(spark, ev, "user_id", "failed")
    return spark.read.parquet(out).drop("batch_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_ema_any_order(spark, sf_dir):
    """The average in event order: summaries of time segments, folded when read."""
    out = segments.ema_segments_feed(spark, _events(spark, sf_dir), "event_type", "value")
    return segments.ema_state(spark, out, "event_type").select("event_type", "events", sig("ema").alias("ema"))


def stream_breaker_any_order(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    out = segments.breaker_segments_feed(spark, ev, "user_id", "failed")
    return segments.breaker_events(spark, out, "user_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_signals(spark, sf_dir):
    ev = _events(spark, sf_dir)
    handlers = (spark.read.parquet(f"{sf_dir}/events.parquet")
                .select(F.concat("event_type", F.lit("_handler")).alias("component"))
                .filter(F.col("component") != "error_handler").distinct().withColumn("role", F.lit("AGENT")))
    sigs = ev.select("event_id", F.when(F.col("event_type") == "error", F.lit("*"))
                     .otherwise(F.concat("event_type", F.lit("_handler"))).alias("target"))
    _, out = ops.run_to_parquet(ops.route_signals(sigs, handlers), spark, "signals")
    return spark.read.parquet(out).select("event_id", "target", "component", "role")


def stream_sliding_counts(spark, sf_dir):
    return _windows(spark, sf_dir, size="1 day", slide="1 hour", watermark="1 hour")


def stream_coherency(spark, sf_dir):
    ev = _events(spark, sf_dir)
    action = (F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "view", "read")
               .when(F.col("event_type") == "click", "write").when(F.col("event_type") == "purchase", "update")
               .otherwise("sync"))
    src = ev.select(F.get_json_object("props", "$.k").alias("block"),
                    F.concat(F.lit("site_"), (F.col("user_id") % 3).cast("string")).alias("source"),
                    "ts", "event_id", action.alias("action"))
    res = ops.newest_copies(spark, ops.coherency_feed(spark, src))
    return res.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


PART_SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def stream_reconcile(spark, sf_dir):
    """ST7 on the catalog stand-in: contributor rows stream in (derived from
    part exactly as the batch binding derives them) and are reconciled with
    the master per micro-batch."""
    path = f"{sf_dir.rstrip('/')}/part.parquet"
    r = spark.readStream.schema(PART_SCHEMA)
    p = (r.option("pathGlobFilter", "*.parquet").parquet(path) if ops.is_directory(spark, path)
         else r.option("pathGlobFilter", "part.parquet").parquet(sf_dir))
    r1 = (p.filter(F.col("p_size") <= 40)
           .withColumn("p_retailprice", F.when(F.col("p_brand") == "Brand#3", F.col("p_retailprice") + 1.0)
                       .otherwise(F.col("p_retailprice"))).withColumn("source", F.lit("repo_1")))
    r2 = p.filter(F.col("p_type") != "ECONOMY").withColumn("source", F.lit("repo_2"))
    r2x = (p.filter(F.col("p_size") > 45).withColumn("p_partkey", F.col("p_partkey") + 1_000_000)
            .withColumn("source", F.lit("repo_2")))
    r3 = (p.withColumn("p_name", F.when(F.col("p_size") < 5, F.upper("p_name")).otherwise(F.col("p_name")))
           .withColumn("source", F.lit("repo_3")))
    changes = r1.unionByName(r2).unionByName(r2x).unionByName(r3)
    master = spark.read.parquet(path)
    cmp_cols = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    out = ops.reconcile_feed(spark, changes, master, "p_partkey", cmp_cols)
    found = spark.read.parquet(out).select("source", "p_partkey", "status")
    return found.unionByName(catalog.missing_rows(master, found, "p_partkey", ["repo_1", "repo_2", "repo_3"]))


QUERIES = {
    "stream_reconcile": stream_reconcile,
    "stream_sliding_counts": stream_sliding_counts, "stream_coherency": stream_coherency,
    "stream_arrivals": stream_arrivals, "stream_window_counts": stream_window_counts,
    "stream_snapshots": stream_snapshots, "stream_ema": stream_ema,
    "stream_late_windows": stream_late_windows,
    "stream_ema_any_order": stream_ema_any_order, "stream_breaker_any_order": stream_breaker_any_order,
    "stream_breaker": stream_breaker, "stream_signals": stream_signals,
}


ORACLE = {
    "stream_reconcile": __import__("tessera.plans.catalog_q", fromlist=["_RECON"])._RECON
        + "SELECT * FROM r",
    "stream_sliding_counts": """WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hs, event_type FROM events),
        w AS (SELECT hs - INTERVAL (k) HOUR AS window_start, event_type FROM h, range(0, 24) r(k))
        SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL""",
    "stream_coherency": __import__("tessera.plans.state_q", fromlist=["ORACLE"]).ORACLE["coherency_fold"],
    "stream_arrivals": """SELECT json_extract_string(props, '$.k') AS key, min(ts) AS first_ts FROM events GROUP BY 1""",
    "stream_window_counts": """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n
        FROM events GROUP BY ALL""",
    "stream_snapshots": f"""SELECT window_start, event_type, n, {sql_sig('total')} AS total FROM (
        SELECT time_bucket(INTERVAL 5 SECOND, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total
        FROM events GROUP BY ALL)""",
    "stream_late_windows": f"""SELECT window_start, event_type, n, {sql_sig('total')} AS total FROM (
        SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total
        FROM events GROUP BY ALL)""",
    "stream_ema_any_order": __import__("tessera.plans.state_q", fromlist=["ORACLE"]).ORACLE["latency_ema"],
    "stream_breaker_any_order": __import__("tessera.plans.state_q", fromlist=["ORACLE"]).ORACLE["breaker_states"],
    "stream_ema": __import__("tessera.plans.state_q", fromlist=["ORACLE"]).ORACLE["latency_ema"],
    "stream_breaker": __import__("tessera.plans.state_q", fromlist=["ORACLE"]).ORACLE["breaker_states"],
    "stream_signals": __import__("tessera.plans.catalog_q", fromlist=["ORACLE"]).ORACLE["signal_fanout"],
}
