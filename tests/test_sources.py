"""Round trips of readers and writers in a scratch folder."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import incremental
from tessera.session import scratch_path
from tessera.sources import io


def test_read_any_order_and_latest(spark):
    base = scratch_path(spark, "readany")
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    df.write.json(f"{base}/t.json")
    df.write.option("header", True).csv(f"{base}/t.csv")
    assert io.read_any(spark, base, "t").columns == ["id", "s"]  # json before csv
    df.write.parquet(f"{base}/t.parquet")
    assert io.read_any(spark, base, "t").first().id == 1
    os.makedirs(f"{base}/files", exist_ok=True)
    for i, name in enumerate(["a.parquet", "b.parquet"]):
        spark.range(i + 1).write.parquet(f"{base}/files/{name}")
        time.sleep(1.1)
    assert io.latest_file(spark, f"{base}/files/*.parquet").endswith("b.parquet")


def test_sources_union_and_append(spark):
    base = scratch_path(spark, "sources")
    spark.createDataFrame([(1, 2.0)], "k long, v double").write.parquet(f"{base}/master")
    spark.createDataFrame([(2, "x")], "k long, extra string").write.parquet(f"{base}/repo_1")
    both = io.read_sources(spark, [{"name": "master", "path": f"{base}/master", "priority": 100},
                                   {"name": "repo_1", "path": f"{base}/repo_1", "priority": 50}])
    rows = {r.source: r for r in both.collect()}
    assert rows["master"].extra is None and rows["repo_1"].v is None and rows["repo_1"].priority == 50
    io.append_rows(spark.createDataFrame([(1,)], "x long"), f"{base}/log")
    io.append_rows(spark.createDataFrame([(2,)], "x long"), f"{base}/log")
    assert spark.read.parquet(f"{base}/log").count() == 2


def test_feature_list_round_trip(spark):
    base = scratch_path(spark, "features")
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/selected.json", "w") as f:
        json.dump({"features": ["views_h1_24_total", "views_q1_23_us"], "count": 2}, f, indent=2)
    fl = io.read_feature_list(spark, f"{base}/selected.json").collect()
    assert [(r.rank, r.feature) for r in fl] == [(1, "views_h1_24_total"), (2, "views_q1_23_us")]


def test_versioned_key_table(spark):
    base = scratch_path(spark, "keys")
    incremental.write_version(spark.createDataFrame([(1,)], "k long"), base, "0001")
    incremental.write_version(spark.createDataFrame([(1,), (2,)], "k long"), base, "0002")
    assert incremental.read_latest_version(spark, base).count() == 2


def test_json_sink_partitioned_and_single(spark):
    base = scratch_path(spark, "json")
    df = spark.createDataFrame([("2024-01-01", "ok", 3), ("2024-01-02", "stop", 1)],
                               "run_date string, status string, phases long")
    io.write_json_rows(df, f"{base}/summary", partition_by=["run_date"])
    io.write_json_rows(df, f"{base}/summary", partition_by=["run_date"])  # append
    back = spark.read.json(f"{base}/summary")
    assert back.count() == 4 and set(back.columns) == {"run_date", "status", "phases"}
    io.write_json_rows(df.select(F.to_json(F.struct("status", "phases")).alias("j")), f"{base}/one", single_file=True)
    files = [f for f in os.listdir(f"{base}/one") if f.endswith(".json")]
    assert len(files) == 1


def test_csv_contributor_equals_parquet_master(spark):
    """CSV columns take the master's types; another order, a missing and an own column; bad values fail."""
    from tessera.operators import catalog

    base = scratch_path(spark, "typed")
    master = spark.createDataFrame([(1, 1.5, True, "x"), (2, None, False, None)],
                                   "k long, price double, flag boolean, name string")
    master.write.parquet(f"{base}/m")
    master.select("price", "k", "flag", F.lit("own").alias("note")).write.option("header", True).csv(f"{base}/c")
    both = io.read_sources(spark, [{"name": "m", "path": f"{base}/m", "priority": 9},
                                   {"name": "c", "path": f"{base}/c", "priority": 1, "format": "csv"}])
    assert {f.name: f.dataType.simpleString() for f in both.schema}["price"] == "double"
    c = both.where("source = 'c'")
    assert {tuple(r) for r in c.select("k", "price", "flag", "name", "note").collect()} == {
        (1, 1.5, True, None, "own"), (2, None, False, None, "own")}
    states = catalog.reconcile(both.where("source = 'm'").select("k", "price"), c.select("k", "price", "source"), "k", ["price"])
    assert [r.status for r in states.collect()] == ["IN_SYNC"] * 2
    spark.createDataFrame([("abc",)], "k string").write.option("header", True).csv(f"{base}/bad")
    bad = io.read_sources(spark, [{"name": "m", "path": f"{base}/m", "priority": 9},
                                  {"name": "b", "path": f"{base}/bad", "priority": 1, "format": "csv"}])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.collect()


def test_event_stream_from_dataset_folder(spark):
    from tessera.plans import stream_q
    base = scratch_path(spark, "sfdir")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{base}/events.parquet")
    got = stream_q.stream_arrivals(spark, base).count()
    want = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.get_json_object("props", "$.k")).distinct().count()
    assert got == want


def test_bucketed_master_is_not_shuffled(spark):
    from tessera.operators import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force a shuffle join to inspect
    try:
        master = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_retailprice")
        io.write_keyed_table(master, "master_part_bucketed", "p_partkey", 8)
        m = spark.table("master_part_bucketed")
        contrib = master.filter("p_partkey % 2 = 0").withColumn("source", F.lit("r1"))
        j = m.join(contrib.select("p_partkey", "source"), "p_partkey")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        # exactly one exchange: the contributor side
        j.write.format("noop").mode("overwrite").save()
        final = j._jdf.queryExecution().executedPlan().toString()
        assert final.count("Exchange hashpartitioning") <= 1
        assert catalog.reconcile(m, contrib, "p_partkey", ["p_retailprice"]).count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS master_part_bucketed")


def test_catalog_and_sync_history_types(spark):
    cat = spark.createDataFrame([("master", "parquet", 1, 100, 0, '{"owner": "ops"}'),
                                 ("repo_3", "csv", 0, 25, 1, None)],
                                "name string, source_type string, is_master int, priority int, read_only int, metadata string")
    rows = {r.name: r for r in io.normalise_catalog(cat).collect()}
    assert rows["master"].is_master is True and rows["repo_3"].read_only is True
    assert rows["master"].metadata == {"owner": "ops"} and rows["repo_3"].metadata is None
    hist = spark.createDataFrame([(1, "repo_1", "sync", 1704067200.5, 1, "")],
                                 "id long, source_name string, operation string, timestamp double, success int, details string")
    h = io.normalise_sync_history(hist).first()
    assert h.success is True and h.timestamp.year == 2024


def test_stream_breaker_and_ema_carry_state_across_batches(spark):
    import datetime as dt

    from tessera.operators import state
    from tessera.streaming import ops

    base = scratch_path(spark, "multibatch")
    t0 = dt.datetime(2024, 1, 1)
    pattern = [True, True, False, True, True, True, True, False, True]  # run spans batch borders
    rows = [(i, t0 + dt.timedelta(seconds=100 * i), 7, "error" if bad else "view", float(i), '{"k": 1}')
            for i, bad in enumerate(pattern)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for chunk in (rows[:3], rows[3:6], rows[6:]):  # three part files, one per trigger
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(1.1)  # distinct modification times keep the files in order
    stream = ops.read_events_stream(spark, f"{base}/in", glob="*.parquet", max_files=1)
    out = ops.breaker_feed(spark, stream.withColumn("failed", F.col("event_type") == "error"), "user_id", "failed")
    got = {r.event_id: (r.state_before, r.failures, r.state_after) for r in spark.read.parquet(out).collect()}
    batch = spark.createDataFrame(rows, schema)
    want = {r.event_id: (r.state_before, r.failures, r.state_after)
            for r in state.breaker_states(batch, "user_id", "ts", "event_id", F.col("event_type") == "error").collect()}
    assert got == want and len(got) == 9
    out2 = ops.ema_feed(spark, ops.read_events_stream(spark, f"{base}/in", glob="*.parquet", max_files=1),
                        "user_id", "value")
    last = spark.read.parquet(out2).orderBy(F.col("events").desc()).first()
    want_ema = state.ema_per_key(batch, "user_id", "ts", "event_id", "value").first().ema
    assert last.events == 9 and abs(last.ema - want_ema) < 1e-12


def test_stream_ema_of_a_hot_key_resumes(spark):
    """One key above any Arrow batch, rows in no order, NULL keys and values; a second run adds to the first."""
    from tessera.operators import state
    from tessera.streaming import ops

    base = scratch_path(spark, "ema-hot")
    i = F.col("id")
    ev = spark.range(24_000).select(
        i.alias("event_id"), (F.timestamp_seconds(i * 7 + 1_700_000_000)).cast("timestamp_ntz").alias("ts"),
        F.lit(1).cast("long").alias("user_id"), F.when(i % 6 > 0, F.lit("hot")).alias("event_type"),
        F.when(i % 11 > 0, (F.hash("id") % 100).cast("double")).alias("value"), F.lit("{}").alias("props"))
    late = F.col("event_id") >= 15_000
    for part in (~late, late):
        ev.filter(part).repartition(3, F.xxhash64("event_id")).orderBy(F.hash("event_id")).write.mode("append").parquet(f"{base}/in")
        ops.ema_feed(spark, ops.read_events_stream(spark, f"{base}/in", glob="*.parquet"), "event_type", "value",
                     out=f"{base}/out", checkpoint=f"{base}/ck")
    got = {r.event_type: (r.events, r.ema) for r in spark.read.parquet(f"{base}/out").filter("batch_id = 1").collect()}
    want = {r.event_type: (r.events, r.ema)
            for r in state.ema_per_key(ev, "event_type", "ts", "event_id", "value").collect()}
    assert got.keys() == want.keys() == {"hot", None}
    for k, (n, x) in want.items():
        assert got[k][0] == n and abs(got[k][1] - x) < 1e-9


def test_stream_breaker_of_a_hot_key_resumes(spark):
    """One key above any Arrow batch, rows in no order, a NULL key, a key that pauses for a run."""
    from tessera.operators import state
    from tessera.streaming import ops

    base = scratch_path(spark, "breaker-hot")
    i = F.col("id")
    ev = spark.range(24_000).select(
        i.alias("event_id"), (F.timestamp_seconds(i * 90 + 1_700_000_000)).cast("timestamp_ntz").alias("ts"),
        F.when(i % 6 > 1, F.lit(7)).when((i % 6 == 1) & ((i < 8_000) | (i >= 16_000)), F.lit(8)).cast("long").alias("user_id"),
        F.when(F.hash("id") % 3 != 0, F.lit("error")).otherwise(F.lit("view")).alias("event_type"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    failed = F.col("event_type") == "error"
    for k in range(3):
        ev.filter(F.floor(F.col("event_id") / 8_000) == k).repartition(3, F.xxhash64("event_id")) \
            .orderBy(F.hash("event_id")).write.mode("append").parquet(f"{base}/in")
        stream = ops.read_events_stream(spark, f"{base}/in", glob="*.parquet").withColumn("failed", failed)
        out = ops.breaker_feed(spark, stream, "user_id", "failed", out=f"{base}/out", checkpoint=f"{base}/ck")
    cols = ["event_id", "user_id", "state_before", "failures", "state_after"]
    got = sorted(spark.read.parquet(out).select(cols).collect(), key=lambda r: r.event_id)
    want = sorted(state.breaker_states(ev, "user_id", "ts", "event_id", failed).select(cols).collect(),
                  key=lambda r: r.event_id)
    assert got == want and len(got) == 24_000 and {r.state_before for r in got} == {"CLOSED", "OPEN", "HALF-OPEN"}


def test_stream_arrivals_and_coherency_across_batches(spark):
    from tessera.plans import state_q
    from tessera.streaming import ops

    base = scratch_path(spark, "mb2")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id").collect()
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    third = len(ev) // 3
    for chunk in (ev[:third], ev[third:2 * third], ev[2 * third:]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(1.1)
    stream = ops.read_events_stream(spark, f"{base}/in", glob="*.parquet", max_files=1)
    keyed = stream.withColumn("key", F.get_json_object("props", "$.k"))
    arrived = spark.read.parquet(ops.arrivals(spark, keyed, "key"))
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = {r.key: r.first_ts for r in batch.groupBy(F.get_json_object("props", "$.k").alias("key"))
            .agg(F.min("ts").alias("first_ts")).collect()}
    got = {r.key: r.first_ts for r in arrived.select("key", F.col("first_ts").cast("timestamp_ntz")).collect()}
    assert got == want and arrived.count() == len(want)  # each key once, in its first batch
    assert arrived.select("batch_id").distinct().count() > 1
    action = (F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "view", "read")
               .when(F.col("event_type") == "click", "write").when(F.col("event_type") == "purchase", "update")
               .otherwise("sync"))
    src = stream.select(F.get_json_object("props", "$.k").alias("block"),
                        F.concat(F.lit("site_"), (F.col("user_id") % 3).cast("string")).alias("source"),
                        "ts", "event_id", action.alias("action"))
    out = ops.coherency_feed(spark, src)
    assert spark.read.parquet(out).select("batch_id").distinct().count() > 1
    cur = {(r.block, r.source): (r.state, r.version) for r in ops.newest_copies(spark, out).collect()}
    want_c = {(r.block, r.source): (r.state, r.version)
              for r in state_q.coherency_fold(spark, "/root/testdata/sf0.001").collect()}
    assert cur == want_c


def test_stream_coherency_any_order_and_batch_size(spark):
    """One block with 24,000 rows in no order: one batch, then batches out of order."""
    from tessera.operators import state
    from tessera.plans import state_q, stream_q
    from tessera.streaming import ops

    base = scratch_path(spark, "coh-big")
    i = F.col("id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("view", "click", "purchase", "error")]), (i % 4 + 1).cast("int"))
    ev = spark.range(24_000).select(
        i.alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=i)).cast("timestamp_ntz").alias("ts"),
        F.floor(i / 7).alias("user_id"),
        F.when(i.isin(3_000, 9_001, 15_002), "signup").otherwise(kind).alias("event_type"), F.lit(1.0).alias("value"),
        F.lit('{"k": "hot"}').alias("props"))
    ev.orderBy(F.hash(i)).coalesce(1).write.parquet(f"{base}/events.parquet")
    want = sorted(map(tuple, state_q.coherency_fold(spark, base).collect()))
    assert sorted(map(tuple, stream_q.stream_coherency(spark, base).collect())) == want and len(want) == 3

    # the last third comes first, the registers after the updates that follow them
    src = state_q._coherency_events(spark, base)
    for lo in (16_000, 8_000, 0):
        part = src.filter(F.col("event_id").between(lo, lo + 7_999)).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{base}/in")
        path = ops.coherency_feed(spark, stream, out=f"{base}/out", checkpoint=f"{base}/ck")
    got = ops.newest_copies(spark, path).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))
    assert sorted(map(tuple, got.collect())) == want
    assert spark.read.parquet(path).select("batch_id").distinct().count() == 3
    assert want == sorted(map(tuple, state.coherency_state(src, "block", "source", "ts", "event_id").collect()))
