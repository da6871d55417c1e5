"""Hand-made frames from FIXTURES.md part C."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import access, audit, catalog, incremental, metrics, quality, state, views


def test_mape_skips_zero_rows_and_all_zero_is_null(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 8.0), (20.0, 25.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert r.mape == pytest.approx((0.2 + 0.25) / 2 * 100)
    z = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, p double")
    assert metrics.regression_metrics(z, "y", "p").first().mape is None


def test_r2_constant_target_is_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 5.0)], "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").first().r2 == 0.0


@pytest.mark.parametrize("present,expected", [
    (("m1", "m2", "m3"), 0.52 * 1 + 0.35 * 2 + 0.13 * 3),
    (("m1", "m2"), (0.52 * 1 + 0.35 * 2) / 0.87),
    (("m3",), 3.0),
    ((), None),
])
def test_ensemble_renormalises(spark, present, expected):
    vals = {"m1": 1.0, "m2": 2.0, "m3": 3.0}
    row = [vals[m] if m in present else None for m in ("m1", "m2", "m3")]
    df = spark.createDataFrame([tuple(row)], "m1 double, m2 double, m3 double")
    got = df.select(metrics.ensemble_prediction({"m1": "m1", "m2": "m2", "m3": "m3"}).alias("e")).first().e
    if expected is None:
        assert got is None
    else:
        assert got == pytest.approx(expected)


def test_breaker_sequence(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t0, True), (1, 2, t0 + dt.timedelta(seconds=1), True),
            (1, 3, t0 + dt.timedelta(seconds=2), True), (1, 4, t0 + dt.timedelta(seconds=303), False)]
    df = spark.createDataFrame(rows, "k long, id long, ts timestamp_ntz, bad boolean")
    out = sorted(state.breaker_states(df, "k", "ts", "id", F.col("bad")).collect(), key=lambda r: r.id)
    seq = [out[0].state_after, out[1].state_after, out[2].state_after, out[3].state_before, out[3].state_after]
    assert seq == ["CLOSED", "CLOSED", "OPEN", "HALF-OPEN", "CLOSED"]


def test_breaker_open_within_timeout(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(seconds=i), True) for i in range(4)]
    df = spark.createDataFrame(rows, "k long, id long, ts timestamp_ntz, bad boolean")
    out = sorted(state.breaker_states(df, "k", "ts", "id", F.col("bad")).collect(), key=lambda r: r.id)
    assert out[3].state_before == "OPEN" and out[3].failures == 4


def test_ema_value(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", i, t0 + dt.timedelta(minutes=i), float(i + 1)) for i in range(3)],
                               "k string, id long, ts timestamp_ntz, v double")
    assert state.ema_per_key(df, "k", "ts", "id", "v").first().ema == pytest.approx(0.561)


def test_hash_chain_fixture_and_tamper(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("c", 1, t0, "a"), ("c", 2, t0 + dt.timedelta(seconds=1), "b")],
                               "chain string, entry_id long, ts timestamp_ntz, payload string")
    ch = {r.seq: r.entry_hash for r in audit.build_chain(df).collect()}
    assert ch[2] == "1324b18e5547c87de96947ccf86edbada7022d1bacdad3e89c785053df7125b4"
    three = spark.createDataFrame([("c", i, t0 + dt.timedelta(seconds=i), p) for i, p in enumerate("xyz")],
                                  "chain string, entry_id long, ts timestamp_ntz, payload string")
    stored = audit.build_chain(three).join(three.select("entry_id", "payload"), "entry_id")
    bad = stored.withColumn("payload", F.when(F.col("entry_id") == 1, F.lit("Y")).otherwise(F.col("payload")))
    res = audit.first_breaks(audit.verify_chain(bad)).first()
    assert res.breaks == 1 and res.first_break_id == 1
    ok = audit.first_breaks(audit.verify_chain(stored)).first()
    assert ok.breaks == 0 and ok.first_break_id is None


def test_hash_chain_null_chain_and_payload(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, i, t0 + dt.timedelta(seconds=i), p) for i, (k, p) in enumerate(
        [(None, "a"), (7, "b"), (None, None), (7, "c"), (None, "d")])]
    schema = "chain long, entry_id int, ts timestamp, payload string"
    got = {r.entry_id: (r.seq, r.entry_hash) for r in audit.build_chain(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i][0] for i in range(5)] == [1, 1, 2, 2, 3]
    named = audit.build_chain(spark.createDataFrame([(k or 1, i, t, p or "") for k, i, t, p in rows], schema))
    assert got == {r.entry_id: (r.seq, r.entry_hash) for r in named.collect()}  # as any other chain, payload as empty text
    blocked = lambda x: {r.entry_id: r.entry_hash for r in audit.build_chain(
        spark.createDataFrame(x, schema), block_col=F.lit("d")).collect()}
    alone = blocked([r for r in rows if r[0] == 7])
    assert {i: h for i, h in blocked(rows).items() if i in alone} == alone
    stored = audit.build_chain(spark.createDataFrame(rows, schema)).join(
        spark.createDataFrame(rows, schema).select("entry_id", "payload"), "entry_id")
    assert all(r.breaks == 0 for r in audit.first_breaks(audit.verify_chain(stored)).collect())


def test_arrivals_twice_adds_nothing(spark):
    processed = spark.createDataFrame([(1,), (2,)], "k long")
    batch = spark.createDataFrame([(2,), (3,), (3,)], "k long")
    once = incremental.complete_run(processed, batch, "k")
    twice = incremental.complete_run(once, batch, "k")
    assert sorted(r.k for r in once.collect()) == [1, 2, 3]
    assert sorted(r.k for r in twice.collect()) == [1, 2, 3]
    assert incremental.new_keys(batch, twice, "k").count() == 0


def test_run_modes(spark):
    titles = spark.createDataFrame([(i,) for i in range(5)], "k long")
    processed = spark.createDataFrame([(0,), (1,)], "k long")
    arrivals = spark.createDataFrame([(1,), (4,)], "k long")
    sel = lambda m: sorted(r.k for r in incremental.select_rows(m, titles, processed, arrivals, "k").collect())
    assert sel("FULL_BUILD") == [0, 1, 2, 3, 4]
    assert sel("INCREMENTAL") == [4]
    assert sel("EQUATION_UPDATE") == [0, 1]
    assert sel("VALIDATION_ONLY") == []


def test_temporal_mask_keeps_null_and_zero_apart(spark):
    df = spark.createDataFrame([(2025, 2024, 0.0), (2025, 2025, 0.0), (2025, 2025, None), (2025, 2024, None)],
                               "start_year int, year int, views double")
    out = [r.views for r in views.temporal_mask(df).collect()]
    assert out == [None, 0.0, None, None]
    prof = {r.column: (r.nulls, r.zeros) for r in quality.null_zero_profile(views.temporal_mask(df), ["views"]).collect()}
    assert prof["views"] == (3, 1)


def test_gate_first_failure_and_pending(spark):
    reg = quality.CheckRegistry()
    reg.register("DATA_BREAKDOWN", "ok", lambda: spark.createDataFrame([(True, "fine")], "ok boolean, message string"))
    reg.register("COMPUTE_HALT", "bad", lambda: spark.createDataFrame([(False, "overflow")], "ok boolean, message string"))
    reg.register("SECURITY_FAILURE", "broken", lambda: 1 / 0)
    empty = spark.createDataFrame([], "violations long")
    reg.register("VALIDATION_BREACH", "pending", lambda: quality.violation_check(empty))
    summ = {r.mode: r for r in quality.gate_summary(reg.check_table(spark)).collect()}
    assert summ["VALIDATION_BREACH"].ok  # no result = pending, passes
    assert not summ["COMPUTE_HALT"].ok and summ["COMPUTE_HALT"].failures == "overflow"
    assert not summ["SECURITY_FAILURE"].ok and "check could not run" in summ["SECURITY_FAILURE"].failures
    assert summ["DATA_BREAKDOWN"].first_failure == "COMPUTE_HALT"
    with pytest.raises(quality.GateFailed) as e:
        quality.enforce(reg.check_table(spark))
    assert e.value.mode == "COMPUTE_HALT"


def test_rows_checked_observation(spark):
    df, obs = quality.with_rows_checked(spark.range(123))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows_checked"] == 123


def test_upsert_last_writer_wins_and_priority(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, seq int")
    new = spark.createDataFrame([(2, "B", 2), (3, "c", 2), (2, "BB", 3)], "k long, v string, seq int")
    got = {r.k: r.v for r in catalog.upsert(old, new, ["k"], ["seq"]).collect()}
    assert got == {1: "a", 2: "BB", 3: "c"}
    rows = spark.createDataFrame([(1, "master", 100, 1.0), (1, "repo_1", 50, 2.0), (2, "repo_2", 45, 3.0)],
                                 "k long, source string, priority int, v double")
    win = {r.k: r.source for r in catalog.winner_by_priority(rows, ["k"]).collect()}
    assert win == {1: "master", 2: "repo_2"}


def test_checksum_order_insensitive_and_changes(spark):
    a = spark.createDataFrame([(1, "x", 1.5), (2, "y", None)], "k long, s string, d double")
    b = spark.createDataFrame([(2, "y", None), (1, "x", 1.5)], "k long, s string, d double")
    c = spark.createDataFrame([(2, "y", None), (1, "x", 1.25)], "k long, s string, d double")
    ca, cb, cc = (catalog.dataset_checksum(x).first() for x in (a, b, c))
    assert (ca.rows, ca.md5_sum, ca.xx_xor) == (cb.rows, cb.md5_sum, cb.xx_xor)
    assert ca.md5_sum != cc.md5_sum


def test_reconcile_statuses_and_merge_idempotent(spark):
    master = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    contrib = spark.createDataFrame([(1, "a", "r1"), (2, "B", "r1"), (9, "z", "r1")], "k long, v string, source string")
    st = {r.k: r.status for r in catalog.reconcile(master, contrib, "k", ["v"]).collect()}
    assert st == {1: "IN_SYNC", 2: "STALE", 3: "MISSING", 9: "EXTRA"}
    cat = spark.createDataFrame([("r1", False)], "source string, read_only boolean")
    once = catalog.merge_master_wins(master, contrib, "k", cat)
    twice = catalog.merge_master_wins(master, once, "k", cat)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.k: r.v for r in once.collect()} == {1: "a", 2: "b", 3: "c", 9: "z"}
    ro = spark.createDataFrame([("r1", True)], "source string, read_only boolean")
    assert catalog.merge_master_wins(master, contrib, "k", ro).count() == 0


def test_tier_table_rules(spark):
    counts = spark.createDataFrame([(f"k{i:04d}", 2000 - i) for i in range(1400)] + [("low", 1)],
                                   "key string, accesses long")
    t = {r.key: (r.rank, r.tier) for r in access.tier_table(counts).collect()}
    assert t["k0000"] == (1, "L1_HOT") and t["k0063"][1] == "L1_HOT"
    assert t["k0064"][1] == "L2_WARM" and t["k0319"][1] == "L2_WARM"
    assert t["k0320"][1] == "L3_COLD" and t["k1343"][1] == "L3_COLD"
    assert t["k1344"] == (None, "UNCACHED") and t["low"][1] == "UNCACHED"


def test_removal_candidates_stop_at_target(spark):
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", "L1", 10.0, t0, 1, False), ("b", "L1", 10.0, t0 + dt.timedelta(hours=1), 1, True),
                               ("c", "L1", 10.0, t0 + dt.timedelta(hours=2), 1, False),
                               ("d", "L1", 10.0, t0 + dt.timedelta(hours=3), 1, False)],
                              "key string, tier string, size_bytes double, last_ts timestamp_ntz, accesses long, pinned boolean")
    got = [r.key for r in access.removal_candidates(e, 15.0, pinned="pinned").orderBy("last_ts").collect()]
    assert got == ["a", "c"]  # b is pinned; a + c free 20 >= 15


def test_split_key(spark):
    df = spark.createDataFrame([("data:x",), ("a:b:c",), ("plain",)], "key string")
    c, n = access.split_key("key")
    assert [tuple(r) for r in df.select(c, n).collect()] == [("data", "x"), (None, None), (None, None)]


def test_bounded_broadcast_checks_size(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    assert views.estimated_bytes(small) is not None
    hinted = views.bounded_broadcast(small, 1000)
    assert "broadcast" in hinted._jdf.queryExecution().analyzed().toString().lower()
    assert views.bounded_broadcast(big, 1000, max_bytes=1024) is big


def test_f_distribution_tail():
    from tessera.operators.ml import f_sf
    # textbook 5% critical values
    assert f_sf(2.866, 4, 20) == pytest.approx(0.05, abs=2e-4)
    assert f_sf(4.965, 1, 10) == pytest.approx(0.05, abs=2e-4)
    assert f_sf(1.0, 5, 5) == pytest.approx(0.5, abs=1e-9)


def test_granger_detects_lagged_cause(spark):
    import math
    rows = []
    xs = [math.sin(i * 0.7) + 0.3 * math.cos(i * 1.3) for i in range(60)]
    for t in range(60):
        rows.append(("x", t, xs[t]))
        rows.append(("y", t, (xs[t - 1] if t else 0.0) * 2 + 0.01 * math.sin(t * 5.1)))
    from tessera.operators import ml
    out = {(r.x, r.y): r for r in ml.granger(spark.createDataFrame(rows, "g string, t long, v double"), "g", "t", "v").collect()}
    assert out[("x", "y")].significant and out[("x", "y")].p_value < 1e-6


def test_termination_record(spark):
    reg = quality.CheckRegistry()
    reg.register("VALIDATION_BREACH", "t", lambda: spark.createDataFrame([(False, "Temporal violations: 3")],
                                                                           "ok boolean, message string"))
    rec = quality.termination_record(quality.gate_summary(reg.check_table(spark)), "run-1", "2024-01-01 00:00:00").first()
    assert rec.status == "TERMINATED" and rec.failure_mode == "VALIDATION_BREACH"
    assert rec.description == quality.MODE_DESCRIPTIONS["VALIDATION_BREACH"] and rec.reason == "Temporal violations: 3"
    assert rec.machine_generated is True and rec.operator_editable is False
    ok = quality.CheckRegistry()
    ok.register("DATA_BREAKDOWN", "fine", lambda: spark.createDataFrame([(True, "ok")], "ok boolean, message string"))
    assert quality.termination_record(quality.gate_summary(ok.check_table(spark)), "run-2", "2024-01-01").first().status == "COMPLETED"


def test_null_keys_survive_access_aggregates(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(None, 1, t0, 1), (None, 2, t0 + dt.timedelta(seconds=2), 2), ("a", 1, t0, 3)],
                                "key string, component long, ts timestamp_ntz, event_id long")
    st = {r.key: r for r in access.access_stats(log).collect()}
    assert st[None].accesses == 2 and st[None].avg_interval_ms == 2000.0
    sh = access.transition_share(log.select(F.col("key").alias("source"), F.col("component").cast("string").alias("target")))
    assert sorted((r.source, r.share) for r in sh.collect() if r.source is None) == [(None, 0.5), (None, 0.5)]


def test_scale_conf_sizes_partitions():
    from tessera.session import scale_conf

    big = scale_conf(100 * 2 ** 40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(10 * 2 ** 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # at least 2 per core


def plain_granger(series, max_lag):
    """Least squares over the steps at which y and x have all their lags; values of a step are added."""
    import numpy as np
    val = {}
    for g, t, v in series:
        if t is not None and v is not None and v == v:
            val.setdefault(g, {}).setdefault(t, 0.0)
            val[g][t] += v
    out = {}
    for x in val:
        for y in val:
            if x == y:
                continue
            steps = [t for t in val[y] if all(t - k in val[y] and t - k in val[x] for k in range(max_lag + 1))]
            if not steps:
                continue
            target = np.array([val[y][t] for t in steps])
            own = np.array([[1.0] + [val[y][t - k] for k in range(1, max_lag + 1)] for t in steps])
            full = np.array([[*o, *(val[x][t - k] for k in range(1, max_lag + 1))] for o, t in zip(own, steps)])
            rss = [float(((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum()) for m in (own, full)]
            n, df2 = len(steps), len(steps) - 2 * max_lag - 1
            out[x, y] = (n, ((rss[0] - rss[1]) / max_lag) / (rss[1] / df2) if df2 > 0 and rss[1] > 1e-9 else None)
    return out


@pytest.mark.parametrize("max_lag", [1, 4])
def test_granger_equals_least_squares_with_gaps_and_nulls(spark, max_lag):
    import random

    from tessera.operators import ml
    rnd = random.Random(6)
    rows = [(g, t, rnd.gauss(1e6 if g == "big" else 0, 1)) for g in ("a", "big", "c", None) for t in range(90) if rnd.random() > 0.05]
    rows += [("a", 17, None), ("c", 30, float("nan")), ("c", 31, 0.5), ("flat", 1, 2.0), ("short", 500, 1.0), ("a", None, 3.0)]
    rows += [("flat", t, 2.0) for t in range(2, 60)]
    got = {(r.x, r.y): r for r in ml.granger(spark.createDataFrame(rows, "g string, t long, v double"), "g", "t", "v", max_lag).collect()}
    want = plain_granger(rows, max_lag)
    assert got.keys() == want.keys() and len(got) >= 12
    for pair, (n, f) in want.items():
        assert got[pair].n == n
        if "flat" in pair:
            continue
        if f is None:
            assert got[pair].f_stat != got[pair].f_stat
        else:
            assert got[pair].f_stat == pytest.approx(f, rel=1e-6, abs=1e-9)
            assert got[pair].p_value == pytest.approx(ml.f_sf(f, max_lag, n - 2 * max_lag - 1), rel=1e-5, abs=1e-12)
    assert all(got[p].f_stat != got[p].f_stat for p in got if p[1] == "flat")
