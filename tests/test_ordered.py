import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import ordered


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else f"k{rnd.randint(0, 20)}"  # one key holds 2/3 of the rows
        rows.append((i, g, rnd.randint(0, 10_000), rnd.random() * 10, rnd.random() < 0.3))
    return spark.createDataFrame(rows, "id long, g string, t long, v double, flag boolean")


@pytest.mark.parametrize("agg", ["sum", "max", "count"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_agg_equals_window(data, agg, inclusive):
    order = [F.col("t"), F.col("id")]
    fn = {"sum": F.sum, "max": F.max, "count": F.count}[agg]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ref = {r.id: r.x for r in data.select("id", fn("v").over(w).alias("x")).collect()}
    got = {r.id: r.x for r in ordered.running_agg(data, ["g"], order, F.col("v"), "x",
                                                   ordered.value_bucket("t", 500), agg, inclusive).collect()}
    assert ref.keys() == got.keys()
    for k in ref:
        if ref[k] is None:
            assert got[k] in (None, 0)
        else:
            assert got[k] == pytest.approx(ref[k], rel=1e-12)


def test_previous_values_equals_lag(data):
    order = [F.col("t"), F.col("id")]
    w = Window.partitionBy("g").orderBy(*order)
    ref = {r.id: (r.pt, r.pv) for r in data.select("id", F.lag("t").over(w).alias("pt"),
                                                   F.lag("v").over(w).alias("pv")).collect()}
    got = {r.id: (r.prev_t, r.prev_v) for r in
           ordered.previous_values(data, ["g"], order, ["t", "v"], ordered.value_bucket("t", 700)).collect()}
    assert ref == got


def test_global_row_numbers(data):
    got = ordered.row_numbers(data, [], [F.col("id")], ordered.value_bucket("id", 256)).collect()
    assert sorted((r.id, r.rn) for r in got) == [(i, i + 1) for i in range(3000)]


def test_descending_order_with_negated_bucket(data):
    w = Window.partitionBy("g").orderBy(F.col("t").desc(), F.col("id").desc())
    ref = {r.id: r.k for r in data.select("id", F.row_number().over(w).alias("k")).collect()}
    got = {r.id: r.k for r in ordered.row_numbers(data, ["g"], [F.col("t"), F.col("id")], -ordered.value_bucket("t", 500),
                                                  "k", descending=True).collect()}
    assert ref == got
    with pytest.raises(ValueError, match="descending"):
        ordered.row_numbers(data, ["g"], [F.col("t").desc()], -ordered.value_bucket("t", 500))


def test_null_keys_are_kept(spark):
    rows = [(i, None if i % 4 == 0 else f"k{i % 3}", i * 10, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, t long, v double")
    order = [F.col("t"), F.col("id")]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ref = {r.id: r.x for r in df.select("id", F.sum("v").over(w).alias("x")).collect()}
    got = {r.id: r.x for r in ordered.running_agg(df, ["g"], order, F.col("v"), "x",
                                                   ordered.value_bucket("t", 300)).collect()}
    assert ref == got
    wl = Window.partitionBy("g").orderBy(*order)
    ref_lag = {r.id: r.p for r in df.select("id", F.lag("v").over(wl).alias("p")).collect()}
    got_lag = {r.id: r.prev_v for r in ordered.previous_values(df, ["g"], order, ["v"],
                                                                ordered.value_bucket("t", 300)).collect()}
    assert ref_lag == got_lag


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(ordered, "MAX_CHUNK_ROWS", 100)
    monkeypatch.setattr(ordered, "CUT_SAMPLES", 20)
    monkeypatch.setattr(ordered, "FAN", 3)


def chunk_sizes(df, groups, bucket, order, descending=False):
    rows, keys = ordered._keyed(df, groups, bucket, order, descending)
    return rows.groupBy(*keys, *ordered.CHUNK).count().toPandas()["count"]


@pytest.mark.parametrize("descending", [False, True])
def test_one_key_in_one_second_is_spread(spark, small_chunks, descending):
    rows = [(i * 7919 % 5000, "hot" if i % 10 else "cold", 77, float(i % 13)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, g string, t long, v double")
    order, bucket = [F.col("t"), F.col("id")], ordered.value_bucket("t", 10)
    size = chunk_sizes(df, ["g"], bucket, order, descending)
    assert size.max() < 3 * 100 and len(size) > 20
    w = Window.partitionBy("g").orderBy(*[c.desc() if descending else c for c in order])
    ref = {r.id: r.k for r in df.select("id", F.row_number().over(w).alias("k")).collect()}
    got = {r.id: r.k for r in ordered.row_numbers(df, ["g"], order, -bucket if descending else bucket, "k", descending).collect()}
    assert ref == got
    if not descending:
        run = w.rowsBetween(Window.unboundedPreceding, -1)
        ref = {r.id: tuple(r)[1:] for r in df.select("id", F.sum("v").over(run), F.max("v").over(run), F.lag("v").over(w)).collect()}
        a = ordered.running_agg(df, ["g"], order, F.col("v"), "s", bucket, "sum", False)
        a = ordered.running_agg(a, ["g"], order, F.col("v"), "m", bucket, "max", False)
        got = {r.id: (r.s, r.m, r.prev_v) for r in ordered.previous_values(a, ["g"], order, ["v"], bucket).collect()}
        assert ref == got


def test_a_long_tail_of_equal_counts_is_spread(spark, small_chunks):
    from tessera.operators import access

    rows = [(f"key{i:05}", "L3", 1, 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, tier string, accesses long, size_bytes long")
    assert chunk_sizes(df, ["tier"], F.col("accesses"), [F.col("accesses"), F.col("key")]).max() < 3 * 100
    got = access.removal_candidates(df, 5000, "LFU").select("key").collect()
    assert sorted(r.key for r in got) == [f"key{i:05}" for i in range(500)]


def test_batches_of_one_wide_range(spark, small_chunks):
    from tessera.operators import state

    df = spark.range(2000).withColumn("k", (F.col("id") * 31) % 2000)
    got = state.assign_batches(df, "k", 250, 1e9).collect()
    assert all(r.batch_id == r.k // 250 for r in got)
    assert chunk_sizes(df, [], ordered.value_bucket("k", 1e9), [F.col("k")]).max() < 3 * 100


def test_two_level_scan_over_many_buckets(data, small_chunks):
    order, w = [F.col("t"), F.col("id")], Window.partitionBy("g").orderBy("t", "id")
    ref = {r.id: (r.k, r.p) for r in data.select("id", F.row_number().over(w).alias("k"), F.lag("id").over(w).alias("p")).collect()}
    bucket = ordered.value_bucket("t", 200)
    a = ordered.row_numbers(data, ["g"], order, bucket, "k")
    got = {r.id: (r.k, r.prev_id) for r in ordered.previous_values(a, ["g"], order, ["id"], bucket).collect()}
    assert ref == got
