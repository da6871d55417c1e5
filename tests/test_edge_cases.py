"""Nulls, collisions, failures while running, and restarts."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import access, incremental, ml, profile, quality
from tessera.streaming import ops


def test_different_rows_have_different_digests(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("\\N", "c"), ("N", "c"), ("", "c"), ("1:a", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(hashing.row_digest(df, ["x", "y"]).alias("h")).distinct().count() == len(rows)


def test_versions_are_ordered_by_number(spark, tmp_path):
    for v in (9, 10, 2):
        incremental.write_version(spark.createDataFrame([(v,)], "v long"), str(tmp_path), str(v))
    assert incremental.read_latest_version(spark, str(tmp_path)).first().v == 10


def test_null_key_is_ranked_like_others(spark):
    t = access.tier_table(spark.createDataFrame([(None, 50), ("a", 9)], "key string, accesses long")).collect()
    assert {r.key: (r.rank, r.tier) for r in t} == {None: (1, "L1_HOT"), "a": (2, "L1_HOT")}


def test_conformal_interval_is_unbounded_for_few_rows(spark):
    few = spark.createDataFrame([(float(i), 0.0) for i in range(1, 6)], "label double, ensemble double")
    many = spark.createDataFrame([(float(i), 0.0) for i in range(1, 20)], "label double, ensemble double")
    assert math.isinf(ml.conformal_intervals(few, few, level=0.9).first().q)
    assert ml.conformal_intervals(many, many, level=0.9).first().q == 18.0


def test_check_that_throws_while_running_is_a_failed_check(spark):
    reg = quality.CheckRegistry()
    reg.register("DATA_BREAKDOWN", "fine", lambda: spark.createDataFrame([(True, "ok")], "ok boolean, message string"))
    reg.register("COMPUTE_HALT", "throws", lambda: spark.range(1).select(
        F.raise_error(F.lit("boom")).cast("boolean").alias("ok"), F.lit("m").alias("message")))
    got = {r.mode: r for r in quality.gate_summary(reg.check_table(spark)).collect()}
    assert got["DATA_BREAKDOWN"].ok and not got["COMPUTE_HALT"].ok
    assert "check could not run" in got["COMPUTE_HALT"].failures


@pytest.mark.parametrize("k", [2, 9])
def test_nan_counts_as_missing_on_both_paths(spark, k):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, float("nan")), (4.0, 8.0)]
    df = spark.createDataFrame([r + (1.0,) * (k - 2) for r in rows], ", ".join(f"f{i} double" for i in range(k)))
    r = profile.correlation_long(df, [f"f{i}" for i in range(k)]).where("f1 = 'f0' AND f2 = 'f1'").first()
    assert r.n == 3 and abs(r.r - np.corrcoef([1, 2, 4], [2, 4.1, 8])[0, 1]) < 1e-9


def test_arrivals_resume_and_take_null_keys_once(spark, tmp_path):
    schema, src = "key string, ts timestamp", str(tmp_path / "in")
    t = dt.datetime(2024, 1, 1)
    state, ck = str(tmp_path / "state"), str(tmp_path / "ck")
    for rows in ([("a", t), (None, t)], [("b", t), (None, t), ("a", t)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ops.arrivals(spark, spark.readStream.schema(schema).parquet(src), "key", state=state, checkpoint=ck)
    got = [(r.key, r.batch_id) for r in spark.read.parquet(state).collect()]
    assert sorted(got, key=repr) == sorted([("a", 0), (None, 0), ("b", 1)], key=repr)


def test_pivot_matches_whole_years_and_fails_outside_its_lists(spark):
    import pytest
    from tessera.operators import views

    long = spark.createDataFrame([(1, "q1", 1998, "asia", 5.0), (1, "q1", 2010, "asia", 7.0)],
                                 "title long, period string, year long, region string, views double")
    got = views.pivot_views(long, "title", ["q1"], [1998, 2010], ["asia"]).first().asDict()
    assert got == {"title": 1, "views_q1_98_asia": 5.0, "views_q1_10_asia": 7.0}
    for rows in (long, long.selectExpr("title", "period", "year + 100 AS year", "region", "views")):
        with pytest.raises(Exception, match="outside the pivot lists"):
            views.pivot_views(rows, "title", ["q1"], [1998], ["asia"]).collect()
    with pytest.raises(ValueError):
        views.pivot_views(long, "title", ["q1"], [1998, 2098], ["asia"])


def test_model_queries_train_the_stated_tree_counts(spark, monkeypatch):
    """1350 trees per model and 100 for the causes, as in the original."""
    from tessera.plans import ml_q

    class Asked(Exception):
        pass

    def train(rows, trees=None, **how):
        raise Asked(trees)

    def causes(*args, trees=None, **how):
        raise Asked(trees)

    monkeypatch.setattr(ml, "train_ensemble", train)
    monkeypatch.setattr(ml, "causation", causes)
    asked = {}
    for name in ("ensemble_train", "rf_importance", "conformal", "causes_ranked"):
        try:
            ml_q.QUERIES[name](spark, "/root/testdata/sf0.001")
        except Asked as e:
            asked[name] = e.args[0]
    assert asked == {"ensemble_train": 1350, "rf_importance": 1350, "conformal": 1350, "causes_ranked": 100}


def test_conformal_rank_is_exact_beyond_a_sketch(spark):
    n = 1_000_003
    x = (F.col("id") * 7919) % n  # every whole number below n once
    calib = spark.range(n).select(F.pow(x.cast("double"), F.lit(1.5)).alias("label"), F.lit(0.0).alias("ensemble"))
    for level in (0.9, 0.5):
        q = ml.conformal_intervals(calib, calib.limit(1), level=level).first().q
        assert round(q ** (2 / 3)) == math.ceil((n + 1) * level) - 1
