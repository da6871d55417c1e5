import pytest
from pyspark.sql import functions as F

from tessera.operators import profile


def test_variance_null_handling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    z = {r.feature: r.variance for r in profile.feature_variance(df, ["x"]).collect()}
    i = {r.feature: r.variance for r in profile.feature_variance(df, ["x"], nulls="ignore").collect()}
    assert z["x"] == pytest.approx(2.0)
    assert i["x"] == pytest.approx(1.25)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    v = profile.feature_variance(df, ["x"]).first().variance
    assert v == pytest.approx(((1 - 4 / 3) ** 2 + (4 / 3) ** 2 + (3 - 4 / 3) ** 2) / 3)


def test_exclusion_and_numeric_only(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3.0, True)],
                               "fc_uid long, title string, Views_Y double, views_h1_24_us double, b boolean")
    assert profile.feature_columns(df) == ["views_h1_24_us"]
    assert profile.feature_columns(df, target="views_h1_24_us") == []


def test_topk_ties_by_name_and_threshold(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0, 0.0), (3.0, 3.0, 5.0, 0.1)], "b double, a double, c double, d double")
    top = profile.select_top_variance(profile.feature_variance(df, ["b", "a", "c", "d"]), top_n=10).collect()
    assert [r.feature for r in top] == ["a", "b"]  # c constant, d below 0.01


def test_empty_input(spark):
    df = spark.createDataFrame([], "x double, y double")
    out = profile.select_top_variance(profile.feature_variance(df, ["x", "y"]))
    assert out.count() == 0
    assert out.columns == ["feature", "variance"]


@pytest.mark.parametrize("method", ["builtin", "gram"])
def test_pairwise_corr_with_nulls(spark, method):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 9.0), (None, 1.0)], "a double, b double")
    r = profile.correlation_long(df, ["a", "b"], method=method).first()
    assert r.n == 3
    assert r.r == pytest.approx(0.96312313730186, abs=1e-12)


@pytest.mark.parametrize("method", ["builtin", "gram"])
def test_constant_column_gives_null(spark, method):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "a double, b double")
    r = profile.correlation_long(df, ["a", "b"], method=method).first()
    assert r.r is None


@pytest.mark.parametrize("mode", ["pairwise", "zero_filled"])
def test_builtin_equals_gram(spark, mode):
    rows = [(float(i), float((i * 7) % 11), None if i % 5 == 0 else float(i * i % 13)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    a = {(r.f1, r.f2): r.r for r in profile.correlation_long(df, ["a", "b", "c"], mode=mode, method="builtin").collect()}
    b = {(r.f1, r.f2): r.r for r in profile.correlation_long(df, ["a", "b", "c"], mode=mode, method="gram").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)


def test_matrix_symmetric_unit_diagonal(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (2.0, 1.0, 1.0), (3.0, 7.0, 0.0)], "a double, b double, c double")
    feats = ["a", "b", "c"]
    m = {r.f1: r for r in profile.correlation_matrix(profile.correlation_long(df, feats), feats).collect()}
    for f in feats:
        assert m[f][f] == 1.0
    assert m["a"]["b"] == pytest.approx(m["b"]["a"])
    top = profile.high_correlation_pairs(profile.correlation_long(df, feats), threshold=0.0).collect()
    assert [abs(t.r) for t in top] == sorted((abs(t.r) for t in top), reverse=True)


def test_wide_table_in_column_groups(spark):
    n_cols = 250
    df = spark.range(40).select(*[((F.col("id") * (i + 1)) % 7).cast("double").alias(f"c{i}") for i in range(n_cols)])
    var = {r.feature: r.variance for r in profile.feature_variance(df, group_size=100).collect()}
    assert len(var) == n_cols
    import statistics
    for i in (0, 99, 100, 249):
        vals = [float((k * (i + 1)) % 7) for k in range(40)]
        assert var[f"c{i}"] == pytest.approx(statistics.pvariance(vals))


def test_gram_many_features_matches_builtin(spark):
    k = 30
    df = spark.range(300).select(*[F.when((F.col("id") + i) % 11 == 0, None)
                                   .otherwise(F.sin(F.col("id") * (i + 1))).alias(f"x{i}") for i in range(k)])
    feats = [f"x{i}" for i in range(k)]
    g = {(r.f1, r.f2): r.r for r in profile.correlation_long(df, feats, method="gram").collect()}
    b = {(r.f1, r.f2): r.r for r in profile.correlation_long(df, feats[:6], method="builtin").collect()}
    assert len(g) == k * (k - 1) // 2
    for key, v in b.items():
        assert g[key] == pytest.approx(v, abs=1e-10)


def test_wide_correlation_has_every_view_column(spark):
    """All 140 view columns of 7 years, so pairs across years too."""
    from tessera.plans import registry

    rows = registry()[0]["wide_correlation_all"](spark, "/root/testdata/sf0.001").collect()
    pairs = {(r.f1, r.f2) for r in rows}
    assert len(rows) == len(pairs) == 140 * 139 // 2
    assert len({c for p in pairs for c in p}) == 140
    assert ("views_q1_95_africa", "views_q4_01_asia") in pairs or ("views_q4_01_asia", "views_q1_95_africa") in pairs
    assert all(r.r is None or -1 <= r.r <= 1 for r in rows) and sum(r.r is not None for r in rows) > 8000


@pytest.mark.parametrize("mode", ["pairwise", "zero_filled"])
def test_tiles_merged_in_a_tree_equal_numpy(spark, mode):
    """Tile and fan-in far below the number of columns and tasks; NULLs, a constant and an empty column."""
    import numpy as np

    k, n = 11, 400
    x = np.random.default_rng(5).normal(1e6, 3.0, (n, k))
    x[:, 3], x[:, 7] = 4.0, np.nan
    x[np.random.default_rng(6).random((n, k)) < 0.2] = np.nan
    feats = [f"x{i}" for i in range(k)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in feats)).repartition(7)
    moments = {(r.i, r.j): r for r in profile._moments_gram(
        df, feats, "zero" if mode == "zero_filled" else "pairwise", tile=4, fan_in=2).collect()}
    assert set(moments) == {(i, j) for i in range(k) for j in range(i + 1, k)}
    y = np.nan_to_num(x) if mode == "zero_filled" else x
    for (i, j), r in moments.items():
        both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
        a, b = y[both, i], y[both, j]
        assert r.n == both.sum()
        if r.n:
            assert r.mx == pytest.approx(a.mean()) and r.my == pytest.approx(b.mean())
            assert r.m2x == pytest.approx(((a - a.mean()) ** 2).sum(), rel=1e-9, abs=1e-3)
            assert r.cxy == pytest.approx(((a - a.mean()) * (b - b.mean())).sum(), rel=1e-6, abs=1e-3)


def test_tasks_write_one_row_per_tile(spark):
    feats = [f"x{i}" for i in range(130)]
    df = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(f) for i, f in enumerate(feats)]).repartition(5)
    got = profile.moment_tiles(df, feats, "pairwise").groupBy("part").count().collect()
    assert len(got) == 5 and {r["count"] for r in got} == {6}  # 3 x 3 tiles, upper half, in place of 8385 pairs
    empty = profile.correlation_long(df.limit(0), feats[:6], method="gram").collect()
    assert len(empty) == 15 and all(r.n == 0 and r.r is None for r in empty)
