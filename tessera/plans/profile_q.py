"""Bindings for feature profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile
from tessera.plans.common import sig, sql_sig, table

# lineitem stands in for the wide title table: its keys and line number are
# identifiers, not features.
LINEITEM_EXCLUDE = profile.DEFAULT_EXCLUDE_PATTERNS + ["key", "linenumber"]
CORR_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "p_size", "p_retailprice", "o_totalprice", "l_netprice", "l_grossprice"]
# Derived features (revenue after discount, and after tax) give the threshold
# filter pairs on both sides of 0.8.
NET = "l_extendedprice * (1 - l_discount)"
GROSS = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


def feature_variance_topk(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    feats = profile.feature_columns(li, LINEITEM_EXCLUDE)
    var = profile.feature_variance(li, feats)
    top = profile.select_top_variance(var)
    return top.select("feature", sig("variance", 12).alias("variance"))


def _corr_input(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    od = table(spark, sf_dir, "orders")
    return (li.join(pa, li.l_partkey == pa.p_partkey)
              .join(od, li.l_orderkey == od.o_orderkey)
              .withColumn("l_netprice", F.expr(NET))
              .withColumn("l_grossprice", F.expr(GROSS))
              .select(*CORR_FEATURES))


def correlation_long(spark, sf_dir):
    corr = profile.correlation_long(_corr_input(spark, sf_dir), sorted(CORR_FEATURES))
    return corr.select("f1", "f2", "n", sig("r").alias("r"))


def correlation_long_gram(spark, sf_dir):
    corr = profile.correlation_long(_corr_input(spark, sf_dir), sorted(CORR_FEATURES), method="gram")
    return corr.select("f1", "f2", "n", sig("r", 9).alias("r"))


def correlation_pairs(spark, sf_dir):
    corr = profile.correlation_long(_corr_input(spark, sf_dir), sorted(CORR_FEATURES))
    pairs = profile.high_correlation_pairs(corr)
    return pairs.select("f1", "f2", sig("r").alias("r"), sig("abs_r").alias("abs_r"))


def correlation_zero_filled(spark, sf_dir):
    corr = profile.correlation_long(_corr_input(spark, sf_dir), sorted(CORR_FEATURES),
                                    mode="zero_filled")
    return corr.select("f1", "f2", "n", sig("r", 9).alias("r"))


def correlation_matrix(spark, sf_dir):
    feats = sorted(CORR_FEATURES)
    corr = profile.correlation_long(_corr_input(spark, sf_dir), feats)
    m = profile.correlation_matrix(corr.select("f1", "f2", sig("r").alias("r")), feats)
    return m


QUERIES = {
    "correlation_matrix": correlation_matrix,
    "feature_variance_topk": feature_variance_topk,
    "correlation_long": correlation_long,
    "correlation_long_gram": correlation_long_gram,
    "correlation_pairs": correlation_pairs,
    "correlation_zero_filled": correlation_zero_filled,
}


def _variance_sql():
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    arms = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, var_pop(coalesce(CASE WHEN isnan({c}) THEN 0.0 ELSE {c} END, 0.0)) "
        f"AS variance FROM lineitem" for c in feats)
    return (f"SELECT feature, {sql_sig('variance', 12)} AS variance FROM ({arms}) v "
            f"WHERE variance >= 0.01 AND NOT isnan(variance) "
            f"ORDER BY variance DESC, feature LIMIT 200")


_CORR_FROM = (f"FROM (SELECT *, {NET} AS l_netprice, {GROSS} AS l_grossprice "
              f"FROM lineitem JOIN part ON l_partkey = p_partkey "
              f"JOIN orders ON l_orderkey = o_orderkey) j")


def _pairs():
    f = sorted(CORR_FEATURES)
    return [(a, b) for i, a in enumerate(f) for b in f[i + 1:]]


def _corr_sql(digits=10):
    arms = " UNION ALL ".join(
        f"SELECT '{a}' AS f1, '{b}' AS f2, count({a} + {b}) AS n, "
        f"CASE WHEN var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 "
        f"AND var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 THEN corr({a}, {b}) END AS r {_CORR_FROM}"
        for a, b in _pairs())
    return f"SELECT f1, f2, n, {sql_sig('r', digits)} AS r FROM ({arms}) c"


def _corr_pairs_sql():
    return (f"SELECT f1, f2, {sql_sig('r')} AS r, {sql_sig('abs(r)')} AS abs_r FROM ({_corr_sql(12)}) c "
            f"WHERE abs(r) >= 0.8 ORDER BY abs(r) DESC, f1, f2")


def _corr_zero_sql():
    arms = []
    for a, b in _pairs():
        za, zb = f"coalesce({a}, 0.0)", f"coalesce({b}, 0.0)"
        arms.append(
            f"SELECT '{a}' AS f1, '{b}' AS f2, count(*) AS n, "
            f"covar_pop({za}, {zb}) / ((stddev_pop({za}) + 1e-8) * (stddev_pop({zb}) + 1e-8)) AS r "
            f"{_CORR_FROM}")
    return f"SELECT f1, f2, n, {sql_sig('r', 9)} AS r FROM ({' UNION ALL '.join(arms)}) c"


def _matrix_sql():
    f = sorted(CORR_FEATURES)
    long = _corr_sql()
    full = (f"SELECT f1, f2, r FROM ({long}) a UNION ALL SELECT f2, f1, r FROM ({long}) b "
            + " ".join(f"UNION ALL SELECT '{x}', '{x}', 1.0" for x in f))
    cols = ", ".join(f"max(CASE WHEN f2 = '{x}' THEN r END) AS {x}" for x in f)
    return f"SELECT f1, {cols} FROM ({full}) m GROUP BY f1"


ORACLE = {
    "correlation_matrix": _matrix_sql(),
    "feature_variance_topk": _variance_sql(),
    "correlation_long": _corr_sql(),
    "correlation_long_gram": _corr_sql(9),
    "correlation_pairs": _corr_pairs_sql(),
    "correlation_zero_filled": _corr_zero_sql(),
}
