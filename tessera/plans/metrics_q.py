"""Bindings for model metrics.

Stand-in predictions are deterministic so the oracle is exact:
y = l_extendedprice; m1 = 1500 x l_quantity; m2 = p_retailprice x l_quantity;
m3 = o_totalprice / 4, present only for finished orders (status 'F') so the
ensemble renormalises on the other rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans.common import sig, sql_sig, table


def _scored(spark, sf_dir, with_segment=False):
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    od = table(spark, sf_dir, "orders")
    df = (li.join(pa, li.l_partkey == pa.p_partkey)
            .join(od, li.l_orderkey == od.o_orderkey))
    if with_segment:
        cu = table(spark, sf_dir, "customer")
        df = df.join(cu, df.o_custkey == cu.c_custkey)
    df = df.select(
        "*",
        (F.lit(1500.0) * F.col("l_quantity")).alias("m1"),
        (F.col("p_retailprice") * F.col("l_quantity")).alias("m2"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 4).alias("m3"))
    return df.withColumn("ensemble", metrics.ensemble_prediction(
        {"m1": "m1", "m2": "m2", "m3": "m3"}))


def ensemble_metrics(spark, sf_dir):
    df = _scored(spark, sf_dir)
    out = metrics.model_metrics(df, "l_extendedprice", ["m1", "m2", "m3", "ensemble"])
    return out.select("model", "n", sig("mape").alias("mape"), sig("r2").alias("r2"))


def mape_by_segment(spark, sf_dir):
    df = _scored(spark, sf_dir, with_segment=True).withColumn(
        "order_year", F.year("o_orderdate").cast("long"))
    out = metrics.regression_metrics(df, "l_extendedprice", "ensemble", ["c_mktsegment", "order_year"])
    return out.select("c_mktsegment", "order_year", "n", sig("mape").alias("mape"), sig("r2").alias("r2"))


QUERIES = {"ensemble_metrics": ensemble_metrics, "mape_by_segment": mape_by_segment}

_SCORED = """
SELECT *,
  CASE WHEN den <= 0 THEN NULL WHEN den < 1.0 THEN num / den ELSE num END AS ensemble
FROM (
  SELECT *,
    0.52 * m1 + 0.35 * m2 + CASE WHEN m3 IS NOT NULL THEN 0.13 * m3 ELSE 0.0 END AS num,
    0.52 + 0.35 + CASE WHEN m3 IS NOT NULL THEN 0.13 ELSE 0.0 END AS den
  FROM (
    SELECT l.*, p.*, o.*{extra},
      1500.0 * l_quantity AS m1,
      p_retailprice * l_quantity AS m2,
      CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 4 END AS m3
    FROM lineitem l JOIN part p ON l_partkey = p_partkey
    JOIN orders o ON l_orderkey = o_orderkey{join}
  ) a
) b
"""


def _metric_cols(y, p):
    return (f"count({p}) AS n, "
            f"avg(CASE WHEN {y} <> 0 AND {p} IS NOT NULL THEN abs(({y} - {p}) / {y}) END) * 100.0 AS mape, "
            f"CASE WHEN var_pop(CASE WHEN {p} IS NOT NULL THEN {y} END) * count(CASE WHEN {p} IS NOT NULL THEN {y} END) > 0 "
            f"THEN 1.0 - sum(CASE WHEN {p} IS NOT NULL THEN ({y} - {p}) * ({y} - {p}) END) / "
            f"(var_pop(CASE WHEN {p} IS NOT NULL THEN {y} END) * count(CASE WHEN {p} IS NOT NULL THEN {y} END)) "
            f"WHEN count(CASE WHEN {p} IS NOT NULL THEN {y} END) > 0 THEN 0.0 END AS r2")


def _ensemble_sql():
    base = _SCORED.format(extra="", join="")
    arms = " UNION ALL ".join(
        f"SELECT '{m}' AS model, {_metric_cols('l_extendedprice', m)} FROM s" for m in
        ["m1", "m2", "m3", "ensemble"])
    return (f"WITH s AS ({base}) SELECT model, n, {sql_sig('mape')} AS mape, {sql_sig('r2')} AS r2 "
            f"FROM ({arms}) x")


def _segment_sql():
    base = _SCORED.format(extra=", c.*", join=" JOIN customer c ON o_custkey = c_custkey")
    return (f"WITH s AS ({base}) SELECT c_mktsegment, order_year, n, {sql_sig('mape')} AS mape, "
            f"{sql_sig('r2')} AS r2 FROM (SELECT c_mktsegment, CAST(year(o_orderdate) AS BIGINT) AS order_year, "
            f"{_metric_cols('l_extendedprice', 'ensemble')} FROM s GROUP BY 1, 2) x")


ORACLE = {"ensemble_metrics": _ensemble_sql(), "mape_by_segment": _segment_sql()}
