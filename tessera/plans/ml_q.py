"""ML bindings (rows-only checks: model training has no SQL twin).

Training rows: lineitem joined with part; target = the first of
['views_y', 'l_extendedprice'] that exists (l_extendedprice here); features:
quantity, discount, tax, part size, retail price. Tree counts are the
original's: at most 1350 per model (the stopping rules are ``ml``'s, the README has
their loss against all trees), 100 for the causes. ``ensemble_train``,
``rf_importance`` and ``conformal`` share one stored training.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ml
from tessera.plans.common import sig, sql_sig, table

FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
TARGETS = ["views_y", "l_extendedprice"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
TREES = 1350
CAUSE_TREES = 100


def _rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    return li.join(pa, li.l_partkey == pa.p_partkey).select(*KEYS, *FEATURES, "l_extendedprice")


def _split(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    target = ml.resolve_target(rows, TARGETS)
    # by the row's keys: a recomputed partition puts every row on the same side again
    side = F.pmod(F.xxhash64(*KEYS, F.lit(ml.SEED)), F.lit(100))
    train, hold = (ml.training_frame(rows.where(part), FEATURES, target, key_cols=KEYS, together=True)
                   for part in (side < 80, side >= 80))
    return train.cache(), hold


def sample_hash(spark, sf_dir):
    return ml.hash_sample(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], 5000)


def causes_ranked(spark, sf_dir):
    return ml.causation(_rows(spark, sf_dir), FEATURES, TARGETS, KEYS, trees=CAUSE_TREES)


def ensemble_train(spark, sf_dir):
    train, hold = _split(spark, sf_dir)
    fitted = ml.train_ensemble(train, TREES)
    out = ml.evaluate(ml.score(fitted, train), "train").unionByName(ml.evaluate(ml.score(fitted, hold), "holdout"))
    return out.select("split", "model", "n", "mape", "r2")


def rf_importance(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    fitted = ml.train_ensemble(train, TREES, models=("m3",))
    return ml.importances(fitted["m3"], FEATURES, spark)


def conformal(spark, sf_dir):
    train, hold = _split(spark, sf_dir)
    fitted = ml.train_ensemble(train, TREES, models=("m3",))
    half = F.pmod(F.xxhash64("row_key", F.lit(ml.SEED)), F.lit(2)) == 0  # same halves after recomputation
    calib, test = hold.where(half), hold.where(~half)
    iv = ml.conformal_intervals(ml.score(fitted, calib), ml.score(fitted, test))
    return iv.agg(F.count(F.lit(1)).alias("rows"),
                  F.avg(((F.col("label") >= F.col("lower")) & (F.col("label") <= F.col("upper"))).cast("double"))
                   .alias("coverage"),
                  F.avg(F.col("upper") - F.col("lower")).alias("avg_width"))


def granger(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    daily = ev.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return ml.granger(daily, "event_type", "day", "v", max_lag=4)


def granger_lag1(spark, sf_dir):
    """The Granger F test with one lag (same code path as ``granger``): with one
    lag the statistic has a closed form, so SQL can check it."""
    ev = table(spark, sf_dir, "events")
    daily = ev.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    g = ml.granger(daily, "event_type", "day", "v", max_lag=1)
    return g.select("x", "y", "n", sig("f_stat", 8).alias("f_stat"), "df1", "df2")


def granger_lag4(spark, sf_dir):
    """The statistics of ``granger``; SQL takes them from a chain of orthogonal variables."""
    return granger(spark, sf_dir).select("x", "y", "n", sig("f_stat", 6).alias("f_stat"), "df1", "df2")


def _granger_sql(lags: int) -> str:
    """Gram-Schmidt in SQL: v0 is y, then y's lags, then x's; every step takes one variable out of the later ones."""
    names = [f"y{k}" for k in range(1, lags + 1)] + [f"x{k}" for k in range(1, lags + 1)]
    lag = "".join(f" JOIN d {v} ON {v}.g = p.{v[0]} AND {v}.day = p.day - {v[1:]}" for v in names)
    ctes = [f"""WITH d AS (SELECT event_type AS g, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL),
p AS (SELECT a.g AS x, b.g AS y, b.day, b.v FROM d a JOIN d b ON a.day = b.day AND a.g <> b.g),
z AS (SELECT p.x, p.y, p.day, p.v AS v0, {', '.join(f'{v}.v AS {v}' for v in names)} FROM p{lag}),
o0 AS (SELECT x, y, day, {', '.join(f'{v} - avg({v}) OVER w AS {v}' for v in ['v0', *names])} FROM z
  WINDOW w AS (PARTITION BY x, y))"""]
    left = list(names)
    for i, v in enumerate(names):
        left = [u for u in left if u != v]
        out = ", ".join(f"{u} - {v} * (sum({u} * {v}) OVER w) / (sum({v} * {v}) OVER w) AS {u}" for u in ["v0", *left])
        ctes.append(f"o{i + 1} AS (SELECT x, y, day, {out} FROM o{i} WINDOW w AS (PARTITION BY x, y))")
    return ",\n".join(ctes) + f""",
r AS (SELECT x, y, count(*) AS n, sum(v0 * v0) AS rss_r FROM o{lags} GROUP BY x, y),
f AS (SELECT x, y, sum(v0 * v0) AS rss_f FROM o{2 * lags} GROUP BY x, y)
SELECT r.x, r.y, n, {sql_sig(f'((rss_r - rss_f) / {lags}) / (rss_f / (n - {2 * lags + 1}))', 6)} AS f_stat,
  CAST({lags} AS BIGINT) AS df1, CAST(n - {2 * lags + 1} AS BIGINT) AS df2 FROM r JOIN f ON r.x = f.x AND r.y = f.y"""


QUERIES = {
    "granger_lag1": granger_lag1, "granger_lag4": granger_lag4,
    "sample_hash": sample_hash, "causes_ranked": causes_ranked, "ensemble_train": ensemble_train,
    "rf_importance": rf_importance, "conformal": conformal, "granger": granger,
}
_GRANGER1 = """WITH d AS (SELECT event_type AS g, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL),
p AS (SELECT a.g AS x, b.g AS y, a.day, a.v AS xv, b.v AS yv FROM d a JOIN d b ON a.day = b.day AND a.g <> b.g),
l AS (SELECT x, y, yv, lag(yv) OVER w AS y1, lag(xv) OVER w AS x1 FROM p WINDOW w AS (PARTITION BY x, y ORDER BY day)),
m AS (SELECT x, y, count(*) AS n, var_pop(yv) AS vy, var_pop(y1) AS v1, var_pop(x1) AS v2, covar_pop(y1, x1) AS c12,
  covar_pop(yv, y1) AS b1, covar_pop(yv, x1) AS b2 FROM l WHERE y1 IS NOT NULL GROUP BY x, y),
r AS (SELECT *, n * (vy - b1 * b1 / v1) AS rss_r,
  n * (vy - (v2 * b1 * b1 - 2 * c12 * b1 * b2 + v1 * b2 * b2) / (v1 * v2 - c12 * c12)) AS rss_f FROM m)
"""

ORACLE = {
    "granger_lag1": _GRANGER1 + f"""SELECT x, y, n, {sql_sig('(rss_r - rss_f) / (rss_f / (n - 3))', 8)} AS f_stat,
        CAST(1 AS BIGINT) AS df1, CAST(n - 3 AS BIGINT) AS df2 FROM r""",
    "granger_lag4": _granger_sql(4),
    "sample_hash": """SELECT * FROM lineitem ORDER BY
        CAST('0x' || substr(md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|'
          || CAST(l_partkey AS VARCHAR)), 1, 15) AS BIGINT), l_orderkey, l_linenumber, l_partkey LIMIT 5000""",
}
