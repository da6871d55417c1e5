"""Model quality: weighted ensemble, MAPE, R2, grouped MAPE.

All metrics are algebraic aggregates, so Spark computes them map-side partial
and shuffles one row per task and group. SStot is ``n * var_pop(y)`` (a
numerically stable built-in) rather than sum(y^2) - sum(y)^2 / n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ensemble weights of the three models, in model order.
ENSEMBLE_WEIGHTS = {"m1": 0.52, "m2": 0.35, "m3": 0.13}


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def ensemble_prediction(preds: dict, weights: dict = ENSEMBLE_WEIGHTS) -> Column:
    """M4 + A22: weighted sum of the predictions that exist.

    A model without a prediction for the row (NULL) drops out; when the weights
    of the models present sum to less than 1 the sum is renormalised by them.
    NULL when no model has a prediction.
    """
    num = None
    den = None
    for name, p in preds.items():
        w = F.lit(float(weights[name]))
        pc = _col(p)
        term = F.when(pc.isNotNull(), w * pc).otherwise(F.lit(0.0))
        wt = F.when(pc.isNotNull(), w).otherwise(F.lit(0.0))
        num = term if num is None else num + term
        den = wt if den is None else den + wt
    return (F.when(den <= 0, F.lit(None).cast("double"))
             .when(den < 1.0, num / den)
             .otherwise(num))


def mape_expr(y, p) -> Column:
    """A5 + P8: mean |(y - p) / y| x 100 over rows with y != 0 (NULL if none)."""
    y, p = _col(y), _col(p)
    ok = (y != 0) & p.isNotNull()
    return F.avg(F.when(ok, F.abs((y - p) / y))) * F.lit(100.0)


def r2_expr(y, p) -> Column:
    """1 - SSres / SStot over rows with a prediction; 0 when SStot = 0."""
    y, p = _col(y), _col(p)
    yk = F.when(p.isNotNull(), y)
    ss_res = F.sum(F.when(p.isNotNull(), (y - p) * (y - p)))
    ss_tot = F.var_pop(yk) * F.count(yk)
    return F.when(ss_tot > 0, F.lit(1.0) - ss_res / ss_tot).when(F.count(yk) > 0, F.lit(0.0))


def regression_metrics(df: DataFrame, label: str, prediction: str,
                       group_cols: list[str] | None = None) -> DataFrame:
    """``(group..., n, mape, r2)`` per group (M9 when grouped)."""
    group_cols = group_cols or []
    p = F.col(prediction)
    aggs = [F.count(p).alias("n"), mape_expr(label, prediction).alias("mape"),
            r2_expr(label, prediction).alias("r2")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def model_metrics(df: DataFrame, label: str, preds: list[str],
                  group_cols: list[str] | None = None) -> DataFrame:
    """Metrics of several prediction columns at once, long form ``(model, ...)``.

    Rows are exploded to one (model, prediction) pair per model; the aggregate
    stays partial map-side, so only (#models x #groups) rows per task shuffle.
    """
    group_cols = group_cols or []
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p"))
                                for m in preds])).alias("mp")
    long = df.select(*group_cols, F.col(label).cast("double").alias("y"), pairs).select(
        *group_cols, "y", "mp.model", "mp.p")
    return regression_metrics(long, "y", "p", group_cols + ["model"])
