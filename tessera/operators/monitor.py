"""Health score and tier usage.

A15 (re-aimed): the original scores one cache snapshot. Here the same ladder
runs per group (e.g. day) over the access log: hit-rate points 40/30/20/10
(> 0.8, > 0.5, > 0.3), int(active share x 30) where the share is components
active in the group over components registered (seen anywhere in the log),
coverage points 30/20/10 from distinct keys seen (> 15, > 10); status > 70
healthy, > 40 degraded, else critical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score ladders and status cut-offs.
HIT_RATE_STEPS = [(0.8, 40), (0.5, 30), (0.3, 20)]
HIT_RATE_FLOOR = 10
COVERAGE_STEPS = [(15, 30), (10, 20)]
COVERAGE_FLOOR = 10
HEALTHY, DEGRADED = 70, 40


def _ladder(x: Column, steps, floor_points) -> Column:
    expr = None
    for cut, pts in steps:
        cond = x > cut
        expr = F.when(cond, F.lit(pts)) if expr is None else expr.when(cond, F.lit(pts))
    return expr.otherwise(F.lit(floor_points))


def health_score(log: DataFrame, group_cols: list[str], hit: Column, component: str, key: str) -> DataFrame:
    """Per group: hit rate, active share, distinct keys, score and status."""
    registered = log.agg(F.count_distinct(component)).scalar()  # scalar subquery
    g = log.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(hit).alias("hits"),
        F.count_distinct(component).alias("active"), F.count_distinct(key).alias("keys"))
    g = g.withColumn("registered", registered)
    rate = F.col("hits") / F.greatest(F.col("requests"), F.lit(1))
    share = F.col("active") / F.greatest(F.col("registered"), F.lit(1))
    score = (_ladder(rate, HIT_RATE_STEPS, HIT_RATE_FLOOR) + F.floor(share * 30).cast("int")
             + _ladder(F.col("keys"), COVERAGE_STEPS, COVERAGE_FLOOR)).cast("long")
    status = (F.when(score > HEALTHY, F.lit("healthy")).when(score > DEGRADED, F.lit("degraded"))
               .otherwise(F.lit("critical")))
    return g.select(*group_cols, "requests", "hits", "keys", rate.alias("hit_rate"),
                    share.alias("active_share"), score.alias("score"), status.alias("status"))


def tier_usage(entries: DataFrame, capacity: dict, tier: str = "tier", size: str = "size_bytes") -> DataFrame:
    """Bytes and entries per tier and utilisation % of its capacity."""
    cap = entries.sparkSession.createDataFrame(list(capacity.items()), f"{tier} string, capacity double")
    g = entries.groupBy(tier).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("entries"))
    return g.join(F.broadcast(cap), tier, "left").select(
        tier, "bytes", "entries",
        F.try_divide(F.col("bytes") * 100, F.col("capacity")).alias("utilisation_pct"))
