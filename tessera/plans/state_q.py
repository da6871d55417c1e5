"""Bindings for EMA, circuit breaker, replica coherency and batch numbering.

EMA: events' value per event_type in (ts, event_id) order.
Breaker: per user, an 'error' event is a failure, others succeed.
Coherency: block = props.k, source = site_(user_id % 3) (the user's home
site), action by event type: signup = register, view = read, click = write,
purchase = update, error = sync.
Batches: orders by o_orderkey, 1000 per batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import state
from tessera.plans.common import sig, sql_sig, table


def latency_ema(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    out = state.ema_per_key(ev, "event_type", "ts", "event_id", "value")
    return out.select("event_type", "events", sig("ema").alias("ema"))


def breaker_states(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return state.breaker_states(ev, "user_id", "ts", "event_id", F.col("event_type") == "error")


def _coherency_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    action = (F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "view", "read")
               .when(F.col("event_type") == "click", "write").when(F.col("event_type") == "purchase", "update")
               .otherwise("sync"))
    return ev.select(F.get_json_object("props", "$.k").alias("block"),
                     F.concat(F.lit("site_"), (F.col("user_id") % 3).cast("string")).alias("source"),
                     "ts", "event_id", action.alias("action"))


def coherency_fold(spark, sf_dir):
    return state.coherency_state(_coherency_events(spark, sf_dir), "block", "source", "ts", "event_id")


def write_invalidations(spark, sf_dir):
    out = state.write_invalidations(_coherency_events(spark, sf_dir), "block", "source", "ts", "event_id")
    return out.select("block", "source", "event_id", "action",
                      F.array_join("invalidated", ",").alias("invalidated"))


def batch_assign(spark, sf_dir):
    od = table(spark, sf_dir, "orders").select("o_orderkey")
    return state.assign_batches(od, "o_orderkey", 1000, 10_000.0)


QUERIES = {
    "latency_ema": latency_ema,
    "breaker_states": breaker_states,
    "coherency_fold": coherency_fold,
    "write_invalidations": write_invalidations,
    "batch_assign": batch_assign,
}

_COH = """WITH e AS (SELECT json_extract_string(props, '$.k') AS block, 'site_' || CAST(user_id % 3 AS VARCHAR) AS source,
  ts, event_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'read' WHEN 'click' THEN 'write'
  WHEN 'purchase' THEN 'update' ELSE 'sync' END AS action FROM events),
c AS (SELECT block, source,
  arg_max(action, (ts, event_id)) FILTER (WHERE action <> 'read') AS last_action,
  max((ts, event_id)) FILTER (WHERE action <> 'read') AS last_own,
  max((ts, event_id)) FILTER (WHERE action = 'register') AS last_register,
  max((ts, event_id)) FILTER (WHERE action = 'read') AS last_read,
  max((ts, event_id)) FILTER (WHERE action IN ('write', 'update')) AS last_wu
  FROM e GROUP BY block, source),
o AS (SELECT c1.block, c1.source, max(c2.last_wu) AS other FROM c c1 LEFT JOIN c c2
  ON c1.block = c2.block AND c1.source <> c2.source GROUP BY c1.block, c1.source),
u AS (SELECT e.block, e.source, count(*) AS updates FROM e JOIN c ON e.block = c.block AND e.source = c.source
  WHERE e.action = 'update' AND (c.last_register IS NULL OR (e.ts, e.event_id) > c.last_register)
  GROUP BY e.block, e.source)
SELECT c.block, c.source,
  CASE WHEN o.other IS NOT NULL AND o.other > c.last_own THEN 'INVALID'
       WHEN last_action IN ('write', 'update') THEN 'MODIFIED'
       WHEN last_action = 'sync' THEN 'SHARED'
       WHEN last_read > last_own THEN 'SHARED' ELSE 'EXCLUSIVE' END AS state,
  CAST(1 + coalesce(u.updates, 0) AS BIGINT) AS version, c.last_own[1] AS last_ts
FROM c JOIN o ON c.block = o.block AND c.source = o.source
LEFT JOIN u ON c.block = u.block AND c.source = u.source WHERE c.last_own IS NOT NULL"""

_INVAL = """WITH e AS (SELECT json_extract_string(props, '$.k') AS block, 'site_' || CAST(user_id % 3 AS VARCHAR) AS source,
  ts, event_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'read' WHEN 'click' THEN 'write'
  WHEN 'purchase' THEN 'update' ELSE 'sync' END AS action FROM events),
r AS (SELECT *,""" + ",".join(
    f"""
  max((ts, event_id)) FILTER (WHERE source = 'site_{i}' AND action <> 'read') OVER w AS own{i},
  max((ts, event_id)) FILTER (WHERE source <> 'site_{i}' AND action IN ('write', 'update')) OVER w AS oth{i}"""
    for i in range(3)) + """
  FROM e WINDOW w AS (PARTITION BY block ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT block, source, event_id, action, array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN source <> 'site_{i}' AND own{i} IS NOT NULL AND (oth{i} IS NULL OR oth{i} < own{i}) THEN 'site_{i}' END"
    for i in range(3)) + """], lambda v: v IS NOT NULL), ',') AS invalidated
FROM r WHERE action IN ('write', 'update')"""

ORACLE = {
    "write_invalidations": _INVAL,
    "latency_ema": f"""SELECT event_type, count(*) AS events,
        {sql_sig("list_reduce(list_prepend(0.0, list(value ORDER BY ts, event_id)), lambda acc, x: 0.1 * x + 0.9 * acc)")} AS ema
        FROM events GROUP BY event_type""",
    "breaker_states": """WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        f AS (SELECT *, max(CASE WHEN NOT failed THEN rn END) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_success_rn,
          lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts FROM e),
        g AS (SELECT *, rn - 1 - coalesce(last_success_rn, 0) AS failures_before FROM f)
        SELECT user_id, event_id, ts, failed,
          CASE WHEN failures_before >= 3 THEN CASE WHEN (epoch_us(ts) - epoch_us(prev_ts)) / 1000000 > 300
               THEN 'HALF-OPEN' ELSE 'OPEN' END ELSE 'CLOSED' END AS state_before,
          CAST(CASE WHEN failed THEN failures_before + 1 ELSE 0 END AS BIGINT) AS failures,
          CASE WHEN failed AND failures_before + 1 >= 3 THEN 'OPEN' ELSE 'CLOSED' END AS state_after
        FROM g""",
    "coherency_fold": _COH,
    "batch_assign": """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn,
        CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS batch_id FROM orders""",
}
