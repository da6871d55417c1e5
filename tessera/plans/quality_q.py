"""Bindings for quality gates, run summaries, health and tier usage.

Checks: completeness of orders and lineitem (DATA_BREAKDOWN), temporal
violations (VALIDATION_BREACH), variance of the selected features is finite
(COMPUTE_HALT), audit chain verifies (SECURITY_FAILURE).
Runs: events per (user_id, day); an 'error' event is a failed phase.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import access, monitor, profile, quality, views
from tessera.plans.common import sig, sql_sig, table
from tessera.plans import access_q, audit_q, views_q


def _registry(spark, sf_dir):
    reg = quality.CheckRegistry()
    od, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    reg.register("DATA_BREAKDOWN", "orders_complete",
                 lambda: quality.completeness_checks(od, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]))
    reg.register("DATA_BREAKDOWN", "lineitem_complete",
                 lambda: quality.completeness_checks(li, "lineitem", ["l_orderkey", "l_quantity", "l_shipdate"]))
    reg.register("VALIDATION_BREACH", "temporal",
                 lambda: quality.violation_check(views.temporal_violations(views_q._temporal(spark, sf_dir))))
    reg.register("COMPUTE_HALT", "variance_finite", lambda: profile.feature_variance(li, ["l_quantity", "l_extendedprice"])
                 .agg(F.bool_and(~F.isnan("variance")).alias("ok"), F.lit("variance computed").alias("message")))
    reg.register("SECURITY_FAILURE", "audit_chain", lambda: audit_q.audit_verify(spark, sf_dir)
                 .agg((F.sum("breaks") == 0).alias("ok"),
                      F.concat(F.lit("audit breaks: "), F.sum("breaks").cast("string")).alias("message")))
    return reg


def quality_checks(spark, sf_dir):
    return _registry(spark, sf_dir).check_table(spark)


def quality_gate(spark, sf_dir):
    return quality.gate_summary(_registry(spark, sf_dir).check_table(spark))


def null_zero_profile(spark, sf_dir):
    li, od = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    t = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.year("o_orderdate").alias("start_year"), F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("views"), "l_discount", "l_tax")
    return quality.null_zero_profile(views.temporal_mask(t), ["views", "l_discount", "l_tax"])


def run_summary(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    rid = F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
    out = quality.run_summary(ev, rid, "ts", F.col("event_type") != "error",
                              F.concat(F.col("event_type"), F.lit("#"), F.col("event_id").cast("string")))
    return out


def health_score(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "user_id", F.get_json_object("props", "$.k").alias("key"), "event_type")
    out = monitor.health_score(ev, ["day"], F.col("event_type").isin("view", "click", "signup"), "user_id", "key")
    return out.select("day", "requests", "hits", "keys", sig("hit_rate").alias("hit_rate"),
                      sig("active_share").alias("active_share"), "score", "status")


def tier_usage(spark, sf_dir):
    tiers = access.tier_table(access_q._tier_counts(spark, sf_dir))
    cap = {"L1_HOT": 5000.0, "L2_WARM": 20000.0, "L3_COLD": 80000.0, "UNCACHED": None}
    out = monitor.tier_usage(tiers, cap)
    return out.select("tier", sig("bytes").alias("bytes"), "entries", sig("utilisation_pct").alias("utilisation_pct"))


QUERIES = {
    "quality_checks": quality_checks, "quality_gate": quality_gate, "null_zero_profile": null_zero_profile,
    "run_summary": run_summary, "health_score": health_score, "tier_usage": tier_usage,
}

_TEMPORAL_N = """(SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE year(l_shipdate) < year(o_orderdate))"""

def _completeness(tbl, cols):
    parts = [f"SELECT 'DATA_BREAKDOWN' AS mode, '{tbl}_complete' AS \"check\", count(*) > 0 AS ok, "
             f"'{tbl} rows: ' || count(*) AS message FROM {tbl}"]
    for c in cols:
        parts.append(f"SELECT 'DATA_BREAKDOWN', '{tbl}_complete', coalesce(count(*) FILTER (WHERE {c} IS NULL) "
                     f"/ count(*), 0.0) <= 0.0, '{tbl}.{c} nulls: ' || count(*) FILTER (WHERE {c} IS NULL) FROM {tbl}")
    return " UNION ALL ".join(parts)


_AUDIT_BREAKS = "(SELECT sum(breaks) FROM (" + audit_q.ORACLE["audit_verify"] + "))"

_CHECK_SQL = (
    _completeness("orders", ["o_orderkey", "o_custkey", "o_orderdate"]) + " UNION ALL " +
    _completeness("lineitem", ["l_orderkey", "l_quantity", "l_shipdate"]) + " UNION ALL " +
    f"""SELECT 'VALIDATION_BREACH', 'temporal', {_TEMPORAL_N} = 0,
      CASE WHEN {_TEMPORAL_N} > 0 THEN 'Temporal violations: ' || {_TEMPORAL_N} ELSE 'Temporal violations OK' END
    UNION ALL SELECT 'COMPUTE_HALT', 'variance_finite', true, 'variance computed'
    UNION ALL SELECT 'SECURITY_FAILURE', 'audit_chain', b = 0, 'audit breaks: ' || b FROM (SELECT {_AUDIT_BREAKS} AS b)""")

ORACLE = {
    "quality_checks": _CHECK_SQL,
    "quality_gate": f"""WITH ch AS ({_CHECK_SQL}),
        m AS (SELECT * FROM (VALUES ('DATA_BREAKDOWN', 0), ('VALIDATION_BREACH', 1), ('COMPUTE_HALT', 2),
          ('SECURITY_FAILURE', 3)) t(mode, mode_order)),
        per AS (SELECT mode, bool_and(ok) AS ok, count(*) AS checks,
          coalesce(string_agg(message, '; ' ORDER BY "check", message) FILTER (WHERE NOT ok), '') AS failures
          FROM ch GROUP BY mode),
        full_ AS (SELECT m.mode, m.mode_order, coalesce(per.ok, true) AS ok, CAST(coalesce(per.checks, 0) AS BIGINT) AS checks,
          coalesce(per.failures, '') AS failures FROM m LEFT JOIN per ON m.mode = per.mode)
        SELECT mode, ok, checks, failures,
          (SELECT arg_min(mode, mode_order) FROM full_ WHERE NOT ok) AS first_failure FROM full_""",
    "null_zero_profile": """WITH t AS (SELECT CASE WHEN year(l_shipdate) >= year(o_orderdate) THEN l_quantity END AS views,
          l_discount, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT 'views' AS "column", count(*) AS rows, count(*) FILTER (WHERE views IS NULL) AS nulls,
          count(*) FILTER (WHERE views = 0) AS zeros FROM t
        UNION ALL SELECT 'l_discount', count(*), count(*) FILTER (WHERE l_discount IS NULL),
          count(*) FILTER (WHERE l_discount = 0) FROM t
        UNION ALL SELECT 'l_tax', count(*), count(*) FILTER (WHERE l_tax IS NULL), count(*) FILTER (WHERE l_tax = 0) FROM t""",
    "run_summary": """SELECT CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d') AS run_id,
        CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'COMPLETED' ELSE 'TERMINATED' END AS status,
        min(ts) AS start_time, max(ts) AS end_time, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 AS duration_ms,
        count(*) FILTER (WHERE event_type <> 'error') AS phases_completed, count(*) AS phases_total,
        arg_min(event_type || '#' || CAST(event_id AS VARCHAR), (ts, event_type || '#' || CAST(event_id AS VARCHAR)))
          FILTER (WHERE event_type = 'error') AS failure_phase
        FROM events GROUP BY 1""",
    "health_score": f"""WITH e AS (SELECT date_trunc('day', ts) AS day, user_id, json_extract_string(props, '$.k') AS key,
          event_type FROM events),
        reg AS (SELECT count(DISTINCT user_id) AS registered FROM e),
        g AS (SELECT day, count(*) AS requests, count(*) FILTER (WHERE event_type IN ('view', 'click', 'signup')) AS hits,
          count(DISTINCT user_id) AS active, count(DISTINCT key) AS keys FROM e GROUP BY day),
        s AS (SELECT g.*, hits / greatest(requests, 1) AS hit_rate, active / greatest(registered, 1) AS active_share
          FROM g, reg),
        sc AS (SELECT *, CAST((CASE WHEN hit_rate > 0.8 THEN 40 WHEN hit_rate > 0.5 THEN 30 WHEN hit_rate > 0.3 THEN 20
          ELSE 10 END) + CAST(floor(active_share * 30) AS INTEGER) + (CASE WHEN keys > 15 THEN 30 WHEN keys > 10 THEN 20
          ELSE 10 END) AS BIGINT) AS score FROM s)
        SELECT day, requests, hits, keys, {sql_sig('hit_rate')} AS hit_rate, {sql_sig('active_share')} AS active_share,
          score, CASE WHEN score > 70 THEN 'healthy' WHEN score > 40 THEN 'degraded' ELSE 'critical' END AS status
        FROM sc""",
    "tier_usage": access_q._TIERS + f""",
        cap AS (SELECT * FROM (VALUES ('L1_HOT', 5000.0), ('L2_WARM', 20000.0), ('L3_COLD', 80000.0),
          ('UNCACHED', NULL)) c(tier, capacity))
        SELECT t.tier, {sql_sig('sum(size_bytes)')} AS bytes, count(*) AS entries,
          {sql_sig('sum(size_bytes) * 100 / max(capacity)')} AS utilisation_pct
        FROM t LEFT JOIN cap ON t.tier = cap.tier GROUP BY t.tier""",
}
