"""Bindings for access-log analytics on ``events``.

key = props.k, component = user_id, ts = ts, tie-break = event_id.
Transitions: source = event_type, target = props.k. Cache levels: view = L1,
click = L2, signup = L3 hit, other types miss. Tier keys: event_type:k with
size = sum(value). Operations: view = read, purchase = write, signup = sync.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import access
from tessera.plans.common import sig, sql_sig, table

def K():
    """The access key: props.k."""
    return F.get_json_object("props", "$.k")


def _log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(K().alias("key"), F.col("user_id").alias("component"), "ts", "event_id",
                     "event_type", "value")


def access_stats(spark, sf_dir):
    st = access.access_stats(_log(spark, sf_dir))
    return st.select("key", "accesses", "n_components", "first_ts", "last_ts",
                     sig("avg_interval_ms").alias("avg_interval_ms"))


def hot_keys(spark, sf_dir):
    st = access.access_stats(_log(spark, sf_dir))
    return access.hot_keys(st, 20).select("key", "accesses", "n_components",
                                          sig("avg_interval_ms").alias("avg_interval_ms"), "category")


def access_gap(spark, sf_dir):
    g = access.access_gaps(_log(spark, sf_dir))
    # exact: integer microseconds / 1000 is the same double in both engines
    return g.select("key", "event_id", "ts", "gap_ms")


def access_recent(spark, sf_dir):
    return access.access_recent(_log(spark, sf_dir))


def _shares(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), K().alias("target"))
    return access.transition_share(ev)


def transition_share(spark, sf_dir):
    return _shares(spark, sf_dir).select("source", "target", "n", sig("share").alias("share"))


def next_targets(spark, sf_dir):
    return access.next_targets(_shares(spark, sf_dir)).select(
        "source", "target", "rank", sig("share").alias("share"))


def hit_rates(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
        F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2)
         .when(F.col("event_type") == "signup", 3).alias("level"))
    out = access.hit_rates(ev, group_cols=["day"])
    return out.select("day", "requests", "l1_hits", "l2_hits", "l3_hits",
                      *[sig(c).alias(c) for c in ("total_hit_rate", "l1_hit_rate", "l1_probe_rate",
                                                  "l2_probe_rate", "l3_probe_rate",
                                                  "overall_probe_rate", "hit_pct")])


def traffic_totals(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write")
         .when(F.col("event_type") == "signup", "sync").alias("op"))
    return access.traffic_totals(ev)


def _tier_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return (ev.select(F.concat_ws(":", "event_type", K()).alias("key"), "ts", "value")
              .groupBy("key").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_ts"),
                                  F.sum("value").alias("size_bytes")))


def tier_table(spark, sf_dir):
    return access.tier_table(_tier_counts(spark, sf_dir)).select("key", "accesses", "rank", "tier")


def removal_candidates(spark, sf_dir):
    tiers = access.tier_table(_tier_counts(spark, sf_dir))
    rc = access.removal_candidates(tiers, 500.0, policy="LRU")
    return rc.select("tier", "key", "last_ts", sig("size_bytes").alias("size_bytes"),
                     sig("freed_after").alias("freed_after"))


def removal_candidates_lfu(spark, sf_dir):
    tiers = access.tier_table(_tier_counts(spark, sf_dir))
    rc = access.removal_candidates(tiers, 500.0, policy="LFU")
    return rc.select("tier", "key", "accesses", sig("size_bytes").alias("size_bytes"),
                     sig("freed_after").alias("freed_after"))


def key_parts(spark, sf_dir):
    keys = _tier_counts(spark, sf_dir).select("key")
    cat, name = access.split_key("key")
    return keys.select("key", cat.alias("key_category"), name.alias("key_name"))


def stale_blocks(spark, sf_dir):
    c = _tier_counts(spark, sf_dir)
    as_of = table(spark, sf_dir, "events").agg(F.max("ts")).scalar()  # scalar subquery
    j = c.withColumn("as_of", as_of)
    return access.stale_entries(j, F.col("as_of"), ts="last_ts").select("key", "last_ts", "as_of")


def recent_snapshots(spark, sf_dir):
    """W10 over ST8: 5-second snapshots per event type, the last 100 kept."""
    ev = table(spark, sf_dir, "events")
    snaps = (ev.groupBy(F.window("ts", "5 seconds").start.cast("timestamp_ntz").alias("window_start"), "event_type")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))
    last = access.top_n_per_group(snaps, ["event_type"], [F.col("window_start").desc()], 100,
                                  salt_col="window_start")
    return last.select("event_type", "window_start", "n", sig("total").alias("total"))


QUERIES = {
    "recent_snapshots": recent_snapshots,
    "access_stats": access_stats,
    "hot_keys": hot_keys,
    "access_gap": access_gap,
    "access_recent": access_recent,
    "transition_share": transition_share,
    "next_targets": next_targets,
    "hit_rates": hit_rates,
    "traffic_totals": traffic_totals,
    "tier_table": tier_table,
    "removal_candidates": removal_candidates,
    "removal_candidates_lfu": removal_candidates_lfu,
    "key_parts": key_parts,
    "stale_blocks": stale_blocks,
}

_LOG = """WITH log AS (SELECT json_extract_string(props, '$.k') AS key, user_id AS component, ts, event_id,
  event_type, value FROM events)"""

_STATS = _LOG + """,
recent AS (SELECT * FROM (SELECT key, ts, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn
  FROM log) WHERE rn <= 100),
gaps AS (SELECT key, CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 / (count(*) - 1)
  ELSE 0.0 END AS avg_interval_ms FROM recent GROUP BY key),
stats AS (SELECT key, count(*) AS accesses, count(DISTINCT component) AS n_components, min(ts) AS first_ts,
  max(ts) AS last_ts FROM log GROUP BY key)
"""

_TIERS = """WITH c AS (SELECT event_type || ':' || json_extract_string(props, '$.k') AS key, count(*) AS accesses,
  max(ts) AS last_ts, sum(value) AS size_bytes FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY accesses DESC, key) AS rnk FROM c),
t AS (SELECT key, accesses, last_ts, size_bytes, CASE WHEN rnk <= 1344 THEN rnk END AS rank,
  CASE WHEN rnk <= 64 AND accesses >= 5 THEN 'L1_HOT' WHEN rnk <= 320 THEN 'L2_WARM'
       WHEN rnk <= 1344 THEN 'L3_COLD' ELSE 'UNCACHED' END AS tier FROM r)
"""

_SHARES = """WITH p AS (SELECT event_type AS source, json_extract_string(props, '$.k') AS target, count(*) AS n
  FROM events GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share FROM p)
"""

_RATE = "coalesce(CASE WHEN ({d}) > 0 THEN ({n}) / ({d}) END, 0.0)"


def _rate(n, d):
    return _RATE.format(n=n, d=d)


_H = "(l1_hits + l2_hits + l3_hits)"
_MISS = "((requests - l1_hits) + (requests - l1_hits - l2_hits) + (requests - l1_hits - l2_hits - l3_hits))"

ORACLE = {
    "recent_snapshots": f"""SELECT event_type, window_start, n, {sql_sig('total')} AS total FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY window_start DESC) AS rn FROM (
          SELECT time_bucket(INTERVAL 5 SECOND, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total
          FROM events GROUP BY ALL)) WHERE rn <= 100""",
    "access_stats": _STATS + f"""SELECT s.key, accesses, n_components, first_ts, last_ts,
        {sql_sig('avg_interval_ms')} AS avg_interval_ms FROM stats s JOIN gaps g ON s.key = g.key""",
    "hot_keys": _STATS + f"""SELECT s.key, accesses, n_components, {sql_sig('avg_interval_ms')} AS avg_interval_ms,
        CASE WHEN s.key LIKE 'path:%' THEN 'path' WHEN s.key LIKE 'data:%' THEN 'data'
             WHEN s.key LIKE 'config:%' THEN 'config' ELSE 'other' END AS category
        FROM stats s JOIN gaps g ON s.key = g.key ORDER BY accesses DESC, s.key LIMIT 20""",
    "access_gap": _LOG + f""" SELECT key, event_id, ts,
        (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id))) / 1000.0 AS gap_ms
        FROM log""",
    "access_recent": _LOG + """, a AS (SELECT max(ts) AS as_of FROM log)
        SELECT key, count(*) FILTER (WHERE ts > as_of - INTERVAL 1 HOUR) AS last_hour,
               count(*) FILTER (WHERE ts > as_of - INTERVAL 1 DAY) AS last_day
        FROM log, a GROUP BY key""",
    "transition_share": _SHARES + f"SELECT source, target, n, {sql_sig('share')} AS share FROM s",
    "next_targets": _SHARES + f"""SELECT source, target, rank, {sql_sig('share')} AS share FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY share DESC, target) AS rank FROM s) WHERE rank <= 5""",
    "hit_rates": f"""WITH e AS (SELECT date_trunc('day', ts) AS day, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2
          WHEN 'signup' THEN 3 END AS level FROM events),
        c AS (SELECT day, count(*) AS requests, count(*) FILTER (WHERE level = 1) AS l1_hits,
          count(*) FILTER (WHERE level = 2) AS l2_hits, count(*) FILTER (WHERE level = 3) AS l3_hits FROM e GROUP BY day)
        SELECT day, requests, l1_hits, l2_hits, l3_hits,
          {sql_sig(_rate(_H, 'requests'))} AS total_hit_rate,
          {sql_sig(_rate('l1_hits', 'requests'))} AS l1_hit_rate,
          {sql_sig(_rate('l1_hits', 'requests'))} AS l1_probe_rate,
          {sql_sig(_rate('l2_hits', 'requests - l1_hits'))} AS l2_probe_rate,
          {sql_sig(_rate('l3_hits', 'requests - l1_hits - l2_hits'))} AS l3_probe_rate,
          {sql_sig(_rate(_H, _H + ' + ' + _MISS))} AS overall_probe_rate,
          {sql_sig('round(' + _rate(_H, 'requests') + ' * 100, 2)')} AS hit_pct
        FROM c""",
    "traffic_totals": """SELECT count(*) FILTER (WHERE event_type = 'view') AS "read",
        count(*) FILTER (WHERE event_type = 'purchase') AS "write",
        count(*) FILTER (WHERE event_type = 'signup') AS "sync" FROM events""",
    "tier_table": _TIERS + "SELECT key, accesses, rank, tier FROM t",
    "removal_candidates": _TIERS + f"""SELECT tier, key, last_ts, {sql_sig('size_bytes')} AS size_bytes,
        {sql_sig('freed_after')} AS freed_after FROM (
        SELECT *, sum(size_bytes) OVER (PARTITION BY tier ORDER BY last_ts, key ROWS UNBOUNDED PRECEDING) AS freed_after
        FROM t) WHERE freed_after - size_bytes < 500.0""",
    "removal_candidates_lfu": _TIERS + f"""SELECT tier, key, accesses, {sql_sig('size_bytes')} AS size_bytes,
        {sql_sig('freed_after')} AS freed_after FROM (
        SELECT *, sum(size_bytes) OVER (PARTITION BY tier ORDER BY accesses, key ROWS UNBOUNDED PRECEDING) AS freed_after
        FROM t) WHERE freed_after - size_bytes < 500.0""",
    "key_parts": """SELECT DISTINCT event_type || ':' || json_extract_string(props, '$.k') AS key,
        CASE WHEN len(string_split(key, ':')) = 2 THEN string_split(key, ':')[1] END AS key_category,
        CASE WHEN len(string_split(key, ':')) = 2 THEN string_split(key, ':')[2] END AS key_name FROM events""",
    "stale_blocks": """WITH c AS (SELECT event_type || ':' || json_extract_string(props, '$.k') AS key, max(ts) AS last_ts
        FROM events GROUP BY 1), a AS (SELECT max(ts) AS as_of FROM events)
        SELECT key, last_ts, as_of FROM c, a WHERE (epoch_us(as_of) - epoch_us(last_ts)) / 1000000 > 3600""",
}
