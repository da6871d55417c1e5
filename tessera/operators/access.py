"""Access-log analytics.

The access log is ``(key, component, ts[, event_id])``. ``event_id`` breaks ties
between equal timestamps so every ordered result is repeatable.

Scale notes
-----------
* Per-key counts are plain aggregates (map-side partial, no skew problem).
* "Last n per key" (W10) never sorts a whole key in one task: rows are first
  cut to the top n inside (key, salt) sub-groups, then to the top n of the
  at most n x salts survivors per key (``top_n_per_group``).
* Global rankings (tier table) take the bounded top-k with ``orderBy().limit``
  (partial top-k per task, one small merge) and join the rank back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import key_category
from tessera.operators import ordered

# Tier slot counts, the promotion threshold, the history length
# for interval statistics and the stale-block age.
L1_SLOTS, L2_SLOTS, L3_SLOTS = 64, 256, 1024
PROMOTE_AT = 5
HISTORY = 100
STALE_SECONDS = 3600
TOP_TARGETS = 5


def _micros(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp"))


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], n: int,
                    salt_buckets: int = 4096, salt_col: str | None = None,
                    method: str = "row_number", rank_col: str | None = None) -> DataFrame:
    """Top ``n`` rows per group by ``order_cols`` without a single-task hot group.

    Stage 1 ranks inside (group, salt) sub-groups and keeps rank <= n; stage 2
    ranks the <= n x salt_buckets survivors per group. A row's rank inside its
    sub-group never exceeds its rank in the group, and every row that beats a
    survivor survives too, so stage 2 gives the exact group rank for
    ``row_number``, ``rank`` and ``dense_rank``. Salt is a hash of ``salt_col``
    (or of all columns), so it is deterministic.

    Many salts cost little: a small group stays small in both stages, and a
    hot group's second stage holds at most n x salt_buckets rows (409,600 for
    n = 100), while its first stage is split 4096 ways.
    """
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    salt_src = F.col(salt_col) if salt_col else F.xxhash64(*[F.col(c) for c in df.columns])
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    stage1 = salted.withColumn("_rn", fn().over(w1)).filter(F.col("_rn") <= n)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    out = (stage1.drop("_rn", "_salt").withColumn("_rn", fn().over(w2))
                 .filter(F.col("_rn") <= n))
    if rank_col:
        return out.withColumn(rank_col, F.col("_rn").cast("long")).drop("_rn")
    return out.drop("_rn")


# ---------------------------------------------------------------- A7 / A8 / W4
def access_stats(log: DataFrame, key="key", component="component", ts="ts",
                 event_id="event_id", history: int = HISTORY) -> DataFrame:
    """A7 + A8: per key total accesses, distinct components, first/last access
    and the mean gap (ms) between consecutive accesses among the last
    ``history`` ones (0 with fewer than two)."""
    totals = log.groupBy(key).agg(
        F.count(F.lit(1)).alias("accesses"),
        F.count_distinct(component).alias("n_components"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    recent = top_n_per_group(log.select(key, ts, event_id), [key],
                             [F.col(ts).desc(), F.col(event_id).desc()], history, salt_col=event_id)
    gaps = recent.groupBy(key).agg(
        F.count(F.lit(1)).alias("_m"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    gap_ms = F.when(F.col("_m") > 1,
                    (_micros("_hi") - _micros("_lo")).cast("double") / F.lit(1000.0) / (F.col("_m") - 1)
                    ).otherwise(F.lit(0.0))
    g = gaps.select(F.col(key).alias("_gk"), gap_ms.alias("avg_interval_ms"))
    # NULL-safe: a NULL key is a group of its own, as in the aggregates
    return totals.join(g, totals[key].eqNullSafe(g["_gk"])).drop("_gk")


def hot_keys(stats: DataFrame, n: int = 10, key="key") -> DataFrame:
    """The n most accessed keys (ties by key) with their category (P10)."""
    return (stats.orderBy(F.col("accesses").desc(), F.col(key).asc()).limit(n)
                 .withColumn("category", key_category(key)))


def key_components(log: DataFrame, keys: DataFrame, key="key", component="component") -> DataFrame:
    """The distinct requesting components of the given keys, long form."""
    return log.select(key, component).join(keys.select(key), key, "left_semi").distinct()


def access_gaps(log: DataFrame, key="key", ts="ts", event_id="event_id",
                bucket_seconds: int = 3600) -> DataFrame:
    """Gap in ms to the previous access of the same key (NULL for the first).

    The previous access time is the running max of the earlier times
    (``ordered.running_agg``): chunks of one key per ``bucket_seconds`` are
    sorted apart, so a hot key is spread over many tasks.
    """
    base = log.select(key, event_id, ts)
    # rows are in ts order, so the previous row's ts is the max of the earlier ts
    prev = ordered.running_agg(base, [key], [F.col(ts), F.col(event_id)], F.col(ts), "prev_" + ts,
                               ordered.time_bucket(ts, bucket_seconds), agg="max", inclusive=False)
    gap = (_micros(ts) - _micros("prev_" + ts)).cast("double") / F.lit(1000.0)
    return prev.select(key, event_id, ts, gap.alias("gap_ms"))


def access_recent(log: DataFrame, as_of: Column | None = None, key="key", ts="ts") -> DataFrame:
    """Accesses in the last hour and the last day before ``as_of``.

    ``as_of`` defaults to the newest access in the log (a parameter, never
    ``now()``), as a scalar subquery.
    """
    if as_of is None:
        as_of = log.agg(F.max(ts)).scalar()  # scalar subquery, computed once
    j = log.select(key, ts).withColumn("_as_of", as_of)
    return j.groupBy(key).agg(
        F.count_if(F.col(ts) > F.col("_as_of") - F.expr("INTERVAL 1 HOUR")).alias("last_hour"),
        F.count_if(F.col(ts) > F.col("_as_of") - F.expr("INTERVAL 1 DAY")).alias("last_day"))


# ---------------------------------------------------------------- A10 / W5
def transition_share(log: DataFrame, source="source", target="target") -> DataFrame:
    """A10: P(target | source) = count(source, target) / count(source).

    Both counts are partial aggregates; the per-source total is joined back
    (no window, so a source with millions of targets is not one task).
    """
    pairs = log.groupBy(source, target).agg(F.count(F.lit(1)).alias("n"))
    totals = log.groupBy(F.col(source).alias("_src")).agg(F.count(F.lit(1)).alias("_total"))
    j = pairs.join(totals, pairs[source].eqNullSafe(totals["_src"]))
    return j.select(source, target, "n", (F.col("n") / F.col("_total")).alias("share"))


def next_targets(shares: DataFrame, k: int = TOP_TARGETS, source="source", target="target") -> DataFrame:
    """The k likeliest next targets per source, rank 1..k, ties by target
    (salted two-stage top-k, so a source with many targets is split)."""
    return top_n_per_group(shares, [source], [F.col("share").desc(), F.col(target).asc()], k,
                           salt_col=target, rank_col="rank")


# ---------------------------------------------------------------- A11 / A12 / A13
def hit_rates(log: DataFrame, level: str = "level", group_cols: list[str] | None = None) -> DataFrame:
    """A11 + A12 + A13 from a request log whose ``level`` is 1, 2, 3 (hit at
    that tier) or NULL (miss).

    * ``total_hit_rate`` / ``l1_hit_rate``: denominator = all requests (A11).
    * ``l1_probe_rate`` / ``l2_probe_rate`` / ``l3_probe_rate``: each tier's
      rate over the requests that reached it; ``overall_probe_rate`` counts a
      deep hit's misses in the tiers above it (A12).
    * ``hit_pct``: hits / requests x 100, rounded to 2 (A13).
    0 when no request reached the tier.
    """
    group_cols = group_cols or []
    lv = F.col(level)
    aggs = [F.count(F.lit(1)).alias("requests"),
            F.count_if(lv == 1).alias("l1_hits"), F.count_if(lv == 2).alias("l2_hits"),
            F.count_if(lv == 3).alias("l3_hits")]
    c = (log.groupBy(*group_cols).agg(*aggs) if group_cols else log.agg(*aggs))
    r, h1, h2, h3 = (F.col(x).cast("double") for x in ("requests", "l1_hits", "l2_hits", "l3_hits"))
    hits = h1 + h2 + h3

    def ratio(num, den):
        return F.coalesce(F.try_divide(num, F.when(den > 0, den)), F.lit(0.0))

    misses = (r - h1) + (r - h1 - h2) + (r - h1 - h2 - h3)
    return c.select(
        *group_cols, "requests", "l1_hits", "l2_hits", "l3_hits",
        ratio(hits, r).alias("total_hit_rate"), ratio(h1, r).alias("l1_hit_rate"),
        ratio(h1, r).alias("l1_probe_rate"), ratio(h2, r - h1).alias("l2_probe_rate"),
        ratio(h3, r - h1 - h2).alias("l3_probe_rate"),
        ratio(hits, hits + misses).alias("overall_probe_rate"),
        F.round(ratio(hits, r) * 100, 2).alias("hit_pct"))


def traffic_totals(log: DataFrame, op="op", ops=("read", "write", "sync")) -> DataFrame:
    """One row with a count per operation type (pivot with fixed values)."""
    return log.groupBy().pivot(op, list(ops)).agg(F.count(F.lit(1))).na.fill(0)


# ---------------------------------------------------------------- W6 / W7
def tier_table(counts: DataFrame, key="key", count="accesses",
               slots=(L1_SLOTS, L2_SLOTS, L3_SLOTS), promote_at: int = PROMOTE_AT) -> DataFrame:
    """Rank keys by access count (ties by key) and assign tiers.

    rank <= 64 with >= 5 accesses: L1_HOT; next up to rank 320: L2_WARM (an
    L1-ranked key below the threshold also lands here); up to rank 1344:
    L3_COLD; rest UNCACHED. The ranked head is a bounded top-k; every key keeps
    a row.
    """
    l1, l2, l3 = slots
    head_n = l1 + l2 + l3
    head = counts.select(key, count).orderBy(F.col(count).desc(), F.col(key).asc()).limit(head_n)
    w = Window.orderBy(F.col(count).desc(), F.col(key).asc())  # over <= head_n rows
    ranked = head.withColumn("rank", F.row_number().over(w).cast("long")).select(key, "rank")
    # bounded by the slots; NULL is a key like any other
    ranked = ranked.select(F.col(key).alias("_ranked_key"), "rank")
    out = counts.join(F.broadcast(ranked), F.col(key).eqNullSafe(F.col("_ranked_key")), "left").drop("_ranked_key")
    rk, n = F.col("rank"), F.col(count)
    tier = (F.when(rk.isNull(), F.lit("UNCACHED"))
             .when((rk <= l1) & (n >= promote_at), F.lit("L1_HOT"))
             .when(rk <= l1 + l2, F.lit("L2_WARM"))
             .when(rk <= head_n, F.lit("L3_COLD"))
             .otherwise(F.lit("UNCACHED")))
    return out.withColumn("tier", tier)


def removal_candidates(entries: DataFrame, required_bytes, policy: str = "LRU",
                       key="key", tier="tier", size="size_bytes", last_access="last_ts",
                       count="accesses", pinned: str | None = None,
                       bucket: Column | None = None) -> DataFrame:
    """Per tier, the entries to remove until ``required_bytes`` are freed.

    LRU orders by last access (oldest first), LFU by access count (least
    first); ties by key. Pinned entries are never candidates. An entry is a
    candidate while the bytes freed before it are still short of the target,
    so the last candidate is the one that reaches it.

    The running byte sum is a chunked scan (``ordered.running_agg``): a tier
    holding most keys is cut into chunks by hour of last access (LRU) or by
    access count (LFU), and those with many rows again by key, instead of being
    sorted in one task.
    """
    df = entries if pinned is None else entries.filter(~F.col(pinned))
    lru = policy.upper() == "LRU"
    order = [F.col(last_access if lru else count), F.col(key)]
    if bucket is None:
        bucket = ordered.time_bucket(last_access, 3600) if lru else F.col(count).cast("long")
    req = required_bytes if isinstance(required_bytes, Column) else F.lit(required_bytes)
    run = ordered.running_agg(df, [tier], order, F.col(size), "freed_after", bucket, "sum")
    return run.filter(F.col("freed_after") - F.col(size) < req)


# ---------------------------------------------------------------- P11 / P13
def split_key(c, sep: str = ":") -> tuple[Column, Column]:
    """``category:name`` -> (category, name); NULLs unless exactly two parts."""
    col = F.col(c) if isinstance(c, str) else c
    parts = F.split(col, sep)
    ok = F.size(parts) == 2
    return F.when(ok, parts.getItem(0)), F.when(ok, parts.getItem(1))


def stale_entries(df: DataFrame, as_of: Column, ts="ts", max_age_seconds: int = STALE_SECONDS) -> DataFrame:
    """Entries whose age at ``as_of`` exceeds ``max_age_seconds``."""
    age = (_micros(as_of) - _micros(ts)) / F.lit(1_000_000)
    return df.filter(age > F.lit(max_age_seconds))
