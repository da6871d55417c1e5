"""Order-dependent state over event logs, computed without per-key folds
(A14, ST4 batch form, C1-C6, P15).

* EMA (A14): s_n = a*x_n + (1-a)*s_(n-1), s_0 = 0, so the final value is
  sum_i a*(1-a)^(rows after i)*x_i: a row number per key (chunked scan) and
  one aggregate.
* Circuit breaker (ST4): the state after an event depends only on the run of
  consecutive failures before it and the time since the previous event
  (gaps-and-islands with chunked running max / lag).
* Replica coherency (C1-C6): the state of a copy is decided by its last own
  non-read event, whether a read followed a register, and the last write or
  update at another source, all plain aggregates.
* Batch numbering (P15): a global row number from a chunked scan over key
  ranges, never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ordered

# EMA smoothing, breaker limits, coherency states.
EMA_ALPHA = 0.1
BREAKER_MAX_FAILURES = 3
BREAKER_RESET_SECONDS = 300
CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF-OPEN"
MODIFIED, EXCLUSIVE, SHARED, INVALID = "MODIFIED", "EXCLUSIVE", "SHARED", "INVALID"
ACTIONS = ("register", "read", "write", "update", "sync")


def _micros(c):
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp"))


# ---------------------------------------------------------------- A14
def ema_per_key(df: DataFrame, key: str, ts: str, tie: str, value: str, alpha: float = EMA_ALPHA,
                bucket_seconds: int = 86400) -> DataFrame:
    """Exponential moving average per key after the last event, start 0.

    Each row's weight is a*(1-a)^k with k the number of later rows of the key;
    (1-a)^k underflows to 0 for very old rows, exactly as the fold forgets them.
    """
    # number rows newest first: row k (1-based) has k - 1 later rows. The chunk
    # column only has to be non-decreasing along this order: minus the bucket.
    numbered = ordered.row_numbers(df.select(key, ts, tie, value), [key], [F.col(ts), F.col(tie)],
                                   -ordered.time_bucket(ts, bucket_seconds), "_k", descending=True)
    w = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), (F.col("_k") - 1).cast("double"))
    return numbered.groupBy(key).agg(F.sum(w * F.col(value)).alias("ema"),
                                     F.count(F.lit(1)).alias("events"))


# ---------------------------------------------------------------- ST4 (batch)
def breaker_states(df: DataFrame, key: str, ts: str, tie: str, failed: Column,
                   max_failures: int = BREAKER_MAX_FAILURES,
                   reset_seconds: int = BREAKER_RESET_SECONDS,
                   bucket_seconds: int = 86400, carry: DataFrame | None = None) -> DataFrame:
    """ST4: circuit-breaker state per event of each key.

    ``state_before`` is what a caller sees when it tries (OPEN turns HALF-OPEN
    once more than ``reset_seconds`` passed since the last failure);
    ``state_after`` follows the outcome: a success closes, a failure opens at
    ``max_failures`` failures in a row. ``carry`` (carry_key, carry_failures,
    carry_ts; one row per key) is where each key stood before these events.
    """
    order = [F.col(ts), F.col(tie)]
    bucket = ordered.time_bucket(ts, bucket_seconds)
    base = df.select(key, ts, tie, failed.alias("failed"))
    numbered = ordered.row_numbers(base, [key], order, bucket, "rn")
    # one pass for both: the last success before the row, and the previous
    # row's time (rows are in ts order, so it is the max of the earlier ts)
    with_prev = ordered.running_aggs(numbered, [key], order,
                                     {"last_success_rn": F.when(~F.col("failed"), F.col("rn")),
                                      "prev_" + ts: F.col(ts)},
                                     bucket, agg="max", inclusive=False)
    run_before = F.col("rn") - 1 - F.coalesce(F.col("last_success_rn"), F.lit(0))
    prev_ts = F.col("prev_" + ts)
    if carry is not None:
        with_prev = with_prev.join(carry, F.col(key).eqNullSafe(F.col("carry_key")), "left")
        run_before = run_before + F.when(F.col("last_success_rn").isNull(),
                                         F.coalesce("carry_failures", F.lit(0))).otherwise(F.lit(0))
        prev_ts = F.when(F.col("rn") == 1, F.col("carry_ts")).otherwise(prev_ts)
    secs = (_micros(ts) - _micros(prev_ts)) / F.lit(1_000_000)
    out = with_prev.withColumn("failures_before", run_before.cast("long"))
    before = (F.when(F.col("failures_before") >= max_failures,
                     F.when(secs > reset_seconds, F.lit(HALF_OPEN)).otherwise(F.lit(OPEN)))
               .otherwise(F.lit(CLOSED)))
    failures = F.when(F.col("failed"), F.col("failures_before") + 1).otherwise(F.lit(0)).cast("long")
    after = F.when(failures >= max_failures, F.lit(OPEN)).otherwise(F.lit(CLOSED))
    return out.select(key, tie, ts, "failed", before.alias("state_before"),
                      failures.alias("failures"), after.alias("state_after"))


# ---------------------------------------------------------------- C1-C6
def coherency_state(events: DataFrame, block: str, source: str, ts: str, tie: str,
                    action: str = "action") -> DataFrame:
    """Current state and version of every copy (block, source).

    Rules (one state machine per logical block, quirks Q4/Q5 re-aimed):
    register -> EXCLUSIVE, version 1; read of an EXCLUSIVE copy -> SHARED
    (reads of unknown / INVALID copies are misses and change nothing);
    write -> MODIFIED and the block's copies at other sources INVALID;
    update -> MODIFIED, version + 1, other copies INVALID; sync -> SHARED.
    A copy exists once it had a non-read event at its source. Events without
    a block or source belong to no state machine and are ignored.
    """
    facts = copy_facts(events, block, source, ts, tie, action)
    n = updates_after(update_events(events, block, source, ts, tie, action), facts, block, source)
    return copy_states(facts.join(n, [block, source], "left").withColumnRenamed("_n", "updates"), block, source)


# last events of a copy; each is the largest of its parts' values, whatever the parts
COPY_FACTS = ("last_own", "last_register", "last_read", "last_wu", "last_update")
UPDATE_SALTS = 16


def copy_facts(events: DataFrame, block: str, source: str, ts: str, tie: str, action: str = "action") -> DataFrame:
    """The last relevant events of every copy, as (t, i) of ts and tie."""
    events = events.filter(F.col(block).isNotNull() & F.col(source).isNotNull())  # no block: no machine
    seq = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"))
    a = F.col(action)
    return events.groupBy(block, source).agg(
        F.max_by(F.when(a != "read", a), F.when(a != "read", seq)).alias("last_action"),
        F.max(F.when(a != "read", seq)).alias("last_own"),
        F.max(F.when(a == "register", seq)).alias("last_register"),
        F.max(F.when(a == "read", seq)).alias("last_read"),
        F.max(F.when(a.isin("write", "update"), seq)).alias("last_wu"),
        F.max(F.when(a == "update", seq)).alias("last_update"))


def merge_facts(facts: DataFrame, block: str, source: str) -> DataFrame:
    """``copy_facts`` of all events from those of their parts (several rows per copy)."""
    return facts.groupBy(block, source).agg(F.max_by("last_action", "last_own").alias("last_action"),
                                            *[F.max(c).alias(c) for c in COPY_FACTS])


def update_events(events: DataFrame, block: str, source: str, ts: str, tie: str,
                  action: str = "action") -> DataFrame:
    """(block, source, _s) of every update."""
    return (events.filter((F.col(action) == "update") & F.col(block).isNotNull() & F.col(source).isNotNull())
                  .select(block, source, F.struct(F.col(ts).alias("t"), F.col(tie).alias("i")).alias("_s")))


def updates_after(updates: DataFrame, facts: DataFrame, block: str, source: str) -> DataFrame:
    """``_n`` = updates of a copy after its last register (copies without one
    have no row). The rows of a copy are spread over ``UPDATE_SALTS`` tasks."""
    salted = updates.withColumn("_p", F.pmod(F.xxhash64("_s"), F.lit(UPDATE_SALTS)))
    last = facts.select(block, source, "last_register", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(UPDATE_SALTS - 1).cast("long"))).alias("_p"))
    return (salted.join(last, [block, source, "_p"])
                  .filter(F.col("last_register").isNull() | (F.col("_s") > F.col("last_register")))
                  .groupBy(block, source).agg(F.count(F.lit(1)).alias("_n")))


def copy_states(facts: DataFrame, block: str, source: str) -> DataFrame:
    """State, version and time of every copy from its last events and ``updates``."""
    # latest write/update at any *other* source of the block: best and
    # second-best source per block over the (small) per-copy table
    w = Window.partitionBy(block).orderBy(F.col("last_wu").desc_nulls_last(), F.col(source))
    ranked = facts.withColumn("_r", F.row_number().over(w))
    top = ranked.groupBy(block).agg(
        F.max(F.when(F.col("_r") == 1, F.struct(F.col("last_wu").alias("s"), F.col(source).alias("src")))).alias("_w1"),
        F.max(F.when(F.col("_r") == 2, F.col("last_wu"))).alias("_w2"))
    c = facts.join(top, block)
    other = F.when(F.col("_w1.src") == F.col(source), F.col("_w2")).otherwise(F.col("_w1.s"))
    state = (F.when(other.isNotNull() & (other > F.col("last_own")), F.lit(INVALID))
              .when(F.col("last_action").isin("write", "update"), F.lit(MODIFIED))
              .when(F.col("last_action") == "sync", F.lit(SHARED))
              .when(F.col("last_read") > F.col("last_own"), F.lit(SHARED))
              .otherwise(F.lit(EXCLUSIVE)))
    return (c.filter(F.col("last_own").isNotNull())
             .select(block, source, state.alias("state"),
                     (F.lit(1) + F.coalesce(F.col("updates"), F.lit(0))).cast("long").alias("version"),
                     F.col("last_own.t").alias("last_ts")))


def write_invalidations(events: DataFrame, block: str, source: str, ts: str, tie: str,
                        action: str = "action", bucket_seconds: int = 86400,
                        max_sources: int = 16) -> DataFrame:
    """For every write or update, the other sources whose copy of the
    block it invalidates (copies that existed and were still valid).

    For each source X of the (catalog-sized, checked) source list two running
    values per block are kept with the chunked scan, strictly before each
    event: X's last own non-read event, and the last write/update by any source
    other than X. X's copy is valid just before the event when the first is
    set and not older than the second.
    """
    events = events.filter(F.col(block).isNotNull() & F.col(source).isNotNull())  # no block: no machine
    rows = events.select(source).distinct().limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources = sorted(r[0] for r in rows)
    order = [F.col(ts), F.col(tie)]
    bucket = ordered.time_bucket(ts, bucket_seconds)
    # a sortable sequence number of the event inside the block
    seq = (F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(38,0)") * F.lit(10 ** 12)
           + F.col(tie).cast("decimal(38,0)"))
    a, src = F.col(action), F.col(source)
    df = events.select(block, source, ts, tie, action).withColumn("_seq", seq)
    vals = {}
    for i, x in enumerate(sources):
        vals[f"_own{i}"] = F.when((src == x) & (a != "read"), F.col("_seq"))
        vals[f"_oth{i}"] = F.when((src != x) & a.isin("write", "update"), F.col("_seq"))
    df = ordered.running_aggs(df, [block], order, vals, bucket, agg="max", inclusive=False)
    hit = [F.when((src != x) & F.col(f"_own{i}").isNotNull()
                  & (F.col(f"_oth{i}").isNull() | (F.col(f"_oth{i}") < F.col(f"_own{i}"))), F.lit(x))
           for i, x in enumerate(sources)]
    inval = F.filter(F.array(*hit), lambda v: v.isNotNull())
    return (df.filter(a.isin("write", "update"))
              .select(block, source, tie, ts, action, inval.alias("invalidated")))


# ---------------------------------------------------------------- P15
def assign_batches(df: DataFrame, order_col: str, batch_size: int, key_width: float) -> DataFrame:
    """Rows in ``order_col`` order cut into batches of ``batch_size``:
    batch i holds rows [i*b, min((i+1)*b, n)). Row numbers come from a
    chunked scan over ranges of width ``key_width`` of the order key (a range with too many
    rows is cut again)."""
    numbered = ordered.row_numbers(df, [], [F.col(order_col)], ordered.value_bucket(order_col, key_width), "rn")
    return numbered.withColumn("batch_id", F.floor((F.col("rn") - 1) / F.lit(batch_size)).cast("long"))
