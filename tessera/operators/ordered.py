"""Skew-safe ordered scans: running aggregates and previous-row lookups.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts every row of a key in
one task; a key with a third of all rows then sets the run time (and the
memory) of the whole job. Here the rows of a group are cut into chunks whose size
the data decide:

1. a ``bucket`` column that never decreases along the order (for example the
   day of the timestamp) cuts a group. One aggregate counts the rows of every (group,
   bucket); a bucket above ``MAX_CHUNK_ROWS`` rows is cut again at order values
   taken from a hash sample of its own rows (``CUT_SAMPLES`` per chunk), so a group
   whose rows all fall in one second, or a tier whose counts are all 1, is
   spread too. Cuts only decide where chunks end, never a result;
2. the window runs per chunk, so each task sorts one chunk;
3. one aggregate per chunk gives a small table (one row per chunk);
4. a scan over that table in two levels (runs of ``FAN`` buckets, then the runs)
   carries the running value from the chunks before and is joined back
   on the chunk; the big side is already partitioned by it, so only the small table moves.

The result equals the plain window exactly. Everything is built-in
DataFrame API; no Python runs per row. The input is read once more for
the counts, and that job runs when the scan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def time_bucket(ts, seconds: int = 3600) -> Column:
    """Bucket of a timestamp: whole ``seconds`` since the epoch."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def value_bucket(c, width: float) -> Column:
    """Bucket of a number: ``floor(value / width)``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col / F.lit(width)).cast("long")


_NULL_CHUNK = -(2 ** 62)
#: rows of a chunk; sampled order values per chunk; buckets of a run in the scan over chunks
MAX_CHUNK_ROWS = 1_000_000
CUT_SAMPLES = 64
FAN = 4096
#: cut tables up to this many chunks are broadcast
BROADCAST_CUTS = 100_000
CHUNK = ["_b", "_s"]


def _keyed(df: DataFrame, group_cols, bucket: Column, order: list[Column], descending: bool = False):
    """Internal non-NULL copies of the group keys ('v' + text, or 'n' for
    NULL) and of the chunk: ``_b`` (the bucket, NULL -> smallest, so it sorts first)
    and ``_s`` (its part, 0 where it was not cut). Windows and
    the chunk join both use these plain columns, so NULL keys are kept (as in
    a plain window) and the big side's partitioning matches the join keys:
    it is never re-shuffled for the join, broadcast or not."""
    keys = [f"_k{i}" for i in range(len(group_cols))]
    out = df
    for k, c in zip(keys, group_cols):
        out = out.withColumn(k, F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")))
    out = out.withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(_NULL_CHUNK)))
    cuts = _cuts(out, keys, order, descending)
    if cuts is None:
        return out.withColumn("_s", F.lit(0)), keys
    at = F.struct(*order)
    passed = F.size(F.filter("_cuts", lambda c: (c >= at) if descending else (c <= at)))
    return (_null_free_join(out, cuts, keys)
            .withColumn("_s", F.coalesce(F.when(F.col("_cuts").isNotNull(), passed), F.lit(0))).drop("_cuts"), keys)


def _null_free_join(rows: DataFrame, cuts: DataFrame, keys) -> DataFrame:
    small = cuts.agg(F.sum(F.size("_cuts"))).first()[0] <= BROADCAST_CUTS
    return rows.join(F.broadcast(cuts) if small else cuts, [*keys, "_b"], "left")


def _cuts(rows: DataFrame, keys, order: list[Column], descending: bool) -> DataFrame | None:
    """(keys, _b, _cuts): order values at which the buckets above ``MAX_CHUNK_ROWS`` are cut; None if
    there is no such bucket. Written to the checkpoint folder, so every use sees the same cuts."""
    spark = rows.sparkSession
    big = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MAX_CHUNK_ROWS).select(*keys, "_b")
    path = scratch_path(spark, "big-buckets")
    big.write.parquet(path)
    big = spark.read.schema(big.schema).parquet(path)
    n = big.count()
    if not n:
        return None
    rate = max(1, MAX_CHUNK_ROWS // CUT_SAMPLES)
    sampled = (rows.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(rate)) == 0)
               .join(F.broadcast(big) if n <= BROADCAST_CUTS else big, [*keys, "_b"], "left_semi")
               .select(*keys, "_b", F.struct(*order).alias("_at")))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col("_at").desc() if descending else F.col("_at"))
    per = max(1, MAX_CHUNK_ROWS // rate)
    kept = sampled.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") % per == 0)
    cuts = kept.groupBy(*keys, "_b").agg(F.collect_list("_at").alias("_cuts"))  # one value per chunk
    path = scratch_path(spark, "bucket-cuts")
    cuts.write.parquet(path)
    return spark.read.schema(cuts.schema).parquet(path)


def _join_chunks(local: DataFrame, chunks: DataFrame, keys, carry_cols) -> DataFrame:
    return local.join(chunks.select(*keys, *CHUNK, *carry_cols), [*keys, *CHUNK])


def _two_level(chunks: DataFrame, keys, values: dict, merge) -> DataFrame:
    """For every chunk ``merge`` of the ``values`` (output name -> chunk column) of all chunks before it in
    its group. Chunks are merged inside runs of ``FAN`` buckets and the runs among themselves, so no
    window holds all chunks of a group, nor all chunks of a frame without groups."""
    runs = chunks.withColumn("_run", F.floor(F.col("_b") / F.lit(FAN)))
    inner = Window.partitionBy(*keys, "_run").orderBy(*CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    whole = runs.groupBy(*keys, "_run").agg(*[merge.total(c).alias(n) for n, c in values.items()])
    carried = whole.select(*keys, "_run", *[merge.over(n, outer).alias(f"_o{n}") for n in values])
    return (runs.select(*keys, *CHUNK, "_run", *[merge.over(c, inner).alias(f"_i{n}") for n, c in values.items()])
            .join(carried, [*keys, "_run"])
            .select(*keys, *CHUNK, *[merge.pair(F.col(f"_i{n}"), F.col(f"_o{n}")).alias(n) for n in values]))


class _Fold:
    """sum, min or max of chunk values."""

    def __init__(self, fn, pair):
        self.total, self.pair = fn, pair
        self.over = lambda c, w: fn(c).over(w)


def _add(a, b):
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


_FOLD = {"sum": _Fold(F.sum, _add), "count": _Fold(F.sum, _add), "max": _Fold(F.max, F.greatest),
         "min": _Fold(F.min, F.least)}


class _Last:
    """The value of the latest chunk."""

    @staticmethod
    def total(c):
        return F.max_by(c, F.struct(*CHUNK))

    @staticmethod
    def over(c, w):
        return F.last(c).over(w)

    @staticmethod
    def pair(a, b):
        return F.coalesce(a, b)


def running_agg(df: DataFrame, group_cols: list[str], order_cols: list[Column], value: Column,
                out_col: str, bucket: Column, agg: str = "sum", inclusive: bool = True, **how) -> DataFrame:
    """``agg`` of ``value`` over the rows of the group up to the current one
    (``inclusive``) or strictly before it, in ``order_cols`` order.

    ``order_cols`` must make the order total (add a unique tie-break) and
    ``bucket`` must not decrease along it. With ``descending`` the order is that of
    ``order_cols`` (plain columns) from the largest to the smallest.
    """
    return running_aggs(df, group_cols, order_cols, {out_col: value}, bucket, agg, inclusive, **how)


def running_aggs(df: DataFrame, group_cols: list[str], order_cols: list[Column], values: dict,
                 bucket: Column, agg: str = "sum", inclusive: bool = True, descending: bool = False) -> DataFrame:
    """Several running aggregates (same ``agg``, same order) in one pass:
    one chunk window, one chunk-summary aggregate, one scan over the chunks and one
    join, whatever the number of values."""
    fn = _AGG[agg]
    names = list(values)
    tmp = {n: f"_v{i}" for i, n in enumerate(names)}
    b, keys = _keyed(df, group_cols, bucket, _plain(order_cols), descending)
    for n in names:
        b = b.withColumn(tmp[n], values[n])
    upper = 0 if inclusive else -1
    by = [c.desc() for c in order_cols] if descending else order_cols
    w_local = Window.partitionBy(*keys, *CHUNK).orderBy(*by).rowsBetween(Window.unboundedPreceding, upper)
    local = b.select("*", *[fn(tmp[n]).over(w_local).alias(tmp[n] + "_loc") for n in names])
    chunks = b.groupBy(*keys, *CHUNK).agg(*[fn(tmp[n]).alias(tmp[n] + "_bt") for n in names])
    offs = _two_level(chunks, keys, {tmp[n] + "_off": tmp[n] + "_bt" for n in names}, _FOLD[agg])
    j = _join_chunks(local, offs, keys, [tmp[n] + "_off" for n in names])
    for n in names:
        loc, off = F.col(tmp[n] + "_loc"), F.col(tmp[n] + "_off")
        if agg == "count":
            res = F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0))
        else:
            res = _FOLD[agg].pair(loc, off)
        j = j.withColumn(n, res)
    drop = [*CHUNK, *keys, *[c for n in names for c in (tmp[n], tmp[n] + "_loc", tmp[n] + "_off")]]
    return j.drop(*drop)


def previous_values(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                    value_cols: list[str], bucket: Column, prefix: str = "prev_") -> DataFrame:
    """``lag(v, 1)`` per group in ``order_cols`` order for each of
    ``value_cols``, as ``prev_<v>`` (NULL on the group's first row)."""
    b, keys = _keyed(df, group_cols, bucket, _plain(order_cols))
    payload = F.struct(*[F.col(c).alias(c) for c in value_cols])
    w_local = Window.partitionBy(*keys, *CHUNK).orderBy(*order_cols)
    local = b.withColumn("_lag", F.lag(payload).over(w_local))
    order_struct = F.struct(*_plain(order_cols))
    last = b.groupBy(*keys, *CHUNK).agg(F.max_by(payload, order_struct).alias("_last"))
    carry = _two_level(last, keys, {"_carry": "_last"}, _Last)
    j = _join_chunks(local, carry, keys, ["_carry"])
    prev = F.coalesce(F.col("_lag"), F.col("_carry"))
    out = j
    for c in value_cols:
        out = out.withColumn(prefix + c, prev[c])
    return out.drop(*CHUNK, "_lag", "_carry", *keys)


def _plain(order_cols):
    """Order columns as plain (ascending) columns, which chunks and ``max_by`` compare;
    a descending order is asked for with ``descending``."""
    for c in order_cols:
        if " DESC" in str(c).upper() or " ASC" in str(c).upper():
            raise ValueError("give plain order columns (and descending=True for the reverse order)")
    return list(order_cols)


def row_numbers(df: DataFrame, group_cols: list[str], order_cols: list[Column], bucket: Column,
                out_col: str = "rn", descending: bool = False) -> DataFrame:
    """``row_number()`` per group (1-based) without a single-task group."""
    return running_agg(df, group_cols, order_cols, F.lit(1), out_col, bucket, agg="count", descending=descending)
