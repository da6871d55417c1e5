"""Master / contributor sources: upsert, priorities, reconciliation, merge,
checksums, hierarchy, routing and signal fan-out (S5, J4, J8-J11, J15, A19, DQ10).

Scale notes
-----------
* "Latest row per key" and "winning row per key" are ``max_by`` aggregates,
  which Spark combines map-side: a key with a third of all versions is reduced
  inside every task before the shuffle, never sorted in one task.
* Nothing emits all pairs inside a group. Sibling relations (same parent
  folder) and duplicate content are expressed as group membership: one row per
  member pointing at its group / canonical copy.
* Only catalog-sized tables (sources, handlers, masters) are broadcast or
  turned into literals, after their row count is checked against a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import LANE_SIZE, LANES, lanes, lanes_hex, row_digest
from tessera.functions.paths import parent_folder
from tessera.session import scratch_path

# The master's priority, contributor priorities 50 - i*5, and
# the reconciliation statuses.
MASTER_PRIORITY = 100
IN_SYNC, STALE, MISSING, EXTRA = "IN_SYNC", "STALE", "MISSING", "EXTRA"
MAX_CATALOG_ROWS = 10_000


def contributor_priority(i: int) -> int:
    return 50 - i * 5


def _bounded_names(df: DataFrame, col: str, bound: int = MAX_CATALOG_ROWS, null: bool = False) -> list:
    """The names in order; with ``null`` a NULL name comes last, without it is left out."""
    rows = df.select(col).distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{col}: more than {bound} catalog entries")
    names = [r[0] for r in rows]
    return sorted(n for n in names if n is not None) + [None] * (null and None in names)


def _is_one_of(col: Column, names: list) -> Column:
    some = col.isin([n for n in names if n is not None])
    return F.coalesce(some, F.lit(False)) | col.isNull() if None in names else some


# ---------------------------------------------------------------- S5 / J11
def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Last writer wins. One row per key, the one with the greatest
    ``order_cols`` (a tuple, so a sequence number can break time ties)."""
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order_cols)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Keyed upsert of ``new`` into ``old`` (INSERT OR REPLACE)."""
    return latest_per_key(old.unionByName(new, allowMissingColumns=True), keys, order_cols)


def winner_by_priority(rows: DataFrame, keys: list[str], priority: str = "priority",
                       source: str = "source") -> DataFrame:
    """Per key, the row of the highest-priority source (ties: source name)."""
    return latest_per_key(rows, keys, [priority, source])


# ---------------------------------------------------------------- A19
def row_hash(df: DataFrame, cols: list[str]) -> Column:
    """MD5 of the row's canonical text (see ``functions.hashing``)."""
    return row_digest(df, cols)


def dataset_checksum(df: DataFrame, cols: list[str] | None = None,
                     group_cols: list[str] | None = None) -> DataFrame:
    """Order-insensitive checksum: row count, the sum of the first 15
    hex digits of each row's MD5 (as DECIMAL, no overflow) and the XOR of the
    rows' xxhash64. Equal multisets of rows give equal checksums."""
    group_cols = group_cols or []
    cols = cols or [c for c in df.columns if c not in group_cols]
    h = row_hash(df, cols)
    part = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(part).alias("md5_sum"),
            F.bit_xor(F.xxhash64(*[F.col(c) for c in cols])).alias("xx_xor")]
    return df.groupBy(*group_cols).agg(*aggs)


def multiset_sums(df: DataFrame, cols: list[str] | None = None, group_cols: list[str] | None = None) -> DataFrame:
    """(group, rows, lanes): row count and the eight sums modulo 2^32 of the rows' SHA-256. Equal
    multisets have equal sums, whatever their order; see ``update_sums``."""
    group_cols = group_cols or []
    cols = cols or [c for c in df.columns if c not in group_cols]
    digest = lanes(row_digest(df, cols, "sha256"))
    sums = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(x).alias(f"_l{i}") for i, x in enumerate(digest)])
    return sums.select(*group_cols, "rows", F.array(*[
        F.coalesce(F.pmod(f"_l{i}", F.lit(LANE_SIZE)), F.lit(0)).cast("long") for i in range(LANES)]).alias("lanes"))


def update_sums(old: DataFrame, added: DataFrame, removed: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Sums of a multiset after rows came and went, from the three ``multiset_sums`` alone."""
    group_cols = group_cols or []
    parts = [d.withColumn("_sign", F.lit(sign)) for d, sign in ((old, 1), (added, 1), (removed, -1))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = every.groupBy(*group_cols).agg(
        F.sum(F.col("rows") * F.col("_sign")).alias("rows"),
        F.array(*[F.pmod(F.sum(F.get("lanes", F.lit(i)) * F.col("_sign")), F.lit(LANE_SIZE)).cast("long")
                  for i in range(LANES)]).alias("lanes"))
    return out.filter(F.col("rows") != 0) if group_cols else out


def dataset_sha256(df: DataFrame, cols: list[str] | None = None, group_cols: list[str] | None = None) -> DataFrame:
    """(group, rows, sha256): the sums of ``multiset_sums`` as 64 hex digits."""
    return multiset_sums(df, cols, group_cols).select(*(group_cols or []), "rows", lanes_hex(F.col("lanes")).alias("sha256"))


# ---------------------------------------------------------------- J10
def reconcile(master: DataFrame, contributors: DataFrame, key: str, compare_cols: list[str],
              source: str = "source") -> DataFrame:
    """Compare each contributor with the master, per key.

    ``contributors`` holds all contributors stacked with a ``source`` column.
    Status: IN_SYNC (same row hash), STALE (differs), MISSING (master only),
    EXTRA (contributor only). Contributor rows join the master once by key;
    the master is never repeated per source, only its MISSING rows are. A NULL
    key is a key and a NULL source a source like any other.
    """
    names = _bounded_names(contributors, source, null=True)
    found = statuses(contributors, master, key, compare_cols, source)
    return found.unionByName(missing_rows(master, contributors, key, names, source))


def statuses(contributors: DataFrame, master: DataFrame, key: str, compare_cols: list[str],
             source: str = "source") -> DataFrame:
    """(source, key, status) of every contributor row."""
    m = master.select(F.col(key).alias("_m_key"), row_hash(master, compare_cols).alias("_m_hash"))
    c = contributors.select(source, key, row_hash(contributors, compare_cols).alias("_c_hash"))
    status = (F.when(F.col("_m_hash").isNull(), F.lit(EXTRA))
               .when(F.col("_m_hash") == F.col("_c_hash"), F.lit(IN_SYNC))
               .otherwise(F.lit(STALE)))
    return c.join(m, F.col(key).eqNullSafe(F.col("_m_key")), "left").select(source, key, status.alias("status"))


def missing_rows(master: DataFrame, seen: DataFrame, key: str, names: list, source: str = "source") -> DataFrame:
    """One MISSING row per master row and source of ``names`` that ``seen`` (source, key) lacks."""
    kind = seen.schema[source].dataType.simpleString()
    want = F.array(*[F.struct(F.lit(n).cast(kind).alias("s")) for n in names]).cast(f"array<struct<s:{kind}>>")
    have = seen.groupBy(F.col(key).alias("_seen_key")).agg(  # at most the sources; a struct keeps NULL
        F.collect_set(F.struct(F.col(source).alias("s"))).alias("_have"))
    absent = F.when(F.col("_have").isNull(), want).otherwise(F.array_except(want, "_have"))
    return master.select(key).join(have, F.col(key).eqNullSafe(F.col("_seen_key")), "left").select(
        F.explode(absent).alias("_s"), key).select(F.col("_s")["s"].alias(source), key, F.lit(MISSING).alias("status"))


RECONCILE_BUCKETS = 1024


def key_bucket(key, buckets: int = RECONCILE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_sums(df: DataFrame, key: str, compare_cols: list[str], group_cols: list[str] | None = None,
                buckets: int = RECONCILE_BUCKETS) -> DataFrame:
    """``multiset_sums`` over (key, compared columns) per key bucket; small enough to store and update."""
    return multiset_sums(df.withColumn("bucket", key_bucket(key, buckets)), [key, *compare_cols],
                         [*(group_cols or []), "bucket"])


def differing_buckets(master_sums: DataFrame, source_sums: DataFrame, names: list, source: str = "source") -> DataFrame:
    """(source, bucket) whose sums differ from the master's; a side without rows counts as zero sums."""
    kind = source_sums.schema[source].dataType.simpleString()
    m = master_sums.withColumn(source, F.explode(F.array(*[F.lit(n).cast(kind) for n in names])))
    a, b = (d.select(F.col(source).alias(f"{p}_source"), F.col("bucket").alias(f"{p}_bucket"), F.struct("rows", "lanes").alias(p))
            for d, p in ((m, "_m"), (source_sums, "_c")))
    both = a.join(b, F.col("_m_source").eqNullSafe(F.col("_c_source")) & (F.col("_m_bucket") == F.col("_c_bucket")), "full")
    return both.filter(~F.col("_m").eqNullSafe(F.col("_c"))).select(
        F.when(F.col("_m").isNull(), F.col("_c_source")).otherwise(F.col("_m_source")).alias(source),
        F.coalesce("_m_bucket", "_c_bucket").alias("bucket"))


def reconcile_changed(master: DataFrame, contributors: DataFrame, key: str, compare_cols: list[str],
                      source: str = "source", buckets: int = RECONCILE_BUCKETS,
                      master_sums: DataFrame | None = None, source_sums: DataFrame | None = None) -> DataFrame:
    """``reconcile`` for copies that mostly agree: the sums of every (source, key bucket) are compared with the
    master's first (stored sums can be given), and only buckets that differ are joined. Rows of
    equal buckets are IN_SYNC without a shuffle. Keys are unique per source and in the master; with
    repeated keys an equal bucket is IN_SYNC as a whole."""
    spark = master.sparkSession
    names = _bounded_names(contributors, source, null=True)
    if not names:
        return reconcile(master, contributors, key, compare_cols, source)
    if master_sums is None:
        master_sums = bucket_sums(master, key, compare_cols, buckets=buckets)
    if source_sums is None:
        source_sums = bucket_sums(contributors, key, compare_cols, [source], buckets)
    path = scratch_path(spark, "differing-buckets")
    found = differing_buckets(master_sums, source_sums, names, source)
    found.write.parquet(path)
    differ = spark.read.schema(found.schema).parquet(path).select(
        F.col(source).alias("_d_source"), F.col("bucket").alias("_d_bucket"))
    hint = F.broadcast if differ.count() <= MAX_CATALOG_ROWS * 10 else (lambda d: d)
    kind = dict(contributors.dtypes)[source]
    c = contributors.withColumn("_bucket", key_bucket(key, buckets))
    met = F.col(source).eqNullSafe(F.col("_d_source")) & (F.col("_bucket") == F.col("_d_bucket"))
    equal = c.join(hint(differ), met, "left_anti").select(source, key, F.lit(IN_SYNC).alias("status"))
    open_ = c.join(hint(differ), met, "left_semi")
    m = master.withColumn("_bucket", key_bucket(key, buckets)).join(
        hint(differ.select("_d_bucket").distinct()), F.col("_bucket") == F.col("_d_bucket"), "left_semi")
    # MISSING: the sources for which the master row's bucket differs, less those that hold its key
    want = differ.groupBy("_d_bucket").agg(F.collect_set(F.struct(F.col("_d_source").cast(kind).alias("s"))).alias("_want"))
    have = open_.groupBy(F.col(key).alias("_seen_key")).agg(F.collect_set(F.struct(F.col(source).alias("s"))).alias("_have"))
    missing = (m.select(key, "_bucket").join(hint(want), F.col("_bucket") == F.col("_d_bucket"))
               .join(have, F.col(key).eqNullSafe(F.col("_seen_key")), "left")
               .select(F.explode(F.when(F.col("_have").isNull(), F.col("_want"))
                                 .otherwise(F.array_except("_want", "_have"))).alias("_s"), key)
               .select(F.col("_s")["s"].alias(source), key, F.lit(MISSING).alias("status")))
    return equal.unionByName(statuses(open_, m, key, compare_cols, source)).unionByName(missing)


def merge_master_wins(master: DataFrame, contributors: DataFrame, key: str,
                      catalog: DataFrame, source: str = "source",
                      read_only: str = "read_only") -> DataFrame:
    """J10 merge with ``master_wins``: each writable contributor ends with every
    master row (master values win on shared keys) plus its own extra keys.
    Read-only contributors are skipped (not in the output). A NULL key is a key and a
    NULL source a source."""
    writable = catalog.filter(~F.col(read_only)).select(source)
    names = _bounded_names(writable, source, null=True)
    kind = dict(contributors.dtypes)[source]
    m = master.withColumn(source, F.explode(F.array(*[F.lit(n).cast(kind) for n in names])))
    held = master.select(F.col(key).alias("_held_key"))
    extra = contributors.filter(_is_one_of(F.col(source), names)).join(
        held, F.col(key).eqNullSafe(F.col("_held_key")), "left_anti")
    return m.unionByName(extra.select(*m.columns))


# ---------------------------------------------------------------- J8
def hierarchy_edges(catalog: DataFrame, name: str = "name", path: str = "path",
                    is_master: str = "is_master") -> DataFrame:
    """J8 (re-aimed): master -> contributor edges, and contributor -> folder
    membership edges (two contributors are related when they share a folder).
    Emits one row per contributor per master and one per contributor, never
    all pairs of a folder. Columns: (src, dst, kind). A master without a name has no edges."""
    masters = _bounded_names(catalog.filter(F.col(is_master)), name, 64)
    repos = catalog.filter(~F.col(is_master))
    out = repos.select(F.concat(F.lit("folder:"), parent_folder(path)).alias("dst"),
                       F.col(name).alias("src"), F.lit("member_of").alias("kind"))
    for m in masters:
        out = out.unionByName(repos.select(F.lit(m).alias("src"), F.col(name).alias("dst"),
                                           F.lit("master_of").alias("kind")))
    return out.select("src", "dst", "kind")


def folder_sizes(edges: DataFrame) -> DataFrame:
    """Members per folder, from the membership edges (who is related to whom
    without enumerating pairs)."""
    return (edges.filter(F.col("kind") == "member_of").groupBy(F.col("dst").alias("folder"))
                 .agg(F.count(F.lit(1)).alias("members")))


# ---------------------------------------------------------------- J9
def route_requests(requests: DataFrame, cached: DataFrame, sources: DataFrame,
                   predictions: DataFrame, data_id: str = "data_id",
                   preferred: str = "preferred_source") -> DataFrame:
    """Where each request is served from, in order: a valid cached copy
    ('cache'), the preferred source if connected, the best-ranked connected
    predicted source for the data id, the connected master, else ''.

    ``cached``: (data_id) with a valid copy. ``sources``: (name, connected,
    is_master), catalog-sized. ``predictions``: (data_id, source, rank). A NULL
    data id is a data id like any other; a source without a name serves nobody.
    """
    conn = sources.filter(F.col("connected"))
    up = _bounded_names(conn, "name")  # catalog-sized: checked before it becomes literals
    masters = _bounded_names(conn.filter(F.col("is_master")), "name", 64)
    best = (predictions.filter(F.col("source").isin(up)).groupBy(F.col(data_id).alias("_best_id"))
                       .agg(F.min_by("source", F.struct("rank", "source")).alias("_pred")))
    copies = cached.select(F.col(data_id).alias("_copy_id")).distinct().withColumn("_cached", F.lit(True))
    r = (requests.withColumn("_pref_ok", F.col(preferred).isin(up))
                 .join(copies, F.col(data_id).eqNullSafe(F.col("_copy_id")), "left")
                 .join(best, F.col(data_id).eqNullSafe(F.col("_best_id")), "left"))
    master = F.lit(masters[0]) if masters else F.lit(None).cast("string")
    route = (F.when(F.col("_cached"), F.lit("cache"))
              .when(F.col("_pref_ok"), F.col(preferred))
              .when(F.col("_pred").isNotNull(), F.col("_pred"))
              .otherwise(F.coalesce(master, F.lit(""))))
    return r.withColumn("route", route).drop("_cached", "_pref_ok", "_pred", "_copy_id", "_best_id")


# ---------------------------------------------------------------- J15
def signal_fanout(signals: DataFrame, handlers: DataFrame, target: str = "target",
                  component: str = "component") -> DataFrame:
    """Deliver each signal to its target handler, or to every handler for
    target '*'. The handler list is catalog-sized (checked) and inlined, so a
    broadcast target becomes an explode + equi-join, not a cross join. A handler without
    a name cannot be addressed, a signal without a target reaches nobody."""
    names = _bounded_names(handlers, component)
    t = F.col(target)
    dest = F.when(t == "*", F.array(*[F.lit(n) for n in names])).otherwise(F.array(t))
    fan = signals.withColumn(component, F.explode(dest))
    return fan.join(handlers, component)  # a name may hold many handlers: their size decides the join


# ---------------------------------------------------------------- J4
def duplicate_groups(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """J4 (re-aimed): content hash per row and the group it belongs to: the
    smallest id with the same hash is the canonical copy, ``copies`` the group
    size. One row per input row, no pairs."""
    h = df.select(id_col, F.md5(content).alias("content_hash"))
    groups = h.groupBy("content_hash").agg(F.min(id_col).alias("canonical_id"),
                                           F.count(F.lit(1)).alias("copies"))
    return h.join(groups, "content_hash")
