"""Processed keys as runs of hash buckets with a Bloom filter each (S11, S12, ST1).

A store is a folder of runs, one per batch. A run keeps its keys in hash buckets
(their number follows the run's size) and a blocked Bloom filter per bucket: every
key sets ``BITS`` bits of one 64-bit word. A membership check joins the batch's words
with the filters and opens only the buckets that may hold one of its keys, so a
batch of new keys reads about none of the earlier ones. ``FAN`` runs of one level are
compacted into one run of the next, so the number of runs grows with the logarithm
of the number of batches. A manifest version lists the runs; readers see a run or a
compaction only when its version is complete, and a replayed batch changes nothing.

NULL is a key like any other; an empty batch adds no run. Files of compacted runs
stay until the owner of the folder removes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.incremental import read_latest_version
from tessera.session import path_exists

FAN = 8
KEYS_PER_BUCKET = 1 << 18
MAX_BUCKETS = 4096
KEYS_PER_FILE = 1 << 22
FILTER_BITS_PER_KEY = 16
BITS = 4
_MANIFEST = "version long, run string, level int, last_batch long, n long, buckets int, words long"


def _bucket(key: str, buckets) -> Column:
    return F.pmod(F.xxhash64(key), buckets).cast("int")


def _word(key: str, words) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(1)), 6 * BITS), words)


def _mask(key: str) -> Column:
    """The ``BITS`` bits (equal ones fall together) that a key sets in its word."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(
        F.xxhash64(F.col(key), F.lit(1)), 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def runs(spark: SparkSession, base: str) -> list:
    """Rows of the newest manifest; at most ``FAN`` per level."""
    path = f"{base}/manifest"
    if not path_exists(spark, path):
        return []
    try:
        return read_latest_version(spark, path).collect()
    except FileNotFoundError:
        return []


def maybe_buckets(spark: SparkSession, base: str, keys: DataFrame, key: str) -> list[str]:
    """Folders of the buckets whose filter may hold one of the keys."""
    listed = runs(spark, base)
    if not listed:
        return []
    # at most FAN runs per level, so the list is short
    of_run = F.array(*[F.struct(F.lit(r.run).alias("run"), F.lit(r.buckets).alias("buckets"),
                                F.lit(r.words).alias("words")) for r in listed])
    probes = (keys.select(key, F.explode(of_run).alias("r"))
                  .select("r.run", _bucket(key, F.col("r.buckets")).alias("bucket"),
                          _word(key, F.col("r.words")).alias("word"), _mask(key).alias("mask")).distinct())
    filters = spark.read.schema("run string, bucket int, word long, bits long").parquet(
        *[f"{base}/filters/{r.run}" for r in listed])
    hits = (probes.join(filters, ["run", "bucket", "word"])
                  .where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("run", "bucket").distinct())
    return [f"{base}/runs/{r.run}/bucket={r.bucket}" for r in hits.orderBy("run", "bucket").collect()]


def unseen(spark: SparkSession, base: str, keys: DataFrame, key: str, before: int | None = None) -> DataFrame:
    """Rows of ``keys`` whose key no batch (below ``before``) has added; the filters only
    choose buckets, the keys themselves decide."""
    paths = maybe_buckets(spark, base, keys, key)
    if not paths:
        return keys
    kind = keys.schema[key].dataType.simpleString()
    seen = spark.read.schema(f"_seen {kind}, _batch long").parquet(*paths)
    if before is not None:
        seen = seen.where(F.col("_batch") < before)
    return keys.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")


def add(spark: SparkSession, base: str, keys: DataFrame, key: str, batch_id: int) -> None:
    """Add the keys of a batch (distinct, unseen before) as a run, then compact full levels.
    Batches come in ascending order; one that the store already holds is left out."""
    listed = runs(spark, base)
    if all(r.last_batch < batch_id for r in listed):
        rows = keys.select(F.col(key).alias("_seen"), F.lit(batch_id).cast("long").alias("_batch"))
        run = _write_run(spark, base, rows, f"b{batch_id}", 0, batch_id)
        if run is None:
            return
        listed = listed + [run]
        _commit(spark, base, listed)
    while full := [lv for lv in {r["level"] for r in listed} if sum(r["level"] == lv for r in listed) >= FAN]:
        level = min(full)
        old = [r for r in listed if r["level"] == level]
        kind = keys.schema[key].dataType.simpleString()
        rows = spark.read.schema(f"_seen {kind}, _batch long").option("recursiveFileLookup", "true").parquet(
            *[f"{base}/runs/{r['run']}" for r in old])
        last = max(r["last_batch"] for r in old)
        listed = [r for r in listed if r["level"] != level] + [
            _write_run(spark, base, rows, f"b{last}-l{level + 1}", level + 1, last)]
        _commit(spark, base, listed)


def _write_run(spark: SparkSession, base: str, rows: DataFrame, run: str, level: int, last: int) -> dict | None:
    n = rows.count()
    if n == 0:
        return None
    buckets = min(MAX_BUCKETS, -(-n // KEYS_PER_BUCKET))
    words = max(1, -(-n * FILTER_BITS_PER_KEY // (64 * buckets)))
    files = -(-n // (buckets * KEYS_PER_FILE))  # of a bucket
    placed = rows.withColumn("bucket", _bucket("_seen", F.lit(buckets)))
    part = F.pmod(F.xxhash64(F.col("_seen"), F.lit(2)), F.lit(files))
    placed.withColumn("part", part).repartition(buckets * files, "bucket", "part").drop("part") \
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/runs/{run}")
    (placed.groupBy("bucket", _word("_seen", F.lit(words)).alias("word")).agg(F.bit_or(_mask("_seen")).alias("bits"))
           .select(F.lit(run).alias("run"), "bucket", "word", "bits")
           .write.mode("overwrite").parquet(f"{base}/filters/{run}"))
    return {"run": run, "level": level, "last_batch": last, "n": n, "buckets": buckets, "words": words}


def _commit(spark: SparkSession, base: str, listed: list) -> None:
    old = runs(spark, base)
    version = (old[0].version if old else 0) + 1
    rows = [(version, r["run"], r["level"], r["last_batch"], r["n"], r["buckets"], r["words"]) for r in listed]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/v={version}")
