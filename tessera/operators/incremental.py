"""Incremental processing: which keys a run touches.

Key tables grow with the data (hundreds of millions of titles), so joins on
them are never forced to broadcast: Catalyst/AQE pick a sort-merge or a
broadcast from the runtime size. Anti and semi joins emit each left row at most
once, so duplicates on the right cannot fan out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_MODES = ("FULL_BUILD", "INCREMENTAL", "EQUATION_UPDATE", "VALIDATION_ONLY")


def new_keys(arrivals: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Arrivals whose key was never processed (left anti)."""
    return arrivals.join(processed.select(key), key, "left_anti")


def seen_keys(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key was processed before (left semi, membership test)."""
    return rows.join(processed.select(key), key, "left_semi")


def select_rows(mode: str, titles: DataFrame, processed: DataFrame, arrivals: DataFrame,
                key: str) -> DataFrame:
    """The title rows a run of ``mode`` touches.

    FULL_BUILD: every title. INCREMENTAL: titles that arrived and were never
    processed. EQUATION_UPDATE: titles processed before. VALIDATION_ONLY: none
    (the run writes nothing), as an empty frame with the same schema.
    """
    mode = mode.upper()
    if mode not in RUN_MODES:
        raise ValueError(f"unknown run mode {mode!r}")
    if mode == "FULL_BUILD":
        return titles
    if mode == "INCREMENTAL":
        todo = new_keys(arrivals.select(key).distinct(), processed, key)
        return seen_keys(titles, todo, key)
    if mode == "EQUATION_UPDATE":
        return seen_keys(titles, processed, key)
    return titles.limit(0)


def complete_run(processed: DataFrame, arrivals: DataFrame, key: str,
                 run_ts_col: str | None = None) -> DataFrame:
    """U1 + U3: processed := processed UNION arrivals, one row per key.

    With ``run_ts_col`` the earliest run time per key is kept, so a key keeps
    the run that first processed it (re-adding a key is a no-op).
    """
    if run_ts_col is None:
        return processed.select(key).unionByName(arrivals.select(key)).dropDuplicates([key])
    both = processed.select(key, run_ts_col).unionByName(arrivals.select(key, run_ts_col))
    return both.groupBy(key).agg(F.min(run_ts_col).alias(run_ts_col))


def state_summary(processed: DataFrame, key: str, sample: int = 1000) -> DataFrame:
    """S11 state row: key count and the first ``sample`` keys in key order.

    The sample is a bounded top-k (TakeOrdered), never the whole set.
    """
    n = processed.agg(F.count(F.lit(1))).scalar()  # scalar subquery
    keys = (processed.select(F.col(key).cast("string").alias("k")).orderBy("k").limit(sample)
                     .agg(F.sort_array(F.collect_list("k")).alias("sample_keys")))
    return keys.select(n.alias("processed_count"), "sample_keys")


def write_version(df: DataFrame, base: str, version: str) -> str:
    """Write a key table to a new version folder; readers switch to it
    only after the write finished, so no path is overwritten while read."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_latest_version(spark, base: str) -> DataFrame:
    """Read the newest complete version folder: the highest ``v=``, numbers by value, before
    names (by text)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    def rank(name):
        version = name.removeprefix("v=")
        return (not version.isdecimal(), int(version) if version.isdecimal() else 0, version)

    versions = sorted((st.getPath().getName() for st in fs.listStatus(jvm_path)
                      if st.isDirectory() and st.getPath().getName().startswith("v=")
                      and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))), key=rank)
    if not versions:
        raise FileNotFoundError(f"no complete version under {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/{versions[-1]}")
