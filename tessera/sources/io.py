"""Readers and writers.

File discovery (``read_any``, ``latest_file``) looks at file-system metadata
only, through the Hadoop FileSystem of the session, so it works the same on
local disk, HDFS or an object store. Data never passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The order in which a dataset name is looked up.
FORMAT_ORDER = ("parquet", "json", "csv")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None,
               fallback: str | None = None) -> DataFrame:
    """Parquet read, optionally from a fallback path when the first is
    missing. Selecting ``columns`` right away lets the scan read only them."""
    use = path if path_exists(spark, path) or fallback is None else fallback
    df = spark.read.parquet(use)
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, base: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Find ``name`` under ``base`` as .parquet, then .json, then .csv.

    CSV is read with a header and, when given, an explicit schema (no
    inference pass over the data).
    """
    for fmt in FORMAT_ORDER:
        path = f"{base.rstrip('/')}/{name}.{fmt}"
        if not path_exists(spark, path):
            continue
        if fmt == "parquet":
            return spark.read.parquet(path)
        reader = spark.read.schema(schema) if schema is not None else spark.read
        if fmt == "json":
            return reader.json(path)
        return reader.option("header", True).csv(path) if schema is not None else \
            reader.option("header", True).option("inferSchema", True).csv(path)
    raise FileNotFoundError(f"{name} not found under {base} as {', '.join(FORMAT_ORDER)}")


def latest_file(spark: SparkSession, pattern: str) -> str:
    """S3: the newest dataset matching a glob (a single file or a dataset
    folder), by modification time, ties by path. Only metadata is listed."""
    fs, p = _fs(spark, pattern)
    st = fs.globStatus(p)
    files = [(s.getModificationTime(), s.getPath().toString()) for s in (st or [])]
    if not files:
        raise FileNotFoundError(pattern)
    return max(files)[1]


def with_file_info(df: DataFrame) -> DataFrame:
    """File path and modification time of every row (hidden ``_metadata``)."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_modification_time").alias("file_mtime"))


def read_sources(spark: SparkSession, specs: list[dict], fmt: str = "parquet",
                 glob: str | None = None, schema: StructType | None = None) -> DataFrame:
    """S4 + U4: master and contributors in one frame.

    ``specs``: ``{"name", "path", "priority"}`` per source (master first), with an own
    ``"format"`` and ``"glob"`` where they differ. Each is tagged with ``source`` and
    ``priority`` and stacked by column name (missing columns become NULL). CSV columns
    take the types of ``schema``, else of the first source that has the column typed, so
    a CSV contributor equals a Parquet master; a value that does not fit its type fails.
    """
    out, types = None, {f.name: f.dataType for f in schema} if schema else {}
    for s in specs:
        kind, only = s.get("format", fmt), s.get("glob", glob)
        r = spark.read.format(kind)
        if only:
            r = r.option("pathGlobFilter", only)
        if kind == "csv":
            r = r.option("header", True)
        df = r.load(s["path"])
        if kind == "csv":
            df = df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
                             for c in df.columns])
        else:
            types = {f.name: f.dataType for f in df.schema} | types
        df = df.withColumn("source", F.lit(s["name"])).withColumn("priority", F.lit(int(s["priority"])))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a table folder (new files only, never rewrites)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_rows(df: DataFrame, path: str, partition_by: list[str] | None = None,
                    single_file: bool = False) -> None:
    """JSON sink. ``single_file`` only for summary-sized frames."""
    d = df.coalesce(1) if single_file else df
    w = d.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """``{"features": [...], "count": n}`` -> (rank, feature)."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.posexplode("features").alias("pos", "feature")).select(
        (F.col("pos") + 1).cast("long").alias("rank"), "feature")


def write_feature_list(features: DataFrame, path: str) -> None:
    """S8 for D6: one JSON document ``{"features": [...], "count": n}``."""
    features.coalesce(1).write.mode("overwrite").json(path)


def write_keyed_table(df: DataFrame, table: str, key: str, buckets: int, sort: bool = True) -> None:
    """Store a large keyed table (the master) bucketed by ``key``.

    Joins on ``key`` against it (reconcile, merge, priority winner) then read
    it already hash-partitioned: Spark shuffles only the other side into the
    same ``buckets`` partitions, and the master is not shuffled on every sync.
    """
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key)
    if sort:
        w = w.sortBy(key)
    w.saveAsTable(table)


def normalise_catalog(df: DataFrame) -> DataFrame:
    """Source catalog rows as stored by the original (0/1 integers, JSON
    text) to typed columns: BOOLEAN flags and ``metadata`` as MAP<STRING,STRING>."""
    out = df
    for c in ("is_master", "read_only"):
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("int") == 1)
    if "metadata" in df.columns:
        out = out.withColumn("metadata", F.from_json(F.col("metadata"), "map<string,string>"))
    return out


def normalise_sync_history(df: DataFrame) -> DataFrame:
    """Sync-history rows: epoch seconds (REAL) to TIMESTAMP, 0/1 success
    to BOOLEAN."""
    return (df.withColumn("timestamp", F.timestamp_seconds(F.col("timestamp").cast("double")))
              .withColumn("success", F.col("success").cast("int") == 1))
