"""Exact deduplication with disk-backed streaming state.

A Structured Streaming aggregate keyed by the digest of the text keeps, without
expiry, the digest, the stable identifier of the row that stays and its content
locator (the file it was read from). The state lives in RocksDB under the
shared checkpoint folder and is read back with the ``statestore`` source. Every
digest that was hit more than once is then checked on the full bytes: its rows
are grouped by (digest, text). The partial aggregation collapses equal texts
inside each task before anything is shuffled, so a group that holds a third of
all rows is not moved. If a digest ever covers two different texts, its rows
are resolved by text instead.

Only DataFrame / SQL functions run; no Python on the executors.

Defined cases: NULL counts as the empty text; of equal texts the row with the
largest identifier stays (NULL identifiers rank lowest); of rows repeated whole,
exactly one stays; an empty table gives an empty result; input columns never
clash because only (identifier, text) enter and working columns are local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, one_per_key
from tessera.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
#: many small stores: do not let each one reserve disk ahead
STATE_CONF = {PROVIDER_CONF: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def stream_state(keyed: DataFrame, max_bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """Run the keyed stream over the written ``keyed`` table; returns its final state.

    ``keyed`` must have been read from files: (digest, id, rid, place). Micro-batches
    are bounded by ``max_bytes_per_trigger``; state never expires.
    """
    spark = keyed.sparkSession
    checkpoint = scratch_path(spark, "dedup-state")
    previous = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        source = (spark.readStream.schema(keyed.schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger))
                  .parquet(_folder(keyed)))
        state = source.groupBy("digest").agg(
            F.max(F.struct(F.col("id").isNotNull(), "id", "rid", "place")).alias("stay"),
            F.count(F.lit(1)).alias("n"))
        run = (state.writeStream.format("noop").outputMode("update")
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        run.awaitTermination()
    finally:
        for k, v in previous.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if not run.lastProgress:  # nothing arrived: there is no state to read
        return spark.createDataFrame([], f"digest string, stay struct<known:boolean,"
                                         f"id:{keyed.schema['id'].dataType.simpleString()},rid:bigint,place:string>, n bigint")
    stored = spark.read.format("statestore").load(checkpoint)
    fields = stored.schema["value"].dataType.fieldNames()
    stay, n = F.col("value")[fields[0]], F.col("value")[fields[1]]
    return stored.select(
        F.col("key")["digest"].alias("digest"),
        F.struct(*[stay[f].alias(a) for f, a in zip(
            stored.schema["value"].dataType[fields[0]].dataType.fieldNames(),
            ("known", "id", "rid", "place"))]).alias("stay"),
        n.alias("n"))


def _folder(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest=sha256_text) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, place.

    ``digest`` is a column function; a weak one is still right (the byte check
    separates its collisions), only slower.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"))
    keyed = materialise(
        docs.select(digest(F.col("text")).alias("digest"), "id",
                    F.monotonically_increasing_id().alias("rid"),
                    F.input_file_name().alias("place")), "dedup-keys")
    state = materialise(stream_state(keyed), "dedup-seen")

    # full bytes of every hit; keyed by (id, digest) so a hot digest does not meet in one task
    hits = keyed.join(state.where("n > 1").select("digest"), "digest", "left_semi") \
        .select(_row_key("id", "digest").alias("k")).distinct()
    texts = docs.withColumn("digest", digest(F.col("text"))).withColumn("k", _row_key("id", "digest"))
    classes = (texts.join(hits, "k", "left_semi").groupBy("digest", "text")
               .agg(F.max(F.struct(F.col("id").isNotNull(), "id")).alias("top"),
                    F.count(F.lit(1)).alias("n"))
               .select("digest", sha256_text(F.col("text")).alias("sha"), F.length("text").alias("chars"),
                       F.col("top")["id"].alias("top"), "n"))
    seen = materialise(classes, "dedup-classes")
    mixed = materialise(seen.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
                        .where("texts > 1").select("digest"), "dedup-mixed")

    plain = keyed.join(state, "digest").select(
        "id", F.col("stay")["id"].alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("stay")["rid"]).alias("kept"), "digest",
        F.col("stay")["place"].alias("place"))
    if mixed.isEmpty():
        return plain
    return plain.join(mixed, "digest", "left_anti").unionByName(_by_text(df, mixed, docs, digest))


def _by_text(df, mixed, docs, digest) -> DataFrame:
    """Rows whose digest covers several texts, resolved on the texts themselves."""
    rows = materialise(docs.withColumn("digest", digest(F.col("text")))
                       .join(mixed, "digest", "left_semi")
                       .withColumn("rid", F.monotonically_increasing_id())
                       .withColumn("place", F.input_file_name()), "dedup-collisions")
    top = rows.groupBy("digest", "text").agg(
        F.max(F.struct(F.col("id").isNotNull(), "id", "rid", "place")).alias("stay"),
        F.count(F.lit(1)).alias("n"))
    return rows.select("id", "digest", "text", "rid").join(top, ["digest", "text"]).select(
        "id", F.col("stay")["id"].alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("stay")["rid"]).alias("kept"), "digest",
        F.col("stay")["place"].alias("place"))


def _row_key(id_col: str, digest_col: str) -> Column:
    """One non-NULL string per (id, digest)."""
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(digest_col))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns. Of rows equal in identifier and text one
    stays: the first by its other columns as JSON text."""
    groups = exact_groups(df, id_col, text_col)
    key = "_row_key"
    while key in df.columns:
        key += "_"
    stay = groups.where("kept").select(_row_key("id", "digest").alias(key))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.withColumn(key, F.concat_ws(
        "|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), sha256_text(text)))
    return one_per_key(keyed.join(stay, key, "left_semi"), key, [id_col, text_col]).drop(key)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
