"""Bindings of readers and writers (S2-S4, S6, S8, S13, F10, F11): round trips of whole tables.

Every query writes a table in the form a source or sink has, under the shared
checkpoint folder, and reads it back; the SQL twin reads the given table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.common import table
from tessera.session import scratch_path
from tessera.sources import io

_ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _by_status(orders):
    """Three parts that make up all rows: finished, open, the rest (NULLs too)."""
    of = F.coalesce("o_orderstatus", F.lit(""))
    return orders.where(of == "F"), orders.where(of == "O"), orders.where(~of.isin("F", "O"))


def read_any_formats(spark, sf_dir):
    """Three datasets by name; where a name has several formats, Parquet goes before JSON before CSV."""
    o, base = _orders(spark, sf_dir), scratch_path(spark, "read-any")
    done, open_, rest = _by_status(o)
    done.write.parquet(f"{base}/first.parquet")
    open_.write.json(f"{base}/first.json")
    open_.write.json(f"{base}/second.json")
    done.write.option("header", True).csv(f"{base}/second.csv")
    rest.write.option("header", True).csv(f"{base}/third.csv")
    schema = spark.createDataFrame([], _ORDER).schema
    out = None
    for name in ("first", "second", "third"):
        df = io.read_any(spark, base, name, schema).select(F.lit(name).alias("dataset"), *schema.names)
        out = df if out is None else out.unionByName(df)
    return out


def latest_snapshot(spark, sf_dir):
    """S3: of the snapshots of a table, the newest by modification time, whatever the names say."""
    o, base = _orders(spark, sf_dir), scratch_path(spark, "snapshots")
    o.where(F.col("o_orderstatus") == "F").write.parquet(f"{base}/orders_9.parquet")
    o.write.parquet(f"{base}/orders_1.parquet")
    return spark.read.schema(_ORDER).parquet(io.latest_file(spark, f"{base}/orders_*.parquet"))


def sources_stacked(spark, sf_dir):
    """A Parquet master and two CSV contributors, one of them without a column, in one typed frame."""
    c, base = table(spark, sf_dir, "customer"), scratch_path(spark, "sources")
    c.write.parquet(f"{base}/master")
    c.where(F.col("c_mktsegment") == "BUILDING").write.option("header", True).csv(f"{base}/building")
    c.where(F.col("c_acctbal") < 0).select("c_acctbal", "c_custkey", "c_nationkey") \
        .write.option("header", True).csv(f"{base}/debtors")
    return io.read_sources(spark, [
        {"name": "master", "path": f"{base}/master", "priority": 100},
        {"name": "building", "path": f"{base}/building", "priority": 50, "format": "csv", "glob": "*.csv"},
        {"name": "debtors", "path": f"{base}/debtors", "priority": 25, "format": "csv", "glob": "*.csv"}])


def history_appended(spark, sf_dir):
    """Rows appended in three calls; earlier files stay, folders split by status."""
    o, base = _orders(spark, sf_dir), scratch_path(spark, "history")
    for part in _by_status(o):
        io.append_rows(part, f"{base}/sync", partition_by=["o_orderstatus"])
    return spark.read.schema(_ORDER).parquet(f"{base}/sync").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                                    "o_totalprice")


def json_rows(spark, sf_dir):
    """JSON rows appended in two calls, in folders by priority; NULL fields come back as NULL."""
    o, base = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.regexp_replace("o_orderpriority", r"[^A-Z0-9]+", "_").alias("priority"),
        (F.col("o_totalprice") > 100000).alias("large")), scratch_path(spark, "json")
    io.write_json_rows(o.where("large"), f"{base}/rows", partition_by=["priority"])
    io.write_json_rows(o.where("NOT large"), f"{base}/rows", partition_by=["priority"])
    return spark.read.schema("o_orderkey long, price double, large boolean, priority string").json(f"{base}/rows")


def feature_list(spark, sf_dir):
    """Names by their number of parts, as one JSON document, read back with ranks."""
    p, base = table(spark, sf_dir, "part"), scratch_path(spark, "features")
    count = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p_brand")))  # brands: a fixed list
    doc = count.agg(ranked.alias("r")).select(F.col("r.p_brand").alias("features"), F.size("r").cast("long").alias("count"))
    io.write_feature_list(doc, f"{base}/features.json")
    return io.read_feature_list(spark, f"{base}/features.json")


def frequency_map(spark, sf_dir):
    """frequencies of event types as a map, looked up for every event; a missing key gives the default."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    # event types: a fixed list, so the map is small
    m = e.where("event_type <> 'view'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    look = F.coalesce(F.try_element_at(m.scalar(), F.col("event_type")), F.lit(-1).cast("long"))
    return e.select("event_id", look.alias("frequency"))


def json_metadata(spark, sf_dir):
    """columns dumped as JSON text and parsed back, nested and with a map."""
    e = table(spark, sf_dir, "events")
    dumped = e.select("event_id", F.to_json(F.struct(
        "user_id", F.from_json("props", "map<string,long>").alias("props"),
        F.struct("event_type", "value").alias("result"))).alias("meta"))
    kind = "user_id long, props map<string,long>, result struct<event_type:string,value:double>"
    back = dumped.withColumn("m", F.from_json("meta", kind))
    return back.select("event_id", F.col("m.user_id").alias("user_id"), F.try_element_at("m.props", F.lit("k")).alias("k"),
                       F.get_json_object("meta", "$.result.event_type").alias("event_type"),
                       F.col("m.result.value").alias("value"))


QUERIES = {
    "read_any_formats": read_any_formats, "latest_snapshot": latest_snapshot, "sources_stacked": sources_stacked,
    "history_appended": history_appended, "json_rows": json_rows, "feature_list": feature_list,
    "frequency_map": frequency_map, "json_metadata": json_metadata,
}

_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"

ORACLE = {
    "read_any_formats": f"""SELECT CASE o_orderstatus WHEN 'F' THEN 'first' WHEN 'O' THEN 'second' ELSE 'third' END
        AS dataset, {_COLS} FROM orders""",
    "latest_snapshot": f"SELECT {_COLS} FROM orders",
    "sources_stacked": """SELECT *, 'master' AS source, 100 AS priority FROM customer UNION ALL
        SELECT *, 'building', 50 FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL
        SELECT c_custkey, NULL, c_nationkey, c_acctbal, NULL, 'debtors', 25 FROM customer WHERE c_acctbal < 0""",
    "history_appended": f"SELECT {_COLS} FROM orders",
    "json_rows": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
        o_totalprice > 100000 AS large, regexp_replace(o_orderpriority, '[^A-Z0-9]+', '_', 'g') AS priority FROM orders""",
    "feature_list": """SELECT row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank, p_brand AS feature
        FROM part GROUP BY p_brand""",
    "frequency_map": """SELECT event_id, coalesce(n, -1) AS frequency FROM events LEFT JOIN (
        SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1) USING (event_type)""",
    "json_metadata": """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type,
        value FROM events""",
}
