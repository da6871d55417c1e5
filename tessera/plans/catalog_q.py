"""Bindings for sources: reconciliation, merge, priorities, upsert,
checksums, hierarchy, routing, signal fan-out and duplicate content.

master = part. Contributors derived from it by attribute (not by key):
repo_1 (priority 50): parts of size <= 40, Brand#3 prices +1.0;
repo_2 (priority 45): parts not of type ECONOMY, plus parts of size > 45
re-keyed by +1,000,000 (rows the master lacks);
repo_3 (priority 40, read-only): all parts, names upper-cased for size < 5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import access, catalog
from tessera.plans.common import table

COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CMP = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _contributors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(*COLS)
    r1 = (p.filter(F.col("p_size") <= 40)
           .withColumn("p_retailprice", F.when(F.col("p_brand") == "Brand#3", F.col("p_retailprice") + 1.0)
                       .otherwise(F.col("p_retailprice"))))
    r2 = (p.filter(F.col("p_type") != "ECONOMY")
           .unionByName(p.filter(F.col("p_size") > 45).withColumn("p_partkey", F.col("p_partkey") + 1_000_000)))
    r3 = p.withColumn("p_name", F.when(F.col("p_size") < 5, F.upper("p_name")).otherwise(F.col("p_name")))
    out = None
    for name, df, prio in (("repo_1", r1, 50), ("repo_2", r2, 45), ("repo_3", r3, 40)):
        d = df.withColumn("source", F.lit(name)).withColumn("priority", F.lit(prio))
        out = d if out is None else out.unionByName(d)
    return p, out


def _catalog_df(spark):
    return spark.createDataFrame(
        [("master", True, 100, False), ("repo_1", False, 50, False), ("repo_2", False, 45, False),
         ("repo_3", False, 40, True)], "source string, is_master boolean, priority int, read_only boolean")


def _decimal(df, col):
    """Prices as DECIMAL(38,6): a text that other engines spell alike."""
    return df.withColumn(col, F.col(col).cast("decimal(38,6)"))


def reconcile(spark, sf_dir):
    m, c = _contributors(spark, sf_dir)
    return catalog.reconcile(m, c, "p_partkey", CMP)


def reconcile_summary(spark, sf_dir):
    return reconcile(spark, sf_dir).groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def merge_master_wins(spark, sf_dir):
    m, c = _contributors(spark, sf_dir)
    merged = _decimal(catalog.merge_master_wins(m, c.select(*COLS, "source"), "p_partkey", _catalog_df(spark)), "p_retailprice")
    c = _decimal(c, "p_retailprice")
    before = catalog.dataset_checksum(c.select(*COLS, "source"), COLS, ["source"]).select(
        "source", F.col("rows").alias("rows_in"), F.col("md5_sum").alias("sum_in"))
    after = catalog.dataset_checksum(merged, COLS, ["source"]).select(
        "source", F.col("rows").alias("rows_out"), F.col("md5_sum").alias("sum_out"))
    # DQ10: the merge must change the data it was given
    return after.join(before, "source").select(
        "source", "rows_in", "rows_out", (F.col("sum_in") != F.col("sum_out")).alias("changed"),
        F.col("sum_out").cast("string").alias("checksum_out"))


def priority_winner(spark, sf_dir):
    m, c = _contributors(spark, sf_dir)
    rows = m.withColumn("source", F.lit("master")).withColumn("priority", F.lit(catalog.MASTER_PRIORITY)) \
            .unionByName(c)
    w = catalog.winner_by_priority(rows.select("p_partkey", "source", "priority", "p_retailprice"),
                                   ["p_partkey"])
    return w.select("p_partkey", "source", "priority", "p_retailprice")


def upsert_latest(spark, sf_dir):
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = od.withColumn("load_seq", F.lit(1))
    late = (od.filter(F.col("o_orderstatus") == "O")
              .withColumn("o_totalprice", F.col("o_totalprice") + 1.0)
              .withColumn("o_orderstatus", F.lit("F")).withColumn("load_seq", F.lit(2)))
    return catalog.upsert(old, late, ["o_orderkey"], ["load_seq"])


def dataset_checksum(spark, sf_dir):
    od = _decimal(table(spark, sf_dir, "orders"), "o_totalprice")
    return catalog.dataset_checksum(od).select(
        "rows", F.col("md5_sum").cast("string").alias("md5_sum"))


def dataset_sha256(spark, sf_dir):
    """SHA-256 lanes of the orders per status, prices in whole cents."""
    od = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return catalog.dataset_sha256(od, ["o_orderkey", "o_custkey", "cents", "o_orderpriority"], ["o_orderstatus"])


def reconcile_buckets(spark, sf_dir):
    """``reconcile`` through bucket sums: only buckets that differ are joined."""
    m, c = _contributors(spark, sf_dir)
    return catalog.reconcile_changed(m, c, "p_partkey", CMP)


def _pages_catalog(spark, sf_dir):
    pg = table(spark, sf_dir, "pages")
    first = pg.agg(F.min("page_id").alias("m")).first()["m"]
    return pg.select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("name"),
                     F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"),
                     (F.col("page_id") == F.lit(first)).alias("is_master"))


def source_hierarchy(spark, sf_dir):
    return catalog.hierarchy_edges(_pages_catalog(spark, sf_dir))


def folder_sizes(spark, sf_dir):
    return catalog.folder_sizes(catalog.hierarchy_edges(_pages_catalog(spark, sf_dir)))


def K():
    """The access key: props.k."""
    return F.get_json_object("props", "$.k")


def route_requests(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    req = ev.select("event_id", K().alias("data_id"), F.col("event_type").alias("preferred_source"))
    counts = req.groupBy("data_id").agg(F.count(F.lit(1)).alias("accesses"))
    tiers = access.tier_table(counts, key="data_id")
    cached = tiers.filter(F.col("tier") == "L1_HOT").select("data_id")
    sources = spark.createDataFrame(
        [(t, t != "error", t == "purchase") for t in ("view", "click", "signup", "purchase", "error")],
        "name string, connected boolean, is_master boolean")
    shares = access.transition_share(req.select(F.col("data_id").alias("source"),
                                                F.col("preferred_source").alias("target")))
    preds = access.next_targets(shares).select(F.col("source").alias("data_id"),
                                               F.col("target").alias("source"), "rank")
    return catalog.route_requests(req, cached, sources, preds).select(
        "event_id", "data_id", "preferred_source", "route")


def signal_fanout(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    sig_ = ev.select("event_id", F.when(F.col("event_type") == "error", F.lit("*"))
                     .otherwise(F.concat(F.col("event_type"), F.lit("_handler"))).alias("target"))
    handlers = (ev.select(F.concat(F.col("event_type"), F.lit("_handler")).alias("component"))
                  .filter(F.col("component") != "error_handler").distinct()
                  .withColumn("role", F.lit("AGENT")))
    return catalog.signal_fanout(sig_, handlers).select("event_id", "target", "component", "role")


def duplicate_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return catalog.duplicate_groups(docs, "doc_id", F.col("text"))


QUERIES = {
    "reconcile": reconcile, "reconcile_summary": reconcile_summary,
    "merge_master_wins": merge_master_wins, "priority_winner": priority_winner,
    "upsert_latest": upsert_latest, "dataset_checksum": dataset_checksum,
    "dataset_sha256": dataset_sha256, "reconcile_buckets": reconcile_buckets,
    "source_hierarchy": source_hierarchy, "folder_sizes": folder_sizes,
    "route_requests": route_requests, "signal_fanout": signal_fanout,
    "duplicate_content": duplicate_content,
}


def _canon(cols, types):
    parts = []
    for c in cols:
        x = f"CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR)" if types.get(c) == "double" else f"CAST({c} AS VARCHAR)"
        parts.append(f"coalesce(length({x}) || ':' || {x}, 'N')")
    return f"md5(concat_ws('|', {', '.join(parts)}))"


_PT = {"p_retailprice": "double"}
_CONTRIB = """WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part),
c AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size,
    CASE WHEN p_brand = 'Brand#3' THEN p_retailprice + 1.0 ELSE p_retailprice END AS p_retailprice,
    'repo_1' AS source, 50 AS priority FROM p WHERE p_size <= 40
  UNION ALL SELECT *, 'repo_2', 45 FROM p WHERE p_type <> 'ECONOMY'
  UNION ALL SELECT p_partkey + 1000000, p_name, p_brand, p_type, p_size, p_retailprice, 'repo_2', 45 FROM p WHERE p_size > 45
  UNION ALL SELECT p_partkey, CASE WHEN p_size < 5 THEN upper(p_name) ELSE p_name END, p_brand, p_type, p_size,
    p_retailprice, 'repo_3', 40 FROM p)
"""

_RECON = _CONTRIB + f""", mh AS (SELECT s.source, p_partkey, {_canon(CMP, _PT)} AS m_hash FROM p,
    (VALUES ('repo_1'), ('repo_2'), ('repo_3')) s(source)),
ch AS (SELECT source, p_partkey, {_canon(CMP, _PT)} AS c_hash FROM c),
r AS (SELECT coalesce(mh.source, ch.source) AS source, coalesce(mh.p_partkey, ch.p_partkey) AS p_partkey,
  CASE WHEN c_hash IS NULL THEN 'MISSING' WHEN m_hash IS NULL THEN 'EXTRA' WHEN m_hash = c_hash THEN 'IN_SYNC'
       ELSE 'STALE' END AS status
  FROM mh FULL OUTER JOIN ch ON mh.source = ch.source AND mh.p_partkey = ch.p_partkey)
"""


def _cks(expr):
    return f"sum(CAST('0x' || substr({expr}, 1, 15) AS HUGEINT))"


def _sha_lanes(cols):
    text = "concat_ws('|', " + ", ".join(
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in cols) + ")"
    lane = "sum(CAST('0x' || substr(h, {}, 8) AS HUGEINT)) % 4294967296"
    return text, " || ".join(f"printf('%08x', CAST({lane.format(8 * i + 1)} AS BIGINT))" for i in range(8))


_SHA_TEXT, _SHA_HEX = _sha_lanes(["o_orderkey", "o_custkey", "CAST(round(o_totalprice * 100) AS BIGINT)", "o_orderpriority"])

_EV = "json_extract_string(props, '$.k')"

ORACLE = {
    "reconcile": _RECON + "SELECT * FROM r",
    "reconcile_buckets": _RECON + "SELECT * FROM r",
    "dataset_sha256": f"""SELECT o_orderstatus, count(*) AS rows, {_SHA_HEX} AS sha256
        FROM (SELECT o_orderstatus, sha256({_SHA_TEXT}) AS h FROM orders) GROUP BY o_orderstatus""",
    "reconcile_summary": _RECON + "SELECT source, status, count(*) AS n FROM r GROUP BY ALL",
    "merge_master_wins": _CONTRIB + f""", merged AS (
        SELECT p.*, s.source FROM p, (VALUES ('repo_1'), ('repo_2')) s(source)
        UNION ALL SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, source FROM c
          WHERE source IN ('repo_1', 'repo_2') AND p_partkey NOT IN (SELECT p_partkey FROM p)),
      a AS (SELECT source, count(*) AS rows_out, {_cks(_canon(COLS, _PT))} AS sum_out FROM merged GROUP BY source),
      b AS (SELECT source, count(*) AS rows_in, {_cks(_canon(COLS, _PT))} AS sum_in FROM c GROUP BY source)
      SELECT a.source, rows_in, rows_out, sum_in <> sum_out AS changed, CAST(sum_out AS VARCHAR) AS checksum_out
      FROM a JOIN b ON a.source = b.source""",
    "priority_winner": _CONTRIB + """, rows AS (SELECT p_partkey, 'master' AS source, 100 AS priority, p_retailprice FROM p
        UNION ALL SELECT p_partkey, source, priority, p_retailprice FROM c)
        SELECT p_partkey, arg_max(source, (priority, source)) AS source, max(priority) AS priority,
          arg_max(p_retailprice, (priority, source)) AS p_retailprice FROM rows GROUP BY p_partkey""",
    "upsert_latest": """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS load_seq FROM orders
        UNION ALL SELECT o_orderkey, 'F', o_totalprice + 1.0, 2 FROM orders WHERE o_orderstatus = 'O')
        SELECT o_orderkey, arg_max(o_orderstatus, load_seq) AS o_orderstatus,
          arg_max(o_totalprice, load_seq) AS o_totalprice, max(load_seq) AS load_seq FROM o GROUP BY o_orderkey""",
    "dataset_checksum": f"""SELECT count(*) AS rows, CAST({_cks(_canon(
        ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'],
        {'o_totalprice': 'double'}))} AS VARCHAR) AS md5_sum FROM orders""",
    "source_hierarchy": """WITH c AS (SELECT 'page_' || CAST(page_id AS VARCHAR) AS name,
          regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path, page_id = (SELECT min(page_id) FROM pages) AS is_master
          FROM pages)
        SELECT name AS src, 'folder:' || regexp_extract(path, '^(.*)/[^/]*$', 1) AS dst, 'member_of' AS kind
          FROM c WHERE NOT is_master
        UNION ALL SELECT m.name, c.name, 'master_of' FROM c, (SELECT name FROM c WHERE is_master) m
          WHERE NOT c.is_master""",
    "folder_sizes": """SELECT 'folder:' || regexp_extract(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '^(.*)/[^/]*$', 1)
          AS folder, count(*) AS members FROM pages WHERE page_id <> (SELECT min(page_id) FROM pages) GROUP BY 1""",
    "route_requests": f"""WITH req AS (SELECT event_id, {_EV} AS data_id, event_type AS preferred_source FROM events),
        cnt AS (SELECT data_id, count(*) AS accesses FROM req GROUP BY data_id),
        rk AS (SELECT data_id, accesses, row_number() OVER (ORDER BY accesses DESC, data_id) AS rnk FROM cnt),
        cached AS (SELECT data_id FROM rk WHERE rnk <= 64 AND accesses >= 5),
        sh AS (SELECT data_id, preferred_source AS source, count(*) AS n FROM req GROUP BY ALL),
        sh2 AS (SELECT *, n / sum(n) OVER (PARTITION BY data_id) AS share FROM sh),
        pr AS (SELECT * FROM (SELECT data_id, source,
          row_number() OVER (PARTITION BY data_id ORDER BY share DESC, source) AS rank FROM sh2) WHERE rank <= 5),
        best AS (SELECT data_id, arg_min(source, (rank, source)) AS pred FROM pr WHERE source <> 'error' GROUP BY data_id)
        SELECT event_id, r.data_id, preferred_source,
          CASE WHEN c.data_id IS NOT NULL THEN 'cache' WHEN preferred_source <> 'error' THEN preferred_source
               WHEN b.pred IS NOT NULL THEN b.pred ELSE 'purchase' END AS route
        FROM req r LEFT JOIN cached c ON r.data_id = c.data_id LEFT JOIN best b ON r.data_id = b.data_id""",
    "signal_fanout": """WITH h AS (SELECT DISTINCT event_type || '_handler' AS component FROM events WHERE event_type <> 'error'),
        s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '*' ELSE event_type || '_handler' END AS target FROM events)
        SELECT event_id, target, component, 'AGENT' AS role FROM s JOIN h ON s.target = h.component OR s.target = '*'""",
    "duplicate_content": """WITH h AS (SELECT doc_id, md5(text) AS content_hash FROM documents),
        g AS (SELECT content_hash, min(doc_id) AS canonical_id, count(*) AS copies FROM h GROUP BY content_hash)
        SELECT h.content_hash, doc_id, canonical_id, copies FROM h JOIN g ON h.content_hash = g.content_hash""",
}
