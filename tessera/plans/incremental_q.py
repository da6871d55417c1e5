"""Bindings for incremental runs.

titles = orders (key o_orderkey stands in for the title id);
arrivals = orders placed from 1998-07-01 on;
processed = orders with a line shipped before 1999-01-01.
Both sets overlap, so anti and semi results are non-trivial.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import incremental, keystore
from tessera.plans.common import table
from tessera.session import checkpoint_dir, scratch_path

KEY = "o_orderkey"


def _sets(spark, sf_dir):
    titles = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    arrivals = titles.filter(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz"))
    li = table(spark, sf_dir, "lineitem")
    processed = (li.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
                   .select(F.col("l_orderkey").alias(KEY)).distinct())
    return titles, arrivals, processed


def arrivals_anti(spark, sf_dir):
    t, a, p = _sets(spark, sf_dir)
    return incremental.select_rows("INCREMENTAL", t, p, a, KEY)


def reprocess_semi(spark, sf_dir):
    t, a, p = _sets(spark, sf_dir)
    return incremental.select_rows("EQUATION_UPDATE", t, p, a, KEY)


def processed_union(spark, sf_dir):
    t, a, p = _sets(spark, sf_dir)
    return incremental.complete_run(p, a, KEY)


def processed_state(spark, sf_dir):
    t, a, p = _sets(spark, sf_dir)
    merged = incremental.complete_run(p, a, KEY)
    return incremental.state_summary(merged, KEY).select(
        "processed_count", F.size("sample_keys").cast("long").alias("sample_size"),
        F.element_at("sample_keys", 1).alias("first_key"))


def arrivals_keystore(spark, sf_dir):
    """Arrivals not processed before, by the key store; processed keys come in three batches."""
    t, a, p = _sets(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(KEY), F.year("l_shipdate").alias("y"))
    checkpoint_dir(spark)
    store = scratch_path(spark, "processed-keys")
    for batch, years in enumerate(((0, 1993), (1994, 1995), (1996, 1998))):
        keys = li.where(F.col("y").between(*years)).select(KEY).distinct()
        keystore.add(spark, store, keystore.unseen(spark, store, keys, KEY).checkpoint(), KEY, batch)
    return keystore.unseen(spark, store, a, KEY)


QUERIES = {
    "arrivals_keystore": arrivals_keystore,
    "arrivals_anti": arrivals_anti,
    "reprocess_semi": reprocess_semi,
    "processed_union": processed_union,
    "processed_state": processed_state,
}

_SETS = """
WITH titles AS (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders),
arrivals AS (SELECT * FROM titles WHERE o_orderdate >= TIMESTAMP '1998-07-01'),
processed AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')
"""

ORACLE = {
    "arrivals_keystore": _SETS + """SELECT * FROM arrivals a
        WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.o_orderkey = a.o_orderkey)""",
    "arrivals_anti": _SETS + """SELECT * FROM titles t WHERE o_orderkey IN (SELECT o_orderkey FROM arrivals)
        AND NOT EXISTS (SELECT 1 FROM processed p WHERE p.o_orderkey = t.o_orderkey)""",
    "reprocess_semi": _SETS + """SELECT * FROM titles t
        WHERE EXISTS (SELECT 1 FROM processed p WHERE p.o_orderkey = t.o_orderkey)""",
    "processed_union": _SETS + "SELECT o_orderkey FROM processed UNION SELECT o_orderkey FROM arrivals",
    "processed_state": _SETS + """, u AS (SELECT o_orderkey FROM processed UNION SELECT o_orderkey FROM arrivals)
        SELECT count(*) AS processed_count,
               CAST(least(count(*), 1000) AS BIGINT) AS sample_size,
               (SELECT min(CAST(o_orderkey AS VARCHAR)) FROM u) AS first_key FROM u""",
}
