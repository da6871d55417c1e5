"""Query bindings on the driver tables and their DuckDB oracle SQL.

Each sub-module defines ``QUERIES`` (name -> callable(spark, sf_dir)) and
``ORACLE`` (name -> SQL). ``registry()`` merges them.
"""

from __future__ import annotations


def registry():
    from tessera.plans import (profile_q, metrics_q, incremental_q, access_q, views_q,
                               catalog_q, quality_q, audit_q, state_q, ml_q, stream_q, sources_q)
    queries, oracle = {}, {}
    for mod in (profile_q, metrics_q, incremental_q, access_q, views_q, catalog_q,
                quality_q, audit_q, state_q, ml_q, stream_q, sources_q):
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle
