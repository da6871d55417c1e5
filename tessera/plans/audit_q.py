"""Bindings for the audit chain on ``events``.

chain = user_id, order (ts, event_id), payload = '<event_id>:<event_type>'.
Tampering stand-in for verification: entries whose value exceeds 49.5 have
their payload altered after the chain was built.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audit, merkle
from tessera.plans.common import table
from tessera.session import scratch_path


def _entries(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    payload = F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type"))
    e = audit.entries(ev, F.col("user_id"), "ts", "event_id", payload, F.col("event_type"))
    return e, ev


def audit_chain(spark, sf_dir):
    e, _ = _entries(spark, sf_dir)
    return audit.build_chain(e)


def audit_chain_blocked(spark, sf_dir):
    e, _ = _entries(spark, sf_dir)
    return audit.build_chain(e, block_col=F.date_format("ts", "yyyy-MM-dd"))


def audit_digest(spark, sf_dir):
    e, _ = _entries(spark, sf_dir)
    return audit.block_digests(audit.build_chain(e, block_col=F.date_format("ts", "yyyy-MM-dd")))


def audit_verify(spark, sf_dir):
    e, ev = _entries(spark, sf_dir)
    chain = audit.build_chain(e)
    tampered = (e.join(ev.select(F.col("event_id").alias("entry_id"), "value"), "entry_id")
                 .withColumn("payload", F.when(F.col("value") > 49.5, F.concat(F.col("payload"), F.lit("*")))
                             .otherwise(F.col("payload"))))
    stored = tampered.select("chain", "entry_id", "ts", "payload").join(
        chain.select("entry_id", "entry_hash"), "entry_id")
    return audit.first_breaks(audit.verify_chain(stored))


def audit_merkle(spark, sf_dir):
    """Merkle roots of the chains of entry types (few long chains)."""
    e, _ = _entries(spark, sf_dir)
    path = scratch_path(spark, "merkle")
    levels = merkle.build_tree(e.withColumn("chain", F.col("event_type")), path)
    return merkle.roots(spark, path, levels)


def audit_merkle_differences(spark, sf_dir):
    """Entries whose payload was altered (see above), found by descending two trees."""
    e, ev = _entries(spark, sf_dir)
    e = e.withColumn("chain", F.col("event_type"))
    bad = e.join(ev.select(F.col("event_id").alias("_id"), "value"), F.col("entry_id") == F.col("_id")).withColumn(
        "payload", F.when(F.col("value") > 49.5, F.concat("payload", F.lit("*"))).otherwise(F.col("payload")))
    a, b = scratch_path(spark, "merkle"), scratch_path(spark, "merkle")
    found = merkle.differing_leaves(spark, a, b, merkle.build_tree(e, a), merkle.build_tree(bad, b))
    leaves = spark.read.parquet(f"{a}/level=0").select("chain", "idx", "entry_id")
    return found.join(leaves, ["chain", "idx"]).select("chain", F.col("idx").alias("place"), "entry_id")


def audit_counts(spark, sf_dir):
    e, _ = _entries(spark, sf_dir)
    return audit.event_counts(e)


def audit_recent(spark, sf_dir):
    e, _ = _entries(spark, sf_dir)
    return audit.recent_entries(e, 100).select("chain", "entry_id", "ts", "event_type",
                                               "machine_generated", "operator_editable")


QUERIES = {
    "audit_chain": audit_chain, "audit_chain_blocked": audit_chain_blocked,
    "audit_digest": audit_digest, "audit_verify": audit_verify,
    "audit_merkle": audit_merkle, "audit_merkle_differences": audit_merkle_differences,
    "audit_counts": audit_counts, "audit_recent": audit_recent,
}

_E = """e AS (SELECT user_id AS chain, event_id AS entry_id, ts,
  CAST(event_id AS VARCHAR) || ':' || event_type AS payload, value{block},
  row_number() OVER (PARTITION BY user_id{bpart} ORDER BY ts, event_id) AS seq FROM events)"""

_CHAIN = """WITH RECURSIVE """ + _E.format(block="", bpart="") + """,
c AS (SELECT chain, entry_id, ts, seq, sha256('GENESIS|' || payload) AS entry_hash FROM e WHERE seq = 1
  UNION ALL SELECT e.chain, e.entry_id, e.ts, e.seq, sha256(c.entry_hash || '|' || e.payload)
  FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1)
"""

_BLOCKED = """WITH RECURSIVE """ + _E.format(block=", strftime(ts, '%Y-%m-%d') AS block", bpart=", strftime(ts, '%Y-%m-%d')") + """,
c AS (SELECT chain, entry_id, ts, block, seq,
    sha256(sha256('GENESIS|' || CAST(chain AS VARCHAR) || '|' || block) || '|' || payload) AS entry_hash FROM e WHERE seq = 1
  UNION ALL SELECT e.chain, e.entry_id, e.ts, e.block, e.seq, sha256(c.entry_hash || '|' || e.payload)
  FROM c JOIN e ON e.chain = c.chain AND e.block = c.block AND e.seq = c.seq + 1)
"""

_LEAVES = """WITH e AS (SELECT event_type AS chain, event_id AS entry_id, value,
  CAST(event_id AS VARCHAR) || ':' || event_type AS payload,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events),
l0 AS (SELECT chain, idx, sha256('0' || payload) AS h FROM e)"""
_TREE = _LEAVES + "".join(f""",
l{k + 1} AS (SELECT chain, idx // 16 AS idx,
  CASE WHEN count(*) = 1 THEN min(h) ELSE sha256('1' || string_agg(h, '' ORDER BY l{k}.idx)) END AS h
  FROM l{k} GROUP BY chain, idx // 16)""" for k in range(8))  # 16^8 entries

ORACLE = {
    "audit_merkle": _TREE + """ SELECT l8.chain, entries, sha256(CAST(entries AS VARCHAR) || ':' || h) AS root
        FROM l8 JOIN (SELECT chain, count(*) AS entries FROM e GROUP BY chain) c ON l8.chain = c.chain""",
    "audit_merkle_differences": _LEAVES + " SELECT chain, idx AS place, entry_id FROM e WHERE value > 49.5",
    "audit_chain": _CHAIN + "SELECT chain, entry_id, ts, seq, entry_hash FROM c",
    "audit_chain_blocked": _BLOCKED + "SELECT chain, entry_id, ts, block, seq, entry_hash FROM c",
    "audit_digest": _BLOCKED + """, last AS (SELECT chain, block, arg_max(entry_hash, seq) AS h FROM c GROUP BY ALL)
        SELECT chain, count(*) AS blocks,
          list_reduce(list_prepend('GENESIS', list(h ORDER BY block)), lambda acc, x: sha256(acc || '|' || x)) AS digest
        FROM last GROUP BY chain""",
    "audit_verify": _CHAIN + """, t AS (SELECT e.chain, e.entry_id, e.ts,
          CASE WHEN e.value > 49.5 THEN e.payload || '*' ELSE e.payload END AS payload, c.entry_hash
          FROM e JOIN c ON e.entry_id = c.entry_id),
        v AS (SELECT *, sha256(coalesce(lag(entry_hash) OVER (PARTITION BY chain ORDER BY ts, entry_id), 'GENESIS')
          || '|' || payload) = entry_hash AS ok FROM t)
        SELECT chain, count(*) AS entries, count(*) FILTER (WHERE NOT ok) AS breaks,
          arg_min(entry_id, (ts, entry_id)) FILTER (WHERE NOT ok) AS first_break_id FROM v GROUP BY chain""",
    "audit_counts": "SELECT event_type, count(*) AS entries FROM events GROUP BY event_type",
    "audit_recent": """SELECT user_id AS chain, event_id AS entry_id, ts, event_type, true AS machine_generated,
        false AS operator_editable FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""",
}
