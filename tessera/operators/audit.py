"""Hash-chained audit trail (H1-H4, W9, DQ11).

Entry hash: sha256(previous_hash || '|' || payload); the first entry of a
chain uses the seed ('GENESIS') as previous hash.

* Building (H1) is sequential inside a chain by definition. Chains are
  independent, so they run in parallel (hash-partitioned by chain, sorted
  inside each partition, one ``mapInArrow`` pass with hashlib per row). For a chain too long for one task, ``block_col``
  cuts it into blocks (e.g. per day): each block is its own chain seeded with
  sha256(seed|chain|block), and ``block_digests`` chains the blocks' last
  hashes, so every entry is still covered by one final digest.
* Verifying (H2) is fully parallel: recompute each entry from the stored hash
  of the entry before it (chunked previous-row lookup) and compare.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ordered

# Chain seed and separator.
SEED = "GENESIS"
SEP = "|"


def entries(events: DataFrame, chain: Column, ts: str, tie: str, payload: Column,
            event_type: Column, description: Column | None = None) -> DataFrame:
    """H3 / DQ11: audit entries with the trust flags every entry carries."""
    return events.select(chain.alias("chain"), F.col(ts).alias("ts"), F.col(tie).alias("entry_id"),
                         event_type.alias("event_type"),
                         (description if description is not None else F.lit("")).alias("description"),
                         payload.alias("payload"),
                         F.lit(True).alias("machine_generated"), F.lit(False).alias("operator_editable"))


def _chain_fn(seed: str, sep: str, blocked: bool, out_cols: list[str]):
    """Per partition: rows arrive sorted by (chain[, block], ts, entry_id);
    the running hash is carried across Arrow batches and reset at every new
    chain (block). Chains and payloads arrive as text (``_chain``, ``_payload``)."""
    def run(batches):
        cur, prev, seq = None, None, 0
        for batch in batches:
            hashes, seqs = [], []
            keys, payloads = (batch.column(c).to_pylist() for c in ("_chain", "_payload"))
            blocks = batch.column("block").to_pylist() if blocked else [None] * batch.num_rows
            for k, b, p in zip(keys, blocks, payloads):
                if (k, b) != cur:
                    cur, seq = (k, b), 0
                    prev = (hashlib.sha256(f"{seed}{sep}{k or ''}{sep}{b or ''}".encode()).hexdigest()
                            if blocked else seed)
                prev = hashlib.sha256(f"{prev}{sep}{p}".encode()).hexdigest()
                seq += 1
                hashes.append(prev)
                seqs.append(seq)
            cols = [batch.column(c) for c in out_cols[:-2]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(seqs, pa.int64()), pa.array(hashes, pa.string())],
                                             names=out_cols)
    return run


def build_chain(entries_df: DataFrame, seed: str = SEED, sep: str = SEP,
                block_col: Column | None = None) -> DataFrame:
    """H1: ``(chain, entry_id, ts[, block], seq, entry_hash)``; ``seq`` is
    1-based in (ts, entry_id) order inside the chain (inside the block when
    blocked). Rows are hash-partitioned by chain (and block) and sorted inside
    each partition, so one Python pass per partition hashes many chains.

    A NULL chain is a chain of its own, a NULL payload counts as empty text, and
    all columns keep their types."""
    df = entries_df.select("chain", "entry_id", "ts", F.col("chain").cast("string").alias("_chain"),
                           F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("_payload"))
    blocked = block_col is not None
    keys = ["chain", "block"] if blocked else ["chain"]
    if blocked:
        df = df.withColumn("block", block_col.cast("string"))
    out_cols = ["chain", "entry_id", "ts"] + (["block"] if blocked else []) + ["seq", "entry_hash"]
    schema = df.select(*out_cols[:-2]).schema.add("seq", "long").add("entry_hash", "string")
    ordered_rows = df.repartition(*keys).sortWithinPartitions(*keys, "ts", "entry_id")
    return ordered_rows.mapInArrow(_chain_fn(seed, sep, blocked, out_cols), schema)


def block_digests(chain_df: DataFrame, seed: str = SEED, sep: str = SEP) -> DataFrame:
    """Chain the last hash of every block per chain: one digest per chain.

    Works on one row per block (bounded by the number of blocks of a chain),
    folded in block order with a built-in ``aggregate``."""
    last = chain_df.groupBy("chain", "block").agg(F.max_by("entry_hash", "seq").alias("h"))
    folded = last.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("block", "h"))).alias("bs"))
    digest = F.aggregate("bs", F.lit(seed),
                         lambda acc, b: F.sha2(F.concat(acc, F.lit(sep), b["h"]), 256))
    return folded.select("chain", F.size("bs").cast("long").alias("blocks"), digest.alias("digest"))


def verify_chain(stored: DataFrame, seed: str = SEED, sep: str = SEP,
                 bucket_seconds: int = 86400) -> DataFrame:
    """H2 + W9: per entry, recompute sha256(prev_stored_hash | payload) and
    flag a break where it differs from the stored hash. ``stored`` has
    (chain, entry_id, ts, payload, entry_hash)."""
    order = [F.col("ts"), F.col("entry_id")]
    prev = ordered.previous_values(stored, ["chain"], order, ["entry_hash"],
                                   ordered.time_bucket("ts", bucket_seconds))
    expected = F.sha2(F.concat(F.coalesce(F.col("prev_entry_hash"), F.lit(seed)), F.lit(sep),
                               F.coalesce(F.col("payload").cast("string"), F.lit(""))), 256)
    return prev.withColumn("ok", expected == F.col("entry_hash"))


def first_breaks(verified: DataFrame) -> DataFrame:
    """Per chain: number of broken entries and the first one (by ts, id)."""
    bad = F.col("ok") == F.lit(False)
    return verified.groupBy("chain").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(bad).alias("breaks"),
        F.min(F.when(bad, F.struct("ts", "entry_id"))).alias("_first")).select(
        "chain", "entries", "breaks", F.col("_first.entry_id").alias("first_break_id"))


def event_counts(entries_df: DataFrame) -> DataFrame:
    """H4: entries per event type."""
    return entries_df.groupBy("event_type").agg(F.count(F.lit(1)).alias("entries"))


def recent_entries(entries_df: DataFrame, n: int = 100) -> DataFrame:
    """H4: the n most recent entries (a bounded top-k)."""
    return entries_df.orderBy(F.col("ts").desc(), F.col("entry_id").desc()).limit(n)
