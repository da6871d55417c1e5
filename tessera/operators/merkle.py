"""Merkle trees over audit entries (H1, H2) for chains of any length.

The entries of a chain, in (ts, entry_id) order, are the leaves. A node hashes its up to
``FAN`` children in order; a single child moves up unchanged. Levels are built
one after the other, each by one aggregate over (chain, place div FAN) and
written to the tree's folder, so a chain of n entries takes log_FAN(n) rounds and no task
holds a chain: groups have at most ``FAN`` rows, and places come from the chunked row
numbers of ``ordered``. The root names the number of entries too.

A proof of one entry is one row of siblings per level; ``proof_root`` folds it. Two trees are
compared from the root down, into the children of differing nodes only.

Leaf: sha256('0' + payload); node: sha256('1' + children); root: sha256(entries + ':' + top). Defined
cases: a NULL chain is a chain; a NULL payload counts as empty text; an empty frame has no trees.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ordered

FAN = 16
SCHEMA = "chain {}, idx long, hash string"


def _same_chain(a: str = "chain", b: str = "_chain"):
    return F.col(a).eqNullSafe(F.col(b))


def build_tree(entries: DataFrame, path: str, bucket_seconds: int = 86_400) -> int:
    """Write the levels of the trees of ``entries`` (chain, entry_id, ts, payload) to ``path``/level=<k>;
    level 0 holds the leaves. Returns the number of levels."""
    spark = entries.sparkSession
    numbered = ordered.row_numbers(entries.select("chain", "entry_id", "ts", "payload"), ["chain"],
                                   [F.col("ts"), F.col("entry_id")], ordered.time_bucket("ts", bucket_seconds), "_rn")
    text = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    level = numbered.select("chain", (F.col("_rn") - 1).cast("long").alias("idx"),
                            F.sha2(F.concat(F.lit("0"), text), 256).alias("hash"), "entry_id")
    schema, n = level.schema, 0
    while True:
        level.write.mode("overwrite").parquet(f"{path}/level={n}")
        level = spark.read.schema(schema).parquet(f"{path}/level={n}")
        n += 1
        if not (level.agg(F.max("idx")).first()[0] or 0):
            return n
        up = level.groupBy("chain", F.floor(F.col("idx") / F.lit(FAN)).alias("idx")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("kids"))  # at most FAN
        joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        level = up.select("chain", "idx", F.when(F.size("kids") == 1, F.get("kids", F.lit(0))["hash"]).otherwise(
            F.sha2(F.concat(F.lit("1"), joined), 256)).alias("hash"))
        schema = level.schema


def _level(spark: SparkSession, path: str, k: int) -> DataFrame:
    return spark.read.parquet(f"{path}/level={k}")


def roots(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """(chain, entries, root)."""
    count = _level(spark, path, 0).groupBy(F.col("chain").alias("_chain")).agg(F.count(F.lit(1)).alias("entries"))
    return (_level(spark, path, levels - 1).join(count, _same_chain())
            .select("chain", "entries", F.sha2(F.concat(F.col("entries").cast("string"), F.lit(":"), F.col("hash")), 256).alias("root")))


def proof(spark: SparkSession, path: str, levels: int, chain, idx: int) -> list[dict]:
    """Per level below the top: the entry's place among its siblings, and their hashes (at most ``FAN``)."""
    steps = []
    for k in range(levels - 1):
        lo = idx // FAN * FAN
        rows = (_level(spark, path, k).where(F.col("chain").eqNullSafe(F.lit(chain)) & F.col("idx").between(lo, lo + FAN - 1))
                .orderBy("idx").select("hash").collect())
        steps.append({"place": idx - lo, "hashes": [r.hash for r in rows]})
        idx //= FAN
    return steps


def proof_root(payload: str | None, steps: list[dict], entries: int) -> str | None:
    """The root that a payload and its proof lead to; None if the proof does not hold together."""
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()
    at = digest("0" + (payload or ""))
    for s in steps:
        if not 0 <= s["place"] < len(s["hashes"]) or s["hashes"][s["place"]] != at:
            return None
        at = at if len(s["hashes"]) == 1 else digest("1" + "".join(s["hashes"]))
    return digest(f"{entries}:{at}")


def differing_leaves(spark: SparkSession, path_a: str, path_b: str, levels_a: int, levels_b: int) -> DataFrame:
    """(chain, idx) of leaves that differ or exist on one side only, found by descending from the tops:
    a level reads only the children of nodes that differ. Trees of unequal height meet at the lower top."""
    open_ = None
    for k in range(min(levels_a, levels_b) - 1, -1, -1):
        a, b = (_level(spark, p, k).select("chain", "idx", "hash") for p in (path_a, path_b))
        if open_ is not None:
            up = open_.select(F.col("chain").alias("_chain"), F.col("idx").alias("_up"))
            a, b = (d.join(up, _same_chain() & (F.floor(F.col("idx") / F.lit(FAN)) == F.col("_up")), "left_semi") for d in (a, b))
        b = b.select(F.col("chain").alias("_chain"), F.col("idx").alias("_idx"), F.col("hash").alias("_hash"))
        met = a.join(b, _same_chain() & (F.col("idx") == F.col("_idx")), "full")
        open_ = met.where(~F.col("hash").eqNullSafe(F.col("_hash"))).select(
            F.when(F.col("hash").isNull(), F.col("_chain")).otherwise(F.col("chain")).alias("chain"),
            F.coalesce("idx", "_idx").alias("idx"))
    return open_
