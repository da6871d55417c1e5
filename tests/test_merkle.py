"""Merkle trees: proofs, single changes, uneven chains."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import merkle
from tessera.session import scratch_path


def frame(spark, n=300, change=(), more=0):
    i = F.col("id")
    return spark.range(n + more).select(
        F.when(i % 3 == 0, F.lit(None)).when(i % 50 == 1, F.lit("small")).otherwise(F.lit("big")).alias("chain"),
        i.alias("entry_id"), F.timestamp_seconds(F.floor(i / 5) + 1_700_000_000).alias("ts"),
        F.when(i % 41 == 0, F.lit(None)).otherwise(F.concat(F.lit("p"), i.cast("string"), F.when(i.isin(*change) if change else F.lit(False), "x").otherwise(""))).alias("payload"))


def plain_root(payloads):
    level = [hashlib.sha256(("0" + (p or "")).encode()).hexdigest() for p in payloads]
    while len(level) > 1:
        groups = [level[i:i + merkle.FAN] for i in range(0, len(level), merkle.FAN)]
        level = [g[0] if len(g) == 1 else hashlib.sha256(("1" + "".join(g)).encode()).hexdigest() for g in groups]
    return hashlib.sha256(f"{len(payloads)}:{level[0]}".encode()).hexdigest()


@pytest.fixture(scope="module")
def tree(spark):
    merkle_fan, merkle.FAN = merkle.FAN, 4
    path = scratch_path(spark, "merkle")
    yield path, merkle.build_tree(frame(spark), path)
    merkle.FAN = merkle_fan


def test_roots_and_proofs(spark, tree):
    path, levels = tree
    rows = frame(spark).orderBy("ts", "entry_id").collect()
    chains = {c: [r.payload for r in rows if r.chain == c] for c in {r.chain for r in rows}}
    got = {r.chain: r for r in merkle.roots(spark, path, levels).collect()}
    assert {c: (r.entries, r.root) for c, r in got.items()} == {c: (len(p), plain_root(p)) for c, p in chains.items()}
    for chain, at in (("big", 77), (None, 0), ("small", 3)):
        steps = merkle.proof(spark, path, levels, chain, at)
        assert merkle.proof_root(chains[chain][at], steps, len(chains[chain])) == got[chain].root
        assert merkle.proof_root("forged", steps, len(chains[chain])) is None
        assert all(len(s["hashes"]) <= merkle.FAN for s in steps)


def test_one_changed_entry_is_found_by_descending(spark, tree):
    path, levels = tree
    other = scratch_path(spark, "merkle")
    n = merkle.build_tree(frame(spark, change=(200,)), other)
    found = [tuple(r) for r in merkle.differing_leaves(spark, path, other, levels, n).collect()]
    ids = [r.entry_id for r in frame(spark).where("chain = 'big'").orderBy("ts", "entry_id").collect()]
    assert found == [("big", ids.index(200))]
    assert merkle.differing_leaves(spark, path, path, levels, levels).count() == 0
    longer = scratch_path(spark, "merkle")
    n = merkle.build_tree(frame(spark, more=3), longer)
    assert merkle.differing_leaves(spark, path, longer, levels, n).count() == 3


def test_no_entries(spark):
    path = scratch_path(spark, "merkle")
    levels = merkle.build_tree(frame(spark, 0), path)
    assert levels == 1 and merkle.roots(spark, path, levels).count() == 0
