"""Processed-key store: membership against sets, files read per batch, compaction, replays."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import keystore
from tessera.session import scratch_path


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(keystore, "KEYS_PER_BUCKET", 20)
    monkeypatch.setattr(keystore, "FAN", 3)


def _keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string").coalesce(1)


def test_equals_a_set_over_batches(spark, small_buckets):
    base, seen, rnd = scratch_path(spark, "ks"), set(), random.Random(3)
    for batch in range(5):
        values = {f"key{rnd.randrange(150)}" for _ in range(60)} | ({None} if batch in (1, 3) else set()) | {""}
        new = keystore.unseen(spark, base, _keys(spark, values), "k")
        got = {r.k for r in new.collect()}
        assert got == values - seen
        keystore.add(spark, base, _keys(spark, got), "k", batch)
        seen |= values
    listed = keystore.runs(spark, base)
    assert sum(r.n for r in listed) == len(seen)
    assert max(r.level for r in listed) >= 1
    assert all(sum(r.level == lv for r in listed) < 3 for lv in {r.level for r in listed})


def test_buckets_read_do_not_grow_with_batches(spark, small_buckets):
    """100 new keys a batch, the same 5 old keys: old buckets are opened for the 5 keys (and false hits) only."""
    base, read = scratch_path(spark, "ks-files"), []
    old = [f"old{i}" for i in range(5)]
    keystore.add(spark, base, _keys(spark, old), "k", 0)
    for batch in range(1, 5):
        fresh = [f"b{batch}-{i}" for i in range(100)]
        paths = keystore.maybe_buckets(spark, base, _keys(spark, old + fresh), "k")
        read.append(len(paths))
        assert {r.k for r in keystore.unseen(spark, base, _keys(spark, old + fresh), "k").collect()} == set(fresh)
        keystore.add(spark, base, _keys(spark, fresh), "k", batch)
    total = sum(r.buckets for r in keystore.runs(spark, base))
    assert total >= 18 and max(read) <= 12  # at most the 5 keys' buckets, false hits below 1 % a key and run


def test_replayed_batch_changes_nothing(spark, small_buckets):
    base = scratch_path(spark, "ks-replay")
    for batch in range(4):
        keystore.add(spark, base, _keys(spark, [f"{batch}-{i}" for i in range(10)]), "k", batch)
    before = keystore.runs(spark, base)
    # the batch's own keys count as unseen for its replay, also after compaction
    again = keystore.unseen(spark, base, _keys(spark, ["3-1", "2-1", "x"]), "k", before=3)
    assert {r.k for r in again.collect()} == {"3-1", "x"}
    keystore.add(spark, base, _keys(spark, ["3-1", "x"]), "k", 3)
    assert keystore.runs(spark, base) == before


def test_empty_store_and_empty_batch(spark):
    base = scratch_path(spark, "ks-empty")
    assert keystore.unseen(spark, base, _keys(spark, ["a", None]), "k").count() == 2
    keystore.add(spark, base, _keys(spark, []), "k", 0)
    assert keystore.runs(spark, base) == [] and keystore.maybe_buckets(spark, base, _keys(spark, ["a"]), "k") == []
    keystore.add(spark, base, spark.range(100).select(F.col("id").alias("k")), "k", 1)
    assert keystore.unseen(spark, base, spark.range(90, 110).select(F.col("id").alias("k")), "k").count() == 10
