"""NULL names and keys, exact doubles, multiset sums and bucketed reconciliation."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog

SCHEMA = "source string, k string, x double, y long"


def plain(master, rows):
    sources = {r[0] for r in rows}
    m = {k: (x, y) for k, x, y in master}
    out = [(s, k, "EXTRA" if k not in m else "IN_SYNC" if m[k] == (x, y) else "STALE") for s, k, x, y in rows]
    have = {(s, k) for s, k, *_ in rows}
    return sorted(out + [(s, k, "MISSING") for s in sources for k in m if (s, k) not in have], key=repr)


MASTER = [(None, 1.0, 1), ("a", 1e-7, 2), ("b", 1e300, 3), ("c", None, 4), ("d", 0.0, 5), ("e", float("inf"), 6)]
ROWS = [(None, None, 1.0, 1), (None, "a", 2e-7, 2), ("s", "a", 1e-7, 2), ("s", "b", 1e300, 3), ("s", "c", None, 4),
        ("s", "d", -0.0, 5), ("t", "b", 2e300, 3), ("t", "zz", 1.0, 1), ("t", None, 1.0, 2)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(MASTER, "k string, x double, y long"), spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("fn", [catalog.reconcile, catalog.reconcile_changed])
def test_null_sources_null_keys_and_exact_doubles(sides, fn):
    got = sorted((tuple(r) for r in fn(*sides, "k", ["x", "y"]).collect()), key=repr)
    assert got == plain(MASTER, ROWS)


def test_null_names_elsewhere(spark, sides):
    m, c = sides
    cat = spark.createDataFrame([(None, False), ("s", False), ("t", True)], "source string, read_only boolean")
    merged = catalog.merge_master_wins(m, c, "k", cat).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in merged} == {None: 6, "s": 6}
    signals = spark.createDataFrame([(1, "*"), (2, "a"), (3, None)], "id long, target string")
    handlers = spark.createDataFrame([("a", "x"), (None, "y"), ("b", "z")], "component string, role string")
    got = {(r.id, r.component) for r in catalog.signal_fanout(signals, handlers).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "a")}
    nodes = spark.createDataFrame([(None, "/x/m", True), ("m", "/x/n", True), ("r", "/x/r", False)],
                                  "name string, path string, is_master boolean")
    assert catalog.hierarchy_edges(nodes).count() == 2
    ask = spark.createDataFrame([(1, "q", "p"), (2, None, None)], "id long, data_id string, preferred_source string")
    sources = spark.createDataFrame([(None, True, False), ("p", True, False), ("m", True, True)],
                                    "name string, connected boolean, is_master boolean")
    none = spark.createDataFrame([], "data_id string")
    best = spark.createDataFrame([(None, None, 1), (None, "p", 2)], "data_id string, source string, rank long")
    got = {r.id: r.route for r in catalog.route_requests(ask, none, sources, best).collect()}
    assert got == {1: "p", 2: "p"}


def test_every_change_is_seen(spark):
    def total(rows):
        return catalog.dataset_sha256(spark.createDataFrame(rows, "x double, t string")).first()
    base = [(1e-7, "a"), (1e300, "b"), (None, None), (None, "N")]
    assert total(base) == total(base[::-1]) and total(base).rows == 4
    for other in ([(2e-7, "a"), *base[1:]], [*base, base[0]], base[:3] + [(None, None)], [(1e-7, "a|"), *base[1:]]):
        assert total(other).sha256 != total(base).sha256
    assert total([(0.0, "z")]) == total([(-0.0, "z")])


def test_updated_sums_equal_a_recomputation(spark):
    rnd = random.Random(3)
    rows = [(f"k{i}", rnd.random(), i % 5) for i in range(400)]
    gone, new = rows[:90], [(f"n{i}", rnd.random(), i % 5) for i in range(50)]
    def frame(r):
        return spark.createDataFrame(r, "k string, x double, g long")
    def sums(r):
        return catalog.bucket_sums(frame(r), "k", ["x"], ["g"], 16)
    got = catalog.update_sums(sums(rows), sums(new), sums(gone), ["g", "bucket"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sums(rows[90:] + new).collect()))
    assert catalog.update_sums(sums(rows), sums(rows[:0]), sums(rows), ["g", "bucket"]).count() == 0


def test_only_differing_buckets_are_joined(spark):
    master = [(f"k{i:03}", float(i), i) for i in range(300)]
    m = spark.createDataFrame(master, "k string, x double, y long")
    rows = [("same", *r) for r in master] + [("near", *r) for r in master[1:]] + [("near", "new", 1.0, 1)]
    c = spark.createDataFrame(rows, SCHEMA)
    differ = catalog.differing_buckets(catalog.bucket_sums(m, "k", ["x", "y"], buckets=64),
                                       catalog.bucket_sums(c, "k", ["x", "y"], ["source"], 64), ["near", "same"]).collect()
    assert {r.source for r in differ} == {"near"} and 1 <= len(differ) <= 2
    got = sorted((tuple(r) for r in catalog.reconcile_changed(m, c, "k", ["x", "y"], buckets=64).collect()), key=repr)
    assert got == plain(master, rows)
    plan = catalog.reconcile_changed(m, m.select(F.lit("same").alias("source"), "*"), "k", ["x", "y"], buckets=64)
    assert {r.status for r in plan.collect()} == {"IN_SYNC"}
