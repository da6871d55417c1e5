import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import access, ml


@pytest.fixture(scope="module")
def ties(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"g{i % 7}", rnd.randint(0, 30)) for i in range(4000)]
    return spark.createDataFrame(rows, "id long, g string, v long")


@pytest.mark.parametrize("method", ["row_number", "rank", "dense_rank"])
def test_salted_top_n_equals_window(ties, method):
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    order = [F.col("v").desc(), F.col("id")] if method == "row_number" else [F.col("v").desc()]
    w = Window.partitionBy("g").orderBy(*order)
    ref = {(r.id, r.k) for r in ties.select("id", fn().over(w).alias("k")).filter("k <= 10").collect()}
    got = {(r.id, r.k) for r in access.top_n_per_group(ties, ["g"], order, 10, salt_buckets=16,
                                                        salt_col="id", method=method, rank_col="k").collect()}
    assert got == ref


def test_hash_sample_equals_brute_force(spark):
    df = spark.range(20000).select(F.col("id").alias("a"), (F.col("id") % 13).alias("b"))
    got = sorted(tuple(r) for r in ml.hash_sample(df, ["a", "b"], 700, seed=9).collect())
    text = F.concat_ws("|", F.lit("9"), F.col("a").cast("string"), F.col("b").cast("string"))
    rank = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    want = sorted(tuple(r) for r in df.orderBy(rank, "a", "b").limit(700).collect())
    assert got == want
    assert ml.hash_sample(df, ["a"], 50000).count() == 20000  # fewer rows than n: all


def test_hash_sample_widens_threshold(spark):
    # a tiny n makes the first threshold keep fewer than n rows now and then;
    # the result must still be exact
    df = spark.range(3000).select(F.col("id").alias("a"))
    for seed in range(5):
        got = sorted(r.a for r in ml.hash_sample(df, ["a"], 3, seed=seed).collect())
        text = F.concat_ws("|", F.lit(str(seed)), F.col("a").cast("string"))
        rank = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
        assert got == sorted(r.a for r in df.orderBy(rank, "a").limit(3).collect())
