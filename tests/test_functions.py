from tessera.functions import hashing, nulls, paths, text


def test_text_helpers(spark):
    df = spark.createDataFrame([("Middle East", "path:x/y"), ("ASIA", "cfg")], "r string, k string")
    got = df.select(text.normalise_name("r").alias("n"), text.key_category("k").alias("c"),
                    text.truncate_ellipsis("r", 6).alias("t"),
                    text.contains_any_ci("r", ["east", "zzz"]).alias("e")).collect()
    assert [tuple(r) for r in got] == [("middle_east", "path", "Middle...", True), ("asia", "other", "ASIA", False)]
    msgs = spark.createDataFrame([("b",), ("a",)], "m string").agg(text.join_messages("m").alias("j")).first().j
    assert msgs == "a; b"


def test_path_helpers(spark):
    df = spark.createDataFrame([("host/a/b/file.parquet",), ("plain",)], "p string")
    got = [tuple(r) for r in df.select(paths.parent_folder("p"), paths.base_name("p")).collect()]
    assert got == [("host/a/b", "file.parquet"), ("", "plain")]


def test_null_helpers(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    got = [tuple(r) for r in df.select(nulls.nan_to_null("x").alias("a"), nulls.zero_fill("x").alias("b")).collect()]
    assert got == [(1.0, 1.0), (None, 0.0), (None, 0.0)]


def test_hash_helpers_match_python(spark):
    import hashlib

    df = spark.createDataFrame([(1, "x", 2.5, None)], "a long, b string, c double, d string")
    r = df.select(hashing.row_digest(df, ["a", "b", "c", "d"]).alias("h"),
                  hashing.md5_hex("b").alias("m"), hashing.sha256_hex("b").alias("s")).first()
    assert r.h == hashlib.md5("1:1|1:x|3:2.5|N".encode()).hexdigest()
    assert r.m == hashlib.md5(b"x").hexdigest() and r.s == hashlib.sha256(b"x").hexdigest()
