"""The pivot to view columns builds a title's wide row in one task."""

import re

from pyspark.sql import functions as F

from tessera.operators import views


def _long(spark, titles):
    return spark.range(titles * 6).select(
        (F.col("id") % titles).alias("title"), F.concat(F.lit("q"), (F.col("id") % 2 + 1).cast("string")).alias("period"),
        (F.lit(1998) + F.floor(F.col("id") / titles) % 3).alias("year"), F.lit("asia").alias("region"),
        F.col("id").cast("double").alias("views"))


def test_a_title_is_pivoted_in_one_task_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "PIVOT_ROWS", 500)
    long = _long(spark, 300)
    wide = views.pivot_views(long, "title", ["q1", "q2"], [1998, 1999, 2000], ["asia"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    # one shuffle, by title, before any wide row is built; 1800 rows in tasks of 500
    assert re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan) == [("title", "4")]
    assert plan.rindex("pivotfirst") < plan.index("hashpartitioning")
    got = {r["title"]: r.asDict() for r in wide.collect()}
    want = {}
    for r in long.collect():
        row = want.setdefault(r["title"], {})
        name = views.view_column_name(r["period"], r["year"], r["region"])
        row[name] = row.get(name, 0.0) + r["views"]
    assert len(got) == 300
    for t, row in got.items():
        assert {k: v for k, v in row.items() if k != "title" and v is not None} == want[t]


def test_empty_and_null_titles(spark):
    none = views.pivot_views(_long(spark, 3).limit(0), "title", ["q1"], [1998], ["asia"])
    assert none.count() == 0 and none.columns == ["title", "views_q1_98_asia"]
    rows = spark.createDataFrame([(None, "q1", 1998, "asia", 2.0), (None, "q1", 1998, "asia", 3.0), (1, "q1", 1998, "asia", None)],
                                 "title long, period string, year long, region string, views double")
    got = {r.title: r.views_q1_98_asia for r in views.pivot_views(rows, "title", ["q1"], [1998], ["asia"]).collect()}
    assert got == {None: 5.0, 1: None}
