import json

from tessera.plans.feature_study import run_feature_study
from tessera.session import scratch_path


def test_feature_study_end_to_end(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    pa = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    df = li.join(pa, li.l_partkey == pa.p_partkey).drop("p_partkey")
    out = scratch_path(spark, "study")
    summary = run_feature_study(df, out, ["views_y", "l_extendedprice"],
                                ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], trees=3, cause_trees=5)
    assert summary["target"] == "l_extendedprice"
    assert summary["models_ok"] == 3 and summary["features"] >= 2
    feats = spark.read.json(f"{out}/features.json").first()
    assert feats["count"] == summary["features"] and "l_extendedprice" not in feats["features"]
    m = spark.read.parquet(f"{out}/correlation")
    assert m.count() == summary["features"]
    assert spark.read.json(f"{out}/models.json").count() == 8
    assert json.loads(spark.read.text(f"{out}/summary.json").first()[0])["status"] == "COMPLETED"
