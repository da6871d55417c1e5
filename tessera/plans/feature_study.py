"""The feature study end to end: select, correlate, rank causes, train.

A plain driver function that chains the DataFrame operators over one input
table and writes each result as it is produced (SURVEY section 3.1):

1. variance selection (one aggregate) -> ``features.json`` (D6),
2. correlation of the selected features -> ``correlation`` Parquet in the
   square form (S7) and the high pairs,
3. importance-ranked causes (sampled forest) -> ``causes.json``,
4. three-model ensemble with train / hold-out metrics -> ``models.json``,
5. one summary row -> ``summary.json``.

Only feature names, the pair table (k x k) and metric rows are small enough
to be collected; every step over rows runs on the executors.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ml, profile
from tessera.sources import io


def run_feature_study(df: DataFrame, out_dir: str, target_candidates: list[str],
                      key_cols: list[str], exclude_patterns=None, top_n: int = profile.TOP_FEATURES,
                      trees: int = 1350, cause_trees: int = 100, seed: int = ml.SEED) -> dict:
    spark = df.sparkSession
    t0 = time.time()
    phases = []

    def phase(name, fn):
        start = time.time()
        try:
            out = fn()
            phases.append({"phase": name, "success": True, "duration_ms": (time.time() - start) * 1000,
                           "error": None})
            return out
        except Exception as e:  # noqa: BLE001 - recorded, then re-raised (fail closed)
            phases.append({"phase": name, "success": False, "duration_ms": (time.time() - start) * 1000,
                           "error": str(e)[:500]})
            raise

    target = ml.resolve_target(df, target_candidates)
    pats = list(exclude_patterns or profile.DEFAULT_EXCLUDE_PATTERNS) + key_cols
    candidates = profile.feature_columns(df, pats, target=target)

    def select():
        top = profile.select_top_variance(profile.feature_variance(df, candidates), top_n=top_n)
        names = [r.feature for r in top.collect()]  # <= top_n names
        spark.createDataFrame([(names, len(names))], "features array<string>, count long") \
             .coalesce(1).write.mode("overwrite").json(f"{out_dir}/features.json")
        return names

    features = phase("feature_selection", select)

    def correlate():
        corr = profile.correlation_long(df, features)
        profile.correlation_matrix(corr, features).write.mode("overwrite").parquet(f"{out_dir}/correlation")
        return profile.high_correlation_pairs(corr).count()

    high_pairs = phase("correlation", correlate)

    def causes():
        ranked = ml.causation(df, features, target_candidates, key_cols, trees=cause_trees, seed=seed)
        io.write_json_rows(ranked, f"{out_dir}/causes.json", single_file=True)
        return ranked.count()

    n_causes = phase("causation", causes)

    def train():
        data = ml.training_frame(df, features, target, key_cols=key_cols)
        side = F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(100))
        tr, ho = data.where(side < 80).cache(), data.where(side >= 80)
        fitted = ml.train_ensemble(tr, trees, seed=seed)
        metrics = ml.evaluate(ml.score(fitted, tr), "train").unionByName(ml.evaluate(ml.score(fitted, ho), "holdout"))
        io.write_json_rows(metrics, f"{out_dir}/models.json", single_file=True)
        tr.unpersist()
        return fitted

    fitted = phase("training", train)
    summary = {"status": "COMPLETED", "target": target, "features": len(features),
               "high_correlation_pairs": int(high_pairs), "causes": int(n_causes),
               "models_ok": fitted.models_ok, "trees_per_model": trees,
               "trees_trained": fitted.trees_trained, "model_errors": fitted.errors,
               "duration_ms": (time.time() - t0) * 1000, "phases": phases}
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1) \
         .write.mode("overwrite").text(f"{out_dir}/summary.json")
    return summary
