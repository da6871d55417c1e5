"""Model training and evaluation.

* Three regressors stand in for the original ensemble: boosted trees with leaf
  penalties, boosted symmetric trees with Bayesian bootstrap (both in
  ``boosting``), and a random forest by Spark ML's rules (``forest``; depth 12, sqrt
  features, leaf 5, 128 bins; a leaf of 5 means that no node below 10 rows is split, the
  original's other limit).
* Tree counts are the original's, 1350 per model, as an upper limit: boosting
  stops when the error on its validation rows has not fallen for ``patience``
  rounds, a forest when a further tranche of trees does not lower it by
  ``FOREST_TOL``. Forests are trained and written in tranches with seeds of their
  own; the mean over all trees is the forest.
* Trained models are stored under the shared checkpoint folder by their settings
  and a digest of the rows, so queries over the same rows train once.
* Models score one DataFrame in a chain of ``transform`` calls, so the
  predictions of all models stay aligned row by row (J14) without a join.
* Metrics are computed on the training rows (as the original does) and on a
  hold-out split (M10).
* Sampling (P14) keeps the n rows with the smallest seeded hash of the key:
  a filter on a hash threshold cuts the candidates to about n, and the exact
  threshold among them comes from histograms, so nothing is sorted.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.nulls import zero_fill
from tessera.operators import boosting, forest, metrics
from tessera.session import checkpoint_dir, path_exists, remove_path, scratch_path

# Model settings of the original, target candidates order,
# minimum training rows, sample size and the number of causes reported.
MODEL_PARAMS = {
    "m1": {"kind": "boost", "depth": 8, "eta": 0.05, "subsample": 0.8, "colsample": 0.8, "min_child": 5.0,
           "l1": 0.1, "l2": 1.0, "bins": 256},
    "m2": {"kind": "boost", "depth": 6, "eta": 0.03, "l2": 3.0, "bins": 128, "symmetric": True, "bayesian": True},
    "m3": {"kind": "rf", "maxDepth": 12, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 5,
           "maxBins": 128},
}
SEED = 42
MIN_ROWS = 1000
SAMPLE_ROWS = 100_000
TOP_CAUSES = 20
GRANGER_MAX_LAG = 4
GRANGER_ALPHA = 0.05

# Stopping rules: share of the training rows used for validation, rounds of boosting
# without a better validation error, trees of a tranche, and the relative gain that a
# tranche must bring.
VALID_SHARE = 0.1
PATIENCE = 10
TRANCHE = 45
FOREST_TOL = 0.002
#: rows of a training partition
PART_ROWS = 250_000


class TrainingInputError(ValueError):
    """Typed error for a missing target or too few rows."""


# ---------------------------------------------------------------- P4 / P5 / P9
def resolve_target(df: DataFrame, candidates: list[str]) -> str:
    """P5: the first candidate that exists in the schema."""
    for c in candidates:
        if c in df.columns:
            return c
    raise TrainingInputError(f"no target column among {candidates}")


def training_frame(df: DataFrame, features: list[str], target: str, min_rows: int = MIN_ROWS,
                   check_rows: bool = True, key_cols: list[str] | None = None, together: bool = False) -> DataFrame:
    """P3 + P4 + P9: rows with a target, features zero-filled into one vector
    column ``features``, the label as ``label`` and ``row_key``, a hash of ``key_cols``
    (of features and label where none are named) that every draw of the training uses. With
    ``together`` the partitions are ranges of the features, sorted (rows of equal features may span
    some): learners and models look at neighbours of equal bins once."""
    key = F.xxhash64(*[F.col(c) for c in key_cols or [*features, target]])
    clean = df.na.drop(subset=[target]).select(
        *[zero_fill(c).alias(c) for c in features], F.col(target).cast("double").alias("label"), key.alias("row_key"))
    if check_rows:
        n = clean.count()
        if n < min_rows:
            raise TrainingInputError(f"only {n} training rows, need {min_rows}")
        # tree learners make many passes over the rows: every core gets some, and no
        # partition more than a bounded number (AQE may have merged a small join result)
        cores = clean.sparkSession.sparkContext.defaultParallelism
        # a multiple of the cores, so that none is idle in the last wave
        parts = cores * max(1, -(-n // (PART_ROWS * cores)))
        if together:
            clean = clean.repartitionByRange(parts, *features, "row_key").sortWithinPartitions(*features)
        else:
            clean = clean.repartition(parts, "row_key")
    return VectorAssembler(inputCols=features, outputCol="features").transform(clean)


# ---------------------------------------------------------------- P14
def hash_sample(df: DataFrame, key_cols: list[str], n: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """N rows without replacement, deterministic for a seed; all rows
    when there are at most n.

    Rows are ranked by a seeded hash of the key (the first 15 hex digits of
    md5('<seed>|k1|k2...'), as a fraction of 16^15; MD5 so any engine can
    reproduce the sample). A first count gives the fraction; the filter keeps
    about 1.1 n candidates, and only those are sorted. If the threshold keeps
    too few, it is widened and retried.
    """
    total = df.count()
    if total <= n:
        return df
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    rank = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    h = df.withColumn("_r", rank).withColumn("_u", F.col("_r") / F.lit(float(16 ** 15)))
    frac = min(1.0, n / total * 1.1 + 1e-4)
    while True:
        cand = h.filter(F.col("_u") < frac) if frac < 1.0 else h
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 1.5)
    at = value_of_rank(cand, "_r", n)
    below = cand.filter(F.col("_r") < at)
    # rows on the threshold itself: equal hashes, so equal keys but for a collision
    left = n - below.count()
    return below.unionByName(cand.filter(F.col("_r") == at).orderBy(*key_cols).limit(left)).drop("_u", "_r")


# ---------------------------------------------------------------- M1-M3
class Forest:
    """Tranches of one forest: (path, model, trees). Its prediction is the mean over all trees."""

    def __init__(self, name: str, tranches: list, history: list):
        self.name, self.tranches, self.history = name, tranches, history

    @property
    def trees_trained(self) -> int:
        return sum(n for _, _, n in self.tranches)

    @property
    def feature_importances(self) -> list[float]:
        """Mean over the trees of their importances, scaled to sum 1."""
        total = sum(n * m.feature_importances for _, m, n in self.tranches)
        return (total / total.sum() if total.sum() else total).tolist()

    def transform(self, df: DataFrame) -> DataFrame:
        out, parts = df, []
        for i, (_, model, n) in enumerate(self.tranches):
            part = f"_{self.name}_{i}"
            out = model.transform(out, part)
            parts.append(F.col(part) * n)
        return out.withColumn(self.name, sum(parts[1:], parts[0]) / F.lit(float(self.trees_trained))).drop(
            *[f"_{self.name}_{i}" for i in range(len(self.tranches))])


def train_forest(rows: DataFrame, name: str, trees: int, path: str, seed: int = SEED, tranche: int = TRANCHE,
                 tol: float = FOREST_TOL, **params) -> Forest:
    """A forest in tranches of ``tranche`` trees with seeds of their own, each written under ``path``
    before the next one starts. Training ends at ``trees`` or when two tranches in a row have not
    lowered the squared error on the validation rows by ``tol`` of it."""
    spark = rows.sparkSession
    side = F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(VALID_SHARE * 1_000_000))
    valid = rows.where(side).select("features", "label", F.lit(0.0).alias("total"))
    held, done, history, found, kept, calm = None, 0, [], [], None, 0
    trainer = forest.Trainer(rows.where(~side), **params)
    try:
        while done < trees and calm < 2:
            n = min(tranche, trees - done)
            at = f"{path}/{name}-{done:05}"
            model = trainer.grow(n, seed + done)
            model.save(spark, at)
            found.append((at, model, n))
            done += n
            scored = model.transform(valid, "_p").select(
                "features", "label", (F.col("total") + F.col("_p") * n).alias("total"))
            held, older = scratch_path(spark, "forest-valid"), held
            scored.write.parquet(held)
            valid = spark.read.schema(scored.schema).parquet(held)
            if older:
                remove_path(spark, older)
            error = valid.agg(F.avg(F.pow(F.col("total") / done - F.col("label"), 2))).first()[0]
            calm = calm + 1 if history and error is not None and error > kept * (1 - tol) else 0
            kept = error if kept is None or error is None or not calm else kept
            history.append([done, error])
    finally:
        trainer.close()
        if held:
            remove_path(spark, held)
    return Forest(name, found, history)


class Ensemble(dict):
    """Model by name (None where training failed); ``errors`` holds the reasons."""

    def __init__(self, models=(), errors=None):
        super().__init__(models)
        self.errors = dict(errors or {})

    @property
    def models_ok(self) -> int:
        return sum(m is not None for m in self.values())

    @property
    def trees_trained(self) -> dict:
        return {name: m.trees_trained if m is not None else 0 for name, m in self.items()}


def _rows_digest(train: DataFrame) -> str:
    """Count and order-free sums of two row hashes."""
    cols = [F.col("row_key"), F.col("label"), vector_to_array("features")]
    parts = [F.sum(F.xxhash64(*cols, F.lit(i)).cast("decimal(38,0)")) for i in (1, 2)]
    return str(tuple(train.agg(F.count(F.lit(1)), *parts).first()))


def fit_model(train: DataFrame, name: str, trees: int, seed: int, path: str):
    """Train one model and write it under ``path``, or read what an earlier call wrote there."""
    spark = train.sparkSession
    p = dict(MODEL_PARAMS[name])
    done = f"{path}/{name}-done"
    if p.pop("kind") == "boost":
        if path_exists(spark, done):
            return boosting.BoostedModel.from_json(spark.read.parquet(done).first()[0])
        model = boosting.train(train, name, boosting.Settings(rounds=trees, seed=seed, valid_share=VALID_SHARE,
                                                              patience=PATIENCE, **p))
        spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(done)
        return model
    if path_exists(spark, done):
        tranches, history = json.loads(spark.read.parquet(done).first()[0])
        return Forest(name, [(at, forest.ForestModel.load(spark, at), n) for at, n in tranches], history)
    model = train_forest(train, name, trees, path, seed, **p)
    text = json.dumps([[(at, n) for at, _, n in model.tranches], model.history])
    spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(done)
    return model


def train_ensemble(train: DataFrame, trees: int = 1350, models=("m1", "m2", "m3"), seed: int = SEED,
                   parallelism: int = 3) -> Ensemble:
    """Fit each model with at most ``trees`` trees; a model that fails to train is left out (its
    prediction column becomes NULL and the ensemble renormalises) and its reason is kept in
    ``errors``; without any model the first reason is raised.

    Models are stored under ``spark.checkpoint.dir`` by their settings, the tree limit and a digest of
    the rows: a second call over the same rows reads them. The fits are submitted from
    ``parallelism`` driver threads: tree learners run many short jobs, and concurrent jobs
    keep the executors busy between them.
    """
    from concurrent.futures import ThreadPoolExecutor

    base = checkpoint_dir(train.sparkSession).rstrip("/")
    rules = (trees, seed, VALID_SHARE, PATIENCE, TRANCHE, FOREST_TOL)
    key = hashlib.sha256(repr((_rows_digest(train), rules, sorted(MODEL_PARAMS.items()))).encode()).hexdigest()[:24]

    def fit(m):
        try:
            return m, fit_model(train, m, trees, seed, f"{base}/models-{key}"), None
        except Exception as e:  # noqa: BLE001 - the original also goes on with the other models
            return m, None, f"{type(e).__name__}: {str(e)[:500]}"

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fitted = list(pool.map(fit, models))
    errors = {m: e for m, _, e in fitted if e}
    if len(errors) == len(fitted):
        raise RuntimeError(f"no model could be trained: {errors}")
    return Ensemble({m: model for m, model, _ in fitted}, errors)


def score(fitted: dict, df: DataFrame) -> DataFrame:
    """J14 + M4: chain every model's transform, then the weighted ensemble."""
    out = df
    for m, model in fitted.items():
        out = model.transform(out) if model is not None else out.withColumn(m, F.lit(None).cast("double"))
    return out.withColumn("ensemble", metrics.ensemble_prediction({m: m for m in fitted}))


def evaluate(scored: DataFrame, split: str) -> DataFrame:
    """A5 + A6 per model and for the ensemble; ``split`` labels the rows."""
    names = [c for c in scored.columns if c in MODEL_PARAMS] + ["ensemble"]
    return metrics.model_metrics(scored, "label", names).withColumn("split", F.lit(split))


# ---------------------------------------------------------------- M5 / J3 / W3
def importances(model, features: list[str], spark) -> DataFrame:
    """M5 + J3: feature name and importance by position (k rows)."""
    vec = model.feature_importances if hasattr(model, "feature_importances") else model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, vec)],
                                 "feature string, importance double")


def ranked_causes(imp: DataFrame, n: int = TOP_CAUSES) -> DataFrame:
    """The n most important features with rank 1.. (ties by name)."""
    top = imp.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)
    from pyspark.sql import Window
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # over n rows
    return top.withColumn("rank", F.row_number().over(w).cast("long"))


def causation(df: DataFrame, features: list[str], target_candidates: list[str], key_cols: list[str],
              trees: int = 100, depth: int = 10, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """M6: importance of a forest on at most ``sample_rows`` rows, top 20; on a
    training error, 100 rounds of boosting (depth 8) instead."""
    target = resolve_target(df, target_candidates)
    sampled = hash_sample(df.select(*key_cols, *features, target), key_cols, sample_rows, seed)
    train = training_frame(sampled, features, target).cache()
    try:
        model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed,
                                      featuresCol="features", labelCol="label").fit(train)
    except Exception:  # noqa: BLE001
        model = GBTRegressor(maxIter=100, maxDepth=8, seed=seed, featuresCol="features",
                             labelCol="label").fit(train)
    out = ranked_causes(importances(model, features, df.sparkSession))
    train.unpersist()
    return out


# ---------------------------------------------------------------- M8
RANK_BINS = 1024


def value_of_rank(df: DataFrame, col: str, rank: int) -> float:
    """The ``rank``-th smallest (from 1) of the finite values of ``col``, exactly:
    a histogram of ``RANK_BINS`` bins, then of the bin that holds the rank, until
    that bin holds one value. Only bins reach the driver."""
    v = F.col(col)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    while lo < hi:
        step = (hi - lo) / RANK_BINS or hi - lo
        place = F.least(F.floor((v - F.lit(lo)) / F.lit(step)), F.lit(RANK_BINS - 1))
        bins = (df.filter(v.between(lo, hi)).groupBy(place.alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect())
        for r in sorted(bins, key=lambda r: r.b):
            if rank <= r.n:
                lo, hi = r.lo, r.hi
                break
            rank -= r.n
    return lo


def conformal_intervals(calibration: DataFrame, scored: DataFrame, prediction: str = "ensemble",
                        level: float = 0.9) -> DataFrame:
    """M8 (split conformal): q is the residual |y - p| of rank ceil((n+1) level)
    on the n calibration rows; interval p +- q on the scored rows. When that
    rank exceeds n there is no such residual and the interval is unbounded. The
    rank is exact for any n."""
    checkpoint_dir(calibration.sparkSession)
    resid = calibration.select(F.abs(F.col("label") - F.col(prediction)).cast("double").alias("r")).filter(
        F.col("r").isNotNull()).checkpoint()  # the passes below do not score again
    rank = math.ceil((resid.count() + 1) * level)
    finite = resid.filter(F.col("r") < float("inf"))  # NaN counts as the largest
    q = float("inf") if rank > finite.count() else value_of_rank(finite, "r", rank)
    return scored.withColumn("q", F.lit(q)).select(
        "*", (F.col(prediction) - F.col("q")).alias("lower"), (F.col(prediction) + F.col("q")).alias("upper"))


# ---------------------------------------------------------------- M7
def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def reg_inc_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(ln)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float, df1: int, df2: int) -> float:
    """P(F > f) for an F(df1, df2) variable."""
    if not (f > 0) or df1 <= 0 or df2 <= 0:
        return float("nan") if not (f >= 0) else 1.0
    return reg_inc_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))



def lagged(series: DataFrame, group_col: str, t_col: str, value_col: str, max_lag: int) -> DataFrame:
    """(g, t, lags): values of the steps t, t-1, .. t-``max_lag`` of every series on its calendar (days for
    dates, whole numbers otherwise), standardised per series; only steps at which all of them are known.
    Values of one step are added; NULL and NaN values and missing steps are unknown."""
    kind = dict(series.dtypes)[t_col]
    step = F.unix_date(F.col(t_col)) if kind == "date" else F.col(t_col).cast("long")
    v = F.col(value_col).cast("double")
    s = (series.select(F.col(group_col).alias("g"), step.alias("t"), v.alias("v"))
         .where(F.col("t").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
         .groupBy("g", "t").agg(F.sum("v").alias("v")))
    scale = s.groupBy(F.col("g").alias("_g")).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    s = s.join(scale, F.col("g").eqNullSafe(F.col("_g"))).select(
        "g", "t", ((F.col("v") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))).alias("v"))
    # every value reaches the steps it is a lag of; no order, so a long series is spread
    shifted = s.select("g", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("k"), "t", "v").withColumn(
        "t", F.col("t") + F.col("k"))
    full = shifted.groupBy("g", "t").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("kv"))  # max_lag + 1 at most
    return full.where(F.size("kv") == max_lag + 1).select("g", "t", F.transform("kv", lambda x: x["v"]).alias("lags"))


def granger(series: DataFrame, group_col: str, t_col: str, value_col: str, max_lag: int = 4,
            alpha: float = GRANGER_ALPHA) -> DataFrame:
    """M7: Granger F-test for every ordered pair (x -> y) of series.

    Restricted OLS: y on its own lags 1..L; full: plus x's lags 1..L.
    F = ((RSS_r - RSS_f) / L) / (RSS_f / (n - 2L - 1)), p-value from the
    F(L, n - 2L - 1) distribution, significant below ``alpha``. Lags are taken on the
    calendar of each series (``lagged``); a pair uses the steps at which both have all
    their lags. The sums of products of the 2L + 2 variables are one Spark aggregate per
    pair, so no pair's rows come together; the normal equations are solved from
    those sums. F does not depend on the scale of the series. NULL is a series
    like any other; a pair with too few steps, or without any spread, has NaN, one
    without a common step no row; when x's lags leave no error at all, F is infinite. The result has one row per ordered pair, and
    the join one per pair and step.
    """
    s = lagged(series, group_col, t_col, value_col, max_lag)
    x = s.select(F.col("g").alias("x"), "t", F.slice("lags", 2, max_lag).alias("xl"))
    y = s.select(F.col("g").alias("y"), "t", "lags")
    one = F.array(F.lit(1.0))
    pairs = x.join(y, "t").where(~F.col("x").eqNullSafe(F.col("y"))).select(
        "x", "y", F.concat(one, F.slice("lags", 2, max_lag), F.col("xl"), F.slice("lags", 1, 1)).alias("z"))
    width = 2 * max_lag + 2
    sums = [F.sum(F.get("z", F.lit(i)) * F.get("z", F.lit(j))) for i in range(width) for j in range(i, width)]
    grams = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"))

    @F.pandas_udf("struct<rss_r:double,rss_f:double>")
    def residuals(sums: pd.Series) -> pd.DataFrame:
        out = []
        for flat in sums:
            gram = np.zeros((width, width))
            gram[np.triu_indices(width)] = flat
            gram = gram + np.triu(gram, 1).T
            def rss(k):
                b = gram[:k, -1]
                return float(gram[-1, -1] - b @ np.linalg.pinv(gram[:k, :k], rcond=1e-12, hermitian=True) @ b)
            out.append((max(rss(max_lag + 1), 0.0), max(rss(width - 1), 0.0)))
        return pd.DataFrame(out, columns=["rss_r", "rss_f"])

    @F.pandas_udf("double")
    def test(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return pd.Series([(0.0 if a == math.inf else f_sf(a, int(b), int(c))) if a == a and c > 0 else None for a, b, c in zip(f, df1, df2)], dtype="float64")

    fitted = grams.withColumn("r", residuals("sums")).withColumn("df2", F.col("n") - (2 * max_lag + 1))
    rss_r, rss_f, least = F.col("r.rss_r"), F.col("r.rss_f"), F.lit(1e-12) * F.col("n")  # of standardised values
    f = (F.when(F.col("df2") <= 0, F.lit(None))
         .when(rss_f > least, F.greatest((rss_r - rss_f) / F.lit(max_lag), F.lit(0.0)) / (rss_f / F.col("df2")))
         .when(rss_r > least, F.lit(float("inf"))))
    nan = F.lit(float("nan"))
    return (fitted.withColumn("f_stat", f).withColumn("df1", F.lit(max_lag).cast("long"))
            .withColumn("p_value", test("f_stat", "df1", "df2"))
            .select("x", "y", "n", F.coalesce("f_stat", nan).alias("f_stat"), "df1", "df2",
                    F.coalesce("p_value", nan).alias("p_value"),
                    F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant")))
