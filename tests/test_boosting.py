"""Histogram boosting, tranche forests and stored training against plain versions on small rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tessera.operators import boosting, forest, ml

N = 500


def small_rows(seed=1, noise=3.0):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 12, N), r.normal(size=N).round(1), r.integers(0, 3, N), np.ones(N)]).astype(float)
    y = 4 * x[:, 0] + 10 * (x[:, 1] > 0.3) * x[:, 2] + r.normal(size=N) * noise
    key = r.permutation(N).astype(np.int64) * 7919
    return key, y, x


def frame(spark, key, y, x, parts=3):
    rows = [(int(k), float(v), [float(c) for c in row]) for k, v, row in zip(key, y, x)]
    return spark.createDataFrame(rows, "row_key long, label double, features array<double>").repartition(parts)


# ---------------------------------------------------------------- the plain version
def t(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g)


def strength(g, h, s):
    return t(g, s.l1) ** 2 / (h + s.l2) if h + s.l2 > 0 else 0.0


def plain_tree(x, g, w, cols, s):
    """Questions as {node path: (feature, threshold)} and a value per row, by trying every cut."""
    def sums(rows):
        return sum(g[i] * w[i] for i in rows), sum(w[i] for i in rows)

    def cut(rows, f, c):
        return [i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]

    def gain(rows, f, c):
        return sum(strength(*sums(p), s) for p in cut(rows, f, c)) - strength(*sums(rows), s)

    live = [i for i in range(len(x)) if w[i] > 0]
    nodes, splits = {"": live}, {}
    for depth in range(s.depth):
        nxt = {}
        cuts = [(f, c) for f in cols for c in sorted(set(x[:, f]))[:-1]]
        if s.symmetric:
            options = [(sum(gain(rows, f, c) for rows in nodes.values()), -k, f, c) for k, (f, c) in enumerate(cuts)
                       if any(all(cut(rows, f, c)) for rows in nodes.values())]
            best = max(options, default=None)
            if best is None or best[0] <= 0:
                break
        for path, rows in nodes.items():
            if not s.symmetric:
                options = [(gain(rows, f, c), -k, f, c) for k, (f, c) in enumerate(cuts)
                           if all(cut(rows, f, c)) and min(sums(p)[1] for p in cut(rows, f, c)) >= s.min_child]
                best = max(options, default=None)
                if best is None or best[0] <= 0:
                    continue
            splits[path] = best[2:]
            nxt[path + "0"], nxt[path + "1"] = cut(rows, *best[2:])
        nodes = {**{p: r for p, r in nodes.items() if p not in splits}, **nxt} if not s.symmetric else nxt
        if not nxt:
            break
    values = {}
    for path, rows in nodes.items():
        gs, hs = sums(rows)
        values[path] = -t(gs, s.l1) / (hs + s.l2) * s.eta if hs + s.l2 > 0 else 0.0

    def place(row):
        path = ""
        while path in splits:
            f, c = splits[path]
            path += "1" if row[f] > c else "0"
        return values.get(path, 0.0)
    return splits, np.array([place(row) for row in x])


def plain_boosting(key, y, x, s):
    valid = boosting.uniform(key, s.seed, -1) < s.valid_share
    score, trees = np.full(len(y), y.mean()), []
    for r in range(s.rounds):
        w = boosting.weights(key, s, r) / boosting.WEIGHT_STEP * ~valid
        splits, add = plain_tree(x, score - y, w, boosting.tree_features(x.shape[1], s, r), s)
        score = score + add
        trees.append((splits, score))
    return trees


def heap_splits(tree):
    found, levels = {}, tree.levels()
    for d in range(levels):
        for i, path in enumerate(itertools.product("01", repeat=d)):
            at = (1 << d) - 1 + i
            if tree.bins[at] != math.inf:
                found["".join(path)] = (tree.features[at], tree.bins[at])
    return found


M1 = boosting.Settings(rounds=4, depth=4, eta=0.3, subsample=0.8, colsample=0.8, min_child=5, l1=0.1, l2=1.0, patience=50)
M2 = boosting.Settings(rounds=4, depth=3, eta=0.3, l2=3.0, symmetric=True, bayesian=True, patience=50)


@pytest.mark.parametrize("s", [M1, M2], ids=["penalties", "symmetric"])
def test_equals_the_plain_version_tree_by_tree(spark, s, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "BLOCK", 64)
    key, y, x = small_rows()
    model = boosting.train(frame(spark, key, y, x), "m", s)
    want = plain_boosting(key, y, x, s)
    raw = model.raw_trees()
    assert 1 <= len(raw) <= s.rounds
    for k, tree in enumerate(raw):
        splits = want[k][0]
        if s.symmetric:
            splits = {p: c for p, c in splits.items()}
            assert {c for p, c in heap_splits(tree).items()} >= set(splits.values())
        else:
            assert heap_splits(tree) == splits
        part = boosting.BoostedModel("m", s, model.base, model.edges, model.trees[:k + 1], model.importance, [])
        assert np.allclose(part.predict(x), want[k][1], rtol=0, atol=1e-6)
    got = model.transform(frame(spark, key, y, x)).collect()
    back = {r.row_key: r.m for r in got}
    assert np.allclose([back[int(k)] for k in key], model.predict(x), atol=1e-9)
    assert model.feature_importances[3] == 0 and sum(model.feature_importances) == pytest.approx(1)


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 32)
    key, y, x = small_rows(2)
    a, b = (boosting.train(frame(spark, key, y, x, p), "m", M2) for p in (1, 7))
    assert [boosting.dataclasses.astuple(t) for t in a.trees] == [boosting.dataclasses.astuple(t) for t in b.trees]


def test_without_penalties_it_is_sparks_tree(spark):
    key, y, x = small_rows(3)
    s = boosting.Settings(rounds=1, depth=4, eta=1.0, min_child=5, valid_share=0.0)
    df = frame(spark, key, y, x)
    ours = {r.row_key: r.m for r in boosting.train(df, "m", s).transform(df).collect()}
    vec = VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="v").transform(
        df.select("row_key", "label", *[F.col("features")[i].alias(f"x{i}") for i in range(4)]))
    tree = DecisionTreeRegressor(featuresCol="v", labelCol="label", maxDepth=4, maxBins=256, minInstancesPerNode=5).fit(vec)
    theirs = {r.row_key: r.prediction for r in tree.transform(vec).collect()}
    assert ours.keys() == theirs.keys()
    assert all(abs(ours[k] - theirs[k]) < 1e-6 for k in ours)


def test_many_values_are_cut_at_quantiles_and_training_stops(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 2))
    key = np.arange(3000, dtype=np.int64)
    s = boosting.Settings(rounds=60, depth=2, eta=0.5, bins=16, patience=3, l2=1.0)
    noise = boosting.train(frame(spark, key, r.normal(size=3000), x), "m", s)
    assert noise.trees_trained < 20 and len(noise.history) - 1 - noise.trees_trained <= 3
    assert all(len(e) <= 15 for e in noise.edges)
    clear = boosting.train(frame(spark, key, 5.0 * (x[:, 0] > 0), x), "m", s)
    assert clear.history[clear.trees_trained][1] < 0.5 < clear.history[0][1]
    again = boosting.BoostedModel.from_json(clear.to_json())
    assert np.array_equal(again.predict(x), clear.predict(x))


def test_no_rows_constant_rows_and_repeated_rows(spark):
    with pytest.raises(ValueError, match="no training rows"):
        boosting.train(frame(spark, *(v[:0] for v in small_rows())), "m", M1)
    key = np.zeros(50, dtype=np.int64)
    flat = boosting.train(frame(spark, key, np.full(50, 2.5), np.ones((50, 2))), "m", boosting.Settings(rounds=3, depth=2))
    assert flat.predict(np.ones((1, 2))).tolist() == [2.5]


# ---------------------------------------------------------------- forests and stored models
@pytest.fixture(scope="module")
def train_rows(spark):
    key, y, x = small_rows(4, noise=1.0)
    df = spark.createDataFrame([(int(k), float(v), *map(float, row)) for k, v, row in zip(key, y, x)],
                               "k long, views_y double, a double, b double, c double, d double")
    return ml.training_frame(df, ["a", "b", "c", "d"], "views_y", min_rows=10, key_cols=["k"]).cache()


def test_tranches_are_one_forest(spark, train_rows, tmp_path):
    f = ml.train_forest(train_rows, "m3", 7, str(tmp_path), tranche=3, tol=-1.0, maxDepth=4, minInstancesPerNode=5)
    assert [n for _, _, n in f.tranches] == [3, 3, 1] and f.trees_trained == 7
    trees = [t for _, m, _ in f.tranches for t in m.trees]
    rows = f.transform(train_rows).select("features", "m3").limit(40).collect()
    for r in rows:
        assert r.m3 == pytest.approx(sum(t.predict(r.features) for t in trees) / 7, rel=1e-9)
    seeds = {m.trees[0].toDebugString for _, m, _ in f.tranches}
    assert len(seeds) == 3  # tranches differ
    stopped = ml.train_forest(train_rows, "m3", 100, str(tmp_path), tranche=2, tol=1.0, maxDepth=2)
    assert stopped.trees_trained == 6  # two tranches that bring too little end it


def test_training_is_stored_and_reasons_are_kept(spark, train_rows, monkeypatch):
    monkeypatch.setattr(ml, "TRANCHE", 2)
    first = ml.train_ensemble(train_rows, 4)
    assert first.models_ok == 3 and first.errors == {} and set(first.trees_trained) == {"m1", "m2", "m3"}

    def refuse(*a, **k):
        raise AssertionError("trained again")
    monkeypatch.setattr(ml.boosting, "train", refuse)
    monkeypatch.setattr(ml, "train_forest", refuse)
    again = ml.train_ensemble(train_rows, 4)
    a, b = (ml.score(f, train_rows).select("m1", "m2", "m3", "ensemble").collect() for f in (first, again))
    assert a == b
    with pytest.raises(RuntimeError, match="trained again"):
        ml.train_ensemble(train_rows, 5)


def test_one_failed_model_leaves_the_others(spark, train_rows, monkeypatch):
    def refuse(*a, **k):
        raise ValueError("no boosting today")
    monkeypatch.setattr(ml.boosting, "train", refuse)
    f = ml.train_ensemble(train_rows, 3)
    assert f.models_ok == 1 and f["m1"] is None and "no boosting today" in f.errors["m1"]
    got = ml.score(f, train_rows).first()
    assert got.m1 is None and got.ensemble == pytest.approx(got.m3)


# ---------------------------------------------------------------- forests on histograms
def plain_forest_tree(key, y, x, seed, k, depth, least):
    """Splits as {heap place: (feature, threshold)} and a value per row, by trying every cut."""
    w = forest.draws(key, seed).astype(int)
    splits, value = {}, np.zeros(len(y))

    def error(rows):
        m = sum(w[rows] * y[rows]) / sum(w[rows])
        return sum(w[rows] * (y[rows] - m) ** 2)

    def grow(place, level, rows, everyone):
        drawn = rows[w[rows] > 0]
        best = None
        if level < depth and len(drawn):
            for f in np.flatnonzero(forest.node_features(seed, np.array([place]), x.shape[1], k)[0]):
                for c in sorted(set(x[drawn, f]))[:-1]:
                    left, right = drawn[x[drawn, f] <= c], drawn[x[drawn, f] > c]
                    if min(w[left].sum(), w[right].sum()) >= least:
                        gain = error(drawn) - error(left) - error(right)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, c)
        if best is None:
            value[everyone] = sum(w[drawn] * y[drawn]) / sum(w[drawn])
            return
        _, f, c = best
        splits[place] = (f, c)
        on = x[:, f] <= c
        grow(2 * place + 1, level + 1, rows[on[rows]], everyone & on)
        grow(2 * place + 2, level + 1, rows[~on[rows]], everyone & ~on)

    grow(0, 0, np.arange(len(y)), np.ones(len(y), bool))
    return splits, value


def test_forest_equals_plain_trees_and_ignores_partitions(spark, monkeypatch):
    """A forest grows on histograms, all trees of a tranche per job: same trees as trying every cut, however
    the rows are dealt out and counted."""
    key, y, x = small_rows(6)
    monkeypatch.setattr(boosting, "BLOCK", 64)
    models = []
    for parts, chunk in ((1, 256), (5, 2)):
        monkeypatch.setattr(forest, "NODE_CHUNK", chunk)
        trainer = forest.Trainer(frame(spark, key, y, x, parts), maxDepth=4, maxBins=64, minInstancesPerNode=5,
                                 featureSubsetStrategy="sqrt")
        models.append(trainer.grow(5, 42))
        trainer.close()
    for a, b in zip(*(m.grown for m in models)):
        assert all(np.array_equal(p, q) for p, q in zip(a, b))
    for i, tree in enumerate(models[0].trees):
        splits, value = plain_forest_tree(key, y, x, 42 + i, 2, 4, 5)
        got = {p: (f, tree.edges[f][c]) for p, (f, c) in enumerate(zip(tree.features, tree.bins)) if c < 255}
        assert got == splits
        assert np.allclose([tree.predict(r) for r in x], value, atol=1e-6)
    back = {r.row_key: r.p for r in models[0].transform(frame(spark, key, y, x), "p").collect()}
    want = np.mean([[t.predict(r) for r in x] for t in models[0].trees], axis=0)
    assert np.allclose([back[int(k)] for k in key], want, atol=1e-9)
    assert models[0].feature_importances.sum() == pytest.approx(1) and models[0].feature_importances[3] == 0


def test_forest_draws_are_a_bootstrap():
    w = forest.draws(np.arange(200_000, dtype=np.int64), 7)
    assert abs((w == 0).mean() - math.exp(-1)) < 0.005 and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w, forest.draws(np.arange(200_000, dtype=np.int64), 6))[0, 1]) < 0.01


def test_a_level_walks_few_older_trees(spark, monkeypatch):
    """Scores of finished trees are stored soon, so the work of a level does not grow with the rounds."""
    key, y, x = small_rows(8)
    walked, level = [], boosting._level

    def seen(blocks, recent, *rest):
        walked.append(len(recent))
        return level(blocks, recent, *rest)
    monkeypatch.setattr(boosting, "_level", seen)
    s = boosting.Settings(rounds=9, depth=1, eta=0.3, patience=50)
    model = boosting.train(frame(spark, key, y, x, 2), "m", s)
    assert model.trees_trained >= 8 and max(walked) < 4
    wanted = plain_boosting(key, y, x, s)[model.trees_trained - 1][1]
    assert np.allclose(model.predict(x), wanted, atol=1e-6)


def test_training_rows_fill_every_core(spark, monkeypatch):
    monkeypatch.setattr(ml, "PART_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(150 * cores).select("id", F.col("id").cast("double").alias("a"), F.lit(1.0).alias("y"))
    rows = ml.training_frame(df, ["a"], "y", min_rows=10, key_cols=["id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert f", {2 * cores})" in plan and rows.count() == 150 * cores  # 1.5 x the cores left half of them idle


# ---------------------------------------------------------------- rows of equal bins
def repeated(seed=9, copies=6, n=60):
    """Rows of which many share all features, with keys and labels of their own."""
    r = np.random.default_rng(seed)
    x = np.repeat(np.column_stack([r.integers(0, 6, n), r.integers(0, 4, n), r.integers(0, 3, n)]).astype(float), copies, axis=0)
    y = 3 * x[:, 0] + 5 * (x[:, 1] > 1) * x[:, 2] + r.normal(size=len(x))
    at = r.permutation(len(x))
    return np.arange(len(x), dtype=np.int64) * 7919, y[at], x[at]


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_round_is_one_job_and_reads_its_rows_seldom(spark, monkeypatch):
    """A job per level, and all rows in each of them, made rounds of large tables take minutes."""
    key, y, x = repeated(copies=20, n=30)
    df, drawn, draw = frame(spark, key, y, x, 2), [], getattr(boosting, "_draw", None)
    s = boosting.Settings(rounds=12, depth=5, eta=0.3, patience=50)
    if draw:
        monkeypatch.setattr(boosting, "_draw", lambda *a: (drawn.append(a), draw(*a))[1])
    model, many = jobs_of(spark, "rounds-12", lambda: boosting.train(df, "m", s))
    draws = len(drawn)
    few = jobs_of(spark, "rounds-2", lambda: boosting.train(df, "m", boosting.dataclasses.replace(s, rounds=2)))[1]
    assert model.trees_trained == 12 and many - few <= 10 * 2  # a tree of 5 levels, seldom draws or stored scores
    assert 1 <= draws <= 4
    assert np.allclose(model.predict(x), plain_boosting(key, y, x, s)[11][1], atol=1e-6)


@pytest.mark.parametrize("s", [M1, M2], ids=["penalties", "symmetric"])
def test_one_task_levels_and_shared_draws_grow_the_same_trees(spark, s, monkeypatch):
    key, y, x = repeated(10)
    s = boosting.dataclasses.replace(s, rounds=7)
    want = plain_boosting(key, y, x, s)
    found = []
    for local, draws, block, parts in ((1 << 25, 16, 1 << 14, 1), (0, 16, 1 << 14, 2), (0, 1, 16, 5), (1 << 25, 2, 16, 3)):
        monkeypatch.setattr(boosting, "LOCAL_BYTES", local)
        monkeypatch.setattr(boosting, "MOST_DRAWN", draws)
        monkeypatch.setattr(boosting, "COUNT_RUNS", 1 << 17 if local else 7)
        model = boosting.train(frame(spark, key, y, x, parts), "m", s)
        assert np.allclose(model.predict(x), want[model.trees_trained - 1][1], atol=1e-6)
        found.append([(t.features, t.bins, t.values) for t in model.trees])
        assert [h[1] for h in model.history] == pytest.approx(
            [np.mean((p - y)[boosting.uniform(key, s.seed, -1) < s.valid_share] ** 2)
             for p in [np.full(len(y), model.base), *(w[1] for w in want)]][:len(model.history)])
    assert all(f == found[0] for f in found)


def test_sums_beyond_doubles_stay_exact():
    r = np.random.default_rng(3)
    x, at = r.integers(0, 4, (1, 3000)).astype(np.uint8), r.integers(0, 2, 3000)
    g, h = r.integers(-(1 << 60), 1 << 60, 3000), r.integers(1, 1 << 20, 3000)
    sums = boosting._empty([0], 2, 4)
    boosting.add_histograms(sums, x, g, h, at, 4)
    for cell in range(8):
        on = at * 4 + x[0] == cell
        high, low, weight = (int(a[cell]) for a in sums[0])
        assert (high << boosting.LOW_BITS) + low == sum(map(int, g[on])) and weight == h[on].sum()


def test_forest_counts_rows_of_equal_bins_together(spark, monkeypatch):
    key, y, x = repeated(11)
    monkeypatch.setattr(boosting, "BLOCK", 50)
    trainer = forest.Trainer(frame(spark, key, y, x, 3), maxDepth=4, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="sqrt")
    blocks = spark.read.parquet(trainer.path).agg(F.sum("n"), F.sum("runs")).first()
    model = trainer.grow(3, 42)
    counted, count = [], forest._count
    monkeypatch.setattr(forest, "_count", lambda b, *a: (counted.append("wq" in b.columns), count(b, *a))[1])
    monkeypatch.setattr(forest, "ROW_BYTES", 10_000)  # levels read the sums of draws
    again = trainer.grow(3, 42)
    monkeypatch.setattr(forest, "ROW_BYTES", 0)  # levels read the rows
    third = trainer.grow(3, 42)
    assert counted[0] and not counted[-1]
    assert all(np.array_equal(p, q) for m in (again, third) for a, b in zip(model.grown, m.grown) for p, q in zip(a, b))
    trainer.close()
    assert blocks[0] == len(y) and blocks[1] < 0.6 * len(y)
    for i, tree in enumerate(model.trees):
        splits, value = plain_forest_tree(key, y, x, 42 + i, 2, 4, 5)
        assert {p: (f, tree.edges[f][c]) for p, (f, c) in enumerate(zip(tree.features, tree.bins)) if c < 255} == splits
        assert np.allclose([tree.predict(row) for row in x], value, atol=1e-6)


def test_models_score_neighbours_of_equal_bins_once(spark, monkeypatch):
    key, y, x = repeated(12)
    df = frame(spark, key, y, x, 2)
    model = boosting.train(df, "m", boosting.dataclasses.replace(M1, rounds=3))
    bins = boosting.to_bins(x[np.lexsort(x.T)], [np.asarray(e) for e in model.edges])
    seen = []
    got = boosting.per_run(bins, lambda b: (seen.append(b.shape[1]), boosting.scores(boosting.stacked(model.trees), b, model.base))[1])
    assert seen[0] < 0.6 * len(y) and np.allclose(got, model.predict(x[np.lexsort(x.T)]), atol=1e-9)
    back = {r.row_key: r.m for r in model.transform(df.orderBy("features")).collect()}
    assert np.allclose([back[int(k)] for k in key], model.predict(x), atol=1e-9)
    few = boosting.scores(boosting.stacked(model.trees), bins)
    monkeypatch.setattr(boosting, "STACK_CELLS", 1)
    assert np.allclose(boosting.scores(boosting.stacked(model.trees), bins), few, atol=1e-9)


def test_together_sorts_the_rows_and_keeps_them(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.lit(2.0).alias("b"), F.col("id").cast("double").alias("y"))
    rows = ml.training_frame(df, ["a", "b"], "y", min_rows=10, key_cols=["id"], together=True)
    parts = [[r.a for r in p] for p in rows.select("a").rdd.glom().collect()]
    assert sum(map(len, parts)) == 3000 and all(p == sorted(p) for p in parts)
    assert max(map(len, parts)) < 3000 / 2 or len(parts) == 1  # one value of the features is no bound of a partition
    plain = ml.training_frame(df, ["a", "b"], "y", min_rows=10, key_cols=["id"])
    assert sorted(r.row_key for r in rows.collect()) == sorted(r.row_key for r in plain.collect())


def test_edges_are_exact_up_to_the_last_bin(spark):
    """A feature of just as many values as bins keeps them all, wherever they are."""
    r = np.random.default_rng(4)
    x = np.column_stack([r.permutation(3000) % 256, r.permutation(3000) % 257, np.sort(np.arange(3000) % 40)]).astype(float)
    df = frame(spark, np.arange(3000, dtype=np.int64), x[:, 0], x, 4)
    edges = boosting.bin_edges(df, 3, 256)
    assert edges[0] == list(range(255)) and len(edges[1]) <= 255 and edges[2] == list(range(39))
