"""Random regression forests on feature histograms (M3).

The rules are those of Spark ML's random forest: every tree sees the rows with
Poisson(1) weights (bootstrap), every node tries ``subset`` features of its own, a split
lowers the sum of squared errors and leaves ``min_rows`` weighted rows on both sides, a
leaf is the weighted mean, importances are the gains per tree, scaled to sum 1.

Spark's part: the rows are cut into bins once for all trees (``boosting.write_blocks``),
neighbours of equal bins being one run: a tree adds up its draws per run and goes on with runs.
One job per level grows all trees of a tranche: each task counts (weight, weighted label)
per (tree, open node, feature of the node, bin) over its rows, tree by tree, so that it
holds the counts of one tree only (where runs are so long that they take no more room with
their draws than the rows do, the draws are added up once for all levels and persisted); one shuffle by tree and ``NODE_CHUNK`` nodes
adds up the parts, and the best splits come back. A task holds at most about
``TASK_ROWS`` rows as bytes. Only splits and node sums reach the driver.

Labels are whole numbers of a fixed step and weights are hashes of the row's key and the
tree, so sums are exact and neither partitions nor recomputation change a tree. Equal
gains go to the first feature, then the lowest bin.

Defined cases: NULLs must be settled before (``ml.training_frame``); rows of one key draw
alike; constant features are never split; without any gain a tree is the weighted mean
(the mean, if it drew no row at all).
"""

from __future__ import annotations

import dataclasses
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.session import remove_path, scratch_path

NODE_CHUNK = 256
#: rows that a task counts at a time, and rows of a task
COUNT_ROWS = 1 << 18
TASK_ROWS = 4_000_000
#: label, key and bins of a row; a tree's draws of a run
ROW_BYTES, DRAWN_BYTES = 22, 12
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
#: Poisson(1) by 16 random bits
DRAWS = np.searchsorted(_CDF, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
PART = "tree int, chunk int, g binary, h binary"
BEST = "tree int, chunk int, feature binary, bin binary, gain binary, gl binary, hl binary, gt binary, ht binary"
KINDS = {"feature": np.int16, "bin": np.uint8, "gain": np.float64, "gl": np.int64, "hl": np.int64,
         "gt": np.int64, "ht": np.int64}


def subset_size(n: int, strategy: str) -> int:
    return {"sqrt": math.ceil(math.sqrt(n)), "onethird": math.ceil(n / 3), "auto": math.ceil(n / 3), "all": n}[strategy]


def node_features(tree_seed: int, heap: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which ``k`` of ``n`` features the nodes ``heap`` try (nodes x features)."""
    if k >= n:
        return np.ones((len(heap), n), dtype=bool)
    u = boosting.uniform((heap[:, None] * n + np.arange(n)).astype(np.int64).ravel(), tree_seed, -2).reshape(-1, n)
    out = np.zeros((len(heap), n), dtype=bool)
    np.put_along_axis(out, np.argsort(u, axis=1, kind="stable")[:, :k], True, axis=1)
    return out


def draw_bits(key: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits per key: the draws of four trees."""
    with np.errstate(over="ignore"):
        salt = boosting.mix64(np.array([seed + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return boosting.mix64(key.view(np.uint64) ^ salt[0])


def draws(key: np.ndarray, tree_seed: int, bits: np.ndarray | None = None) -> np.ndarray:
    """How often the rows are in the bootstrap sample of a tree."""
    bits = draw_bits(key, tree_seed // 4) if bits is None else bits
    return DRAWS[((bits >> np.uint64(16 * (tree_seed % 4))) & np.uint64(0xFFFF)).astype(np.int64)]


def walk(features: np.ndarray, cuts: np.ndarray, x: np.ndarray, n: int, at_rows: np.ndarray, levels: int) -> np.ndarray:
    """Node at depth ``levels`` of the rows ``at_rows`` of ``x``, the bins of ``n`` rows feature by feature."""
    at = np.zeros(len(at_rows), dtype=np.int64)
    start = features.astype(np.int64) * n
    cuts = np.ascontiguousarray(cuts)
    for d in range(levels):
        heap = at + ((1 << d) - 1)
        place = start.take(heap)
        place += at_rows
        right = x.take(place) > cuts.take(heap)
        at += at
        at += right
    return at


@dataclasses.dataclass
class Growing:
    """A tree while it grows: questions in heap order, the open nodes of the next level, sums per node."""

    seed: int
    features: np.ndarray
    cuts: np.ndarray
    open_: np.ndarray
    sums: list
    min_rows: float = 1


def _pieces(rows: list, n_features: int, base: float, unit: float):
    """(runs, their bins, labels and keys of the rows, first row of each run or None) of about COUNT_ROWS rows at a time."""
    while rows:
        take, n = [], 0
        while rows and n < COUNT_ROWS:
            take.append(rows.pop())
            n += take[-1]["n"]
        x, size, y, key = (np.concatenate(c, axis=-1) for c in zip(*(boosting.unpack(r, n_features) for r in take)))
        starts = np.cumsum(size) - size if len(size) < n else None
        yield len(size), x.ravel(), np.rint((y - base) / unit), key, starts


def _weighted(q: np.ndarray, key: np.ndarray, starts, seed: int, bits: dict, piece: int):
    """Draws of a tree and draws times label, per run; the latter None where every row is a run."""
    if bits.get(piece, (None,))[0] != seed // 4:
        bits[piece] = (seed // 4, draw_bits(key, seed // 4))
    w = draws(key, seed, bits[piece][1])
    if starts is None:
        return w, None
    w = w.astype(np.float64)
    return np.add.reduceat(w, starts), np.add.reduceat(q * w, starts)


def _draw(blocks: DataFrame, seeds, n_features: int, base: float, unit: float) -> DataFrame:
    """Runs with the draws of all trees, so that the levels do not read the rows."""
    def run(batches):
        rows, bits = [r for b in batches for r in b.to_pylist()], {}
        for p, (n, x, q, key, starts) in enumerate(_pieces(rows, n_features, base, unit)):
            starts = np.arange(n) if starts is None else starts
            w, wq = np.empty((len(seeds), n), np.int32), np.empty((len(seeds), n))
            for i, seed in enumerate(seeds):
                w[i], wq[i] = _weighted(q, key, starts, seed, bits, p)
            bits.clear()
            yield pa.RecordBatch.from_pydict({"runs": pa.array([n], pa.int64()), "bins": [x.tobytes()], "w": [w.tobytes()], "wq": [wq.tobytes()]})

    return blocks.mapInArrow(run, "runs long, bins binary, w binary, wq binary")


def _count(blocks: DataFrame, trees: list, level: int, widths: list[int], k: int, base: float, unit: float) -> list:
    """Best splits of the open nodes of all trees; ``blocks`` of rows or of ``_draw``."""
    drawn = "wq" in blocks.columns
    n_features, nodes = len(widths), 1 << level
    sent = [(i, t.seed, t.features, t.cuts, t.open_) for i, t in enumerate(trees) if t.open_.any()]

    def add_up(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        if drawn:
            parts = [(r["runs"], np.frombuffer(r["bins"], np.uint8), np.frombuffer(r["w"], np.int32).reshape(-1, r["runs"]),
                      np.frombuffer(r["wq"]).reshape(-1, r["runs"])) for r in rows]
        else:
            parts = list(_pieces(rows, n_features, base, unit))
        bits = {}
        for i, seed, features, cuts, open_ in sent:
            live = np.flatnonzero(open_)
            slot = np.full(nodes, -1, dtype=np.int64)
            slot[live] = np.arange(len(live))
            tried = node_features(seed, live + nodes - 1, n_features, k)
            g = [np.zeros(len(live) * w, np.int64) for w in widths]
            h = [np.zeros(len(live) * w, np.int64) for w in widths]
            for p, (n, x, *part) in enumerate(parts):
                w, wq = (a[i] for a in part) if drawn else _weighted(*part, seed, bits, p)
                rows = np.flatnonzero(w != 0)
                at = slot.take(walk(features, cuts, x, n, rows, level))
                if len(live) < nodes:
                    keep = at >= 0
                    rows, at = rows[keep], at[keep]
                w = w.take(rows).astype(np.float64)
                wq = part[0].take(rows) * w if wq is None else wq.take(rows)
                for j, width in enumerate(widths):
                    if not tried[:, j].any():
                        continue
                    cell = at * width
                    cell += x[j * n:(j + 1) * n].take(rows)
                    g[j] += np.bincount(cell, wq, len(g[j])).astype(np.int64)
                    h[j] += np.bincount(cell, w, len(h[j])).astype(np.int64)
            for lo in range(0, len(live), NODE_CHUNK):
                some = slice(lo, lo + NODE_CHUNK)
                cut = [[s[j].reshape(-1, width)[some][tried[some, j]].ravel() for j, width in enumerate(widths)]
                       for s in (g, h)]
                yield pa.RecordBatch.from_pydict(
                    {"tree": pa.array([i], pa.int32()), "chunk": pa.array([lo], pa.int32()),
                     "g": pa.array([np.concatenate(cut[0]).tobytes()], pa.binary()),
                     "h": pa.array([np.concatenate(cut[1]).astype(np.int32).tobytes()], pa.binary())})

    at_tree = {i: (seed, open_) for i, seed, _, _, open_ in sent}
    least = trees[0].min_rows

    def choose(parts: pd.DataFrame) -> pd.DataFrame:
        i, lo = int(parts["tree"].iloc[0]), int(parts["chunk"].iloc[0])
        seed, open_ = at_tree[i]
        live = np.flatnonzero(open_)[lo:lo + NODE_CHUNK]
        tried = node_features(seed, live + nodes - 1, n_features, k)
        g, h = (sum(np.frombuffer(b, kind).astype(np.int64) for b in parts[c]) for c, kind in (("g", np.int64), ("h", np.int32)))
        best = {c: np.zeros(len(live), kind) for c, kind in KINDS.items()}
        best["feature"][:], best["gain"][:] = -1, 0.0
        start = 0
        for j, width in enumerate(widths):
            on = np.flatnonzero(tried[:, j])
            if not len(on):
                continue
            gl = np.cumsum(g[start:start + len(on) * width].reshape(-1, width), axis=1)
            hl = np.cumsum(h[start:start + len(on) * width].reshape(-1, width), axis=1)
            start += len(on) * width
            gt, ht = gl[:, -1:], hl[:, -1:]
            a, b = hl.astype(np.float64), (ht - hl).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (gl * unit) ** 2 / a + ((gt - gl) * unit) ** 2 / b - (gt * unit) ** 2 / ht
            gain[(hl < max(least, 1)) | (ht - hl < max(least, 1))] = -1.0
            at = np.argmax(gain, axis=1)
            r = np.arange(len(on))
            best["gt"][on], best["ht"][on] = gt[:, 0], ht[:, 0]
            better = gain[r, at] > best["gain"][on]
            to, r, at = on[better], r[better], at[better]
            best["feature"][to], best["bin"][to], best["gain"][to] = j, at, gain[r, at]
            best["gl"][to], best["hl"][to] = gl[r, at], hl[r, at]
        return pd.DataFrame({"tree": [i], "chunk": [lo], **{c: [v.tobytes()] for c, v in best.items()}})

    return blocks.mapInArrow(add_up, PART).groupBy("tree", "chunk").applyInPandas(choose, BEST).collect()


def _grow(blocks, seeds, widths, k, depth, min_rows, base, unit):
    """Trees as (features, bins, values) with their gains per feature."""
    trees = [Growing(s, np.zeros(0, np.int16), np.zeros(0, np.uint8), np.ones(1, bool), [(0, 0)], min_rows) for s in seeds]
    gains = np.zeros((len(trees), len(widths)))
    for level in range(depth):
        if not any(t.open_.any() for t in trees):
            break
        nodes = 1 << level
        found = {}
        for r in _count(blocks, trees, level, widths, k, base, unit):
            found.setdefault(r.tree, []).append(r)
        for i, t in enumerate(trees):
            f, c = np.zeros(nodes, np.int16), np.full(nodes, 255, np.uint8)
            g, h = np.zeros(2 * nodes, np.int64), np.zeros(2 * nodes, np.int64)
            old_g, old_h = (np.array([s[x] for s in t.sums], np.int64) for x in (0, 1))
            next_open = np.zeros(2 * nodes, bool)
            live = np.flatnonzero(t.open_)
            for r in found.get(i, []):
                best = {col: np.frombuffer(r[col], kind) for col, kind in KINDS.items()}
                at = live[r.chunk:r.chunk + len(best["feature"])]
                old_g[at], old_h[at] = best["gt"], best["ht"]
                on = best["feature"] >= 0
                at = at[on]
                f[at], c[at] = best["feature"][on], best["bin"][on]
                np.add.at(gains[i], best["feature"][on], best["gain"][on])
                g[2 * at], h[2 * at] = best["gl"][on], best["hl"][on]
                g[2 * at + 1], h[2 * at + 1] = best["gt"][on] - best["gl"][on], best["ht"][on] - best["hl"][on]
                next_open[2 * at] = next_open[2 * at + 1] = True
            whole = c == 255
            whole[np.flatnonzero(next_open[::2])] = False
            g[::2][whole], h[::2][whole] = old_g[whole], old_h[whole]
            next_open &= h >= 2 * max(min_rows, 1)  # a smaller node has no split
            t.features, t.cuts = np.concatenate([t.features, f]), np.concatenate([t.cuts, c])
            t.sums, t.open_ = list(zip(g.tolist(), h.tolist())), next_open
    done = []
    for t in trees:
        values = np.array([base + g * unit / h if h else base for g, h in t.sums])
        done.append((t.features, t.cuts, values))
    return done, gains


class ForestTree:
    """One tree on its own."""

    def __init__(self, edges, features, bins, values):
        self.edges, self.features, self.bins, self.values = edges, features, bins, values

    def predict(self, x) -> float:
        return float(_means(self.edges, [(self.features, self.bins, self.values)], np.asarray(x, dtype=float)[:, None])[0])

    @property
    def toDebugString(self) -> str:
        return "\n".join(f"{i}: feature {f} > {self.edges[f][b] if b < len(self.edges[f]) else 'all'}"
                         for i, (f, b) in enumerate(zip(self.features.tolist(), self.bins.tolist())))


def _means(edges, trees, x: np.ndarray) -> np.ndarray:
    """Mean over the trees for raw rows (features x rows)."""
    bins = np.stack([np.searchsorted(np.asarray(e), x[j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)
    return boosting.per_run(bins, lambda b: boosting.scores(_stacked(trees), b) / len(trees))


def _stacked(trees: list) -> list:
    return boosting.stacked([boosting.Tree(*t) for t in trees])


class ForestModel:
    """A tranche of trees."""

    def __init__(self, edges, grown, importances):
        self.edges, self.grown, self.feature_importances = edges, grown, np.asarray(importances)

    @property
    def trees(self) -> list[ForestTree]:
        return [ForestTree(self.edges, *t) for t in self.grown]

    def transform(self, df: DataFrame, to: str, features: str = "features") -> DataFrame:
        array = vector_to_array(F.col(features)) if dict(df.dtypes)[features] == "vector" else F.col(features)
        edges, trees, stacks = [np.asarray(e) for e in self.edges], len(self.grown), _stacked(self.grown)

        @F.arrow_udf("double")
        def apply(x: pa.Array) -> pa.Array:
            x = boosting.matrix(x, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)
            return pa.array(boosting.per_run(bins, lambda b: boosting.scores(stacks, b) / trees), pa.float64())

        return df.withColumn(to, apply(array))

    def save(self, spark, path: str) -> None:
        data = pickle.dumps((self.edges, self.grown, self.feature_importances))
        spark.createDataFrame([(bytearray(data),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "ForestModel":
        return cls(*pickle.loads(bytes(spark.read.parquet(path).first()[0])))


class Trainer:
    """Rows cut into bins once; ``grow`` trains tranches on them. ``close`` removes the blocks."""

    def __init__(self, rows: DataFrame, maxDepth: int = 5, maxBins: int = 32, minInstancesPerNode: int = 1,
                 featureSubsetStrategy: str = "auto"):
        self.spark, self.depth, self.least = rows.sparkSession, maxDepth, minInstancesPerNode
        array = vector_to_array(F.col("features")) if dict(rows.dtypes)["features"] == "vector" else F.col("features")
        data = rows.select(F.col("row_key").alias("key"), F.col("label").cast("double").alias("label"), array.alias("features"))
        n, mean, low, high, width = data.agg(F.count(F.lit(1)), F.avg("label"), F.min("label"), F.max("label"),
                                             F.max(F.size("features"))).first()
        if not n:
            raise ValueError("no training rows")
        if maxBins > 256:
            raise ValueError("a bin is one byte: at most 256 bins")
        self.base = float(f"{mean:.12g}")
        # exact: a count of COUNT_ROWS rows in doubles, all rows in 64 bits
        reach, most = max(high - self.base, self.base - low, 1e-300), math.ceil(math.log2(int(DRAWS.max()) + 1))
        bits = min(52 - most - math.ceil(math.log2(2 * COUNT_ROWS)), 62 - most - math.ceil(math.log2(max(n, 2))))
        self.unit = 2.0 ** (math.ceil(math.log2(reach)) - bits)
        self.edges = boosting.bin_edges(data, width, maxBins)
        self.k = subset_size(width, featureSubsetStrategy)
        self.path = scratch_path(self.spark, "forest")
        boosting.write_blocks(data, self.edges, boosting.Settings(valid_share=0.0), self.path)
        self.rows, self.runs = self.spark.read.schema(boosting.SCHEMA).parquet(self.path).agg(F.sum("n"), F.sum("runs")).first()
        cores = self.spark.sparkContext.defaultParallelism
        self.tasks = max(cores, -(-n // TASK_ROWS))

    def grow(self, trees: int, seed: int) -> ForestModel:
        blocks = (self.spark.read.schema(boosting.SCHEMA).parquet(self.path).select("n", "runs", "bins", "size", "y", "key")
                  .coalesce(self.tasks))
        widths = [len(e) + 1 for e in self.edges]
        seeds, drawn = range(seed, seed + trees), None
        if self.runs * trees * DRAWN_BYTES <= self.rows * ROW_BYTES:
            blocks = drawn = _draw(blocks, seeds, len(widths), self.base, self.unit).persist()
        grown, gains = _grow(blocks, seeds, widths, self.k, self.depth, self.least, self.base, self.unit)
        if drawn is not None:
            drawn.unpersist()
        sums = gains.sum(axis=1, keepdims=True)
        total = np.divide(gains, sums, out=np.zeros_like(gains), where=sums > 0).sum(axis=0)
        return ForestModel(self.edges, grown, total / total.sum() if total.sum() else total)

    def close(self) -> None:
        remove_path(self.spark, self.path)
