"""Gradient-boosted trees on feature histograms.

Squared-error boosting with the leaf and split rules of the two boosted models:

* ``symmetric=False`` (M1): every node has a split of its own. With G and H the sums
  of weighted gradients and weights, a leaf is -T(G) / (H + l2) and a split gains
  S(left) + S(right) - S(node), where T(G) = sign(G) max(|G| - l1, 0) and
  S = T(G)^2 / (H + l2). Children need H >= ``min_child``. Rows are kept per round
  with probability ``subsample``, a share ``colsample`` of the features enters a tree.
* ``symmetric=True`` (M2): one split per level for all its nodes, so a tree is
  ``depth`` questions and its leaf index a bit string. ``bayesian`` draws row weights
  from the exponential distribution instead of leaving rows out.

Spark's part: the training rows are cut into bins once and written as blocks of at most
``BLOCK`` rows, sorted so that rows of equal bins are one run (one byte per value of a run, and
label and key of every row). A round reads the rows once: weights and gradients are
added up per run (``_level``). The levels of its tree work on the runs only, of which there are
never more than rows or than products of bins:

* runs of at most ``LOCAL_BYTES`` in all: one task grows the whole tree, one job per round;
* more: the sums are persisted for the round (memory, then disk) and every level is one job: each
  task adds up the (gradient, weight) histograms per (node, feature, bin), one shuffle brings
  the parts of a feature together, and the best split per node or level comes back.

Only splits and sums of nodes reach the driver: at most features x
2^(depth-1) small rows, never rows of the data. Scores of the finished trees are
written back with the blocks, one per run, every ``KEEP`` rounds (more rounds where runs are
long: a walk costs by run, a copy by row) and the older copy is removed, so a round walks few
older trees. The jobs run in a session of their own, without adaptive replanning and with one
shuffle partition for each group.

Gradients and weights are whole numbers of a fixed step, chosen so that no sum can
overflow. Sums are therefore exact and do not depend on the order of tasks or on
recomputation; the draws are hashes of the row's key and the round. Equal gains go
to the first feature, then the lowest bin.

Training stops when the squared error of the validation rows (a share picked by the
hash of the key) has not fallen for ``patience`` rounds; the trees up to its lowest
point are the model.

Defined cases: NULL labels and features must be settled before (``ml.training_frame``);
rows repeated whole draw alike; constant features are never split; without
any gain the model is the mean; an empty frame is an error.
"""

from __future__ import annotations

import collections
import dataclasses
import itertools
import json
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import remove_path, scratch_path

BLOCK = 16_384
KEEP = 4
MOST_KEPT = 64
NODE_CHUNK = 32
WEIGHT_STEP = 1 << 16
MAX_DRAW = 64  # an exponential draw of 64-bit hashes stays below
#: bytes of raw values that are sorted at a time, and of a round's sums that one task takes
SORT_BYTES = 1 << 24
LOCAL_BYTES = 1 << 25
#: blocks of an Arrow batch, and records of runs, which end at so many; runs that histograms count at a time
BATCH_BLOCKS, BATCH_BYTES = 8, 1 << 25
RECORD_RUNS = 1 << 16
COUNT_RUNS = 1 << 17
#: a block has training rows only or validation rows only
SCHEMA = "valid boolean, n long, runs long, bins binary, size binary, s1 binary, s2 binary, y binary, key binary, score binary"
#: a round's draws per run are the columns w and wy with the place of the round
DRAWN = ["valid", "n", "runs", "bins", "size", "s1", "s2", "score"]
MOST_DRAWN = 16
SUMS = "runs long, bins binary, g binary, h binary, n long, se double, valid_n long, valid_se double"
PART = "feature int, chunk int, gh binary, gl binary, h binary"
#: sums of gradients are kept as high * 2^LOW_BITS + low
LOW_BITS = 26


@dataclasses.dataclass(frozen=True)
class Settings:
    rounds: int = 1350
    depth: int = 8
    eta: float = 0.05
    subsample: float = 1.0
    colsample: float = 1.0
    min_child: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    bins: int = 256
    symmetric: bool = False
    bayesian: bool = False
    seed: int = 42
    valid_share: float = 0.1
    patience: int = 10


# ---------------------------------------------------------------- draws
def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """A number in (0, 1) per key, the same wherever the row is."""
    with np.errstate(over="ignore"):
        salt = mix64(np.array([seed * 1_000_003 + stream + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        u = mix64(key.view(np.uint64) ^ salt[0])
    return ((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def weights(key: np.ndarray, s: Settings, round_: int) -> np.ndarray:
    """Whole-number weights (steps of 1 / WEIGHT_STEP) of the rows in one round."""
    if s.bayesian:
        return np.rint(-np.log(uniform(key, s.seed, round_)) * WEIGHT_STEP).astype(np.int64)
    if s.subsample < 1:
        return np.where(uniform(key, s.seed, round_) < s.subsample, WEIGHT_STEP, 0)
    return np.full(len(key), WEIGHT_STEP, dtype=np.int64)


def tree_features(n: int, s: Settings, round_: int) -> list[int]:
    if s.colsample >= 1:
        return list(range(n))
    return sorted(np.random.default_rng([s.seed, round_]).choice(n, max(1, int(s.colsample * n)), replace=False).tolist())


# ---------------------------------------------------------------- trees
@dataclasses.dataclass
class Tree:
    """A complete tree in heap order: rows with bin > ``bins[node]`` go right. ``values`` are its leaves.
    Nodes that were not split send every row left."""

    features: list
    bins: list
    values: list

    def levels(self):
        return int(math.log2(len(self.features) + 1))


def descend(tree: Tree, x: np.ndarray, levels: int, first: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Node at depth ``levels`` of every column of ``x`` (features x rows, in bins or raw with bins as
    thresholds), from their nodes ``at`` at depth ``first``."""
    n, x = x.shape[1], np.ascontiguousarray(x)
    at = np.zeros(n, dtype=np.int64) if at is None else at.copy()
    features, cuts, rows = np.asarray(tree.features, dtype=np.int64), np.asarray(tree.bins), None
    for d in range(first, levels):
        level = slice((1 << d) - 1, (2 << d) - 1)
        f, c = features[level], cuts[level]
        if (f == f[0]).all() and (c == c[0]).all():  # one question for all nodes
            right = x[f[0]] > c[0]
        else:
            rows = np.arange(n) if rows is None else rows
            place = (f * n).take(at)
            place += rows
            right = x.ravel().take(place) > c.take(at)
        at += at
        at += right
    return at


@dataclasses.dataclass
class Stack:
    """Trees of one depth as arrays (trees x nodes, trees x leaves)."""

    features: np.ndarray
    bins: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, trees: list) -> "Stack":
        return cls(np.array([t.features for t in trees], dtype=np.int32), np.array([t.bins for t in trees], dtype=np.int16),
                   np.array([t.values for t in trees], dtype=np.float64))

    def tree(self, i: int) -> Tree:
        return Tree(self.features[i], self.bins[i], self.values[i])

    def add(self, out: np.ndarray, x: np.ndarray) -> None:
        """Add the values of every tree for the bins ``x`` (features x rows); few rows: many trees at a time."""
        n, (count, nodes) = x.shape[1], self.features.shape
        levels = int(math.log2(nodes + 1))
        at_once = STACK_CELLS // max(n, 1)
        if at_once < 2:
            for i in range(count):
                out += self.values[i].take(descend(self.tree(i), x, levels))
            return
        flat, rows = np.ascontiguousarray(x).ravel(), np.arange(n)
        for lo in range(0, count, at_once):
            f, c, v = (a[lo:lo + at_once] for a in (self.features, self.bins, self.values))
            start, c, v = (f.astype(np.int64) * n).ravel(), c.ravel(), np.ascontiguousarray(v)
            tree = np.arange(len(f))[:, None]
            at = np.zeros((len(f), n), dtype=np.int64)
            for d in range(levels):
                heap = at + (tree * nodes + ((1 << d) - 1))
                right = flat.take(start.take(heap) + rows) > c.take(heap)
                at += at
                at += right
            out += v.ravel().take(at + tree * v.shape[1]).sum(axis=0)


#: tree nodes that ``Stack.add`` looks at in one step
STACK_CELLS = 1 << 14


def stacked(trees: list) -> list[Stack]:
    return [Stack.of(list(some)) for _, some in itertools.groupby(trees, lambda t: len(t.features))]


def scores(stacks: list[Stack], x: np.ndarray, base: float = 0.0) -> np.ndarray:
    """``base`` and the sums of the trees' values for bins."""
    out = np.full(x.shape[1], base)
    for stack in stacks:
        stack.add(out, x)
    return out


def to_bins(x: np.ndarray, edges: list) -> np.ndarray:
    """Bins (features x rows) of raw values (rows x features); NaN exceeds no edge."""
    out = np.empty((len(edges), len(x)), dtype=np.uint8)
    for j, e in enumerate(edges):
        out[j] = np.searchsorted(e, x[:, j], side="left")
        if np.isnan(x[:, j]).any():
            out[j][np.isnan(x[:, j])] = 0
    return out


def run_starts(bins: np.ndarray) -> np.ndarray:
    """Places at which a column differs from the one before."""
    new = np.ones(bins.shape[1], dtype=bool)
    new[1:] = (bins[:, 1:] != bins[:, :-1]).any(axis=0)
    return np.flatnonzero(new)


def per_run(bins: np.ndarray, values) -> np.ndarray:
    """``values(bins)``, worked out once for neighbours of equal bins."""
    n, starts = bins.shape[1], run_starts(bins)
    if len(starts) > 0.8 * n:
        return values(bins)
    return np.repeat(values(np.ascontiguousarray(bins[:, starts])), np.diff(starts, append=n))


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """An Arrow array of lists of ``width`` numbers as rows x ``width``."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def shrink(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def strength(g, h, s: Settings):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + s.l2 > 0, shrink(g, s.l1) ** 2 / (h + s.l2), 0.0)


def leaf(g: float, h: float, s: Settings) -> float:
    return float(-shrink(g, s.l1) / (h + s.l2)) * s.eta if h + s.l2 > 0 else 0.0


def best_splits(sums: tuple, unit: float, s: Settings) -> list[tuple]:
    """(node, gain, bin, left g, left h, g, h) of one feature from the whole-number sums (high and low part of
    g, h; each nodes x bins); with ``symmetric`` one row with the sums of every node as lists."""
    high, low, hl = (np.cumsum(a.reshape(-1, s.bins), axis=1) for a in sums)
    gl = high.astype(np.float64) * 2.0 ** LOW_BITS + low  # exact but for one rounding
    gt, ht = gl[:, -1:], hl[:, -1:]
    real_g, real_h = (lambda x: x * unit), (lambda x: x / WEIGHT_STEP)
    left, right = real_h(hl), real_h(ht - hl)
    gain = (strength(real_g(gl), left, s) + strength(real_g(gt - gl), right, s)
            - strength(real_g(gt), real_h(ht), s))
    if s.symmetric:
        total = gain.sum(axis=0)
        total[((hl == 0) | (hl == ht)).all(axis=0)] = -1.0
        b = int(np.argmax(total))
        return [(0, float(total[b]), b, gl[:, b].tolist(), hl[:, b].tolist(), gt[:, 0].tolist(), ht[:, 0].tolist())]
    gain[(left < s.min_child) | (right < s.min_child) | (hl == 0) | (hl == ht)] = -1.0
    best = np.argmax(gain, axis=1)
    return [(i, float(gain[i, b]), int(b), [float(gl[i, b])], [int(hl[i, b])], [float(gt[i, 0])], [int(ht[i, 0])])
            for i, b in enumerate(best.tolist()) if ht[i, 0] > 0]


# ---------------------------------------------------------------- bins and blocks
def bin_edges(rows: DataFrame, n: int, bins: int) -> list[list[float]]:
    """Upper edges of all bins but the last: every value but the largest where there are at most
    ``bins`` of them, quantiles otherwise."""
    def distinct(batches):
        seen = [np.zeros(0)] * n  # None: more than ``bins`` values
        for batch in batches:
            x = matrix(batch.column(0), n)
            for i, old in enumerate(seen):
                if old is not None:
                    new = np.unique(np.concatenate((old, np.unique(x[:, i]))))
                    seen[i] = new if len(new) <= bins else None
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array(range(n), pa.int32()), "over": pa.array([v is None for v in seen]),
             "values": pa.array([[] if v is None else v for v in seen], pa.list_(pa.float64()))})

    values = [F.col("features")[i] for i in range(n)]
    few = (rows.select("features").mapInArrow(distinct, "feature int, over boolean, values array<double>")
           .select("feature", "over", F.explode_outer("values").alias("v")).distinct()
           .groupBy("feature").agg(F.max("over").alias("over"), F.slice(F.sort_array(F.collect_list("v")), 1, bins + 1).alias("v"))
           .where(~F.col("over") & (F.size("v") <= bins)).collect())  # ``bins`` values each at most
    found = {r.feature: list(r.v) for r in few}
    many = [i for i in range(n) if i not in found]
    if many:
        probs = [k / bins for k in range(1, bins)]
        at = rows.agg(*[F.percentile_approx(values[i], probs, 10_000) for i in many],
                      *[F.max(values[i]) for i in many]).first()
        for k, i in enumerate(many):
            found[i] = [*sorted(set(at[k]) - {at[len(many) + k]}), math.inf]
    return [[float(v) for v in found[i][:-1]] for i in range(n)]


def write_blocks(rows: DataFrame, edges: list[list[float]], s: Settings, path: str, base: float = 0.0) -> None:
    """(key, label, features) rows as blocks of bins; repeated keys are rows of their own. ``s1`` and ``s2``
    are the sums of (label - ``base``) and of its square per run."""
    bounds = [np.array(e) for e in edges]
    block, most = BLOCK, max(BLOCK, SORT_BYTES // (8 * max(1, len(edges))))

    def blocks(bins, y, key):
        valid = uniform(key, s.seed, -1) < s.valid_share
        order = np.lexsort((*bins[::-1], valid))
        ends = [0, len(order) - int(valid.sum()), len(order)]
        for side in (0, 1):
            for lo in range(ends[side], ends[side + 1], block):
                some = order[lo:min(lo + block, ends[side + 1])]
                part = bins[:, some]
                starts, off = run_starts(part), y[some] - base
                yield pa.RecordBatch.from_pydict(
                    {"valid": pa.array([bool(side)]), "n": pa.array([len(some)], pa.int64()),
                     "runs": pa.array([len(starts)], pa.int64()), "bins": [part[:, starts].tobytes()],
                     "size": [np.diff(starts, append=len(some)).astype(np.int32).tobytes()],
                     "s1": [np.add.reduceat(off, starts).tobytes()], "s2": [np.add.reduceat(off ** 2, starts).tobytes()],
                     "y": [y[some].tobytes()], "key": [key[some].tobytes()], "score": [np.zeros(len(starts)).tobytes()]})

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                x = matrix(part.column(2), len(bounds))
                bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(bounds)]).astype(np.uint8)
                held.append((bins, part.column(1).to_numpy(zero_copy_only=False).astype(np.float64),
                             part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
                n += part.num_rows
                if n >= most:
                    yield from blocks(*(np.concatenate(c, axis=-1) for c in zip(*held)))
                    held, n = [], 0
        if n:
            yield from blocks(*(np.concatenate(c, axis=-1) for c in zip(*held)))

    _written(rows.select("key", "label", "features").mapInArrow(pack, SCHEMA), path)


def _written(blocks: DataFrame, path: str) -> None:
    """Small row groups, so that readers can share out the blocks of a large file."""
    (blocks.write.option("parquet.block.size", 4 << 20).option("parquet.block.size.row.check.min", 4)
     .option("parquet.block.size.row.check.max", 4).parquet(path))


def unpack(row: dict, n_features: int):
    """(bins per run, rows per run, labels, keys) of a block."""
    return (np.frombuffer(row["bins"], np.uint8).reshape(n_features, row["runs"]), np.frombuffer(row["size"], np.int32),
            np.frombuffer(row["y"]), np.frombuffer(row["key"], np.int64))


# ---------------------------------------------------------------- one round
def _drawing(base: float, unit: float, n_features: int, first: int, rounds: int, s: Settings):
    """Blocks to their runs with the draws of ``rounds`` rounds: sums of weights (w) and of weights times label (wy),
    in whole numbers. They do not depend on any tree, so several rounds share one reading of the rows."""
    names = ["bins", "size", "s1", "s2", "score", *(f"{c}{k}" for k in range(rounds) for c in ("w", "wy"))]

    def record(side, parts):
        cols = [np.concatenate(c, axis=-1) for c in zip(*parts)] + [np.zeros(0)] * (2 * rounds * side)
        return pa.RecordBatch.from_pydict(
            {"valid": pa.array([side]), "n": pa.array([int(cols[1].sum())], pa.int64()),
             "runs": pa.array([len(cols[1])], pa.int64()), **dict(zip(names, ([c.tobytes()] for c in cols)))})

    def run(batches):
        held = {False: [], True: []}
        for batch in batches:
            for row in batch.to_pylist():
                bins, size, y, key = unpack(row, n_features)
                part = [bins, size, *(np.frombuffer(row[c]) for c in ("s1", "s2", "score"))]
                if not row["valid"]:
                    label = np.rint((y - base) / unit).astype(np.int64)
                    starts = np.cumsum(size) - size if len(size) < len(y) else None
                    for k in range(rounds):
                        w = weights(key, s, first + k)
                        part += (w, w * label) if starts is None else (
                            np.add.reduceat(w, starts), np.add.reduceat(w * label, starts))
                held[row["valid"]].append(part)
            for side, parts in held.items():
                if sum(len(p[1]) for p in parts) >= RECORD_RUNS:
                    yield record(side, parts)
                    held[side] = []
        for side, parts in held.items():
            if parts:
                yield record(side, parts)
    return run


def _draw(blocks: DataFrame, *how) -> DataFrame:
    rounds = how[-2]
    return blocks.mapInArrow(_drawing(*how), "valid boolean, n long, runs long, bins binary, size binary, s1 binary, s2 binary, "
                             "score binary, " + ", ".join(f"w{k} binary, wy{k} binary" for k in range(rounds)))


def _level(blocks: DataFrame, recent: list, base: float, unit: float, n_features: int, round_: int, s: Settings,
           at: int | None = None) -> DataFrame:
    """What the levels of a round read: whole-number sums of weighted gradients and of weights per run,
    and the error sums so far. The only walk of older trees. ``blocks`` are runs with draws, this round's at
    place ``at``, or the blocks of rows."""
    older = stacked(recent)
    drawing = None if at is not None else _drawing(base, unit, n_features, round_, 1, s)
    w, wy = f"w{at or 0}", f"wy{at or 0}"

    def add_up(batches):
        for batch in drawing(batches) if drawing else batches:
            for row in batch.to_pylist():
                bins, size = np.frombuffer(row["bins"], np.uint8).reshape(n_features, -1), np.frombuffer(row["size"], np.int32)
                over = np.frombuffer(row["score"]) + scores(older, bins)  # the mean, which the labels leave out too
                error = float((size * over ** 2 - 2 * over * np.frombuffer(row["s1"]) + np.frombuffer(row["s2"])).sum())
                none = row["valid"]
                h = np.zeros(0, np.int64) if none else np.frombuffer(row[w], np.int64)
                g = h if none else np.rint(over / unit).astype(np.int64) * h - np.frombuffer(row[wy], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"runs": pa.array([len(g)], pa.int64()), "bins": [b"" if none else row["bins"]], "g": [g.tobytes()],
                     "h": [h.tobytes()], "n": pa.array([0 if none else row["n"]], pa.int64()), "se": [0.0 if none else error],
                     "valid_n": pa.array([row["n"] if none else 0], pa.int64()), "valid_se": [error if none else 0.0]})

    return (blocks if drawing else blocks.select(*DRAWN, w, wy)).mapInArrow(add_up, SUMS)


def _runs(batch: pa.RecordBatch, n_features: int):
    """(bins, g, h) of the records of ``_level``."""
    cols = [batch.column(batch.schema.get_field_index(c)) for c in ("runs", "bins", "g", "h")]
    for n, bins, g, h in zip(*cols):
        if n.as_py():
            yield (np.frombuffer(bins.as_buffer(), np.uint8).reshape(n_features, -1),
                   np.frombuffer(g.as_buffer(), np.int64), np.frombuffer(h.as_buffer(), np.int64))


def add_histograms(sums: dict, x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, width: int) -> None:
    """Add (g in two parts, h) of the runs per (node, bin) to ``sums`` of each feature. Doubles hold the sums of
    COUNT_RUNS parts exactly."""
    for lo in range(0, len(g), COUNT_RUNS):
        some = slice(lo, lo + COUNT_RUNS)
        cell0, parts = at[some] * width, [g[some] >> LOW_BITS, g[some] & ((1 << LOW_BITS) - 1), h[some]]
        if np.abs(g[some]).sum(dtype=np.float64) < 2.0 ** 52:  # in one go
            parts[:2] = None, g[some]
        parts = [None if p is None else p.astype(np.float64) for p in parts]
        for j, to in sums.items():
            cell = cell0 + x[j, some]
            for total, part in zip(to, parts):
                if part is not None:
                    total += np.bincount(cell, part, len(total)).astype(np.int64)


def _open_runs(x, g, h, at, open_):
    if open_.all():
        return x, g, h, at
    use = open_[at]
    return x[:, use], g[use], h[use], at[use]


def _empty(cols, nodes: int, width: int) -> dict:
    return {j: tuple(np.zeros(nodes * width, np.int64) for _ in range(3)) for j in cols}


Split = collections.namedtuple("Split", "feature node gain bin gl hl gt ht")


def _grow_at_once(sums: DataFrame, n_features: int, unit: float, s: Settings, round_: int):
    """(tree, gains per feature, error sums) of a round, the whole tree by one task."""
    def run(batches):
        parts, errors = [], []
        for batch in batches:
            parts += _runs(batch, n_features)
            errors += [tuple(r.values()) for r in batch.select(["n", "se", "valid_n", "valid_se"]).to_pylist()]
        x, g, h = (np.concatenate(c, axis=-1) for c in zip(*parts)) if parts else (
            np.zeros((n_features, 0), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        live, at = x, np.zeros(len(g), dtype=np.int64)

        def level_rows(partial, level, open_, cols):
            nonlocal live, g, h, at
            at = descend(partial, live, level, max(level - 1, 0), at)
            live, g, h, at = _open_runs(live, g, h, at, open_)
            histograms = _empty(cols, 1 << level, s.bins)
            add_histograms(histograms, live, g, h, at, s.bins)
            return [Split(j, *r) for j, found in histograms.items() for r in best_splits(found, unit, s)]
        gains = np.zeros(n_features)
        tree = _grow(level_rows, n_features, s, round_, gains, unit)
        yield pa.RecordBatch.from_pydict({"found": [pickle.dumps((tree, gains, _total(errors)))]})

    # collected, not ``first()``: a task that is cut short costs its Python worker
    return pickle.loads(sums.repartition(1).mapInArrow(run, "found binary").collect()[0][0])


def _total(errors: list) -> tuple:
    """(rows, squared error, validation rows, their squared error), whatever the order."""
    return tuple(math.fsum(c) for c in zip(*errors)) or (0, 0.0, 0, 0.0)


def _best(sums: DataFrame, partial: Tree, level: int, open_: np.ndarray, cols: list[int], n_features: int, unit: float,
          s: Settings) -> list:
    """Best splits of the level's open nodes, by one job."""
    nodes, width = 1 << level, s.bins
    step_ = nodes if s.symmetric else NODE_CHUNK

    def add_up(batches):
        histograms = _empty(cols, nodes, width)
        for batch in batches:
            for x, g, h in _runs(batch, n_features):
                for lo in range(0, len(g), COUNT_RUNS):  # pieces that stay in the cache
                    some = slice(lo, lo + COUNT_RUNS)
                    piece = np.ascontiguousarray(x[:, some])
                    at = descend(partial, piece, level)
                    add_histograms(histograms, *_open_runs(piece, g[some], h[some], at, open_), width)
        out = {c: [] for c in ("feature", "chunk", "gh", "gl", "h")}
        for j in cols:
            for lo in range(0, nodes, step_):
                part = [a[lo * width:(lo + step_) * width] for a in histograms[j]]
                if part[2].any():
                    for c, v in zip(out, (j, lo, *(a.tobytes() for a in part))):
                        out[c].append(v)
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], names=list(out))

    def choose(parts: pd.DataFrame) -> pd.DataFrame:
        sums = tuple(sum(np.frombuffer(b, np.int64) for b in parts[c]) for c in ("gh", "gl", "h"))
        lo, j = int(parts["chunk"].iloc[0]), int(parts["feature"].iloc[0])
        return pd.DataFrame([(j, lo + node, *rest) for node, *rest in best_splits(sums, unit, s)], columns=Split._fields)

    schema = ("feature int, node int, gain double, bin int, gl array<double>, hl array<long>, gt array<double>, "
              "ht array<long>")
    return (sums.select("runs", "bins", "g", "h").mapInArrow(add_up, PART).groupBy("feature", "chunk")
            .applyInPandas(choose, schema).collect())  # features x nodes rows at most


def _grow(level_rows, n_features: int, s: Settings, round_: int, importance: np.ndarray, unit: float) -> Tree:
    """One tree; ``level_rows(partial, level, open, features)`` finds the best splits of a level."""
    cols = tree_features(n_features, s, round_)
    features, cuts = [], []
    sums, open_ = {0: None}, np.ones(1, dtype=bool)
    for level in range(s.depth):
        rows = level_rows(Tree(features, cuts, []), level, open_, cols) if open_.any() else []
        best = {}
        for r in sorted(rows, key=lambda r: (-r.gain, r.feature, r.bin)):
            best.setdefault(r.node, r)
        if level == 0 and best:
            sums[0] = (best[0].gt[0], best[0].ht[0])
        f, b, nxt = [0] * (1 << level), [s.bins] * (1 << level), {}
        next_open = np.zeros(2 << level, dtype=bool)
        for node in range(1 << level):
            r = best.get(0 if s.symmetric else node)
            i = node if s.symmetric else 0
            if r is not None and r.gain > 0 and open_[node]:
                f[node], b[node] = r.feature, r.bin
                importance[r.feature] += r.gain / (len(r.gt) if s.symmetric else 1)
                nxt[2 * node] = (r.gl[i], r.hl[i])
                nxt[2 * node + 1] = (r.gt[i] - r.gl[i], r.ht[i] - r.hl[i])
                next_open[2 * node:2 * node + 2] = True
            else:
                nxt[2 * node], nxt[2 * node + 1] = sums.get(node), (0, 0)
        features, cuts, sums, open_ = features + f, cuts + b, nxt, next_open
    values = [leaf(x[0] * unit, x[1] / WEIGHT_STEP, s) if x else 0.0 for _, x in sorted(sums.items())]
    return Tree(features, cuts, values)


class BoostedModel:
    """Trees with thresholds on the raw values. ``transform`` adds the prediction column."""

    def __init__(self, name, settings, base, edges, trees, importance, history):
        self.name, self.settings, self.base = name, settings, base
        self.edges, self.trees, self.importance, self.history = edges, trees, importance, history

    @property
    def trees_trained(self) -> int:
        return len(self.trees)

    @property
    def feature_importances(self) -> list[float]:
        total = sum(self.importance)
        return [x / total if total else 0.0 for x in self.importance]

    def raw_trees(self) -> list[Tree]:
        def cut(f, b):
            return self.edges[f][b] if b < len(self.edges[f]) else math.inf
        return [Tree(t.features, [cut(f, b) for f, b in zip(t.features, t.bins)], t.values) for t in self.trees]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of raw rows (rows x features)."""
        return scores(stacked(self.trees), to_bins(x, [np.asarray(e) for e in self.edges]), self.base)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        array = vector_to_array(F.col(features)) if dict(df.dtypes)[features] == "vector" else F.col(features)
        edges, base, stacks = [np.asarray(e) for e in self.edges], self.base, stacked(self.trees)

        @F.arrow_udf("double")
        def apply(x: pa.Array) -> pa.Array:
            bins = to_bins(matrix(x, len(edges)), edges)
            return pa.array(per_run(bins, lambda b: scores(stacks, b, base)), pa.float64())

        return df.withColumn(self.name, apply(array))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "settings": dataclasses.asdict(self.settings), "base": self.base,
                           "edges": self.edges, "trees": [dataclasses.astuple(t) for t in self.trees],
                           "importance": list(self.importance), "history": self.history})

    @classmethod
    def from_json(cls, text: str) -> "BoostedModel":
        d = json.loads(text)
        return cls(d["name"], Settings(**d["settings"]), d["base"], d["edges"], [Tree(*t) for t in d["trees"]],
                   d["importance"], d["history"])


def step(spread: float, s: Settings) -> float:
    """Size of one unit of scores and labels: the weighted gradients of a block stay exact in 64 bits."""
    bits = 62 - math.ceil(math.log2(WEIGHT_STEP * (MAX_DRAW if s.bayesian else 1))) - math.ceil(math.log2(BLOCK))
    return 2.0 ** (math.ceil(math.log2(max(spread, 1e-300) * 4)) - bits)


def _session(spark, n_features: int, s: Settings):
    """For the jobs of the levels; settings of the given session that matter to them are taken over."""
    jobs = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.session.timeZone"):
        jobs.conf.set(name, spark.conf.get(name))
    groups = n_features * (1 if s.symmetric else max(1, (1 << (s.depth - 1)) // NODE_CHUNK))
    jobs.conf.set("spark.sql.adaptive.enabled", "false")
    jobs.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch",
                  str(max(1, min(BATCH_BLOCKS, BATCH_BYTES // (BLOCK * (n_features + 16))))))
    jobs.conf.set("spark.sql.shuffle.partitions", str(min(groups, 2 * spark.sparkContext.defaultParallelism)))
    return jobs


def train(df: DataFrame, name: str, s: Settings, key: str = "row_key", label: str = "label",
          features: str = "features") -> BoostedModel:
    """Fit on (key, label, features); ``key`` is a long that tells rows apart, ``features`` a vector or array."""
    spark = df.sparkSession
    array = vector_to_array(F.col(features)) if dict(df.dtypes)[features] == "vector" else F.col(features)
    rows = df.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), array.alias("features"))
    n, mean, low, high, width = rows.agg(F.count(F.lit(1)), F.avg("label"), F.min("label"), F.max("label"),
                                         F.max(F.size("features"))).first()
    if not n:
        raise ValueError("no training rows")
    if s.bins > 256:
        raise ValueError("a bin is one byte: at most 256 bins")
    base = float(f"{mean:.12g}")
    unit = step(max(high - base, base - low), s)
    edges = bin_edges(rows, width, s.bins)
    path = scratch_path(spark, f"boost-{name}")
    write_blocks(rows, edges, s, path, base)
    jobs = _session(spark, width, s)
    blocks = jobs.read.schema(SCHEMA).parquet(path)
    runs, held, n_train = blocks.agg(F.sum("runs"), F.sum(F.when(~F.col("valid"), F.col("runs"))), F.sum("n")).first()
    small = (held or 0) * (width + 16) <= LOCAL_BYTES
    keep = max(KEEP, min(MOST_KEPT, int(KEEP * math.sqrt(n_train / runs))))
    # runs with their draws, 16 bytes a round, are kept for as many rounds as they are no larger than the rows
    draw_rounds = max(1, min(MOST_DRAWN, n_train // runs))
    drawn, drawn_at = None, 0
    trees, kept, history = [], 0, []
    importance = np.zeros(width)
    gains = [importance.copy()]
    for round_ in range(s.rounds + 1):
        last = round_ == s.rounds
        renew = draw_rounds > 1 and (drawn is None or round_ - drawn_at == draw_rounds)
        if renew and drawn is not None:
            drawn.unpersist()
        if len(trees) - kept >= keep and (renew or draw_rounds == 1):  # nothing persisted reads the older copy
            older, path = path, scratch_path(spark, f"boost-{name}")
            _written(_add_scores(blocks, trees[kept:], width), path)
            blocks, kept = jobs.read.schema(SCHEMA).parquet(path), len(trees)
            remove_path(spark, older)
        if renew:
            drawn, drawn_at = _draw(blocks, base, unit, width, round_, draw_rounds, s).persist(), round_
        if drawn is None:
            sums = _level(blocks, trees[kept:], base, unit, width, round_, s)
        else:
            sums = _level(drawn, trees[kept:], base, unit, width, round_, s, round_ - drawn_at)
        errors = ("n", "se", "valid_n", "valid_se")
        if last:  # only the error of the finished model is still to be known
            total = _total(sums.select(*errors).collect())
        elif small:
            tree, gain, total = _grow_at_once(sums, width, unit / WEIGHT_STEP, s, round_)
            importance += gain
        else:
            sums = sums.persist()
            tree = _grow(lambda *level: _best(sums, *level, width, unit / WEIGHT_STEP, s), width, s, round_,
                         importance, unit / WEIGHT_STEP)
            total = _total(sums.select(*errors).collect())  # a few numbers per BATCH_BLOCKS blocks
            sums.unpersist()
        count, error, vc, ve = total
        history.append([error / count if count else 0.0, ve / vc if vc else 0.0])
        best = min(range(len(history)), key=lambda i: history[i][1]) if vc else round_
        if last or (vc and round_ - best >= s.patience):
            break
        trees.append(tree)
        gains.append(importance.copy())
    if drawn is not None:
        drawn.unpersist()
    remove_path(spark, path)
    return BoostedModel(name, s, base, edges, trees[:best], gains[best].tolist(), history)


def _add_scores(blocks: DataFrame, trees: list, n_features: int) -> DataFrame:
    stacks = stacked(trees)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["score"] = (np.frombuffer(row["score"]) + scores(stacks, unpack(row, n_features)[0])).tobytes()
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)
    return blocks.mapInArrow(run, SCHEMA)
