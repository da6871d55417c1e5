"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to ``n_buckets`` arcs of a ring on which every shard owns
``virtual_nodes`` points. An arc belongs to the first point clockwise; if that
shard has no room left, the arc continues clockwise to the next shard with
room. The capacity is (1 + slack) times the mean load, and the slack doubles
while some arc finds no room, so the balance is guaranteed. Arcs are placed
from the heaviest to the lightest, which is a fixed order of the arcs and so
keeps movement small when a shard is added.

Spark reduces the rows to one (rows, bytes) pair per arc; that histogram has at
most ``n_buckets`` rows whatever the data size, and only it reaches the driver.
The arc map goes back as a broadcast of the same bounded size. Slots are
numbered per arc and shifted by the arc's offset in its shard, so no task sees
more than one arc's rows at a time.

Defined cases: NULL key columns hash like a value; rows repeated whole take
separate slots; sizes below 1 count as 1; an empty table gives no rows; input columns
are kept and clashing output names are refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_BUCKETS = 1 << 16
VIRTUAL_NODES = 64
SLACK = 0.001


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring points in [0, 1) and the shard that owns each."""
    points = sorted((int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") / 2 ** 64, s)
                    for s in range(n_shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in points]), np.array([s for _, s in points])


def place(arcs: np.ndarray, load: np.ndarray, n_shards: int, n_buckets: int = N_BUCKETS,
          virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> np.ndarray:
    """Shard of every arc (bounded loads); ``load`` is what balance is measured in."""
    points, owner = ring(n_shards, virtual_nodes)
    first = np.searchsorted(points, (arcs + 0.5) / n_buckets)
    order = np.lexsort((arcs, -load))
    mean = load.sum() / n_shards
    while True:
        room = np.full(n_shards, mean * (1 + slack))
        out = np.full(len(arcs), -1)
        for a in order:
            need = load[a]
            open_ = room >= need
            if not open_.any():
                break
            start = first[a] % len(points)
            if open_[owner[start]]:
                s = owner[start]
            else:
                turn = np.concatenate((owner[start:], owner[:start]))
                s = turn[np.argmax(open_[turn])]
            out[a] = s
            room[s] -= need
        if (out >= 0).all():
            return out
        slack *= 2


def shard_rows(df: DataFrame, key_cols: list[str], size_col: str, n_shards: int,
               order_cols: list[str] | None = None, n_buckets: int = N_BUCKETS,
               virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless per shard) to every row of ``df``.

    ``df`` is evaluated twice (histogram, assignment): pass a narrow or written table.
    """
    for c in ("shard", "slot"):
        if c.lower() in (x.lower() for x in df.columns):
            raise ValueError(f"the input already has a column {c!r}")
    spark = df.sparkSession
    tail = "_"  # working columns get names that the input has not got
    while any(x.lower().endswith(tail) and x.lower().startswith(("arc", "row", "base")) for x in df.columns):
        tail += "_"
    arc_, row_, base_ = (name + tail for name in ("arc", "row", "base"))
    arc = F.pmod(F.xxhash64(*[F.col(c) for c in key_cols]), F.lit(n_buckets)).cast("int")
    keyed = df.withColumn(arc_, arc)
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(1)), F.lit(1))
    hist = keyed.groupBy(arc_).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("load")) \
        .orderBy(arc_).toPandas()  # at most n_buckets rows
    arcs, rows = hist[arc_].to_numpy(dtype=np.int64), hist["rows"].to_numpy(dtype=np.int64)
    shard = place(arcs, hist["load"].to_numpy(dtype=np.float64), n_shards, n_buckets, virtual_nodes, slack)
    base = np.zeros(len(arcs), dtype=np.int64)
    for s in range(n_shards):
        own = shard == s
        base[own] = np.cumsum(rows[own]) - rows[own]
    table = spark.createDataFrame([(int(a), int(s), int(b)) for a, s, b in zip(arcs, shard, base)],
                                  f"{arc_} int, shard int, {base_} long")
    in_arc = Window.partitionBy(arc_).orderBy(*[F.col(c).asc_nulls_first() for c in (order_cols or key_cols)])
    # bounded: at most n_buckets rows of 16 bytes
    return (keyed.withColumn(row_, F.row_number().over(in_arc))
            .join(F.broadcast(table), arc_)
            .withColumn("slot", F.col(base_) + F.col(row_) - 1)
            .drop(arc_, row_, base_))
