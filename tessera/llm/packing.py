"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

A document longer than the window is cut into full windows and a rest; full
windows are sequences of their own. The rests, and the shorter documents, are
dealt by hash into blocks of about ``block_items`` pieces. In each block the
differencing method starts with one partial partition per piece and keeps
merging the two with the largest spread, the fullest window of one with the
emptiest of the other, until one partition into k near-equal windows is left.
k starts at ceil(tokens / window) and rises whenever a window exceeds the
capacity.

Two Python passes: token counts and ids per document (map only, pieces
written), then the differencing per block on lengths alone. Blocks are bounded, so no task sees
more than one block; the only global step is a running sum over block counts.

Defined cases: NULL and empty texts hold the end token only; very long texts
give many pieces; repeated rows are packed like others; an empty table gives
no pieces. Only (identifier, text) enter, so other columns never clash.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder
from tessera.llm.common import materialise, strings, text_slices

WINDOW = 4096
BLOCK_ITEMS = 2000
END_ID = 2


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of every item: Karmarkar-Karp k-way largest differencing."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    # a partition is (sums, descending, zeros left out); its merge keeps, for each window
    # of the result, the windows of the two partitions that it joined (-1: none)
    heap = [(-int(s), i, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums = {i: np.array([s], dtype=np.int64) for i, s in enumerate(sizes)}
    merges, node = [], n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        x, y = sums.pop(a), sums.pop(b)
        m = min(k, len(x) + len(y))
        left, right = np.full(m, -1), np.full(m, -1)
        total = np.zeros(m, dtype=np.int64)
        total[:len(x)] += x
        left[:len(x)] = np.arange(len(x))
        total[m - len(y):] += y[::-1]
        right[m - len(y):] = np.arange(len(y))[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[node] = total
        merges.append((a, b, left[order], right[order]))
        spread = int(total[0]) - (int(total[-1]) if m == k else 0)
        heapq.heappush(heap, (-spread, node, node))
        node += 1
    at = {heap[0][2]: np.arange(len(sums[heap[0][2]]))}
    out = np.zeros(n, dtype=np.int64)
    for i in range(len(merges) - 1, -1, -1):
        a, b, left, right = merges[i]
        place = at.pop(n + i)
        for child, side in ((a, left), (b, right)):
            used = side >= 0
            where = np.empty(int(used.sum()), dtype=np.int64)
            where[side[used]] = place[used]
            if child < n:
                out[child] = where[0]
            else:
                at[child] = where
    if n == 1:
        out[0] = 0
    return out


def pack_block(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every piece; no window exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        place = differencing(sizes, k)
        if np.bincount(place, weights=sizes, minlength=k).max(initial=0) <= window:
            break
        k += max(1, k // 200)
    used, place = np.unique(place, return_inverse=True)
    order = np.lexsort((np.arange(len(sizes)), place))
    ends = np.cumsum(sizes[order])
    begin = ends - sizes[order]
    first = np.r_[True, place[order][1:] != place[order][:-1]]
    base = np.repeat(begin[first], np.diff(np.append(np.flatnonzero(first), len(sizes))))
    offset = np.empty(len(sizes), dtype=np.int64)
    offset[order] = begin - base
    return place, offset


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, start, length, ids_crc32, doc_tokens (and the ids as bytes)."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        schema += ", ids binary"
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, at = enc.encode(strings(part, "text"))
                row, start, length, crc, total, payload = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), window):
                        cut = own[s:s + window].tobytes()
                        row.append(i)
                        start.append(s)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        total.append(len(own))
                        if with_ids:
                            payload.append(cut)
                cols = [part.column("doc_id").take(pa.array(row, pa.int64())),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(payload, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return narrow.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID, block_items: int = BLOCK_ITEMS,
         with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` (gapless from 0) and ``offset`` in the sequence."""
    cut = materialise(pieces(df, tokenizer, id_col, text_col, window, end_id, with_ids)
                      .withColumn("_piece", F.monotonically_increasing_id()), "pack-pieces")
    full, rest = cut.where(F.col("length") == window), cut.where(F.col("length") < window)
    n_blocks = max(1, -(-rest.count() // block_items))
    block = F.pmod(F.xxhash64("doc_id", "_piece"), F.lit(n_blocks)).cast("int")
    lengths = rest.select(block.alias("block"), "_piece", "length")

    def solve(pdf):
        pdf = pdf.sort_values("_piece")
        place, offset = pack_block(pdf["length"].to_numpy(dtype=np.int64), window)
        return pdf.assign(local=place, offset=offset)[["block", "_piece", "local", "offset"]]

    placed = materialise(lengths.groupBy("block").applyInPandas(
        solve, "block int, _piece long, local long, offset long"), "pack-placed")
    per_block = placed.groupBy(F.col("block").cast("long").alias("block")).agg((F.max("local") + 1).alias("n"))
    base = running_base(per_block, "block", "n")
    used = per_block.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    packed = (cut.join(placed, "_piece").join(base, "block")
              .withColumn("sequence_id", F.col("base") + F.col("local")).drop("block", "base", "local"))
    return packed.unionByName(_number_full(full, used)).drop("_piece")


def running_base(counts: DataFrame, key: str, value: str, group: int = 1024) -> DataFrame:
    """(key, base): sum of ``value`` over all smaller keys, by groups of keys so no task sees all."""
    grouped = counts.withColumn("_g", F.floor(F.col(key) / group))
    inner = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    heads = grouped.groupBy("_g").agg(F.sum(value).alias("_n")).select(
        "_g", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_head"))
    return (grouped.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(heads, "_g")
            .select(key, (F.col("_head") + F.col("_own")).alias("base")))


def _number_full(full: DataFrame, used: int) -> DataFrame:
    """Full windows, numbered after the packed ones: position in their written partition plus its base."""
    keyed = full.withColumn("_part", F.shiftright(F.col("_piece"), 33))
    order = Window.partitionBy("_part").orderBy("_piece")
    base = running_base(keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "_part", "n")
    return (keyed.withColumn("_row", F.row_number().over(order)).join(base, "_part")
            .withColumn("sequence_id", F.lit(used) + F.col("base") + F.col("_row") - 1)
            .withColumn("offset", F.lit(0).cast("long")).drop("_part", "base", "_row"))
