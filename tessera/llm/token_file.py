"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 payload bits: selector s packs
``COUNTS[s]`` ids of 60 // count bits each. An id of more than 60 bits is an
escape: selector 0 holds its index in the payload's escape list. Ids are coded
in sub-blocks of ``SUB_BLOCK`` ids, each starting at a whole word whose offset
is stored, so all sub-blocks are encoded in step and decoded at once.

Payload: magic "S8B1", then unsigned 32-bit n_ids, sub_block, n_sub, n_words,
n_escapes, the n_sub + 1 word offsets, then the 64-bit words and the escapes
(little-endian). A file is a table of payloads (one row per run of whole
documents) written by Spark, so it works on any store and a lost task is
written again: (part, block, start, doc_ids, lens, payload), where ``start`` is
the number of ids before the block in its part. Parts are ranges of the
identifier in ascending order.

Defined cases: NULL and empty texts hold the end id only; very long texts make
one large block; NULL identifiers come first; rows repeated whole follow each
other; an empty table gives files without rows. Only (identifier, text) enter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder
from tessera.llm.common import bounds, strings, text_slices
from tessera.llm.packing import running_base

MAGIC = b"S8B1"
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
SUB_BLOCK = 256
BLOCK_IDS = 1 << 16


def _widths(values: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), values, side="right").astype(np.int8)


#: widths of all ids of at most 16 bits
WIDTH_16 = _widths(np.arange(1 << 16, dtype=np.uint64))


def encode(values: np.ndarray, sub_block: int = SUB_BLOCK) -> bytes:
    """Payload of the ids."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    n_sub = -(-n // sub_block)
    size = np.full(n_sub, sub_block)
    if n_sub:
        size[-1] = n - sub_block * (n_sub - 1)
    stride = sub_block + 60
    lanes = np.zeros((n_sub, stride), dtype=np.uint64)
    padded = np.zeros(n_sub * sub_block, dtype=np.uint64)
    padded[:n] = values
    lanes[:, :sub_block] = padded.reshape(n_sub, sub_block)
    small = n and int(values.max()) < len(WIDTH_16)
    width = np.ones(lanes.shape, dtype=np.int8)
    width[:, :sub_block] = (WIDTH_16[padded] if small else _widths(padded)).reshape(n_sub, sub_block)
    pick = np.zeros((n_sub, sub_block), dtype=np.int8)  # 0: escape
    widest = {1: width}
    for s in range(len(COUNTS) - 1, 0, -1):  # the last hit, with the largest count, stays
        c = int(COUNTS[s])
        if c > 1:  # widest of the next c ids, from two shorter runs
            b = max(widest)  # at least half of c: the counts at most double
            widest[c] = np.maximum(widest[b][:, :widest[b].shape[1] - (c - b)], widest[b][:, c - b:])
        fits = widest[c][:, :sub_block] <= BITS[s]
        if c > 1 and not fits.any():
            break  # a longer run holds this one and has fewer bits an id
        np.copyto(pick, np.int8(s), where=fits)
    pos, lane = np.zeros(n_sub, dtype=np.int64), np.arange(n_sub)
    steps = []
    while len(lane):
        sel = pick[lane, pos[lane]].astype(np.int64)
        steps.append((lane, pos[lane], sel))
        pos[lane] += COUNTS[sel]
        lane = lane[pos[lane] < size[lane]]
    if steps:
        at, start, sel = (np.concatenate([s[k] for s in steps]) for k in range(3))
        order = np.argsort(at * stride + start)
        at, start, sel = at[order], start[order], sel[order]
    else:
        at = start = sel = np.zeros(0, dtype=np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    escapes = np.zeros(0, dtype=np.uint64)
    first, flat = at * stride + start, lanes.ravel()
    for s in np.unique(sel).tolist():
        own = np.flatnonzero(sel == s)
        if s == 0:
            escapes = flat[first[own]]
            words[own] |= np.arange(len(own), dtype=np.uint64)
            continue
        from_, packed = first[own], words[own]
        for k in range(COUNTS[s]):
            packed |= flat[from_ + k] << np.uint64(k * BITS[s])
        words[own] = packed
    offsets = np.searchsorted(at, np.arange(n_sub + 1)).astype("<u4")
    head = np.array([n, sub_block, n_sub, len(words), len(escapes)], dtype="<u4")
    return MAGIC + head.tobytes() + offsets.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode(payload: bytes) -> np.ndarray:
    """Ids of a payload, all sub-blocks at once."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, sub_block, n_sub, n_words, n_escapes = np.frombuffer(payload, "<u4", 5, 4)
    at = 24
    offsets = np.frombuffer(payload, "<u4", n_sub + 1, at).astype(np.int64)
    at += 4 * (int(n_sub) + 1)
    words = np.frombuffer(payload, "<u8", n_words, at)
    escapes = np.frombuffer(payload, "<u8", n_escapes, at + 8 * int(n_words))
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    ends = bounds(counts)
    block = np.repeat(np.arange(n_sub), np.diff(offsets))
    start = ends[:-1] - ends[offsets[block]] + block * int(sub_block)
    limit = np.minimum((block + 1) * int(sub_block), n)
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(sel):
        own = sel == s
        if s == 0:
            low = words[own] & ((np.uint64(1) << np.uint64(60)) - np.uint64(1))
            out[start[own]] = escapes[low.astype(np.int64)]
            continue
        mask = (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
        w, first, last = words[own], start[own], limit[own]
        for k in range(COUNTS[s]):
            ok = first + k < last
            out[first[ok] + k] = (w[ok] >> np.uint64(k * BITS[s])) & mask
    return out


def write_ids(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end_id`` and write the files in ascending identifier order."""
    id_type = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        enc = encoder(tokenizer)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        names = ["part", "block", "start", "doc_ids", "lens", "payload"]
        for batch in batches:
            for piece in text_slices(batch, "text", 16 << 20):
                ids, at = enc.encode(strings(piece, "text"))
                lens = np.diff(at) + 1
                ids = np.insert(ids, at[1:], end_id)
                ends = bounds(lens)
                lo = 0
                while lo < len(lens):
                    hi = min(len(lens), max(lo + 1, int(np.searchsorted(ends, ends[lo] + block_ids, side="right")) - 1))
                    row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                           pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()),
                                                    piece.column("doc_id").slice(lo, hi - lo)),
                           pa.array([lens[lo:hi].tolist()], pa.list_(pa.int64())),
                           pa.array([encode(ids[ends[lo]:ends[hi]])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names=names)
                    block, start, lo = block + 1, start + int(ends[hi] - ends[lo]), hi

    ordered.mapInArrow(run, f"part int, block int, start long, doc_ids array<{id_type.simpleString()}>, "
                            "lens array<long>, payload binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids before it in all files), n_tokens, ids (32-bit little-endian)."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                payload = batch.column("payload")[i].as_py()
                ids = decode(payload).astype("<u4")
                lens = np.array(batch.column("lens")[i].as_py(), dtype=np.int64)
                at = bounds(lens)
                n = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("part")[i].as_py()), pa.int32()),
                     batch.column("doc_ids")[i].values,
                     pa.array(at[:-1] + batch.column("start")[i].as_py(), pa.int64()), pa.array(lens, pa.int64()),
                     pa.array([ids[at[k]:at[k + 1]].tobytes() for k in range(n)], pa.binary())],
                    names=["part", "doc_id", "before", "n_tokens", "ids"])

    rows = files.mapInArrow(run, f"part int, doc_id {id_type}, before long, n_tokens long, ids binary")
    totals = files.groupBy("part").agg(
        F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base = running_base(totals, "part", "n")
    # bounded: one row per written part
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")
