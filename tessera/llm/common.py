"""Shared pieces of the corpus operators: shared-folder tables and text batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can reach, so a lost executor
    costs only its running tasks.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col="text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def one_per_key(df: DataFrame, key: str, same: list[str]) -> DataFrame:
    """One row of every ``key``, with all columns; the columns of ``same`` are equal within a key.

    Of rows that differ in other columns the one whose other columns come first as JSON
    text stays, whatever the partitioning.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in {key, *same}]
    order = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_one")).select("_one.*")


def text_slices(batch: pa.RecordBatch, col: str, max_bytes: int = 8 << 20):
    """Cut a batch into runs of rows with at most ``max_bytes`` of text (one row at least)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    lo, base = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(end, base + max_bytes, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, base = hi, int(end[hi - 1])


def strings(batch: pa.RecordBatch, col: str) -> pa.Array:
    """The text column of a batch as large strings, NULL as empty.

    The values are copied: some Arrow kernels misread slices whose first offset is not 0.
    """
    text = pc.fill_null(batch.column(col).cast(pa.large_string()), "")
    return text.take(pa.array(np.arange(len(text))))


def gather_ranges(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` for all (s, n) without a Python loop."""
    total = int(lens.sum())
    if total == 0:
        return flat[:0]
    first = np.cumsum(lens) - lens
    return flat[np.repeat(starts - first, lens) + np.arange(total)]


def bounds(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=out[1:])
    return out
