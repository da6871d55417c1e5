"""NULL / NaN handling (F7, P3, DQ2).

pandas treats NaN and NULL alike, Spark keeps them apart. Sources are
normalised once (NaN -> NULL); model inputs are zero-filled with ``zero_fill``.
The stored table is never filled (NULL means "no measurement").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c, data_type=None) -> Column:
    col = _col(c)
    if data_type is not None and not isinstance(data_type, (DoubleType, FloatType)):
        return col
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def zero_fill(c, data_type=None) -> Column:
    """Missing (NULL or NaN) to 0.0 as DOUBLE; integers are cast first."""
    col = _col(c).cast("double")
    return F.coalesce(F.nanvl(col, F.lit(0.0)), F.lit(0.0))
