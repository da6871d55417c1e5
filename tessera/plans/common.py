"""Shared pieces of the query bindings: table loading and result rounding.

Doubles leave every binding rounded to a fixed number of significant digits
(``sig``) so two engines that sum in a different order still agree on the
printed value. The SQL twin ``sql_sig`` spells the same rule for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SIG_DIGITS = 10
_DECADES = range(-6, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sig(c, digits: int = SIG_DIGITS) -> Column:
    """Round a DOUBLE to ``digits`` significant digits (CASE ladder on |x|)."""
    col = F.col(c) if isinstance(c, str) else c
    col = col.cast("double")
    expr = None
    for e in _DECADES:
        cond = F.abs(col) < F.lit(10.0 ** (e + 1))
        val = F.round(col, digits - 1 - e)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.round(col, digits - 1 - (max(_DECADES) + 1)))


def sql_sig(x: str, digits: int = SIG_DIGITS) -> str:
    x = f"CAST({x} AS DOUBLE)"
    parts = [f"WHEN abs({x}) < 1e{e + 1} THEN round({x}, {digits - 1 - e})" for e in _DECADES]
    return "CASE " + " ".join(parts) + f" ELSE round({x}, {digits - 1 - (max(_DECADES) + 1)}) END"
