"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def contains_any_ci(c, patterns) -> Column:
    """True when lower(c) contains any of ``patterns`` (case-insensitive)."""
    col = F.lower(_col(c))
    out = F.lit(False)
    for p in patterns:
        out = out | col.contains(p.lower())
    return out


def normalise_name(c) -> Column:
    """lower case, spaces to underscores."""
    return F.regexp_replace(F.lower(_col(c)), " ", "_")


def truncate_ellipsis(c, n: int) -> Column:
    """Keep the first ``n`` characters and add '...' when longer (F2)."""
    col = _col(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def join_messages(c, sep: str = "; ") -> Column:
    """Aggregate: sorted, separator-joined messages."""
    return F.concat_ws(sep, F.sort_array(F.collect_list(_col(c))))


def key_category(c) -> Column:
    """Key class by prefix (P10): path / data / config / other."""
    col = _col(c)
    return (F.when(col.startswith("path:"), F.lit("path"))
            .when(col.startswith("data:"), F.lit("data"))
            .when(col.startswith("config:"), F.lit("config"))
            .otherwise(F.lit("other")))
