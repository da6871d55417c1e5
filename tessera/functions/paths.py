"""Path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def parent_folder(c) -> Column:
    """Everything before the last '/'; empty string when there is none."""
    return F.regexp_extract(_col(c), r"^(.*)/[^/]*$", 1)


def base_name(c) -> Column:
    """Everything after the last '/'."""
    return F.regexp_extract(_col(c), r"([^/]*)$", 1)
