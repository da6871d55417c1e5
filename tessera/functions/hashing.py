"""Hash helpers.

``row_digest`` hashes a canonical text of the given columns: every value is its
length, ':' and its text, NULL is ``N`` (no length can spell it), so different
rows never share a text. A DOUBLE (FLOAT is widened first) is spelled with all the
digits that tell it from every other double, so 1e-7 and 2e-7 differ and 1e300 has a
text; 0.0 and -0.0 are equal, and so are all NaN. Other engines print doubles in
other ways: to compare digests with them, cast to DECIMAL or whole cents first.

``lanes`` cuts a SHA-256 into eight 32-bit numbers. Their sums modulo 2^32 over the rows
are a hash of the multiset of rows: order-free, and updated by adding the sums of new rows and
taking away those of removed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def canonical_value(c, dtype=None) -> Column:
    col = _col(c)
    if isinstance(dtype, (DoubleType, FloatType)):
        col = col.cast("double") + F.lit(0.0)  # -0.0 + 0.0 is 0.0
    text = col.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))


def canonical_text(df: DataFrame, cols: list[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws("|", *[canonical_value(c, types.get(c)) for c in cols])


def row_digest(df: DataFrame, cols: list[str], algo: str = "md5") -> Column:
    text = canonical_text(df, cols)
    return F.md5(text) if algo == "md5" else F.sha2(text, 256)


LANES = 8
LANE_SIZE = 1 << 32


def lanes(digest: Column) -> list[Column]:
    """The eight 32-bit numbers of a SHA-256 in hex."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(LANES)]


def lanes_hex(sums: Column) -> Column:
    """64 hex digits of an array of eight numbers below 2^32."""
    return F.array_join(F.transform(sums, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def md5_hex(c) -> Column:
    return F.md5(_col(c).cast("string"))


def sha256_hex(c) -> Column:
    return F.sha2(_col(c).cast("string"), 256)
