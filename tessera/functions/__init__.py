"""Column-level helpers (built-in Spark expressions only, no Python UDFs)."""

from tessera.functions.nulls import nan_to_null, zero_fill
from tessera.functions.text import normalise_name, truncate_ellipsis, join_messages
from tessera.functions.paths import parent_folder, base_name
from tessera.functions.hashing import row_digest, md5_hex, sha256_hex

__all__ = [
    "nan_to_null", "zero_fill", "normalise_name", "truncate_ellipsis", "join_messages",
    "parent_folder", "base_name", "row_digest", "md5_hex", "sha256_hex",
]
