"""tessera: Spark-native analytics for wide feature tables and the logs around them.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a small
driver-side helper that only inspects schemas). Constants the original system
fixes are parameters whose defaults equal those values.
"""

from tessera.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
