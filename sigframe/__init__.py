"""sigframe: DataFrame operators for labelled multichannel signal recordings.

Every public operator takes and returns a :class:`pyspark.sql.DataFrame` and is
built from Spark's own expressions, so Catalyst can prune, push down and fuse
whole chains of them into one plan.
"""

from sigframe.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
