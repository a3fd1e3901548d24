"""Keeping an intermediate for reuse (SNK-4)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Persist ``df`` for the actions inside the block, then release it.

    Use it for small, reused results (predictions, reports), not for the raw
    sample table: lost blocks are recomputed from lineage, so it is safe when
    an executor disappears, but it costs executor memory and disk.
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
