"""Guarding joins against coarse partition reuse.

``session.RECOMMENDED_CONF`` sets ``spark.sql.requireAllClusterKeysForCoPartition
=false`` so that the label join and the epoch aggregation share one exchange.
The same setting lets Spark join on (a, b) an input that is already
hash-partitioned on ``a`` alone, shuffling the other input on ``a`` only; if
``a`` is a hot recording, all its rows then meet in one task. Joins whose key
is (recording, bucket) therefore partition both inputs on the full key
explicitly whenever the session allows that reuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def allows_coarse_reuse(df: DataFrame) -> bool:
    conf = df.sparkSession.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true")
    return str(conf).lower() == "false"


def on_full_key(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` hash-partitioned on all of ``cols`` when the session could otherwise
    reuse a partitioning on a subset of them; unchanged otherwise."""
    return df.repartition(*cols) if allows_coarse_reuse(df) else df
