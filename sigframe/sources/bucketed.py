"""Stored tables that later jobs join and group without a shuffle (SNK-1 with JN-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.prep import tumbling_epoch
from sigframe.schemas import EPOCH_SAMPLES

BUCKET_KEYS = ("patient", "epoch")


def store_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: tuple[str, ...] = BUCKET_KEYS,
                   order: tuple[str, ...] = ("timestep",)) -> DataFrame:
    """Write ``df`` as table ``name`` under the shared folder ``path``, in ``buckets`` hash buckets
    of ``keys``, and return the table.

    Rows are partitioned the way buckets are before writing, so a bucket is one file. Size
    the buckets as shuffle partitions would be: tables that are joined need equal numbers.
    An epoch has at most n rows, so no bucket of (patient, epoch) is hot.
    """
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
       .bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(name))
    return df.sparkSession.table(name)


def store_samples(samples: DataFrame, labels: DataFrame, name: str, path: str, buckets: int,
                  n: int = EPOCH_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """Typed samples and labels with their epoch ids as the tables ``name``_samples and ``name``_labels."""
    return tuple(store_bucketed(tumbling_epoch(df, n), f"{name}_{kind}", f"{path}/{kind}", buckets)
                 for kind, df in (("samples", samples), ("labels", labels)))


def stored_label_join(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """JN-1 on stored tables. With this package's session settings the join, and an epoch
    assembly above it, use the buckets as they are: no exchange."""
    return samples.join(labels.select(*BUCKET_KEYS, "timestep", F.col("label")).hint("merge"), [*BUCKET_KEYS, "timestep"])
