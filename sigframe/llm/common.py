"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.session import checkpoint_dir

# Characters of text a Python worker handles at a time: an Arrow batch is cut
# into slices of about this size, so memory does not follow the batch.
SLICE_CHARS = 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_each(rows: DataFrame, *values: str) -> DataFrame:
    """One row per (doc_id, th: hash of the text) with the columns ``values``, which follow from
    the text, and ``copies``, the number of such rows. This keys rows by what they hold, so a
    task that runs again gives them the same keys; copies are counted before the shuffle."""
    return rows.groupBy("doc_id", "th").agg(*[F.first(v).alias(v) for v in values], F.count(F.lit(1)).alias("copies"))


def every_copy(rows: DataFrame) -> DataFrame:
    """``copies`` rows of each row."""
    kept = [c for c in rows.columns if c != "copies"]
    return rows.select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(texts: pa.Array, budget: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in slices of about ``budget`` characters; nulls as ''."""
    start, part, size = 0, [], 0
    for i in range(len(texts)):
        value = texts[i].as_py() or ""
        part.append(value)
        size += len(value)
        if size >= budget:
            yield start, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, part


# Keys that hold more than one row in this many are few enough to broadcast.
HOT_KEYS = 1000


def spread_join(big: DataFrame, small: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has each ``key`` once and in ``size`` its number
    of rows in ``big``. Keys with more than a thousandth of the rows (at most ``HOT_KEYS``, so a
    bounded table) are broadcast and their rows stay where they are; the others are shuffled.
    Both inputs are read twice and should be stored."""
    total = F.lit(big.count())
    hot = small.filter(F.col(size) * HOT_KEYS > total).drop(size)
    rest = small.filter(F.col(size) * HOT_KEYS <= total).drop(size)
    here = big.join(F.broadcast(hot), key)
    away = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return here.unionByName(away)
