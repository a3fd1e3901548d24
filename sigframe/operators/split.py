"""Seeded, partition-independent splits and hold-outs (SPL-1..3, FLT-2..4, JN-5, D10, D17).

A row's side is decided by md5(key || seed) alone, so the split is the same for
any partitioning, executor count or rerun, and needs no global sort. The first
8 hex digits are compared as fixed-width strings, which orders them the same
way as the numbers they spell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.operators.ordering import _hashable, ordered_index


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def hash_hex(key: Column | str, seed: int) -> Column:
    """First 8 hex digits of md5(key || seed)."""
    return F.substring(F.md5(F.concat(_c(key).cast("string"), F.lit(str(seed)))), 1, 8)


def _threshold(fraction: float) -> str:
    v = min(max(int(round(fraction * 16 ** 8)), 0), 16 ** 8)
    return "g" if v >= 16 ** 8 else format(v, "08x")  # 'g' sorts after every hex digit


def hash_side(key: Column | str, seed: int, fractions: dict[str, float]) -> Column:
    """Name of the side of each row: sides take consecutive ranges of the hash
    in the given order; ``fractions`` should sum to 1."""
    h = hash_hex(key, seed)
    acc, expr = 0.0, None
    names = list(fractions)
    for name in names[:-1]:
        acc += fractions[name]
        cond = h < F.lit(_threshold(acc))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    last = F.lit(names[-1])
    return last if expr is None else expr.otherwise(last)


def hash_split(df: DataFrame, key: Column | str, test_fraction: float = 0.2,
               seed: int = 42, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """SPL-2: split rows by key hash -> (train, test).

    By default the test side holds the rows whose hash falls below the
    fraction: about ``test_fraction`` of the rows, no sort, no count. With
    ``exact`` exactly floor(test_fraction * rows + 0.5) rows go to test, those of
    the smallest hashes (``tag_split_exact``).
    """
    if exact:
        tagged = tag_split_exact(df, key, test_fraction, seed, out="_sf_side")
        return (tagged.filter(F.col("_sf_side") == "train").drop("_sf_side"),
                tagged.filter(F.col("_sf_side") == "test").drop("_sf_side"))
    tagged = tag_split(df, key, test_fraction, seed, out="_sf_side")
    return (tagged.filter(F.col("_sf_side") == "train").drop("_sf_side"),
            tagged.filter(F.col("_sf_side") == "test").drop("_sf_side"))


DIGITS = 4  # hexadecimal digits looked at in one pass: a histogram of at most 65,536 bins


def tag_split_exact(df: DataFrame, key: Column | str, test_fraction: float = 0.2,
                    seed: int = 42, out: str = "side") -> DataFrame:
    """SPL-2 of exact size by distributed selection: ``out`` is 'test' on the
    floor(test_fraction * rows + 0.5) rows whose md5(key || seed) is smallest.

    A histogram of the first digits of the hash names the one bin that holds the
    cut; only that bin is counted by its next digits, and so on until a bin's edge
    is the cut. Nothing is sorted or ranked, and the driver sees counts of bins
    alone. Rows of one key differ by a hash of their columns; only if rows equal in
    every column lie across the cut are those rows numbered. A NULL key comes first.
    """
    tie = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)] or [F.lit(0)])), 16, "0")
    own = F.coalesce(F.md5(F.concat(_c(key).cast("string"), F.lit(str(seed)))), F.lit("0" * 32))
    digits = F.concat(own, F.lower(tie))
    left, prefix, length = None, "", 48
    while len(prefix) < length:
        bin_of = F.substring("_sf_d", len(prefix) + 1, DIGITS)
        rows = df.select(digits.alias("_sf_d")).filter(F.col("_sf_d").startswith(prefix))
        bins = sorted((r["bin"], r["count"]) for r in rows.groupBy(bin_of.alias("bin")).count().collect())
        if left is None:
            left = math.floor(sum(n for _, n in bins) * float(test_fraction) + 0.5)
        for name, n in bins:
            if left < n:
                prefix += name
                break
            left -= n
        else:
            prefix += "g"  # sorts after every digit: all rows seen are test
            break
        if not left:
            break
    side = F.when(digits < F.lit(prefix), F.lit("test")).otherwise(F.lit("train"))
    if len(prefix) < length or not left:
        return df.withColumn(out, side)
    equal = ordered_index(df.filter(digits == F.lit(prefix)), [], [F.lit(0)], out="_sf_rank")
    equal = equal.withColumn(out, F.when(F.col("_sf_rank") < left, "test").otherwise("train")).drop("_sf_rank")
    return df.filter(digits != F.lit(prefix)).withColumn(out, side).unionByName(equal)


def hash_split_3way(df: DataFrame, key: Column | str, val_fraction: float = 0.1,
                    test_fraction: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """SPL-3: tag rows train / val / test by key hash."""
    return df.withColumn(out, hash_side(key, seed, {
        "train": 1 - val_fraction - test_fraction, "val": val_fraction, "test": test_fraction}))


def person_of(recording: Column | str, length: int = 5) -> Column:
    """Person id of a recording id (both nights of a person share it)."""
    return F.substring(_c(recording), 1, length)


def pick_holdout(df: DataFrame, k: int, seed: int = 42, col: str = "patient",
                 unit: str = "recording", person_len: int = 5) -> DataFrame:
    """SPL-1: k distinct units (recordings or persons) with the smallest hash.
    Returns a DataFrame of at most k ``unit_id`` values (a per-partition top-k
    then a merge; never the whole id list on one task). NULL ids are no unit."""
    unit_col = _c(col) if unit == "recording" else person_of(col, person_len)
    ids = df.select(unit_col.alias("unit_id")).filter("unit_id is not null").distinct()
    return ids.orderBy(hash_hex("unit_id", seed), "unit_id").limit(k)


def tag_holdout(df: DataFrame, k: int, seed: int = 42, col: str = "patient", unit: str = "person",
                person_len: int = 5, out: str = "side") -> DataFrame:
    """JN-5/D10 in one pass: ``out`` is 'test' on the rows of k held-out units and 'train'
    on all others (rows without an id included). The id table has at most k rows, so
    it is broadcast."""
    ids = F.broadcast(pick_holdout(df, k, seed, col, unit, person_len)).withColumnRenamed("unit_id", "_sf_unit")
    unit_col = _c(col) if unit == "recording" else person_of(col, person_len)
    return (df.join(ids, unit_col == F.col("_sf_unit"), "left")
              .withColumn(out, F.when(F.col("_sf_unit").isNotNull(), "test").otherwise("train"))
              .drop("_sf_unit"))


def tag_split(df: DataFrame, key: Column | str, test_fraction: float = 0.2, seed: int = 42,
              out: str = "side") -> DataFrame:
    """SPL-2 in one pass: tag rows train / test by key hash."""
    return df.withColumn(out, hash_side(key, seed, {"train": 1 - test_fraction, "test": test_fraction}))


def holdout_split(df: DataFrame, k: int, seed: int = 42, col: str = "patient",
                  unit: str = "person", person_len: int = 5) -> tuple[DataFrame, DataFrame]:
    """JN-5/D10: (train, test) where test holds every row of k held-out units.
    The id table has at most k rows, so it is broadcast; the big side is filtered
    in place by a semi / anti join, no shuffle."""
    ids = F.broadcast(pick_holdout(df, k, seed, col, unit, person_len))
    unit_col = _c(col) if unit == "recording" else person_of(col, person_len)
    tagged = df.withColumn("_sf_unit", unit_col)
    test = tagged.join(ids, tagged["_sf_unit"] == ids["unit_id"], "left_semi").drop("_sf_unit")
    train = tagged.join(ids, tagged["_sf_unit"] == ids["unit_id"], "left_anti").drop("_sf_unit")
    return train, test


def rows_in(df: DataFrame, col: str, ids: list) -> DataFrame:
    """FLT-2: membership in a literal id list (becomes an In / InSet filter that
    reaches the Parquet scan)."""
    return df.filter(F.col(col).isin(ids))


def rows_not_in(df: DataFrame, col: str, ids: list) -> DataFrame:
    """FLT-3: non-membership. A NULL id is neither in nor out, so it is dropped."""
    return df.filter(~F.col(col).isin(ids))


def single_recording(df: DataFrame, recording: str, col: str = "patient") -> DataFrame:
    """FLT-4: one recording's rows."""
    return df.filter(F.col(col) == F.lit(recording))
