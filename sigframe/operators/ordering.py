"""Row positions, sorts and limits (PRJ-8, FLT-5, WIN-3, WIN-4, SRT-1..4, LIM-1).

``ordered_index`` is the building block. A window ``row_number() OVER
(PARTITION BY key ORDER BY ...)`` sends every row of a key to one task, so a
recording holding a third of the table would run on one core.

Here the whole table is cut into ranges of (key, order) tuples. A sketch of
bounded size gives their borders: about ``SAMPLES`` rows a range are picked by a
hash, and of those the one of least hash in each of ``SLOTS`` slots is kept, an
aggregate that merges partial results. A row's range is the number of borders not
above its tuple (a binary search over values of their own types, so any orderable
type and any value is exact). One exchange on (key, range) and a ``row_number``
inside give local positions, which are stored. Only a range's first and last key
can go on in another range, so what must be added to local positions is a table of
at most two rows a range, small enough to broadcast whatever the input.

The input is read twice, by the sketch and by the exchange, both while the plan is
built; the result is a scan of the stored rows. A table too small for a border is
one range: then nothing is stored and the plan is the plain window. Rows that are
equal in every column share a range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.session import scratch_path

_B, _N, _OFF, _RN, _K, _T, _S, _H = "_sf_bucket", "_sf_n", "_sf_off", "_sf_rn", "_sf_key", "_sf_tuple", "_sf_splits", "_sf_hash"
ROWS_PER_BUCKET = 2_000_000
SAMPLES = 8
SLOTS = 1 << 16


def _col(o):
    return F.col(o) if isinstance(o, str) else o


def _order_cols(order, descending):
    return [(_col(o).desc_nulls_last() if descending else _col(o).asc_nulls_first()) for o in order]


def _hashable(dt: T.DataType) -> bool:
    if isinstance(dt, T.ArrayType):
        return _hashable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_hashable(f.dataType) for f in dt.fields)
    return not isinstance(dt, (T.MapType, T.VariantType))


def _has_floats(dt: T.DataType) -> bool:
    if isinstance(dt, T.ArrayType):
        return _has_floats(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_has_floats(f.dataType) for f in dt.fields)
    return isinstance(dt, (T.FloatType, T.DoubleType))


def _splitters_below(splits, count: int, value):
    """How many of the ``count`` sorted ``splits`` are at most ``value`` (binary search)."""
    steps = [1 << b for b in range(count.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        (at + step <= count) & (F.get(splits, at + step - 1) <= value), at + step).otherwise(at))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder, and read from there."""
    path = scratch_path(df.sparkSession, f"sigframe-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantile_sketch(work: DataFrame, column: str, rows_per_bucket: int) -> DataFrame:
    """One row with ``_sf_splits``: sorted values of ``column`` about ``rows_per_bucket`` rows
    apart, at most ``SLOTS / SAMPLES`` of them. Equal rows are picked alike, so a value is
    picked with the odds of its rows being so many apart."""
    h = F.xxhash64(column)
    picked = work.select(F.col(column), h.alias("_sf_h")).filter(F.pmod("_sf_h", F.lit(max(1, rows_per_bucket // SAMPLES))) == 0)
    kept = picked.groupBy(F.pmod(F.xxhash64("_sf_h"), F.lit(SLOTS)).alias("_sf_slot")).agg(F.min(F.struct("_sf_h", column)).alias("_sf_least"))
    ranked = F.array_sort(F.collect_set(f"_sf_least.{column}"))
    return kept.agg(ranked.alias(_S)).select(F.filter(_S, lambda x, i: (i + 1) % SAMPLES == 0).alias(_S))


def _placed(work: DataFrame, splits: DataFrame, count: int, by: str = _K) -> DataFrame:
    """``work`` with the range of every row, dealt by (``by``, range), without the row's tuple:
    it repeats the row's columns and is made again behind the exchange."""
    ready = work.withColumn(_S, splits.scalar())  # no sub-query inside the search
    return ready.withColumn(_B, _splitters_below(F.col(_S), count, F.col(_T))).drop(_S, _T).repartition(by, _B)


def in_ranges(df: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` dealt by (``key``, range of (``key``, ``by``)) in one exchange, the range in
    ``_sf_bucket``, so that neighbours in the order of ``by`` meet in a window of (``key``,
    ``_sf_bucket``); and the keys that lie in more than one range, at most one a range (None
    if there is only one). A key's ranges are numbered in the order of ``by``; rows that are
    equal in both share a range."""
    work = df.withColumn(_T, F.struct(F.col(key).alias("k"), F.col(by).alias("o0")))
    splits = stored(quantile_sketch(work, _T, ROWS_PER_BUCKET), "splits")
    count = splits.select(F.size(_S)).first()[0]
    if not count:
        return df.repartition(key).withColumn(_B, F.lit(0)), None
    border_keys = splits.select(F.explode(_S).alias("_sf_border")).select(F.col("_sf_border.k").alias(key)).distinct()
    return _placed(work, splits, count, key), border_keys


def ordered_index(df: DataFrame, keys: list[str], order: list, out: str = "idx",
                  descending: bool = False, rows_per_bucket: int | None = None,
                  count_out: str | None = None) -> DataFrame:
    """Add ``out``: the 0-based position of each row within its ``keys`` group in
    ``order`` (ascending unless ``descending``). ``keys=[]`` numbers the whole table.
    ``count_out`` also adds the size of the row's group (so positions from the end
    are ``count - 1 - position``).

    Equal to ``row_number() - 1`` over the same window: NULLs come first, last if
    descending, and NaN is the largest number. Rows that tie in ``order`` are told
    apart by a hash of their columns; give ``order`` a total order (end with a
    unique column) for positions that do not depend on it.
    """
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    own = [F.col(f"`{c}`") for c in df.columns]
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)] or [F.lit(0)])
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0)
    # orders that are no column are kept, so that they are computed once
    made = {f"_sf_o{i}": o for i, o in enumerate(order) if not isinstance(o, str)}
    value = F.struct(F.col(_K).alias("k"), *[F.col(f"_sf_o{i}" if f"_sf_o{i}" in made else o).alias(f"o{i}") for i, o in enumerate(order)], tie.alias("tie"))
    work = df.select(*own, *[o.alias(c) for c, o in made.items()], key.alias(_K)).withColumn(_T, value)
    splits = stored(quantile_sketch(work, _T, rows_per_bucket), "splits")
    count = splits.select(F.size(_S)).first()[0]
    # struct order is that of the window: NULL fields first
    nth = F.col(_T).desc() if descending else F.col(_T).asc()
    if not count:
        whole = Window.partitionBy(_K)
        return work.select(*own, (F.row_number().over(whole.orderBy(nth)) - F.lit(1)).cast("long").alias(out),
                           *([F.count(F.lit(1)).over(whole).alias(count_out)] if count_out else []))
    # A window groups floating values by normalized ones and would exchange rows dealt by the
    # values themselves once more: those are dealt by the key's hash, one of the window's groups.
    dealt, by = work.drop(*keys), _K
    if keys and _has_floats(df.select(*keys).schema):
        dealt, by = dealt.withColumn(_H, F.xxhash64(_K)), _H
    here = Window.partitionBy(*dict.fromkeys([by, _K]), _B)
    # a row is exchanged with its key once
    placed = _placed(dealt, splits, count, by).withColumns({k: F.col(_K)[k] for k in keys}).withColumn(_T, value)
    local = stored(placed.select(
        *own, _B, F.row_number().over(here.orderBy(nth)).cast("long").alias(_RN),
        *([F.count(F.lit(1)).over(here).alias(_N)] if count_out else [])), "positions").withColumn(_K, key)
    # at most two rows a range: its first and its last key, where they lie in other ranges too;
    # a border lies between any two ranges of a key, so such a key is that of a border
    border_keys = splits.select(F.explode(_S).alias("_sf_border")).select(F.col("_sf_border.k").alias(_K)).distinct()
    of_key = Window.partitionBy(_K)
    before = of_key.orderBy(F.col(_B).desc() if descending else F.col(_B)).rowsBetween(Window.unboundedPreceding, -1)
    counts = local.join(F.broadcast(border_keys), _K, "left_semi").groupBy(_K, _B).agg(F.max(_RN).alias("_sf_rows"))
    carry = stored(counts.select(_K, _B, F.coalesce(F.sum("_sf_rows").over(before), F.lit(0)).alias(_OFF),
                                 F.sum("_sf_rows").over(of_key).alias("_sf_total"), F.count(F.lit(1)).over(of_key).alias("_sf_ranges"))
                   .filter("_sf_ranges > 1").select(_K, _B, _OFF, "_sf_total"), "carry")
    joined = local.join(F.broadcast(carry), [_K, _B], "left")
    position = F.col(_RN) - F.lit(1) + F.coalesce(_OFF, F.lit(0))
    return joined.select(*own, position.cast("long").alias(out), *([F.coalesce("_sf_total", _N).alias(count_out)] if count_out else []))


def row_index(df: DataFrame, key: str = "patient", order: list | None = None,
              out: str = "timestep") -> DataFrame:
    """PRJ-8: per-recording row index (the sample number) in time order."""
    return ordered_index(df, [key], order or ["time"], out=out).withColumn(out, F.col(out).cast("int"))


def every_nth_row(df: DataFrame, n: int, key: str = "patient", order: list | None = None) -> DataFrame:
    """FLT-5: keep rows whose position within the recording is a multiple of ``n``."""
    idx = ordered_index(df, [key], order or ["timestep"], out="_sf_pos")
    return idx.filter(F.col("_sf_pos") % n == 0).drop("_sf_pos")


def nth_in_group(df: DataFrame, key: str, order: list, n: int, from_end: bool = False) -> DataFrame:
    """WIN-3: the n-th row (0-based) of each group, counted from the start or the end.
    Every task keeps n + 1 rows per group before the shuffle."""
    w = Window.partitionBy(key).orderBy(*_order_cols(order, from_end))
    return df.withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) <= n + 1).filter(F.col(_RN) == n + 1).drop(_RN)


def sort_with_ordinal(df: DataFrame, keys: list[str], order: list, out: str = "ord",
                      descending: bool = False) -> DataFrame:
    """SRT-1/3/4: globally sorted rows plus their position inside each key group,
    so an order-insensitive comparison of the result still checks the order."""
    idx = ordered_index(df, keys, order, out=out, descending=descending)
    return idx.orderBy(*[F.col(k) for k in keys], *_order_cols(order, descending))


def top_n(df: DataFrame, n: int, order: list, ordinal: str | None = None) -> DataFrame:
    """LIM-1: first ``n`` rows under a total order (a per-partition top-n, then a merge),
    with their place from 0 in the column ``ordinal`` if it is named."""
    top = df.orderBy(*_order_cols(order, False)).limit(n)
    if ordinal is None:
        return top
    # at most n rows are left: one task numbers them
    return top.withColumn(ordinal, F.row_number().over(Window.orderBy(*_order_cols(order, False))) - 1)


