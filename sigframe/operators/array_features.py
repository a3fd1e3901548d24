"""Strided features inside assembled epochs (SIG-1, SIG-2 on the arrays of AG-1).

An assembled epoch already holds its channel in one row, so windows are slices of an array
and neither rows nor shuffles are added. ``dense_channels`` gives every array one place per
sample number; the features then equal those of the long form (``operators.features``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import same_padding


def dense_channels(epochs: DataFrame, channels: list[str], length: int, pos: str = "pos") -> DataFrame:
    """Channel arrays of ``length`` places, the value of position i at place i and NULL where
    the epoch has no sample. ``pos`` is the array of positions that was collected with the
    channels; it is dropped. A position that repeats or is outside 0 .. length - 1 is an error."""
    places = F.sequence(F.lit(0), F.lit(length - 1))
    wrong = F.exists(pos, lambda p: p.isNull() | (p < 0) | (p >= length))
    checked = F.when(wrong, F.raise_error(F.lit(f"position outside 0 .. {length - 1}"))).otherwise(F.col(pos))
    at = epochs.withColumn("_sf_pos", checked)
    dense = {c: F.transform(places, _looked_up(F.map_from_arrays("_sf_pos", c))) for c in channels}
    return at.withColumns(dense).drop("_sf_pos", pos)


def _looked_up(values: Column):
    return lambda i: F.try_element_at(values, i)


def array_strided_max(epochs: DataFrame, channels: list[str], pool: int, length: int) -> DataFrame:
    """SIG-1 on dense arrays: each channel becomes the array of its window maxima, NULL where
    a window has no value."""
    out_len, pad = same_padding(length, pool, pool)
    windows = F.sequence(F.lit(0), F.lit(out_len - 1))

    def pooled(c):
        lo = lambda o: F.greatest(o * pool - pad, F.lit(0))
        hi = lambda o: F.least(o * pool - pad + pool, F.lit(length))
        return F.transform(windows, lambda o: F.array_max(F.slice(c, lo(o) + 1, hi(o) - lo(o))))
    return epochs.withColumns({c: pooled(c) for c in channels})


def array_strided_fir(epochs: DataFrame, channels: list[str], taps: list[float], stride: int, length: int) -> DataFrame:
    """SIG-2 on dense arrays: each channel becomes the array of its dot products with ``taps``,
    zero padded; a place without a value counts as 0."""
    k = len(taps)
    out_len, pad = same_padding(length, k, stride)
    behind = max((out_len - 1) * stride + k - pad - length, 0)
    weights = F.array(*[F.lit(float(t)) for t in taps])
    starts = F.sequence(F.lit(1), F.lit((out_len - 1) * stride + 1), F.lit(stride))

    def filtered(c):
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        padded = F.concat(zeros(pad), F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), zeros(behind))
        dot = lambda o: F.aggregate(F.zip_with(F.slice(padded, o, k), weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        return F.transform(starts, dot)
    return epochs.withColumns({c: filtered(c) for c in channels})
