"""Strided signal features over long-format samples (SIG-1..SIG-6).

Input is one row per sample: group keys (recording, epoch), a 0-based position
``pos`` inside the group, and channel columns. Outputs are grouped sums / maxima,
so every feature is a partial aggregate followed by one shuffle of the (much
smaller) output grid. Padding follows the common 'same' rule: output length
ceil(L / stride) and the padding split with the smaller half on the left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_padding(length: int, kernel: int, stride: int) -> tuple[int, int]:
    """(output length, left padding) of a 'same' window of ``kernel`` and ``stride``."""
    out_len = math.ceil(length / stride)
    total = max((out_len - 1) * stride + kernel - length, 0)
    return out_len, total // 2


def _position(pos: str, length: int):
    """``pos``, or an error where it is NULL or outside 0 .. length - 1."""
    inside = F.col(pos).between(0, length - 1)
    return F.when(inside, F.col(pos)).otherwise(F.raise_error(F.concat(
        F.lit(f"position outside 0 .. {length - 1}: "), F.coalesce(F.col(pos).cast("string"), F.lit("NULL")))))


def _every_position(grouped: DataFrame, keys: tuple[str, ...], channels: list[str], out_len: int, empty) -> DataFrame:
    """Rows for all ``out_len`` outputs of every group, ``empty`` where no sample fed one.
    Works on the output grid, which is shorter than the samples by the stride."""
    found = F.map_from_entries(F.collect_list(F.struct("out_pos", F.struct(*channels))))
    rows = (grouped.groupBy(*keys).agg(found.alias("_sf_found"))
                   .withColumn("out_pos", F.explode(F.sequence(F.lit(0), F.lit(out_len - 1))))
                   .withColumn("_sf_row", F.try_element_at("_sf_found", F.col("out_pos"))))
    return rows.select(*keys, "out_pos", *[F.coalesce(F.col(f"_sf_row.{c}"), empty).alias(c) for c in channels])


def strided_max(df: DataFrame, channels: list[str], pool: int, length: int,
                keys: tuple[str, ...] = ("patient", "epoch"), pos: str = "pos") -> DataFrame:
    """SIG-1: max pooling with pool = stride; edge windows may be short.
    Returns (keys..., out_pos, <channel> max...) for every output position of a group,
    NULL where it has no sample; a position outside the length is an error."""
    out_len, pad = same_padding(length, pool, pool)
    out = F.floor((_position(pos, length) + F.lit(pad)) / F.lit(pool)).cast("int")
    grouped = df.groupBy(*keys, out.alias("out_pos")).agg(*[F.max(c).alias(c) for c in channels])
    return _every_position(grouped, keys, channels, out_len, F.lit(None))


def strided_fir(df: DataFrame, channels: list[str], taps: list[float], stride: int, length: int,
                keys: tuple[str, ...] = ("patient", "epoch"), pos: str = "pos") -> DataFrame:
    """SIG-2: y[o] = sum_j taps[j] * x[o*stride + j - pad] with zero padding.

    Each sample is copied only to the ceil(k/stride) outputs it feeds, with its
    tap weight looked up in a literal array; a grouped sum builds the outputs.
    Every output position of a group is returned, 0 where only padding feeds it; a
    position outside the length is an error.
    """
    k = len(taps)
    out_len, pad = same_padding(length, k, stride)
    i = F.col("_sf_i")
    lo = F.greatest(F.ceil((i - F.lit(k - 1)) / F.lit(stride)), F.lit(0))
    hi = F.least(F.floor(i / F.lit(stride)), F.lit(out_len - 1))
    w = F.array(*[F.lit(float(t)) for t in taps])
    # A stride wider than the taps leaves samples that feed no output; their group stays.
    outs = F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int")))
    fed = (df.withColumn("_sf_i", _position(pos, length) + F.lit(pad))
             .withColumn("out_pos", F.explode_outer(outs))
             .withColumn("_sf_w", F.element_at(w, (i - F.col("out_pos") * stride + 1).cast("int"))))
    grouped = (fed.groupBy(*keys, F.coalesce("out_pos", F.lit(-1)).alias("out_pos"))
                  .agg(*[F.sum(F.col(c) * F.col("_sf_w")).alias(c) for c in channels]))
    return _every_position(grouped, keys, channels, out_len, F.lit(0.0))


def epoch_mean(df: DataFrame, channels: list[str], keys: tuple[str, ...] = ("patient", "epoch")) -> DataFrame:
    """SIG-3: average over time per epoch and channel."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in channels])


def row_layernorm(df: DataFrame, channels: list[str], eps: float = 1e-6,
                  suffix: str = "_ln") -> DataFrame:
    """SIG-4: normalise across the channel columns of each row:
    (x - mean) / sqrt(var + eps), with the population variance of that row."""
    k = float(len(channels))
    mean = sum((F.col(c) for c in channels), F.lit(0.0)) / F.lit(k)
    tmp = df.withColumn("_sf_m", mean)
    var = sum(((F.col(c) - F.col("_sf_m")) * (F.col(c) - F.col("_sf_m")) for c in channels),
              F.lit(0.0)) / F.lit(k)
    tmp = tmp.withColumn("_sf_v", var)
    return tmp.withColumns({c + suffix: (F.col(c) - F.col("_sf_m")) / F.sqrt(F.col("_sf_v") + F.lit(eps))
                            for c in channels}).drop("_sf_m", "_sf_v")
