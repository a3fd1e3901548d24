"""Epoch assembly: samples -> one row per (recording, epoch) with the channels as
ordered arrays and the epoch label (AG-1..AG-4, FN-7, FN-8, FN-10, D6, D7, D13, D18)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.schemas import CHANNELS, EPOCH_SAMPLES


def _samples_struct(order: str, channels: list[str]):
    return F.expr(f"struct(`{order}` AS _o, " + ", ".join(f"`{c}`" for c in channels) + ")")


def _order_of(df: DataFrame) -> str:
    """The sample number where there is one: float32 seconds collide from 131,072 s on."""
    return "timestep" if "timestep" in df.columns else "time"


def assemble_epochs(df: DataFrame, keys: tuple[str, ...] = ("patient", "epoch"),
                    order: str | None = None, channels: list[str] | None = None,
                    layout: str = "channel", label_rule: str | None = "both",
                    n: int | None = EPOCH_SAMPLES, require_full: bool = False,
                    vectors: bool = False) -> DataFrame:
    """AG-1: group samples by epoch and collect each channel in time order.

    One struct per sample is collected and sorted inside the aggregate, so the
    order never depends on how rows reached the task (D6) and a NULL channel value
    keeps its position (D13). The group is one epoch, so its state is bounded.

    layout='channel' gives one array per channel plus ``features`` (channel-major,
    FN-7); 'time' gives ``features`` as n rows of channel values (AG-4);
    'both' gives both. ``label_rule`` is 'mean' (avg truncated to int, AG-2),
    'first' (label of the earliest sample, AG-3), 'both' or None.
    ``require_full`` keeps epochs of exactly ``n`` samples (D18).
    """
    channels = channels or CHANNELS
    order = order or _order_of(df)
    keys = list(keys)
    aggs = [F.array_sort(F.collect_list(_samples_struct(order, channels))).alias("_samples"),
            F.count(F.lit(1)).alias("n_samples")]
    if label_rule in ("mean", "both"):
        aggs.append(F.avg("label").cast("int").alias("label_mean"))
    if label_rule in ("first", "both"):
        # min of (time, label) = label of the earliest sample; ties take the smaller label.
        aggs.append(F.min(F.struct(F.col(order), F.col("label")))["label"].alias("label_first"))
    out = df.groupBy(*keys).agg(*aggs)
    if require_full and n:
        out = out.filter(F.col("n_samples") == n)
    arrays = {c: f"transform(_samples, x -> x.`{c}`)" for c in channels}
    cols = [f"`{c}`" for c in out.columns if c != "_samples"]
    extra = []
    if layout in ("channel", "both"):
        extra += [f"{a} AS `{c}`" for c, a in arrays.items()]
        extra.append("concat(" + ", ".join(arrays.values()) + ") AS features")
    if layout in ("time", "both"):
        name = "features_tm" if layout == "both" else "features"
        row = "array(" + ", ".join(f"x.`{c}`" for c in channels) + ")"
        extra.append(f"transform(_samples, x -> {row}) AS {name}")
    out = out.selectExpr(*cols, *extra)
    if vectors:
        out = out.withColumn("vectors", array_to_vector(F.col("features")))
    return out


def dropped_short_epochs(epochs: DataFrame, n: int = EPOCH_SAMPLES) -> DataFrame:
    """D18 report: epochs shorter than ``n`` and the samples they hold."""
    return (epochs.filter(F.col("n_samples") != n)
                  .agg(F.count(F.lit(1)).alias("short_epochs"),
                       F.coalesce(F.sum("n_samples"), F.lit(0)).alias("dropped_samples")))


def epoch_label_mean(df: DataFrame, keys=("patient", "epoch")) -> DataFrame:
    """AG-2: avg(label) truncated to int per epoch (partial aggregation, no collect)."""
    return df.groupBy(*keys).agg(F.avg("label").cast("int").alias("label"))


def epoch_label_first(df: DataFrame, keys=("patient", "epoch"), order: str | None = None) -> DataFrame:
    """AG-3: label of the earliest sample of each epoch."""
    order = order or _order_of(df)
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(order), F.col("label")))["label"].alias("label"))
