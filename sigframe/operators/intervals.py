"""Interval annotations: chunking, n-th rows, cropping, and the interval join that
labels samples (WIN-2, WIN-3, FLT-7, JN-3, FN-17).

Spark has no range-join algorithm; a plain ``patient = patient AND t BETWEEN``
join degrades to a per-recording product. Here both sides get a time bucket of
fixed width, each interval is copied into the few buckets it touches, and the join
is an equi-join on (recording, bucket) with the exact test as a residual filter.
A bucket holds a bounded stretch of time, so a long recording spreads over many
join keys instead of forming one hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators.ordering import ordered_index
from sigframe.operators.partitioning import on_full_key
from sigframe.schemas import CROP_MARGIN_S, EPOCH_SECONDS, SFREQ

# Tasks over which the annotations of one recording are dealt where they meet its crop bounds.
SPREAD = 16


def annotation_chunks(ann: DataFrame, chunk: float = EPOCH_SECONDS, onset: str = "onset",
                      duration: str = "duration") -> DataFrame:
    """WIN-2: cut each annotation into whole chunks of ``chunk`` seconds.

    An annotation of duration d yields floor(d / chunk) chunks starting at
    onset + k * chunk; shorter remainders yield nothing. Adds ``chunk_idx`` and
    ``chunk_onset``.
    """
    n = F.floor(F.col(duration) / F.lit(chunk))
    # sequence(0, -1) would count down, hence the guard.
    return (ann.filter(n >= 1)
               .withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
               .withColumn("chunk_onset", F.col(onset) + F.col("chunk_idx") * F.lit(chunk)))


def epoch_window_seconds(chunk: float = EPOCH_SECONDS, sfreq: float = SFREQ) -> tuple[float, float]:
    """FN-17: tmin and tmax of an epoch in seconds (tmax = chunk - 1/sfreq)."""
    return 0.0, chunk - 1.0 / sfreq


def epoch_seconds(df: DataFrame, index: str = "timestep", chunk: float = EPOCH_SECONDS,
                  sfreq: float = SFREQ) -> DataFrame:
    """FN-17 as columns: ``t_start`` of the sample at ``index`` in seconds, and ``t_end`` of the
    last sample of an epoch that starts there."""
    tmin, tmax = epoch_window_seconds(chunk, sfreq)
    start = F.col(index) / F.lit(float(sfreq))
    return df.withColumns({"t_start": start + F.lit(tmin), "t_end": start + F.lit(tmax)})


def interval_join(samples: DataFrame, intervals: DataFrame, key: str = "patient",
                  t: str = "t", start: str = "chunk_onset", length: float | None = EPOCH_SECONDS,
                  end: str | None = None, bucket: float | None = None,
                  how: str = "inner") -> DataFrame:
    """JN-3: join each sample to every interval [start, end) of its recording that
    contains its time ``t``.

    Give a fixed ``length`` (end = start + length) or an ``end`` column. The bucket
    width defaults to ``length``; an interval is copied into
    floor(end/w) - floor(start/w) + 1 buckets, so keep ``bucket`` near the typical
    interval length.
    """
    w = float(bucket or length)
    if end is None:
        end_col = F.col(start) + F.lit(float(length))
    else:
        end_col = F.col(end)
    iv = (intervals.withColumn("_sf_end", end_col)
                   .withColumn("_sf_b", F.explode(F.sequence(
                       F.floor(F.col(start) / F.lit(w)), F.floor(F.col("_sf_end") / F.lit(w))))))
    sm = samples.withColumn("_sf_b", F.floor(F.col(t) / F.lit(w)))
    s, i = on_full_key(sm, key, "_sf_b").alias("s"), on_full_key(iv, key, "_sf_b").alias("i")
    cond = [F.col(f"s.{key}") == F.col(f"i.{key}"), F.col("s._sf_b") == F.col("i._sf_b"),
            F.col(f"s.{t}") >= F.col(f"i.{start}"), F.col(f"s.{t}") < F.col("i._sf_end")]
    out = s.join(i, cond, how)
    keep = [F.col(f"s.{c}") for c in samples.columns] + \
           [F.col(f"i.{c}") for c in intervals.columns if c not in samples.columns]
    return out.select(*keep)


FANOUT = 16
# The smallest nodes of an interval in ``interval_join_any`` are at most so many times its length.
GRAIN = 8.0


def dyadic_cover(intervals: DataFrame, start: str, end: str, unit: float, levels: int, fanout: int = FANOUT,
                 grain: float | None = None) -> DataFrame:
    """One row per interval and node (``_sf_level``, ``_sf_node``) of a tree over time whose
    leaves are ``unit`` long and whose nodes have ``fanout`` children: the fewest nodes that
    cover [start, end), at most 2 (fanout - 1) a level, so their number grows with the
    logarithm of the length. Empty intervals have none.

    With ``grain`` the ends of an interval are first rounded outwards to nodes of the highest
    level whose nodes are at most ``grain`` times its length (leaves, if none is). It then has
    at most fanout / grain + 2 nodes, more only if it is longer than the top level's, and they
    reach past each end by less than ``grain`` times its length."""
    first = F.floor(F.col(start) / F.lit(unit))
    stop = F.ceil(F.col(end) / F.lit(unit))  # one past the last leaf
    if grain is not None:
        reach, step = (F.col(end) - F.col(start)) * F.lit(float(grain)), F.lit(1)
        for level in range(1, levels):
            step = F.when(reach >= F.lit(float(unit * fanout ** level)), F.lit(fanout ** level)).otherwise(step)
        first, stop = F.floor(first / step) * step, F.ceil(stop / step) * step
    runs = []
    for level in range(levels):
        size, up = fanout ** level, fanout ** (level + 1)
        lo, hi = F.ceil(first / F.lit(size)), F.floor(stop / F.lit(size))  # the level's nodes inside
        above, beyond = F.ceil(first / F.lit(up)) * fanout, F.floor(stop / F.lit(up)) * fanout  # those in nodes one level up
        if level == levels - 1:
            parts = [(lo, hi)]
        else:
            whole = above < beyond
            parts = [(lo, F.when(whole, above).otherwise(hi)), (F.when(whole, beyond).otherwise(hi), hi)]
        for a, b in parts:
            nodes = F.when(a < b, F.sequence(a.cast("long"), b.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
            runs.append(F.arrays_zip(F.array_repeat(F.lit(level), F.size(nodes)).alias("_sf_level"), nodes.alias("_sf_node")))
    pairs = [F.col(f"_sf_run{i}") for i in range(len(runs))]
    named = intervals.filter(F.col(start) < F.col(end)).select("*", *[x.cast("array<struct<_sf_level:int,_sf_node:bigint>>").alias(f"_sf_run{i}") for i, x in enumerate(runs)])
    return named.select(*[F.col(f"`{c}`") for c in intervals.columns], F.inline(F.concat(*pairs)))


def interval_join_any(samples: DataFrame, intervals: DataFrame, key: str = "patient", t: str = "t",
                      start: str = "start", end: str = "end", unit: float = 1.0, longest: float | None = None) -> DataFrame:
    """JN-3 for intervals of any length: each sample with every interval [start, end) of its
    recording that contains ``t``.

    Intervals are cut into the nodes of a tree over time (``dyadic_cover``), a sample is in
    one node of each level, and both meet by (recording, level, node). Nodes are not much
    shorter than their interval, which so has a few of them instead of some on every level;
    samples that lie in its nodes beside it are told by the exact test. ``longest`` is the
    length of the longest interval (looked up if not given); it sets the levels, one for
    each power of ``FANOUT`` units. Intervals longer than it are still joined, in more nodes.
    """
    if longest is None:
        longest = intervals.agg(F.max(F.col(end) - F.col(start))).first()[0] or unit
    levels = 1
    while unit * FANOUT ** levels <= longest:
        levels += 1
    cover = dyadic_cover(intervals, start, end, unit, levels, grain=GRAIN)
    leaf = F.floor(F.col(t) / F.lit(unit))
    nodes = F.array(*[F.struct(F.lit(n).alias("_sf_level"), F.floor(leaf / F.lit(FANOUT ** n)).alias("_sf_node")) for n in range(levels)])
    placed = samples.select("*", F.inline(nodes))
    s, i = (on_full_key(d, key, "_sf_level", "_sf_node").alias(n) for d, n in ((placed, "s"), (cover, "i")))
    both = s.join(i, [F.col(f"s.{c}") == F.col(f"i.{c}") for c in (key, "_sf_level", "_sf_node")] + [
        F.col(f"s.{t}") >= F.col(f"i.{start}"), F.col(f"s.{t}") < F.col(f"i.{end}")])
    return both.select(*[F.col(f"s.{c}") for c in samples.columns], *[F.col(f"i.{c}") for c in intervals.columns if c not in samples.columns])


def label_samples_by_chunks(samples: DataFrame, ann: DataFrame, chunk: float = EPOCH_SECONDS,
                            key: str = "patient", t: str = "t") -> DataFrame:
    """Annotation-based epoching as a join: every sample inside a full chunk of an
    annotation gets that annotation's description as ``condition``."""
    chunks = annotation_chunks(ann, chunk).select(key, "chunk_onset", "chunk_idx",
                                                 F.col("description").alias("condition"))
    return interval_join(samples, chunks, key=key, t=t, start="chunk_onset", length=chunk)


def annotation_landmarks(ann: DataFrame, key: str = "patient") -> DataFrame:
    """WIN-3 per recording: the second annotation, the last one and the one
    before the last (ordered by onset, duration, description). The input is read once: every
    row stands in an ascending and a descending order of its recording, and every task keeps
    two rows of each before the shuffle. Recordings with one annotation get NULL for the
    missing rows."""
    order = ["onset", "duration", "description"]
    rows = ann.select(key, *order, F.explode(F.array(F.lit(False), F.lit(True))).alias("_sf_back"))
    back = F.col("_sf_back")
    both = [o for c in order for o in (F.when(~back, F.col(c)).asc_nulls_first(), F.when(back, F.col(c)).desc_nulls_last())]
    ends = (rows.withColumn("_sf_nth", F.row_number().over(Window.partitionBy(key, "_sf_back").orderBy(*both)))
                .filter("_sf_nth <= 2"))
    at = lambda n, side, c: F.max(F.when((F.col("_sf_nth") == n) & side, F.col(c)))
    return ends.groupBy(key).agg(
        at(2, ~back, "onset").alias("second_onset"), at(2, ~back, "description").alias("second_description"),
        at(1, back, "onset").alias("last_onset"), at(1, back, "description").alias("last_description"),
        at(2, back, "onset").alias("before_last_onset"))


def crop_bounds(ann: DataFrame, margin: float = CROP_MARGIN_S, key: str = "patient",
                wake_suffix: str = "W") -> DataFrame:
    """FLT-7 bounds per recording: from ``margin`` before the second annotation to
    ``margin`` after the last wake annotation (the last row if its description
    ends in ``wake_suffix``, else the row before it)."""
    lm = annotation_landmarks(ann, key)
    last_is_wake = F.col("last_description").endswith(wake_suffix)
    wake_onset = F.when(last_is_wake, F.col("last_onset")).otherwise(F.col("before_last_onset"))
    return lm.select(key, (F.col("second_onset") - F.lit(margin)).alias("crop_lo"),
                     (wake_onset + F.lit(margin)).alias("crop_hi"))


def crop_annotations(ann: DataFrame, margin: float = CROP_MARGIN_S, key: str = "patient",
                     wake_suffix: str = "W") -> DataFrame:
    """FLT-7: keep annotations overlapping [crop_lo, crop_hi] and clip them to it
    (an annotation is kept when onset <= hi and onset + duration >= lo).
    Recordings with fewer than two annotations, or without a wake bound, vanish."""
    # A recording's annotations are dealt over SPREAD tasks, each with a copy of its bounds.
    slot = F.pmod(F.xxhash64("onset", "duration", "description"), F.lit(SPREAD))
    bounds = crop_bounds(ann, margin, key, wake_suffix).withColumn("_sf_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    a = (on_full_key(ann.withColumn("_sf_slot", slot), key, "_sf_slot")
         .join(on_full_key(bounds, key, "_sf_slot"), [key, "_sf_slot"], "inner"))
    off = F.col("onset") + F.col("duration")
    kept = a.filter((F.col("onset") <= F.col("crop_hi")) & (off >= F.col("crop_lo")))
    new_onset = F.greatest(F.col("onset"), F.col("crop_lo"))
    new_end = F.least(off, F.col("crop_hi"))
    return kept.select(*[c for c in ann.columns if c not in ("onset", "duration")],
                       new_onset.alias("onset"), (new_end - new_onset).alias("duration"),
                       "crop_lo", "crop_hi")


def recording_tables(samples: DataFrame, ann: DataFrame, channels: list[str], chunk: float = EPOCH_SECONDS,
                     margin: float = CROP_MARGIN_S, key: str = "patient", t: str = "t",
                     ties: tuple[str, ...] = ()) -> DataFrame:
    """The data-generation chain: annotations cropped to the night, cut into whole chunks,
    joined to the samples they contain, and the samples kept numbered per recording.

    Returns (key, timestep, time, condition, channels...), with ``timestep`` from 0 in
    order of ``t`` and then ``ties``, and ``time`` the seconds since the chunk's start. The
    sample and the label table are selections of it (``sample_table``, ``label_table``).
    """
    cropped = crop_annotations(ann, margin, key).drop("crop_lo", "crop_hi")
    inside = label_samples_by_chunks(samples, cropped, chunk, key, t)
    inside = inside.withColumn("time", F.col(t) - F.col("chunk_onset"))
    rows = ordered_index(inside, [key], [t, *ties, "chunk_onset"], out="timestep")
    return rows.select(key, "timestep", "time", "condition", *channels)


def sample_table(rows: DataFrame, channels: list[str], key: str = "patient") -> DataFrame:
    return rows.select(key, "timestep", "time", *channels)


def label_table(rows: DataFrame, key: str = "patient") -> DataFrame:
    return rows.select(key, "timestep", "time", "condition")
