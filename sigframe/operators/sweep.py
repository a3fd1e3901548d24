"""Overlapping annotations made disjoint (WIN-2, JN-3).

Annotations of one recording may overlap (a second scorer, an event inside a stage); cut
into chunks and joined to samples they would label a sample more than once. Here the start
and end points of a recording are swept in order, and every stretch between two points
goes to one annotation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators.intervals import interval_join_any
from sigframe.operators.ordering import in_ranges, stored


def disjoint_intervals(intervals: DataFrame, key: str = "patient", start: str = "onset", end: str = "end",
                       unit: float = 60.0, longest: float | None = None) -> DataFrame:
    """The pieces [start, end) of each recording that one interval owns, which never overlap.

    Where several intervals cover a time, the one that starts last owns it; of equal starts
    the one that ends first, then the one with the greatest other columns (in the order of
    the columns). An interval goes on after a later one inside it has ended, so it may have
    several pieces or none. Adjoining stretches of one interval are one piece, equal rows
    are one interval, and rows that are empty or have a NULL start, end or key are left out.

    Returns (key, start, end, of_start, of_end, other columns): ``of_start`` and ``of_end``
    are the ends of the interval that owns the piece. Other columns must be orderable.

    Points are dealt in ranges of (recording, time) (``in_ranges``), so no recording is one
    task: a point's stretch ends where the next one lies, and what goes on past a range is a
    table of a few rows a range. Where intervals start, the greatest of them owns the
    stretch; at a point where some only end, its owner is a maximum over the intervals that
    the tree join finds there. Intervals and points are stored, as they are read more than
    once. ``unit`` and ``longest`` are those of ``interval_join_any``.
    """
    rest = [c for c in intervals.columns if c not in (key, start, end)]
    others = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_sf_rest")] if rest else []
    iv = stored(intervals.filter((F.col(start) < F.col(end)) & F.col(key).isNotNull()).select(key, start, end, *others), "intervals")
    # the owner's columns repeat those of its interval: made where they are needed, not exchanged
    owner = F.struct(F.col(start).alias("of_start"), (-F.col(end)).alias("_sf_neg"), *(["_sf_rest"] if rest else []))
    # an interval with an end of NaN is in no node of the tree, and owns nothing
    begins = F.struct(F.col(start).cast("double").alias("_sf_t"), F.when(~F.isnan(F.col(end).cast("double")), owner).alias("_sf_own"))
    ends = F.struct(F.col(end).cast("double").alias("_sf_t"), F.lit(None).cast(iv.select(owner.alias("_sf_own")).schema["_sf_own"].dataType).alias("_sf_own"))
    marks, wide = in_ranges(iv.select(key, F.inline(F.array(begins, ends))), key, "_sf_t")
    here = Window.partitionBy(key, "_sf_bucket").orderBy("_sf_t")
    points = marks.groupBy(key, "_sf_bucket", "_sf_t").agg(F.max("_sf_own").alias("_sf_own"))
    stretches = stored(points.withColumn("_sf_until", F.lead("_sf_t").over(here)), "points")
    if wide is not None:
        stretches = _until_next_range(stretches, wide, key)
    stretches = stretches.filter(F.col("_sf_until").isNotNull())
    begun, left = stretches.filter(F.col("_sf_own").isNotNull()), stretches.filter(F.col("_sf_own").isNull()).drop("_sf_own")
    covered = interval_join_any(left, iv, key=key, t="_sf_t", start=start, end=end, unit=unit, longest=longest)
    found = covered.groupBy(key, "_sf_bucket", "_sf_t", "_sf_until").agg(F.max(owner).alias("_sf_own"))
    owned = begun.unionByName(found).repartition(key, "_sf_bucket")
    pieces = _runs(owned, [key, "_sf_bucket"])
    if wide is not None:
        pieces = _over_borders(stored(pieces, "pieces"), wide, key)
    return pieces.select(key, F.col("_sf_t").alias(start), F.col("_sf_until").alias(end), F.col("_sf_own.of_start").alias("of_start"),
                         (-F.col("_sf_own._sf_neg")).alias("of_end"), *[F.col(f"_sf_own._sf_rest.`{c}`").alias(c) for c in rest])


def _until_next_range(stretches: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """``stretches`` with the end of a recording's last one in a range: the first point of its next range."""
    firsts = stretches.join(F.broadcast(wide), key, "left_semi").groupBy(key, "_sf_bucket").agg(F.min("_sf_t").alias("_sf_first"))
    following = F.lead("_sf_first").over(Window.partitionBy(key).orderBy("_sf_bucket"))
    carry = stored(firsts.select(key, "_sf_bucket", following.alias("_sf_next")).filter(F.col("_sf_next").isNotNull()), "carry")
    joined = stretches.join(F.broadcast(carry), [key, "_sf_bucket"], "left")
    return joined.withColumn("_sf_until", F.coalesce("_sf_until", "_sf_next")).drop("_sf_next")


def _runs(rows: DataFrame, within: list[str]) -> DataFrame:
    """Rows that adjoin within ``within`` and have one owner as one, numbered in ``_sf_run`` from 1."""
    order = Window.partitionBy(*within).orderBy("_sf_t")
    goes_on = F.lag("_sf_own").over(order).eqNullSafe(F.col("_sf_own")) & F.lag("_sf_until").over(order).eqNullSafe(F.col("_sf_t"))
    numbered = (rows.withColumn("_sf_new", F.when(goes_on, 0).otherwise(1))
                    .withColumn("_sf_run", F.sum("_sf_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return numbered.groupBy(*within, "_sf_run").agg(F.max("_sf_own").alias("_sf_own"), F.min("_sf_t").alias("_sf_t"), F.max("_sf_until").alias("_sf_until"))


def _over_borders(pieces: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """``pieces`` with those of one owner that adjoin over a border as one: only a range's first
    and last piece of a recording can, so at most two rows a range meet."""
    counts = stored(pieces.join(F.broadcast(wide), key, "left_semi").groupBy(key, "_sf_bucket").agg(F.max("_sf_run").alias("_sf_last")), "carry")
    placed = pieces.join(F.broadcast(counts), [key, "_sf_bucket"], "left")
    outer = F.col("_sf_last").isNotNull() & ((F.col("_sf_run") == 1) | (F.col("_sf_run") == F.col("_sf_last")))
    cols = [key, "_sf_t", "_sf_until", "_sf_own"]
    return placed.filter(~outer).select(*cols).unionByName(_runs(placed.filter(outer).select(*cols), [key]).select(*cols))


def disjoint_annotations(ann: DataFrame, key: str = "patient", unit: float = 60.0, longest: float | None = None) -> DataFrame:
    """Annotations (key, onset, duration, ...) of which no two overlap, by the rule of
    ``disjoint_intervals``; same columns. Give them to ``label_samples_by_chunks`` so that no
    sample is labelled twice. A piece is written as its length, so its end is exact where
    the sums of onsets and durations are (whole seconds, binary fractions) and can differ in
    the last bit elsewhere: join on the ends of ``disjoint_intervals`` there."""
    iv = ann.withColumn("_sf_end", F.col("onset") + F.col("duration")).drop("duration")
    parts = disjoint_intervals(iv, key, "onset", "_sf_end", unit, longest)
    return parts.withColumn("duration", F.col("_sf_end") - F.col("onset")).select(*ann.columns)
