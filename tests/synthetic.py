"""Seeded synthetic recordings for tests of true shape (FIXTURES section 5).

r recordings x e epochs x n samples; three channels are sine waves whose
frequency depends on the stage, plus hash noise; stages come in runs and about
2 % of epochs carry an unknown stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

STAGE_NAMES = ["Sleep stage W", "Sleep stage 1", "Sleep stage 2", "Sleep stage 3", "Sleep stage R"]


def recordings(spark, r: int = 4, e: int = 20, n: int = 30, seed: int = 7):
    """(raw_data, raw_labels) in the raw schemas (channel names with spaces)."""
    total = r * e * n
    base = spark.range(total).select(
        (F.col("id") / (e * n)).cast("int").alias("rec"),
        (F.col("id") % (e * n)).cast("int").alias("timestep"))
    base = base.withColumn("patient", F.format_string("ST7%02d%dJ0", (F.col("rec") / 2).cast("int") + 1,
                                                      F.col("rec") % 2 + 1))
    epoch = (F.col("timestep") / n).cast("int")
    # stages in runs of 3 epochs; an unknown stage where a hash hits 2 %
    stage_idx = ((epoch / 3).cast("int") + F.col("rec")) % 5
    h = F.abs(F.xxhash64(F.col("patient"), epoch, F.lit(seed))) % 100
    cond = F.when(h < 2, F.lit("Sleep stage ?")).otherwise(F.element_at(F.array(*[F.lit(s) for s in STAGE_NAMES]),
                                                                        stage_idx + 1))
    freq = (stage_idx + 1).cast("double")
    phase = (F.col("timestep") % n).cast("double") / n * 2 * 3.141592653589793
    noise = (F.abs(F.xxhash64("patient", "timestep", F.lit(seed))) % 1000 / 1000.0 - 0.5) * 0.2
    df = base.withColumns({
        "time": (F.col("timestep") / 100.0).cast("float"),
        "cond": cond,
        "c1": (F.sin(phase * freq) + noise).cast("float"),
        "c2": (F.cos(phase * freq) + noise).cast("float"),
        "c3": (F.sin(phase * freq * 2) - noise).cast("float"),
    })
    data = df.select("patient", "timestep", "time", F.col("c1").alias("EEG Fpz-Cz"),
                     F.col("c2").alias("EEG Pz-Oz"), F.col("c3").alias("EOG horizontal"),
                     (F.col("c1") * 0.5).alias("EMG submental"))
    labels = df.select("patient", "timestep", "time", F.col("cond").alias("condition"))
    return data, labels
