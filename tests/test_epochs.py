"""Epoch assembly, layouts and array functions (D6, D7, D12, D13, D18, FN-7..FN-13)."""

import math

from pyspark.sql import functions as F

from sigframe.functions.arrays import (
    argmax, channel_major_to_time_major, one_hot, softmax, time_major_to_channel_major,
)
from sigframe.operators import epochs as E


def _epoch_rows(spark, rows):
    return spark.createDataFrame(rows, "patient string, epoch bigint, time float, fpzcz float, pzoz float, "
                                       "horizontal float, label int").repartition(3)


def test_order_and_nulls_kept(spark):
    rows = [("P", 0, 2.0, 2.0, 20.0, None, 1), ("P", 0, 1.0, 1.0, 10.0, 5.0, 1), ("P", 0, 3.0, None, 30.0, 6.0, 1)]
    ep = E.assemble_epochs(_epoch_rows(spark, rows), n=3).first()
    assert ep["fpzcz"] == [1.0, 2.0, None]
    assert ep["horizontal"] == [5.0, None, 6.0]
    assert ep["features"] == [1.0, 2.0, None, 10.0, 20.0, 30.0, 5.0, None, 6.0]


def test_label_rules(spark):
    rows = [("P", 0, 1.0, 0.0, 0.0, 0.0, 1), ("P", 0, 2.0, 0.0, 0.0, 0.0, 2),
            ("P", 1, 3.0, 0.0, 0.0, 0.0, 4), ("P", 1, 4.0, 0.0, 0.0, 0.0, 0), ("P", 1, 5.0, 0.0, 0.0, 0.0, 0)]
    got = {r["epoch"]: (r["label_mean"], r["label_first"]) for r in E.assemble_epochs(_epoch_rows(spark, rows)).collect()}
    assert got == {0: (1, 1), 1: (1, 4)}


def test_layouts_and_transpose(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [5.0, 6.0])], "a array<double>, b array<double>, c array<double>")
    flat = F.concat("a", "b", "c")
    row = df.select(flat.alias("f"), channel_major_to_time_major(flat, 3).alias("tm")).select(
        "f", "tm", time_major_to_channel_major(F.col("tm"), 3).alias("back")).first()
    assert row["f"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert row["tm"] == [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]]
    assert row["back"] == row["f"]


def test_time_major_assembly(spark):
    rows = [("P", 0, 2.0, 2.0, 4.0, 6.0, 0), ("P", 0, 1.0, 1.0, 3.0, 5.0, 0)]
    ep = E.assemble_epochs(_epoch_rows(spark, rows), layout="time", n=2).first()
    assert ep["features"] == [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]]


def test_short_epoch_dropped_and_reported(spark):
    rows = [("P", 0, float(i), 0.0, 0.0, 0.0, 2) for i in range(30)] + \
           [("P", 1, 30.0 + i, 0.0, 0.0, 0.0, 2) for i in range(12)]
    df = _epoch_rows(spark, rows)
    full = E.assemble_epochs(df, n=30, require_full=True)
    assert [r["epoch"] for r in full.collect()] == [0]
    rep = E.dropped_short_epochs(E.assemble_epochs(df, n=30), 30).first()
    assert (rep["short_epochs"], rep["dropped_samples"]) == (1, 12)


def test_argmax_first_max_and_nan(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5],), ([float("nan"), 1.0, 2.0],)], "s array<double>")
    assert [r[0] for r in df.select(argmax("s")).collect()] == [1, 0]


def test_one_hot_and_softmax(spark):
    df = spark.createDataFrame([(2, [1.0, 2.0, 3.0])], "label int, s array<double>")
    row = df.select(one_hot("label", 5).alias("oh"), softmax("s").alias("p")).first()
    assert row["oh"] == [0.0, 0.0, 1.0, 0.0, 0.0]
    e = [math.exp(x - 3.0) for x in (1.0, 2.0, 3.0)]
    assert all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(row["p"], e))


def test_shuffled_input_gives_same_epochs(spark):
    rows = [("P", i // 4, float(i), float(i), float(-i), 0.0, i % 3) for i in range(40)]
    a = E.assemble_epochs(_epoch_rows(spark, rows), n=4).orderBy("epoch").collect()
    b = E.assemble_epochs(_epoch_rows(spark, rows[::-1]).repartition(7), n=4).orderBy("epoch").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_epoch_order_survives_float32_seconds(spark):
    """From 131,072 s on, 0.01 s steps collide in float32: the sample number orders them."""
    base = 14_000_000
    rows = [("p", 0, base + i, float(base + i) / 100, float(i % 7), 0.0, 0.0, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "patient string, epoch int, timestep int, time float, fpzcz float, pzoz float, horizontal float, label int")
    from sigframe.operators.epochs import assemble_epochs
    got = assemble_epochs(df.repartition(7), n=200).first()
    assert list(got["fpzcz"]) == [float(i % 7) for i in range(200)]
