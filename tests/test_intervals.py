"""Annotation chunks, interval join edges and cropping (WIN-2, JN-3, FLT-7, D11)."""

from pyspark.sql import functions as F

from sigframe.operators import intervals as IV

ANN = "patient string, onset double, duration double, description string"


def test_chunk_counts(spark):
    ann = spark.createDataFrame([("P", 0.0, d, "Sleep stage W") for d in (0.0, 29.9, 30.0, 65.0)], ANN)
    got = IV.annotation_chunks(ann, 30.0).groupBy("duration").count().collect()
    assert {r["duration"]: r["count"] for r in got} == {30.0: 1, 65.0: 2}
    onsets = sorted(r["chunk_onset"] for r in IV.annotation_chunks(ann, 30.0).filter("duration = 65").collect())
    assert onsets == [0.0, 30.0]


def test_interval_edges(spark):
    chunks = spark.createDataFrame([("P", 10.0, "Sleep stage 2")], "patient string, chunk_onset double, condition string")
    samples = spark.createDataFrame([("P", t) for t in (9.99, 10.0, 39.99, 40.0)], "patient string, t double")
    got = sorted(r["t"] for r in IV.interval_join(samples, chunks, length=30.0).collect())
    assert got == [10.0, 39.99]


def test_interval_join_equals_inequality_join(spark):
    ann = spark.createDataFrame([("P", 0.0, 95.0, "a"), ("P", 100.0, 61.0, "b"), ("Q", 5.0, 30.0, "c")], ANN)
    samples = spark.createDataFrame([(p, float(t)) for p in ("P", "Q") for t in range(0, 200, 7)],
                                    "patient string, t double")
    got = sorted((r["patient"], r["t"], r["condition"]) for r in IV.label_samples_by_chunks(samples, ann).collect())
    chunks = IV.annotation_chunks(ann, 30.0).collect()
    brute = sorted((s["patient"], s["t"], c["description"]) for s in samples.collect() for c in chunks
                   if s["patient"] == c["patient"] and c["chunk_onset"] <= s["t"] < c["chunk_onset"] + 30.0)
    assert got == brute and len(got) > 0


def test_variable_length_intervals(spark):
    iv = spark.createDataFrame([("P", 0.0, 250.0), ("P", 240.0, 260.0)], "patient string, s double, e double")
    samples = spark.createDataFrame([("P", float(t)) for t in (0, 100, 245, 255, 300)], "patient string, t double")
    got = sorted((r["t"], r["s"]) for r in IV.interval_join(samples, iv, start="s", end="e", length=None,
                                                           bucket=50.0).collect())
    assert got == [(0.0, 0.0), (100.0, 0.0), (245.0, 0.0), (245.0, 240.0), (255.0, 240.0)]


def _crop_rows(extra=()):
    rows = [("P", 0.0, 1000.0, "Sleep stage W"), ("P", 1000.0, 300.0, "Sleep stage 1"),
            ("P", 1300.0, 300.0, "Sleep stage 2"), ("P", 1600.0, 3400.0, "Sleep stage W")]
    return rows + list(extra)


def test_crop(spark):
    out = IV.crop_annotations(spark.createDataFrame(_crop_rows(), ANN)).orderBy("onset").collect()
    assert (out[0]["crop_lo"], out[0]["crop_hi"]) == (400.0, 2200.0)
    assert [(r["onset"], r["duration"]) for r in out] == [(400.0, 600.0), (1000.0, 300.0), (1300.0, 300.0),
                                                         (1600.0, 600.0)]


def test_crop_last_row_not_wake(spark):
    rows = _crop_rows([("P", 5000.0, 30.0, "Sleep stage ?")])
    b = IV.crop_bounds(spark.createDataFrame(rows, ANN)).first()
    assert (b["crop_lo"], b["crop_hi"]) == (400.0, 2200.0)


def test_recording_with_one_annotation_vanishes(spark):
    ann = spark.createDataFrame([("Q", 0.0, 10.0, "Sleep stage W")], ANN)
    assert IV.crop_annotations(ann).count() == 0
    assert IV.crop_bounds(ann).filter(F.col("crop_lo").isNotNull()).count() == 0


def test_recording_tables(spark):
    """Only samples inside chunks of the cropped annotations are labelled and numbered."""
    ann = spark.createDataFrame([("P", 0.0, 1000.0, "W"), ("P", 1000.0, 60.0, "1"), ("P", 1060.0, 45.0, "2"),
                                 ("P", 1105.0, 5000.0, "W")],
                                "patient string, onset double, duration double, description string")
    samples = spark.createDataFrame([("P", float(t), float(t) / 2) for t in range(0, 6200, 5)],
                                    "patient string, t double, x double")
    got = IV.recording_tables(samples, ann, ["x"], chunk=30.0).orderBy("timestep").collect()
    # cropped: 400..1000 W, 1000..1060 1, 1060..1105 2 (one whole chunk), 1105..1705 W
    want = []
    for lo, hi, name in ((400, 1000, "W"), (1000, 1060, "1"), (1060, 1090, "2"), (1105, 1705, "W")):
        want += [(t, name, (t - lo) % 30) for t in range(0, 6200, 5) if lo <= t < hi]
    assert [r["timestep"] for r in got] == list(range(len(want)))
    assert [(2 * r["x"], r["condition"], r["time"]) for r in got] == want


def test_epoch_seconds(spark):
    df = spark.createDataFrame([(0,), (250,), (None,)], "timestep int")
    got = [(r["t_start"], r["t_end"]) for r in IV.epoch_seconds(df).orderBy(F.col("timestep").asc_nulls_last()).collect()]
    assert [got[0], got[2]] == [(0.0, 29.99), (None, None)]
    assert got[1][0] == 2.5 and abs(got[1][1] - 32.49) < 1e-9


def test_landmarks_equal_brute_force(spark):
    """Ends of every recording in one scan, with ties, nulls and recordings of one row."""
    import random
    rng = random.Random(6)
    pick = lambda *x: rng.choice([None, *x])
    rows = [(rng.choice(["P", "P", "P", "Q", "R"]), pick(0.0, 1.0, 2.0, 3.0), pick(5.0, 6.0), pick("W", "1")) for _ in range(60)]
    rows += [("one", 4.0, 1.0, "W"), (None, 1.0, 1.0, "a"), (None, 2.0, 1.0, "b")]
    got = IV.annotation_landmarks(spark.createDataFrame(rows, ANN).repartition(7)).collect()
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:3]) + ((r[3] is not None, r[3] or ""),)
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=order)
        second, before = (own[1], own[-2]) if len(own) > 1 else ([None] * 4,) * 2
        want[key] = (second[1], second[3], own[-1][1], own[-1][3], before[1])
    assert {r[0]: tuple(r)[1:] for r in got} == want
