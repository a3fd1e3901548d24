"""Scaling and splitting (D8, D9, D10, D17, SPL-1..3)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sigframe.operators import scale as S
from sigframe.operators import split as SP


def test_scaling_modes(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "x double, k double")
    so = S.ChannelScaler(["x", "k"], "scale_only").fit(df).transform(df).orderBy("x").collect()
    assert [r["x"] for r in so] == [1.0, 2.0, 3.0] and [r["k"] for r in so] == [0.0, 0.0, 0.0]
    zs = S.ChannelScaler(["x", "k"], "zscore_pop").fit(df).transform(df).orderBy("x").collect()
    assert [round(r["x"], 4) for r in zs] == [-1.2247, 0.0, 1.2247] and [r["k"] for r in zs] == [0.0] * 3


def test_scaler_fitted_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    test = spark.createDataFrame([(1e9,)], "x double")
    tr, te = S.scale_channels(train, [test], cols=["x"], mode="zscore_pop", scope="train")
    assert [round(r["x"], 4) for r in tr.orderBy("x").collect()] == [-1.2247, 0.0, 1.2247]
    leaky, _ = S.scale_channels(train, [test], cols=["x"], mode="zscore_pop", scope="all")
    assert round(leaky.orderBy("x").first()["x"], 4) != -1.2247


def test_ml_scaler_matches_std_only(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 5.0), (3.0, 2.0, None)],
                               "fpzcz double, pzoz double, horizontal double")
    out = S.ml_scaled_channels(df).orderBy("fpzcz").collect()
    assert len(out) == 2  # the row with a NULL channel is skipped
    assert abs(out[0]["scaled_fpzcz"] - 1.0 / 0.70710678) < 1e-5


def test_holdout_by_person_keeps_both_nights_together(spark):
    ids = ["ST7011J0", "ST7012J0", "ST7021J0", "ST7022J0"]
    df = spark.createDataFrame([(p, t) for p in ids for t in range(5)], "patient string, timestep int")
    for seed in range(5):
        train, test = SP.holdout_split(df, 1, seed, unit="person")
        tp = {r["patient"] for r in test.select("patient").distinct().collect()}
        rp = {r["patient"] for r in train.select("patient").distinct().collect()}
        assert tp in ({"ST7011J0", "ST7012J0"}, {"ST7021J0", "ST7022J0"})
        assert not tp & rp and train.count() + test.count() == df.count()


def test_split_independent_of_partitioning(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    a_tr, a_te = SP.hash_split(df, "k", 0.2, seed=3)
    b_tr, b_te = SP.hash_split(df.repartition(13), "k", 0.2, seed=3)
    ka = {r["k"] for r in a_te.collect()}
    assert ka == {r["k"] for r in b_te.collect()}
    assert not ka & {r["k"] for r in a_tr.collect()}
    assert 300 < len(ka) < 500


def test_three_way_split_complete(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    counts = {r["split"]: r["count"] for r in SP.hash_split_3way(df, "k", 0.1, 0.2, 1).groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000 and set(counts) == {"train", "val", "test"}
    assert 150 < counts["val"] < 450


def test_pick_holdout_is_seeded(spark):
    df = spark.createDataFrame([(f"R{i}",) for i in range(50)], "patient string")
    a = [r[0] for r in SP.pick_holdout(df, 8, 42).collect()]
    b = [r[0] for r in SP.pick_holdout(df.repartition(5), 8, 42).collect()]
    assert a == b and len(set(a)) == 8


def test_exact_split_size(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("k"))
    for per_bucket in (2_000_000, 50):
        import sigframe.operators.ordering as O
        old = O.ROWS_PER_BUCKET
        O.ROWS_PER_BUCKET = per_bucket
        try:
            train, test = SP.hash_split(df, "k", 0.2, seed=5, exact=True)
            kt = {r["k"] for r in test.collect()}
            want = sorted((hashlib.md5(f"{i}5".encode()).hexdigest(), str(i)) for i in range(1001))[:200]
            assert kt == {k for _, k in want} and train.count() == 801
            assert not kt & {r["k"] for r in train.collect()}
        finally:
            O.ROWS_PER_BUCKET = old


def test_tags_agree_with_pairs(spark):
    rows = [(f"ST7{p:02d}{n}", i, float(p + i)) for p in range(10) for n in (1, 2) for i in range(3)] + [(None, 0, 1.0)]
    df = spark.createDataFrame(rows, "patient string, i int, fpzcz double")
    tagged = SP.tag_holdout(df, 3, 7).cache()
    train, test = SP.holdout_split(df, 3, 7)
    for side, want in (("train", train), ("test", test)):
        got = tagged.filter(f"side = '{side}'").drop("side")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["patient"][:5] for r in test.collect()} == {r["patient"][:5] for r in tagged.filter("side = 'test'").collect()}
    assert len({r["patient"][:5] for r in test.collect()}) == 3
    whole = {r["side"]: r["n"] for r in SP.tag_split(df, "i", 0.5, 1).groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert sum(whole.values()) == len(rows)


def test_scale_tagged_fits_on_training_rows(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("test", 7.0)], "side string, x double")
    assert [r["x"] for r in S.scale_tagged(df, cols=["x"], mode="zscore_pop").orderBy("x").collect()] == [-1.0, 1.0, 5.0]


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 0.777, 1.0])
def test_exact_split_is_the_smallest_hashes(spark, fraction):
    keys = [f"r{i}" for i in range(997)] + ["r1"] * 5 + [None] * 3
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v int").repartition(6)
    got = {r["v"]: r["side"] for r in SP.tag_split_exact(df, "k", fraction, 7).collect()}
    n = int(len(keys) * fraction + 0.5)
    assert sum(s == "test" for s in got.values()) == n and len(got) == len(keys)
    h = [hashlib.md5(f"{k}7".encode()).hexdigest() if k else "0" * 32 for k in keys]
    inside = [h[v] for v, s in got.items() if s == "test"]
    assert all(a <= b for a in [max(inside, default="")] for b in [h[v] for v, s in got.items() if s == "train"])


def test_exact_split_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([("a", 1)] * 10, "k string, v int")
    assert sorted(r["side"] for r in SP.tag_split_exact(same, "k", 0.25, 1).collect()) == ["test"] * 3 + ["train"] * 7
    assert SP.tag_split_exact(same.limit(0), "k", 0.25, 1).collect() == []
