"""Tree cover of intervals, stored moments, and text scans with a header per file."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sigframe.operators import intervals as IV
from sigframe.operators import scale as S
from sigframe.session import scratch_path
from sigframe.sources.csv import read_text_split


def _mixed(n=150):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        start = rnd.uniform(-5000, 100_000)
        rows.append((f"P{i % 3}", i, start, start + rnd.choice([0.0, 0.3, 1.0, 30.0, 90.5, 3600.0, 86_400.0, -2.0])))
    return rows + [("P0", 900, 16.0, 32.0), ("P0", 901, 0.0, 256.0), (None, 902, 0.0, 9.0), ("P1", 903, None, 4.0)]


@pytest.mark.parametrize("longest", [None, 100.0])
def test_intervals_of_any_length_equal_brute_force(spark, longest):
    rnd = random.Random(5)
    iv = _mixed()
    points = [(f"P{i % 4}", i, rnd.choice([rnd.uniform(-6000, 190_000), float(rnd.randrange(0, 300))])) for i in range(400)] + [("P0", 1000, 16.0), ("P0", 1001, 32.0), ("P0", 1002, None)]
    got = IV.interval_join_any(spark.createDataFrame(points, "patient string, s int, t double"),
                               spark.createDataFrame(iv, "patient string, i int, start double, end double"), longest=longest)
    assert got.columns == ["patient", "s", "t", "i", "start", "end"]
    want = sorted((s, i) for p, s, t in points for q, i, a, b in iv if p == q and t is not None and a is not None and a <= t < b)
    assert sorted((r["s"], r["i"]) for r in got.collect()) == want and len(want) > 100


def test_copies_of_an_interval_grow_with_the_logarithm(spark):
    lengths = [1, 30, 3600, 86_400, 10_000_000]
    df = spark.createDataFrame([(n, 12_345.5, 12_345.5 + n) for n in lengths], "n long, start double, end double")
    cover = IV.dyadic_cover(df, "start", "end", 1.0, levels=7)
    copies = {r["n"]: r["count"] for r in cover.groupBy("n").count().collect()}
    for n in lengths:
        assert copies[n] <= 2 * (IV.FANOUT - 1) * (math.log(n, IV.FANOUT) + 1) + 2
    leaves = F.sum(F.pow(F.lit(IV.FANOUT), "_sf_level")).cast("long").alias("leaves")
    assert {r["n"]: r["leaves"] for r in cover.groupBy("n").agg(leaves).collect()} == {n: n + 1 for n in lengths}  # each leaf once


def test_moments_merge_and_leave_out(spark):
    rnd = random.Random(6)
    rows = [(f"p{i % 5}", 1e6 + rnd.gauss(0, 1) if i % 11 else None, float(i % 5)) for i in range(400)] + [("none", None, 2.0)]
    parts = S.moments(spark.createDataFrame(rows, "patient string, a double, b double"), cols=["a", "b"])
    for c, at in (("a", 1), ("b", 2)):
        values = [r[at] for r in rows if r[at] is not None]
        all_ = S.merge_moments(parts, cols=["a", "b"]).first()
        assert all_[f"{c}_n"] == len(values) and abs(all_[f"{c}_mean"] - statistics.fmean(values)) < 1e-6
        assert abs(all_[f"{c}_m2"] / len(values) - statistics.pvariance(values)) < 1e-6
        for r in S.leave_one_out(parts, cols=["a", "b"]).collect():
            rest = [x[at] for x in rows if x[at] is not None and x[0] != r["patient"]]
            assert r[f"{c}_n"] == len(rest) and abs(r[f"{c}_mean"] - statistics.fmean(rest)) < 1e-6
            assert abs(r[f"{c}_std_pop"] - statistics.pstdev(rest)) < 1e-6
    held = S.merge_moments(parts.withColumn("side", F.when(F.col("patient") == "p1", "test").otherwise("train")), ["side"], ["a", "b"])
    assert {r["side"]: r["b_n"] for r in held.collect()} == {"test": 80, "train": 321}


def test_every_file_has_its_own_header(spark):
    path = scratch_path(spark, "headers-" + str(random.random()))
    spark.createDataFrame([("a|b|c",), ("1|2|3",), ("a|b|c",), ("x|y|z",)], "value string").coalesce(1).write.text(path + "/one")
    spark.createDataFrame([("x|y|z",), ("4|5|6",), ("",), ("a|b|c",)], "value string").coalesce(1).write.text(path + "/two")
    got = read_text_split(spark, path + "/*", sep="|")
    assert sorted(r["fields"] for r in got.collect()) == [[""], ["1", "2", "3"], ["4", "5", "6"], ["a", "b", "c"], ["x", "y", "z"]]
    assert sorted(r["fields"] for r in read_text_split(spark, path + "/two", sep="|", drop_header=False).collect())[-1] == ["x", "y", "z"]


@pytest.mark.parametrize("at", [12_345.5, -700.0, 0.0])
def test_an_interval_of_the_join_has_few_nodes(spark, at):
    lengths = [0.25, 1.0, 7.0, 30.0, 999.0, 3600.0, 86_400.0, 1e6, 1e7]
    df = spark.createDataFrame([(n, at, at + n) for n in lengths], "n double, start double, end double")
    size = F.pow(F.lit(IV.FANOUT), "_sf_level")
    nodes = IV.dyadic_cover(df, "start", "end", 1.0, levels=7, grain=IV.GRAIN).groupBy("n").agg(
        F.count("*").alias("nodes"), F.max(size).alias("longest"), F.sum(size).alias("leaves"),
        F.min(F.col("_sf_node") * size).alias("lo"), F.max((F.col("_sf_node") + 1) * size).alias("hi"))
    got = {r["n"]: r for r in nodes.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["nodes"] <= IV.FANOUT / IV.GRAIN + 2
        assert r["lo"] <= at and at + n <= r["hi"] and r["leaves"] == r["hi"] - r["lo"]  # without a gap or a node twice
        assert r["longest"] <= max(1.0, IV.FANOUT * n)


def test_the_join_moves_few_copies_of_its_intervals(spark):
    iv = spark.range(200).select(F.lit("P").alias("patient"), "id", (F.col("id") * 977.3).alias("start"), (F.col("id") * 977.3 + 26_000.0).alias("end"))
    points = spark.range(400).select(F.lit("P").alias("patient"), F.col("id").alias("s"), (F.col("id") * 531.7).alias("t"))
    seen = []
    cover = IV.dyadic_cover

    def watched(*args, **named):
        out = cover(*args, **named)
        seen.append(out.count())
        return out
    with pytest.MonkeyPatch.context() as m:
        m.setattr(IV, "dyadic_cover", watched)
        got = IV.interval_join_any(points, iv, unit=60.0, longest=30 * 86400.0).select("s", "id").collect()
    assert sorted(map(tuple, got)) == [(s, i) for s in range(400) for i in range(200) if i * 977.3 <= s * 531.7 < i * 977.3 + 26_000.0]
    assert seen[0] <= 200 * 5


def test_overlapping_labels_copy_pieces_and_annotations_a_few_times(spark, monkeypatch):
    from sigframe.plans.queries import QUERIES
    seen, cover = [], IV.dyadic_cover

    def watched(intervals, *args, **named):
        out = cover(intervals, *args, **named)
        seen.append((intervals.count(), out.count()))
        return out
    monkeypatch.setattr(IV, "dyadic_cover", watched)
    assert QUERIES["label_overlapping"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 2 and all(0 < n <= copies <= 6 * n for n, copies in seen), seen


def test_intervals_of_any_length_have_two_nodes_on_average(spark):
    lengths = [1.7 ** i for i in range(2, 28)]
    df = spark.createDataFrame([(n, at, at + n) for n in lengths for at in (0.0, 12_345.5, 99_999.9)], "n double, start double, end double")
    copies = IV.dyadic_cover(df, "start", "end", 1.0, levels=6, grain=IV.GRAIN).count()
    assert len(lengths) * 3 <= copies <= 2 * len(lengths) * 3
