"""ordered_index equals row_number(), for tables of one range and (forced here with a small
rows_per_bucket) of many."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigframe.operators import ordering
from sigframe.operators.ordering import ordered_index, quantile_sketch


@pytest.fixture(scope="module")
def events(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "ts", "user_id", "value")
    return ev.withColumn("name", F.format_string("%07.2f-%d", "value", "event_id"))


def _mismatches(df, keys, order_cols, desc, **kw):
    idx = ordered_index(df, keys, order_cols, out="i", descending=desc, **kw)
    o = [F.col(c).desc() if desc else F.col(c).asc() for c in order_cols]
    w = Window.partitionBy(*keys).orderBy(*o) if keys else Window.orderBy(*o)
    ref = df.withColumn("j", F.row_number().over(w) - 1)
    return idx.join(ref.select("event_id", "j"), "event_id").filter(F.col("i") != F.col("j")).count()


@pytest.mark.parametrize("rows_per_bucket", [2_000_000, 40])
@pytest.mark.parametrize("desc", [False, True])
def test_per_key_timestamp_order(events, rows_per_bucket, desc):
    assert _mismatches(events, ["user_id"], ["ts", "event_id"], desc, rows_per_bucket=rows_per_bucket) == 0


@pytest.mark.parametrize("rows_per_bucket", [2_000_000, 300])
def test_global_string_order(events, rows_per_bucket):
    assert _mismatches(events, [], ["name", "event_id"], False, rows_per_bucket=rows_per_bucket) == 0


def test_global_double_order_with_nulls(spark):
    rows = [(i, None if i % 9 == 0 else float((i * 37) % 101)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, v double")
    for desc in (False, True):
        assert _mismatches(df, [], ["v", "event_id"], desc, rows_per_bucket=50) == 0


def test_only_hot_keys_are_split(events):
    # one key holds a third of the rows; with 400 rows per bucket only it is split
    mixed = events.withColumn("user_id", F.when(F.col("user_id") < 50, F.lit(-1)).otherwise(F.col("user_id")))
    for desc in (False, True):
        assert _mismatches(mixed, ["user_id"], ["ts", "event_id"], desc, rows_per_bucket=400) == 0


@pytest.mark.parametrize("rows_per_bucket", [2_000_000, 40])
def test_group_size_output(events, rows_per_bucket):
    idx = ordered_index(events, ["user_id"], ["ts", "event_id"], out="i", count_out="n",
                        rows_per_bucket=rows_per_bucket)
    ref = events.groupBy("user_id").count()
    bad = idx.join(ref, "user_id").filter((F.col("n") != F.col("count")) | (F.col("i") >= F.col("n"))).count()
    assert bad == 0


def test_nth_in_group_from_both_ends(spark):
    from sigframe.operators.ordering import nth_in_group
    df = spark.createDataFrame([("a", t) for t in (5, 1, 9, 3)] + [("b", 7)], "k string, t int")
    second = {r["k"]: r["t"] for r in nth_in_group(df, "k", ["t"], 1).collect()}
    last = {r["k"]: r["t"] for r in nth_in_group(df, "k", ["t"], 0, from_end=True).collect()}
    assert second == {"a": 3} and last == {"a": 9, "b": 7}


@pytest.mark.parametrize("desc", [False, True])
def test_hot_group_of_copies(spark, desc):
    # a third of the rows are copies of one timestamp in one recording
    rows = [("hot", 0, i) for i in range(300)] + [("hot", 1 + i % 7, 300 + i) for i in range(300)] + \
           [(f"k{i % 30}", i % 11, 600 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts int, event_id int")
    assert _mismatches(df, ["k"], ["ts", "event_id"], desc, rows_per_bucket=25) == 0


def test_global_order_with_ties_and_nulls(spark):
    rows = [(None if i % 13 == 0 else i % 3, None if i % 7 == 0 else i % 5, i) for i in range(500)]
    df = spark.createDataFrame(rows, "ts int, w int, event_id int")
    for desc in (False, True):
        assert _mismatches(df, [], ["ts", "w", "event_id"], desc, rows_per_bucket=20) == 0


def test_nulls_next_to_one_value_split_correctly(spark):
    # the second order column holds NULLs and a single value inside a hot group
    rows = [("hot", 0, None, 0), ("hot", 0, None, 1), ("hot", 0, None, 2), ("hot", 0, 0, 3), ("hot", 0, None, 4)]
    df = spark.createDataFrame(rows, "k string, v int, w int, event_id int")
    for desc in (False, True):
        assert _mismatches(df, ["k"], ["v", "w", "event_id"], desc, rows_per_bucket=4) == 0


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("column", ["name", "big", "dec", "num"])
def test_values_that_look_alike_as_doubles_or_prefixes(spark, column, desc):
    """Names sharing eight bytes, BIGINT beyond 2^53, long decimals, NaN, infinities and NULLs."""
    odd = {0: float("nan"), 1: float("inf"), 2: float("-inf"), 3: None}
    rows = [(i, f"ST7011J0_{(i * 37) % 600:06d}", 9_007_199_254_740_993 + (i * 37) % 600, float(odd.get(i % 40, (i * 37) % 101)) if odd.get(i % 40, 0) is not None else None)
            for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, name string, big long, num double")
    df = df.withColumn("dec", F.expr("cast('12345678901234567890.000' as decimal(38,3)) + cast(pmod(event_id * 37, 600) as decimal(10,3)) / 1000"))
    assert _mismatches(df, [], [column, "event_id"], desc, rows_per_bucket=50) == 0


def test_equal_rows_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("a", 2)] * 50, "k string, v long")
    idx = ordered_index(df, ["k"], ["v"], out="i", rows_per_bucket=5)
    assert sorted(r["i"] for r in idx.collect()) == list(range(100))
    assert {r["v"] for r in idx.filter("i < 50").collect()} == {1}


def test_sketch_is_bounded_and_merges(spark, monkeypatch):
    """Borders lie about ``rows_per_bucket`` rows apart, and never number more than the slots allow."""
    df = spark.range(20000).selectExpr("struct(id as k) as t")
    borders = quantile_sketch(df.repartition(7), "t", 1000).first()[0]
    assert borders == quantile_sketch(df.coalesce(1), "t", 1000).first()[0]  # however the rows are dealt
    at = [b["k"] for b in borders]
    assert at == sorted(at) and 10 <= len(at) <= 30 and max(b - a for a, b in zip([0, *at], [*at, 20000])) < 4000
    monkeypatch.setattr(ordering, "SLOTS", 64)
    few = [b["k"] for b in quantile_sketch(df, "t", 8).first()[0]]
    assert len(few) == 64 // ordering.SAMPLES and max(b - a for a, b in zip([0, *few], [*few, 20000])) < 10000


@pytest.mark.parametrize("desc", [False, True])
def test_a_key_over_many_ranges_and_many_keys_in_one(spark, desc):
    rows = [("big", i % 977, i) for i in range(2000)] + [(f"k{i % 300:03d}", i, 2000 + i) for i in range(900)] + [(None, i, 3000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts int, event_id int")
    got = ordered_index(df, ["k"], ["ts", "event_id"], out="i", descending=desc, rows_per_bucket=100, count_out="n")
    o = [F.col(c).desc() if desc else F.col(c) for c in ("ts", "event_id")]
    want = df.select("event_id", (F.row_number().over(Window.partitionBy("k").orderBy(*o)) - 1).alias("i"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    key = lambda d: {r["event_id"]: (r["i"], r["n"]) for r in d.collect()}
    assert key(got) == key(want)
