"""Decisions D1-D5, D19 and the preprocessing operators on literal rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigframe.operators import ordering as O
from sigframe.operators import prep as P
from sigframe.functions.keys import composite_key


def test_null_key_does_not_match(spark):
    data = spark.createDataFrame([(None, 5, 1.0)], "patient string, timestep int, fpzcz float")
    lab = spark.createDataFrame([(None, 5, 2)], "patient string, timestep int, label int")
    assert P.label_join(data, lab).count() == 0


def test_ambiguous_string_key_does_not_match_on_typed_pair(spark):
    data = spark.createDataFrame([("a", "b_c")], "patient string, timestep string")
    lab = spark.createDataFrame([("a_b", "c", 1)], "patient string, timestep string, label int")
    keys = data.select(composite_key("patient", "timestep").alias("k")).first()["k"]
    assert keys == "a_b_c"  # the string keys collide ...
    assert P.label_join(data, lab).count() == 0  # ... the typed join does not


def test_bad_number_becomes_null_or_raises(spark):
    df = spark.createDataFrame([("x",), ("1.5",)], "fpzcz string")
    vals = [r["fpzcz"] for r in P.typed(df, {"fpzcz": "float"}).collect()]
    assert vals == [None, 1.5]
    with pytest.raises(PySparkException):
        P.typed(df, {"fpzcz": "float"}, strict=True).collect()


def test_unknown_stage_modes(spark):
    rows = [("Sleep stage ?",), ("Movement time",), (None,), ("Sleep stage 4",)]
    df = spark.createDataFrame(rows, "condition string")
    assert [r["label"] for r in P.label_stages(df, "drop").collect()] == [3]
    assert [r["label"] for r in P.label_stages(df, "keep").collect()] == [-1, -1, -1, 3]
    with pytest.raises(PySparkException):
        P.label_stages(df, "error").collect()
    ok = df.filter(F.col("condition") == "Sleep stage 4")
    assert P.label_stages(ok, "error").first()["label"] == 3


def test_numeric_and_lexicographic_sort(spark):
    df = spark.createDataFrame([("P", 10), ("P", 2), ("P", 1)], "patient string, timestep int")
    num = O.sort_with_ordinal(df, ["patient"], ["timestep"]).collect()
    assert [r["timestep"] for r in num] == [1, 2, 10]
    keyed = df.select(composite_key("patient", "timestep").alias("k"))
    lex = O.sort_with_ordinal(keyed, [], ["k"]).collect()
    assert [r["k"] for r in lex] == ["P_1", "P_10", "P_2"]
    assert [r["ord"] for r in lex] == [0, 1, 2]


def test_epoch_edges(spark):
    df = spark.createDataFrame([(t,) for t in (0, 2999, 3000, 5999, 6000)], "timestep int")
    assert [r["epoch"] for r in P.tumbling_epoch(df, 3000).collect()] == [0, 0, 1, 1, 2]
    assert dict(P.tumbling_epoch(df, 3000).dtypes)["epoch"] == "bigint"


def test_duplicate_label_multiplies_rows(spark):
    data = spark.createDataFrame([("P", 1, 0.5)], "patient string, timestep int, fpzcz float")
    lab = spark.createDataFrame([("P", 1, 0), ("P", 1, 2)], "patient string, timestep int, label int")
    assert P.label_join(data, lab).count() == 2
    assert P.label_join(data, lab, n=3000).count() == 2


def test_co_partitioned_join_equals_plain_join(spark):
    data = spark.createDataFrame([("P", t, float(t)) for t in range(20)], "patient string, timestep int, fpzcz float")
    lab = spark.createDataFrame([("P", t, t % 5) for t in range(0, 20, 2)], "patient string, timestep int, label int")
    a = sorted(tuple(r) for r in P.label_join(data, lab).select("timestep", "label").collect())
    b = sorted(tuple(r) for r in P.label_join(data, lab, n=4).select("timestep", "label").collect())
    assert a == b and len(a) == 10


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 200, 70000, 3.5)], "a bigint, b bigint, c bigint, d double")
    types = dict(P.narrow_types(df).dtypes)
    assert types == {"a": "tinyint", "b": "smallint", "c": "int", "d": "float"}


def test_known_stage_dim_keeps_mapped_rows(spark):
    df = spark.createDataFrame([("Sleep stage W",), ("Sleep stage ?",)], "condition string")
    assert [r["label"] for r in P.keep_known_stages(df).collect()] == [0]


def test_pair_join_concatenates(spark):
    a = spark.createDataFrame([("k", [1.0, 2.0])], "key string, values array<double>")
    b = spark.createDataFrame([("k", [3.0])], "key string, values array<double>")
    assert P.pair_join(a, b).first()["values"] == [1.0, 2.0, 3.0]
