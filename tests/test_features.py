"""Strided signal features (SIG-1..SIG-4)."""

import pytest

from sigframe.operators import features as SIG

ROWS = "patient string, epoch long, pos int, x double"


def _series(spark, values):
    return spark.createDataFrame([("P", 0, i, float(v)) for i, v in enumerate(values)], ROWS)


def test_strided_max(spark):
    out = SIG.strided_max(_series(spark, range(1, 11)), ["x"], pool=4, length=10).orderBy("out_pos").collect()
    assert [r["x"] for r in out] == [3.0, 7.0, 10.0]


def test_strided_fir(spark):
    out = SIG.strided_fir(_series(spark, [1, 2, 3, 4]), ["x"], [1.0, 1.0, 1.0], 1, 4).orderBy("out_pos").collect()
    assert [r["x"] for r in out] == [3.0, 6.0, 9.0, 7.0]


def test_strided_fir_matches_direct_formula(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=37)
    taps = [0.2, -0.5, 1.0, 0.3, 0.1, -0.2]
    stride = 3
    out_len, pad = SIG.same_padding(len(x), len(taps), stride)
    want = []
    for o in range(out_len):
        acc = 0.0
        for j, w in enumerate(taps):
            i = o * stride + j - pad
            if 0 <= i < len(x):
                acc += w * x[i]
        want.append(acc)
    got = SIG.strided_fir(_series(spark, x), ["x"], taps, stride, len(x)).orderBy("out_pos").collect()
    assert [r["out_pos"] for r in got] == list(range(out_len))
    assert max(abs(r["x"] - w) for r, w in zip(got, want)) < 1e-12


def test_layernorm_row(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    r = SIG.row_layernorm(df, ["a", "b", "c"]).first()
    assert abs(r["a_ln"] + 1.2247) < 1e-3 and abs(r["b_ln"]) < 1e-12


def test_strided_outputs_are_dense(spark):
    df = spark.createDataFrame([("P", 0, 0, 5.0), ("P", 1, 9, 2.0)], ROWS)
    got = {(r["epoch"], r["out_pos"]): r["x"] for r in SIG.strided_max(df, ["x"], pool=4, length=10).collect()}
    assert got == {(0, 0): 5.0, (0, 1): None, (0, 2): None, (1, 0): None, (1, 1): None, (1, 2): 2.0}
    got = {(r["epoch"], r["out_pos"]): r["x"] for r in SIG.strided_fir(df, ["x"], [1.0], 4, 10).collect()}
    assert got == {(0, 0): 5.0, (0, 1): 0.0, (0, 2): 0.0, (1, 0): 0.0, (1, 1): 0.0, (1, 2): 0.0}


@pytest.mark.parametrize("pos", [-1, 4, None])
def test_position_outside_the_epoch_is_an_error(spark, pos):
    df = spark.createDataFrame([("P", 0, pos, 1.0)], ROWS)
    for out in (SIG.strided_max(df, ["x"], 2, 4), SIG.strided_fir(df, ["x"], [1.0], 2, 4)):
        with pytest.raises(Exception, match="position outside"):
            out.collect()
