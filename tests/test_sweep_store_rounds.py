"""Disjoint annotations, features in arrays, bucketed tables, observed ranges, kept rounds, and the jobs on them."""

import random
import re
import uuid

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sigframe.operators import array_features as AF
from sigframe.operators import features as SIG
from sigframe.operators import intervals as IV
from sigframe.operators import model as M
from sigframe.operators import ordering
from sigframe.operators import prep as P
from sigframe.operators import sweep as SW
from sigframe.operators.epochs import assemble_epochs
from sigframe.plans.jobs import generate_job, main, text_preprocess_job, train_job
from sigframe.session import scratch_path
from sigframe.sources import bucketed as BK
from sigframe.sources.csv import write_csv
from tests.synthetic import recordings


def _root(spark):
    return scratch_path(spark, f"sigframe-test-{uuid.uuid4().hex}")


def _owned(rows):
    """Brute force: the owner of every stretch, then adjoining stretches of one owner joined."""
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        iv = {r for r in rows if r[0] == key and r[1] is not None and r[2] is not None and r[1] < r[2]}
        points = sorted({p for r in iv for p in r[1:3]})
        for lo, hi in zip(points, points[1:]):
            over = [r for r in iv if r[1] <= lo < r[2]]
            if not over:
                continue
            best = max(over, key=lambda r: (r[1], -r[2], r[3] is not None, r[3] or ""))
            if out and out[-1][0] == key and out[-1][2] == lo and out[-1][3:] == best[1:]:
                out[-1] = (key, out[-1][1], hi, *best[1:])
            else:
                out.append((key, lo, hi, *best[1:]))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_bucket", [None, 16])
def test_disjoint_intervals_equal_brute_force(spark, monkeypatch, rows_per_bucket):
    if rows_per_bucket:  # positions in many ranges, and a hot recording over several of them
        monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows_per_bucket)
    rnd = random.Random(3)
    rows = [(f"P{min(i % 7, 2)}", s := float(rnd.randrange(0, 900)), s + rnd.choice([0.0, 1.0, 7.5, 60.0, 400.0, -3.0]), rnd.choice(["a", "b", None])) for i in range(160)]
    rows += [("P9", 0.0, 100.0, "x"), ("P9", 10.0, 20.0, "y"), ("P9", 10.0, 20.0, "y"), ("P9", 30.0, 40.0, "z"), ("P9", 100.0, 110.0, "x")]
    rows += [(None, 0.0, 9.0, "n"), ("P8", None, 4.0, "n"), ("P8", 4.0, None, "n")]
    df = spark.createDataFrame(rows, "patient string, onset double, `end` double, description string")
    got = SW.disjoint_intervals(df, unit=1.0)
    assert got.columns == ["patient", "onset", "end", "of_start", "of_end", "description"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _owned(rows)


def test_no_sample_is_labelled_twice(spark):
    ann = spark.createDataFrame([("P", 0.0, 120.0, "W"), ("P", 30.0, 60.0, "1"), ("Q", 0.0, 30.0, "R")], "patient string, onset double, duration double, description string")
    points = spark.range(130).select(F.lit("P").alias("patient"), F.col("id").cast("double").alias("t"))
    once = IV.label_samples_by_chunks(points, SW.disjoint_annotations(ann))
    assert {r["condition"]: r["n"] for r in once.groupBy("condition").agg(F.count("*").alias("n")).collect()} == {"W": 60, "1": 60}
    assert once.count() == once.select("t").distinct().count() == 120
    assert IV.label_samples_by_chunks(points, ann).count() == 180  # as asked: every annotation that holds it
    assert SW.disjoint_annotations(ann.limit(0)).count() == 0


@pytest.mark.parametrize("length,pool,taps,stride", [(8, 4, 5, 2), (10, 3, 4, 3), (7, 8, 1, 5), (9, 2, 9, 1)])
def test_array_features_equal_the_long_form(spark, length, pool, taps, stride):
    rnd = random.Random(length)
    rows = [("P", e, p, rnd.choice([None, rnd.uniform(-5, 5)]), rnd.uniform(-5, 5)) for e in range(6) for p in range(length) if rnd.random() < 0.7 or p == e]
    df = spark.createDataFrame(rows, "patient string, epoch int, pos int, a double, b double")
    weights = [rnd.uniform(-1, 1) for _ in range(taps)]
    dense = AF.dense_channels(assemble_epochs(df, order="pos", channels=["pos", "a", "b"], label_rule=None), ["a", "b"], length)

    def places(arrays):
        return {(r["epoch"], i): (a, b) for r in arrays.collect() for i, (a, b) in enumerate(zip(r["a"], r["b"]))}

    def long(rows):
        return {(r["epoch"], r["out_pos"]): (r["a"], r["b"]) for r in rows.collect()}
    assert places(AF.array_strided_max(dense, ["a", "b"], pool, length)) == long(SIG.strided_max(df, ["a", "b"], pool, length))
    got, want = places(AF.array_strided_fir(dense, ["a", "b"], weights, stride, length)), long(SIG.strided_fir(df, ["a", "b"], weights, stride, length))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_array_features_shuffle_once(spark):
    df = spark.createDataFrame([("P", 0, 0, 1.0), ("P", 0, 2, 5.0)], "patient string, epoch int, pos int, a double")
    dense = AF.dense_channels(assemble_epochs(df, order="pos", channels=["pos", "a"], label_rule=None), ["a"], 4)
    assert dense.first()["a"] == [1.0, None, 5.0, None]
    plan = AF.array_strided_fir(AF.array_strided_max(dense, ["a"], 2, 4), ["a"], [1.0], 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Generate" not in plan
    with pytest.raises(Exception, match="position outside"):
        AF.dense_channels(assemble_epochs(df, order="pos", channels=["pos", "a"], label_rule=None), ["a"], 2).collect()


def test_stored_tables_join_and_assemble_without_an_exchange(spark):
    data, labels = recordings(spark, r=2, e=4, n=30)
    typed, known = P.prepare_samples(data), P.label_stages(labels.select("patient", "timestep", "condition"), "drop")
    smp, lab = BK.store_samples(typed, known, f"sigframe_{uuid.uuid4().hex}", _root(spark), 4, 30)
    ep = assemble_epochs(BK.stored_label_join(smp, lab), order="timestep", n=30)
    plan = ep._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = assemble_epochs(P.label_join(typed, known, 30), order="timestep", n=30)
    cols = ["patient", "epoch", "fpzcz", "label_mean"]
    assert sorted(map(str, ep.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_ranges_come_from_the_pass_that_stores(spark):
    runs = spark.sparkContext.accumulator(0)
    schema = "a bigint, b int, e bigint, x double"

    def rows(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b
    df = spark.createDataFrame([(1, 300, None, 1.5), (-128, -5, None, None), (127, None, None, 2.0)], schema).mapInArrow(rows, schema)
    got = P.store_narrow(df, _root(spark))
    assert got.dtypes == [("a", "tinyint"), ("b", "smallint"), ("e", "bigint"), ("x", "float")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 300, None, 1.5), (-128, -5, None, None), (127, None, None, 2.0)], key=str)
    assert runs.value == 3  # the input was computed once
    assert P.store_narrow(spark.createDataFrame([], "a bigint, x double"), _root(spark)).dtypes == [("a", "bigint"), ("x", "float")]
    dotted = P.store_narrow(spark.createDataFrame([(7, 0.5)], "`a.b` bigint, `c.d` double"), _root(spark))
    assert dotted.dtypes == [("a.b", "tinyint"), ("c.d", "float")] and tuple(dotted.first()) == (7, 0.5)
    assert P.store_narrow(spark.createDataFrame([("t",)], "s string"), _root(spark)).first()["s"] == "t"


def _points(spark):
    rnd = random.Random(1)
    rows = [(i % 3, [rnd.gauss(3.0 * (i % 3 == j), 1.0) for j in range(3)]) for i in range(240)]
    df = spark.createDataFrame(rows, "label int, v array<double>").select("label", array_to_vector("v").alias("vectors"), F.monotonically_increasing_id().alias("id"))
    return df.filter("id % 4 != 0").drop("id"), {"val": df.filter("id % 4 = 0").drop("id")}


def test_training_goes_on_after_a_stop(spark):
    train, val = _points(spark)
    one, two = _root(spark), _root(spark)
    assert M.saved_curve(spark, one).count() == 0
    M.train_rounds(train, val, one, 3, 3, rounds=2, iterations=3)
    # stopped inside round 2: a model without measures
    M.load_round(one, 0).write().overwrite().save(f"{one}/model/round=2")
    key = lambda rows: sorted((r["round"], r["split"], r["n"], round(r["loss"], 6), round(r["accuracy"], 6)) for r in rows.collect())
    resumed = key(M.train_rounds(train, val, one, 3, 3, rounds=4, iterations=3))
    assert resumed == key(M.train_rounds(train, val, two, 3, 3, rounds=4, iterations=3))
    assert resumed == key(M.learning_curve_by_split(train, val, 3, 3, rounds=4, iterations=3))
    assert len(resumed) == 8 and key(M.train_rounds(train, val, one, 3, 3, rounds=3, iterations=3)) == resumed  # nothing left to do
    curve = M.saved_curve(spark, one)
    best = M.best_round(curve)
    losses = {r["round"]: r["loss"] for r in curve.filter("split = 'val'").collect()}
    assert losses[best] == min(losses.values())
    assert M.predict(M.load_round(one, best), train, ["label"]).filter("y_pred = label").count() > 100


def test_generate_preprocess_train(spark):
    """From timed samples and annotations to a model with a validation side, by the command line."""
    root, n = _root(spark), 30
    data, labels = recordings(spark, r=8, e=20, n=n)
    channels = [c for c in data.columns if c not in ("patient", "timestep", "time")]
    t = (F.col("timestep") / F.lit(float(n)) * 30).alias("t")  # an epoch of n samples lasts 30 s
    write_csv(data.select("patient", t, *channels), f"{root}/samples")
    ann = labels.filter(f"timestep % {n} = 0").select("patient", (F.col("timestep") / n * 30.0).alias("onset"), F.lit(30.0).alias("duration"), F.col("condition").alias("description"))
    write_csv(ann.unionByName(ann.filter("onset = 60").withColumn("description", F.lit("Sleep stage ?"))), f"{root}/ann")
    main(["generate", f"{root}/samples", f"{root}/ann", f"{root}/raw", "--disjoint"])
    raw, lab = generate_job(spark, f"{root}/samples", f"{root}/ann", f"{root}/raw2", disjoint=True)
    assert raw.columns == data.columns and lab.columns == labels.columns
    per = raw.groupBy("patient").agg(F.count("*").alias("n"), F.countDistinct("timestep").alias("d"), F.max("timestep").alias("m"))
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in per.collect()) and raw.count() == lab.count() > 0
    twice, _ = generate_job(spark, f"{root}/samples", f"{root}/ann", f"{root}/raw3", fmt="parquet")
    assert twice.count() == raw.count() + 8 * n  # the doubled annotation of each recording
    main(["preprocess", f"{root}/raw/data", f"{root}/raw/labels", f"{root}/pre", "--n", str(n)])
    acc = train_job(spark, f"{root}/pre", f"{root}/out", n=n, k_holdout=1, k_validation=1, max_iter=10, rounds=3, estimator="mlp")
    assert set(acc) == {"train", "val", "test"} and acc["test"] > 0.5
    curve = spark.read.option("header", True).csv(f"{root}/out/learning_curve")
    assert curve.count() == 9
    timeline = spark.read.option("header", True).csv(f"{root}/out/timeline")
    preds = spark.read.option("header", True).csv(f"{root}/out/predictions").filter("split = 'test'")
    assert timeline.columns == ["patient", "epoch", "y_true", "y_pred"] and timeline.count() == preds.count() > 0


def test_text_job_joins_both_fields_and_returns_files(spark):
    root = _root(spark)
    head = "patient,timestep,time,a,b,c,d"
    for name, lines in {"data": [head, "A_1,2,0,1,1,1,1", "A,1_2,0,9,9,9,9", "A_1,10,0,2,2,2,2"],
                        "labels": ["patient,timestep,time,condition", "A_1,2,0,Sleep stage W", "A_1,10,0,Sleep stage R"]}.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{root}/{name}")
    got = text_preprocess_job(spark, f"{root}/data", f"{root}/labels", f"{root}/out", n=8)
    assert "FileScan text" in got._jdf.queryExecution().executedPlan().toString() and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("A_1_2", 2, 1.0, 1.0, 1.0, "Sleep stage W", 0, 0), ("A_1_10", 10, 2.0, 2.0, 2.0, "Sleep stage R", 4, 1)]


def test_only_points_where_nothing_starts_are_looked_up(spark, monkeypatch):
    rows = [("P", float(10 * i), float(10 * i + 25), "x") for i in range(40)] + [("P", 0.0, 400.0, "long"), ("P", 0.0, 12.0, None), ("Q", 5.0, 9.0, "y")]
    asked = []

    def watched(samples, *args, **named):
        asked.append(samples.count())
        return IV.interval_join_any(samples, *args, **named)
    monkeypatch.setattr(SW, "interval_join_any", watched)
    got = SW.disjoint_intervals(spark.createDataFrame(rows, "patient string, onset double, `end` double, description string"), unit=1.0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _owned(rows)
    points = {p for r in rows if r[0] == "P" for p in r[1:3]}
    assert asked == [len(points - {r[1] for r in rows}) - 1]  # but the last end


@pytest.mark.parametrize("desc", [False, True])
def test_positions_by_floating_keys_are_exchanged_once(spark, monkeypatch, desc):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([0.0, -0.0, 1.5, float("nan"), None] + [float(i) for i in range(300)]), i) for i in range(3000)]
    rows += [("hot", 2.5, 3000 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double, t long").repartition(5)
    plans = {}
    write = ordering.stored

    def watched(df, name):
        plans[name] = (df._jdf.queryExecution().executedPlan().toString(), df.count())
        return write(df, name)
    monkeypatch.setattr(ordering, "stored", watched)
    got = ordering.ordered_index(df, ["k", "x"], ["t"], out="i", descending=desc, rows_per_bucket=200, count_out="n")
    want = {}
    for k, x, t in sorted(rows, key=lambda r: r[2], reverse=desc):
        want.setdefault((k, "nan" if x != x else x), []).append(t)
    for r in got.collect():
        group = want[r["k"], "nan" if r["x"] != r["x"] else r["x"]]
        assert group[r["i"]] == r["t"] and r["n"] == len(group)
    assert got.count() == len(rows)
    assert plans["positions"][0].count("Exchange hashpartitioning") == 1
    assert plans["carry"][1] <= 2 * 30


def test_a_piece_goes_on_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 8)
    rows = [("P", float(i), 100.0 + i, "a") for i in range(50)] + [("P", 49.5, 500.0, None), ("P", 600.0, 601.0, "b")]
    rows += [("Q", 0.0, 5.0, "a"), ("Q", 5.0, 9.0, "a"), ("R", 1.0, 2.0, "c")]
    got = SW.disjoint_intervals(spark.createDataFrame(rows, "patient string, onset double, `end` double, description string"), unit=1.0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _owned(rows)
    assert [(r["onset"], r["end"]) for r in got.filter("of_end = 500").collect()] == [(49.5, 500.0)]  # over 50 ends


def test_stretches_are_exchanged_a_few_times(spark, monkeypatch):
    """Points once, those looked up and the intervals once into the tree, what they find twice."""
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 40)
    rows = [(f"P{i % 3}", float(10 * i), float(10 * i + 45), "x") for i in range(300)]
    plans, sizes, write = {}, {}, SW.stored

    def watched(df, name):
        plans[name], sizes[name] = df._jdf.queryExecution().executedPlan().toString(), df.count()
        return write(df, name)
    monkeypatch.setattr(SW, "stored", watched)
    monkeypatch.setattr(ordering, "stored", lambda df, name: watched(df, name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = SW.disjoint_intervals(spark.createDataFrame(rows, "patient string, onset double, `end` double, description string"), unit=1.0)
        plans["result"] = got._jdf.queryExecution().executedPlan().toString()
        assert sorted((tuple(r) for r in got.collect()), key=str) == _owned(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = {name: plan.count("Exchange hashpartitioning") for name, plan in plans.items() if name not in ("splits", "carry")}
    assert sum(moved.values()) <= 6, moved  # the last one moves a range's outer pieces only
    assert sizes["carry"] <= 600 // 40 * 3
