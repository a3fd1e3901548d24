"""The preprocess and train jobs end to end on synthetic recordings written as CSV."""

import uuid

from pyspark.sql import functions as F

from sigframe.plans.jobs import main, preprocess_job, text_preprocess_job, train_job
from sigframe.session import scratch_path
from sigframe.sources.catalog import list_files, recording_catalog
from sigframe.sources.csv import write_csv
from sigframe.sources.persist import persisted
from tests.synthetic import recordings

N = 30


def test_preprocess_then_train(spark):
    root = scratch_path(spark, f"sigframe-jobs-{uuid.uuid4().hex}")
    data, labels = recordings(spark, r=8, e=20, n=N)
    write_csv(data, f"{root}/data")
    write_csv(labels, f"{root}/labels")
    pre = preprocess_job(spark, f"{root}/data", f"{root}/labels", f"{root}/pre", n=N)
    known = labels.filter(~F.col("condition").endswith("?")).count()
    assert pre.count() == known
    assert pre.columns == ["patient", "time", "fpzcz", "pzoz", "horizontal", "label", "epoch"]
    acc = train_job(spark, f"{root}/pre", f"{root}/out", n=N, k_holdout=1, max_iter=50)
    assert set(acc) == {"train", "test"} and acc["test"] > 0.8
    rep = spark.read.option("header", True).csv(f"{root}/out/class_report_avg")
    assert rep.filter(F.col("kind") == "accuracy").count() == 2


def test_persisted_releases(spark):
    df = spark.range(10)
    with persisted(df) as p:
        assert p.is_cached and p.count() == 10
    assert not df.is_cached


def test_list_files_and_pair(spark):
    root = scratch_path(spark, f"sigframe-files-{uuid.uuid4().hex}")
    names = ["ST7011J0-PSG.edf", "ST7011JP-Hypnogram.edf", "ST7012J0-PSG.edf", "ST7012JA-Hypnogram.edf",
             "ST7012JB-Hypnogram.edf", "ST7021J0-PSG.edf"]
    for nm in names:
        spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{root}/{nm}.d")
    files = list_files(spark, root, "part-*").withColumn(
        "name", F.regexp_extract("path", r"/([^/]+)\.d/part-", 1))
    got = {r["recording"]: r["hyp_name"] for r in recording_catalog(files).collect()}
    assert got == {"ST7011J0": "ST7011JP-Hypnogram.edf", "ST7012J0": "ST7012JA-Hypnogram.edf"}


def test_parquet_output_prunes_by_recording(spark):
    root = scratch_path(spark, f"sigframe-jobs-{uuid.uuid4().hex}")
    data, labels = recordings(spark, r=4, e=6, n=N)
    write_csv(data, f"{root}/data")
    write_csv(labels, f"{root}/labels")
    pre = preprocess_job(spark, f"{root}/data", f"{root}/labels", f"{root}/pre", n=N, fmt="parquet")
    assert pre.columns == ["patient", "time", "fpzcz", "pzoz", "horizontal", "label", "epoch"]
    one = pre.filter(F.col("patient") == "ST7011J0")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(patient" in plan and "ST7011J0" in plan
    assert one.count() == pre.filter(F.col("patient") == "ST7011J0").count() > 0
    acc = train_job(spark, f"{root}/pre", f"{root}/out", n=N, fmt="parquet", k_holdout=1, max_iter=20)
    assert set(acc) == {"train", "test"}


def test_text_job_matches_dataframe_job(spark):
    root = scratch_path(spark, f"sigframe-jobs-{uuid.uuid4().hex}")
    data, labels = recordings(spark, r=2, e=4, n=N)
    write_csv(data.repartition(3), f"{root}/data")
    write_csv(labels.repartition(2), f"{root}/labels")
    main(["preprocess-text", f"{root}/data", f"{root}/labels", f"{root}/txt", "--n", str(N)])
    lines = [r["value"].split(",") for r in spark.read.text(f"{root}/txt").collect()]
    pre = preprocess_job(spark, f"{root}/data", f"{root}/labels", f"{root}/pre", n=N)
    assert len(lines) == pre.count() > 0
    assert {(f[0].split("_")[0], int(f[7]), int(f[6])) for f in lines} == \
        {(r["patient"], r["epoch"], r["label"]) for r in pre.select("patient", "epoch", "label").collect()}
    lex = text_preprocess_job(spark, f"{root}/data", f"{root}/labels", f"{root}/lex", n=N, lexicographic=True)
    keys = [r["key"] for r in lex.collect()]
    assert keys == sorted(keys)
