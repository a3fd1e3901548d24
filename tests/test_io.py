"""Scans and sinks (SRC-1..SRC-4, SNK-1, SNK-2, D2)."""

import glob
import uuid

from pyspark.sql import functions as F

from sigframe.schemas import RAW_LABELS
from sigframe.session import scratch_path
from sigframe.sources import csv as IO

ROWS = [("P1", 0, 0.0, "Sleep stage W"), ("P1", 1, 0.01, "Sleep stage 1"), ("P2", 0, 0.0, "Sleep stage ?")]


def _labels(spark):
    return spark.createDataFrame(ROWS, RAW_LABELS)


def test_text_scan_drops_every_header_line(spark):
    root = scratch_path(spark, f"sigframe-io-{uuid.uuid4().hex}")
    IO.write_csv(_labels(spark).repartition(3), root)  # three files, three header lines
    fields = IO.read_text_split(spark, root)  # header found by a one-line read
    assert fields.count() == 3
    assert sorted(r["fields"][0] for r in fields.collect()) == ["P1", "P1", "P2"]


def test_single_file_and_partitioned_sinks(spark):
    root = scratch_path(spark, f"sigframe-io-{uuid.uuid4().hex}")
    IO.write_csv(_labels(spark).repartition(3), f"{root}/one", single_file=True)
    assert len(glob.glob(f"{root}/one/part-*.csv")) == 1
    IO.write_csv(_labels(spark), f"{root}/by", partition_by=["patient"])
    back = IO.read_csv(spark, f"{root}/by", RAW_LABELS.__class__(RAW_LABELS.fields[1:]))
    assert back.count() == 3
    only_p2 = spark.read.option("header", True).csv(f"{root}/by").filter(F.col("patient") == "P2")
    assert only_p2.count() == 1


def test_typed_read_handles_bad_numbers(spark):
    root = scratch_path(spark, f"sigframe-io-{uuid.uuid4().hex}")
    spark.createDataFrame([("P1", "x", "0.5", "Sleep stage 2")], "patient string, timestep string, time string, "
                          "condition string").write.option("header", True).csv(root)
    row = IO.read_csv(spark, root, RAW_LABELS).first()
    assert row["timestep"] is None and abs(row["time"] - 0.5) < 1e-7


def test_inferred_and_text_roundtrip(spark):
    root = scratch_path(spark, f"sigframe-io-{uuid.uuid4().hex}")
    IO.write_csv(_labels(spark), f"{root}/csv")
    types = dict(IO.read_csv_inferred(spark, f"{root}/csv").dtypes)
    assert types["timestep"] == "int" and types["time"] == "double"
    IO.write_text(_labels(spark), f"{root}/txt")
    lines = sorted(r["value"] for r in spark.read.text(f"{root}/txt").collect())
    assert lines[0] == "P1,0,0.0,Sleep stage W"
