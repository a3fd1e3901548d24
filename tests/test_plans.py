"""Plan shapes that carry the scale design (checked on the physical plan)."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from sigframe.operators import intervals as IV
from sigframe.operators import ordering
from sigframe.operators.ordering import ordered_index, quantile_sketch
from sigframe.operators.split import tag_split_exact
from sigframe.plans.flagship import epochs_from_raw
from sigframe.plans.queries import QUERIES
from sigframe.session import scratch_path
from tests.synthetic import recordings


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_one_exchange_per_input(spark):
    root = scratch_path(spark, f"sigframe-plan-{uuid.uuid4().hex}")
    data, labels = recordings(spark, r=2, e=4, n=30)
    data.write.parquet(f"{root}/d")
    labels.write.parquet(f"{root}/l")
    ep = epochs_from_raw(spark.read.parquet(f"{root}/d"), spark.read.parquet(f"{root}/l"), n=30)
    plan = _plan(ep)
    exchanges = re.findall(r"Exchange (\w+)\(([^)]*)", plan)
    assert len(exchanges) == 2, exchanges
    assert all(kind == "hashpartitioning" and "patient" in cols and "epoch" in cols and "timestep" not in cols
               for kind, cols in exchanges), exchanges
    assert "SortMergeJoin" in plan and "SortAggregate" in plan and "Broadcast" not in plan


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _hot(spark):
    root = scratch_path(spark, f"sigframe-plan-{uuid.uuid4().hex}")
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    ev.select(F.when(F.col("user_id") < 50, F.lit(-1)).otherwise(F.col("user_id")).alias("k"), "ts", "event_id").write.parquet(root)
    return spark.read.parquet(root)


def test_positions_read_stored_rows_without_an_exchange(spark, no_broadcast):
    """With joins as at size: no row is exchanged on the key alone, and the index is a scan of
    stored positions and of the few that go on in another range."""
    df = _hot(spark)
    plan = _plan(ordered_index(df, ["k"], ["ts", "event_id"], out="i", rows_per_bucket=400, count_out="n"))
    assert plan.count("FileScan") == 2 and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    work = df.select("*", F.struct("k").alias(ordering._K), F.struct(F.struct("k").alias("k"), "ts", "event_id").alias(ordering._T))
    splits = quantile_sketch(work, ordering._T, 400)
    plan = _plan(ordering._placed(work, splits, splits.select(F.size(ordering._S)).first()[0]))
    assert re.findall(r"Exchange hashpartitioning\((\S+?)#\d+, (\S+?)#", plan)[0] == (ordering._K, ordering._B)


def test_positions_of_positions_do_not_multiply_scans(spark, no_broadcast):
    first = ordered_index(_hot(spark), ["k"], ["ts", "event_id"], out="i", rows_per_bucket=400)
    assert _plan(ordered_index(first, ["k"], ["i"], out="j", rows_per_bucket=400)).count("FileScan") == 2


def test_annotation_ends_are_found_in_one_scan(spark, no_broadcast):
    ann = _hot(spark).select(F.col("k").alias("patient"), F.col("event_id").cast("double").alias("onset"), F.lit(30.0).alias("duration"), F.lit("W").alias("description"))
    plan = _plan(IV.annotation_landmarks(ann))
    assert plan.count("FileScan") == 1 and "Join" not in plan and "WindowGroupLimit" in plan
    # annotations meet their bounds by (recording, slot), never by the recording alone
    plan = _plan(IV.crop_annotations(ann))
    assert plan.count("FileScan") == 2
    joined = re.findall(r"Exchange hashpartitioning\((.+?), \d+\)", plan)
    assert sum("_sf_slot" in x for x in joined) == 2, joined


def test_exact_split_neither_sorts_nor_exchanges(spark):
    plan = _plan(tag_split_exact(_hot(spark), "event_id", 0.2, 42))
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_or_python_rows(spark, name):
    if name.startswith("ml_"):
        pytest.skip("model fitting runs eagerly; its predictions are plain expressions")
    plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)
