"""Session helpers and the join partitioning guard."""

from pyspark.sql import functions as F

from sigframe.operators.partitioning import allows_coarse_reuse, on_full_key
from sigframe.session import RECOMMENDED_CONF, checkpoint_dir, scratch_path


def test_checkpoint_folder_is_read_from_the_session(spark):
    folder = checkpoint_dir(spark)
    assert folder and spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").startswith(folder)


def test_recommended_settings_applied(spark):
    for key in ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition",
                "spark.sql.execution.useObjectHashAggregateExec"):
        assert spark.conf.get(key) == RECOMMENDED_CONF[key]


def test_full_key_guard_follows_the_setting(spark):
    df = spark.range(10).withColumn("b", F.col("id") % 3)
    assert allows_coarse_reuse(df)
    plan = on_full_key(df, "id", "b")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and ", b" in plan
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    try:
        assert not allows_coarse_reuse(df)
        assert on_full_key(df, "id", "b") is df
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

