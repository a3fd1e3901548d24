"""Session construction and the few session-level settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that shape the physical plans of this library.
#  * AQE re-plans joins at runtime (broadcast only once the real size is known),
#    coalesces small shuffle partitions and splits skewed join partitions.
#  * requireAllClusterKeysForCoPartition=false lets a join on
#    (patient, epoch, timestep) reuse inputs hash-partitioned on (patient, epoch),
#    so the label join and the epoch aggregation share one shuffle. Safe there
#    because an epoch holds a bounded number of samples. The flip side: Spark may
#    then join on (a, b) an input partitioned on a alone; joins of this package
#    keyed by (recording, bucket) guard against that (operators/partitioning.py),
#    and user joins on a hot prefix key should repartition on the full key.
#  * useObjectHashAggregateExec=false plans collect_list aggregations (epoch
#    assembly) as sort-based aggregates: after the label join, whose output is
#    already ordered by (patient, epoch, timestep), epochs stream through without
#    the extra sort the hash aggregate falls back to past 128 keys per task.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for a large cluster (set with spark-submit --conf, not here): start with
# many shuffle partitions and let AQE merge them to ~256 MB; read files in 256 MB
# splits. An epoch is 3000 samples x 3 floats, so per-group state stays small.
CLUSTER_CONF_HINTS = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sigframe", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the recommended settings.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if is_local(spark) or _shared_dir(spark):
        checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process, so that a local folder is shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def _shared_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, with its scheme.

    A cluster names it in ``spark.checkpoint.dir`` and we only read that setting.
    Where neither it nor the context's folder is set, a local session (tests) gets
    a temporary folder that goes with the process; on a cluster this is an error,
    since executors do not share their own disks.
    """
    current = _shared_dir(spark)
    if not current:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="sigframe-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        current = f"file:{current}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a materialised table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}"
