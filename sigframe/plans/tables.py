"""Driver tables -> signal tables.

The driver ships generic tables; this adapter only reshapes ``events`` into rows
with the schemas the operators expect (it does none of their work):

* ``signals_raw`` (DM-1): recording = 'P' || user_id; sample number = position of
  the event in (ts, event_id) order within its recording; time = sample / 100 s;
  channels from value, props.k, event_id mod 97 and value / 2.
* ``labels_raw`` (DM-2): the same key plus a stage name chosen by event type,
  with an unknown stage for some rows, and stages 3 and 4 both present.
* ``annotations`` (DM-3): one interval per event: onset = seconds since
  2024-01-01, duration = gap to the next event of the recording.
* ``preds``: (recording, sample, epoch, label, y_pred) with y_pred off by one
  class on some rows, for the evaluation operators.
* ``file_catalog``: recording and hypnogram file names per user.

The same definitions, written as SQL, feed the DuckDB oracles (``oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions.stages import stage_label
from sigframe.functions.times import ntz_micros
from sigframe.operators.ordering import ordered_index
from sigframe.operators.partitioning import on_full_key

# Fixed values of the adapter.
EPOCH_N = 8                 # samples per epoch on driver tables (49-86 events per user at sf0.01)
CHUNK_S = 6 * 3600.0        # annotation chunk length on driver tables, seconds
SEED = 42
ANCHOR = "2024-01-01 00:00:00"


# (table name, sf_dir) -> (parquet path, schema) of a materialised copy; see ``materialize``.
_MATERIALIZED: dict[tuple[str, str], tuple] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _stored(spark: SparkSession, name: str, sf_dir: str) -> DataFrame | None:
    stored = _MATERIALIZED.get((name, sf_dir))
    if not stored:
        return None
    path, schema = stored
    return spark.read.schema(schema).parquet(path)


def materialize(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, str]:
    """Write the adapter tables once as Parquet under ``folder`` (a shared
    location) and serve later calls from those files, as real inputs would be."""
    builders = {"signals_raw": signals_raw, "labels_raw": labels_raw,
                "annotations": annotations, "event_times": event_times, "preds": preds}
    out = {}
    for name, fn in builders.items():
        path = f"{folder}/{name}"
        df = fn(spark, sf_dir)
        df.write.mode("overwrite").parquet(path)
        _MATERIALIZED[(name, sf_dir)] = (path, df.schema)
        out[name] = path
    return out


def condition_expr() -> F.Column:
    et, eid = F.col("event_type"), F.col("event_id")
    return (F.when(eid % 4 == 0, F.lit("Sleep stage ?"))
             .when(et == "view", F.lit("Sleep stage W"))
             .when(et == "click", F.lit("Sleep stage 1"))
             .when(et == "purchase", F.lit("Sleep stage 2"))
             .when(et == "signup", F.when(eid % 2 == 0, F.lit("Sleep stage 3")).otherwise(F.lit("Sleep stage 4")))
             .when(et == "error", F.lit("Sleep stage R")))


def seconds_expr() -> F.Column:
    """Seconds since ANCHOR, independent of the session time zone."""
    anchor = ntz_micros(F.lit(ANCHOR).cast("timestamp_ntz"))
    return (ntz_micros("ts") - anchor) / F.lit(1e6)


_INDEXED: dict[tuple[str, int, str], DataFrame] = {}


def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their recording id and sample number. The plan is built once
    per session and table folder, so signals and labels share one plan subtree."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _INDEXED:
        _INDEXED[key] = _index_events(spark, sf_dir)
    return _INDEXED[key]


def _index_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = (_events(spark, sf_dir)
          .select("event_id", "ts", "user_id", "event_type", "value", "props")
          .withColumn("patient", F.concat(F.lit("P"), F.col("user_id").cast("string"))))
    idx = ordered_index(ev, ["patient"], ["ts", "event_id"], out="timestep")
    return idx.withColumn("timestep", F.col("timestep").cast("int"))


def _time():
    return (F.col("timestep") / F.lit(100)).cast("float").alias("time")


def signals_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, "signals_raw", sf_dir)
    if stored is not None:
        return stored
    ev = indexed_events(spark, sf_dir)
    return ev.select(
        "patient", "timestep", _time(),
        F.col("value").cast("float").alias("EEG Fpz-Cz"),
        F.get_json_object("props", "$.k").cast("float").alias("EEG Pz-Oz"),
        (F.col("event_id") % 97).cast("float").alias("EOG horizontal"),
        (F.col("value") / 2).cast("float").alias("EMG submental"))


def labels_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, "labels_raw", sf_dir)
    if stored is not None:
        return stored
    ev = indexed_events(spark, sf_dir)
    return ev.select("patient", "timestep", _time(), condition_expr().alias("condition"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, "annotations", sf_dir)
    if stored is not None:
        return stored
    ev = indexed_events(spark, sf_dir).select(
        "patient", "timestep", seconds_expr().alias("onset"), condition_expr().alias("description"))
    nxt = ev.select("patient", (F.col("timestep") - 1).alias("timestep"), F.col("onset").alias("_next"))
    ev, nxt = on_full_key(ev, "patient", "timestep"), on_full_key(nxt, "patient", "timestep")
    return (ev.join(nxt, ["patient", "timestep"], "left")
              .select("patient", "onset",
                      F.coalesce(F.col("_next") - F.col("onset"), F.lit(0.0)).alias("duration"),
                      "description"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point samples on the annotation clock: (patient, event_id, t seconds)."""
    stored = _stored(spark, "event_times", sf_dir)
    if stored is not None:
        return stored
    return _events(spark, sf_dir).select(
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("patient"),
        "event_id", seconds_expr().alias("t"))


def timed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples on the annotation clock, not numbered yet: (patient, event_id, t, channels)."""
    return _events(spark, sf_dir).select(
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("patient"),
        "event_id", seconds_expr().alias("t"), F.col("value").cast("float").alias("fpzcz"),
        (F.col("event_id") % 97).cast("float").alias("horizontal"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, "preds", sf_dir)
    if stored is not None:
        return stored
    ev = indexed_events(spark, sf_dir)
    lab = stage_label(condition_expr(), "keep")
    shift = F.when(F.col("event_id") % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    return (ev.select("patient", "timestep", "event_id", lab.alias("label"))
              .filter(F.col("label") != -1)
              .select("patient", "timestep",
                      F.floor(F.col("timestep") / F.lit(EPOCH_N)).cast("long").alias("epoch"),
                      "label", ((F.col("label") + shift) % 5).cast("int").alias("y_pred")))


# Digits of an id in a file name: those of the longest BIGINT, so none is cut.
FILE_ID_DIGITS = 19


def file_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(recording files, hypnogram files), each (path, name)."""
    ev = _events(spark, sf_dir)
    num = F.lpad(F.col("user_id").cast("string"), FILE_ID_DIGITS, "0")
    psg = (ev.select(F.concat(F.lit("ST"), num, F.lit("J0-PSG.edf")).alias("name")).distinct()
             .withColumn("path", F.concat(F.lit("/recordings/"), F.col("name"))))
    hyp = (ev.select(F.concat(F.lit("ST"), num, F.lit("J"), F.upper(F.substring("event_type", 1, 1)),
                              F.lit("-Hypnogram.edf")).alias("name")).distinct()
             .withColumn("path", F.concat(F.lit("/recordings/"), F.col("name"))))
    return psg, hyp


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
