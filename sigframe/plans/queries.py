"""Query registry: one entry per operator of the inventory, each a function
(spark, sf_dir) -> DataFrame over the driver tables, plus an independent DuckDB
SQL oracle where SQL can express it.

Results are scalar columns only (arrays are exploded with their positions), so
an order-insensitive comparison of rows still checks array order. Floating
results of aggregates are rounded in both the query and its oracle, because
summation order differs between engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigframe.functions.arrays import (
    argmax, channel_major_to_time_major, one_hot, relu_array, softmax, time_major_to_channel_major,
)
from sigframe.functions.keys import composite_key
from sigframe.operators import array_features as AF
from sigframe.operators import epochs as E
from sigframe.operators import evaluate as V
from sigframe.operators import features as SIG
from sigframe.operators import intervals as IV
from sigframe.operators import model as M
from sigframe.operators import ordering as O
from sigframe.operators import prep as P
from sigframe.operators import scale as S
from sigframe.operators import split as SP
from sigframe.operators import sweep as SW
from sigframe.plans import tables as TB
from sigframe.plans.flagship import epoch_digest, epochs_from_raw
from sigframe.plans.oracle import CHUNK_S, N, stage_case, with_views
from sigframe.schemas import CHANNELS, RAW_CHANNELS, RAW_DATA, RAW_LABELS, STAGE_MAP
from sigframe.session import scratch_path
from sigframe.sources import bucketed as BK
from sigframe.sources import catalog as CAT
from sigframe.sources import csv as IO
from sigframe.sources.persist import persisted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K_HOLDOUT = 8
SEED = TB.SEED
FIR_TAPS = [0.25, 0.5, 1.0, 0.5, 0.25]
FIR_STRIDE = 2
POOL = 4
N_CLASSES = 5


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r(c, d=6):
    """Round a float result (keeps the column name when given by name)."""
    if isinstance(c, str):
        return F.round(F.col(c), d).alias(c)
    return F.round(c, d)


# ---- shared inputs -----------------------------------------------------------

def samples(spark, d) -> DataFrame:
    return P.prepare_samples(TB.signals_raw(spark, d))


def labels_typed(spark, d) -> DataFrame:
    return TB.labels_raw(spark, d).select("patient", "timestep", "condition")


def prep_rows(spark, d) -> DataFrame:
    """Preprocessed samples with epoch and in-epoch position."""
    rows = P.preprocess(TB.signals_raw(spark, d), TB.labels_raw(spark, d), n=N, with_key=False)
    return rows.withColumn("pos", (F.col("timestep") - F.col("epoch") * N).cast("int"))


def flagship(spark, d) -> DataFrame:
    return epochs_from_raw(TB.signals_raw(spark, d), TB.labels_raw(spark, d), n=N)


def holdout_ids(spark, d, k=K_HOLDOUT) -> list[str]:
    """k recording ids chosen by seeded hash (at most k values reach the driver)."""
    return [row["unit_id"] for row in SP.pick_holdout(samples(spark, d), k, SEED).collect()]


HOLD_IDS_SQL = f"""SELECT patient AS unit_id FROM (SELECT DISTINCT patient FROM samples)
  ORDER BY substr(md5(patient || '{SEED}'), 1, 8), patient LIMIT {K_HOLDOUT}"""


# ---- flagship ------------------------------------------------------------------

@query("preprocess_epochs", with_views(f"""
SELECT patient, epoch, patient || '_' || CAST(epoch AS VARCHAR) AS primary_key,
  COUNT(*) AS n_samples, CAST(trunc(avg(label)) AS INTEGER) AS label_mean,
  arg_min(label, "time") AS label_first, arg_min(fpzcz, "time") AS fpzcz_first,
  arg_max(pzoz, "time") AS pzoz_last, arg_max(horizontal, "time") AS horizontal_last,
  CAST(3 * COUNT(*) AS INTEGER) AS n_features
FROM prep GROUP BY patient, epoch""", "prep"))
def q_preprocess_epochs(spark, d):
    """Flagship: raw samples and labels -> labelled epochs (digest of the arrays)."""
    return epoch_digest(flagship(spark, d))


# ---- 2.1 scans and sinks --------------------------------------------------------

def _scratch(spark, name):
    return scratch_path(spark, f"sigframe-{name}-{uuid.uuid4().hex}")


SAMPLES_SQL = with_views("SELECT * FROM samples", "samples")


@query("csv_roundtrip", SAMPLES_SQL)
def q_csv_roundtrip(spark, d):
    """SNK-1/SNK-3 then SRC-1: data and labels written as two CSVs with headers,
    the data read back through the all-strings-then-cast reader."""
    path = _scratch(spark, "csv")
    IO.write_csv(TB.signals_raw(spark, d), path + "/data")
    IO.write_csv(TB.labels_raw(spark, d), path + "/labels")
    return P.prepare_samples(IO.read_csv(spark, path + "/data", RAW_DATA))


@query("csv_typed_scan", with_views("SELECT patient, timestep, \"time\", condition FROM labels_raw", "labels_raw"))
def q_csv_typed_scan(spark, d):
    """SRC-2: header + separator scan, then typed with try_cast."""
    path = _scratch(spark, "csvtyped")
    IO.write_csv(TB.labels_raw(spark, d), path, sep=";")
    return IO.read_csv(spark, path, RAW_LABELS, sep=";")


@query("csv_infer_scan", with_views("""SELECT patient, timestep, "time", "EEG Fpz-Cz" AS fpzcz, "EEG Pz-Oz" AS pzoz,
  "EOG horizontal" AS horizontal, "EMG submental" AS submental FROM signals""", "signals"))
def q_csv_infer_scan(spark, d):
    """SRC-4: schema inferred from the file; numbers come back as int / double."""
    path = _scratch(spark, "csvinfer")
    IO.write_csv(TB.signals_raw(spark, d), path)
    df = IO.read_csv_inferred(spark, path)
    names = {"time": "time", **RAW_CHANNELS, "EMG submental": "submental"}
    return df.select("patient", F.col("timestep").cast("int").alias("timestep"),
                     *[F.col(f"`{c}`").cast("float").alias(n) for c, n in names.items()])


@query("text_split_scan", with_views("""SELECT patient, timestep, "time", condition FROM labels_raw
  WHERE condition IS NOT NULL""", "labels_raw"))
def q_text_split_scan(spark, d):
    """SRC-3/FN-3: a CSV read as text lines, header lines dropped, split on ','."""
    path = _scratch(spark, "textsplit")
    IO.write_csv(TB.labels_raw(spark, d), path)
    f = IO.read_text_split(spark, path)
    return f.select(F.element_at("fields", 1).alias("patient"),
                    F.element_at("fields", 2).cast("int").alias("timestep"),
                    F.element_at("fields", 3).cast("float").alias("time"),
                    F.element_at("fields", 4).alias("condition"))


@query("text_roundtrip", SAMPLES_SQL)
def q_text_roundtrip(spark, d):
    """SNK-2/FN-4: values joined with ',' and written as text, no header; read back
    with the split scan and typed."""
    path = _scratch(spark, "text")
    cols = ["patient", "timestep", "time", "fpzcz", "pzoz", "horizontal"]
    IO.write_text(samples(spark, d), path, cols)
    f = IO.read_text_split(spark, path, drop_header=False)
    types = ["string", "int", "float", "float", "float", "float"]
    return f.select(*[F.element_at("fields", i + 1).try_cast(t).alias(c) for i, (c, t) in enumerate(zip(cols, types))])


@query("pair_files_by_prefix", """
WITH psg AS (SELECT DISTINCT 'ST' || lpad(CAST(user_id AS VARCHAR), 19, '0') || 'J0-PSG.edf' AS name FROM events),
hyp AS (SELECT DISTINCT 'ST' || lpad(CAST(user_id AS VARCHAR), 19, '0') || 'J' || upper(substr(event_type, 1, 1))
        || '-Hypnogram.edf' AS name FROM events)
SELECT substr(p.name, 1, 23) AS recording, p.name AS psg_name, min(h.name) AS hyp_name
FROM psg p JOIN hyp h ON substr(p.name, 1, 22) = substr(h.name, 1, 22)
GROUP BY p.name""")
def q_pair_files_by_prefix(spark, d):
    """SRC-5/JN-4/PRJ-7/FN-5: recordings paired with the first hypnogram sharing
    their prefix, here 'ST', the id's digits and 'J'; the recording id is one longer."""
    psg, hyp = TB.file_catalog(spark, d)
    prefix = 2 + TB.FILE_ID_DIGITS + 1
    return CAT.pair_by_prefix(psg, hyp, prefix, prefix + 1).select("recording", "psg_name", "hyp_name")


# ---- 2.2 projections ------------------------------------------------------------

@query("project_rename_cast", SAMPLES_SQL)
def q_project_rename_cast(spark, d):
    """PRJ-1..4: text columns renamed, EMG dropped, cast with try_cast."""
    raw = TB.signals_raw(spark, d)
    as_text = raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])
    return P.prepare_samples(as_text)


@query("composite_key", with_views("""SELECT patient, timestep, patient || '_' || CAST(timestep AS VARCHAR)
  AS primary_key FROM samples""", "samples"))
def q_composite_key(spark, d):
    """PRJ-6."""
    return samples(spark, d).select("patient", "timestep",
                                    composite_key("patient", "timestep").alias("primary_key"))


@query("row_index", with_views("""SELECT patient, timestep, CAST(row_number() OVER (PARTITION BY patient
  ORDER BY fpzcz, timestep) - 1 AS INTEGER) AS idx FROM samples""", "samples"))
def q_row_index(spark, d):
    """PRJ-8: per-recording row index under an order (here by channel value)."""
    return O.row_index(samples(spark, d).select("patient", "timestep", "fpzcz"), "patient",
                       ["fpzcz", "timestep"], out="idx").select("patient", "timestep", "idx")


@query("row_index_bucketed", with_views("""SELECT patient, timestep, CAST(row_number() OVER (
  ORDER BY patient || '-' || lpad(CAST(timestep AS VARCHAR), 12, '0')) - 1 AS BIGINT) AS idx FROM samples""", "samples"))
def q_row_index_bucketed(spark, d):
    """PRJ-8: positions in the whole table by a string order, in buckets of about 50 rows
    that share long prefixes."""
    rows = samples(spark, d).select("patient", "timestep").withColumn(
        "name", F.concat_ws("-", "patient", F.lpad(F.col("timestep").cast("string"), 12, "0")))
    return O.ordered_index(rows, [], ["name"], out="idx", rows_per_bucket=50).drop("name")


def _narrow_sql(c):
    return f"""SELECT '{c}' AS column_name, CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint'
      WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint'
      WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS dtype,
      CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM events"""


@query("narrow_types", " UNION ALL ".join([_narrow_sql("event_id"), _narrow_sql("user_id"),
       """SELECT 'value', 'float', CAST(min(CAST(value AS FLOAT)) AS DOUBLE),
          CAST(max(CAST(value AS FLOAT)) AS DOUBLE) FROM events"""]))
def q_narrow_types(spark, d):
    """PRJ-9: integer columns to the smallest type holding their range, doubles to
    float; reported as (column, new type, min, max)."""
    return _type_report(P.narrow_types(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "value")))


def _type_report(nt):
    cols = nt.columns
    agg = nt.agg(*[F.first(F.expr(f"typeof({c})")).alias(f"t_{c}") for c in cols],
                 *[F.min(c).cast("double").alias(f"lo_{c}") for c in cols],
                 *[F.max(c).cast("double").alias(f"hi_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"t_{c}").alias("dtype"),
                              F.col(f"lo_{c}").alias("min_value"), F.col(f"hi_{c}").alias("max_value"))
                     for c in cols])
    return agg.select(F.inline(rows))


@query("narrow_types_stored", ORACLES["narrow_types"])
def q_narrow_types_stored(spark, d):
    """PRJ-9 with the ranges observed by the pass that stores the rows."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "value")
    return _type_report(P.store_narrow(events, _scratch(spark, "narrow")))


def _pair_inputs(spark, d):
    s = samples(spark, d).select(composite_key("patient", "timestep").alias("key"),
                                 F.array("fpzcz", "pzoz", "horizontal").alias("values"))
    lab = P.label_stages(labels_typed(spark, d), "keep").select(
        composite_key("patient", "timestep").alias("key"), F.array(F.col("label").cast("float")).alias("values"))
    return P.pair_join(s, lab)


PAIR_SQL = with_views("""SELECT patient || '_' || CAST(timestep AS VARCHAR) AS key, fpzcz, pzoz, horizontal,
  label FROM labeled""", "labeled")


@query("pair_join", f"""SELECT key, 4 AS n_values, fpzcz AS v1, pzoz AS v2, horizontal AS v3,
  CAST(label AS FLOAT) AS v4 FROM ({PAIR_SQL})""")
def q_pair_join(spark, d):
    """JN-2: (key, values) pairs joined, value arrays concatenated."""
    j = _pair_inputs(spark, d)
    return j.select("key", F.size("values").alias("n_values"),
                    *[F.element_at("values", i).alias(f"v{i}") for i in range(1, 5)])


@query("row_reorder", f"SELECT key, label, horizontal, fpzcz FROM ({PAIR_SQL})")
def q_row_reorder(spark, d):
    """PRJ-10: fields of the joined value list picked in a new order."""
    j = _pair_inputs(spark, d)
    return j.select("key", F.element_at("values", 4).cast("int").alias("label"),
                    F.element_at("values", 3).alias("horizontal"), F.element_at("values", 1).alias("fpzcz"))


# ---- 2.3 filters ------------------------------------------------------------------

@query("stage_map", with_views(f"""SELECT patient, timestep, condition, {stage_case('condition')} AS label
  FROM labels_raw""", "labels_raw"))
def q_stage_map(spark, d):
    """FN-1: stage name -> class id, -1 when unknown."""
    return P.label_stages(labels_typed(spark, d), "keep")


_KNOWN = ", ".join(f"'{k}'" for k in STAGE_MAP)


@query("stage_map_strict", with_views(f"""SELECT patient, timestep, {stage_case('condition')} AS label
  FROM labels_raw WHERE condition IN ({_KNOWN})""", "labels_raw"))
def q_stage_map_strict(spark, d):
    """FN-2: strict lookup (fails on an unknown name), run on the known rows."""
    lab = labels_typed(spark, d).filter(F.col("condition").isin(list(STAGE_MAP)))
    return P.label_stages(lab, "error").select("patient", "timestep", "label")


@query("filter_known_stage", with_views(f"""SELECT * FROM (SELECT patient, timestep, condition,
  {stage_case('condition')} AS label FROM labels_raw) WHERE label <> -1""", "labels_raw"))
def q_filter_known_stage(spark, d):
    """FLT-1: unknown stages removed."""
    return P.label_stages(labels_typed(spark, d), "drop")


@query("known_stage_dim", with_views(f"""SELECT l.patient, l.timestep, l.condition, CAST(m.label AS INTEGER) AS label
  FROM labels_raw l JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in STAGE_MAP.items())}) m(condition, label)
  ON l.condition = m.condition""", "labels_raw"))
def q_known_stage_dim(spark, d):
    """FLT-6: inner join to the stage dimension table."""
    return P.keep_known_stages(labels_typed(spark, d)).select("patient", "timestep", "condition", "label")


@query("holdout_test_rows", with_views(f"""SELECT patient, timestep FROM samples
  WHERE patient IN (SELECT unit_id FROM ({HOLD_IDS_SQL}))""", "samples"))
def q_holdout_test_rows(spark, d):
    """FLT-2: rows of k hash-chosen recordings (a literal id list)."""
    return SP.rows_in(samples(spark, d), "patient", holdout_ids(spark, d)).select("patient", "timestep")


@query("holdout_train_rows", with_views(f"""SELECT patient, timestep FROM samples
  WHERE patient NOT IN (SELECT unit_id FROM ({HOLD_IDS_SQL}))""", "samples"))
def q_holdout_train_rows(spark, d):
    """FLT-3: all other rows."""
    return SP.rows_not_in(samples(spark, d), "patient", holdout_ids(spark, d)).select("patient", "timestep")


@query("single_recording", with_views(f"""SELECT patient, timestep, fpzcz FROM samples
  WHERE patient = (SELECT unit_id FROM ({HOLD_IDS_SQL}) ORDER BY substr(md5(unit_id || '{SEED}'), 1, 8), unit_id
  LIMIT 1)""", "samples"))
def q_single_recording(spark, d):
    """FLT-4: one recording."""
    rid = holdout_ids(spark, d, 1)[0]
    return SP.single_recording(samples(spark, d), rid).select("patient", "timestep", "fpzcz")


@query("every_nth_row", with_views(f"""SELECT patient, timestep FROM (SELECT patient, timestep,
  row_number() OVER (PARTITION BY patient ORDER BY timestep) - 1 AS p FROM samples) WHERE p % {N} = 0""", "samples"))
def q_every_nth_row(spark, d):
    """FLT-5: every n-th row of each recording by position."""
    return O.every_nth_row(samples(spark, d).select("patient", "timestep"), N)


CROP_BODY = """SELECT a.patient, a.description, greatest(a.onset, b.crop_lo) AS onset,
  least(a.onset + a.duration, b.crop_hi) - greatest(a.onset, b.crop_lo) AS duration, b.crop_lo, b.crop_hi
FROM annotations a JOIN b ON a.patient = b.patient
WHERE a.onset <= b.crop_hi AND a.onset + a.duration >= b.crop_lo"""
CROP_CTES = """
pos AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY onset, duration, description) AS rn,
                    row_number() OVER (PARTITION BY patient ORDER BY onset DESC, duration DESC, description DESC) AS rd
          FROM annotations),
b AS (SELECT patient,
        max(CASE WHEN rn = 2 THEN onset END) - 600.0 AS crop_lo,
        CASE WHEN suffix(max(CASE WHEN rd = 1 THEN description END), 'W') THEN max(CASE WHEN rd = 1 THEN onset END)
             ELSE max(CASE WHEN rd = 2 THEN onset END) END + 600.0 AS crop_hi
      FROM pos GROUP BY patient)"""
CROP_SQL = with_views(CROP_BODY, "annotations", extra=CROP_CTES)


# Gaps between every 1st, 5th and 25th event: lengths from seconds to days in one table.
_MIXED_SQL = """SELECT patient, k, onset AS start, "end" FROM (
  SELECT patient, k, onset, lead(onset, k) OVER (PARTITION BY patient, k ORDER BY timestep) AS "end"
  FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY onset, duration, description) - 1 AS timestep FROM annotations), (VALUES (1), (5), (25)) t(k))
  WHERE "end" IS NOT NULL"""


@query("interval_join_any", with_views("""SELECT e.patient, e.event_id, m.k, count(*) AS n, min(m.start) AS first_start, max(m."end") AS last_end
  FROM event_times e JOIN mixed m ON e.patient = m.patient AND e.t >= m.start AND e.t < m."end" GROUP BY 1, 2, 3""",
                                       "event_times", "annotations", extra=f"mixed AS ({_MIXED_SQL})"))
def q_interval_join_any(spark, d):
    """JN-3 with intervals from seconds to days: each sample's intervals by the nodes of a tree over time."""
    ann = O.ordered_index(TB.annotations(spark, d), ["patient"], ["onset", "duration", "description"], out="timestep").select("patient", "timestep", "onset")
    ends = ann.select("patient", F.col("timestep").alias("_at"), F.col("onset").alias("end"))
    starts = ann.select("patient", "timestep", F.col("onset").alias("start"), F.explode(F.array(F.lit(1), F.lit(5), F.lit(25))).alias("k"))
    mixed = starts.withColumn("_at", F.col("timestep") + F.col("k")).join(ends, ["patient", "_at"]).select("patient", "k", "start", "end")
    both = IV.interval_join_any(TB.event_times(spark, d), mixed, unit=60.0, longest=30 * 86400.0)
    return both.groupBy("patient", "event_id", "k").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


# Annotations stretched to two and a half times their length, so that most overlap the next ones.
_SWEEP_CTES = """long AS (SELECT DISTINCT patient, onset, onset + duration * 2.5 AS "end", description FROM annotations WHERE onset < onset + duration * 2.5),
pts AS (SELECT patient, onset AS t FROM long UNION SELECT patient, "end" FROM long),
seg AS (SELECT *, lead(t) OVER (PARTITION BY patient ORDER BY t) AS u, row_number() OVER (PARTITION BY patient ORDER BY t) AS i FROM pts),
won AS (SELECT * FROM (SELECT s.patient, s.t, s.u, s.i, l.onset, l."end", l.description, row_number() OVER (
          PARTITION BY s.patient, s.t ORDER BY l.onset DESC, l."end", l.description DESC NULLS LAST) AS place
        FROM seg s JOIN long l ON s.patient = l.patient AND s.t >= l.onset AND s.t < l."end" WHERE s.u IS NOT NULL) WHERE place = 1),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY patient, onset, "end", description ORDER BY i) AS run FROM won)"""


def _long_annotations(spark, d):
    return TB.annotations(spark, d).withColumn("duration", F.col("duration") * 2.5)


@query("disjoint_intervals", with_views("""SELECT patient, min(t) AS onset, max(u) AS "end", onset AS of_start, "end" AS of_end, description
  FROM runs GROUP BY patient, onset, "end", description, run""", "annotations", extra=_SWEEP_CTES))
def q_disjoint_intervals(spark, d):
    """WIN-2/JN-3 on overlapping annotations: the pieces that each of them owns."""
    ann = _long_annotations(spark, d).select("patient", "onset", (F.col("onset") + F.col("duration")).alias("end"), "description")
    return SW.disjoint_intervals(ann, longest=30 * 86400.0)


@query("label_overlapping", with_views("""SELECT e.patient, e.event_id, w.description AS condition FROM event_times e
  JOIN won w ON e.patient = w.patient AND e.t >= w.t AND e.t < w.u""", "event_times", "annotations", extra=_SWEEP_CTES))
def q_label_overlapping(spark, d):
    """JN-3 with overlapping annotations made disjoint first: a sample has one label."""
    ann = _long_annotations(spark, d).select("patient", "onset", (F.col("onset") + F.col("duration")).alias("end"), "description")
    iv = SW.disjoint_intervals(ann, longest=30 * 86400.0).select("patient", F.col("onset").alias("start"), "end", F.col("description").alias("condition"))
    both = IV.interval_join_any(TB.event_times(spark, d), iv, unit=60.0, longest=30 * 86400.0)
    return both.select("patient", "event_id", "condition")


@query("crop_recording", CROP_SQL)
def q_crop_recording(spark, d):
    """FLT-7: annotations cropped to [2nd onset - 10 min, last wake onset + 10 min]."""
    return IV.crop_annotations(TB.annotations(spark, d))


# ---- 2.4 joins ------------------------------------------------------------------------

@query("label_join", with_views("SELECT * FROM labeled", "labeled"))
def q_label_join(spark, d):
    """JN-1: samples joined to per-sample labels on (patient, timestep)."""
    lab = P.label_stages(labels_typed(spark, d), "keep")
    return P.label_join(samples(spark, d), lab).select(
        "patient", "timestep", "time", "fpzcz", "pzoz", "horizontal", "label")


@query("bucketed_epochs", with_views("""SELECT patient, epoch, COUNT(*) AS n_samples, CAST(trunc(avg(label)) AS INTEGER) AS label_mean,
  arg_min(label, timestep) AS label_first, arg_min(fpzcz, timestep) AS fpzcz_first, arg_max(horizontal, timestep) AS horizontal_last
  FROM prep GROUP BY patient, epoch""", "prep"))
def q_bucketed_epochs(spark, d):
    """SNK-1 with JN-1 and AG-1: samples and labels stored in buckets of (patient, epoch), joined
    and assembled without an exchange."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    smp, lab = BK.store_samples(samples(spark, d), P.label_stages(labels_typed(spark, d), "drop"),
                                f"sigframe_{uuid.uuid4().hex}", _scratch(spark, "buckets"), buckets, N)
    ep = E.assemble_epochs(BK.stored_label_join(smp, lab), order="timestep", n=N)
    return ep.select("patient", "epoch", "n_samples", "label_mean", "label_first", F.element_at("fpzcz", 1).alias("fpzcz_first"),
                     F.element_at("horizontal", -1).alias("horizontal_last"))


@query("interval_join", with_views(f"""SELECT s.patient, s.event_id, s.t, c.chunk_onset, c.description AS condition
  FROM event_times s JOIN chunks c ON s.patient = c.patient AND s.t >= c.chunk_onset
  AND s.t < c.chunk_onset + {CHUNK_S}""", "event_times", "chunks"))
def q_interval_join(spark, d):
    """JN-3/WIN-2/FN-17: each event labelled by the annotation chunk containing it."""
    out = IV.label_samples_by_chunks(TB.event_times(spark, d), TB.annotations(spark, d), chunk=CHUNK_S)
    return out.select("patient", "event_id", "t", "chunk_onset", "condition")


@query("epoch_seconds", with_views("""SELECT patient, timestep, round(timestep / 100.0, 6) AS t_start,
  round(timestep / 100.0 + 29.99, 6) AS t_end FROM samples""", "samples"))
def q_epoch_seconds(spark, d):
    """FN-17: sample number to seconds, and the end of an epoch of 30 s at 100 Hz that starts there."""
    out = IV.epoch_seconds(samples(spark, d).select("patient", "timestep"))
    return out.select("patient", "timestep", r("t_start"), r("t_end"))


GENERATE_SQL = with_views(f"""
SELECT patient, row_number() OVER (PARTITION BY patient ORDER BY t, event_id) - 1 AS timestep,
  round(t - chunk_onset, 6) AS "time", {stage_case('condition')} AS label, fpzcz, horizontal
FROM (SELECT s.patient, s.event_id, s.t, c.condition, c.onset + c.k * {CHUNK_S} AS chunk_onset,
        CAST(e.value AS FLOAT) AS fpzcz, CAST(e.event_id % 97 AS FLOAT) AS horizontal
      FROM event_times s JOIN events e ON s.event_id = e.event_id
      JOIN (SELECT patient, onset, description AS condition,
              unnest(range(0, CAST(floor(duration / {CHUNK_S}) AS BIGINT))) AS k FROM cropped) c
        ON s.patient = c.patient AND s.t >= c.onset + c.k * {CHUNK_S} AND s.t < c.onset + (c.k + 1) * {CHUNK_S})""",
    "event_times", "annotations", extra=CROP_CTES + f""",
cropped AS ({CROP_BODY})""")


@query("recording_tables", GENERATE_SQL)
def q_recording_tables(spark, d):
    """The data-generation chain: crop, chunks, interval join and sample numbers. The sample and
    the label table are both written and joined back on (patient, timestep)."""
    channels = ["fpzcz", "horizontal"]
    rows = IV.recording_tables(TB.timed_samples(spark, d), TB.annotations(spark, d), channels,
                               chunk=CHUNK_S, ties=("event_id",))
    path = _scratch(spark, "tables")
    rows.write.parquet(path + "/rows")
    stored = spark.read.parquet(path + "/rows")
    IV.sample_table(stored, channels).write.parquet(path + "/data")
    IV.label_table(stored).write.parquet(path + "/labels")
    data, labels = spark.read.parquet(path + "/data"), spark.read.parquet(path + "/labels")
    both = P.label_join(data, P.label_stages(labels.drop("time"), "keep"))
    return both.select("patient", "timestep", r("time"), "label", *channels)


@query("holdout_semi_anti", with_views(f"""SELECT patient, timestep,
  CASE WHEN person IN (SELECT person FROM (SELECT DISTINCT person FROM p)
       ORDER BY substr(md5(person || '{SEED}'), 1, 8), person LIMIT {K_HOLDOUT}) THEN 'test' ELSE 'train' END AS side
  FROM p""", "samples", extra="""
p AS (SELECT *, 'S' || CAST(CAST(substr(patient, 2) AS BIGINT) // 2 AS VARCHAR) AS person FROM samples)"""))
def q_holdout_semi_anti(spark, d):
    """JN-5/D10: persons (here two recordings each, named by a column) held out in one
    pass, by a broadcast join with the k chosen ids."""
    rows = samples(spark, d).withColumn("person", F.expr("concat('S', CAST(substr(patient, 2) AS BIGINT) div 2)"))
    return SP.tag_holdout(rows, K_HOLDOUT, SEED, col="person", unit="recording").select("patient", "timestep", "side")


# ---- 2.5 aggregations -------------------------------------------------------------------

@query("epoch_assemble", with_views("""SELECT patient, epoch, CAST(row_number() OVER (PARTITION BY patient, epoch
  ORDER BY "time") - 1 AS INTEGER) AS pos, fpzcz, pzoz, horizontal, COUNT(*) OVER (PARTITION BY patient, epoch)
  AS n_samples FROM prep""", "prep"))
def q_epoch_assemble(spark, d):
    """AG-1: ordered per-epoch channel arrays, exploded with positions."""
    ep = E.assemble_epochs(prep_rows(spark, d), layout="channel", label_rule=None, n=N)
    return ep.select("patient", "epoch", "n_samples",
                     F.posexplode(F.arrays_zip("fpzcz", "pzoz", "horizontal")).alias("pos", "s")) \
             .select("patient", "epoch", "pos", "s.fpzcz", "s.pzoz", "s.horizontal", "n_samples")


@query("epoch_label_mean", with_views("""SELECT patient, epoch, CAST(trunc(avg(label)) AS INTEGER) AS label
  FROM prep GROUP BY patient, epoch""", "prep"))
def q_epoch_label_mean(spark, d):
    """AG-2."""
    return E.epoch_label_mean(prep_rows(spark, d))


@query("epoch_label_first", with_views("""SELECT patient, epoch, arg_min(label, "time") AS label
  FROM prep GROUP BY patient, epoch""", "prep"))
def q_epoch_label_first(spark, d):
    """AG-3."""
    return E.epoch_label_first(prep_rows(spark, d))


TM_SQL = with_views("""SELECT patient, epoch, CAST(row_number() OVER (PARTITION BY patient, epoch
  ORDER BY "time") - 1 AS INTEGER) AS pos, fpzcz AS c0, pzoz AS c1, horizontal AS c2 FROM prep""", "prep")


@query("epoch_time_major", TM_SQL)
def q_epoch_time_major(spark, d):
    """AG-4: (n, channels) layout, exploded by row."""
    ep = E.assemble_epochs(prep_rows(spark, d), layout="time", label_rule=None, n=N)
    return ep.select("patient", "epoch", F.posexplode("features").alias("pos", "row")).select(
        "patient", "epoch", "pos", *[F.element_at("row", i + 1).alias(f"c{i}") for i in range(3)])


@query("distinct_recordings", with_views("SELECT DISTINCT patient FROM samples", "samples"))
def q_distinct_recordings(spark, d):
    """AG-5."""
    return samples(spark, d).select("patient").distinct()


def _stats_sql(src):
    parts = ["COUNT(*) AS n"]
    for c in CHANNELS:
        parts += [f"round(avg({c}), 6) AS {c}_mean", f"round(stddev_samp({c}), 6) AS {c}_std_samp",
                  f"round(stddev_pop({c}), 6) AS {c}_std_pop"]
    return f"SELECT {', '.join(parts)} FROM {src}"


@query("scaler_stats", with_views(_stats_sql("samples"), "samples"))
def q_scaler_stats(spark, d):
    """AG-6: mean, sample and population std per channel."""
    st = S.scaler_stats(samples(spark, d))
    return st.select("n", *[r(c) for c in st.columns if c != "n"])


def _apart_sql(c):
    return f"""count(s.{c}) AS {c}_n, round(avg(s.{c}), 6) AS {c}_mean, round(stddev_pop(s.{c}), 6) AS {c}_std_pop"""


@query("scaler_leave_one_out", with_views(f"""SELECT p.patient, {", ".join(_apart_sql(c) for c in CHANNELS)}
  FROM (SELECT DISTINCT patient FROM samples) p JOIN samples s ON s.patient <> p.patient GROUP BY p.patient""", "samples"))
def q_scaler_leave_one_out(spark, d):
    """AG-6/FN-16/SPL-1: the scaler of all other recordings for each one, from a stored table of moments."""
    path = _scratch(spark, "moments")
    S.moments(samples(spark, d)).write.parquet(path)
    out = S.leave_one_out(spark.read.parquet(path))
    return out.select("patient", *[c if c.endswith("_n") else r(c) for c in out.columns[1:]])


PREDS_SQL = with_views("SELECT * FROM preds", "preds")


@query("accuracy", with_views("""SELECT round(avg(CASE WHEN label IS NOT DISTINCT FROM y_pred THEN 1 ELSE 0 END), 9)
  AS accuracy, COUNT(*) AS n FROM preds""", "preds"))
def q_accuracy(spark, d):
    """AG-7/FN-12: mean of the NULL-safe equality flag."""
    return V.accuracy(TB.preds(spark, d)).select(r("accuracy", 9), "n")


@query("confusion_matrix", with_views("""SELECT COALESCE(g.t, c.t) AS y_true, COALESCE(g.p, c.p) AS y_pred,
  COALESCE(c.n, 0) AS count
  FROM (SELECT CAST(t AS INTEGER) AS t, CAST(p AS INTEGER) AS p FROM range(5) a(t), range(5) b(p)) g
  FULL JOIN (SELECT label AS t, y_pred AS p, COUNT(*) AS n FROM preds GROUP BY 1, 2) c ON g.t = c.t AND g.p = c.p""",
                                      "preds"))
def q_confusion_matrix(spark, d):
    """AG-8: dense long confusion matrix."""
    return V.confusion_matrix(TB.preds(spark, d))


@query("confusion_matrix_wide", with_views(f"""SELECT label AS y_true,
  {", ".join(f"COUNT(*) FILTER (WHERE y_pred = {k}) AS pred_{k}" for k in range(N_CLASSES))},
  COUNT(*) FILTER (WHERE real AND (y_pred IS NULL OR y_pred NOT BETWEEN 0 AND 4)) AS pred_other
  FROM (SELECT label, y_pred, true AS real FROM preds
        UNION ALL SELECT CAST(t AS INTEGER), NULL, false FROM range(5) a(t)) GROUP BY label""", "preds"))
def q_confusion_matrix_wide(spark, d):
    """AG-8 wide form."""
    return V.confusion_matrix_wide(TB.preds(spark, d))


def _report_ctes(by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""
c AS (SELECT {b}label AS cls, 1 AS is_true, 0 AS is_pred,
               CASE WHEN label IS NOT DISTINCT FROM y_pred THEN 1 ELSE 0 END AS tp FROM preds
        UNION ALL SELECT {b}y_pred, 0, 1, 0 FROM preds),
agg AS (SELECT {b}cls, sum(tp) AS tp, sum(is_true) AS support, sum(is_pred) AS predicted FROM c GROUP BY {b}cls),
pr AS (SELECT {b}cls, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM agg),
rep AS (SELECT {b}cls AS label, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  CAST(support AS BIGINT) AS support FROM pr)"""


def _report_q(by: str = "") -> str:
    b = f"{by}, " if by else ""
    return with_views(f"""SELECT {b}label, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f1, 9) AS f1, support FROM rep""", "preds", extra=_report_ctes(by))


REPORT_AVG_SQL = with_views("""
SELECT 'accuracy' AS kind, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall,
  round(sum(recall * support) / sum(support), 9) AS f1, CAST(sum(support) AS BIGINT) AS support FROM rep
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
  CAST(sum(support) AS BIGINT) FROM rep
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
  round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
  CAST(sum(support) AS BIGINT) FROM rep""", "preds", extra=_report_ctes())


def _round_report(df, by=()):
    return df.select(*by, "label", r("precision", 9), r("recall", 9), r("f1", 9), "support")


@query("class_report", _report_q())
def q_class_report(spark, d):
    """AG-9: per class precision, recall, f1, support."""
    return _round_report(V.class_report(TB.preds(spark, d)))


@query("class_report_by_recording", _report_q("patient"))
def q_class_report_by_recording(spark, d):
    """ML-5: the class report per recording."""
    return _round_report(V.class_report(TB.preds(spark, d), by=["patient"]), ["patient"])


@query("class_report_avg", REPORT_AVG_SQL)
def q_class_report_avg(spark, d):
    """AG-10: accuracy, macro and weighted averages."""
    rep = V.class_report(TB.preds(spark, d))
    avg = V.class_report_avg(rep)
    return avg.select("kind", r("precision", 9), r("recall", 9), r("f1", 9), "support")


@query("class_support", with_views("SELECT label, COUNT(*) AS support FROM preds GROUP BY label", "preds"))
def q_class_support(spark, d):
    """AG-11/AG-12."""
    return V.class_support(TB.preds(spark, d))


@query("persisted_reports", with_views("""SELECT 'accuracy' AS kind, CAST(NULL AS INTEGER) AS label,
  round(avg(CASE WHEN label IS NOT DISTINCT FROM y_pred THEN 1.0 ELSE 0.0 END), 9) AS value FROM preds
  UNION ALL SELECT 'support', label, CAST(COUNT(*) AS DOUBLE) FROM preds GROUP BY label""", "preds"))
def q_persisted_reports(spark, d):
    """SNK-4: predictions kept for two reports, both written before they are released."""
    path = _scratch(spark, "reports")
    with persisted(TB.preds(spark, d)) as p:
        V.accuracy(p).select(F.lit("accuracy").alias("kind"), F.lit(None).cast("int").alias("label"),
                             r("accuracy", 9).alias("value")).write.parquet(path + "/accuracy")
        V.class_support(p).select(F.lit("support").alias("kind"), "label",
                                  F.col("support").cast("double").alias("value")).write.parquet(path + "/support")
    return spark.read.parquet(path + "/accuracy", path + "/support")


# ---- 2.6 windows, ordering, limits ---------------------------------------------------------

@query("tumbling_epoch", with_views(f"""SELECT patient, timestep, CAST(floor(timestep / {N}) AS BIGINT) AS epoch
  FROM samples""", "samples"))
def q_tumbling_epoch(spark, d):
    """WIN-1/FN-6."""
    return P.tumbling_epoch(samples(spark, d).select("patient", "timestep"), N)


@query("annotation_chunks", with_views("SELECT patient, onset, description, chunk_idx, chunk_onset FROM chunks",
                                       "chunks"))
def q_annotation_chunks(spark, d):
    """WIN-2: annotations cut into whole chunks."""
    return IV.annotation_chunks(TB.annotations(spark, d), CHUNK_S).select(
        "patient", "onset", "description", "chunk_idx", "chunk_onset")


@query("nth_annotation", with_views("""SELECT patient,
  max(CASE WHEN rn = 2 THEN onset END) AS second_onset, max(CASE WHEN rn = 2 THEN description END) AS second_description,
  max(CASE WHEN rd = 1 THEN onset END) AS last_onset, max(CASE WHEN rd = 1 THEN description END) AS last_description
  FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY onset, duration, description) AS rn,
          row_number() OVER (PARTITION BY patient ORDER BY onset DESC, duration DESC, description DESC) AS rd
        FROM annotations) GROUP BY patient HAVING max(CASE WHEN rn = 2 THEN 1 END) = 1""", "annotations"))
def q_nth_annotation(spark, d):
    """WIN-3: second and last annotation of each recording (one position pass,
    one grouped aggregate)."""
    lm = IV.annotation_landmarks(TB.annotations(spark, d))
    return lm.filter(F.col("second_onset").isNotNull()).select(
        "patient", "second_onset", "second_description", "last_onset", "last_description")


@query("stage_timeline", with_views("""SELECT patient, row_number() OVER (PARTITION BY patient ORDER BY timestep) - 1
  AS epoch, CAST(label AS VARCHAR) AS y_true, CAST(y_pred AS VARCHAR) AS y_pred FROM preds""", "preds"))
def q_stage_timeline(spark, d):
    """ML-8/WIN-4/PRJ-5/SRT-4: ordinal per recording with string stages."""
    return V.stage_timeline(TB.preds(spark, d), order="timestep").orderBy(
        "patient", F.col("y_true").desc(), "epoch")


@query("timeline_by_stage", with_views("""SELECT patient, epoch, y_true, y_pred,
  row_number() OVER (PARTITION BY patient ORDER BY y_true DESC, epoch DESC) - 1 AS ord
  FROM (SELECT patient, row_number() OVER (PARTITION BY patient ORDER BY timestep) - 1 AS epoch,
          CAST(label AS VARCHAR) AS y_true, CAST(y_pred AS VARCHAR) AS y_pred FROM preds)""", "preds"))
def q_timeline_by_stage(spark, d):
    """SRT-4: the timeline sorted by stage, latest class first, with the order as a column."""
    timeline = V.stage_timeline(TB.preds(spark, d), order="timestep")
    return O.sort_with_ordinal(timeline, ["patient"], ["y_true", "epoch"], descending=True)


@query("sorted_samples", with_views("""SELECT patient, epoch, "time",
  row_number() OVER (PARTITION BY patient ORDER BY epoch, "time") - 1 AS ord FROM prep""", "prep"))
def q_sorted_samples(spark, d):
    """SRT-1/SRT-3: sorted by recording, epoch, time, with the in-recording ordinal."""
    return O.sort_with_ordinal(prep_rows(spark, d).select("patient", "epoch", "time"), ["patient"],
                               ["epoch", "time"])


@query("sorted_lexicographic", with_views("""SELECT patient || '_' || CAST(timestep AS VARCHAR) AS primary_key,
  row_number() OVER (ORDER BY patient || '_' || CAST(timestep AS VARCHAR)) - 1 AS ord FROM samples""", "samples"))
def q_sorted_lexicographic(spark, d):
    """SRT-2/D4: global sort by the string key (P1_10 before P1_2), with positions."""
    keyed = samples(spark, d).select(composite_key("patient", "timestep").alias("primary_key"))
    return O.sort_with_ordinal(keyed, [], ["primary_key"])


@query("top_n", with_views("""SELECT patient, timestep, fpzcz, CAST(row_number() OVER (ORDER BY patient, timestep) - 1
  AS INTEGER) AS ord FROM samples ORDER BY patient, timestep LIMIT 10""", "samples"))
def q_top_n(spark, d):
    """LIM-1: first 10 rows under (patient, timestep), with their places."""
    return O.top_n(samples(spark, d).select("patient", "timestep", "fpzcz"), 10, ["patient", "timestep"],
                   ordinal="ord")


# ---- 2.7 set operations ----------------------------------------------------------------

@query("union_recordings", SAMPLES_SQL)
def q_union_recordings(spark, d):
    """SET-1: held-out and remaining recordings appended back by column name."""
    train, test = SP.holdout_split(samples(spark, d), K_HOLDOUT, SEED, unit="recording")
    test = test.select(*reversed(test.columns))
    return train.unionByName(test)


# ---- 2.8 scalar, array, vector functions ------------------------------------------------

@query("epoch_flatten", with_views("""
SELECT patient, epoch, CAST(pos AS INTEGER) AS idx, fpzcz AS value FROM t
UNION ALL SELECT patient, epoch, CAST(n + pos AS INTEGER), pzoz FROM t
UNION ALL SELECT patient, epoch, CAST(2 * n + pos AS INTEGER), horizontal FROM t""", "prep", extra="""
t AS (SELECT patient, epoch, fpzcz, pzoz, horizontal,
          row_number() OVER (PARTITION BY patient, epoch ORDER BY "time") - 1 AS pos,
          COUNT(*) OVER (PARTITION BY patient, epoch) AS n FROM prep)"""))
def q_epoch_flatten(spark, d):
    """FN-7: channel-major flat features."""
    ep = E.assemble_epochs(prep_rows(spark, d), layout="channel", label_rule=None, n=N)
    return ep.select("patient", "epoch", F.posexplode("features").alias("idx", "value"))


@query("epoch_transpose", with_views("""SELECT patient, epoch, CAST(row_number() OVER (PARTITION BY patient, epoch
  ORDER BY "time") - 1 AS INTEGER) AS pos, fpzcz AS c0, pzoz AS c1, horizontal AS c2, 1 AS roundtrip_ok FROM prep""",
                                     "prep"))
def q_epoch_transpose(spark, d):
    """FN-8: channel-major -> time-major, and back (checked equal)."""
    ep = E.assemble_epochs(prep_rows(spark, d), layout="channel", label_rule=None, n=N)
    tm = ep.select("patient", "epoch", "features",
                   channel_major_to_time_major(F.col("features"), 3).alias("tm"))
    tm = tm.withColumn("roundtrip_ok", (time_major_to_channel_major(F.col("tm"), 3) == F.col("features")).cast("int"))
    return tm.select("patient", "epoch", "roundtrip_ok", F.posexplode("tm").alias("pos", "row")).select(
        "patient", "epoch", "pos", *[F.element_at("row", i + 1).alias(f"c{i}") for i in range(3)], "roundtrip_ok")


@query("scaled_channels", with_views("""SELECT patient, timestep,
  CAST(fpzcz * (1.0 / stddev_samp(fpzcz) OVER ()) AS FLOAT) AS scaled_fpzcz,
  CAST(pzoz * (1.0 / stddev_samp(pzoz) OVER ()) AS FLOAT) AS scaled_pzoz,
  CAST(horizontal * (1.0 / stddev_samp(horizontal) OVER ()) AS FLOAT) AS scaled_horizontal FROM samples""",
                                     "samples"))
def q_scaled_channels(spark, d):
    """FN-14/FN-15/FN-9: VectorAssembler + StandardScaler, elements back to floats."""
    out = S.ml_scaled_channels(samples(spark, d))
    return out.select("patient", "timestep", "scaled_fpzcz", "scaled_pzoz", "scaled_horizontal")


ZSCORE_SQL = with_views("""
SELECT patient, timestep, CASE WHEN patient IN (SELECT unit_id FROM ids) THEN 'test' ELSE 'train' END AS side,
  round((fpzcz - m0) / s0, 6) AS fpzcz, round((pzoz - m1) / s1, 6) AS pzoz,
  round((horizontal - m2) / s2, 6) AS horizontal FROM samples, st""", "samples", extra=f"""
ids AS ({HOLD_IDS_SQL}),
tr AS (SELECT * FROM samples WHERE patient NOT IN (SELECT unit_id FROM ids)),
st AS (SELECT avg(fpzcz) AS m0, stddev_pop(fpzcz) AS s0, avg(pzoz) AS m1, stddev_pop(pzoz) AS s1,
              avg(horizontal) AS m2, stddev_pop(horizontal) AS s2 FROM tr)""")


@query("zscore_channels", ZSCORE_SQL)
def q_zscore_channels(spark, d):
    """FN-16/D8/D9: z-score with population std fitted on training recordings only
    and applied to the held-out ones."""
    tagged = SP.tag_holdout(samples(spark, d), K_HOLDOUT, SEED, unit="recording")
    return S.scale_tagged(tagged, mode="zscore_pop").select("patient", "timestep", "side", *[r(c) for c in CHANNELS])


@query("array_vector_roundtrip", """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, 1 AS same,
  embedding[1] AS first_value FROM embeddings""")
def q_array_vector_roundtrip(spark, d):
    """FN-10: array -> ML vector -> array gives the same floats."""
    e = TB.embeddings(spark, d).withColumn("v", array_to_vector("embedding"))
    back = vector_to_array("v", "float32")
    return e.select("vec_id", F.size(back).alias("dim"), (back == F.col("embedding")).cast("int").alias("same"),
                    F.element_at(back, 1).alias("first_value"))


@query("argmax_label", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER)
  AS y_pred FROM embeddings""")
def q_argmax_label(spark, d):
    """FN-11: index of the largest score, first maximum wins."""
    return TB.embeddings(spark, d).select("vec_id", argmax("embedding").alias("y_pred"))


@query("one_hot", with_views(f"""SELECT patient, timestep,
  {", ".join(f"CASE WHEN label = {k} THEN 1.0 ELSE 0.0 END AS oh_{k}" for k in range(N_CLASSES))} FROM preds""",
                             "preds"))
def q_one_hot(spark, d):
    """FN-13."""
    p = TB.preds(spark, d).withColumn("oh", one_hot("label", N_CLASSES))
    return p.select("patient", "timestep", *[F.element_at("oh", k + 1).alias(f"oh_{k}") for k in range(N_CLASSES)])


@query("relu_softmax", """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(x, 0.0::FLOAT)) AS a FROM embeddings),
e AS (SELECT vec_id, list_transform(a, lambda x: exp(x - list_max(a))) AS ex FROM r),
s AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM e)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS top_class,
  round(list_max(p), 9) AS p_max, round(list_sum(p), 9) AS p_sum FROM s""")
def q_relu_softmax(spark, d):
    """SIG-5/SIG-6: rectified scores turned into probabilities."""
    e = TB.embeddings(spark, d).select("vec_id", softmax(relu_array("embedding")).alias("p"))
    return e.select("vec_id", argmax("p").alias("top_class"), r(F.array_max("p"), 9).alias("p_max"),
                    r(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 9).alias("p_sum"))


# ---- 2.9 sampling and splitting --------------------------------------------------------

@query("group_holdout", with_views(HOLD_IDS_SQL, "samples"))
def q_group_holdout(spark, d):
    """SPL-1: k recordings with the smallest seeded hash."""
    return SP.pick_holdout(samples(spark, d), K_HOLDOUT, SEED)


EPOCH_KEYS_SQL = "SELECT DISTINCT patient || '_' || CAST(epoch AS VARCHAR) AS primary_key FROM prep"


@query("hash_split", with_views(f"""SELECT primary_key, CASE WHEN substr(md5(primary_key || '{SEED}'), 1, 8)
  < 'cccccccd' THEN 'train' ELSE 'test' END AS side FROM ({EPOCH_KEYS_SQL})""", "prep"))
def q_hash_split(spark, d):
    """SPL-2: 80/20 split of epochs by seeded hash of the epoch key."""
    keys = flagship(spark, d).select("primary_key")
    return SP.tag_split(keys, "primary_key", 0.2, SEED)


@query("hash_split_exact", with_views(f"""SELECT primary_key,
  CASE WHEN rn <= (SELECT floor(0.2 * COUNT(*) + 0.5) FROM ({EPOCH_KEYS_SQL})) THEN 'test' ELSE 'train' END AS side
  FROM (SELECT primary_key, row_number() OVER (ORDER BY md5(primary_key || '{SEED}'), primary_key) AS rn
        FROM ({EPOCH_KEYS_SQL}))""", "prep"))
def q_hash_split_exact(spark, d):
    """SPL-2 exact: exactly 20 % of the epochs in test, those of the smallest seeded hashes."""
    return SP.tag_split_exact(flagship(spark, d).select("primary_key"), "primary_key", 0.2, SEED)


@query("hash_split_3way", with_views(f"""SELECT primary_key, CASE
  WHEN substr(md5(primary_key || '{SEED}'), 1, 8) < 'b3333333' THEN 'train'
  WHEN substr(md5(primary_key || '{SEED}'), 1, 8) < 'cccccccd' THEN 'val'
  ELSE 'test' END AS split FROM ({EPOCH_KEYS_SQL})""", "prep"))
def q_hash_split_3way(spark, d):
    """SPL-3: train / validation / test by the same hash."""
    keys = flagship(spark, d).select("primary_key")
    return SP.hash_split_3way(keys, "primary_key", 0.1, 0.2, SEED)


# ---- 2.11 signal features -----------------------------------------------------------------

SIG_COLS = ["fpzcz", "pzoz", "horizontal"]


def _sig_rows(spark, d):
    return prep_rows(spark, d).select("patient", "epoch", "pos", *SIG_COLS)


# 8 samples: pools of 4 without padding give 2 outputs; 5 taps with stride 2 give 4 and pad 1 on the left.
@query("strided_max", with_views("""SELECT g.patient, g.epoch, g.out_pos, max(fpzcz) AS fpzcz, max(pzoz) AS pzoz,
  max(horizontal) AS horizontal
  FROM (SELECT patient, epoch, CAST(o AS INTEGER) AS out_pos
        FROM (SELECT DISTINCT patient, epoch FROM prep), range(2) t(o)) g
  LEFT JOIN prep s ON s.patient = g.patient AND s.epoch = g.epoch AND s.pos // 4 = g.out_pos
  GROUP BY 1, 2, 3""", "prep"))
def q_strided_max(spark, d):
    """SIG-1: max pooling, pool = stride = 4 over 8-sample epochs."""
    return SIG.strided_max(_sig_rows(spark, d), SIG_COLS, POOL, N)


_FIR_SQL = with_views("""SELECT g.patient, g.epoch, g.out_pos, round(COALESCE(sum(fpzcz * w), 0), 6) AS fpzcz,
  round(COALESCE(sum(pzoz * w), 0), 6) AS pzoz, round(COALESCE(sum(horizontal * w), 0), 6) AS horizontal
  FROM (SELECT patient, epoch, CAST(o AS INTEGER) AS out_pos, j, w
        FROM (SELECT DISTINCT patient, epoch FROM prep), range(4) t(o),
             (VALUES (0, 0.25::DOUBLE), (1, 0.5), (2, 1.0), (3, 0.5), (4, 0.25)) k(j, w)) g
  LEFT JOIN prep s ON s.patient = g.patient AND s.epoch = g.epoch AND s.pos = g.out_pos * 2 + j - 1
  GROUP BY 1, 2, 3""", "prep")


@query("strided_fir", _FIR_SQL)
def q_strided_fir(spark, d):
    """SIG-2: FIR filter with 5 taps, stride 2, 'same' padding."""
    out = SIG.strided_fir(_sig_rows(spark, d), SIG_COLS, FIR_TAPS, FIR_STRIDE, N)
    return out.select("patient", "epoch", "out_pos", *[r(c) for c in SIG_COLS])


def _dense_epochs(spark, d):
    rows = prep_rows(spark, d)
    ep = E.assemble_epochs(rows, order="timestep", channels=["pos", *SIG_COLS], label_rule=None)
    return AF.dense_channels(ep.drop("features"), SIG_COLS, N).select("patient", "epoch", *SIG_COLS)


def _by_place(arrays, cols):
    """One row per place of the arrays."""
    return arrays.select("patient", "epoch", F.posexplode(F.arrays_zip(*cols)).alias("out_pos", "v")).select(
        "patient", "epoch", "out_pos", *[F.col(f"v.{c}") for c in cols])


@query("strided_max_arrays", ORACLES["strided_max"])
def q_strided_max_arrays(spark, d):
    """SIG-1 inside assembled epochs: no row is added and nothing is shuffled after AG-1."""
    return _by_place(AF.array_strided_max(_dense_epochs(spark, d), SIG_COLS, POOL, N), SIG_COLS)


@query("strided_fir_arrays", ORACLES["strided_fir"])
def q_strided_fir_arrays(spark, d):
    """SIG-2 inside assembled epochs."""
    out = _by_place(AF.array_strided_fir(_dense_epochs(spark, d), SIG_COLS, FIR_TAPS, FIR_STRIDE, N), SIG_COLS)
    return out.select("patient", "epoch", "out_pos", *[r(c) for c in SIG_COLS])


@query("epoch_mean", with_views("""SELECT patient, epoch, round(avg(fpzcz), 6) AS fpzcz, round(avg(pzoz), 6) AS pzoz,
  round(avg(horizontal), 6) AS horizontal FROM prep GROUP BY 1, 2""", "prep"))
def q_epoch_mean(spark, d):
    """SIG-3: average over time per epoch and channel."""
    out = SIG.epoch_mean(_sig_rows(spark, d), SIG_COLS)
    return out.select("patient", "epoch", *[r(c) for c in SIG_COLS])


@query("row_layernorm", with_views("""
SELECT patient, timestep, round((a - mu) / sqrt(var + 1e-6), 6) AS fpzcz_ln, round((b - mu) / sqrt(var + 1e-6), 6)
  AS pzoz_ln, round((c - mu) / sqrt(var + 1e-6), 6) AS horizontal_ln FROM v""", "samples", extra="""
m AS (SELECT patient, timestep, fpzcz::DOUBLE AS a, pzoz::DOUBLE AS b, horizontal::DOUBLE AS c,
          (0.0::DOUBLE + fpzcz::DOUBLE + pzoz::DOUBLE + horizontal::DOUBLE) / 3.0 AS mu FROM samples),
v AS (SELECT *, (0.0::DOUBLE + (a - mu) * (a - mu) + (b - mu) * (b - mu) + (c - mu) * (c - mu)) / 3.0 AS var FROM m)"""))
def q_row_layernorm(spark, d):
    """SIG-4: per-sample normalisation across the channels (eps 1e-6)."""
    out = SIG.row_layernorm(samples(spark, d), SIG_COLS)
    return out.select("patient", "timestep", *[r(c + "_ln") for c in SIG_COLS])


# ---- 2.10 machine learning -----------------------------------------------------------------
# Fitted numbers are not SQL: the oracles state what must hold of them on every row.

N_ML_CLASSES, N_ML_FEATURES = 10, 64
ML_SIDE_SQL = f"""SELECT vec_id, label, CASE WHEN substr(md5(CAST(vec_id AS VARCHAR) || '{SEED}'), 1, 8)
  < 'cccccccd' THEN 'train' ELSE 'test' END AS side FROM embeddings"""


def _ml_data(spark, d):
    e = TB.embeddings(spark, d).select("vec_id", "label", array_to_vector("embedding").alias("vectors"))
    return SP.tag_split(e, "vec_id", 0.2, SEED)


def _train_side(tagged):
    return tagged.filter("side = 'train'")


def _flag(cond):
    return F.coalesce(cond, F.lit(False)).cast("int")


def _is_class(c):
    return _flag(F.col(c).between(0, N_ML_CLASSES - 1))


@query("ml_stage_fit", f"SELECT vec_id, label, side, 1 AS is_class FROM ({ML_SIDE_SQL})")
def q_ml_stage_fit(spark, d):
    """ML-1: a Spark ML pipeline fitted on the training side and applied to both sides; every
    row gets one of the classes."""
    rows = _ml_data(spark, d)
    model = M.fit(_train_side(rows), M.make_estimator("logistic", max_iter=20))
    p = M.predict(model, rows, keep=["vec_id", "label", "side"])
    return p.select("vec_id", "label", "side", _is_class("y_pred").alias("is_class"))


@query("ml_train_predict", f"""SELECT vec_id, label, 1 AS is_class, 1 AS is_argmax, CAST(1 AS DOUBLE) AS p_sum
  FROM ({ML_SIDE_SQL}) WHERE side = 'test'""")
def q_ml_train_predict(spark, d):
    """ML-2/ML-3: train a multinomial classifier, predict the test side with
    probabilities that sum to 1; argmax gives y_pred."""
    rows = _ml_data(spark, d)
    model = M.fit(_train_side(rows), M.make_estimator("logistic", max_iter=20))
    p = M.predict(model, rows.filter("side = 'test'"), keep=["vec_id", "label"])
    return p.select("vec_id", "label", _is_class("y_pred").alias("is_class"),
                    _flag(F.element_at("probs", F.col("y_pred") + 1) == F.array_max("probs")).alias("is_argmax"),
                    r(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 6).alias("p_sum"))


@query("ml_accuracy_by_split", f"SELECT side AS split, COUNT(*) AS n, 1 AS in_range FROM ({ML_SIDE_SQL}) GROUP BY side")
def q_ml_accuracy_by_split(spark, d):
    """ML-4: train and test accuracy of one model, one grouped job; each lies in 0..1."""
    rows = _ml_data(spark, d)
    model = M.fit(_train_side(rows), M.make_estimator("mlp", n_features=N_ML_FEATURES, n_classes=N_ML_CLASSES, max_iter=30))
    acc = V.accuracy(M.predict(model, rows, keep=["side", "label"]), by=["side"])
    return acc.select(F.col("side").alias("split"), "n", _flag(F.col("accuracy").between(0, 1)).alias("in_range"))


@query("ml_save_load", "SELECT vec_id, 1 AS same FROM embeddings")
def q_ml_save_load(spark, d):
    """ML-6: predictions of all rows are equal after the model is saved and loaded."""
    rows = _ml_data(spark, d)
    model = M.fit(_train_side(rows), M.make_estimator("logistic", max_iter=10))
    again = M.save_load(model, spark, f"sigframe-model-{uuid.uuid4().hex}")
    a = M.predict(model, rows, keep=["vec_id"]).select("vec_id", "y_pred")
    b = M.predict(again, rows, keep=["vec_id"]).select("vec_id", F.col("y_pred").alias("y_pred_reloaded"))
    return a.join(b, "vec_id").select("vec_id", _flag(F.col("y_pred") == F.col("y_pred_reloaded")).alias("same"))


@query("ml_learning_curve", f"""SELECT CAST(i AS INTEGER) AS round, split, n, 1 AS not_worse, 1 AS in_range
  FROM range(5) t(i), (SELECT split, COUNT(*) AS n FROM (
    SELECT CASE WHEN h < 'b3333333' THEN 'train' ELSE 'val' END AS split
    FROM (SELECT substr(md5(CAST(vec_id AS VARCHAR) || '{SEED}'), 1, 8) AS h FROM embeddings)
    WHERE h < 'cccccccd') GROUP BY split)""")
def q_ml_learning_curve(spark, d):
    """ML-7: loss and accuracy after each round on the training and the validation side. The
    training loss never rises; all accuracies lie in 0..1 and all losses are numbers."""
    e = TB.embeddings(spark, d).select("vec_id", "label", array_to_vector("embedding").alias("vectors"))
    tagged = SP.hash_split_3way(e, "vec_id", 0.1, 0.2, SEED)
    curve = M.learning_curve_by_split(tagged.filter("split = 'train'"), {"val": tagged.filter("split = 'val'")},
                                      N_ML_FEATURES, N_ML_CLASSES, rounds=5)
    # ten rows: the curve's own split is the window's key
    before = F.lag("loss").over(Window.partitionBy("split").orderBy("round"))
    falls = (F.col("split") == "val") | before.isNull() | (F.col("loss") <= before + 1e-9)
    numbers = F.col("accuracy").between(0, 1) & ~F.isnan("loss") & (F.col("loss") >= 0)
    return curve.select("round", "split", "n", _flag(falls).alias("not_worse"), _flag(numbers).alias("in_range"))


# The classes of the table do not depend on its vectors. The one below does: the place of the
# greatest of the first four entries, which a linear model can learn and one class cannot meet.
LEARNED_SQL = f"""SELECT vec_id, CAST(list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS INTEGER) AS label,
  CASE WHEN substr(md5(CAST(vec_id AS VARCHAR) || '{SEED}'), 1, 8) < 'cccccccd' THEN 'train' ELSE 'test' END AS side FROM embeddings"""


def _learnable(spark, d):
    e = TB.embeddings(spark, d).select("vec_id", argmax(F.slice("embedding", 1, 4)).cast("int").alias("label"),
                                       array_to_vector("embedding").alias("vectors"))
    return SP.tag_split(e, "vec_id", 0.2, SEED)


@query("ml_learned", f"""SELECT side AS split, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS majority, 1 AS learned, count(*) AS classes_right
  FROM (SELECT side, label, count(*) AS n FROM ({LEARNED_SQL}) GROUP BY side, label) GROUP BY side""")
def q_ml_learned(spark, d):
    """ML-1, ML-2, ML-4 on classes that follow from the vectors. ``learned``: the accuracy is at
    least half way from the share of the commonest class to 1; ``classes_right``: the classes
    of which the model predicts at least half. A model of one class fails both."""
    rows = _learnable(spark, d)
    model = M.fit(_train_side(rows), M.make_estimator("logistic", max_iter=50, reg=0.01))
    p = M.predict(model, rows, keep=["side", "label"])
    by_class = p.groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y_pred") == F.col("label")).cast("int")).alias("hits"))
    share = F.max("n") / F.sum("n")
    return by_class.groupBy(F.col("side").alias("split")).agg(
        F.sum("n").alias("n"), F.round(share, 6).alias("majority"), _flag(F.sum("hits") / F.sum("n") >= (share + 1) / 2).alias("learned"),
        F.sum((F.col("hits") * 2 >= F.col("n")).cast("int")).alias("classes_right"))


@query("ml_predictions")
def q_ml_predictions(spark, d):
    """ML-3, ML-4: the fitted numbers themselves: each row's prediction, the probability of its
    class and the accuracy of its side. Not expressible in SQL."""
    rows = _learnable(spark, d)
    model = M.fit(_train_side(rows), M.make_estimator("logistic", max_iter=50, reg=0.01))
    p = M.predict(model, rows, keep=["vec_id", "side", "label"])
    acc = V.accuracy(p, by=["side"]).select("side", "accuracy")  # a row a side
    return p.join(F.broadcast(acc), "side").select("vec_id", "side", "label", "y_pred", r(F.element_at("probs", F.col("label") + 1)).alias("p_label"),
                                                   r("accuracy"))


@query("ml_resumed_rounds", f"""SELECT CAST(i AS INTEGER) AS round, split, n, 1 AS same FROM range(4) t(i), (
  SELECT side AS split, count(*) AS n FROM ({LEARNED_SQL}) GROUP BY side)""")
def q_ml_resumed_rounds(spark, d):
    """ML-6/ML-7: training that is stopped after two rounds and goes on from the weights kept in
    the shared folder, against training in one go: the same loss and accuracy in each round."""
    rows = _learnable(spark, d)
    train, test, path = _train_side(rows), {"test": rows.filter("side = 'test'")}, _scratch(spark, "rounds")
    M.train_rounds(train, test, path, N_ML_FEATURES, 4, rounds=2)
    again = M.train_rounds(train, test, path, N_ML_FEATURES, 4, rounds=4).alias("a")
    whole = M.learning_curve_by_split(train, test, N_ML_FEATURES, 4, rounds=4).alias("w")
    near = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"w.{c}")) < 1e-6
    return again.join(whole, ["round", "split"], "full").select("round", "split", "a.n", _flag(near("loss") & near("accuracy")).alias("same"))
