"""Table schemas (data model DM-1..DM-13) and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must equal the reference for right results) --------------
# Sleep stage names and their class ids; stages 3 and 4 are merged into class 3.
STAGE_MAP = {
    "Sleep stage W": 0,
    "Sleep stage 1": 1,
    "Sleep stage 2": 2,
    "Sleep stage 3": 3,
    "Sleep stage 4": 3,
    "Sleep stage R": 4,
}
N_CLASSES = 5
# 30 s epochs at 100 Hz.
SFREQ = 100.0
EPOCH_SECONDS = 30.0
EPOCH_SAMPLES = 3000
# Crop margin around the sleep period, in seconds (the code's 10 minutes).
CROP_MARGIN_S = 600.0
# Raw channel names of the sample table and their short names.
RAW_CHANNELS = {
    "EEG Fpz-Cz": "fpzcz",
    "EEG Pz-Oz": "pzoz",
    "EOG horizontal": "horizontal",
}
RAW_DROPPED = ["EMG submental"]
CHANNELS = ["fpzcz", "pzoz", "horizontal"]
# -----------------------------------------------------------------------------

# DM-1: sample table as written by the recording export.
RAW_DATA = T.StructType([
    T.StructField("patient", T.StringType()),
    T.StructField("timestep", T.IntegerType()),
    T.StructField("time", T.FloatType()),
    T.StructField("EEG Fpz-Cz", T.FloatType()),
    T.StructField("EEG Pz-Oz", T.FloatType()),
    T.StructField("EOG horizontal", T.FloatType()),
    T.StructField("EMG submental", T.FloatType()),
])

# DM-2: one label row per sample.
RAW_LABELS = T.StructType([
    T.StructField("patient", T.StringType()),
    T.StructField("timestep", T.IntegerType()),
    T.StructField("time", T.FloatType()),
    T.StructField("condition", T.StringType()),
])

# DM-3: interval annotations (hypnogram).
ANNOTATIONS = T.StructType([
    T.StructField("patient", T.StringType()),
    T.StructField("onset", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("description", T.StringType()),
])

# DM-8: preprocessed table.
PREPROCESSED = T.StructType([
    T.StructField("patient", T.StringType()),
    T.StructField("time", T.FloatType()),
    T.StructField("fpzcz", T.FloatType()),
    T.StructField("pzoz", T.FloatType()),
    T.StructField("horizontal", T.FloatType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("epoch", T.LongType()),
])

# Preprocessed table before typing: every column a string (SRC-1 without schema).
def all_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
