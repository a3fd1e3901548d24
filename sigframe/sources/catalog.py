"""Recording file catalog (SRC-5, PRJ-7, JN-4, FN-5).

Recordings and their hypnograms share a name prefix (7 characters in the
reference's naming, e.g. a recording ``XX1234J0-PSG.edf`` and its hypnogram
``XX1234JP-Hypnogram.edf``). Listing uses the ``binaryFile`` source with only
the path selected, so no file content is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions.keys import file_name_of, recording_id


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name) of the files under ``folder`` matching the glob ``pattern``."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
               .option("recursiveFileLookup", "true").load(folder).select("path"))
    return df.withColumn("name", file_name_of("path"))


def pair_by_prefix(recordings: DataFrame, annotations: DataFrame, prefix_len: int = 7,
                   id_len: int = 8) -> DataFrame:
    """Pair every recording file with the first annotation file (by name) sharing
    its ``prefix_len``-character prefix. Annotation files are reduced to one per
    prefix before the join (a grouped min, partial on every task), so the join is
    one-to-one and a prefix with many files cannot blow it up.

    Returns (recording, psg_path, psg_name, hyp_path, hyp_name); recordings with
    no match are dropped, as a failing lookup would stop the reference.
    """
    first = (annotations.groupBy(F.substring("name", 1, prefix_len).alias("_sf_prefix"))
                        .agg(F.min(F.struct("name", "path")).alias("_sf_h")))
    rec = recordings.withColumn("_sf_prefix", F.substring("name", 1, prefix_len))
    return (rec.join(first, "_sf_prefix", "inner")
               .select(recording_id("name", id_len).alias("recording"),
                       F.col("path").alias("psg_path"), F.col("name").alias("psg_name"),
                       F.col("_sf_h.path").alias("hyp_path"), F.col("_sf_h.name").alias("hyp_name")))


def recording_catalog(files: DataFrame, recording_suffix: str = "PSG.edf",
                      annotation_suffix: str = "Hypnogram.edf", prefix_len: int = 7) -> DataFrame:
    """SRC-5: split a listing into recordings and annotation files and pair them."""
    rec = files.filter(F.col("name").endswith(recording_suffix))
    ann = files.filter(F.col("name").endswith(annotation_suffix))
    return pair_by_prefix(rec, ann, prefix_len)
