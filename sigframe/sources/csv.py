"""CSV and delimited-text scans and sinks (SRC-1..SRC-4, SNK-1..SNK-3, FN-3, FN-4, D2, D15, D16)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.schemas import all_strings


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             sep: str = ",", strict: bool = False) -> DataFrame:
    """SRC-1/SRC-2: scan with every column as text, then cast to ``schema``.

    Reading as text first means a malformed number becomes NULL (``try_cast``)
    instead of failing the job; ``strict=True`` makes it fail. No inference pass
    over the data is needed, and only the referenced columns are parsed.
    """
    raw = (spark.read.schema(all_strings(schema)).option("header", header).option("sep", sep)
                .option("mode", "PERMISSIVE").csv(path))
    cast = []
    for f in schema.fields:
        t = f.dataType.simpleString()
        cast.append((F.col(f"`{f.name}`").cast(t) if strict
                     else F.expr(f"try_cast(`{f.name}` AS {t})")).alias(f.name))
    return raw.select(*cast)


def read_csv_strings(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """SRC-1 as written in the reference: header names, every value a string."""
    return spark.read.option("header", header).option("sep", sep).csv(path)


def read_csv_inferred(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """SRC-4: schema inferred from the data (one extra pass over the files)."""
    return (spark.read.option("header", header).option("sep", sep)
                 .option("inferSchema", True).csv(path))


def read_text_split(spark: SparkSession, path: str, sep: str = ",", drop_header: bool = True,
                    header_line: str | None = None) -> DataFrame:
    """SRC-3/FN-3: lines split on the characters ``sep`` into ``fields`` (no quoting rules).

    As in a split-lines job, every line equal to the header line is dropped, not
    just the first one. Without ``header_line`` each file's header is its own first
    line, taken from its first block (one row a file) inside the same plan.
    """
    lines = spark.read.text(path)
    if drop_header and header_line is not None:
        lines = lines.filter(F.col("value") != F.lit(header_line))
    elif drop_header:
        placed = lines.select("value", F.col("_metadata.file_path").alias("_sf_file"), F.col("_metadata.file_block_start").alias("_sf_block"))
        # ids rise with the lines of a block
        first = (placed.filter("_sf_block = 0").select("_sf_file", "value", F.monotonically_increasing_id().alias("_sf_line"))
                 .groupBy("_sf_file").agg(F.min_by("value", "_sf_line").alias("_sf_header")))
        lines = placed.join(first, "_sf_file").filter(F.col("value") != F.col("_sf_header")).select("value")
    return lines.select(F.split(F.col("value"), re.escape(sep)).alias("fields"))


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",",
              single_file: bool = False, partition_by: list[str] | None = None,
              mode: str = "overwrite") -> None:
    """SNK-1/SNK-3: CSV with a header. ``single_file`` funnels the last stage into
    one task (only for small outputs); ``partition_by`` writes one folder per
    value so later reads of a recording prune the others."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode).option("header", header).option("sep", sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def to_delimited_line(df: DataFrame, cols: list[str] | None = None, sep: str = ",") -> DataFrame:
    """FN-4: one text column holding the values joined by ``sep`` (NULL -> empty)."""
    cols = cols or df.columns
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
                                        for c in cols]).alias("value"))


def write_text(df: DataFrame, path: str, cols: list[str] | None = None, sep: str = ",",
               mode: str = "overwrite") -> None:
    """SNK-2: delimited text without a header."""
    to_delimited_line(df, cols, sep).write.mode(mode).text(path)
