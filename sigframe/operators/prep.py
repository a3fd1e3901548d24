"""Sample-table preparation: projections, casts, stage mapping, label joins
(PRJ-1..6, PRJ-9, PRJ-10, FLT-1, FLT-6, JN-1, JN-2, FN-1, FN-2, FN-6, WIN-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.functions.keys import composite_key
from sigframe.functions.stages import stage_label
from sigframe.operators.partitioning import allows_coarse_reuse, on_full_key
from sigframe.schemas import EPOCH_SAMPLES, RAW_CHANNELS, RAW_DROPPED, STAGE_MAP


def typed(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """PRJ-4: cast columns. ``try_cast`` gives NULL for bad text; ``strict`` raises."""
    return df.withColumns({c: _cast(c, t, strict) for c, t in types.items()})


def rename_channels(df: DataFrame, names: dict[str, str] | None = None,
                    drop: list[str] | None = None) -> DataFrame:
    """PRJ-1/PRJ-2: short channel names, unused channels dropped."""
    names = RAW_CHANNELS if names is None else names
    drop = RAW_DROPPED if drop is None else drop
    return df.withColumnsRenamed(names).drop(*drop)


def _cast_sql(c: str, t: str, strict: bool) -> str:
    return f"{'CAST' if strict else 'try_cast'}(`{c}` AS {t})"


def _cast(c: str, t: str, strict: bool):
    return F.expr(_cast_sql(c, t, strict))


def prepare_samples(raw: DataFrame, strict: bool = False, names: dict[str, str] | None = None,
                    drop: list[str] | None = None) -> DataFrame:
    """Raw sample table -> (patient, timestep int, time float, fpzcz, pzoz, horizontal float).
    Rename, drop and cast in one projection."""
    names = RAW_CHANNELS if names is None else names
    drop = RAW_DROPPED if drop is None else drop
    types = {"timestep": "int", "time": "float", **{c: "float" for c in names.values()}}
    cols = []
    for c in raw.columns:
        if c in drop:
            continue
        new = names.get(c, c)
        cols.append(f"{_cast_sql(c, types[new], strict)} AS `{new}`" if new in types else f"`{c}`")
    return raw.selectExpr(*cols)


def label_stages(labels: DataFrame, unknown: str = "drop", mapping: dict | None = None,
                 condition: str = "condition") -> DataFrame:
    """FN-1/FN-2/FLT-1: add ``label`` from the stage name.

    unknown='drop' removes unknown stages (the filter runs before any shuffle),
    'keep' leaves them as -1, 'error' fails the job on the first one.
    """
    if unknown == "drop":
        # Same rows as label != -1, written as a membership test so that it
        # reaches the Parquet scan as an In filter.
        known = list(STAGE_MAP if mapping is None else mapping)
        return (labels.filter(F.col(condition).isin(known))
                      .select("*", stage_label(condition, "keep", mapping).alias("label")))
    return labels.select("*", stage_label(condition, unknown, mapping).alias("label"))


def tumbling_epoch(df: DataFrame, n: int = EPOCH_SAMPLES, col: str = "timestep",
                   out: str = "epoch") -> DataFrame:
    """WIN-1/FN-6: count-based epoch id ``floor(col / n)`` as bigint."""
    return df.withColumn(out, F.floor(F.col(col) / F.lit(n)).cast("long"))


def label_join(samples: DataFrame, labels: DataFrame, n: int | None = None,
               keys: tuple[str, str] = ("patient", "timestep")) -> DataFrame:
    """JN-1: samples joined to per-sample labels on the typed key pair.

    With ``n`` given the result also carries ``epoch``. When the session lets a
    join reuse inputs partitioned on a subset of its keys
    (``spark.sql.requireAllClusterKeysForCoPartition=false``, see
    ``session.RECOMMENDED_CONF``), both sides are hash-partitioned on
    (patient, epoch) and joined on (patient, epoch, timestep), so that one
    exchange per input also serves a later per-epoch aggregation. Otherwise the
    plain join is used (the repartition would then only add a shuffle).
    Duplicate label keys multiply rows, as any inner join does.
    """
    pk, tk = keys
    lab = labels.select(pk, tk, "label")
    if n is None or not allows_coarse_reuse(samples):
        # (patient, timestep) is nearly unique: partitioned on both it is never hot
        out = on_full_key(samples, pk, tk).join(on_full_key(lab, pk, tk), [pk, tk], "inner")
        return out if n is None else tumbling_epoch(out, n, tk)
    epoch = f"CAST(floor(`{tk}` / {int(n)}) AS BIGINT) AS epoch"
    s = samples.selectExpr("*", epoch).repartition(pk, "epoch")
    lab = labels.selectExpr(pk, tk, "label", epoch).repartition(pk, "epoch")
    # Both sides are already exchanged on (patient, epoch): a sort-merge join
    # adds no shuffle, while broadcasting the label side would only add work.
    # Its output is ordered by (patient, epoch, timestep), which a sort-based
    # epoch aggregation then streams without another sort.
    return s.join(lab.hint("merge"), [pk, "epoch", tk], "inner")


def pair_join(left: DataFrame, right: DataFrame, key: str = "key",
              values: str = "values") -> DataFrame:
    """JN-2/PRJ-10: (key, array) pairs joined, value arrays concatenated."""
    l, r = left.alias("l"), right.alias("r")
    return (l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "inner")
             .select(F.col(f"l.{key}").alias(key),
                     F.concat(F.col(f"l.{values}"), F.col(f"r.{values}")).alias(values)))


def known_stage_dim(spark, mapping: dict | None = None) -> DataFrame:
    """FLT-6: the stage dimension table (one row per known stage name)."""
    mapping = STAGE_MAP if mapping is None else mapping
    schema = T.StructType([T.StructField("condition", T.StringType(), False),
                           T.StructField("label", T.IntegerType(), False)])
    return spark.createDataFrame(list(mapping.items()), schema)


def keep_known_stages(df: DataFrame, mapping: dict | None = None,
                      condition: str = "condition") -> DataFrame:
    """FLT-6: inner join to the stage dimension; it has a fixed handful of rows,
    so broadcasting it is size-safe."""
    dim = known_stage_dim(df.sparkSession, mapping).withColumnRenamed("condition", condition)
    return df.join(F.broadcast(dim), condition, "inner")


def _range_columns(df: DataFrame) -> tuple[list[str], list]:
    """The integer columns, and the aggregates that give their ranges."""
    int_types = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, int_types)]
    aggs = [F.min(F.col(f"`{c}`")).alias(f"min_{i}") for i, c in enumerate(ints)] + \
           [F.max(F.col(f"`{c}`")).alias(f"max_{i}") for i, c in enumerate(ints)]
    return ints, aggs


def _narrowed(df: DataFrame, ints: list[str], ranges: dict) -> DataFrame:
    """``df`` with integers in the smallest type that holds their range, doubles as float."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    casts = {c: F.col(f"`{c}`").cast("float") for c in floats}
    for i, c in enumerate(ints):
        lo, hi = ranges.get(f"min_{i}"), ranges.get(f"max_{i}")
        if lo is None:
            continue
        for name, bits in (("byte", 8), ("short", 16), ("int", 32), ("long", 64)):
            if -(2 ** (bits - 1)) <= lo and hi < 2 ** (bits - 1):
                casts[c] = F.col(f"`{c}`").cast(name)
                break
    return df.withColumns(casts)


def narrow_types(df: DataFrame) -> DataFrame:
    """PRJ-9: integers to the smallest signed type that holds their range,
    doubles to float. One aggregate pass finds the ranges."""
    ints, aggs = _range_columns(df)
    return _narrowed(df, ints, df.agg(*aggs).first().asDict() if ints else {})


def store_narrow(df: DataFrame, path: str) -> DataFrame:
    """PRJ-9 on the way to storage: the input is written as Parquet to ``path`` and its ranges are
    observed by the same pass, so it is computed once. Returns the stored rows in the narrow
    types; a column without values keeps its type. Ranges of a task that ran twice count once
    or twice alike, being minima and maxima."""
    ints, aggs = _range_columns(df)
    seen = Observation()
    (df.observe(seen, *aggs) if ints else df).write.mode("overwrite").parquet(path)
    return _narrowed(df.sparkSession.read.schema(df.schema).parquet(path), ints, seen.get if ints else {})


def preprocess(raw_data: DataFrame, raw_labels: DataFrame, n: int = EPOCH_SAMPLES,
               unknown: str = "drop", strict: bool = False, with_key: bool = True,
               co_partition: bool = True) -> DataFrame:
    """The preprocessing job: rename, cast, stage map, drop unknown, join, epoch.

    Returns (patient, time, fpzcz, pzoz, horizontal, label, epoch[, timestep,
    primary_key]). No sort: order is restored where it matters, inside epochs.
    """
    samples = prepare_samples(raw_data, strict)
    labels = raw_labels.select("patient", _cast("timestep", "int", strict).alias("timestep"), "condition")
    labels = label_stages(labels, unknown)
    joined = label_join(samples, labels, n if co_partition else None)
    if not co_partition:
        joined = tumbling_epoch(joined, n)
    if with_key:
        joined = joined.withColumn("primary_key", composite_key("patient", "timestep"))
    return joined
