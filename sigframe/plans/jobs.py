"""The batch jobs a user submits, with a command line (query lifecycles A, B and C).

    python -m sigframe.plans.jobs generate SAMPLES.csv ANNOTATIONS.csv OUT [--disjoint]
    python -m sigframe.plans.jobs preprocess DATA.csv LABELS.csv OUT [--n 3000] [--format csv|parquet]
    python -m sigframe.plans.jobs preprocess-text DATA.csv LABELS.csv OUT [--n 3000] [--lexicographic]
    python -m sigframe.plans.jobs train PREPROCESSED OUT [--n 3000] [--format csv|parquet]

``preprocess`` reads the sample and label CSVs, maps stages, drops unknown ones,
joins on (patient, timestep) and writes the preprocessed table (patient, time,
fpzcz, pzoz, horizontal, label, epoch). ``train`` holds out whole persons,
scales channels with statistics of the training rows only, assembles ordered
epochs into vectors, trains a Spark ML classifier and writes predictions,
accuracy per split, class reports and confusion matrices, plus the model.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.operators import evaluate as V
from sigframe.operators import model as M
from sigframe.operators.epochs import assemble_epochs
from sigframe.operators.intervals import recording_tables
from sigframe.operators.prep import label_stages, pair_join, preprocess, tumbling_epoch
from sigframe.operators.scale import scale_channels
from sigframe.operators.split import holdout_split
from sigframe.operators.sweep import disjoint_annotations
from sigframe.schemas import (ANNOTATIONS, CROP_MARGIN_S, EPOCH_SAMPLES, EPOCH_SECONDS, N_CLASSES, PREPROCESSED,
                              RAW_CHANNELS, RAW_DATA, RAW_DROPPED, RAW_LABELS)
from sigframe.session import checkpoint_dir
from sigframe.sources.csv import read_csv, read_text_split, write_csv, write_text
from sigframe.sources.persist import persisted

OUT_COLS = [f.name for f in PREPROCESSED.fields]


def _write(df: DataFrame, path: str, fmt: str, single_file: bool = False) -> None:
    if fmt == "csv":
        write_csv(df, path, single_file=single_file)
    else:
        (df.coalesce(1) if single_file else df).write.mode("overwrite").parquet(path)


def write_by_recording(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet with one folder per recording, so a filter on ``patient`` (a
    hold-out) reads only those folders. Rows are range-partitioned on
    (patient, epoch) first: each task writes a contiguous slice, so a very long
    recording spreads over several tasks and the file count stays near
    tasks + recordings (a hash split by patient would put a hot recording on
    one task; no split at all would make every task write to every folder)."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(parts, "patient", "epoch")
       .sortWithinPartitions("patient", "epoch", "time")
       .write.mode("overwrite").partitionBy("patient").parquet(path))


def preprocess_job(spark: SparkSession, data_path: str, labels_path: str, out_path: str,
                   n: int = EPOCH_SAMPLES, fmt: str = "csv", unknown: str = "drop",
                   strict: bool = False, sep: str = ",", single_file: bool = False) -> DataFrame:
    """Raw CSVs -> preprocessed table at ``out_path``. CSV output is sorted within
    each file by (patient, epoch, time); Parquet output has one folder per
    recording (``write_by_recording``), so hold-out reads prune folders.
    Returns the written table."""
    raw = read_csv(spark, data_path, RAW_DATA, sep=sep, strict=strict)
    lab = read_csv(spark, labels_path, RAW_LABELS, sep=sep, strict=strict)
    rows = preprocess(raw, lab, n=n, unknown=unknown, strict=strict, with_key=False)
    out = rows.select(*OUT_COLS)
    if fmt == "parquet" and not single_file:
        write_by_recording(out, out_path)
    else:
        _write(out.sortWithinPartitions("patient", "epoch", "time"), out_path, fmt, single_file)
    return read_preprocessed(spark, out_path, fmt)


def read_preprocessed(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, PREPROCESSED)
    return spark.read.parquet(path).select(*OUT_COLS)


def text_preprocess_job(spark: SparkSession, data_path: str, labels_path: str, out_path: str,
                        n: int = EPOCH_SAMPLES, unknown: str = "drop", lexicographic: bool = False,
                        with_epoch: bool = True, sep: str = ",") -> DataFrame:
    """The text-lines form of preprocessing: both files are read as lines and
    split on ``sep`` (every header line dropped), keyed by ``patient_timestep``,
    joined on that key, reduced to (key, timestep, fpzcz, pzoz, horizontal,
    condition), given a class id, sorted and written as delimited text without a
    header. Sorting is by (patient, numeric timestep) unless ``lexicographic``
    asks for the string key order (P_1, P_10, P_2). The epoch id is appended
    unless ``with_epoch`` is False. Returns the written rows, read from the files."""
    data = read_text_split(spark, data_path, sep)
    labels = read_text_split(spark, labels_path, sep)
    # raw sample columns: patient, timestep, time, c1, c2, c3, c4; labels: patient, timestep, time, condition
    # Joined on both fields: as one text, recording A_1 at 2 and recording A at 1_2 are the same.
    key = F.struct(F.element_at("fields", 1).alias("patient"), F.element_at("fields", 2).alias("timestep"))
    left = data.select(key.alias("key"), F.col("fields").alias("values"))
    right = labels.select(key.alias("key"), F.array(F.element_at("fields", 4)).alias("values"))
    joined = pair_join(left, right)
    v = F.col("values")
    rows = joined.select(
        F.concat_ws("_", "key.patient", "key.timestep").alias("key"), F.element_at(v, 1).alias("patient"), F.expr("try_cast(element_at(values, 2) AS INT)").alias("timestep"),
        *[F.expr(f"try_cast(element_at(values, {i}) AS FLOAT)").alias(c)
          for i, c in ((4, "fpzcz"), (5, "pzoz"), (6, "horizontal"))],
        F.element_at(v, 8).alias("condition"))
    rows = label_stages(rows, unknown)
    if with_epoch:
        rows = tumbling_epoch(rows, n)
    order = ["key"] if lexicographic else ["patient", "timestep"]
    cols = ["key", "timestep", "fpzcz", "pzoz", "horizontal", "condition", "label"] + (["epoch"] if with_epoch else [])
    write_text(rows.orderBy(*order), out_path, cols, sep)
    types = {"timestep": "int", "fpzcz": "float", "pzoz": "float", "horizontal": "float", "label": "int", "epoch": "bigint"}
    written = read_text_split(spark, out_path, sep, drop_header=False)
    return written.select(*[F.get("fields", F.lit(i)).try_cast(types.get(c, "string")).alias(c) for i, c in enumerate(cols)])


def train_job(spark: SparkSession, preprocessed_path: str, out_path: str, n: int = EPOCH_SAMPLES,
              fmt: str = "csv", k_holdout: int = 8, seed: int = 42, unit: str = "person",
              scaler_mode: str = "scale_only", scope: str = "train", label_rule: str = "mean",
              max_iter: int = 100, estimator: str = "logistic", k_validation: int = 0, rounds: int = 0) -> dict:
    """Preprocessed table -> model and evaluation tables under ``out_path``.
    Returns {split: accuracy}.

    ``k_validation`` holds out that many more persons (or recordings) as split 'val'. With
    ``rounds`` a perceptron is trained in rounds of ``max_iter`` that are kept under
    ``out_path``/rounds, so a job that was stopped goes on there; the model is that of the
    round with the smallest validation loss (of the last round without a validation side),
    and the curve is written to ``learning_curve``. ``timeline`` holds the true and predicted
    stage of every epoch of the held-out recordings, numbered by recording.
    """
    rows = read_preprocessed(spark, preprocessed_path, fmt)
    train_rows, test_rows = holdout_split(rows, k_holdout, seed, unit=unit)
    held = {"test": test_rows}
    if k_validation:
        train_rows, held["val"] = holdout_split(train_rows, k_validation, seed + 1, unit=unit)
    train_rows, *scaled = scale_channels(train_rows, list(held.values()), mode=scaler_mode, scope=scope)
    held = dict(zip(held, scaled))
    label = "label_mean" if label_rule == "mean" else "label_first"

    def epochs(df, split):
        ep = assemble_epochs(df, n=n, require_full=True, vectors=True, label_rule=label_rule)
        return ep.select("patient", "epoch", F.col(label).alias("label"), "vectors",
                         F.lit(split).alias("split"))

    # The epoch tables are read by the fit and again by the predictions: write
    # them to the shared checkpoint folder once, which also cuts the lineage so
    # a lost executor never re-runs the join and the grouping.
    checkpoint_dir(spark)
    ep_train = epochs(train_rows, "train").checkpoint(eager=True)
    ep_held = {name: epochs(df, name).checkpoint(eager=True) for name, df in held.items()}
    n_features = 3 * n
    if rounds:
        path = f"{out_path}/rounds"
        curve = M.train_rounds(ep_train, ep_held, path, n_features, N_CLASSES, rounds, max_iter, seed=seed)
        _write(curve.orderBy("round", "split"), f"{out_path}/learning_curve", fmt)
        model = M.load_round(path, M.best_round(curve) if k_validation else rounds - 1)
    else:
        model = M.fit(ep_train, M.make_estimator(estimator, n_features=n_features, max_iter=max_iter, seed=seed))
    model.write().overwrite().save(f"{out_path}/model")
    both = ep_train
    for ep in ep_held.values():
        both = both.unionByName(ep)
    preds = M.predict(model, both, keep=["split", "patient", "epoch", "label"])
    # One row per epoch: small next to the samples, and read by every report below.
    with persisted(preds) as p:
        _write(p.select("split", "patient", "epoch", "label", "y_pred"), f"{out_path}/predictions", fmt)
        acc = V.accuracy(p, by=["split"])
        _write(acc, f"{out_path}/accuracy", fmt)
        rep = V.class_report(p, by=["split"])
        _write(rep, f"{out_path}/class_report", fmt)
        _write(V.class_report_avg(rep, by=["split"]), f"{out_path}/class_report_avg", fmt)
        _write(V.confusion_matrix(p, by=["split"]), f"{out_path}/confusion_matrix", fmt)
        _write(V.class_report(p.filter(F.col("split") == "test"), by=["patient"]),
               f"{out_path}/class_report_by_recording", fmt)
        _write(V.stage_timeline(p.filter(F.col("split") == "test")), f"{out_path}/timeline", fmt)
        return {r["split"]: r["accuracy"] for r in acc.collect()}


def generate_job(spark: SparkSession, samples_path: str, annotations_path: str, out_path: str,
                 fmt: str = "csv", chunk: float = EPOCH_SECONDS, margin: float = CROP_MARGIN_S,
                 disjoint: bool = False) -> tuple[DataFrame, DataFrame]:
    """Timed samples (patient, t in seconds, channels) and annotations (patient, onset, duration,
    description) -> the raw tables of ``preprocess`` at ``out_path``/data and ``out_path``/labels:
    annotations cropped to the night, cut into whole chunks and joined to the samples they
    contain. ``disjoint`` makes overlapping annotations disjoint first
    (``operators.sweep``); without it a sample has a row for every annotation that holds it.
    Returns the written tables."""
    channels = [*RAW_CHANNELS, *RAW_DROPPED]
    timed = T.StructType([T.StructField("patient", T.StringType()), T.StructField("t", T.DoubleType()),
                          *[T.StructField(c, T.FloatType()) for c in channels]])
    ann = read_csv(spark, annotations_path, ANNOTATIONS)
    if disjoint:
        ann = disjoint_annotations(ann)
    rows = recording_tables(read_csv(spark, samples_path, timed), ann, channels, chunk, margin)
    _write(rows.drop("condition"), f"{out_path}/data", fmt)
    _write(rows.drop(*channels), f"{out_path}/labels", fmt)
    if fmt == "csv":
        return read_csv(spark, f"{out_path}/data", RAW_DATA), read_csv(spark, f"{out_path}/labels", RAW_LABELS)
    return spark.read.parquet(f"{out_path}/data"), spark.read.parquet(f"{out_path}/labels")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="sigframe.plans.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    commands = {name: sub.add_parser(name) for name in ("generate", "preprocess", "preprocess-text", "train")}
    paths = {"generate": ("samples", "annotations"), "train": ("preprocessed",)}
    for name, p in commands.items():
        for arg in (*paths.get(name, ("data", "labels")), "out"):
            p.add_argument(arg)
        if name != "generate":
            p.add_argument("--n", type=int, default=EPOCH_SAMPLES)
        if name != "preprocess-text":
            p.add_argument("--format", choices=["csv", "parquet"], default="csv")
    gen, pre, txt, tr = commands.values()
    gen.add_argument("--chunk", type=float, default=EPOCH_SECONDS)
    gen.add_argument("--margin", type=float, default=CROP_MARGIN_S)
    gen.add_argument("--disjoint", action="store_true")
    for p in (pre, txt):
        p.add_argument("--unknown", choices=["drop", "keep", "error"], default="drop")
        p.add_argument("--sep", default=",")
    pre.add_argument("--strict", action="store_true")
    pre.add_argument("--single-file", action="store_true")
    txt.add_argument("--lexicographic", action="store_true")
    txt.add_argument("--no-epoch", action="store_true")
    tr.add_argument("--holdout", type=int, default=8)
    tr.add_argument("--validation", type=int, default=0)
    tr.add_argument("--seed", type=int, default=42)
    tr.add_argument("--unit", choices=["person", "recording"], default="person")
    tr.add_argument("--scaler", choices=["scale_only", "zscore_pop"], default="scale_only")
    tr.add_argument("--scope", choices=["train", "all"], default="train")
    tr.add_argument("--label-rule", choices=["mean", "first"], default="mean")
    tr.add_argument("--max-iter", type=int, default=100)
    tr.add_argument("--estimator", choices=["logistic", "mlp"], default="logistic")
    tr.add_argument("--rounds", type=int, default=0)
    a = ap.parse_args(argv)
    from sigframe.session import get_session
    spark = get_session()
    if a.cmd == "generate":
        generate_job(spark, a.samples, a.annotations, a.out, a.format, a.chunk, a.margin, a.disjoint)
    elif a.cmd == "preprocess":
        preprocess_job(spark, a.data, a.labels, a.out, a.n, a.format, a.unknown, a.strict, a.sep, a.single_file)
    elif a.cmd == "preprocess-text":
        text_preprocess_job(spark, a.data, a.labels, a.out, a.n, a.unknown, a.lexicographic, not a.no_epoch, a.sep)
    else:
        print(train_job(spark, a.preprocessed, a.out, a.n, a.format, a.holdout, a.seed, a.unit, a.scaler, a.scope,
                        a.label_rule, a.max_iter, a.estimator, a.validation, a.rounds))


if __name__ == "__main__":
    main()
