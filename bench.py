"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

The driver-table adapter output (signal, label, annotation and prediction
tables) is written once to the shared checkpoint folder first, so the timings
are those of the library's operators on stored inputs. Each query is run to
completion with the ``noop`` sink (no collect); the reported time is the
median of $BENCH_REPEATS (default 5) runs.

Besides these, ``preprocess_epochs`` is timed from the given tables (the adapter's
work included), and a stage lookup as a Spark expression against a row-at-a-time
Python function.

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from sigframe.functions.stages import stage_label  # noqa: E402
from sigframe.plans import tables as TB  # noqa: E402
from sigframe.plans.queries import QUERIES, flagship  # noqa: E402
from sigframe.schemas import STAGE_MAP  # noqa: E402
from sigframe.session import get_session, scratch_path  # noqa: E402

HEADLINE = [
    "preprocess_epochs", "label_join", "epoch_assemble", "epoch_time_major", "interval_join",
    "crop_recording", "row_index", "sorted_samples", "scaled_channels", "zscore_channels",
    "hash_split", "holdout_semi_anti", "class_report_by_recording", "confusion_matrix",
    "strided_fir", "strided_max", "pair_files_by_prefix", "ml_train_predict", "hash_split_exact",
]


def stage_lookup(spark, rows: int, native: bool):
    """The same six-entry lookup as a Spark expression or as a row-at-a-time Python function:
    what leaving the JVM costs on this machine."""
    names = list(STAGE_MAP)
    codes = spark.range(rows).select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names) + 1).cast("int")).alias("condition"))
    if native:
        return codes.select(stage_label("condition", "keep").alias("label"))
    known = dict(STAGE_MAP)
    return codes.select(F.udf(known.get, T.IntegerType())("condition").alias("label"))


REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(build) -> float:
    """Median wall time of REPEATS runs (plan construction included)."""
    times = []
    for _ in range(REPEATS):
        t = time.time()
        run(build())
        times.append(time.time() - t)
    return round(statistics.median(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="sigframe-bench",
                        extra={"spark.driver.memory": "16g"})
    t0 = time.time()
    TB.materialize(spark, sf_dir, scratch_path(spark, f"sigframe-bench-{uuid.uuid4().hex}"))
    prepare = time.time() - t0
    run(QUERIES["preprocess_epochs"](spark, sf_dir))  # warm-up, not timed
    times = {name: timed(lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    full = timed(lambda: flagship(spark, sf_dir))
    given = timed(lambda: QUERIES["preprocess_epochs"](spark, f"{sf_dir}/"))
    lookups = {name: timed(lambda n=n: stage_lookup(spark, 2_000_000, n)) for name, n in (("native", True), ("python", False))}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf,
        "cpus": int(cpus), "repeats": REPEATS, "prepare_inputs_sec": round(prepare, 3),
        "flagship_full_table_sec": full, "preprocess_epochs_from_given_tables_sec": given, "stage_lookup_sec": lookups,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
