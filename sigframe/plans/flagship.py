"""The flagship job: raw samples + per-sample labels -> labelled, ordered epochs.

rename/drop/cast -> stage map -> drop unknown stages -> join on (patient,
timestep) -> epoch id -> per-epoch ordered arrays + both label rules -> vectors.

Plan shape with the settings of ``session.RECOMMENDED_CONF``: each input is
hash-partitioned once on (patient, epoch), sorted once for the merge join, and
the sort-based epoch aggregation streams the join's order - one shuffle per
input and no other sort than the one inside each epoch. In a session without
those settings the label join is a plain join and the aggregation shuffles
once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sigframe.functions.keys import composite_key
from sigframe.operators.epochs import assemble_epochs
from sigframe.operators.prep import preprocess
from sigframe.schemas import EPOCH_SAMPLES


def epochs_from_raw(raw_data: DataFrame, raw_labels: DataFrame, n: int = EPOCH_SAMPLES,
                    unknown: str = "drop", layout: str = "channel", require_full: bool = False,
                    vectors: bool = True) -> DataFrame:
    """Raw tables -> one row per (patient, epoch) with primary_key, n_samples,
    label_mean, label_first, channel arrays, ``features`` and ``vectors``."""
    samples = preprocess(raw_data, raw_labels, n=n, unknown=unknown, with_key=False)
    ep = assemble_epochs(samples, order="time", layout=layout, label_rule="both", n=n,
                         require_full=require_full, vectors=vectors)
    return ep.withColumn("primary_key", composite_key("patient", "epoch"))


def epoch_digest(ep: DataFrame) -> DataFrame:
    """Scalar view of the epoch table for comparisons: counts, labels and the
    first/last values of the ordered arrays."""
    return ep.selectExpr("patient", "epoch", "primary_key", "n_samples", "label_mean", "label_first",
                         "element_at(fpzcz, 1) AS fpzcz_first", "element_at(pzoz, -1) AS pzoz_last",
                         "element_at(horizontal, -1) AS horizontal_last", "size(features) AS n_features")
