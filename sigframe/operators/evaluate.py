"""Evaluation tables: accuracy, confusion matrices, per-class reports, stage
timelines (AG-7..AG-12, FN-11, FN-12, ML-4, ML-5, ML-8).

Everything is a grouped aggregate with partial aggregation, so a recording with
a third of all predictions still pre-aggregates on every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.keys import eq_flag
from sigframe.operators.ordering import ordered_index
from sigframe.schemas import N_CLASSES


def accuracy(df: DataFrame, y_true: str = "label", y_pred: str = "y_pred",
             by: list[str] | None = None) -> DataFrame:
    """AG-7/ML-4: mean of the NULL-safe equality flag, overall or per group."""
    by = by or []
    agg = [F.avg(eq_flag(y_true, y_pred)).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(*by).agg(*agg)


def _grid(n_classes: int):
    """Every (y_true, y_pred) pair of ``n_classes`` classes as an array of structs."""
    k = int(n_classes)
    return F.expr(f"transform(sequence(0, {k * k - 1}), i -> named_struct("
                  f"'y_true', CAST(i div {k} AS INT), 'y_pred', CAST(i % {k} AS INT)))")


def confusion_matrix(df: DataFrame, y_true: str = "label", y_pred: str = "y_pred",
                     by: list[str] | None = None, n_classes: int = N_CLASSES,
                     dense: bool = True) -> DataFrame:
    """AG-8 long form: (by..., y_true, y_pred, count). ``dense`` adds zero cells for
    every pair of ``n_classes`` classes of each group. Pairs with a NULL or any other
    class keep their own cells, so the counts sum to the number of rows."""
    by = by or []
    counts = (df.groupBy(*by, F.col(y_true).cast("int").alias("y_true"),
                         F.col(y_pred).cast("int").alias("y_pred"))
                .agg(F.count(F.lit(1)).alias("count")))
    if not dense:
        return counts
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    zeros = groups.select(*by, F.inline(_grid(n_classes)), F.lit(0).cast("long").alias("count"))
    return counts.unionByName(zeros).groupBy(*by, "y_true", "y_pred").agg(F.sum("count").alias("count"))


def confusion_matrix_wide(df: DataFrame, y_true: str = "label", y_pred: str = "y_pred",
                          by: list[str] | None = None, n_classes: int = N_CLASSES) -> DataFrame:
    """AG-8 wide form of the same cells: one row per true class, one ``pred_<k>`` column
    per class and ``pred_other`` for predictions that are NULL or no class."""
    by = by or []
    cells = confusion_matrix(df, y_true, y_pred, by, n_classes)
    known = F.coalesce(F.col("y_pred").between(0, n_classes - 1), F.lit(False))
    total = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    return cells.groupBy(*by, "y_true").agg(
        *[total(F.col("y_pred") == k).alias(f"pred_{k}") for k in range(n_classes)],
        total(~known).alias("pred_other"))


def class_report(df: DataFrame, y_true: str = "label", y_pred: str = "y_pred",
                 by: list[str] | None = None) -> DataFrame:
    """AG-9: per class precision, recall, f1 and support, for the classes that
    occur in y_true or y_pred; 0/0 counts as 0 (scikit-learn's zero_division=0).

    Each prediction row contributes one row for its true class and one for its
    predicted class; a single grouped sum then gives tp, support and predicted.
    """
    by = by or []
    t, p = f"CAST(`{y_true}` AS INT)", f"CAST(`{y_pred}` AS INT)"
    contrib = F.expr(
        f"array(named_struct('label', {t}, 'is_true', 1, 'is_pred', 0, 'tp', CAST({t} <=> {p} AS INT)), "
        f"named_struct('label', {p}, 'is_true', 0, 'is_pred', 1, 'tp', 0))")
    per = (df.select(*by, F.inline(contrib))
             .groupBy(*by, "label")
             .agg(F.sum("tp").alias("tp"), F.sum("is_true").alias("support"),
                  F.sum("is_pred").alias("predicted")))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = per.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    return (out.withColumn("f1", f1)
               .filter(F.col("label").isNotNull())
               .select(*by, "label", "precision", "recall", "f1",
                       F.col("support").cast("long").alias("support")))


def class_report_avg(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG-10: accuracy, macro and weighted averages from a class report.
    The accuracy row carries its value in ``f1`` (as the printed report does)."""
    by = by or []
    tot = F.sum("support")
    agg = report.groupBy(*by).agg(
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("acc"),
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("w_f"),
        tot.cast("long").alias("support"))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("kind"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1")),
        *[F.struct(F.lit(kind).alias("kind"), F.col(f"{p}_p").alias("precision"),
                   F.col(f"{p}_r").alias("recall"), F.col(f"{p}_f").alias("f1"))
          for kind, p in (("macro avg", "m"), ("weighted avg", "w"))])
    return agg.select(*by, F.inline(rows), "support")


def class_support(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """AG-11/AG-12: rows per class."""
    by = by or []
    return df.groupBy(*by, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("support"))


def stage_timeline(preds: DataFrame, key: str = "patient", order: str = "epoch",
                   y_true: str = "label", y_pred: str = "y_pred") -> DataFrame:
    """ML-8/WIN-4/PRJ-5: (recording, epoch ordinal, y_true, y_pred as strings),
    the table behind a hypnogram plot. The ordinal comes from ``ordered_index``."""
    idx = ordered_index(preds.select(key, order, y_true, y_pred), [key], [order], out="epoch_ord")
    return idx.select(key, F.col("epoch_ord").alias("epoch"),
                      F.col(y_true).cast("string").alias("y_true"),
                      F.col(y_pred).cast("string").alias("y_pred"))
