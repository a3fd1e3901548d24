"""Evaluation tables (D14, AG-7..AG-11) and the published reports."""

from sigframe.operators import evaluate as V

PRED = "label int, y_pred int"

# Class rows (precision, recall, f1, support) and the averages of
# the three published reports (test set, held-out recording 1, held-out recording 2).
PUBLISHED = {
    "test_set": {
        "classes": [(0, 0.71, 0.92, 0.80, 706), (1, 0.54, 0.51, 0.53, 729), (2, 0.91, 0.82, 0.86, 3754),
                    (3, 0.70, 0.92, 0.80, 1203), (4, 0.91, 0.78, 0.84, 1602)],
        "accuracy": 0.81, "macro": (0.75, 0.79, 0.77), "weighted": (0.82, 0.81, 0.81), "support": 7994},
    "recording_1": {
        "classes": [(0, 0.90, 0.97, 0.93, 100), (1, 0.75, 0.78, 0.76, 72), (2, 0.80, 0.89, 0.84, 303),
                    (3, 0.91, 0.89, 0.90, 305), (4, 0.96, 0.80, 0.87, 231)],
        "accuracy": 0.87, "macro": (0.86, 0.87, 0.86), "weighted": (0.88, 0.87, 0.87), "support": 1011},
    "recording_2": {
        "classes": [(0, 0.92, 0.69, 0.79, 35), (1, 0.50, 0.58, 0.54, 31), (2, 0.74, 0.92, 0.82, 401),
                    (3, 0.88, 0.99, 0.93, 157), (4, 0.88, 0.47, 0.62, 249)],
        "accuracy": 0.79, "macro": (0.79, 0.73, 0.74), "weighted": (0.80, 0.79, 0.77), "support": 873},
}


def test_null_safe_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 1)], PRED)
    assert abs(V.accuracy(df).first()["accuracy"] - 1 / 3) < 1e-12


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], PRED)
    rep = {r["label"]: r for r in V.class_report(df).collect()}
    assert (rep[1]["precision"], rep[1]["recall"], rep[1]["f1"], rep[1]["support"]) == (0.0, 0.0, 0.0, 1)
    assert rep[0]["precision"] == 0.5 and rep[0]["recall"] == 1.0


def test_confusion_dense_and_wide(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (4, 3)], PRED)
    dense = V.confusion_matrix(df).collect()
    assert len(dense) == 25 and sum(r["count"] for r in dense) == 4
    wide = {r["y_true"]: r for r in V.confusion_matrix_wide(df).collect()}
    assert (wide[0]["pred_0"], wide[0]["pred_1"], wide[4]["pred_3"]) == (1, 1, 1)


def test_report_by_group(spark):
    df = spark.createDataFrame([("A", 0, 0), ("A", 1, 0), ("B", 1, 1)], "patient string, label int, y_pred int")
    rep = {(r["patient"], r["label"]): r["recall"] for r in V.class_report(df, by=["patient"]).collect()}
    assert rep == {("A", 0): 1.0, ("A", 1): 0.0, ("B", 1): 1.0}


def test_published_report_averages(spark):
    for name, pub in PUBLISHED.items():
        rep = spark.createDataFrame(pub["classes"], "label int, precision double, recall double, f1 double, support long")
        got = {r["kind"]: r for r in V.class_report_avg(rep).collect()}
        assert got["accuracy"]["support"] == pub["support"], name
        assert abs(got["accuracy"]["f1"] - pub["accuracy"]) <= 0.01, name
        for kind, key in (("macro avg", "macro"), ("weighted avg", "weighted")):
            vals = (got[kind]["precision"], got[kind]["recall"], got[kind]["f1"])
            assert all(abs(a - b) <= 0.01 for a, b in zip(vals, pub[key])), (name, kind, vals)


def test_stage_timeline(spark):
    df = spark.createDataFrame([("A", 5, 2, 2), ("A", 1, 0, 1), ("B", 3, 4, 4)],
                               "patient string, epoch long, label int, y_pred int")
    got = sorted(tuple(r) for r in V.stage_timeline(df).collect())
    assert got == [("A", 0, "0", "1"), ("A", 1, "2", "2"), ("B", 0, "4", "4")]


def test_confusion_matrix_keeps_every_row(spark):
    rows = [("A", 0, 0), ("A", -1, 2), ("A", 7, None), ("B", None, 1), ("B", 3, 9)]
    df = spark.createDataFrame(rows, "patient string, label int, y_pred int")
    for by in ([], ["patient"]):
        cells = V.confusion_matrix(df, by=by).collect()
        assert sum(r["count"] for r in cells) == len(rows)
        assert sum(r["count"] == 0 for r in cells) == (24 if not by else 24 + 25)
        wide = V.confusion_matrix_wide(df, by=by).collect()
        names = [f"pred_{k}" for k in range(5)] + ["pred_other"]
        assert sum(r[c] for r in wide for c in names) == len(rows)
        assert sum(r["pred_other"] for r in wide) == 2
        assert {r["y_true"] for r in wide} == {None, -1, 0, 1, 2, 3, 4, 7}
