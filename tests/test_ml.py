"""Spark ML training on synthetic recordings (ML-1..ML-4, ML-6, ML-7) and the
end-to-end epoch job on data of true shape."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sigframe.operators import evaluate as V
from sigframe.operators import model as M
from sigframe.operators import split as SP
from sigframe.plans.flagship import epochs_from_raw
from tests.synthetic import recordings

N = 30


def _epochs(spark):
    data, labels = recordings(spark, r=4, e=20, n=N)
    return epochs_from_raw(data, labels, n=N, require_full=True), data


def test_epochs_property(spark):
    ep, data = _epochs(spark)
    rows = ep.agg(F.count(F.lit(1)).alias("e"), F.sum("n_samples").alias("s")).first()
    kept = epochs_from_raw(*recordings(spark, r=4, e=20, n=N), n=N).agg(F.sum("n_samples")).first()[0]
    assert rows["s"] == rows["e"] * N and rows["s"] == kept  # synthetic epochs are whole or dropped whole
    assert ep.filter(F.size("features") != 3 * N).count() == 0


def test_learns_separable_stages(spark):
    ep, _ = _epochs(spark)
    ep = ep.select("primary_key", F.col("label_first").alias("label"), "vectors")
    train, test = SP.hash_split(ep, "primary_key", 0.25, 1)
    model = M.fit(train, M.make_estimator("logistic", max_iter=50))
    preds = M.predict(model, test, keep=["label"])
    assert V.accuracy(preds).first()["accuracy"] > 0.9
    curve = M.learning_curve(model, spark).collect()
    assert len(curve) >= 2 and curve[-1]["loss"] <= curve[0]["loss"]


def test_save_load_same_predictions(spark):
    ep, _ = _epochs(spark)
    ep = ep.select("primary_key", F.col("label_mean").alias("label"), "vectors")
    model = M.fit(ep, M.make_estimator("logistic", max_iter=5))
    again = M.save_load(model, spark, "sigframe-test-model")
    a = M.predict(model, ep, keep=["primary_key"]).orderBy("primary_key").collect()
    b = M.predict(again, ep, keep=["primary_key"]).orderBy("primary_key").collect()
    assert [r["y_pred"] for r in a] == [r["y_pred"] for r in b]


def test_mlp_on_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    e = e.select("vec_id", "label", array_to_vector("embedding").alias("vectors"))
    model = M.fit(e, M.make_estimator("mlp", n_features=64, n_classes=10, max_iter=5))
    p = M.predict(model, e, keep=["vec_id"])
    assert p.count() == e.count()
    assert p.filter(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6).count() == 0


def test_learning_curve_has_a_validation_side(spark):
    rows = [(i % 2, [float(i % 2) + (i % 7) / 20, float(i % 5) / 5]) for i in range(200)]
    df = spark.createDataFrame(rows, "label int, x array<double>").select(
        "label", array_to_vector("x").alias("vectors"), F.monotonically_increasing_id().alias("i"))
    tagged = df.withColumn("val", F.col("i") % 4 == 0)
    curve = M.learning_curve_by_split(tagged.filter("not val"), {"val": tagged.filter("val")}, 2, 2,
                                      rounds=4, iterations=4, hidden=(4,)).orderBy("split", "round").collect()
    assert [(r["split"], r["round"]) for r in curve] == [(s, i) for s in ("train", "val") for i in range(4)]
    train = [r["loss"] for r in curve if r["split"] == "train"]
    assert all(b <= a + 1e-9 for a, b in zip(train, train[1:]))
    assert curve[3]["accuracy"] == curve[7]["accuracy"] == 1.0
