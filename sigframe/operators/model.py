"""Training and applying Spark ML classifiers on epoch vectors (ML-1..ML-4, ML-6, ML-7).

The reference trains a neural net through a parameter-averaging add-on; here the
learner is a Spark ML estimator in a ``Pipeline`` (distributed by Spark ML
itself). Predictions keep the class-probability vector and add ``y_pred`` by
argmax, first maximum winning.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.arrays import argmax
from sigframe.session import scratch_path


def make_estimator(kind: str = "logistic", features: str = "vectors", label: str = "label",
                   n_features: int | None = None, n_classes: int = 5, max_iter: int = 50,
                   seed: int = 42, reg: float = 0.0, block_size: int = 32, hidden: tuple = (32,)):
    """ML-2: the classifier. 'logistic' is multinomial logistic regression;
    'mlp' a small perceptron (needs ``n_features``)."""
    if kind == "logistic":
        return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                                  maxIter=max_iter, regParam=reg)
    if kind == "mlp":
        if not n_features:
            raise ValueError("n_features is required for the perceptron")
        return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                              layers=[n_features, *hidden, n_classes],
                                              maxIter=max_iter, blockSize=block_size, seed=seed)
    raise ValueError(kind)


def fit(train: DataFrame, estimator) -> PipelineModel:
    """ML-1: fit a one-stage (or more) pipeline."""
    return Pipeline(stages=[estimator]).fit(train)


def predict(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """ML-3: class probabilities as an array plus ``y_pred`` (argmax)."""
    out = model.transform(df)
    probs = vector_to_array(F.col("probability"))
    cols = [F.col(c) for c in (keep or [])]
    return out.select(*cols, probs.alias("probs"), argmax(probs).alias("y_pred"))


def save_load(model: PipelineModel, spark, name: str) -> PipelineModel:
    """ML-6: write the fitted model under the shared checkpoint folder and read it back."""
    path = scratch_path(spark, name)
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def _sides(train: DataFrame, others: dict[str, DataFrame], label: str, features: str) -> DataFrame:
    both = None
    for name, df in {"train": train, **others}.items():
        part = df.select(F.col(label), F.col(features), F.lit(name).alias("split"))
        both = part if both is None else both.unionByName(part)
    return both


def _measured(model: PipelineModel, both: DataFrame, label: str) -> DataFrame:
    """(split, loss, hit) per row: -ln p(label), with p at least 1e-15, and whether y_pred is the label."""
    p = predict(model, both, keep=["split", label])
    chosen = F.element_at("probs", F.col(label).cast("int") + 1)
    return p.select("split", (-F.log(F.greatest(chosen, F.lit(1e-15)))).alias("loss"),
                    (F.col("y_pred") == F.col(label)).cast("int").alias("hit"))


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), F.avg("hit").alias("accuracy"))


def learning_curve_by_split(train: DataFrame, others: dict[str, DataFrame], n_features: int, n_classes: int,
                            rounds: int = 5, iterations: int = 5, hidden: tuple = (32,), seed: int = 42,
                            features: str = "vectors", label: str = "label") -> DataFrame:
    """ML-7 with a validation side: a perceptron trained in ``rounds`` of ``iterations``, each
    round going on from the weights of the last, and measured after every round on
    ``train`` and on each of ``others``.

    Returns (round, split, n, loss, accuracy): loss is the mean of -ln p(label), with p at
    least 1e-15. The inputs are read once per fit and once per measurement: give stored ones.
    """
    both = _sides(train, others, label, features)
    estimator = make_estimator("mlp", features, label, n_features, n_classes, iterations, seed, hidden=hidden)
    curve, weights = None, None
    for i in range(rounds):
        if weights is not None:
            estimator.setInitialWeights(weights)
        model = fit(train, estimator)
        weights = model.stages[-1].weights
        at = _measured(model, both, label).withColumn("round", F.lit(i))
        curve = at if curve is None else curve.unionByName(at)
    return _summed(curve, "round", "split")


CURVE = "split string, n bigint, loss double, accuracy double, round int"


def saved_curve(spark, path: str) -> DataFrame:
    """(round, split, n, loss, accuracy) of the rounds that ``train_rounds`` finished under ``path``."""
    try:
        rows = spark.read.schema(CURVE).parquet(f"{path}/measures")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CURVE)
    return rows.select("round", "split", "n", "loss", "accuracy")


def train_rounds(train: DataFrame, others: dict[str, DataFrame], path: str, n_features: int, n_classes: int,
                 rounds: int = 5, iterations: int = 5, hidden: tuple = (32,), seed: int = 42,
                 features: str = "vectors", label: str = "label") -> DataFrame:
    """ML-6/ML-7: ``learning_curve_by_split`` whose rounds are kept under the shared folder
    ``path``: the model of a round, then its measures. A call finds the finished rounds there
    and goes on from the weights of the last, so a run that was stopped gives the same curve;
    a round without measures is trained anew. Other data or parameters need another ``path``.

    Returns the curve of all rounds under ``path`` (see ``best_round``).
    """
    spark = train.sparkSession
    done = {r["round"] for r in saved_curve(spark, path).select("round").distinct().collect()}  # one value a round
    first = next(i for i in range(len(done) + 1) if i not in done)
    both = _sides(train, others, label, features)
    estimator = make_estimator("mlp", features, label, n_features, n_classes, iterations, seed, hidden=hidden)
    weights = PipelineModel.load(f"{path}/model/round={first - 1}").stages[-1].weights if first else None
    for i in range(first, rounds):
        if weights is not None:
            estimator.setInitialWeights(weights)
        model = fit(train, estimator)
        weights = model.stages[-1].weights
        model.write().overwrite().save(f"{path}/model/round={i}")
        measures = _summed(_measured(model, both, label), "split").coalesce(1)  # a row a side, one file
        measures.write.mode("overwrite").parquet(f"{path}/measures/round={i}")
    return saved_curve(spark, path)


def best_round(curve: DataFrame, split: str = "val") -> int | None:
    """The round with the smallest loss on ``split`` (the earliest of equal ones)."""
    row = curve.filter(F.col("split") == split).orderBy("loss", "round").first()
    return None if row is None else row["round"]


def load_round(path: str, i: int) -> PipelineModel:
    """The model that ``train_rounds`` kept after round ``i``."""
    return PipelineModel.load(f"{path}/model/round={i}")


def learning_curve(model: PipelineModel, spark) -> DataFrame:
    """ML-7: (iteration, loss) of the last stage's training summary.
    The history has one value per iteration, so it is bounded by maxIter."""
    stage = model.stages[-1]
    hist = list(stage.summary.objectiveHistory) if stage.hasSummary else []
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)],
                                 "iteration int, loss double")
