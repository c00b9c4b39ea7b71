"""Four-class models: boosted trees or a random forest on flat features, a recurrent network or a perceptron on sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, BoostParams, boosted_probabilities, fit_boosted_trees
from .recurrent import RecurrentModel, RecurrentParams, fit_recurrent, recurrent_probabilities

CLASSES = range(4)


def fit_forest(df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Random forest over the four classes: the tree ensemble of Spark ML that gives class probabilities."""
    rows = df.select(*features, F.col(label).cast("double").alias("label")).na.fill(0.0, list(features))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(rows)


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str = "label", validation: str | None = None, rounds: int = 500, depth: int = 6, step: float = 0.05, seed: int = 42, patience: int = 50
) -> BoostedTrees:
    """Gradient-boosted trees of all classes together.

    ``validation`` names a boolean column: its rows are held out, and the fit ends once their loss has
    not fallen for ``patience`` rounds.  Rows without a label are left out, null features are 0.
    """
    return fit_boosted_trees(df, features, label, validation, BoostParams(rounds=rounds, depth=depth, step=step, seed=seed, patience=patience))


def probabilities(model, df: DataFrame, name: str, classes: int = 4) -> DataFrame:
    """``df`` with ``<name>_prob_0..3``; classes the model never saw get 0."""
    if isinstance(model, BoostedTrees):
        return boosted_probabilities(model, df, name)
    if isinstance(model, RecurrentModel):
        return recurrent_probabilities(model, df, name)
    inputs = model.stages[0].getInputCols() if isinstance(model, PipelineModel) else []
    scored = model.transform(df.na.fill(0.0, inputs) if inputs else df)
    p = vector_to_array("probability")
    return scored.select(*df.columns, *[F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)).alias(f"{name}_prob_{k}") for k in range(classes)])


def importances(model: BoostedTrees | PipelineModel, top: int = 20) -> list[tuple[str, float]]:
    """The ``top`` features by their share of all gain (boosted trees), or of all impurity removed (forest)."""
    if isinstance(model, BoostedTrees):
        gain = model.feature_gain()
        shares = [g / (sum(gain) or 1.0) for g in gain]
        return sorted(zip(model.features, shares), key=lambda x: (-x[1], x[0]))[:top]
    shares = model.stages[1].featureImportances.toArray()
    return sorted(zip(model.stages[0].getInputCols(), shares.tolist()), key=lambda x: (-x[1], x[0]))[:top]


def load_flat(spark: SparkSession, path: str) -> BoostedTrees | PipelineModel:
    """The flat model saved at ``path``: boosted trees, or a pipeline of Spark ML."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    boosted = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return BoostedTrees.load(spark, path) if boosted else PipelineModel.load(path)


def flatten_sequences(df: DataFrame, column: str = "sequence") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(F.flatten(column), lambda x: x.cast("double"))))


def fit_sequences(df: DataFrame, inputs: int, label: str = "label", hidden: Sequence[int] = (64, 32), rounds: int = 50, seed: int = 42):
    """Perceptron on flattened sequences of ``inputs`` values."""
    rows = flatten_sequences(df).select("features", F.col(label).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, 4], maxIter=rounds, seed=seed).fit(rows)


def accuracy(df: DataFrame, predicted: str = "predicted_class", label: str = "label") -> float:
    return df.agg(F.avg((F.col(predicted) == F.col(label)).cast("double"))).first()[0]


def log_loss(df: DataFrame, name: str, label: str = "label") -> float:
    """Mean negative logarithm of the probability given to the true class."""
    mine = F.get(F.array(*[F.col(f"{name}_prob_{k}") for k in CLASSES]), F.col(label))
    return df.agg(F.avg(-F.ln(F.greatest(mine, F.lit(1e-15))))).first()[0]


def most_likely(name: str):
    """The class of the highest ``<name>_prob_k``, the first on ties."""
    p = [F.col(f"{name}_prob_{k}") for k in CLASSES]
    return (F.array_position(F.array(*p), F.greatest(*p)) - 1).cast("int")
