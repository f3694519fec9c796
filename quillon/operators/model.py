"""Pair classifier: linear, deep, or both blended; Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.evaluate import confusion_metrics


def prepared(numeric: list[str], categorical: list[str]) -> list:
    """Stages that impute and scale numeric columns, one-hot encode integer categories and assemble ``features``."""
    filled = [f"{c}_filled" for c in numeric]
    stages = [Imputer(inputCols=numeric, outputCols=filled)]
    hot = [f"{c}_hot" for c in categorical]
    if categorical:
        stages.append(OneHotEncoder(inputCols=categorical, outputCols=hot, handleInvalid="keep"))
    return [*stages, VectorAssembler(inputCols=filled + hot, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]


def fit(pairs: DataFrame, numeric: list[str], categorical: list[str], label: str, kind: str = "wide", hidden: tuple[int, ...] = (16, 8), seed: int = 7) -> Pipeline:
    """A fitted pipeline; ``kind`` is wide (logistic regression) or deep (perceptron with ``hidden`` layers)."""
    front = Pipeline(stages=prepared(numeric, categorical)).fit(pairs)
    ready = front.transform(pairs)
    if kind == "wide":
        back = LogisticRegression(labelCol=label, maxIter=50, regParam=1e-4)
    else:
        size = ready.schema["features"].metadata["ml_attr"]["num_attrs"] if "ml_attr" in ready.schema["features"].metadata else len(ready.select("features").first()[0])
        back = MultilayerPerceptronClassifier(labelCol=label, layers=[size, *hidden, 2], maxIter=60, seed=seed)
    return Pipeline(stages=[front, back.fit(ready)]).fit(pairs)


class Blend:
    """Linear and deep pipelines whose two probabilities a logistic regression combines."""

    def __init__(self, pairs: DataFrame, numeric: list[str], categorical: list[str], label: str, hidden: tuple[int, ...] = (16, 8), seed: int = 7) -> None:
        self.parts = {k: fit(pairs, numeric, categorical, label, k, hidden, seed) for k in ("wide", "deep")}
        self.assembler = VectorAssembler(inputCols=["p_wide", "p_deep"], outputCol="features")
        self.top = LogisticRegression(labelCol=label, maxIter=50, regParam=1e-4).fit(self.assembler.transform(self._both(pairs)))

    def _both(self, pairs: DataFrame) -> DataFrame:
        out = pairs
        for k, model in self.parts.items():
            scored = model.transform(out).withColumn(f"p_{k}", vector_to_array("probability")[1])
            out = scored.select(*out.columns, f"p_{k}")
        return out

    def transform(self, pairs: DataFrame) -> DataFrame:
        return self.top.transform(self.assembler.transform(self._both(pairs)))


def evaluated(model, pairs: DataFrame, label: str) -> DataFrame:
    """One row of counts and metrics of a fitted classifier over labelled pairs (see ``confusion_metrics``)."""
    return confusion_metrics(predict(model, pairs).withColumn(label, F.col(label).cast("int")), label, "predicted_label")


def save(model: PipelineModel, path: str) -> None:
    """Writes a fitted pipeline, replacing what was there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model, pairs: DataFrame) -> DataFrame:
    """``pairs`` with predicted_label, the class of the greatest probability (ties: the first), and its probability."""
    p = vector_to_array("probability")
    scored = model.transform(pairs).withColumn("_p", p)
    top = F.array_max("_p")
    return scored.select(*pairs.columns, (F.array_position("_p", top) - 1).cast("int").alias("predicted_label"), top.alias("probability"))
