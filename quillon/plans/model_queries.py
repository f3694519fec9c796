"""Queries that train and apply the pair classifier on pairs of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import model as M
from quillon.operators import wide_deep as W
from quillon.plans.item_queries import pair_band_join
from quillon.plans.registered import query
from quillon.session import materialize

NUMERIC = ["delta_seconds", "delta_sec_in_day", "delta_value", "avg_value", "delta_k"]


def _fit_on(pairs: DataFrame) -> DataFrame:
    """All pairs, as a table: however often a fit reads them, the band join runs once, for the fit and for the scores."""
    return materialize(pairs, "fit-pairs")


def _sample(pairs: DataFrame, key: Column) -> DataFrame:
    """``_fit_on`` by the name that callers know: every pair, whatever its key."""
    return _fit_on(pairs)


def _scored(spark, sf, kind):
    pairs = pair_band_join(spark, sf).where("first_id < second_id").withColumn("label", F.col("same_type").cast("double"))
    pairs = _fit_on(pairs.select("first_id", "second_id", *NUMERIC, "delta_day", "label"))
    model = M.Blend(pairs, NUMERIC, ["delta_day"], "label") if kind == "wide_deep" else M.fit(pairs, NUMERIC, ["delta_day"], "label", kind)
    return M.predict(model, pairs).select("first_id", "second_id", "predicted_label", F.round("probability", 6).alias("probability"))


@query()
def train_predict_linear(spark, sf):
    return _scored(spark, sf, "wide")


@query()
def train_predict_mlp(spark, sf):
    return _scored(spark, sf, "deep")


@query()
def train_predict_blend(spark, sf):
    return _scored(spark, sf, "wide_deep")


#: A joint run of few epochs with rates that move the weights in them.
JOINT = W.Settings(hidden=(32, 16), wide_rate=20.0, deep_rate=20.0, dropout=0.1, epochs=4, steps=3, crosses=(("delta_day", "same_day"),))


@query()
def train_predict_joint(spark, sf):
    """The wide and the deep part trained together on all pairs; every pair is scored."""
    pairs = pair_band_join(spark, sf).where("first_id < second_id").withColumn("label", F.col("same_type").cast("double"))
    pairs = _fit_on(pairs.withColumn("same_day", (F.col("delta_day") == 0).cast("int")).select("first_id", "second_id", *NUMERIC, "delta_day", "same_day", "label"))
    keyed = pairs.withColumn("pair", F.concat_ws(":", F.col("first_id").cast("string"), F.col("second_id").cast("string")))
    model = W.fit(keyed, "pair", NUMERIC, ["delta_day"], "label", JOINT)
    return W.predict(model, pairs.drop("label")).select("first_id", "second_id", "predicted_label", F.round("probability", 6).alias("probability"))
