"""Fits over all rows: no classifier is made from a part of its pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import wide_deep as W
from quillon.plans import model_queries as Q

N = 60_000


class Seen(Exception):
    pass


@pytest.fixture
def many_pairs(spark, monkeypatch):
    numbers = [F.rand(k).alias(c) for k, c in enumerate(Q.NUMERIC)]
    pairs = spark.range(N).select(F.col("id").alias("first_id"), (F.col("id") + 1).alias("second_id"), *numbers, (F.col("id") % 5).cast("int").alias("delta_day"), (F.col("id") % 2).alias("same_type"))
    monkeypatch.setattr(Q, "pair_band_join", lambda spark, sf: pairs)

    def seen(rows, *rest, **more):
        raise Seen(rows.count(), rows.select("first_id", "second_id").distinct().count())

    for module, name in ((Q.M, "fit"), (Q.M, "Blend"), (Q.W, "fit")):
        monkeypatch.setattr(module, name, seen)


@pytest.mark.parametrize("name", ["train_predict_linear", "train_predict_mlp", "train_predict_blend", "train_predict_joint"])
def test_fit_is_given_every_pair(spark, many_pairs, name):
    with pytest.raises(Seen) as seen:
        getattr(Q, name)(spark, "unused")
    assert seen.value.args == (N, N)


def test_groups_of_a_batch_are_its_rows():
    row = lambda k: {"y": float(k % 2), "x": [k, k + 0.5], "w": [k, 2 * k, 3 * k]}
    kind = pa.list_(pa.struct([("y", pa.float64()), ("x", pa.list_(pa.float64())), ("w", pa.list_(pa.int32()))]))
    held = [[row(0)], [row(1), row(2), row(3)], [row(4), row(5)]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(held, kind)], names=["_group", "_rows"])
    for b, at in ((batch, 0), (batch.slice(1), 1)):
        got = list(W._groups(b))
        assert [g for g, *_ in got] == [7, 8, 9][at:]
        for (_, x, w, y), rows in zip(got, held[at:], strict=True):
            assert x.tolist() == [r["x"] for r in rows] and w.tolist() == [r["w"] for r in rows] and y.tolist() == [r["y"] for r in rows] and w.dtype == np.int64
    assert list(W._groups(batch.slice(3))) == []
