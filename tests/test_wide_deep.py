"""The joint classifier: its gradients, its steps and what it learns."""

import numpy as np
import pytest

from quillon.operators import wide_deep as W

ROWS = "id long, a double, b double, c int, label double"
SMALL = W.Settings(hidden=(6, 4), wide_rate=20.0, deep_rate=20.0, dropout=0.0, epochs=8, group_rows=40, steps=4, wide_size=64)


def rows_of(n=600, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        a, b, c = *rng.normal(size=2), int(rng.integers(0, 3))
        out.append((k, float(a) if k % 50 else None, float(b), c if k % 70 else None, float(a * b + (c == 1) > 0.2)))
    return out


def model_of(settings):
    rng = np.random.default_rng(1)
    sizes = [2 + 8, *settings.hidden, 1]
    weights = {"wide": rng.normal(size=settings.wide_size), "wide_x": rng.normal(size=2), "bias": rng.normal(size=1), "embed": rng.normal(size=(settings.wide_size, 8))}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        weights[f"w{k}"], weights[f"b{k}"] = rng.normal(size=(a, b)), rng.normal(size=b)
        if settings.batch_norm and k < len(settings.hidden):
            weights[f"gamma{k}"], weights[f"beta{k}"] = rng.normal(size=b), rng.normal(size=b)
    return W.Model(settings, ["a", "b"], ["c"], [0, 0], [1, 1], weights, {})


@pytest.mark.parametrize(("norm", "dropout"), [(True, 0.0), (False, 0.0), (True, 0.4), (False, 0.3)])
def test_gradients_equal_differences(norm, dropout):
    m = model_of(W.Settings(hidden=(5, 3), batch_norm=norm, dropout=dropout, wide_size=16))
    rng = np.random.default_rng(2)
    x, w, y = rng.normal(size=(9, 2)), rng.integers(0, 16, (9, 2)), rng.integers(0, 2, 9).astype(float)
    loss = lambda: W.gradients(m, x, w, y, np.random.default_rng(3))
    made = loss()[0]
    assert made.keys() == m.weights.keys()
    for k, v in m.weights.items():
        for at in [np.unravel_index(int(i), v.shape) for i in rng.integers(0, v.size, 6)]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()[1]
            v[at] = old - 1e-6
            down = loss()[1]
            v[at] = old
            assert made[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-4), (k, at)


def test_learns_and_does_not_depend_on_the_tasks(spark):
    data = rows_of()
    fit = lambda parts, **more: W.fit(spark.createDataFrame(data, ROWS).repartition(parts), "id", ["a", "b"], ["c"], "label", SMALL, **more)
    one = fit(1, held_out=spark.createDataFrame(rows_of(200, 9), ROWS))
    losses = [h["loss"] for h in one.history]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.8 * losses[0]
    assert [("eval_loss" in h) for h in one.history] == [False, True] * 4 and one.history[-1]["eval_accuracy"] > 0.7
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = fit(7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [h["loss"] for h in many.history] == pytest.approx(losses, rel=1e-9)
    for k, v in one.weights.items():
        assert many.weights[k] == pytest.approx(v, rel=1e-6, abs=1e-9)
    scored = W.predict(one, spark.createDataFrame(data, ROWS)).collect()
    assert len(scored) == 600 and all(r.probability >= 0.5 and r.predicted_label in (0, 1) for r in scored)


def test_partial_sums_meet_eight_at_a_time(spark):
    parts = spark.range(100).repartition(30).selectExpr("array(cast(id as double), 1D) as v")
    out = W._added(parts, 30).collect()
    assert 1 <= len(out) <= 8 and np.sum([r.v for r in out], axis=0).tolist() == [4950.0, 100.0]
