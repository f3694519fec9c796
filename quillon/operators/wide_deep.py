"""A wide and a deep part trained together: data-parallel gradients in Arrow batches, added on Spark, one update a step.

Rows are dealt into groups by a hash of their key. A group is the unit of batch normalisation and dropout and lies whole in one
task; a step takes some groups, adds up their gradients and updates the model on the driver, whose size is that of the
model. So neither the partitioning nor the number of tasks changes a result beyond the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialize


@dataclass(frozen=True)
class Settings:
    """What a training run is given; the learning rates are Adadelta's, of the wide and of the deep part."""

    hidden: tuple[int, ...] = (150, 100, 50, 10)
    wide_rate: float = 0.004
    deep_rate: float = 0.00003
    dropout: float = 0.0
    batch_norm: bool = True
    epochs: int = 100
    epochs_per_eval: int = 2
    group_rows: int = 256
    steps: int = 4
    wide_size: int = 1 << 12
    crosses: tuple[tuple[str, ...], ...] = ()
    seed: int = 7


@dataclass
class Model:
    """Weights by name, moving averages of the normalised layers and of Adadelta, and how a row becomes features."""

    settings: Settings
    numeric: list[str]
    categorical: list[str]
    centre: list[float]
    scale: list[float]
    weights: dict[str, np.ndarray]
    moving: dict[str, np.ndarray]
    squares: dict[str, list[np.ndarray]] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)


def featured(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with _x, the standardised numbers (0 where null), and _w, the places of the row's categories and crosses in the wide
    part: each by a hash of its names and values."""
    s = model.settings
    x = F.array(*[F.coalesce((F.col(c).cast("double") - m) / d, F.lit(0.0)) for c, m, d in zip(model.numeric, model.centre, model.scale, strict=True)])
    sets = [(c,) for c in model.categorical] + [tuple(c) for c in s.crosses]
    named = lambda cs: F.concat_ws("\x01", *[F.lit(c) for c in cs], *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs])
    w = F.array(*[F.pmod(F.xxhash64(named(cs)), F.lit(s.wide_size)).cast("int") for cs in sets]) if sets else F.array().cast("array<int>")
    return rows.withColumns({"_x": x, "_w": w})


def started(rows: DataFrame, numeric: list[str], categorical: list[str], settings: Settings) -> Model:
    """A model with random weights and the means and deviations of the numbers."""
    stats = rows.agg(*[f(F.col(c).cast("double")).alias(f"{k}{n}") for n, c in enumerate(numeric) for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    rng = np.random.default_rng(settings.seed)
    sizes = [len(numeric) + len(categorical) * 8, *settings.hidden, 1]
    weights = {"wide": np.zeros(settings.wide_size), "wide_x": np.zeros(len(numeric)), "bias": np.zeros(1), "embed": rng.normal(0, 0.1, (settings.wide_size, 8))}
    moving = {}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        weights[f"w{k}"], weights[f"b{k}"] = rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)
        if settings.batch_norm and k < len(settings.hidden):
            weights[f"gamma{k}"], weights[f"beta{k}"] = np.ones(b), np.zeros(b)
            moving[f"mean{k}"], moving[f"var{k}"] = np.zeros(b), np.ones(b)
    return Model(settings, numeric, categorical, [stats[f"m{k}"] or 0.0 for k in range(len(numeric))], [stats[f"d{k}"] or 1.0 for k in range(len(numeric))], weights, moving)


def forward(model: Model, x: np.ndarray, w: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list, dict]:
    """(logit, what ``backward`` needs, the statistics of normalised layers). With ``rng``: training, else the moving averages."""
    p, s = model.weights, model.settings
    n_cat = len(model.categorical)
    a, tape, seen = np.concatenate([x, p["embed"][w[:, :n_cat]].reshape(len(x), -1)], axis=1), [], {}
    for k in range(len(s.hidden)):
        z = a @ p[f"w{k}"] + p[f"b{k}"]
        norm = None
        if s.batch_norm:
            mean, var = (z.mean(axis=0), z.var(axis=0)) if rng is not None else (model.moving[f"mean{k}"], model.moving[f"var{k}"])
            seen |= {f"mean{k}": mean, f"var{k}": var}
            norm = (z - mean) / np.sqrt(var + 1e-3), np.sqrt(var + 1e-3)
            z = norm[0] * p[f"gamma{k}"] + p[f"beta{k}"]
        keep = (rng.random(z.shape) >= s.dropout) / (1 - s.dropout) if rng is not None and s.dropout else np.ones_like(z)
        tape.append((a, norm, z > 0, keep))
        a = np.maximum(z, 0) * keep
    last = len(s.hidden)
    tape.append((a, None, None, None))
    return (a @ p[f"w{last}"] + p[f"b{last}"])[:, 0] + p["wide"][w].sum(axis=1) + x @ p["wide_x"] + p["bias"][0], tape, seen


def gradients(model: Model, x: np.ndarray, w: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[dict[str, np.ndarray], float, dict]:
    """(sums of gradients, sum of the cross entropy, statistics) of a group."""
    p, s = model.weights, model.settings
    logit, tape, seen = forward(model, x, w, rng)
    loss = float(np.sum(np.logaddexp(0, logit) - y * logit))
    d = 1 / (1 + np.exp(-logit)) - y
    g = {"bias": np.array([d.sum()]), "wide_x": d @ x, "wide": np.zeros(s.wide_size), "embed": np.zeros_like(p["embed"])}
    np.add.at(g["wide"], w, d[:, None])
    last = len(s.hidden)
    up = d[:, None]
    g[f"w{last}"], g[f"b{last}"] = tape[last][0].T @ up, up.sum(axis=0)
    up = up @ p[f"w{last}"].T
    for k in reversed(range(last)):
        a, norm, on, keep = tape[k]
        up = up * keep * on
        if norm is not None:
            z, dev = norm
            g[f"gamma{k}"], g[f"beta{k}"] = (up * z).sum(axis=0), up.sum(axis=0)
            up = up * p[f"gamma{k}"]
            up = (up - up.mean(axis=0) - z * (up * z).mean(axis=0)) / dev
        g[f"w{k}"], g[f"b{k}"] = a.T @ up, up.sum(axis=0)
        up = up @ p[f"w{k}"].T
    n_cat = len(model.categorical)
    if n_cat:
        np.add.at(g["embed"], w[:, :n_cat], up[:, len(model.numeric) :].reshape(len(x), n_cat, 8))
    return g, loss, seen


def _arrays(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """List columns, all of a column's lists of one length and without nulls, as a row of numbers each."""
    return [b.column(n).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for n in names]


def _groups(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, x, w, y) of each row of a batch, a group with its rows, without a Python object a number."""
    held = b.column("_rows")
    flat, ends = held.flatten(), np.cumsum(pc.list_value_length(held).to_numpy())
    if len(flat):
        x, w = (flat.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) for c in ("x", "w"))
        y = flat.field("y").to_numpy(zero_copy_only=False)
        for g, start, end in zip(b.column("_group").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield g, x[start:end], w[start:end].astype(np.int64), y[start:end]


def _added(parts: DataFrame, tasks: int) -> DataFrame:
    """Rows of one array, added up; eight tasks' rows meet in one, until eight are left."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                v = v.values.to_numpy()
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    while tasks > 8:
        tasks = -(-tasks // 8)
        parts = parts.repartition(tasks).mapInArrow(add, "v array<double>")
    return parts


def _step(model: Model, rows: DataFrame, epoch: int, step: int, tasks: int) -> float:
    """One update of the model; the mean loss of its rows."""
    s = model.settings
    shapes = {k: v.shape for k, v in model.weights.items()}
    stats = {k: v.shape for k, v in model.moving.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(int(np.prod(v)) for v in [*shapes.values(), *stats.values()]) + 3)

        for b in batches:
            for g, x, w, y in _groups(b):
                made, loss, seen = gradients(model, x, w, y, np.random.default_rng([s.seed, epoch, step, g]))
                total += np.concatenate([*(made[k].ravel() for k in shapes), *(seen[k].ravel() for k in stats), [loss, len(x), 1]])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    own = rows.where(F.pmod(F.xxhash64("_group", F.lit(epoch)), F.lit(s.steps)) == step)
    parts = [np.array(r.v) for r in _added(own.mapInArrow(run, "v array<double>"), tasks).collect()]
    total = np.sum(parts, axis=0) if parts else np.zeros(1)
    if not parts or total[-2] == 0:
        return float("nan")
    loss, n, groups = total[-3:]
    at = 0
    for k, shape in shapes.items():
        size = int(np.prod(shape))
        g = total[at : at + size].reshape(shape) / n
        at += size
        rate = s.wide_rate if k in ("wide", "wide_x", "bias") else s.deep_rate
        square, moved = model.squares.setdefault(k, [np.zeros(shape), np.zeros(shape)])
        square[:] = 0.95 * square + 0.05 * g * g
        change = np.sqrt(moved + 1e-8) / np.sqrt(square + 1e-8) * g
        moved[:] = 0.95 * moved + 0.05 * change * change
        model.weights[k] = model.weights[k] - rate * change
    for k, shape in stats.items():
        size = int(np.prod(shape))
        model.moving[k] = 0.9 * model.moving[k] + 0.1 * total[at : at + size].reshape(shape) / groups
        at += size
    return float(loss / n)


def fit(rows: DataFrame, key: str, numeric: list[str], categorical: list[str], label: str, settings: Settings = Settings(), held_out: DataFrame | None = None) -> Model:
    """A model trained on ``rows``. Its history has, for each epoch, the mean loss of the steps' rows and, every
    ``epochs_per_eval`` epochs, the loss and accuracy over ``held_out``. Rows without a label are left out. A group is one row of
    about ``group_rows`` rows, if ``key`` is a key; equal keys fall into one group."""
    known = rows.where(F.col(label).isNotNull())
    model = started(known, numeric, categorical, settings)
    n = known.count()
    groups = max(settings.steps, round(n / settings.group_rows))
    dealt = featured(known, model).select(
        F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(settings.seed)), F.lit(groups)).alias("_group"),
        F.struct(F.col(key).cast("string").alias("key"), F.col(label).cast("double").alias("y"), F.col("_x").alias("x"), F.col("_w").alias("w")).alias("_row"),
    )
    ordered = F.sort_array(F.collect_list("_row"))  # the key only orders
    dealt = materialize(dealt.groupBy("_group").agg(F.transform(ordered, lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["w"].alias("w"))).alias("_rows")), "training-groups")
    tasks = dealt.select(F.spark_partition_id().alias("p")).distinct().count()
    for epoch in range(settings.epochs):
        losses = [x for k in range(settings.steps) if not np.isnan(x := _step(model, dealt, epoch, k, tasks))]
        model.history.append({"epoch": epoch + 1, "loss": float(np.mean(losses)) if losses else None})
        if held_out is not None and (epoch + 1) % settings.epochs_per_eval == 0:
            model.history[-1] |= evaluated(model, held_out, label)
    return model


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` with predicted_label and its probability."""
    ready = featured(rows, model)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    names = rows.columns
    broadcast = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for b in batches:
            if b.num_rows:
                x, w = _arrays(b, "_x", "_w")
                p = 1 / (1 + np.exp(-forward(m, x, w.astype(np.int64))[0]))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array((p > 0.5).astype(np.int32)), pa.array(np.maximum(p, 1 - p))], names=[*names, "predicted_label", "probability"])

    return ready.mapInArrow(run, f"{schema}, predicted_label int, probability double")


def evaluated(model: Model, rows: DataFrame, label: str) -> dict:
    """The mean loss and the accuracy over labelled rows."""
    right = F.col("predicted_label") == F.col(label).cast("int")
    scored = predict(model, rows.where(F.col(label).isNotNull()))
    loss = -F.log(F.greatest(F.when(right, F.col("probability")).otherwise(1 - F.col("probability")), F.lit(1e-12)))
    r = scored.agg(F.avg(loss).alias("loss"), F.avg(right.cast("double")).alias("accuracy")).first()
    return {"eval_loss": r.loss, "eval_accuracy": r.accuracy}
