"""Reachability clusters: levels, cuts and recursion against plain definitions, and blocks against one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import density as D
from quillon.operators import graph as G


def blobs(n, d, seed, spread=6.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, d)) * spread
    return np.concatenate([middles[k] + rng.normal(size=(n // 6, d)) * (0.2 + 0.2 * k) for k in range(5)] + [rng.uniform(-12, 12, (n - 5 * (n // 6), d))])


def plain_cut(points, least, k):
    """Clusters (sets of indices) at level k, point by point."""
    d = D.distances(points, points)
    core = [i for i in range(len(points)) if (d[i] <= k / D.STEPS).sum() >= least]
    left, out = set(core), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            i = todo.pop()
            own.add(i)
            near = {j for j in left if d[i, j] <= k / D.STEPS}
            left -= near
            todo += near
        out.append(own)
    covered = {j for j in range(len(points)) if any(d[j, i] <= k / D.STEPS for i in core)}
    return out, covered


def plain_best(points, least):
    best = None
    for k in range(D.STEPS):
        cores, covered = plain_cut(points, least, k)
        noise = len(points) - len(covered)
        if len(cores) + (noise > 0) > 1 and covered and (best is None or noise < best[0]):
            best = noise, k, cores
    return best


def frame(spark, points, key=1):
    columns = [f"c{k}" for k in range(points.shape[1])]
    return spark.createDataFrame([(key, k, *map(float, p)) for k, p in enumerate(points)], "a long, i long, " + ", ".join(f"{c} double" for c in columns)), columns


def test_levels(spark):
    x = [0.0, 0.01, 0.07, 0.29, 0.57, 0.58, 0.07000000000000001, 0.5, 0.99, 0.995, 1.0, 5.0, float("inf")]
    want = [next((k for k in range(D.STEPS) if v <= k / D.STEPS), D.STEPS) for v in x]
    assert D.levels(np.array(x)).tolist() == want
    got = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").select(D.level_of(F.col("x")).alias("k")).collect()
    assert [r.k for r in got] == [*want, D.STEPS]


@pytest.mark.parametrize(("n", "d", "seed"), [(120, 2, 1), (150, 4, 2), (90, 1, 3), (40, 3, 4)])
def test_best_cut_equals_every_cut(n, d, seed):
    p = blobs(n, d, seed)
    z = np.round((p - p.mean(axis=0)) / p.std(axis=0), 9)
    noise, k, cores = plain_best(z, 5)
    label = D.best_labels(z, 5)
    assert (label < 0).sum() == noise
    of = {}
    for i, c in enumerate(label):
        of.setdefault(c, set()).add(i)
    held = set().union(*cores)
    assert sorted(map(sorted, cores)) == sorted(sorted(v & held) for c, v in of.items() if c >= 0)
    d = D.distances(z, z)
    for c, v in of.items():  # a point at the rim lies within the threshold of a core of its cluster
        assert c < 0 or all(any(d[i, j] <= k / D.STEPS for j in v & held) for i in v)


def test_split_partitions_its_points():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.05, (25, 2)) for c in (0, 3, 6)])
    parts = D.split(points, 10, 30)
    assert sorted(np.concatenate([i for i, _ in parts]).tolist()) == list(range(75))
    assert sum(s == "chosen" for _, s in parts) == 3
    assert [s for _, s in D.split(points[:5], 10, 30)] == ["unchosen"]
    assert len(np.concatenate([i for i, _ in D.split(np.zeros((40, 2)), 10, 30)])) == 40


@pytest.mark.parametrize(("n", "d", "bound", "block"), [(420, 4, 300, 64), (330, 1, 260, 32)])
def test_blocks_equal_one_task(spark, n, d, bound, block):
    df, columns = frame(spark, blobs(n, d, 7))
    odd = df.limit(1).select(F.lit(1).cast("long").alias("a"), F.lit(-5).cast("long").alias("i"), *[F.lit(None).cast("double").alias(c) for c in columns])
    both = df.unionByName(odd).unionByName(df.where("i < 12").withColumns({"a": F.lit(2).cast("long"), "i": F.col("i") + 10_000}))
    got, want = ({r.i: (r.a, r.scene_id, r.status) for r in D.scenes(both, "a", "i", columns, **kw).collect()} for kw in ({"in_one_task": bound, "block": block}, {}))
    assert got == want and len(got) == n + 13 and got[-5] == (1, -5, "noise")
    assert {v[2] for v in got.values()} >= {"chosen", "noise"}


def test_large_event_in_space(spark):
    p = blobs(3000, 4, 11)
    z = np.round((p - p.mean(axis=0)) / p.std(axis=0), 9)
    df, columns = frame(spark, z)
    got = {r.i: r.cluster for r in D.space_labels(df, "a", "i", columns, 10, block=512).collect()}
    label = D.best_labels(z, 10)
    names = {c: {i for i in range(len(z)) if label[i] == c} for c in set(label) if c >= 0}
    found = {}
    for i, c in got.items():
        found.setdefault(c, set()).add(i)
    assert sorted(map(sorted, names.values())) == sorted(sorted(v) for c, v in found.items() if c is not None)


def test_empty(spark):
    df, columns = frame(spark, np.zeros((1, 2)))
    assert D.scenes(df.limit(0), "a", "i", columns).count() == 0


def test_spanning_forest(spark):
    rng = np.random.default_rng(3)
    edges = {(int(min(a, b)), int(max(a, b))): int(w) for a, b, w in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 9, 300), strict=True) if a != b}
    edges |= {(100, 101): 5, (101, 102): 5, (100, 102): 5}
    root = {v: v for e in edges for v in e}
    want = set()
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        x, y = root[a], root[b]
        if x != y:
            want.add((a, b, w))
            root = {v: (x if r == y else r) for v, r in root.items()}
    df = spark.createDataFrame([(b, a, w) for (a, b), w in edges.items()] + [(7, 7, 0), (None, 3, 0), (1, 2, None)], "a long, b long, w int")
    assert {tuple(r) for r in G.spanning_forest(df).collect()} == want
    assert G.spanning_forest(df.limit(0)).count() == 0
