"""Sets that are cut again and again: from lists of the nearest as from all distances."""

import numpy as np
import pytest

from quillon.operators import density as D
from tests.test_density import blobs, frame


def normal(n, d, seed=5):
    return np.random.default_rng(seed).normal(size=(n, d))


GRID = np.array([(i, j) for i in range(25) for j in range(20)], float)


@pytest.mark.parametrize(
    ("points", "least"),
    [(normal(700, 4), 10), (blobs(600, 4, 1), 10), (blobs(600, 2, 2), 5), (blobs(500, 1, 3), 10), (np.repeat(normal(100, 3), 6, axis=0), 10), (np.zeros((300, 4)), 10), (GRID, 5), (normal(400, 2) ** 3, 3)],
)
def test_lists_cut_like_all_distances(points, least):
    parts = lambda plain: sorted((tuple(i.tolist()), s) for i, s in D.split(points, least, 30, plain) if len(i))
    assert parts(0) == parts(10**9)


def test_a_cut_tells_the_clusters(monkeypatch):
    monkeypatch.setattr(D._Cuts, "ROOM", 5000)  # in small pieces
    for points in (normal(500, 4, 8), blobs(420, 3, 9)):
        cuts = D._Cuts(points, 10)
        label, want = cuts.labels(np.arange(len(points))), D.best_labels(D.standard(points), 10)
        assert label.tolist() == want.tolist()
        rest = np.flatnonzero(label >= 0)
        want = D.best_labels(D.standard(points[rest]), 10)
        assert cuts.labels(rest).tolist() == np.where(want < 0, -1, rest[want]).tolist()


def test_a_large_set_ends_in_its_task(spark):
    df, columns = frame(spark, normal(2500, 4))
    got = D.scenes(df, "a", "i", columns, max_levels=1).collect()  # a level takes off a few points, and each would be a round of jobs
    assert sorted(r.i for r in got) == list(range(2500)) and {r.status for r in got} >= {"noise"}
