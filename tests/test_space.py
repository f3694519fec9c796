"""Clusters in space by questions to near blocks: as from all distances, with few questions."""

import numpy as np
import pytest

from quillon.operators import density as D
from quillon.operators import graph as G
from tests.test_density import blobs, frame


def sets(names):
    found = {}
    for i, c in names:
        found.setdefault(c, set()).add(i)
    return sorted(sorted(v) for c, v in found.items() if c is not None and c != -1), sorted(found.get(None, found.get(-1, ())))


def lattice():
    """Rings of equal edges, of three sizes, and points that lie on each other."""
    flat = np.array([(i, j) for i in range(12) for j in range(12)], float)
    return np.concatenate([flat, flat * 0.5 + 20, flat * 2 - (40, 0), np.full((30, 2), 33.0), [[60.0, 60.0]]])


@pytest.mark.parametrize(("points", "least"), [(lattice(), 4), (blobs(1200, 3, 21, 9.0), 10)])
def test_blocks_find_what_all_distances_tell(spark, points, least):
    z = D.standard(points)
    df, columns = frame(spark, z)
    got = D.space_labels(df, "a", "i", columns, least, block=48).collect()
    assert sets((r.i, r.cluster) for r in got) == sets(enumerate(D.best_labels(z, least).tolist()))


def test_points_ask_few_blocks(spark, monkeypatch):
    n, block, rows, write = 4000, 50, {}, D.materialize

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(D, "materialize", counted)
    df, columns = frame(spark, np.random.default_rng(6).normal(size=(n, 2)))
    D.space_labels(df, "a", "i", columns, 10, block=block).count()
    near = rows["near-boxes"] / (n / block)  # blocks within the largest threshold of one
    assert near > 15 and rows["asked"] < 6 * n and rows["space-asked"] < 6 * n


def test_components_of_long_ways(spark):
    rng = np.random.default_rng(3)
    name = rng.permutation(3000)
    way = [(int(name[k]), int(name[k + 1])) for k in range(2999) if k % 1000 != 999] + [(5000, 5000), (int(name[0]), int(name[0])), (6001, 6000), (None, 3), (4, None)]
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(way, "a long, b long"), "a", "b", max_rounds=20, at_once=50).collect()}
    want = {int(v): int(name[k : k + 1000].min()) for k in range(0, 3000, 1000) for v in name[k : k + 1000]}
    assert got == want | {5000: 5000, 6000: 6000, 6001: 6000}
    assert G.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", at_once=1).count() == 0
