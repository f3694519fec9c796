"""Nearest places against all distances, and pairs that are made in several runs."""

import math
import os
import random

from pyspark.sql import functions as F

from quillon.operators.places import nearest_place
from quillon.sources import resumable


def xyz(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return 6371 * math.cos(a) * math.sin(b), 6371 * math.sin(a), 6371 * math.cos(a) * math.cos(b)


def test_nearest_place_equals_all_distances(spark):
    rng = random.Random(3)
    items = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(150)]
    items += [(200, 90.0, 0.0), (201, -90.0, 77.0), (202, 10.0, 180.0), (203, 10.0, -180.0), (204, None, 3.0), (205, 4.0, None), *[(300 + k, 48.137, 11.576) for k in range(50)]]
    places = [(f"p{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)] + [("twin b", 48.0, 11.0), ("twin a", 48.0, 11.0), ("none", None, 1.0), (None, 1.0, 1.0), ("pole", 89.9, 170.0), ("east", 10.0, 179.9)]
    df = spark.createDataFrame([(*r, "x") for r in items], "id long, lat double, lon double, place string")
    known = spark.createDataFrame(places, "name string, lat double, lon double")
    got = {r.id: (r.name, r.name_km) for r in nearest_place(df, known, "name", "lat", "lon", 900.0, first_km=60.0).collect()}
    assert len(got) == len(items)
    for i, lat, lon in items:
        want = (None, None)
        if lat is not None and lon is not None:
            d = sorted((math.dist(xyz(round(lat, 2), round(lon, 2)), xyz(a, b)), n) for n, a, b in places if n is not None and a is not None)[0]
            want = (d[1], d[0]) if d[0] <= 900 else want
        assert got[i][0] == want[0] and (want[1] is None or abs(got[i][1] - want[1]) < 1e-6)
    assert got[300] == got[349] and got[200][0] == "pole" and got[203][0] == "east"


def test_no_places_and_no_items(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "id long, lat double, lon double")
    known = spark.createDataFrame([], "name string, lat double, lon double")
    assert [tuple(r) for r in nearest_place(df, known, "name", "lat", "lon", 10.0).collect()] == [(1, 1.0, 2.0, None, None)]
    assert nearest_place(df.limit(0), known, "name", "lat", "lon", 10.0).count() == 0


def test_stopped_pairs_go_on(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(4), k, rng.randrange(10**9)) for k in range(300)]
    items = spark.createDataFrame(rows, "u long, i long, us long")
    select = [F.col("l.i").alias("a"), F.col("r.i").alias("b")]
    run = lambda df=items, **more: resumable.resumable_pairs(df, f"file://{tmp_path}/pairs", "u", "i", "us", 60, select, strict=True, buckets=8, at_once=2, **more)
    want = sorted((i, j) for u, i, s in rows for v, j, t in rows if u == v and i < j and abs(s - t) <= 60e6)
    assert run(stop_after=2) is None
    [folder] = [d for d in os.listdir(tmp_path / "pairs") if d.startswith("pairs-")]
    bucket = lambda: {d: sorted(os.listdir(tmp_path / "pairs" / folder / d)) for d in os.listdir(tmp_path / "pairs" / folder) if d.startswith("bucket=")}
    first = bucket()
    stale = tmp_path / "pairs" / folder / "bucket=7"
    spark.createDataFrame([(-1, -1)], "a long, b long").write.parquet(f"file://{stale}")  # left by a job that was killed before its entry
    assert sorted(map(tuple, run().collect())) == want
    assert all(bucket()[d] == files for d, files in first.items())  # what was done is not made again
    before = bucket()
    assert sorted(map(tuple, run().collect())) == want and bucket() == before
    fewer = items.where("i < 100")
    assert sorted(map(tuple, run(fewer).collect())) == [(a, b) for a, b in want if a < 100 and b < 100]
    assert run(items.limit(0)).count() == 0
