"""Steps that read, shuffle or repeat no more than their results need, with the same results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import callgraph as C
from quillon.operators import density as D
from quillon.operators import graph as G
from quillon.operators import items as I
from quillon.operators.places import nearest_place
from quillon.plans import density_queries, graph_queries, item_queries, model_queries


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_forest_and_components_in_one_task_or_rounds(spark, at_once):
    rng = random.Random(5)
    edges = [(k, k + 1, 100 - k % 37) for k in range(90)] + [(rng.randrange(120), rng.randrange(120), rng.randrange(200)) for _ in range(200)]
    df = spark.createDataFrame([*edges, (500, 501, 3)], "a long, b long, w int")
    root, want = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in [*edges, (500, 501, 3)] if a != b):
        if find(a) != find(b):
            root[find(b)] = find(a)
            want.add((a, b, w))
    assert {tuple(r) for r in G.spanning_forest(df, at_once=at_once).collect()} == want
    got, least = dict(map(tuple, G.connected_components(df, "a", "b", at_once=at_once).collect())), {}
    for v in got:
        least[find(v)] = min(v, least.get(find(v), v))
    assert got == {v: least[find(v)] for v in got} and len(got) == len({v for a, b, _ in edges for v in (a, b)}) + 2


def test_roots_come_from_pointers_alone(spark, monkeypatch):
    monkeypatch.setattr(G, "connected_components", None)  # a round of the forest follows pointers and hears no labels over edges
    df = spark.createDataFrame([(k, k + 1, k) for k in range(40)], "a long, b long, w int")
    assert G.spanning_forest(df, at_once=0).count() == 40


def test_nearest_ancestor_over_long_dead_chains(spark):
    tree = [(k, k - 1 if k else None, k in (0, 5)) for k in range(400)] + [(1000, 999, False), (1001, 1000, True), (1002, 1001, None), (1003, 1002, False)]
    got = dict(map(tuple, G.nearest_ancestor(spark.createDataFrame(tree, "node long, parent long, live boolean")).collect()))
    want = {k: None if k == 0 else 0 if k <= 5 else 5 for k in range(400)} | {1000: None, 1001: None, 1002: 1001, 1003: 1001}
    assert got == want


def test_call_graph_is_read_from_summed_paths(spark, sf):
    for df in graph_queries.graph(spark, sf):
        assert not any("lineitem" in f for f in df.inputFiles())


def test_fit_reads_a_table_of_its_sample(spark, sf):
    pairs = item_queries.pair_band_join(spark, sf).where("first_id < second_id")
    sample = model_queries._sample(pairs, F.concat_ws(":", "first_id", "second_id"))
    assert sample.count() == 8_291 and not any("events" in f for f in sample.inputFiles())


def test_tasks_follow_the_rows(spark):
    df = spark.range(1000).select((F.col("id") % 90).alias("u"), "id")
    assert I.dealt(df, "u", 100).rdd.getNumPartitions() == 10 and I.dealt(df.limit(0), "u").count() == 0
    assert I.dealt(df, "u", 100).select("u", F.spark_partition_id()).distinct().count() == 90


def test_small_keys_on_a_line_equal_blocks(spark, sf):
    e = item_queries.events(spark, sf).select("user_id", "event_id", F.col("us").cast("double").alias("us"))
    z = density_queries._standard(e, "user_id", "event_id", ["us"])
    sets = lambda **kw: {frozenset(r.m) for r in D.line_labels(z, "user_id", "event_id", "us", 10, **kw).groupBy("user_id", "cluster").agg(F.collect_list("event_id").alias("m")).collect()}
    want = sets()
    assert sets(in_one_task=1500) == want and sets(in_one_task=66) == want


def test_small_keys_keep_large_ids(spark):
    rows = [(1, 2**60 + k, float(x)) for k, x in enumerate(np.r_[np.linspace(0, 0.1, 12), np.linspace(3, 3.1, 12), 9.0])]
    df = spark.createDataFrame(rows, "a long, i long, x double")
    got = {r.i: r.cluster for r in D.line_labels(df, "a", "i", "x", 10, in_one_task=100).collect()}
    assert got[2**60 + 24] is None and len(set(got.values())) == 3 and all(c is None or c in got for c in got.values())


def test_spots_beside_zero_and_halfway(spark):
    df = spark.createDataFrame([(1, -0.001, -2.03), (2, -0.84, -1.5)], "id long, lat double, lon double")
    keys = [r.k for r in df.orderBy("id").select(S.rounded_key(F.col("lat"), F.col("lon")).alias("k")).collect()]
    assert keys == ["(-0.00, -2.03)", "(-0.84, -1.50)"]
    places = spark.createDataFrame([(f"{n} {lat}", float(lat), float(lon)) for n, lon in (("b", -1), ("a", -2)) for lat in range(-5, 4)], "name string, lat double, lon double")
    got = nearest_place(df, places, "name", "lat", "lon", 900.0).where("id = 2").first()
    rad = np.radians
    far = lambda lat, lon: 6371 * np.sqrt((np.cos(rad(-0.84)) * np.sin(rad(-1.5)) - np.cos(rad(lat)) * np.sin(rad(lon))) ** 2 + (np.sin(rad(-0.84)) - np.sin(rad(lat))) ** 2 + (np.cos(rad(-0.84)) * np.cos(rad(-1.5)) - np.cos(rad(lat)) * np.cos(rad(lon))) ** 2)
    assert got.name == min((far(float(lat), float(lon)), f"{n} {lat}") for n, lon in (("b", -1), ("a", -2)) for lat in range(-5, 4))[1]


def test_graph_tables_are_not_broadcast(spark, sf, monkeypatch):
    plans, write = [], G.materialize
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (G, C, graph_queries):
        monkeypatch.setattr(module, "materialize", lambda df, name: plan(df) or write(df, name))
    plan(graph_queries.cycle_propagate(spark, sf))
    assert sum("SortMergeJoin" in p for p in plans) > 20 and not any("BroadcastHashJoin" in p for p in plans)  # what is broadcast goes through the driver
    assert sum("events" in p for p in plans) == 1  # read once, for the table of edges


def test_ends_of_one_way_are_components_of_their_own(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("z", "a"), ("d", "d"), ("e", "f"), (None, "a"), ("g", None)]
    got = {r.node: r.scc for r in G.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "z": "z", "d": "d", "e": "e", "f": "f"}
