"""Every registered query of the library: against its oracle where it has one, else its own invariants."""

import pytest

import __spark_entry__ as entry
from quillon.plans import registry
from tests.compare import both




@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, sf, name):
    got, want = both(spark, sf, registry.QUERIES[name], registry.ORACLES[name])
    assert got == want and got


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["user_id", "first_id", "second_id"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_known_answers(spark):
    sf = "/root/testdata/sf0.01"
    pairs = registry.QUERIES["pair_band_join"](spark, sf)
    assert pairs.count() == 92_781
    assert pairs.agg({"delta_value": "sum"}).first()[0] == pytest.approx(4_112_244.49, abs=0.5)
    freq = registry.QUERIES["time_frequency"](spark, sf)
    assert freq.agg({"time_freq": "sum"}).first()[0] == pytest.approx(0.489117, abs=1e-5)
    assert registry.QUERIES["event_components"](spark, sf).select("cluster_id").distinct().count() == 6_940
    assert registry.QUERIES["strip_brackets"](spark, sf).agg({"n": "sum"}).first()[0] == 687_097
    assert registry.QUERIES["hash_split"](spark, sf).where("train").count() == 980


def test_scenes_partition_their_items(spark, sf):
    rows = registry.QUERIES["scene_split_4d"](spark, sf).collect()
    assert len({r.vec_id for r in rows}) == len(rows) == 500
    sizes = {}
    for r in rows:
        sizes.setdefault((r.scene_id, r.status), []).append(r.vec_id)
    assert all(10 <= len(v) <= 30 for (_, s), v in sizes.items() if s == "chosen")
    assert all(min(v) == k for (k, s), v in sizes.items() if s == "chosen")


def test_cycles_deal_out_their_total(spark, sf):
    totals = {r.name: r.total for r in registry.QUERIES["cycle_propagate"](spark, sf).collect()}
    scc = {r.node: r.scc for r in registry.QUERIES["scc_cycles"](spark, sf).collect()}
    assert totals.keys() == scc.keys() and len(set(scc.values())) < len(scc)
    starts = sum(t for n, t in totals.items() if n.endswith(":start"))
    assert starts == pytest.approx(1.0, abs=1e-4)  # all cost is reached from the starts


def test_classifier_scores_every_pair(spark, sf):
    for name in ("train_predict_linear", "train_predict_mlp", "train_predict_blend", "train_predict_joint"):
        rows = registry.QUERIES[name](spark, sf)
        assert rows.count() == 8_291 and rows.where("probability < 0.5 or predicted_label not in (0, 1)").count() == 0


def test_event_pipeline(spark, sf):
    from quillon.plans import event_pipeline, item_queries

    items = item_queries.events(spark, sf)
    assigned, metrics = event_pipeline.run(items)
    rows = assigned.collect()
    assert sorted(r.event_id for r in rows) == sorted(r.event_id for r in items.select("event_id").collect())
    assert {r.status for r in rows} <= {"chosen", "unchosen", "noise"}
    m = metrics.first()
    assert m.accuracy > 0.9 and m.recall > 0.5
