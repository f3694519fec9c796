import pytest

from quillon.llm import mixing, oracles, queries
from tests.llm.compare import both


def test_equals_oracle(spark):
    got, want = both(spark, "/root/testdata/sf0.01", queries.op2_mixing, oracles.ORACLES["op2_mixing"])
    assert got == want


def test_marginals_meet_targets(spark):
    cells = spark.createDataFrame([(s, l, t, 10.0 + 7 * a + b * 3 + c) for a, s in enumerate("xyz") for b, l in enumerate("ab") for c, t in enumerate("mno")], "source string, lang string, topic string, tokens double")
    raked = mixing.rake(cells, {"source": {"x": 0.5, "y": 0.25, "z": 0.25}, "lang": 0.0, "topic": {"m": 1.0, "n": 1.0, "o": 2.0}}, max_rounds=100).collect()
    for at, want in ((0, {"x": 0.5, "y": 0.25, "z": 0.25}), (1, {"a": 0.5, "b": 0.5}), (2, {"m": 0.25, "n": 0.25, "o": 0.5})):
        for value, share in want.items():
            assert sum(r.share for r in raked if r[at] == value) == pytest.approx(share, abs=1e-6)
    rates = mixing.rates(spark.createDataFrame(raked), 0.6).collect()
    assert sum(r.rate * r.tokens for r in rates) == pytest.approx(0.6 * sum(r.tokens for r in rates))
    assert all(0 <= r.rate <= 1 for r in rates)


def test_edges(spark):
    rows = [(None, None, None, None), (1, "", "s", "en"), (2, "a b", None, None), (2, "a b", None, None), (3, "w " * 50000, "s", "en"), (4, "x | y | z", "t", "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, lang string, rate double")
    got = mixing.mix(docs, part=1.0).orderBy("doc_id").collect()
    assert len(got) == 6 and [r.rate for r in got if not r.n_tokens] == [0.0, 0.0]
    assert all(r.sampled and r.rate == 1.0 for r in got if r.n_tokens)
    assert [r.n_tokens for r in got] == [0, 0, 2, 2, 50000, 5] and got[-1].topic == "table"
    kept = mixing.sampled(docs, part=1.0)
    assert kept.columns == docs.columns and kept.count() == 4
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sampled(docs.limit(0)).count() == 0


def test_targets_as_weights_and_a_given_topic(spark):
    """Enough cells for all targets: the sampled tokens follow the weights of each dimension."""
    rows = [(k, "w " * 50, f"s{k % 4}", ("en", "en", "en", "de")[k // 4 % 4], ("law", "arts")[k // 16 % 2], 9) for k in range(6400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, field string, mix_rate int")
    targets = {"source": {"s0": 4.0, "*": 1.0}, "lang": {"en": 1.0, "de": 1.0}, "topic": {"law": 3.0, "arts": 1.0}}
    out = mixing.sampled(docs, part=0.2, targets=targets, topic_col="field")
    assert out.columns == docs.columns
    kept = out.collect()
    share = lambda f: sum(map(f, kept)) / len(kept)
    assert abs(len(kept) / 6400 - 0.2) < 0.03
    assert abs(share(lambda r: r.source == "s0") - 4 / 7) < 0.05
    assert abs(share(lambda r: r.lang == "de") - 0.5) < 0.05 and abs(share(lambda r: r.field == "law") - 0.75) < 0.05


def test_targets_that_cannot_be_met_are_said(spark):
    import pytest

    cells = spark.createDataFrame([("a", "en", "prose", 10), ("b", "de", "prose", 10)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": 1.0}
    with pytest.warns(UserWarning, match="targets"):
        assert mixing.rake(cells, targets, max_rounds=10).count() == 2
    with pytest.raises(ValueError, match="targets"):
        mixing.rake(cells, targets, max_rounds=10, strict=True)
    one = mixing.rake(cells, targets | {"lang": 1.0, "source": {"a": 0.5, "b": 0.5}})
    assert {r.source: round(r.share, 9) for r in one.collect()} == {"a": 0.5, "b": 0.5}
