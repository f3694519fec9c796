import zlib

from pyspark.sql import functions as F

from quillon.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_backoff_uses_the_longest_known_grams(spark):
    docs = spark.createDataFrame([(1, "xx", "ab abba ab"), (3, "yy", "cd cddc cd")], "doc_id long, lang string, text string")
    m = langid.train(docs)
    at = {g: m.grams[k] for g, k in m.gram_at.items()}
    assert (m.word("abba") == m.known[m.words["abba"]]).all()
    assert (m.word("abbx") == at["^abb"]).all()
    assert (m.word("qqd") == at["d$"]).all()
    assert (m.word("???") == 0).all() or len(m.word("???")) == 2
    more = docs.unionByName(spark.createDataFrame([(4, "xx", "ab ab ab ab ab ab ab ab ab")], docs.schema))
    small = langid.train(more, max_words=1, max_grams=9)
    assert list(small.words) == ["ab"] and 0 < len(small.gram_at) <= 9


def test_no_word_is_left_out(spark, monkeypatch):
    """A frequent language of more words than the old bound of 60000, and a rare one over the same letters."""
    import random

    random.seed(4)
    vocabulary = sorted({"".join(random.choices("abcdefgh", k=7)) for _ in range(72_000)})
    assert len(vocabulary) > 66_000
    rare, hot = vocabulary[::900], [w for k, w in enumerate(vocabulary) if k % 900]
    taught = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 != 2]
    tested = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 == 2]
    rows = [(taught[k], " ".join(hot[k::50] * 2), "hot") for k in range(50)] + [(taught[50], " ".join(rare), "rr")]
    rows += [(tested[0], " ".join(rare[::2]), "rr"), (tested[1], " ".join(hot[::700]), "hot"), (tested[2], "abcdefx " + rare[3] + " qq", "rr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("not " + f"doc_id in ({tested[0]}, {tested[1]}, {tested[2]})"))
    want = {r.doc_id: r.p for r in docs.select("doc_id", langid.predict(docs, model).alias("p")).collect()}
    for head in (langid.HEAD, 100):
        monkeypatch.setattr(langid, "HEAD", head)
        got = {r.doc_id: r for r in langid.identify(docs).collect()}
        assert [got[k].lang_pred for k in tested[:2]] == ["rr", "hot"]
        assert all(got[k].lang_pred == want[k].lang and abs(got[k].score - want[k].score) < 1e-3 for k in want)


def test_edges(spark):
    rows = [(1, "one two three", "en"), (2, None, "en"), (3, "12 ½ _ ...", "en"), (4, "", None), (5, "eins zwei drei", "de"), (None, "two one", None), (5, "漢字", None), (6, "two " * 80000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.train(docs)
    got = [(r.doc_id, r.p.lang, r.p.score) for r in docs.select("doc_id", langid.predict(docs, model).alias("p")).collect()]
    assert [(i, p) for i, p, _ in got] == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (None, "en"), (5, "de"), (6, "en")]
    assert [s for _, p, s in got if p == "und"] == [0, 0, 0]
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("lang is null").count() == 0
    assert langid.identify(docs.limit(0)).count() == 0 and langid.keep_identified(docs.limit(0)).count() == 0
