import corpus_pipeline
from quillon.llm import langid, mixing, pii, simhash
from quillon.llm.queries import tokenizer_files


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        tables[name] = now.collect()
        if name != "pack":
            assert now.columns == docs.columns
            now = spark.createDataFrame(tables[name], docs.schema)
    count = {k: len(v) for k, v in tables.items()}
    assert count["language"] <= docs.count() and count["near_copies"] < count["language"]
    assert count["privacy"] == count["near_copies"] and 0 < count["mix"] < count["privacy"]
    texts = [r.text for r in tables["near_copies"]]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    assert len(set(texts)) == len(texts)
    assert not any(a and b and len(a & b) >= 0.9 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert not any(pii.base_spans(r.text) for r in tables["privacy"])
    assert {p.doc_id for p in tables["pack"]} == {r.doc_id for r in tables["mix"]}
    whole = sorted(corpus_pipeline.run(spark, sf).select("doc_id", "doc_tokens").distinct().collect())
    assert whole == sorted({(p.doc_id, p.doc_tokens) for p in tables["pack"]})
    assert langid and mixing and tokenizer_files()


def test_empty_and_odd_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "of the and", None, None, None)], docs.schema)
    for table, least in ((docs.limit(0), 0), (docs.unionByName(odd), 1)):
        for _, stage in corpus_pipeline.STAGES:
            table = spark.createDataFrame((df := stage(spark, table, sf)).collect(), df.schema)
        assert table.count() >= least


def test_stages_keep_columns_of_any_name(spark, sf):
    from pyspark.sql import functions as F

    from quillon.llm import langid, mixing, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("x`y", F.col("doc_id"))
    for stage in (langid.keep_identified, simhash.keep_first, mixing.sampled):
        kept = stage(docs)
        assert kept.columns == docs.columns
        assert kept.where("`a.b` = 1 and `x``y` = doc_id").count() == kept.count() > 0
