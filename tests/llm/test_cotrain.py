import numpy as np

from quillon.llm import cotrain, queries


def test_held_out_quality(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    tested = {r.doc_id: r.quality for r in labels.join(known, "doc_id", "left_anti").collect()}
    part = docs.where("doc_id < 5000")
    got = {r.doc_id: r for r in cotrain.score(part, known, max_labelled=1500).collect()}
    assert len(got) == part.count()
    both = [(got[i].quality_score, q, got[i].keep) for i, q in tested.items() if i in got]
    good, bad = np.array([s for s, q, _ in both if q]), np.array([s for s, q, _ in both if not q])
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert np.mean([k for _, q, k in both if q]) > 0.97


def least_squares(x, y, weight, l2=0.01):
    """Weighted least squares by solving for centred columns, row by row sums."""
    w = weight / weight.sum()
    mean, share = w @ x, w @ y
    c = x - mean
    spread = (c * w[:, None]).T @ c
    beta = np.linalg.solve(spread + np.diag(l2 * np.diag(spread) + 1e-6), (c * w[:, None]).T @ (y - share))
    return lambda z: (z - mean) @ beta + share


def test_equals_brute_force(spark):
    """All rounds over all rows in one process, from row weights instead of sums of products."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7, "doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect()}
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    view = cotrain.TextView()
    text = np.array([view(r.text) for r in rows]).astype(np.float16).astype(np.float64)
    meta = np.zeros((len(rows), cotrain.META_SIZE))
    for k, r in enumerate(rows):
        meta[k, cotrain.metadata(r.source, r.lang, r.n_chars)] = 1
    known = np.array([k for k, r in enumerate(rows) if r.doc_id in label])
    y = np.array([label[rows[k].doc_id] for k in known], float)
    last = np.sort(np.concatenate([np.flatnonzero(y == c)[4::5] for c in (0, 1)]))
    hold, hold_y, pool = known[last], y[last], np.array([k for k, r in enumerate(rows) if r.doc_id not in label])
    taught, taught_y = np.delete(known, last), np.delete(y, last)
    pseudo = {"text": (pool[:0], np.zeros(0)), "meta": (pool[:0], np.zeros(0))}
    for _ in range(4):
        logit = {}
        for name, x in (("text", text), ("meta", meta)):
            at, ys = pseudo[name]
            weight = np.concatenate([np.ones(len(taught)), *[np.zeros(0)]])
            extra = np.zeros(len(at))
            for c in (0, 1):
                if (ys == c).any():
                    extra[ys == c] = (taught_y == c).sum() / (ys == c).sum()
            f = least_squares(x[np.r_[taught, at]], np.r_[taught_y, ys], np.r_[weight, extra])
            scale = cotrain.calibrated(f(x[hold])[:, None], hold_y)
            logit[name] = scale(f(x)[:, None])
        p = {k: 1 / (1 + np.exp(-v)) for k, v in logit.items()}
        for name, other in (("text", "meta"), ("meta", "text")):
            up, down = pool[p[other][pool] >= 0.9], pool[1 - p[other][pool] >= 0.9]
            pseudo[name] = np.r_[up, down], np.r_[np.ones(len(up)), np.zeros(len(down))]
    two = np.stack([logit["text"], logit["meta"]], axis=1)
    want = 1 / (1 + np.exp(-cotrain.calibrated(two[hold], hold_y)(two)))
    got = {r.doc_id: r.quality_score for r in cotrain.score(docs, labels).collect()}
    assert np.abs(np.array([got[r.doc_id] for r in rows]) - want).max() < 1e-3
    assert len(pseudo["text"][0]) + len(pseudo["meta"][0]) > 50


def test_pseudo_labels_help_and_every_row_counts(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1500)
    words = [" ".join(rng.choice(["fine", "calm", "prose"] if v else ["win", "cash", "now"], 12)) + " " + " ".join(rng.choice(["a", "b", "c", "d"], 30)) for v in y]
    source = [("good" if (v == 1) == (rng.random() < 0.95) else "bad") for v in y]
    docs = spark.createDataFrame([(k, words[k], source[k], "en", 99) for k in range(1500)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, int(y[k]), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality_score >= 0.5 for r in cotrain.score(docs, labels).collect()}
    assert np.mean([got[k] == bool(y[k]) for k in range(60, 1500)]) > 0.97


def test_repeated_labelled_ids_teach_once_at_any_size(spark):
    base = [(k, "good calm words here" if k % 2 else "$$$ ### !!", "s", "en", 5) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    for copies in (100, 1200):
        docs = spark.createDataFrame(base + [(7, "good calm words here", "s", "en", 5)] * copies, "doc_id long, text string, source string, lang string, n_chars long")
        made = cotrain.materialize(cotrain.features(docs), "test-features")
        seen = []
        plain, cotrain.cotrain = cotrain.cotrain, lambda text, meta, y, *rest: seen.append(len(y))
        try:
            cotrain.train(made, labels)
        finally:
            cotrain.cotrain = plain
        assert seen == [40]


def test_edges(spark):
    rows = [(k, ("good calm words here " * 3) if k % 2 else "$$$ ###", "s", "en", 5) for k in range(60)] + [(None, None, None, None, None), (1, "x" * 200000, None, "en", 7), (2, "", "s", None, 0)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, quality_score double")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (50, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.score(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.keep == bool(r.doc_id % 2) for r in got if r.doc_id is not None and 40 <= r.doc_id < 60)
    assert all(r.keep and r.quality_score is None for r in cotrain.score(docs, labels.limit(0)).collect())
    assert cotrain.score(docs.limit(0), labels).count() == 0
    assert "op3_quality" in queries.queries()


def test_few_labels_of_both_kinds_give_scores(spark):
    assert [x.tolist() for x in cotrain.dealt(np.array([1.0] * 7 + [0.0]))] == [[True] * 4 + [False] + [True] * 3, [False] * 4 + [True] + [False] * 2 + [True]]
    docs = spark.createDataFrame([(k, ("fine calm prose " if k % 2 else "win cash now ") * 9, "s", "en", 99) for k in range(40)], "doc_id long, text string, source string, lang string, n_chars long")
    for good, bad in ((4, 4), (1, 7), (7, 1), (1, 1), (2, 1)):
        marked = [(2 * k + 1, 1, 0) for k in range(good)] + [(2 * k, 0, 0) for k in range(bad)]
        got = cotrain.score(docs, spark.createDataFrame(marked, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 40 and all(0 <= r.quality_score <= 1 for r in got), (good, bad)
    one = spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    assert all(r.quality_score is None and r.keep for r in cotrain.score(docs, one).collect())
