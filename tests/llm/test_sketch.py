import hashlib

import xxhash

from quillon.llm import sketch

M = 2**64


def plain(text, k=5):
    """The set of all shingle hashes of a text, one shingle at a time in whole numbers."""
    w = text.lower().split()
    out = set()
    for i in range(max(1, len(w) - k + 1) if w else 0):
        h = 0
        for x in w[i : i + k]:
            h = (h ^ xxhash.xxh3_64_intdigest(x)) * 0x9E3779B97F4A7C15 % M
            h ^= h >> 29
        h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % M
        out.add((h ^ (h >> 32)) >> 16)
    return len(w) - k + 1, out


def print_of(text, fraction=1 / 4):
    n, every = plain(text)
    kept = sorted(h for h in every if n <= 64 or h < fraction * 2**48)
    return "01"[n > 64] + "".join(f"{h:012x}" for h in kept), {h for h in every if h < fraction * 2**48}, every, n


def likeness(a, b):
    x, y = [print_of(t) for t in (a, b)]
    p, q = (x[2], y[2]) if min(x[3], y[3]) <= 64 else (x[1], y[1])
    least = min(len(p), len(q))
    return len(p & q) / least if least else float(len(p) == len(q))


def test_edits_follow_the_next_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in sketch.fingerprint_edits(docs, rows_per_task=17).collect()}
    assert len(got) == len(rows)
    off = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == print_of(text)[0] and r.edited_fingerprint == print_of(changed)[0]
        assert r.near_next == likeness(text, following) and r.near_edited == likeness(text, changed)
        a, b = plain(text)[1], plain(changed)[1]
        off.append(abs(r.near_edited - len(a & b) / max(1, min(len(a), len(b)))))
    assert sum(off) / len(off) < 0.06  # some 75 retained hashes: a standard error of 0.06 at a half


def test_sketch_is_a_threshold_and_merges():
    s, everything = sketch.Sketcher(1 / 8, 5), sketch.Sketcher(1.0, 5)
    a, b = " ".join(f"w{k}" for k in range(4000)), " ".join(f"w{k}" for k in range(3996, 4400))
    assert abs(len(s(a).hashes) / len(everything(a).hashes) - 1 / 8) < 0.02
    merged, whole = s.merged(s(a), s(b)), s(a + " " + " ".join(b.split()[4:]))
    assert merged.level == whole.level and merged.hashes.tolist() == whole.hashes.tolist()
    half = " ".join(a.split()[:400])
    assert s.containment(s(half), s(a)) == 1.0
    assert sketch.written(s(a)) == sketch.written(s(a.upper()))


def test_short_texts_against_long_ones():
    """Twenty words from a long text are found in it, twenty others are not, and no sketch holds a hash over its threshold."""
    s = sketch.Sketcher(1 / 4, 5)
    text = " ".join(f"w{k}" for k in range(5000))
    long, right, wrong = s(text), 0, 0
    for k in range(0, 4980, 60):
        own, other = s(" ".join(text.split()[k : k + 20])), s(" ".join(f"x{k}-{j}" for j in range(20)))
        assert own.level == 0 and len(own.hashes) == 16
        right += s.containment(own, long) == 1.0
        wrong += s.containment(other, long) > 0
        merged = s.merged(own, long)
        assert merged.hashes.tolist() == long.hashes.tolist()
    assert right >= 79 and wrong == 0
    assert all(int(h) < sketch.threshold(1, 1 / 4) for h in long.hashes)


def test_contained_texts_are_found_from_five_words_on(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows, want = [], {}
    for n in (5, 8, 12, 20, 64, 68):
        for k in range(0, 320, 40):
            part = " ".join(text.split()[k : k + n - 1] + (["other"] if k % 80 else [text.split()[k + n - 1]]))
            want[len(rows)] = 1.0 if k % 80 == 0 else (n - 5) / (n - 4)
            rows += [(len(rows), part), (len(rows) + 1, text)]
    got = {r.doc_id: r for r in sketch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(abs(got[i].near_next - w) < 1e-9 for i, w in want.items())


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x y", 1, 2), (5, None, 1, 2), (5, "", 1, 2), (7, "é" * 9, 1, 2), (9, "a b c " * 30000, 1, 2)], "doc_id long, text string, range int, at int")
    got = sketch.fingerprint_edits(docs).orderBy("doc_id", "n_chars").collect()
    assert [(r.doc_id, r.n_chars) for r in got] == [(None, 3), (5, 0), (5, 0), (7, 9), (9, 180000)]
    assert got[1].near_next == 1.0 and got[1].fingerprint == "0"
    one = sketch.fingerprint_edits(docs.where("doc_id = 7")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(7, 1.0)]
    assert sketch.fingerprint_edits(docs.limit(0)).count() == 0
