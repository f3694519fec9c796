import random
import re

import numpy as np
import xxhash

from quillon.llm import simhash


def plain(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, most=4):
    up = list(range(len(fps)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= most:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def clustered(n, centres, seed):
    random.seed(seed)
    base, out = [random.getrandbits(64) for _ in range(centres)], set()
    while len(out) < n:
        x = random.choice(base)
        for _ in range(random.randint(0, 6)):
            x ^= 1 << random.randrange(64)
        out.add(x)
    return sorted(out)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain(t) for _, t in rows]
    label = classes(fps)
    want = {i: (f"{f:016x}", rows[k][0]) for (i, _), f, k in zip(rows, fps, label, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(docs).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(got)


def test_links_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 100)
    fps = clustered(900, 4, 1)
    refs = simhash.pivots()
    nodes = spark.createDataFrame([(k, bytearray(simhash.distances([f], refs)), f - (f >> 63 << 64)) for k, f in enumerate(fps)], "node long, far binary, f0 long")
    label = list(range(len(fps)))
    label = np.array(label)
    edges = simhash.links(nodes).collect()
    assert all((fps[e.src] ^ fps[e.dst]).bit_count() <= 64 for e in edges)
    simhash.merge(label, np.array([e.src for e in edges]), np.array([e.dst for e in edges]))
    assert label.tolist() == classes(fps)


def test_forest_of_a_group():
    for seed in range(8):
        f = np.array(clustered(250, 9, seed), np.uint64)
        zero, refs = np.zeros(len(f), np.int64), simhash.pivots()
        far = np.array([list(simhash.distances([int(x)], refs)) for x in f], np.uint8).T
        assert all(far[0][k] == (int(x) ^ int(refs[0][0])).bit_count() for k, x in enumerate(f))
        edges = simhash._forest(np.arange(len(f)), zero, zero, simhash.Table([f], far), 4)
        src, dst, bits = (c.to_numpy() for c in edges.columns)
        assert (src < dst).all() and bits.tolist() == [(int(f[a]) ^ int(f[b])).bit_count() for a, b in zip(src, dst, strict=True)]
        label = np.arange(len(f))
        simhash.merge(label, src, dst)
        assert label.tolist() == classes(f)


def wide(n, centres, flips, seed):
    """``n`` different values of 256 bits around some centres, with up to ``flips`` of their bits changed."""
    random.seed(seed)
    base, out = [random.getrandbits(256) for _ in range(centres)], set()
    while len(out) < n:
        x = random.choice(base)
        for b in random.sample(range(256), random.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def wide_nodes(spark, values):
    signed = lambda x, k: (w := x >> 64 * k & 2**64 - 1) - (w >> 63 << 64)
    refs = simhash.pivots()
    rows = [(i, bytearray(simhash.distances([x >> 64 * k & 2**64 - 1 for k in range(4)], refs)), *[signed(x, k) for k in range(4)]) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "node long, far binary, f0 long, f1 long, f2 long, f3 long")


def meets(x, y):
    """The numbers of the keys that two wide fingerprints share."""
    blocks = [[v >> 64 * w + 9 * k & 511 for w in range(4) for k in range(7)] for v in (x, y)]
    same = [a == b for a, b in zip(*blocks, strict=True)]
    return [28 * n + a for n, s in enumerate((1, 3, 9)) for a in range(28) if same[a] and same[(a + s) % 28]]


def test_wide_links_connect_what_shares_a_key(spark, monkeypatch):
    """Classes are those of all linked pairs with a common key, whole groups or cells of hot ones; each node has an edge to its
    nearest or to one within SURE bits; edges are few."""
    for cell, flips in ((8192, 40), (60, 40), (60, 12)):
        monkeypatch.setattr(simhash, "CELL", cell)
        values = wide(400, 3, flips, flips + cell)
        edges = [(e.src, e.dst, e.bits) for e in simhash.wide_links(wide_nodes(spark, values)).collect()]
        label, nearest = np.arange(len(values)), {}
        pairs = [(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 56 and meets(values[i], values[j])]
        simhash.merge(label, *np.array(pairs).T)
        for i, j in pairs:
            for k in (i, j):
                nearest[k] = min(nearest.get(k, 256), (values[i] ^ values[j]).bit_count())
        got, found = np.arange(len(values)), {}
        simhash.merge(got, *np.array([(a, b) for a, b, _ in edges]).T)
        assert got.tolist() == label.tolist()
        for a, b, bits in edges:
            assert a < b and bits == (values[a] ^ values[b]).bit_count() and meets(values[a], values[b])
            for k in (a, b):
                found[k] = min(found.get(k, 256), bits)
        assert all(found[k] <= max(simhash.SURE, bits) for k, bits in nearest.items())
        shared = sum(len(meets(values[a], values[b])) for a, b, _ in edges)
        assert cell < 8192 or len(edges) < 12 * len(values) < shared


def test_longer_keys_for_larger_tables(spark):
    from pyspark.sql import functions as F

    fps = clustered(400, 4, 3)
    df = spark.createDataFrame([(k, f - (f >> 63 << 64)) for k, f in enumerate(fps)], "node long, f0 long")
    for n, keys in ((1000, 15), (1 << 25, 35), (1 << 30, 70)):
        assert sum(simhash.widths(n)[0]) == 64
        found = {r.node: set(r.k) for r in df.select("node", simhash._keys(F.col("f0"), n).alias("k")).collect()}
        assert {len(k) for k in found.values()} == {keys}
        for i in range(0, 400, 7):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    assert found[i] & found[j]


def test_edges(spark):
    rows = [(4, None), (3, ""), (9, "one two"), (9, "one two"), (8, "ONE\ttwo"), (None, "one two"), (7, "w " * 60000), (6, "Ä b c d e")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, {"a": 1}) for i, t in rows], "doc_id long, text string, f0 int, kept_id int, Text_Key int, m map<string,int>")
    got = simhash.near_copies(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (4, 3), (6, 6), (7, 7), (8, 8), (9, 8), (9, 8)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.fingerprint for r in got if r.doc_id in (3, 4)} == {"0" * 16}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 6, 7, 8]
    unlike = docs.unionByName(spark.createDataFrame([(9, "quite another text than the other one here", 1, 2, 3, None), (9, "one two", 5, 2, 3, None)], docs.schema))
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_first(unlike).collect() if r.doc_id in (8, 9)) == [(8, "ONE\ttwo"), (9, "quite another text than the other one here")]
    assert simhash.near_copies(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def test_stage_finds_similar_documents(spark):
    random.seed(9)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, near, far = [], [], []
    for g in range(60):
        base = random.choices(vocabulary, k=random.choice([60, 300, 900]))
        copy, other = list(base), list(base)
        for k in random.sample(range(len(base)), max(1, len(base) // 80)):
            copy[k] = "edited"
        for k in random.sample(range(len(base)), len(base) // 8):
            other[k] = "changed"
        near.append((3 * g, 3 * g + 1))
        far.append(3 * g + 2)
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(copy)), (3 * g + 2, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)

    def shingles(i):
        w = text[i].split()
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}

    like = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    similar = [(a, b) for a, b in near if like(a, b) >= 0.85]
    assert len(similar) > 40 and all(like(k - 2, k) < 0.6 for k in far)
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert all(a in kept for a, _ in near) and all(k in kept for k in far)
    assert sum(b not in kept for _, b in similar) >= 0.97 * len(similar)


def sets_of(rows, k=5):
    out = {}
    for i, t in rows:
        w = t.lower().split()
        out[i] = frozenset(" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))
    return out


def test_recall_near_the_bound_and_no_false_removal(spark):
    """Pairs of a similarity of 0.80 to 0.85 are found, pairs just below stay."""
    random.seed(4)
    vocabulary = [f"v{k}" for k in range(9000)]
    rows = []
    for g in range(260):
        base = random.choices(vocabulary, k=random.choice([120, 240, 500]))
        copy = list(base)
        for k in random.sample(range(len(base)), round(len(base) * random.uniform(0.018, 0.032))):
            copy[k] = f"edit{k}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    sets = sets_of(rows)
    like = {g: len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(260)}
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [g for g, s in like.items() if 0.8 <= s <= 0.85]
    assert len(close) > 50 and sum(2 * g + 1 not in kept for g in close) >= 0.95 * len(close)
    assert all(2 * g + 1 in kept for g, s in like.items() if s < 0.8) and all(2 * g in kept for g in like)


def test_classes_equal_brute_force(spark):
    """Over whole documents the components are those of all pairs at least 0.8 alike, but for a few missed links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = sets_of([(r.doc_id, r.text or "") for r in docs.collect()])
    ids = sorted(sets)
    holds = {}
    for i in ids:
        for x in sets[i]:
            holds.setdefault(x, []).append(i)
    up = {i: i for i in ids}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    pairs = {(a, b) for own in holds.values() if len(own) < 200 for k, b in enumerate(own) for a in own[:k]}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    want = {i: top(i) for i in ids}
    got = {r.doc_id: r.component_id for r in simhash.alike_components(docs).collect()}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is linked that is not alike
    removed = [i for i in ids if want[i] != i]
    assert len(removed) > 30 and sum(got[i] == i for i in removed) <= 0.03 * len(removed)
