"""Small cases with answers worked by hand."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import callgraph as C
from quillon.operators import cluster as K
from quillon.operators import evaluate as V
from quillon.operators import graph as G
from quillon.operators import items as I


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("seconds", "want"), [
    ([0], [1]), ([0, 1], [1, 1]), ([0, 1, 2], [2, 2, 2]), ([0, 1, 3, 6, 10], [1, 0.666667, 0.666667, 0.6, 0.666667]), ([0, 0, 0, 0], [3, 3, 3, 2]),
    ([0, 100, 100, 100, 5000, 5060, 9000], [0.03, 0.04, 0.001, 0.001008, 0.000806, 0.000605, 0.033333]),
])
def test_time_frequency(spark, seconds, want):
    df = spark.createDataFrame([("u", k, s * 1_000_000) for k, s in enumerate(seconds)], "u string, k long, us long")
    got = I.with_time_frequency(df, "u", "us", "k").orderBy("k").collect()
    assert [round(r.time_freq, 6) for r in got] == want


def test_pair_code_and_ratio(spark):
    codes = {(0, 0): 0, (1, 1): 1, (2, 2): 2, (1, 2): 3, (2, 1): 3, (1, 0): 4, (0, 1): 4, (2, 0): 5, (0, 2): 5}
    for (a, b), c in codes.items():
        assert one(spark, S.pair_code(F.lit(a), F.lit(b))) == c
    for (a, b), c in {(1, 0): 1, (0, 0): 1, (-1, 2): 0, (3, 2): 1, (1, 4): 0.25}.items():
        assert one(spark, S.ratio(F.lit(float(a)), F.lit(float(b)))) == c


def test_chord_distance(spark):
    point = lambda *x: tuple(F.lit(float(v)) for v in x)
    for a, b, d in (((0, 0, 0), (0, 0, 1), 6108.840213), ((0, 0, 0), (0, 0, 0), 0), ((10, 30.25, 120.5), (12, 30.26, 120.5), 63.851064)):
        assert one(spark, S.chord_distance(point(*a), point(*b))) == pytest.approx(d, abs=1e-5)


def test_nearest_holiday(spark):
    cal = spark.sql("select date'2024-03-01' + int(id) as day, element_at(array(2,0,0,0,2), int(id) + 1) as flag from range(5)")
    cal = cal.withColumn("day", F.to_date("day"))
    assert [r.closest for r in I.nearest_holiday(cal).orderBy("day").collect()] == [0, 1, 2, 1, 0]
    assert [r.closest for r in I.nearest_holiday(cal.where("flag = 0")).collect()] == [None] * 3
    assert I.calendar(cal.limit(0)).count() == 0


def test_strings(spark):
    assert one(spark, S.strip_name(F.lit("ns::f<a<b>>(int(*)(x)) const"))) == "ns::f"
    assert one(spark, S.strip_name(F.lit("f" + "(" * 9 + ")" * 9 + "<" * 12 + ">" * 12))) == "f" and one(spark, S.strip_name(F.lit("a<b> x)y(")) ) == "a x)y("
    assert one(spark, S.squeezed(F.lit("map<a, b<c<d> > >"))) == "map<a,b<c<d>>>"
    assert one(spark, S.wrapped_words(F.lit("one two three four"), 9)) == "one two\nthree\nfour" and one(spark, S.wrapped_words(F.lit("toolongword a b"), 5)) == "toolongword\na b"
    assert [one(spark, S.glob(F.lit(x), "f[!a]*.?")) for x in ("fb.c", "fa.c", "fbb.cc", "xfb.c")] == [True, False, False, False]
    assert [tuple(one(spark, S.converted(F.lit(x)))) for x in ("12", "1.5", "x")] == [(12, None, None), (None, 1.5, None), (None, None, "x")]
    assert one(spark, S.rounded_key(F.lit(30.256), F.lit(-120.5))) == "(30.26, -120.50)"
    assert one(spark, S.address(F.lit("c"), F.lit(None).cast("string"), F.lit("d"), F.lit(None).cast("string"))) == "c,d,"
    assert one(spark, S.hue_colour(F.lit(0.0), (0.0, 0.0, 0.85), (0.0, 0.0, 0.0), 2.2)) == f"#{round(0.85 ** (1 / 2.2) * 255):02x}" * 1 + f"{round(0.85 ** (1 / 2.2) * 255):02x}" * 2
    assert one(spark, S.dot_escape(F.lit('a"b\\c\n'))) == '"a\\"b\\\\c\\n"'
    assert [one(spark, S.sniffed(F.lit(x))) for x in ("12", "-3", "1.5", "1e3", "x", "")] == ["int", "int", "float", "float", "str", "str"]
    assert one(spark, S.truncated(F.lit("x" * 5000))) == "x" * 4095 + "…"
    assert [one(spark, S.joined(F.array(*map(F.lit, v)))) for v in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a or b", "a, b or c"]
    assert one(spark, S.parse_exif_time(F.lit("2024:13:01 00:00:00"))) is None
    assert one(spark, S.hue_colour(F.lit(1.0))) == "#ff0000"


def test_ranks(spark):
    df = spark.createDataFrame([("a", 5, 4.0), ("b", 2, 1.0), ("c", 9, 2.0)], "k string, size int, mean double")
    got = {r.k: r for r in I.rank_fusion(df, {"size": (0.5, True), "mean": (0.5, False)}, "k").collect()}
    assert [got[k].rank_size for k in "abc"] == [1, 0, 2] and [got[k].rank_mean for k in "abc"] == [0, 2, 1]
    many = spark.range(1000).select("id", F.expr("id * 7919 % 1000").alias("v"))
    assert I.ordinal(many.repartition(5), [F.asc("v")], "n").where("n <> v").count() == 0


def test_pairwise_metrics_and_brute_force(spark):
    truth, found = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 2]
    df = spark.createDataFrame(list(zip(truth, found, strict=True)), "t int, p int")
    r = V.pairwise_metrics(df, "t", "p").first()
    assert [round(x, 6) for x in r] == [0.733333, 0.5, 0.5, 0.659091]
    rng = np.random.default_rng(4)
    t, p = rng.integers(0, 4, 40).tolist(), rng.integers(0, 5, 40).tolist()
    pairs = [(t[i] == t[j], p[i] == p[j]) for i, j in itertools.combinations(range(40), 2)]
    r = V.pairwise_metrics(spark.createDataFrame(list(zip(t, p, strict=True)), "t int, p int"), "t", "p").first()
    tp = sum(a and b for a, b in pairs)
    assert r.accuracy == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
    assert r.precision == pytest.approx(tp / sum(b for _, b in pairs)) and r.recall == pytest.approx(tp / sum(a for a, _ in pairs))


def test_greedy_match(spark):
    def match(alg, gt):
        rows = [(a, g) for x in set().union(*alg) for a, s in enumerate(alg) if x in s for g, u in enumerate(gt) if x in u]
        cells = V.containment(spark.createDataFrame(rows, "a int, g int"), "a", "g")
        cells = cells.withColumn("sim", F.col("both") / (F.element_at(F.array(*[F.lit(len(u)) for u in gt]), F.col("g") + 1) + V.TINY))
        return {r.a: r.g for r in V.greedy_match(cells, "a", "g").collect()}

    assert match([{"a", "b"}, {"c"}], [{"a", "b", "c"}, {"c"}]) == {0: 0, 1: 1}
    assert match([{"a", "b", "c"}, {"d"}], [{"a"}, {"b"}, {"x", "d"}])[0] == 1
    # two cells above 0 for three clusters: the third turn falls to the first cell of what is all zeros by then
    assert match([{"a"}, {"b", "c"}, {"d"}], [{"a"}, {"b", "c", "d"}]) == {0: 0, 1: 1, 2: 1}
    few = spark.createDataFrame([(0, 5, 0.0), (1, 5, 0.7), (1, 6, 0.0), (2, 5, 0.0)], "a int, g int, sim double")
    assert {r.a: r.g for r in V.greedy_match(few, "a", "g").collect()} == {0: 5, 1: 5, 2: None}


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (4, 4), (None, 9)], "src long, dst long")
    got = {r.node: r.component for r in G.connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert [r.component for r in G.connected_components(path).select("component").distinct().collect()] == [0]
    assert G.connected_components(df.limit(0)).count() == 0


def test_reach_and_strong_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "f")], "src string, dst string")
    got = {r.node: r.scc for r in G.strong_components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    start = spark.createDataFrame([("b",)], "node string")
    assert {r.node: r.depth for r in G.reach(edges, start).collect()} == {"b": 0, "c": 1, "a": 2, "d": 2, "e": 3, "f": 4}
    assert {r.node for r in G.reach(edges, start, depth=1).collect()} == {"b", "c"}


def test_call_graph(spark):
    stacks = spark.createDataFrame([(["b", "a", "main"], 3.0), (["b", "main"], 1.0), (["a", "main"], 2.0), (["main"], 4.0)], "stack array<string>, cost double")
    nodes, edges = C.stack_nodes(stacks), C.stack_edges(stacks)
    assert {r.name: r.ratio for r in C.self_ratios(nodes).collect()} == {"b": 0.4, "a": 0.2, "main": 0.4}
    total = {r.name: r.total for r in C.propagate(nodes, edges).collect()}
    assert total == pytest.approx({"b": 0.4, "a": 0.5, "main": 1.0})
    calls = {(r.src, r.dst): (r.weight, r.ratio) for r in C.call_ratios(edges).collect()}
    assert calls == {("a", "b"): (3.0, 0.75), ("main", "b"): (1.0, 0.25), ("main", "a"): (5.0, 1.0)}
    kept, left = C.prune(spark.createDataFrame(list(total.items()), "name string, total double"), edges.withColumn("weight", F.lit(None).cast("double")), 0.45, 0.0)
    assert {r.name for r in kept.collect()} == {"a", "main"} and [(r.src, r.dst, r.weight) for r in left.collect()] == [("main", "a", 0.5)]
    assert {(r.name, r.self) for r in C.completed(nodes.where("name <> 'b'"), edges).collect()} == {("a", 2.0), ("main", 4.0), ("b", 0.0)}
    assert {r.name: r.samples for r in C.presence(stacks).collect()} == {"b": 2, "a": 2, "main": 4}


def dealt_out(nodes, edges):
    """Totals by walking calls one after another: cycles as a whole, then from each entry outwards."""
    reach = {n: {n} for n in nodes}
    while True:
        more = {a: reach[a].union(*[reach[b] for x, b in edges if x == a]) for a in nodes}
        if more == reach:
            break
        reach = more
    part = {a: frozenset(b for b in reach[a] if a in reach[b]) for a in nodes}
    whole = sum(nodes.values())
    own = {n: v / whole for n, v in nodes.items()}
    into = lambda dst: sum(w for (a, b), w in edges.items() if b == dst and a != b)
    outside = lambda p: sum(w for (a, b), w in edges.items() if b in p and a not in p)
    ratio = {(a, b): w / (outside(part[b]) if len(part[b]) > 1 and a not in part[b] else into(b)) for (a, b), w in edges.items() if a != b}
    memo = {}

    def total(p):
        if p not in memo:
            memo[p] = sum(own[m] for m in p) + sum(r * total(part[b]) for (a, b), r in ratio.items() if a in p and b not in p)
        return memo[p]

    out = {n: total(part[n]) if len(part[n]) == 1 else 0.0 for n in nodes}
    checks = []
    for p in {q for q in part.values() if len(q) > 1}:
        for entry in p:
            r_in = sum(r for (a, b), r in ratio.items() if b == entry and a not in p)
            if not r_in:
                continue
            rank, todo = {entry: 0}, [entry]
            for a in todo:
                for (x, b) in ratio:
                    if x == a and b in p and b not in rank:
                        rank[b] = rank[a] + 1
                        todo.append(b)
            away = {e: r for e, r in ratio.items() if e[0] in p and e[1] in p and rank[e[1]] > rank[e[0]]}
            partial = {}
            for m in sorted(p, key=lambda m: -rank[m]):
                partial[m] = r_in * (own[m] + sum(r * total(part[b]) for (a, b), r in ratio.items() if a == m and b not in p))
                partial[m] += sum(r / sum(q for (_, c), q in away.items() if c == b) * partial[b] for (a, b), r in away.items() if a == m)
                out[m] += partial[m]
            checks.append((partial[entry], max(partial.values()), r_in * total(p)))
    return out, checks


def test_totals_within_cycles_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    nodes, edges = {}, {}
    for g in range(8):  # graphs side by side, of random calls among six nodes
        names = [f"{g}{c}" for c in "abcdef"]
        nodes |= {n: float(rng.integers(0, 9)) for n in names}
        for a, b in itertools.product(names, names):
            if rng.random() < 0.3:
                edges[a, b] = float(rng.integers(1, 9))
    want, checks = dealt_out(nodes, edges)
    got = C.propagate(spark.createDataFrame(list(nodes.items()), "name string, self double"), spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double"))
    assert {r.name: round(r.total, 9) for r in got.collect()} == {n: round(v, 9) for n, v in want.items()}
    assert checks and all(abs(a - m) < 1e-9 and abs(a - t) < 1e-9 for a, m, t in checks)  # an entry has the cycle's total by its ratio


def test_graph_document(spark):
    nodes = spark.createDataFrame([("main", 1.0, 0.4), ('f<a, b>("x")', 0.6, 0.6)], "name string, total double, self double")
    edges = spark.createDataFrame([("main", 'f<a, b>("x")', 1.0)], "src string, dst string, ratio double")
    lines = [r.line for r in C.dot_document(nodes, edges).orderBy("at").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and len(lines) == 8 and "Arial" in lines[1]
    assert lines[4].startswith('\t"f<a, b>(\\"x\\")" [color="#') and lines[5].startswith('\t"main" [color="#ff0000"')
    assert 'label="main\\n100.00%\\n(40.00%)"' in lines[5] and '"main" -> "f<a' in lines[6] and 'penwidth="2.40"' in lines[6] and 'label="60.00%"' in lines[6]
    for theme in C.THEMES:
        some = [r.line for r in C.dot_document(nodes, edges, theme, strip=True, wrap=True).orderBy("at").collect()]
        assert len(some) == 8 and 'label="f\\n60.00%' in some[4]
    assert 'style="solid"' in [r.line for r in C.dot_document(nodes, edges, "print").orderBy("at").collect()][2]


def test_parents_have_the_mean_of_their_scenes(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 4.0), ("q", 2.0)], "event string, total_rank double")
    assert {r.event: r.total_rank for r in I.parent_rank(df, "event").collect()} == {"p": 2.5, "q": 2.0}
    assert all(sum(w) == pytest.approx(1.0) for w in I.PRESETS.values())


def test_density_on_a_line(spark):
    seconds = [0, 1, 2, 3, 50, 100, 101, 102, 103, 107, 300]
    df = spark.createDataFrame([("u", k, s * 1_000_000) for k, s in enumerate(seconds)], "u string, k long, us long")
    got = {r.k: r.c for r in K.density_1d(df, "u", "us", "k", 4, 3, "c").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: None, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: None}
    isl = {r.k: r.cluster_id for r in K.islands(df, "u", "us", "k", 10).collect()}
    assert isl == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 10}


def test_recursive_split_on_a_line(spark):
    """Three bursts, one of them two close ones, fall apart level by level; twins in time cannot; sizes hold elsewhere."""
    seconds = [*range(0, 12), *range(100, 112), *range(1000, 1006), *[2000] * 15, 5000]
    df = spark.createDataFrame([("u", k, s * 1_000_000, 0) for k, s in enumerate(seconds)] + [("v", 900 + k, k, 0) for k in range(3)], "u string, k long, us long, size int")
    got = {r.k: (r.scene_id, r.status) for r in K.split_1d(df, "u", "us", "k", 128, 3, 5, 13).collect()}
    assert len(got) == len(seconds) + 3 and [got[900 + k] for k in range(3)] == [(900, "unchosen")] * 3
    assert {got[k] for k in range(12)} == {(0, "chosen")} and {got[k] for k in range(12, 24)} == {(12, "chosen")}
    assert {got[k] for k in range(24, 30)} == {(24, "chosen")} and {got[k] for k in range(30, 45)} == {(30, "chosen")}
    assert got[45] == (None, "noise")
    assert K.split_1d(df.limit(0), "u", "us", "k", 128, 3, 5, 13).count() == 0


def test_band_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(u), k, int(t)) for k, (u, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(-10**9, 10**9, 200), strict=True))] + [(None, 900, 5), (1, 901, None)]
    df = spark.createDataFrame(rows, "u long, k long, us long")
    for strict in (False, True):
        got = {(r[0], r[1]) for r in I.band_join(df, "u", "k", "us", 60, strict).select("l.k", "r.k").collect()}
        want = {(a[1], b[1]) for a in rows for b in rows if None not in (*a, *b) and a[0] == b[0] and abs(a[2] - b[2]) <= 60e6 and (a[1] < b[1] or a[1] == b[1] and not strict)}
        assert got == want


def test_nearest_ancestor(spark):
    t = spark.createDataFrame([(1, None, True), (2, 1, False), (3, 2, False), (4, 3, True), (5, 4, True), (6, None, False), (7, 6, True)], "node long, parent long, live boolean")
    assert {r.node: r.ancestor for r in G.nearest_ancestor(t).collect()} == {1: None, 2: 1, 3: 1, 4: 1, 5: 4, 6: None, 7: None}
