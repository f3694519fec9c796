"""Density clusters by reachability, at every threshold at once, for groups of any size.

A threshold is a whole number of hundredths below 1, its level. A point is a core from the level on at which ``least`` points,
itself included, lie within the threshold; cores within the threshold of each other are one cluster; a point that is no core
but has one within the threshold joins the nearest core of the lowest level at which it has any; the rest is noise. All cuts
follow from three tables: the level of each core, the level and core at which each point is placed, and which levels join
cores. No cut is made per threshold, and none depends on an order of the points.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import connected_components, spanning_forest
from quillon.operators.items import ordinal, standardized
from quillon.session import materialize

#: Thresholds are 0, 1 / STEPS, 2 / STEPS, ... below 1.
STEPS = 100
#: Sets of more points are dealt over tasks of their own.
LONG = 2000


def levels(x: np.ndarray) -> np.ndarray:
    """The least k with x <= k / STEPS; STEPS where that is 1 or more."""
    k = np.ceil(np.minimum(x, 2) * STEPS)
    k -= (k - 1) / STEPS >= x
    k += k / STEPS < x
    return np.clip(k, 0, STEPS).astype(np.int16)


def level_of(x: Column) -> Column:
    """``levels`` of a column; null is beyond all thresholds."""
    k = F.ceil(F.least(x, F.lit(2.0)) * STEPS).cast("int")
    k = k - ((k - 1) / float(STEPS) >= x).cast("int") + (k / float(STEPS) < x).cast("int")
    return F.coalesce(F.least(k, F.lit(STEPS)), F.lit(STEPS))


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros((len(p), len(q)))
    for c in range(p.shape[1]):
        total += np.square(p[:, c, None] - q[None, :, c])
    return np.sqrt(total)


def forest(m: np.ndarray) -> np.ndarray:
    """(a, b, level) of a minimum spanning forest of the symmetric matrix of levels; levels of STEPS and more are no edges."""
    n = len(m)
    m, best, parent, out = m.copy(), np.full(n, STEPS), np.full(n, -1), []
    for _ in range(n):
        at = int(best.argmin())
        if best[at] < STEPS:
            out.append((parent[at], at, best[at]))
        m[:, at] = best[at] = STEPS + 1  # taken: never the least, never closer
        row = m[at]
        closer = (row < best).nonzero()[0]
        if len(closer):
            best[closer], parent[closer] = row[closer], at
    return np.array(out, np.int64).reshape(-1, 3)


def nearest_cores(d: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, distance, column): for each row the lowest level at which a column's core is within reach, and the nearest such
    column; ties by column. ``d`` is infinite where a row is its column."""
    at = np.where(np.isfinite(d), np.maximum(levels(d), core[None, :]), STEPS)
    least = at.min(axis=1)
    col = np.argmin(np.where(at == least[:, None], d, np.inf), axis=1)
    return least, d[np.arange(len(d)), col], col


def choose(n: int, cores: np.ndarray, placed: np.ndarray, joins: np.ndarray) -> int | None:
    """The level with the fewest noise points among those with more than one label (noise is one) and some point placed, the
    lowest of equals. cores and placed count points by their level; joins are the joined pairs of clusters at each level."""
    noise = n - np.cumsum(placed)
    labels = np.cumsum(cores) - joins + (noise > 0)
    fits = (labels > 1) & (noise < n)
    return int(np.argmin(np.where(fits, noise, n + 1))) if fits.any() else None


def best_labels(points: np.ndarray, least: int) -> np.ndarray:
    """The clusters of a small set at its best level, as the index of a core of each; -1 is noise."""
    n = len(points)
    d = distances(points, points)
    core = levels(np.partition(d, least - 1, axis=1)[:, least - 1]) if n >= least else np.full(n, STEPS)
    joins = forest(np.maximum(np.maximum(levels(d), core[:, None]), core[None, :]))
    np.fill_diagonal(d, np.inf)
    reach, _, at = nearest_cores(d, core) if n > 1 else (np.full(n, STEPS), None, np.zeros(n, int))
    count = lambda x: np.bincount(x[x < STEPS], minlength=STEPS)
    k = choose(n, count(core), count(np.minimum(core, reach)), np.cumsum(count(joins[:, 2])))
    if k is None:
        return np.full(n, -1)
    root = np.arange(n)
    for a, b, _ in joins[joins[:, 2] <= k]:
        a, b = root[a], root[b]
        root[root == max(a, b)] = min(a, b)
    return np.where(core <= k, root, np.where(reach <= k, root[at], -1))


class _Cuts:
    """``best_labels`` of sets that are cut again and again out of ``points``, in work that follows what changes between cuts.

    A point keeps the list of its ``WIDTH`` nearest and the distance within which all others of its set are listed. Later cuts
    have other deviations, which stretch distances by a bounded factor, and fewer points: a list tells the ``least``-th
    nearest as long as that is nearer than what is not listed can be, else it is made anew. Points whose ``least``-th nearest
    is too near to matter for the choice of a level are left as they are. What decides is the distance ``best_labels`` has.
    """

    WIDTH = 32
    #: Nearest listed cores that are joined first; what is apart then is compared with all cores.
    FIRST = 6
    #: Distances made at once.
    ROOM = 2_000_000

    def __init__(self, points: np.ndarray, least: int) -> None:
        n, d = points.shape
        self.points, self.least, self.width = points, least, max(self.WIDTH, 3 * least)
        self.near, self.within, self.near_scale = np.zeros((n, self.width), np.int32), np.full(n, -1.0), np.ones((n, d))
        self.far, self.far_scale, self.alive = np.full(n, np.inf), np.ones((n, d)), np.full(n, -1)
        self.z, self.core = np.zeros((n, d)), np.zeros(n, np.int16)
        self.now, self.cut_of, self.known = 0, np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _gaps(self, rows: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """Distances of ``rows`` to the points in their rows of ``listed``; infinite to those of other sets."""
        total = np.zeros(listed.shape)
        for c in range(self.z.shape[1]):
            z = self.z[:, c]
            total += np.square(z[rows][:, None] - z[listed])
        return np.where(self.cut_of[listed] == self.now, np.sqrt(total), np.inf)

    def _listed(self, rows: np.ndarray) -> np.ndarray:
        """The distances of the ``least``-th nearest of ``rows``, which get new lists, by distance, each point first in its own."""
        far = np.empty(len(rows))
        each = max(1, self.ROOM // len(self.own))
        for a in range(0, len(rows), each):
            some = rows[a : a + each]
            d = distances(self.z[some], self.z[self.own])
            d[np.arange(len(some)), np.searchsorted(self.own, some)] = -1
            at = np.argpartition(d, self.width - 1, axis=1)[:, : self.width]
            gap = np.take_along_axis(d, at, axis=1)
            order = np.argsort(gap, axis=1, kind="stable")
            gap = np.maximum(np.take_along_axis(gap, order, axis=1), 0)
            self.near[some] = self.own[np.take_along_axis(at, order, axis=1)]
            self.within[some], self.near_scale[some], far[a : a + each] = gap[:, -1], self.scale, gap[:, self.least - 1]
        return far

    def _look(self, rows: np.ndarray) -> None:
        """Makes the levels of ``rows`` as cores known for this cut."""
        for a in range(0, len(rows), self.ROOM // self.width):
            some = rows[a : a + self.ROOM // self.width]
            far = np.partition(self._gaps(some, self.near[some]), self.least - 1, axis=1)[:, self.least - 1]
            within = self.within[some] * (self.near_scale[some] / self.scale).min(axis=1) * (1 - 1e-9) - 1e-8
            new = np.minimum(far, 1) > within
            if new.any():
                far[new] = self._listed(some[new])
            self.far[some], self.far_scale[some], self.core[some], self.known[some] = far, self.scale, levels(far), self.now
            self.alive[some] = (self.cut_of[self.near[some]] == self.now).sum(axis=1)

    def _placed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level, core) by which ``rows`` are reached, if below their own levels: such cores are among their nearest."""
        listed = self.near[rows]
        other = np.unique(listed)
        other = other[(self.cut_of[other] == self.now) & (self.known[other] != self.now)]
        self._look(other)
        d = self._gaps(rows, listed)
        d[listed == rows[:, None]] = np.inf
        at = np.where(np.isfinite(d), np.maximum(levels(d), self.core[listed]), STEPS)
        level = at.min(axis=1)
        d[at != level[:, None]] = np.inf
        nearest = np.where(d == d.min(axis=1)[:, None], listed, len(self.points)).min(axis=1)
        return level, nearest

    def _joined(self, cores: np.ndarray, k: int) -> np.ndarray:
        """The smallest core of the cluster of each of ``cores`` at level ``k``."""
        n = len(cores)
        place = np.full(len(self.points), -1)
        place[cores] = np.arange(n)
        root = np.arange(n)

        def join(u: np.ndarray, v: np.ndarray) -> None:
            while len(u):
                a, b = root[u], root[v]
                apart = a != b
                u, v, a, b = u[apart], v[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (up := root[root])[root != up].size:
                    root[:] = up

        def near(rows: np.ndarray, first: int, last: int) -> None:
            listed = self.near[cores[rows], first:last]
            hit = (place[listed] >= 0) & (levels(self._gaps(cores[rows], listed)) <= k)
            u, v = hit.nonzero()
            join(rows[u], place[listed[u, v]])

        near(np.arange(n), 1, 1 + self.FIRST)
        rest = np.flatnonzero(root != np.bincount(root).argmax())
        near(rest, 1 + self.FIRST, self.width)
        rest = np.flatnonzero(root != np.bincount(root).argmax())
        for a in range(0, len(rest), max(1, self.ROOM // n)):
            some = rest[a : a + max(1, self.ROOM // n)]
            u, v = (levels(distances(self.z[cores[some]], self.z[cores])) <= k).nonzero()
            join(some[u], v)
        return cores[root]

    def labels(self, own: np.ndarray) -> np.ndarray:
        """``best_labels`` of the points ``own``, ascending, more than ``width``; clusters are named by points of the whole."""
        p = self.points[own]
        self.own, self.now, self.scale = own, self.now + 1, p.std(axis=0) + 1e-15
        self.z[own], self.cut_of[own] = standard(p), self.now
        bound = levels(self.far[own] * (self.far_scale[own] / self.scale).max(axis=1) * (1 + 1e-9) + 1e-8)
        stale = (self.cut_of[self.near[own]] == self.now).sum(axis=1) != self.alive[own]
        self._look(own[stale])
        bound[stale] = self.core[own[stale]]
        for low in (*np.quantile(bound, [0.98, 0.9, 0.5], method="lower").astype(int).tolist(), -1):
            self._look(own[(bound > low) & (self.known[own] != self.now)])
            seen = own[self.known[own] == self.now]
            seen = seen[self.core[seen] > low]
            level, via = self._placed(seen)
            placed = np.minimum(level, self.core[seen])  # that of all others is ``low`` or less
            top = np.unique(placed)[::-1]
            cut = None
            if len(top) and top[0] < STEPS and top[0] > low and (low >= 0 or len(top)):
                cut = self._cut(own, int(top[0]), seen, level, via)
                if len(np.unique(cut[cut >= 0])) > 1:
                    return cut
            below = top[1:] if len(top) else top
            if len(below) and below[0] > low:
                return self._cut(own, int(below[0]), seen, level, via)
        return np.full(len(own), -1)

    def _cut(self, own: np.ndarray, k: int, seen: np.ndarray, level: np.ndarray, via: np.ndarray) -> np.ndarray:
        held = np.ones(len(own), bool)
        at = np.searchsorted(own, seen)
        held[at] = self.core[seen] <= k
        label = np.full(len(self.points), -1)
        cores = own[held]
        label[cores] = self._joined(cores, k)
        rim = ~held[at] & (level <= k)
        label[seen[rim]] = label[via[rim]]
        return label[own]


def standard(p: np.ndarray) -> np.ndarray:
    """The standardised points, to nine digits."""
    return np.round((p - p.mean(axis=0)) / (p.std(axis=0) + 1e-15), 9)


def split(points: np.ndarray, least: int, most: int, plain: int = 400) -> list[tuple[np.ndarray, str]]:
    """(indices, status) that partition a set: a set of at most ``most`` is chosen, or unchosen below ``least``; a larger one is
    standardised and cut at its best level, its noise set aside, and its clusters are split in turn. Sets of up to ``plain``
    points are cut from all their distances, larger ones from lists of the nearest, with the same result."""
    out, todo, cuts = [], [np.arange(len(points))], None
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append((own, "chosen" if len(own) >= least else "unchosen"))
            continue
        if len(own) > max(plain, 4 * _Cuts.WIDTH, 4 * least):
            cuts = cuts or _Cuts(points, least)
            label = cuts.labels(own)
        else:
            label = best_labels(standard(points[own]), least)
        if (label < 0).any():
            out.append((own[label < 0], "noise"))
        todo += [own[label == k] for k in np.unique(label[label >= 0])]
    return out


def _best_levels(counts: DataFrame, key: str) -> DataFrame:
    """(key, best) from (key, kind, level, n): ``choose`` on a few hundred rows of each key. Kinds: all, core, placed, and either edge
    (of a forest, counts from its level on) or join (at its level only)."""
    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        of = {kind: np.bincount(g["level"], g["n"], STEPS + 1)[:STEPS].astype(np.int64) for kind, g in pdf.groupby("kind")}
        none = np.zeros(STEPS, np.int64)
        joins = np.cumsum(of.get("edge", none)) + of.get("join", none)
        return pd.DataFrame({key: [k[0]], "best": pd.array([choose(int(of["all"].sum()), of.get("core", none), of.get("placed", none), joins)], "Int32")})

    return counts.groupBy(key).applyInPandas(run, f"{key} {counts.schema[key].dataType.simpleString()}, best int")


def _counts(points: DataFrame, key: str) -> DataFrame:
    """(key, kind, level, n) of points (key, core, reach)."""
    kinds = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit(0).alias("level")), F.struct(F.lit("core").alias("kind"), F.col("core").alias("level")),
        F.struct(F.lit("placed").alias("kind"), F.least("core", "reach").alias("level")),
    )
    return points.select(key, F.explode(kinds).alias("k")).groupBy(key, "k.kind", "k.level").agg(F.count("*").alias("n"))


def _asked(pdf: pd.DataFrame, boxes: pd.DataFrame, columns: list[str], radius: np.ndarray, may: np.ndarray | None = None) -> pd.DataFrame:
    """A row of ``pdf`` for each of the boxes (``other``) that come within the point's radius, as ``block``; with ``may`` only those allowed."""
    x, gap = pdf[columns].to_numpy(), np.zeros((len(pdf), len(boxes)))
    for c, name in enumerate(columns):
        lo, hi = boxes[f"lo_{name}"].to_numpy(), boxes[f"hi_{name}"].to_numpy()
        gap += np.square(np.maximum(0, np.maximum(lo - x[:, c, None], x[:, c, None] - hi)))
    near = np.sqrt(gap) <= radius[:, None] + 1e-9
    p, b = (near if may is None else near & may).nonzero()
    return pdf.iloc[p].assign(block=boxes["other"].to_numpy()[b])


def _some(asked: pd.DataFrame, n: int) -> list[pd.DataFrame]:
    """``asked`` in parts, each of at most some million distances to ``n`` points."""
    each = max(1, _Cuts.ROOM // max(1, n))
    return [asked.iloc[k : k + each] for k in range(0, len(asked), each)] if n else []


def _own_names(items: DataFrame, key: str, item: str, columns: list[str], run) -> DataFrame:
    """``run`` on the columns it needs under names of its own, and its result under the caller's."""
    x = [f"_x{k}" for k in range(len(columns))]
    found = run(items.select(F.col(key).alias("_key"), F.col(item).alias("_item"), *[F.col(c).alias(n) for c, n in zip(columns, x, strict=True)]), "_key", "_item", x)
    return found.select(F.col("_key").alias(key), F.col("_item").alias(item), "cluster")


def space_labels(items: DataFrame, key: str, item: str, columns: list[str], least: int, block: int = 512) -> DataFrame:
    """(key, item, cluster) at each key's best level; cluster is one of its cores, null for noise.

    Points are put in the order of interleaved bits of their coordinates and cut into blocks of ``block``. What a point must know of
    another block it asks there, and only of blocks whose box lies near enough: first for the nearest ``least``, which are within
    the distance at which its own block has as many; then, for the spanning forest, for edges out of its cluster that would
    be lighter than the lightest known (see ``_space_forest``). Distances stay in the task. ``item`` is a key of the rows.
    """
    return _own_names(items, key, item, columns, lambda *own: _space_labels(*own, least, block))


def _space_labels(items: DataFrame, key: str, item: str, columns: list[str], least: int, block: int) -> DataFrame:
    bits = min(10, 62 // len(columns))
    cells = [F.least(F.greatest(F.floor((F.col(c) + 8) * (1 << bits) / 16), F.lit(0)), F.lit((1 << bits) - 1)).cast("long") for c in columns]
    code = reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(q, b).bitwiseAND(1), b * len(cells) + c) for c, q in enumerate(cells) for b in range(bits)])
    placed = ordinal(items.select(key, item, *columns).withColumn("_code", code), [F.asc(key), F.asc("_code"), F.asc(item)], "_at").drop("_code")
    begin = placed.groupBy(key).agg(F.min("_at").alias("_begin"))
    points = materialize(placed.join(begin, key).withColumn("block", F.floor((F.col("_at") - F.col("_begin")) / block)).drop("_at", "_begin"), "blocks")
    boxes = points.groupBy(key, "block").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    parts = max(1, min(400, boxes.count()))  # few bytes, but work each: dealt by their number
    dealt = lambda df: df.repartition(parts, key, "block").groupBy(key, "block")
    l, r = boxes.select(key, *[F.col(c).alias(f"l_{c}") for c in boxes.columns if c != key]), boxes.withColumnRenamed("block", "other")
    gaps = [F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(f"l_hi_{c}"), F.col(f"l_lo_{c}") - F.col(f"hi_{c}")) for c in columns]
    near = l.join(r, key).where(reduce(lambda a, b: a + b, [g * g for g in gaps]) < 1)
    near = materialize(near.select(key, F.col("l_block").alias("block"), *[c for c in r.columns if c != key]), "near-boxes")
    kind, key_kind = (items.schema[c].dataType.simpleString() for c in (item, key))
    at = f"{key} {key_kind}, block long, {item} {kind}, " + ", ".join(f"{c} double" for c in columns)

    def first(pdf: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        x = pdf[columns].to_numpy()
        d = distances(x, x)
        far = np.minimum(np.partition(d, least - 1, axis=1)[:, least - 1], 1) if len(x) >= least else np.ones(len(x))
        return _asked(pdf.assign(far=far), boxes, columns, far)[[key, "block", item, *columns, "far"]]

    def nearest(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, k = pdf[columns].to_numpy(), pdf[item].to_numpy(), min(least, len(pdf))
        out = [pd.DataFrame({"a": ids[:0], "b": ids[:0], "d": np.zeros(0)})]
        for some in _some(asked, len(x)):
            d = distances(some[columns].to_numpy(), x)
            few = np.argpartition(d, k - 1, axis=1)[:, :k]
            gap = np.take_along_axis(d, few, axis=1)
            p, q = ((gap <= some["far"].to_numpy()[:, None] + 1e-9) & (gap < 1)).nonzero()
            out.append(pd.DataFrame({"a": some[item].to_numpy()[p], "b": ids[few[p, q]], "d": gap[p, q]}))
        return pd.concat(out)

    asked = materialize(dealt(points).cogroup(dealt(near)).applyInPandas(first, f"{at}, far double"), "asked")
    found = dealt(asked).cogroup(dealt(points)).applyInPandas(nearest, f"a {kind}, b {kind}, d double")
    lists = materialize(found.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "b"))), 1, least).alias("near")), "nearest")
    cores = lists.select(F.col("a").alias(item), level_of(F.get("near.d", F.lit(least - 1))).alias("core"))
    points = materialize(points.join(cores, item), "cores")
    core_of = lambda c: points.select(F.col(item).alias(c), F.col("core").alias(f"core_{c}"))
    links = lists.select("a", F.explode("near").alias("n")).select("a", "n.b", "n.d").where("a <> b").join(core_of("a"), "a").join(core_of("b"), "b")
    links = materialize(links.withColumn("level", F.greatest(level_of(F.col("d")), "core_b")).where(F.col("level") < STEPS), "links")
    listed = links.select("a", "b", F.greatest("level", "core_a").alias("w")).where(F.col("w") < STEPS)
    edges = _space_forest(points.where(F.col("core") < STEPS), near, listed, key, item, columns, dealt, at)
    # a core that reaches a point at a level below the point's own is among its nearest
    reach = links.groupBy(F.col("a").alias(item)).agg(F.min(F.struct("level", "d", "b")).alias("r")).select(item, F.col("r.level").alias("reach"), F.col("r.b").alias("via"))
    points = materialize(points.select(key, item, "core").join(reach, item, "left").withColumn("reach", F.coalesce("reach", F.lit(STEPS))), "reach")
    joined = edges.join(points.select(key, F.col(item).alias("a")), "a")
    counts = _counts(points, key).unionByName(joined.groupBy(key, F.lit("edge").alias("kind"), F.col("w").alias("level")).agg(F.count("*").alias("n")))
    best = materialize(_best_levels(counts, key), "best-levels").where("best is not null")
    known = points.join(best, key, "left")
    cores = known.where("core <= best").select(F.col(item).alias("a"), F.col(item).alias("b"))
    label = connected_components(joined.join(best, key).where("w <= best").select("a", "b").unionByName(cores), "a", "b", at_once=500_000)
    at = F.when(F.col("core") <= F.col("best"), F.col(item)).when(F.col("reach") <= F.col("best"), F.col("via"))
    return known.select(key, item, at.alias("node")).join(label.withColumnRenamed("component", "cluster"), "node", "left").select(key, item, "cluster")


def _space_forest(points: DataFrame, near: DataFrame, listed: DataFrame, key: str, item: str, columns: list[str], dealt, at: str, max_rounds: int = 60) -> DataFrame:
    """(a, b, w): a minimum spanning forest of the cores ``points`` (key, item, block, columns, core), an edge's weight being the level of
    its length or of an end, the highest.

    Rounds after Borůvka: each cluster takes a lightest edge out of it. ``listed`` has the edges to the nearest of each point; any
    other is as heavy as the core levels of its ends, so a point whose level is below the weight of its cluster's lightest
    listed edge asks the blocks within that for a lighter one, and no other point asks. The largest cluster of a key takes
    none and need not ask. Blocks that lie whole in the cluster are not asked. Of equal edges that close a ring one goes.
    """
    kind = points.schema[item].dataType.simpleString()
    now = points.select(key, "block", item, *columns, "core", F.col(item).alias("comp"), F.lit(False).alias("over"))
    left = materialize(listed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")).select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("w", "a", "b").alias("e")), "listed")
    kept = [left.select("e.a", "e.b", "e.w").limit(0)]

    def ask(pdf: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        may = boxes["only"].to_numpy(object)[None, :] != pdf["comp"].to_numpy(object)[:, None]
        return _asked(pdf, boxes, columns, (pdf["bound"].to_numpy() - 1) / STEPS, may)[[key, "block", item, *columns, "core", "comp", "bound"]]

    def lighter(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, core, comp = pdf[columns].to_numpy(), pdf[item].to_numpy(), pdf["core"].to_numpy(), pdf["comp"].to_numpy()
        out = [pd.DataFrame({"u": ids[:0], "v": ids[:0], "w": np.zeros(0, int), "a": ids[:0], "b": ids[:0]})]
        for some in _some(asked, len(x)):
            d = distances(some[columns].to_numpy(), x)
            bound, own = some["bound"].to_numpy(), some["comp"].to_numpy()
            p, q = (d <= bound[:, None] / STEPS).nonzero()
            w = np.maximum(np.maximum(levels(d[p, q]), core[q]), some["core"].to_numpy()[p])
            good = (w < bound[p]) & (own[p] != comp[q])
            p, q, w = p[good], q[good], w[good]
            out.append(pd.DataFrame({"u": own[p], "v": comp[q], "w": w, "a": some[item].to_numpy()[p], "b": ids[q]}))
        return pd.concat(out).sort_values("w", kind="stable").drop_duplicates("u")

    for _ in range(max_rounds):
        now = materialize(now, "space-comps")
        ways = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        first = ways.groupBy("u").agg(F.min(F.struct("e.w", "e.a", "e.b", "v")).alias("e"))
        whole = materialize(now.groupBy(key, "comp").agg(F.count("*").alias("n")).groupBy(key).agg(F.max(F.struct("n", "comp")).alias("m")).select(key, F.col("m.comp").alias("whole")), "space-whole")
        first = materialize(first.join(whole.select(F.col("whole").alias("u")), "u", "left_anti"), "space-first")
        some = now.join(whole, key).where("comp <> whole and not over").join(first.select(F.col("u").alias("comp"), "e.w"), "comp", "left")
        some = some.withColumn("bound", F.coalesce("w", F.lit(STEPS))).where("core < bound").select(key, "block", item, *columns, "core", "comp", "bound")
        boxes = near.join(now.groupBy(key, F.col("block").alias("other")).agg(F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("only")), [key, "other"])
        asked = materialize(dealt(some).cogroup(dealt(boxes)).applyInPandas(ask, f"{at}, core int, comp {kind}, bound int"), "space-asked")
        found = dealt(asked).cogroup(dealt(now)).applyInPandas(lighter, f"u {kind}, v {kind}, w int, a {kind}, b {kind}")
        every = first.select("u", "e").unionByName(found.select("u", F.struct("w", "a", "b", "v").alias("e")))
        chosen = materialize(every.groupBy("u").agg(F.min("e").alias("e")).select("u", "e.v", "e.w", "e.a", "e.b"), "space-chosen")
        if chosen.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        tree = spanning_forest(chosen.select(F.col("u").alias("a"), F.col("v").alias("b"), "w")).select(F.col("a").alias("lo"), F.col("b").alias("hi"), "w")
        named = chosen.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "w").agg(F.min(F.struct("a", "b")).alias("e"))
        kept.append(materialize(tree.join(named, ["lo", "hi", "w"]).select("e.a", "e.b", "w"), "space-forest"))
        grown = connected_components(chosen, "u", "v", at_once=500_000)
        of = lambda c: grown.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))
        last = now.join(whole, key).join(of("comp"), "comp", "left").join(chosen.select(F.col("u").alias("comp"), F.lit(True).alias("took")), "comp", "left")
        over = F.col("over") | ((F.col("comp") != F.col("whole")) & F.col("took").isNull())
        now = last.select(key, "block", item, *columns, "core", F.coalesce("new_comp", "comp").alias("comp"), over.alias("over"))
        moved = left.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("new_u", "u").alias("u"), F.coalesce("new_v", "v").alias("v"), "e").where("u <> v")
        left = materialize(moved.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("e").alias("e")), "listed")
    raise RuntimeError(f"clusters still grow after {max_rounds} rounds")


def line_labels(items: DataFrame, key: str, item: str, column: str, least: int, block: int = 4096, in_one_task: int = 0) -> DataFrame:
    """``space_labels`` of one coordinate, in work proportional to the points: sorted points are cut into blocks of ``block``, each with
    the ``least - 1`` points on either side; what a block must know of the others is their outermost core of each level.
    Keys of up to ``in_one_task`` points are cut in a task each, with the same result."""
    if not in_one_task:
        return _own_names(items, key, item, [column], lambda own, k, i, x: _line_labels(own, k, i, x[0], least, block))
    sized = materialize(items.join(items.groupBy(key).agg(F.count("*").alias("_size")), key), "sized")
    small, large = (sized.where(c).drop("_size") for c in (F.col("_size") <= in_one_task, F.col("_size") > in_one_task))
    found = _own_names(small, key, item, [column], lambda own, k, i, x: _small_labels(own, k, i, x, least))
    return found if large.isEmpty() else found.unionByName(line_labels(large, key, item, column, least, block))


def _small_labels(items: DataFrame, key: str, item: str, columns: list[str], least: int) -> DataFrame:
    kind = items.schema[item].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, ignore_index=True)
        label = best_labels(pdf[columns].to_numpy(), least)
        return pdf[[key, item]].assign(cluster=pd.Series(np.where(label < 0, None, pdf[item].to_numpy(object)[label]), dtype=object))

    return items.groupBy(key).applyInPandas(run, f"{key} {items.schema[key].dataType.simpleString()}, {item} {kind}, cluster {kind}")


def _line_labels(items: DataFrame, key: str, item: str, column: str, least: int, block: int) -> DataFrame:
    size = max(block, least)
    placed = ordinal(items.select(key, item, F.col(column).alias("x")), [F.asc(key), F.asc("x"), F.asc(item)], "at")
    begin = placed.groupBy(key).agg(F.min("at").alias("_begin"))
    put = placed.join(begin, key).withColumn("at", F.col("at") - F.col("_begin")).withColumn("own", F.floor(F.col("at") / size)).drop("_begin")
    place = F.col("at") % size
    beside = F.array_compact(F.array("own", F.when(place < least - 1, F.col("own") - 1), F.when(place >= size - least + 1, F.col("own") + 1)))
    kind, key_kind = (items.schema[c].dataType.simpleString() for c in (item, key))

    def core(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        x = np.concatenate([np.full(least, -np.inf), pdf["x"], np.full(least, np.inf)])
        n = len(pdf)
        far = np.full(n, np.inf)
        for j in range(least):  # j points before, the others behind
            back, ahead = x[least : least + n] - x[least - j : least - j + n], x[2 * least - 1 - j : 2 * least - 1 - j + n] - x[least : least + n]
            far = np.minimum(far, np.maximum(back, ahead))
        return pdf.assign(core=levels(far))[pdf["own"] == pdf["block"]].drop(columns="own")

    schema = f"{key} {key_kind}, {item} {kind}, x double, at long, block long"
    halo = put.select(key, item, "x", "at", "own", F.explode(beside).alias("block"))
    points = materialize(halo.groupBy(key, "block").applyInPandas(core, f"{schema}, core int"), "line-cores")

    def ends(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        x, c = pdf["x"].to_numpy(), pdf["core"].to_numpy()
        first, last = (np.array([np.flatnonzero(c <= t)[s] if (c <= t).any() else -1 for t in range(STEPS)]) for s in (0, -1))
        value = lambda at: pd.array(np.where(at < 0, np.nan, x[at]), "Float64")
        name = lambda at: pdf[item].iloc[at].where(at >= 0, None).to_numpy()
        return pd.DataFrame({key: k[0], "block": k[1], "level": range(STEPS), "fx": value(first), "fi": name(first), "lx": value(last), "li": name(last)})

    outer = points.groupBy(key, "block").applyInPandas(ends, f"{key} {key_kind}, block long, level int, fx double, fi {kind}, lx double, li {kind}")
    w = Window.partitionBy(key, "level").orderBy("block")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    met = materialize(outer.select(
        key, "block", "level", F.last("lx", ignorenulls=True).over(before).alias("lx"), F.last("li", ignorenulls=True).over(before).alias("li"),
        F.first("fx", ignorenulls=True).over(after).alias("fx"), F.first("fi", ignorenulls=True).over(after).alias("fi"),
    ), "line-ends")

    def placed_in(pdf: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        pdf, ahead = pdf.sort_values("at", ignore_index=True), ahead.sort_values("level", ignore_index=True)
        x, c, n = pdf["x"].to_numpy(), pdf["core"].to_numpy(), len(pdf)
        names = np.concatenate([pdf[item].to_numpy(object), [None, None]])
        reach, via, joins = np.full(n, STEPS), np.full(n, None, object), np.zeros(STEPS, np.int64)
        at = np.arange(n)
        for t in range(STEPS):
            held = c <= t
            lx, fx = (np.nan_to_num(float(v) if v is not pd.NA else np.nan, nan=s) for v, s in ((ahead["lx"][t], -np.inf), (ahead["fx"][t], np.inf)))
            xs = np.concatenate([x, [lx, fx]])
            names[n], names[n + 1] = ahead["li"][t], ahead["fi"][t]
            left = np.maximum.accumulate(np.concatenate([[-1], np.where(held, at, -1)]))[:-1]
            right = np.minimum.accumulate(np.concatenate([np.where(held, at, n + 1), [n + 1]])[::-1])[::-1][1:]
            left = np.where(left < 0, n, left)
            dl, dr = x - xs[left], xs[right] - x
            d, who = np.minimum(dl, dr), np.where(dl <= dr, left, right)
            for k in np.flatnonzero((dl == dr) & np.isfinite(dl)):
                who[k] = min(left[k], right[k], key=lambda at: names[at])
            level = np.maximum(levels(d), t)
            new = (level <= reach) & (level < STEPS)  # at an equal level more cores count, so the last is the nearest
            reach[new], via[new] = level[new], names[who[new]]
            joins[t] = int((held & (levels(dl) <= t)).sum())
        return pd.concat([
            pdf[[key, item, "x", "at", "block", "core"]].assign(kind="point", reach=reach, via=via, level=0, n=0),
            pd.DataFrame({key: pdf[key].iloc[0], "kind": "join", "level": range(STEPS), "n": joins}),
        ])

    out = f"{schema}, core int, kind string, reach int, via {kind}, level int, n long"
    found = materialize(points.groupBy(key, "block").cogroup(met.groupBy(key, "block")).applyInPandas(placed_in, out), "line-reach")
    points = found.where("kind = 'point'").drop("kind", "level", "n")
    counts = _counts(points, key).unionByName(found.where("kind = 'join'").groupBy(key, "kind", "level").agg(F.sum("n").alias("n")))
    best = materialize(_best_levels(counts, key), "best-levels").where("best is not null")
    known = points.join(best, key).join(met.select(key, "block", F.col("level").alias("best"), F.col("lx").alias("before")), [key, "block", "best"])

    def started(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        held = (pdf["core"] <= pdf["best"]).to_numpy()
        x = pdf["x"].to_numpy()[held]
        first = np.nan_to_num(float(pdf["before"].iloc[0]) if not pd.isna(pdf["before"].iloc[0]) else np.nan, nan=-np.inf)
        cut = levels(np.diff(np.concatenate([[first], x]))) > pdf["best"].iloc[0]
        start = np.maximum.accumulate(np.where(cut, np.arange(len(x)), -1)) if len(x) else np.zeros(0, int)
        names = pdf[item].to_numpy(object)[held]
        return pdf.assign(own=pd.Series([names[s] if s >= 0 else None for s in start], index=np.flatnonzero(held), dtype=object).reindex(pdf.index))[[key, "block", item, "at", "core", "reach", "via", "best", "own"]]

    cut = materialize(known.groupBy(key, "block").applyInPandas(started, f"{key} {key_kind}, block long, {item} {kind}, at long, core int, reach int, via {kind}, best int, own {kind}"), "line-starts")
    last = cut.where("own is not null").groupBy(key, "block").agg(F.max_by("own", "at").alias("last"))
    blocks = cut.select(key, "block").distinct().join(last, [key, "block"], "left")
    carry = blocks.select(key, "block", F.last("last", ignorenulls=True).over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    cores = cut.where("core <= best").join(carry, [key, "block"]).select(F.col(item).alias("node"), F.coalesce("own", "carried").alias("cluster"))
    at = F.when(F.col("core") <= F.col("best"), F.col(item)).when(F.col("reach") <= F.col("best"), F.col("via"))
    labelled = cut.select(key, item, at.alias("node")).join(cores, "node", "left").select(key, item, "cluster")
    return points.select(key, item).join(labelled.select(item, "cluster"), item, "left")


def scenes(items: DataFrame, event: str, item: str, columns: list[str], least: int = 10, most: int = 30, in_one_task: int = 100_000, block: int | None = None, max_levels: int = 10_000) -> DataFrame:
    """(event, scene_id, status, item) of every item with an event: an event of over ``most`` items is standardised and cut at its best
    level; its noise is set aside and its clusters are split in turn. A set of at most ``most`` is chosen, or unchosen below
    ``least``. scene_id is the smallest item of the set; items with a coordinate that is null or no number are noise of
    their own.

    Sets of up to ``in_one_task`` items are split to the end in a task each, as a level often takes off a few points and the next
    follows from what is left. Larger ones are cut by blocks, all of a level at once, as often as they stay larger; the result
    does not depend on the bound. Coordinates are standardised to nine digits.
    """
    named = {"_event": event, "_item": item} | {f"_x{k}": c for k, c in enumerate(columns)}
    spread = items.select(*[F.col(c).cast("double").alias(k) if k.startswith("_x") else F.col(c).alias(k) for k, c in named.items()]).where("_event is not null")
    parts = _scenes(spread, "_event", "_item", [f"_x{k}" for k in range(len(columns))], least, most, max(in_one_task, most), {"block": block} if block else {}, max_levels)
    return parts.select(F.col("_event").alias(event), "scene_id", "status", F.col("_item").alias(item))


def _scenes(spread: DataFrame, event: str, item: str, columns: list[str], least: int, most: int, in_one_task: int, more: dict, max_levels: int) -> DataFrame:
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns])
    spread = spread.withColumn("_whole", whole)
    done = [spread.where("not _whole").select(event, F.col(item).alias("scene_id"), F.lit("noise").alias("status"), item)]
    named = spread.where("_whole").drop("_whole")
    now = materialize(named.join(named.groupBy(event).agg(F.min(item).alias("_node"), F.count("*").alias("_size")), event), "scenes")
    kind = spread.schema[item].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, ignore_index=True)
        name, status = pdf[item].to_numpy(copy=True), np.empty(len(pdf), object)
        for i, s in split(pdf[columns].to_numpy(), least, most):
            if len(i):
                name[i], status[i] = name[i[0]], s  # indices ascend, so the first is the smallest item
        return pd.DataFrame({event: pdf[event], "scene_id": name, "status": status, item: pdf[item]})

    schema = f"{event} {spread.schema[event].dataType.simpleString()}, scene_id {kind}, status string, {item} {kind}"
    for _ in range(max_levels):
        small = now.where(F.col("_size") <= in_one_task)
        done.append(small.where(F.col("_size") <= LONG).groupBy("_node").applyInPandas(run, schema))
        long = small.where(F.col("_size") > LONG)
        if sets := long.select("_node").distinct().count():  # few bytes, but seconds of work each: dealt by their number
            done.append(long.repartition(min(4 * sets, 10_000), "_node").groupBy("_node").applyInPandas(run, schema))
        large = now.where(F.col("_size") > in_one_task)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        z = standardized(large.select("_node", item, *columns), "_node", columns)
        z = materialize(z.select("_node", item, *[F.round(f"z_{c}", 9).alias(c) for c in columns]), "standard")
        found = line_labels(z, "_node", item, columns[0], least, **more) if len(columns) == 1 else space_labels(z, "_node", item, columns, least, **more)
        found = materialize(found, "labels")
        sets = found.groupBy("_node", "cluster").agg(F.min(item).alias("_next"), F.count("*").alias("_n"))
        same = (F.col("f._node") == F.col("s._node")) & F.col("f.cluster").eqNullSafe(F.col("s.cluster"))
        named = found.alias("f").join(sets.alias("s"), same).select(item, "f.cluster", "_next", "_n")
        placed = materialize(large.join(named, item), "scenes")
        done.append(placed.where("cluster is null").select(event, F.col("_next").alias("scene_id"), F.lit("noise").alias("status"), item))
        now = placed.where("cluster is not null").select(event, item, *columns, F.col("_next").alias("_node"), F.col("_n").alias("_size"))
    raise RuntimeError(f"sets are still too large after {max_levels} levels")
