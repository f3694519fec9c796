"""Graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialize


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles both. Tables of a graph grow with the graph, and a broadcast of each in every
    round would go through the driver."""
    return df.hint("merge")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, component) for every endpoint of ``edges``; component is the smallest node reachable, the node itself included.

    Hash-min label propagation with pointer jumping: each round sends labels over the edges (one join, one
    pre-aggregated minimum), then replaces every label by its label's label, so long paths shorten geometrically.
    The state of each round is a table in the shared folder. Edges with a null endpoint are ignored, self edges keep
    their node as a singleton; an empty table gives an empty result. At most ``at_once`` edges are done in one task; if it is
    given, more are contracted until so few are left.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    if at_once:
        e = materialize(e, "cc-edges")
        if e.count() <= at_once:
            return materialize(e.repartition(1).mapInArrow(_merged, e.select(F.col("a").alias("node"), F.col("a").alias("component")).schema), "cc-labels")
        return _contracted(e, max_rounds, at_once)
    both = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels")
    for _ in range(max_rounds):
        heard = (
            both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        )
        nearer = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("up_component"))
        jumped = nearer.join(up, nearer["component"] == up["up"], "left").select(
            "node", F.least("component", "up_component").alias("component"), "old"
        )
        step = materialize(jumped, "cc-labels")
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _contracted(e: DataFrame, max_rounds: int, at_once: int) -> DataFrame:
    """``connected_components`` of the edges (a, b): each node goes with its smallest neighbour, so clusters at least halve in
    number however long the ways are, and the edges between them are taken on. Ways of such steps end in two nodes, as a
    ring of smallest neighbours has no more."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy(F.col("a").alias("u")).agg(F.coalesce(F.min(F.when(F.col("a") != F.col("b"), F.col("b"))), F.first("a")).alias("v"))
    grown = _roots(materialize(best, "cc-best"), max_rounds)
    of = lambda c: grown.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))
    left = e.join(of("a"), "a").join(of("b"), "b").where("new_a <> new_b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct()
    up = connected_components(left, "a", "b", max_rounds, at_once).select(F.col("node").alias("component"), F.col("component").alias("top"))
    placed = materialize(grown.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("top")), "cc-placed")
    least = placed.groupBy("top").agg(F.min("node").alias("component"))
    return materialize(placed.join(least, "top").select("node", "component"), "cc-labels")


class _Roots(dict):
    """Union-find over any keys; the root of a set is the one it was joined to."""

    def find(self, x):
        top = x
        while self.setdefault(top, top) != top:
            top = self[top]
        while x != top:
            self[x], x = top, self[x]
        return top


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components (node, component) of a task's rows (a, b)."""
    root, kind = _Roots(), None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root.find(u), root.find(v)
            root[max(u, v)] = min(u, v)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root.find(x) for x in nodes], kind)], names=["node", "component"])


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest edges (a, b, w) of all a task's rows (u, v, e), ``e`` being the original edge and its rank."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    rows = pa.Table.from_batches(held)
    e = rows.column("e").combine_chunks()
    flat = pa.table({"u": rows.column("u"), "v": rows.column("v"), **{n: e.field(n) for n in ("w", "a", "b")}}).sort_by([(n, "ascending") for n in ("w", "a", "b")])
    root, kept = _Roots(), []
    for k, (u, v) in enumerate(zip(flat.column("u").to_pylist(), flat.column("v").to_pylist(), strict=True)):
        u, v = root.find(u), root.find(v)
        if u != v:
            root[v] = u
            kept.append(k)
    yield from flat.take(kept).select(["a", "b", "w"]).to_batches()


def _roots(best: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) where each ``u`` points to ``v`` by its lightest edge: ways end in two that point to each other, of which
    the smaller is the component; pointers are doubled until all have come there."""
    back = best.select(F.col("u").alias("v"), F.col("v").alias("back"))
    own = F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v"))
    now = materialize(best.join(back, "v").select(F.col("u").alias("node"), own.alias("component")), "forest-roots")
    for _ in range(max_rounds):
        up = now.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = materialize(now.join(up, "component").select("node", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("moved")), "forest-roots")
        now = step.select("node", "component")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError(f"roots still change after {max_rounds} rounds")


def spanning_forest(edges: DataFrame, max_rounds: int = 60, at_once: int = 500_000) -> DataFrame:
    """(a, b, w): a minimum spanning forest of the undirected edges (a, b, w), ties by (w, a, b); a is the smaller end.

    Rounds after Borůvka: every component takes its lightest edge to another one, components that take each other's edges grow
    together, and edges within one go; of parallel edges the lightest stays. Components at least halve in number, so
    there are few rounds, each a handful of joins on tables that shrink. Once at most ``at_once`` edges are left they are
    finished in one task, whose memory that number bounds. Edges with a null and self edges are ignored.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a < b and w is not null")
    e = e.groupBy("a", "b").agg(F.min("w").alias("w"))
    left = materialize(e.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("w", "a", "b").alias("e")), "forest-edges")
    kept = []
    for _ in range(max_rounds):
        if left.count() <= at_once:
            kept.append(materialize(left.repartition(1).mapInArrow(_kruskal, left.select("e.a", "e.b", "e.w").schema), "forest-rest"))
            break
        ways = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        best = materialize(ways.groupBy("u").agg(F.min_by(F.struct("e", "v"), "e").alias("best")).select("u", "best.e", "best.v"), "forest-best")
        if best.isEmpty():
            break
        kept.append(best.select("e.a", "e.b", "e.w").distinct())
        grown = _roots(best, max_rounds)
        of = lambda c: grown.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))
        moved = left.join(of("u"), "u").join(of("v"), "v").where("new_u <> new_v")
        ends = (F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v"))
        left = materialize(moved.select(*ends, "e").groupBy("u", "v").agg(F.min("e").alias("e")), "forest-edges")
    else:
        raise RuntimeError(f"components still grow after {max_rounds} rounds")
    return reduce(DataFrame.unionByName, kept) if kept else e


def reach(edges: DataFrame, starts: DataFrame, depth: int = -1, max_rounds: int = 100_000) -> DataFrame:
    """(node, depth): every node reached from ``starts`` (column node) along src -> dst, with its least number of steps, up
    to ``depth`` (-1: any). Breadth first: each round joins the frontier only, minus what is already seen."""
    e = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "reach-edges")
    frontier = materialize(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "reach")
    levels = [frontier]
    for k in range(1, max_rounds + 1):
        if 0 <= depth < k:
            break
        seen = reduce(DataFrame.unionByName, levels)
        step = e.join(shuffled(frontier), e["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(shuffled(seen), "node", "left_anti").withColumn("depth", F.lit(k)), "reach")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > 20:
            levels = [materialize(reduce(DataFrame.unionByName, levels), "reach-seen")]
    return reduce(DataFrame.unionByName, levels)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are in ``nodes`` (column node)."""
    kept = shuffled(nodes.select("node").distinct())
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, scc) for every endpoint; scc is the smallest node of the strongly connected component.

    Nodes without an edge into or out of them are taken off first, a few times over; they are components of their own.
    Then colouring: the smallest node that reaches a node, over edges left, is its colour; a colour's nodes that reach its
    smallest node within the colour form a component, which is removed; until nothing is left.
    """
    left = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "scc-edges")
    nodes = materialize(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "scc-nodes")
    out = None
    for _ in range(4):
        ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out"))))
        ways = left.where("src <> dst").select(ends.alias("end")).groupBy("end.node").agg(F.bool_and("end.out").alias("all_out"), F.bool_or("end.out").alias("any_out"))
        inner = materialize(ways.where("any_out and not all_out").select("node"), "scc-nodes")
        alone = nodes.join(shuffled(inner), "node", "left_anti")
        if alone.isEmpty():
            break
        done = materialize(alone.select("node", F.col("node").alias("scc")), "scc-done")
        out = done if out is None else out.unionByName(done)
        nodes, left = inner, materialize(induced(left, inner), "scc-edges")
    for _ in range(max_rounds):
        if nodes.isEmpty():
            break
        colour = _spread_min(left, nodes.select("node", F.col("node").alias("colour")), max_rounds)
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        inside = left.join(shuffled(a), "src").join(shuffled(b), "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = reach(inside, colour.select(F.col("colour").alias("node")).distinct())
        done = materialize(back.select("node").join(shuffled(colour), "node").select("node", F.col("colour").alias("scc")), "scc-done")
        out = done if out is None else materialize(out.unionByName(done), "scc-out")
        nodes = materialize(nodes.join(shuffled(done), "node", "left_anti"), "scc-nodes")
        left = materialize(induced(left, nodes), "scc-edges")
    return out if out is not None else nodes.select("node", F.col("node").alias("scc"))


def _spread_min(edges: DataFrame, colours: DataFrame, max_rounds: int) -> DataFrame:
    """Colours after each node took the least colour of what reaches it, to the fixpoint."""
    now = materialize(colours, "spread")
    for _ in range(max_rounds):
        heard = edges.join(shuffled(now), edges["src"] == now["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("heard"))
        step = materialize(now.join(shuffled(heard), "node", "left").select("node", F.least("colour", F.coalesce("heard", "colour")).alias("colour"), F.col("colour").alias("old")), "spread")
        now = step.select("node", "colour")
        if step.where("colour <> old").isEmpty():
            return now
    raise RuntimeError(f"colours still change after {max_rounds} rounds")


def nearest_ancestor(tree: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, ancestor): the nearest proper ancestor that is live, null if none, by pointer jumping over dead ones.

    ``tree`` has node, parent (null at a root) and live; a node occurs once and the tree has no cycle. Only dead nodes whose
    parent is dead, too, take part in the jumps, and each jump doubles their length.
    """
    t = materialize(tree.select("node", "parent", (~F.coalesce("live", F.lit(False))).alias("dead")), "tree")
    up = t.select(F.col("node").alias("parent"), F.col("dead").alias("up_dead"))
    at = F.when(F.col("up_dead").isNotNull(), F.col("parent"))  # a parent that is no node is none
    first = materialize(t.join(up, "parent", "left").select("node", "dead", at.alias("at"), F.coalesce("up_dead", F.lit(False)).alias("open")), "ancestors")
    known, moving = [first.where("dead and not open").select("node", "at")], first.where("dead and open").select("node", "at")
    for _ in range(max_rounds):
        if moving.isEmpty():
            break
        ends = reduce(DataFrame.unionByName, known).withColumn("open", F.lit(False)).unionByName(moving.withColumn("open", F.lit(True)))
        step = materialize(moving.join(ends.select(F.col("node").alias("at"), F.col("at").alias("next"), "open"), "at").select("node", F.col("next").alias("at"), "open"), "ancestors")
        known.append(step.where("not open").select("node", "at"))
        moving = step.where("open").select("node", "at")
    else:
        raise RuntimeError(f"ancestors still change after {max_rounds} rounds")
    ends = reduce(DataFrame.unionByName, known).select(F.col("node").alias("at"), F.col("at").alias("ancestor"))
    return first.where("not open").select("node", F.col("at").alias("ancestor")).unionByName(first.where("open").join(ends, "at").select("node", "ancestor"))


def connected(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``connected``: are both ends in one component of ``components`` (node, component)? False where an
    end is in none."""
    out = pairs
    for c in ("a", "b"):
        out = out.join(components.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    return out.select(*pairs.columns, F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)).alias("connected"))


def component_of(asked: DataFrame, components: DataFrame) -> DataFrame:
    """(node, member): all members of the component of each node of ``asked``, itself included; none for an unknown node."""
    own = asked.select("node").distinct().join(components, "node")
    return own.join(components.withColumnRenamed("node", "member"), "component").select("node", "member")


def counters(components: DataFrame) -> DataFrame:
    """(n_elts, n_comps): how many elements and how many components there are."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_elts"), F.count("*").alias("n_comps"))
