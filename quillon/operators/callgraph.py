"""Weighted call graphs: from stacks to ratios, totals, pruning and graph text.

Nodes (name, self), edges (src, dst, weight): src calls dst. Stacks are arrays of names, leaf first, with a cost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import dot_escape, hue_colour, percentage, ratio, squeezed, strip_name, truncated, wrapped_words
from quillon.operators.graph import shuffled, strong_components
from quillon.session import materialize


def stack_edges(stacks: DataFrame) -> DataFrame:
    """(src, dst, weight): cost summed over neighbouring frames of each stack (caller above callee)."""
    n = F.size("stack")
    pairs = F.explode(F.when(n > 1, F.arrays_zip(F.slice("stack", F.lit(2), n - 1).alias("src"), F.slice("stack", F.lit(1), n - 1).alias("dst"))).otherwise(F.array().cast("array<struct<src:string,dst:string>>")))
    return stacks.select(pairs.alias("p"), "cost").groupBy(F.col("p.src").alias("src"), F.col("p.dst").alias("dst")).agg(F.sum("cost").alias("weight"))


def stack_nodes(stacks: DataFrame) -> DataFrame:
    """(name, self): every name on a stack with the cost of stacks of which it is the leaf."""
    frame = F.posexplode("stack").alias("at", "name")
    return stacks.select(frame, "cost").groupBy("name").agg(F.sum(F.when(F.col("at") == 0, F.col("cost")).otherwise(0.0)).alias("self"))


def presence(stacks: DataFrame) -> DataFrame:
    """(name, samples, share): in how many stacks a name occurs, and in which share of them."""
    n = stacks.agg(F.count("*").alias("n"))
    on = stacks.select(F.explode(F.array_distinct("stack")).alias("name")).groupBy("name").agg(F.count("*").alias("samples"))
    return on.crossJoin(F.broadcast(n)).select("name", "samples", (F.col("samples") / F.col("n")).alias("share"))


def self_ratios(nodes: DataFrame) -> DataFrame:
    """(name, self, ratio): a node's part of the sum, clamped."""
    total = nodes.agg(F.sum("self").alias("total"))
    return nodes.crossJoin(F.broadcast(total)).select("name", "self", ratio(F.col("self"), F.col("total")).alias("ratio"))


def call_ratios(edges: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """``edges`` with ``ratio``: weight over all weight into the callee, self calls left out (they get 0). With ``cycles``
    (node, scc), a call into a cycle from outside is set against all calls into that cycle from outside."""
    if cycles is None:
        into = edges.where("src <> dst").groupBy("dst").agg(F.sum("weight").alias("into"))
        return edges.join(into, "dst", "left").select("src", "dst", "weight", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(ratio(F.col("weight"), F.col("into"))).alias("ratio"))
    a, b = cycles.select(F.col("node").alias("src"), F.col("scc").alias("a")), cycles.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    both = edges.join(shuffled(a), "src").join(shuffled(b), "dst")
    into = both.where("a <> b").groupBy("b").agg(F.sum("weight").alias("into"))
    return both.join(shuffled(into), "b", "left").select("src", "dst", "weight", "a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(ratio(F.col("weight"), F.col("into"))).alias("ratio"))


def propagate(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(name, total): self plus, for each call, the call's ratio times the callee's total, as ratios of all cost.

    Cycles are condensed first; totals then travel from callees to callers level by level: a round settles every node or
    cycle whose callees are settled, and its results are a table of their own. What a cycle has in all (its members' self
    and what they call outside) is dealt out among its members (see ``cycle_totals``).
    """
    parts = strong_components(edges)
    of = nodes.join(shuffled(parts.withColumnRenamed("node", "name")), "name", "left").select("name", "self", F.coalesce("scc", "name").alias("part"))
    of = materialize(of, "parts")
    every = call_ratios(edges, of.select(F.col("name").alias("node"), F.col("part").alias("scc")))
    every = materialize(every.where("a <> b").select("src", "dst", "a", "b", "ratio"), "calls-outside")
    calls = materialize(every.groupBy("a", "b").agg(F.sum("ratio").alias("ratio")), "calls")
    whole = of.agg(F.sum("self").alias("whole"))
    of = of.crossJoin(F.broadcast(whole)).select("name", "part", ratio(F.col("self"), F.col("whole")).alias("own"))
    open_, levels = materialize(of.groupBy("part").agg(F.sum("own").alias("own")), "open"), []
    for _ in range(max_rounds):
        waits = calls.join(shuffled(open_.select(F.col("part").alias("b"))), "b", "left_semi").select(F.col("a").alias("part")).distinct()
        ready = open_.join(shuffled(waits), "part", "left_anti")
        settled = ready.select("part", F.col("own").alias("total"))
        if levels:
            done = reduce(DataFrame.unionByName, levels)
            got = calls.join(shuffled(done), calls["b"] == done["part"]).groupBy("a").agg(F.sum(F.col("ratio") * F.col("total")).alias("called"))
            settled = ready.join(shuffled(got), ready["part"] == got["a"], "left").select(ready["part"], (F.col("own") + F.coalesce("called", F.lit(0.0))).alias("total"))
        levels.append(materialize(settled, "settled"))
        open_ = materialize(open_.join(shuffled(levels[-1]), "part", "left_anti"), "open")
        if open_.isEmpty():
            break
        if len(levels) > 20:
            levels = [materialize(reduce(DataFrame.unionByName, levels), "settled")]
    done = reduce(DataFrame.unionByName, levels) if levels else open_.select("part", F.col("own").alias("total"))
    cycles = materialize(of.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part"), "cycles")
    ring = shuffled(cycles)
    if cycles.isEmpty():
        return of.join(shuffled(done), "part").select("name", "total")
    alone = of.join(ring, "part", "left_anti").join(shuffled(done), "part").select("name", "total")
    return alone.unionByName(cycle_totals(of.join(ring, "part", "left_semi"), edges, every, done, max_rounds))


def cycle_totals(members: DataFrame, edges: DataFrame, outside: DataFrame, done: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(name, total) of the ``members`` (name, part, own) of cycles, from the calls between parts ``outside`` (src, dst, a, b,
    ratio) and the parts' totals ``done``.

    For each member that is called from outside, an entry, members are ranked by their distance from it, and only calls
    that lead away from it count: of a member's partial total each caller one step nearer gets the share of its call among
    those. The partial total of the entry is the cycle's total times the ratio of the calls into it; a member's total is
    the sum over entries, and 0 in a cycle that nothing calls.
    """
    members = shuffled(materialize(members, "cycle-members"))
    inside = members.select(F.col("name").alias("src"), "part").join(edges.where("src <> dst"), "src").join(members.select(F.col("name").alias("dst"), F.col("part").alias("to")), "dst")
    into = edges.where("src <> dst").groupBy("dst").agg(F.sum("weight").alias("into"))
    inside = materialize(inside.where("part = to").join(shuffled(into), "dst").select("src", "dst", ratio(F.col("weight"), F.col("into")).alias("ratio")), "cycle-calls")
    called = outside.join(shuffled(done).select(F.col("part").alias("b"), "total"), "b").groupBy(F.col("src").alias("name")).agg(F.sum(F.col("ratio") * F.col("total")).alias("called"))
    value = materialize(members.join(called, "name", "left").select(F.col("name").alias("node"), (F.col("own") + F.coalesce("called", F.lit(0.0))).alias("value")), "cycle-values")
    entries = outside.join(members.select(F.col("name").alias("dst")), "dst").groupBy(F.col("dst").alias("entry")).agg(F.sum("ratio").alias("part_in"))
    entries, inside, value = shuffled(materialize(entries, "cycle-entries")), shuffled(inside), shuffled(value)
    levels = [materialize(entries.select("entry", F.col("entry").alias("node"), F.lit(0).alias("rank")), "cycle-ranks")]
    for k in range(1, max_rounds):
        step = levels[-1].select("entry", F.col("node").alias("src")).join(inside, "src").select("entry", F.col("dst").alias("node")).distinct()
        step = materialize(step.join(shuffled(reduce(DataFrame.unionByName, levels)), ["entry", "node"], "left_anti").withColumn("rank", F.lit(k)), "cycle-ranks")
        if step.isEmpty():
            break
        levels.append(step)
    partials: list[DataFrame] = []
    for k in range(len(levels) - 1, -1, -1):
        own = shuffled(levels[k]).join(value, "node").join(entries, "entry").select("entry", "node", (F.col("part_in") * F.col("value")).alias("partial"))
        if partials:
            away = levels[k].select("entry", F.col("node").alias("src")).join(inside, "src").join(shuffled(levels[k + 1]).select("entry", F.col("node").alias("dst")), ["entry", "dst"])
            of_all = away.groupBy("entry", "dst").agg(F.sum("ratio").alias("all"))
            shares = away.join(shuffled(of_all), ["entry", "dst"]).join(shuffled(partials[-1]).select("entry", F.col("node").alias("dst"), "partial"), ["entry", "dst"])
            got = shares.groupBy("entry", F.col("src").alias("node")).agg(F.sum(ratio(F.col("ratio"), F.col("all")) * F.col("partial")).alias("more"))
            own = own.join(shuffled(got), ["entry", "node"], "left").select("entry", "node", (F.col("partial") + F.coalesce("more", F.lit(0.0))).alias("partial"))
        partials.append(materialize(own, "cycle-partials"))
    total = reduce(DataFrame.unionByName, partials).groupBy(F.col("node").alias("name")).agg(F.sum("partial").alias("total"))
    return members.select("name").join(shuffled(total), "name", "left").select("name", F.coalesce("total", F.lit(0.0)).alias("total"))


def prune(nodes: DataFrame, edges: DataFrame, least_node: float = 0.005, least_edge: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, total) and edges (src, dst, weight) at or above the thresholds; an edge without a weight counts as the
    lesser of its ends' totals, and goes with either end."""
    kept = nodes.where(F.col("total") >= least_node)
    a, b = kept.select(F.col("name").alias("src"), F.col("total").alias("ta")), kept.select(F.col("name").alias("dst"), F.col("total").alias("tb"))
    safe = edges.join(a, "src").join(b, "dst").withColumn("weight", F.coalesce("weight", F.least("ta", "tb")))
    return kept, safe.where(F.col("weight") >= least_edge).select("src", "dst", "weight")


def validated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to known nodes, the others)."""
    known = nodes.select(F.col("name").alias("dst")).distinct()
    return edges.join(known, "dst", "left_semi"), edges.join(known, "dst", "left_anti")


def completed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` and, with self 0, every callee that has no node."""
    missing = edges.select(F.col("dst").alias("name")).distinct().join(nodes.select("name"), "name", "left_anti")
    return nodes.select("name", "self").unionByName(missing.withColumn("self", F.lit(0.0)))


def font_size(weight: Column, least: float = 8.0, most: float = 10.0) -> Column:
    return F.greatest(weight * weight * most, F.lit(least))


def pen_width(weight: Column, least: float = 0.5, most: float = 4.0) -> Column:
    return F.greatest(weight * most, F.lit(least))


def self_time_weights(nodes: DataFrame) -> DataFrame:
    """(name, weight): self over the greatest self, for colouring; 0 where all are 0."""
    most = nodes.agg(F.max("self").alias("most"))
    return nodes.crossJoin(F.broadcast(most)).select("name", F.when(F.col("most") > 0, F.col("self") / F.col("most")).otherwise(0.0).alias("weight"))


#: Looks of a graph document (fixed values): text and ground colours, node style, sizes of text and pens, and the colours,
#: as hue, saturation and lightness, of the least and the greatest weight.
THEMES = {
    "color": {"cold": (2 / 3, 0.8, 0.25), "hot": (0.0, 1.0, 0.5), "gamma": 1.0},
    "pink": {"cold": (0.0, 1.0, 0.9), "hot": (0.0, 1.0, 0.5)},
    "gray": {"cold": (0.0, 0.0, 0.85), "hot": (0.0, 0.0, 0.0)},
    "bw": {"cold": (0.0, 0.0, 0.0), "hot": (0.0, 0.0, 0.0), "font": (8.0, 24.0), "pen": (0.1, 8.0)},
    "print": {"cold": (0.0, 0.0, 0.0), "hot": (0.0, 0.0, 0.0), "font": (18.0, 30.0), "pen": (0.1, 8.0), "font_colour": "black", "style": "solid"},
}
PLAIN = {"gamma": 2.2, "font": (10.0, 10.0), "pen": (0.5, 4.0), "font_colour": "white", "style": "filled", "font_name": "Arial"}


def arrow_size(weight: Column, least: float = 0.5, most: float = 4.0) -> Column:
    return 0.5 * F.sqrt(pen_width(weight, least, most))


def _statement(head: Column, attributes: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f"{k}="), v) for k, v in sorted(attributes.items())]
    return F.concat(F.lit("\t"), head, F.lit(" ["), F.concat_ws(", ", *parts), F.lit("];"))


def dot_document(nodes: DataFrame, edges: DataFrame, theme: str = "color", strip: bool = False, wrap: bool = False) -> DataFrame:
    """(at, line): the lines of a graph document of ``nodes`` (name, total, self as ratios) and ``edges`` (src, dst, ratio), in the
    order of ``at``: header, then by name each node and its calls by callee, then the end. Write it sorted by ``at``."""
    look = PLAIN | THEMES[theme]
    (small, large), (thin, thick) = look["font"], look["pen"]
    number = lambda x: F.format_string("%.2f", x)
    colour = lambda w: dot_escape(hue_colour(w, look["cold"], look["hot"], look["gamma"]))
    front = colour if look["style"] != "filled" else lambda w: dot_escape(F.lit("#ffffff"))
    shown = truncated(strip_name(F.col("name")) if strip else F.col("name"))
    shown = squeezed(wrapped_words(shown)) if wrap else shown
    text = F.concat(shown, F.lit("\n"), percentage(F.col("total")), F.lit("\n("), percentage(F.col("self")), F.lit(")"))
    weight = F.col("total")
    node = _statement(dot_escape(F.col("name")), {
        "color": colour(weight), "fontcolor": front(weight), "fontsize": dot_escape(number(font_size(weight, small, large))), "label": dot_escape(text),
    })
    pen = number(pen_width(weight, thin, thick))
    edge = _statement(F.concat(dot_escape(F.col("src")), F.lit(" -> "), dot_escape(F.col("dst"))), {
        "arrowsize": dot_escape(number(arrow_size(weight, thin, thick))), "color": colour(weight), "fontcolor": colour(weight),
        "fontsize": dot_escape(number(font_size(weight, small, large))), "label": dot_escape(percentage(weight)), "labeldistance": dot_escape(pen), "penwidth": dot_escape(pen),
    })
    called = edges.join(nodes.select(F.col("name").alias("dst"), F.col("total").alias("callee")), "dst").withColumn("total", F.col("ratio") * F.col("callee"))
    at = lambda *x: F.struct(*[c.cast(k).alias(n) for c, k, n in zip(x, ("int", "string", "int", "string"), ("block", "name", "kind", "callee"), strict=True)])
    none = F.lit("")
    name, ground = look["font_name"], {"font_colour": look["font_colour"], "style": look["style"]}
    head = [
        "digraph {", f'\tgraph [fontname="{name}", nodesep=0.125, ranksep=0.25];',
        f'\tnode [fontcolor="{ground["font_colour"]}", fontname="{name}", height=0, shape=box, style="{ground["style"]}", width=0];', f'\tedge [fontname="{name}"];',
    ]
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([*[(0, k, x) for k, x in enumerate(head)], (2, 0, "}")], "block int, k int, line string")
    frame = fixed.select(at(F.col("block"), none, F.col("k"), none).alias("at"), "line")
    return frame.unionByName(nodes.select(at(F.lit(1), F.col("name"), F.lit(0), none).alias("at"), node.alias("line"))).unionByName(
        called.select(at(F.lit(1), F.col("src"), F.lit(1), F.col("dst")).alias("at"), edge.alias("line"))
    )
