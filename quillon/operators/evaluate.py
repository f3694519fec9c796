"""Evaluation of clusterings and classifiers, by contingency counts instead of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.items import ordinal
from quillon.session import materialize

TINY = 1e-6


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """accuracy, precision, recall and the area under the curve of hard labels; 0 where a denominator is 0."""
    part = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)
    auc = (part(tp, tp + fn) + part(tn, tn + fp)) / 2
    return [part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), auc.alias("auc")]


def pairwise_metrics(items: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the metrics of "same cluster" over all item pairs, from the sizes of the clusters and of their overlaps."""
    cells = items.groupBy(truth, predicted).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(choose2(F.col("n"))).alias("tp"), F.sum("n").alias("all"))
    a = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("same"))
    b = cells.groupBy(predicted).agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("called"))
    one = both.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))
    tp, fp, fn = F.col("tp"), F.col("called") - F.col("tp"), F.col("same") - F.col("tp")
    return one.select(*rates(tp, fp, fn, choose2(F.col("all")) - tp - fp - fn))


def confusion_metrics(items: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the counts and metrics of a binary classifier."""
    count = lambda t, p: F.count(F.when((F.col(truth) == t) & (F.col(predicted) == p), 1)).cast("double")
    c = items.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    return c.select("tp", "fp", "fn", "tn", *rates(*map(F.col, ("tp", "fp", "fn", "tn"))))


def containment(items: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, both, size_a, size_b, sim): share of b's items that a holds, for clusters that meet; others have 0."""
    cells = items.groupBy(a, b).agg(F.count("*").alias("both"))
    of_a, of_b = cells.groupBy(a).agg(F.sum("both").alias("size_a")), cells.groupBy(b).agg(F.sum("both").alias("size_b"))
    return cells.join(of_a, a).join(of_b, b).select(a, b, "both", "size_a", "size_b", (F.col("both") / (F.col("size_b") + TINY)).alias("sim"))


def greedy_match(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) for each cluster a: the b of its last cell among the best cells, as many as there are clusters a, by (sim
    descending, a, b); null if it has none.

    Where fewer cells than clusters a are above 0, each further turn takes the first cell of a table of zeros, so the first
    a ends with the first b. Cells get their global place by ranges, so no task holds the best of all.
    """
    ids = cells.select(a).distinct()
    n = ids.count()
    placed = ordinal(cells.where("sim > 0").select(a, b, "sim"), [F.desc("sim"), F.asc(a), F.asc(b)], "_place")
    best = placed.where(F.col("_place") < n)
    last = F.row_number().over(Window.partitionBy(a).orderBy(F.desc("_place")))
    kept = best.withColumn("_last", last).where("_last = 1").select(a, b)
    if n and best.count() < n:
        first = cells.agg(F.min(a).alias(a), F.min(b).alias(b))
        kept = kept.join(first.select(a), a, "left_anti").unionByName(first)
    return ids.join(kept, a, "left")


def one_to_one_match(cells: DataFrame, a: str, b: str, max_rounds: int = 1000) -> DataFrame:
    """(a, b) for each cluster a: its partner when cells are taken by (sim descending, a, b), each taking its row and its column
    away; null for an a that is left over. Cells of 0 are none.

    A cell that comes first both in its row and in its column is taken by the walk through all cells, whatever lies before it;
    so each round takes all such cells at once and drops their rows and columns.
    """
    left = materialize(cells.where("sim > 0").select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct((-F.col("sim")).alias("s"), F.col(a).alias("a"), F.col(b).alias("b")).alias("o")), "match")
    taken = []
    for _ in range(max_rounds):
        of = lambda c: left.groupBy(c).agg(F.min("o").alias("o")).select("o.a", "o.b")
        both = materialize(of("a").join(of("b"), ["a", "b"]), "matched")
        if both.isEmpty():
            break
        taken.append(both)
        left = materialize(left.join(both.select("a"), "a", "left_anti").join(both.select("b"), "b", "left_anti"), "match")
    else:
        raise RuntimeError(f"cells are left after {max_rounds} rounds")
    found = reduce(DataFrame.unionByName, taken) if taken else left.select("a", "b")
    return cells.select(a).distinct().join(found.select(F.col("a").alias(a), F.col("b").alias(b)), a, "left")


def match_metrics(cells: DataFrame, matched: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, precision, recall, f1) of each matched pair, denominators plus 1e-6; 0 without a match."""
    m = matched.join(cells, [a, b], "left")
    p, r = F.col("both") / (F.col("size_a") + TINY), F.col("both") / (F.col("size_b") + TINY)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return m.select(a, b, zero(p).alias("precision"), zero(r).alias("recall"), zero(2 * p * r / (p + r + TINY)).alias("f1"))
