"""Filter interaction audit: what each order of five document filters keeps, removes and loses, from one count tensor a part."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import columns

#: The filters in the order of the tensor's axes.
NAMES = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of its words distinct), C (over 3 in 100 code points are
    A-Z) and D (holds one of ``#$%&*|``). A null text reads as an empty one, which fails A only."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 3 * F.length(whole).cast("long"), whole.rlike(r"[#$%&*|]")]


def counted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, bits, first, first_good, first_toxic, later, later_good, later_toxic): documents by part and by the filters A to D
    they fail (bit k for filter k), apart by whether a smaller id has the same text (later, filter E) or not (first).

    Texts are read once and leave the scan as a digest; rows of one id, digest and part are counted before they move, and so
    are the copies of one text, so neither a hot id nor a hot text meets in one task: of a text, a row for each part and
    kind of label is left when its smallest id is looked up.
    """
    d = columns(docs, doc_id=id_col, text=text_col, part=part_col)
    bits = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(own_failures(F.col("text")))), F.lit(0))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = d.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), F.unhex(digest).alias("digest"), bits.alias("bits"))
    rows = rows.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = columns(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null")
    known = known.groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    labelled = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    texts = labelled.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.col("without_id") + F.when(F.col("least") == least, F.col("at_least")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("later", F.col("n") - F.col("first"))
    sums = [F.sum(F.col(c) * w).alias(f"{c}{s}") for c in ("first", "later") for s, w in (("", F.lit(1)), ("_good", F.col("good")), ("_toxic", F.col("toxic")))]
    return split.groupBy("part", "bits").agg(*sums)


def _selectors(orders: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """For each order and step a selector of two weights (pass, fail) an axis: the documents kept after the step, removed in it,
    all that fail its filter, and those that fail nothing else."""
    n = len(orders[0])
    made = {k: np.ones((len(orders) * n, n, 2), np.int64) for k in ("kept", "removed", "failing", "alone")}
    for o, order in enumerate(orders):
        for step, axis in enumerate(order):
            at = o * n + step
            made["kept"][at, list(order[: step + 1])] = 1, 0
            made["removed"][at, list(order[:step])] = 1, 0
            made["alone"][at] = 1, 0
            for kind in ("removed", "failing", "alone"):
                made[kind][at, axis] = 0, 1
    return made


def contracted(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """Of a tensor (all, good, toxic) x pass or fail of each filter: the counts of every order and step, in the order of
    ``permutations``; shapley is a filter's removals over all orders."""
    n = tensor.ndim - 1
    orders = list(permutations(range(n)))
    axes = "abcdefgh"[:n]
    spec = f"x{axes}," + ",".join(f"r{a}" for a in axes) + "->xr"
    of = {k: np.einsum(spec, tensor, *(s[:, a] for a in range(n))) for k, s in _selectors(orders).items()}
    letter = np.array(orders).ravel()
    total = np.zeros(n, np.int64)
    np.add.at(total, letter, of["removed"][0])
    return {
        "kept": of["kept"][0], "removed": of["removed"][0], "redundant": of["failing"][0] - of["removed"][0], "unique_fails": of["alone"][0],
        "good_lost": of["removed"][1], "toxic_lost": of["removed"][2], "shapley": total[letter],
    }


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each part, all orders
    of the filters and all steps, document counts within the part.

    Filters A to D are ``own_failures``; E fails a document whose text a smaller id of the table has, whether removed or not. A
    null part counts as the empty string, a null text as an empty text. Rows are documents: repeated rows count each, and rows
    of the smallest id all pass E; a row without id neither fails E nor makes others fail. A label is good or toxic if any of
    its id's rows says so; ids without a label are neither. An empty table gives no row. A task gets the 16 rows of a part.
    """
    orders = ["".join(NAMES[k] for k in o) for o in permutations(range(len(NAMES)))]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tensor = np.zeros((3,) + (2,) * len(NAMES), np.int64)
        for r in pdf.itertuples(index=False):
            at = tuple(r.bits >> k & 1 for k in range(len(NAMES) - 1))
            tensor[(slice(None), *at, 0)] += r.first, r.first_good, r.first_toxic
            tensor[(slice(None), *at, 1)] += r.later, r.later_good, r.later_toxic
        steps = pd.DataFrame({"part": key[0], "filter_order": np.repeat(orders, len(NAMES)), "step": np.tile(np.arange(1, len(NAMES) + 1, dtype=np.int32), len(orders))})
        return steps.assign(**contracted(tensor))

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return counted(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(run, schema)
