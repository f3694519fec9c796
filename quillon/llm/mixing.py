"""Mixing sources to target weights: token weights raked to marginals, then documents sampled by calibrated probabilities.

DataFrame functions only.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import fresh, named
from quillon.session import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Topics by the first that has a mark anywhere in the lower-cased text; else ``prose``. A parameter of the functions below,
#: used where no column gives the topic.
TOPICS = (("table", (" | ",)), ("license", ("licensed under", "all rights reserved")), ("symbols", ("***", "###", "%%%", "&&&", "$$$")), ("shouting", ("!!",)))
#: The mix: for each dimension the weight of each value, ``*`` for each value not named; or the power of the present shares
#: (1 keeps them, 0 makes all values equal). Weights are scaled to the values that are present.
TARGETS = {
    "source": 0.5,
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15, "*": 0.02},
    "topic": {"prose": 0.9, "table": 0.04, "license": 0.03, "symbols": 0.02, "shouting": 0.01, "*": 0.01},
}
#: Cells (distinct combinations of source, language and topic) that one task handles while raking.
CELLS_PER_TASK = 100_000
#: Raking ends once no share changes in a round by more than this part of itself.
SETTLED = 1e-10
#: A share that is off its target by more has missed it.
MISSED = 1e-6
#: Rounds of one plan.
ROUNDS_AT_ONCE = 5


def topic(text: Column, topics: tuple = TOPICS) -> Column:
    """The name of the first of ``topics`` (name, marks) that the text has a mark of; ``prose`` if none or null."""
    low = F.lower(text)
    return reduce(lambda rest, t: F.when(reduce(lambda a, b: a | b, [low.contains(m) for m in t[1]]), t[0]).otherwise(rest), reversed(topics), F.lit("prose"))


def tokens(text: Column) -> Column:
    """The number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _cell(docs: DataFrame, topics: tuple, topic_col: str | None) -> dict[str, Column]:
    cell = {c: F.coalesce(docs[c], F.lit("unknown")) for c in ("source", "lang")}
    cell["topic"] = F.coalesce(docs[topic_col], F.lit("unknown")) if topic_col else topic(docs["text"], topics)
    return cell


def described(docs: DataFrame, topics: tuple = TOPICS, topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of each row; a null source, language or given topic is the value ``unknown``."""
    cell = _cell(docs, topics, topic_col)
    return docs.select(docs["doc_id"].alias("doc_id"), *[cell[c].alias(c) for c in DIMENSIONS], tokens(docs["text"]).alias("n_tokens"))


def _targets(cells: DataFrame, dimension: str, wanted: float | dict[str, float]) -> DataFrame:
    """(dimension, target): a share for each value that has tokens; shares sum to 1, or are 0 where no value has a weight."""
    present = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("present"))
    if isinstance(wanted, dict):
        named = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
        raw = present.withColumn("raw", F.coalesce(F.try_element_at(named, dimension), F.lit(wanted.get("*", 0.0)).cast("double")))
    else:
        raw = present.withColumn("raw", F.pow("present", F.lit(float(wanted))))
    total = raw.agg(F.sum("raw").alias("total"))
    share = F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(0.0)
    return raw.crossJoin(F.broadcast(total)).select(dimension, share.alias(f"target_{dimension}"))


def rake(cells: DataFrame, targets: dict = TARGETS, max_rounds: int = 200, strict: bool = False) -> DataFrame:
    """Iterative proportional fitting: the cells (source, lang, topic, tokens) with ``share``, their calibrated part of the mix.

    Each round scales the shares to each dimension's targets in turn, by the sum of each value's cells, until no share
    changes any more or ``max_rounds`` are over. Targets that no shares can meet together (a source in one language alone,
    say) are missed: this is said by a warning, or an error where ``strict``; the topic's targets then hold, the others as
    nearly as the last round left them. A few rounds make a plan and a table, in one task for each
    ``CELLS_PER_TASK`` cells at most. A value whose target is 0 or is absent gets 0.
    """
    files = max(1, -(-cells.count() // CELLS_PER_TASK))
    total = cells.agg(F.sum("tokens").alias("total"))
    now = cells.crossJoin(F.broadcast(total)).select(*DIMENSIONS, "tokens", (F.col("tokens") / F.col("total")).alias("share"))
    for d in DIMENSIONS:
        now = now.join(_targets(cells, d, targets[d]), d)
    now = materialize(now.coalesce(files), "mix-cells").coalesce(files)
    for at in range(0, max_rounds, ROUNDS_AT_ONCE):
        for k in range(at, min(max_rounds, at + ROUNDS_AT_ONCE)):
            now = now.withColumn("before", F.col("share"))
            for d in DIMENSIONS:
                has = F.sum("share").over(Window.partitionBy(d))
                now = now.withColumn("share", F.when(has > 0, F.col("share") * F.col(f"target_{d}") / has).otherwise(0.0))
        now = materialize(now, "mix-cells").coalesce(files)
        if now.where(F.abs(F.col("share") - F.col("before")) > SETTLED * F.col("before")).isEmpty():
            break
    off = [
        now.groupBy(d).agg(F.sum("share").alias("has"), F.first(f"target_{d}").alias("target")).select(F.abs(F.col("has") - F.col("target")).alias("off"))
        for d in DIMENSIONS
    ]
    worst = reduce(DataFrame.unionByName, off).agg(F.max("off")).first()[0] or 0.0
    if worst > MISSED:
        said = f"raking cannot meet, or has not met, all targets: a share is off by {worst:.2g}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return now.select(*DIMENSIONS, "tokens", "share")


def rates(cells: DataFrame, part: float) -> DataFrame:
    """Raked cells with ``rate``, the probability of each of their tokens: proportional to share / tokens, at most 1, and
    such that ``part`` of all tokens is expected (all that have a share, where that is less).
    """
    per = cells.select(*DIMENSIONS, "tokens", "share", (F.col("share") / F.col("tokens")).alias("per")).where("share > 0")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale, budget = None, part * total
    for _ in range(200):  # each step caps more cells; the set of capped cells only grows, so it settles in a few
        full = F.lit(False) if scale is None else F.col("per") * F.lit(scale) >= 1
        got = per.agg(F.sum(F.when(full, F.col("tokens"))).alias("whole"), F.sum(F.when(~full, F.col("share"))).alias("open")).first()
        if not got["open"]:
            break
        step = max(0.0, budget - (got["whole"] or 0)) / got["open"]
        if scale is not None and step <= scale * (1 + 1e-12):
            break
        scale = step
    rate = F.least(F.lit(1.0), F.col("share") / F.col("tokens") * F.lit(float(scale or 0.0)))
    return cells.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(0.0))


def draw(doc_id: Column, seed: int) -> Column:
    """A fixed number in [0, 1) for each id: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(
    docs: DataFrame, part: float = 0.7, targets: dict = TARGETS, topics: tuple = TOPICS, topic_col: str | None = None, max_rounds: int = 200, seed: int = 7
) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens, rate and sampled, whether the document is in the mix.

    The topic is that of ``topic_col`` where one is named, else it is told by marks in the text. Documents without words have
    rate 0 and are not sampled; the rate is shown to six digits, the draw takes it whole. Rows repeated under one doc_id fall alike. An empty table gives no rows.
    """
    d = materialize(described(docs, topics, topic_col), "mix-docs")
    cells = materialize(d.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    rated = materialize(rates(rake(cells, targets, max_rounds), part).select(*DIMENSIONS, F.col("rate").alias("cell_rate")), "mix-rates")
    rate = F.when(F.col("n_tokens") > 0, F.coalesce("cell_rate", F.lit(0.0))).otherwise(0.0)
    return d.join(rated, list(DIMENSIONS), "left").select(
        "doc_id", *DIMENSIONS, "n_tokens", F.round(rate, 6).alias("rate"), (draw(F.col("doc_id"), seed) < rate).alias("sampled")
    )


def sampled(
    docs: DataFrame, part: float = 0.7, targets: dict = TARGETS, topics: tuple = TOPICS, topic_col: str | None = None, max_rounds: int = 200, seed: int = 7
) -> DataFrame:
    """The rows of ``docs``, all columns, that are in the mix (see ``mix``): the decision is remade from each row's cell, so no id is
    joined. Other columns, whatever their names, stay as they are.
    """
    inner = {c: fresh(docs, f"mix_{c}") for c in (*DIMENSIONS, "rate")}
    own, cell = described(docs, topics, topic_col), _cell(docs, topics, topic_col)
    cells = materialize(own.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    rated = rates(rake(cells, targets, max_rounds), part).select(*[F.col(c).alias(inner[c]) for c in DIMENSIONS], F.col("rate").alias(inner["rate"]))
    on = reduce(lambda a, b: a & b, [cell[c] == F.col(inner[c]) for c in DIMENSIONS])
    kept = docs.join(materialize(rated, "mix-rates"), on).where(draw(docs["doc_id"], seed) < F.col(inner["rate"]))
    return kept.where(F.coalesce(docs["text"].rlike(r"\S"), F.lit(False))).select(*[named(docs, c) for c in docs.columns])
