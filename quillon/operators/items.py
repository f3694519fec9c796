"""Item operators: band self-join, time density, calendar features, standardisation, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import MICROS, micros
from quillon.session import materialize


def band_join(items: DataFrame, group: str, item: str, time_us: str, seconds: float, strict: bool = False) -> DataFrame:
    """Pairs (l.*, r.*) of items of a group with l.item <= r.item (or <) whose times differ by at most ``seconds``.

    Time is cut into buckets of the band's width, so the right item lies in the left one's bucket or a neighbour: the
    right side is written once for each of the three, and the band becomes an equi-join on (group, bucket) with the
    exact condition beside it. A busy group is spread over its buckets; the work per pair of buckets grows with the
    pairs found, not with the group squared. Rows without group or time pair with nothing.
    """
    width = int(seconds * MICROS)
    bucket = F.floor(F.col(time_us) / F.lit(max(width, 1))).cast("long")
    left = items.withColumn("bucket", bucket).alias("l")
    near = F.explode(F.array(bucket - 1, bucket, bucket + 1))
    right = items.select("*", near.alias("bucket")).alias("r")
    order = F.col(f"l.{item}") < F.col(f"r.{item}") if strict else F.col(f"l.{item}") <= F.col(f"r.{item}")
    close = F.abs(F.col(f"l.{time_us}") - F.col(f"r.{time_us}")) <= width
    return left.join(right, (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col("l.bucket") == F.col("r.bucket")) & order & close)


def relative_seconds(items: DataFrame, group: str, ts: str) -> Column:
    """Seconds since the group's first time; null times stay null."""
    first = F.min(micros(ts)).over(Window.partitionBy(group))
    return (micros(ts) - first) / float(MICROS)


def with_time_frequency(items: DataFrame, group: str, time_us: str, item: str, half: int = 2, name: str = "time_freq") -> DataFrame:
    """``items`` with the density of each item's neighbourhood in time: the items in the frame of ``half`` rows to either side
    over the frame's span in seconds (at least 1). The last row of a group is in no frame; a frame of at most one row gives 1."""
    order = Window.partitionBy(group).orderBy(time_us, item)
    frame = order.rowsBetween(-half, half)
    last = F.row_number().over(order) == F.count("*").over(Window.partitionBy(group))
    marked = items.withColumn("_kept", F.when(~last, F.col(time_us)))
    count = F.count("_kept").over(frame)
    span = (F.max("_kept").over(frame) - F.min("_kept").over(frame)) / float(MICROS)
    value = F.when(count <= 1, 1.0).otherwise(count / F.greatest(span, F.lit(1.0)))
    return marked.withColumn(name, value).drop("_kept")


def calendar(days: DataFrame, holidays: tuple[int, ...] = (1, 15)) -> DataFrame:
    """(day, flag) for every day from the first to the last of ``days`` (column ``day``): 2 on the given days of a month, 1 at weekends, else 0."""
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    day = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    flag = F.when(F.dayofmonth("day").isin(*holidays), 2).when(F.dayofweek("day").isin(1, 7), 1).otherwise(0)
    return day.withColumn("flag", flag)


def nearest_holiday(cal: DataFrame) -> DataFrame:
    """``cal`` with the days to the nearest day of flag 2 in either direction; null where there is none. The calendar is a
    row a day, so one task orders some thousand rows whatever the data's size."""
    back = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("flag") == 2, F.col("day"))
    before, after = F.last(mark, ignorenulls=True).over(back), F.first(mark, ignorenulls=True).over(ahead)
    return cal.withColumn("closest", F.least(F.datediff("day", before), F.datediff(after, "day")))


def standardized(items: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Each column less its group's mean over its population deviation (plus 1e-15), as ``z_<column>``."""
    stats = items.groupBy(group).agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    z = {f"z_{c}": (F.col(c) - F.col(f"mean_{c}")) / (F.col(f"dev_{c}") + 1e-15) for c in columns}
    return items.join(stats, group).withColumns(z).drop(*[f"{k}_{c}" for c in columns for k in ("mean", "dev")])


def dealt(items: DataFrame, key: str, rows: int = 200_000) -> DataFrame:
    """``items`` dealt by ``key`` over as many partitions as there are times ``rows`` of them, so what a task holds does not follow the table."""
    return items.repartition(max(1, -(-items.count() // rows)), key)


def proportion(items: DataFrame, group: str, category: str) -> DataFrame:
    """(group, category, n, prop): a category's share of its group's items."""
    n = items.groupBy(group, category).agg(F.count("*").alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    return n.join(total, group).select(group, category, "n", (F.col("n") / F.col("total")).alias("prop"))


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its 0-based place in the global order as column ``name``; the order must have no ties.

    Rows are range-partitioned and sorted, numbered within a partition, and shifted by the sizes of the partitions
    before; only those sizes, a row a partition, meet in one task.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordinal")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(shift, F.lit(0)).alias("_shift"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_row") + F.col("_shift")).cast("long")).drop("_part", "_row", "_shift")


def rank_fusion(clusters: DataFrame, criteria: dict[str, tuple[float, bool]], key: str) -> DataFrame:
    """``clusters`` with a 0-based rank for each criterion, ``rank_<c>``, and their weighted sum ``total_rank``.

    criteria: column -> (weight, ascending). Ascending ranks give the greatest value the highest rank, descending ones the
    smallest; ties by ``key`` in the same direction.
    """
    base = materialize(clusters, "rank-base")
    out = base
    for c, (_, up) in criteria.items():
        order = [F.col(c).asc(), F.col(key).asc()] if up else [F.col(c).desc(), F.col(key).desc()]
        out = out.join(ordinal(base.select(key, c), order, f"rank_{c}").drop(c), key)  # only key and rank are sorted and shuffled
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"rank_{c}") for c, (w, _) in criteria.items()])
    return out.withColumn("total_rank", total)


#: Weights of the criteria size, time, place, closest holiday and holiday share, in that order (fixed values).
PRESETS = {"equal": (0.2, 0.2, 0.2, 0.2, 0.2), "time_only": (0.25, 0.25, 0.0, 0.25, 0.25)}


def parent_rank(scenes: DataFrame, parent: str, rank: str = "total_rank") -> DataFrame:
    """(parent, rank): a parent's rank is the mean of its scenes'."""
    return scenes.groupBy(parent).agg(F.avg(rank).alias(rank))


def ranked_by_parent(scenes: DataFrame, parent: str, rank: str = "total_rank", digits: int = 6) -> DataFrame:
    """Each scene with the mean rank of its parent's scenes (``parent_mean``, rounded) and its parent's place among all parents
    by that mean, then by key (``parent_rank``); written back to every scene of the parent."""
    means = scenes.groupBy(parent).agg(F.round(F.avg(rank), digits).alias("parent_mean"))
    return scenes.join(ordinal(means, [F.asc("parent_mean"), F.asc(parent)], "parent_rank"), parent)


def lookup(items: DataFrame, known: DataFrame, on: list[str], value: str, missing: Column) -> DataFrame:
    """A left lookup: ``value`` of the row of ``known`` with equal keys, else ``missing``."""
    return items.join(known.dropDuplicates(on), on, "left").withColumn(value, F.coalesce(value, missing))
