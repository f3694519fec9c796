"""Clustering of items: time islands, one-dimensional density clusters by windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import MICROS
from quillon.operators.items import ordinal
from quillon.session import materialize


def islands(items: DataFrame, group: str, time_us: str, item: str, gap: float, name: str = "cluster_id") -> DataFrame:
    """``items`` with the smallest item of its island: items of a group in time order, cut where the gap exceeds ``gap`` seconds."""
    order = Window.partitionBy(group).orderBy(time_us, item)
    cut = F.coalesce((F.col(time_us) - F.lag(time_us).over(order) > int(gap * MICROS)).cast("int"), F.lit(1))
    numbered = items.withColumn("_cut", cut).withColumn("_n", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn(name, F.min(item).over(Window.partitionBy(group, "_n"))).drop("_cut", "_n")


def density_1d(items: DataFrame, group: str, time_us: str, item: str, eps: float, least: int, name: str = "cluster_id") -> DataFrame:
    """Density clusters on a line: an item with at least ``least`` items (itself included) within ``eps`` seconds is a core;
    cores no more than ``eps`` apart are one cluster, named by its first core's item; another item within ``eps`` of a core
    joins the one before it, else the one after; the rest is noise (null)."""
    width = int(eps * MICROS)
    line = Window.partitionBy(group).orderBy(time_us)
    near = F.count("*").over(line.rangeBetween(-width, width))
    cored = items.withColumn("_core", near >= least)
    order = Window.partitionBy(group).orderBy(time_us, item)
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("_core"), F.col(time_us))
    last = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = cored.withColumn("_start", F.col("_core") & F.coalesce(F.col(time_us) - last > width, F.lit(True)))
    named = starts.withColumn("_name", F.last(F.when(F.col("_start"), F.col(item)), ignorenulls=True).over(before))
    named = named.withColumn("_mine", F.when(F.col("_core"), F.col("_name")))
    at_before, at_after = F.last(own, ignorenulls=True).over(before), F.first(own, ignorenulls=True).over(after)
    label = F.when(F.col(time_us) - at_before <= width, F.last("_mine", ignorenulls=True).over(before)).when(at_after - F.col(time_us) <= width, F.first("_mine", ignorenulls=True).over(after))
    return named.withColumn(name, label).drop("_core", "_start", "_name", "_mine")


def split_1d(
    items: DataFrame, group: str, time_us: str, item: str, eps: float, least: int, min_size: int, max_size: int, max_levels: int = 24
) -> DataFrame:
    """``items`` with scene_id and status: each group of over ``max_size`` items is cut by density on a line (``density_1d``), its
    clusters that are still too large are cut again with half the distance, and so on.

    A scene is chosen from ``min_size`` items on, else unchosen; what a cut leaves out is noise (scene_id null). Items at one
    time cannot be parted: after ``max_levels`` halvings such a scene is chosen as it is. Only groups that are too large
    are read again at a level; each level is a table.
    """
    key, size = "_scene", F.count("*").over(Window.partitionBy("_scene", group))
    status = F.when(F.col("_size") >= min_size, "chosen").otherwise("unchosen")
    now = items.withColumn(key, F.min(item).over(Window.partitionBy(group))).withColumn("_size", size)
    now, done = materialize(now, "split"), []
    for level in range(max_levels):
        done.append(now.where(F.col("_size") <= max_size).select(*items.columns, F.col(key).alias("scene_id"), status.alias("status")))
        large = now.where(F.col("_size") > max_size)
        if large.isEmpty():
            break
        both = F.concat_ws(":", F.col(group).cast("string"), F.col(key).cast("string"))
        cut_ = density_1d(large.withColumn("_both", both), "_both", time_us, item, eps / 2**level, least, "_cut")
        cut_ = materialize(cut_.select(*items.columns, "_cut"), "split")
        done.append(cut_.where("_cut is null").select(*items.columns, F.col("_cut").alias("scene_id"), F.lit("noise").alias("status")))
        now = materialize(cut_.where("_cut is not null").withColumnRenamed("_cut", key).withColumn("_size", size), "split")
    else:
        done.append(now.select(*items.columns, F.col(key).alias("scene_id"), status.alias("status")))
    return reduce(DataFrame.unionByName, done)


def sized(clusters: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """(key, size) of the clusters with ``least`` to ``most`` items."""
    return clusters.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size").between(least, most))


def numbered(items: DataFrame, cluster: str, item: str, name: str = "label") -> DataFrame:
    """``items`` with a number for each: its cluster's 0-based place among the clusters, or, for noise (null), a negative
    number of its own, -1, -2, … in the order of the items."""
    places = ordinal(items.select(cluster).where(F.col(cluster).isNotNull()).distinct(), [F.asc(cluster)], name)
    noise = ordinal(items.where(F.col(cluster).isNull()), [F.asc(item)], "_n")
    own = noise.withColumn(name, -F.col("_n") - 1).drop("_n")
    return items.join(places, cluster).select(*items.columns, name).unionByName(own.select(*items.columns, name))


def weighted_holiday_share(flag: Column) -> Column:
    """Three quarters of the share of weekend items plus one quarter of the share of holiday items."""
    return 0.75 * F.avg((flag == 1).cast("double")) + 0.25 * F.avg((flag == 2).cast("double"))
