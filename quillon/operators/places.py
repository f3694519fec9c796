"""The nearest known place to each item, by a grid over the globe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import EARTH_KM, xyz
from quillon.session import materialize


def _globe(rows: DataFrame, name: str, lat: str, lon: str) -> DataFrame:
    """(name, x, y, z) of rows with both coordinates, on a globe of radius 1."""
    at = xyz(F.lit(0.0), F.col(lat).cast("double"), F.col(lon).cast("double"), degrees=True, radius=1.0)
    return rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(name).alias(name), *[v.alias(c) for c, v in zip("xyz", at, strict=True)])


def _cells(side: float, shift: tuple[int, int, int] = (0, 0, 0)) -> list[Column]:
    return [(F.floor(F.col(c) * EARTH_KM / side) + d).cast("long").alias(f"cell_{c}") for c, d in zip("xyz", shift, strict=True)]


def nearest_place(items: DataFrame, places: DataFrame, place: str, lat: str, lon: str, within_km: float, first_km: float = 25.0, digits: int = 2) -> DataFrame:
    """``items`` with the place nearest to each and its straight-line distance, ``place`` and ``<place>_km``; null where none lies
    within ``within_km``, or where a coordinate is null. Ties go to the smallest place.

    Items are looked up by their coordinates rounded to ``digits``, so many items at one spot are one search. Spots and places
    meet by cells of a cube grid, a place being written into its cell and the 26 around it. The first round has cells of
    ``first_km``; a spot whose nearest place lies within a cell's side is done, the others go on with cells twice the
    size, until a side reaches ``within_km``. So a dense region is searched by small cells, an empty one by large ones.
    """
    spot = [F.round(F.col(c).cast("double"), digits).alias(n) for c, n in ((lat, "_lat"), (lon, "_lon"))]
    keyed = items.withColumns({"_lat": spot[0], "_lon": spot[1]})
    spots = keyed.select("_lat", "_lon").where("_lat is not null and _lon is not null").distinct().withColumn("_spot", F.struct("_lat", "_lon"))
    left = materialize(_globe(spots, "_spot", "_lat", "_lon"), "spots")
    known = materialize(_globe(places.where(F.col(place).isNotNull()), place, lat, lon).withColumnsRenamed({place: "place"}), "places")
    done, side = [], min(first_km, within_km)
    while True:
        around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
        cells = F.explode(F.array(*[F.struct(*_cells(side, s)) for s in around])).alias("cell")
        spread = known.select("place", F.struct("x", "y", "z").alias("p"), cells).select("place", "p", "cell.*")
        met = left.select("*", *_cells(side)).join(spread, ["cell_x", "cell_y", "cell_z"])
        km = EARTH_KM * F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"p.{c}")) * (F.col(c) - F.col(f"p.{c}")) for c in "xyz"]))
        near = met.select("_spot", F.struct(km.alias("km"), "place").alias("best")).where(F.col("best.km") <= side).groupBy("_spot").agg(F.min("best").alias("best"))
        found = materialize(near, "near-places")
        done.append(found)
        if side >= within_km:
            break
        left = materialize(left.join(found.select("_spot"), "_spot", "left_anti"), "spots")
        if left.isEmpty():
            break
        side = min(side * 2, within_km)
    every = reduce(DataFrame.unionByName, done).select("_spot._lat", "_spot._lon", F.col("best.place").alias(place), F.col("best.km").alias(f"{place}_km"))
    return keyed.join(every, ["_lat", "_lon"], "left").drop("_lat", "_lon")
