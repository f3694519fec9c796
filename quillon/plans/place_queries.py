"""Queries over places near items, and over pairs generated in several runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators.places import nearest_place as nearest
from quillon.plans.item_queries import BAND, events
from quillon.plans.registered import query, table
from quillon.session import shared_dir
from quillon.sources.resumable import resumable_pairs

WITHIN_KM = 2000.0
#: Items at the first two components of a vector, places at a rule of the supplier's key; three axes of the globe from angles.
PLACES_SQL = f"""i AS (SELECT vec_id, round(embedding[1]::DOUBLE * 89, 2) AS lat, round(embedding[2]::DOUBLE * 179, 2) AS lon FROM embeddings),
  p AS (SELECT s_name || ',' || coalesce(CASE WHEN s_suppkey % 3 > 0 THEN n_name END, 'district ' || s_suppkey::VARCHAR) || ',' || r_name AS address,
    (s_suppkey * 37 % 171 - 85)::DOUBLE AS lat, (s_suppkey * 91 % 359 - 179)::DOUBLE AS lon
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  d AS (SELECT vec_id, i.lat, i.lon, address, 6371 * sqrt(pow(cos(radians(i.lat)) * sin(radians(i.lon)) - cos(radians(p.lat)) * sin(radians(p.lon)), 2)
    + pow(sin(radians(i.lat)) - sin(radians(p.lat)), 2) + pow(cos(radians(i.lat)) * cos(radians(i.lon)) - cos(radians(p.lat)) * cos(radians(p.lon)), 2)) AS km FROM i, p),
  n AS (SELECT vec_id, address, km FROM d WHERE km <= {WITHIN_KM} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY km, address) = 1)"""


@query(f"""WITH {PLACES_SQL} SELECT vec_id, format('({{:.2f}}, {{:.2f}})', i.lat, i.lon) AS key, coalesce(address, 'Undefined_' || vec_id::VARCHAR) AS city, round(km, 6) AS km
  FROM i LEFT JOIN n USING (vec_id)""")
def nearest_place(spark, sf):
    """Each item's nearest place within 2000 km, its address formatted, and the key of its rounded coordinates."""
    part = lambda k, most: (F.col("embedding")[k].cast("double") * most)
    items = table(spark, sf, "embeddings").select("vec_id", part(0, 89).alias("lat"), part(1, 179).alias("lon"))
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    city = F.when(F.col("s_suppkey") % 3 > 0, F.col("n_name"))
    places = s.select(
        S.address(F.col("s_name"), city, F.concat(F.lit("district "), F.col("s_suppkey").cast("string")), F.col("r_name")).alias("address"),
        (F.col("s_suppkey") * 37 % 171 - 85).cast("double").alias("lat"), (F.col("s_suppkey") * 91 % 359 - 179).cast("double").alias("lon"),
    )
    found = nearest(items, places, "address", "lat", "lon", WITHIN_KM, first_km=250.0)
    name = F.coalesce("address", F.concat(F.lit("Undefined_"), F.col("vec_id").cast("string")))
    return found.select("vec_id", S.rounded_key(F.col("lat"), F.col("lon")).alias("key"), name.alias("city"), F.round("address_km", 6).alias("km"))


@query(f"""SELECT l.user_id, l.event_id AS first_id, r.event_id AS second_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 AS seconds FROM events l JOIN events r
  ON l.user_id = r.user_id AND l.event_id < r.event_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= {BAND}::BIGINT * 1000000""")
def resumed_pairs(spark, sf):
    """Pairs in the band from a run that was stopped after two of its four jobs and one that went on."""
    e = events(spark, sf).select("user_id", "event_id", "us")
    select = [F.col("l.user_id"), F.col("l.event_id").alias("first_id"), F.col("r.event_id").alias("second_id"), (F.abs(F.col("l.us") - F.col("r.us")) / 1e6).alias("seconds")]
    path = f"{shared_dir(spark)}/resumed-pairs-{uuid.uuid4().hex}"
    run = lambda **more: resumable_pairs(e, path, "user_id", "event_id", "us", BAND, select, strict=True, buckets=16, at_once=4, **more)
    run(stop_after=2)
    return run()
