"""Queries over items: pairs in a time band, calendar, density, proportions, ranks' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import items as I
from quillon.plans.registered import query, table

BAND = 96 * 3600


def events(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, user_id, ts, us, event_type, value and k, the entry ``k`` of the attribute map or 0."""
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", "user_id", "ts", S.micros("ts").alias("us"), "event_type", "value", S.get_or(props, "k").alias("k"))


E_SQL = "SELECT *, epoch_us(ts) AS us, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events"
CAL_SQL = """SELECT day::DATE AS day, CASE WHEN day(day) IN (1, 15) THEN 2 WHEN isodow(day) > 5 THEN 1 ELSE 0 END AS flag
  FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events)::TIMESTAMP, (SELECT max(ts)::DATE FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS day)"""


@query(f"""WITH e AS ({E_SQL}) SELECT l.user_id, l.event_id AS first_id, r.event_id AS second_id, abs(l.us - r.us) / 1e6 AS delta_seconds,
  abs(l.ts::DATE - r.ts::DATE)::INT AS delta_day,
  abs(hour(l.ts) * 3600 + minute(l.ts) * 60 + second(l.ts) - hour(r.ts) * 3600 - minute(r.ts) * 60 - second(r.ts))::INT AS delta_sec_in_day,
  round(abs(l.value - r.value), 6) AS delta_value, abs(l.k - r.k) AS delta_k, round((l.value + r.value) / 2, 6) AS avg_value,
  (l.event_type = r.event_type)::INT AS same_type, (l.event_type = r.event_type AND l.ts::DATE = r.ts::DATE)::INT AS same_type_day
  FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_id <= r.event_id AND abs(l.us - r.us) <= {BAND}::BIGINT * 1000000""")
def pair_band_join(spark, sf):
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    same = F.coalesce(l("event_type") == r("event_type"), F.lit(False))
    return I.band_join(events(spark, sf), "user_id", "event_id", "us", BAND).select(
        l("user_id").alias("user_id"), l("event_id").alias("first_id"), r("event_id").alias("second_id"),
        (F.abs(l("us") - r("us")) / 1e6).alias("delta_seconds"), F.abs(F.datediff(l("ts"), r("ts"))).alias("delta_day"),
        F.abs(S.second_of_day(l("ts")) - S.second_of_day(r("ts"))).alias("delta_sec_in_day"),
        F.round(F.abs(l("value") - r("value")), 6).alias("delta_value"), F.abs(l("k") - r("k")).alias("delta_k"),
        F.round((l("value") + r("value")) / 2, 6).alias("avg_value"), same.cast("int").alias("same_type"),
        (same & (F.to_date(l("ts")) == F.to_date(r("ts")))).cast("int").alias("same_type_day"),
    )


@query(f"""WITH e AS ({E_SQL}) SELECT l.user_id, l.event_id AS first_id, r.event_id AS second_id, abs(l.us - r.us) / 1e6 AS sec,
  abs(l.ts::DATE - r.ts::DATE)::INT AS day, abs(l.k - r.k) AS delta_k
  FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_id < r.event_id AND abs(l.us - r.us) <= 86400000000""")
def pair_band_strict(spark, sf):
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    return I.band_join(events(spark, sf), "user_id", "event_id", "us", 86400, strict=True).select(
        l("user_id").alias("user_id"), l("event_id").alias("first_id"), r("event_id").alias("second_id"), (F.abs(l("us") - r("us")) / 1e6).alias("sec"),
        F.abs(F.datediff(l("ts"), r("ts"))).alias("day"), F.abs(l("k") - r("k")).alias("delta_k"),
    )


@query(f"""WITH c AS ({CAL_SQL}), e AS (SELECT e.*, epoch_us(ts) AS us, flag FROM events e JOIN c ON e.ts::DATE = c.day)
  SELECT l.event_id AS first_id, r.event_id AS second_id, CASE WHEN least(l.flag, r.flag) = greatest(l.flag, r.flag) THEN l.flag
    WHEN least(l.flag, r.flag) = 1 THEN 3 WHEN greatest(l.flag, r.flag) = 1 THEN 4 ELSE 5 END::INT AS holiday_code
  FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_id < r.event_id AND abs(l.us - r.us) <= 86400000000""")
def pair_holiday_code(spark, sf):
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    flagged = e.join(F.broadcast(I.calendar(e)), "day")
    return I.band_join(flagged, "user_id", "event_id", "us", 86400, strict=True).select(
        F.col("l.event_id").alias("first_id"), F.col("r.event_id").alias("second_id"), S.pair_code(F.col("l.flag"), F.col("r.flag")).alias("holiday_code")
    )


@query(f"SELECT event_id, k, 0::DOUBLE AS absent FROM ({E_SQL})")
def map_get_default(spark, sf):
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", S.get_or(props, "k").alias("k"), S.get_or(props, "no such key").alias("absent"))


@query("SELECT user_id, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS seconds FROM events")
def relative_seconds(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", "event_id", I.relative_seconds(e, "user_id", "ts").alias("seconds"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS alt, CASE WHEN label % 2 = 0 THEN embedding[2]::DOUBLE ELSE -embedding[2]::DOUBLE END AS lat,
    embedding[3]::DOUBLE AS lon FROM embeddings)
  SELECT a.vec_id AS first_id, b.vec_id AS second_id, round(sqrt(
    pow((6371 + a.alt) * cos(a.lat) * sin(a.lon) - (6371 + b.alt) * cos(b.lat) * sin(b.lon), 2) + pow((6371 + a.alt) * sin(a.lat) - (6371 + b.alt) * sin(b.lat), 2)
    + pow((6371 + a.alt) * cos(a.lat) * cos(a.lon) - (6371 + b.alt) * cos(b.lat) * cos(b.lon), 2)), 5) AS distance
  FROM p a JOIN p b ON b.vec_id = a.vec_id + 1""")
def chord_distance(spark, sf):
    at = [F.col("embedding")[k].cast("double") for k in range(3)]
    ref = F.when(F.col("label") % 2 == 0, "N").otherwise("S")
    p = table(spark, sf, "embeddings").select("vec_id", at[0].alias("alt"), S.signed(at[1], ref, "N").alias("lat"), at[2].alias("lon"))
    a, b = p.alias("a"), p.alias("b")
    point = lambda s: tuple(F.col(f"{s}.{c}") for c in ("alt", "lat", "lon"))
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(
        F.col("a.vec_id").alias("first_id"), F.col("b.vec_id").alias("second_id"), F.round(S.chord_distance(point("a"), point("b")), 5).alias("distance")
    )


@query("""WITH o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  m AS (SELECT *, CASE WHEN n < c THEN us END AS kept FROM o),
  f AS (SELECT user_id, event_id, count(kept) OVER w AS size, (max(kept) OVER w - min(kept) OVER w) / 1e6 AS span FROM m
    WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT user_id, event_id, round(CASE WHEN size <= 1 THEN 1.0 ELSE size / greatest(span, 1.0) END, 9) AS time_freq FROM f""")
def time_frequency(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "us")
    return I.with_time_frequency(e, "user_id", "us", "event_id").select("user_id", "event_id", F.round("time_freq", 9).alias("time_freq"))


@query(f"""WITH c AS ({CAL_SQL}), n AS (SELECT day, flag, last_value(CASE WHEN flag = 2 THEN day END IGNORE NULLS) OVER (ORDER BY day) AS p,
    first_value(CASE WHEN flag = 2 THEN day END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM c)
  SELECT e.event_id, n.flag::INT AS flag, CASE WHEN p IS NULL THEN a - n.day WHEN a IS NULL THEN n.day - p ELSE least(n.day - p, a - n.day) END::INT AS closest
  FROM events e JOIN n ON e.ts::DATE = n.day""")
def nearest_holiday(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return e.join(F.broadcast(I.nearest_holiday(I.calendar(e))), "day").select("event_id", "flag", "closest")


@query(f"""WITH c AS ({CAL_SQL}), h AS (SELECT day, last_value(CASE WHEN flag = 2 THEN day END IGNORE NULLS) OVER (ORDER BY day) AS p,
    first_value(CASE WHEN flag = 2 THEN day END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM c),
  o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS size,
    count(*) OVER (PARTITION BY user_id, event_type) / count(*) OVER (PARTITION BY user_id) AS prop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  m AS (SELECT *, CASE WHEN n < size THEN us END AS kept FROM o),
  f AS (SELECT *, count(kept) OVER w AS held, (max(kept) OVER w - min(kept) OVER w) / 1e6 AS span FROM m
    WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  e AS (SELECT f.*, CASE WHEN held <= 1 THEN 1.0 ELSE held / greatest(span, 1.0) END AS freq,
    CASE WHEN p IS NULL THEN a - h.day WHEN a IS NULL THEN h.day - p ELSE least(h.day - p, a - h.day) END AS closest FROM f JOIN h ON f.ts::DATE = h.day)
  SELECT l.event_id AS first_id, r.event_id AS second_id, abs(l.closest - r.closest)::INT AS delta_closest, (l.closest + r.closest) / 2.0::DOUBLE AS avg_closest,
    round(abs(l.freq - r.freq), 6) AS delta_freq, round((l.prop + r.prop) / 2, 6) AS avg_prop
  FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_id < r.event_id AND abs(l.us - r.us) <= 86400000000""")
def pair_context_differences(spark, sf):
    """Of each pair: the differences in days to a holiday and in time frequency, the averages of those days and of the types' shares."""
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    near = I.nearest_holiday(I.calendar(e)).select("day", "closest")
    shares = I.proportion(e, "user_id", "event_type").select("user_id", "event_type", "prop")
    known = I.with_time_frequency(e.join(F.broadcast(near), "day"), "user_id", "us", "event_id").join(shares, ["user_id", "event_type"])
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    return I.band_join(known.select("user_id", "event_id", "us", "closest", "time_freq", "prop"), "user_id", "event_id", "us", 86400, strict=True).select(
        l("event_id").alias("first_id"), r("event_id").alias("second_id"), F.abs(l("closest") - r("closest")).alias("delta_closest"),
        ((l("closest") + r("closest")) / 2).alias("avg_closest"), F.round(F.abs(l("time_freq") - r("time_freq")), 6).alias("delta_freq"),
        F.round((l("prop") + r("prop")) / 2, 6).alias("avg_prop"),
    )


@query("""SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS prop
  FROM events GROUP BY user_id, event_type""")
def category_proportion(spark, sf):
    return I.proportion(table(spark, sf, "events"), "user_id", "event_type").withColumn("prop", F.round("prop", 9))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-15), 6) + 0.0 AS z_l_quantity
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def standardize(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return I.standardized(li, "l_suppkey", ["l_quantity"]).select("l_orderkey", "l_linenumber", (F.round("z_l_quantity", 6) + 0.0).alias("z_l_quantity"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS raw FROM orders)
  SELECT o_orderkey, raw, strftime(try_strptime(raw, '%Y:%m:%d %H:%M:%S'), '%Y%m%d') AS date_key, (try_strptime(raw, '%Y:%m:%d %H:%M:%S') IS NULL) AS quarantined FROM o""")
def exif_parse_quarantine(spark, sf):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    o = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("ts", S.parse_exif_time(F.col("raw")))
    return o.select("o_orderkey", "raw", S.date_key(F.col("ts")).alias("date_key"), F.col("ts").isNull().alias("quarantined"))


@query("SELECT doc_id, substr(md5(doc_id::VARCHAR), 1, 4) < 'fae1' AS train FROM documents")
def hash_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.hash_split(F.col("doc_id"), 0.98).alias("train"))


@query("""SELECT c.c_custkey, coalesce(r.r_name || ',' || n.n_name || ',' || n.n_nationkey::VARCHAR, 'Undefined_' || c.c_custkey::VARCHAR) AS city
  FROM customer c LEFT JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3) ON c.c_nationkey = n.n_nationkey""")
def geocode_lookup_left(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = places.select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws(",", "r_name", "n_name", F.col("n_nationkey").cast("string")).alias("city"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return I.lookup(c, known, ["c_nationkey"], "city", F.concat(F.lit("Undefined_"), F.col("c_custkey").cast("string"))).select("c_custkey", "city")


@query("""WITH p AS (SELECT l.event_id AS a, r.event_id AS b FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_id < r.event_id
    AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 3600000000) SELECT DISTINCT e AS event_id FROM (SELECT a AS e FROM p UNION ALL SELECT b FROM p)""")
def distinct_endpoints(spark, sf):
    p = I.band_join(events(spark, sf).select("user_id", "event_id", "us"), "user_id", "event_id", "us", 3600, strict=True)
    return p.select(F.explode(F.array("l.event_id", "r.event_id")).alias("event_id")).distinct()


@query("SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def pair_distinct(spark, sf):
    e = table(spark, sf, "events")
    halves = [e.where(F.col("event_id") % 3 != k).select("user_id", "event_type", F.to_date("ts").alias("day")) for k in range(3)]
    return halves[0].unionByName(halves[1]).unionByName(halves[2]).distinct()


@query("""SELECT user_id, event_id, lag(event_type) OVER w AS previous_type, event_type FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def type_transitions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("previous_type"), "event_type")
