"""Queries over clusters of events: components, sizes, means, ranks, density cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import cluster as K
from quillon.operators import graph as G
from quillon.operators import items as I
from quillon.plans.item_queries import CAL_SQL, E_SQL, events
from quillon.plans.registered import query, table

GAP = 4 * 3600
ISLANDS = f"""i AS (SELECT user_id, event_id, event_type, ts, us, min(event_id) OVER (PARTITION BY user_id, n) AS cluster_id FROM (
    SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM (
      SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {GAP}::BIGINT * 1000000 THEN 0 ELSE 1 END AS c FROM ({E_SQL}))))"""
MEANS = f"""{ISLANDS}, cal AS ({CAL_SQL}),
  n AS (SELECT day, flag, last_value(CASE WHEN flag = 2 THEN day END IGNORE NULLS) OVER (ORDER BY day) AS p,
    first_value(CASE WHEN flag = 2 THEN day END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM cal),
  pr AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS prop FROM events GROUP BY user_id, event_type),
  m AS (SELECT i.user_id, cluster_id, count(*) AS size, round(avg(CASE WHEN p IS NULL THEN a - n.day WHEN a IS NULL THEN n.day - p ELSE least(n.day - p, a - n.day) END), 9) AS mean_closest,
    round(avg(prop), 9) AS mean_prop, round(0.75 * avg((flag = 1)::INT) + 0.25 * avg((flag = 2)::INT), 9) AS holiday_freq
    FROM i JOIN n ON i.ts::DATE = n.day JOIN pr ON i.user_id = pr.user_id AND i.event_type = pr.event_type GROUP BY i.user_id, cluster_id)"""
RANKS = f"""{MEANS}, f AS (SELECT *, row_number() OVER (ORDER BY size, cluster_id) - 1 AS rank_size, row_number() OVER (ORDER BY mean_closest DESC, cluster_id DESC) - 1 AS rank_mean_closest,
    row_number() OVER (ORDER BY mean_prop DESC, cluster_id DESC) - 1 AS rank_mean_prop, row_number() OVER (ORDER BY holiday_freq, cluster_id) - 1 AS rank_holiday_freq FROM m),
  t AS (SELECT *, 0.2::DOUBLE * rank_size + 0.2::DOUBLE * rank_mean_closest + 0.2::DOUBLE * rank_mean_prop + 0.2::DOUBLE * rank_holiday_freq AS total_rank FROM f)"""


def clusters(spark, sf) -> DataFrame:
    e = events(spark, sf).select("user_id", "event_id", "event_type", "ts", "us")
    return K.islands(e, "user_id", "us", "event_id", GAP)


def means(spark, sf) -> DataFrame:
    """user_id, cluster_id, size, mean_closest, mean_prop, holiday_freq of each cluster."""
    c = clusters(spark, sf).withColumn("day", F.to_date("ts"))
    days = F.broadcast(I.nearest_holiday(I.calendar(c.select("day"))))
    props = I.proportion(table(spark, sf, "events").select("user_id", "event_type"), "user_id", "event_type").select("user_id", "event_type", "prop")
    full = c.join(days, "day").join(props, ["user_id", "event_type"])
    return full.groupBy("user_id", "cluster_id").agg(
        F.count("*").alias("size"), F.round(F.avg("closest"), 9).alias("mean_closest"), F.round(F.avg("prop"), 9).alias("mean_prop"),
        F.round(K.weighted_holiday_share(F.col("flag")), 9).alias("holiday_freq"),
    )


def fused(spark, sf) -> DataFrame:
    criteria = {"size": (0.2, True), "mean_closest": (0.2, False), "mean_prop": (0.2, False), "holiday_freq": (0.2, True)}
    return I.rank_fusion(means(spark, sf), criteria, "cluster_id")


@query(f"WITH {ISLANDS} SELECT user_id, event_id, cluster_id FROM i")
def event_components(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "us")
    pairs = I.band_join(e, "user_id", "event_id", "us", GAP).select(F.col("l.event_id").alias("src"), F.col("r.event_id").alias("dst"))
    found = G.connected_components(pairs)
    return e.join(found, e["event_id"] == found["node"]).select("user_id", "event_id", F.col("component").alias("cluster_id"))


@query(f"WITH {ISLANDS} SELECT cluster_id, count(*) AS size FROM i GROUP BY cluster_id HAVING count(*) BETWEEN 2 AND 30")
def component_sizes_filtered(spark, sf):
    return K.sized(clusters(spark, sf), "cluster_id", 2, 30)


@query(f"WITH {MEANS} SELECT cluster_id, holiday_freq FROM m")
def cluster_holiday_freq(spark, sf):
    return means(spark, sf).select("cluster_id", "holiday_freq")


@query(f"WITH {MEANS} SELECT cluster_id, size, mean_closest, mean_prop FROM m")
def cluster_means(spark, sf):
    return means(spark, sf).select("cluster_id", "size", "mean_closest", "mean_prop")


@query(f"WITH {ISLANDS} SELECT cluster_id, size, row_number() OVER (ORDER BY size, cluster_id) - 1 AS rank FROM (SELECT cluster_id, count(*) AS size FROM i GROUP BY ALL)")
def rank_asc(spark, sf):
    return I.ordinal(clusters(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("size")), [F.asc("size"), F.asc("cluster_id")], "rank")


@query(f"WITH {MEANS} SELECT cluster_id, mean_closest, row_number() OVER (ORDER BY mean_closest DESC, cluster_id DESC) - 1 AS rank FROM m")
def rank_desc(spark, sf):
    return I.ordinal(means(spark, sf).select("cluster_id", "mean_closest"), [F.desc("mean_closest"), F.desc("cluster_id")], "rank")


@query(f"WITH {RANKS} SELECT cluster_id, rank_size, rank_mean_closest, rank_mean_prop, rank_holiday_freq, round(total_rank, 6) AS total_rank FROM t")
def rank_fusion(spark, sf):
    return fused(spark, sf).select("cluster_id", "rank_size", "rank_mean_closest", "rank_mean_prop", "rank_holiday_freq", F.round("total_rank", 6).alias("total_rank"))


@query(f"WITH {RANKS} SELECT user_id, round(avg(total_rank), 6) AS mean_rank FROM t GROUP BY user_id")
def rank_parent_mean(spark, sf):
    return fused(spark, sf).groupBy("user_id").agg(F.round(F.avg("total_rank"), 6).alias("mean_rank"))


@query(f"WITH {RANKS} SELECT cluster_id, round(total_rank, 6) AS total_rank FROM t ORDER BY round(total_rank, 6) DESC, cluster_id LIMIT 50")
def top_k_clusters(spark, sf):
    return fused(spark, sf).select("cluster_id", F.round("total_rank", 6).alias("total_rank")).orderBy(F.desc("total_rank"), "cluster_id").limit(50)


D_SQL = """c{x} AS (SELECT user_id, event_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING) >= {k} AS core FROM (SELECT *, epoch_us(ts) AS us FROM events)),
  s{x} AS (SELECT *, core AND coalesce(us - last_value(CASE WHEN core THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {w}, TRUE) AS start FROM c{x}),
  n{x} AS (SELECT *, last_value(CASE WHEN start THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS name FROM s{x}),
  d{x} AS (SELECT user_id, event_id,
    CASE WHEN us - last_value(CASE WHEN core THEN us END IGNORE NULLS) OVER b <= {w} THEN last_value(CASE WHEN core THEN name END IGNORE NULLS) OVER b
         WHEN first_value(CASE WHEN core THEN us END IGNORE NULLS) OVER a - us <= {w} THEN first_value(CASE WHEN core THEN name END IGNORE NULLS) OVER a END AS cluster_id
    FROM n{x} WINDOW b AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {D_SQL.format(x='', w=GAP * 1000000, k=4)} SELECT * FROM d")
def scene_split_1d(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "us")
    return K.density_1d(e, "user_id", "us", "event_id", GAP, 4).select("user_id", "event_id", "cluster_id")


HOURS = (2, 4, 8, 16, 32)


@query("WITH " + ", ".join(D_SQL.format(x=f"_{h}", w=h * 3600 * 1000000, k=6) for h in HOURS) + ", a AS (" + " UNION ALL ".join(f"SELECT {h} AS eps, user_id, cluster_id FROM d_{h}" for h in HOURS)
       + """), g AS (SELECT user_id, eps, count(*) - count(cluster_id) AS noise, count(*) AS n, count(DISTINCT cluster_id) + (count(*) > count(cluster_id))::INT AS labels FROM a GROUP BY ALL)
  SELECT user_id, eps, noise FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY noise, eps) AS k FROM g WHERE labels > 1 AND noise < n) WHERE k = 1""")
def best_threshold(spark, sf):
    e = I.dealt(events(spark, sf).select("user_id", "event_id", "us"), "user_id")
    every = None
    for h in HOURS:
        one = K.density_1d(e, "user_id", "us", "event_id", h * 3600, 6).groupBy("user_id").agg(
            F.lit(h).alias("eps"), (F.count("*") - F.count("cluster_id")).alias("noise"), F.count("*").alias("n"),
            (F.countDistinct("cluster_id") + F.when(F.count("*") > F.count("cluster_id"), 1).otherwise(0)).alias("labels"),
        )
        every = one if every is None else every.unionByName(one)
    best = every.where("labels > 1 and noise < n").groupBy("user_id").agg(F.min(F.struct("noise", "eps")).alias("b"))
    return best.select("user_id", "b.eps", "b.noise")


@query("""SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s""")
def session_windows(spark, sf):
    e = table(spark, sf, "events")
    s = e.groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return s.select("user_id", "first_ts", "n")
