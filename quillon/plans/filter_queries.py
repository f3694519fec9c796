"""Queries over name filters, stems, labels and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import callgraph as C
from quillon.operators import cluster as K
from quillon.plans.cluster_queries import D_SQL, GAP
from quillon.plans.graph_queries import P_SQL, graph
from quillon.plans.item_queries import events
from quillon.plans.registered import query, table


@query("SELECT p_partkey, p_type FROM part WHERE p_type GLOB '*A?*' ")
def glob_filter(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_type").where(S.glob(F.col("p_type"), "*A?*"))


@query("SELECT page_id, (url LIKE 'http://blog.%' OR url LIKE 'https://www.%') AS kept FROM pages")
def prefix_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.under_any(F.col("url"), ["http://blog.", "https://www."]).alias("kept"))


@query("""WITH g AS (SELECT DISTINCT c_custkey::VARCHAR AS stem FROM customer WHERE c_acctbal > 0), x AS (SELECT o_custkey::VARCHAR AS stem, count(*) AS n FROM orders GROUP BY 1)
  SELECT g.stem, x.n FROM g JOIN x ON g.stem = x.stem""")
def stem_join(spark, sf):
    gps = table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("in/"), F.col("c_custkey").cast("string"), F.lit("-gps.plist")).alias("path"))
    exif = table(spark, sf, "orders").select(F.concat(F.lit("in/"), F.col("o_custkey").cast("string"), F.lit("-exif.plist")).alias("path"))
    counts = exif.groupBy(S.stem(F.col("path")).alias("stem")).agg(F.count("*").alias("n"))
    return gps.select(S.stem(F.col("path")).alias("stem")).distinct().join(counts, "stem")


@query(f"""WITH {D_SQL.format(x='', w=GAP * 1000000, k=4)} SELECT event_id, CASE WHEN cluster_id IS NOT NULL THEN dense_rank() OVER (PARTITION BY cluster_id IS NULL ORDER BY cluster_id) - 1
    ELSE -row_number() OVER (PARTITION BY cluster_id IS NULL ORDER BY event_id) END AS label FROM d""")
def cluster_labels(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "us")
    found = K.density_1d(e, "user_id", "us", "event_id", GAP, 4).select("event_id", "cluster_id")
    return K.numbered(found, "cluster_id", "event_id").select("event_id", "label")


@query(f"""WITH {P_SQL} SELECT name, round(self / max(self) OVER (), 9) AS weight FROM (
  SELECT leaf AS name, sum(cost) AS self FROM p GROUP BY leaf UNION ALL SELECT DISTINCT mid, 0 FROM p UNION ALL SELECT DISTINCT root, 0 FROM p)""")
def self_time_rescale(spark, sf):
    return C.self_time_weights(graph(spark, sf)[0]).withColumn("weight", F.round("weight", 9))


@query("""SELECT user_id, CASE WHEN count(*) = count(v) THEN round(sum(v), 4) END AS total FROM (SELECT user_id, CASE WHEN value > 0.5 THEN value END AS v FROM events) GROUP BY user_id""")
def complete_sums(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.when(F.col("value") > 0.5, F.col("value")).alias("v"))
    return e.groupBy("user_id").agg(F.round(S.complete_sum(F.col("v")), 4).alias("total"))


@query("""SELECT p_partkey, CASE WHEN length(p_type) > 8 THEN p_type[:8] || chr(10) || p_type[9:16] || CASE WHEN length(p_type) > 16 THEN chr(10) || p_type[17:24] || CASE WHEN length(p_type) > 24 THEN chr(10) || p_type[25:] ELSE '' END ELSE '' END ELSE p_type END AS label FROM part""")
def wrap_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.wrapped(F.col("p_type"), 8).alias("label"))
