"""Queries over parsing: names, paths, stack text, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.plans.cluster_queries import ISLANDS, clusters
from quillon.plans.graph_queries import stacks
from quillon.plans.registered import query, table
from quillon.sources import items as items_source
from quillon.sources import profiles


@query("SELECT page_id, length(regexp_replace(html, '<[^<>]*>', '', 'g'))::INT AS n FROM pages")
def strip_brackets(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^<>]*>", "")).alias("n"))


@query("""SELECT page_id, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host, CASE WHEN regexp_matches(regexp_extract(url, '(\\d+)', 1), '^\\d+$') THEN 'int' ELSE 'str' END AS sniffed FROM pages""")
def path_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1).alias("host"), S.sniffed(F.regexp_extract("url", r"(\d+)", 1)).alias("sniffed"))


@query("""SELECT p_brand AS leaf, o_orderpriority AS root, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def parse_stack_text(spark, sf):
    frame = lambda k, a: F.concat(F.lit(f"  {a} "), F.col("stack")[k], F.lit("+0x1f (/lib/x.so)"))
    text = stacks(spark, sf).select(F.concat_ws("\n", F.lit("app 1 [000] 2.5: cycles:"), frame(0, "7f01"), frame(1, "7f02"), frame(2, "7f03")).alias("block"))
    s = text.select(profiles.perf_stack(F.col("block")).alias("s"))
    return s.groupBy(F.col("s")[0].alias("leaf"), F.element_at("s", -1).alias("root")).agg(F.count("*").alias("n"))


@query("""SELECT 'm!' || p_brand AS leaf, sum(l_quantity) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def parse_xperf_csv(spark, sf):
    line = F.concat(F.lit("[Root]/m!"), F.col("stack")[2], F.lit("/m!"), F.col("stack")[1], F.lit("/m!"), F.col("stack")[0])
    known = F.when(F.col("cost") % 2 == 0, line).otherwise("?")
    s = stacks(spark, sf).select(profiles.xperf_stack(known, F.lit("m"), F.col("stack")[0]).alias("s"), "cost")
    return s.groupBy(F.col("s")[0].alias("leaf")).agg(F.sum("cost").alias("cost"))


@query(f"""WITH {ISLANDS} SELECT cluster_id, '{{"cluster":' || cluster_id || ',"items":[' || string_agg(event_id, ',' ORDER BY event_id) || ']}}' AS value FROM i GROUP BY cluster_id""")
def result_json(spark, sf):
    return items_source.result_json(clusters(spark, sf), "cluster_id", "event_id").drop("part")


@query("""SELECT user_id, CASE WHEN len(l) < 2 THEN array_to_string(l, '') ELSE array_to_string(l[:-2], ', ') || ' or ' || l[-1] END AS types
  FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS l FROM events GROUP BY user_id)""")
def joined_names(spark, sf):
    names = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("l"))
    return names.select("user_id", S.joined(F.col("l")).alias("types"))
