"""Queries over the forms of names and values, the helpers of components, and ranks that scenes take from their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import graph as G
from quillon.operators import items as I
from quillon.plans import cluster_queries as C
from quillon.plans.cluster_queries import ISLANDS, RANKS
from quillon.plans.registered import query, table

#: Names that ``exact_names`` looks up.
WANTED = ["red widget", "small ring", "hot", "blue bolt "]
DEMANGLED = "p_name || repeat('<' || p_brand, p_size % 4) || repeat('>', p_size % 4) || '(' || repeat('f(int, ', p_size % 3) || repeat(')', p_size % 3) || ')' || CASE WHEN p_size % 2 = 0 THEN ' const' ELSE '' END"
LINE = "string_split(a, chr(10))[-1]"


@query("SELECT p_partkey, p_name AS stripped FROM part")
def strip_demangled(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"{DEMANGLED} AS name").select("p_partkey", S.strip_name(F.col("name")).alias("stripped"))


@query(f"""SELECT p_partkey, list_reduce(string_split(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size, ' '),
  lambda a, w: CASE WHEN length({LINE}) + 1 + length(w) <= 14 THEN a || ' ' || w ELSE a || chr(10) || w END) AS label FROM part""")
def wrap_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.wrapped_words(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string")), 14).alias("label"))


@query("SELECT p_partkey, 'map<' || p_name || ',list<' || p_brand || '>>' AS squeezed FROM part")
def squeeze_names(spark, sf):
    spaced = F.concat(F.lit("map<"), "p_name", F.lit(", list<"), "p_brand", F.lit("> >"))
    return table(spark, sf, "part").select("p_partkey", S.squeezed(spaced).alias("squeezed"))


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 9 THEN p_name[:8] || '…' ELSE p_name END AS label FROM part")
def truncate_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.truncated(F.col("p_name"), 9).alias("label"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name = 'red widget' OR p_name = 'small ring'")
def exact_names(spark, sf):
    return table(spark, sf, "part").where(S.named(F.col("p_name"), WANTED)).select("p_partkey", "p_name")


TEXTS = "CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '-' || p_size || '.25' WHEN 2 THEN p_brand ELSE p_size || 'e2' END"


@query(f"""WITH v AS (SELECT p_partkey, {TEXTS} AS v FROM part), k AS (SELECT *, CASE WHEN v.v SIMILAR TO '[+-]?[0-9]+' THEN 'int' WHEN try_cast(v.v AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind FROM v)
  SELECT p_partkey, kind, CASE WHEN kind = 'int' THEN v::BIGINT END AS as_int, CASE WHEN kind = 'float' THEN v::DOUBLE END AS as_float, CASE WHEN kind = 'str' THEN v END AS as_text FROM k""")
def convert_values(spark, sf):
    v = table(spark, sf, "part").selectExpr("p_partkey", TEXTS.replace("::VARCHAR", "::STRING") + " AS v")
    return v.select("p_partkey", S.sniffed(F.col("v")).alias("kind"), S.converted(F.col("v")).alias("c")).select("p_partkey", "kind", "c.*")


@query("""WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT l_partkey, n || '×' AS label, round((pow(10.0, n / max(n) OVER ()) - 1) / 9, 9) AS weight FROM n""")
def call_labels(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))  # one row
    return n.join(F.broadcast(most)).select("l_partkey", S.times(F.col("n")).alias("label"), F.round(S.skewed(F.col("n") / F.col("most"), 10.0), 9).alias("weight"))


def components(spark, sf):
    return C.event_components(spark, sf).select(F.col("event_id").alias("node"), F.col("cluster_id").alias("component"))


@query(f"""WITH {ISLANDS}, e AS (SELECT event_id AS a, event_id + 1 AS b FROM events)
  SELECT e.a, e.b, coalesce(x.cluster_id = y.cluster_id, FALSE) AS connected FROM e LEFT JOIN i x ON x.event_id = e.a LEFT JOIN i y ON y.event_id = e.b""")
def connected_events(spark, sf):
    pairs = table(spark, sf, "events").select(F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"))
    return G.connected(pairs, components(spark, sf))


@query(f"""WITH {ISLANDS}, f AS (SELECT user_id, min(event_id) AS node FROM i GROUP BY 1)
  SELECT f.node, y.event_id AS member FROM f JOIN i x ON x.event_id = f.node JOIN i y ON y.cluster_id = x.cluster_id""")
def component_members(spark, sf):
    found = C.event_components(spark, sf)
    asked = found.groupBy("user_id").agg(F.min("event_id").alias("node"))
    return G.component_of(asked, found.select(F.col("event_id").alias("node"), F.col("cluster_id").alias("component")))


@query(f"WITH {ISLANDS} SELECT count(*) AS n_elts, count(DISTINCT cluster_id) AS n_comps FROM i")
def component_counters(spark, sf):
    return G.counters(components(spark, sf))


@query(f"""WITH {RANKS}, parent_means AS (SELECT user_id, round(avg(total_rank), 6) AS parent_mean FROM t GROUP BY 1),
  parent_ranks AS (SELECT *, row_number() OVER (ORDER BY parent_mean, user_id) - 1 AS parent_rank FROM parent_means)
  SELECT t.cluster_id, user_id, parent_mean, parent_rank FROM t JOIN parent_ranks USING (user_id)""")
def scene_rank_by_event(spark, sf):
    return I.ranked_by_parent(C.fused(spark, sf), "user_id").select("cluster_id", "user_id", "parent_mean", "parent_rank")
