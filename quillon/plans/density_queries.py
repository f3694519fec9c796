"""Queries of density clusters by reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import density as D
from quillon.operators.items import standardized
from quillon.plans.item_queries import events
from quillon.plans.registered import query, table

LEAST, MOST = 10, 30


def _level(d: str) -> str:
    k = f"ceil(least({d}, 2) * 100)"
    return f"least(100, {k} - (({k} - 1) / 100 >= {d})::INT + ({k} / 100 < {d})::INT)::INT"


def cut_sql(given: str, x: int, columns: list[str], least: int) -> str:
    """Tables by which ``cut{x}`` has (event, node, item, columns, cluster) of the rows of ``given`` (event, node, item, columns).

    Levels of all pairs give the level of each core and of each placed point, these the noise at each level. Noise that is not
    0 is a label beside any cluster, so clusters are counted only at levels without noise; the lowest of the best levels wins.
    """
    z = ", ".join(f"round(({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-15), 9) AS z_{c}" for c in columns)
    far = _level("sqrt(" + " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in columns) + ")")
    gap = "sqrt(" + " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in columns) + ")"
    if len(columns) == 1:  # on a line cores next to each other are joined, or a cluster ends
        clusters = f"""h{x} AS MATERIALIZED (SELECT m.node, m.t, item, z_{columns[0]} AS z FROM m{x} m JOIN k{x} k ON k.node = m.node AND k.core <= m.t JOIN z{x} z USING (item)),
  v{x} AS MATERIALIZED (SELECT *, coalesce({_level(f"z - lag(z) OVER (PARTITION BY node, t ORDER BY z, item)")} <= t, FALSE) AS joined FROM h{x}),
  u{x} AS MATERIALIZED (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY node, t ORDER BY z, item) AS part FROM v{x}),
  g{x} AS MATERIALIZED (SELECT node, t, item, min(item) OVER (PARTITION BY node, t, part) AS cluster FROM u{x})"""
    else:
        clusters = f"""e{x} AS MATERIALIZED (SELECT m.node, m.t, a, b FROM d{x} JOIN m{x} m USING (node) JOIN k{x} p ON p.node = m.node AND p.item = a AND p.core <= t JOIN k{x} q ON q.node = m.node AND q.item = b AND q.core <= t WHERE lev <= t),
  c{x} AS (SELECT m.node, m.t, item, item AS root FROM m{x} m JOIN k{x} k ON k.node = m.node AND k.core <= m.t UNION SELECT e.node, e.t, e.b, root FROM c{x} c JOIN e{x} e ON e.node = c.node AND e.t = c.t AND e.a = c.item),
  g{x} AS MATERIALIZED (SELECT node, t, item, min(root) AS cluster FROM c{x} GROUP BY ALL)"""
    return f"""z{x} AS MATERIALIZED (SELECT *, {z} FROM {given} WINDOW w AS (PARTITION BY node)),
  d{x} AS MATERIALIZED (SELECT a.node, a.item AS a, b.item AS b, {gap} AS d, {far} AS lev FROM z{x} a JOIN z{x} b ON a.node = b.node AND a.item <> b.item),
  k{x} AS MATERIALIZED (SELECT node, a AS item, coalesce(list_sort(list(lev))[{least - 1}], 100) AS core FROM d{x} GROUP BY ALL),
  r{x} AS MATERIALIZED (SELECT node, a AS item, min({{'lev': greatest(lev, core), 'd': d, 'item': b}}) AS r FROM d{x} JOIN k{x} USING (node) WHERE d{x}.b = k{x}.item GROUP BY ALL),
  p{x} AS MATERIALIZED (SELECT k.node, k.item, core, r.lev AS reach, r.item AS via FROM k{x} k JOIN r{x} USING (node, item)),
  t{x} AS MATERIALIZED (SELECT node, t, count(*) AS n, count(*) FILTER (WHERE least(core, reach) > t) AS noise FROM p{x}, (SELECT unnest(range(0, 100)) AS t) GROUP BY ALL),
  f{x} AS MATERIALIZED (SELECT * FROM t{x} WHERE noise < n),
  m{x} AS MATERIALIZED (SELECT node, t, noise FROM f{x} WHERE noise = 0 UNION ALL
    SELECT node, min(t), noise FROM f{x} WHERE noise > 0 GROUP BY node, noise QUALIFY noise = min(noise) OVER (PARTITION BY node)),
  {clusters},
  b{x} AS MATERIALIZED (SELECT node, t FROM (SELECT m.node, m.t, noise, count(DISTINCT cluster) + (noise > 0)::INT AS labels FROM m{x} m JOIN g{x} g ON g.node = m.node AND g.t = m.t GROUP BY m.node, m.t, noise)
    WHERE labels > 1 QUALIFY row_number() OVER (PARTITION BY node ORDER BY noise, t) = 1),
  cut{x} AS MATERIALIZED (SELECT i.*, g.cluster FROM {given} i JOIN p{x} p ON p.node = i.node AND p.item = i.item LEFT JOIN b{x} b ON b.node = i.node
    LEFT JOIN g{x} g ON g.node = i.node AND g.t = b.t AND g.item = CASE WHEN core <= b.t THEN p.item WHEN reach <= b.t THEN via END)"""


def scenes_sql(items: str, columns: list[str]) -> str:
    """Recursive splitting of ``items`` (event, item, columns), all sets of a level at once."""
    names = ", ".join(columns)
    whole = f"SELECT event, min(item) OVER w AS node, item, count(*) OVER w AS size, FALSE AS noise, {names} FROM ({items}) WINDOW w AS (PARTITION BY event)"
    again = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT event, node, item, {names} FROM s WHERE size > {MOST} AND NOT noise), {cut_sql("l", 0, columns, LEAST)}
      SELECT event, min(item) OVER w AS node, item, count(*) OVER w AS size, cluster IS NULL AS noise, {names} FROM cut0 WINDOW w AS (PARTITION BY node, cluster)"""
    status = f"CASE WHEN noise THEN 'noise' WHEN size >= {LEAST} THEN 'chosen' ELSE 'unchosen' END AS status"
    return f"WITH RECURSIVE s AS ({whole} UNION ALL SELECT * FROM ({again})) SELECT event, node AS scene_id, {status}, item FROM s WHERE noise OR size <= {MOST}"


VECTORS = "SELECT label AS event, vec_id AS item, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS x{k}" for k in range(4)) + " FROM embeddings"
TIMES = "SELECT user_id AS event, event_id AS item, epoch_us(ts)::DOUBLE AS x0 FROM events"
SPACE = ["x0", "x1", "x2", "x3"]


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("label", "vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(SPACE)])


@query(f"SELECT event AS label, scene_id, status, item AS vec_id FROM ({scenes_sql(VECTORS, SPACE)})")
def scene_split_4d(spark, sf):
    return D.scenes(vectors(spark, sf), "label", "vec_id", SPACE, LEAST, MOST)


@query(f"SELECT event AS user_id, scene_id, status, item AS event_id FROM ({scenes_sql(TIMES, ['x0'])})")
def scene_split_time(spark, sf):
    return D.scenes(events(spark, sf).select("user_id", "event_id", "us"), "user_id", "event_id", ["us"], LEAST, MOST)


def _standard(items: DataFrame, key: str, item: str, columns: list[str]) -> DataFrame:
    z = standardized(items, key, columns)
    return z.select(key, item, *[F.round(f"z_{c}", 9).alias(c) for c in columns])



@query(f"WITH RECURSIVE i AS (SELECT event, 0 AS node, item, x0, x1, x2, x3 FROM ({VECTORS})), {cut_sql('i', 0, SPACE, LEAST)} SELECT item AS vec_id, cluster AS cluster_id FROM cut0")
def reach_cut_space(spark, sf):
    z = _standard(vectors(spark, sf).withColumn("all", F.lit(0)), "all", "vec_id", SPACE)
    return D.space_labels(z, "all", "vec_id", SPACE, LEAST).select("vec_id", F.col("cluster").alias("cluster_id"))


@query(f"WITH RECURSIVE i AS (SELECT event, event AS node, item, x0 FROM ({TIMES})), {cut_sql('i', 0, ['x0'], LEAST)}, "
       "n AS (SELECT *, min(item) OVER (PARTITION BY node, cluster) AS name FROM cut0) SELECT event AS user_id, item AS event_id, CASE WHEN cluster IS NOT NULL THEN name END AS cluster_id FROM n")
def reach_cut_time(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", F.col("us").cast("double").alias("us"))
    found = D.line_labels(_standard(e, "user_id", "event_id", ["us"]), "user_id", "event_id", "us", LEAST, in_one_task=1500)
    names = found.groupBy("user_id", "cluster").agg(F.min("event_id").alias("name")).where("cluster is not null")
    return found.join(names, ["user_id", "cluster"], "left").select("user_id", "event_id", F.col("name").alias("cluster_id"))
