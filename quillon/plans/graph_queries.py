"""Queries over call graphs: part brand, called by part type, called by order priority; and transition graphs of event types."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import callgraph as C
from quillon.operators import graph as G
from quillon.plans.registered import query, table
from quillon.session import materialize


def stacks(spark, sf):
    """A stack (leaf first) and its cost for each line item."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    full = li.join(part, "l_partkey").join(orders, "l_orderkey")
    return full.select(F.array("p_brand", "p_type", "o_orderpriority").alias("stack"), F.col("l_quantity").alias("cost"))


def graph(spark, sf):
    """(nodes, edges) of one summed table of paths, of which there are few; written once, so line items are joined once."""
    paths = materialize(stacks(spark, sf).groupBy("stack").agg(F.sum("cost").alias("cost")), "paths")
    return C.stack_nodes(paths), C.stack_edges(paths)


P_SQL = """p AS (SELECT p_brand AS leaf, p_type AS mid, o_orderpriority AS root, sum(l_quantity) AS cost, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
  e AS (SELECT src, dst, sum(w) AS weight FROM (SELECT mid AS src, leaf AS dst, cost AS w FROM p UNION ALL SELECT root, mid, cost FROM p) GROUP BY ALL),
  r AS (SELECT src, dst, weight, weight / sum(weight) OVER (PARTITION BY dst) AS ratio FROM e),
  leafs AS (SELECT leaf AS name, sum(cost) / sum(sum(cost)) OVER () AS total FROM p GROUP BY leaf),
  mids AS (SELECT r.src AS name, sum(ratio * total) AS total FROM r JOIN leafs ON dst = name GROUP BY r.src),
  roots AS (SELECT r.src AS name, sum(ratio * total) AS total FROM r JOIN mids ON dst = name GROUP BY r.src),
  totals AS (SELECT * FROM leafs UNION ALL SELECT * FROM mids UNION ALL SELECT * FROM roots)"""


@query(f"WITH {P_SQL} SELECT src, dst, weight FROM e")
def callgraph_edges(spark, sf):
    return graph(spark, sf)[1]


@query(f"""WITH {P_SQL} SELECT name, self, round(self / sum(self) OVER (), 9) AS ratio FROM (
  SELECT leaf AS name, sum(cost) AS self FROM p GROUP BY leaf UNION ALL SELECT DISTINCT mid, 0 FROM p UNION ALL SELECT DISTINCT root, 0 FROM p)""")
def self_ratio(spark, sf):
    return C.self_ratios(graph(spark, sf)[0]).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {P_SQL} SELECT src, dst, weight, round(ratio, 9) AS ratio FROM r")
def call_ratios(spark, sf):
    return C.call_ratios(graph(spark, sf)[1]).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {P_SQL} SELECT name, round(total, 9) AS total FROM totals")
def propagate_total(spark, sf):
    return C.propagate(*graph(spark, sf)).withColumn("total", F.round("total", 9))


@query(f"""WITH {P_SQL}, k AS (SELECT * FROM totals WHERE total >= 0.04), w AS (SELECT r.src, r.dst, ratio * t.total AS weight FROM r JOIN totals t ON r.dst = t.name)
  SELECT src, dst, round(weight, 9) AS weight FROM w WHERE weight >= 0.006 AND src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k)""")
def prune_threshold(spark, sf):
    nodes, edges = graph(spark, sf)
    totals = C.propagate(nodes, edges)
    weighed = C.call_ratios(edges).join(totals.withColumnRenamed("name", "dst"), "dst").select("src", "dst", (F.col("ratio") * F.col("total")).alias("weight"))
    return C.prune(totals, weighed, 0.04, 0.006)[1].withColumn("weight", F.round("weight", 9))


@query(f"""WITH {P_SQL}, top AS (SELECT min(root) AS x FROM p) SELECT x AS node, 0 AS depth FROM top
  UNION ALL SELECT DISTINCT dst, 1 FROM e JOIN top ON src = x UNION ALL SELECT DISTINCT b.dst, 2 FROM e a JOIN top ON a.src = x JOIN e b ON b.src = a.dst""")
def descendants(spark, sf):
    edges = graph(spark, sf)[1]
    start = stacks(spark, sf).agg(F.min(F.col("stack")[2]).alias("node"))
    return G.reach(edges, start)


@query(f"WITH {P_SQL}, x AS (SELECT min(leaf) AS x FROM p) SELECT x AS node, 0 AS depth FROM x UNION ALL SELECT DISTINCT src, 1 FROM e JOIN x ON dst = x")
def ancestors(spark, sf):
    edges = graph(spark, sf)[1].select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = stacks(spark, sf).agg(F.min(F.col("stack")[0]).alias("node"))
    return G.reach(edges, start, depth=1)


@query(f"WITH {P_SQL} SELECT src, dst, (dst NOT LIKE '%1%') AS known FROM e")
def validate_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    good, bad = C.validated(nodes.where("name not like '%1%'"), edges)
    return good.select("src", "dst", F.lit(True).alias("known")).unionByName(bad.select("src", "dst", F.lit(False).alias("known")))


@query(f"""WITH {P_SQL}, x AS (SELECT leaf AS name, n FROM p UNION ALL SELECT mid, n FROM p UNION ALL SELECT root, n FROM p)
  SELECT name, sum(n)::BIGINT AS samples, round(sum(n) / (SELECT sum(n) FROM p), 9) AS share FROM x GROUP BY name""")
def stack_presence(spark, sf):
    return C.presence(stacks(spark, sf)).withColumn("share", F.round("share", 9))


def transitions(spark, sf):
    """Edges between (user, event type) nodes for each change of type in a user's time order, from ``start`` on: what a user
    goes back and forth between is a cycle, called once from its start."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_type", F.lag("event_type", 1, "start").over(w).alias("previous"))
    node = lambda c: F.concat(F.col("user_id").cast("string"), F.lit(":"), c)
    return e.where("previous <> event_type").groupBy(node("previous").alias("src"), node("event_type").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


T_SQL = """t AS (SELECT user_id, event_type, lag(event_type, 1, 'start') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events),
  e AS (SELECT user_id || ':' || previous AS src, user_id || ':' || event_type AS dst, count(*) AS weight FROM t WHERE previous <> event_type GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {T_SQL}, reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
  n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
  SELECT n.node, least(n.node, min(x.b)) AS scc FROM n LEFT JOIN (SELECT p.a, p.b FROM reach p JOIN reach q ON p.a = q.b AND p.b = q.a) x ON n.node = x.a GROUP BY n.node""")
def scc_cycles(spark, sf):
    return G.strong_components(transitions(spark, sf))


#: All of a user's types that it comes back to are one cycle with one entry, the first type, or have none before them. Ranks
#: are distances from the entry; along each way that leads away from it shares multiply, and a member's total is what lies at
#: the ends of all its ways.
CYCLE_SQL = f"""WITH RECURSIVE {T_SQL},
  reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
  m AS (SELECT DISTINCT p.a AS x, p.b AS y FROM reach p JOIN reach q ON p.a = q.b AND p.b = q.a),
  n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
  scc AS (SELECT n.node, least(n.node, coalesce(min(m.y), n.node)) AS scc, coalesce(count(DISTINCT m.y), 0) > 1 AS cyclic FROM n LEFT JOIN m ON n.node = m.x GROUP BY n.node),
  own AS (SELECT n.node, coalesce(w, 0) / sum(coalesce(w, 0)) OVER () AS own FROM n LEFT JOIN (SELECT dst, sum(weight) AS w FROM e GROUP BY dst) ON n.node = dst),
  c AS (SELECT e.src, e.dst, weight, a.scc AS a, b.scc AS b, weight / sum(weight) OVER (PARTITION BY e.dst) AS within FROM e JOIN scc a ON e.src = a.node JOIN scc b ON e.dst = b.node),
  x AS (SELECT *, weight / sum(weight) OVER (PARTITION BY b) AS r FROM c WHERE a <> b),
  part AS (SELECT scc AS part, sum(own) AS own FROM own JOIN scc USING (node) GROUP BY scc),
  pr AS (SELECT a, b, sum(r) AS r FROM x GROUP BY a, b),
  down AS (SELECT part AS top, part AS here, 1.0::DOUBLE AS f FROM part UNION ALL SELECT top, b, f * r FROM down JOIN pr ON here = a),
  total AS (SELECT top AS part, sum(f * own) AS total FROM down JOIN part ON here = part GROUP BY top),
  val AS (SELECT o.node, o.own + coalesce(q.more, 0) AS v FROM own o LEFT JOIN (SELECT src, sum(r * total) AS more FROM x JOIN total ON b = part GROUP BY src) q ON o.node = q.src),
  entry AS (SELECT dst AS entry, sum(r) AS r FROM x JOIN scc ON dst = node WHERE cyclic GROUP BY dst),
  walk AS (SELECT entry, entry AS node, 0 AS rank FROM entry UNION SELECT entry, dst, rank + 1 FROM walk JOIN c ON src = node AND a = b WHERE rank < 6),
  ranks AS (SELECT entry, node, min(rank) AS rank FROM walk GROUP BY entry, node),
  away AS (SELECT f.entry, c.src, c.dst, c.within / sum(c.within) OVER (PARTITION BY f.entry, c.dst) AS share FROM c JOIN ranks f ON c.src = f.node
    JOIN ranks t ON c.dst = t.node AND f.entry = t.entry AND t.rank > f.rank WHERE a = b),
  ways AS (SELECT entry, node AS top, node AS here, 1.0::DOUBLE AS f FROM ranks UNION ALL SELECT w.entry, top, dst, f * share FROM ways w JOIN away d ON w.entry = d.entry AND here = d.src),
  inside AS (SELECT top AS node, sum(f * v * r) AS total FROM ways JOIN val ON here = node JOIN entry USING (entry) GROUP BY top)
  SELECT s.node AS name, round(CASE WHEN cyclic THEN coalesce(i.total, 0) ELSE t.total END, 9) AS total
  FROM scc s LEFT JOIN inside i ON s.node = i.node LEFT JOIN total t ON s.scc = t.part"""


@query(CYCLE_SQL)
def cycle_propagate(spark, sf):
    edges = materialize(transitions(spark, sf), "transitions")
    nodes = edges.groupBy(F.col("dst").alias("name")).agg(F.sum("weight").alias("self"))
    roots = edges.select(F.col("src").alias("name")).distinct().join(G.shuffled(nodes), "name", "left_anti").withColumn("self", F.lit(0.0))
    return C.propagate(nodes.unionByName(roots), edges).withColumn("total", F.round("total", 9))


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey > 1 THEN o_orderkey // 2 END AS parent, o_orderstatus <> 'F' AS live FROM orders),
  w AS (SELECT node, parent AS up FROM t UNION ALL SELECT w.node, t.parent FROM w JOIN t ON w.up = t.node WHERE NOT t.live),
  m AS (SELECT w.node, w.up, t.live FROM w LEFT JOIN t ON w.up = t.node)
  SELECT node, max(up) FILTER (WHERE live) AS ancestor FROM m GROUP BY node""")
def nearest_live_ancestor(spark, sf):
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(k.alias("node"), F.when(k > 1, F.floor(k / 2)).alias("parent"), (F.col("o_orderstatus") != "F").alias("live"))
    return G.nearest_ancestor(t)


@query(f"""WITH {P_SQL} SELECT name, printf('%.2f%%', total * 100) AS label FROM totals""")
def format_labels(spark, sf):
    return C.propagate(*graph(spark, sf)).select("name", S.percentage(F.col("total")).alias("label"))


@query(f"""WITH {P_SQL}, c AS (SELECT name, total, 2.0 / 3 * (1 - total) AS h, 0.8 + 0.2 * total AS s, 0.25 + 0.25 * total AS l FROM totals),
  k AS (SELECT name, l, (1 - abs(2 * l - 1)) * s AS ch, (h * 12) % 12 AS k0, (h * 12 + 8) % 12 AS k8, (h * 12 + 4) % 12 AS k4 FROM c),
  v AS (SELECT name, l - ch / 2 * greatest(-1, least(k0 - 3, 9 - k0, 1)) AS r, l - ch / 2 * greatest(-1, least(k8 - 3, 9 - k8, 1)) AS g, l - ch / 2 * greatest(-1, least(k4 - 3, 9 - k4, 1)) AS b FROM k)
  SELECT name, printf('#%02x%02x%02x', floor(r * 255 + 0.5)::INT, floor(g * 255 + 0.5)::INT, floor(b * 255 + 0.5)::INT) AS colour FROM v""")
def color_map(spark, sf):
    return C.propagate(*graph(spark, sf)).select("name", S.hue_colour(F.col("total")).alias("colour"))


@query(f"""WITH {P_SQL}, z AS (SELECT name, total, CASE WHEN name IN (SELECT leaf FROM p) THEN total ELSE 0 END AS self FROM totals)
  SELECT 1 AS block, name, 0 AS kind, '' AS callee, printf('%.2f%%', total * 100) AS shown FROM z
  UNION ALL SELECT 1, src, 1, dst, printf('%.2f%%', ratio * total * 100) FROM r JOIN z ON dst = name
  UNION ALL SELECT 0, '', k, '', NULL FROM (SELECT unnest([0, 1, 2, 3]) AS k) UNION ALL SELECT 2, '', 0, '', NULL""")
def dot_document(spark, sf):
    nodes, edges = graph(spark, sf)
    whole = C.propagate(nodes, edges).join(C.self_ratios(nodes).select("name", F.col("ratio").alias("self")), "name")
    lines = C.dot_document(whole, C.call_ratios(edges))
    return lines.select("at.*", F.nullif(F.regexp_extract("line", r'label="[^%]*?([0-9]+\.[0-9]+%)', 1), F.lit("")).alias("shown"))


@query(f"""WITH {P_SQL} SELECT '"' || src || '" -> "' || dst || '" [label="' || printf('%.2f%%', ratio * 100) || '"];' AS line FROM r
  UNION ALL SELECT '"' || name || '" [label="' || name || chr(92) || 'n' || printf('%.2f%%', total * 100) || '"];' FROM totals""")
def dot_lines(spark, sf):
    nodes, edges = graph(spark, sf)
    totals, calls = C.propagate(nodes, edges), C.call_ratios(edges)
    pct = S.percentage
    a = totals.select(F.concat(S.dot_escape(F.col("name")), F.lit(" [label="), S.dot_escape(F.concat("name", F.lit("\n"), pct(F.col("total")))), F.lit("];")).alias("line"))
    b = calls.select(F.concat(S.dot_escape(F.col("src")), F.lit(" -> "), S.dot_escape(F.col("dst")), F.lit(" [label="), S.dot_escape(pct(F.col("ratio"))), F.lit("];")).alias("line"))
    return a.unionByName(b)
