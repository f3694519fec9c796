"""Queries that compare clusterings and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import evaluate as V
from quillon.plans.registered import query, table


def assigned(spark, sf):
    """vec_id with its true label and a cell of the first two coordinates as the found cluster."""
    cell = F.floor(F.col("embedding")[0].cast("double") * 8) * 100 + F.floor(F.col("embedding")[1].cast("double") * 8)
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("gt"), cell.cast("long").alias("alg"))


A_SQL = """x AS (SELECT vec_id, label AS gt, (floor(embedding[1]::DOUBLE * 8) * 100 + floor(embedding[2]::DOUBLE * 8))::BIGINT AS alg FROM embeddings)"""
C_SQL = f"""{A_SQL}, cells AS (SELECT alg, gt, count(*) AS both_n FROM x GROUP BY ALL),
  sims AS (SELECT *, sum(both_n) OVER (PARTITION BY alg) AS size_a, sum(both_n) OVER (PARTITION BY gt) AS size_b, both_n / (sum(both_n) OVER (PARTITION BY gt) + 1e-6) AS sim FROM cells),
  best AS (SELECT *, row_number() OVER (ORDER BY sim DESC, alg, gt) AS rn FROM sims),
  kept AS (SELECT alg, arg_max(gt, rn) AS gt FROM best WHERE rn <= (SELECT count(DISTINCT alg) FROM cells) GROUP BY alg),
  matched AS (SELECT a.alg, kept.gt FROM (SELECT DISTINCT alg FROM cells) a LEFT JOIN kept USING (alg)),
  prf AS (SELECT m.alg, m.gt, coalesce(both_n / (size_a + 1e-6), 0) AS p, coalesce(both_n / (size_b + 1e-6), 0) AS r FROM matched m LEFT JOIN sims s ON m.alg = s.alg AND m.gt = s.gt)"""


@query(f"WITH {C_SQL} SELECT alg, gt, both_n AS both, round(sim, 9) AS sim FROM sims")
def containment_similarity(spark, sf):
    return V.containment(assigned(spark, sf), "alg", "gt").select("alg", "gt", "both", F.round("sim", 9).alias("sim"))


@query(f"WITH {C_SQL} SELECT alg, gt FROM matched")
def greedy_match(spark, sf):
    return V.greedy_match(V.containment(assigned(spark, sf), "alg", "gt"), "alg", "gt")


#: A walk through the cells in their order: a cell is taken if neither its row nor its column is.
ONE_SQL = f"""{C_SQL}, walk AS (
    SELECT 0::BIGINT AS at, []::BIGINT[] AS rows_gone, []::BIGINT[] AS columns_gone, NULL::BIGINT AS alg, NULL::BIGINT AS gt
    UNION ALL SELECT rn, CASE WHEN free THEN list_append(rows_gone, a) ELSE rows_gone END, CASE WHEN free THEN list_append(columns_gone, g) ELSE columns_gone END,
      CASE WHEN free THEN a END, CASE WHEN free THEN g END
    FROM (SELECT best.rn, best.alg AS a, best.gt::BIGINT AS g, rows_gone, columns_gone, NOT list_contains(rows_gone, best.alg) AND NOT list_contains(columns_gone, best.gt::BIGINT) AS free
      FROM walk JOIN best ON best.rn = walk.at + 1))"""


@query(f"WITH RECURSIVE {ONE_SQL} SELECT a.alg, walk.gt::INT AS gt FROM (SELECT DISTINCT alg FROM cells) a LEFT JOIN walk ON walk.alg = a.alg")
def one_to_one_match(spark, sf):
    return V.one_to_one_match(V.containment(assigned(spark, sf), "alg", "gt"), "alg", "gt")


@query(f"WITH {C_SQL} SELECT alg, gt, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r + 1e-6), 9) AS f1 FROM prf")
def match_prf(spark, sf):
    cells = V.containment(assigned(spark, sf), "alg", "gt")
    m = V.match_metrics(cells, V.greedy_match(cells, "alg", "gt"), "alg", "gt")
    return m.select("alg", "gt", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {C_SQL} SELECT alg % 5 AS model, round(avg(2 * p * r / (p + r + 1e-6)), 9) AS f1, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall FROM prf GROUP BY ALL""")
def leaderboard(spark, sf):
    cells = V.containment(assigned(spark, sf), "alg", "gt")
    m = V.match_metrics(cells, V.greedy_match(cells, "alg", "gt"), "alg", "gt").groupBy((F.col("alg") % 5).alias("model")).agg(*[F.round(F.avg(c), 9).alias(c) for c in ("f1", "precision", "recall")])
    return m.orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"))


PAIR = """part AS (SELECT * FROM x), n AS (SELECT gt, alg, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
  s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS tp, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM n GROUP BY gt)) AS a,
    (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM n GROUP BY alg)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM n) AS t)"""


@query(f"""WITH {A_SQL}, {PAIR} SELECT round((tp + t - a - b + tp) / t, 9) AS accuracy, round(tp / b, 9) AS precision, round(tp / a, 9) AS recall,
  round((tp / a + (t - a - b + tp) / (t - a)) / 2, 9) AS auc FROM s""")
def pairwise_metrics(spark, sf):
    m = V.pairwise_metrics(assigned(spark, sf), "gt", "alg")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS fp,
    count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS tn FROM labels)
  SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
    round(((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END)) / 2, 9) AS auc FROM c""")
def confusion_metrics(spark, sf):
    m = V.confusion_metrics(table(spark, sf, "labels"), "quality", "toxic")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("SELECT round(avg((quality = 1)::INT), 9) AS positive FROM labels")
def positive_ratio(spark, sf):
    return table(spark, sf, "labels").agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 9).alias("positive"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_files(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT d.doc_id, d.source FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_files(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH a AS (SELECT user_id, list_distinct(list(event_type)) AS x, list_distinct(list(event_type) FILTER (WHERE value > 90)) AS y FROM events GROUP BY user_id)
  SELECT user_id, len(x)::INT AS n_all, len(coalesce(y, []))::INT AS n_high, len(x) > len(coalesce(y, [])) AS proper_superset FROM a""")
def superset_audit(spark, sf):
    a = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("x"), F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("y"))
    superset = (F.size(F.array_except("y", "x")) == 0) & (F.size("x") > F.size("y"))
    return a.select("user_id", F.size("x").alias("n_all"), F.size("y").alias("n_high"), superset.alias("proper_superset"))
