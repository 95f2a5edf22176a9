"""Agreement by depth and tree (A23-A29, J12, M1-M11, U2-U4, K10): the steps of rollouts against the children that the
supervised rows give to the same parent or, where they have none for it, to the whole level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import metrics
from graftline.functions.text import username
from graftline.operators import agreement as ag
from graftline.operators.gold import gold_rows
from graftline.plans.record_queries import GOLD, _sound
from graftline.plans.registry import Registry
from graftline.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Steps (step_id, group_id, depth, parent, parsed_output), each once."""
    rows = table(spark, d, "rollout").where("rollout_id IS NOT NULL AND group_id IS NOT NULL AND depth IS NOT NULL")
    return rows.select(F.col("rollout_id").alias("step_id"), "group_id", "depth", username(F.col("input_text")).alias("parent"), "parsed_output").distinct()


def _true(spark: SparkSession, d: str) -> DataFrame:
    """(step_id, group_id, depth, parent, name): the true children of each step."""
    asked = _asked(spark, d).drop("parsed_output")
    gold = gold_rows(_sound(spark, d)).select(F.col("record_id").alias("group_id"), "depth", "parent", F.col("child").alias("name")).distinct()
    strict = asked.join(gold, ["group_id", "depth", "parent"])
    level = asked.join(strict.select("step_id").distinct(), "step_id", "left_anti").join(gold.drop("parent").distinct(), ["group_id", "depth"])
    return strict.unionByName(level)


def items(spark: SparkSession, d: str) -> DataFrame:
    """(step_id, group_id, depth, parent, name, type): what the steps say of each candidate."""
    return _asked(spark, d).select("step_id", "group_id", "depth", "parent", F.explode("parsed_output").alias("i")).select("step_id", "group_id", "depth", "parent", F.col("i.user_name").alias("name"), "i.type")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """names and edges (step_id, group_id, depth, name, child, parent, gold, pred): a row for each true and each predicted child."""
    named = items(spark, d).where("type IN (1, 2) AND name <> ''").drop("type").withColumns({"gold": F.lit(False), "pred": F.lit(True)})
    return named.unionByName(_true(spark, d).withColumns({"gold": F.lit(True), "pred": F.lit(False)})).withColumn("child", F.col("name"))


_STEPS = "(" + GOLD + r""", r AS (SELECT DISTINCT rollout_id AS step_id, group_id, depth, regexp_extract(input_text, '(?im)^\s*username:\s*(.+?)\s*$', 1) AS parent, parsed_output FROM rollout
 WHERE rollout_id IS NOT NULL AND group_id IS NOT NULL AND depth IS NOT NULL), i AS (SELECT step_id, group_id, depth, parent, unnest(parsed_output, recursive := true) FROM r),
st AS (SELECT r.step_id, r.group_id, r.depth, r.parent, g.child FROM r JOIN g ON g.record_id = r.group_id AND g.depth = r.depth AND g.parent = r.parent),
lv AS (SELECT r.step_id, r.group_id, r.depth, r.parent, l.child FROM r JOIN (SELECT DISTINCT record_id, depth, child FROM g) l ON l.record_id = r.group_id AND l.depth = r.depth WHERE r.step_id NOT IN (SELECT step_id FROM st)),
t AS (SELECT * FROM st UNION ALL SELECT * FROM lv) """
S = "WITH s AS " + _STEPS + """SELECT step_id, group_id, depth, parent, child, child AS name, true AS gold, false AS pred FROM t
 UNION ALL SELECT step_id, group_id, depth, parent, user_name, user_name, false, true FROM i WHERE type IN (1, 2) AND user_name <> '')"""
STEPS = S + """, c AS (SELECT step_id, depth, name, count(*) FILTER (gold) AS n_gold, count(*) FILTER (pred) AS n_pred FROM s GROUP BY ALL HAVING count(*) FILTER (gold) + count(*) FILTER (pred) > 0)"""
CELLS = S + """, c AS (SELECT group_id, depth, name, count(*) FILTER (gold) AS n_gold, count(*) FILTER (pred) AS n_pred FROM s GROUP BY ALL HAVING count(*) FILTER (gold) + count(*) FILTER (pred) > 0)"""
EDGES = S + """, c AS (SELECT group_id, child, parent, count(*) FILTER (gold) AS n_gold, count(*) FILTER (pred) AS n_pred FROM s WHERE parent <> '' GROUP BY ALL HAVING count(*) FILTER (gold) + count(*) FILTER (pred) > 0)"""
DEGREES = EDGES + """, g AS (SELECT group_id, node, sum(og) AS out_gold, sum(op) AS out_pred, sum(ig) AS in_gold, sum(ip) AS in_pred FROM (
 SELECT group_id, child AS node, n_gold AS og, n_pred AS op, 0 AS ig, 0 AS ip FROM c UNION ALL SELECT group_id, parent, 0, 0, n_gold, n_pred FROM c) GROUP BY ALL)"""
PRF = "round(tp / (tp + fp + 1e-8), 6) AS p, round(tp / (tp + fn + 1e-8), 6) AS r, round(2 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8)) / (tp / (tp + fp + 1e-8) + tp / (tp + fn + 1e-8) + 1e-8), 6) AS f1"
SET = "sum(least(CAST(n_gold > 0 AS BIGINT), CAST(n_pred > 0 AS BIGINT))) AS tp, sum(CAST(n_pred > 0 AND n_gold = 0 AS BIGINT)) AS fp, sum(CAST(n_gold > 0 AND n_pred = 0 AS BIGINT)) AS fn"
BAG = "sum(least(n_gold, n_pred)) AS tp, sum(greatest(n_pred - n_gold, 0)) AS fp, sum(greatest(n_gold - n_pred, 0)) AS fn"


def _prf(inner: str, keys: str) -> str:
    return f"SELECT {keys}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {PRF} FROM ({inner})"


@query(STEPS + _prf(f"SELECT depth, {SET} FROM c GROUP BY depth", "depth"))
def a26_node_set(spark: SparkSession, d: str) -> DataFrame:
    return ag.by_depth(steps(spark, d), ["name"], bag=False)


@query(STEPS + _prf(f"SELECT depth, {BAG} FROM c GROUP BY depth", "depth"))
def a26_node_bag(spark: SparkSession, d: str) -> DataFrame:
    return ag.by_depth(steps(spark, d), ["name"], bag=True)


@query(S + ", c AS (SELECT step_id, depth, child, parent, count(*) FILTER (gold) AS n_gold, count(*) FILTER (pred) AS n_pred FROM s WHERE parent <> '' GROUP BY ALL)" + _prf(f"SELECT depth, {SET} FROM c GROUP BY depth", "depth"))
def a27_edge_micro(spark: SparkSession, d: str) -> DataFrame:
    return ag.by_depth(steps(spark, d).where("parent <> ''"), ["child", "parent"], bag=False)


@query(STEPS + _prf(f"SELECT depth, {SET} FROM c GROUP BY ROLLUP (depth)", "depth"))
def k10_overall(spark: SparkSession, d: str) -> DataFrame:
    return ag.overall(ag.overlap(ag.counts(steps(spark, d), ["step_id", "depth", "name"]), ["depth"], False))


@query(CELLS + """, t AS (SELECT group_id, depth, sum(least(n_gold, n_pred)) AS s, sum(n_gold) AS g, sum(n_pred) AS p FROM c GROUP BY ALL)
SELECT depth, round(avg(CASE WHEN g = 0 OR p = 0 THEN 0 ELSE 2 * (s / (p + 1e-8)) * (s / (g + 1e-8)) / (s / (p + 1e-8) + s / (g + 1e-8) + 1e-8) END), 6) AS macro_f1, count(*) AS n_trees FROM t GROUP BY ROLLUP (depth)""")
def a25_macro_bag(spark: SparkSession, d: str) -> DataFrame:
    return ag.macro_bag(steps(spark, d))


@query("WITH x AS " + _STEPS + """SELECT i.depth, i.type, EXISTS (SELECT 1 FROM t WHERE t.step_id = i.step_id AND t.child = i.user_name) AS gold FROM i)
SELECT depth, count(*) AS cands, count(*) FILTER (gold) AS gold_pos, count(*) FILTER (NOT gold) AS gold_neg, count(*) FILTER (coalesce(type, 0) = 0) AS t0, count(*) FILTER (type = 1) AS t1, count(*) FILTER (type = 2) AS t2 FROM x GROUP BY depth""")
def a23_panel(spark: SparkSession, d: str) -> DataFrame:
    return ag.panel(items(spark, d), _true(spark, d))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    cells = ag.counts(steps(spark, d), ["step_id", "name"])
    hit, g, p = (F.col("n_gold") > 0) & (F.col("n_pred") > 0), F.col("n_gold") > 0, F.col("n_pred") > 0
    return cells.groupBy("step_id").agg(F.count_if(hit).alias("tp"), F.count_if(g).alias("n_g"), F.count_if(p).alias("n_p"), F.sum(F.least("n_gold", "n_pred")).alias("shared"), F.sum("n_gold").alias("b_g"), F.sum("n_pred").alias("b_p"))


STEP = CELLS.replace("group_id, depth, name", "step_id, name") + """, t AS (SELECT step_id, count(*) FILTER (n_gold > 0 AND n_pred > 0) AS tp, count(*) FILTER (n_gold > 0) AS g, count(*) FILTER (n_pred > 0) AS p,
 sum(least(n_gold, n_pred)) AS s, sum(n_gold) AS bg, sum(n_pred) AS bp FROM c GROUP BY step_id)"""


@query(STEP + "SELECT step_id, round(CASE WHEN g = 0 OR p = 0 THEN 0 ELSE 2 * (tp / (p + 1e-6)) * (tp / (g + 1e-6)) / (tp / (p + 1e-6) + tp / (g + 1e-6) + 1e-6) END, 6) AS f1 FROM t")
def m1_step_f1(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).select("step_id", F.round(metrics.step_f1(F.col("tp"), F.col("n_g"), F.col("n_p")), 6).alias("f1"))


@query(STEP + "SELECT step_id, round(CASE WHEN g = 0 AND p = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / g) / (tp / p + tp / g) END, 6) AS f1 FROM t")
def m2_turn_f1(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).select("step_id", F.round(metrics.turn_f1(F.col("tp"), F.col("n_g"), F.col("n_p")), 6).alias("f1"))


@query(STEP + "SELECT step_id, round(CASE WHEN bg = 0 OR bp = 0 THEN 0 ELSE 2 * (s / (bp + 1e-8)) * (s / (bg + 1e-8)) / (s / (bp + 1e-8) + s / (bg + 1e-8) + 1e-8) END, 6) AS f1 FROM t")
def m3_bag_f1(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).select("step_id", F.round(metrics.bag_f1(F.col("shared"), F.col("b_g"), F.col("b_p")), 6).alias("f1"))


@query(EDGES + "SELECT group_id, child, parent, n_gold, n_pred FROM c")
def a28_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return ag.edge_weights(steps(spark, d))


@query(S + ", c AS (SELECT group_id, least(child, parent) AS child, greatest(child, parent) AS parent, count(*) FILTER (gold) AS n_gold, count(*) FILTER (pred) AS n_pred FROM s WHERE parent <> '' GROUP BY ALL) SELECT * FROM c WHERE n_gold + n_pred > 0")
def a28_edge_weights_undirected(spark: SparkSession, d: str) -> DataFrame:
    return ag.edge_weights(steps(spark, d), directed=False)


@query(DEGREES + "SELECT group_id, node, CAST(out_gold AS BIGINT) AS out_gold, CAST(out_pred AS BIGINT) AS out_pred, CAST(in_gold AS BIGINT) AS in_gold, CAST(in_pred AS BIGINT) AS in_pred FROM g")
def a29_degrees(spark: SparkSession, d: str) -> DataFrame:
    return ag.degrees(ag.edge_weights(steps(spark, d)))


@query(EDGES + f""", t AS (SELECT group_id, round(sqrt(sum((n_gold - n_pred) * (n_gold - n_pred))) / (sqrt(sum(n_gold * n_gold)) + 1e-8), 6) AS rel_error,
 round(coalesce(abs(sum(n_pred) / nullif(count(*) FILTER (n_pred > 0), 0) - sum(n_gold) / nullif(count(*) FILTER (n_gold > 0), 0)) / (sum(n_gold) / nullif(count(*) FILTER (n_gold > 0), 0)), 0), 6) AS mean_diff,
 {SET} FROM c GROUP BY group_id)
SELECT group_id, rel_error, mean_diff, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {PRF} FROM t""")
def m5_m6_m11_weight_errors(spark: SparkSession, d: str) -> DataFrame:
    return ag.weight_errors(ag.edge_weights(steps(spark, d)))


@query(DEGREES + """, h AS (SELECT group_id, out_gold / greatest(sum(out_gold) OVER w, 1) AS a, out_pred / greatest(sum(out_pred) OVER w, 1) AS b FROM g WINDOW w AS (PARTITION BY group_id))
SELECT group_id, round(0.5 * sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END), 6) AS jsd FROM h GROUP BY group_id""")
def m7_divergence(spark: SparkSession, d: str) -> DataFrame:
    return ag.divergence(ag.degrees(ag.edge_weights(steps(spark, d))), "out_gold", "out_pred")


@query(DEGREES + """, r AS (SELECT group_id, rank() OVER (PARTITION BY group_id ORDER BY out_gold) + (count(*) OVER (PARTITION BY group_id, out_gold) - 1) / 2.0 AS x,
 rank() OVER (PARTITION BY group_id ORDER BY out_pred) + (count(*) OVER (PARTITION BY group_id, out_pred) - 1) / 2.0 AS y FROM g),
v AS (SELECT group_id, sum(x * y) - sum(x) * sum(y) / count(*) AS cov, sum(x * x) - sum(x) * sum(x) / count(*) AS vx, sum(y * y) - sum(y) * sum(y) / count(*) AS vy FROM r GROUP BY group_id)
SELECT group_id, round(CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN cov / sqrt(vx * vy) ELSE 0 END, 6) AS rho FROM v""")
def m8_spearman(spark: SparkSession, d: str) -> DataFrame:
    return ag.spearman(ag.degrees(ag.edge_weights(steps(spark, d))), "out_gold", "out_pred")


@query(DEGREES + """, h AS (SELECT group_id, in_gold AS v, sum(in_gold) OVER (PARTITION BY group_id ORDER BY in_gold ROWS UNBOUNDED PRECEDING) AS c FROM g)
SELECT group_id, round(coalesce(2 * sum(c) / nullif(count(*) * sum(v), 0) - (count(*) + 1) / count(*), 0), 6) AS gini FROM h GROUP BY group_id""")
def m9_gini(spark: SparkSession, d: str) -> DataFrame:
    return ag.gini(ag.degrees(ag.edge_weights(steps(spark, d))), "in_gold", ["group_id"])


@query(DEGREES + """, e AS (SELECT group_id, in_gold AS v, 1 AS a, 0 AS b FROM g UNION ALL SELECT group_id, in_pred, 0, 1 FROM g), f AS (SELECT group_id, v, sum(a) AS a, sum(b) AS b FROM e GROUP BY ALL),
h AS (SELECT group_id, abs(sum(a) OVER u / sum(a) OVER w - sum(b) OVER u / sum(b) OVER w) AS gap FROM f WINDOW u AS (PARTITION BY group_id ORDER BY v ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY group_id))
SELECT group_id, round(max(gap), 6) AS ks FROM h GROUP BY group_id""")
def m10_ks(spark: SparkSession, d: str) -> DataFrame:
    return ag.ks_distance(ag.degrees(ag.edge_weights(steps(spark, d))), "in_gold", "in_pred", ["group_id"])


@query(S + "SELECT group_id, count(DISTINCT name) FILTER (gold) AS n_gold, count(DISTINCT name) FILTER (pred) AS n_pred FROM s GROUP BY group_id")
def u2_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of each side of a tree."""
    return steps(spark, d).groupBy("group_id").agg(F.count_distinct(F.when(F.col("gold"), F.col("name"))).alias("n_gold"), F.count_distinct(F.when(F.col("pred"), F.col("name"))).alias("n_pred"))


@query(S + "SELECT group_id, name FROM s WHERE gold INTERSECT ALL SELECT group_id, name FROM s WHERE pred")
def u3_bag_intersection(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d)
    return rows.where("gold").select("group_id", "name").intersectAll(rows.where("pred").select("group_id", "name"))


@query(S + "SELECT group_id, name FROM s WHERE gold EXCEPT ALL SELECT group_id, name FROM s WHERE pred")
def u3_bag_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d)
    return rows.where("gold").select("group_id", "name").exceptAll(rows.where("pred").select("group_id", "name"))


@query(S + "SELECT depth FROM s WHERE gold UNION SELECT depth FROM s WHERE pred")
def u4_depths(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d)
    return rows.where("gold").select("depth").union(rows.where("pred").select("depth")).distinct()


@query(S + """, g AS (SELECT group_id, child, parent, count(*) AS n FROM s WHERE gold GROUP BY ALL), p AS (SELECT group_id, child, parent, count(*) AS n FROM s WHERE pred GROUP BY ALL)
SELECT group_id, child, parent, coalesce(g.n, 0) AS n_gold, coalesce(p.n, 0) AS n_pred FROM g FULL JOIN p USING (group_id, child, parent)""")
def j12_edges_outer(spark: SparkSession, d: str) -> DataFrame:
    keys = ["group_id", "child", "parent"]
    rows = steps(spark, d)
    g, p = (rows.where(k).groupBy(*keys).agg(F.count("*").alias(f"n_{k}")) for k in ("gold", "pred"))
    return g.join(p, keys, "full").na.fill(0, ["n_gold", "n_pred"])
