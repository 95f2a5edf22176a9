"""Agreement of predicted with true children: sets, multisets and graphs, per step, tree and depth.

Inputs are long tables, one row per name or edge: names(step_id, group_id, depth, name, gold, pred) with two flags, and
edges(step_id, group_id, depth, child, parent, gold, pred). A step is one line of a log; a tree has many, at several depths. Each measure is one or two aggregations with map-side combine on
the keys it needs; no list of a group is ever built, so a tree of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.metrics import LOG_EPS, bag_f1, micro

TREE = ["group_id"]


def counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys with n_gold and n_pred, how often each was true and predicted."""
    return rows.groupBy(*keys).agg(F.count_if("gold").alias("n_gold"), F.count_if("pred").alias("n_pred")).where("n_gold + n_pred > 0")


def overlap(cells: DataFrame, by: list[str], bag: bool) -> DataFrame:
    """tp, fp, fn of each ``by`` from counts of names or edges; as sets every count is one."""
    g, p = (F.col("n_gold"), F.col("n_pred")) if bag else ((F.col("n_gold") > 0).cast("bigint"), (F.col("n_pred") > 0).cast("bigint"))
    return cells.groupBy(*by).agg(F.sum(F.least(g, p)).alias("tp"), F.sum(F.greatest(p - g, F.lit(0))).alias("fp"), F.sum(F.greatest(g - p, F.lit(0))).alias("fn"))


def with_micro(totals: DataFrame) -> DataFrame:
    p, r, f = micro(F.col("tp"), F.col("fp"), F.col("fn"))
    return totals.withColumns({"p": F.round(p, 6), "r": F.round(r, 6), "f1": F.round(f, 6)})


def by_depth(rows: DataFrame, names: list[str], bag: bool) -> DataFrame:
    """Micro precision, recall and F1 per depth: sets or bags of each step by itself, then summed."""
    return with_micro(overlap(counts(rows, ["step_id", "depth", *names]), ["depth"], bag))


def overall(totals: DataFrame) -> DataFrame:
    """Per depth and, with a null depth, over all."""
    return with_micro(totals.rollup("depth").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def macro_bag(rows: DataFrame) -> DataFrame:
    """Mean over trees of the bag F1 per depth, a tree's steps of a depth taken together, and with a null depth over all;
    a tree with an empty side counts as 0."""
    each = overlap(counts(rows, [*TREE, "depth", "name"]), [*TREE, "depth"], True)
    f = bag_f1(F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp"))
    return each.rollup("depth").agg(F.round(F.avg(f), 6).alias("macro_f1"), F.count("*").alias("n_trees"))


def panel(items: DataFrame, true: DataFrame) -> DataFrame:
    """Per depth: items(step_id, depth, name, type), those whose name is in the step's true(step_id, name), the rest, and
    the items of each type; repeated names count each, an unreadable type as 0."""
    known = true.select("step_id", "name").distinct().withColumn("gold", F.lit(True))
    rows = items.join(known, ["step_id", "name"], "left")
    gold, kind = F.coalesce("gold", F.lit(False)), F.coalesce("type", F.lit(0))
    return rows.groupBy("depth").agg(F.count("*").alias("cands"), F.count_if(gold).alias("gold_pos"), F.count_if(~gold).alias("gold_neg"), *[F.count_if(kind == k).alias(f"t{k}") for k in (0, 1, 2)])


def edge_weights(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(group_id, child, parent, n_gold, n_pred): the edges of each tree with their counts."""
    rows = edges.where("parent <> '' AND child IS NOT NULL")
    if not directed:
        rows = rows.withColumns({"child": F.least("child", "parent"), "parent": F.greatest("child", "parent")})
    return counts(rows, [*TREE, "child", "parent"])


def degrees(weights: DataFrame) -> DataFrame:
    """(group_id, node, out_gold, out_pred, in_gold, in_pred): out counts the child side, in the parent side."""
    ends = weights.select("group_id", "n_gold", "n_pred", F.explode(F.array(F.struct(F.col("child").alias("node"), F.lit(True).alias("out")), F.struct(F.col("parent").alias("node"), F.lit(False).alias("out")))).alias("e"))
    sums = {f"{side}_{k}": F.sum(F.when(F.col("e.out") == (side == "out"), F.col(f"n_{k}")).otherwise(0)) for side in ("out", "in") for k in ("gold", "pred")}
    return ends.groupBy("group_id", F.col("e.node").alias("node")).agg(*[c.alias(n) for n, c in sums.items()])


def weight_errors(weights: DataFrame) -> DataFrame:
    """Per tree: relative L2 error of the edge weights, relative difference of their means, edge set P, R and F1."""
    g, p = F.col("n_gold").cast("double"), F.col("n_pred").cast("double")
    hit, n_g, n_p = F.count_if((g > 0) & (p > 0)), F.count_if(g > 0), F.count_if(p > 0)
    out = weights.groupBy(*TREE).agg(
        F.round(F.sqrt(F.sum((g - p) * (g - p))) / (F.sqrt(F.sum(g * g)) + LOG_EPS), 6).alias("rel_error"),
        F.round(F.coalesce(F.try_divide(F.abs(F.try_divide(F.sum(p), n_p) - F.try_divide(F.sum(g), n_g)), F.try_divide(F.sum(g), n_g)), F.lit(0.0)), 6).alias("mean_diff"),
        hit.alias("tp"), (n_p - hit).alias("fp"), (n_g - hit).alias("fn"))
    return with_micro(out)


def divergence(cells: DataFrame, gold: str = "n_gold", pred: str = "n_pred") -> DataFrame:
    """Jensen-Shannon divergence, base 2, of the two count distributions of each tree; empty sides count as all zero."""
    tree = Window.partitionBy(*TREE)
    total = lambda c: F.greatest(F.sum(c).over(tree), F.lit(1))
    shares = cells.select("group_id", (F.col(gold) / total(gold)).alias("a"), (F.col(pred) / total(pred)).alias("b"))
    m = (F.col("a") + F.col("b")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return shares.groupBy(*TREE).agg(F.round(0.5 * F.sum(part("a")) + 0.5 * F.sum(part("b")), 6).alias("jsd"))


def tie_ranks(rows: DataFrame, value: str, by: list[str]) -> Column:
    """Rank of the value within ``by``, ties sharing their mean rank."""
    ordered, equal = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count("*").over(equal) - 1) / 2.0


def spearman(cells: DataFrame, gold: str = "n_gold", pred: str = "n_pred") -> DataFrame:
    """Rank correlation per tree over the union of keys; 0 where a side is constant.

    Ranks need only the distinct values of a tree with their counts: keys are counted by their pair of values first, so
    the windows run over as many rows as a tree has different counts, and the sums are weighted.
    """
    pairs = cells.groupBy(*TREE, F.col(gold).alias("a"), F.col(pred).alias("b")).agg(F.count("*").alias("w"))

    def ranks(side: str, name: str) -> DataFrame:
        of = pairs.groupBy(*TREE, side).agg(F.sum("w").alias("k"))
        before = F.sum("k").over(Window.partitionBy(*TREE).orderBy(side).rowsBetween(Window.unboundedPreceding, -1))
        return of.select(*TREE, side, (F.coalesce(before, F.lit(0)) + (F.col("k") + 1) / 2.0).alias(name))

    rows = pairs.join(ranks("a", "x"), [*TREE, "a"]).join(ranks("b", "y"), [*TREE, "b"])
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    n = F.sum(w)
    cov = F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / n
    vx, vy = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / n, F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / n
    out = rows.groupBy(*TREE).agg(cov.alias("cov"), vx.alias("vx"), vy.alias("vy"))
    return out.select("group_id", F.round(F.when((F.col("vx") > 1e-9) & (F.col("vy") > 1e-9), F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(0.0), 6).alias("rho"))


def gini(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    """2 * sum of running sums / (n * s) - (n + 1) / n: the usual coefficient with its sign turned; 0 for an empty sum."""
    running = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.select(*by, F.col(value).alias("v"), F.sum(value).over(running).alias("c"))
    n, s = F.count("*"), F.sum("v")
    return rows.groupBy(*by).agg(F.round(F.coalesce(2 * F.try_divide(F.sum("c"), n * s) - (n + 1) / n, F.lit(0.0)), 6).alias("gini"))


def ks_distance(cells: DataFrame, gold: str, pred: str, by: list[str]) -> DataFrame:
    """Greatest gap between the two distributions' cumulative shares, over the union of their values."""
    long = cells.select(*by, F.explode(F.array(F.struct(F.col(gold).alias("v"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("v"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("e"))
    at = long.groupBy(*by, F.col("e.v").alias("v")).agg(F.sum("e.g").alias("g"), F.sum("e.p").alias("p"))
    up, whole = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    gap = F.abs(F.sum("g").over(up) / F.sum("g").over(whole) - F.sum("p").over(up) / F.sum("p").over(whole))
    return at.select(*by, gap.alias("gap")).groupBy(*by).agg(F.round(F.max("gap"), 6).alias("ks"))
