"""Breadth-first rollouts with a pluggable model.

The frontier of all trees is one table. A depth is one pass: the model is asked for each node's children in batches,
answers are scored against the true children and turned into the next frontier, which is written to the shared folder.
The loop runs depth times on the driver, whatever the number of trees.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions.lenient import canonical_status, checked
from graftline.functions.metrics import failed_as_minus_one, step_f1, turn_f1
from graftline.runtime import Scratch, spread

Model = Callable[[pd.DataFrame], pd.Series]


def load(spec: str) -> Callable:
    """A function named ``module:function``."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def ask(frontier: DataFrame, model: Model) -> DataFrame:
    """frontier with ``preds``, the names the model gives for each node, in order."""
    schema = T.StructType([*frontier.schema.fields, T.StructField("preds", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(preds=model(batch))

    return spread(frontier).mapInPandas(run, schema)


def head_of(depth) -> object:
    """Which classifier head a depth uses: three classes at the root, two below."""
    return F.when(depth == 0, "three").otherwise("two")


def score(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Steps with n_gold, n_pred, tp, f1 and whether the parent is unknown; gold(record_id, depth, parent, child)."""
    steps = answers.select("record_id", "trajectory", "depth", "user", "ord", F.array_distinct("preds").alias("preds"))
    truth = gold.select("record_id", "depth", F.col("parent").alias("user"), "child").distinct()
    have = truth.groupBy("record_id", "depth", "user").agg(F.count("*").alias("n_gold"))
    hits = steps.select("record_id", "trajectory", "depth", "user", "ord", F.explode("preds").alias("child")).join(truth, ["record_id", "depth", "user", "child"], "left_semi")
    tp = hits.groupBy("record_id", "trajectory", "depth", "user", "ord").agg(F.count("*").alias("tp"))
    out = steps.join(have, ["record_id", "depth", "user"], "left").join(tp, ["record_id", "trajectory", "depth", "user", "ord"], "left")
    out = out.withColumns({"parent_missing": F.col("n_gold").isNull(), "n_gold": F.coalesce("n_gold", F.lit(0)), "tp": F.coalesce("tp", F.lit(0)), "n_pred": F.size("preds")})
    return out.withColumn("f1", F.round(step_f1(F.col("tp"), F.col("n_gold"), F.col("n_pred")), 6)).drop("preds")


def rollout(roots: DataFrame, gold: DataFrame, model: Model, depth_limit: int, turns: int, trajectories: int = 1, pool: DataFrame | None = None) -> DataFrame:
    """Scored steps of all trees; roots(record_id, user). At most ``turns`` nodes of a trajectory are asked, in
    breadth-first order; with pool(record_id, user) only its members are expanded."""
    scratch = Scratch(roots.sparkSession, "rollout")
    frontier = roots.select("record_id", F.explode(F.sequence(F.lit(0), F.lit(trajectories - 1))).alias("trajectory"), F.lit(0).alias("depth"), "user", F.lit(None).cast("string").alias("parent"), F.lit(1).cast("bigint").alias("ord"))  # ord: the place in breadth-first order within the depth
    used = roots.select("record_id", F.explode(F.sequence(F.lit(0), F.lit(trajectories - 1))).alias("trajectory"), F.lit(0).cast("bigint").alias("used"))
    steps = None
    for depth in range(depth_limit + 1):
        if depth:
            order = Window.partitionBy("record_id", "trajectory").orderBy("parent_ord", "pos")
            frontier = frontier.withColumn("ord", F.row_number().over(order).cast("bigint")).drop("parent_ord", "pos")
        ranked = frontier.withColumn("turn", F.col("ord"))
        now = ranked.join(used, ["record_id", "trajectory"]).where(F.col("turn") + F.col("used") <= turns).drop("turn", "used")
        answers = scratch.write(ask(now, model))
        scored = scratch.write(score(answers, gold))
        steps = scored if steps is None else steps.unionByName(scored)
        if depth == depth_limit:
            break
        kids = answers.select("record_id", "trajectory", F.lit(depth + 1).alias("depth"), F.posexplode(F.array_distinct("preds")).alias("pos", "child"), F.col("user").alias("parent"), F.col("ord").alias("parent_ord"))
        kids = kids.select("record_id", "trajectory", "depth", F.col("child").alias("user"), "parent", "parent_ord", "pos")
        if pool is not None:
            kids = kids.join(pool.select("record_id", "user").distinct(), ["record_id", "user"], "left_semi").select("record_id", "trajectory", "depth", "user", "parent", "parent_ord", "pos")
        done = answers.groupBy("record_id", "trajectory").agg(F.count("*").alias("n"))
        used = scratch.write(used.join(done, ["record_id", "trajectory"], "left").select("record_id", "trajectory", (F.col("used") + F.coalesce("n", F.lit(0))).alias("used")))
        frontier = scratch.write(kids)
    return steps


def respond(frontier: DataFrame, model: Model) -> DataFrame:
    """frontier with ``output``, the text that the model gives for each node."""
    schema = T.StructType([*frontier.schema.fields, T.StructField("output", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(output=model(batch))

    return spread(frontier).mapInPandas(run, schema)


def children_of(answers: DataFrame, pool: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(record_id, user, content, interests, parent_ord, pos): the named items of sound answers, in order.

    With pool(record_id, user, interests) only its members, with their profiles; at most ``most`` of a node. Without a pool
    every valid name is a child.
    """
    kids = answers.where("status IN ('ok', 'ok_repaired')").select("record_id", F.col("ord").alias("parent_ord"), F.posexplode("items").alias("pos", "i"))
    kids = kids.select("record_id", "parent_ord", "pos", F.trim("i.user_name").alias("user"), F.col("i.content").alias("content")).where("user <> ''")
    if pool is None:
        kids = kids.withColumn("interests", F.array().cast("array<string>"))
    else:
        kids = kids.join(pool.groupBy("record_id", "user").agg(F.max("interests").alias("interests")), ["record_id", "user"])
    if most is not None:
        place = F.row_number().over(Window.partitionBy("record_id", "parent_ord").orderBy("pos"))
        kids = kids.withColumn("place", place).where(F.col("place") <= most).drop("place")
    return kids


def evaluate(roots: DataFrame, levels: DataFrame, model: Model, turns: int, pool: DataFrame | None = None, most_children: int | None = None) -> DataFrame:
    """Steps (record_id, depth, ord, user, status, n_gold, n_pred, tp, f1, reward) of a model that answers with text.

    levels(record_id, depth, child) is the truth of whole levels; a node deeper than the last level takes a turn and is not
    asked. An answer that cannot be read gives a reward of -1 and no children. Rounds go by depth, as long as any record has
    nodes, levels and turns left.
    """
    scratch = Scratch(roots.sparkSession, "evaluate")
    none = F.array().cast("array<string>")
    frontier = scratch.write(roots.select("record_id", "user", F.lit("").alias("content"), none.alias("interests"), F.lit(1).cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("used")))
    n_levels = levels.groupBy("record_id").agg((F.max("depth") + 1).alias("n_levels"))
    truth = levels.select("record_id", "depth", "child").distinct()
    sizes = truth.groupBy("record_id", "depth").agg(F.count("*").alias("n_gold"))
    steps, depth = None, 0
    while True:
        now = frontier.where(F.col("ord") + F.col("used") <= turns).join(n_levels, "record_id").where(F.col("n_levels") > depth).drop("n_levels").withColumn("depth", F.lit(depth))
        answers = scratch.write(respond(now, model).withColumn("c", checked(F.col("output"))).select("*", "c.items", canonical_status(F.col("c.status")).alias("status")).drop("c"))
        if answers.isEmpty():
            return steps if steps is not None else _scored(answers, truth, sizes)
        found = scratch.write(_scored(answers, truth, sizes))
        steps = found if steps is None else steps.unionByName(found)
        used = answers.groupBy("record_id").agg((F.max("used") + F.count("*")).alias("used"))
        kids = children_of(answers, pool, most_children).join(used, "record_id")
        order = Window.partitionBy("record_id").orderBy("parent_ord", "pos")
        frontier = scratch.write(kids.withColumn("ord", F.row_number().over(order).cast("bigint")).select("record_id", "user", "content", "interests", "ord", "used"))
        depth += 1


def _scored(answers: DataFrame, truth: DataFrame, sizes: DataFrame) -> DataFrame:
    names = F.array_distinct(F.transform("items", lambda x: x.user_name))
    hits = answers.select("record_id", "depth", "ord", F.explode(names).alias("child")).join(truth, ["record_id", "depth", "child"], "left_semi").groupBy("record_id", "depth", "ord").agg(F.count("*").alias("tp"))
    out = answers.select("record_id", "depth", "ord", "user", "status", F.size(names).cast("bigint").alias("n_pred")).join(sizes, ["record_id", "depth"], "left").join(hits, ["record_id", "depth", "ord"], "left").na.fill(0, ["n_gold", "tp"])
    f1 = F.when(~F.col("status").startswith("parse_fail"), F.round(turn_f1(F.col("tp"), F.col("n_gold"), F.col("n_pred")), 6))
    return out.withColumn("f1", f1).withColumn("reward", failed_as_minus_one(F.col("status"), F.col("f1")))


def trajectory_rewards(steps: DataFrame, key: str, value: str, spec: str) -> DataFrame:
    """(key, reward): a function named ``module:function`` over the values of each trajectory, which its turn cap bounds."""
    own = load(spec)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [rows[key].iloc[0]], "reward": [own(rows[value])]})

    return steps.select(key, value).groupBy(key).applyInPandas(run, T.StructType([steps.schema[key], T.StructField("reward", T.DoubleType())]))


def mean_reward(values: pd.Series) -> float | None:
    """The mean of the known values, none without any."""
    return None if values.dropna().empty else float(values.mean())


def fixed_model(names: int) -> Model:
    """A stand-in that gives every node the same number of children."""
    return lambda batch: pd.Series([[f"{u}.{k}" for k in range(names)] for u in batch["user"]], index=batch.index)


def hashed_model(names: int = 3, share: int = 7) -> Model:
    """A stand-in model that names children by a hash of the node; the same on every run."""
    import zlib

    def model(batch: pd.DataFrame) -> pd.Series:
        return pd.Series([[f"{u}.{k}" for k in range(names) if zlib.crc32(f"{r}|{t}|{u}|{k}".encode()) % share < share - 2] for r, t, u in zip(batch["record_id"], batch["trajectory"], batch["user"])], index=batch.index)

    return model


#: Rollouts by the name under which a trainer's configuration asks for them.
ROLLOUTS: dict[str, Callable[..., DataFrame]] = {"self_play": rollout, "evaluate": evaluate}


#: Names under which a score may stand, in the order of trust; fixed values.
SCORES = ("rewards", "trajectory_reward", "step_reward")


def register_scores(spark: SparkSession) -> None:
    """``compute_score(data_source, solution_str, ground_truth, extra_info)`` for SQL: the score that ``extra_info`` carries,
    in ``reward_scores`` or itself, else 0. It is an expression of SQL, so that it stays in generated code."""
    found = ", ".join(f"try_cast(get_json_object(extra_info, '$.{place}{k}') AS DOUBLE)" for place in ("reward_scores.", "") for k in SCORES)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION compute_score(data_source STRING, solution_str STRING, ground_truth STRING, extra_info STRING) RETURNS DOUBLE "
        f"RETURN coalesce({found}, 0.0D)")
