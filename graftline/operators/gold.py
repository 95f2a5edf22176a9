"""True children by record, depth and parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions.records import ROOT, candidate_names, chunk_info, first_user, message_depth, positive_children, system_content
from graftline.functions.text import candidates, guarded_json, prompt_hash, username

ITEM = "array<struct<user_name:string,content:string,type:int>>"


def gold_rows(samples: DataFrame) -> DataFrame:
    """(record_id, depth, parent, child, pos) of the pairs of samples; a blank parent is the root, a negative depth 0.

    Children of a parent are each kept once, at their first place; each sample's children are made row by row and
    the first places come from an aggregation, not from gathered lists.
    """
    of = lambda role: F.get(F.filter("messages", lambda m: m.role == role), F.lit(0)).content
    items = F.from_json(of("assistant"), ITEM)
    rows = samples.select(
        F.regexp_extract("id", "^(.*?)_node_", 1).alias("record_id"), F.greatest(F.coalesce("node_depth", F.lit(0)), F.lit(0)).alias("depth"),
        F.coalesce(F.nullif(username(of("user")), F.lit("")), F.lit(ROOT)).alias("parent"), F.regexp_extract("id", r"_potchunk_(\d+)", 1).try_cast("int").alias("chunk"),
        F.posexplode(positive_children(items, candidate_names(of("user")))).alias("pos", "child"))
    first = F.min(F.struct("chunk", "pos")).alias("at")
    return rows.where("child <> ''").groupBy("record_id", "depth", "parent", "child").agg(first).select("record_id", "depth", "parent", "child", "at.chunk", "at.pos")


def children_lists(gold: DataFrame) -> DataFrame:
    """Ordered children of each parent; a parent's list is as long as its candidates at most."""
    return gold.groupBy("record_id", "depth", "parent").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "pos", "child"))), lambda x: x.child).alias("children"))


def aligned(steps: DataFrame, gold: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """steps(record_id, depth, parent, ...) with their true children and flags: depth out of range, parent missing,
    empty, taken from the fallback(record_id, depth, children) of whole levels."""
    lists = children_lists(gold)
    levels = gold.groupBy("record_id").agg(F.max("depth").alias("deepest"))
    out = steps.join(lists, ["record_id", "depth", "parent"], "left").join(levels, "record_id", "left")
    out = out.withColumns({"out_of_range": F.col("depth") > F.coalesce("deepest", F.lit(-1)), "parent_missing": F.col("children").isNull()}).drop("deepest")
    none = F.array().cast("array<string>")
    if fallback is None:
        return out.withColumn("used_fallback", F.lit(False)).withColumn("children", F.coalesce("children", none))
    whole = fallback.select("record_id", "depth", F.col("children").alias("level"))
    out = out.join(whole, ["record_id", "depth"], "left").withColumn("used_fallback", F.col("children").isNull() & F.col("level").isNotNull())
    return out.withColumn("children", F.coalesce("children", "level", none)).drop("level")


def layers(gold: DataFrame) -> DataFrame:
    """(record_id, layers): the truth of each record as a list by depth of {parent: children}; depths without any are empty.

    A record's list is as long as its tree is, which a prompt holds whole.
    """
    cells = children_lists(gold).groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("depth", "parent", "children"))).alias("cells"), F.max("depth").alias("deepest"))
    level = lambda d: F.transform(F.filter("cells", lambda c: c.depth == d), lambda c: F.create_map(c.parent, c.children))
    return cells.select("record_id", F.transform(F.sequence(F.lit(0), F.col("deepest")), level).alias("layers"))


def rl_rows(samples: DataFrame) -> DataFrame:
    """Root samples as rows for reinforcement learning, the first of each prompt by id: (id, data_source, prompt, ability,
    sft_chunk_info, h). The user message is a JSON object with the prompt's text, the truth of its answer by depth and the pool."""
    roots = samples.where((F.coalesce("node_depth", F.lit(0)) <= 0) & (F.size("messages") >= 2))
    user, answer = first_user(F.col("messages")), F.get(F.filter("messages", lambda m: m.role == "assistant"), 0).content
    found = roots.where(user.isNotNull() & answer.isNotNull()).select("id", "messages", "sft_chunk_info", user.alias("user"), system_content(F.col("messages")).alias("system"), F.from_json(answer, ITEM).alias("items"))
    parent = F.coalesce(F.nullif(username(F.col("user")), F.lit("")), F.lit(ROOT))
    pool = F.transform(candidates(F.col("user")), lambda x: F.from_json(x, "user_name string, interests array<string>, depth int"))
    children = F.array_distinct(F.filter(positive_children(F.col("items"), candidate_names(F.col("user"))), lambda x: F.coalesce(x, F.lit("")) != ""))
    rows = found.withColumns({"parent": parent, "pool": pool, "children": F.coalesce(children, F.array().cast("array<string>"))})
    truth = F.struct(F.array(F.array(F.create_map("parent", "children"))).alias("cond_gt_by_turn"))
    potential = F.struct(F.transform("pool", lambda x: x.user_name).alias("user_names"), F.col("pool").alias("full"))
    model = F.struct(truth.alias("ground_truth"), potential.alias("root_potential"), F.col("parent").alias("root_parent_key"))
    cell = F.to_json(F.struct(F.col("user").alias("content"), F.array().cast("array<string>").alias("historical_interactors"), F.lit(0).alias("depth"), F.lit(0).alias("_step_depth"), model.alias("reward_model")))
    origin = chunk_info(F.col("sft_chunk_info"), F.col("id"), F.get(F.filter("messages", lambda m: m.role == "meta"), 0).content)
    info = F.struct(
        origin.alias("origin"), F.size("pool").alias("root_potential_count"), F.coalesce(F.array_min(F.transform("pool", lambda x: x.depth)), F.lit(0)).alias("root_potential_min_depth"),
        F.coalesce(F.array_max(F.transform("pool", lambda x: x.depth)), F.lit(0)).alias("root_potential_max_depth"), (F.size("pool") > 0).alias("has_psep_block"), F.lit(0).alias("node_depth"))
    prompt = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")), F.struct(F.lit("user").alias("role"), cell.alias("content")))
    out = rows.select("id", F.lit("social_f1").alias("data_source"), prompt.alias("prompt"), F.lit("social_prediction").alias("ability"), info.alias("sft_chunk_info"))
    keyed = out.withColumn("h", prompt_hash(F.col("prompt")[0].content, F.col("prompt")[1].content))
    first = keyed.groupBy("h").agg(F.min("id").alias("id"))
    return keyed.join(first, ["h", "id"], "left_semi").dropDuplicates(["id", "h"])


def names_by_row(samples: DataFrame) -> DataFrame:
    """(id, depth, child): the distinct true children of each distinct sample row; a negative depth counts as 0."""
    answer = F.get(F.filter("messages", lambda m: m.role == "assistant"), 0).content
    depth = F.greatest(F.coalesce("node_depth", F.lit(0)), F.lit(0))
    return samples.select("id", depth.alias("depth"), F.explode(positive_children(F.from_json(answer, ITEM), candidate_names(first_user(F.col("messages"))))).alias("child")).where("child <> ''").distinct()


def turn_counts(samples: DataFrame) -> DataFrame:
    """(id, reply_layer, comments, reposts) of each user message with an assistant message right after it; the layer is the
    message's depth, else the sample's, plus one."""
    pair = F.transform("messages", lambda m, i: F.struct(m.role.alias("r1"), F.get("messages", i + 1).role.alias("r2"), m.content.alias("u"), F.get("messages", i + 1).content.alias("a")))
    turns = samples.select("id", "node_depth", F.inline(F.filter(pair, lambda p: (p.r1 == "user") & (p.r2 == "assistant"))))
    n = lambda k: F.coalesce(F.size(F.filter(F.from_json(guarded_json(F.col("a")), ITEM), lambda x: x.type == k)), F.lit(0))
    told = F.when(F.col("u").rlike(r"^\s*\{"), message_depth(F.lit(None).cast("int"), F.col("u")))
    return turns.select("id", (F.coalesce(told, "node_depth") + 1).alias("reply_layer"), n(1).alias("comments"), n(2).alias("reposts"))


def effective(turns: DataFrame) -> DataFrame:
    """Per reply layer 1 and 2: items that react, comments and reposts, turns without any, and the share of the former."""
    k = F.col("comments") + F.col("reposts")
    sums = turns.where("reply_layer IN (1, 2)").groupBy("reply_layer").agg(F.sum(k).alias("effective"), F.sum("comments").alias("comments"), F.sum("reposts").alias("reposts"), F.count_if(k == 0).alias("invalid"))
    total = F.col("effective") + F.col("invalid")
    return sums.withColumns({"total": total, "ratio": F.round(F.try_divide(F.col("effective"), total), 6)})


def depth_share(gold: DataFrame, depth: int) -> tuple[Column, Column]:
    """Share of a depth among all occurrences and among distinct names; 0 where there are none."""
    at = F.col("depth") == depth
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return share(F.count_if(at), F.count("*")), share(F.count_distinct(F.when(at, F.col("child"))), F.count_distinct("child"))
