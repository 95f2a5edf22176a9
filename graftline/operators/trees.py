"""Interaction trees of posts as adjacency tables, and what is read off them.

A tree is node(record_id, node_id, parent_id, root_user, user, user_id, content, kind, depth): recursion lives in the
rows, not in a type, so depth is unbounded. A post is one row, so its nodes are placed within the row, before they are
laid out: the ids and parents of a row go through one Arrow-batched function in linear time, which built-in functions
could only do in a fixed number of steps. Nothing is shuffled but the choice of each post's latest crawl.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions.text import COMMENT, REPOST, REPOST_LONG, is_image_comment


def latest_posts(raw: DataFrame) -> DataFrame:
    """One post per id: the latest crawl, ties by row. The winners are found by their times, without the posts' contents."""
    some = raw.where("post.id IS NOT NULL")
    best = some.groupBy(F.col("post.id").alias("record_id")).agg(F.max(F.struct("crawled_at", "row_id")).alias("b")).select(F.col("b.row_id").alias("row_id"))
    return some.join(best, "row_id", "left_semi").select(F.col("post.id").alias("record_id"), "post")


def climbs(ids: list[int], parents: list[int | None]) -> list[list[int] | None]:
    """The nodes above each one, from the top down; none for copies of a node but the one with the smallest parent, and for
    nodes that do not come to a top."""
    own: dict[int, int] = {}
    for i, (n, p) in enumerate(zip(ids, parents)):
        if n not in own or p is not None and (parents[own[n]] is None or p < parents[own[n]]):
            own[n] = i
    above: dict[int, list[int] | None] = {}
    for n in own:
        way, here = [], n
        while here is not None and here in own and here not in above and here not in way[-1:]:
            above[here] = None  # until it is known to come to a top
            way.append(here)
            here = parents[own[here]]
        top = [] if here is None else above.get(here)
        lead = None if here is not None and top is None else (top if here is None else [*top, here])
        for x in reversed(way):
            above[x] = lead
            lead = None if lead is None else [*lead, x]
    return [above[n] if own[n] == i else None for i, n in enumerate(ids)]


def depths(ids: list[int], parents: list[int | None]) -> list[int | None]:
    """Like ``climbs``, but only how many nodes are above; linear in the number of nodes, whatever the depth."""
    own: dict[int, int] = {}
    for i, (n, p) in enumerate(zip(ids, parents)):
        if n not in own or p is not None and (parents[own[n]] is None or p < parents[own[n]]):
            own[n] = i
    depth: dict[int | None, int | None] = {None: -1}
    for n in own:
        way, here = [], n
        while here not in depth and here in own:
            depth[here] = None
            way.append(here)
            here = parents[own[here]]
        at = depth.get(here)
        for x in reversed(way):
            at = None if at is None else at + 1
            depth[x] = at
    return [depth[n] if own[n] == i else None for i, n in enumerate(ids)]


def _within(ids: Column, parents: Column, each, kind: str) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        plain = lambda x: None if pd.isna(x) else int(x)
        return pd.Series([each([plain(x) for x in i], [plain(x) for x in p]) for i, p in zip(a, b)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(ids, parents)


def _node(node: Column, parent: Column, user: Column, content: Column, kind: str) -> Column:
    return F.struct(node.alias("node_id"), parent.alias("parent_id"), user.screen_name.alias("user"), user.id.alias("user_id"), content.alias("content"), F.lit(kind).alias("kind"))


def post_nodes(posts: DataFrame) -> DataFrame:
    """(record_id, root_user, nodes): posts, comments, replies and reposts with the parent each names; image comments go with
    their replies."""
    p = F.col("post")
    some = lambda a: F.coalesce(a, F.array())
    shown = F.filter(some(p.comments), lambda c: c.id.isNotNull() & ~F.coalesce(is_image_comment(c.text_raw), F.lit(False)))
    first = F.transform(shown, lambda c: _node(c.id, p.id, c.user, c.text_raw, COMMENT))
    below = F.flatten(F.transform(shown, lambda c: F.transform(
        F.filter(some(c.comments), lambda r: r.id.isNotNull() & ~F.coalesce(is_image_comment(r.text_raw), F.lit(False))),
        lambda r: _node(r.id, F.coalesce(r.reply_comment.id, c.id), r.user, r.text_raw, COMMENT))))
    shares = F.transform(F.filter(some(p.reposts), lambda r: r.id.isNotNull()), lambda r: _node(r.id, p.id, r.user, F.when(F.length(F.trim(r.text_law)) > 0, r.text_law).otherwise(r.text_raw), REPOST_LONG))
    root = F.array(_node(p.id, F.lit(None).cast("bigint"), p.user, p.text_raw, "原创博文"))
    return posts.select("record_id", p.user.screen_name.alias("root_user"), F.concat(root, first, below, shares).alias("nodes"))


def _placed(raw: DataFrame, each, kind: str, name: str) -> DataFrame:
    rows = post_nodes(latest_posts(raw))
    ids, parents = F.transform("nodes", lambda n: n.node_id), F.transform("nodes", lambda n: n.parent_id)
    placed = rows.withColumn("places", _within(ids, parents, each, kind))
    cells = F.zip_with("nodes", "places", lambda n, d: n.withField(name, d))
    return placed.select("record_id", "root_user", F.inline(F.filter(cells, lambda n: n[name].isNotNull())))


def trees(raw: DataFrame) -> DataFrame:
    """Nodes that hang below their post, with depth (the post at 0); orphans and cycles vanish."""
    return _placed(raw, depths, "array<int>", "depth").withColumn("depth", F.col("depth").cast("bigint"))


def ancestors(raw: DataFrame) -> DataFrame:
    """The same nodes with the ids above each, from the post down."""
    return _placed(raw, climbs, "array<array<bigint>>", "above")


def with_interests(nodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join of each node's user with the latest profile; no profile gives no interests."""
    latest = profiles.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max(F.struct("updated_at", "user_interests")).alias("b")).select("user_id", F.coalesce("b.user_interests", F.array().cast("array<string>")).alias("interests"))
    return nodes.join(latest, "user_id", "left").withColumn("interests", F.coalesce("interests", F.array().cast("array<string>")))


def interactors(nodes: DataFrame) -> DataFrame:
    """(root_user, user): the distinct users below the posts of each author, all posts taken together, a row each."""
    return nodes.where("depth > 0 AND user IS NOT NULL AND root_user IS NOT NULL").select("root_user", "user").distinct()


def answers(nodes: DataFrame) -> DataFrame:
    """(record_id, node_id, user, interests, content, nature): all direct children of each node, a row each; nodes with interests."""
    kind = F.when(F.col("content").isin(REPOST, REPOST_LONG), REPOST).otherwise(COMMENT)
    return nodes.where("parent_id IS NOT NULL").select("record_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), "user", "interests", "content", kind.alias("nature"))


def answers_of(nodes: DataFrame, subset: DataFrame, profiles: DataFrame) -> DataFrame:
    """The children whose user is among subset(user_id), with the descriptions of their latest profiles."""
    best = profiles.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max(F.struct("updated_at", "user_description")).alias("b")).select("user_id", F.coalesce("b.user_description", F.lit("")).alias("description"))
    mine = nodes.join(subset.select("user_id").distinct(), "user_id", "left_semi")
    rows = answers(mine).join(mine.select("record_id", F.col("node_id").alias("child_id"), "user_id"), ["record_id", "child_id"])
    return rows.join(best, "user_id", "left").withColumn("description", F.coalesce("description", F.lit("")))


def pools(nodes: DataFrame) -> DataFrame:
    """(root_user, user_name, interests): users with interests anywhere in an author's trees, the author included."""
    known = nodes.where("size(interests) > 0 AND user <> '' AND root_user <> ''")
    first = known.groupBy(F.col("user").alias("user_name")).agg(F.min_by("interests", F.struct("record_id", "node_id")).alias("interests"))
    return known.select("root_user", F.col("user").alias("user_name")).distinct().join(first, "user_name")


def without_large(nodes: DataFrame, pool: DataFrame, most: int) -> DataFrame:
    """Nodes of authors whose pool has at most ``most`` users."""
    large = pool.groupBy("root_user").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return nodes.join(large, "root_user", "left_anti")


def parent_users(nodes: DataFrame) -> DataFrame:
    """Each node with its parent's user: a history of one."""
    up = nodes.select("record_id", F.col("node_id").alias("parent_id"), F.col("user").alias("parent_user"))
    return nodes.join(up, ["record_id", "parent_id"], "left")


def children(nodes: DataFrame) -> DataFrame:
    """(record_id, parent_id, user, reaction, said): the last reaction of each user below a node; texts are moved only where
    ``said`` is read."""
    from graftline.functions.text import reaction, strip_repost_tail, without_markers

    content = F.coalesce("content", F.lit(""))
    kind = reaction(F.col("kind"), content)
    said = F.when(kind == 1, without_markers(strip_repost_tail(content))).otherwise("")
    rows = nodes.where("parent_id IS NOT NULL AND user <> ''")
    return rows.groupBy("record_id", "parent_id", "user").agg(F.max_by(kind, "node_id").alias("reaction"), F.max_by(said, "node_id").alias("said"))
