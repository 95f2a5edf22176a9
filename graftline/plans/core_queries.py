"""Queries of the general training-data operators: drifting schemas (p1), nested records (p5), hierarchies (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators import drift, hierarchy, nested, rescue
from graftline.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift(table(spark, d, "sft_lines"))


def p1_samples(spark: SparkSession, d: str) -> DataFrame:
    return drift.samples(table(spark, d, "sft_lines"))


def p1_ingested(spark: SparkSession, d: str) -> DataFrame:
    """The lines in the target schema as first read, with what was rescued."""
    return rescue.ingest(table(spark, d, "sft_lines")).drop("_paths")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.links(table(spark, d, "raw_posts"))


def p5_posts(spark: SparkSession, d: str) -> DataFrame:
    return nested.posts(table(spark, d, "raw_posts"))


def p5_comments(spark: SparkSession, d: str) -> DataFrame:
    return nested.comments(table(spark, d, "raw_posts"))


def p5_replies(spark: SparkSession, d: str) -> DataFrame:
    return nested.replies(table(spark, d, "raw_posts"))


def p5_reposts(spark: SparkSession, d: str) -> DataFrame:
    return nested.reposts(table(spark, d, "raw_posts"))


def p5_users(spark: SparkSession, d: str) -> DataFrame:
    return nested.users(table(spark, d, "raw_posts"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.latest_links(table(spark, d, "comments").select("id", "reply_comment", "depth", "fetched_at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(_latest(spark, d).select("id", "parent"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each comment with its path from the top, its depth against the stored one, and whether it hangs in a cycle."""
    nodes = _latest(spark, d)
    found = hierarchy.resolve(nodes.select("id", "parent"), with_path=True)
    depth = nodes.select("id", "stored_depth")
    return found.join(depth, "id").select(
        "id", "root_id", "node_depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"),
        (F.col("node_depth") == -1).alias("in_cycle"), F.coalesce(F.col("stored_depth") == F.col("node_depth"), F.lit(False)).alias("depth_right"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """One row for each comment below each comment."""
    return hierarchy.descendants(hierarchy.resolve(_latest(spark, d).select("id", "parent"), with_path=True))


QUERIES = {f.__name__: f for f in (p1_found, p1_samples, p1_ingested, p5_found, p5_posts, p5_comments, p5_replies, p5_reposts, p5_users, p6_found, p6_paths, p6_descendants)}

_FOREST = """
WITH RECURSIVE n AS (SELECT id, reply_comment AS parent, depth AS stored FROM comments WHERE id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, reply_comment DESC NULLS LAST, depth DESC NULLS LAST) = 1),
m AS (SELECT n.id, p.id AS parent, n.stored FROM n LEFT JOIN n AS p ON n.parent = p.id AND n.parent <> 0),
t AS (SELECT id, id AS root_id, CAST(1 AS BIGINT) AS node_depth, [id] AS ids FROM m WHERE parent IS NULL
      UNION ALL SELECT m.id, t.root_id, t.node_depth + 1, list_append(t.ids, m.id) FROM m JOIN t ON m.parent = t.id),
lost AS (SELECT id, parent FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = m.id)),
walk AS (SELECT id AS start, id AS here, 0 AS step FROM lost UNION ALL SELECT w.start, l.parent, w.step + 1 FROM walk w JOIN lost l ON w.here = l.id WHERE w.step < 2 * (SELECT count(*) FROM lost)),
ring AS (SELECT start AS id, min(here) AS root_id FROM walk WHERE step >= (SELECT count(*) FROM lost) GROUP BY start)
"""

ORACLE = {
    "p5_found": """
WITH c AS (SELECT post.id AS post_id, unnest(post.comments) AS c FROM raw_posts),
r AS (SELECT post_id, c.id AS parent_id, unnest(c.comments) AS r FROM c),
s AS (SELECT post.id AS post_id, unnest(post.reposts) AS s FROM raw_posts)
SELECT DISTINCT * FROM (
 SELECT post_id, post_id AS parent_id, c.id AS node_id, 'comment' AS kind FROM c
 UNION ALL SELECT post_id, parent_id, r.id, 'reply' FROM r
 UNION ALL SELECT post_id, post_id, s.id, 'repost' FROM s) WHERE node_id IS NOT NULL AND parent_id IS NOT NULL""",
    "p5_posts": "SELECT row_id, crawled_at, post.id AS post_id, post.created_at AS created_at, post.text_raw AS text_raw, post.\"user\".id AS user_id, post.\"user\".screen_name AS screen_name FROM raw_posts WHERE post IS NOT NULL",
    "p5_reposts": """
WITH s AS (SELECT row_id, post.id AS post_id, unnest(post.reposts) AS s, generate_subscripts(post.reposts, 1) - 1 AS i FROM raw_posts)
SELECT row_id, post_id, CAST(i AS INTEGER) AS repost_index, s.id AS repost_id, CASE WHEN length(trim(s.text_law)) > 0 THEN s.text_law ELSE s.text_raw END AS text,
 s."user".id AS user_id, s."user".screen_name AS screen_name FROM s WHERE s IS NOT NULL""",
    "p5_comments": """
WITH c AS (SELECT row_id, post.id AS post_id, unnest(post.comments) AS c, generate_subscripts(post.comments, 1) - 1 AS i FROM raw_posts)
SELECT row_id, post_id, CAST(i AS INTEGER) AS comment_index, c.id AS comment_id, c.text_raw AS text_raw, c."user".id AS user_id, c."user".screen_name AS screen_name FROM c WHERE c IS NOT NULL""",
    "p5_replies": """
WITH c AS (SELECT row_id, post.id AS post_id, unnest(post.comments) AS c, generate_subscripts(post.comments, 1) - 1 AS i FROM raw_posts),
r AS (SELECT row_id, post_id, i, c.id AS comment_id, unnest(c.comments) AS r, generate_subscripts(c.comments, 1) - 1 AS j FROM c WHERE c IS NOT NULL)
SELECT row_id, post_id, CAST(i AS INTEGER) AS comment_index, comment_id, CAST(j AS INTEGER) AS reply_index, r.id AS reply_id, r.reply_comment.id AS reply_to,
 r.text_raw AS text_raw, r."user".id AS user_id, r."user".screen_name AS screen_name FROM r WHERE r IS NOT NULL""",
    "p5_users": """
WITH c AS (SELECT row_id, unnest(post.comments) AS c FROM raw_posts), r AS (SELECT row_id, unnest(c.comments) AS r FROM c), s AS (SELECT row_id, unnest(post.reposts) AS s FROM raw_posts)
SELECT * FROM (
 SELECT row_id, 'post' AS kind, post.id AS holder_id, post."user".id AS user_id, post."user".screen_name AS screen_name FROM raw_posts
 UNION ALL SELECT row_id, 'comment', c.id, c."user".id, c."user".screen_name FROM c
 UNION ALL SELECT row_id, 'reply', r.id, r."user".id, r."user".screen_name FROM r
 UNION ALL SELECT row_id, 'repost', s.id, s."user".id, s."user".screen_name FROM s) WHERE user_id IS NOT NULL OR screen_name IS NOT NULL""",
    "p6_found": _FOREST + "SELECT id, root_id, node_depth FROM t UNION ALL SELECT id, root_id, CAST(-1 AS BIGINT) FROM ring",
    "p6_paths": _FOREST + """, every AS (SELECT id, root_id, node_depth, array_to_string(ids, '/') AS path FROM t UNION ALL SELECT id, root_id, CAST(-1 AS BIGINT), NULL FROM ring)
SELECT e.id, e.root_id, e.node_depth, e.path, e.node_depth = -1 AS in_cycle, coalesce(m.stored = e.node_depth, false) AS depth_right FROM every e JOIN m ON m.id = e.id""",
    "p6_descendants": _FOREST + "SELECT ancestor_id, id, node_depth - i AS distance FROM (SELECT id, node_depth, unnest(ids) AS ancestor_id, generate_subscripts(ids, 1) AS i FROM t) WHERE ancestor_id <> id",
}
