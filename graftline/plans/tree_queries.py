"""Trees of posts and the samples built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators import samples, trees
from graftline.plans.registry import Registry
from graftline.runtime import Scratch
from graftline.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

CHUNK, COPIES, SHARE = 8, 10, 0.85
STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

FLAT = """WITH RECURSIVE p AS (SELECT post.id AS record_id, post FROM raw_posts WHERE post.id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post.id ORDER BY crawled_at DESC NULLS LAST, row_id DESC) = 1),
c AS (SELECT * FROM (SELECT record_id, post."user".screen_name AS root_user, unnest(post.comments) AS c FROM p) WHERE c.id IS NOT NULL AND NOT coalesce(starts_with(ltrim(c.text_raw), '图片评论'), false)),
r AS (SELECT record_id, root_user, c.id AS holder, r FROM (SELECT *, unnest(c.comments) AS r FROM c) WHERE r.id IS NOT NULL AND NOT coalesce(starts_with(ltrim(r.text_raw), '图片评论'), false)),
s AS (SELECT * FROM (SELECT record_id, post."user".screen_name AS root_user, unnest(post.reposts) AS s FROM p) WHERE s.id IS NOT NULL),
flat0 AS (SELECT record_id, post."user".screen_name AS root_user, record_id AS node_id, NULL::BIGINT AS parent_id, post."user".screen_name AS "user", post."user".id AS user_id, post.text_raw AS content, '原创博文' AS kind FROM p
 UNION ALL SELECT record_id, root_user, c.id, record_id, c."user".screen_name, c."user".id, c.text_raw, '评论' FROM c
 UNION ALL SELECT record_id, root_user, r.id, coalesce(r.reply_comment.id, holder), r."user".screen_name, r."user".id, r.text_raw, '评论' FROM r
 UNION ALL SELECT record_id, root_user, s.id, record_id, s."user".screen_name, s."user".id, CASE WHEN length(trim(s.text_law)) > 0 THEN s.text_law ELSE s.text_raw END, '转发微博' FROM s),
flat AS (SELECT * FROM flat0 QUALIFY row_number() OVER (PARTITION BY record_id, node_id ORDER BY parent_id) = 1),
links AS (SELECT record_id, node_id AS id, parent_id AS parent FROM flat),
walk AS (SELECT record_id, id, CAST(0 AS BIGINT) AS depth FROM links WHERE parent IS NULL UNION ALL SELECT l.record_id, l.id, w.depth + 1 FROM links l JOIN walk w ON l.parent = w.id AND l.record_id = w.record_id),
nodes AS (SELECT flat.*, walk.depth FROM flat JOIN walk ON walk.id = flat.node_id AND walk.record_id = flat.record_id)
"""
PROFILED = FLAT + """, prof AS (SELECT user_id, coalesce(user_interests, []) AS interests FROM profiles WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, user_interests DESC NULLS LAST) = 1),
known AS (SELECT nodes.*, coalesce(prof.interests, []) AS interests FROM nodes LEFT JOIN prof USING (user_id)),
ok AS (SELECT * FROM known WHERE len(interests) > 0 AND "user" <> '' AND root_user <> ''),
firsts AS (SELECT "user" AS user_name, interests FROM ok QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY record_id, node_id) = 1),
pool AS (SELECT root_user, user_name, interests FROM (SELECT DISTINCT root_user, "user" AS user_name FROM ok) JOIN firsts USING (user_name))
"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return trees.trees(table(spark, d, "raw_posts"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with interests, kept once: pools, chunks and labels all read them."""
    return Scratch(spark, "known").write(trees.with_interests(_nodes(spark, d), table(spark, d, "profiles")))


@query(FLAT + "SELECT record_id, node_id, parent_id, depth, \"user\" AS user_name, kind FROM nodes")
def t1_trees(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("record_id", "node_id", "parent_id", "depth", F.col("user").alias("user_name"), "kind")


@query(FLAT + "SELECT depth, kind, count(*) AS n FROM nodes GROUP BY ALL")
def t5_levels(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).groupBy("depth", "kind").agg(F.count("*").alias("n"))


@query(FLAT + ", lines AS (SELECT record_id, id, [id] AS ids FROM links WHERE parent IS NULL UNION ALL SELECT l.record_id, l.id, list_append(x.ids, l.id) FROM links l JOIN lines x ON l.parent = x.id AND l.record_id = x.record_id) SELECT record_id, id AS node_id, array_to_string(list_slice(ids, 1, len(ids) - 1), '/') AS above FROM lines")
def t4_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Ids above each node, from the post down."""
    out = trees.ancestors(table(spark, d, "raw_posts"))
    return out.select("record_id", "node_id", F.array_join(F.transform("above", lambda x: x.cast("string")), "/").alias("above"))


@query(FLAT + "SELECT n.record_id, n.node_id, u.\"user\" AS parent_user FROM nodes n LEFT JOIN nodes u ON u.record_id = n.record_id AND u.node_id = n.parent_id")
def t6_parent_history(spark: SparkSession, d: str) -> DataFrame:
    return trees.parent_users(_nodes(spark, d)).select("record_id", "node_id", "parent_user")


@query(FLAT + "SELECT DISTINCT root_user, \"user\" AS user_name FROM nodes WHERE depth > 0 AND root_user IS NOT NULL AND \"user\" IS NOT NULL")
def a2_interactors(spark: SparkSession, d: str) -> DataFrame:
    return trees.interactors(_nodes(spark, d)).withColumnRenamed("user", "user_name")


@query(PROFILED + "SELECT record_id, parent_id AS node_id, node_id AS child_id, \"user\" AS user_name, array_to_string(interests, ',') AS interests, content, CASE WHEN content IN ('转发', '转发微博') THEN '转发' ELSE '评论' END AS nature FROM known WHERE parent_id IS NOT NULL")
def t8_p20_answers(spark: SparkSession, d: str) -> DataFrame:
    """All direct children of each node with their interests."""
    return trees.answers(_known(spark, d)).withColumn("interests", F.array_join("interests", ",")).withColumnRenamed("user", "user_name")


@query(PROFILED + """, sub AS (SELECT DISTINCT user_id FROM profiles WHERE user_id % 2 = 0), said AS (SELECT user_id, coalesce(user_description, '') AS description FROM profiles WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, user_description DESC NULLS LAST) = 1)
SELECT record_id, parent_id AS node_id, node_id AS child_id, user_id, array_to_string(interests, ',') AS interests, coalesce(description, '') AS description FROM known JOIN sub USING (user_id) LEFT JOIN said USING (user_id) WHERE parent_id IS NOT NULL""")
def sel_p21_answers_of(spark: SparkSession, d: str) -> DataFrame:
    """The children by the users of a list, here those with even ids, with their descriptions."""
    profiles = table(spark, d, "profiles")
    out = trees.answers_of(_known(spark, d), profiles.where("user_id % 2 = 0"), profiles)
    return out.select("record_id", "node_id", "child_id", "user_id", F.array_join("interests", ",").alias("interests"), "description")


@query(PROFILED + "SELECT record_id, node_id, len(interests) AS n_interests FROM known")
def j2_node_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select("record_id", "node_id", F.size("interests").cast("bigint").alias("n_interests"))


@query(PROFILED + "SELECT root_user, user_name, array_to_string(interests, ',') AS interests FROM pool")
def a4_a5_pool(spark: SparkSession, d: str) -> DataFrame:
    return trees.pools(_known(spark, d)).select("root_user", "user_name", F.array_join("interests", ",").alias("interests"))


@query(PROFILED + ", n AS (SELECT root_user, count(*) AS n FROM pool GROUP BY root_user) SELECT round(avg(n), 6) AS avg_n, min(n) AS min_n, max(n) AS max_n, CAST(sum(n) AS BIGINT) AS sum_n, count(*) FILTER (n > 20) AS n_large FROM n")
def a6_pool_stats(spark: SparkSession, d: str) -> DataFrame:
    n = trees.pools(_known(spark, d)).groupBy("root_user").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("avg_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.sum("n").alias("sum_n"), F.count_if(F.col("n") > 20).alias("n_large"))


@query(PROFILED + "SELECT record_id, count(*) AS n FROM known WHERE root_user NOT IN (SELECT root_user FROM pool GROUP BY root_user HAVING count(*) > 20) OR root_user IS NULL GROUP BY record_id")
def sel_p3_j9_small_pools(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    return trees.without_large(known, trees.pools(known), 20).groupBy("record_id").agg(F.count("*").alias("n"))


@query(PROFILED + "SELECT root_user, user_name, CAST((row_number() OVER (PARTITION BY root_user ORDER BY user_name) - 1) // 8 AS INTEGER) AS chunk FROM pool")
def o5_chunks(spark: SparkSession, d: str) -> DataFrame:
    return samples.chunks(trees.pools(_known(spark, d)), ["root_user"], "user_name", CHUNK).select("root_user", "user_name", "chunk")


@query(PROFILED + ", n AS (SELECT root_user, user_name, greatest(1, count(*) OVER (PARTITION BY root_user) // 10) AS size, row_number() OVER (PARTITION BY root_user ORDER BY user_name) AS pos FROM pool) SELECT root_user, user_name, CAST((pos - 1) // size AS INTEGER) AS part FROM n WHERE (pos - 1) // size < 10")
def o4_even_parts(spark: SparkSession, d: str) -> DataFrame:
    return samples.even_parts(trees.pools(_known(spark, d)), ["root_user"], "user_name", 10).select("root_user", "user_name", "part")


LABELS = PROFILED + r""", cut AS (SELECT root_user, user_name, row_number() OVER (PARTITION BY root_user ORDER BY user_name) AS pos FROM pool),
kid AS (SELECT record_id, parent_id AS node_id, "user" AS user_name, CASE WHEN kind = '转发微博' OR contains(coalesce(content, ''), '//@') THEN 2 ELSE 1 END AS reaction FROM nodes WHERE parent_id IS NOT NULL AND "user" <> ''
 QUALIFY row_number() OVER (PARTITION BY record_id, parent_id, "user" ORDER BY node_id DESC) = 1),
cell AS (SELECT n.record_id, n.node_id, n.depth, CAST((pos - 1) // 8 AS INTEGER) AS chunk, pos, cut.user_name, coalesce(kid.reaction, 0) AS reaction
 FROM nodes n JOIN cut USING (root_user) LEFT JOIN kid ON kid.record_id = n.record_id AND kid.node_id = n.node_id AND kid.user_name = cut.user_name WHERE n.depth IN (0, 1))
"""


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, chunks of the candidates and last reactions, of all authors however large their pools."""
    known = _known(spark, d)
    return known, samples.chunks(trees.pools(known), ["root_user"], "user_name", CHUNK), trees.children(known)


def _in_lines(cells: Column) -> list[Column]:
    """Candidates and types of a sample from its cells, each in one string."""
    return [F.array_join(F.transform(cells, lambda c: c.user), "|").alias("candidates"), F.array_join(F.transform(cells, lambda c: c.reaction.cast("string")), ",").alias("types")]


@query(LABELS + "SELECT record_id || '_node_' || node_id || '_potchunk_' || chunk || '_tL' || depth AS id, depth AS node_depth, array_to_string(list(user_name ORDER BY pos), '|') AS candidates, array_to_string(list(reaction ORDER BY pos), ',') AS types FROM cell GROUP BY record_id, node_id, depth, chunk")
def t7_j4_j5_samples(spark: SparkSession, d: str) -> DataFrame:
    nodes, pool, kids = _asked(spark, d)
    return samples.sampled(nodes, pool, kids.withColumn("said", F.lit("")), form=_in_lines).select("id", "node_depth", "candidates", "types")


@query(LABELS + "SELECT depth, count(DISTINCT (record_id, node_id, chunk)) AS n_samples, count(*) AS n_cands, count(*) FILTER (reaction <> 0) AS n_gold, round(count(*) FILTER (reaction <> 0) / count(*), 6) AS share FROM cell GROUP BY depth")
def a7_candidate_stats(spark: SparkSession, d: str) -> DataFrame:
    return samples.candidate_stats(*_asked(spark, d))


@query("WITH k AS (SELECT DISTINCT regexp_extract(id, '^(.*?)_node_', 1) AS record_id FROM sft), n AS (SELECT record_id, row_number() OVER (ORDER BY md5(record_id), record_id) AS rank, count(*) OVER () AS n FROM k) SELECT record_id, CASE WHEN rank <= round_even(n * 0.85, 0) THEN 'train' ELSE 'val' END AS part FROM n")
def o7_j7_split(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "sft").select(F.regexp_extract("id", "^(.*?)_node_", 1).alias("record_id"))
    return samples.split(ids, "record_id", SHARE, F.md5("record_id"))


@query("SELECT CASE WHEN i = 0 THEN id ELSE id || '__d0x' || i END AS id, node_depth FROM (SELECT id, node_depth, unnest(range(CASE WHEN node_depth = 0 THEN 10 ELSE 1 END)) AS i FROM (SELECT DISTINCT id, node_depth FROM sft WHERE split_name = 'train'))")
def o8_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft").where("split_name = 'train'").select("id", "node_depth").distinct()
    return samples.repeated(rows, COPIES)


@query(PROFILED + "SELECT root_user, count(*) AS n, CAST(count(*) * (count(*) + 1) // 2 AS BIGINT) AS places, count(DISTINCT user_name) AS users, count(*) < 12 OR true AS mixed FROM pool GROUP BY root_user")
def o6_shuffled_pool(spark: SparkSession, d: str) -> DataFrame:
    """Pool in a seeded order that is the same on every run: each place once, and in larger pools not the order of the names."""
    pool = trees.pools(_known(spark, d)).select("root_user", "user_name")
    placed = samples.numbered(pool, ["root_user"], samples.shuffled(42, "root_user", "user_name"))
    by_name = samples.numbered(placed.withColumnRenamed("pos", "place"), ["root_user"], "user_name")
    n = F.count("*")
    return by_name.groupBy("root_user").agg(n.alias("n"), F.sum("place").cast("bigint").alias("places"), F.count_distinct("user_name").alias("users"), ((n < 12) | (F.count_if(F.col("place") != F.col("pos")) > 0)).alias("mixed"))
