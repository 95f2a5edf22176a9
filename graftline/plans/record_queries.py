"""Samples, gold, steps and spans: the remaining reading and alignment operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import records, text
from graftline.operators import gold, spans
from graftline.plans.registry import Registry
from graftline.plans.tree_queries import FLAT, PROFILED, _known, _nodes
from graftline.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

GOLD = r"""WITH m AS (SELECT id, node_depth, list_filter(messages, lambda x: x.role = 'user')[1].content AS u, list_filter(messages, lambda x: x.role = 'assistant')[1].content AS a FROM sft),
j AS (SELECT id, greatest(coalesce(node_depth, 0), 0) AS depth, u, CASE WHEN json_valid(a) AND json_type(a) = 'ARRAY' THEN a END AS a FROM m),
c AS (SELECT id, depth, coalesce(nullif(regexp_extract(u, '(?im)^\s*username:\s*(.+?)\s*$', 1), ''), '__ROOT__') AS parent, unnest(json_extract(a, '$[*]')) AS x, generate_subscripts(json_extract(a, '$[*]'), 1) - 1 AS pos FROM j WHERE a IS NOT NULL),
g0 AS (SELECT regexp_extract(id, '^(.*?)_node_', 1) AS record_id, depth, parent, json_extract_string(x, '$.user_name') AS child, pos FROM c WHERE TRY_CAST(json_extract_string(x, '$.type') AS INTEGER) IN (1, 2)),
g AS (SELECT DISTINCT record_id, depth, parent, child FROM g0 WHERE child <> '')
"""


def _sound(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose answer is one valid array."""
    a = F.get(F.filter("messages", lambda m: m.role == "assistant"), F.lit(0)).content
    return table(spark, d, "sft").select("id", "node_depth", "messages").where(text.guarded_json(a).isNotNull() & a.rlike(r"^\s*\["))


@query(GOLD + "SELECT record_id, depth, parent, child FROM g")
def a30_r17_gold(spark: SparkSession, d: str) -> DataFrame:
    return gold.gold_rows(_sound(spark, d)).select("record_id", "depth", "parent", "child")


@query(GOLD + "SELECT round(count(*) FILTER (depth = 1) / count(*), 6) AS occurrences, round(count(DISTINCT child) FILTER (depth = 1) / count(DISTINCT child), 6) AS names FROM g")
def a16_depth_share(spark: SparkSession, d: str) -> DataFrame:
    a, b = gold.depth_share(gold.gold_rows(_sound(spark, d)), 1)
    return gold.gold_rows(_sound(spark, d)).agg(a.alias("occurrences"), b.alias("names"))


@query(GOLD + """, s AS (SELECT DISTINCT group_id AS record_id, depth, regexp_extract(input_text, '(?im)^\\s*username:\\s*(.+?)\\s*$', 1) AS parent FROM rollout WHERE depth IS NOT NULL),
n AS (SELECT record_id, depth, parent, count(*) AS n FROM g GROUP BY ALL), deep AS (SELECT record_id, max(depth) AS deepest FROM g GROUP BY record_id)
SELECT s.record_id, s.depth, s.parent, CAST(coalesce(n.n, 0) AS INTEGER) AS n_children, s.depth > coalesce(deepest, -1) AS out_of_range, n.n IS NULL AS parent_missing FROM s LEFT JOIN n USING (record_id, depth, parent) LEFT JOIN deep USING (record_id)""")
def j10_j11_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Steps of rollouts with the true children of their parent and the flags of a miss."""
    steps = table(spark, d, "rollout").where("depth IS NOT NULL").select(F.col("group_id").alias("record_id"), "depth", text.username(F.col("input_text")).alias("parent")).distinct()
    out = gold.aligned(steps, gold.gold_rows(_sound(spark, d)))
    return out.select("record_id", "depth", "parent", F.size("children").alias("n_children"), "out_of_range", "parent_missing")


@query("SELECT node_depth, count(*) AS n, count(*) FILTER (coalesce(node_depth, 0) = 0) AS roots, count(*) FILTER (node_depth IN (0, 1)) AS shown FROM sft GROUP BY node_depth")
def sel_p4_p5_p6_p10_depths(spark: SparkSession, d: str) -> DataFrame:
    depth = F.col("node_depth")
    return table(spark, d, "sft").groupBy("node_depth").agg(F.count("*").alias("n"), F.count_if(F.coalesce(depth, F.lit(0)) == 0).alias("roots"), F.count_if(depth.between(0, 1)).alias("shown"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 1 AS n FROM events WHERE props IS NOT NULL")
def sel_p11_p12_public_fields(spark: SparkSession, d: str) -> DataFrame:
    """Properties with every private key added and cut again."""
    private = "".join(f', "{k}": [1]' for k in ("_secret", *records.PRIVATE))
    leaky = F.regexp_replace("props", r"\}$", private + "}")
    kept = table(spark, d, "events").where("props IS NOT NULL").select("event_id", records.public_fields(leaky).alias("m"))
    return kept.select("event_id", F.try_element_at("m", F.lit("k")).try_cast("bigint").alias("k"), F.size("m").alias("n"))


@query("SELECT id, list_transform(messages, lambda m: m.role) AS roles FROM sft")
def sel_p13_p24_without_field(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft").select("id", "messages")
    if records.has_field(rows.schema, "messages", "loss"):
        rows = rows.withColumn("messages", F.transform("messages", lambda m: m.dropFields("loss")))
    return rows.select("id", F.transform("messages", lambda m: m.role).alias("roles"))


@query("SELECT DISTINCT rollout_id, list_transform(list_filter(parsed_output, lambda x: x.type IN (1, 2) AND x.user_name IS NOT NULL), lambda x: x.user_name)[1] AS first_name FROM rollout WHERE parsed_output IS NOT NULL")
def j8_r14_reacting(spark: SparkSession, d: str) -> DataFrame:
    """First reacting name among a step's candidates, in its own order."""
    named = F.transform(F.filter("parsed_output", lambda x: x.type.isin(1, 2) & x.user_name.isNotNull()), lambda x: x.user_name)
    every = F.transform("parsed_output", lambda x: x.user_name)
    return table(spark, d, "rollout").where("parsed_output IS NOT NULL").select("rollout_id", F.get(records.kept_order(named, every), F.lit(0)).alias("first_name")).distinct()


@query("SELECT DISTINCT rollout_id, i - 1 AS place, nullif(parsed_output[i].content, '') AS said FROM (SELECT rollout_id, parsed_output, unnest(range(1, len(parsed_output) + 1)) AS i FROM rollout WHERE parsed_output IS NOT NULL AND len(parsed_output) = len(list_distinct(list_transform(parsed_output, lambda x: x.user_name))) AND len(list_filter(parsed_output, lambda x: x.user_name IS NULL)) = 0)")
def j13_r23_by_name_or_place(spark: SparkSession, d: str) -> DataFrame:
    names, said = F.transform("parsed_output", lambda x: x.user_name), F.transform("parsed_output", lambda x: x.content)
    rows = table(spark, d, "rollout").where("parsed_output IS NOT NULL").where((F.size(F.array_distinct(names)) == F.size("parsed_output")) & ~F.exists(names, lambda x: x.isNull()))
    each = rows.select("rollout_id", names.alias("n"), said.alias("s"), F.explode(F.sequence(F.lit(0), F.size("parsed_output") - 1)).alias("place"))
    return each.where("size(n) > 0").select("rollout_id", F.col("place").cast("bigint").alias("place"), records.by_name_or_place(F.col("n"), F.col("s"), F.get("n", F.col("place")), F.col("place")).alias("said")).distinct()


@query("SELECT DISTINCT rollout_id, len(list_filter(parsed_output, lambda x: x.type = 1)) AS comments, len(list_filter(parsed_output, lambda x: x.type = 2)) AS reposts, coalesce(len(parsed_output), 0) = 0 AS is_empty FROM rollout")
def r14_r31_answer_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.array_size(F.filter("parsed_output", lambda x: x.type == k)).cast("bigint")
    return table(spark, d, "rollout").select("rollout_id", n(1).alias("comments"), n(2).alias("reposts"), (F.coalesce(F.array_size("parsed_output"), F.lit(0)) == 0).alias("is_empty")).distinct()


@query("SELECT id, coalesce(CASE WHEN json_valid(sft_chunk_info) THEN json_extract_string(sft_chunk_info, '$.record_id') END, regexp_extract(id, '^(.*?)_node_', 1)) AS record_id, TRY_CAST(nullif(regexp_extract(id, '_potchunk_(\\d+)', 1), '') AS INTEGER) AS chunk FROM sft")
def r19_r26_origin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft").select("id", records.sample_origin(F.col("sft_chunk_info"), F.col("id")).alias("o")).select("id", "o.record_id", "o.chunk")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS reward FROM events")
def m14_reward(spark: SparkSession, d: str) -> DataFrame:
    renamed = F.regexp_replace("props", '"k"', '"step_reward"')
    return table(spark, d, "events").select("event_id", records.reward(F.lit("{}"), renamed).alias("reward"))


@query("SELECT event_id, TRUE AS ok, 1 AS n FROM events WHERE props IS NOT NULL")
def r12_r13_p25_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Three shapes of a level and a wrapped list give the same names."""
    e = table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    maps, plain = F.format_string('[{"p": ["%s"]}]', "k"), F.format_string('{"p": ["%s"], "q": ["%s"]}', "k", "k")
    wrapped = F.format_string('{"data": ["%s"]}', "k")
    same = (records.children_names(maps) == records.children_names(plain)) & (records.children_names(records.unwrapped_items(wrapped)) == records.children_names(maps))
    return e.select("event_id", (same & records.is_parent_maps(maps) & ~records.is_parent_maps(plain)).alias("ok"), F.size(records.children_names(maps)).alias("n"))


@query(r"SELECT event_id, [json_extract_string(props, '$.k'), 'b'] AS found FROM events WHERE props IS NOT NULL")
def f15_quoted_list(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    whole, cut = F.format_string('["%s", "b"]', "k"), F.format_string('["%s", "b", "c', "k")
    return e.select("event_id", records.quoted_list(F.when(F.col("event_id") % 2 == 0, whole).otherwise(cut)).alias("found"))


@query("SELECT DISTINCT file_name FROM sft_lines WHERE file_name LIKE 'feed#_%#_01.jsonl' ESCAPE '#'")
def f18_glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_lines").select("file_name").distinct().where(F.col("file_name").rlike(records.glob_pattern("feed_*_01.jsonl")))


@query("""WITH v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), n AS (SELECT label, count(*) AS k FROM embeddings GROUP BY label),
l AS (SELECT label, i, round(CASE WHEN k > 1 THEN avg(CAST(x AS DOUBLE)) ELSE 0 END, 6) AS m FROM v JOIN n ON n.label IS NOT DISTINCT FROM v.label GROUP BY ALL), g AS (SELECT i, round(avg(CAST(x AS DOUBLE)), 6) AS m FROM v GROUP BY i)
SELECT label, i AS place, m FROM l UNION ALL SELECT label, i + (SELECT max(i) FROM g), g.m FROM g, (SELECT DISTINCT label FROM embeddings) d""".replace("v JOIN n ON n.label IS NOT DISTINCT FROM v.label GROUP BY ALL", "v JOIN n USING (label) GROUP BY label, i, k"))
def m19_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label followed by that of all, component by component."""
    e = table(spark, d, "embeddings").select("label", "embedding")
    every = spans.pooled(e.withColumn("every", F.lit(1)), "every", "embedding").first()  # one vector
    both = spans.beside_global(spans.pooled(e, "label", "embedding"), every.mean if every else [])
    return both.select("label", F.posexplode("vector").alias("place", "m")).select("label", (F.col("place") + 1).cast("bigint").alias("place"), "m")


@query(r"""WITH u AS (SELECT id, list_filter(messages, lambda x: x.role = 'user')[1].content AS u FROM sft), c AS (SELECT id, u, string_split(u, '<|psep|>') AS p FROM u WHERE u IS NOT NULL),
x AS (SELECT id, unnest(range(2, 2 * ((len(p) - 1) // 2) + 1, 2)) AS i, p FROM c) SELECT id, CAST(i // 2 - 1 AS INTEGER) AS pos, p[i] AS span, p[i] <> '' AS covered FROM x""")
def f19_j16_span_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's characters in its prompt, and whether the words found for them hold them."""
    u = F.get(F.filter("messages", lambda m: m.role == "user"), F.lit(0)).content
    rows = table(spark, d, "sft").select("id", u.alias("u")).where("u IS NOT NULL")
    each = rows.select("id", "u", F.posexplode(spans.span_tokens(F.col("u"), text.PSEP)).alias("pos", "x"))
    span = F.substring("u", F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    words = F.array_join(F.slice(F.filter(F.split("u", " "), lambda w: w != ""), F.col("x.first") + 1, F.col("x.last") - F.col("x.first") + 1), " ")
    return each.select("id", "pos", span.alias("span"), F.coalesce(F.contains(words, F.regexp_replace(span, " +", " ")), F.lit(False)).alias("covered"))


@query(PROFILED + """, newest AS (SELECT root_user, max(record_id) AS record_id FROM known WHERE root_user <> '' GROUP BY root_user)
SELECT DISTINCT k.root_user, k."user" AS user_name, array_to_string(k.interests, ',') AS interests FROM known k JOIN newest USING (root_user, record_id) WHERE k."user" <> ''""")
def a3_last_post_pool(spark: SparkSession, d: str) -> DataFrame:
    """Users and interests of each author's last post only."""
    known = _known(spark, d)
    newest = known.where("root_user <> ''").groupBy("root_user").agg(F.max("record_id").alias("record_id"))
    return known.join(newest, ["root_user", "record_id"], "left_semi").where("user <> ''").select("root_user", F.col("user").alias("user_name"), F.array_join("interests", ",").alias("interests")).distinct()


@query(FLAT + "SELECT record_id, node_id, CAST(depth AS VARCHAR) AS q FROM nodes")
def sel_p19_questions(spark: SparkSession, d: str) -> DataFrame:
    """The oldest sample format's question of each node, read back for its depth."""
    nodes = _nodes(spark, d)
    q = F.to_json(F.struct(F.col("user").alias("用户名"), F.col("content").alias("内容"), F.col("depth").alias("深度"), text.nature(F.col("content")).alias("文本性质")))
    return nodes.select("record_id", "node_id", F.get_json_object(q, "$.深度").alias("q"))


@query("SELECT CAST(len(user_interests) AS INTEGER) AS depth, count(*) AS n FROM profiles WHERE user_interests IS NOT NULL GROUP BY 1")
def r15_r30_message_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth of a message without one of its own: the number of earlier interactors in its content."""
    content = F.to_json(F.struct(F.col("user_interests").alias("historical_interactors")))
    return table(spark, d, "profiles").where("user_interests IS NOT NULL").select(records.message_depth(F.lit(None).cast("int"), content).alias("depth")).groupBy("depth").agg(F.count("*").alias("n"))


@query("SELECT record_id, node_id FROM (" + FLAT + "SELECT record_id, node_id FROM nodes WHERE kind = '转发微博')")
def t2_u5_reposts(spark: SparkSession, d: str) -> DataFrame:
    """Reposts among the united children of posts, leaves at depth 1."""
    return _nodes(spark, d).where("kind = '转发微博' AND depth = 1").select("record_id", "node_id")

