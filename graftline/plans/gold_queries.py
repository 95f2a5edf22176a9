"""Truth by depth, rows for reinforcement learning and what is read out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import lenient, records, text
from graftline.operators import gold, rollout
from graftline.plans.record_queries import GOLD, _sound
from graftline.plans.registry import Registry
from graftline.plans.text_queries import CANDS
from graftline.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_USER, _ANSWER, _SYSTEM = (f"list_filter(messages, lambda x: x.role = '{r}')[1].content" for r in ("user", "assistant", "system"))
#: Rows for reinforcement learning: root samples with an answer that is an array, one for each system, user and truth.
RL = GOLD + f""", root AS (SELECT DISTINCT id, coalesce({_SYSTEM}, '') AS s, {_USER} AS u, {_ANSWER} AS a FROM sft WHERE coalesce(node_depth, 0) <= 0 AND CASE WHEN json_valid({_ANSWER}) THEN json_type({_ANSWER}) = 'ARRAY' ELSE false END AND {_USER} IS NOT NULL),
kid AS (SELECT id, s, u, a, list_distinct(list_filter(list_transform(list_filter(CAST(json_extract(a, '$[*]') AS JSON[]), lambda x: TRY_CAST(json_extract_string(x, '$.type') AS INTEGER) IN (1, 2)), lambda x: json_extract_string(x, '$.user_name')), lambda x: x <> '')) AS kids FROM root),
rl AS (SELECT min(id) AS id, s, u, list_sort(kids) AS kids FROM kid GROUP BY s, u, list_sort(kids)) """
#: Distinct true children of each sample.
NAMES = GOLD + ", n AS (SELECT DISTINCT id, depth, json_extract_string(x, '$.user_name') AS child FROM c WHERE TRY_CAST(json_extract_string(x, '$.type') AS INTEGER) IN (1, 2) AND json_extract_string(x, '$.user_name') <> '') "
TURNS = f"""WITH t AS (SELECT id, node_depth, messages, unnest(range(1, len(messages))) AS i FROM (SELECT DISTINCT id, node_depth, messages FROM sft)),
u AS (SELECT id, node_depth + 1 AS reply_layer, CASE WHEN CASE WHEN json_valid(messages[i + 1].content) THEN json_type(messages[i + 1].content) = 'ARRAY' ELSE false END THEN CAST(json_extract(messages[i + 1].content, '$[*]') AS JSON[]) END AS a FROM t WHERE messages[i].role = 'user' AND messages[i + 1].role = 'assistant'),
k AS (SELECT id, reply_layer, coalesce(len(list_filter(a, lambda x: TRY_CAST(json_extract_string(x, '$.type') AS INTEGER) = 1)), 0) AS comments, coalesce(len(list_filter(a, lambda x: TRY_CAST(json_extract_string(x, '$.type') AS INTEGER) = 2)), 0) AS reposts FROM u) """


def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft").select("id", "node_depth", "messages").distinct()


def _rl(spark: SparkSession, d: str) -> DataFrame:
    return gold.rl_rows(_sound_rows(spark, d))


def _sound_rows(spark: SparkSession, d: str) -> DataFrame:
    a = F.get(F.filter("messages", lambda m: m.role == "assistant"), 0).content
    return table(spark, d, "sft").where(text.guarded_json(a).isNotNull() & a.rlike(r"^\s*\["))


@query(TURNS + """SELECT reply_layer, CAST(sum(comments + reposts) AS BIGINT) AS effective, CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(reposts) AS BIGINT) AS reposts, count(*) FILTER (comments + reposts = 0) AS invalid,
 CAST(sum(comments + reposts) AS BIGINT) + count(*) FILTER (comments + reposts = 0) AS total, round(sum(comments + reposts) / nullif(sum(comments + reposts) + count(*) FILTER (comments + reposts = 0), 0), 6) AS ratio
 FROM k WHERE reply_layer IN (1, 2) GROUP BY reply_layer""")
def j6_a10_a12_effective(spark: SparkSession, d: str) -> DataFrame:
    """Reacting items, comments, reposts and silent turns of the first two reply layers."""
    return gold.effective(gold.turn_counts(_distinct(spark, d)))


@query(TURNS + ", n AS (SELECT id, node_depth, messages, row_number() OVER () AS r FROM (SELECT DISTINCT id, node_depth, messages FROM sft)) SELECT round((SELECT count(*) FROM k) / count(*), 6) AS turns, round((SELECT count(*) FROM k WHERE reply_layer IN (1, 2)) / count(*), 6) AS turns_of_two FROM n")
def a13_turns_per_dialog(spark: SparkSession, d: str) -> DataFrame:
    """Mean number of turns of a dialog, of all layers and of the first two; 0 without dialogs."""
    rows = _distinct(spark, d)
    both = gold.turn_counts(rows).select(F.lit(1).alias("a"), F.col("reply_layer").isin(1, 2).cast("int").alias("b"), F.lit(0).alias("n")).unionAll(rows.select(F.lit(0), F.lit(0), F.lit(1)))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.sum(c), F.sum("n")), F.lit(0.0)), 6)
    return both.agg(share("a").alias("turns"), share("b").alias("turns_of_two"))


@query(RL + "SELECT 1 AS layer, CAST(sum(len(kids)) AS BIGINT) AS occurrences, (SELECT count(DISTINCT k) FROM (SELECT unnest(kids) AS k FROM rl)) AS names FROM rl")
def a14_truth_of_rl_rows(spark: SparkSession, d: str) -> DataFrame:
    """True names by layer, read back out of the rows' first user messages: occurrences, each once a row, and distinct ones."""
    levels = _rl(spark, d).select("id", "h", F.posexplode(records.truth_of_record(F.col("prompt"))).alias("depth", "level"))
    names = levels.select("id", "h", (F.col("depth") + 1).alias("layer"), F.explode("level").alias("m")).select("id", "h", "layer", F.explode(F.flatten(F.map_values("m"))).alias("child")).distinct()
    return names.groupBy("layer").agg(F.count("*").alias("occurrences"), F.count_distinct("child").alias("names"))


@query(NAMES + "SELECT depth, count(*) AS occurrences, count(DISTINCT child) AS names, count(DISTINCT id) AS n_rows FROM n GROUP BY ROLLUP (depth)")
def a15_truth_of_answers(spark: SparkSession, d: str) -> DataFrame:
    """The same of the supervised answers, per depth and over all."""
    return gold.names_by_row(_sound(spark, d)).rollup("depth").agg(F.count("*").alias("occurrences"), F.count_distinct("child").alias("names"), F.count_distinct("id").alias("n_rows"))


@query(NAMES + "SELECT depth, count(*) AS n FROM (SELECT DISTINCT id, coalesce(node_depth, -1) AS depth FROM sft) e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.id) GROUP BY depth")
def a17_empty_gold(spark: SparkSession, d: str) -> DataFrame:
    """Samples without any true child, per depth; an unknown depth is -1."""
    named = gold.names_by_row(_sound(spark, d)).select("id").distinct()
    return table(spark, d, "sft").select("id", F.coalesce("node_depth", F.lit(-1)).alias("depth")).distinct().join(named, "id", "left_anti").groupBy("depth").agg(F.count("*").alias("n"))


@query(NAMES + "SELECT DISTINCT id FROM n WHERE depth >= 1 ORDER BY id LIMIT 10")
def o3_example_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first ten ids of samples below the root with true children."""
    return gold.names_by_row(_sound(spark, d)).where("depth >= 1").select("id").distinct().orderBy("id").limit(10)


@query(GOLD + "SELECT record_id, CAST(max(depth) + 1 AS INTEGER) AS n_layers, CAST(max(depth) + 1 - count(DISTINCT depth) AS INTEGER) AS n_empty, CAST(count(DISTINCT (depth, parent)) AS INTEGER) AS n_parents, CAST(count(*) AS INTEGER) AS n_children FROM g GROUP BY record_id")
def a30_layers(spark: SparkSession, d: str) -> DataFrame:
    """Truth of each record as a list by depth, gaps as empty layers."""
    out = gold.layers(gold.gold_rows(_sound(spark, d)))
    kids = F.aggregate(F.flatten("layers"), F.lit(0), lambda a, m: a + F.size(F.flatten(F.map_values(m))))
    return out.select("record_id", F.size("layers").alias("n_layers"), F.size(F.filter("layers", lambda x: F.size(x) == 0)).alias("n_empty"), F.size(F.flatten("layers")).alias("n_parents"), kids.alias("n_children"))


@query(RL + rf""", q AS (SELECT rl.*, {CANDS} AS pool FROM rl)
SELECT id, regexp_extract(id, '^(.*?)_node_', 1) AS record_of_id, len(kids) AS n_kids, CAST(len(pool) AS INTEGER) AS root_potential_count, len(pool) > 0 AS has_psep_block, s AS system, u AS content FROM q""")
def t13_w8_rl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows for reinforcement learning, with the truth and the pool embedded in the user message."""
    user = F.col("prompt")[1].content
    kids = F.size(F.flatten(F.map_values(F.get(F.get(records.truth_of_record(F.col("prompt")), 0), 0))))
    return _rl(spark, d).select(
        "id", F.regexp_extract("sft_chunk_info.origin.sample_id", "^(.*?)_node_", 1).alias("record_of_id"), F.coalesce(kids, F.lit(0)).cast("bigint").alias("n_kids"), "sft_chunk_info.root_potential_count", "sft_chunk_info.has_psep_block",
        F.col("prompt")[0].content.alias("system"), F.get_json_object(user, "$.content").alias("content"))


@query(RL + rf""", q AS (SELECT id, unnest({CANDS}) AS x FROM rl) SELECT DISTINCT id, json_extract_string(x, '$.user_name') AS user_name, len(CAST(json_extract(x, '$.interests[*]') AS JSON[])) AS n_interests FROM q""")
def r24_j15_pool_interests(spark: SparkSession, d: str) -> DataFrame:
    """The pool out of a root user's JSON, and the interests of each of its names."""
    user = F.col("prompt")[1].content
    rows = _rl(spark, d).select("id", user.alias("user"), F.explode(records.root_pool(user)).alias("p"))
    return rows.select("id", F.col("p.user_name").alias("user_name"), F.size(records.interests_in_pool(F.col("user"), F.col("p.user_name"))).cast("bigint").alias("n_interests")).distinct()


@query(RL + rf", q AS (SELECT rl.*, {CANDS} AS pool FROM rl) SELECT id, CAST(len(pool) AS INTEGER) AS n, CASE WHEN len(pool) > 0 THEN 3 END AS depth, false AS tells FROM q")
def t14_rebuilt_view(spark: SparkSession, d: str) -> DataFrame:
    """What a model sees at depth 3: the block made anew from the pool, and nothing of the truth."""
    view = records.rebuilt_view(F.col("prompt")[1].content, F.lit(3))
    out = _rl(spark, d).select("id", view.alias("v"))
    return out.select("id", F.size(text.candidates(F.col("v"))).alias("n"), text.candidate_depth(F.col("v")).alias("depth"), F.contains(F.col("v"), F.lit("cond_gt_by_turn")).alias("tells"))


@query("SELECT event_id, CAST(event_id % 11 AS INTEGER) AS place, CASE WHEN event_id % 11 = 10 THEN '[]' ELSE '[[{\"p\":[\"' || event_id || '\"]}]]' END AS found, event_id % 11 = 10 AS none FROM events")
def r20_truth_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """The truth by depth under each of its names and places."""
    cell = F.concat(F.lit('[[{"p":["'), F.col("event_id").cast("string"), F.lit('"]}]]'))
    k = lambda i: f'"{records.TRUTH[i]}"'
    forms = [f'{{"reward_model":{{"ground_truth":{{{k(0)}:#}}}}}}', f'{{"reward_model":{{"ground_truth":{{{k(1)}:#}}}}}}', f'{{"reward_model":{{"gt":{{{k(0)}:#}}}}}}', f'{{"reward_models":[{{"ground_truth":{{{k(0)}:#}}}}]}}',
             f'{{"reward_models":[{{"gt":{{{k(1)}:#}}}}]}}', f'{{"ground_truth":{{{k(0)}:#}}}}', f'{{"ground_truth":{{{k(1)}:#}}}}', f"{{{k(0)}:#}}", f"{{{k(1)}:#}}", f'{{"meta_info":{{"reward_model":{{"ground_truth":{{{k(1)}:#}}}}}}}}', '{"reward_model":1}']
    made = F.replace(F.get(F.array(*map(F.lit, forms)), (F.col("event_id") % 11).cast("int")), F.lit("#"), cell)
    found = records.truth_of_prompts(made)
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 11).cast("int").alias("place"), found.alias("found"), (found == "[]").alias("none"))


@query("SELECT event_id, event_id % 3 = 0 AS sound, CASE WHEN event_id % 3 = 0 THEN '[[\"a\"],[]]' END AS turns FROM events")
def r22_root_and_turns(spark: SparkSession, d: str) -> DataFrame:
    """Root user and truth by turn of rows that hold them, null for the others."""
    good, bad = F.lit('{"user_name":"x"}'), F.lit("plain text")
    kind = F.col("event_id") % 3
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), F.when(kind == 0, good).otherwise(bad).alias("content")))
    model = F.when(kind == 0, '{"ground_truth":{"gt_by_turn":[["a"],[]]}}').when(kind == 1, '{"ground_truth":{"gt":1}}').otherwise("not json")
    return table(spark, d, "events").select("event_id", records.root_user(messages).isNotNull().alias("sound"), records.truth_by_turn(model).alias("turns"))


@query(f"""WITH o AS (SELECT DISTINCT rollout_id, report_depth, input_text, output_text, CASE WHEN json_valid(output_text) THEN json_type(output_text) = 'ARRAY' AND json_array_length(output_text) > 0 ELSE false END AS p FROM rollout)
SELECT rollout_id, regexp_extract(input_text, '(?im)^\\s*username:\\s*(.+?)\\s*$', 1) AS user_name, output_text FROM o WHERE report_depth = 2 AND p AND regexp_extract(input_text, '(?im)^\\s*username:\\s*(.+?)\\s*$', 1) <> ''""")
def sel_p7_second_layer(spark: SparkSession, d: str) -> DataFrame:
    """User and output of the steps of the second layer that predict someone."""
    rows = table(spark, d, "rollout").where((F.col("report_depth") == 2) & records.has_pred(F.col("output_text")))
    return rows.select("rollout_id", text.username(F.col("input_text")).alias("user_name"), "output_text").where("user_name <> ''").distinct()


@query("""SELECT DISTINCT rollout_id, CASE rollout_id % 4 WHEN 0 THEN CASE WHEN json_valid(output_text) THEN json_type(output_text) = 'ARRAY' AND json_array_length(output_text) > 0 ELSE false END WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS has_pred FROM rollout""")
def sel_p8_p9_has_pred(spark: SparkSession, d: str) -> DataFrame:
    """Outputs as they are, under a header of 0, an array under a header of 1, and the words for nothing."""
    form = F.col("rollout_id") % 4
    shown = F.when(form == 0, F.col("output_text")).when(form == 1, F.concat(F.lit("[INTERACT=0]\n"), F.coalesce("output_text", F.lit("")))).when(form == 2, "INTERACT: 1\n[{}]").otherwise(lenient.NOTHING)
    return table(spark, d, "rollout").select("rollout_id", records.has_pred(shown).alias("has_pred")).distinct()


@query("""SELECT DISTINCT rollout_id, CASE WHEN CASE WHEN json_valid(output_text) THEN json_type(output_text) = 'ARRAY' ELSE false END THEN CAST(len(list_filter(CAST(json_extract(output_text, '$[*]') AS JSON[]), lambda x: json_type(x) = 'OBJECT')) AS INTEGER) ELSE 0 END AS n_items,
 NOT CASE WHEN json_valid(output_text) THEN json_type(output_text) = 'ARRAY' ELSE false END AS failed FROM rollout""")
def r16_output_items(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "rollout").select("rollout_id", records.output_items(F.col("output_text")).alias("o"))
    return out.select("rollout_id", F.size("o.items").alias("n_items"), "o.failed").distinct()


@query("""SELECT DISTINCT user_id, list_distinct(user_interests) AS names FROM (SELECT user_id, user_interests FROM profiles WHERE user_id IS NOT NULL AND len(user_interests) > 1) WHERE user_id % 3 < 2
 UNION SELECT user_id, user_interests FROM profiles WHERE user_id % 3 = 2 AND len(user_interests) > 1""".replace("list_distinct(user_interests)", "list_filter(user_interests, lambda x, i: NOT list_contains(user_interests[:i - 1], x))"))
def r18_old_children(spark: SparkSession, d: str) -> DataFrame:
    """Names of old answers: an array of objects, an array of texts under a header, names with separators."""
    c, form = F.col("user_interests"), F.col("user_id") % 3
    listed = F.to_json(F.transform(c, lambda x: F.struct(x.alias("user_name"))))
    answer = F.when(form == 0, listed).when(form == 1, F.concat(F.lit("[INTERACT=1]\r\n"), F.to_json(c))).otherwise(F.concat(F.lit(" "), F.array_join(c, "、")))
    return table(spark, d, "profiles").where("user_id IS NOT NULL AND size(user_interests) > 1").select("user_id", records.old_children(answer).alias("names")).distinct()


@query("""SELECT DISTINCT id, CASE WHEN hash_form = 0 THEN 'meta' ELSE coalesce(CASE WHEN json_valid(sft_chunk_info) THEN json_extract_string(sft_chunk_info, '$.record_id') END, nullif(regexp_extract(id, '^(.*?)_node_', 1), '')) END AS record_id,
 CASE WHEN hash_form = 0 THEN 7 ELSE coalesce(TRY_CAST(CASE WHEN json_valid(sft_chunk_info) THEN json_extract_string(sft_chunk_info, '$.potential_chunk_index') END AS INTEGER), TRY_CAST(nullif(regexp_extract(id, '_potchunk_(\\d+)', 1), '') AS INTEGER)) END AS chunk_index
 FROM (SELECT *, length(id) % 2 AS hash_form FROM sft)""")
def r19_chunk_info(spark: SparkSession, d: str) -> DataFrame:
    """Origins of samples, half of them with a meta message that goes before all else."""
    meta = F.when(F.length("id") % 2 == 0, '{"record_id": "meta", "chunk_index": 7}')
    return table(spark, d, "sft").select("id", records.chunk_info(F.col("sft_chunk_info"), F.col("id"), meta).alias("o")).select("id", "o.record_id", "o.chunk_index").distinct()


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'none' ELSE json_extract_string(props, '$.k') END AS k FROM events WHERE props IS NOT NULL")
def s15_parsed_loosely(spark: SparkSession, d: str) -> DataFrame:
    """JSON, the same as a Python literal, in a tuple, and what is neither."""
    form = F.col("event_id") % 4
    quoted = F.replace("props", F.lit('"'), F.lit("'"))
    cell = F.when(form == 0, F.col("props")).when(form == 1, quoted).when(form == 2, F.concat(F.lit("("), quoted, F.lit(",)"))).otherwise("no { json")
    read = table(spark, d, "events").where("props IS NOT NULL").select("event_id", lenient.parsed_loosely(cell, '{"k": "none"}').alias("j"))
    return read.select("event_id", F.coalesce(F.get_json_object("j", "$.k"), F.get_json_object("j", "$[0].k")).alias("k"))


PROMPTS = "SELECT DISTINCT user_id, screen_name, user_interests, user_description FROM profiles WHERE user_id IS NOT NULL AND user_interests IS NOT NULL AND screen_name IS NOT NULL AND NOT contains(coalesce(user_description, ''), '/@') AND NOT contains(screen_name, chr(34))"


@query("WITH p AS (" + PROMPTS + """), q AS (SELECT *, '[' || coalesce(array_to_string(list_transform(user_interests, lambda x: CAST(to_json(x) AS VARCHAR)), ', '), '') || ']' AS listed, '[' || coalesce(array_to_string(list_transform(user_interests, lambda x: CAST(to_json(x) AS VARCHAR)), ','), '') || ']' AS tight FROM p)
SELECT user_id, 'username: ' || screen_name || chr(10) || 'content:' || chr(10) || trim(coalesce(user_description, '')) || chr(10) || 'userinterest: ' || listed || chr(10) || 'historicalinteractors: ["a", "b"]' || chr(10)
 || 'potentialspan:<POTENTIAL_SPANS><|psep|>{"user_name":"' || screen_name || '","interests":' || tight || ',"depth":1}<|psep|></POTENTIAL_SPANS><TL1>' AS prompt FROM q""")
def f10_f11_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts by the template, with a block of one candidate."""
    rows = table(spark, d, "profiles").where("user_id IS NOT NULL AND user_interests IS NOT NULL AND screen_name IS NOT NULL").where(~F.contains(F.coalesce("user_description", F.lit("")), F.lit("/@")) & ~F.contains("screen_name", F.lit('"')))
    rows = rows.select("user_id", "screen_name", "user_interests", "user_description").distinct()
    block = text.render_candidates(F.array("screen_name"), F.array("user_interests"), F.lit(1))
    return rows.select("user_id", text.user_prompt(F.col("screen_name"), F.col("user_description"), F.col("user_interests"), F.array(F.lit("a"), F.lit("b")), block, F.lit(1)).alias("prompt"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS score FROM events")
def x1_compute_score(spark: SparkSession, d: str) -> DataFrame:
    """The score as a function of SQL, found in the scores that a row carries."""
    rollout.register_scores(spark)
    key = F.when(F.col("event_id") % 2 == 0, "rewards").otherwise("trajectory_reward")
    extra = F.concat(F.lit('{"reward_scores": '), F.regexp_replace("props", '"k"', F.concat(F.lit('"'), key, F.lit('"'))), F.lit("}"))
    table(spark, d, "events").select("event_id", extra.alias("extra")).createOrReplaceTempView("scored_rows")
    return spark.sql("SELECT event_id, compute_score('s', '', '', extra) AS score FROM scored_rows")
