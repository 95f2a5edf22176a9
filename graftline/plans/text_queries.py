"""Text and lenient JSON functions on documents, prompts and answers (F*, P1, P14-P17, R*, M13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import lenient, text
from graftline.plans.registry import Registry
from graftline.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

STRIP = r"regexp_replace({0}, '^[\s\x{{0B}}\x{{85}}\p{{Z}}\x{{1C}}-\x{{1F}}]+|[\s\x{{0B}}\x{{85}}\p{{Z}}\x{{1C}}-\x{{1F}}]+$', '', 'g')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query("SELECT doc_id, CASE WHEN contains(text, '/@') THEN rtrim(regexp_replace(text, '(?s)//?@.*$', ''), chr(9) || chr(10) || chr(13) || ' ' || '　') ELSE " + STRIP.format("text") + " END AS cut FROM documents")
def f1_repost_tail(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.strip_repost_tail(F.col("text")).alias("cut"))


@query("SELECT doc_id, " + STRIP.format("replace(replace(text, '<|cstart|>', ''), '<|cend|>', '')") + " AS bare FROM documents")
def f2_without_markers(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.without_markers(F.col("text")).alias("bare"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)<\|cstart\|>.*?<\|cend\|>') THEN regexp_extract(text, '(?s)<\|cstart\|>(.*?)<\|cend\|>', 1) ELSE text END AS inner_text FROM documents")
def f3_between_markers(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.between_markers(F.col("text")).alias("inner_text"))


@query(r"SELECT doc_id, regexp_replace(text, '\x1B\[[0-?]*[ -/]*[@-~]', '', 'g') AS plain FROM documents WHERE source = 'console'")
def f4_strip_ansi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'console'").select("doc_id", text.strip_ansi(F.col("text")).alias("plain"))


@query(r"SELECT rollout_id, " + STRIP.format("output_text") + r" AS body FROM rollout WHERE NOT contains(output_text, '```') AND NOT contains(output_text, '<|im_') AND NOT contains(lower(output_text), '[user')")
def f5_chat_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Outputs dressed up with a fence and the template's marks, which come off again."""
    rows = table(spark, d, "rollout").where(~F.col("output_text").contains("```") & ~F.col("output_text").contains("<|im_") & ~F.lower("output_text").contains("[user"))
    dressed = F.concat(F.lit("```json\n<|im_start|>assistant\n[user x]"), F.col("output_text"), F.lit("<|im_end|>\n```"))
    return rows.select("rollout_id", text.strip_chat_artifacts(dressed).alias("body"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id % 2 AS INTEGER) WHEN 1 THEN 1 END AS tag FROM documents")
def f6_interact_tag(spark: SparkSession, d: str) -> DataFrame:
    """Texts under headers of both forms and under none."""
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[ tag INTERACT = "), (F.col("doc_id") % 2).cast("string"), F.lit(" ]"))).when(F.col("doc_id") % 3 == 1, F.lit("interact: 1\n")).otherwise("- ")
    return _docs(spark, d).select("doc_id", text.interact_tag(F.concat(head, F.coalesce("text", F.lit("")))).alias("tag"))


USER = "list_filter(messages, lambda m: m.role = 'user')[1].content"
BLOCK = r"regexp_extract(u, '(?s).*<POTENTIAL_SPANS>(.*?)(?:</POTENTIAL_SPANS>|$)', 1)"
CANDS = rf"list_filter(regexp_extract_all({BLOCK}, '(?s)<\|psep\|>(\{{.*?\}})<\|psep\|>', 1), lambda x: coalesce(json_extract_string(x, '$.user_name'), '') <> '')"


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft").select("id", "node_depth", F.get(F.filter("messages", lambda m: m.role == "user"), 0).content.alias("u"))


@query(rf"SELECT id, regexp_extract(u, '(?im)^\s*username:\s*(.+?)\s*$', 1) AS user_name FROM (SELECT id, {USER} AS u FROM sft)")
def f7_username(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select("id", text.username(F.col("u")).alias("user_name"))


@query(rf"""SELECT id, CAST(i AS INTEGER) AS pos, json_extract_string(x, '$.user_name') AS user_name, CAST(json_array_length(x, '$.interests') AS INTEGER) AS n_interests FROM (
 SELECT id, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS i FROM (SELECT id, {CANDS} AS c FROM (SELECT id, {USER} AS u FROM sft)))""")
def f8_r25_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select("id", F.posexplode(text.candidates(F.col("u"))).alias("pos", "x")).select(
        "id", "pos", F.get_json_object("x", "$.user_name").alias("user_name"), F.json_array_length(F.get_json_object("x", "$.interests")).alias("n_interests"))


@query(rf"""SELECT id, TRY_CAST(json_extract_string(nullif(regexp_extract(u, '(?s)<POTENTIAL_SPANS>\s*<\|psep\|>(\{{.*?\}})<\|psep\|>', 1), ''), '$.depth') AS INTEGER) AS depth, TRY_CAST(nullif(regexp_extract(u, '<TL(\d+)>\s*$', 1), '') AS INTEGER) AS layer FROM (SELECT id, {USER} AS u FROM sft)""")
def f9_depth_and_layer(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select("id", text.candidate_depth(F.col("u")).alias("depth"), text.target_layer(F.col("u")).alias("layer"))


@query(r"SELECT id, regexp_replace(u, '(?s)<POTENTIAL_SPANS>.*?</POTENTIAL_SPANS>', '', 'g') AS rest FROM (SELECT id, " + USER + " AS u FROM sft)")
def f12_strip_block(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select("id", text.strip_candidate_block(F.col("u")).alias("rest"))


@query(rf"""SELECT id, TRY_CAST(json_extract_string(nullif(regexp_extract(u, '(?s)<POTENTIAL_SPANS>\s*<\|psep\|>(\{{.*?\}})<\|psep\|>', 1), ''), '$.depth') AS INTEGER) + 2 AS depth, CAST(len({CANDS}) AS INTEGER) AS n,
 regexp_replace(u, '(?s)<POTENTIAL_SPANS>.*?</POTENTIAL_SPANS>', '', 'g') AS rest FROM (SELECT id, {USER} AS u FROM sft)""")
def f12_bumped_depths(spark: SparkSession, d: str) -> DataFrame:
    u = text.bump_candidates(F.col("u"), 2)
    return _users(spark, d).select("id", u.alias("u")).select("id", text.candidate_depth(F.col("u")).alias("depth"), F.size(text.candidates(F.col("u"))).alias("n"), text.strip_candidate_block(F.col("u")).alias("rest"))


@query("SELECT id, array_to_string(list_transform(messages, lambda m: upper(coalesce(m.role, '')) || ':' || chr(10) || coalesce(m.content, '') || chr(10)), '') AS plain FROM sft")
def f13_render_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft").select("id", text.render_messages(F.col("messages")).alias("plain"))


@query(r"SELECT id, regexp_extract(id, '^(.*?)_node_', 1) AS record_id, TRY_CAST(nullif(regexp_extract(id, '_node_(\d+)', 1), '') AS BIGINT) AS node_id, TRY_CAST(nullif(regexp_extract(id, '_potchunk_(\d+)', 1), '') AS INTEGER) AS chunk, TRY_CAST(nullif(regexp_extract(id, '_tL(\d+)', 1), '') AS INTEGER) AS layer FROM sft")
def f14_sample_id(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p, t: F.regexp_extract("id", p, 1).try_cast(t)
    return table(spark, d, "sft").select("id", F.regexp_extract("id", "^(.*?)_node_", 1).alias("record_id"), part(r"_node_(\d+)", "bigint").alias("node_id"), part(r"_potchunk_(\d+)", "int").alias("chunk"), part(r"_tL(\d+)", "int").alias("layer"))


@query(r"SELECT doc_id, least(length(text), 8192) AS seq_len FROM documents")
def sel_p14_seq_len(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.least(F.length("text"), F.lit(8192)).cast("bigint").alias("seq_len"))


@query("SELECT id, content FROM (SELECT DISTINCT id, content FROM comments) WHERE NOT starts_with(" + STRIP.format("content") + ", '图片评论')")
def sel_p1_no_image_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comments").select("id", "content").distinct().where(~text.is_image_comment(F.col("content")))


@query("SELECT doc_id, CASE WHEN text IN ('转发', '转发微博') THEN '转发' WHEN contains(text, '//@') THEN '评论' ELSE '原创博文' END AS nature FROM documents")
def sel_p15_nature(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.nature(F.col("text")).alias("nature"))


@query("SELECT node_type, CASE WHEN node_type IN ('转发', '转发微博') THEN '转发' ELSE '评论' END AS kind, count(*) AS n FROM comments GROUP BY ALL")
def sel_p16_kind(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("node_type").isin(text.REPOST, text.REPOST_LONG), text.REPOST).otherwise(text.COMMENT)
    return table(spark, d, "comments").groupBy("node_type", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, content, CASE WHEN coalesce(node_type = '转发微博', false) OR coalesce(contains(content, '//@'), false) THEN 2 ELSE 1 END AS reaction FROM comments")
def sel_p17_reaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comments").select("id", "content", text.reaction(F.col("node_type"), F.col("content")).alias("reaction")).distinct()


@query("SELECT doc_id, sha256('sys' || chr(0) || coalesce(text, '')) AS h FROM documents WHERE NOT contains(coalesce(text, ''), chr(0))")
def m13_prompt_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(~F.coalesce("text", F.lit("")).contains("\x00")).select("doc_id", text.prompt_hash(F.lit("sys"), F.col("text")).alias("h"))


@query(r"SELECT event_id, regexp_replace('[' || props || ',' || chr(10) || ' ]', ',\s*([\]}])', '\1', 'g') AS mended FROM events")
def r4_trailing_commas(spark: SparkSession, d: str) -> DataFrame:
    broken = F.concat(F.lit("["), F.col("props"), F.lit(",\n ]"))
    return table(spark, d, "events").select("event_id", text.no_trailing_commas(broken).alias("mended"))


@query(r"SELECT DISTINCT rollout_id, nullif(regexp_extract(output_text, '(?s)(\[.*\])', 1), '') AS part FROM rollout")
def r10_array_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rollout").select("rollout_id", text.array_slice(F.col("output_text")).alias("part")).distinct()


@query(r"SELECT line_id, regexp_matches(line, '^\s*[\[{]') AND json_valid(line) AS sound FROM sft_lines WHERE line IS NOT NULL")
def r28_guarded_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_lines").where("line IS NOT NULL").select("line_id", text.guarded_json(F.col("line")).isNotNull().alias("sound"))


@query("SELECT event_id, '[' || props || ']' AS wrapped FROM events WHERE props IS NOT NULL")
def r29_wrap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", text.wrap_as_list(F.col("props")).alias("wrapped"))


@query("SELECT user_id, list_transform(string_split(j, ','), lambda x: trim(x)) AS names FROM (SELECT DISTINCT user_id, array_to_string(user_interests, ',') AS j FROM profiles WHERE len(user_interests) > 1)")
def f20_split_names(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join("user_interests", ",")
    return table(spark, d, "profiles").where("size(user_interests) > 1").select("user_id", joined.alias("j")).distinct().select("user_id", text.split_names(F.col("j")).alias("names"))


#: Outputs in every state, with their status, note and number of items when mended, their status when checked, with and without closing what is cut off, and their names.
_A, _B = '{"user_name": "a", "content": "x", "type": "评论"}', '{"user_name": "b", "content": "", "type": "转发微博"}'
FORMS = (
    (f"[{_A}, {_B}]", "ok_repaired", "direct_json", 2, "ok", "ok", "a|b"), (f"[{_A}, {_B}, {_A}]", "ok_repaired", "direct_json", 2, "ok", "ok", "a|b"),
    (f"[{_A}, {_B},]", "ok_repaired", "slice_json_array_fix_commas", 2, "ok_repaired", "parse_fail_json", f"[{_A}, {_B},]"), (f"so: [{_A}] ok?", "ok_repaired", "slice_json_array", 1, "ok_repaired", "parse_fail_json", f"so: [{_A}] ok?"),
    (_A, "ok_repaired", "wrapped_as_list", 1, "parse_fail_not_list", "parse_fail_not_list", "a"), (f"[{_A}, {{\"user_na", "parse_fail_json", "fail", 0, "ok_repaired", "parse_fail_json", f"[{_A}, {{\"user_na"),
    (f"[INTERACT=1]\n[{_A}]", "ok_repaired", "peeled_header_bracket;direct_json", 1, "parse_fail_json", "parse_fail_json", f"[INTERACT=1]\n[{_A}]"), ("INTERACT=0", "no_interaction", "peeled_header_nobracket", 0, "parse_fail_json", "parse_fail_json", "INTERACT=0"),
    (f"```json\n[{_A}]\n```", "ok_repaired", "direct_json", 1, "ok_repaired", "parse_fail_json", f"```json\n[{_A}]\n```"), ("无人互动", "empty", "explicit_empty", 0, "no_interaction", "no_interaction", "无人互动"), ("[]", "empty", "explicit_empty", 0, "empty", "empty", ""),
    ('[{"user_name": "", "content": "", "type": "评论"}]', "empty", "direct_json;empty_after_filter", 0, "parse_fail_bad_field", "parse_fail_bad_field", ""), ('[{"user_name": "a", "content": "", "type": "赞"}]', "parse_fail_bad_field", "direct_json;bad_field", 0, "parse_fail_bad_field", "parse_fail_bad_field", "a"),
    ('[{"user_name": 1, "content": "", "type": "评论"}]', "parse_fail_field_not_str", "direct_json;field_not_str", 0, "parse_fail_field_not_str", "parse_fail_field_not_str", None), ("[1]", "parse_fail_item_not_dict", "direct_json;item_not_dict", 0, "parse_fail_item_not_dict", "parse_fail_item_not_dict", ""),
    ("", "parse_fail_empty", "empty_output", 0, "parse_fail_empty", "parse_fail_empty", ""), ("words", "parse_fail_json", "fail", 0, "parse_fail_json", "parse_fail_json", "words"),
)


def _formed(spark: SparkSession, d: str, skip: tuple[int, ...] = ()) -> DataFrame:
    kept = [f[0] for i, f in enumerate(FORMS) if i not in skip]
    return table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, kept)), (F.col("event_id") % len(kept)).cast("int")).alias("output"))


def _expected(*columns: tuple[int, str], skip: tuple[int, ...] = ()) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    kept = [f for i, f in enumerate(FORMS) if i not in skip]
    return "SELECT event_id, " + ", ".join(f"[{', '.join(cell(f[at]) for f in kept)}][event_id % {len(kept)} + 1] AS {name}" for at, name in columns) + " FROM events"


@query(_expected((1, "status"), (2, "note"), (3, "n_items")))
def r1_r5_r6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Outputs mended, with the way each was read."""
    out = _formed(spark, d).select("event_id", lenient.cleaned(F.col("output")).alias("c"))
    return out.select("event_id", "c.status", "c.note", F.size("c.items").alias("n_items"))


@query()
def r1_r5_cleaned_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """The same over the outputs of rollouts."""
    out = table(spark, d, "rollout").select("rollout_id", lenient.cleaned(F.col("output_text")).alias("c"))
    return out.select("rollout_id", F.size("c.items").alias("n_items"), "c.status", "c.note", "c.sound")


@query(_expected((4, "status")))
def r3_r7_checked(spark: SparkSession, d: str) -> DataFrame:
    return _formed(spark, d).select("event_id", lenient.checked_status(F.col("output")).alias("status"))


@query(_expected((5, "status")))
def r8_r27_checked_plain(spark: SparkSession, d: str) -> DataFrame:
    return _formed(spark, d).select("event_id", lenient.checked_status(F.col("output"), mend=False).alias("status"))


@query(_expected((6, "names"), skip=(13,)))
def r11_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of a loose structure; words that are no structure are a name themselves."""
    return _formed(spark, d, skip=(13,)).select("event_id", F.array_join(lenient.loose_names(F.col("output")), "|").alias("names"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'parse_fail_bad_field' WHEN 'click' THEN 'parse_fail_json' ELSE 'ok' END AS status FROM events) GROUP BY status""")
def r9_canonical_status(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.col("event_type") == "error", "parse_fail").when(F.col("event_type") == "click", "parse_fail_can't_load").otherwise("ok")
    return table(spark, d, "events").select(lenient.canonical_status(old).alias("status")).groupBy("status").agg(F.count("*").alias("n"))
