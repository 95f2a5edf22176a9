"""Sources and sinks, each as a round trip through the shared folder; rollouts; streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators import rollout
from graftline.plans.registry import Registry
from graftline.runtime import Scratch
from graftline.sources import readers, writers
from graftline.sources.tables import table
from graftline.streaming import logs

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _folder(spark: SparkSession, label: str) -> str:
    return Scratch(spark, label).root


@query("SELECT event_id, user_id, event_type, value FROM events")
def s1_k3_jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s1")
    writers.jsonl(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path)
    return readers.jsonl_strict(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("SELECT json_extract_string(line, '$.author') AS author, count(*) AS n FROM sft_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT' GROUP BY 1")
def s2_jsonl_tolerant(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s2")
    table(spark, d, "sft_lines").where("line IS NOT NULL").select("line").write.text(path)
    got = readers.jsonl_tolerant(spark, path, "author string")
    return got.groupBy("author").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def s3_s4_json_array(spark: SparkSession, d: str) -> DataFrame:
    """The 25 nations as one JSON array, told from JSON lines by its first character."""
    path = _folder(spark, "s3")
    cells = table(spark, d, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))  # a fixed table
    cells.coalesce(1).write.text(path)
    return readers.records(spark, path, "n_nationkey int, n_name string")


@query("SELECT r_regionkey, r_name FROM region")
def s3_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s3l")
    writers.jsonl(table(spark, d, "region"), path)
    return readers.records(spark, path, "r_regionkey int, r_name string")


@query("""WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS user_id, CAST(n_regionkey AS VARCHAR) AS anon_id FROM nation), r AS (SELECT CAST(r_regionkey AS VARCHAR) AS anon_id, r_name FROM region WHERE r_regionkey > 0)
SELECT user_id, anon_id, coalesce(r_name, '') AS interests FROM n LEFT JOIN r USING (anon_id)""")
def s5_j1_profile_maps(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s5")
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))  # noqa: E731  # fixed tables of 25 and 5 rows
    table(spark, d, "nation").agg(F.to_json(pairs(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))).alias("value")).coalesce(1).write.text(f"{path}/ids")
    profile = F.struct(F.array("r_name").alias("user_interests"), F.lit("-").alias("user_description"))
    table(spark, d, "region").where("r_regionkey > 0").agg(F.to_json(pairs(F.col("r_regionkey").cast("string"), profile)).alias("value")).coalesce(1).write.text(f"{path}/graph")
    return readers.profile_maps(spark, f"{path}/graph", f"{path}/ids").select("user_id", "anon_id", F.array_join("interests", ",").alias("interests"))


@query("SELECT count(*) AS n, count(messages) AS n_messages FROM sft")
def s6_s7_projection(spark: SparkSession, d: str) -> DataFrame:
    return readers.parquet_columns(spark, [f"{d}/sft.parquet"], ["id", "messages", "not_there"]).agg(F.count("id").alias("n"), F.count("messages").alias("n_messages"))


@query("SELECT count(*) AS n FROM comments")
def s9_per_file(spark: SparkSession, d: str) -> DataFrame:
    return readers.per_file(table(spark, d, "comments")).agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT rollout_id, len(parsed_output) AS n FROM rollout WHERE parsed_output IS NOT NULL")
def s14_k5_message_cells(spark: SparkSession, d: str) -> DataFrame:
    """Arrays written as JSON text and read back."""
    path = _folder(spark, "s14")
    rows = table(spark, d, "rollout").where("parsed_output IS NOT NULL").select("rollout_id", F.transform("parsed_output", lambda x: F.struct(x.user_name.alias("role"), x.content.alias("content"))).alias("messages")).distinct()
    writers.messages_as_json(rows, path)
    return spark.read.parquet(path).select("rollout_id", F.size(readers.messages_of(F.col("messages"))).cast("bigint").alias("n"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS line_no, regexp_replace(line, '\\x1B\\[[0-?]*[ -/]*[@-~]', '', 'g') AS line FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE source = 'console'))")
def s13_console_lines(spark: SparkSession, d: str) -> DataFrame:
    from graftline.functions.text import strip_ansi

    lines = table(spark, d, "documents").where("source = 'console'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", strip_ansi(F.col("line")))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s12_text_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text files in order, from whole files."""
    path = _folder(spark, "s12")
    table(spark, d, "supplier").select(F.concat_ws("\t", "s_suppkey", "s_name", "s_acctbal").alias("value")).write.text(path)
    cells = F.split("line", "\t")
    return readers.text_lines(spark, path).select(cells[0].cast("bigint").alias("s_suppkey"), cells[1].alias("s_name"), cells[2].cast("double").alias("s_acctbal"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def k7_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "k7")
    writers.csv(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey bigint, p_name string, p_size int").option("header", True).option("escape", '"').csv(path)


@query("SELECT 0 AS n, 'doc_id,text,lang,source,n_chars,author,posted_at,record_id' AS cols")
def k1_empty_parquet(spark: SparkSession, d: str) -> DataFrame:
    """An empty table keeps its columns through a write."""
    path = _folder(spark, "k1")
    writers.parquet(table(spark, d, "documents").where("doc_id < 0 AND doc_id > 0"), path)
    back = spark.read.parquet(path)
    return back.agg(F.count("*").cast("int").alias("n")).withColumn("cols", F.lit(",".join(back.columns)))


@query("SELECT group_id, count(*) AS n FROM rollout GROUP BY group_id")
def k8_append_log(spark: SparkSession, d: str) -> DataFrame:
    """Two appends of the allowed keys."""
    path = _folder(spark, "k8")
    rows = table(spark, d, "rollout")
    writers.append_log(rows.where("rollout_id % 2 = 0"), path)
    writers.append_log(rows.where("rollout_id % 2 <> 0"), path)
    return spark.read.schema("group_id string").json(path).groupBy("group_id").agg(F.count("*").alias("n"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    """A root (record_id, user) for each post of the comments."""
    return table(spark, d, "comments").where("post_id IS NOT NULL").groupBy(F.col("post_id").cast("string").alias("record_id")).agg(F.min("user_id").cast("string").alias("user")).na.fill("nobody", ["user"])


_ROOTS = "WITH r AS (SELECT CAST(post_id AS VARCHAR) AS record_id, coalesce(CAST(min(user_id) AS VARCHAR), 'nobody') AS u FROM comments WHERE post_id IS NOT NULL GROUP BY 1), k AS (SELECT unnest(['.0', '.1']) AS k)"


@query(_ROOTS + """, n AS (SELECT record_id, 0 AS depth, u AS "user" FROM r UNION ALL SELECT record_id, 1, u || k FROM r, k UNION ALL SELECT record_id, 2, u || a.k || b.k FROM r, k a, k b)
SELECT record_id, CAST(trajectory AS INTEGER) AS trajectory, depth, "user" AS user_name, CASE WHEN depth = 0 THEN 'three' ELSE 'two' END AS head, 2 AS n_pred, CASE WHEN depth = 0 THEN 2 ELSE 0 END AS n_gold, depth > 0 AS parent_missing,
 CASE WHEN depth = 0 THEN round(2 * (2 / (2 + 1e-6)) * (2 / (2 + 1e-6)) / (2 * (2 / (2 + 1e-6)) + 1e-6), 6) ELSE 0.0 END AS f1 FROM n, (SELECT unnest([0, 1]) AS trajectory)""")
def t9_t10_rollout(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first rollout of all posts with a stand-in model, scored against the children that it names at the root."""
    roots = _roots(spark, d)
    gold = roots.select("record_id", F.lit(0).alias("depth"), F.col("user").alias("parent"), F.explode(F.array(F.concat("user", F.lit(".0")), F.concat("user", F.lit(".1")))).alias("child"))
    out = rollout.ROLLOUTS["self_play"](roots, gold, rollout.fixed_model(2), depth_limit=2, turns=8, trajectories=2)
    return out.select("record_id", "trajectory", "depth", F.col("user").alias("user_name"), rollout.head_of(F.col("depth")).alias("head"), "n_pred", F.col("n_gold").cast("int").alias("n_gold"), "parent_missing", "f1")


@query(_ROOTS + """, n AS (SELECT record_id, 0 AS depth, u AS "user", 'ok' AS status, 3 AS n_pred, 1 AS n_gold, 1 AS tp, round(2 * (1 / 3.0) / (1 / 3.0 + 1), 6) AS f1, round(2 * (1 / 3.0) / (1 / 3.0 + 1), 6) AS reward FROM r
 UNION ALL SELECT record_id, 1, u || k, 'parse_fail_json', 0, 1, 0, NULL, -1.0 FROM r, k) SELECT record_id, depth, "user" AS user_name, status, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_gold AS BIGINT) AS n_gold, CAST(tp AS BIGINT) AS tp, f1, reward FROM n""")
def t11_t12_j14_m20_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """A model that answers with text: three names at the root, of which the pool holds two, and what cannot be read below."""
    import pandas as pd

    def model(batch: pd.DataFrame) -> pd.Series:
        item = '{{"user_name": "{}", "content": "", "type": "评论"}}'
        return pd.Series([f"[{', '.join(item.format(x) for x in (f'{u}.0', 'stranger', f'{u}.1'))}]" if d == 0 else "so {" for u, d in zip(batch["user"], batch["depth"])], index=batch.index)

    roots = _roots(spark, d)
    kids = roots.select("record_id", F.explode(F.array(F.concat("user", F.lit(".0")), F.concat("user", F.lit(".1")))).alias("user"), F.array(F.lit("x")).alias("interests"))
    levels = kids.where("user LIKE '%.0'").select("record_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("depth"), F.col("user").alias("child"))
    out = rollout.evaluate(roots, levels, model, turns=20, pool=kids)
    return out.select("record_id", "depth", F.col("user").alias("user_name"), "status", "n_pred", "n_gold", "tp", "f1", "reward")


@query("SELECT trajectory_id, round(avg(step_reward), 6) AS reward FROM (SELECT DISTINCT trajectory_id, rollout_id, step_reward FROM rollout) GROUP BY trajectory_id")
def x2_trajectory_rewards(spark: SparkSession, d: str) -> DataFrame:
    """A reward of each trajectory by a function named in a configuration."""
    steps = table(spark, d, "rollout").select("trajectory_id", "rollout_id", "step_reward").distinct()
    out = rollout.trajectory_rewards(steps, "trajectory_id", "step_reward", "graftline.operators.rollout:mean_reward")
    return out.withColumn("reward", F.round("reward", 6))


@query("SELECT count(*) AS n_rows, count(*) FILTER (node_depth = 0) AS depth0, count(*) FILTER (node_depth = 1) AS depth1, count(*) FILTER (l = 0) AS v_tl0, count(*) FILTER (l = 1) AS v_tl1, count(*) FILTER (l IS NULL) AS v_unknown, count(*) FILTER (node_depth IN (0, 1) AND l <> node_depth) AS mismatch FROM (SELECT node_depth, TRY_CAST(nullif(regexp_extract(list_filter(messages, lambda m: m.role = 'user')[1].content, '<TL([01])>\\s*$', 1), '') AS INTEGER) AS l FROM sft)")
def s8_scan_layers(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan_layers(table(spark, d, "sft"), verify=True)


@query("SELECT id, len(messages) AS n FROM sft")
def s10_tolerant_columns(spark: SparkSession, d: str) -> DataFrame:
    """Those of the wanted columns that a file has."""
    return readers.parquet_columns(spark, [f"{d}/sft.parquet"], ["id", "messages", "not_there"]).select("id", F.size("messages").cast("bigint").alias("n"))


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS line_no, s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 7")
def s11_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first seven lines of a file (a limit is the feature here)."""
    path = _folder(spark, "s11")
    table(spark, d, "supplier").orderBy("s_suppkey").select(F.concat_ws("\t", "s_suppkey", "s_name").alias("value")).coalesce(1).write.text(path)
    cells = F.split("line", "\t")
    return readers.first_lines(spark, path, 7).select("line_no", cells[0].cast("bigint").alias("s_suppkey"), cells[1].alias("s_name"))


@query("SELECT id, coalesce(len(targets_per_potential_types), 0) AS n_types, coalesce(len(targets_comment_texts), 0) AS n_texts, sft_chunk_info FROM sft")
def k0_typed_samples(spark: SparkSession, d: str) -> DataFrame:
    out = writers.typed_samples(table(spark, d, "sft"))
    return out.select("id", F.size("targets_per_potential_types").cast("bigint").alias("n_types"), F.size("targets_comment_texts").cast("bigint").alias("n_texts"), "sft_chunk_info")


@query("SELECT c_custkey, c_name, 'gzip' AS codec FROM customer")
def k2_codec_chain(spark: SparkSession, d: str) -> DataFrame:
    """A codec that does not exist gives way to the next."""
    path = _folder(spark, "k2")
    codec = writers.parquet_somehow(table(spark, d, "customer").select("c_custkey", "c_name"), path, ("no_such_codec", "gzip"))
    return spark.read.parquet(path).withColumn("codec", F.lit(codec))


@query("SELECT n_nationkey, n_name FROM nation")
def k4_pretty_json(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "k4")
    writers.pretty_json(table(spark, d, "nation").select("n_nationkey", "n_name"), path, 25)  # a fixed table
    return readers.json_array(spark, path, "n_nationkey int, n_name string")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def k6_head_json(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred rows as JSON lines (a limit is the feature here)."""
    path = _folder(spark, "k6")
    writers.head_json(table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), path, 100)
    return spark.read.schema("o_orderkey bigint, o_totalprice double").json(path)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def st1_stream_means(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows of a tailed log dropped by the stream, then summed."""
    path = _folder(spark, "st1")
    e = table(spark, d, "events").select("ts", "user_id", "event_id", "event_type", "value")
    e.unionAll(e).write.json(f"{path}/log")
    once = logs.drained(logs.distinct_steps(logs.tail(spark, f"{path}/log"), "4000 days"), path)
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH c AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS idx FROM events),
g AS (SELECT user_id, CAST(idx AS BIGINT) AS idx, count(*) FILTER (event_type <> 'signup') AS n, round(coalesce(sum(value) FILTER (event_type <> 'signup'), 0), 4) AS total FROM c WHERE idx > 0 GROUP BY ALL)
SELECT user_id, idx, n, total FROM (SELECT *, max(idx) OVER (PARTITION BY user_id) AS last FROM g) WHERE idx < last""")
def st2_stream_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments between markers, kept as state of a stream."""
    path = _folder(spark, "st2")
    table(spark, d, "events").select("ts", "user_id", "event_id", "event_type", "value").write.json(f"{path}/log")
    out = logs.drained(logs.running_segments(logs.tail(spark, f"{path}/log"), "signup"), path)
    return out.select("user_id", "idx", "n", F.round("total", 4).alias("total"))

