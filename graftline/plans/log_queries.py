"""Ordered-log analytics on events and console documents; message and gold statistics on sft and rollout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import dates, metrics
from graftline.operators import logs, samples
from graftline.plans.registry import Registry
from graftline.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("WITH m AS (SELECT user_id, max(ts) AS latest FROM events GROUP BY user_id) SELECT event_id, e.user_id FROM events e LEFT JOIN m USING (user_id) WHERE coalesce(e.ts >= m.latest - INTERVAL 7 DAY, true)")
def sel_p2_a1_retained(spark: SparkSession, d: str) -> DataFrame:
    return logs.retained(_events(spark, d), "user_id", "ts", 7).select("event_id", "user_id")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events")
def w1_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", F.round(logs.smoothed("value", ["user_id"], ["ts", "event_id"], 5), 6).alias("smooth"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def w2_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Number of each event in the order of the whole log."""
    return samples.global_rank(_events(spark, d).select("event_id", "ts"), "ts", "event_id").select("event_id", F.col("rank").alias("seq"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS x FROM events WHERE event_type = 'purchase'")
def w3_plot_positions(spark: SparkSession, d: str) -> DataFrame:
    return samples.numbered(_events(spark, d).where("event_type = 'purchase'"), ["user_id"], "ts", "event_id").select("event_id", F.col("pos").alias("x"))


def _trainer_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as the log of a trainer: epochs, steps with their loss, and micro batches."""
    e = samples.numbered(_events(spark, d), ["user_id"], "ts", "event_id")
    k = lambda m: (F.col("event_id") % m).cast("string")
    loss = F.concat(F.lit("0."), F.lpad(k(1000), 3, "0"))
    step = F.concat(F.lit("\x1b[36mstep:"), k(10_000), F.lit(" - train/loss:"), loss, F.lit(" - train/cls_weight:1.0 - train/gen_weight:2e-1 - train/cls_loss:0.1 - train/cls0_loss:0.1 - train/cls1_loss:0 - train/content_loss:0\x1b[0m"))
    micro = F.concat(F.lit("[micro] "), k(4), F.lit("/4 | cls0="), loss, F.lit("e-1 cls1=0.0000 content=-1.5 | depth0="), k(3), F.lit(" depth1=0 pairs=16"))
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("Epoch "), k(7), F.lit(" / 7"))).when(F.col("event_type") == "purchase", step).otherwise(micro)
    return e.select(F.col("user_id").alias("file"), F.col("pos").alias("line_no"), line.alias("line"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
c AS (SELECT user_id AS file, CAST(pos AS INTEGER) AS line_no, event_id, event_type, CAST(last_value(CASE WHEN event_type = 'signup' THEN event_id % 7 END IGNORE NULLS) OVER w AS INTEGER) AS epoch,
 CAST(last_value(CASE WHEN event_type = 'signup' THEN 7 END IGNORE NULLS) OVER w AS INTEGER) AS epoch_total, CAST(last_value(CASE WHEN event_type = 'purchase' THEN event_id % 10000 END IGNORE NULLS) OVER w AS INTEGER) AS step_in_epoch,
 last_value(CASE WHEN event_type = 'purchase' THEN (event_id % 1000) / 1000.0 END IGNORE NULLS) OVER w AS total_loss FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT file, line_no, CAST(event_id % 4 AS INTEGER) AS micro, 4 AS micro_total, epoch, epoch_total, step_in_epoch, total_loss, round((event_id % 1000) / 10000.0, 6) AS cls0_loss, CAST(0 AS DOUBLE) AS cls1_loss, CAST(-1.5 AS DOUBLE) AS content_loss,
 CAST(event_id % 3 AS INTEGER) AS depth0, 0 AS depth1, 16 AS pairs FROM c WHERE event_type NOT IN ('signup', 'purchase')""")
def w4_f17_micro_frame(spark: SparkSession, d: str) -> DataFrame:
    """Micro batches with the epoch, step and loss told before them, carried over blocks of 7 lines."""
    out = logs.micro_frame(_trainer_lines(spark, d), block=7)
    return out.withColumn("cls0_loss", F.round("cls0_loss", 6))


@query("""WITH c AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS idx FROM events),
g AS (SELECT user_id, idx, count(value) FILTER (event_type <> 'signup') AS n, round(avg(value) FILTER (event_type <> 'signup'), 6) AS mean FROM c WHERE idx > 0 GROUP BY ALL)
SELECT user_id, CAST(idx AS BIGINT) AS idx, n, mean FROM (SELECT *, max(idx) OVER (PARTITION BY user_id) AS last FROM g) WHERE idx < last OR last = 1""")
def w5_segments(spark: SparkSession, d: str) -> DataFrame:
    return logs.segments(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("value"))


@query("SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY round(value)) + (count(*) OVER (PARTITION BY user_id, round(value)) - 1) / 2.0 AS tie_rank FROM events")
def w6_tie_ranks(spark: SparkSession, d: str) -> DataFrame:
    from graftline.operators.agreement import tie_ranks

    rows = _events(spark, d).withColumn("v", F.round("value"))
    return rows.select("event_id", tie_ranks(rows, "v", ["user_id"]).alias("tie_rank"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def w7_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First event of each type of each user, by an aggregation instead of a sort."""
    return _events(spark, d).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", "m.event_id")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0)) GROUP BY sha256(text)")
def w8_distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").where(~F.col("text").contains("\x00")).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT id, list_filter(messages, lambda m: m.role = 'user')[1].content AS first_user, list_filter(messages, lambda m: m.role = 'system')[1].content AS first_system FROM sft")
def w9_first_messages(spark: SparkSession, d: str) -> DataFrame:
    first = lambda role: F.get(F.filter("messages", lambda m: m.role == role), F.lit(0)).content
    return table(spark, d, "sft").select("id", first("user").alias("first_user"), first("system").alias("first_system"))


@query("SELECT DISTINCT trajectory_id, rollout_id FROM (SELECT trajectory_id, rollout_id, depth, ts FROM (SELECT DISTINCT trajectory_id, rollout_id, depth, ts FROM rollout) QUALIFY row_number() OVER (PARTITION BY trajectory_id ORDER BY depth NULLS FIRST, ts NULLS FIRST, rollout_id) <= 3)")
def w10_turn_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first turns of each trajectory in breadth-first order (a cap is the feature here)."""
    rows = table(spark, d, "rollout").select("trajectory_id", "rollout_id", "depth", "ts").distinct()
    return samples.numbered(rows, ["trajectory_id"], "depth", "ts", "rollout_id").where("pos <= 3").select("trajectory_id", "rollout_id")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS src, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def u1_union_tagged(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    both = e.where("event_id % 2 = 0").withColumn("src", F.lit("a")).unionByName(e.where("event_id % 2 <> 0").withColumn("src", F.lit("b")))
    return both.groupBy("src", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def _kept_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of rollouts written as a console's kept-step lines and read back."""
    from graftline.plans.agreement_queries import _true

    rows = table(spark, d, "rollout").where("rollout_id IS NOT NULL AND group_id IS NOT NULL AND depth IS NOT NULL").select(
        F.col("rollout_id").alias("step_id"), "depth", "group_id", "trajectory_id", F.col("parsed_output").isNull().alias("failed"), "step_reward",
        F.to_json(F.array_distinct(F.transform(F.filter(F.coalesce("parsed_output", F.array()), lambda x: x.type.isin(1, 2) & (x.user_name != "")), lambda x: x.user_name))).alias("pred")).distinct()
    gold = _true(spark, d).groupBy("step_id").agg(F.to_json(F.sort_array(F.collect_set("name"))).alias("gold"))  # children of one parent or level
    status = F.when(F.col("failed"), "parse_fail").otherwise("ok")
    line = F.concat(
        F.lit("\x1b[36m(Worker pid=7)\x1b[0m [rollout][kept-step] group="), F.col("group_id"), F.lit(" traj="), F.col("trajectory_id"), F.lit(" depth="), F.col("depth").cast("string"), F.lit(" status="), status,
        F.lit(" step_F1(raw)="), F.coalesce(F.col("step_reward").cast("string"), F.lit("?")), F.lit(' cond_keys=["k"] gold='), F.coalesce("gold", F.lit("[]")), F.lit(" pred="), F.col("pred"))
    cells = logs.kept_step(F.col("line"))
    return rows.join(gold, "step_id", "left").select("step_id", line.alias("line")).where(logs.is_kept_step(F.col("line"))).select("step_id", *[c.alias(k) for k, c in cells.items()])


def _kept_sql(tail: str) -> str:
    from graftline.plans.agreement_queries import _STEPS

    return "WITH k AS " + _STEPS + """, u AS (SELECT DISTINCT rollout_id AS step_id, depth, parsed_output IS NULL AS failed, step_reward AS f1,
 list_distinct(list_transform(list_filter(parsed_output, lambda x: x.type IN (1, 2) AND x.user_name <> ''), lambda x: x.user_name)) AS p FROM rollout WHERE rollout_id IS NOT NULL AND group_id IS NOT NULL AND depth IS NOT NULL),
n AS (SELECT step_id, count(DISTINCT child) AS n_gold FROM t GROUP BY step_id)
SELECT u.step_id, depth, CASE WHEN failed THEN 'parse_fail' ELSE 'ok' END AS status, f1, coalesce(n_gold, 0) AS n_gold, coalesce(len(p), 0) AS n_pred FROM u LEFT JOIN n USING (step_id)) """ + tail


@query(_kept_sql("SELECT step_id, depth, status, f1, CAST(n_gold AS INTEGER) AS n_gold, CAST(n_pred AS INTEGER) AS n_pred FROM k"))
def f16_kept_step_lines(spark: SparkSession, d: str) -> DataFrame:
    return _kept_steps(spark, d).select("step_id", "depth", "status", "f1", F.size("gold").alias("n_gold"), F.size("pred").alias("n_pred"))


_FAIL, _MEAN = "starts_with(status, 'parse_fail')", "round(coalesce(avg({0}) FILTER ({1}), 0), 6)"


@query(_kept_sql("SELECT " + ", ".join(f"{_MEAN.format(*x)} AS {x[2]}" for x in (
    ("f1", f"NOT {_FAIL} AND n_gold = 0", "f1_untrue"), ("f1", f"NOT {_FAIL} AND n_gold > 0", "f1_true"), ("f1", f"NOT {_FAIL}", "f1_all"), (f"CASE WHEN {_FAIL} THEN -1.0 ELSE f1 END", "true", "reward")))
    + f", count(*) FILTER (NOT {_FAIL}) AS n_ok, count(*) AS n FROM k"))
def a21_m20_reward_means(spark: SparkSession, d: str) -> DataFrame:
    return logs.reward_means(_kept_steps(spark, d))


@query(_kept_sql("SELECT count(*) AS n, count(*) FILTER (depth = 0) AS n_root, " + ", ".join(f"round(avg(f1) FILTER ({w}), 6) AS {n}" for w, n in (
    ("depth = 0", "root_all"), ("depth <> 0", "below_all"), (f"depth = 0 AND NOT {_FAIL}", "root_ok"), (f"depth <> 0 AND NOT {_FAIL}", "below_ok"), ("depth <> 0 AND n_gold > 0", "below_true_all"), (f"depth <> 0 AND n_gold > 0 AND NOT {_FAIL}", "below_true_ok")))
    + ", round(count(*) FILTER (n_gold = 0 AND n_pred > 0) / nullif(count(*) FILTER (n_gold = 0), 0), 6) AS said_of_untrue, round(count(*) FILTER (n_pred = 0 AND n_gold > 0) / nullif(count(*) FILTER (n_pred = 0), 0), 6) AS true_of_unsaid FROM k"))
def a22_kept_means(spark: SparkSession, d: str) -> DataFrame:
    return logs.kept_means(_kept_steps(spark, d))


@query(_kept_sql(f"SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, round(sum(count(*) FILTER ({_FAIL})) OVER () / sum(count(*)) OVER (), 6) AS fail_rate FROM k GROUP BY status"))
def a19_sel_p23_status(spark: SparkSession, d: str) -> DataFrame:
    return logs.statuses(_kept_steps(spark, d))


@query(_kept_sql("SELECT depth, count(*) FILTER (n_gold > 0) AS has_gold, count(*) FILTER (n_gold = 0) AS no_gold, count(*) FILTER (n_pred > 0) AS has_pred, count(*) FILTER (n_pred = 0) AS no_pred FROM k GROUP BY depth"))
def a20_sides_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return logs.sides_by_depth(_kept_steps(spark, d))


@query("""WITH s AS (SELECT depth, step_reward FROM (SELECT DISTINCT rollout_id, depth, step_reward FROM rollout)) SELECT depth, count(*) AS n, count(*) FILTER (step_reward IS NULL) AS missing, round(avg(step_reward), 6) AS mean FROM s GROUP BY ROLLUP (depth)""")
def a24_reward_by_depth(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollout").select("rollout_id", "depth", "step_reward").distinct()
    return rows.rollup("depth").agg(F.count("*").alias("n"), F.count_if(F.col("step_reward").isNull()).alias("missing"), F.round(F.avg("step_reward"), 6).alias("mean"))


@query("SELECT count(*) AS n, round(avg(step_reward), 6) AS mean, count(*) FILTER (abs(step_reward) < 1e-12) AS n_zero, max(len(parsed_output)) AS max_items FROM (SELECT DISTINCT rollout_id, step_reward, parsed_output FROM rollout)")
def a32_batch_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollout").select("rollout_id", "step_reward", "parsed_output").dropDuplicates()
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("step_reward"), 6).alias("mean"), F.count_if(F.abs("step_reward") < 1e-12).alias("n_zero"), F.max(F.size("parsed_output")).cast("bigint").alias("max_items"))


@query("SELECT id, CAST(i AS INTEGER) AS turn, u, a FROM (SELECT id, unnest(range(1, len(messages))) AS i, messages FROM (SELECT DISTINCT id, messages FROM sft)), LATERAL (SELECT messages[i].content AS u, messages[i + 1].content AS a) WHERE messages[i].role = 'user' AND messages[i + 1].role = 'assistant'")
def j17_turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant turn that follows, by position inside the array: no join and no shuffle of texts."""
    rows = table(spark, d, "sft").select("id", "messages").dropDuplicates()
    pair = F.transform("messages", lambda m, i: F.struct((i + 1).alias("turn"), m.role.alias("r1"), m.content.alias("u"), F.get("messages", i + 1).role.alias("r2"), F.get("messages", i + 1).content.alias("a")))
    return rows.select("id", F.inline(F.filter(pair, lambda p: (p.r1 == "user") & (p.r2 == "assistant")))).select("id", "turn", "u", "a")


@query("SELECT role, count(*) AS n, count(*) FILTER (content IS NULL) AS n_null, round(avg(length(content)), 6) AS mean_chars FROM (SELECT unnest(messages, recursive := true) FROM sft) GROUP BY role")
def sel_p22_role_stats(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sft").select(F.inline("messages"))
    return m.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("content").isNull()).alias("n_null"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"))


@query("""SELECT node_depth, count(*) FILTER (t = 0) AS t0, count(*) FILTER (t = 1) AS t1, count(*) FILTER (t = 2) AS t2, count(*) FILTER (t IS NULL OR t NOT IN (0, 1, 2)) AS other
 FROM (SELECT node_depth, unnest(targets_per_potential_types) AS t FROM sft) GROUP BY node_depth""")
def a8_type_distribution(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sft").select("node_depth", F.explode("targets_per_potential_types").alias("t"))
    return t.groupBy("node_depth").agg(*[F.count_if(F.col("t") == k).alias(f"t{k}") for k in (0, 1, 2)], F.count_if(F.col("t").isNull() | ~F.col("t").isin(0, 1, 2)).alias("other"))


@query("SELECT node_depth, count(*) FILTER (n > 0) AS valid, count(*) FILTER (n = 0) AS invalid, count(*) FILTER (n IS NULL) AS missing, CAST(sum(c) AS BIGINT) AS n_comments FROM (SELECT node_depth, len(targets_per_potential_types) AS n, len(list_filter(targets_per_potential_types, lambda x: x = 1)) AS c FROM sft) GROUP BY node_depth")
def a9_a11_validity(spark: SparkSession, d: str) -> DataFrame:
    n = F.array_size("targets_per_potential_types")
    ones = F.array_size(F.filter("targets_per_potential_types", lambda x: x == 1))
    return table(spark, d, "sft").groupBy("node_depth").agg(F.count_if(n > 0).alias("valid"), F.count_if(n == 0).alias("invalid"), F.count_if(n.isNull()).alias("missing"), F.sum(ones).cast("bigint").alias("n_comments"))


@query("SELECT count(*) AS n, count(*) FILTER (id LIKE '%#_tL0%' ESCAPE '#') AS tl0, count(*) FILTER (id LIKE '%#_tL1%' ESCAPE '#') AS tl1, count(*) FILTER (TRY_CAST(nullif(regexp_extract(id, '_tL(\\d+)', 1), '') AS INTEGER) <> node_depth) AS mismatch FROM sft".replace("\\\\", "\\"))
def a18_layer_check(spark: SparkSession, d: str) -> DataFrame:
    layer = F.regexp_extract("id", r"_tL(\d+)", 1).try_cast("int")
    return table(spark, d, "sft").agg(F.count("*").alias("n"), F.count_if(F.col("id").contains("_tL0")).alias("tl0"), F.count_if(F.col("id").contains("_tL1")).alias("tl1"), F.count_if(layer != F.col("node_depth")).alias("mismatch"))


@query("SELECT l.doc_id, l.line_no, TRY_CAST(nullif(regexp_extract(l.line, 'step:(\\d+)', 1), '') AS BIGINT) AS step, TRY_CAST(nullif(regexp_extract(l.line, 'actor/pg_loss:([-+0-9.eE]+)', 1), '') AS DOUBLE) AS pg_loss, TRY_CAST(nullif(regexp_extract(l.line, 'critic/score/mean:([-+0-9.eE]+)', 1), '') AS DOUBLE) AS score FROM (SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE source = 'console')) l WHERE contains(l.line, 'step:')")
def f17_train_steps(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("source = 'console'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cells = logs.train_step(F.col("line"))
    return lines.where(F.col("line").contains("step:")).select("doc_id", "line_no", *[c.alias(k) for k, c in cells.items()])


@query(r"""SELECT doc_id, CAST(regexp_extract(line, 'depth=(\d+)', 1) AS INTEGER) AS depth, regexp_extract(line, 'cond_key=(\S+)', 1) AS key, CAST(regexp_extract(line, 'f1=(\S+)', 1) AS DOUBLE) AS f1,
 CAST(regexp_extract(line, 'gold=(\[.*?\])', 1) AS VARCHAR[]) AS gold, list_transform(CAST(regexp_extract(line, 'pred=(\[.*?\])', 1) AS JSON)::JSON[], lambda x: x ->> '$') AS pred
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'console') WHERE starts_with(line, '[keep]') AND regexp_matches(line, 'f1=\S+$')""")
def f16_kept_steps(spark: SparkSession, d: str) -> DataFrame:
    """Kept-step lines of console documents, with truth and predictions."""
    lines = table(spark, d, "documents").where("source = 'console'").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    cells = logs.kept_step(F.col("line"))
    return lines.where(F.col("line").startswith("[keep]") & F.col("line").rlike(r"f1=\S+$")).select("doc_id", *[cells[k].alias(k) for k in ("depth", "key", "f1", "gold", "pred")])


@query("SELECT row_id, try_strptime(regexp_replace(regexp_replace(post.created_at, '\\s+', ' ', 'g'), '^\\s*[A-Za-z]{3} ', ''), '%b %d %H:%M:%S %z %Y') AT TIME ZONE 'UTC' AS created FROM raw_posts WHERE post IS NOT NULL")
def fd1_created_at(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_posts").where("post IS NOT NULL").select("row_id", dates.created_at(F.col("post.created_at")).cast("timestamp_ntz").alias("created"))


@query("SELECT c_custkey, CASE WHEN o = 0 THEN '0.00%' ELSE printf('%.2f%%', f * 100.0 / o) END AS pct FROM (SELECT c_custkey, count(o_orderkey) AS o, count(o_orderkey) FILTER (o_orderstatus = 'F') AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def m12_percent(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0).select("c_custkey", metrics.percent(F.col("f"), F.col("o")).alias("pct"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def m18_first_best(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", metrics.first_best(F.col("embedding")).alias("best"))


@query("SELECT id, list_transform(m, lambda x: CASE WHEN x > 0 THEN round(0.6 / list_sum(m), 9) ELSE 0 END)::DOUBLE[] AS shares FROM (SELECT id, list_transform(targets_per_potential_types, lambda x: CAST(least(coalesce(x, 0), 1) AS DOUBLE)) AS m FROM (SELECT DISTINCT id, targets_per_potential_types FROM sft) WHERE len(targets_per_potential_types) > 0)")
def m15_reward_shares(spark: SparkSession, d: str) -> DataFrame:
    mask = F.transform("targets_per_potential_types", lambda x: F.least(F.coalesce(x, F.lit(0)), F.lit(1)).cast("double"))
    rows = table(spark, d, "sft").select("id", "targets_per_potential_types").distinct().where("size(targets_per_potential_types) > 0")
    return rows.select("id", F.transform(metrics.spread_reward(F.lit(0.6), mask), lambda x: F.round(x, 9)).alias("shares"))


@query("SELECT id, list_transform(range(1, len(m) + 1), lambda i: greatest(CAST(list_sum(m[1:i]) AS INTEGER) - 1, 0)) AS positions FROM (SELECT id, list_transform(targets_per_potential_types, lambda x: least(coalesce(x, 0), 1)) AS m FROM (SELECT DISTINCT id, targets_per_potential_types FROM sft) WHERE len(targets_per_potential_types) > 0)")
def m17_positions(spark: SparkSession, d: str) -> DataFrame:
    mask = F.transform("targets_per_potential_types", lambda x: F.least(F.coalesce(x, F.lit(0)), F.lit(1)))
    rows = table(spark, d, "sft").select("id", "targets_per_potential_types").distinct().where("size(targets_per_potential_types) > 0")
    return rows.select("id", metrics.positions(mask).alias("positions"))


@query("SELECT id, list_resize(coalesce(targets_per_potential_types, []), 6, -1) AS padded FROM (SELECT DISTINCT id, targets_per_potential_types FROM sft)")
def m16_padded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft").select("id", "targets_per_potential_types").distinct()
    return rows.select("id", metrics.pad(F.coalesce("targets_per_potential_types", F.array().cast("array<int>")), 6, -1).alias("padded"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank, count(*) OVER () AS n FROM orders) WHERE rank <= n - n % 7")
def o9_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """The longest head whose length divides by 7."""
    o = table(spark, d, "orders").select("o_orderkey")
    n = o.count()
    return samples.global_rank(o, "o_orderkey").where(F.col("rank") <= n - n % 7).select("o_orderkey")


@query("SELECT id FROM (SELECT DISTINCT id, targets_per_potential_types AS t FROM sft) WHERE list_sum(list_transform(t, lambda x: coalesce(x, 0))) > 0")
def sel_p18_valid_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft").select("id", "targets_per_potential_types").distinct()
    return rows.where(F.aggregate("targets_per_potential_types", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) > 0).select("id")


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def o1_o2_longest(spark: SparkSession, d: str) -> DataFrame:
    """The 50 longest documents: each task keeps 50, the driver merges."""
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
