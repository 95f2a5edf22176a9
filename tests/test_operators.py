"""Hand-derived cases of the reference's operators."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from graftline.functions import dates, lenient, metrics, text
from graftline.operators import agreement as ag
from graftline.operators import logs, rollout, samples, trees
from graftline.sources import readers, writers
from graftline.streaming import logs as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_created_at(spark):
    assert one(spark, dates.created_at(F.lit("Wed Dec 20 10:35:09 +0800 2023"))) == dt.datetime(2023, 12, 20, 2, 35, 9)
    assert one(spark, dates.created_at(F.lit("zzz"))) is None and one(spark, dates.created_at(F.lit(None).cast("string"))) is None


def test_retention_keeps_recent_and_unknown(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    df = spark.createDataFrame([(1, 7, day(0)), (2, 7, day(3)), (3, 7, day(10)), (4, 7, None), (5, None, day(0))], "id int, u int, t timestamp")
    assert {r.id for r in logs.retained(df, "u", "t", 7).collect()} == {2, 3, 4, 5}


@pytest.mark.parametrize(("raw", "cut"), [("hi //@bob: yo", "hi"), (" hi ", "hi"), ("/@x", ""), ("a /@b //@c", "a"), ("　x　", "x"), (None, None)])
def test_repost_tail(spark, raw, cut):
    assert one(spark, text.strip_repost_tail(F.lit(raw).cast("string"))) == cut


def test_text_functions(spark):
    assert one(spark, text.between_markers(F.lit("a<|cstart|>b<|cend|>c"))) == "b" and one(spark, text.between_markers(F.lit("abc"))) == "abc"
    assert one(spark, text.strip_chat_artifacts(F.lit("```json\n[]\n```"))) == "[]" and one(spark, text.strip_chat_artifacts(F.lit("<|im_start|>assistant\n[1]<|im_end|>"))) == "[1]"
    assert one(spark, text.strip_chat_artifacts(F.lit(" ``` JSON\n<|im_start|> user \n[user bob] hi <|IM_END|>\n x<|im_start|>y \n```"))) == "hi \n x<|im_start|>y"
    assert [one(spark, text.interact_tag(F.lit(s))) for s in ("[INTERACT=0]", "interact: 1\n[]", "[]")] == [0, 1, None]
    assert one(spark, text.split_names(F.lit("a、b， c"))) == ["a、b", "c"] and one(spark, text.split_names(F.lit(" solo "))) == ["solo"]
    assert one(spark, text.reaction(F.lit("评论"), F.lit("ok //@z"))) == 2 and one(spark, text.no_trailing_commas(F.lit('[{"a":1,},]'))) == '[{"a":1}]'
    block = one(spark, text.render_candidates(F.array(F.lit("a")), F.array(F.array(F.lit("x"))), F.lit(1)))
    assert block == '<POTENTIAL_SPANS><|psep|>{"user_name":"a","interests":["x"],"depth":1}<|psep|></POTENTIAL_SPANS>'
    assert one(spark, text.candidates(F.lit("username: q\n" + block))) == ['{"user_name":"a","interests":["x"],"depth":1}'] and one(spark, text.candidate_depth(F.lit(block))) == 1


def test_lenient_reading(spark):
    assert lenient.read_list('[{"user_name":"a"},]') == ([{"user_name": "a"}], "slice_json_array_fix_commas")
    assert lenient.close_truncated('[{"user_name":"a"},{"user_na') == '[{"user_name":"a"}]'
    assert lenient.clean_output("", 0, "peeled_header_bracket") == ([], "no_interaction", "peeled_header_bracket", True)
    assert lenient.read_list('[1, [2, ], {"a": 3 ,\n} , ]') == ([1, [2], {"a": 3}], "slice_json_array_fix_commas") and lenient.read_list("x [1, [2] y") == (None, "fail")
    assert lenient.read_list("so: [1, [2]] and [3]") == ([1, [2]], "slice_json_array") and lenient.read_list("[[1], [2") == ([[1], [2]], "slice_json_array")
    assert lenient.read_list("['a', 'b',]") == (["a", "b"], "literal_eval_fix_commas") and lenient.read_list("{'a': 1}") == ([{"a": 1}], "wrapped_literal_eval") and lenient.read_list("['a\\'s']") == (["a's"], "literal_eval_fix_commas")
    assert lenient.clean_output(None)[1] == "parse_fail_empty" and lenient.clean_output("[]")[1] == "empty" and lenient.clean_output("x")[1] == "parse_fail_json"
    good = '{"user_name": " a ", "content": "c", "type": "转发"}'
    assert lenient.clean_output(f"text {good}")[1] == "parse_fail_json" and lenient.clean_output(good) == ([{"user_name": "a", "content": "c", "type": "转发微博"}], "ok_repaired", "wrapped_as_list", True)
    assert lenient.check_output('[{"user_name":"","content":"","type":"评论"}]') == ([], "parse_fail_bad_field") and lenient.check_output("{}")[1] == "parse_fail_not_list" and lenient.check_output("[1]")[1] == "parse_fail_item_not_dict"
    assert lenient.check_output('[{"user_name":"a","content":"","type":"评论"},{"us')[1] == "ok_repaired" and lenient.check_output('[{"user_name":"a"', mend=False)[1] == "parse_fail_json"
    assert lenient.names(["a", '["b", {"user_name": "c"}]', {"name": "a"}, None]) == ["a", "b", "c"]
    raw = ["[]", None, "  ", "[INTERACT=0]", "```json\n[x, INTERACT : 1 y]\n[]\n```", "<|im_start|>assistant\nINTERACT=1\n[1]<|im_end|>", "INTERACT=0 but", "[user a]\n[1, 2"]
    got = [(r.x.status, r.x.note) for r in spark.createDataFrame([(x,) for x in raw], "s string").coalesce(1).select(lenient.cleaned(F.col("s")).alias("x")).collect()]
    assert got == [("empty", "explicit_empty"), ("parse_fail_empty", "empty_output"), ("parse_fail_empty", "empty_output"), ("no_interaction", "peeled_header_bracket"), ("empty", "explicit_empty"),
                   ("parse_fail_item_not_dict", "peeled_header_nobracket;direct_json;item_not_dict"), ("parse_fail_json", "fail"), ("parse_fail_item_not_dict", "slice_json_array;item_not_dict")]
    assert one(spark, lenient.canonical_status(F.lit("parse_fail"))) == "parse_fail_bad_field" and one(spark, lenient.canonical_status(F.lit("ok"))) == "ok"


def test_public_fields_hide_the_truth(spark):
    from graftline.functions import records

    cell = '{"user": "a", "_x": 1, ' + ", ".join(f'"{k}": 1' for k in records.PRIVATE) + ', "text": "b"}'
    assert one(spark, records.public_fields(F.lit(cell))) == {"user": "a", "text": "b"} and len(records.PRIVATE) == 9


def test_step_measures(spark):
    v = lambda *x: [F.lit(y) for y in x]
    assert one(spark, metrics.step_f1(*v(1, 2, 2))) == pytest.approx(0.5, abs=1e-5) and one(spark, metrics.step_f1(*v(0, 0, 2))) == 0
    assert one(spark, metrics.turn_f1(*v(0, 0, 0))) == 1 and one(spark, metrics.turn_f1(*v(0, 1, 0))) == 0
    assert one(spark, metrics.bag_f1(*v(1, 2, 3))) == pytest.approx(0.4, abs=1e-6)
    assert one(spark, F.to_json(metrics.spread_reward(F.lit(0.6), F.array(*v(1.0, 1.0, 0.0))))) == "[0.3,0.3,0.0]"
    assert one(spark, metrics.positions(F.array(*v(0, 1, 1)))) == [0, 0, 1] and one(spark, metrics.pad(F.array(*v(1, 2, 3)), 2, 0)) == [1, 2]
    assert one(spark, metrics.percent(*v(0, 0))) == "0.00%" and one(spark, metrics.first_best(F.array(*v(1.0, 3.0, 3.0)))) == 1


def cells(spark, rows):
    return spark.createDataFrame([("t", *r) for r in rows], "group_id string, node string, n_gold bigint, n_pred bigint")


def test_sets_bags_and_panel(spark):
    rows = [(1, "t", 0, "a", False, True), (1, "t", 0, "a", True, True), (1, "t", 0, "b", False, True), (1, "t", 0, "c", True, False)]
    df = spark.createDataFrame(rows, "step_id int, group_id string, depth int, name string, gold boolean, pred boolean")
    bag = ag.by_depth(df, ["name"], True).first()
    assert (bag.tp, bag.fp, bag.fn) == (1, 2, 1)
    s = ag.by_depth(df.where("name <> 'a'").union(spark.createDataFrame([(1, "t", 0, "d", True, True)], df.schema)), ["name"], False).first()
    assert (s.tp, s.fp, s.fn) == (1, 1, 1)
    two = df.union(df.withColumn("step_id", F.lit(2)))  # each line by itself: two steps of a tree at one depth
    assert [tuple(ag.by_depth(two, ["name"], k).first())[1:4] for k in (False, True)] == [(2, 2, 2), (2, 4, 2)]
    macro = {r.depth: (r.macro_f1, r.n_trees) for r in ag.macro_bag(two).collect()}
    assert set(macro) == {0, None} and macro[0][1] == 1 and macro[0][0] == pytest.approx(0.4, abs=1e-5)
    items = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "b", 1), (1, 0, "b", 1)], "step_id int, depth int, name string, type int")
    assert tuple(ag.panel(items, spark.createDataFrame([(1, "b")], "step_id int, name string")).first()) == (0, 3, 2, 1, 1, 2, 0)
    assert {r.depth: r.tp for r in ag.overall(ag.overlap(ag.counts(df, ["group_id", "depth", "name"]), ["depth"], True)).collect()} == {0: 1, None: 1}


def test_graph_measures(spark):
    w = spark.createDataFrame([("t", "a", "b", 3, 0), ("t", "a", "c", 4, 0)], "group_id string, child string, parent string, n_gold bigint, n_pred bigint")
    e = ag.weight_errors(w).first()
    assert e.rel_error == 1.0 and (e.tp, e.fp, e.fn) == (0, 0, 2)
    assert ag.divergence(cells(spark, [("a", 1, 0), ("b", 0, 1)])).first().jsd == 1.0
    assert ag.spearman(cells(spark, [("a", 1, 2), ("b", 2, 1)])).first().rho == -1.0 and ag.spearman(cells(spark, [("a", 1, 5), ("b", 2, 5)])).first().rho == 0.0
    assert ag.gini(cells(spark, [("a", 0, 1), ("b", 1, 1)]), "n_gold", ["group_id"]).first().gini == -0.5 and ag.gini(cells(spark, [("a", 0, 1), ("b", 1, 1)]), "n_pred", ["group_id"]).first().gini == 0.0
    assert ag.ks_distance(cells(spark, [("a", 0, 1), ("b", 1, 1)]), "n_gold", "n_pred", ["group_id"]).first().ks == 0.5
    ranks = cells(spark, [("a", 1, 0), ("b", 2, 0), ("c", 2, 0), ("d", 5, 0)])
    assert sorted(r.x for r in ranks.select(ag.tie_ranks(ranks, "n_gold", ["group_id"]).alias("x")).collect()) == [1, 2.5, 2.5, 4]


def test_windows_and_segments(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "g int, i int, v double")
    assert [r.x for r in df.select("i", logs.smoothed("v", ["g"], ["i"], 3).alias("x")).orderBy("i").collect()] == [1, 1.5, 2, 3]
    rows = [(1, 0, "r", 0.9), (1, 1, "P", None), (1, 2, "r", 0.5), (1, 3, "e", None), (1, 4, "P", None), (1, 5, "r", 1.0)]
    log = spark.createDataFrame(rows, "g int, i int, kind string, v double")
    cut = lambda d, **k: [(r.idx, r.n, r["mean"]) for r in logs.segments(d, ["g"], ["i"], F.col("kind") == "P", F.col("v"), **k).orderBy("idx").collect()]
    assert cut(log) == [(1, 1, 0.5)] and cut(log, keep_incomplete=True) == [(1, 1, 0.5), (2, 1, 1.0)]
    assert cut(log.where("i BETWEEN 1 AND 2")) == [(1, 1, 0.5)]


def test_chunks_splits_and_repeats(spark):
    users = spark.createDataFrame([("r", f"u{i:02d}") for i in range(23)], "root string, u string")
    kept = samples.even_parts(users, ["root"], "u", 10).groupBy("part").count().collect()
    assert len(kept) == 10 and all(r["count"] == 2 for r in kept)
    assert sorted(r["count"] for r in samples.chunks(users.limit(5), ["root"], "u", 2).groupBy("chunk").count().collect()) == [1, 2, 2]
    assert samples.chunks(users, ["root"], "u", 0).select("chunk").distinct().count() == 1
    for n, train in ((10, 8), (30, 26)):
        got = samples.split(spark.range(n).withColumnRenamed("id", "k"), "k", 0.85, F.col("k"))
        assert got.where("part = 'train'").count() == train and got.count() == n
    ids = {r.id for r in samples.repeated(spark.createDataFrame([("x", 0), ("y", 1)], "id string, node_depth int"), 10).collect()}
    assert ids == {"x", "y", *(f"x__d0x{k}" for k in range(1, 10))}
    assert [r["rank"] for r in samples.global_rank(spark.range(50).select((49 - F.col("id")).alias("v")), "v").orderBy("v").collect()] == list(range(1, 51))


def test_labels_take_the_last_reaction(spark):
    node = "record_id bigint, node_id bigint, parent_id bigint, root_user string, user string, content string, kind string, depth bigint"
    nodes = spark.createDataFrame([(1, 1, None, "a", "a", "p", "原创博文", 0), (1, 2, 1, "a", "b", "t", "评论", 1), (1, 3, 1, "a", "c", "u", "转发微博", 1), (1, 4, 1, "a", "b", "later <|cend|>", "评论", 1)], node)
    pool = samples.chunks(spark.createDataFrame([("a", x) for x in "abc"], "root_user string, user_name string"), ["root_user"], "user_name", 8)
    rows = {r.id: r for r in samples.gathered(samples.labelled(nodes, pool, trees.children(nodes))).collect()}
    assert rows["1_node_1_potchunk_0_tL0"].types == [0, 1, 2] and rows["1_node_1_potchunk_0_tL0"].texts == ["", "later", ""]
    assert rows["1_node_2_potchunk_0_tL1"].types == [0, 0, 0] and len(rows) == 4


def test_rollout_scores_and_limits(spark):
    roots = spark.createDataFrame([("1", "r")], "record_id string, user string")
    gold = spark.createDataFrame([("1", 0, "r", "r.0"), ("1", 0, "r", "zz")], "record_id string, depth int, parent string, child string")

    def model(batch):
        import pandas as pd

        return pd.Series([[f"{u}.0", f"{u}.1"] for u in batch["user"]], index=batch.index)

    steps = rollout.rollout(roots, gold, model, depth_limit=2, turns=5).collect()
    assert [len([s for s in steps if s.depth == d]) for d in (0, 1, 2)] == [1, 2, 2]
    (top,) = [s for s in steps if s.depth == 0]
    assert (top.tp, top.n_gold, top.n_pred, top.parent_missing) == (1, 2, 2, False) and math.isclose(top.f1, 0.5, abs_tol=1e-5)
    assert all(s.parent_missing and s.f1 == 0 for s in steps if s.depth)
    pool = spark.createDataFrame([("1", "r.1")], "record_id string, user string")
    assert {s.user for s in rollout.rollout(roots, gold, model, depth_limit=1, turns=9, pool=pool).collect()} == {"r", "r.1"}
    assert rollout.load("math:sqrt")(4) == 2


def test_rollout_keeps_breadth_first_order_of_many_children(spark):
    def model(batch):
        import pandas as pd

        return pd.Series([[f"{u}.{k}" for k in range(1500 if d == 0 else 2)] for u, d in zip(batch["user"], batch["depth"])], index=batch.index)

    roots = spark.createDataFrame([("1", "r")], "record_id string, user string")
    none = spark.createDataFrame([], "record_id string, depth int, parent string, child string")
    steps = rollout.rollout(roots, none, model, depth_limit=8, turns=1504).collect()
    assert {s.user for s in steps if s.depth == 2} == {"r.0.0", "r.0.1", "r.1.0"} and len(steps) == 1504


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n{"a": 1}\nbroken\n\n{"a": 2}\n')
    (tmp_path / "b.json").write_text(' [{"a": 3}, {"a": 4}]')
    path = lambda n: str(tmp_path / n)
    assert {r.a for r in readers.jsonl_tolerant(spark, path("a.json"), "a int").collect()} == {1, 2}
    assert {r.a for r in readers.records(spark, path("b.json"), "a int").collect()} == {3, 4} and {r.a for r in readers.records(spark, path("a.json"), "a int").collect()} == {1, 2}
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl_strict(spark, path("a.json"), "a int").collect()
    (tmp_path / "log.txt").write_text("\x1b[36mone\x1b[0m\ntwo\n")
    assert [r.line for r in readers.text_lines(spark, path("log.txt")).orderBy("line_no").collect()] == ["one", "two"]
    assert readers.first_lines(spark, path("log.txt"), 1).count() == 1
    writers.pretty_json(spark.range(3), path("p.json"), 2)
    (part,) = (tmp_path / "p.json").glob("part-*")
    assert part.read_text().count('"id"') == 2 and part.read_text().startswith("[ {")
    with pytest.raises(Exception, match="too few lines"):
        readers.first_lines(spark, path("log.txt"), 3).collect()
    (tmp_path / "mixed.txt").write_bytes("grün\n".encode() + "grün\n".encode("latin-1"))
    assert [r.line for r in readers.text_lines(spark, path("mixed.txt")).orderBy("line_no").collect()] == ["grün", "grün"]
    (tmp_path / "long.txt").write_text("".join(f"{k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # many splits
    try:
        assert readers.text_lines(spark, path("long.txt")).where("line <> CAST(line_no AS STRING)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert writers.parquet_somehow(spark.range(2), path("c"), ("no_such", "snappy")) == "snappy"
    with pytest.raises(Exception, match="no_such"):
        writers.parquet_somehow(spark.range(2), path("c2"), ("no_such",))
    with pytest.raises(ValueError, match="node_depth"):
        readers.scan_layers(spark.range(1))
    writers.append_log(spark.createDataFrame([(1, "secret")], "ts int, _gold string"), path("k8"))
    assert spark.read.json(path("k8")).columns == ["ts"]


def test_stream_drops_late_repeats_and_counts_windows(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), 1, h, "t", 1.0) for h in (0, 1, 1, 30 % 24)], stream.STEP)
    rows.write.json(str(tmp_path / "log"))
    out = stream.drained(stream.distinct_steps(stream.tail(spark, str(tmp_path / "log")), "10 days"), str(tmp_path / "s"))
    assert out.count() == 3
    means = stream.drained(stream.window_means(stream.tail(spark, str(tmp_path / "log"))), str(tmp_path / "m"))
    assert means.columns == ["start", "event_type", "n", "mean"]


def test_spans_and_records(spark):
    from graftline.functions import records
    from graftline.operators import spans

    assert spans.between_marks("a|bc|d|e", "|") == [(2, 4)] and spans.covering([(2, 4), (5, 5)], [(0, 1), (1, 3), (3, 9)]) == [(1, 2), (None, None)]
    assert one(spark, spans.span_tokens(F.lit("x |a b| y"), "|"))[0].asDict() == {"start": 3, "end": 6, "first": 1, "last": 2}
    assert one(spark, spans.span_tokens(F.lit(None).cast("string"), "|")) == []
    items = F.from_json(F.lit('[{"type":0},{"type":1},{"type":2}]'), "array<struct<user_name:string,type:int>>")
    assert one(spark, records.positive_children(items, F.array(*map(F.lit, "abc")))) == ["b", "c"]
    assert one(spark, records.quoted_list(F.lit('["a", "b'))) == ["a"] and records.glob_pattern("a.*b") == r"^a\..*b$"
    assert one(spark, records.public_fields(F.lit('{"a": "1", "_b": 2, "gold": []}'))) == {"a": "1"}
    assert one(spark, records.reward(F.lit('{"step_reward": "0.5"}'), F.lit("x"))) == 0.5 and one(spark, records.reward(F.lit(None).cast("string"))) == 0.0
    assert one(spark, records.is_parent_maps(F.lit("[]"))) is True and one(spark, records.is_parent_maps(F.lit("{}"))) is False


def test_samples_of_pools_of_any_size(spark, tmp_path):
    """An author with 1,203 candidates keeps all samples; the cells are those of the candidates taken one by one."""
    from graftline.plans import tree_queries

    who = lambda i: f"struct({i} as id, concat('u', {i}) as screen_name)"
    comment = lambda i: f"struct({i} + 10000L * p as id, {who(i)} as user, 'hi' as text_raw, cast(array() as array<struct<id: bigint, user: struct<id: bigint, screen_name: string>, text_raw: string, reply_comment: struct<id: bigint>>>) as comments)"
    repost = f"struct(9L + 10000L * p as id, {who('1L')} as user, 'x' as text_raw, '' as text_law)"
    raw = spark.sql(f"SELECT p AS row_id, timestamp'2024-01-01' AS crawled_at, struct(p as id, struct(p as id, concat('a', p) as screen_name) as user, 'post' as text_raw, transform(sequence(10L, n), i -> {comment('i')}) as comments, array({repost}) as reposts) AS post FROM VALUES (1L, 1210L), (2L, 20L) AS t(p, n)")
    raw.write.parquet(f"{tmp_path}/raw_posts.parquet")
    spark.range(2000).selectExpr("id AS user_id", "array('x') AS user_interests", "timestamp'2024-01-01' AS updated_at").write.parquet(f"{tmp_path}/profiles.parquet")
    rows = tree_queries.QUERIES["t7_j4_j5_samples"](spark, str(tmp_path)).collect()
    assert len({r.id for r in rows}) == len(rows) == 151 * 1203 + 2 * 13
    (first,) = [r for r in rows if r.id == "1_node_1_potchunk_0_tL0"]
    assert first.candidates.split("|")[:2] == ["a1", "u1"] and first.types.split(",")[:3] == ["0", "2", "1"]
    stats = {r.depth: r for r in tree_queries.QUERIES["a7_candidate_stats"](spark, str(tmp_path)).collect()}
    assert (stats[0].n_samples, stats[0].n_cands, stats[0].n_gold) == (153, 1216, 1214) and (stats[1].n_samples, stats[1].n_gold) == (151 * 1202 + 2 * 12, 0)
    nodes, pool, kids = tree_queries._asked(spark, str(tmp_path))
    few = nodes.where("node_id < 3 OR node_id % 100 = 9")
    a, b = (f(few).select("id", "node_depth", "candidates", "types", "texts") for f in (lambda n: samples.sampled(n, pool, kids), lambda n: samples.gathered(samples.labelled(n, pool, kids))))
    assert a.count() == b.count() > 0 and not a.exceptAll(b).count() and not b.exceptAll(a).count()


def test_samples_are_unfolded_after_the_last_join(spark, tmp_path):
    """What a sample tells is made once a chunk, not once a sample: above the last join nothing goes over cells. Small blocks,
    lots and tasks give the same samples as large ones."""
    from graftline.plans import tree_queries

    nodes = spark.sql("""SELECT r AS record_id, if(i = 0, r, 100 * r + i) AS node_id, if(i = 0, NULL, if(i < 12, r, 100 * r + i - 11)) AS parent_id, if(r = 4, NULL, concat('a', r % 2)) AS root_user,
        CASE WHEN i = 0 THEN concat('a', r % 2) WHEN i = 5 THEN NULL ELSE concat('u', (i * r) % 17) END AS user, CASE WHEN i = 0 THEN 0L WHEN i < 12 THEN 1L ELSE 2L END AS depth,
        if(i % 7 = 3, concat('x//@', i), concat('said ', i)) AS content, if(i % 5 = 4, '转发微博', '评论') AS kind, if(i % 6 = 1, array(), array('x')) AS interests FROM (SELECT explode(sequence(1L, 5L)) AS r), (SELECT explode(sequence(0L, 30L)) AS i)""")
    pool, kids = samples.chunks(trees.pools(nodes), ["root_user"], "user_name", 2), trees.children(nodes)
    want = samples.gathered(samples.labelled(nodes, pool, kids))
    assert want.where("exists(types, t -> t = 2)").count() and want.where("exists(types, t -> t = 1)").count() and want.where("id LIKE '%potchunk_4%'").count()
    for sizes in ({}, {"block": 3, "lot": 2, "task": 5}, {"block": 1, "lot": 1}):
        got = samples.sampled(nodes, pool, kids, **sizes).select(*want.columns)
        assert got.count() == want.count() > 100 and not got.exceptAll(want).count() and not want.exceptAll(got).count()
    nodes.write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")
    asked = tree_queries._asked
    try:
        tree_queries._asked = lambda *_: (known, samples.chunks(trees.pools(known), ["root_user"], "user_name", 8), trees.children(known))
        rows = tree_queries.QUERIES["t7_j4_j5_samples"](spark, "")
    finally:
        tree_queries._asked = asked
    plan, above = rows._jdf.queryExecution().optimizedPlan(), []
    while plan.nodeName() != "Join":
        above.append(plan.simpleString(10_000))
        assert plan.children().size() == 1
        plan = plan.children().apply(0)
    assert above and not [x for x in above if "lambda" in x or "format_string" in x or "sort_array" in x]


def test_samples_of_many_lots_share_the_copies_of_a_block(spark):
    """Of 160 million samples of one author less than one row in 500 is shuffled, and no row unfolds to more than 2 ** 19 at once."""
    from pyspark.sql import DataFrame

    nodes = spark.range(40_000, numPartitions=4).selectExpr("id AS record_id", "id AS node_id", "'a' AS root_user", "0L AS depth")
    pool = spark.range(32_000).selectExpr("'a' AS root_user", "cast(id div 8 AS int) AS chunk", "cast(id AS int) + 1 AS pos", "concat('u', id) AS user_name")
    kids = spark.sql("SELECT 7L AS record_id, 7L AS parent_id, 'u9' AS user, 1 AS reaction, 'hi' AS said")
    rows = samples.sampled(nodes, pool, kids, samples.in_arrays)
    plan = rows._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    lots, blocks = (DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().apply(i)), spark) for i in (0, 1))
    moved, most = lots.selectExpr("sum(size(nodes))", "max(size(nodes))").first()
    copied, longest = blocks.selectExpr("sum(size(cells))", "max(size(cells))").first()
    assert (moved + copied) * 500 < 40_000 * 4_000 and most * longest < 1 << 19


def test_nodes_are_placed_within_their_post():
    ids, parents = [1, 2, 3, 4, 5, 6, 7, 3, 8], [None, 1, 2, 99, 6, 5, 5, 1, 8]
    assert trees.depths(ids, parents) == [0, 1, None, None, None, None, None, 1, None]  # the copy of 3 with the smaller parent counts; 4 has no parent, 5 to 8 hang in cycles
    assert trees.climbs(ids, parents) == [[], [1], None, None, None, None, None, [1], None]
    n = 20_000
    assert trees.depths(list(range(n)), [None, *range(n - 1)]) == list(range(n)) and trees.depths([], []) == []


def test_a_node_in_two_posts_stays_in_both(spark):
    user = "struct<id:bigint,screen_name:string>"
    reply = f"struct<id:bigint,text_raw:string,user:{user},reply_comment:struct<id:bigint>>"
    post = f"struct<id:bigint,created_at:string,text_raw:string,user:{user},comments:array<struct<id:bigint,text_raw:string,user:{user},comments:array<{reply}>>>,reposts:array<struct<id:bigint,text_law:string,text_raw:string,user:{user}>>>"
    made = lambda k, c: (k, None, "t", (1, "a"), [(c, "x", (2, "b"), [(30, "y", (3, "c"), None)])], None)
    rows = [(1, dt.datetime(2024, 1, 1), made(10, 20)), (2, dt.datetime(2024, 1, 2), made(10, 21)), (3, dt.datetime(2024, 1, 1), made(11, 22)), (4, None, None)]
    df = spark.createDataFrame(rows, f"row_id bigint, crawled_at timestamp, post {post}")
    assert {(r.record_id, r.node_id, r.depth) for r in trees.trees(df).collect()} == {(10, 10, 0), (10, 21, 1), (10, 30, 2), (11, 11, 0), (11, 22, 1), (11, 30, 2)}
    assert trees.trees(df.limit(0)).count() == 0


def test_evaluation_of_text_models(spark):
    import pandas as pd

    item = lambda u: f'{{"user_name": "{u}", "content": "hi", "type": "评论"}}'

    def model(batch):
        return pd.Series(["" if u == "r.0" else f"[{item(f'{u}.0')}, {item(f'{u}.1')}, {item(f'{u}.1')}" for u in batch["user"]], index=batch.index)  # cut off, mended

    roots = spark.createDataFrame([("1", "r"), ("2", "q")], "record_id string, user string")
    levels = spark.createDataFrame([("1", 0, "r.0"), ("1", 2, "z"), ("1", 2, "z")], "record_id string, depth int, child string")
    got = {(r.depth, r.user): (r.status, r.n_pred, r.n_gold, r.tp, r.f1, r.reward) for r in rollout.evaluate(roots, levels, model, turns=20).collect()}
    assert got == {
        (0, "r"): ("ok_repaired", 2, 1, 1, 0.666667, 0.666667), (1, "r.0"): ("parse_fail_empty", 0, 0, 0, None, -1.0), (1, "r.1"): ("ok_repaired", 2, 0, 0, 0.0, 0.0),
        (2, "r.1.0"): ("ok_repaired", 2, 1, 0, 0.0, 0.0), (2, "r.1.1"): ("ok_repaired", 2, 1, 0, 0.0, 0.0)}  # record 2 has no level, so it is not asked
    assert {r.user for r in rollout.evaluate(roots, levels, model, turns=2).collect()} == {"r", "r.0"}
    assert {r.user for r in rollout.evaluate(roots, levels, model, turns=20, most_children=1).collect()} == {"r", "r.0"}
    pool = spark.createDataFrame([("1", "r.1", ["x"]), ("1", "r.1", None)], "record_id string, user string, interests array<string>")
    assert {r.user for r in rollout.evaluate(roots, levels, model, turns=20, pool=pool).collect()} == {"r", "r.1"}
    assert rollout.evaluate(roots.limit(0), levels, model, turns=2).count() == 0


def test_carried_lines_cross_blocks(spark):
    rows = [("a", k, v) for k, v in enumerate([None, "1", None, None, None, "2", None, None])] + [("b", 0, None), ("b", 7, None)]
    df = spark.createDataFrame(rows, "file string, line_no int, v string")
    got = {(r.file, r.line_no): r.c for r in logs.carried_lines(df, ["file"], "line_no", {"c": F.col("v")}, block=2).collect()}
    assert [got["a", k] for k in range(8)] == [None, "1", "1", "1", "1", "2", "2", "2"] and got["b", 7] is None and len(got) == 10


def test_lines_of_either_spelling(spark):
    a = '\x1b[36m[rollout][kept-step] group=1 traj=x depth=2 status=parse_fail step_F1(raw)=-1.0000 cond_keys=["bob"] gold=["a", "b"] pred=[]\x1b[0m'
    b = '[keep] depth=0\tcond_key=bob   pred=["x"] gold=["y", f1=2.9e-01'
    cells = [c.alias(k) for k, c in logs.kept_step(F.col("line")).items()]
    rows = [tuple(r) for r in spark.createDataFrame([(a,), (b,), ("other",)], "line string").coalesce(1).select(*cells).collect()]
    assert rows[0] == (2, "parse_fail", -1.0, "bob", ["a", "b"], []) and rows[1][:4] == (0, None, 0.29, "bob") and rows[1][5] == ["x"] and rows[2][:4] == (None, None, None, None)
    lines = spark.createDataFrame([("f", 0, "[micro] 1/4 | cls0=0.2199 cls1=0.0000 content=1e-3 | depth0=1 depth1=0 pairs=16"), ("f", 1, "Epoch 2 / 3"), ("f", 2, "step:5 - train/loss:1.5e-1 - train/cls_weight:1"), ("f", 3, "[micro] 2/4 | cls0=1 cls1=2 content=3 | depth0=1 depth1=1 pairs=8")], "file string, line_no int, line string")
    one, two = logs.micro_frame(lines).orderBy("line_no").collect()
    assert (one.epoch, one.step_in_epoch, one.total_loss, one.micro, one.content_loss, one.pairs) == (None, None, None, 1, 0.001, 16)
    assert (two.epoch, two.epoch_total, two.step_in_epoch, two.total_loss, two.cls1_loss, two.depth1) == (2, 3, 5, 0.15, 2.0, 1)
    text = spark.createDataFrame([(0, "ok", 0.5, ["a"], ["a"]), (1, "parse_fail", -1.0, [], []), (1, "ok", 0.2, [], ["b"])], "depth int, status string, f1 double, gold array<string>, pred array<string>")
    m = logs.kept_means(text).first()
    assert (m.n, m.root_all, m.below_all, m.below_ok, m.below_true_all, m.said_of_untrue, m.true_of_unsaid) == (3, 0.5, -0.4, 0.2, None, 0.5, 0.0)
    r = logs.reward_means(text).first()
    assert (r.f1_untrue, r.f1_true, r.f1_all, r.reward, r.n_ok) == (0.2, 0.5, 0.35, -0.1, 2)
    assert {(x.status, x.n, x.fail_rate) for x in logs.statuses(text).collect()} == {("ok", 2, 0.333333), ("parse_fail", 1, 0.333333)}
