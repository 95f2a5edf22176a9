"""Rescue-column ingestion and the drift report."""

from __future__ import annotations

import json

from graftline.operators import drift, rescue

SCHEMA = "line_id bigint, feed string, file_name string, file_seq int, record_id string, line string"


def lines(spark, files, feed="f"):
    rows, n = [], 0
    for seq, items in enumerate(files, 1):
        for rec, item in items:
            n += 1
            rows.append((n, feed, f"{feed}_{seq}", seq, rec, item if item is None or isinstance(item, str) else json.dumps(item, ensure_ascii=False)))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {tuple(r) for r in drift.drift(df).collect()}


def test_changes_of_each_sort(spark):
    one = [("a", {"id": "1", "who": "x", "n": 1, "m": [{"role": "u", "content": "hi"}], "gone": 1}), ("b", {"id": "2", "who": "y", "n": 2, "m": [{"role": "v", "content": "ho"}]}), ("c", None), ("c", ""), ("c", "  "), ("c", '{"cut'), ("c", "[1]"), ("c", "3")]
    two = [("a", {"id": "1", "author": "x", "n": 1.5, "m": [{"role": "u", "body": "hi"}], "fresh": {"k": 1}}), ("b", {"author": "y", "n": 2, "id": "2", "m": [{"role": "v", "body": "ho"}], "fresh": None})]
    assert found(lines(spark, [one, two])) == {
        ("f_2", "renamed", "author", "who"), ("f_2", "retyped", "n", ""), ("f_2", "renamed", "m[].body", "m[].content"), ("f_2", "removed", "gone", ""), ("f_2", "added", "fresh", "")}


def test_same_kinds_but_other_values_are_no_rename(spark):
    a, b = [("a", {"x": 1, "k": 1}), ("b", {"x": 2, "k": 1})], [("a", {"y": 7, "k": 1}), ("b", {"y": 8, "k": 1})]
    assert found(lines(spark, [a, b])) == {("f_2", "added", "y", ""), ("f_2", "removed", "x", "")}
    assert found(lines(spark, [[("a", {"x": 1})], [("q", {"y": 1})]])) == {("f_2", "added", "y", ""), ("f_2", "removed", "x", "")}


def test_paths_below_a_renamed_holder_keep_its_name(spark):
    a = [("a", {"m": {"t": "x", "d": 1, "o": 1}})]
    b = [("a", {"w": {"t": "x", "d": "1"}})]
    got = found(lines(spark, [a, [("a", {"w": {"t": "x", "d": 1, "o": 1}})]]))
    assert got == {("f_2", "renamed", "w", "m")}
    assert found(lines(spark, [a, b])) == {("f_2", "removed", "m", ""), ("f_2", "added", "w", "")}


def test_nothing_told_below_a_changed_path_and_gaps(spark):
    a, b = [("a", {"m": [{"c": "x"}]})], [("a", {"m": "text"})]
    assert found(lines(spark, [a, b])) == {("f_2", "retyped", "m", "")}
    assert found(lines(spark, [a, [("a", None)], b])) == set()
    assert found(spark.createDataFrame([], SCHEMA)) == set()


USER = rescue.APPROVED | {
    "user_name": "author", "id": "sample_id", "row_key": "sample_id", "layer": "node_depth", "target_layer": "node_depth", "data_source": "origin", "messages[].body": "messages[].content",
    "messages[].value": "messages[].content", "messages[].turn_depth": "messages[].depth", "messages[].level": "messages[].depth"}


def test_ingest_rescues_and_promotes(spark):
    df = lines(spark, [[("a", {"sample_id": "1", "user_name": "x", "node_depth": "2", "seq_len": "far", "messages": [{"role": "user", "body": "hi", "depth": 1.0}, None, {"role": "assistant", "content": {"text": "yo", "depth": 3}}], "new": {"k": [1]}}), ("b", None), ("c", "nope")]])
    raw = rescue.ingest(df.selectExpr("*", "1 as author", "'z' as extra")).orderBy("line_id").collect()
    assert [r._status for r in raw] == ["ok", "null", "broken"]
    assert raw[0].node_depth == 2 and raw[0].author is None and raw[0].extra == "z"
    assert json.loads(raw[0]._rescued) == {"user_name": "x", "seq_len": "far", "messages[0].body": "hi", "messages[2].content": {"text": "yo", "depth": 3}, "new": {"k": [1]}}
    assert json.loads(raw[0]._written) == {"node_depth": "2", "messages[0].depth": 1.0}
    (row,) = rescue.promote(rescue.ingest(df).where("_status = 'ok'"), USER).collect()
    assert row.author == "x" and row.messages[0].content == "hi" and row.messages[0].depth == 1 and row.messages[2].content == "yo" and row.messages[2].depth == 3
    assert json.loads(row._rescued)["new"] == {"k": [1]} and json.loads(row._rescued)["seq_len"] == "far"
    (same,) = drift.samples(df, USER).collect()
    assert same.author == "x" and same.messages[0].content == "hi"


def test_typed_and_rescued_hold_all_that_a_line_held():
    for value in ({"sample_id": 4, "node_depth": "7", "seq_len": 2.0, "origin": True, "targets_per_potential_types": ["1", 2], "z": {"a": [1, {"b": None}]}, "messages": [{"role": 1, "depth": "x", "more": [2]}, "text", None, {}]},
                  {"messages": {"a": 1}, "targets_per_potential_types": [1, 2], "author": "q"}, {"messages": "[]"}, {}):
        held = {(p, w, json.dumps(v)) for p, _, w, v in rescue.values(*rescue.enforce(value)) if not isinstance(v, dict | list)}
        assert held == {(p, w, json.dumps(v)) for p, _, w, v in rescue.leaves(value, "") if not isinstance(v, dict | list)}


def test_approved_names_come_from_the_report(spark):
    one = [("a", {"row_key": 7, "turns": [{"who": "u", "value": {"text": "hi", "layer": 2}}], "w": 1}), ("b", {"row_key": 8, "turns": [{"who": "v", "value": {"text": "ho", "layer": 3}}], "w": 2})]
    two = [("a", {"id": 7, "messages": [{"role": "u", "value": {"text": "hi", "depth": 2}}], "v": 9}), ("b", {"id": 8, "messages": [{"role": "v", "value": {"text": "ho", "depth": 3}}], "v": 8})]
    three = [("a", {"sample_id": 7, "messages": [{"role": "u", "content": {"text": "hi", "depth": 2}}]}), ("b", {"sample_id": 8, "messages": [{"role": "v", "content": {"text": "ho", "depth": 3}}]})]
    found = drift.Drift(lines(spark, [one, two, three]))
    names = found.approved()
    assert names["row_key"] == names["id"] == "sample_id" and names["turns"] == "messages" and names["messages[].value"] == "messages[].content" and "w" not in names and "v" not in names
    rows = found.samples().orderBy("line_id").collect()
    assert [(r.sample_id, r.messages[0].role, r.messages[0].content, r.messages[0].depth) for r in rows] == [("7", "u", "hi", 2), ("8", "v", "ho", 3)] * 3
    assert json.loads(rows[0]._rescued)["w"] == 1
    assert rescue.approvals([("a", "sample_id"), ("a", "b"), ("b", "author")], {}) == {}  # joined to two targets: none


def test_no_sample_loses_its_id_depth_or_content(spark):
    df = lines(spark, [[
        ("a", {"id": 48, "target_layer": 3, "data_source": "s", "messages": [{"content": {"text_raw": "hi", "depth": 9}, "turn_depth": "2", "weight": 5.0, "w": 6.0}]}),
        ("b", {"sample_id": 49, "target_layer": 4.0, "messages": [{"body": {"text_raw": "ho"}, "turn_depth": 1}]}),
        ("c", {"row_key": "50", "target_layer": "5", "messages": [{"value": {"text_raw": "he"}, "level": 7}]}), ("d", {"row_key": 51, "layer": 6, "messages": [{"content": 12, "depth": 0}]})]])
    for made in (drift.samples(df, USER), rescue.promote(rescue.ingest(df), USER)):
        rows = made.orderBy("line_id").collect()
        assert [(r.sample_id, r.node_depth, r.messages[0].content, r.messages[0].depth) for r in rows] == [("48", 3, "hi", 2), ("49", 4, "ho", 1), ("50", 5, "he", 7), ("51", 6, "12", 0)]
        assert rows[0].origin == "s" and rows[0].messages[0].loss is None and json.loads(rows[0]._rescued)["messages[0].weight"] == 5.0


def test_rename_is_judged_from_all_values_of_a_record(spark):
    for hit in range(1, 8):  # one of many values, wherever its hash falls
        a, b = [("a", {"x": k, "k": 1}) for k in range(1, 8)], [("a", {"y": hit, "k": 1})]
        assert found(lines(spark, [a, b])) == {("f_2", "renamed", "y", "x")}
    assert found(lines(spark, [a, [("a", {"y": 9, "k": 1})]])) == {("f_2", "added", "y", ""), ("f_2", "removed", "x", "")}
