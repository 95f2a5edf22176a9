"""Nested projection and hierarchies against small cases and brute force."""

from __future__ import annotations

import random

import pytest

from graftline.operators import hierarchy, nested

USER = "struct<id:bigint,screen_name:string>"
POST = (
    f"struct<id:bigint,created_at:string,text_raw:string,user:{USER},"
    f"comments:array<struct<id:bigint,text_raw:string,user:{USER},comments:array<struct<id:bigint,text_raw:string,user:{USER},reply_comment:struct<id:bigint>>>>>,"
    f"reposts:array<struct<id:bigint,text_law:string,text_raw:string,user:{USER}>>>"
)
SCHEMA = f"row_id bigint, crawled_at timestamp, post {POST}"


def post(id_, comments=None, reposts=None):
    return (id_, None, "t", (1, "a"), comments, reposts)


def test_links_skip_nulls_and_repeat_once(spark):
    rows = [
        (1, None, post(10, [(11, "x", None, [(12, "y", (2, "b"), (99,)), None, (None, "z", None, None)]), None, (None, "n", None, [(13, "w", None, None)])], [(14, " ", "r", None), None])),
        (2, None, post(10, [(11, "x", None, None)], None)),
        (3, None, None),
        (4, None, post(None, [(15, "q", None, None)], None)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in nested.links(df).collect()} == {(10, 10, 11, "comment"), (10, 11, 12, "reply"), (10, 10, 14, "repost")}
    assert nested.links(df).count() == 3
    assert nested.comments(df).count() == 4
    assert [r.text for r in nested.reposts(df).collect()] == ["r"]
    assert {(r.kind, r.holder_id, r.user_id) for r in nested.users(df).collect()} >= {("post", 10, 1), ("reply", 12, 2)}


def test_links_of_empty_table_with_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", kind string, node_id bigint")
    assert nested.links(df).count() == 0
    assert nested.posts(df).count() == 0


def brute(parents):
    out = {}
    for x in parents:
        path, y = [x], x
        while True:
            p = parents[y]
            if p in (None, 0) or p not in parents:
                out[x] = (y, len(path), [*reversed(path)])
                break
            if p in path:
                out[x] = (min(path[path.index(p):]), -1, None)
                break
            path.append(p)
            y = p
    return out


@pytest.mark.parametrize(("seed", "rate"), [(1, 1), (2, 3), (3, 1000)])
def test_resolve_matches_brute_force(spark, seed, rate):
    rnd = random.Random(seed)
    parents = {i: rnd.choice([None, 0, 5000, rnd.randint(1, 300), max(1, i - 1), max(1, i - 1)]) for i in range(1, 301)}
    parents.update({i: i - 1 for i in range(301, 401)} | {400 + i: 400 + i % 7 + 1 for i in range(1, 8)} | {500: 500, 501: 500})
    df = spark.createDataFrame(list(parents.items()), "id bigint, parent bigint")
    got = {r.id: (r.root_id, r.node_depth, r.path) for r in hierarchy.resolve(df, rate=rate, with_path=True).collect()}
    assert got == brute(parents)
    if rate == 3:
        plain = {r.id: (r.root_id, r.node_depth) for r in hierarchy.resolve(df, rate=rate).collect()}
        assert plain == {k: v[:2] for k, v in got.items()}
    paths = spark.createDataFrame([(k, *v) for k, v in got.items()], "id bigint, root_id bigint, node_depth bigint, path array<bigint>")
    below = hierarchy.descendants(paths).collect()
    assert {(r.ancestor_id, r.id, r.distance) for r in below} == {(a, k, len(p) - 1 - i) for k, (_, _, p) in got.items() if p for i, a in enumerate(p[:-1])}


def test_latest_links_and_empty(spark):
    rows = [(1, None, 1, None), (1, 7, 2, "2024-01-02 00:00:00"), (1, 8, 2, "2024-01-02 00:00:00"), (None, 1, 1, None)]
    df = spark.createDataFrame(rows, "id bigint, reply_comment bigint, depth int, fetched_at string").selectExpr("id", "reply_comment", "depth", "cast(fetched_at as timestamp) fetched_at", "'x' as path")
    assert [tuple(r) for r in hierarchy.latest_links(df).collect()] == [(1, 8, 2)]
    none = spark.createDataFrame([], "id bigint, parent bigint")
    assert hierarchy.resolve(none).count() == 0
