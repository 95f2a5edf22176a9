"""Groups and splits against union-find; overlaps against all pairs."""

from __future__ import annotations

import json
import random

import pytest

from graftline.llm import balance, overlap

SFT = "id string, sft_chunk_info string"


def info(record=None, user=None, **more):
    return json.dumps({k: v for k, v in {"record_id": record, "root_user": user, **more}.items() if v is not None}, ensure_ascii=False)


def union(rows):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, record, user in rows:
        up[top(("i", i))] = top(("r", record))
        if user:
            up[top(("i", i))] = top(("u", user))
    best = {}
    for i, *_ in rows:
        best[top(("i", i))] = min(best.get(top(("i", i)), i), i)
    return {i: best[top(("i", i))] for i, *_ in rows}


def test_keys_are_read_as_stated(spark):
    rows = [("7_node_1", info("9", " @Bob ")), ("7_node_2", info(9, "bob")), ("7_node_3", None), ("7_node_4", '{"record_id": "9", "root_us'), ("7_node_5", info(user="   ")), ("7_node_6", info("9.0", "@"))]
    got = {r.id: (r.record, r.user) for r in balance.keyed(spark.createDataFrame(rows, SFT)).collect()}
    assert got == {"7_node_1": ("9", "bob"), "7_node_2": ("9", "bob"), "7_node_3": ("7", None), "7_node_4": ("7", None), "7_node_5": ("7", None), "7_node_6": ("9", None)}


def test_groups_match_union_find(spark):
    rnd = random.Random(1)
    plain = [(f"{rnd.randint(1, 60)}_node_{n}", str(rnd.randint(1, 60)), rnd.choice(["", "", f"u{rnd.randint(1, 60)}", "hot"])) for n in range(150)]
    plain += [(f"9{k}_node_c", str(1000 + k), f"c{k}") for k in range(40)] + [(f"9{k}_node_d", str(1000 + k), f"c{k + 1}") for k in range(40)]
    rows = [(i, info(r, u or None)) for i, r, u in plain]
    df = spark.createDataFrame(rows + rows[:20] + [(None, info("1", "hot"))], SFT).selectExpr("*", "1 as weight", "'x' as record", "2 as label")
    got = balance.groups(df).collect()
    assert {r.id: r.group_id for r in got} == union(plain)
    assert sum(r.weight for r in got) == len(rows) + 20
    assert balance.groups(spark.createDataFrame([], SFT)).count() == 0


def test_splits_keep_groups_and_portions(spark):
    rows = [(f"{n % 300}_node_{n}", info(str(n % 300), f"u{n % 300 // 2}" if n % 300 < 250 else "giant")) for n in range(1500)]
    out = balance.splits(spark.createDataFrame(rows, SFT), {"train": 0.8, "val": 0.1, "test": 0.1}, packets=64, bins=20).collect()
    by_group, share = {}, {}
    for r in out:
        by_group.setdefault(r.group_id, set()).add(r.split_name)
        share[r.split_name] = share.get(r.split_name, 0) + r.weight
    assert all(len(s) == 1 for s in by_group.values()) and len(out) == 1500
    assert abs(share["train"] / 1500 - 0.8) < 0.06 and abs(share["val"] - share["test"]) < 90


def test_largest_differencing_bins_are_even():
    rnd = random.Random(2)
    weights = {i: rnd.randint(1, 100) for i in range(500)}
    bins = balance.difference(weights, 16)
    assert sorted(p for _, ps in bins for p in ps) == sorted(weights) and all(s == sum(weights[p] for p in ps) for s, ps in bins)
    assert max(s for s, _ in bins) - min(s for s, _ in bins) <= 3
    assert balance.difference({}, 4) == []


def prompt(text):
    return f"username: x\ncontent:\n{text}\nuserinterest: []\npotentialspan:\n"


def sft(spark, rows):
    cells = [(i, None if p is None else [("system", "s"), ("user", prompt(p))], split, source) for i, p, split, source in rows]
    return spark.createDataFrame(cells, "id string, messages array<struct<role:string,content:string>>, split_name string, source string")


@pytest.mark.parametrize("most", [20_000, 2])
def test_overlap_matches_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(overlap, "LIST", most)  # with 2, lists are salted
    rnd, rows = random.Random(4), []
    vocabulary = [f"w{k}" for k in range(60)] + list("的一是不了人我在有他这中大来上国")
    for n in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 9, 16, 40, 120]))]
        for copy in range(rnd.randint(1, 4)):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, len(base) // 8, len(base) // 8 + 1])):
                k = rnd.randrange(len(text))
                text[k : k + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 1)
            joined = " ".join(text)
            rows.append((f"r{n}_{copy}", joined.upper() + "!! [doge] #tag# https://t.co/x" if copy % 2 else joined, rnd.choice(["train", "val", "test"]), f"s{n % 3}"))
    got = {tuple(r) for r in overlap.Overlaps(sft(spark, [*rows, *rows[:9]])).found().collect()}
    want = set()
    w = {r[0]: overlap.words(r[1]) for r in rows}
    for a in rows:
        for b in rows:
            x, y = w[a[0]], w[b[0]]
            if a[2] == "train" and b[2] != "train" and min(len("".join(x)), len("".join(y))) >= 20:
                most = max(len(x), len(y)) // 8
                if overlap.changed_words(x, y, most) <= most or "".join(x) == "".join(y):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want and len(want) > 10


def test_overlap_words_and_edges(spark):
    assert overlap.words("Ｈｅｌｌｏ, don’t 你好! #tag# 😂 :) https://x.y/z?a=1 [doge] (´･ω･`) end") == ["hello", "dont", "你", "好", "end"]
    assert overlap.words(None) == [] and overlap.changed_words(list("abc"), list("abd"), 1) == 1 and overlap.changed_words(list("abcdef"), list("uvwxyz"), 2) == 3
    long = "one two three four five six seven"
    rows = [("a", long, "train", "s"), ("b", long, "val", "s"), ("b", long, "val", "s"), ("a", long, "test", "s"), (None, long, "test", "s"), ("c", None, "test", "s"), ("d", "too short", "test", "s"), ("e", long, None, None), ("f", long, "test", None)]
    o = overlap.Overlaps(sft(spark, rows))
    assert {tuple(r) for r in o.found().collect()} == {("a", "b"), ("a", "f")}
    assert {tuple(r) for r in o.report().collect()} == {("val", "s", 1, 1), ("test", "s", 1, 1), ("test", None, 1, 1)}
    assert overlap.Overlaps(sft(spark, rows).limit(0)).found().count() == 0
    cells = [("x", [("system", "s")], "train", "s"), ("y", [], "val", "s"), ("z", [None], "val", "s"), ("a", [("user", prompt(long))], "train", "s"), ("b", [("user", prompt(long))], "val", "s")]
    df = spark.createDataFrame(cells, "id string, messages array<struct<role:string,content:string>>, split_name string, source string")
    assert {tuple(r) for r in overlap.Overlaps(df).found().collect()} == {("a", "b")}


def test_classes_members_and_spellings(spark):
    base = "one two three four five six seven eight nine ten"
    near = base.replace("four", "other")
    broken = base.replace("seven", "se ven").replace("two", "t w o")  # a copy with spaces inside its words
    rows = [("a", base, "train", "s"), ("b", base.upper(), "train", "s"), ("c", broken, "train", "s"), ("d", near, "val", "s"), ("e", near, "test", "s"), ("f", base, "val", "s")]
    o = overlap.Overlaps(sft(spark, rows))
    assert {tuple(r) for r in o.found().collect()} == {(x, y) for x in "abc" for y in "def"}
    pairs = o.classes().collect()
    assert sorted((r.n_train, r.n_eval, r.cosine < 1) for r in pairs) == [(3, 1, False), (3, 2, True)] and all(r.dot is None or r.dot > 0 for r in pairs)
    members = {r.id: r.text_class for r in o.membership().collect()}
    assert len(members) == 6 and members["a"] == members["b"] == members["c"] == members["f"] != members["d"] == members["e"]


def test_tags_end_at_words():
    assert overlap.words("see #x and #y now") == ["see", "and", "now"] and overlap.words("#two words# end") == ["end"]
