"""Encoding against two public libraries; packing by its properties."""

from __future__ import annotations

import base64
import os
import random

import pytest

from graftline.llm import encode, pack

PATH = encode.vocabulary("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")

TEXTS = [
    None, "", " ", "  \n\n\t ", "hello world", "I'm here, you've won 12345 times!!", "<|endoftext|> is text", "上海的面馆在路上，味道便宜得不像话。", "привет, как дела?", "👨‍👩‍👧 naïve café",
    "a" * 3000, "汉字" * 900, "x" * 399 + "yz", "\x00\x01�", "  leading and trailing  ", "don't DON'T ’s", "é̈", "١٢٣ ੧੨",
]


def _random_texts(n=150):
    rnd = random.Random(7)
    pools = ["abcdefg ", "的一是不了人我在有他这", "0123456789.,-", "éèüß ñ", "привет ", "👍🥹🔥", " \n\t'"]
    return ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 700))) for _ in range(n)]


def test_encoder_matches_tiktoken_and_tokenizers():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    third = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    third.encode_special_tokens = True
    mine = encode.Encoder(PATH)
    for t in [x for x in TEXTS if x is not None] + _random_texts():
        assert mine.encode(t) == other.encode_ordinary(t)
        assert mine.encode(t) == third.encode(t, add_special_tokens=False).ids


def test_long_words_by_heap_equal_the_scan():
    mine, rnd = encode.Encoder(PATH), random.Random(3)
    for n in (2, 3, 50, 700):
        piece = bytes(rnd.choice(b"abcde\xe4\xb8\xad") for _ in range(n))
        assert mine._heap(piece) == mine._scan(piece)


def test_encode_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(4, "hello world", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encode.encode(df, PATH).collect()
    mine = encode.Encoder(PATH)
    assert len(got) == len(rows) and {(r.doc_id, tuple(r.ids)) for r in got} == {(i, tuple(mine.encode(t))) for i, t, _ in rows}
    assert [r.ids for r in got if r.doc_id in (0, 1)] == [[], []]
    assert {(r.doc_id, r.tokens) for r in encode.count(df, PATH).collect()} == {(i, len(mine.encode(t))) for i, t, _ in rows}
    assert encode.encode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("salt", [50_000, 7])
def test_packing_places_every_token_once(spark, monkeypatch, salt):
    monkeypatch.setattr(pack, "ROWS_PER_SALT", salt)
    rnd, cap = random.Random(5), 64
    sizes = [0, None, 64, 65, 128, 300, 1] + [rnd.choice([3, 3, 3, rnd.randint(1, 64)]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint")
    rows = pack.pack(df, cap).collect()
    filled, covered = {}, {}
    for r in rows:
        filled[r.container_id] = filled.get(r.container_id, 0) + r.tokens
        covered.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
    assert max(filled.values()) <= cap and sorted(filled) == list(range(len(filled)))
    for i, n in enumerate(sizes):
        pieces = sorted(covered.get(i, []))
        assert sum(t for _, t in pieces) == (n or 0)
        assert all(a + t == b for (a, t), (b, _) in zip(pieces, pieces[1:]))
        assert len(pieces) == (-(-n // cap) if n else 0)
    least = -(-sum(filter(None, sizes)) // cap)
    assert len(filled) <= least * 1.02 + 1
    steps = {}
    for r in rows:
        steps.setdefault(r.step_id, set()).add(r.container_id)
    assert max(map(len, steps.values())) - min(map(len, steps.values())) <= 1


def test_packing_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert pack.pack(none, 10).count() == 0
    with pytest.raises(ValueError):
        pack.pack(none, 0)


def test_tiers_are_windows_of_their_own():
    lone = pack.tiered({12: 5, 3: 4}, 32, 3)[0]  # two windows of 16 a container, each filled from below
    assert [r for r in lone if r.size == 12] == [pack.Run(12, 0, 5, 0, 1, 0, 1)] and [r for r in lone if r.size == 3][0].shift == 1
    assert lone != pack.tiered({12: 5, 3: 4}, 32, 1)[0]
    rnd = random.Random(2)
    for _ in range(60):
        cap = rnd.choice([16, 30, 100])
        h = {s: rnd.randint(1, 40) for s in rnd.sample(range(1, cap + 1), 9)}
        for tiers in (1, 2, 3, 4):
            runs, spans, made = pack.tiered(h, cap, tiers)
            load: dict = {}
            for r in runs:
                for k in range(r.many):
                    c = r.base + ((r.window + k // r.per) >> r.shift)
                    load[c] = load.get(c, 0) + r.size
            assert sorted(load) == list(range(made)) and max(load.values()) <= cap
            assert {s.first + i: cap - s.room for s in spans for i in range(s.many)} == load
            for size, n in h.items():
                own = sorted((r.rank, r.many) for r in runs if r.size == size)
                assert sum(m for _, m in own) == n and all(a + m == b for (a, m), (b, _) in zip(own, own[1:]))
        assert pack.plan(h, cap)[2] <= pack.tiered(h, cap, 1)[2]


def test_packing_two_thousand_hot_sizes(spark, monkeypatch):
    monkeypatch.setattr(pack, "ROWS_PER_SALT", 2)
    df = spark.range(6000).selectExpr("id AS doc_id", "1 + id % 2000 AS tokens")
    rows = pack.pack(df, 2048).groupBy("container_id").sum("tokens").collect()
    assert sum(r[1] for r in rows) == 3 * 2001 * 1000 and max(r[1] for r in rows) <= 2048


def test_steps_are_of_like_load(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "1 + (id * id) % 700 AS tokens")
    loads = [r[1] for r in pack.pack(df, 512, step=8).groupBy("step_id").sum("tokens").collect()]
    assert max(loads) - min(loads) <= 2 * 512
