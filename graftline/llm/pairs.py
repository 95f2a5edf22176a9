"""Prompt and answer pairs whose answer does not serve the prompt, each with its defect.

Method: a pushdown parser reads the answer through fences, markup, brackets and quotations, keeps a stack of what is
open, and gives the complete items, what is left open at the end, and the wording outside. On its result:
* empty: no item and no wording;
* refusal: the wording, or the comments, match a grammar of declining in six languages;
* copied: greedy string tiling covers the answer, or every comment, with the prompt or its post text;
* truncated: the items do not come to the end of the last candidate of the prompt;
* other_language: most comments are in another script than the post text or, among Latin ones, in another language by
  profiles of letter sequences.
The first that fits counts. Rows are judged one by one in Arrow batches, whole texts each; only defective keys are
shuffled, to give one row per key.

The profiles are fitted on labelled texts: of each Latin language the first SAMPLE texts, in the order of a hash, of 20
to 400 characters. This bound is the parameter ``sample`` of ``profiles``; everything else reads all rows.

Defined cases: a missing or null answer is empty, unless the stored ``parsed_output`` holds items, which then count as
the answer; a missing prompt can make no answer copied, truncated or foreign; a key with several versions, or several
turns, gets the first defect in the order above; rows without key are left out; a prompt without candidates makes no
answer truncated; without profiles Latin languages are not told apart.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.runtime import spread

DEFECTS = ("empty", "refusal", "copied", "truncated", "other_language")
TILE, COPY = 3, 0.8

_MARKUP = regex.compile(r"```[ \t]*[A-Za-z]*|<\|(?!cstart|cend|psep)[A-Za-z_]+\|>|</?[A-Za-z_]{1,20}>|[​-‏⁠﻿­]")
_MARKS = re.compile(r"<\|c(?:start|end)\|>")
_INNER = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|(?P<open>$))|[\[\]{}]', re.S)
_OUTER = re.compile(r"\[(?=\s*(?:[\[\]{\"]|$))|\{(?=\s*(?:[\"}]|$))")
_CANDIDATE = re.compile(r'<\|psep\|>\s*\{\s*"user_name"\s*:\s*"((?:[^"\\]|\\.)*)"', re.S)
_POST = re.compile(r"(?:^|\n)content:[ \t\r]*\n(.*?)\n?userinterest:", re.S)
_FIELD = re.compile(r'"(user_name|content)"\s*:\s*"((?:[^"\\]|\\.)*)"', re.S)
_WORDS = regex.compile(r"\p{Han}|(?:(?!\p{Han})[\p{L}\p{M}\p{N}])+")
_APOSTROPHE = regex.compile(r"(?<=\p{L})['’](?=\p{L})")


class Parsed:
    """What the parser finds: items (user_name, comment), started (an item left open), wording outside."""

    __slots__ = ("items", "started", "wording")

    def __init__(self, items: list[tuple[str, str]], started: str, wording: str):
        self.items, self.started, self.wording = items, started, wording


def parse(answer: str) -> Parsed:
    """Pushdown parse of an answer; brackets of prose that hold no JSON count as wording."""
    text = _MARKUP.sub(" ", answer)
    items: list[tuple[str, str]] = []
    outside: list[str] = []
    at, n, started = 0, len(text), ""
    while at < n:
        begin = _OUTER.search(text, at)
        if not begin:
            outside.append(text[at:])
            break
        outside.append(text[at : begin.start()])
        stack: list[tuple[str, int]] = []
        at = begin.start()
        while True:
            token = _INNER.search(text, at)
            if not token:
                at = n
                break
            at = token.end()
            sign = text[token.start()]
            if sign in "[{":
                stack.append((sign, token.start()))
            elif sign in "]}":
                if stack and stack[-1][0] == ("[" if sign == "]" else "{"):
                    opened, start = stack.pop()
                    # an item is an object right in the array, or on its own
                    if opened == "{" and not any(s == "{" for s, _ in stack):
                        item = _item(text[start:at])
                        if item:
                            items.append(item)
                if not stack:
                    break
            elif token["open"] is not None:
                at = n
                break
        if at >= n and stack:
            opens = [start for s, start in stack if s == "{"]
            started = text[opens[0]:] if opens else ""
    return Parsed(items, started, "".join(outside))


def _item(text: str) -> tuple[str, str] | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        value = dict(_FIELD.findall(text))
    if not isinstance(value, dict) or not value.keys() & {"user_name", "content", "type"}:
        return None
    name, said = value.get("user_name"), value.get("content")
    return (name if isinstance(name, str) else "", _MARKS.sub("", said).strip() if isinstance(said, str) else "")


def words(text: str) -> list[str]:
    return _WORDS.findall(_APOSTROPHE.sub("", text).casefold())


def tiled(a: list[str], b: list[str], least: int = TILE) -> int:
    """Words of a covered by greedy string tiling with b: longest common runs first, no word used twice.

    Runs are found once, from their left ends, and kept in a heap; one that was partly used since goes back with what
    is left of it.
    """
    starts: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for j in range(len(b) - least + 1):
        starts[tuple(b[j : j + least])].append(j)
    heap: list[tuple[int, int, int]] = []
    for i in range(len(a) - least + 1):
        for j in starts.get(tuple(a[i : i + least]), ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # inside a run that began before
            k = least
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            heap.append((-k, i, j))
    heapq.heapify(heap)
    used_a, used_b, covered = bytearray(len(a)), bytearray(len(b)), 0
    while heap:
        k, i, j = heapq.heappop(heap)
        k = -k
        if not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
            used_a[i : i + k] = used_b[j : j + k] = b"\1" * k
            covered += k
            continue
        run = 0
        for x in range(k + 1):  # the unused stretches of the run
            if x < k and not used_a[i + x] and not used_b[j + x]:
                run += 1
                continue
            if run >= least:
                heapq.heappush(heap, (-run, i + x - run, j + x - run))
            run = 0
    return covered


def alike(a: list[str], b: list[str]) -> bool:
    """Whether a is b, at most slightly changed."""
    if not a or not b:
        return False
    if a == b:
        return True
    if min(len(a), len(b)) < COPY * max(len(a), len(b)) or min(len(a), len(b)) < TILE:
        return False
    total = len(a) + len(b)
    if 2 * _shared(a, b) < COPY * total:
        return False
    return 2 * tiled(a, b, 2) >= COPY * total


def _shared(a: list[str], b: list[str]) -> int:
    counts: dict[str, int] = defaultdict(int)
    for x in b:
        counts[x] += 1
    n = 0
    for x in a:
        if counts[x] > 0:
            counts[x] -= 1
            n += 1
    return n


#: Grammar of declining in each language: S is a refusal, a word in braces another rule, the rest a pattern of words.
_GRAMMAR = {
    "zh": {
        "S": ["{unable}{near}{act}", "超出了?[^。！？\\n]{{0,12}}(?:范围|能力)", "{must}{refuse}(?:这|该|此|您)"],
        "unable": ["不能", "无法", "不便", "没办法", "不会", "拒绝", "做不到", "难以", "不可以", "不方便"], "near": ["[^。！？\\n]{{0,10}}"],
        "act": ["预测", "判断", "评判", "评价", "生成", "撰写", "代写", "代替", "写评论", "协助", "帮助", "帮忙", "完成", "提供", "回答", "处理", "满足", "标注"],
        "must": ["我", "必须", "只能", "不得不"], "refuse": ["拒绝", "谢绝"],
    },
    "en": {
        "S": [r"\b{unable}\s+{few}{act}", r"\b{must}\s+(?:respectfully\s+)?{refuse}\b", r"\bi\s+{refuse}\s+to\b", r"\b{isnt}\s+something\s+i(?:'m| am)?\s+(?:can|able|will)", r"something\s+i\s+{wont}", "beyond what i can"],
        "unable": ["can'?t", "cannot", "can not", "could not", "couldn't", "won't", "will not", "unable to", "not able to", "not going to", "not in a position to", "not allowed to"], "few": [r"(?:\w+\s+){{0,2}}?"],
        "act": ["predict", "label", "judge", "classify", "rate", "write", "generate", "help", "assist", "answer", "provide", "complete", "comply", "fulfil", "fulfill", "do th", "respond", "say how", "comment on"],
        "must": ["must", "have to", "need to", "has to"], "refuse": ["decline", "refuse"], "isnt": ["isn'?t", "is not", "not"], "wont": ["won't", "can'?t", "cannot", "will not"],
    },
    "es": {
        "S": [r"\bno\s+{able}\s+{few}{act}", r"\b{must}\s+{refuse}"],
        "able": ["puedo", "podré", "podría", "me es posible", "soy capaz de", "estoy en condiciones de", "voy a"], "few": [r"(?:\w+\s+){{0,2}}?"],
        "act": ["predecir", "escribir", "generar", "ayudar", "responder", "juzgar", "clasificar", "etiquetar", "evaluar", "atender", "completar", "cumplir", "hacer eso"],
        "must": ["debo", "tengo que", "he de"], "refuse": ["rechazar", "declinar", "negarme"],
    },
    "de": {
        "S": [r"\b{able}\s+(?:ich\s+)?[^.!?\n]{{0,70}}?\bnicht\s+(?:\w+\s+){{0,1}}?{act}", r"\b(?:anfrage|bitte)\s+(?:leider\s+)?{refuse}", r"\bnicht in der lage\b"],
        "able": ["kann", "darf", "werde", "möchte"], "act": ["vorhersagen", "beurteilen", "schreiben", "beantworten", "helfen", "bewerten", "erstellen", "verfassen", "einschätzen", "erfüllen", "bearbeiten"],
        "refuse": ["ablehnen", r"nicht\s+(?:erfüllen|bearbeiten|beantworten)"],
    },
    "fr": {
        "S": [r"\bje\s+(?:ne|n['’])\s*{able}\s+(?:pas\s+)?{few}{act}", r"\bje\s+dois\s+{refuse}", r"\bil\s+m['’]est\s+impossible", r"\bil\s+ne\s+m['’]est\s+pas\s+possible"],
        "able": ["peux", "puis", "pourrai", "suis", "saurais", "vais"], "few": [r"(?:\w+\s+){{0,2}}?"],
        "act": ["prédire", "écrire", "rédiger", "générer", "aider", "répondre", "juger", "évaluer", "classer", "mesure", "traiter"], "refuse": ["refuser", "décliner"],
    },
    "ru": {
        "S": [r"\bне\s+{able}\s+{few}{act}", r"\b{must}\s+отказ", "отказываюсь", "выходит за рамки"],
        "able": ["могу", "смогу", "буду", "в состоянии", "в силах", "имею возможности", r"готов\w*"], "few": [r"(?:\w+\s+){{0,3}}?"],
        "act": ["предсказ", "предугад", "напис", "писать", "оцен", "помо", "ответ", "выполн", "генерир", "суди", "сужд"], "must": [r"вынужден\w*", "должен", "должна", "приходится"],
    },
}


def _rule(rules: dict[str, list[str]], name: str) -> str:
    """A rule as a pattern, the rules that it names put in."""
    own = {k: _rule(rules, k) for k in rules if any(f"{{{k}}}" in x for x in rules[name])}
    return "(?:" + "|".join(x.format_map(own) for x in rules[name]) + ")"


_REFUSAL = regex.compile("|".join(_rule(rules, "S") for rules in _GRAMMAR.values()), regex.I)


def declines(text: str) -> bool:
    return bool(_REFUSAL.search(text.replace("’", "'")))


LATIN, SAMPLE, LEAD, GRAMS = ("en", "es", "de", "fr"), 1000, 3.0, 4
_ASIDE = regex.compile(r"(?:https?://|www\.)[!-~]+|@[\p{L}\p{N}_.-]+|#[^#\n]{1,40}#|#[\p{L}\p{N}_]+|\[\p{L}{1,8}\]|<\|[a-z]+\|>")
_LATIN = regex.compile(r"[\p{Latin}\p{M}]+(?:['’](?=\p{L}))?")
_HAN, _CYRILLIC, _KANA, _HANGUL = (regex.compile(p) for p in (r"\p{Han}", r"[\p{Cyrillic}]+", r"[\p{Hiragana}\p{Katakana}]", r"\p{Hangul}"))
Profiles = dict[str, list[float]]


def _grams(found: list[str]) -> Iterator[str]:
    """Letter sequences of words with their ends, and short words whole."""
    for w in found:
        w = f" {w} "
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                yield w[i : i + n]
        if len(w) <= 7:
            yield f"{w}."


def fit(texts: dict[str, list[str]]) -> Profiles:
    """Log likelihoods of each letter sequence in LATIN languages, below that of its likeliest one."""
    counts = {lang: Counter(g for t in texts.get(lang, ()) for g in _grams(_LATIN.findall(_ASIDE.sub(" ", t).casefold()))) for lang in LATIN}
    every = sum(counts.values(), Counter())
    kept = [g for g, n in every.items() if n >= 3]
    total = {lang: sum(counts[lang][g] for g in kept) + len(kept) / 2 for lang in LATIN}
    logs = {g: [math.log((counts[lang][g] + 0.5) / total[lang]) for lang in LATIN] for g in kept}
    return {g: [x - max(v) for x in v] for g, v in logs.items()}


def profiles(documents: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from at most ``sample`` labelled texts of each Latin language; labels count by their first two letters."""
    lang, size = F.lower(F.substring(F.trim("lang"), 1, 2)), F.length("text")
    rows = documents.select(lang.alias("lang"), "text").where(F.col("lang").isin(*LATIN) & size.between(20, 400))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    texts = defaultdict(list)
    for row in rows.withColumn("n", first).where(F.col("n") <= sample).collect():  # each task keeps ``sample`` a language
        texts[row.lang].append(row.text)
    return fit(texts)


def language(text: str, known: Profiles | None = None) -> str | None:
    """zh, ru, ja, ko, en, es, de, fr, or nothing where the text does not tell."""
    text = _ASIDE.sub(" ", text).casefold()
    han, cyrillic, kana, hangul = (len(p.findall(text)) for p in (_HAN, _CYRILLIC, _KANA, _HANGUL))
    latin = _LATIN.findall(text)
    if kana * 3 > han + len(latin) and kana > 1:
        return "ja"
    if hangul * 2 > han + 2 * len(latin) and hangul > 1:
        return "ko"
    if han / 1.7 > len(latin) and han / 1.7 > cyrillic:
        return "zh"
    if cyrillic > len(latin):
        return "ru"
    likely = [v for g in _grams(latin) if (v := known.get(g))] if known else []
    if len(likely) < GRAMS:
        return None
    scores = [math.fsum(x) for x in zip(*likely)]
    best = sorted(range(len(LATIN)), key=lambda i: -scores[i])
    return LATIN[best[0]] if scores[best[0]] - scores[best[1]] >= LEAD else None


def judge(prompt: str | None, answer: str | None, model: Profiles | None = None) -> str | None:
    """The answer's defect, or nothing."""
    if answer is None:
        return "empty"
    p = parse(answer)
    wording = _MARKS.sub(" ", p.wording)
    said = [c for _, c in p.items if c]
    worded = any(ch.isalnum() for ch in wording)
    if not p.items and not worded and not any(ch.isalnum() for ch in p.started):
        return "empty"
    post = post_words = None
    names: list[str] = []
    if prompt:
        found = _POST.search(prompt)
        post = found[1] if found else None
        block = prompt.rfind("<POTENTIAL_SPANS>")
        names = [json.loads(f'"{x}"', strict=False) if "\\" in x else x for x in _CANDIDATE.findall(prompt, block)] if block >= 0 else []
    copied = False
    if prompt and worded:
        whole = words(_MARKS.sub(" ", _MARKUP.sub(" ", answer)))
        source = words(prompt)
        outside = words(wording)
        real = any(c or n in names for n, c in p.items) and "potential_spans" not in answer.casefold()
        mine = outside if real else whole
        copied = (len(mine) >= 2 * TILE and tiled(mine, source) >= COPY * len(mine)) or (post is not None and alike(mine, words(post)))
        copied = copied and not (real and len(outside) < 2 * TILE)
    if worded and not copied and declines(wording):
        return "refusal"
    known = set(names)
    strange = [c for n, c in p.items if c and n not in known]
    if strange and all(map(declines, strange)) or said and all(map(declines, said)):
        return "refusal"
    if not prompt:
        return None
    if not copied and said and post is not None:
        post_words = words(post)
        copied = all(alike(words(c), post_words) for c in said)
    if copied:
        return "copied"
    if names and not complete(p.items, names):
        return "truncated"
    if said and post is not None and (own := language(post, model)):
        others = sum(lang is not None and lang != own for lang in (language(c, model) for c in said))
        if others * 2 > len(said):
            return "other_language"
    return None


def complete(items: list[tuple[str, str]], names: list[str]) -> bool:
    """Whether the items come to the end of the last candidate."""
    if len(items) >= len(names):
        return True
    last = names[-1]
    return bool(items) and items[-1][0] == last and [n for n, _ in items].count(last) >= names.count(last)


def _flag(rows: DataFrame, known: Profiles | None) -> DataFrame:
    """rows(tbl, rec_key, prompt, answer) to one row (tbl, rec_key, defect) per defective key."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # a table of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tbl, key, prompt, answer in zip(batch["tbl"], batch["rec_key"], batch["prompt"], batch["answer"]):
                defect = judge(prompt, answer, shared.value)
                if defect:
                    out.append((tbl, key, DEFECTS.index(defect)))
            yield pd.DataFrame(out, columns=["tbl", "rec_key", "place"])

    found = spread(rows.where("rec_key IS NOT NULL")).mapInPandas(run, "tbl string, rec_key string, place int")
    defects = F.array(*map(F.lit, DEFECTS))
    return found.groupBy("tbl", "rec_key").agg(F.min("place").alias("place")).select("tbl", "rec_key", F.get(defects, "place").alias("defect"))


def turns(messages: Column) -> Column:
    """(prompt, answer) of each assistant message and the last user message before it; messages without an assistant
    give one pair without an answer, so do no messages at all."""
    last = lambda i: F.get(F.reverse(F.filter(F.slice(messages, 1, i), lambda m: m.role == "user")), 0).content
    said = F.filter(F.transform(messages, lambda m, i: F.struct(m.role.alias("role"), last(i).alias("prompt"), m.content.alias("answer"))), lambda t: t.role == "assistant")
    pairs = F.transform(said, lambda t: F.struct(t.prompt.alias("prompt"), t.answer.alias("answer")))
    first = F.get(F.filter(messages, lambda m: m.role == "user"), 0).content
    none = F.array(F.struct(first.alias("prompt"), F.lit(None).cast("string").alias("answer")))
    return F.when(F.size(pairs) > 0, pairs).otherwise(none)


def flag(sft: DataFrame, rollout: DataFrame, known: Profiles | None = None) -> DataFrame:
    """(tbl, rec_key, defect) of both tables; only the columns needed are read."""
    a = sft.select(F.lit("sft").alias("tbl"), F.col("id").alias("rec_key"), F.inline(turns(F.col("messages"))))
    stored = F.when(F.size("parsed_output") > 0, F.to_json("parsed_output")) if "parsed_output" in rollout.columns else F.lit(None).cast("string")
    b = rollout.select(F.lit("rollout").alias("tbl"), F.col("rollout_id").cast("string").alias("rec_key"), F.col("input_text").alias("prompt"), F.coalesce("output_text", stored).alias("answer"))
    return _flag(a.unionByName(b), known)


def stored_items(rollout: DataFrame) -> DataFrame:
    """(rollout_id, n_read, n_stored): steps whose stored ``parsed_output`` is not what the parser reads in their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, stored in zip(batch["rollout_id"], batch["output_text"], batch["stored"]):
                read = [n for n, _ in parse(text or "").items]
                kept = [x.get("user_name") or "" for x in json.loads(stored)] if stored else []
                if read != kept:
                    out.append((key, len(read), len(kept) if stored else None))
            yield pd.DataFrame(out, columns=["rollout_id", "n_read", "n_stored"]).astype({"n_stored": "Int32"})

    rows = rollout.where("rollout_id IS NOT NULL").select("rollout_id", "output_text", F.to_json("parsed_output").alias("stored")).distinct()
    return rows.mapInPandas(run, "rollout_id bigint, n_read int, n_stored int")
