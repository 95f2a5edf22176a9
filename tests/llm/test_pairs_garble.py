"""Defective pairs case by case; wrong decoding by round trips."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graftline.llm import garble, pairs

POST = "The new yoga mat from Wawailo claims to be light; after 95 days I regret not buying it sooner."
NAMES = ["ann", "bob", "cyd"]


def prompt(post=POST, names=NAMES):
    spans = "".join(f'<|psep|>{{"user_name":"{n}","interests":[],"depth":0}}<|psep|>' for n in names)
    return f"username: zed\ncontent:\n{post}\nuserinterest: []\nhistoricalinteractors: []\npotentialspan:\n<POTENTIAL_SPANS>\n{spans}\n</POTENTIAL_SPANS>\n<TL0>"


def item(name, said="", kind=0):
    return f'{{"user_name": "{name}", "content": "<|cstart|>{said}<|cend|>", "type": {kind}}}'


FULL = f"[{item('ann')}, {item('bob', 'I own that lamp too and it is really dull.', 1)}, {item('cyd')}]"
SPANISH = ["No estoy de acuerdo, la tesis está rápida.", "¿Dónde compraste la cámara? Mi niño busca una más triste."]

CASES = [
    (FULL, None), (f"```json\n{FULL}\n```<|im_end|>", None), (f"[{item('ann')},{item('bob')},{item('cyd')}]", None), (FULL[:-1], None),
    (FULL.replace("really dull", "really gemütlich 加油 #dull#"), None), (FULL.replace("I own that lamp too and it is really dull.", "Sorry, I can't accept such a dull lamp, I have to try again."), None),
    (None, "empty"), ("", "empty"), (" \n​", "empty"), ("[ ]", "empty"), ("```json\n[]\n```", "empty"), ("<|cstart|><|cend|>", "empty"),
    ("I'm sorry, but I cannot predict how these users would react.", "refusal"), ("很遗憾，这个请求我没办法协助完成，希望您理解。", "refusal"), ("Leider muss ich diese Anfrage ablehnen.", "refusal"),
    ("Il m’est impossible d’écrire à la place d’autrui.", "refusal"), ("Lo siento, no puedo predecir qué harán estos usuarios.", "refusal"), ("К сожалению, я не могу предсказать их поведение.", "refusal"),
    (f"This is something I won't help with.\n{FULL}", "refusal"), (f"[{item('', '我不便判断候选人的行为，请换一个问题。')}]", "refusal"), (f"[{', '.join(item(n, 'I must decline to label these accounts.') for n in NAMES)}]", "refusal"),
    (POST, "copied"), (POST.upper().replace(";", " "), "copied"), (prompt(), "copied"), (f"content:\n{POST}", "copied"), (f"[{item('ann', POST.replace('light', 'heavy'), 1)}, {item('bob')}, {item('cyd')}]", "copied"),
    (FULL[:60], "truncated"), (FULL[: FULL.index(', {"user_name": "cyd"') + 2], "truncated"), (f"[{item('ann')}, {item('bob')}]", "truncated"), (f"```json\n{FULL[:-5]}\n```", "truncated"), (FULL[:-8] + "…", "truncated"),
    (f"[{item('ann', SPANISH[0], 1)}, {item('bob', SPANISH[1], 1)}, {item('cyd')}]", "other_language"), (f"[{item('ann', '这款雨伞我也用过，确实治愈。', 1)}, {item('bob')}, {item('cyd')}]", "other_language"),
]


KNOWN = pairs.fit({
    "en": ["The new lamp from the shop is really dull and I regret that I bought it, but my sister likes it.", "I own that too and it is not what they say; after two days we were sorry about it.", "What do you think of the light in there? To be honest it was very good for the price.", POST] * 3,
    "es": ["La nueva lámpara de la tienda está muy rápida y no me gusta nada, pero mi niño busca una más triste.", "¿Dónde compraste la cámara? Yo no estoy de acuerdo con lo que dicen de la tesis.", "Hay que decir que la luz era muy buena para el precio, aunque mi hermana está triste."] * 3,
    "de": ["Die neue Lampe aus dem Laden ist wirklich öde, und ich bereue, dass ich sie gekauft habe.", "Wo hast du die gekauft? Meine Schwester sucht etwas, das gemütlich ist.", "Das Licht war sehr gut für den Preis, aber ich glaube das nicht."] * 3,
    "fr": ["La nouvelle lampe du magasin est vraiment triste et je regrette de l’avoir achetée.", "Où as-tu trouvé la lampe ? Ma collègue en cherche une qui est très solide.", "La lumière était très bonne pour le prix, mais je ne suis pas d’accord."] * 3})


@pytest.mark.parametrize(("answer", "defect"), CASES)
def test_judge(answer, defect):
    assert pairs.judge(prompt(), answer, KNOWN) == defect


def test_profiles_from_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(POST, "EN"), (POST, "en_US"), (SPANISH[1], " es"), ("Wo hast du die gekauft, meine Schwester?", "DE"), (None, "fr"), ("x", "fr"), ("Où as-tu trouvé la lampe ?", None)])]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert pairs.profiles(df, 1) == pairs.fit({"en": [POST], "es": [SPANISH[1]], "de": ["Wo hast du die gekauft, meine Schwester?"]})
    assert pairs.profiles(df.limit(0)) == {} and pairs.language("the lamp", {}) is None and pairs.language("灯很好", None) == "zh"


def test_tiling_is_greedy_and_uses_no_word_twice():
    a, b = "p q r s t u v".split(), "r s t u x p q r".split()
    assert pairs.tiled(a, b) == 4 and pairs.tiled(a, b, 2) == 6 and pairs.tiled(a, a) == 7 and pairs.tiled([], a) == 0
    assert pairs.tiled(["x"] * 9, ["x"] * 4) == 4 and pairs.tiled(["ha"] * 3000, ["ha"] * 2000) == 2000


def test_stored_items(spark):
    rows = [(1, FULL, [(n, "", 0) for n in NAMES]), (2, FULL, [("ann", "", 0)]), (3, FULL, None), (4, None, []), (5, None, None), (2, FULL, [("ann", "", 0)])]
    df = spark.createDataFrame(rows, "rollout_id bigint, output_text string, parsed_output array<struct<user_name:string,content:string,type:int>>")
    assert {tuple(r) for r in pairs.stored_items(df).collect()} == {(2, 3, 1), (3, 3, None)}
    sft = spark.createDataFrame([], "id string, messages array<struct<role:string,content:string>>")
    kept = df.selectExpr("*", "CAST(NULL AS STRING) AS input_text").withColumn("output_text", F.lit(None).cast("string"))
    assert {tuple(r)[1:] for r in pairs.flag(sft, kept).collect()} == {("3", "empty"), ("4", "empty"), ("5", "empty")}


def test_judge_without_prompt_and_long_texts():
    assert pairs.judge(None, FULL[:50]) is None and pairs.judge(None, "") == "empty"
    assert pairs.judge(prompt("转发"), f"[{item('ann', '求链接，想给同事买一个。', 1)}, {item('bob')}, {item('cyd')}]") is None
    assert pairs.judge(prompt(), "{" * 2000 + "a") in pairs.DEFECTS


def test_flag_rows(spark):
    m = "id string, messages array<struct<role:string,content:string,loss:bigint>>, defect string"
    sft = spark.createDataFrame([("a", [("user", prompt(), 0), ("assistant", FULL, 1)], "x"), ("b", [("user", prompt(), 0), ("assistant", "", 1)], "x"), ("b", [("user", prompt(), 0), ("assistant", "", 1)], "x"), ("c", None, "x"), (None, None, "x"), ("d", [("user", prompt(), 0), ("assistant", FULL[:60], 1)], None)], m)
    rollout = spark.createDataFrame([(1, prompt(), FULL), (2, prompt(), POST), (3, None, None)], "rollout_id bigint, input_text string, output_text string")
    got = {tuple(r) for r in pairs.flag(sft, rollout).collect()}
    assert got == {("sft", "b", "empty"), ("sft", "c", "empty"), ("sft", "d", "truncated"), ("rollout", "2", "copied"), ("rollout", "3", "empty")}
    assert pairs.flag(sft.limit(0), rollout.limit(0)).count() == 0


def test_turns_of_any_shape(spark):
    m = "id string, messages array<struct<role:string,content:string,loss:bigint>>"
    rows = [("none", []), ("system", [("system", "s", 0)]), ("asked", [("user", prompt(), 0)]), ("said", [("assistant", FULL, 1)]), ("first", [("assistant", FULL, 1), ("user", prompt(), 0)]),
            ("two", [("user", prompt(), 0), ("assistant", FULL, 1), ("user", prompt(), 0), ("assistant", FULL[:60], 1)]), ("nulls", [None, ("user", None, None), (None, None, None), ("assistant", None, None)])]
    sft = spark.createDataFrame(rows, m)
    rollout = spark.createDataFrame([], "rollout_id bigint, input_text string, output_text string")
    assert {tuple(r)[1:] for r in pairs.flag(sft, rollout).collect()} == {("none", "empty"), ("system", "empty"), ("asked", "empty"), ("two", "truncated"), ("nulls", "empty")}


SOUND = ["", "plain", "Âmbar y CHÂTEAU, #NÃO", "naïve café, déjà vu, voilà… où ça ?", "½ cup 5×7±1 µm €5 ™", "ЁЖ: Рёбра и «СССР» — это № 1…", "你好，猫和毛，没每 谢谢", "(´･ω･`) ██▌ 87%", "l·l 5 m³ 20 °C", "¿Qué tal? ¡Ánimo!", "Größe, Straße, Übung", "Ποτάμι και θάλασσα", "안녕하세요 カフェ", "x≤y a±b", "٣٤ ५६ Åland"]
ZH, RU, EN, FR = "导师推荐的奶茶我排了分钟，味道便宜得不像话。", "Соседка говорит, что каша сегодня была вкусная", "I don’t know — maybe “later”…", "J’ai payé très tôt, ma théière préférée était gâtée"


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts(text):
    assert garble.finder().restore(text) == (0, text, True)


def wrong(text, true, read):
    table = garble._table(read)
    return "".join(table[b] for b in text.encode(true))


@pytest.mark.parametrize(("text", "true", "read"), [(t, "utf-8", r) for t in (ZH, RU, EN, FR) for r in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r")] + [(ZH, "gb2312", "cp1252"), (ZH, "big5", "latin-1"), (RU, "koi8-r", "cp1252"), (RU, "cp1251", "latin-1")])
def test_bytewise_round_trip(text, true, read):
    text = text.translate(str.maketrans("导师钟话宜", "工人友土上")) if true == "big5" else text
    try:
        bad = wrong(text, true, read)
    except UnicodeEncodeError:
        pytest.skip("not in the code page")
    mixed = f"ok {bad} Ende, schön"
    n, restored, whole = garble.finder().restore(mixed)
    assert n and restored.count(text[3:6]) >= 1 and restored.startswith("ok ") and restored.endswith("Ende, schön")


def test_double_pairwise_and_lost():
    find = garble.finder()
    twice = wrong(wrong(FR, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert find.restore(twice)[:2][1] == FR
    assert find.restore("小鹿在路上".encode().decode("gb18030", "replace"))[0]
    for text in ("can�t", "锟斤拷锟斤拷", "na茂ve f眉r", EN.encode().decode("gb18030", "replace"), ZH.encode().decode("cp949", "replace"), ZH.encode().decode("cp932", "replace"), "mu±eca s≤lida coraz≤n", "canÆt ù wait"):
        assert find.restore(text)[0], text
    assert not find.restore("can�t")[2]


def test_repair_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "fine é", None), (4, "cafÃ© olé", "x"), (4, "cafÃ© olé", "x"), (5, ("né " * 20_000) + "Ã©", "x")], "doc_id bigint, text string, restored string")
    rows = garble.repair(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_spans, r.whole) for r in rows] == [(4, 1, True), (4, 1, True), (5, 1, True)] and rows[0].restored == "café olé"
    assert garble.repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("true", garble.CYRILLIC)
@pytest.mark.parametrize("read", garble.CYRILLIC)
def test_russian_of_one_cyrillic_page_in_another(true, read):
    find, table = garble.finder(), garble._table(read)
    text = "Сегодня мы говорили о погоде, потому что вечером будет дождь и холодный ветер"
    n, restored, _ = find.restore("".join(table[b] for b in text.encode(true)))
    assert (n > 0) == (true != read) and restored.count("говорили") == restored.count("холодный") == 1
    for right in (text.upper(), "Мой дом, твой сад и наша школа стоят рядом", "ЦЕНА ЖИЛЬЯ СНОВА РАСТЁТ", "Сьогодні їхали дуже довго, бо йшов сильний дощ", "хм хм ого ааа эээ ыыы", "Щука ещё жуёт, цыпа в ящике", "┌──────┐│└─┘"):
        assert find._pages(right)[1] == []


def test_the_face_in_each_wrong_page():
    for wrong in ("cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8-r"):
        assert garble.finder().restore(f"ok ({garble._table(wrong)[0xB4]}`) so")[0] == 1, wrong
    assert garble.finder().restore("ok (Д`) so")[0] == 0 and garble.finder().restore("ok (´`) so")[0] == 0


KO, JA, TW = "오늘 친구와 함께 공원에 갔는데 날씨가 아주 좋았다.", "今日は友達と一緒に公園へ行きました。とても楽しかったです。", "今天和朋友一起去公園，天氣很好，我們都很開心。"


@pytest.mark.parametrize(("text", "true", "read"), [
    (t, true, r) for t, true in ((KO, "euc_kr"), (KO, "utf-8"), (JA, "cp932"), (TW, "big5"), (ZH, "gb2312"), (RU, "cp866"), (RU, "iso8859-5"), (RU, "koi8-r"), (RU, "cp1251")) for r in ("cp1252", "latin-1", "cp850")
] + [(RU, "cp866", "cp1251"), (RU, "cp1251", "cp866"), (KO, "utf-8", "koi8-r"), (FR, "utf-8", "cp1250")])
def test_exact_round_trip(text, true, read):
    assert garble.finder().restore(wrong(text, true, read))[1:] == (text, True)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_many_levels(read):
    bad = FR
    for _ in range(5):
        bad = wrong(bad, "utf-8", read)
    assert garble.finder().restore(bad)[1:] == (FR, True)


def test_what_is_not_sure_is_not_whole():
    find = garble.finder()
    n, back, whole = find.restore(wrong("鲸鱼岭塘", "gb2312", "cp1252"))
    assert n == 1 and back == "鲸鱼岭塘" and not whole  # rare characters only: another reading may be right
