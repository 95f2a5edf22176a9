"""python tests/llm/measure_garble.py FOLDER: sound texts of documents garbled in every pair of encodings and restored.

Prints per true encoding: texts, share found, share restored exactly, and share of the inexact ones that say they are whole.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import pyarrow.parquet as pq

from graftline.llm import garble

OWN = {"gb2312": "zh", "koi8-r": "ru", "cp1251": "ru", "cp866": "ru", "iso8859-5": "ru"}
MADE = {
    "euc_kr": ["오늘 친구와 함께 공원에 갔는데 날씨가 아주 좋았다.", "이 가게의 커피는 정말 맛있지만 가격이 조금 비싸다.", "어제 본 영화는 생각보다 재미있었고 음악도 좋았다."],
    "cp932": ["今日は友達と一緒に公園へ行きました。とても楽しかったです。", "この店のコーヒーは本当においしいけれど、少し高い。", "昨日見た映画は思ったより面白くて、音楽もよかった。"],
    "big5": ["今天和朋友一起去公園，天氣很好，我們都很開心。", "這家店的咖啡真的很好喝，可是價格有一點貴。", "昨天看的電影比想像中有意思，音樂也不錯。"],
}


def texts(folder: str, n: int) -> dict[str, list[str]]:
    table = pq.read_table(f"{folder}/documents.parquet", columns=["text", "lang"]).to_pylist()
    find, out = garble.finder(), defaultdict(list)
    for row in table:
        t, lang = row["text"], (row["lang"] or "")[:2].lower()
        if t and 20 <= len(t) <= 400 and not t.isascii() and len(out[lang]) < n and not find.restore(t)[0]:
            out[lang].append(t)
    return out


def main() -> None:
    by_lang = texts(sys.argv[1], 60)
    find = garble.finder()
    pairs = [("utf-8", w) for w in (*garble.BYTEWISE, *garble.PAIRWISE)] + [(t, w) for t, ws in garble.LEGACY.items() for w in ws] + [(t, w) for t in garble.CYRILLIC for w in garble.CYRILLIC if t != w]
    total = defaultdict(lambda: [0, 0, 0, 0])
    for true, wrong in pairs:
        sample = [t for x in by_lang.values() for t in x] if true == "utf-8" else MADE.get(true) or by_lang[OWN[true]]
        n = found = exact = claimed = 0
        for t in sample:
            try:
                raw = t.encode(true)
                bad = raw.decode(wrong, "replace") if wrong in garble.PAIRWISE else "".join(garble._table(wrong)[b] for b in raw)
            except UnicodeEncodeError:
                continue
            if bad == t:
                continue
            spans, back, whole = find.restore(bad)
            n, found, exact, claimed = n + 1, found + (spans > 0), exact + (back == t), claimed + (back != t and whole)
        print(f"{true:10} read as {wrong:10} {n:4} texts, found {found / max(n, 1):.3f}, exact {exact / max(n, 1):.3f}, wrongly whole {claimed / max(n, 1):.3f}")
        for i, x in enumerate((n, found, exact, claimed)):
            total[true][i] += x
    for true, (n, found, exact, claimed) in total.items():
        print(f"{true}: {n} texts, found {found / max(n, 1):.3f}, exact {exact / max(n, 1):.3f}, wrongly whole {claimed / max(n, 1):.3f}")


if __name__ == "__main__":
    main()
