"""Text that was decoded with a wrong character encoding: finding it, and giving back the original where it is known.

Method: for every pair of a true and a wrong encoding the garbled forms of the characters that texts are made of are
computed beforehand and put into one multi-pattern automaton, built once per Python worker. A text is walked once per
level of garbling; only the spans that match are replaced, so right text between them stays as it is.

Patterns are of four sorts.
* unit: a whole character of UTF-8 read byte by byte (``Ã©``); one is proof, as long as it holds more than letters
  and punctuation that also meet in right text.
* run: a character of a one- or two-byte encoding read byte by byte (``ÖÐ``); such forms may occur by chance, so
  several must follow each other.
* seed: the first character of UTF-8 read two bytes at a time (``鍒``, ``鈥``); the text from there must go back,
  byte by byte, to valid UTF-8 of common characters. Lost bytes (U+FFFD) stand for any byte in this check.
* sure: U+FFFD itself, and its own garbled form.
Russian text of one Cyrillic code page in another is letters of the same script; where nothing but runs and a few chance
forms is found, its words are read back in each pair and must be cased, voiced and lettered like Russian, clearly more so than as they stand.

Runs of Chinese, Korean and Japanese in two bytes share most of their forms: each reading is judged by the share of its
characters that are among the commonest of its language, the likeliest one is taken, and where another comes near, or
none is likely, the text counts as not known for sure. Readings of Russian are judged by their letters in the same way.

Each sort has an automaton of its own behind a gate, a character pattern that right text seldom passes: sound texts
cost little more than the gates. Text garbled several times is restored level by level until no known span is left.
Whole texts are searched; the work is linear in their length.

Defined cases: null, empty and ASCII texts are sound; accents, foreign scripts, emoji, half-width forms and drawing
characters of right text match no pattern or too few; a span with lost bytes is found but keeps its U+FFFD, and the
text counts as not fully restorable; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graftline.runtime import spread

BYTEWISE = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "cp1254")
PAIRWISE = ("gb18030", "cp949", "cp932", "big5hkscs")
#: True encodings of texts in one or two bytes, and the wrong ones they are read in.
_LATIN_PAGES = ("cp1252", "latin-1", "mac_roman", "cp1250", "cp437", "cp850")
LEGACY = dict.fromkeys(("gb2312", "big5", "euc_kr", "cp932"), (*_LATIN_PAGES, "cp1251")) | dict.fromkeys(("koi8-r", "cp1251", "cp866", "iso8859-5"), _LATIN_PAGES)
#: The commonest characters of each language that two bytes write; fixed values.
_COMMONEST = {
    "gb2312": "的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长知样现分将外但身些与高意进把法此实回二理美点月明，。！？、",
    "big5": "的一是不了在人有我他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可她裡後小麼心多天而能好都然沒日於起還發成事只作當想看文無開手十用主行方又如前所本見經頭面公同三已老從動兩長知樣現分將外但身些與高意進把法此實回二理美點月明，。！？、",
    "euc_kr": "이다는을가에의를은한고지로도하사서리기자어나인아시그대라으스있해일수정게보부제장들것면전만요여주구과상원와었우안음무동공거오소마",
    "cp932": "のにはをたがでてとしれさいるなもこらかうまきっりそよくあすおけえみちつどめやわろせんだじばねびぶごーンスルトイリアクラ、。日人年大一本中出国",
}
SWAPPED = ("mac_roman", "cp437", "cp850", "cp1251", "koi8-r")
#: Code pages that are told from each other by how Russian their words are.
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5")
#: Share in percent of each letter in Russian texts.
_OFTEN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (11, 8.5, 8, 7.4, 6.7, 6.3, 5.5, 4.7, 4.5, 4.4, 3.5, 3.2, 3, 2.8, 2.6, 2, 1.9, 1.7, 1.7, 1.7, 1.6, 1.4, 1.2, 1, 0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.3, 0.1, 0.1), strict=True))
_LATIN = "áéíóúüñàâçèêëîïôœùûäößåæø¿ÁÉÍÓÚÑÜÄÖÀÇÅÆØ"
#: Signs that also stand between letters in right text, so that one of them proves nothing.
_WEAK = frozenset("·±÷×²³¹°º≤≥")
#: Signs that stand at words of right text.
_STOPS = frozenset("…–—‘’“”‚„•™©®°‹›«»¡¿")
#: Cyrillic letters that are also put into Latin words for their looks.
_TWINS = frozenset("аеорсухіАЕОРСУХВНКМТ")
#: Signs beside letters in Russian texts.
_SIGNS = frozenset("«»—–…“”„№’‘•·°§©®™€\xa0")
_WIDE, _TRAILED = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[^\x00-\x7f](?:[^\x00-\x7f]|(?<=[^\x00-\x7f])[@-~])*")
#: Share of the commonest characters from which a reading is likely, and how near a rival may come.
LIKELY, RIVAL = 0.12, 0.5
LOST = "�"
#: What è and ë become in GBK: nouns that right text, too, puts right after a Latin word.
_NOUNS = frozenset(x.encode().decode("gb18030") for x in "èë")
#: Signs that Russian letters become in another Cyrillic code page.
_PAGES = re.compile(r"[Ѐ-ӿ─-▟]{3}")
_RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
#: Characters of right text that may follow each other by chance although they are a form of some character.
_PLAIN = re.compile(r"[A-Za-zА-яЁё«»„“”‘’‚–—…№ \xa0·]+")


def _table(codec: str) -> list[str]:
    """Character of each byte; bytes the code page leaves open stay control characters, as most software has it."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _repertoire() -> list[str]:
    """Characters of texts in Chinese, Latin and Cyrillic script that take two or three bytes of UTF-8."""
    out = [chr(c) for c in [*range(0xA0, 0x180), *range(0x300, 0x370), *range(0x391, 0x3CA), *range(0x660, 0x66A), *range(0x966, 0x970)]] + list(_RUSSIAN + _RUSSIAN.upper())
    out += [chr(c) for c in [*range(0x2010, 0x2027), *range(0x2030, 0x203B), 0x20AC, 0x2122, 0x200B, 0x200D, 0xFE0F, 0xFEFF, 0xFFFD]]
    out += [c for page in BYTEWISE for c in _table(page) if not c.isascii()]  # what a first wrong reading makes
    out += [chr(c) for c in [*range(0x3000, 0x3020), *range(0x3041, 0x30FF), *range(0xFF01, 0xFFA0), *range(0x2600, 0x27C0), *range(0x2190, 0x2200)]]
    return [*dict.fromkeys(out)] + _hanzi("gb2312", 0xB0, 0xF8, 0xA1) + _hanzi("euc_kr", 0xB0, 0xC9, 0xA1)


def _hanzi(codec: str, low: int, high: int, trail: int) -> list[str]:
    out = []
    for a in range(low, high):
        for b in range(trail, 0xFF):
            try:
                out.append(bytes([a, b]).decode(codec))
            except UnicodeDecodeError:
                continue
    return [c for c in out if len(c) == 1]


#: Lead bytes from and to, first trail byte and signs of the two-byte encodings.
_TWO_BYTES = {
    "gb2312": (0xB0, 0xD8, 0xA1, "，。！？、：；（）《》“”…—"), "big5": (0xA4, 0xC7, 0x40, "，。！？、：；（）《》…"),
    "euc_kr": (0xB0, 0xC9, 0xA1, ""), "cp932": (0x82, 0x99, 0x40, "、。「」ー！？…"),
}


def _cells(true: str) -> list[str]:
    """Characters of texts in a two-byte encoding."""
    low, high, trail, signs = _TWO_BYTES[true]
    return [c for c in [*_hanzi(true, low, high, trail), *signs] if not 0xFF01 <= ord(c) <= 0xFF5E or c in signs]


def _bytes_of(c: str, codec: str) -> bytes:
    try:
        return c.encode(codec)
    except UnicodeEncodeError:
        return b""


def _one_of(chars: Iterable[str]) -> str:
    return f"[{''.join(map(re.escape, sorted(set(chars))))}]"


class Patterns:
    """An automaton over the forms of one sort; a text is walked if it passes a gate: it holds one of some characters
    and, where that is so, matches a pattern."""

    def __init__(self) -> None:
        self.forms: dict[str, dict[tuple[str, str], str]] = defaultdict(dict)
        self.gates: list[tuple[frozenset[str], re.Pattern]] = []

    def gate(self, chars: Iterable[str], pattern: str) -> None:
        self.gates.append((frozenset(chars), re.compile(pattern)))

    def passes(self, text: str, letters: set[str]) -> bool:
        return not self.gates or any(not chars.isdisjoint(letters) and pattern.search(text) for chars, pattern in self.gates)

    def close(self) -> Patterns:
        self.automaton = ahocorasick.Automaton()
        for form, pairs in self.forms.items():
            self.automaton.add_word(form, (len(form), tuple(pairs.items())))
        self.automaton.make_automaton()
        return self


class Finder:
    """The automata and what their patterns stand for."""

    def __init__(self) -> None:
        self.tables = {c: _table(c) for c in {*BYTEWISE, *(w for ws in LEGACY.values() for w in ws)}}
        self.bytes = {c: {ch: b for b, ch in reversed(list(enumerate(t)))} for c, t in self.tables.items()}
        self.level1 = frozenset(_hanzi("gb2312", 0xB0, 0xD8, 0xA1)) | frozenset("，。！？、：；（）《》“”‘’…—　【】～￥") | frozenset(chr(c) for c in range(0xFF01, 0xFF5F))
        self.commonest = {true: frozenset(x) for true, x in _COMMONEST.items()}
        self.goes_on: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        self.sorts = [x.close() for x in (self._unit_forms(), self._two_byte_forms(), self._one_byte_forms(), *map(self._seed_forms, PAIRWISE), self._swap_forms())]
        self.marks = {}
        for wrong in ("cp437", "mac_roman"):
            form = {c: _table(wrong)[c.encode("cp1252")[0]] for c in "’—“”…"}
            self.marks[wrong] = ({f: c for c, f in form.items()}, re.compile(
                f"(?={_one_of(form.values())})(?:(?<={'[a-z]' if form['’'].isupper() else 'n'})(?P<contraction>{form['’']})(?={'[ts]' if form['’'].isupper() else 't'}\\b)|(?<=\\bI)(?P<contraction2>{form['’']})(?=(?:d|m|ve|ll)\\b)|(?<= )(?P<dash>{form['—']})(?= )"
                f"|(?<![^\\s])(?P<{'contraction3' if form['“'] == 'ì' else 'open'}>{form['“']})(?=[A-Za-z])|(?<=[a-z.])(?P<rest>{form['…']}|{form['”']})(?![^\\s]))".replace("contraction2", "short").replace("contraction3", "word")))
        self.cyrillic = []
        for true in CYRILLIC:
            for wrong in CYRILLIC:
                back = {self.tables[wrong][c.encode(true)[0]]: c for c in _RUSSIAN + _RUSSIAN.upper()}
                if true != wrong:
                    gain = {x: math.log(_OFTEN.get(y.lower(), 0.05) / _OFTEN.get(x.lower(), 0.05)) for x, y in back.items()}
                    self.cyrillic.append(((f"page {true}", wrong), str.maketrans(back), re.compile(f"{_one_of(back)}+"), gain))
        self.order = {w: i for i, w in enumerate(BYTEWISE)}

    def _unit_forms(self) -> Patterns:
        out = Patterns()
        letters = _repertoire()
        for wrong in BYTEWISE:
            table = self.tables[wrong]
            for c in letters:
                form = "".join(table[b] for b in c.encode())
                out.forms[form]["plain" if _PLAIN.fullmatch(form) else "unit", wrong] = c
            for third in range(0x80, 0xC0):  # emoji and the like, four bytes
                out.forms["".join(table[b] for b in (0xF0, 0x9F, third))]["unit", wrong] = ""
            if (sign := table[0xB4]) not in "´Д":  # the acute of a face that lost its other signs; (Д`), in iso8859-5, is a face of its own
                out.forms[f"({sign}`)"]["sure", "cp1251"] = LOST
        for form in ("锟斤拷", "锟斤"):  # U+FFFD itself, read as GBK
            out.forms[form]["sure", "gb18030"] = LOST
        euro, pound = (self.tables["cp1251"][b] for b in (0x80, 0xA3))  # of cp1252, before an amount
        for form in (f" {sign}{digit}" for sign in (euro, pound) for digit in "0123456789"):
            out.forms[form]["sure", "cp1251"] = LOST
        out.forms[LOST]["sure", "utf-8"] = LOST
        return out

    def _two_byte_forms(self) -> Patterns:
        out = Patterns()
        for pages in (_LATIN_PAGES, ("cp1251",)):
            leads, trails = set(), set()
            for true in _TWO_BYTES:
                cells = [(c, raw) for c in _cells(true) if len(raw := _bytes_of(c, true)) == 2]
                for wrong in pages:
                    table = self.tables[wrong]
                    for c, raw in cells:
                        first, second = table[raw[0]], table[raw[1]]
                        out.forms[first + second][f"run {true}", wrong] = c
                        leads.add(first)
                        trails.add(second)
            out.gate(leads, f"(?:{_one_of(leads)}{_one_of(trails)}){{2}}")
        return out

    def _one_byte_forms(self) -> Patterns:
        out = Patterns()
        for true in ("koi8-r", "cp1251", "cp866", "iso8859-5"):
            for wrong in LEGACY[true]:
                for c in _RUSSIAN + _RUSSIAN.upper():
                    form = self.tables[wrong][c.encode(true)[0]]
                    if not form.isascii() and not "Ѐ" <= form <= "ӿ":
                        out.forms[form][f"run {true}", wrong] = c
        out.gate(out.forms, f"{_one_of(out.forms)}{{3}}")
        return out

    def _seed_forms(self, wrong: str) -> Patterns:
        """First characters of UTF-8 read in pairs. Behind the first of three bytes another must stand that goes on with
        UTF-8; accents and signs, of two bytes, stand between ASCII; Cyrillic letters, of two bytes, stand together."""
        out, ascii_, long, pairs = Patterns(), f"[\\x00-\\x7f{LOST}]", set(), {True: set(), False: set()}
        for lead in (0xC2, 0xC3, 0xCC, 0xD0, 0xD1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xEB, 0xEC, 0xED, 0xEF, 0xF0):
            for second in range(0x80, 0xC0):
                try:
                    form = bytes([lead, second]).decode(wrong)
                except UnicodeDecodeError:
                    continue
                out.forms[form]["seed", wrong] = ""
                (long if lead >= 0xE0 else pairs[lead >= 0xD0]).add(form)
        goes_on = [LOST, *(c for c in self._wide(wrong) if 0x80 <= _bytes_of(c, wrong)[0] < 0xC0), *(x[1] for x in long if x[1:])]
        short = pairs[True] | pairs[False]
        out.gate((x[0] for x in long), f"{_one_of(x[0] for x in long)}{_one_of(goes_on)}")
        out.gate((x[0] for x in short), f"(?:^|{ascii_}){_one_of(''.join(short))}{{1,4}}(?:{ascii_}|$)|{_one_of(''.join(pairs[True]))}{{3}}")
        self.goes_on[wrong] = frozenset(x[0] for x in long), frozenset(goes_on)
        return out

    @staticmethod
    def _wide(codec: str) -> list[str]:
        """Characters that the encoding writes in one byte above ASCII or in two."""
        out = [bytes([b]).decode(codec, "ignore") for b in range(0x80, 0x100)]
        out += [bytes([a, b]).decode(codec, "ignore") for a in range(0x81, 0xFF) for b in range(0x40, 0xFF)]
        return [c for c in dict.fromkeys(out) if len(c) == 1 and not c.isascii() and _bytes_of(c, codec)]

    @staticmethod
    def _swap_forms() -> Patterns:
        """Accents of a one-byte text in another one-byte code page."""
        out = Patterns()
        for wrong in SWAPPED:
            for c in _LATIN:
                form = _table(wrong)[c.encode("cp1252")[0]]
                if not form.isascii() and not ("ß" <= form <= "ž" and form.islower()):
                    out.forms[form]["swap", wrong] = c
        telling = [f for f, pairs in out.forms.items() if f not in _STOPS or "¿" in pairs.values()]
        out.gate(telling, f"{_one_of(telling)}(?:(?<=[A-Za-z].)|(?=[A-Za-z]))")
        return out

    def spans(self, text: str) -> list[tuple[int, int, str | None, bool]]:
        """Disjoint garbled spans (start, end, original or None where it is lost, whether no other reading is near), in order."""
        hits: dict[tuple[str, str], dict[int, tuple[int, str]]] = defaultdict(dict)
        letters = set(text)
        for sort in self.sorts:
            if sort.passes(text, letters):
                for end, (n, pairs) in sort.automaton.iter(text):
                    for pair, c in pairs:
                        at = hits[pair]
                        if end - n + 1 not in at or at[end - n + 1][0] < end + 1:
                            at[end - n + 1] = (end + 1, c)
        found: list[tuple[tuple[str, str], list[tuple[int, int, str | None]]]] = []
        likely: dict[tuple[str, str], float] = {}
        for pair, at in hits.items():
            kind, wrong = pair
            if kind == "sure":
                got = [(s, e, None) for s, (e, _) in at.items()]
            elif kind == "unit":
                got = self._units(text, wrong, at)
            elif kind == "seed":
                got = self._seeds(text, wrong, at)
            elif kind == "swap":
                got = self._swaps(text, at)
            elif kind == "plain":
                got = self._plains(text, at)
            else:
                got, likely[pair] = self._runs(text, kind[4:], wrong, at)
            if got:
                found.append((pair, got))
        if (got := self._marks(text)):
            found.append((("swap", "marks"), got))
        others = sum(e - s for pair, got in found if pair not in likely for s, e, _ in got)
        pages, got = self._pages(text)
        if got and sum(e - s for s, e, _ in got) > 4 * others:  # few chance forms at most
            found = [(pages, got)]
        # the pair that explains most of a text comes first, of readings of the same bytes the likeliest; the others fill what they leave
        rank = {pair: (-sum(e - s for s, e, _ in got) * (0.5 + likely.get(pair, 1.0)), pair[0] != "unit", -sum(c in _USUAL for _, _, c in got if c), self.order.get(pair[1], 99)) for pair, got in found}
        weight = {pair: likely[pair] * sum(e - s for s, e, _ in got) for pair, got in found if pair in likely}
        taken = bytearray(len(text))
        out = []
        for pair, got in sorted(found, key=lambda x: (*rank[x[0]], x[0])):
            sure = pair not in likely or likely[pair] >= LIKELY and all(other[0] == pair[0] or w < RIVAL * weight[pair] for other, w in weight.items())
            for s, e, c in (*self._stretch(text, pair, got), *got):
                if taken.find(1, s, e) < 0:
                    taken[s:e] = b"\1" * (e - s)
                    out.append((s, e, c, sure))
        return sorted(out, key=lambda x: x[0])

    def _stretch(self, text: str, pair: tuple[str, str], got: list[tuple[int, int, str | None]]) -> list[tuple[int, int, str]]:
        """Whole stretches of characters above ASCII read back in a pair that is proven: in the whole text where the
        proof covers half of such characters, else from the first to the last proven span and what they hang together with."""
        kind, wrong = pair
        true = "utf-8" if kind in ("unit", "plain") else kind.partition(" ")[2]
        if not true or wrong not in self.bytes:
            return []
        wide = len(text) - len(text.encode("ascii", "ignore"))
        proven = "".join([text[s:e] for s, e, _ in got])
        low, high = (0, len(text)) if 2 * (len(proven) - len(proven.encode("ascii", "ignore"))) >= wide else (min(s for s, _, _ in got), max(e for _, e, _ in got))
        out = []
        latin = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalpha()
        inner = (low, high)
        while low and not text[low - 1].isascii():
            low -= 1
        while high < len(text) and not text[high].isascii():
            high += 1
        for m in (_TRAILED if true in ("big5", "cp932") else _WIDE).finditer(text, low, high):
            ends = [(m.start(), m.end()), (m.start(), m.end() - 1)] if m[0][-1].isascii() else [(m.start(), m.end()), (max(m.start(), inner[0]), min(m.end(), inner[1]))]
            for start, end in dict.fromkeys(ends):
                if true != "utf-8" and true not in _TWO_BYTES and (latin(start - 1) or latin(end)):  # a Latin word's own accent
                    break
                back = self._read(text[start:end], true, wrong) if start < end else None
                if back:
                    out.append((start, end, back))
                    break
        return out

    def _read(self, form: str, true: str, wrong: str) -> str | None:
        """The form's bytes in the true encoding, if that gives signs of text."""
        raw = [self.bytes[wrong].get(x, ord(x) if x.isascii() else None) for x in form]
        try:
            back = bytes(raw).decode(true)
        except (TypeError, UnicodeDecodeError):
            return None
        if true in _TWO_BYTES and form[1:].isascii() and back not in self.commonest[true]:  # as the end of schön
            return None
        if true == "utf-8" or true in _TWO_BYTES:
            return back if len(back) < len(form) else None
        return back if all("Ѐ" <= c <= "ё" or c in _SIGNS for c in back) else None

    def _units(self, text: str, wrong: str, at: dict[int, tuple[int, str]]) -> list[tuple[int, int, str | None]]:
        out, back = [], self.bytes[wrong]
        for s, (e, c) in at.items():
            if c == "":
                raw = bytes(back.get(x, 0) for x in text[s : s + 4])
                try:
                    c, e = raw.decode(), s + 4
                except UnicodeDecodeError:
                    continue
                if len(c) != 1:
                    continue
            out.append((s, e, c))
        return out

    def _seeds(self, text: str, wrong: str, at: dict[int, tuple[int, str]]) -> list[tuple[int, int, str | None]]:
        out, reach = [], -1
        long, goes_on = self.goes_on[wrong]
        for s in sorted(at):
            if s < reach or text[s] in long and text[s + 1 : s + 2] not in goes_on:
                continue
            span = self._pairwise(text, s, wrong)
            if span:
                out.append(span)
                reach = span[1]
        return out + self._beside(text, wrong, at, out) if out else out

    def _beside(self, text: str, wrong: str, at: dict[int, tuple[int, str]], proven: list[tuple[int, int, str | None]]) -> list[tuple[int, int, str | None]]:
        """Characters too short to be proof by themselves, of the kinds that are proven elsewhere in the text, apart from other
        wide characters."""
        kinds = {_kind(c) for _, _, found in proven for c in found or ""} - {""}
        taken = {i for s, e, _ in proven for i in range(s, e)}
        ends = {s for s, _, _ in proven} | {e for _, e, _ in proven}
        apart = lambda i, edge: not 0 <= i < len(text) or text[i].isascii() or edge in ends
        out, reach = [], -1
        for s in sorted(at):
            if s < reach or s in taken or not apart(s - 1, s):
                continue
            span = self._pairwise(text, s, wrong, known=True)
            if span and span[2] and apart(span[1], span[1]) and taken.isdisjoint(range(s, span[1])) and all(c.isascii() or _kind(c) in kinds for c in span[2]):
                out.append(span)
                reach = span[1]
        return out

    @staticmethod
    def _plains(text: str, at: dict[int, tuple[int, str]]) -> list[tuple[int, int, str | None]]:
        """Forms that right text also holds, as a Cyrillic letter and a sign; proof where they stand in a Latin word."""
        out = []
        for s, (e, c) in at.items():
            left, right = text[s - 1 : s] if s else "", text[e : e + 1]
            inside = "А" <= text[s] <= "я" and text[s + 1] not in "–—-" and not "Ѐ" <= left <= "ӿ" and not "Ѐ" <= right <= "ӿ"
            if inside and (left.isascii() and left.isalpha() or not left.isalnum() and right.isascii() and right.isalpha()) and not text[s + 1].isspace():
                out.append((s, e, c))
        return out

    @staticmethod
    def _swaps(text: str, at: dict[int, tuple[int, str]]) -> list[tuple[int, int, str | None]]:
        """Odd signs inside, at the end or at the head of words in ASCII letters; two of them, or one that never stands there."""
        out, proof = [], 0.0
        letter = lambda i: 0 <= i < len(text) and (text[i].isascii() and text[i].isalpha() or i in at and text[i] not in _STOPS)
        for s, (e, c) in at.items():
            if text[s] in _STOPS and c != "¿":
                continue
            left, right = letter(s - 1), letter(e)
            low, high = s, e
            while letter(low - 1) and s - low < 4:
                low -= 1
            while letter(high) and high - e < 4:
                high += 1
            around = high - e + s - low  # letters of the word beside the sign
            odd = not ("ß" <= text[s] <= "ɏ" and text[s].isalpha()) or text[s].isupper()  # no small Latin letter
            cyrillic, weak = "Ѐ" <= text[s] <= "ӿ", text[s] in _WEAK
            after = text[e : e + 1]
            before = text[s - 1 : s] if s else ""
            if left and not before.isascii():  # right after another sign, itself in a word
                before = text[s - 2 : s - 1] if s > 1 else ""
                left = before.isascii() and before.isalpha()
            fits = left and (before.islower() or not ("À" <= text[s] <= "ɏ" and text[s].isalpha())) and not (text[s].isalpha() and after.isascii() and after.isupper())
            if fits and (right or not (after.isalpha() or after.isdigit())):
                out.append((s, e, c))
                proof += 0 if not odd else (1 if text[s] in _TWINS else 2 if around >= 3 else 1) if cyrillic else (2 if right and around >= 4 else 0.5) if weak else 2 if right or around >= 2 else 1
            elif right and high - e >= 3 and not left and not text[s].isalnum() and text[s] not in "«»‹›„“”‘’¿¡·" and not text[s - 1 : s].strip() and text[e : e + 3].islower():
                out.append((s, e, c))
                proof += 2 if "─" <= text[s] <= "▟" else 1
            elif c == "¿" and after.isascii() and after.isupper():
                out.append((s, e, c))
                proof += 0.5
        return out if proof >= 2 else []

    def _marks(self, text: str) -> list[tuple[int, int, str | None]]:
        """Marks of a one-byte text in another one-byte code page, told by their places in English words."""
        for marks, rule in self.marks.values():
            hits = list(rule.finditer(text))
            kinds = {m.lastgroup for m in hits}
            if kinds & {"contraction", "short", "word"} or len(kinds) >= 2 and kinds & {"dash", "open"}:
                return [(m.start(m.lastgroup), m.end(m.lastgroup), marks[m[m.lastgroup]]) for m in hits]
        return []

    def _pairwise(self, text: str, start: int, wrong: str, known: bool = False) -> tuple[int, int, str | None] | None:
        """The longest stretch from ``start`` whose bytes in ``wrong`` are UTF-8 of common characters."""
        i, n, raw, ends, lost = start, len(text), bytearray(), [], False
        chars: list[str] = []
        good_end, good_chars = start, 0
        while i < n:
            ch = text[i]
            if ch == LOST:
                raw.append(0xBF)
                lost = True
            elif ch.isascii() and not raw:
                break
            else:
                try:
                    raw += ch.encode(wrong)
                except UnicodeEncodeError:
                    break
            i += 1
            bad = False
            while raw:
                need = 1 if raw[0] < 0x80 else 2 if 0xC2 <= raw[0] < 0xE0 else 3 if 0xE0 <= raw[0] < 0xF0 else 4 if raw[0] == 0xF0 else 0
                if not need or any(not 0x80 <= b < 0xC0 for b in raw[1:need]):
                    bad = True
                    break
                if len(raw) < need:
                    break
                try:
                    c = raw[:need].decode()
                except UnicodeDecodeError:
                    bad = True
                    break
                del raw[:need]
                if c.isascii():
                    bad = not ends  # the second byte of a pair whose first ended a character
                    chars.append(c)
                    good_end = i
                    raw.clear()
                    bad = True
                    break
                chars.append(c)
                good_chars += 1
            if bad:
                break
            if not raw:
                good_end = i
                ends.append(i)
        wide = [c for c in chars if not c.isascii()]
        if not wide or not known and not self._proof(text, start, good_end, wide, lost):
            return None
        end = max(good_end, start + 1)
        return start, end, None if lost or raw else "".join(chars)

    def _proof(self, text: str, start: int, end: int, wide: list[str], lost: bool) -> bool:
        hanzi = sum(c in self.level1 for c in wide)
        cyrillic = sum("А" <= c <= "я" or c in "ёЁ" for c in wide)
        if hanzi >= 2 and hanzi >= 0.7 * len(wide) or cyrillic >= 3 and cyrillic == len(wide):
            return True
        if wide and (wide[0] in "‘’“”–—…€™•" or "\U0001f000" <= wide[0] <= "\U0001ffff"):
            return True
        left, right = text[start - 1 : start] if start else "", text[end : end + 1]
        if len(wide) == 1 and "\u0300" <= wide[0] <= "\u036f":  # an accent of its own after its letter
            return left.isascii() and left.isalpha()
        if len(wide) == 1 and wide[0] in "§°±²³·½¼¾×÷£¥©®«»¿¡":
            return (not left or left.isascii()) and (not right or right.isascii()) and (not left or left.isspace()) != left.isdigit()
        if wide and ("☀" <= wide[0] <= "➿" and text[start] not in self.level1 or "･" in wide):
            return True
        if wide and len(wide) <= 2 and all(c in _ACCENTED for c in wide) and (len(wide) == 2 or not left.isalnum()):
            tail = text[end : end + 3]
            return left.isascii() and left.isalpha() and (not right or right.isascii()) or not left.isalnum() and len(tail) == 3 and tail.isascii() and tail.islower()
        if len(wide) == 1 and wide[0].isalpha() and wide[0] in _ACCENTED:
            return (left.isascii() and left.isalpha()) and (not right or right.isascii()) and (text[start] not in _NOUNS or right.isalpha())
        return False

    def _runs(self, text: str, true: str, wrong: str, at: dict[int, tuple[int, str]]) -> tuple[list[tuple[int, int, str | None]], float]:
        """Spans of forms that follow each other, and how likely a text of the language they are, from 0 to 1."""
        runs: list[list[tuple[int, int, str]]] = []
        reach = -1
        for s in sorted(at):
            e, c = at[s]
            if runs and s == reach:
                runs[-1].append((s, e, c))
            elif s > reach:
                runs.append([(s, e, c)])
            else:
                continue
            reach = e
        two = true in _TWO_BYTES
        least, total = (2, 3) if two else (3, 4)
        kept = [r for r in runs if len(r) >= least and len({c for _, _, c in r}) > 1]
        if not two:  # words that go on in other letters are right text of another script
            foreign = lambda i: 0 <= i < len(text) and text[i].isalpha() and not text[i].isascii()
            kept = [r for r in kept if not foreign(r[0][0] - 1) and not foreign(r[-1][1])]
        if two:
            kept = [r for r in kept if sum(ord(x) > 0x7F for x in text[r[0][0] : r[-1][1]]) >= 3]
        chars = [c for r in kept for _, _, c in r]
        if len(chars) < total:
            return [], 0.0
        if not two:
            words = "".join(c for r in kept for _, _, c in [*r, (0, 0, " ")])
            likely = sum(_OFTEN.get(c.lower(), 0) for c in chars) / len(chars) / 12
            return ([(r[0][0], r[-1][1], "".join(c for _, _, c in r)) for r in kept], likely) if self._russian(words) else ([], 0.0)
        likely = sum(c in self.commonest[true] for c in chars) / len(chars)
        if likely < LIKELY and (true != "gb2312" or wrong == "cp1251" or len(chars) >= 25):  # chance forms, or another language
            return [], 0.0
        return [(r[0][0], r[-1][1], "".join(c for _, _, c in r)) for r in kept], likely

    def _pages(self, text: str) -> tuple[tuple[str, str], list[tuple[int, int, str | None]]]:
        """Words of one Cyrillic code page read in another, by the pair that gives the most Russian text."""
        best, most, pair = [], 0.0, ("", "")
        if not _PAGES.search(text):
            return pair, best
        often = Counter(text)
        for codecs, back, rule, gain in self.cyrillic:
            if sum(often[x] * g for x, g in gain.items() if x in often) <= 0:
                continue
            hits = [(m, m[0].translate(back)) for m in rule.finditer(text) if not text[m.end() : m.end() + 1].isalpha() and not (m.start() and text[m.start() - 1].isalpha())]
            words = [(m, c, sum(gain[x] for x in m[0])) for m, c in hits]
            long = [x for x in words if len(x[1]) > 2]
            n, won = sum(len(c) for _, c, _ in long), sum(g for _, _, g in long)
            if n >= 8 and won > max(most, 0.2 * n) and self._russian(" ".join(c for _, c, _ in long)):
                best, most, pair = [(m.start(), m.end(), c) for m, c, g in words if g > 0 or len(c) < 3], won, codecs
        return pair, best

    @staticmethod
    def _russian(text: str) -> bool:
        """Whether words are cased and voiced like Russian ones, which tells apart the one-byte code pages."""
        words = text.split()
        fine = sum(w[1:].islower() and bool(re.search("[аеёиоуыэюя]", w[1:])) for w in words if len(w) > 2)
        return fine >= 0.7 * sum(len(w) > 2 for w in words) and fine > 0

    def restore(self, text: str) -> tuple[int, str, bool]:
        """(number of garbled spans at the first level, text restored as far as it is known, whether wholly)."""
        first, sure, seen = None, True, {text}
        while not text.isascii():
            spans = self.spans(text)
            first = len(spans) if first is None else first
            known = [x for x in spans if x[2] is not None]
            if not known:
                return first, text, sure and not spans
            out, reach = [], 0
            for s, e, c, certain in known:
                out += [text[reach:s], c]
                reach = e
                sure = sure and certain
            text = "".join([*out, text[reach:]])
            if text in seen:  # signs that turn into each other
                return first, text, False
            seen.add(text)
        return first or 0, text, sure


def _kind(c: str) -> str:
    """Cyrillic, accented Latin or a sign of texts in these; nothing for other characters."""
    return "cyrillic" if "А" <= c <= "я" or c in "ёЁ" else "latin" if c in _ACCENTED or c in _USUAL or c in "«»ßœŒ" else ""


#: Letters and signs above ASCII that are usual in Western texts.
_USUAL = frozenset("áéíóúüñ¿¡àâçèêëîïôœùûäöß’“”…–—")
_ACCENTED = frozenset("áéíóúüñàâçèêëîïôœùûäößãõåæøÁÉÍÓÚÜÑÀÂÇÈÊÄÖÃÕÅÆØ")


@lru_cache(maxsize=1)
def finder() -> Finder:
    return Finder()


def repair(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_spans, restored, whole): one row per document with at least one garbled sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            rows = [(k, *find.restore(t)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and not t.isascii()]
            rows = [r for r in rows if r[1]]
            cells = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (batch.schema.field(0).type, pa.int32(), pa.string(), pa.bool_()))], [key, "n_spans", "restored", "whole"])

    schema = T.StructType([documents.schema[key], T.StructField("n_spans", T.IntegerType()), T.StructField("restored", T.StringType()), T.StructField("whole", T.BooleanType())])
    return spread(documents.select(key, text)).mapInArrow(run, schema)
