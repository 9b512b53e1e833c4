"""Attributes of a product listing, parsed from its title, body and article numbers, in canonical units.

What of a listing may name the model is only gathered here: which of its words
does is learned from all listings (``linkage.modelled``).
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from millrace.llm.markup import PARA, blocks
from millrace.llm.recent import Recent

#: The colour of each spelling (fixed values: the shops' palettes in Swedish, English, Danish and German).
COLOURS = {
    "ice blue": "isblå, ice blue, icy blue, eisblau",
    "chestnut": "kastanjebrun, chestnut brown, chestnut, kastanienbraun, kastanje",
    "sand": "sandbeige, sand beige, sandfarvet, sandfarben, sand",
    "plum": "plommonlila, plum purple, plum, blommelilla, pflaume, plommon, blomme",
    "moss green": "mossgrön, moss green, mosgrøn, moosgrün, moss",
    "brick red": "tegelröd, brick red, teglrød, ziegelrot, brick, tegel",
    "mustard": "senapsgul, mustard yellow, mustard, sennepsgul, senfgelb, senap",
    "light grey": "ljusgrå, light grey, pale grey, light gray, pale gray, lysegrå, hellgrau, lt grey, lt gray, lt. grey, lt. gray",
    "navy": "marinblå, navy blue, dark navy, navy, marineblå, marineblau, mörkblå, marin, marine",
    "black": "kolsvart, svart, jet black, black, kulsort, sort, tiefschwarz, schwarz",
    "cream": "gräddvit, off-white cream, off white cream, off-white, off white, cream, flødehvid, cremeweiß, creme",
    "rose": "rosenrosa, rose pink, rosenrød, rosé, rosa, rose, pink",
}
_PLURALS = ("ern", "er", "en", "or", "ar", "es", "e", "n", "r", "s", "a")
_ACCENTS = str.maketrans("åäâàáãöøôòóõüûùúéèêëíìîïñçæ", "aaaaaaoooooouuuueeeeiiiinca")
_MEASURE = re.compile(r"(?<![\w*<>.,])(\d+(?:[.,]\d+)?)\s?(kg/m²|kg/m2|g/m²|g/m2|gsm|mm|cm|ml|cl|dl|m|l|liter|litres?|litre)(?![\w²/])", re.I)
_UNITS = {"kg/m²": ("w", 1000), "kg/m2": ("w", 1000), "g/m²": ("w", 1), "g/m2": ("w", 1), "gsm": ("w", 1), "mm": ("l", 1), "cm": ("l", 10), "m": ("l", 1000), "ml": ("v", 1), "cl": ("v", 10), "dl": ("v", 100), "l": ("v", 1000), "liter": ("v", 1000), "litre": ("v", 1000), "litres": ("v", 1000)}
_PIECE = re.compile(r"[^\W_]+(?:-[^\W_]+)*|[^\s\w-]")
_WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
SHORTEST_NUMBER = 4  # digits of an article number
_MAKER_NOISE = frozenset("ab aps as gmbh inc ltd sweden official brand varumarke by wear and och og und co".split())


def plain(text: str) -> str:
    """Lower case without accents, so that compounds and umlaut plurals compare."""
    if text.isascii():
        return text.lower()
    return text.lower().translate(_ACCENTS).replace("ß", "ss").replace("́", "").replace("̈", "").replace("̊", "")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """A word without its plural ending and doubled last letter."""
    word = plain(word)
    if word.endswith("ies"):
        return word[:-3] + "y"
    for _ in range(2):  # once is not enough where a stem ends like a plural
        for end in _PLURALS:
            if word.endswith(end) and len(word) - len(end) >= 3:
                word = word[: -len(end)]
                break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


_COLOUR = {plain(s.strip()): name for name, spellings in COLOURS.items() for s in spellings.split(",")}
_COLOUR_RE = re.compile(r"(?<![a-z])(" + "|".join(re.escape(s) for s in sorted(_COLOUR, key=len, reverse=True)) + r")(?![a-z])")


_LETTERS = re.compile(r"[^\W\d_]+")


class Attributes(NamedTuple):
    code: str | None
    model: str | None
    kind: int | None
    colour: str | None
    measure: str | None
    maker: str | None


class Parsed(NamedTuple):
    """A listing's attributes but for the model; ``prefix`` is the letters before the article number, ``begins`` how the maker's name begins, ``house`` two letters that stand for it however it is spelled, ``names`` its words, ``words`` what may name the model, in order of the title, then the body, ``joined`` neighbours in the title written as one."""

    code: str | None
    prefix: str
    kind: int | None
    colour: str | None
    measure: str | None
    maker: str | None
    begins: str
    house: str | None
    names: list[str]
    words: list[str]
    joined: list[str]


def article_number(skus: list[str | None] | None) -> tuple[str | None, str]:
    """The digits that all of a listing's article numbers share, whatever stands between them, and the letters before; null if they are too few."""
    parts = [re.findall(r"[^\W\d_]+|\d+", sku) for sku in skus or () if sku]
    if not parts:
        return None, ""
    first = next((i for i, g in enumerate(parts[0]) if g.isdigit()), len(parts[0]))
    digits = "".join(g for g in parts[0] if g.isdigit() and all(g in other for other in parts[1:]))
    return digits if len(digits) >= SHORTEST_NUMBER else None, plain("".join(parts[0][:first]))


class Parser:
    """Parses listings; ``kinds`` are the (id, name) pairs of the reference list's kinds of goods in all languages."""

    def __init__(self, kinds: list[tuple[int, str]]):
        self.single: dict[str, int] = {}
        self.phrases: dict[tuple[str, ...], int] = {}
        for i, name in kinds:
            stems = tuple(stem(w) for w in re.findall(r"[^\W\d_]+", name))
            if len(stems) == 1:
                self.single[stems[0]] = i
            elif stems:
                self.phrases[stems] = i
        self.heads: dict[str, tuple[int, int] | None] = {}
        #: Whether a word may name a model: it has letters and is no kind of goods.
        self.says = Recent(lambda w: len(w) > 1 and bool(_WORD.fullmatch(w)) and (s := stem(w)) not in self.single and not self._head(s), 400_000)
        self.longest = max(map(len, self.phrases), default=1)

    def kind(self, text: str) -> int | None:
        """The kind a text names: the longest phrase, else the word or compound with the longest known head."""
        words = [stem(w) for w in _LETTERS.findall(_COLOUR_RE.sub(" ", plain(text)))]
        for n in range(self.longest, 1, -1):
            for at in range(len(words) - n + 1):
                if (found := self.phrases.get(tuple(words[at : at + n]))) is not None:
                    return found
        for w in words:
            if w in self.single:
                return self.single[w]
        return max((h for w in words if (h := self._head(w))), default=(0, None))[1]

    def _head(self, word: str) -> tuple[int, int] | None:
        """Length and kind of the longest known head of a compound."""
        if word not in self.heads:
            if len(self.heads) > 200_000:
                self.heads.clear()
            self.heads[word] = next(((len(word) - cut, self.single[word[cut:]]) for cut in range(1, len(word) - 2) if word[cut:] in self.single), None)
        return self.heads[word]

    def _open(self, text: str, makers: set[str]) -> list[str]:
        """The words of a text, '' in place of those that are known to be something else: maker, kind, colour, measure."""
        found = _COLOUR_RE.sub(" | ", plain(_MEASURE.sub(" | ", text)))
        says, words = self.says, [w.replace("-", "") for w in _PIECE.findall(found)]
        return [w if says[w] and w not in makers else "" for w in words]

    def parse(self, title: str | None, vendor: str | None, body: str | None, skus: list[str | None] | None) -> Parsed:
        title = title or ""
        # the paragraph that describes the article is the first that names a colour
        about, colour = "", None
        for kind, text, _ in blocks(body):
            if kind == PARA and (m := _COLOUR_RE.search(plain(text))):
                about, colour = text, _COLOUR[m[1]]
                break
        if colour is None and (m := _COLOUR_RE.search(plain(title))):
            colour = _COLOUR[m[1]]
        kind = self.kind(title)
        if kind is None:
            kind = self.kind(about)
        makers = set(_LETTERS.findall(plain(vendor or "")))
        named = self._open(title, makers)
        joined = [a + b for a, b in zip(named, named[1:]) if a and b]
        words = list(dict.fromkeys(w for w in (*named, *self._open(about, makers)) if w))
        return Parsed(*article_number(skus), kind, colour, measure(title) or measure(about), maker(vendor), plain("".join(_LETTERS.findall(vendor or "")))[:8], house(vendor), sorted(makers), words, joined)


def measure(text: str) -> str | None:
    """The first weight of fabric, length or volume of a text, as class and whole canonical units."""
    m = _MEASURE.search(text)
    if not m:
        return None
    kind, factor = _UNITS[m[2].lower()]
    return f"{kind}{round(float(m[1].replace(',', '.')) * factor)}"


def maker(vendor: str | None) -> str | None:
    """A maker's letters in order of the alphabet, trade words left out: order, joints and case of words don't count."""
    text = plain(vendor or "")
    for pair, one in (("aa", "a"), ("ae", "a"), ("oe", "o")):
        text = text.replace(pair, one)
    words = [w for w in re.findall(r"[a-z]+", text) if w not in _MAKER_NOISE]
    return "".join(sorted("".join(words))) or None


def house(vendor: str | None) -> str | None:
    """The first two letters of the alphabetically first word of a maker's name: few misspellings and no order or joint of words change them."""
    words = [w for w in _LETTERS.findall(plain(vendor or "")) if w not in _MAKER_NOISE]
    return min(words)[:2] if words else None


def letters_apart(a: str, b: str) -> int:
    """Letters that one multiset has and the other lacks, the larger side."""
    i = j = left = right = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            left, i = left + 1, i + 1
        else:
            right, j = right + 1, j + 1
    return max(left + len(a) - i, right + len(b) - j)
