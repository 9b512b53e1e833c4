"""Evaluation texts leaking into training text.

The normalised word n-grams of the evaluation items, a hash set of fixed size,
go to every executor. One scan over each document's word windows finds hits;
each hit is verified by aligning the item's windows of ``span`` words with the
words around the hit. n is chosen so that no passage within the tolerance can
lack a hit. Documents that hold a passage are reported, dropped, or rid of the
passages.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import spread, written

SPAN, EDITS = 20, 3
BLOCK = 200_000  # items broadcast at once; more are more jobs, one after the other

_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|cite|code|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_WORD = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")
_LINK = re.compile(r"\]\([^()\s]*\)")
_UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
#: Letters that no decomposition takes apart.
_FOLD = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


@lru_cache(maxsize=100_000)
def _folded(word: str) -> str:
    plain = unicodedata.normalize("NFKD", word.casefold()).translate(_FOLD)
    return "".join(c for c in plain if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """Words of a text, without regard to case, accents, punctuation, white space and markup."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = unescape(text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFC", _UNSEEN.sub("", text))
    return [w.lower() if w.isascii() else _folded(w) for w in _WORD.findall(text)]


def gram_size(span: int, edits: int) -> int:
    """The longest run of words that every passage of ``span`` words with ``edits`` edits still shares with its item."""
    return max(1, -(-(span - edits) // (edits + 1)))


_PART = re.compile(rf"(?P<none>{_INLINE.pattern}|{_UNSEEN.pattern})|(?P<blank>{_TAG.pattern}|{_LINK.pattern})|(?P<ref>&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?)", re.I | re.S)


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """The words of a text as ``words`` gives them, each with where it begins and ends in the text as it stands."""
    plain, places, last = [], [], 0

    def say(piece: str, begin: int, end: int, each: bool) -> None:
        for i, c in enumerate(piece):
            plain.append(c)
            places.append((begin + i, begin + i + 1) if each else (begin, end))

    for m in _PART.finditer(text):
        say(text[last : m.start()], last, m.start(), True)
        last = m.end()
        if m["blank"] is not None:
            say(" ", m.start(), m.end(), False)
        elif m["ref"] is not None:
            say(_UNSEEN.sub("", unescape(m["ref"])), m.start(), m.end(), False)
    say(text[last:], last, len(text), True)
    joined = "".join(plain)
    return [(w.lower() if (w := m.group()).isascii() else _folded(w), places[m.start()][0], places[m.end() - 1][1]) for m in _WORD.finditer(joined)]


def matches(pattern: list[str], text: list[str], most: int) -> int | None:
    """Where the stretch of ``text`` nearest to ``pattern`` ends, the first of equally near ones, null if none is within ``most`` word edits (bit-parallel approximate matching)."""
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for end, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most:
            best, most = end, score - 1
    return best


class Scanner:
    """Finds the items of which a text holds ``span`` consecutive words, up to ``edits`` changed, dropped or added.

    An n-gram is 64 bits, a polynomial of its words' numbers; what two n-grams
    share by chance the verification finds out. Hashes lie in one sorted array,
    beside them the item and the place of each.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[str | None], span: int = SPAN, edits: int = EDITS):
        self.span, self.edits, self.n = span, edits, gram_size(span, edits)
        self.items = {i: w for i, t in enumerate(items) if len(w := words(t)) >= span}
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        ids = [np.fromiter((number(x, len(self.vocabulary)) for x in w), np.int64, len(w)) for w in self.items.values()]
        grams = [self._grams(i) for i in ids]
        hashes = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.fromiter(self.items, np.int32, len(ids)), [len(g) for g in grams]) if ids else np.empty(0, np.int32)
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.empty(0, np.int32)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        size, out = len(ids) - self.n + 1, None
        for k in range(self.n):
            part = ids[k : k + size].astype(np.uint64) + np.uint64(1)
            out = part if out is None else out * self.BASE + part
        return out

    def hits(self, texts: list[list[str]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By (text, item), the (place in the text, place in the item) of each shared n-gram, for all texts at once."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        known, total = self.vocabulary.get, int(lengths.sum())
        ids = np.fromiter((known(w, -1) for t in texts for w in t), np.int64, total)
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if total < self.n or not len(self.hashes):
            return found
        ends = np.cumsum(lengths)
        # a window with a word that no item has can't be in the set, nor one over the end of a text
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        starts = np.flatnonzero(unknown[self.n :] == unknown[: -self.n])
        owner = np.searchsorted(ends, starts, "right")
        inside = starts + self.n <= ends[owner]
        starts, owner = starts[inside], owner[inside]
        grams = self._grams(ids)[starts]
        low, high = np.searchsorted(self.hashes, grams, "left"), np.searchsorted(self.hashes, grams, "right")
        for at in np.flatnonzero(high > low):
            text = int(owner[at])
            begin = int(starts[at] - ends[text] + lengths[text])
            for k in range(low[at], high[at]):
                found.setdefault((text, int(self.item[k])), []).append((begin, int(self.place[k])))
        return found

    def leaked(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(text, item) of each passage, by their positions, in order."""
        tokens = [words(t) for t in texts]
        return sorted((t, i) for (t, i), places in self.hits(tokens).items() if next(self._passages(tokens[t], self.items[i], places), None))

    def passages(self, text: str | None) -> list[tuple[int, int]]:
        """Where passages of any item stand in a text: (begin, end) in characters, overlapping ones joined."""
        placed = placed_words(text or "")
        tokens = [w for w, _, _ in placed]
        found = sorted(p for (_, i), places in self.hits([tokens]).items() for p in self._passages(tokens, self.items[i], places))
        out: list[tuple[int, int]] = []
        for begin, end in found:
            first, last = placed[begin][1], placed[end - 1][2]
            if out and first <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return out

    def without(self, text: str) -> str:
        """``text`` without its passages, a line break in place of each."""
        out, last = [], 0
        for begin, end in self.passages(text):
            out += [text[last:begin], "\n"]
            last = end
        return "".join((*out, text[last:]))

    def _passages(self, tokens: list[str], item: list[str], places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """(begin, end), in words, of what matches a window of the item around a hit."""
        tried: set[tuple[int, int]] = set()
        reach = self.span + self.edits - self.n
        for at, place in places:
            near = set(tokens[max(0, at - reach) : at + self.n + reach])
            first, beyond = max(0, place + self.n - self.span), min(place, len(item) - self.span) + 1
            there = [w in near for w in item[first : beyond + self.span]]
            for start in range(first, beyond):
                # a window that lacks more words than may be changed can't match
                if sum(there[start - first : start - first + self.span]) < self.span - self.edits:
                    continue
                begin = at - (place - start)
                # hits on one diagonal ask for the same comparison
                if (start, begin) in tried:
                    continue
                tried.add((start, begin))
                low, high = max(0, begin - self.edits), begin + self.span + self.edits
                window = item[start : start + self.span]
                if (end := matches(window, tokens[low:high], self.edits)) is not None:
                    back = matches(window[::-1], tokens[low : low + end][::-1], self.edits)
                    yield low + end - (back or end), low + end


_MADE: dict[object, Scanner] = {}


def _scanner(sent, span: int, edits: int) -> Scanner:
    """The scanner of a broadcast block of items, made once in a worker, which keeps the last."""
    name = (sent.value[0], span, edits)
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Scanner(sent.value[1].column(1).to_pylist(), span, edits)
    return _MADE[name]


def _blocks(items: DataFrame, item_key: str, item_text: str, block: int) -> Iterator[tuple[object, bool]]:
    """Broadcast blocks of about ``block`` items, each (name, Arrow table of key and text), and whether there is but one; the last block is freed before the next comes."""
    spark = items.sparkSession
    held = items.select(item_key, item_text)
    parts = max(1, -(-held.count() // block))
    for b in range(parts):
        part = held if parts == 1 else held.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(parts)) == b)
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, part.toArrow()))
        yield sent, parts == 1
        if parts > 1:
            with suppress(Exception):  # to free memory, no more
                sent.destroy()


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, span: int = SPAN, edits: int = EDITS, block: int = BLOCK) -> DataFrame:
    """(key, item_key) of each document and item it holds a passage of, distinct.

    Null, empty and short texts have none; an item shorter than ``span`` words
    can't leak. A document that holds several items has a row for each. Items
    are collected and broadcast ``block`` at a time; with more than one block
    each is a scan of its own, written before the next begins.
    """
    kind, item_kind = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    given = spread(documents.where(F.length(text) > 0).select(F.col(key), F.col(text)), key)
    out = None
    for sent, only in _blocks(items, item_key, item_text, block):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanner, names = _scanner(sent, span, edits), sent.value[1].column(0).combine_chunks()
            for batch in batches:
                found = scanner.leaked(batch.column(1).to_pylist())
                rows, which = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), names.take(which)], names=["_k", "_i"])

        one = given.mapInArrow(run, f"_k {kind}, _i {item_kind}")
        one = one if only else written(one.distinct(), "leaks")
        out = one if out is None else out.unionByName(one)
    return out.distinct().select(F.col("_k").alias(key), F.col("_i").alias(item_key))


def without_leaks(documents: DataFrame, text: str, items: DataFrame, item_text: str, drop: bool = False, span: int = SPAN, edits: int = EDITS, block: int = BLOCK) -> DataFrame:
    """``documents``, all columns, with the passages of ``items`` cut out of ``text``, or, with ``drop``, without the documents that hold any.

    One scan and no shuffle: rows are changed where they are. Rows without a
    passage, null and empty texts among them, stay as they are; repeated rows
    are treated alike. A cut leaves a line break, so that no new passage can
    join over it.
    """
    out, at = documents, documents.columns.index(text)
    for sent, only in _blocks(items, item_text, item_text, block):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(sent, span, edits)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                held = {t for t, _ in scanner.leaked(texts)}
                if drop:
                    yield batch.filter(pa.array([i not in held for i in range(len(texts))], pa.bool_()))
                else:
                    cut = pa.array([scanner.without(t) if i in held else t for i, t in enumerate(texts)], batch.schema.field(at).type)
                    yield batch.set_column(at, batch.schema.field(at), cut)

        out = out.mapInArrow(run, documents.schema)
        out = out if only else written(out, "clean")
    return out


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_item.parquet")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the item."""
    documents, items = _tables(spark, sf_dir)
    return leaks(documents, "doc_id", "text", items, "item_id", "text")


def p9_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its text without the passages of evaluation items."""
    documents, items = _tables(spark, sf_dir)
    return without_leaks(documents.select("doc_id", "text"), "text", items, "text")
