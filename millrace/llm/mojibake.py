"""Garbled text from a wrong character encoding, restored by minimum description length.

Every candidate decoding of a text is compressed, sentence by sentence, with
the Zstandard dictionary of its language, made of what all texts hold most; the
chain of re-decodings whose description is shortest, the chain's own cost
included, is taken, and the text stays unchanged where none is shorter. What a
text may hold is not listed anywhere: the dictionaries know it.

Before compression a text is written in a code of script windows, so that a
letter costs a byte in any script and a change of script costs some more.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import spread, written

#: Single-byte encodings that UTF-8 bytes may have been read as, and those that Windows text may have been read as.
CODECS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1257", "iso8859_15")
SINGLE = ("cp850", "cp437", "mac_roman", "iso8859_1", "cp1251", "cp1250")
LANGUAGES = ("sv", "en", "da", "de")
LOST = "\ufffd"
DICTIONARY = 300_000  # bytes of a language's dictionary
SEGMENT = 64  # characters of a word that is counted whole
LINE = 500  # bytes of a line to train on, at least

_ENTITIES = re.compile(r"(?:&#(?:[0-9]{2,5}|[xX][0-9a-fA-F]{2,4});){2,}")
_ENTITY = re.compile(r"&#(?:([0-9]+)|[xX]([0-9a-fA-F]+));")
_BEYOND = re.compile("[^\x00-\x7f]")
_PAIR = re.compile("[^\x00-\x7f]{2}")
_WORDS = re.compile(rf"\S{{1,{SEGMENT}}}")
_SENTENCE_END = re.compile(r"[.!?;:]+\s+|\n\s*")
#: What is left of a sequence whose last byte had no character: the text can't be had.
_BROKEN = re.compile("(?:â€|Ã¢â‚¬|вЂ|ΓÇ|‚Ä)(?=[?\\s\\w]|$)|Ã\\?")


def _tables() -> dict[str, dict[str, int]]:
    """Byte of each character by encoding."""
    out = {}
    for codec in dict.fromkeys(CODECS + SINGLE):
        table = {}
        for b in range(128, 256):
            try:
                table[bytes([b]).decode(codec)] = b
            except UnicodeDecodeError:
                continue
        if codec in ("cp1252", "iso8859_1"):  # these two differ in controls only, and the controls are read as either
            for b in range(128, 160):
                table.setdefault(chr(b), b)
        out[codec] = table
    return out


TABLES = _tables()
#: Each character of another encoding as Windows 1252 has its byte, where that differs.
AS_WINDOWS = [{c: w for c, b in TABLES[codec].items() if (w := bytes([b]).decode("cp1252", "replace")) not in (c, LOST)} for codec in SINGLE]


def _sequences(table: dict[str, int]) -> re.Pattern:
    """What UTF-8 sequences look like when their bytes are read by ``table``."""
    def of(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    more = of(0x80, 0xBF)
    return re.compile(f"{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}}")


_SEQUENCES = {codec: _sequences(TABLES[codec]) for codec in CODECS}


def undo_utf8(text: str, codec: str) -> str:
    """``text`` with each sequence that is UTF-8 read as ``codec`` decoded; other characters stay."""
    table = TABLES[codec]

    def fix(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _SEQUENCES[codec].sub(fix, text)


def undo_entities(text: str) -> str:
    """``text`` with runs of numeric references that spell UTF-8 read as Windows 1252 decoded; other references stay."""

    def fix(m: re.Match) -> str:
        chars = "".join(chr(int(d) if d else int(x, 16)) for d, x in _ENTITY.findall(m.group()))
        if any(c not in TABLES["cp1252"] for c in chars):
            return m.group()
        try:
            return bytes(TABLES["cp1252"][c] for c in chars).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _ENTITIES.sub(fix, text) if "&#" in text else text


def windows(text: str) -> bytes:
    """``text`` in a code of script windows: ASCII and Latin-1 as they are, other characters a byte within the window of 128 that a shift before them names.

    Punctuation, currency and letter-like signs take a shift each; a shift to
    any other window holds until the next. This is only ever compressed.
    """
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    out, last, window = [], 0, 1
    for m in _BEYOND.finditer(text):
        at, code = m.start(), ord(m.group())
        out.append(text[last:at].encode())
        last, own = at + 1, code >> 7
        if own != window:
            if 0x40 <= own <= 0x43:
                out.append(bytes((own - 0x30,)))
            else:
                out.append(bytes((0x0E, own)) if own < 256 else bytes((0x18 + (own >> 8 & 7),)))
                window = own
        out.append(bytes((code & 0x7F | 0x80,)))
    out.append(text[last:].encode())
    return b"".join(out)


def sentences(text: str) -> list[str]:
    """``text`` cut after the ends of sentences and lines; joined they are the text again."""
    cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(text))]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]) if a < b]


class Model(NamedTuple):
    """A language: its trained Zstandard dictionary and the characters beyond ASCII of the texts it was trained on."""

    dictionary: bytes
    characters: frozenset[str]


class Restorer:
    """Chooses the chain by the ``models`` of the languages.

    A step that undoes UTF-8 costs ``step`` bytes, as only well-formed sequences
    offer one; one that takes the whole text, or some sentences, for Windows 1252
    read as another single-byte encoding costs ``single``, as any text offers it,
    and each sentence re-decoded apart from the rest ``sentence``. To spare
    work a single-byte step isn't compressed for a sentence in which it raises
    the number of characters that the model's texts don't have; each of these
    counts as a byte more. With ``SPARE`` off all are compressed.
    """

    SPARE = True

    def __init__(self, models: dict[str, Model], level: int = 16, step: float = 0.5, single: float = 4.0, sentence: float = 2.0):
        self.step, self.single, self.sentence = step, single, sentence
        self.compress, self.written = {}, {lang: model.characters for lang, model in models.items()}
        for lang, model in models.items():
            made = zstandard.ZstdCompressionDict(model.dictionary)
            made.precompute_compress(level=level)
            self.compress[lang] = zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.compress = self.compress or {"": zstandard.ZstdCompressor(level=level).compress}

    def restore(self, text: str, lang: str | None) -> tuple[str, int]:
        """The text of minimum description length and the number of steps to it, 0 if unchanged.

        All chains of UTF-8 steps are searched of which each shortens the
        description, as undoing a misreading does; so they end. Single-byte steps are taken where none of these is left or the text
        is best without it, and carried on where they give the shortest
        description so far.
        """
        if text.isascii() and "&#" not in text:
            return text, 0
        code = (lang or "").strip().lower()[:2]
        if code in self.compress:
            return self._restored(text, code)[1:]
        # of an unknown language: that of the shortest description
        tried = (self._restored(text, c, True) for c in sorted(self.compress))
        return min(tried, key=lambda r: r[0])[1:]

    def _restored(self, text: str, code: str, absolute: bool = False) -> tuple[float, str, int]:
        """The least description length, against that of the text as given or ``absolute``, the text that has it, and its number of steps."""
        compress, known = self.compress[code], {}

        def length(sentence: str) -> int:
            found = known.get(sentence)
            if found is None:
                found = known[sentence] = len(compress(windows(sentence)))
            return found

        whole = sum(map(length, sentences(text))) if absolute else None  # the length of the text as given, once it is asked for
        best, seen, front, steps = (0.0, 0, text), {text}, [(0, 0.0, text)], 0
        while front:
            steps, found = steps + 1, []
            for gained, cost, held in front:
                options = [undo_utf8(held, c) for c in CODECS] if _PAIR.search(held) else []
                options.append(undo_entities(held))
                for new in options:
                    if new not in seen:
                        seen.add(new)
                        whole = sum(map(length, sentences(text))) if whole is None else whole
                        change = sum(map(length, sentences(new))) - whole
                        if change < gained:
                            found.append((change, cost + self.step, new))
                        best = min(best, (change + cost + self.step, steps, new), key=lambda b: b[0])
                # a single-byte step before one that undoes UTF-8 is the latter by another encoding, so it waits until that is done or doesn't pay
                if held != best[2] and any(new != held for new in options):
                    continue
                for change, extra, new in self._singles(held, length, self.written.get(code, frozenset())):
                    if gained + change + cost + extra < best[0] and (new := "".join(new)) not in seen:
                        seen.add(new)
                        found.append((gained + change, cost + extra, new))
                        best = (gained + change + cost + extra, steps, new)
            front = found
        return best[0] + (whole if absolute else 0), best[2], best[1]

    def _singles(self, held: str, length, written: frozenset[str]) -> Iterator[tuple[int, float, list[str]]]:
        """(change of length, cost, sentences) of ``held`` re-decoded from each single-byte encoding, whole and in those sentences that get shorter by it."""
        beyond = [c for c in set(held) if c > "\x7f"]
        parts, tried = None, set()
        for table in AS_WINDOWS:
            pairs = frozenset((c, table[c]) for c in beyond if c in table)
            if not pairs or pairs in tried:
                continue
            tried.add(pairs)
            odder = {c: (w not in written) - (c not in written) for c, w in pairs} if self.SPARE else {}
            if odder and min(odder.values()) > 0:
                continue
            parts = parts or [(s, s.isascii()) for s in sentences(held)]
            chained = {c for c, _ in pairs}.isdisjoint(w for _, w in pairs)  # one after the other is as all at once
            all_, some, change, saved, n = [], [], 0, 0, 0
            for old, plain in parts:
                new = old
                if not plain and chained:
                    for c, w in pairs:
                        new = new.replace(c, w)
                elif not plain:
                    new = "".join(table.get(c, c) for c in old)
                all_.append(new)
                odd = sum(n * old.count(c) for c, n in odder.items() if n) if new != old else 0
                one = length(new) - length(old) if new != old and odd <= 0 else odd  # an unknown character costs a byte at least
                change += one
                if one + self.sentence < 0:
                    some.append(new)
                    saved, n = saved + one, n + 1
                else:
                    some.append(old)
            yield change, self.single, all_
            yield saved, self.single + self.sentence * n, some


def _candidates(text: str) -> bool:
    return undo_entities(text) != text or not text.isascii() and bool(_PAIR.search(text)) and any(undo_utf8(text, c) != text for c in CODECS)


def _dictionary(samples: list[bytes], size: int, level: int) -> bytes | None:
    """A Zstandard dictionary with entropy tables of at most ``size`` bytes; null if the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8, level=level).as_bytes()
    except zstandard.ZstdError:
        return None


def trained(texts: list[str], size: int = 300_000, rare: float = 0.01, level: int = 16) -> Model | None:
    """A model whose dictionary is one with entropy tables, of at most ``size`` bytes, from the undamaged ones of ``texts``; null if they are too few to train on.

    Left out are texts that hold a sequence some re-decoding would change, and
    those with a character that under ``rare`` of the others have.
    """
    texts = [t for t in texts if LOST not in t and not _candidates(t)]
    held = Counter(c for t in texts for c in set(t))
    odd = {c for c, n in held.items() if n < rare * len(texts)}
    made = _dictionary([windows(t + "\n") for t in texts if odd.isdisjoint(t)], size, level)
    return made and Model(made, frozenset(c for c in held if c > "\x7f") - odd)


def counted(documents: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """(lang, kind, said, n): how often each segment ('segment'), and in how many texts each character beyond ASCII ('character'), is found in all undamaged texts of LANGUAGES; 'texts' has their number.

    Segments are the words, and each word with a character beyond ASCII with
    its neighbour on either side and between both. Words longer than SEGMENT
    characters are cut into pieces of it. Damaged is what holds a sequence that some re-decoding would change.
    """
    code = F.substring(F.lower(F.trim(lang)), 1, 2)
    given = spread(documents.where(code.isin(*LANGUAGES) & F.col(text).isNotNull()).select(key, code.alias("_l"), F.col(text).alias("_t")), key, 1).select("_l", "_t")

    def count(held: dict[tuple[str, str], Counter], code: str, text: str) -> None:
        words = text.split()
        if words and max(map(len, words)) > SEGMENT:
            words = _WORDS.findall(text)
        held[code, "segment"].update(words)
        if not text.isascii():
            beyond = [not w.isascii() for w in words]
            near = [f"{a} {b}" for a, b, x, y in zip(words, words[1:], beyond, beyond[1:]) if x or y]
            near += [f"{a} {b} {c}" for a, b, c, x in zip(words, words[1:], words[2:], beyond[1:]) if x]
            held[code, "segment"].update(near)
            held[code, "character"].update([c for c in set(text) if c > "\x7f"])
        held[code, "texts"][""] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for (code, kind), counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(code, len(counts)), pa.repeat(kind, len(counts)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "kind", "said", "n"])
            held.clear()

        for batch in batches:
            for code, one in zip(*(c.to_pylist() for c in batch.columns)):
                if LOST not in one and not _candidates(one):
                    count(held, code, one)
                    if sum(map(len, held.values())) > 300_000:  # what a worker holds doesn't grow with its rows
                        yield from told()
        yield from told()

    return given.mapInArrow(run, "lang string, kind string, said string, n long").groupBy("lang", "kind", "said").agg(F.sum("n").alias("n"))


def _material(segments: list[tuple[str, int]], samples: int, size: int) -> list[bytes]:
    """At most ``samples`` lines, of LINE bytes or more and ``size`` bytes together, in which segments come as often, in proportion, as counted, each once at least; the first ones, up to half of ``size``, if not all fit."""
    taken, room = [], size // 2
    for said, n in segments:
        data = windows(said + " ")
        if len(data) > room:
            break
        taken.append((data, n))
        room -= len(data)
    share = min(1.0, size / 2 / max(1, sum(len(data) * n for data, n in taken)))
    times = [(data, max(1, int(n * share))) for data, n in taken]
    lines = [bytearray() for _ in range(min(samples, sum(len(data) * n for data, n in times) // LINE))]
    at = 0
    for data, n in times if lines else ():
        for _ in range(n):
            lines[at % len(lines)] += data
            at += 1
    return [bytes(line) for line in lines]


def language_models(documents: DataFrame, text: str, lang: str, order: str, samples: int = 1000, size: int = 4_000_000, rare: float = 0.01) -> dict[str, Model]:
    """Models of LANGUAGES, from counts of all their undamaged texts (``counted``).

    A dictionary holds DICTIONARY bytes, so it is trained on those segments of
    which all texts have the most, in bytes, in proportion to their counts:
    ``samples`` lines of twice that size, and of ``size`` bytes, at most. The
    characters of a model are those that ``rare`` of all texts have, and
    segments with others are left out. ``order`` is a key that spreads the rows.
    """
    counts = written(counted(documents, text, lang, order), "counts", "lang")
    told = counts.where(F.col("kind") != "segment").collect()  # no more rows than there are characters
    texts = {r["lang"]: r["n"] for r in told if r["kind"] == "texts"}
    known = {code: frozenset(r["said"] for r in told if r["lang"] == code and r["kind"] == "character" and r["n"] >= rare * n) for code, n in texts.items()}

    def most(code: str) -> DataFrame:
        own = counts.where((F.col("kind") == "segment") & (F.col("lang") == code))
        return own.where(F.translate("said", "".join(sorted(known[code])), "").rlike(r"^[\x00-\x7f]*$")).orderBy((F.col("n") * F.length("said")).desc(), "said").limit(DICTIONARY // 4)

    out, room = {}, min(size, 2 * DICTIONARY)
    for code in sorted(texts):
        if made := _dictionary(_material([(r["said"], r["n"]) for r in most(code).select("said", "n").collect()], samples, room), DICTIONARY, 16):
            out[code] = Model(made, known[code])
    return out


_MADE: dict[int, Restorer] = {}


def _restorer(models: dict[str, Model]) -> Restorer:
    """The restorer of some models, made once in a worker, which keeps the last."""
    name = hash(frozenset(models.items()))
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Restorer(models)
    return _MADE[name]


def restored(documents: DataFrame, key: str, text: str, lang: str, models: dict[str, Model]) -> DataFrame:
    """The damaged rows of ``documents``: (key, restored STRING, steps INT, lost BOOLEAN).

    ``restored`` is null and ``lost`` true where characters are gone (the
    replacement character, or a sequence without its last byte). Null, empty
    and undamaged texts give no row. Texts go whole; repeated rows come as
    often as they are there.
    """
    names = [key, text, lang]
    given = spread(documents.select(*(F.col(c) for c in names)).where(F.col(text).rlike(r"[^\x00-\x7f]|&#")), key)
    kind = dict(documents.dtypes)[key]
    sent = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(sent.value)
        for batch in batches:
            keep, texts, steps, lost = [], [], [], []
            for i, (t, code) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if LOST in t:
                    new, n, gone = None, 0, True
                else:
                    new, n = restorer.restore(t, code)
                    gone = bool(_BROKEN.search(new))
                    if not n and not gone:
                        continue
                keep.append(i)
                texts.append(None if gone else new)
                steps.append(n)
                lost.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(texts, pa.string()), pa.array(steps, pa.int32()), pa.array(lost, pa.bool_())], names=[key, "restored", "steps", "lost"])

    return given.mapInArrow(run, f"`{key}` {kind}, restored string, steps int, lost boolean")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged documents and the hash of each original text, '' where it is lost."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = language_models(documents, "text", "lang", "doc_id")
    found = restored(documents, "doc_id", "text", "lang", models)
    return found.select("doc_id", F.coalesce(F.sha2("restored", 256), F.lit("")).alias("restored_sha256")).distinct()
