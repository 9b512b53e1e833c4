"""Markup residue in texts: HTML, Markdown, wiki and LaTeX bodies as clean blocks.

A body is cut into headings, list items, paragraphs, code and formulas. Two
passes of block rules then label them: length, stop-word density and link
density decide a block where they can; ambiguous short blocks inherit the label
of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import spread

HEADING, ITEM, PARA, CODE, FORMULA = "heading", "item", "para", "code", "formula"

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = frozenset(
    "och i att det som en på är av för med till den har de inte om ett från vid du vi så men kan hela när ta "
    "the of and to in a is that it for on with as by from at you we our this not are be or if who like "
    "og er til af på der med den det et ikke fra ved du vi som kan hele dig "
    "der die das und ist in von zu den mit für auf ein eine im am nicht aus bei wer wie dem des wir sie".split()
)

_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_SPACE = re.compile(r"[\s\u00a0\u200b\ufeff]+")
_BLOCK = "address|article|aside|blockquote|body|caption|center|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"
_ANY_BLOCK = re.compile(rf"</?(?:{_BLOCK}|br|img|span|script|style)(?:\s[^<>]*)?/?>", re.I)
_ESCAPED = re.compile(rf"&lt;/?(?:{_BLOCK})(?:\s|/?&gt;)", re.I)
_TOKEN = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))|(?P<raw><(?P<rname>script|style|math|syntaxhighlight|source|nowiki|template|noscript)\b(?P<rattr>[^<>]*)>(?P<rbody>.*?)(?:</(?P=rname)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attr>(?:\s(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)?)/?>|(?P<decl><[!?][^<>]*>)",
    re.S | re.I,
)
_KIND = {f"h{n}": HEADING for n in range(1, 7)} | {"li": ITEM, "dt": ITEM, "dd": ITEM, "pre": CODE}
_BLOCK_NAME = re.compile(rf"(?:{_BLOCK})\Z", re.I)
_WHOLE_FORMULA = re.compile(r"\s*(?:\\\((?P<a>.+)\\\)|\\\[(?P<b>.+)\\\]|\$\$(?P<c>.+)\$\$)\s*\Z", re.S)

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*\Z")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*\Z")
_RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_BULLET = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)\Z")
_WIKI_HEAD = re.compile(r"(={1,6})\s*(.+?)\s*\1\s*\Z")
_WIKI_ITEM = re.compile(r"[*#:;]+\s*(.*)\Z")
_WIKI = re.compile(r"^={2,6}[^=\n].*?={2,6}[ \t]*$|'''?[^'\n]+'''?|\[\[[^\[\]\n]+\]\]|\[https?://\S+ [^\]\n]+\]|<math>|<syntaxhighlight|<source\b|^#[ \t]+[^\n]*\n#[ \t]", re.M)
_TEX = re.compile(r"\\(?:(?:sub)*section|paragraph|chapter|begin|item|textbf|textit|emph|href|underline|texttt)\b")
_MD_IMAGE, _MD_LINK, _MD_REF = re.compile(r"!\[[^\]\n]*\](?:\([^()\n]*\)|\[[^\]\n]*\])"), re.compile(r"\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)"), re.compile(r"^\s*\[[^\]\n]+\]:\s*\S+.*$", re.M)
_MD_EMPHASIS = [re.compile(p) for p in (r"(?<![\w*\\])\*\*(?=\S)(.+?)(?<=[^\s\\])\*\*(?![\w*])", r"(?<![\w_\\])__(?=\S)(.+?)(?<=[^\s\\])__(?![\w_])", r"(?<![\w*\\])\*(?=[^\s*])(.+?)(?<=[^\s*\\])\*(?![\w*])", r"(?<![\w_\\])_(?=[^\s_])(.+?)(?<=[^\s_\\])_(?![\w_])", r"~~(?=\S)(.+?)(?<=\S)~~")]
_MD_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_WIKI_FILE, _WIKI_LINK, _WIKI_URL = re.compile(r"\[\[(?:Fil|File|Image|Bild|Datei|Billede|Kategori|Category|Kategorie):[^\[\]]*\]\]", re.I), re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), re.compile(r"\[(?:https?:)?//\S+?(?:\s+([^\]]*))?\]")
_TEX_ENV = re.compile(r"\\begin\{(?P<n>equation|displaymath|math|align|gather|multline|eqnarray|verbatim|lstlisting|minted|Verbatim|alltt)(?P<s>\*?)\}(?P<o>(?:\[[^\]]*\])?(?:\{[^{}]*\})?)(?P<b>.*?)\\end\{(?P=n)(?P=s)\}|\\\[(?P<d>.*?)\\\]|\$\$(?P<e>.*?)\$\$", re.S)
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_BREAK = re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]]*\])?|\\(?:par|maketitle|bigskip|medskip|smallskip|newpage)\b")
_TEX_LINK, _TEX_DROP = re.compile(r"\\href\{[^{}]*\}\{((?:[^{}]|\{[^{}]*\})*)\}"), re.compile(r"\\(?:includegraphics|label|url|index|cite|ref)\*?(?:\[[^\]]*\])?\{[^{}]*\}|(?m:^%.*$)|(?<=\s)%.*$")
_TEX_WRAP = re.compile(r"\\(?:textbf|textit|emph|underline|texttt|textsc|textrm|textsf|text|mbox|footnote)\{([^{}]*)\}")


def unescape(text: str) -> str:
    """References with their semicolon decoded; a bare ampersand stays."""
    return _ENTITY.sub(lambda m: html.unescape(m.group()), text) if "&" in text else text


class _Blocks:
    """Collects blocks: [kind, text, characters of links]."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str, int]] = []

    def add(self, kind: str, text: str, linked: int = 0) -> None:
        if kind != CODE and (m := _WHOLE_FORMULA.match(text)):
            kind, text = FORMULA, m["a"] or m["b"] or m["c"]
        text = _SPACE.sub(" ", text).strip()
        if text:
            self.found.append((kind, text, linked))


def _markdown_inline(text: str) -> tuple[str, int]:
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    linked = 0
    if "`" in text:
        text = _MD_CODE.sub(lambda m: keep(m[2].strip()), text)
    if "[" in text:
        text = _MD_IMAGE.sub("", text)
        linked = sum(len(m[1]) for m in _MD_LINK.finditer(text))
        text = _MD_LINK.sub(r"\1", text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: keep(m[1]), text)
    if "*" in text or "_" in text or "~" in text:
        for pattern in _MD_EMPHASIS:
            text = pattern.sub(r"\1", text)
    text = unescape(text)
    while kept and "\x00" in text:
        text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)
        break
    return text, linked


def _markdown(text: str, out: _Blocks) -> None:
    lines, at = _MD_REF.sub("", text).split("\n"), 0
    pending: list[str] = []
    kind = PARA

    def flush() -> None:
        nonlocal kind
        if pending:
            out.add(kind, *_markdown_inline("\n".join(pending)))
        pending.clear()
        kind = PARA

    while at < len(lines):
        line = lines[at]
        at += 1
        bare = line.strip()
        if not bare:
            flush()
        elif m := _FENCE.match(line):
            flush()
            end = at
            while end < len(lines) and not (lines[end].strip().startswith(m[1]) and not lines[end].strip().strip(m[1][0])):
                end += 1
            out.add(CODE, "\n".join(lines[at:end]))
            at = end + 1
        elif bare.startswith(("$$", "\\[")) and kind == PARA and not pending:
            close = "$$" if bare.startswith("$$") else "\\]"
            body, end = [bare[2:]], at
            while close not in body[-1] and end < len(lines):
                body.append(lines[end])
                end += 1
            inside, found, after = "\n".join(body).partition(close)
            if found and not after.strip():
                out.add(FORMULA, inside)
                at = end
            else:
                pending.append(bare)
        elif pending and kind == PARA and _SETEXT.match(line) and (len(bare) > 1 or bare == "="):
            kind = HEADING
            flush()
        elif _RULE.match(line):
            flush()
        elif m := _ATX.match(line):
            flush()
            out.add(HEADING, *_markdown_inline(m[2]))
        elif m := _BULLET.match(line):
            flush()
            kind = ITEM
            pending.append(m[1])
        else:
            pending.append(re.sub(r"^(?:> ?)+", "", bare) if bare.startswith(">") else bare)
    flush()


def _wiki_inline(text: str) -> tuple[str, int]:
    text = re.sub(r"<ref\b[^<>]*(?:/>|>.*?</ref>)", "", text, flags=re.S)
    text = re.sub(r"\{\{[^{}]*\}\}", "", text) if "{{" in text else text
    text = _WIKI_FILE.sub("", text)
    linked = sum(len(m[1] or "") for p in (_WIKI_LINK, _WIKI_URL) for m in p.finditer(text))
    text = _WIKI_URL.sub(lambda m: m[1] or "", _WIKI_LINK.sub(r"\1", text))
    text = re.sub(r"'{2,5}", "", text)
    return unescape(re.sub(r"</?[A-Za-z][^<>]*>", " ", text)), linked


def _wiki(text: str, out: _Blocks) -> None:
    pending: list[str] = []

    def flush() -> None:
        if pending:
            out.add(PARA, *_wiki_inline("\n".join(pending)))
        pending.clear()

    for line in text.split("\n"):
        if not line.strip() or re.match(r"-{4,}\s*\Z", line):
            flush()
        elif m := _WIKI_HEAD.match(line.strip()):
            flush()
            out.add(HEADING, *_wiki_inline(m[2]))
        elif m := _WIKI_ITEM.match(line):
            flush()
            out.add(ITEM, *_wiki_inline(m[1]))
        else:
            pending.append(line)
    flush()


def _tex_inline(text: str) -> tuple[str, int]:
    linked = sum(len(m[1]) for m in _TEX_LINK.finditer(text))
    text = _TEX_DROP.sub("", _TEX_LINK.sub(r"\1", text))
    while (new := _TEX_WRAP.sub(r"\1", text)) != text:
        text = new
    text = text.replace("\\\\", " ").replace("~", " ").replace("``", "“").replace("''", "”")
    text = re.sub(r"\\([&%$#_{}])", r"\1", re.sub(r"(?<!\\)[{}]", "", text))
    return unescape(_ESCAPE.sub(r"\1", re.sub(r"\\(?:ldots|dots)\b", "…", text))), linked


def _tex_prose(text: str, out: _Blocks) -> None:
    last = 0
    for m in [*_TEX_HEAD.finditer(text), None]:
        for part in re.split(r"\n[ \t]*\n", text[last : m.start() if m else len(text)]):
            for i, piece in enumerate(re.split(r"\\item\b(?:\s*\[[^\]]*\])?", part)):
                # what precedes the first item is a paragraph, and so is what follows the list's end
                for j, chunk in enumerate(_TEX_BREAK.split(piece)):
                    out.add(ITEM if i and not j else PARA, *_tex_inline(chunk))
        if m:
            out.add(HEADING, *_tex_inline(m[1]))
            last = m.end()


def _tex(text: str, out: _Blocks) -> None:
    last = 0
    for m in _TEX_ENV.finditer(text):
        _tex_prose(text[last : m.start()], out)
        if (m["n"] or "").lower() in ("verbatim", "lstlisting", "minted", "alltt"):
            out.add(CODE, m["b"])
        else:
            out.add(FORMULA, next(g for g in (m["b"], m["d"], m["e"]) if g is not None))
        last = m.end()
    _tex_prose(text[last:], out)


def _loose(text: str, out: _Blocks) -> None:
    """Text outside any block element: LaTeX, wiki or Markdown, of which plain paragraphs are a part."""
    if not text.strip():
        return
    if _TEX.search(text):
        _tex(text, out)
    elif _WIKI.search(text):
        _wiki(text, out)
    else:
        _markdown(text, out)


def _tags(text: str, out: _Blocks) -> None:
    """HTML, and whatever stands between its block elements."""
    open_: list[str] = []  # kinds of the open block elements, with their names
    names: list[str] = []
    parts: list[str] = []
    linked, in_link, last = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = "".join(parts)
            if open_:
                out.add(next((k for k in (CODE, HEADING, ITEM) if k in open_), PARA), joined, linked)
            else:
                _loose(joined, out)
        parts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            if open_:
                piece = unescape(piece)
            if in_link:
                linked += len(piece)
            parts.append(piece)

    for m in _TOKEN.finditer(text):
        say(text[last : m.start()])
        last = m.end()
        if m["raw"] is not None:
            name = m["rname"].lower()
            if name == "math" or name == "script" and "math/" in m["rattr"].lower():
                flush()
                out.add(FORMULA, m["rbody"])
            elif name in ("syntaxhighlight", "source"):
                flush()
                out.add(CODE, m["rbody"])
            elif name == "nowiki":
                say(m["rbody"])
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            parts.append(" " if open_ else "\n")
        elif name == "a":
            in_link = not m["close"]
        elif _BLOCK_NAME.match(name):
            flush()
            if m["close"]:
                if name in names:
                    while names:
                        open_.pop()
                        if names.pop() == name:
                            break
            elif name not in ("hr",):
                if name == "li":
                    while names and "li" in names and names[-1] not in ("ul", "ol"):
                        open_.pop(), names.pop()
                elif names and names[-1] == "p" or name.startswith("h") and names and names[-1] in _KIND and names[-1].startswith("h"):
                    open_.pop(), names.pop()  # a paragraph ends where the next block begins
                open_.append(_KIND.get(name, PARA))
                names.append(name)
    say(text[last:])
    flush()


def blocks(text: str | None) -> list[tuple[str, str, int]]:
    """The blocks of a body in order: (kind, text, characters of link texts)."""
    out = _Blocks()
    if not text:
        return out.found
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for _ in range(2):  # markup that was escaped, once or twice
        if _ESCAPED.search(text) and not _ANY_BLOCK.search(text):
            text = html.unescape(text)
    if "<" in text and _TOKEN.search(text):
        if _TEX.search(text) and not _ANY_BLOCK.search(text):
            _tex(text, out)
        else:
            _tags(text, out)
    else:
        _loose(text, out)
    return out.found


def labels(found: list[tuple[str, str, int]], short: int = 70, long: int = 200, low: float = 0.16, high: float = 0.28, links: float = 0.5) -> list[str]:
    """'content' or 'boilerplate' for each block.

    First pass: mostly links is boilerplate; long texts with many stop words,
    code and formulas are content, with few boilerplate; short ones are left
    open. Second pass: an open block takes the label of its nearest decided
    neighbours if they agree, else content; headings look ahead first.
    """
    first: list[str | None] = []
    for kind, text, linked in found:
        words = text.lower().split()
        density = sum(w.strip(".,;:!?()") in STOP_WORDS for w in words) / max(1, len(words))
        if kind in (CODE, FORMULA):
            first.append("content")
        elif linked > links * len(text):
            first.append("boilerplate" if len(text) >= short else None)
        elif len(text) < short or kind == HEADING:
            first.append(None)
        elif density >= high or (density >= low and len(text) >= short):
            first.append("content")
        else:
            first.append("boilerplate" if len(text) >= long else None)
    before: list[str | None] = []
    held = None
    for label in first:
        held = label or held
        before.append(held)
    after: list[str | None] = []
    held = None
    for label in reversed(first):
        held = label or held
        after.append(held)
    after.reverse()
    out = []
    for label, b, a in zip(first, before, after):
        near = {x for x in (b, a) if x}
        out.append(label or (near.pop() if len(near) == 1 else "content"))
    return out


def clean_blocks(records: DataFrame, key: str, body: str, content_only: bool = False) -> DataFrame:
    """(key, ordinal INT, block_kind, block_text, label) of each block of each body.

    White space is one space, ends are trimmed and empty blocks left out. Null
    and blank bodies have no rows; repeated rows have theirs again. With
    ``content_only`` blocks labelled boilerplate are left out, else nothing is
    dropped by its label. Bodies go whole.
    """
    kind = dict(records.dtypes)[key]
    given = spread(records.where(F.length(body) > 0).select(F.col(key), F.col(body)), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ordinals, kinds, texts, marks = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = blocks(text)
                said = labels(found)
                if content_only:
                    found, said = [b for b, label in zip(found, said) if label == "content"], ["content"] * said.count("content")
                rows += [i] * len(found)
                ordinals += range(len(found))
                kinds += [b[0] for b in found]
                texts += [b[1] for b in found]
                marks += said
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ordinals, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(marks, pa.string())], names=[key, "ordinal", "block_kind", "block_text", "label"])

    return given.mapInArrow(run, f"`{key}` {kind}, ordinal int, block_kind string, block_text string, label string")


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two passes of block rules say of each block of each product's body."""
    records = spark.read.parquet(f"{sf_dir}/product_record.parquet")
    return clean_blocks(records, "product_id", "body_html").select("product_id", "block_kind", "block_text", "label").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each product's body."""
    return clean_blocks(spark.read.parquet(f"{sf_dir}/product_record.parquet"), "product_id", "body_html").select("product_id", "block_kind", "block_text").distinct()
