"""Block texts of HTML documents, and documents rewritten with translations of them.

Blocks are paragraphs, headings, list items, quotes, table cells, definitions and captions, numbered
in the order of their start tags; text belongs to the innermost open block, and goes on in the outer
one when that closes. Own rules where HTML is malformed: an end tag closes the innermost open
element of its name and what is open inside it; an end tag without one is ignored; the document's end
closes all; script and style are raw text up to their end tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.entities import unescape
from quire.functions.text import collapse_ws, is_translatable

#: The block elements.
BLOCK_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote td th dd dt figcaption".split())
#: The class of inserted translations, and its style.
STYLE = ".ebtr-translation{margin:.45em 0;}"
MARK_CLASS = "ebtr-translation"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title"))
_SIBLING = {"li": "li", "dt": "dt", "dd": "dd", "td": "td", "th": "td"}
_WS = r"\t\n\f\r "
#: Attributes as HTML has them: a quote opens a value directly behind "=" only, elsewhere it is a character like others.
_VALUE = rf"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^{_WS}>\"'][^{_WS}>]*+"
_ATTRIBUTES = rf"(?:[{_WS}/]|[^{_WS}/>][^{_WS}/>=]*+(?:[{_WS}]*+=[{_WS}]*+(?:{_VALUE})?+)?+)*+"
_TAG = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^{_WS}/>]*+){_ATTRIBUTES}(?:(>)|\Z)", re.S)


def _scan(html: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, tag): text, start and end tags, and other markup (comments, declarations)."""
    pos, raw = 0, ""
    while pos < len(html):
        if raw:
            stop = re.compile(f"</{raw}(?=[\\s/>])", re.I).search(html, pos)
            end = stop.start() if stop else len(html)
            if end > pos:
                yield "text", pos, end, ""
            pos, raw = end, ""
            if pos >= len(html):
                break
        m = _TAG.search(html, pos)
        if m is None:
            yield "text", pos, len(html), ""
            break
        if m.start() > pos:
            yield "text", pos, m.start(), ""
        pos = m.end()
        if m[3]:
            tag = m[2].lower()
            yield ("end" if m[1] else "start"), m.start(), pos, tag
            raw = tag if not m[1] and tag in _RAW else ""
        else:
            yield "other", m.start(), pos, ""


class _Stack:
    """Open elements; those that are blocks carry their number."""

    def __init__(self):
        self.open: list[tuple[str, int]] = []
        self.blocks: list[int] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str, block: int) -> None:
        self.open.append((tag, block))
        self.count[tag] = self.count.get(tag, 0) + 1
        if block >= 0:
            self.blocks.append(block)

    def pop(self) -> int:
        tag, block = self.open.pop()
        self.count[tag] -= 1
        if block >= 0:
            self.blocks.pop()
        return block

    def close(self, tag: str) -> list[int]:
        """Close up to the innermost element of this name; the blocks that closed, innermost first."""
        out = []
        if self.count.get(tag):
            while self.open:
                name = self.open[-1][0]
                block = self.pop()
                if block >= 0:
                    out.append(block)
                if name == tag:
                    break
        return out


def raw_blocks(html: str) -> list[tuple[str, str]]:
    """(tag, text with entities decoded) in the order of start tags."""
    tags: list[str] = []
    texts: list[list[str]] = []
    stack = _Stack()
    for kind, a, b, tag in _scan(html):
        if kind == "text":
            if stack.blocks:
                texts[stack.blocks[-1]].append(html[a:b])
        elif kind == "end":
            stack.close(tag)
        elif kind == "start" and tag not in _VOID:
            block = -1
            if tag in BLOCK_TAGS:
                block = len(tags)
                tags.append(tag)
                texts.append([])
            stack.push(tag, block)
    return [(t, unescape("".join(x))) for t, x in zip(tags, texts, strict=True)]


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def rewrite(html: str, translations: dict[int, str], bilingual: bool) -> str:
    """The document with translations by block number: beside the blocks, or in place of their own texts."""
    out: list[str] = []
    stack, n = _Stack(), 0
    tag_of: dict[int, str] = {}

    def beside(blocks: list[int]) -> None:
        for k in blocks:
            if bilingual and k in translations:
                s = _SIBLING.get(tag_of[k], "p")
                out.append(f'<{s} class="{MARK_CLASS}">{escape(translations[k])}</{s}>')

    for kind, a, b, tag in _scan(html):
        piece = html[a:b]
        if kind == "text":
            if bilingual or not stack.blocks or stack.blocks[-1] not in translations:
                out.append(piece)
        elif kind == "other":
            out.append(piece)
        elif kind == "start":
            out.append(piece)
            if tag not in _VOID:
                block = -1
                if tag in BLOCK_TAGS:
                    block, n = n, n + 1
                    tag_of[block] = tag
                    if not bilingual and block in translations:
                        out.append(escape(translations[block]))
                stack.push(tag, block)
        else:
            if tag == "head" and bilingual and stack.count.get("head"):
                out.append(f'<style type="text/css">{STYLE}</style>')
            closed = stack.close(tag)
            own = closed[-1:] if closed and tag_of.get(closed[-1]) == tag else []
            beside(closed[: len(closed) - len(own)])
            out.append(piece)
            beside(own)
    while stack.open:
        k = stack.pop()
        beside([k] if k >= 0 else [])
    return "".join(out)


def collect(docs: DataFrame, key: str = "d", html: str = "html") -> DataFrame:
    """(key, b, tag, text, skipped): a row for each block of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                keys, nos, tags, texts = [], [], [], []
                for k, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for no, (tag, text) in enumerate(raw_blocks(source or "")):
                        keys.append(k)
                        nos.append(no)
                        tags.append(tag)
                        texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(0).type), pa.array(nos, pa.int64()), pa.array(tags, pa.string()), pa.array(texts, pa.string())], [key, "b", "tag", "raw"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, html).mapInArrow(run, f"`{key}` {kind}, b long, tag string, raw string")
    rows = rows.withColumn("text", collapse_ws(F.col("raw"))).drop("raw")
    return rows.withColumn("skipped", ~is_translatable(F.col("text")))


def rewrite_docs(docs: DataFrame, translated: DataFrame, mode: str = "bilingual", key: str = "d", html: str = "html") -> DataFrame:
    """(key, html) of documents that have a translation; translated has (key, b, translation, skipped)."""
    by_doc = translated.where(~F.col("skipped") & F.col("translation").isNotNull()).groupBy(key).agg(F.collect_list(F.struct("b", "translation")).alias("t"))
    rows = docs.select(key, html).join(by_doc, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [rewrite(h or "", {x["b"]: x["translation"] for x in t}, mode == "bilingual") for h, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], [key, html])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, `{html}` string")
