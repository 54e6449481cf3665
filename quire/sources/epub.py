"""EPUB books: reading their documents, and writing books with translations.

A book is one binary value, read and written by one task; Spark spreads books. A book that can't be
read gives a row with its error and no documents, never a failed job.
"""

from __future__ import annotations

import base64
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.paths import decode_name, encode_name
from quire.functions.text import LANGUAGE_CODES
from quire.operators.html_blocks import MARK_CLASS, STYLE, escape

#: Image types of cover files, and the time stamp that makes new books the same each time.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}
STAMP = "2026-01-01T00:00:00Z"


# ---------------------------------------------------------------- names


def resolve(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def entry_key(name: str) -> str:
    return resolve(decode_name(name))


def join_href(base: str, href: str) -> str:
    path = decode_name(href.split("#", 1)[0])
    return resolve(decode_name(path if path.startswith("/") or not base else f"{base}/{path}"))


def title_of_path(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    for end in (".xhtml", ".html", ".htm"):
        while name.endswith(end):
            name = name[: -len(end)]
    return name.replace("_", " ").replace("-", " ")


# ---------------------------------------------------------------- reading


@dataclass
class Book:
    title: str = ""
    author: str = ""
    cover: str | None = None
    docs: list[tuple[str, str, str]] = field(default_factory=list)  # path, title, html
    warnings: list[str] = field(default_factory=list)


def _local(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _all(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (n for n in root.iter() if _local(n) == name)


def _text(node: ElementTree.Element | None) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


#: What reading an archive raises where it, or a member, is damaged, locked or packed in a way not known here.
DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError, struct.error)


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except DAMAGE as e:
        raise ValueError(f"not an archive: {e}") from e


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    try:
        return archive.read(name)
    except DAMAGE as e:
        raise ValueError(f"{name}: {e}") from e


def read_book(content: bytes, file_name: str = "") -> Book:
    """Documents in spine order with their titles, metadata and the cover; raises ValueError with a message."""
    archive = _open(content)
    names = set(archive.namelist())

    def entry(path: str) -> bytes | None:
        name = next((n for n in (path, encode_name(path)) if n in names), None)
        return None if name is None else _member(archive, name)

    def xml(path: str) -> ElementTree.Element:
        raw = entry(path)
        if raw is None:
            raise ValueError(f"missing {path}")
        try:
            return ElementTree.fromstring(raw)
        except ElementTree.ParseError as e:
            raise ValueError(f"{path}: {e}") from e

    opf_path = next((n.get("full-path") for n in _all(xml("META-INF/container.xml"), "rootfile") if n.get("full-path")), None)
    if not opf_path:
        raise ValueError("container.xml names no package")
    opf = xml(opf_path)
    base = opf_path.rpartition("/")[0]
    book = Book(title=_text(next(_all(opf, "title"), None)), author=_text(next(_all(opf, "creator"), None)))
    manifest = {n.get("id"): n for n in _all(opf, "item") if n.get("id") and n.get("href")}
    spine = [join_href(base, manifest[r.get("idref")].get("href")) for r in _all(opf, "itemref") if r.get("idref") in manifest]
    if not spine:
        raise ValueError("the spine is empty")
    titles = _labels(base, manifest, entry)
    book.cover = _cover(base, opf, manifest, entry)
    for path in spine:
        try:
            raw = entry(path)
        except ValueError as e:  # the other documents are still worth reading
            book.warnings.append(f"damaged document: {e}")
            continue
        if raw is None:
            book.warnings.append(f"missing document: {path}")
        else:
            book.docs.append((path, titles.get(path) or title_of_path(path), raw.decode("utf-8", "replace")))
    book.title = book.title or file_name.rsplit(".", 1)[0]
    return book


def _labels(base: str, manifest: dict, entry) -> dict[str, str]:
    """Path to title: the navigation document's links, then the NCX's points; the first label of a path stays."""
    out: dict[str, str] = {}

    def tree(kind) -> ElementTree.Element | None:
        item = next((n for n in manifest.values() if kind(n)), None)
        try:
            raw = entry(join_href(base, item.get("href"))) if item is not None else None
            return ElementTree.fromstring(raw) if raw else None
        except (ElementTree.ParseError, ValueError):
            return None

    nav = tree(lambda n: "nav" in (n.get("properties") or "").split())
    for a in _all(nav, "a") if nav is not None else ():
        if a.get("href") and _text(a):
            out.setdefault(join_href(base, a.get("href")), _text(a))
    ncx = tree(lambda n: n.get("media-type") == "application/x-dtbncx+xml")
    for point in _all(ncx, "navPoint") if ncx is not None else ():
        target = next(_all(point, "content"), None)
        label = _text(next(_all(point, "text"), None))
        if target is not None and target.get("src") and label:
            out.setdefault(join_href(base, target.get("src")), label)
    return out


def _cover(base: str, opf: ElementTree.Element, manifest: dict, entry) -> str | None:
    named = next((manifest.get(n.get("content")) for n in _all(opf, "meta") if n.get("name") == "cover"), None)
    item = named if named is not None else next((n for n in manifest.values() if "cover-image" in (n.get("properties") or "").split() and (n.get("media-type") or "").startswith("image/")), None)
    if item is None:
        return None
    path = join_href(base, item.get("href"))
    try:
        raw = entry(path)
    except ValueError:
        return None
    kind = IMAGE_TYPES.get(path.rsplit(".", 1)[-1].lower(), "image/jpeg")
    return f"data:{kind};base64,{base64.b64encode(raw).decode()}" if raw is not None else None


_DOC = pa.struct([("d", pa.int64()), ("path", pa.string()), ("title", pa.string()), ("html", pa.string())])


def books(files: DataFrame) -> DataFrame:
    """(book, title, author, cover, docs, warnings, error) from (book, file_name, content), a row a book."""
    names = ["book", "title", "author", "cover", "docs", "warnings", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                key, name, content = (b.column(i)[k].as_py() for i in range(3))
                error = None
                try:
                    book = read_book(content or b"", name or "")
                except ValueError as e:
                    book, error = Book(), str(e)
                docs = [{"d": d, "path": p, "title": t, "html": h} for d, (p, t, h) in enumerate(book.docs)]
                row = [[key], [book.title], [book.author], [book.cover], [docs], [book.warnings], [error]]
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(_DOC), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names)

    schema = "book string, title string, author string, cover string, docs array<struct<d:bigint,path:string,title:string,html:string>>, warnings array<string>, error string"
    return files.select("book", "file_name", "content").mapInArrow(run, schema)


def documents(read: DataFrame) -> DataFrame:
    """(book, d, path, title, html) of read books."""
    return read.select("book", F.inline("docs"))


# ---------------------------------------------------------------- writing


def _archive(parts: list[tuple[str, bytes]]) -> bytes:
    """The first part stored, the others deflated, all with one time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, content) in enumerate(parts):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED
            z.writestr(info, content)
    return out.getvalue()


def repack(content: bytes, replacements: dict[str, str]) -> tuple[bytes, int]:
    """The archive with documents replaced by path, and how many replacements found no entry."""
    old = _open(content)
    by_key = {entry_key(k): v for k, v in replacements.items()}
    used, parts = set(), []
    for name in old.namelist():
        if name.endswith("/"):
            continue
        new = replacements.get(name)
        key = entry_key(name)
        if new is None:
            new = by_key.get(key)
        if new is not None:
            used.add(key)
        parts.append((name, _member(old, name) if new is None else new.encode()))
    first = [p for p in parts if p[0] == "mimetype"]
    return _archive([*(first or [("mimetype", b"application/epub+zip")]), *[p for p in parts if p[0] != "mimetype"]]), len(set(by_key) - used)


def language_code(name: str) -> str:
    low = name.lower()
    code = next((c for part, c in LANGUAGE_CODES if part in low), "en")
    return "zh-TW" if code == "zh-CN" and "traditional" in low else code


@dataclass
class Chapter:
    title: str
    blocks: list[dict]  # text, skipped, translation


#: Fixed values of the format: namespaces and media types.
_OPF, _DC, _NCX = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.daisy.org/z3986/2005/ncx/"
_XHTML, _OPS, _OCF = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops", "urn:oasis:names:tc:opendocument:xmlns:container"
_TYPES = {"xhtml": "application/xhtml+xml", "ncx": "application/x-dtbncx+xml", "css": "text/css", "opf": "application/oebps-package+xml"}
SHEET = "p { text-indent: 0; margin: 0 0 .8em }\n"


def _plain(text: str) -> str:
    """text without the characters that XML has not."""
    return "".join(c for c in text if c in "\t\n\r" or " " <= c <= "\ud7ff" or "\ue000" <= c <= "\ufffd" or c > "\uffff")


def _node(parent: ElementTree.Element, tag: str, text: str | None = None, **attributes: str) -> ElementTree.Element:
    """A child element; attributes written with an underscore behind them, or between words, get what XML has there."""
    node = ElementTree.SubElement(parent, tag, {k.rstrip("_").replace("_", "-"): _plain(v) for k, v in attributes.items()})
    node.text = None if text is None else _plain(text)
    return node


def _root(tag: str, space: str, **attributes: str) -> ElementTree.Element:
    return ElementTree.Element(tag, {"xmlns": space, **attributes})


def _xml(root: ElementTree.Element) -> bytes:
    return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True, short_empty_elements=True)


def _sheet_page(title: str) -> tuple[ElementTree.Element, ElementTree.Element]:
    """(html, body) of a page that takes its looks from the book's style sheet."""
    html = _root("html", _XHTML)
    head = _node(html, "head")
    _node(head, "title", title)
    _node(head, "link", rel="stylesheet", type="text/css", href="looks.css")
    return html, _node(html, "body")


def chapter_html(title: str, blocks: list[dict], mode: str) -> str:
    """A chapter's page: every block's text, with its translation under it, or in its place."""
    html, body = _sheet_page(title)
    for b in blocks:
        told = None if b["skipped"] else b.get("translation")
        if told is None or mode == "bilingual":
            if b["text"] or told is not None:
                _node(body, "p", b["text"])
        if told is not None:
            _node(body, "p", told, **({"class_": MARK_CLASS} if mode == "bilingual" else {}))
    return _xml(html).decode()


class NewBook:
    """A book as the things it is made of: pages in order, and other files. Equal input, equal bytes."""

    folder = "OEBPS"

    def __init__(self, title: str, author: str, language: str):
        self.title, self.author, self.code = title, author, language_code(language)
        self.name = f"urn:quire:{title}-{self.code}"
        self.pages: list[tuple[str, str, str]] = []  # file, title, html

    def add(self, chapter: Chapter, mode: str) -> None:
        self.pages.append((f"ch{len(self.pages) + 1:03}.xhtml", chapter.title, chapter_html(chapter.title, chapter.blocks, mode)))

    def package(self, others: dict[str, str]) -> bytes:
        """others: id to file name, of what is no page."""
        root = _root("package", _OPF, version="3.0", **{"unique-identifier": "book"})
        about = _node(root, "metadata")
        about.set("xmlns:dc", _DC)
        _node(about, "dc:title", self.title)
        _node(about, "dc:creator", self.author)
        _node(about, "dc:language", self.code)
        _node(about, "dc:identifier", self.name, id="book")
        _node(about, "meta", STAMP, property="dcterms:modified")
        manifest, spine = _node(root, "manifest"), _node(root, "spine", toc="points")
        for k, (file, _, _) in enumerate(self.pages):
            _node(manifest, "item", id=f"page-{k}", href=file, media_type=_TYPES["xhtml"])
            _node(spine, "itemref", idref=f"page-{k}")
        for name, file in others.items():
            item = _node(manifest, "item", id=name, href=file, media_type=_TYPES[file.rsplit(".", 1)[-1]])
            if name == "contents":
                item.set("properties", "nav")
        return _xml(root)

    def contents(self) -> bytes:
        """The list of pages for readers of version 3."""
        html, body = _sheet_page(self.title)
        html.set("xmlns:epub", _OPS)
        nav = _node(body, "nav")
        nav.set("epub:type", "toc")
        _node(nav, "h1", self.title)
        rows = _node(nav, "ol")
        for file, title, _ in self.pages:
            _node(_node(rows, "li"), "a", title, href=file)
        return _xml(html)

    def points(self) -> bytes:
        """The same for readers of version 2."""
        root = _root("ncx", _NCX, version="2005-1")
        _node(_node(root, "head"), "meta", name="dtb:uid", content=self.name)
        _node(_node(root, "docTitle"), "text", self.title)
        rows = _node(root, "navMap")
        for k, (file, title, _) in enumerate(self.pages, 1):
            point = _node(rows, "navPoint", id=f"point-{k}", playOrder=str(k))
            _node(_node(point, "navLabel"), "text", title)
            _node(point, "content", src=file)
        return _xml(root)

    def pack(self) -> bytes:
        container = _root("container", _OCF, version="1.0")
        _node(_node(container, "rootfiles"), "rootfile", full_path=f"{self.folder}/book.opf", media_type=_TYPES["opf"])
        inside = {"book.opf": self.package({"contents": "contents.xhtml", "points": "points.ncx", "looks": "looks.css"})}
        inside |= {file: html.encode() for file, _, html in self.pages}
        inside |= {"contents.xhtml": self.contents(), "points.ncx": self.points(), "looks.css": f"{SHEET}{STYLE}\n".encode()}
        return _archive([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", _xml(container)), *((f"{self.folder}/{n}", c) for n, c in inside.items())])


def new_book(title: str, author: str, language: str, chapters: list[tuple[str, list[dict]]], mode: str) -> bytes:
    """A fresh book with navigation for readers of either version."""
    book = NewBook(title, author, language)
    for name, blocks in chapters:
        book.add(Chapter(name, blocks), mode)
    return book.pack()


def repacked(files: DataFrame, rewritten: DataFrame) -> DataFrame:
    """(book, content, missed, error): books (book, content) with rewritten documents (book, path, html) put in.

    A book whose archive is damaged gives a row with its error and null content.
    """
    by_book = rewritten.groupBy("book").agg(F.collect_list(F.struct("path", "html")).alias("docs"))
    rows = files.select("book", "content").join(by_book, "book")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                made, missed, error = None, None, None
                try:
                    made, missed = repack(b.column(1)[k].as_py() or b"", {x["path"]: x["html"] for x in b.column(2)[k].as_py()})
                except ValueError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([made], pa.binary()), pa.array([missed], pa.int64()), pa.array([error], pa.string())], ["book", "content", "missed", "error"])

    return rows.mapInArrow(run, "book string, content binary, missed long, error string")


def built(chapters: DataFrame, language: str, mode: str) -> DataFrame:
    """(book, content): fresh books from (book, title, author, d, chapter, b, text, skipped, translation) rows."""
    by_doc = chapters.groupBy("book", "title", "author", "d", "chapter").agg(F.array_sort(F.collect_list(F.struct("b", "text", "skipped", "translation"))).alias("blocks"))
    by_book = by_doc.groupBy("book", "title", "author").agg(F.array_sort(F.collect_list(F.struct("d", "chapter", "blocks"))).alias("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                _, title, author, docs = (b.column(i)[k].as_py() for i in range(4))
                made = new_book(title or "", author or "", language, [(d["chapter"], d["blocks"]) for d in docs], mode)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([made], pa.binary())], ["book", "content"])

    return by_book.select("book", "title", "author", "docs").mapInArrow(run, "book string, content binary")


def save(made: DataFrame, folder: str) -> DataFrame:
    """Write each book's bytes under folder, with .epub behind names that lack it: (book, path, bytes).

    folder may be on any file system that Spark knows. Books go one at a time through the driver, which
    is where a user's save command runs; a book without bytes is left out.
    """
    spark = made.sparkSession
    jvm, rows = spark.sparkContext._jvm, []
    for r in made.select("book", "content").where("content is not null").toLocalIterator():
        name = r["book"].rsplit("/", 1)[-1]
        path = jvm.org.apache.hadoop.fs.Path(folder, name if name.endswith(".epub") else f"{name}.epub")
        stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        stream.write(bytearray(r["content"]))
        stream.close()
        rows.append((r["book"], path.toString(), len(r["content"])))
    return spark.createDataFrame(rows, "book string, path string, bytes long")
