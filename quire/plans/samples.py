"""Files made of the driver's tables, for the queries that read files: books with all that readers must put up with, PDF files, logs."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import lines
from quire.plans import tables

#: Documents of a volume, items of a benchmark volume.
VOLUME, ITEMS = 500, 25


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, title, author, d, chapter, b, text, skipped): books of bounded size, a document a chapter, a line a block."""
    rows = tables.blocks(spark, sf_dir).withColumn("book", F.concat_ws("/", "book", F.floor(F.col("d") / VOLUME).cast("string")))
    return rows.select("book", F.concat(F.lit("Volume "), "book").alias("title"), F.concat(F.lit("Author of "), F.split_part("book", F.lit("/"), F.lit(1))).alias("author"), "d", F.concat(F.lit("Chapter "), F.col("d").cast("string")).alias("chapter"), "b", "text", "skipped")


def item_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, i, text): benchmark items in books of ITEMS; i counts from 0 in its book."""
    return tables.read(spark, sf_dir, "benchmark").select(F.concat(F.lit("items-"), F.floor(F.col("item_id") / ITEMS).cast("string")).alias("book"), (F.col("item_id") % ITEMS).alias("i"), "text")


def _made(rows: DataFrame, make) -> DataFrame:
    """(book, content) from (book, parts), one file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([make(b.column(0)[k].as_py(), b.column(1)[k].as_py())], pa.binary())], ["book", "content"])

    return rows.mapInArrow(run, "book string, content binary")


# ---------------------------------------------------------------- awkward books


def awkward_name(i: int) -> str:
    return f"part {i}_é.xhtml"


def awkward_book(name: str, parts: list[dict]) -> bytes:
    """Entry names encoded or not in turn, every seventh document lost, titles in two tables of contents or in none, a cover named by metadata."""
    numbers = [p["i"] for p in parts]
    items = "".join(f'<item id="c{i}" href="text/../text/{quote(awkward_name(i))}#top" media-type="application/xhtml+xml"/>' for i in numbers)
    refs = "".join(f'<itemref idref="c{i}"/>' for i in numbers)
    package = (
        '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> ' + name + " </dc:title>"
        '<meta name="cover" content="pic"/></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav"/>'
        '<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="pic" href="img/cover%20pic.PNG"/>' + items + '</manifest><spine><itemref idref="lost"/>' + refs + "</spine></package>"
    )
    links = "".join(f'<li><a href="text/{quote(awkward_name(i))}">Nav {i}</a></li>' for i in numbers if i % 3 == 0)
    points = "".join(f'<navPoint><navLabel><text>Ncx {i}</text></navLabel><content src="text/{quote(awkward_name(i))}#a"/></navPoint>' for i in numbers if i % 3 < 2)
    files = {
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        "OPS/book.opf": package,
        "OPS/nav.xhtml": f"<html><body><nav><ol>{links}</ol></nav></body></html>",
        "OPS/toc.ncx": f"<ncx xmlns='http://www.daisy.org/z3986/2005/ncx/'><navMap>{points}</navMap></ncx>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for entry, text in files.items():
            z.writestr(entry, text)
        z.writestr("OPS/img/cover pic.PNG", parts[0]["text"].encode())
        for p in parts:
            if p["i"] % 7 != 6:
                entry = awkward_name(p["i"])
                z.writestr("OPS/text/" + (quote(entry) if p["i"] % 2 else entry), f"<html><body><p>{p['text'].replace('&', '&amp;').replace('<', '&lt;')}</p></body></html>")
    return out.getvalue()


def awkward_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, file_name, content)."""
    rows = item_volumes(spark, sf_dir).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("parts"))
    return _made(rows, awkward_book).select("book", F.concat("book", F.lit(".epub")).alias("file_name"), "content")


# ---------------------------------------------------------------- PDF files


def pdf_file(title: str, author: str, pages: list[list[str]]) -> bytes:
    """Pages of lines in a font of two-byte codes, streams deflated, two pages a node of the page tree."""
    objects: dict[int, bytes] = {}
    font, info, catalog, root = 1, 2, 3, 4
    objects[font] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H >>"
    said = author.encode().replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    objects[info] = b"<< /Title <" + (b"\xfe\xff" + title.encode("utf-16-be")).hex().encode() + b"> /Author (" + said + b") >>"
    objects[catalog] = b"<< /Type /Catalog /Pages %d 0 R >>" % root
    at, nodes = 5, []
    for k in range(0, len(pages), 2):
        node, kids = at, []
        at += 1
        for page in pages[k : k + 2]:
            shown = b"\n".join(b"<" + line.encode("utf-16-be").hex().encode() + b"> Tj T*" for line in page)
            body = zlib.compress(b"BT /F1 12 Tf 14 TL 72 720 Td\n" + shown + b"\nET")
            objects[at] = b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (node, at + 1)
            objects[at + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream"
            kids.append(b"%d 0 R" % at)
            at += 2
        objects[node] = b"<< /Type /Pages /Parent %d 0 R /Resources << /Font << /F1 %d 0 R >> >> /Kids [%s] /Count %d >>" % (root, font, b" ".join(kids), len(kids))
        nodes.append(b"%d 0 R" % node)
    objects[root] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(nodes), len(pages))
    out = bytearray(b"%PDF-1.4\n")
    places = {}
    for n in sorted(objects):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + objects[n] + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(objects))
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, catalog, info, start))


def pdf_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, content): a volume as a PDF file, a document a page, all its lines as they are."""
    docs = tables.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / VOLUME).cast("string")).alias("book"), F.col("doc_id").alias("d"), lines(F.col("text")).alias("ls"))
    rows = docs.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("d", "ls"))).alias("parts"))
    return _made(rows, lambda name, parts: pdf_file(f"Volume {name}", f"A (\\) of {name}", [p["ls"] for p in parts]))


def pdf_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, content): benchmark volumes as PDF files, an item a page."""
    rows = item_volumes(spark, sf_dir).select("book", "i", lines(F.col("text")).alias("ls")).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("i", "ls"))).alias("parts"))
    return _made(rows, lambda name, parts: pdf_file(f"PDF of {name}", "Nobody", [p["ls"] for p in parts]))


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, text, content): a volume's documents as one text with form feeds between, and behind the last; content is its bytes."""
    docs = tables.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / VOLUME).cast("string")).alias("book"), F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("d", "text"))).alias("parts"))
    whole = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "\f"), F.lit("\f"))
    return rows.select("book", whole.alias("text")).withColumn("content", F.col("text").cast("binary"))


# ---------------------------------------------------------------- translators


class Moody:
    """Answers like the stub, but cuts its reply off where a text holds the mark."""

    def __init__(self, mark: str):
        self.mark = mark

    def __call__(self, model: str, items: list[tuple[int, str]]) -> tuple[str, list[tuple[int, str]], int, str]:
        if any(self.mark in t for _, t in items):
            return "truncated", [], 0, "cut off"
        return "ok", [(i, "[MY] " + t) for i, t in items], len(items), ""
