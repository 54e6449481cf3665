"""Files as rows: what they are by their first bytes, and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.paths import file_name
from quire.functions.text import trim_ws


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(book, file_name, content, format) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("book"), file_name(F.col("path")).alias("file_name"), "content", sniff(F.col("content")).alias("format"))


def sniff(content: Column) -> Column:
    """epub for any zip, pdf, else null; the magic alone is not enough."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return F.when((F.octet_length(content) > 4) & (head(4) == "504B0304"), "epub").when((F.octet_length(content) > 4) & (head(5) == "255044462D"), "pdf")


def pages_of_dumps(dumps: DataFrame, book: str = "book", text: str = "text") -> DataFrame:
    """(book, page, text): text dumps cut at form feeds; an empty page at the end goes."""
    cut = F.regexp_replace(F.col(text), "\f\\z", "")
    return dumps.select(book, F.posexplode(F.split(cut, "\f")).alias("page", text))


def first_readable(readers: list[DataFrame], book: str = "book", page: str = "page", text: str = "text") -> DataFrame:
    """Pages from the first of several readers that gives a book any text."""
    rows = None
    for k, df in enumerate(readers):
        part = df.select(book, page, text, F.lit(k).alias("_reader"))
        rows = part if rows is None else rows.unionByName(part)
    good = rows.where(trim_ws(F.col(text)) != "").groupBy(book).agg(F.min("_reader").alias("_reader"))
    return rows.join(good, [book, "_reader"]).drop("_reader")


def pdf_string(raw: Column) -> Column:
    """A PDF string: UTF-16BE behind its mark, else UTF-8 with replacements for what is not."""
    wide = F.hex(F.substring(raw, 1, 2)) == "FEFF"
    return F.when(wide, F.decode(F.unhex(F.substring(F.hex(raw), 5, 1 << 30)), "UTF-16BE")).otherwise(F.make_valid_utf8(raw.cast("string")))


def decode_pdf_string(raw: bytes) -> str:
    """The same for one value."""
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8", "replace")
