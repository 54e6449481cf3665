"""Page texts of PDF files by a chain of readers; the first that gives any text is taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip_markdown
from quire.sources.pdf_text import describe, read_pdf

#: bytes to page texts; raises any Exception if it can't
PageReader = Callable[[bytes], list[str]]


@dataclass(frozen=True)
class Reader:
    """A reader by what it gives: page texts, pages of markdown, or one dump with form feeds between pages."""

    name: str
    read: Callable[[bytes], list[str] | str]
    gives: str = "pages"

    def __call__(self, content: bytes) -> list[str]:
        got = self.read(content)
        return pages_of_dump(got) if self.gives == "dump" else got


def pages_of_dump(text: str) -> list[str]:
    """A dump cut at form feeds; the empty page behind the last one goes."""
    out = text.split("\f")
    return out[:-1] if len(out) > 1 and not out[-1].strip() else out


#: Readers used where none are given.
READERS: list[PageReader] = [Reader("built-in", read_pdf)]


def read_pages(content: bytes, readers: list[PageReader]) -> tuple[list[str], bool]:
    """(pages, whether they are markdown) from the first reader that gives any text; raises ValueError with all their errors."""
    errors = []
    for reader in readers:
        name = getattr(reader, "name", None) or getattr(reader, "__name__", "reader")
        try:
            pages = reader(content)
        except Exception as e:  # noqa: BLE001  a reader may fail in any way; the next one has its turn
            errors.append(f"{name}: {e}")
            continue
        if any(p.strip() for p in pages):
            return pages, getattr(reader, "gives", "") == "markdown"
        errors.append(f"{name}: no text")
    raise ValueError("; ".join(errors) or "no page reader is installed")


def pages(files: DataFrame, readers: list[PageReader]) -> DataFrame:
    """(book, page, text, error) from (book, content); a book that no reader can take is one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    texts, markdown = read_pages(content or b"", readers)
                    rows = [(key, i, t, markdown, None) for i, t in enumerate(texts)]
                except ValueError as e:
                    rows = [(key, None, None, False, str(e))]
                cols = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["book", "page", "text", "markdown", "error"])

    rows = files.select("book", "content").mapInArrow(run, "book string, page int, text string, markdown boolean, error string")
    return rows.select("book", "page", F.when(F.col("markdown"), strip_markdown(F.col("text"))).otherwise(F.col("text")).alias("text"), "error")


def metadata(files: DataFrame) -> DataFrame:
    """(book, title, author) from (book, content): what the files say of themselves, '' where they don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [describe(c or b"") for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in said], pa.string()), pa.array([a for _, a in said], pa.string())], ["book", "title", "author"])

    return files.select("book", "content").mapInArrow(run, "book string, title string, author string")
