"""Page text: lines, running headers and page numbers, paragraphs, chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numerals import header_key, is_page_number
from quire.functions.text import collapse_ws, lines, trim_ws
from quire.operators.batching import assign_groups
from quire.shared import table

#: An edge line must recur on so many pages; lines a paragraph takes on pages without blank lines; characters of a chapter.
MIN_PAGES, GROUP_LINES, CHAPTER_CHARS = 3, 6, 8000


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with a row for each line: line_no, line (trimmed)."""
    rest = [c for c in pages.columns if c != text]
    return pages.select(*rest, F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("line", trim_ws(F.col("line")))


def _full(text: str):
    """The trimmed lines that are not empty."""
    return F.filter(F.transform(lines(F.col(text)), trim_ws), lambda x: x != "")


def edge_lines(pages: DataFrame, book: str = "book", page: str = "page", text: str = "text") -> DataFrame:
    """(book, page, m, edges): how many lines that are not empty a page has, and the two at each edge as (edge, k, line); none on pages of one line."""
    rows = pages.select(book, page, _full(text).alias("full")).withColumn("m", F.size("full"))
    at = lambda e, k, i: F.struct(F.lit(e).alias("edge"), F.lit(k).alias("k"), F.get("full", i).alias("line"))
    four = F.array(at("top", 1, F.lit(0)), at("top", 2, F.lit(1)), at("bottom", 1, F.col("m") - 1), at("bottom", 2, F.col("m") - 2))
    return rows.select(book, page, "m", F.when(F.col("m") >= 2, four).otherwise(F.slice(four, 1, 0)).alias("edges"))


def _sums(edges: DataFrame, book: str) -> DataFrame:
    """(book, edge, key, n, numbered): pages by running text at each edge, and by book (edge and key null) all pages."""
    numbered = F.exists("edges", lambda x: (x["k"] == 1) & is_page_number(x["line"]))
    ends = F.filter("edges", lambda x: x["k"] == 1)
    none = F.lit(None).cast("string")
    row = lambda e, line, n: F.struct(e.alias("edge"), line.alias("line"), n.alias("numbered"))
    rows = edges.select(book, F.inline(F.concat(F.transform(ends, lambda x: row(x["edge"], x["line"], F.lit(False))), F.array(row(none, none, numbered)))))
    keyed = rows.select(book, "edge", header_key(F.col("line")).alias("key"), "numbered").where("key is not null or edge is null")
    return keyed.groupBy(book, "edge", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("numbered").alias("numbered"))


def header_counts(pages: DataFrame, book: str = "book", page: str = "page", text: str = "text") -> DataFrame:
    """(book, edge, key, n): on how many pages a running text stands at an edge; pages of one line don't count."""
    return _sums(edge_lines(pages, book, page, text), book).where("edge is not null").drop("numbered")


def _gates(sums: DataFrame, book: str) -> DataFrame:
    enough = (F.col("numbered") >= MIN_PAGES) | (F.col("numbered") * 3 >= F.col("n"))
    return sums.where("edge is null").select(book, enough.alias("strip_numbers"))


def numbered_books(pages: DataFrame, book: str = "book", page: str = "page", text: str = "text") -> DataFrame:
    """(book, strip_numbers): whether enough pages begin or end with a page number."""
    return _gates(_sums(edge_lines(pages, book, page, text), book), book)


def strip_furniture(pages: DataFrame, book: str = "book", page: str = "page", text: str = "text") -> DataFrame:
    """(book, page, stripped, text): up to two running lines or page numbers off either edge, top first.

    Counts come from the pages as they are; blank lines stay; pages of one line stay. What decides is
    narrow (edge lines, and their counts by book), and written once; texts meet the decisions in one join.
    """
    narrow = table(edge_lines(pages, book, page, text), "edges")
    sums = table(_sums(narrow, book).where(F.col("edge").isNull() | (F.col("n") >= MIN_PAGES)), "running")
    running = sums.where("edge is not null").select(book, "edge", "key", F.lit(True).alias("runs"))
    edge = narrow.select(book, page, F.inline("edges")).withColumn("key", header_key(F.col("line")))
    edge = edge.join(running, [book, "edge", "key"], "left").join(_gates(sums, book), book, "left")
    edge = edge.withColumn("hit", F.coalesce("runs", F.lit(False)) | (F.col("strip_numbers") & is_page_number(F.col("line"))))
    hit = lambda e, k: F.bool_or(F.when((F.col("edge") == e) & (F.col("k") == k), F.col("hit")))
    streak = lambda e: F.when(hit(e, 1), F.when(hit(e, 2), 2).otherwise(1)).otherwise(0)
    marks = edge.groupBy(book, page).agg(streak("top").alias("top"), streak("bottom").alias("bottom")).where("top + bottom > 0")
    rows = pages.select(book, page, text).join(marks, [book, page], "left")
    rows = rows.withColumn("ls", F.transform(lines(F.col(text)), trim_ws))
    places = F.filter(F.transform("ls", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", F.when(F.col("top").isNotNull(), places))
    m, top = F.size("places"), F.col("top")
    bottom = F.least(F.col("bottom"), m - top)
    gone = F.concat(F.slice("places", F.lit(1), top), F.slice("places", m - bottom + 1, bottom))
    rows = rows.withColumn("gone", F.when(F.col("places").isNotNull(), gone))
    kept = F.filter("ls", lambda x, i: ~F.array_contains("gone", i))
    plain = F.array_join(F.when(F.col("gone").isNull(), F.col("ls")).otherwise(kept), "\n")
    return rows.select(book, page, F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("stripped"), plain.alias("text"))


def paragraphs(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, paragraph, text): blank lines part paragraphs; on a page without any, every six lines are one.

    keys name a page; a paragraph never spans pages. Numbers run over a page from 0.
    """
    rows = page_lines(pages.select(*keys, text), text)
    page = Window.partitionBy(*keys)
    order = page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    blank = (F.col("line") == "").cast("int")
    rows = rows.withColumns({"blanks": F.sum(blank).over(page), "before": F.sum(blank).over(order)})
    rows = rows.where("line <> ''").withColumn("grp", F.when(F.col("blanks") > 0, F.col("before")).otherwise(F.floor(F.col("line_no") / GROUP_LINES)))
    done = rows.groupBy(*keys, "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"))
    done = done.withColumn("text", collapse_ws(F.col("text"))).where("text <> ''")
    return done.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("grp")) - 1).cast("long").alias("paragraph"), "text")


def chapters(paras: DataFrame, book: str, order: list[str], text: str = "text") -> DataFrame:
    """paras with chapter (from 1), its id and its title: greedy chapters of 8,000 characters, none empty."""
    sized = paras.withColumn("chars", F.length(text).cast("long"))
    rest = tuple(c for c in paras.columns if c not in (book, *order))
    done = assign_groups(sized, book, order, "chars", CHAPTER_CHARS, None, rest)
    n = F.col("group_id") + 1
    return done.withColumns({"chapter": n, "chapter_id": F.concat(F.lit("ch"), F.lpad(n.cast("string"), 3, "0")), "title": F.concat(F.lit("Part "), n.cast("string"))}).drop("group_id")
