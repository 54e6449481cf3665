import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions.text import collapse_ws
from quire.operators import html_blocks
from quire.plans.job import answers, bilingual_rows, call, plan, translate
from quire.plans.samples import pdf_file
from quire.sources import binary, epub, logs, pdf, pdf_text
from quire.translate.desk import Desk, Pace, Served
from quire.translate.stub import StubTranslator

CH1 = "<html><head><title>x</title></head><body><h1>Chapter One</h1><p>Hello world, this is the first chapter.</p><p>42</p></body></html>"
CH2 = "<html><body><p>Second chapter &amp; more text here.</p><ul><li>Item one</li><li>Item two</li></ul></body></html>"


def sample(ch2="text/ch2.xhtml", href=None, nav="nav.xhtml", ncx=False, container=True):
    points = '<navPoint><navLabel><text>Late</text></navLabel><content src="text/ch1.xhtml"/></navPoint><navPoint><navLabel><text>From NCX</text></navLabel><content src="text/ch2.xhtml#a"/></navPoint>'
    opf = f"""<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> Test Book </dc:title><dc:creator>Test Author</dc:creator></metadata>
<manifest><item id="nav" href="{nav}" properties="nav"/><item id="c1" href="text/ch1.xhtml"/><item id="c2" href="{href or ch2}"/><item id="cover" href="images/cover.png" media-type="image/png" properties="cover-image"/>{'<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if ncx else ''}</manifest>
<spine><itemref idref="c1"/><itemref idref="gone"/><itemref idref="c2"/></spine></package>"""
    links = '<a href="text/ch1.xhtml">One</a>' + ("" if ncx else '<a href="text/ch2.xhtml"> Two</a><a href="text/ch2.xhtml">Again</a>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        if container:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        z.writestr(f"OEBPS/{nav}", f"<html><body><nav>{links}</nav></body></html>")
        z.writestr("OEBPS/text/ch1.xhtml", CH1)
        z.writestr(f"OEBPS/{ch2}", CH2)
        z.writestr("OEBPS/images/cover.png", b"png")
        if ncx:
            z.writestr("OEBPS/toc.ncx", f"<ncx xmlns='u'><navMap>{points}</navMap></ncx>")
    return out.getvalue()


def names(content):
    return zipfile.ZipFile(io.BytesIO(content)).namelist()


def test_reading_a_book():
    book = epub.read_book(sample())
    assert (book.title, book.author) == ("Test Book", "Test Author")
    assert [d[:2] for d in book.docs] == [("OEBPS/text/ch1.xhtml", "One"), ("OEBPS/text/ch2.xhtml", "Two")]
    assert book.cover.startswith("data:image/png;base64,") and not book.warnings


def test_titles_come_from_the_package_folder_and_in_order():
    assert [d[1] for d in epub.read_book(sample(ncx=True)).docs] == ["One", "From NCX"]
    assert [d[1] for d in epub.read_book(sample(nav="sub/nav.xhtml")).docs] == ["One", "Two"]


def test_encoded_entry_names():
    book = epub.read_book(sample(ch2="text/ch%20two.xhtml"))
    assert not book.warnings and book.docs[1][0] == "OEBPS/text/ch two.xhtml"
    made, missed = epub.repack(sample(ch2="text/ch%20two.xhtml"), {"OEBPS/text/ch two.xhtml": "<p>new</p>"})
    assert missed == 0 and "OEBPS/text/ch%20two.xhtml" in names(made)
    assert epub.repack(sample(), {"nowhere.xhtml": "x"})[1] == 1
    lost = epub.read_book(sample(href="text/none.xhtml"))
    assert lost.warnings and len(lost.docs) == 1


def test_books_from_files_to_bilingual_books(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.epub").write_bytes(sample())
    (folder / "broken.epub").write_bytes(b"PK\x03\x04 not an archive")
    (folder / "other.epub").write_bytes(sample(container=False))
    (folder / "x.pdf").write_bytes(b"%PDF-1.7 x")
    (folder / "x.txt").write_bytes(b"text")
    files = binary.read_files(spark, f"file://{folder}")
    assert {r["file_name"]: r["format"] for r in files.collect()} == {"a.epub": "epub", "broken.epub": "epub", "other.epub": "epub", "x.pdf": "pdf", "x.txt": None}
    read = epub.books(files.where("format = 'epub'"))
    errors = {r["book"].rsplit("/", 1)[-1]: r["error"] for r in read.collect()}
    assert errors["a.epub"] is None and errors["broken.epub"] and errors["other.epub"]
    docs = epub.documents(read)
    keyed = docs.withColumn("key", F.concat_ws("|", "book", "path"))
    blocks = html_blocks.collect(keyed, "key").join(keyed.select("key", "book", "d", "path"), "key")
    assert blocks.where(~F.col("skipped")).count() == 5
    told = translate(blocks.select("book", "d", "b", "text", "skipped"), "x-lite")
    told = told.join(keyed.select("book", "d", "key"), ["book", "d"])
    rewritten = html_blocks.rewrite_docs(keyed, told, "bilingual", "key").join(keyed.select("key", "book", "path"), "key")
    out = epub.repacked(files, rewritten).collect()
    assert len(out) == 1 and out[0]["missed"] == 0 and names(out[0]["content"])[0] == "mimetype"
    page = zipfile.ZipFile(io.BytesIO(out[0]["content"])).read("OEBPS/text/ch1.xhtml").decode()
    assert '<p class="ebtr-translation">[MY] Hello world' in page and "[MY] 42" not in page
    only = html_blocks.rewrite_docs(keyed, told, "translated", "key").where(F.col("key").endswith("ch2.xhtml")).first()["html"]
    assert "<p>[MY] Second chapter &amp; more" in only and "<li>[MY] Item one</li>" in only
    saved = epub.save(epub.repacked(files, rewritten), f"file://{tmp_path}/out").collect()
    made = open(saved[0]["path"].removeprefix("file:"), "rb").read()
    assert saved[0]["path"].endswith("a.epub") and saved[0]["bytes"] == len(made) and epub.read_book(made).title == "Test Book"


def test_new_books_are_readable_and_the_same(spark):
    rows = [("k", "A & B", "Me", d, f"Part {d + 1}", b, f"text {d}{b} <x>", b == 2, None if b else f"told {d}") for d in range(2) for b in range(3)]
    df = spark.createDataFrame(rows, "book string, title string, author string, d long, chapter string, b long, text string, skipped boolean, translation string")
    one, two = (epub.built(df.repartition(n), "Chinese (Traditional)", "bilingual").first()["content"] for n in (1, 3))
    assert bytes(one) == bytes(two)
    book = epub.read_book(bytes(one))
    assert book.title == "A & B" and [d[1] for d in book.docs] == ["Part 1", "Part 2"]
    assert "<p>text 00 &lt;x&gt;</p>" in book.docs[0][2] and '<p class="ebtr-translation">told 0</p>' in book.docs[0][2]
    assert "zh-TW" in zipfile.ZipFile(io.BytesIO(bytes(one))).read("OEBPS/book.opf").decode()


def test_damaged_members_are_a_row_not_a_failed_job(spark):
    whole = sample()
    at = whole.index(b"OEBPS/text/ch2.xhtml") + 30
    bad = whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        start = next(i.header_offset for i in z.infolist() if i.filename.endswith("content.opf"))
    lost = whole[: start + 60] + b"#" + whole[start + 61 :]
    rows = spark.createDataFrame([("a", "a", bad), ("b", "b", lost), ("c", "c", whole[:200]), ("d", "d", None)], "book string, file_name string, content binary")
    out = {r["book"]: r for r in epub.books(rows).collect()}
    assert len(out["a"]["docs"]) == 1 and out["a"]["warnings"][0].startswith("damaged document") and out["a"]["error"] is None
    assert all(out[k]["error"] and not out[k]["docs"] for k in "bcd")
    new = spark.createDataFrame([(k, "OEBPS/text/ch1.xhtml", "x") for k in "ac"], "book string, path string, html string")
    packed = {r["book"]: r for r in epub.repacked(rows.select("book", "content"), new).collect()}
    assert packed["a"]["error"] and packed["c"]["error"] and packed["c"]["content"] is None


def test_pdf_reader_on_what_writers_do():
    pages = [["One line (a)", "é ß €"], [], ["last \\ one"]]
    raw = pdf_file("Tïtle", "Au(th)or", pages)
    assert pdf_text.read_pdf(raw) == ["One line (a)\né ß €", "", "last \\ one"] and pdf_text.describe(raw) == ("Tïtle", "Au(th)or")
    shifted = raw.replace(b"startxref\n", b"startxref\n9")
    assert pdf_text.read_pdf(shifted) == pdf_text.read_pdf(raw), "a broken table does no harm"
    assert pdf_text.describe(b"%PDF-1.4 nothing") == ("", "")
    for bad in (b"%PDF-1.4 nothing", raw + b"/Encrypt 5 0 R"):
        with pytest.raises(ValueError):
            pdf_text.read_pdf(bad)
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <01> <00410042> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<007a> <0079>] endbfrange"
    body = b"BT /F 9 Tf 1 0 0 1 50 700 Tm (\\001\\002) Tj [(\\003) -300 <04> 20 (\\005)] TJ 1 0 0 1 50 680 Tm (\\006) Tj ET BT /G 9 Tf (caf\\351 \\200) ' ET BI /W 1 ID (Tj EI BT /H 1 Tf <80> Tj ET"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents [4 0 R] /Resources << /Font << /F 5 0 R /G 7 0 R /H 8 0 R >> >> >>", b"<< >>\nstream\n" + body + b"\nendstream", b"<< /ToUnicode 6 0 R >>", b"<< >>\nstream\n" + cmap + b"\nendstream", b"<< /Subtype /Type1 >>", b"<< /Encoding << /Differences [ 128 /fi /Adieresis ] >> >>"]
    raw = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1))
    assert pdf_text.read_pdf(raw) == ["ABab cz\ny\ncafé €\nfi"]


def test_pdf_objects_in_streams():
    import zlib

    inner = [b"<< /Type /Catalog /Pages 11 0 R >>", b"<< /Type /Pages /Kids [12 0 R] >>", b"<< /Type /Page /Contents 1 0 R >>"]
    head, at = b"", 0
    for n, o in zip((10, 11, 12), inner):
        head += b"%d %d " % (n, at)
        at += len(o) + 1
    packed = zlib.compress(head + b" ".join(inner))
    raw = b"%%PDF-1.5\n1 0 obj\n<< /Length 99 >>\nstream\nBT (plain) Tj ET\nendstream\nendobj\n2 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    assert pdf_text.read_pdf(raw) == ["plain"]


def test_reader_chain(spark):
    files = spark.createDataFrame([("a", b"x"), ("b", b"")], "book string, content binary")

    def broken(content):
        raise RuntimeError("no program")

    rows = pdf.pages(files, [broken, lambda c: [" "], pdf.Reader("md", lambda c: ["# Head\n**x**"] if c else [], "markdown")]).collect()
    by = {r["book"]: r for r in rows}
    assert by["a"]["text"] == "Head\nx\n" and by["b"]["text"] is None and "broken: no program" in by["b"]["error"] and "md: no text" in by["b"]["error"]
    assert pdf.pages_of_dump("a\fb\f") == ["a", "b"] and pdf.pages_of_dump("") == [""]
    assert {r["error"] for r in pdf.pages(files, []).collect()} == {"no page reader is installed"}


def test_page_dumps_and_readers(spark):
    dumps = spark.createDataFrame([("a", "one\ftwo\f"), ("b", " \f ")], "book string, text string")
    pages = binary.pages_of_dumps(dumps)
    assert [(r["page"], r["text"]) for r in pages.where("book = 'a'").orderBy("page").collect()] == [(0, "one"), (1, "two")]
    other = spark.createDataFrame([("b", 0, "other"), ("a", 0, "no")], "book string, page int, text string")
    assert {(r["book"], r["text"]) for r in binary.first_readable([pages, other]).collect()} == {("a", "one"), ("a", "two"), ("b", "other")}
    raw = spark.createDataFrame([(b"\xfe\xff\x00a\x00b",), (b"plain",), (b"bad \xff",)], "r binary")
    assert [r[0] for r in raw.select(binary.pdf_string(F.col("r"))).collect()] == ["ab", "plain", "bad �"]


def test_logs(spark, tmp_path):
    path = f"file://{tmp_path}/resume"
    assert logs.read_resume(spark, path).count() == 0
    lines = [{"i": 0, "t": {"1": "old"}, "seq": 1}, {"i": 0, "t": {"1": "new", "x": "no"}, "seq": 2}, {"i": 1, "t": {}, "seq": 1}]
    spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{broken",)], "value string").write.text(path)
    logs.append_resume(spark.createDataFrame([(2, 1, "a"), (2, 2, "b"), (3, 1, "c"), (3, 2, None)], "i long, item long, t string"), path, 3)
    assert {(r["i"], r["item"], r["t"]) for r in logs.read_resume(spark, path).collect()} == {(0, 1, "new"), (2, 1, "a"), (2, 2, "b")}
    store = f"file://{tmp_path}/cache"
    put = lambda rows, seq: logs.append_cache(spark.createDataFrame(rows, "k string, t string"), store, seq)
    put([("k", "1"), ("q", "2")], 1)
    put([("k", "3"), ("q", "2")], 2)
    assert {(r["k"], r["t"]) for r in logs.read_cache(spark, store).collect()} == {("k", "3"), ("q", "2")}
    assert spark.read.text(store).count() == 3 and logs.cache_stats(spark, store).first()["entries"] == 2
    logs.clear_cache(spark, store)
    assert logs.read_cache(spark, store).count() == 0


def test_settings(spark, tmp_path):
    path = f"file://{tmp_path}/s/settings.json"
    assert logs.load_settings(spark, path) == logs.Settings()
    logs.save_settings(spark, logs.Settings(model="m"), path)
    assert logs.load_settings(spark, path).model == "m" and (tmp_path / "s" / "settings.json").stat().st_mode & 0o777 == 0o600
    logs.write_file(spark, path, "{broken")
    with pytest.raises(ValueError, match="broken"):
        logs.load_settings(spark, path)
    assert (tmp_path / "s" / "settings.broken").read_text() == "{broken" and logs.load_settings(spark, path) == logs.Settings()


def test_calls_halve_fall_back_and_stop():
    stub = StubTranslator()
    items = [(i, f"t{i}") for i in range(1, 8)]
    sent = []

    def small(model, part):
        sent.append((model, len(part)))
        return stub(model, part) if len(part) <= 2 else ("truncated", [], 0)

    told = call(small, Desk("gemini-3.5-flash-lite"), items)
    assert told.outcome == "done" and len(told.answers) == 7 and told.answers[3] == ("[MY] t3", "gemini-3.5-flash-lite")
    dry = lambda model, part: ("quota", [], 0) if model == "gemini-3.5-flash-lite" else stub(model, part)
    desk = Desk("gemini-3.5-flash-lite")
    assert {m for _, m in call(dry, desk, items).answers.values()} == {"gemini-3.1-flash-lite"} and desk.model() == "gemini-3.1-flash-lite"
    spent = call(lambda m, p: ("quota", [], 0), Desk("x"), items)
    assert spent.outcome == "fatal" and not spent.answers, "no model is left"
    assert call(lambda m, p: ("ok", [(1, "only")], 5), Desk("x"), items).outcome == "failed"
    assert call(lambda m, p: ("fatal", [], 0, "bad key"), Desk("x"), items) .error == "bad key"

    def counting(outcome):
        sent.clear()

        def one(model, part):
            sent.append(model)
            return outcome, [], 0

        return one

    assert call(counting("transient"), Desk("x"), items).outcome == "failed" and len(sent) == 5
    assert call(counting("failed"), Desk("x"), items).outcome == "failed" and len(sent) == 1, "a translator's own failure is final"
    bad = lambda model, part: ("truncated", [], 0) if any(t == "t5" for _, t in part) else stub(model, part)
    told = call(bad, Desk("x"), items)
    assert told.outcome == "failed" and sorted(told.answers) == [1, 2, 3, 4, 6, 7]


def test_workers_share_one_desk(spark, tmp_path):
    """Four tasks under one limiter: starts lie apart as if one had called; a batch that is kept is not called again."""
    rows = [("k", n, 0, n, -1, f"text {n}", None) for n in range(8)]
    df = spark.createDataFrame(rows, "book string, batch_id long, d long, b long, part int, text string, t string")
    desk = Desk("any", total=8)
    desk.paces["any"] = pace = Pace(600)
    served = Served(desk, "localhost")

    class Paced:
        desk = None

        def bind(self, desk):
            out = Paced()
            out.desk = desk
            return out

        def __call__(self, model, items):
            import time

            time.sleep(self.desk.book(model))
            with open(f"{tmp_path}/calls", "a") as f:
                f.write(f"{time.time()}\n")
            self.desk.sent(model)
            return "ok", [(i, t.upper()) for i, t in items], 7, ""

    try:
        out = answers(df, "any", Paced(), served.address, 4).collect()
        starts = sorted(map(float, open(f"{tmp_path}/calls").read().split()))
        assert len(starts) == 8 and starts[-1] - starts[0] > 0.6 and pace.gap == 0.1, "four limiters would take a quarter of that"
        assert {r["t"] for r in out} == {f"TEXT {n}" for n in range(8)} and desk.snapshot()["done"] == 8 and desk.snapshot()["tokens"] == 56 and len(desk.calls) == 8
        again = answers(df, "any", Paced(), served.address, 4).collect()
        assert len(open(f"{tmp_path}/calls").read().split()) == 8 and {r["t"] for r in again} == {r["t"] for r in out}
    finally:
        served.close()


def test_plan_needs_full_coverage(spark):
    blocks = spark.createDataFrame([("k", 0, i, f"line number {i}", False) for i in range(3)] + [("q", 0, 0, "other book", False)], "book string, d long, b long, text string, skipped boolean")
    log = spark.createDataFrame([("k", 0, 0, -1, "x"), ("k", 0, 1, -1, "y"), ("q", 0, 0, -1, "z")], "book string, d long, b long, part int, t string")
    rows = {(r["book"], r["b"]): (r["t"], r["resumed"]) for r in plan(blocks, "x-lite", None, log).collect()}
    assert rows == {("k", 0): ("x", False), ("k", 1): ("y", False), ("k", 2): (None, False), ("q", 0): ("z", True)}


def test_translation_uses_cache_resume_and_parts(spark):
    long = "many words here " * 1500
    rows = [("k", 0, 0, "hello there", False), ("k", 0, 1, "42", True), ("k", 0, 2, collapse_py(long), False), ("k", 1, 0, "cached line", False), ("k", 1, 1, "resumed line", False)]
    blocks = spark.createDataFrame(rows, "book string, d long, b long, text string, skipped boolean")
    cached = spark.createDataFrame([("cached line", "from cache")], "text string, t string")
    resumed = spark.createDataFrame([("k", 1, 1, -1, "from log")], "book string, d long, b long, part int, t string")
    out = {(r["d"], r["b"]): r["translation"] for r in translate(blocks, "x-lite", cache=cached, resumed=resumed).collect()}
    assert out[0, 0] == "[MY] hello there" and out[0, 1] is None and out[1, 0] == "from cache" and out[1, 1] == "from log"
    assert out[0, 2].count("[MY] ") > 1 and out[0, 2].replace("[MY] ", "") == collapse_py(long)
    assert bilingual_rows(translate(blocks, "x-lite")).count() == 9


def collapse_py(s):
    return " ".join(s.split())


def test_collapse_is_the_same_in_spark(spark):
    assert spark.createDataFrame([(" a  b ",)], "s string").select(collapse_ws(F.col("s"))).first()[0] == collapse_py(" a  b ")
