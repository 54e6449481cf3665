"""Operators 1, 2, 4 and 10."""

import gzip
import hashlib
import io
import re
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F


# ---------------------------------------------------------------- 1: HTML


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain &amp; &copy; text", "plain & © text"),
        ("<p>One<p>Two  <b>bold<p>Three", "One\n\nTwo bold\n\nThree"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>z", "- a\n- b\n  3. x\n  4. y\n- c\n\nz"),
        ("<table><tr><th>Name<th>N<tr><td>alpha beta<td>1<tr><td colspan=2>wide</table>", "Name       | N\nalpha beta | 1\nwide"),
        ("<table><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<div hidden>no</div><div style='display : none'>no</div><span aria-x>yes</span><script>var a='</p>';</script>", "yes"),
        ("<style>.x, #y {display:none} p.z{visibility:hidden}</style><p class='a x'>no<p id=y>no<p class=z>no<div class=z>yes</div>", "yes"),
        ("<head><title>no</title></head><body>yes<noscript>no</noscript>", "yes"),
        ("<pre>\n a\n\n   b</pre>c", " a\n\n   b\n\nc"),
        ("a<br>b<br><br>c<hr>d", "a\nb\n\nc\nd"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<dl><dt>k<dd>v<dd>w</dl>", "k\n  v\n  w"),
        ("x <!-- no --> y <!doctype html> z </i></div></p>", "x y z"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("1 < 2 <notatag", "1 < 2"),
        ("<a title='x > y'>t</a>", "t"),
    ],
)
def test_html_rendering(source, want):
    from quire.llm.html_text import visible_text

    assert visible_text(source) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<html><head><title>T</title><h1>A</h1><p>text", "A\n\ntext"),
        ("<head><meta charset=x><link href=y>plain text<p>more", "plain text\n\nmore"),
        ("<html><head>\n<script>var a</script>\n<noscript><img></noscript><template><p>no</template><div>a</div><body>b", "a\nb"),
        ("<head><title>T</title></head><p>a<head><p>b", "a\n\nb"),
        ("<title>T</title><p>a<head><style>p{}</style> b", "a b"),
        ("<head></br>a", "a"),
    ],
)
def test_html_head_ends_where_content_begins(source, want):
    from quire.llm.html_text import visible_text

    assert visible_text(source).strip() == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<a href=/x title=don't>Hello</a><p>more", "Hello\n\nmore"),
        ("<table><tr><td width=5\">Hello</td><td class=\"x\">b</table>", "Hello | b"),
        ("<a 'x>one</a> <b\">two</b>", "one two"),
        ("<a title = \"x > y\" alt='>' hidden=>no</a>yes", "yes"),
        ("<a title='a'class=\"b>c\"id=d>t</a>", "t"),
        ("<p =x='>'>t</p title='>'>u", "t\n\nu"),
        ("<i " + "a='" * 50_000 + ">end", "end"),
        ("<i " + "a b= " * 50_000 + ">end", "end"),
    ],
)
def test_html_quotes_open_values_only(source, want):
    from quire.llm.html_text import visible_text

    assert visible_text(source) == want


def test_html_attributes_are_read_as_tokenized():
    from quire.llm.html_text import Node

    assert Node("a", " href=/x title=don't a=\"b>c\"d e = 'f' g= h/ =i=j style=x/").attributes() == {"href": "/x", "title": "don't", "a": "b>c", "d": "", "e": "f", "g": "h/", "=i": "j", "style": "x/"}


HIDE = "<style>%s</style><p class='nav x' id=i>a</p><div class=y><b>b</b></div>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (HIDE % "@media print{.nav,.no-print{display:none}}", "a\n\nb"),
        (HIDE % "@media (max-width: 600px){.nav{display:none} .y{display:none}}", "a\n\nb"),
        (HIDE % "@media screen and (min-width:600px){.nav{display:none}}", "b"),
        (HIDE % "@media not print{.nav{display:none}} @media (width<40em){.y{display:none}} @media(100px <= width){b{color:red}}", "b"),
        (HIDE % "@supports (display:grid){@media all{.nav{display:none}}} @font-face{src:url('}')} .y{content:'}'}", "b"),
        (HIDE % ".nav{display:none} .x{display:block}", "a\n\nb"),
        (HIDE % ".x{display:block} .nav{display:none}", "b"),
        (HIDE % "#i{display:block} .nav{display:none}", "a\n\nb"),
        (HIDE % "#i{display:block} .nav{display:none!important}", "b"),
        (HIDE % "p.nav.x{display:block} p{display:none} .y > b{display:none} .z b{display:block}", "a"),
        (HIDE % "div p{display:none} html .y b{visibility:hidden} p:hover{display:none} [class~=nav]:not(p){display:none}", "a"),
        (HIDE % ".nav{x-display:none; content:'display:none'} .y{display:nonsense}", "a\n\nb"),
        ("<style media=print>p{display:none}</style><p>a", "a"),
        ("<style>p{display:none}</style><p style='display:block'>a<p>b<p hidden style='display:flex'>c", "a\n\nc"),
        ("<div style='visibility:hidden'>no<p>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<style>.h{visibility:hidden}.s{visibility:visible}</style><table><tr class=h><td>no<td class=s>yes</table><ol class=h><li>a<li class=s>b</ol>", "     | yes\n\n2. b"),
        ("E <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> f", "E x= 1 2 f"),
        ("a<svg width=1><title>no</title><defs><text>no</text></defs>no<path d='x'/><g><text x=1>one<tspan>two</tspan></text><text visibility=hidden>no</text></g></svg>b", "a onetwo b"),
        ("<svg><path d=M/><a href=/x/><text>t</text></a><path d='M'/><p>after", "t\n\nafter"),
    ],
)
def test_html_visibility(source, want):
    from quire.llm.html_text import visible_text

    assert visible_text(source).split() == want.split() and visible_text(source).strip("\n").count("\n") == want.count("\n")


def test_html_wide_cells_keep_columns_aligned():
    from quire.llm.html_text import visible_text

    long, word = " ".join(f"word{i}" for i in range(40)), "x" * 64
    lines = visible_text(f"<table><tr><td>a<td>{long}<td>end<tr><td>b<td>{word}<td>z<tr><td>c<td>d<td>{long}</table>").split("\n")
    assert {ln.index(" | ", 3) for ln in lines if ln.count(" | ") == 2} == {4 + 64} and lines[-1].endswith(long)
    assert [w for ln in lines[:-2] for w in ln.replace("|", " ").split()] == ["a", *(w := long.split())[: (n := lines[0].split(" | ")[1].count("word"))], "end", *w[n:]]
    assert word in lines[-2] and lines[-2].endswith("| z")


def test_html_padding_stays_in_proportion():
    from quire.llm.html_text import visible_text

    page = "<table><tr><td>" + "x" * 100_000 + "<td>b" + "<tr><td>a<td>b" * 5000 + "</table>"
    assert len(visible_text(page)) < 10 * len(page)
    page = "<table><tr>" + "<td>a" * 3000 + "<td>" + "w " * 50_000 + "<td>b" + "<tr><td>c" * 3000 + "</table>"
    assert len(visible_text(page)) < 100 * len(page)


def test_html_spans_and_depth():
    from quire.llm.html_text import visible_text

    rows = "<table><tr><td rowspan=300>s<td>0" + "".join(f"<tr><td>{i}" for i in range(1, 302)) + "</table>"
    lines = visible_text(rows).split("\n")
    assert lines[299] == "    | 299" and lines[300] == "300" and lines[301] == "301"
    assert visible_text("<table><tr><td colspan=500>a<td>b<tr>" + "<td>c" * 500 + "<td>d</table>").split("\n")[0].split()[-1] == "b"
    wide = visible_text("<table><tr><td colspan=500>a<td>b<tr>" + "<td>c" * 500 + "<td>d</table>").split("\n")
    assert wide[0].index("b") == wide[1].index("d")
    assert visible_text("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>") == "a | b\n  | c\nd"
    deep = "<font>" * 3000
    assert visible_text(deep + "<div hidden>no</div><ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>long<td>z</table>") == "- a\n- b\n\nx    | y\nlong | z"
    assert visible_text("<table><tr><td>" * 2000 + "in" + "</table>" * 2000 + "out").split() == ["in", "out"]
    assert visible_text("<p><table><td>" + "<font>" * 100_000 + "<hr>" * 100_000 + "t") == "t"
    assert len(visible_text("<blockquote>x" * 3000)) < 3000 * 600


def test_html_odd_pages(spark):
    from quire.llm.html_text import extract, visible_text

    rows = [(1, None, "x"), (2, "", "x"), (3, "<p>a", "x"), (3, "<p>a", "x"), (None, "b", "x"), (4, "<div>" * 5000 + "deep", "x"), (5, "<table>" * 200 + "<td>cell", "x"), (6, "<p>" + "w " * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extract(df).collect()), key=str)
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    by = {i: t for i, t, _ in got}
    assert by[1] == by[2] == "" and by[3] == "a" and by[None] == "b" and by[4] == "deep" and by[5] == "cell" and len(by[6]) == 399_999
    assert extract(df.limit(0)).count() == 0
    words = lambda s: re.findall(r"\w+", s)
    assert words(visible_text("<article><h1>T</h1>a<p>b<ul><li>c</ul>d<table><tr><td>e</table>f")) == list("Tabcdef")


# ---------------------------------------------------------------- 2: chat


def test_chat_trees_rank_and_format(spark):
    from quire.llm import chat

    rows = [
        ("t", 1, None, "user", "root", 1.0),
        ("t", 2, 1, "assistant", "low", 0.0),
        ("t", 3, 1, "assistant", "high", 5.0),
        ("t", 4, 3, "user", "more", 5.0),
        ("t", 5, 3, "user", "less", 1.0),
        ("u", 1, 99, "user", None, None),
        ("u", 1, 99, "user", None, None),
        ("c", 1, 2, "user", "cycle", 0.0),
        ("c", 2, 1, "user", "cycle", 0.0),
        (None, 7, None, None, "[INST] </s> \\e ]", 0.0),
        ("v", None, None, "user", "nameless", 0.0),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "tree string, node long, parent long, role string, text string, score double, leaf string, at int")
    out = {(r["tree"], r["rank"]): r for r in chat.format_trees(df, top=2).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("lost", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in out.items()}
    assert turns["t", 1] == [("user", "root"), ("assistant", "high"), ("user", "more")]
    assert turns["t", 2] == [("user", "root"), ("assistant", "high"), ("user", "less")]
    assert turns["u", 1] == [("user", "")] and turns[None, 1] == [("", "[INST] </s> \\e ]")]
    assert set(out) == {("t", 1), ("t", 2), ("u", 1), (None, 1)}
    assert out["t", 1]["lost"] == "high" and out["t", 1]["formatted"].startswith("<s>[user] root[/user]</s><s>[assistant] high")
    everything = chat.format_trees(df, top=None)
    assert everything.where("tree = 't'").count() == 3
    assert chat.format_trees(df.limit(0)).count() == 0


def test_chat_long_chain(spark):
    from quire.llm import chat

    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}", "x") for i in range(700)] + [(1, 5, "user", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    done = chat.format_trees(chat.chain(df, "conv_id", ["turn"], "role", "text")).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert len(done) == 1
    want = [(r[2], r[3]) for r in sorted(rows, key=lambda r: (r[1], r[2], r[3]))]
    assert [(t["role"], t["text"]) for t in done[0]["turns"]] == want


# ---------------------------------------------------------------- 4: media


def _png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def _zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


SAMPLES = {
    "png": _png(),
    "jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x01\xff\x00\x02\xff\xd9",
    "gif": b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"\x2c" + bytes(8) + b"\x00\x02\x02\x44\x01\x00\x3b",
    "bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0",
    "pdf": b"%PDF-1.4\nx\nstartxref\n0\n%%EOF",
    "zip": _zip(),
    "gzip": gzip.compress(b"x" * 1000),
    "flac": b"fLaC\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8ab",
    "ogg": b"OggS\x00\x06" + bytes(20) + b"\x01\x03abc",
    "mp4": struct.pack(">I", 12) + b"ftypisom" + struct.pack(">I", 8) + b"moov",
    "webp": b"RIFF" + struct.pack("<I", 4 + 8 + 2) + b"WEBPVP8 " + struct.pack("<I", 2) + b"ab",
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_media_formats_validate_and_break(kind):
    from quire.llm.media import Sniffer

    sniff, raw = Sniffer(), SAMPLES[kind]
    assert sniff(raw)[:2] == (kind, len(raw))
    broken = raw[:-1] if kind not in ("pdf", "flac") else raw[:-6]
    assert sniff(broken)[0] is None
    got = sniff(b"junk" + raw + (b"" if kind == "flac" else b"tail"))
    assert got[0] is None and got[2][0] == (kind, 4, len(raw))


def _crc(data, poly, bits):
    c = 0
    for x in data:
        c ^= x << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return c


def _flac_bytes(frames, total):
    """16-bit stereo, 192 samples a frame: a fixed subframe with Rice codes, and a constant one for the side."""
    out = b"fLaC\x80\x00\x00\x22" + struct.pack(">HH", 192, 192) + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | total).to_bytes(8, "big") + bytes(16)
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x88, k])
        head += bytes([_crc(head, 7, 8)])
        rice = "".join("0" * ((i * 7 + k) % 5) + "1" + format(i % 8, "03b") for i in range(191))
        sub = "0" + "001001" + "0" + format(k, "016b") + "00" + "0000" + "0011" + rice
        sub += "0" + "000000" + "0" + format(k, "017b")
        sub += "0" * (-len(sub) % 8)
        frame = head + int(sub, 2).to_bytes(len(sub) // 8, "big")
        out += frame + struct.pack(">H", _crc(frame, 0x8005, 16))
    return out


@pytest.mark.parametrize("total", [0, 192 * 4])
def test_media_flac_ends_with_its_last_frame(total):
    from quire.llm.media import Sniffer

    sniff, flac, png = Sniffer(), _flac_bytes(4, total), SAMPLES["png"]
    assert sniff(flac)[:2] == ("flac", len(flac))
    kind, n, carved = sniff(flac + png + flac + b"tail")
    assert (kind, n) == ("flac", len(flac)) and carved == [("png", len(flac), len(png)), ("flac", len(flac) + len(png), len(flac))]
    assert sniff(b"junk" + flac + flac + b"x")[2] == [("flac", 4, len(flac)), ("flac", 4 + len(flac), len(flac))]
    one = (len(flac) - 42) // 4
    cut = flac[:-1] + png
    assert sniff(cut)[1] in range(len(flac) - one - 8, len(flac) - one + 8) and [k for k, *_ in sniff(cut)[2]] == ["png"]
    hurt = bytearray(flac)
    hurt[42 + one + 30] ^= 1
    assert sniff(bytes(hurt) + png)[1] == len(flac) or not total
    assert sniff(SAMPLES["flac"] + png)[:2] == ("flac", len(SAMPLES["flac"])) and sniff(b"j" + SAMPLES["flac"] + png)[2] == [("flac", 1, len(SAMPLES["flac"])), ("png", 1 + len(SAMPLES["flac"]), len(png))]


def test_media_ogg_and_mp4_end_by_themselves():
    from quire.llm.media import Sniffer

    page = lambda flag, serial: b"OggS\x00" + bytes([flag]) + bytes(8) + bytes([serial]) + bytes(11) + b"\x01\x03abc"
    ogg = page(2, 1) + page(2, 2) + page(0, 1) + page(4, 1) + page(0, 2) + page(4, 2)
    sniff, mp4, png = Sniffer(), SAMPLES["mp4"], SAMPLES["png"]
    assert sniff(ogg + png)[1] == len(ogg) and sniff(b"junk" + ogg + png)[2] == [("ogg", 4, len(ogg)), ("png", 4 + len(ogg), len(png))]
    assert sniff(mp4 + mp4 + png)[1:] == (len(mp4), [("mp4", len(mp4), len(mp4)), ("png", 2 * len(mp4), len(png))])


def test_media_inspection_table(spark):
    from quire.llm.media import inspect, to_wav

    inner = b"text" + SAMPLES["png"] + b"more" + SAMPLES["gzip"] + b"end"
    rows = [(1, inner, "image/gif"), (2, SAMPLES["png"], "image/jpeg"), (2, SAMPLES["png"], "image/jpeg"), (3, None, None), (4, b"", "image/png"), (5, b"BM just text", "text/plain"), (None, to_wav(inner), None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "media_id long, media binary, declared string, feature string")
    out = sorted(inspect(df).collect(), key=lambda r: str(r["media_id"]))
    by = {r["media_id"]: r for r in out}
    assert len(out) == len(rows)
    assert [(c["media_type"], c["offset"], c["length"]) for c in by[1]["carved"]] == [("image/png", 4, len(SAMPLES["png"])), ("application/gzip", 8 + len(SAMPLES["png"]), len(SAMPLES["gzip"]))]
    assert by[1]["carved"][0]["sha256"] == hashlib.sha256(SAMPLES["png"]).hexdigest()
    assert by[1]["media_type"] == "application/octet-stream" and by[2]["media_type"] == "image/png" and by[2]["corrected"]
    assert by[3]["media_bytes"] == 0 and by[4]["media_type"] == "application/octet-stream" and by[5]["media_type"] == "text/plain" and not by[5]["corrected"]
    assert by[None]["media_type"] == "audio/wav" and by[None]["n_bytes"] == len(inner) and len(by[None]["carved"]) == 2


def test_media_round_trip_of_texts(spark):
    from quire.llm.media import inspect, store

    texts = {1: None, 2: "", 3: "é" * 31 + "ab", 4: "x" * 64, 5: "y" * 65, 6: "\0tail\0", 7: "BM RIFF PK\x03\x04 %PDF-1.", 8: "long " * 100_000}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(3, texts[3], 1)], "doc_id long, text string, media int")
    out = inspect(store(df)).collect()
    assert len(out) == 9
    for r in out:
        raw = (texts[r["media_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert inspect(store(df.limit(0))).count() == 0


# ---------------------------------------------------------------- 10: URLs

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def _rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "http://", "://x", "http://EXAMPLE.com/en/7?x=1", "https://a.example.com/en/71", "https://com/en/", "http://notexample.com/en/8", "http://b.example.net/de/8#y", "http://example.net/de/7", "x://w.org/es/", "x://w.org/es", "http://é.ORG/es/ü?a://b", "http://h?q/en/", "http://h#f", "a://b://c", "http://com", "http://x.com/EN/", "http://" + "a" * 100_000 + ".com/en/", "http://u\nv.net/de/\nx"]


def test_url_rules_and_parts(spark):
    from quire.llm import urls

    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(5, URLS[5], "x", 1), (None, None, None, None)], "page_id long, url string, host string, score int")
    empty = urls.train(df.select("url", F.lit(None).cast("int").alias("label")))
    rows = urls.judge(df, empty).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path = _parts(URLS[r["page_id"]] if r["page_id"] is not None else None)
        rule, verdict = _rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), r["page_id"]
    again = {r["page_id"]: (r["rule"], r["rule_verdict"]) for r in urls._joined(df.select("page_id", urls.host_of("url").alias("host"), urls.path_of("url").alias("path")), urls.DEFAULT_RULES).collect()}
    assert all(again[r["page_id"]][0] == r["rule"] for r in rows)
    assert urls.judge(df.limit(0), empty).count() == 0


def test_url_trees_learn_and_score_in_sql(spark):
    from quire.llm import urls

    rows = [(f"http://site{i % 7}.example.com/a/{'9' * (i % 13)}?p={i}" if i % 3 == 0 else f"http://quiet{i % 5}.example.org/about", int(i % 3 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    model = urls.train(labelled)
    assert urls.train(labelled) == model, "the same sample, the same trees"
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    out = urls.judge(pages, model, rules=[]).collect()
    assert sum((r["verdict"] == "block") == bool(rows[r["page_id"]][1]) for r in out) >= 395
    plan = urls.judge(pages, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

    def walk(node, x):
        while not isinstance(node, float):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node

    names = list(urls.features(F.col("url"), F.col("host"), F.col("path"), F.lit(0.0)))
    feats = pages.select("page_id", "url", urls.host_of("url").alias("host"), urls.path_of("url").alias("path"))
    cols = urls.features(F.col("url"), F.col("host"), F.col("path"), model.suffix_rate(F.col("host")))
    by = {r["page_id"]: {n: r[n] for n in names} for r in feats.select("page_id", *[c.alias(n) for n, c in cols.items()]).collect()}
    for r in out[:50]:
        z = model.bias + sum(walk(t, by[r["page_id"]]) for t in model.trees)
        assert abs(r["score"] - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9


def test_url_suffixes_all_count(spark):
    """300 registered domains that look alike, a third of them bad throughout, and one URL with very many copies."""
    from quire.llm import urls

    name = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:10]
    bad = {i for i in range(300) if hashlib.md5(f"bad{i}".encode()).digest()[0] % 3 == 0}
    page = lambda i, k: f"http://www.{name(i)}.com/page/{100 + k}"
    rows = [(page(i, k), int(i in bad)) for i in range(300) for k in range(30)] + [("http://hot.example.org/", 0)] * 3000
    labelled = spark.createDataFrame(rows, "url string, label int")
    model = urls.train(labelled, max_rows=3000)
    rates = {r["suffix"]: r["suffix_rate"] for r in model.rates.collect()}
    prior = (30 * len(bad) + 1) / (len(rows) + 2)
    assert len(rates) == 301 and model.prior == prior
    assert all(abs(rates[f"{name(i)}.com"] - (30 * (i in bad) + 10 * prior) / 40) < 1e-12 for i in range(300))
    pages = spark.createDataFrame([(i, page(i, 50)) for i in range(300)] + [(1000, "http://www.unheard.com/page/7")] * 2, "page_id long, url string")
    out = urls.judge(pages, model, rules=[])
    got = out.collect()
    assert len(got) == 302 and all((r["verdict"] == "block") == (r["page_id"] in bad) for r in got if r["page_id"] < 300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_copies_do_not_fill_the_sample(spark):
    from quire.llm import urls

    rows = [(f"http://a.example.com/{'x' * (i % 40)}/{i}?q=1", 1) for i in range(100)] + [(f"http://a.example.com/{i}", 0) for i in range(100)]
    hot = [("http://b.example.org/", 0)] * 5000
    model = urls.train(spark.createDataFrame(rows + hot, "url string, label int"), max_rows=201)
    out = urls.judge(spark.createDataFrame(list(enumerate(u for u, _ in rows)), "page_id long, url string"), model, rules=[]).collect()
    assert sum((r["verdict"] == "block") == bool(rows[r["page_id"]][1]) for r in out) == 200


@pytest.mark.parametrize("unit", [b"%PDF-1.4 ", b"PK\x03\x04", b"GIF89a!\x01\x01\x01", b"OggS\x00" + bytes(22), b"\xff\xd8\xff\xda\x00\x02", b"fLaC", b"\0\0\0\x10mdat\0\0\0\x0cftyp", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x1f\0", b"BM"])
def test_media_many_magics_cost_one_walk(unit):
    from quire.llm.media import Sniffer

    sniff, took = Sniffer(), []
    for n in (100_000, 800_000):
        raw = b"\x01" + unit * (n // len(unit))
        start = time.perf_counter()
        sniff(raw)
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0] + 0.5, "eight times the bytes, about eight times the time"


def test_media_gzip_headers_and_trailers():
    from quire.llm.media import Bytes, _gzip

    plain = gzip.compress(b"some words " * 9000)
    named = plain[:3] + b"\x1a" + plain[4:10] + b"name.txt\0"
    named += b"said\0"
    whole = named + struct.pack("<H", zlib.crc32(named) & 0xFFFF) + plain[10:]
    assert _gzip(Bytes(whole + b"tail"), 0) == len(whole) and gzip.decompress(whole) == b"some words " * 9000
    for broken in (whole[:-1], whole[:3] + b"\xfa" + whole[4:], whole[:-8] + bytes(8), named + b"\0\0" + plain[10:], b"\x1f\x8b\x08"):
        assert _gzip(Bytes(broken), 0) == 0


def test_media_ids_of_any_type(spark):
    from quire.llm.media import inspect, store

    rows = [("a-1", "x"), ("a-1", "x"), (None, None), ("", "")]
    out = inspect(store(spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id string, text string, media_id int, media binary"))).collect()
    assert sorted(str(r["media_id"]) for r in out) == ["", "None", "a-1", "a-1"]
    assert {r["n_bytes"] for r in out if r["media_id"] == "a-1"} == {1} and len({r["media_sha256"] for r in out}) == 2
