import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import hashing, numerals, paths, text
from quire.functions.entities import unescape, unescape_entities
from quire.operators import requests


def one(spark, value, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"v {kind}").select(expr(F.col("v"))).collect()]


def test_tokens_truncate_twice(spark):
    assert one(spark, ["Hello world, this is fine.", "မ" * 17, "", "abc", "é" * 3 + "abc"], text.estimate_tokens) == [6, 7, 0, 0, 1]
    assert text.token_budget("x-lite") == 5000 and text.token_budget("x") == 10000


def test_translatable_is_unicode_alphabetic(spark):
    cases = {"ok": True, "x": False, "42": False, "ာာ": True, "Ⅳ!": True, "Ⓐ.": True, "၁၂": False, "  a  ": False, " a1 ": True, "": False, "  ": False}
    assert one(spark, list(cases), text.is_translatable) == list(cases.values())


def test_whitespace(spark):
    assert one(spark, ["  a  b\t\nc　"], text.collapse_ws) == ["a b c"]
    assert one(spark, ["  a  "], text.trim_ws) == ["a"]
    assert one(spark, ["a\r\nb\n", "", "a", "\n", "a\n\nb"], text.lines) == [["a", "b"], [], ["a"], [""], ["a", "", "b"]]


def test_entities(spark):
    cases = {"a &amp; b &#65;&#x42;": "a & b AB", "&copy; &middot;": "&copy; &middot;", "&amp;lt;": "&lt;", "&nbsp;": " ", "&#xD800;": "&#xD800;", "&#1114112;": "&#1114112;", "&;&&lt;": "&;&<", "&#x0000000041;": "&#x0000000041;"}
    for a, b in cases.items():
        assert unescape(a) == b
    assert one(spark, list(cases), unescape_entities) == list(cases.values())
    assert one(spark, ['&<>"\''], text.escape_html) == ["&amp;&lt;&gt;&quot;'"]


@given(st.text(alphabet="&<>\"'a;#x"))
@settings(max_examples=200, deadline=None)
def test_unescape_reverses_escape(s):
    from quire.operators.html_blocks import escape

    assert unescape(escape(s)) == s


def test_markdown(spark):
    md = "# Title\n\nSee the [license](http://x) for **details**.\n|a|b|\n|---|---|\n```\ncode\n```\n__x__ *y*"
    out = one(spark, [md], text.strip_markdown)[0]
    assert not any(c in out for c in "[|#`") and "---" not in out
    assert out == "Title\n\nSee the license for details.\na b\ncode\nx y\n"


def test_languages_and_labels(spark):
    cases = {"Burmese (မြန်မာ)": "my", "Chinese (Traditional)": "zh-TW", "chinese": "zh-CN", "Klingon": "en", "French": "fr"}
    assert one(spark, list(cases), text.lang_code) == list(cases.values())
    assert one(spark, ["Burmese (x)"], text.language_label) == ["Burmese"]
    assert one(spark, [999, 1500, 2_499, 1_250_000], text.format_chars, "long") == ["999 chars", "2k chars", "2k chars", "1.3M chars"]
    assert one(spark, [1023, 1536, 1_572_864], text.format_bytes, "long") == ["1023 B", "2 KB", "1.5 MB"]
    assert one(spark, ['a/b:"c"?', ' <>| '], text.safe_file_name) == ["abc", "book"]
    assert one(spark, ["p", "li", "th", "td", "h1", "dd"], text.sibling_tag) == ["p", "li", "td", "td", "p", "dd"]


def test_numberish(spark):
    no = "civil mill mid did mix jolly zoo joy oil lily ill lol".split()
    yes = "xiv mmxxvi xvii i6 2o 3* j6 6y ioo IOI I0 16 iv".split()
    assert one(spark, no + yes, numerals.is_numberish) == [False] * len(no) + [True] * len(yes)
    assert one(spark, ["iiv", "", "iv", "mmmcmxcix", "mmmm", "dix"], numerals.roman_value) == [None, None, 4, 3999, None, 509]
    lines = ["12", "- 13 -", "[14]", "Page 15", "xvi", " p. 16 ", "2o", "i6", "Chapter", "12345678901", "page", "of 3"]
    assert one(spark, lines, numerals.is_page_number) == [True] * 8 + [False] * 4
    keys = ["22 Early Buddhist Theory of Knowledge", "Early Buddhist Theory of Knowledge 4 i", "<5  Foreword", "12 13", "1 2 3 w", "1 2 3 x", ""]
    assert one(spark, keys, numerals.header_key) == ["early buddhist theory of knowledge", "early buddhist theory of knowledge", "foreword", None, "3 w", None, None]


def test_roman_numbers_round_trip(spark):
    rows = spark.range(1, 4000).select("id", numerals.roman_value(numerals.to_roman(F.col("id"))).alias("v"))
    assert rows.where("v is null or v <> id").count() == 0


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [("OEBPS", "text/ch1.xhtml", "OEBPS/text/ch1.xhtml"), ("OEBPS", "../cover.jpeg", "cover.jpeg"), ("OEBPS", "/mimetype", "mimetype"), ("", "a%20b.xhtml", "a b.xhtml"), ("d", "ch1.xhtml#frag", "d/ch1.xhtml"), ("d", "a+b%zz%2", "d/a+b%zz%2")],
)
def test_paths(spark, base, href, want):
    from quire.sources.epub import join_href

    df = spark.createDataFrame([(base, href)], "base string, href string")
    assert df.select(paths.normalize_path(F.col("base"), F.col("href"))).first()[0] == want == join_href(base, href)


def test_names(spark):
    assert one(spark, ["a/b_c-d.xhtml", "x.htm", "y"], paths.pretty_name) == ["b c d", "x", "y"]
    assert one(spark, ["a/b/c", "c"], paths.dir_of) == ["a/b", ""]
    assert one(spark, ["text/ch%20one.xhtml", "./a//../b"], paths.entry_key) == ["text/ch one.xhtml", "b"]
    assert paths.encode_name("a b/é-._~") == "a%20b/%C3%A9-._~"


def test_cache_addresses(spark):
    import hashlib

    told = hashlib.sha256(b"be brief").digest()[:4]
    want = hashlib.sha256(b"m\0Burmese\0" + told + b"\x02").hexdigest()[:16]
    df = spark.createDataFrame([(" be brief \n", "text")], "i string, t string")
    prefix = hashing.cache_prefix(F.lit("m"), F.lit("Burmese"), F.col("i"))
    row = df.select(prefix.alias("p"), hashing.cache_key(prefix, F.col("t")).alias("k")).first()
    assert row["p"] == want and row["k"] == hashlib.sha256(want.encode() + b"\0text").hexdigest()
    same = lambda i: df.select(hashing.cache_prefix(F.lit("m"), F.lit("x"), F.lit(i))).first()[0]
    assert same("  ") == same("") != same("a")
    key = df.select(hashing.resume_key(F.lit(b"book"), "x-lite", "Thai", " a ")).first()[0]
    assert key == "-".join([hashlib.sha256(b"book").hexdigest(), "x-lite", "Thai", "5000", "100", hashlib.sha256(b"a").hexdigest()[:8], "v2"])


def test_replies(spark):
    good = '{"translations":[{"i":1,"t":"a"},{"i":2,"t":"b"}]}'
    cases = {good: 2, f"```json\n{good}\n```": 2, f"```{good}```": 2, good + "}": None, '{"translations":[]}': None, '{"translations":[{"i":1}]}': None, '{"translations":[{"i":1,"t":5}]}': None, '{"translations":[{"i":"1","t":"a"}]}': None, "no": None, '{"x":1}': None}
    assert one(spark, list(cases), lambda c: F.when(requests.parse_translations(c).isNotNull(), F.size(requests.parse_translations(c)))) == list(cases.values())
    body = '{"steps":[{"type":"thought","content":[{"type":"text","text":"no"}]},{"type":"model_output","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]},{"type":"model_output"}]}'
    rows = spark.createDataFrame([(body,), ('{"status":"incomplete","steps":[]}',)], "b string").withColumn("r", F.from_json("b", requests.REPLY))
    got = rows.select(requests.output_text(F.col("r")).alias("t"), requests.output_complete(F.col("r.status")).alias("c")).collect()
    assert [(r["t"], r["c"]) for r in got] == [("ab", True), (None, False)]


def test_rate_limits(spark):
    rows = spark.createDataFrame([("x PerMinute", 30), ("resource exhausted", None), ("PerDay", 1), ("200 requests per day", None), ("resource exhausted", 1800)], "m string, s long")
    assert [r[0] for r in rows.select(requests.classify_429(F.col("m"), F.col("s"))).collect()] == ["rate_limit", "rate_limit", "daily_confirmed", "daily_confirmed", "daily_suspected"]
    assert one(spark, [1, 5, 9], requests.rate_limit_delay, "long") == [5, 25, 30]
    assert one(spark, [1, 5, 9], lambda c: requests.backoff_ms(c, F.lit(None).cast("long")), "long") == [2000, 32000, 32000]
    flash = requests.FLASH
    assert one(spark, [flash[0], flash[2], requests.LITE[0], "my-lite", "my"], lambda c: requests.fallback_models(c)) == [flash[1:], [flash[3], flash[0], flash[1]], [requests.LITE[1]], requests.LITE, flash]
