"""Column expressions on text: whitespace, translatability, token estimates, entities, languages.

Whitespace and alphabetic mean the Unicode properties, as Java's regular expressions have them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space; unlike \\s it holds the no-break space.
WS = r"\p{IsWhite_Space}"


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse_ws(text: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def is_translatable(text: Column) -> Column:
    """At least two code points after trimming, one of them alphabetic."""
    return (F.char_length(trim_ws(text)) >= 2) & text.rlike(r"\p{IsAlphabetic}")


def lines(text: Column) -> Column:
    """Lines without their ends (LF or CRLF); a final line end opens no further line, an empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


# ---------------------------------------------------------------- tokens


def ascii_chars(text: Column) -> Column:
    """ASCII code points; where bytes and code points are as many, all are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.char_length(text)).otherwise(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))).cast("long")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the ASCII code points plus 10/23 of the others, each cut to a whole number."""
    sizes = F.struct(ascii_chars(text).alias("a"), F.char_length(text).cast("long").alias("n"))
    return once(sizes, lambda s: (F.floor(s["a"] / 4) + F.floor((s["n"] - s["a"]) * 10 / 23)).cast("long"))


#: Estimated input tokens a request takes, and requests a minute, by model family.
LITE_BUDGET, FULL_BUDGET, LITE_RPM, FULL_RPM = 5000, 10000, 500, 20


def token_budget(model: str) -> int:
    return LITE_BUDGET if "lite" in model else FULL_BUDGET


def preview_requests(chars: Column, model: str) -> Column:
    """A rough count of requests before anything is read; the estimate proper counts batches."""
    return F.ceil(chars / 2.3 / token_budget(model)).cast("long")


def model_rpm(model: Column) -> Column:
    return F.when(model.contains("lite"), LITE_RPM).otherwise(FULL_RPM)


# ---------------------------------------------------------------- markup


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_named(text: Column) -> Column:
    """The six named entities, each once (what `&amp;` gives is not read again)."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sibling_tag(tag: Column) -> Column:
    """The element that a translation beside a block of this tag goes into."""
    return F.when(tag.isin("li", "dt", "dd", "td"), tag).when(tag == "th", "td").otherwise("p")


def _unlink(line: Column) -> Column:
    """[text](url) to text."""
    return F.regexp_replace(line, r"\[([^\]]*)\]\([^)]*\)", "$1")


def strip_markdown(text: Column) -> Column:
    """Plain lines of light markdown: no fences, table rules, heading signs, emphasis, links, table bars.

    Blank lines stay; every line ends with a line feed.
    """

    def plain(t: Column) -> Column:
        x = trim_ws(F.regexp_replace(t, "^#+", ""))
        x = _unlink(x)
        for mark in ("**", "__", "*"):
            x = F.replace(x, F.lit(mark), F.lit(""))
        x = F.when(t.startswith("|"), F.replace(x, F.lit("|"), F.lit(" "))).otherwise(x)
        return F.concat(trim_ws(x), F.lit("\n"))

    rows = F.transform(lines(text), trim_ws)
    kept = F.filter(rows, lambda t: ~t.startswith("```") & ~(t.startswith("|") & t.contains("---")))
    return F.array_join(F.transform(kept, plain), "")


# ---------------------------------------------------------------- languages and labels

#: Part of a language's name -> its code; the first that fits holds.
LANGUAGE_CODES = [
    ("burmese", "my"),
    ("myanmar", "my"),
    ("english", "en"),
    ("chinese", "zh-CN"),
    ("japanese", "ja"),
    ("korean", "ko"),
    ("thai", "th"),
    ("vietnamese", "vi"),
    ("french", "fr"),
    ("german", "de"),
    ("spanish", "es"),
    ("hindi", "hi"),
    ("indonesian", "id"),
    ("arabic", "ar"),
    ("russian", "ru"),
]


def lang_code(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for part, code in LANGUAGE_CODES:
        value = F.when(low.contains("traditional"), "zh-TW").otherwise(code) if part == "chinese" else F.lit(code)
        out = F.when(low.contains(part), value) if out is None else out.when(low.contains(part), value)
    return out.otherwise("en")


def language_label(name: Column) -> Column:
    """A language's name without what stands in brackets."""
    return F.substring_index(name, " (", 1)


def _amount(n: Column, big: int, small: int, words: tuple[str, str, str]) -> Column:
    """One decimal in the large unit, whole numbers in the small one; halves go up."""
    tenths = F.floor((n * 10 + big // 2) / big)
    large = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(words[0]))
    return F.when(n >= big, large).when(n >= small, F.concat(F.floor((n + small // 2) / small).cast("string"), F.lit(words[1]))).otherwise(F.concat(n.cast("string"), F.lit(words[2])))


def format_chars(n: Column) -> Column:
    return _amount(n, 1_000_000, 1000, ("M chars", "k chars", " chars"))


def format_bytes(n: Column) -> Column:
    return _amount(n, 1_048_576, 1024, (" MB", " KB", " B"))


def safe_file_name(title: Column) -> Column:
    name = trim_ws(F.regexp_replace(title, r'[\\/:*?"<>|]', ""))
    return F.when(name == "", "book").otherwise(name)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done / total * 100 + 0.5).cast("long"))).otherwise(F.lit(0)).cast("long")
