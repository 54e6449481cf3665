"""Page numbers as scans have them: digits with look-alikes, and strict roman numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import WS, once, trim_ws

#: Words that would read as page numbers.
NOT_PAGE_NUMBERS = ["di", "mi", "ci", "li", "mix", "lo", "yo", "jo", "ill", "oil", "oily", "lily", "joy", "lol", "loll", "jill", "yoyo"]
#: Characters that accompany a number, and letters read for digits.
NOISE = "*<>,.-–—"
LOOKS_LIKE = ("iIlLjJoOyY", "1111110077")

STRICT_ROMAN = "^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
_ROMAN = [("cm", 900), ("cd", 400), ("xc", 90), ("xl", 40), ("ix", 9), ("iv", 4), ("m", 1000), ("d", 500), ("c", 100), ("l", 50), ("x", 10), ("v", 5), ("i", 1)]


def roman_value(text: Column) -> Column:
    """The value of a strict lower-case roman numeral below 4000; null for anything else."""
    rest, total = text, F.lit(0)
    for sign, value in _ROMAN:
        less = F.replace(rest, F.lit(sign), F.lit(""))
        total = total + F.floor((F.length(rest) - F.length(less)) / len(sign)) * value
        rest = less
    return F.when(text.rlike(STRICT_ROMAN) & (text != ""), total.cast("long"))


def to_roman(n: Column) -> Column:
    digits = [("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")]
    parts = [F.repeat(F.lit("m"), F.floor(n / 1000).cast("int"))]
    for k, names in zip((100, 10, 1), digits, strict=True):
        parts.append(F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(n / k) % 10 + 1).cast("int")))
    return F.concat(*parts)


def is_numberish(token: Column) -> Column:
    """A token that reads as a page number, and is no word."""
    low = F.lower(token)
    with_digit = token.rlike(r"[0-9]") & token.rlike(r"^[0-9iIlLoOjJyY*<>,.\-–—]+$")
    mapped = F.translate(F.translate(token, NOISE, ""), *LOOKS_LIKE)
    misread = mapped.rlike("^[0-9]{2,4}$") & mapped.rlike("[1-9]")
    return ~low.isin(NOT_PAGE_NUMBERS) & (with_digit | misread | (low.rlike(STRICT_ROMAN) & (low != "")))


def is_page_number(line: Column) -> Column:
    """A line that is nothing but a page number, with page or p. before it and signs around it."""
    low = F.lower(trim_ws(line))
    core = F.regexp_replace(low, "^(page |page, |p\\. |p )", "")
    compact = F.regexp_replace(core, f"{WS}+", "")
    bare = lambda c: F.regexp_replace(c, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    return once(compact, lambda c: (F.char_length(c) <= 10) & once(bare(c), is_numberish))


def header_key(line: Column) -> Column:
    """Lower-cased words without up to two numberish ones at either end; null if none is left."""
    words = F.filter(F.split(line, f"{WS}+"), lambda t: t != "")
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

    def peel(a: Column, first: Column, second: Column) -> Column:
        return F.when(is_numberish(first), F.when(is_numberish(second), 2).otherwise(1)).otherwise(0)

    head = F.transform(F.array(words), lambda a: F.slice(a, peel(a, at(a, F.lit(0)), at(a, F.lit(1))) + 1, F.greatest(F.size(a), F.lit(1))))
    both = F.transform(head, lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - peel(a, at(a, F.size(a) - 1), at(a, F.size(a) - 2)), F.lit(0))))
    key = F.lower(F.array_join(F.get(both, F.lit(0)), " "))
    return F.when(key != "", key)
