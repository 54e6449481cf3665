"""Entity references: six names and numbers, in one pass, at most ten bytes between & and ;."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names that are decoded; all others stay as they are.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}

_REFERENCE = re.compile(r"&(?:(amp|lt|gt|quot|apos|nbsp)|#[xX](\+?[0-9A-Fa-f]{1,8})|#(\+?[0-9]{1,9}));")


def _value(m: re.Match) -> str:
    if m[1]:
        return NAMED[m[1]]
    code = int(m[2], 16) if m[2] else int(m[3])
    ok = code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF
    return chr(code) if ok else m[0]


def unescape(text: str) -> str:
    return _REFERENCE.sub(_value, text) if "&" in text else text


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore")


def unescape_entities(text: Column) -> Column:
    return _unescape(text)
