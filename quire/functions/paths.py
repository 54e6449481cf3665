"""Paths inside archives: percent coding, dot segments, names for display."""

from __future__ import annotations

from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_name(name: str) -> str:
    """Percent escapes decoded, bad ones kept, a plus sign kept, broken UTF-8 replaced."""
    return unquote_to_bytes(name).decode("utf-8", "replace")


def encode_name(name: str) -> str:
    return quote(name, safe="/-._~")


@F.pandas_udf(T.StringType())
def _decode(names: pd.Series) -> pd.Series:
    return names.map(decode_name, na_action="ignore")


@F.pandas_udf(T.StringType())
def _encode(names: pd.Series) -> pd.Series:
    return names.map(encode_name, na_action="ignore")


def percent_encode(name: Column) -> Column:
    """Bytes other than letters, digits and / - . _ ~ as escapes."""
    return _encode(name)


def percent_decode(name: Column) -> Column:
    """Spark's own function reads a plus sign as a space and fails on bad escapes, so this goes through Python in Arrow batches."""
    return _decode(name)


def resolve(path: Column) -> Column:
    """Segments without empty ones and dots; two dots take back the segment before."""
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def entry_key(name: Column) -> Column:
    return resolve(percent_decode(name))


def join_path(base: Column, path: Column) -> Column:
    """A decoded path below base, unless it is absolute or base is empty."""
    return F.when(path.startswith("/") | (base == ""), F.regexp_replace(path, "^/+", "")).otherwise(F.concat(base, F.lit("/"), path))


def normalize_path(base: Column, href: Column) -> Column:
    """An href relative to base as an archive entry's key; what follows # goes."""
    return resolve(join_path(base, percent_decode(F.substring_index(href, "#", 1))))


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def pretty_name(path: Column) -> Column:
    """A title out of a file's name."""
    stem = file_name(path)
    for end in ("xhtml", "html", "htm"):
        stem = F.regexp_replace(stem, rf"(\.{end})+$", "")
    return F.translate(stem, "_-", "  ")
