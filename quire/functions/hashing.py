"""Content addresses of the translation cache and names of resume logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import token_budget, trim_ws

#: Part of every address: prompts of another version never meet.
PROMPT_VERSION = 2
MAX_ITEMS = 100


def _bytes(text: Column) -> Column:
    return text.cast("binary")


def cache_prefix(model: Column, language: Column, instructions: Column) -> Column:
    """16 hex digits for all that shapes an answer besides the text; instructions count trimmed, by 4 raw bytes of their digest."""
    zero = F.unhex(F.lit("00"))
    told = F.unhex(F.substring(F.sha2(_bytes(trim_ws(instructions)), 256), 1, 8))
    version = F.unhex(F.lit(f"{PROMPT_VERSION:02x}"))
    return F.substring(F.sha2(F.concat(_bytes(model), zero, _bytes(language), zero, told, version), 256), 1, 16)


def cache_key(prefix: Column, text: Column) -> Column:
    return F.sha2(F.concat(_bytes(prefix), F.unhex(F.lit("00")), _bytes(text)), 256)


def resume_key(content: Column, model: str, language: str, instructions: str) -> Column:
    """Name of a book's resume log; content is the book's bytes."""
    told = F.substring(F.sha2(_bytes(trim_ws(F.lit(instructions))), 256), 1, 8)
    parts = [F.sha2(content, 256), F.lit(model), F.lit(language), F.lit(str(token_budget(model))), F.lit(str(MAX_ITEMS)), told, F.lit(f"v{PROMPT_VERSION}")]
    return F.concat_ws("-", *parts)
