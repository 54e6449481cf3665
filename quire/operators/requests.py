"""Replies and errors of the model service: reading, classifying, falling back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import trim_ws

#: Models of a tier in the order of their turn.
FLASH = ["gemini-3.5-flash", "gemini-3.6-flash", "gemini-3.7-flash", "gemini-3.8-flash"]
LITE = ["gemini-3.5-flash-lite", "gemini-3.1-flash-lite"]

REPLY = "struct<status:string,steps:array<struct<type:string,content:array<struct<type:string,text:string>>>>,usage:struct<total_tokens:bigint>>"
_TRANSLATIONS = "array<struct<translations:array<struct<i:variant,t:variant>>>>"


def fallback_models(model: Column, exhausted: Column | None = None) -> Column:
    """Same-tier models after this one, going round, without exhausted ones; the whole tier for an unknown model."""

    def turn(tier: list[str]) -> Column:
        names = F.array(*[F.lit(m) for m in tier])
        at = F.array_position(names, model).cast("int")
        rest = F.concat(F.slice(names, at + 1, F.lit(len(tier))), F.slice(names, F.lit(1), F.greatest(at - 1, F.lit(0))))
        return F.when(at == 0, names).otherwise(rest)

    chain = F.when(model.contains("lite"), turn(LITE)).otherwise(turn(FLASH))
    return chain if exhausted is None else F.array_except(chain, exhausted)


def classify_429(message: Column, retry_after: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("per day") | low.contains("perday"), "daily_confirmed").when(retry_after > 600, "daily_suspected").otherwise("rate_limit")


def rate_limit_delay(hits: Column) -> Column:
    return F.least(hits * 5, F.lit(30)).cast("long")


def backoff_ms(attempt: Column, retry_after: Column) -> Column:
    """Milliseconds before the jitter of up to half a second."""
    return F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(120)) * 1000).otherwise(F.lit(1000) * F.pow(F.lit(2.0), F.least(attempt, F.lit(5)))).cast("long")


def http_class(status: Column, body: Column) -> Column:
    message = F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$[0].error.message"), F.lit("unknown API error"))
    bad_key = message.contains("API key not valid") | message.contains("API_KEY_INVALID")
    return (
        F.when(status.between(200, 299), "ok")
        .when(status == 429, "rate")
        .when((status == 408) | (status >= 500), "transient")
        .when(bad_key, "invalid_key")
        .when(status == 400, "rejected")
        .when(status.isin(401, 403), "unauthorized")
        .when(status == 404, "not_found")
        .otherwise("other")
    )


def output_complete(status: Column) -> Column:
    return F.coalesce(status, F.lit("completed")) == "completed"


def output_text(reply: Column) -> Column:
    """Text parts of the model's output steps put together; null where there are none."""
    steps = F.filter(reply["steps"], lambda s: s["type"] == "model_output")
    parts = F.flatten(F.transform(steps, lambda s: F.transform(F.filter(F.coalesce(s["content"], F.array()), lambda c: c["type"] == "text"), lambda c: c["text"])))
    out = F.array_join(parts, "")
    return F.when(out != "", out)


def parse_translations(text: Column) -> Column:
    """array<struct<i, t>> out of a reply, fenced or not; null if it is not that, is empty, or any item is broken."""
    body = trim_ws(text)
    fenced = body.startswith("```") & body.endswith("```") & (F.length(body) >= 6)
    inner = F.regexp_replace(F.regexp_replace(body.substr(F.lit(4), F.greatest(F.length(body) - 6, F.lit(0))), "^json", ""), "^[\r\n]+", "")
    # put in an array, so that anything behind the object makes it invalid
    rows = F.from_json(F.concat(F.lit("["), F.when(fenced, inner).otherwise(body), F.lit("]")), _TRANSLATIONS)
    got = F.when(F.size(rows) == 1, F.get(rows, F.lit(0))["translations"])
    typed = F.forall(got, lambda x: F.coalesce((F.schema_of_variant(x["i"]) == "BIGINT") & (F.schema_of_variant(x["t"]) == "STRING"), F.lit(False)))
    out = F.transform(got, lambda x: F.struct(F.try_variant_get(x["i"], "$", "bigint").alias("i"), F.try_variant_get(x["t"], "$", "string").alias("t")))
    return F.when((F.size(got) > 0) & typed & F.forall(out, lambda x: x["i"] >= 0), out)
