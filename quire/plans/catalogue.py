"""Registered queries by name. Their SQL is in quire.plans.oracle.

All run over whole tables; a limit stands only where it is the feature (samples, log tails).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import numerals, paths, text
from quire.functions.hashing import cache_key, cache_prefix
from quire.operators import batching, cache, html_blocks, pages, progress, requests
from quire.plans import books, books_sql, oracle, tables
from quire.streaming import quota
from quire.translate import stub

MODEL, LANGUAGE, INSTRUCTIONS = "gemini-3.5-flash-lite", "Burmese", "  keep names  "


def q01_translatable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    turns = tables.read(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    rows = docs.unionByName(turns)
    return rows.select("origin", "id", "part", F.length("text").cast("long").alias("chars"), text.is_translatable(F.col("text")).alias("translatable"))


def q02_segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.blocks(spark, sf_dir).where(~F.col("skipped"))
    return rows.rollup("book", "d").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text").cast("long")).alias("chars"))


def q03_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.collect(tables.read(spark, sf_dir, "pages").select(F.col("page_id").alias("d"), "html"))


def _batched(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return batching.build_batches(batching.items_of(tables.blocks(spark, sf_dir), model), model)


def q04_batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batch_totals(_batched(spark, sf_dir))


def q05_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.estimate_tokens(F.col("text"))
    docs = tables.read(spark, sf_dir, "documents")
    return docs.select("doc_id", tokens.alias("tokens"), (tokens > text.LITE_BUDGET).alias("over_lite"), (tokens > text.FULL_BUDGET).alias("over_full"))


def q05b_split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    parts = batching.split_oversized(docs, text.LITE_BUDGET).where("part is not null")
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), F.col("n_parts").cast("long").alias("n_parts"), F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def q06_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run answered what users said; every turn is looked up."""
    turns = tables.read(spark, sf_dir, "conversations")
    prefix = cache_prefix(F.lit(MODEL), F.lit(LANGUAGE), F.lit(INSTRUCTIONS))
    known = turns.where("role = 'user'").select(cache_key(prefix, F.col("text")).alias("k"), stub.answer(F.col("text")).alias("t")).distinct()
    found = cache.lookup(cache.with_keys(turns, prefix), known)
    return found.select("conv_id", "turn", "k", F.col("t").isNotNull().alias("hit"))


def q07_pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would still send for each book: an earlier one stopped after every book's first batch, and English lines are cached."""
    prefix = cache_prefix(F.lit(MODEL), F.lit(LANGUAGE), F.lit(INSTRUCTIONS))
    items = cache.with_keys(batching.items_of(tables.blocks(spark, sf_dir), MODEL), prefix).drop("text")
    known = items.where(F.col("book").endswith("/en")).select("k", F.lit("").alias("t")).distinct()
    hits = cache.lookup(items, known).withColumn("hit", F.col("t").isNotNull())
    batched = batching.build_batches(hits, MODEL, keep=("hit",))
    # the log of a job that stopped after its first batch names that batch of every book
    resumed = tables.books(spark, sf_dir).withColumn("batch_id", F.lit(0).cast("long"))
    return cache.pending(batched, resumed)


def _turn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.read(spark, sf_dir, "conversations")
    rows = text.lines(F.col("text"))
    parts = turns.select("conv_id", "turn", F.size(rows).alias("n_parts"), F.posexplode(rows).alias("part", "line"))
    return parts.withColumn("t", F.when(text.is_translatable(F.col("line")), stub.answer(F.col("line"))))


def q08_part_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's lines are its parts; one that has no answer leaves the turn without a translation."""
    return progress.join_parts(_turn_parts(spark, sf_dir), ["conv_id", "turn"])


def q08b_segment_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", (~text.is_translatable(F.col("text"))).alias("skipped"))
    done = q08_part_join(spark, sf_dir)
    return progress.segments(turns.join(done, ["conv_id", "turn"], "left"), ["conv_id"])


def q09_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as a job: purchases stand for batches that failed, errors and sign-ups for a fatal one and a cancelled job."""
    day = quota.quota_day(F.col("ts")).alias("day")
    jobs = tables.read(spark, sf_dir, "events").groupBy("user_id", day).agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("event_type") == "purchase").alias("failed"), F.bool_or(F.col("event_type") == "error").alias("fatal"), F.bool_or(F.col("event_type") == "signup").alias("cancelled"))
    return jobs.select("user_id", "day", "batches", "failed", progress.job_status(F.col("fatal"), F.col("cancelled"), F.col("failed"), F.col("batches")).alias("status"))


def q10_sample_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batch_totals(batching.first_items(_batched(spark, sf_dir)))


def q11_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages as they are, and once more with a blank line after every line that ends a sentence."""
    rows = tables.pages(spark, sf_dir)
    spaced = rows.withColumns({"text": F.replace("text", F.lit(".\n"), F.lit(".\n\n")), "spaced": F.lit(True)})
    return pages.paragraphs(rows.withColumn("spaced", F.lit(False)).unionByName(spaced), ["page", "spaced"])


def q12_path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's address as an href below its host, with steps back; titles come from addresses that others share."""
    rows = tables.read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1).alias("base"), F.regexp_extract("url", r"^[a-z]+://[^/]*/?(.*)$", 1).alias("href"))
    rows = rows.withColumn("href", F.concat(F.lit("text/../././"), F.split_part("href", F.lit("?"), F.lit(1))))
    return rows.select("page_id", paths.normalize_path(F.col("base"), F.col("href")).alias("entry"), paths.entry_key(F.concat(F.lit("/../"), F.col("href"))).alias("key"))


def q12b_toc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries take the first label that a table of contents has for them, else a name made from the file's.

    The tables hold no contents: a benchmark item's first sentence stands in for a label.
    """
    entry = q12_path_normalize(spark, sf_dir)
    toc = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"), F.substring_index("text", ".", 1).alias("label"))
    labels = entry.join(toc, "page_id").groupBy("entry").agg(F.min_by("label", "page_id").alias("label"))
    return entry.join(labels, "entry", "left").select("page_id", "entry", F.coalesce("label", paths.pretty_name(F.col("entry"))).alias("title"))


def q13_header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.header_counts(tables.pages(spark, sf_dir))


def q13b_strip_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pages.strip_furniture(tables.pages(spark, sf_dir))
    return done.select("book", "page", "stripped", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def q14_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 4000).select(F.col("id").alias("n"), numerals.to_roman(F.col("id")).alias("roman"))
    return rows.select("n", "roman", numerals.roman_value(F.col("roman")).alias("value"), numerals.roman_value(F.concat("roman", F.lit("i"))).alias("with_i"))


def q15_page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = tables.blocks(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("line")).unionByName(tables.blocks(spark, sf_dir).select(F.col("text").alias("line")))
    return said.distinct().select("line", numerals.is_page_number(F.col("line")).alias("is_number"))


def q16_quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.usage(tables.read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("model"), (F.col("value") > 90).alias("exhausted")))


def q17_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.pages(spark, sf_dir)
    paras = pages.paragraphs(rows, ["book", "page"])
    done = pages.chapters(paras, "book", ["page", "paragraph"])
    return done.groupBy("book", "chapter", "chapter_id", "title").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("chars").alias("chars"))


def q18_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*requests.FLASH, *requests.LITE, "custom-lite", "custom"]
    rows = spark.createDataFrame([(m, d) for m in names for d in ("", requests.FLASH[1], requests.LITE[0])], "model string, dead string")
    chain = requests.fallback_models(F.col("model"), F.array("dead"))
    return rows.select("model", "dead", F.array_join(chain, ",").alias("chain"), F.get(chain, F.lit(0)).alias("next_model"))


def q19_strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark and document texts dressed as markdown, and flattened again."""
    docs = tables.read(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    items = tables.read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")
    dressed = F.concat(F.lit("# A **head**\n\n|a|b|\n|---|---|\n```\n"), F.replace("text", F.lit(". "), F.lit(".* [see __this__](x/y) ")), F.lit("\n```\n"))
    return docs.unionByName(items).select("origin", "id", F.sha2(text.strip_markdown(dressed).cast("binary"), 256).alias("digest"))


def q20_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a model's reply: fenced for assistants, broken for system turns."""
    turns = tables.read(spark, sf_dir, "conversations")
    items = F.to_json(F.struct(F.array(F.struct(F.col("turn").alias("i"), F.col("text").alias("t"))).alias("translations")))
    reply = F.when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), items, F.lit("\n```"))).when(F.col("role") == "system", F.concat(items, F.lit("}{"))).otherwise(items)
    got = requests.parse_translations(reply)
    return turns.select("conv_id", "turn", got.isNotNull().alias("accepted"), F.get(got, F.lit(0))["i"].alias("i"), F.length(F.get(got, F.lit(0))["t"]).cast("long").alias("chars"))


def q21_output_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies: the props number gives the status, and a step of another type beside the model's."""
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("completed")).otherwise("incomplete")
    part = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    steps = F.array(F.struct(F.lit("thought").alias("type"), F.array(part("text", F.lit("no"))).alias("content")), F.struct(F.lit("model_output").alias("type"), F.array(part("text", F.col("event_type")), part("image", F.lit("no")), part("text", k.cast("string"))).alias("content")))
    rows = tables.read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(status.alias("status"), steps.alias("steps"))).alias("body"))
    reply = rows.withColumn("r", F.from_json("body", requests.REPLY))
    return reply.select("event_id", requests.output_complete(F.col("r.status")).alias("complete"), requests.output_text(F.col("r")).alias("said"))


def q22_http_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = [200, 204, 400, 401, 403, 404, 408, 409, 429, 500, 503]
    said = ["resource exhausted", "Quota 'RequestsPerMinute' exceeded", "GenerateRequestsPerDayPerModel", "limit: 200 requests per day", "API key not valid. Please pass", "API_KEY_INVALID"]
    waits = [None, 1, 600, 601, 1800]
    rows = spark.createDataFrame([(c, m, w, n) for c in codes for m in said for w in waits for n in (False, True)], "status int, message string, retry_after long, in_array boolean")
    error = F.to_json(F.struct(F.struct("message").alias("error")))
    body = F.when(F.col("in_array"), F.concat(F.lit("["), error, F.lit("]"))).otherwise(error)
    kind = F.when(F.col("status") == 429, requests.classify_429(F.col("message"), F.col("retry_after"))).otherwise(requests.http_class(F.col("status"), body))
    return rows.select("status", "message", "retry_after", "in_array", kind.alias("kind"), requests.backoff_ms(F.lit(3), F.col("retry_after")).alias("wait_ms"))


def q23_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "pages")
    once = text.escape_html(F.col("html"))
    back = text.unescape_named(F.col("html"))
    return rows.select("page_id", F.sha2(once.cast("binary"), 256).alias("escaped"), F.sha2(back.cast("binary"), 256).alias("unescaped"), (text.unescape_named(once) == F.col("html")).alias("reversible"))


def q24_collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    odd = F.concat(F.lit("  \t"), F.replace("text", F.lit(". "), F.lit(".   \n")), F.lit("　"))
    return docs.select("doc_id", F.sha2(text.collapse_ws(odd).cast("binary"), 256).alias("digest"))


def q25_lang_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Burmese (မြန်မာ)", "Myanmar", "English", "Chinese (Traditional)", "Chinese (Simplified)", "Japanese", "Korean", "Thai", "Vietnamese", "French", "German", "Spanish", "Hindi", "Indonesian", "Arabic", "Russian", "Klingon", ""]
    rows = spark.createDataFrame([(n,) for n in names], "language string")
    spoken = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "English (US)", "de", "German", "fr", "French", "es", "Spanish")]), F.col("lang"))
    docs = tables.read(spark, sf_dir, "documents").select(spoken.alias("language")).distinct()
    return rows.unionByName(docs).select("language", text.lang_code(F.col("language")).alias("code"), text.language_label(F.col("language")).alias("label"))


def q26_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, percentages and file names as shown. The tables hold no book titles: a text's first 12 characters and marks that file names must not have stand in for one."""
    docs = tables.read(spark, sf_dir, "documents")
    n, size = F.col("n_chars"), F.octet_length("text").cast("long") * 97
    done = F.length(F.regexp_replace("text", "[^a-z]", "")).cast("long")
    title = F.concat(F.substring("text", 1, 12), F.lit(': "a/b"?'))
    return docs.select("doc_id", text.format_chars(n * 37).alias("chars"), text.format_bytes(size).alias("bytes"), text.safe_file_name(title).alias("file_name"), text.percent(done, n).alias("percent"))


def q26b_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 41 lines of the log."""
    return tables.read(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(41)


def q27_end_to_end_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books through items, batches, the stub translator, joined parts and bilingual output."""
    from quire.plans.job import bilingual_rows, translate

    turns = tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book"), F.lit(0).cast("long").alias("d"), F.col("turn").alias("b"), text.collapse_ws(F.col("text")).alias("text"))
    blocks = turns.withColumn("skipped", ~text.is_translatable(F.col("text")))
    return bilingual_rows(translate(blocks, MODEL))


def q28_layout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each book by what becomes of them, and its longest one."""
    rows = tables.blocks(spark, sf_dir)
    over = ~F.col("skipped") & (text.estimate_tokens(F.col("text")) > text.LITE_BUDGET)
    return rows.groupBy("book").agg(F.count_if(~F.col("skipped")).alias("translatable"), F.count_if("skipped").alias("skipped"), F.count_if(over).alias("split_blocks"), F.max(F.length("text").cast("long")).alias("longest"))


def q29_usage_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = q16_quota_usage(spark, sf_dir)
    reset = F.date_format(F.timestamp_seconds("reset_at"), "HH:mm")
    return used.select("day", "model", progress.usage_line(F.col("requests"), F.col("exhausted"), reset).alias("line"))


QUERIES = {name: fn for name, fn in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()} | books.QUERIES
ORACLE_SQL = {**oracle.ORACLE_SQL, **books_sql.SQL}
