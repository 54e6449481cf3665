"""Registered queries of books, files, logs and jobs. Their SQL is in quire.plans.books_sql.

Files and logs are made of the driver's tables (quire.plans.samples), written where executors can read
them, and read back by the engine's own sources.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import entities, paths, text
from quire.functions.hashing import cache_key, cache_prefix, resume_key
from quire.operators import batching, html_blocks, pages, progress, requests
from quire.plans import job, samples, tables
from quire.shared import shared_dir, table
from quire.sources import binary, epub, logs, pdf
from quire.streaming import quota
from quire.translate import stub
from quire.translate.client import request_body
from quire.translate.desk import Desk, Served

MODEL, LANGUAGE, INSTRUCTIONS = "gemini-3.5-flash-lite", "Burmese", "  keep names  "


def _digest(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quire/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- files and books


def q30_file_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind the magic of a zip, of a PDF file, of neither, and magic alone."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("504B0304", "255044462D", "504B0506", "", "2550")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = docs.select("doc_id", F.concat(head, F.when(F.col("doc_id") % 3 > 0, F.col("raw")).otherwise(F.unhex(F.lit("")))).alias("content"))
    return rows.select("doc_id", F.octet_length("content").cast("long").alias("bytes"), binary.sniff(F.col("content")).alias("format"))


def _books_of(content: DataFrame) -> DataFrame:
    return epub.books(content.select("book", F.concat("book", F.lit(".epub")).alias("file_name"), "content"))


def _blocks_of(read: DataFrame) -> DataFrame:
    """(book, d, path, chapter, b, tag, text) of read books."""
    docs = epub.documents(read).withColumn("key", F.concat_ws("|", "book", "d"))
    return html_blocks.collect(docs, "key").join(docs.select("key", "book", "d", "path", F.col("title").alias("chapter")), "key").drop("key")


def _said(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, blocks, digest): blocks of each document, and the digest of their texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("b", "text"))), lambda x: x["text"])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), _digest(F.array_join(texts, "\n")).alias("digest"))


def q31_new_book_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes written as fresh books and read again."""
    made = epub.built(samples.volumes(spark, sf_dir).withColumn("translation", F.lit(None).cast("string")), "Thai", "translated")
    read = table(_books_of(made), "books")
    docs = epub.documents(read).join(read.select("book", F.col("title").alias("book_title"), "author"), "book")
    said = _said(_blocks_of(read), "book", "d")
    return docs.select("book", "book_title", "author", "d", "path", F.col("title").alias("chapter")).join(said, ["book", "d"], "left").select("book", "book_title", "author", "d", "path", "chapter", F.coalesce("blocks", F.lit(0)).alias("blocks"), "digest")


def q32_rewritten_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes as books whose documents are rewritten with the stub's translations, packed again and read again."""
    made = table(epub.built(samples.volumes(spark, sf_dir).withColumn("translation", F.lit(None).cast("string")), "Thai", "translated"), "made")
    read = table(_books_of(made), "books")
    docs = epub.documents(read).withColumn("key", F.concat_ws("|", "book", "d"))
    told = _blocks_of(read).withColumn("skipped", ~text.is_translatable(F.col("text"))).withColumns({"translation": stub.answer(F.col("text")), "key": F.concat_ws("|", "book", "d")})
    out = None
    for mode in ("bilingual", "translated"):
        pages_ = html_blocks.rewrite_docs(docs, told, mode, "key").join(docs.select("key", "book", "path"), "key")
        packed = table(epub.repacked(made, pages_), "packed")
        again = table(_books_of(packed), "again")
        styled = epub.documents(again).select("book", "d", F.col("html").contains(html_blocks.STYLE).alias("styled"))
        rows = _said(_blocks_of(again), "book", "d").join(styled, ["book", "d"]).join(packed.select("book", "missed"), "book").withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def q33_awkward_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded entry names, lost documents, two tables of contents, a cover named by metadata."""
    read = table(epub.books(samples.awkward_books(spark, sf_dir)), "awkward")
    said = _said(_blocks_of(read), "book", "d")
    about = read.select("book", F.col("title").alias("book_title"), F.size("warnings").cast("long").alias("warnings"), _digest(F.col("cover")).alias("cover"))
    return epub.documents(read).select("book", "d", "path", "title").join(said, ["book", "d"]).join(about, "book").drop("blocks")


def q33b_damaged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives cut short, no archives, and whole ones: an error each, never a failed job."""
    whole = samples.awkward_books(spark, sf_dir).withColumn("k", F.split_part("book", F.lit("-"), F.lit(2)).cast("int") % 3)
    cut = F.when(F.col("k") == 0, F.col("content")).when(F.col("k") == 1, F.substring("content", 1, F.floor(F.octet_length("content") / 2).cast("int"))).otherwise(F.unhex(F.lit("504B0304")))
    read = epub.books(whole.select("book", "file_name", cut.alias("content")))
    return read.select("book", F.size("docs").cast("long").alias("docs"), F.col("error").isNotNull().alias("failed"))


def q34_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes as PDF files, read page by page by the built-in reader, with what the files say of themselves."""
    files = table(samples.pdf_volumes(spark, sf_dir), "pdf")
    return pdf.pages(files, pdf.READERS).join(pdf.metadata(files), "book").select("book", F.col("page").cast("long").alias("page"), _digest(F.col("text")).alias("digest"), "title", "author", "error")


def q35_form_feed_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader chain: one that fails, one that finds no text, one that gives a dump with form feeds."""

    def failing(content: bytes) -> list[str]:
        raise RuntimeError("no such program")

    chain = [failing, lambda content: [" ", "\n"], pdf.Reader("dump", lambda content: content.decode(), "dump")]
    rows = pdf.pages(samples.dumps(spark, sf_dir), chain)
    return rows.select("book", F.col("page").cast("long").alias("page"), _digest(F.col("text")).alias("digest"), "error")


def q35b_dump_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dumps as a table of texts, cut at form feeds; books whose dump is blank come from another reader."""
    made = samples.dumps(spark, sf_dir)
    blank = F.col("book").endswith("/0")
    first = binary.pages_of_dumps(made.select("book", F.when(blank, " \f\n\f").otherwise(F.col("text")).alias("text")))
    second = made.select("book", F.lit(0).alias("page"), F.lit("from another reader").alias("text"))
    rows = binary.first_readable([first, second])
    return rows.select("book", F.col("page").cast("long").alias("page"), _digest(F.col("text")).alias("digest"))


def q36_markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that gives pages of markdown; they come out plain."""
    docs = tables.read(spark, sf_dir, "documents")
    dressed = F.concat(F.lit("# A **head**\n\n|a|b|\n|---|---|\n```\n"), F.replace("text", F.lit(". "), F.lit(".* [see __this__](x/y) ")), F.lit("\n```\n"))
    files = docs.select(F.col("doc_id").cast("string").alias("book"), dressed.cast("binary").alias("content"))
    rows = pdf.pages(files, [pdf.Reader("inspector", lambda content: [content.decode()], "markdown")])
    return rows.select(F.col("book").cast("long").alias("id"), _digest(F.col("text")).alias("digest"))


def q37_pdf_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF strings: wide behind their mark, or plain bytes."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).otherwise(F.col("text").cast("binary"))
    return docs.select("doc_id", _digest(binary.pdf_string(raw)).alias("digest"))


# ---------------------------------------------------------------- logs, settings, usage


def q38_resume_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten benchmark items, logged twice, the second time with other answers; every fourth then without any, and broken lines."""
    folder = f"{_folder(spark)}/jobs"
    items = tables.read(spark, sf_dir, "benchmark").select((F.floor(F.col("item_id") / 10)).alias("batch_id"), (F.col("item_id") % 10).alias("b"), "text")
    for seq, said in ((1, F.lit("old")), (2, F.col("text"))):
        entry = F.struct(F.lit(0).cast("long").alias("d"), "b", F.lit(-1).alias("part"), said.alias("t"), F.lit(MODEL).alias("model"))
        batch = items.groupBy("batch_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
        empty = (F.col("batch_id") % 4 == 3) & F.lit(seq == 2)
        lines = batch.select(F.lit("key").alias("key"), "batch_id", F.when(empty, F.slice("items", 1, 0)).otherwise(F.col("items")).alias("items"), F.lit(seq).alias("seq"))
        lines.select(F.to_json(F.struct("*")).alias("value")).unionByName(batch.select(F.lit('{"key": "key", "batch_id": 0, "items": [').alias("value"))).write.mode("append").text(folder)
    return logs.read_batches(spark, folder).select("key", "batch_id", "b", F.col("part").cast("long").alias("part"), _digest(F.col("t")).alias("digest"))


def q39_cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation cache after two rounds of answers, of which the second changes some; entries counted, then cleared."""
    path = f"{_folder(spark)}/cache"
    prefix = cache_prefix(F.lit(MODEL), F.lit(LANGUAGE), F.lit(INSTRUCTIONS))
    keyed = tables.read(spark, sf_dir, "conversations").select(cache_key(prefix, F.col("text")).alias("k"), "text", "role").dropDuplicates(["k"])
    logs.append_cache(keyed.select("k", stub.answer(F.col("text")).alias("t")), path, 1)
    logs.append_cache(keyed.where(F.col("k") < "8").select("k", F.concat(F.lit("again "), "text").alias("t")), path, 2)
    logs.append_cache(keyed.where(F.col("k") >= "8").select("k", stub.answer(F.col("text")).alias("t")), path, 3)
    rows = table(logs.read_cache(spark, path).crossJoin(F.broadcast(logs.cache_stats(spark, path).select("entries"))), "cache")
    logs.clear_cache(spark, path)
    left = logs.read_cache(spark, path).count()
    return rows.select("k", _digest(F.col("t")).alias("digest"), "entries", F.lit(left).cast("long").alias("after_clearing"))


def q40_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings where the file is absent, as saved, with a field missing, and broken."""
    folder = _folder(spark)
    rows = []

    def load(case: str) -> None:
        try:
            s = logs.load_settings(spark, f"{folder}/settings.json")
            rows.append((case, s.model, s.mode, s.custom_instructions, s.auto_switch_model))
        except ValueError:
            rows.append((case, None, None, None, None))

    load("absent")
    logs.save_settings(spark, logs.Settings(api_key="k", model="m", mode="translated", custom_instructions="ä\n", auto_switch_model=False), f"{folder}/settings.json")
    load("saved")
    logs.write_file(spark, f"{folder}/settings.json", '{"model": "other", "unknown": 1}')
    load("partial")
    logs.write_file(spark, f"{folder}/settings.json", "{broken")
    load("broken")
    load("after broken")
    return spark.createDataFrame(rows, "moment string, model string, mode string, instructions string, switches boolean")


def q41_usage_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage as of the last event: older quota days are forgotten."""
    events = tables.read(spark, sf_dir, "events")
    used = quota.usage(events.select("ts", F.col("event_type").alias("model"), (F.col("value") > 90).alias("exhausted")))
    last = events.agg(F.max("ts").alias("now"))
    return quota.current(used.crossJoin(F.broadcast(last)), F.col("now")).drop("now")


def q41b_usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream in tumbling windows of a quota day."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = _folder(spark)
    rows = spark.readStream.schema(schema).parquet(path.replace("events.parquet", "events.parque[t]"))
    used = quota.usage_stream(rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), (F.col("value") > 90).alias("exhausted")), "36500 days")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    used.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def q42_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 15).select(F.col("id").alias("n")).crossJoin(spark.createDataFrame([(m,) for m in (MODEL, "gemini-3.6-flash", "other")], "model string"))
    budget = F.when(F.col("model") == MODEL, text.token_budget(MODEL)).when(F.col("model") == "other", text.token_budget("other")).otherwise(text.token_budget("gemini-3.6-flash"))
    return rows.select("n", "model", requests.rate_limit_delay(F.col("n")).alias("pause"), requests.backoff_ms(F.col("n"), F.lit(None).cast("int")).alias("backoff"), text.model_rpm(F.col("model")).cast("long").alias("rpm"), budget.cast("long").alias("budget"))


# ---------------------------------------------------------------- jobs


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, d, b, text, skipped): a conversation is a book, a turn a block."""
    rows = tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book"), F.lit(0).cast("long").alias("d"), F.col("turn").alias("b"), text.collapse_ws(F.col("text")).alias("text"))
    return rows.withColumn("skipped", ~text.is_translatable(F.col("text")))


def q43_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three workers at one desk, and a service that cuts off replies to texts with an ß: halves, single failures, counters."""
    rows = table(job.plan(_turns(spark, sf_dir), MODEL), "plan")
    desk = Desk(MODEL, total=rows.select("book", "batch_id").distinct().count())
    served = Served(desk, spark.conf.get("spark.driver.host", "localhost"))
    try:
        told = table(job.answers(rows, MODEL, samples.Moody("ß"), served.address, job.PARALLEL_CALLS), "answers")
    finally:
        served.close()
    now = desk.snapshot()
    out = told.select(F.col("book").cast("long").alias("conv_id"), F.col("b").alias("turn"), F.col("t").isNotNull().alias("answered"), "model", "outcome")
    return out.withColumns({"batches": F.lit(now["total"]).cast("long"), "done": F.lit(now["done"]).cast("long"), "failed": F.lit(now["failed"]).cast("long"), "error": F.lit(now["error"])})


def q44_job_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job knows when it starts: a log of every third conversation and of half of every other, and a cache of users' texts."""
    turns = _turns(spark, sf_dir)
    log = turns.where("book % 3 = 0 or (book % 3 = 1 and b % 2 = 0)").select("book", "d", "b", F.lit(-1).alias("part"), F.lit("logged").alias("t"))
    known = tables.read(spark, sf_dir, "conversations").where("role = 'user'").select(text.collapse_ws(F.col("text")).alias("text")).distinct().withColumn("t", F.lit("cached"))
    rows = job.plan(turns, MODEL, known, log)
    have = F.col("t").isNotNull()
    return rows.groupBy(F.col("book").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("t") == "logged").alias("logged"), F.count_if(F.col("t") == "cached").alias("cached"), F.bool_and("resumed").alias("resumed"), F.sum("chars").alias("chars_total"), F.coalesce(F.sum(F.when(have, F.col("chars"))), F.lit(0)).alias("chars_start"))


def q45_job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of items: an hour is a batch; errors are bad, clicks come from the cache."""
    kind = F.col("event_type")
    rows = tables.read(spark, sf_dir, "events").select(F.lit("b").alias("book"), F.floor(F.unix_timestamp("ts") / 3600).alias("batch_id"), F.when(kind == "error", "failed").otherwise("done").alias("outcome"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (kind == "click").alias("hit"))
    return progress.counters(rows)


def q46_debug_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five batches of each book, and its first twelve split blocks."""
    items = batching.items_of(tables.blocks(spark, sf_dir), MODEL)
    batches = batching.first_batches(batching.build_batches(items, MODEL)).select("book", F.lit("batch").alias("what"), F.col("batch_id").alias("number"), "items", "tokens")
    splits = batching.first_splits(items).select("book", F.lit("split").alias("what"), F.col("k").alias("number"), F.col("n_parts").cast("long").alias("items"), F.lit(None).cast("long").alias("tokens"))
    return batches.unionByName(splits)


def q47_engine_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's commands from files to files: inspect, estimate, start, progress, save, read again, usage, cache."""
    from quire.engine import Engine, JobOptions

    folder = _folder(spark)
    epub.save(samples.awkward_books(spark, sf_dir).select("book", "content"), f"{folder}/in")
    made = samples.pdf_items(spark, sf_dir)
    for r in made.toLocalIterator():
        _write(spark, f"{folder}/in/{r['book']}.pdf", r["content"])
    engine = Engine(spark, f"{folder}/data")
    info = table(engine.inspect(f"{folder}/in").drop("cover"), "info")
    options = JobOptions(target_lang="Thai", mode="bilingual", model=MODEL)
    before = table(engine.estimate(MODEL, "Thai").select("book", "requests"), "before")
    status = engine.start(options)
    stands, segments = engine.progress(), table(engine.segments(), "segments")
    saved = engine.save_output(f"{folder}/out")
    out = table(_books_of(binary.read_files(spark, f"{folder}/out")), "out")
    told = html_blocks.collect(epub.documents(out).select(F.concat_ws("|", "book", "d").alias("key"), "html"), "key")
    told = told.groupBy(F.split_part("key", F.lit("|"), F.lit(1)).alias("path")).agg(F.count_if(F.col("text").startswith(stub.MARK)).alias("told"))
    after, used, cached = engine.estimate(MODEL, "Thai").agg(F.sum("requests")).first()[0], engine.usage().agg(F.sum("requests")).first()[0], engine.cache_stats().first()["entries"]
    done = segments.groupBy("book").agg(F.sum("done").alias("done"), F.sum("total").alias("total"))
    file = F.element_at(F.split("path", "/"), -1)
    kept = saved.select("book", file.alias("file"), (F.col("bytes") > 0).alias("saved"))
    rows = info.join(before, "book").join(done, "book").join(kept, "book").join(told.select(file.alias("file"), "told"), "file")
    return rows.select("file_name", "format", "title", "author", "total_chars", F.size("segments").cast("long").alias("segments"), "requests", "done", "total", "saved", "told").withColumns({"status": F.lit(status), "batches": F.lit(stands["done"]).cast("long"), "requests_after": F.lit(after).cast("long"), "used": F.lit(used).cast("long"), "cached": F.lit(cached).cast("long"), "chars": F.lit(stands["chars_total"]).cast("long")})


def _write(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(content))
    stream.close()


def q48_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream that comes twice: the second time nothing is called, every answer is there."""
    from quire.streaming.incremental import translate_stream

    folder = _folder(spark)
    turns = _turns(spark, sf_dir)
    for k in range(2):
        turns.withColumn("book", F.concat("book", F.lit(f"-{k}"))).write.mode("append").parquet(f"{folder}/in")
        service = stub.StubTranslator() if not k else samples.Moody("")
        stream = spark.readStream.schema(turns.schema).parquet(f"{folder}/in")
        translate_stream(stream, MODEL, LANGUAGE, INSTRUCTIONS, f"{folder}/cache", f"{folder}/out", f"{folder}/check", service).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("book", F.col("b").alias("turn"), F.col("translation").isNotNull().alias("told"), _digest(F.col("translation")).alias("digest"))


def q49_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options as a job takes them or not."""
    from quire.engine import JobOptions

    rows = []
    for mode in ("bilingual", "translated", "Bilingual", ""):
        for language in ("Thai", "  ", ""):
            try:
                JobOptions(target_lang=language, mode=mode).check()
                rows.append((mode, language, True))
            except ValueError:
                rows.append((mode, language, False))
    return spark.createDataFrame(rows, "mode string, language string, taken boolean")


def q50_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a request of its own: the input, and what the instructions must name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [request_body(MODEL, "Thai", " be brief ", [(1, t or "")]) for t in b.column(2).to_pylist()]
            said = [x["system_instruction"] for x in bodies]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x["input"] for x in bodies]), pa.array(["Thai" in x for x in said]), pa.array([x.endswith("be brief") for x in said]), pa.array([x["model"] for x in bodies])], ["conv_id", "turn", "input", "language", "wish", "model"])

    rows = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInArrow(run, "conv_id long, turn long, input string, language boolean, wish boolean, model string")
    return rows.select("conv_id", "turn", _digest(F.col("input")).alias("input"), "language", "wish", "model")


def q51_preview_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.blocks(spark, sf_dir).where(~F.col("skipped")).groupBy("book").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    return rows.select("book", "chars", text.preview_requests(F.col("chars"), MODEL).alias("lite"), text.preview_requests(F.col("chars"), "gemini-3.6-flash").alias("full"))


# ---------------------------------------------------------------- names and references


def q52_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of a text that is not a letter of a-z as a number, decimal or hexadecimal, and back; and references that are none."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    code = lambda c: F.when(c.rlike("^[a-z]$"), c).when(F.ascii(c) % 2 == 0, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(F.concat(F.lit("&#x"), F.hex(F.ascii(c)), F.lit(";")))
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    coded = F.concat(F.array_join(F.transform(chars, code), ""), F.lit("&amp;lt;&nbsp;&copy;&#xD800;&#1114112;&#;&lt"))
    return docs.select("doc_id", _digest(entities.unescape_entities(coded)).alias("digest"))


def q53_percent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages' addresses and of items as entry names, encoded and back; broken escapes stay."""
    names = tables.read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).unionByName(tables.read(spark, sf_dir, "pages").select(F.col("url").alias("name"))).distinct()
    coded = paths.percent_encode(F.concat("name", F.lit(" é+%/~")))
    return names.select("name", coded.alias("coded"), paths.percent_decode(coded).alias("back"), paths.percent_decode(F.concat("name", F.lit("%zz%4"))).alias("broken"))


def q54_sibling_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in sorted(html_blocks.BLOCK_TAGS)], "tag string")
    return rows.select("tag", text.sibling_tag(F.col("tag")).alias("sibling"))


def q55_resume_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return docs.select("doc_id", resume_key(F.col("content"), MODEL, LANGUAGE, INSTRUCTIONS).alias("key"))


def q56_file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and folders of files, and the titles that stand in for missing ones."""
    rows = tables.read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("_a-b.xhtml")).alias("path"))
    return rows.select("page_id", paths.file_name(F.col("path")).alias("file"), paths.dir_of(F.col("path")).alias("folder"), paths.pretty_name(F.col("path")).alias("title"))


def q57_known_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages made of documents' lines, with every block element in turn, attributes full of stray quotes, and tags left open."""
    docs = tables.blocks(spark, sf_dir).where("text <> ''")
    tag = F.element_at(F.array(*[F.lit(t) for t in KNOWN_TAGS]), (F.col("b") % len(KNOWN_TAGS) + 1).cast("int"))
    odd = F.element_at(F.array(*[F.lit(a) for a in KNOWN_ATTRIBUTES]), (F.col("b") % len(KNOWN_ATTRIBUTES) + 1).cast("int"))
    one = F.concat(F.lit("<"), tag, odd, F.lit("> <i\n>"), text.escape_html(F.col("text")), F.lit("</i > <script>if (a<b) x('</p')</script></"), F.upper(tag), F.lit(">\n"))
    rows = docs.groupBy(F.concat_ws("|", "book", "d").alias("d")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", one.alias("h")))), lambda x: x["h"]), "outside").alias("html"))
    return html_blocks.collect(rows.withColumn("html", F.concat(F.lit("<!DOCTYPE html><!-- <p>no</p> --><body>"), "html", F.lit("<li>open <b>end"))))


#: Elements and attributes of q57's pages.
KNOWN_TAGS = ["p", "h1", "li", "blockquote", "td", "figcaption", "dd"]
KNOWN_ATTRIBUTES = ["", " title=don't", ' class="a > b"', " x='\"'", ' href="x"y"', " a = b/c", " data-x"]

QUERIES = {name: fn for name, fn in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}
