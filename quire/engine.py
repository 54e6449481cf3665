"""The engine's commands: settings, inspecting books, estimating, translating, saving, cache and usage.

State is kept in tables under a data folder that driver and executors share: the translation cache,
the log of finished batches (by which a job resumes), the usage log, and each run's answers.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.hashing import cache_prefix, resume_key
from quire.functions.text import collapse_ws, is_translatable
from quire.operators import batching, cache, html_blocks, pages, progress
from quire.plans import job
from quire.sources import binary, epub, logs, pdf
from quire.streaming import quota
from quire.translate.desk import Desk, Served
from quire.translate.stub import StubTranslator

#: What a job may produce.
MODES = logs.MODES
#: Seconds after which finished batches are on disk at the latest.
SAVE_EVERY = 5.0
ITEMS = "book string, batch_id long, d long, b long, part int, t string"


@dataclass(frozen=True)
class JobOptions:
    target_lang: str = "Burmese"
    mode: str = "translated"
    model: str = "gemini-3.5-flash-lite"
    custom_instructions: str = ""
    sample: bool = False
    auto_switch_model: bool = True

    def check(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode}")
        if not self.target_lang.strip():
            raise ValueError("a target language is needed")


class Engine:
    def __init__(self, spark: SparkSession, data: str, translator: job.Translator | None = None, page_readers: list[pdf.PageReader] | None = None, workers: int = job.PARALLEL_CALLS):
        self.spark, self.data, self.workers = spark, data.rstrip("/"), workers
        self.translator, self.page_readers = translator or StubTranslator(), pdf.READERS if page_readers is None else page_readers
        self.files: DataFrame | None = None
        self.docs: DataFrame | None = None
        self.blocks: DataFrame | None = None
        self.info: DataFrame | None = None
        self.output: DataFrame | None = None
        self.status: str | None = None
        self.error: str | None = None
        self.running = threading.Lock()
        self._desk: Desk | None = None
        self._chars = (0, 0)
        self._done: DataFrame | None = None
        self._held: list[DataFrame] = []

    def job_is_running(self) -> bool:
        return self.running.locked()

    # ------------------------------------------------------------ settings

    def get_settings(self) -> logs.Settings:
        return logs.load_settings(self.spark, f"{self.data}/settings.json")

    def save_settings(self, settings: logs.Settings) -> None:
        logs.save_settings(self.spark, settings, f"{self.data}/settings.json")

    def ping(self, model: str) -> dict:
        """One call of the translator with one short text: model, outcome, reply, message and milliseconds."""
        start = dt.datetime.now()
        outcome, got, _, *said = self.translator(model, [(1, "Reply")])
        took = int((dt.datetime.now() - start).total_seconds() * 1000)
        return {"model": model, "outcome": outcome, "reply": "".join(t for _, t in got), "message": said[0] if said else "", "ms": took}

    # ------------------------------------------------------------ books

    def inspect(self, path: str) -> DataFrame:
        """(book, format, title, author, cover, total_chars, segments, warnings, error) of the files under path, which become current."""
        if self.job_is_running():
            raise ValueError("a job is running")
        for df in self._held:
            df.unpersist()
        files = binary.read_files(self.spark, path).persist()
        read = epub.books(files.where("format = 'epub'")).persist()
        docs = epub.documents(read).select("book", "d", "path", "title", "html")
        keyed = docs.withColumn("key", F.concat_ws("|", "book", "d"))
        blocks = html_blocks.collect(keyed, "key").join(keyed.select("key", "book", "d"), "key").select("book", "d", "b", "tag", "text", "skipped")
        raw = pdf.pages(files.where("format = 'pdf'"), self.page_readers).persist()
        paras, chapters = self._chapters(raw.where("error is null"))
        self.files, self.docs = files, docs.unionByName(chapters, allowMissingColumns=True)
        self.blocks = blocks.unionByName(paras, allowMissingColumns=True).persist()
        self._held = [files, read, raw, self.blocks]
        self.output = self._done = self.status = self.error = self._desk = None
        kept = self.blocks.where(~F.col("skipped")).groupBy("book", "d").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text").cast("long")).alias("chars"))
        segments = kept.join(self.docs.select("book", "d", "path", "title"), ["book", "d"]).groupBy("book").agg(F.sum("chars").alias("total_chars"), F.array_sort(F.collect_list(F.struct("d", "path", "title", "blocks", "chars"))).alias("segments"))
        printed = pdf.metadata(files.where("format = 'pdf'")).join(raw.groupBy("book").agg(F.max("error").alias("error")), "book")
        meta = read.select("book", "title", "author", "cover", "warnings", "error").unionByName(printed, allowMissingColumns=True)
        name = F.regexp_replace("file_name", r"\.[^.]*$", "")
        info = files.select("book", "file_name", "format").join(meta, "book", "left").join(segments, "book", "left")
        self.info = info.select("book", "file_name", "format", F.coalesce(F.when(F.col("title") != "", F.col("title")), name).alias("title"), "author", "cover", F.coalesce("total_chars", F.lit(0)).alias("total_chars"), "segments", "warnings", F.when(F.col("format").isNull(), "neither EPUB nor PDF").otherwise(F.col("error")).alias("error"))
        return self.info

    def _chapters(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        clean = pages.strip_furniture(raw.select("book", "page", "text"))
        paras = pages.chapters(pages.paragraphs(clean, ["book", "page"]), "book", ["page", "paragraph"])
        paras = paras.select("book", (F.col("chapter") - 1).alias("d"), "title", F.concat("chapter_id", F.lit(".xhtml")).alias("path"), (F.shiftleft(F.col("page").cast("long"), 32) + F.col("paragraph")).alias("b"), F.lit("p").alias("tag"), collapse_ws(F.col("text")).alias("text"))
        rows = paras.select("book", "d", "b", "tag", "text").withColumn("skipped", ~is_translatable(F.col("text")))
        return rows, paras.select("book", "d", "path", "title").distinct()

    def current_books(self) -> DataFrame | None:
        """What inspect() said of the current books."""
        return self.info

    # ------------------------------------------------------------ jobs

    def _prefix(self, o: JobOptions):
        return cache_prefix(F.lit(o.model), F.lit(o.target_lang), F.lit(o.custom_instructions))

    def _known(self, o: JobOptions, items: DataFrame) -> DataFrame:
        """Cached answers by text."""
        keyed = cache.with_keys(items.select("text").distinct(), self._prefix(o))
        return keyed.join(logs.read_cache(self.spark, f"{self.data}/cache"), "k").select("text", "t")

    def _keys(self, o: JobOptions) -> DataFrame:
        return self.files.select("book", resume_key(F.col("content"), o.model, o.target_lang, o.custom_instructions).alias("key"))

    def _resumed(self, o: JobOptions) -> DataFrame:
        """Items (book, batch_id, d, b, part, t) that an earlier run of the same job on the same bytes has answered."""
        if o.sample:
            return self.spark.createDataFrame([], ITEMS)
        return logs.read_batches(self.spark, f"{self.data}/jobs").join(self._keys(o), "key").select("book", "batch_id", "d", "b", "part", "t")

    def _plan(self, o: JobOptions) -> DataFrame:
        items = batching.items_of(self.blocks, o.model)
        return job.plan(self.blocks, o.model, self._known(o, items), self._resumed(o), o.sample)

    def estimate(self, model: str, target_lang: str, instructions: str = "") -> DataFrame:
        """(book, requests, done) that a full run would take now."""
        self._need_book()
        rows = self._plan(JobOptions(target_lang=target_lang, model=model, custom_instructions=instructions))
        batches = rows.groupBy("book", "batch_id").agg(F.count("t") == F.count(F.lit(1))).toDF("book", "batch_id", "have")
        return batches.groupBy("book").agg(F.count_if(~F.col("have")).alias("requests"), F.count_if("have").alias("done"))

    def start(self, o: JobOptions) -> str:
        """Translate the current books; the job's final state.

        Finished batches are logged while others run, so a job that is cancelled, or breaks, goes on
        from there. An error leaves the state failed, with its message in progress().
        """
        self._need_book()
        o.check()
        if not self.running.acquire(blocking=False):
            raise ValueError("a job is running")
        try:
            self.status, self.error, self.output, self._done = "running", None, None, None
            self.status = self._run(o)
        except Exception as e:
            self.status, self.error = "failed", str(e)
            raise
        finally:
            self.running.release()
        return self.status

    def _run(self, o: JobOptions) -> str:
        rows = self._plan(o).persist()
        sums = rows.groupBy("book", "batch_id").agg(F.bool_and("resumed").alias("r"), F.sum("chars").alias("c"), F.sum(F.when(F.col("t").isNotNull(), F.col("chars"))).alias("s")).agg(F.count(F.lit(1)), F.count_if("r"), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
        self._chars = (sums[2], sums[3])
        today = [r["model"] for r in self.usage().where("exhausted").collect()]
        self._desk = desk = Desk(o.model, o.auto_switch_model, tuple(today), sums[0] - sums[1])
        served = Served(desk, self.spark.conf.get("spark.driver.host", "localhost"))
        run = f"{self.data}/answers/{uuid.uuid4().hex}"
        saver = _Saver(lambda: self._save(desk))
        try:
            todo = rows.where(~F.col("resumed")).select("book", "batch_id", "d", "b", "part", "text", "t")
            todo = todo.withColumn("log", F.lit(None).cast("string")) if o.sample else todo.join(self._keys(o).withColumnRenamed("key", "log"), "book")
            job.answers(todo, o.model, self.translator, served.address, self.workers).write.parquet(run)
        finally:
            saver.stop()
            served.close()
            calls = [(dt.datetime.fromtimestamp(at, dt.timezone.utc).replace(tzinfo=None), model, spent) for at, model, spent in desk.calls]
            if calls:
                self.spark.createDataFrame(calls, "ts timestamp, model string, exhausted boolean").coalesce(1).write.mode("append").parquet(f"{self.data}/usage")
        told = self.spark.read.parquet(run)
        new = told.where("t is not null and model is not null").join(rows.select(*job.AT, "text"), job.AT)
        prefix = cache_prefix(F.col("model"), F.lit(o.target_lang), F.lit(o.custom_instructions))
        logs.append_cache(cache.with_keys(new, prefix).select("k", "t").dropDuplicates(["k"]), f"{self.data}/cache", int(dt.datetime.now().timestamp()))
        have = rows.where("resumed").select(*job.AT, "t").unionByName(told.where("t is not null").select(*job.AT, "t"))
        self._done = self._kept(job.put_together(self.blocks, rows, have), f"{run}-blocks")
        now = desk.snapshot()
        self.error = now["error"]
        status = self.spark.range(1).select(progress.job_status(F.lit(desk.stopped), F.lit(desk.cancelled), F.lit(now["failed"]), F.lit(sums[0]))).first()[0]
        self.output = self._kept(self._assemble(o), f"{run}-books") if status in ("completed", "partial") else None
        rows.unpersist()
        return status

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _save(self, desk: Desk) -> None:
        """Put finished batches into the log."""
        lines = [{"key": log, "batch_id": n, "items": [dict(zip(("d", "b", "part", "t", "model"), x, strict=True)) for x in items]} for log, n, items in desk.take_unsaved() if log]
        if lines:
            logs.append_batches(self.spark, lines, f"{self.data}/jobs")

    def _assemble(self, o: JobOptions) -> DataFrame:
        keyed = self.docs.where("html is not null").withColumn("key", F.concat_ws("|", "book", "d"))
        told = self._done.join(keyed.select("book", "d", "key"), ["book", "d"])
        pages_ = html_blocks.rewrite_docs(keyed, told, o.mode, "key").join(keyed.select("key", "book", "path"), "key")
        old = epub.repacked(self.files, pages_).select("book", "content")
        titles = self.docs.where("html is null").select("book", "d", F.col("title").alias("chapter"))
        name = self.files.select("book", F.regexp_replace("file_name", r"\.[^.]*$", "").alias("title"))
        meta = pdf.metadata(self.files.where("format = 'pdf'")).select("book", F.col("title").alias("named"), F.coalesce("author", F.lit("")).alias("author"))
        name = name.join(meta, "book").select("book", F.coalesce(F.when(F.col("named") != "", F.col("named")), "title").alias("title"), "author")
        rows = self._done.join(titles, ["book", "d"]).join(name, "book")
        return old.unionByName(epub.built(rows, o.target_lang, o.mode))

    def cancel(self) -> None:
        """Let the running job send nothing more; finished batches stay logged, and start() returns cancelled."""
        if self.job_is_running() and self._desk is not None:
            self._desk.cancel()

    def progress(self) -> dict | None:
        """Where the job stands, at any time: status, batches, tokens, characters, error, model and the log's last lines."""
        if self.status is None:
            return None
        desk = self._desk
        now = desk.snapshot() if desk else {"total": 0, "done": 0, "failed": 0, "cached": 0, "tokens": 0, "model": None}
        return {**now, "status": self.status, "error": self.error or now.get("error"), "chars_total": self._chars[0], "chars_start": self._chars[1], "log": list(desk.log) if desk else []}

    def segments(self) -> DataFrame | None:
        """(book, d, done, total, state) of the last job that has ended."""
        return None if self._done is None else progress.segments(self._done, ["book", "d"])

    def save_output(self, folder: str) -> DataFrame:
        """(book, path, bytes) of the books written under folder, which any file system of Spark may hold."""
        if self.output is None:
            raise ValueError("there is nothing to save yet")
        return epub.save(self.output, folder)

    def _need_book(self) -> None:
        if self.blocks is None:
            raise ValueError("load a book first")

    # ------------------------------------------------------------ cache and usage

    def cache_stats(self) -> DataFrame:
        return logs.cache_stats(self.spark, f"{self.data}/cache")

    def clear_cache(self) -> None:
        logs.clear_cache(self.spark, f"{self.data}/cache")

    def usage(self) -> DataFrame:
        """(day, model, requests, exhausted, reset_at) of the current quota day."""
        path = f"{self.data}/usage"
        if not logs._exists(self.spark, path):
            return quota.usage(self.spark.createDataFrame([], "ts timestamp, model string, exhausted boolean"))
        return quota.current(quota.usage(self.spark.read.parquet(path)), F.current_timestamp())


class _Saver:
    """Runs a function every SAVE_EVERY seconds, and once more at the end."""

    def __init__(self, save):
        self.save, self.end = save, threading.Event()
        self.thread = threading.Thread(target=self._work, daemon=True)
        self.thread.start()

    def _work(self) -> None:
        while not self.end.wait(SAVE_EVERY):
            self.save()

    def stop(self) -> None:
        self.end.set()
        self.thread.join()
        self.save()
