"""A translation job: items, batches, what is still to send, the calls, parts put together.

The calls are the only expensive step: batches that a resume log has whole, and items that the log or
the cache answers, never reach them. A batch (bounded in items and tokens) is called by one worker;
truncated answers halve it there, a spent quota moves on to the next model of the tier. Workers share
one desk (quire.translate.desk): its pace, its models, and the batches it has kept already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import batching, progress
from quire.translate.desk import Desk, RemoteDesk
from quire.translate.stub import StubTranslator

#: (model, [(i, text)]) -> (outcome, [(i, answer)], tokens[, message]); outcome: ok, truncated, quota,
#: transient (worth another try), failed or fatal. One with bind(desk) paces itself and reports its calls.
Translator = Callable[[str, list[tuple[int, str]]], tuple]
PARALLEL_CALLS, MAX_ATTEMPTS = 3, 5
AT = ["book", "d", "b", "part"]


# ---------------------------------------------------------------- one batch


@dataclass
class Told:
    """What became of a batch, or of a half of one: full coverage, or nothing for each half that was sent."""

    answers: dict[int, tuple[str, str]] = field(default_factory=dict)  # number -> (text, model)
    outcome: str = "done"
    tokens: int = 0
    error: str = ""


def call(translator: Translator, desk: Desk | RemoteDesk, items: list[tuple[int, str]]) -> Told:
    """Ask for a batch until it is answered, fails, or the job must end."""
    wanted = {i for i, _ in items}
    reports = hasattr(translator, "bind")
    attempts, error, spent = 0, "", False
    while True:
        model = desk.model()
        if model is None:
            return Told(outcome="fatal" if spent else "cancelled", error=error or "no model is left")
        if not reports:
            desk.sent(model)
        outcome, got, used, *said = translator(model, items)
        error = said[0] if said and said[0] else outcome
        if outcome == "ok":
            answers = {i: (t, model) for i, t in got if i in wanted}
            if len(answers) == len(wanted):
                return Told(answers, "done", used)
            error = "the reply does not hold every text"
        if outcome == "quota":
            spent = True
            if not reports:
                desk.spent(model, False)
        elif outcome == "truncated" and len(items) > 1:
            half = len(items) // 2
            a = call(translator, desk, items[:half])
            b = call(translator, desk, items[half:]) if a.outcome in ("done", "failed") else Told(outcome=a.outcome)
            worst = next((o for o in ("fatal", "cancelled", "failed") if o in (a.outcome, b.outcome)), "done")
            return Told(a.answers | b.answers, worst, a.tokens + b.tokens, a.error or b.error)
        elif outcome in ("truncated", "failed", "fatal"):
            return Told(outcome="fatal" if outcome == "fatal" else "failed", error=error)
        else:
            attempts += 1
            if attempts >= MAX_ATTEMPTS:
                return Told(outcome="failed", error=error)


# ---------------------------------------------------------------- all batches


def plan(blocks: DataFrame, model: str, cache: DataFrame | None = None, resumed: DataFrame | None = None, sample: bool = False) -> DataFrame:
    """(book, batch_id, d, b, part, n_parts, text, chars, t, resumed): the job's items, t where an answer is there.

    cache has (text, t), resumed has (book, d, b, part, t); resumed marks items of batches that the
    log answers whole.
    """
    items = batching.items_of(blocks, model)
    ids = batching.build_batches(items, model)
    if sample:
        ids = batching.first_items(ids)
    rows = items.select(*AT, "n_parts", "text", "chars").join(ids.select(*AT, "batch_id"), AT)
    none = F.lit(None).cast("string")
    logged = rows.withColumn("logged", none) if resumed is None else rows.join(resumed.select(*AT, F.col("t").alias("logged")).dropDuplicates(AT), AT, "left")
    held = logged.withColumn("held", none) if cache is None else logged.join(cache.select("text", F.col("t").alias("held")).dropDuplicates(["text"]), "text", "left")
    whole = held.groupBy("book", "batch_id").agg((F.count("logged") == F.count(F.lit(1))).alias("resumed"))
    return held.join(whole, ["book", "batch_id"]).select("book", "batch_id", "d", "b", "part", "n_parts", "text", "chars", F.coalesce("logged", "held").alias("t"), "resumed")


def answers(rows: DataFrame, model: str, translator: Translator, address: tuple[str, int, str] | None = None, workers: int | None = None, key: str = "book") -> DataFrame:
    """(book, batch_id, d, b, part, t, model, outcome, tokens): a row an item; tokens stand at a batch's first.

    rows are items (book, batch_id, d, b, part, text, t, and log, the name of the book's log, if it has
    one); only those without t are sent, in batches in order. address is a served desk that all tasks share; without one each task has its own. workers
    tasks run side by side (default: as many as Spark makes).
    """
    order = ["d", "b", "part"]
    dealt = [F.col(key), F.col("batch_id")]
    log = F.col("log") if "log" in rows.columns else F.lit(None).cast("string").alias("log")
    src = rows.select(key, "batch_id", *order, "text", "t", log)
    src = (src.repartition(workers, *dealt) if workers else src.repartition(*dealt)).sortWithinPartitions(key, "batch_id", *order)
    names = [key, "batch_id", *order, "t", "model", "outcome", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        desk = RemoteDesk(address) if address else Desk(model)
        ask = translator.bind(desk) if hasattr(translator, "bind") else translator
        kind, held = None, []

        def send() -> pa.RecordBatch:
            place = list(held[0][:2])
            kept = desk.kept(place)
            if kept is not None:
                told = {tuple(k): (t, m) for *k, t, m in kept}
                out = [(*r[:5], *told[r[2:5]], "done", 0) for r in held]
            else:
                todo = [(k, r[5]) for k, r in enumerate(held, 1) if r[6] is None]
                got = call(ask, desk, todo) if todo else Told()
                out = [(*r[:5], *(got.answers.get(k, (None, None)) if r[6] is None else (r[6], None)), got.outcome, got.tokens if k == 1 else 0) for k, r in enumerate(held, 1)]
                desk.finished(place, [[*r[2:5], r[5], r[6]] for r in out if r[5] is not None], got.outcome, got.tokens, len(held) - len(todo), got.error, held[0][7])
            kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            kind = kind or b.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and row[:2] != held[0][:2]:
                    yield send()
                    held = []
                held.append(row)
        if held:
            yield send()

    return src.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, batch_id long, d long, b long, part int, t string, model string, outcome string, tokens long")


def put_together(blocks: DataFrame, rows: DataFrame, told: DataFrame) -> DataFrame:
    """blocks with translation (null where a part has none) from the plan's rows and the answers (book, d, b, part, t)."""
    parts = rows.select(*AT, F.coalesce("n_parts", F.lit(1)).alias("n_parts")).join(told.select(*AT, "t"), AT, "left")
    return blocks.join(progress.join_parts(parts, ["book", "d", "b"]), ["book", "d", "b"], "left")


def translate(blocks: DataFrame, model: str, translator: Translator | None = None, cache: DataFrame | None = None, resumed: DataFrame | None = None, sample: bool = False) -> DataFrame:
    """blocks with translation, in one plan: what plan() knows, and answers() for the rest."""
    rows = plan(blocks, model, cache, resumed, sample)
    if cache is None and resumed is None:
        return put_together(blocks, rows, answers(rows, model, translator or StubTranslator()))
    known = rows.where("t is not null").select(*AT, "t")
    fresh = answers(rows.where("t is null"), model, translator or StubTranslator()).select(*AT, "t")
    return put_together(blocks, rows, known.unionByName(fresh))


def bilingual_rows(translated: DataFrame) -> DataFrame:
    """(book, d, b, k, text): a block's own text (k 0), and its translation under it (k 1)."""
    both = F.array(F.struct(F.lit(0).cast("long").alias("k"), F.col("text")), F.struct(F.lit(1).cast("long").alias("k"), F.col("translation").alias("text")))
    return translated.select("book", "d", "b", F.inline(F.filter(both, lambda x: (x["k"] == 0) | x["text"].isNotNull())))
