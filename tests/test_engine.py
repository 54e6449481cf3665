import json
import zipfile

import pytest

from quire.engine import Engine, JobOptions
from quire.sources import logs
from quire.translate import client
from quire.translate.desk import Desk, Pace, RemoteDesk, Served
from quire.translate.stub import StubTranslator
from tests.test_sources import sample


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_pace_spaces_doubles_and_relaxes():
    pace = Pace(20)
    starts = [pace.book(0) for _ in range(3)]
    assert starts == [0, 3, 6]
    for _ in range(4):
        pace.refused(6, 10)
    assert pace.slowness == 4 and pace.book(6) == 10 and pace.book(6) == 22
    for _ in range(19):
        pace.went_well()
    assert pace.slowness == 4
    pace.went_well()
    assert pace.slowness == 1 + 3 * 0.75
    assert Pace(500).gap == 0.12


def test_desk_goes_round_and_forgets_on_a_new_day():
    clock = Clock()
    desk = Desk("gemini-3.7-flash", clock=clock)
    assert desk.spent("gemini-3.7-flash", True) == "gemini-3.8-flash"
    assert desk.spent("gemini-3.7-flash", False) == "gemini-3.8-flash"
    assert desk.spent("gemini-3.8-flash", False) == "gemini-3.5-flash"
    assert desk.spent("gemini-3.5-flash", False) == "gemini-3.6-flash" and desk.spent("gemini-3.6-flash", False) is None
    clock.now += 86400
    assert desk.model() == "gemini-3.7-flash"
    assert [(m, e) for _, m, e in desk.calls] == [("gemini-3.7-flash", True)]
    assert Desk("gemini-3.5-flash-lite", spent=("gemini-3.5-flash-lite",)).model() == "gemini-3.1-flash-lite"
    assert Desk("x", switch=False).spent("x", False) is None
    desk.cancel()
    assert desk.model() is None


def test_desk_answers_only_those_who_know_the_secret():
    served = Served(Desk("m"), "localhost")
    try:
        assert RemoteDesk(served.address).model() == "m"
        with pytest.raises(ConnectionError):
            RemoteDesk((*served.address[:2], "guess")).model()
        with pytest.raises(AttributeError):
            RemoteDesk(served.address).cancel()
    finally:
        served.close()


def ok(body, status="completed", cut=None):
    items = json.loads(body["input"])["paragraphs"][:cut]
    text = "```json\n" + json.dumps({"translations": [{"i": x["i"], "t": x["t"].upper()} for x in items]}) + "\n```"
    return 200, {"status": status, "steps": [{"type": "thought"}, {"type": "model_output", "content": [{"type": "text", "text": text}]}], "usage": {"total_tokens": 9}}, None


def test_service_translator_retries_and_classifies():
    clock = Clock()
    items = [(1, "a"), (2, "b")]

    def run(*replies):
        left, desk = list(replies), Desk("m", clock=clock)
        t = client.ServiceTranslator(lambda body: left.pop(0)(body) if len(left) > 1 else left[0](body), "Thai", " be brief ", sleep=clock.sleep).bind(desk)
        return t("m", items), desk

    limited = lambda b: (429, {"error": {"message": "PerMinute"}}, 30)
    done = ("ok", [(1, "A"), (2, "B")], 9, "")
    assert run(ok)[0] == done
    start = clock.now
    assert run(limited, limited, lambda b: (503, None, None), lambda b: ok(b, cut=1), ok)[0] == done
    assert clock.now - start > 60
    assert run(lambda b: ok(b, status="incomplete"))[0][0] == "truncated"
    got, desk = run(lambda b: (429, [{"error": {"message": "x PerDay"}}], 1))
    assert got[0] == "quota" and [(m, e) for _, m, e in desk.calls] == [("m", True)]
    assert run(lambda b: (400, {"error": {"message": "no"}}, None))[0] == ("fatal", [], 0, "400: no")
    got, desk = run(lambda b: ok(b, cut=1))
    assert got[0] == "failed" and len(desk.calls) == 5, "five attempts, each a call that the service took"
    got, desk = run(lambda b: (500, None, 1))
    assert got[0] == "failed" and not desk.calls
    assert run(limited)[0][0] == "failed"
    body = client.request_body("m", "Thai", " be brief ", items)
    assert "Thai" in body["system_instruction"] and "be brief" in body["system_instruction"] and json.loads(body["input"])["paragraphs"][1] == {"i": 2, "t": "b"}


def test_engine_from_files_to_files(spark, tmp_path):
    books = tmp_path / "books"
    books.mkdir()
    (books / "a.epub").write_bytes(sample())
    (books / "b.pdf").write_bytes(b"%PDF-1.4 whatever")
    (books / "c.txt").write_bytes(b"nothing")
    reader = lambda raw: ["First page text of it\n\nSecond paragraph here", "Other page text of it"]
    calls = []

    class Counting(StubTranslator):
        def __call__(self, model, items):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write(f"{len(items)}\n")
            return super().__call__(model, items)

    engine = Engine(spark, f"file://{tmp_path}/data", Counting(), [lambda raw: [""], reader])
    with pytest.raises(ValueError, match="load a book"):
        engine.estimate("x-lite", "Thai")
    info = {r["file_name"]: r for r in engine.inspect(f"file://{books}").collect()}
    assert info["a.epub"]["title"] == "Test Book" and [s["blocks"] for s in info["a.epub"]["segments"]] == [2, 3]
    assert info["b.pdf"]["title"] == "b" and info["b.pdf"]["error"] is None and info["b.pdf"]["segments"][0]["blocks"] == 3
    assert info["c.txt"]["error"] == "neither EPUB nor PDF"
    with pytest.raises(ValueError, match="mode"):
        engine.start(JobOptions(mode="no"))
    assert sorted((r["requests"], r["done"]) for r in engine.estimate("x-lite", "Thai").collect()) == [(1, 0), (1, 0)]
    options = JobOptions(target_lang="Thai", mode="bilingual", model="x-lite")
    assert engine.start(options) == "completed"
    assert all(r["state"] == "done" for r in engine.segments().collect())
    now = engine.progress()
    assert now["status"] == "completed" and now["done"] == now["total"] == 2 and now["chars_total"] > now["chars_start"] == 0 and len(now["log"]) == 2
    paths = sorted(r["path"].removeprefix("file:") for r in engine.save_output(f"file://{tmp_path}/out").collect())
    texts = [zipfile.ZipFile(p).read(n).decode() for p in paths for n in zipfile.ZipFile(p).namelist() if n.endswith("ch1.xhtml") or n.endswith("ch001.xhtml")]
    assert len(paths) == 2 and all("[MY] " in t and "ebtr-translation" in t for t in texts)
    assert sorted((r["requests"], r["done"]) for r in engine.estimate("x-lite", "Thai").collect()) == [(0, 1), (0, 1)]
    assert engine.cache_stats().first()["entries"] == 8
    assert [(r["model"], r["requests"]) for r in engine.usage().collect()] == [("x-lite", 2)]
    n = len(open(f"{tmp_path}/calls").read().splitlines())
    assert engine.start(options) == "completed" and len(open(f"{tmp_path}/calls").read().splitlines()) == n, "nothing is called twice"
    engine.clear_cache()
    assert engine.cache_stats().first()["entries"] == 0
    assert engine.start(options) == "completed" and len(open(f"{tmp_path}/calls").read().splitlines()) == n, "the log answers without the cache"
    engine.translator = lambda model, items: ("fatal", [], 0, "key not valid")
    assert engine.start(JobOptions(target_lang="Lao", model="x-lite")) == "failed" and engine.output is None
    assert engine.progress()["error"] == "key not valid"
    assert engine.ping("m")["outcome"] == "fatal" and engine.ping("m")["message"] == "key not valid" and calls == []


def _book_of(spark, tmp_path, pages):
    books = tmp_path / "books"
    books.mkdir()
    (books / "b.pdf").write_bytes(b"%PDF-1.4 whatever")
    return f"file://{books}", [lambda raw: pages]


class Noting(StubTranslator):
    """Writes down every text it is sent; answers those of `deaf` with a failure."""

    def __init__(self, path, deaf=""):
        self.path, self.deaf = path, deaf

    def __call__(self, model, items):
        with open(self.path, "a") as f:
            f.writelines(t + "\n" for _, t in items)
        if self.deaf and any(self.deaf in t for _, t in items):
            return "failed", [], 0, "deaf"
        return super().__call__(model, items)


def test_log_keeps_cached_items_of_a_batch(spark, tmp_path):
    """A batch half of which came from the cache is logged whole: after clearing the cache nothing is sent again, and nothing is lost."""
    folder, readers = _book_of(spark, tmp_path, ["First paragraph here\n\nSecond paragraph here"])
    said = f"{tmp_path}/said"
    engine = Engine(spark, f"file://{tmp_path}/data", Noting(said), readers)
    engine.inspect(folder)
    o = JobOptions(target_lang="Thai", mode="bilingual", model="x-lite")
    from quire.operators import cache

    prefix = engine._prefix(o)
    logs.append_cache(cache.with_keys(spark.createDataFrame([("First paragraph here", "from cache")], "text string, t string"), prefix).select("k", "t"), f"file://{tmp_path}/data/cache", 1)
    assert engine.start(o) == "completed" and open(said).read() == "Second paragraph here\n"
    engine.clear_cache()
    assert engine.start(o) == "completed" and open(said).read() == "Second paragraph here\n"
    assert all(r["done"] == r["total"] == 2 for r in engine.segments().collect())


def test_cancelled_jobs_keep_what_is_finished(spark, tmp_path):
    import threading
    import time

    folder, readers = _book_of(spark, tmp_path, [f"Paragraph {k} with words enough\n\n" + f"word{k} " * 3000 for k in range(12)])
    said = f"{tmp_path}/said"

    class Slow(Noting):
        def __call__(self, model, items):
            time.sleep(0.5)
            return super().__call__(model, items)

    engine = Engine(spark, f"file://{tmp_path}/data", Slow(said), readers, workers=1)
    engine.inspect(folder)
    o, got = JobOptions(target_lang="Thai", mode="bilingual", model="x-lite"), []
    job = threading.Thread(target=lambda: got.append(engine.start(o)))
    job.start()
    while not (engine.progress() or {}).get("done"):
        time.sleep(0.1)
        assert job.is_alive()
    assert engine.job_is_running() and engine.progress()["status"] == "running"
    with pytest.raises(ValueError, match="running"):
        engine.start(o)
    engine.cancel()
    job.join(120)
    assert got == ["cancelled"] and not engine.job_is_running() and engine.output is None
    first = open(said).read().splitlines()
    finished = engine.progress()["done"]
    assert 0 < finished < engine.progress()["total"]
    assert engine.start(o) == "completed"
    every = open(said).read().splitlines()
    assert len(every) == len(set(every)), "no text was sent twice"
    assert len(every) > len(first) and engine.progress()["chars_start"] > 0


def test_fallback_answers_are_cached_under_the_model_that_gave_them(spark, tmp_path):
    folder, readers = _book_of(spark, tmp_path, ["First paragraph here"])

    def dry(model, items):
        return ("quota", [], 0, "spent") if model == "gemini-3.5-flash-lite" else ("ok", [(i, model) for i, _ in items], 1)

    engine = Engine(spark, f"file://{tmp_path}/data", dry, readers)
    engine.inspect(folder)
    o = JobOptions(target_lang="Thai", mode="bilingual", sample=True)
    assert engine.start(o) == "completed"
    known = lambda model: engine._known(JobOptions(target_lang="Thai", model=model), engine.blocks).count()
    assert known("gemini-3.5-flash-lite") == 0 and known("gemini-3.1-flash-lite") == 1
    used = {r["model"]: r["requests"] for r in engine.usage().collect()}
    assert used == {"gemini-3.5-flash-lite": 1, "gemini-3.1-flash-lite": 1}
    assert engine.start(JobOptions(target_lang="Lao", auto_switch_model=False, sample=True)) == "failed"


def test_errors_leave_the_job_failed(spark, tmp_path):
    folder, readers = _book_of(spark, tmp_path, ["First paragraph here"])

    def broken(model, items):
        raise RuntimeError("out of order")

    engine = Engine(spark, f"file://{tmp_path}/data", broken, readers)
    assert engine.progress() is None
    engine.inspect(folder)
    with pytest.raises(Exception, match="out of order"):
        engine.start(JobOptions(target_lang="Thai"))
    assert engine.progress()["status"] == "failed" and "out of order" in engine.progress()["error"] and not engine.job_is_running()
