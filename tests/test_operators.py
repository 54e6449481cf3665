import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.text import is_translatable
from quire.operators import batching, cache, html_blocks, pages, progress
from quire.operators.batching import split_text


def est(s):
    a = sum(ord(c) < 128 for c in s)
    return a // 4 + (len(s) - a) * 10 // 23


def slow_split(text, budget):
    target, parts, cur = max(budget // 2, 200), [], ""
    for c in text:
        cur += c
        if est(cur) >= target and (c.isspace() or len(cur) >= 4 * target):
            parts.append(cur)
            cur = ""
    return parts + ([cur] if cur else [])


@given(st.lists(st.sampled_from(["word ", "x" * 900, "é", "မြန် ", " ", "a" * 70, "ü" * 300]), max_size=30), st.sampled_from([0, 400, 900]))
@settings(max_examples=60, deadline=None)
def test_split_is_the_fold_and_lossless(bits, budget):
    text = "".join(bits)
    got = split_text(text, budget)
    assert "".join(got) == text and got == slow_split(text, budget)


def test_split_of_plain_ascii_cuts_hard():
    assert [len(p) for p in split_text("word " * 5200, 5000)] == [10000, 10000, 6000]


def _blocks(spark, rows):
    df = spark.createDataFrame(rows, "book string, d long, b long, text string")
    return df.withColumn("skipped", ~is_translatable(F.col("text")))


def test_batches_keep_their_budget(spark):
    rows = [("k", 0, i, f"paragraph number {i} " * 30) for i in range(200)] + [("k", 1, 0, "tiny"), ("k", 1, 1, "a full sentence here")]
    counts = {}
    for model in ("x-lite", "x"):
        items = batching.items_of(_blocks(spark, rows), model)
        done = batching.batch_totals(batching.build_batches(items, model)).orderBy("batch_id").collect()
        assert sum(r["items"] for r in done) == 202
        assert all(r["items"] <= 100 and r["tokens"] <= batching.token_budget(model) for r in done)
        counts[model] = len(done)
    assert counts["x"] < counts["x-lite"]
    few = batching.items_of(_blocks(spark, [("k", 0, 0, "ok"), ("k", 0, 1, "x"), ("k", 0, 2, "42"), ("k", 0, 3, "another one")]), "x-lite")
    assert [(r["items"], r["batch_id"]) for r in batching.batch_totals(batching.build_batches(few, "x-lite")).collect()] == [(2, 0)]


def test_groups_equal_the_greedy_rule(spark):
    rng = random.Random(8)
    rows = [(f"b{k}", i, rng.choice([0, 1, 50, 120, 300])) for k in range(5) for i in range(rng.randrange(1, 200))]
    want = {}
    for book in {r[0] for r in rows}:
        g = total = n = 0
        for _, i, size in sorted(r for r in rows if r[0] == book):
            if n and (total + size > 400 or n >= 7):
                g, total, n = g + 1, 0, 0
            total, n = total + size, n + 1
            want[book, i] = g
    got = batching.assign_groups(spark.createDataFrame(rows, "book string, i long, size long").repartition(7), "book", ["i"], "size", 400, 7)
    assert {(r["book"], r["i"]): r["group_id"] for r in got.collect()} == want


def test_sample_is_a_prefix(spark):
    rows = [("k", 0, i, "some words here " * 40) for i in range(60)]
    items = batching.items_of(_blocks(spark, rows), "x-lite")
    whole = batching.build_batches(items, "x-lite")
    kept = batching.first_items(whole)
    assert [r["b"] for r in kept.orderBy("d", "b").collect()] == list(range(25))
    assert batching.batch_totals(kept).agg(F.sum("items")).first()[0] == 25


def test_running_headers_go(spark):
    body = lambda i: f"Some text of {'abcdefghijkl'[i]}w\nand a second line of {'abcdefghijkl'[i]}w"
    rows = [("k", i, f"{20 + i} Early Buddhist Theory of Knowledge\n{body(i)}" if i % 2 else f"{body(i)}\nThe Historical Background {21 + i}") for i in range(12)]
    out = pages.strip_furniture(spark.createDataFrame(rows, "book string, page long, text string")).collect()
    assert sum(r["stripped"] for r in out) == 12 and all(r["text"] == body(r["page"]) for r in out)


def test_page_numbers_go_where_pages_have_them(spark):
    ends = ["12", "- 13 -", "[14]", "Page 15", "xvi", " p. 16 ", "2o", "i6"]
    rows = [("k", i, f"Line one of {i}x\nLine two of {i}x\n{e}") for i, e in enumerate(ends)]
    rows += [("q", i, f"Heading {'abcde'[i]}\nText{'abcde'[i]} body") for i in range(5)]
    rows += [("z", i, "II\nSome text" if i == 0 else "In 1947 it was\nmore") for i in range(5)]
    out = pages.strip_furniture(spark.createDataFrame(rows, "book string, page long, text string"))
    got = {r["book"]: r["n"] for r in out.groupBy("book").agg(F.sum("stripped").alias("n")).collect()}
    assert got["k"] == 8 and got["q"] == 0


def test_furniture_needs_two_lines_and_keeps_blanks(spark):
    rows = [("k", i, "Title") for i in range(5)] + [("m", i, f"Head\n\nA{i}\n\nB{i}\nHead") for i in range(4)]
    out = {(r["book"], r["page"]): r for r in pages.strip_furniture(spark.createDataFrame(rows, "book string, page long, text string")).collect()}
    assert out["k", 0]["stripped"] == 0
    assert out["m", 1]["stripped"] == 2 and out["m", 1]["text"] == "\nA1\n\nB1"


def test_paragraphs_and_chapters(spark):
    rows = [("k", 0, "One two\nthree\n\nFour five\n"), ("k", 1, "\n".join(f"line{i}" for i in range(13)) + "\n")]
    out = pages.paragraphs(spark.createDataFrame(rows, "book string, page long, text string"), ["book", "page"]).orderBy("page", "paragraph").collect()
    assert [r["text"] for r in out][:2] == ["One two three", "Four five"]
    assert [len(r["text"].split()) for r in out][2:] == [6, 6, 1]
    paras = spark.createDataFrame([("k", i, "x" * 1000) for i in range(20)], "book string, i long, text string")
    got = pages.chapters(paras, "book", ["i"]).groupBy("chapter", "chapter_id", "title").count().orderBy("chapter").collect()
    assert [tuple(r) for r in got] == [(1, "ch001", "Part 1", 8), (2, "ch002", "Part 2", 8), (3, "ch003", "Part 3", 4)]


def test_html_blocks():
    assert html_blocks.raw_blocks("<p>Hello world</p><p>42</p><p>Bye now</p>") == [("p", "Hello world"), ("p", "42"), ("p", "Bye now")]
    assert html_blocks.raw_blocks("<ul><li>Outer <ul><li>Inner</li></ul></li></ul>") == [("li", "Outer "), ("li", "Inner")]
    assert html_blocks.raw_blocks("<p>Hi <em>there</em>, &amp; welcome!</p>") == [("p", "Hi there, & welcome!")]
    assert html_blocks.raw_blocks("<p>a<br>b</p></p><div>no</div><p>open<script>x='</p>'</script>") == [("p", "ab"), ("p", "openx='</p>'")]


def test_html_blocks_table(spark):
    df = spark.createDataFrame([(1, "<p>Hello&nbsp;  world</p><p>42</p>"), (2, None), (3, "")], "d long, html string")
    rows = html_blocks.collect(df).orderBy("d", "b").collect()
    assert [(r["d"], r["b"], r["text"], r["skipped"]) for r in rows] == [(1, 0, "Hello world", False), (1, 1, "42", True)]


def test_html_rewrite():
    page = "<html><head><title>t</title></head><body><!-- c --><p>One</p><ul><li>Two <b>x</b><ul><li>In</li></ul></li></ul><th>h</th></body></html>"
    both = html_blocks.rewrite(page, {0: "<1>", 1: "2", 3: "4"}, True)
    assert '<p>One</p><p class="ebtr-translation">&lt;1&gt;</p>' in both and '</ul></li><li class="ebtr-translation">2</li>' in both
    assert '<th>h</th><td class="ebtr-translation">4</td>' in both and both.count("<style") == 1 and "<!-- c -->" in both
    only = html_blocks.rewrite(page, {0: "A", 1: "B"}, False)
    assert "<p>A</p>" in only and "<li>B<b></b><ul><li>In</li></ul></li>" in only and "<style" not in only
    assert html_blocks.rewrite(page, {}, False) == page


def test_parts_join_only_when_complete(spark):
    rows = [("k", 0, 2, "b", 1), ("k", 0, 2, "a", 0), ("q", 0, 2, "a", 0), ("q", 0, 2, None, 1), ("z", 0, 1, "w", 0)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[3]) for r in rows], "k string, part int, n_parts int, t string")
    assert {r["k"]: r["translation"] for r in progress.join_parts(df, ["k"]).collect()} == {"k": "ab", "q": None, "z": "w"}


def test_segments_and_status(spark):
    rows = [("a", False, "x"), ("a", False, None), ("b", False, "x"), ("b", True, None), ("c", True, None), ("d", False, None)]
    df = spark.createDataFrame(rows, "s string, skipped boolean, translation string")
    assert {r["s"]: (r["done"], r["total"], r["state"]) for r in progress.segments(df, ["s"]).collect()} == {"a": (1, 2, "active"), "b": (1, 1, "done"), "c": (0, 0, "pending"), "d": (0, 1, "pending")}
    cases = [(True, False, 0, 3, "failed"), (False, True, 0, 3, "cancelled"), (False, False, 3, 3, "failed"), (False, False, 1, 3, "partial"), (False, False, 0, 0, "completed")]
    jobs = spark.createDataFrame(cases, "f boolean, c boolean, n int, b int, want string")
    assert jobs.where(progress.job_status(F.col("f"), F.col("c"), F.col("n"), F.col("b")) != F.col("want")).count() == 0


def test_pending_requests(spark):
    hits = {"none": [], "resumed": [1], "cached": [1]}
    rows = [("k", b, i, b == 2) for b in range(3) for i in range(2)]
    half = [("k", b, i, b == 2 or (b == 0 and i == 0)) for b in range(3) for i in range(2)]
    frame = lambda r: spark.createDataFrame(r, "book string, batch_id long, i long, hit boolean")
    log = lambda ids: spark.createDataFrame([("k", i) for i in ids], "book string, batch_id long")
    got = lambda r, ids: tuple(cache.pending(frame(r), log(ids)).select("requests", "done").first())
    assert got([(a, b, c, False) for a, b, c, _ in rows], hits["none"]) == (3, 0)
    assert got([(a, b, c, False) for a, b, c, _ in rows], hits["resumed"]) == (2, 1)
    assert got(rows, hits["cached"]) == (1, 2) and got(half, hits["cached"]) == (1, 2)


def test_counters_and_usage_line(spark):
    rows = [("k", 0, "done", 5, False), ("k", 0, "done", 0, True), ("k", 1, "failed", 7, False), ("k", 2, "done", 0, True)]
    df = spark.createDataFrame(rows, "book string, batch_id long, outcome string, tokens long, hit boolean")
    assert tuple(progress.counters(df).first()) == (3, 1, 5, 2)
    cases = spark.createDataFrame([(0, False), (1, False), (2, None), (3, True), (None, None)], "n long, e boolean")
    got = [r[0] for r in cases.select(progress.usage_line(F.col("n"), F.col("e"), F.lit("08:00"))).collect()]
    assert got == ["daily quota resets 08:00", "1 request on this model today · resets 08:00", "2 requests on this model today · resets 08:00", "quota exhausted for today — resets 08:00", "daily quota resets 08:00"]


def _greedy(sizes, limit, most):
    out, total, count, group = [], 0, 0, 0
    for n in sizes:
        if count and (total + n > limit or most is not None and count >= most):
            total, count, group = 0, 0, group + 1
        total, count = total + n, count + 1
        out.append(group)
    return out


def test_blocks_compose_to_the_greedy_fold():
    """Blocks summed up one by one, composed, and numbered on their own, against one walk over all items."""

    import numpy as np

    from quire.operators.batching import Walk, taken

    rng = random.Random(1)
    for _ in range(1500):
        limit, most = rng.choice([1, 5, 10, 40]), rng.choice([None, 1, 3, 7])
        blocks = [[rng.choice([0, 1, 2, 5, 9, 50]) for _ in range(rng.randrange(1, rng.choice([3, 30])))] for _ in range(rng.randrange(1, 7))]
        state, got = (0, 0, 0), []
        for b in blocks:
            walk = Walk(np.array(b), limit, most)
            got += walk.groups(*state).tolist()
            n, size, group = state
            at = taken(walk.total[1 : walk.head() + 1], n, size, limit, most) if n else 0
            if n and at == len(b):
                state = (n + len(b), size + sum(b), group)
            else:
                x = walk.exits()[at]
                state = (x[0], x[1], group + (1 if n else 0) + x[2])
        assert got == _greedy(sum(blocks, []), limit, most)


@pytest.mark.parametrize("docs", [1, 4, 4096])
def test_groups_over_many_blocks(spark, monkeypatch, docs):


    monkeypatch.setattr(batching, "BLOCK_DOCS", docs)
    rng = random.Random(docs)
    rows = [(book, d, b, rng.choice([0, 3, 40, 90, 300]), f"{d}-{b}") for book in ("one", "two", None) for d in range(-3, 30) for b in range(rng.randrange(0, 9))]
    df = spark.createDataFrame(rows, "book string, d long, b long, n long, tag string").repartition(5)
    for limit, most in ((100, None), (250, 3)):
        want = {}
        for book in ("one", "two", None):
            mine = [r for r in rows if r[0] == book]
            want |= {(book, r[1], r[2]): (r[3], r[4], g) for r, g in zip(mine, _greedy([r[3] for r in mine], limit, most), strict=True)}
        got = batching.assign_groups(df, "book", ["d", "b"], "n", limit, most, ("tag",))
        assert got.columns == ["book", "d", "b", "tag", "n", "group_id"]
        assert {(r["book"], r["d"], r["b"]): (r["n"], r["tag"], r["group_id"]) for r in got.collect()} == want
    assert batching.assign_groups(df.limit(0), "book", ["d", "b"], "n", 5, None).count() == 0


def test_debug_exports(spark):

    items = spark.createDataFrame([("k", 0, b, p, 2) for b in range(20) for p in (0, 1)] + [("k", 1, 0, -1, None)], "book string, d long, b long, part int, n_parts int")
    assert [(r["b"], r["k"]) for r in batching.first_splits(items).orderBy("k").collect()] == [(i, i) for i in range(12)]
