"""Substring dedup by recompression: words that repeated passages cover are removed.

Each document's words become symbols, and rounds rename them: runs of one symbol get one name, then
pairs whose first symbol falls in the left class and whose second falls in the right class get one
name. Names and classes are functions of the content, so every task names the same runs and pairs
alike without exchanging a dictionary, and equal substrings get equal symbols inside, whatever
stands around them.

What a window of words has inside for certain is found by dropping, in every round, what could be
drawn into a neighbour outside: the first and the last run, a leading right symbol, a trailing left
symbol. The window's anchor is the longest symbol left in the last round that leaves any (of equal
ones that of smallest name); equal windows have the same anchor at the same place. Neighbouring
windows on one anchor make one row. Names only bring rows together; whether their words are equal is
verified on a 128-bit digest of the words' bytes, so unequal words under one name change nothing. In
Spark, then:

1. The rows are counted by anchor name alone (partly before the shuffle). Those of a name that occurs
   once can hold no repeat and go; only the others are dealt with their digests.
2. Rows whose words all occur again are repeats entirely.
3. Where one name stands among different words (the edges of repeats), each distinct stretch of words
   is opened into its windows, which are compared by the digests of their words.

Texts are dealt by row key once, into a bucketed table, beside which both the opening and the
removal find their rows without moving texts again.

A very long text is taken in parts that overlap by a window less one word; a row that a part's end
cuts shares its name with whole ones, so step 3 settles it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACED, U64, Part, chunks, drop, mix, owner, parts, range_digests, row_key, signed, spaced, table, word_names
from quire.shared import _fs, shared_dir

#: Words of a window; rounds; rounds that name runs (single words repeat, later names rarely do). After four
#: rounds a window of 35 words still holds several symbols of three words on average, among which neighbouring
#: windows mostly choose the same one: about one row for 11 words.
WINDOW, ROUNDS, RUN_ROUNDS = 35, 4, (1,)
#: Bytes of the input, as stored, that a bucket holds, about.
BUCKET_BYTES = 16 << 20

_RUN, _PAIR_A, _PAIR_B, _LEVEL = U64(0x8CB92BA72F3D8DD7), U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93), U64(0xA24BAED4963EE407)


def parse_round(name: np.ndarray, brk: np.ndarray, level: int, left: np.ndarray, right: np.ndarray):
    """One round: new names, first-of-document flags, first old symbol of each, and the windows' new [left, right).

    left and right are the certain symbols of each window; afterwards a window may have none.
    """
    n = len(name)
    old = np.arange(n)
    if level in RUN_ROUNDS:
        new = brk.copy()
        new[1:] |= name[1:] != name[:-1]
        head = np.flatnonzero(new)
        if len(head) < n:
            size = np.diff(np.append(head, n))
            run = np.cumsum(new) - 1
            name, brk, old = name[head], brk[head], head
            many = size > 1
            name = name.copy()
            name[many] = mix(name[many] * _RUN + size[many].astype(U64))
            left, right = run[left] + 1, run[right - 1]
        else:
            left, right = left + 1, right - 1
        ok = left < right
        left, right = np.where(ok, left, 0), np.where(ok, right, 1)
    else:
        ok = None
    side = (mix(name + U64(level * int(_LEVEL) & (1 << 64) - 1)) & U64(1)).astype(bool)  # True: right class
    merge = np.zeros(len(name), bool)
    merge[:-1] = ~side[:-1] & side[1:] & ~brk[1:]
    left = left + side[left]
    right = right - ~side[right - 1]
    alive = left < right if ok is None else ok & (left < right)
    keep = np.ones(len(name), bool)
    keep[1:] = ~merge[:-1]
    to = np.cumsum(keep) - 1
    pair = np.flatnonzero(merge)
    name = name.copy()
    name[pair] = mix(name[pair] * _PAIR_A + mix(name[pair + 1] + _PAIR_B))
    first = np.flatnonzero(keep)
    left, right = np.where(alive, to[np.where(alive, left, 0)], 0), np.where(alive, to[np.where(alive, right - 1, 0)] + 1, 0)
    return name[first], brk[first], old[first], left, right, alive


def smallest(name: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each range the index of its smallest name, the first of equal ones."""
    best, value = left.copy(), name[left]
    todo, at = np.flatnonzero(right - left > 1), 1
    while len(todo):
        i = left[todo] + at
        v = name[i]
        less = v < value[todo]
        hit = todo[less]
        best[hit], value[hit] = i[less], v[less]
        at += 1
        todo = todo[right[todo] - left[todo] > at]
    return best


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Rows (document, first window, windows, name) of all documents of a chunk."""
    doc = owner(first, len(words))
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(words)) + window <= end)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64)
    brk = np.zeros(len(words), bool)
    brk[first[:-1][np.diff(first) > 0]] = True
    name, start = words, np.arange(len(words))
    live, left, right = np.arange(len(at)), at, at + window
    key, place = np.empty(len(at), U64), np.empty(len(at), np.int64)

    def settle(rows: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> None:
        span = np.diff(np.append(start, len(words)))
        order = np.where(span < 255, 255 - span, 0).astype(U64) << U64(56) | name >> U64(8)
        best = smallest(order, a, b)
        key[rows] = mix(name[best] ^ U64((level + 1) * int(_LEVEL) & (1 << 64) - 1))
        place[rows] = start[best]

    for level in range(1, ROUNDS + 1):
        new_name, new_brk, old, new_left, new_right, alive = parse_round(name, brk, level, left, right)
        gone = ~alive
        settle(live[gone], left[gone], right[gone], level - 1)
        live, left, right = live[alive], new_left[alive], new_right[alive]
        name, brk, start = new_name, new_brk, start[old]
        if not len(live):
            break
    if len(live):
        settle(live, left, right, ROUNDS)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    a = at[head]
    return doc[a], a - first[doc[a]], count, key[head]


# ---------------------------------------------------------------- Spark


def _anchor_rows(window: int):
    names = ["rid", "key", "w1", "w2", "a", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            for p in parts(b.column(1), SPACED, window - 1):
                buf, at = spaced(p.data, p.s, p.e)
                doc, a, n, key = anchors(word_names(buf, at), p.first, window)
                begin = p.first[doc] + a
                words = range_digests(buf, at[begin], at[begin + n + window - 1])
                small = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(p.rows[doc])), pa.array(signed(key)), pa.array(words[:, 0]), pa.array(words[:, 1]), small(a + p.base[doc]), small(n)], names)

    return run


def _window_rows(window: int):
    names = ["w1", "w2", "rid", "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            ranges = b.column(2)
            count = np.diff(np.asarray(ranges.offsets)) if len(ranges) else np.zeros(0, np.int64)
            flat = ranges.flatten()
            row = np.repeat(np.arange(b.num_rows), count)
            low = np.asarray(flat.field("a")).astype(np.int64)
            high = low + np.asarray(flat.field("n"))
            for p in parts(b.column(1), SPACED, window - 1):
                a = np.maximum(low - p.base[row], 0)
                n = np.maximum(np.minimum(high - p.base[row], p.own[row]) - a, 0)
                pos = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                doc = np.repeat(row, n)
                buf, at = spaced(p.data, p.s, p.e)
                begin = p.first[doc] + pos
                words = range_digests(buf, at[begin], at[begin + window])
                yield pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1]), b.column(0).take(pa.array(p.rows[doc])), pa.array((pos + p.base[doc]).astype(np.int32))], names)

    return run


def dealt(src: DataFrame, name: str = "texts") -> DataFrame:
    """src (with rid) as a table bucketed by rid in the shared folder: joins by rid move its rows no more."""
    spark = src.sparkSession
    size = int(str(src._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // BUCKET_BYTES) if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))  # a size not known
    n = max(spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")), wanted))
    entry = f"quire_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quire/{entry}"
    src.repartition(n, "rid").write.option("compression", "zstd").option("path", path).bucketBy(n, "rid").saveAsTable(entry, format="parquet")
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return spark.table(entry)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, spans): for each row key of docs (rid, text) the word ranges [a, b) that repeated windows cover."""
    rows = table(docs.mapInArrow(_anchor_rows(window), "rid binary, key long, w1 long, w2 long, a int, n int"), "anchors")
    keys = table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "keys")
    some = table(rows.join(keys.hint("merge"), "key"), "shared")
    drop(rows, keys)
    contexts = table(some.groupBy("key", "w1", "w2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rid", "a", "n")).alias("one")), "contexts")
    again = contexts.where("m > 1").select("w1", "w2").hint("merge")
    whole = table(some.select("rid", "w1", "w2", "a", "n").join(again, ["w1", "w2"], "left_semi").select("rid", "a", (F.col("a") + F.col("n") + (window - 1)).alias("b")), "whole")
    mixed = table(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "mixed")
    opened = contexts.join(mixed.hint("merge"), "key").groupBy(F.col("one.rid").alias("rid")).agg(F.collect_list(F.struct("one.a", "one.n")).alias("ranges"))
    opened = table(opened, "opened")
    drop(some, contexts, mixed)
    # a row that repeats is opened once for each copy; all its windows do occur again
    windows = table(docs.join(opened.hint("merge"), "rid").select("rid", "text", "ranges").mapInArrow(_window_rows(window), "w1 long, w2 long, rid binary, a int"), "windows")
    twice = table(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("w1", "w2"), "twice")
    edges = windows.join(twice.hint("merge"), ["w1", "w2"], "left_semi").select("rid", "a", (F.col("a") + window).alias("b"))
    spans = table(whole.unionByName(edges).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    drop(whole, opened, windows, twice)
    return spans


def _covered(p: Part, spans: pa.ListArray) -> np.ndarray:
    """For each own word of a part whether any span of its text covers it."""
    begin = np.concatenate([[0], np.cumsum(p.own)])
    edge = np.zeros(begin[-1] + 1, np.int64)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)))
    for field, by in (("a", 1), ("b", -1)):
        np.add.at(edge, begin[row] + np.clip(np.asarray(flat.field(field)) - p.base[row], 0, p.own[row]), by)
    return np.cumsum(edge)[:-1] > 0


def _pieces(b: pa.RecordBatch, text: str, spans: str) -> Iterator[tuple[int, np.ndarray, memoryview, np.ndarray, np.ndarray]]:
    """For each text, part by part: (row, covered words, bytes, words' first and end bytes)."""
    for p in parts(b.column(b.schema.get_field_index(text)), SPACED):
        gone = _covered(p, b.column(b.schema.get_field_index(spans)))
        raw = memoryview(np.ascontiguousarray(p.data))
        for row, x, y in zip(p.rows.tolist(), p.first[:-1].tolist(), p.first[1:].tolist(), strict=True):
            yield row, gone[x:y], raw, p.s[x:y], p.e[x:y]


def _kept(raw: memoryview, s: np.ndarray, e: np.ndarray, keep: np.ndarray) -> bytes:
    return b" ".join([raw[a:z] for a, z in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])


def _with_spans(docs: DataFrame, text_col: str, id_col: str, window: int) -> tuple[DataFrame, list[str]]:
    fields = [f.name for f in docs.schema.fields]
    inner = docs.toDF(*[f"c{i}" for i in range(len(fields))])
    text, key = f"c{fields.index(text_col)}", f"c{fields.index(id_col)}"
    src = dealt(inner.withColumn(text, F.col(text).cast("string")).withColumn("rid", row_key(key, text)))
    spans = repeated_spans(src.select("rid", F.col(text).alias("text")), window)
    return src.join(spans.hint("merge"), "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))), fields


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    A word goes if it is covered by a window of `window` words whose sequence starts anywhere else
    too, same document included; all windows are judged on the input. Rows that repeat are copies
    of each other, so all their windows go. Null and empty texts have no words; texts shorter than
    a window lose nothing; other columns, whatever their names, are ignored; an empty table gives no
    rows. A very long text is worked on in parts, so memory stays a few times its bytes.
    """
    joined, fields = _with_spans(docs.select(id_col, text_col), text_col, id_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            digests = [hashlib.sha256() for _ in range(b.num_rows)]
            words, removed, some = ([0] * b.num_rows for _ in range(3))
            for row, gone, raw, s, e in _pieces(b, "text", "spans"):
                lost = int(gone.sum())
                if lost < len(gone):
                    if some[row]:
                        digests[row].update(b" ")
                    digests[row].update(_kept(raw, s, e, ~gone))
                words[row], removed[row], some[row] = words[row] + len(gone), removed[row] + lost, some[row] + len(gone) - lost
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array([d.hexdigest() for d in digests])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    src = joined.select(F.col("c0").alias("doc_id"), F.col("c1").alias("text"), "spans")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated passages taken out: a text that loses words keeps the others, joined by one space; all else stays.

    Repeated rows, and equal texts of a window or more, lose all that their windows cover and stay as
    rows (a text may become empty). Null, empty and short texts stay as they are; null ids are fine;
    an empty table stays empty; columns may have any names, those used inside included.
    """
    joined, fields = _with_spans(docs, text_col, id_col, window)
    at = fields.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            names = [n for n in b.schema.names if n != "spans"]
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            kept: dict[int, list[bytes]] = {}
            losing = set()
            touched = set(np.flatnonzero(np.diff(np.asarray(cols["spans"].offsets))).tolist()) if b.num_rows else set()
            for row, gone, raw, s, e in _pieces(b, "text", "spans") if touched else ():
                if row in touched:
                    losing |= {row} if gone.any() else set()
                    if not gone.all():
                        kept.setdefault(row, []).append(_kept(raw, s, e, ~gone))
            if losing:
                texts = cols["text"].to_pylist()
                for row in losing:
                    texts[row] = b" ".join(kept.get(row, [])).decode()
                cols["text"] = pa.array(texts, cols["text"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    src = joined.select(*[F.col(f"c{i}").alias("text") if i == at else f"c{i}" for i in range(len(fields))], "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "spans")
    done = src.mapInArrow(run, schema)
    return done.toDF(*fields)
