"""Splitting oversized texts and packing items into batches of bounded token estimates.

Packing is a greedy fold in a fixed order, done as a parallel scan. A book's items are cut into blocks
of documents that follow each other. A block is summed up as a function: from the open group that
comes in (items, size) to the one that goes out and the groups closed between; since a group is
bounded, that is a short table. Tables are composed along the book, one small row a block, and then
every block numbers its own groups. Numbers only are walked; texts join later by their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import estimate_tokens, token_budget

MAX_ITEMS, SAMPLE_ITEMS = 100, 25


# ---------------------------------------------------------------- splitting


def split_text(text: str, budget: int) -> list[str]:
    """Parts that put together give the text.

    A part ends at the first whitespace, or the first stretch of four times the target, from which
    on its estimate reaches the target (half the budget, 200 at least).
    """
    target = max(budget // 2, 200)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.concatenate([[0], np.cumsum(code < 128)])
    space = np.frombuffer(np.array([c.isspace() and c not in "\x1c\x1d\x1e\x1f" for c in text], bool), bool) if len(text) else np.zeros(0, bool)
    parts, start, n = [], 0, len(code)
    while start < n:
        cut, look = n, start
        while look < n:
            end = np.arange(look + 1, min(n, look + 4 * target + 64) + 1)
            a = plain[end] - plain[start]
            full = a // 4 + (end - start - a) * 10 // 23 >= target
            ok = np.flatnonzero(full & (space[end - 1] | (end - start >= 4 * target)))
            if len(ok):
                cut = int(end[ok[0]])
                break
            look = int(end[-1])
        parts.append(text[start:cut])
        start = cut
    return parts


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(texts: pd.Series, budgets: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else split_text(t, int(b)) for t, b in zip(texts, budgets, strict=True)], dtype=object)


def split_oversized(blocks: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """blocks with part and n_parts (null where a text fits), and a row for each part of one that does not.

    One pass; Python sees oversized texts only, and null for the others.
    """
    over = blocks.withColumn("_parts", _split(F.when(estimate_tokens(F.col(text)) > budget, F.col(text)), F.lit(budget)))
    rest = [c for c in blocks.columns if c != text]
    rows = over.select(*rest, F.col(text).alias("_whole"), F.when(F.col("_parts").isNotNull(), F.size("_parts")).alias("n_parts"), F.posexplode_outer("_parts").alias("part", "_part"))
    return rows.select(*rest, F.when(F.col("n_parts").isNull(), F.col("_whole")).otherwise(F.col("_part")).alias(text), "part", "n_parts")


# ---------------------------------------------------------------- the greedy fold


#: Documents (values of the first order column) of a block.
BLOCK_DOCS = 4096
_EXITS = "array<struct<n:long,size:long,closed:long>>"


class Walk:
    """Greedy groups over the sizes of a block's items."""

    def __init__(self, sizes: np.ndarray, limit: int, most: int | None):
        self.total = np.concatenate([[0], np.cumsum(sizes)])
        self.n, self.limit, self.most = len(sizes), limit, most or len(sizes) + (1 << 62)
        fits = np.searchsorted(self.total, self.total[:-1] + limit, "right") - 1
        here = np.arange(self.n)
        #: where the group after one that begins at an item begins
        self.next = np.minimum(np.maximum(fits, here + 1), here + min(self.most, self.n + 1))

    def head(self) -> int:
        """Items at the front that an open group may still take, at most."""
        return int(min(np.searchsorted(self.total, self.limit, "right") - 1, self.most, self.n))

    def exits(self) -> list[tuple[int, int, int]]:
        """For a group that begins at item 0, 1, ... up to head(): the group open at the end (items, size), and groups closed."""
        known: dict[int, tuple[int, int, int]] = {self.n: (0, 0, 0)}
        out = []
        for e in range(self.head() + 1):
            path, i = [], e
            while i not in known:
                path.append(i)
                if self.next[i] >= self.n:
                    known[i] = (self.n - i, int(self.total[-1] - self.total[i]), 0)
                    path.pop()
                    break
                i = int(self.next[i])
            for j in reversed(path):
                a, b, c = known[int(self.next[j])]
                known[j] = (a, b, c + 1)
            out.append(known[e])
        return out

    def groups(self, n: int, size: int, group: int) -> np.ndarray:
        """The group of each item, where one of n items and this size is open and has this number."""
        at = taken(self.total[1:], n, size, self.limit, self.most) if n else 0
        mark = np.zeros(self.n, np.int64)
        i = at
        while i < self.n:
            mark[i] = 1
            i = int(self.next[i])
        return group + np.cumsum(mark) - (0 if n else 1)


def taken(sums: np.ndarray, n: int, size: int, limit: int, most: int | None) -> int:
    """How many items with these running sums an open group takes."""
    return int(min(np.searchsorted(sums, limit - size, "right"), len(sums) if most is None else max(most - n, 0)))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of equal, adjacent values in the first columns, whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        marks = list(zip(*[b.column(i).to_pylist() for i in range(keys)], strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if held or i > start:
                    yield from _whole([*held, b.slice(start, i - start)])
                held, start, last = [], i, mark
        held.append(b.slice(start))
    yield from _whole(held)


def _whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in held if b.num_rows]
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def assign_groups(items: DataFrame, key: str, order: list[str], size: str, limit: int, max_items: int | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Number greedy groups of each key in order: key, order..., keep..., size, group_id.

    A group closes before an item that would bring its sum over limit, or when it has max_items.
    The columns in keep travel along, which spares a join. The first order column is a number; sizes
    are not negative.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_key")  # null is a key too
    block = F.coalesce(F.floor(F.col(order[0]) / BLOCK_DOCS).cast("long"), F.lit(-1)).alias("_block")
    names = [key, *order, *(k for k in keep if k != size), size]
    dealt = items.select(named, block, F.col(size).cast("long").alias(size), *names[:-1]).repartition("_key", "_block")
    src = dealt.sortWithinPartitions("_key", "_block", *order)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, 2):
            walk = Walk(np.asarray(b.column(2)), limit, max_items)
            exits = [{"n": n, "size": s, "closed": c} for n, s, c in walk.exits()]
            row = [[walk.n], [int(walk.total[-1])], [walk.total[1 : walk.head() + 1].tolist()], [exits]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([(f, pa.int64()) for f in ("n", "size", "closed")]))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), b.column(1).slice(0, 1), *[pa.array(v, t) for v, t in zip(row, types, strict=True)]], ["_key", "_block", "n", "total", "head", "exits"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), (0, 0, 0)
        for b in batches:
            out = []
            for k, n, total, head, exits in zip(*[b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)], strict=True):
                if k != last:
                    last, state = k, (0, 0, 0)
                out.append(state)
                open_, held, group = state
                at = taken(np.array(head, np.int64), open_, held, limit, max_items) if open_ else 0
                if open_ and at == n:
                    state = (open_ + n, held + total, group)
                else:
                    x = exits[at]
                    state = (x["n"], x["size"], group + (1 if open_ else 0) + x["closed"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[i] for x in out], pa.int64()) for i in range(3)]], ["_key", "_block", "_n", "_size", "_group"])

    sums = src.mapInArrow(sum_up, f"_key string, _block long, n long, total long, head array<long>, exits {_EXITS}")
    states = sums.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(compose, "_key string, _block long, _n long, _size long, _group long")
    rows = dealt.join(states.hint("merge"), ["_key", "_block"]).sortWithinPartitions("_key", "_block", *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, 2):
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            first = [cols[c][0].as_py() for c in ("_n", "_size", "_group")]
            ids = Walk(np.asarray(cols[size]), limit, max_items).groups(*first)
            yield pa.RecordBatch.from_arrays([*[cols[c] for c in names], pa.array(ids, pa.int64())], [*names, "group_id"])

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(number, f"{schema}, group_id long")


def build_batches(items: DataFrame, model: str, key: str = "book", order: tuple[str, ...] = ("d", "b", "part"), keep: tuple[str, ...] = ("chars",)) -> DataFrame:
    """(key, order, keep, tokens, batch_id) of items: the requests of each book, across its documents."""
    return assign_groups(items, key, list(order), "tokens", token_budget(model), MAX_ITEMS, keep).withColumnRenamed("group_id", "batch_id")


def items_of(blocks: DataFrame, model: str) -> DataFrame:
    """Translatable blocks as items: oversized ones split, with chars and tokens of each."""
    parts = split_oversized(blocks.where(~F.col("skipped")), token_budget(model))
    return parts.withColumns({"chars": F.length("text").cast("long"), "tokens": estimate_tokens(F.col("text")), "part": F.coalesce("part", F.lit(-1))})


def batch_totals(batched: DataFrame, key: str = "book") -> DataFrame:
    return batched.groupBy(key, "batch_id").agg(F.count(F.lit(1)).alias("items"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def first_items(batched: DataFrame, n: int = SAMPLE_ITEMS, key: str = "book", order: tuple[Column | str, ...] = ("d", "b", "part")) -> DataFrame:
    """The first n items of each book; batches beyond go, and the one they end in keeps what is left of it."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return batched.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


#: What a debug export shows of a book.
DEBUG_BATCHES, DEBUG_SPLITS = 5, 12


def first_batches(batched: DataFrame, n: int = DEBUG_BATCHES, key: str = "book") -> DataFrame:
    """Totals of each book's first n batches."""
    return batch_totals(batched.where(F.col("batch_id") < n), key)


def first_splits(items: DataFrame, n: int = DEBUG_SPLITS, key: str = "book", order: tuple[str, ...] = ("d", "b")) -> DataFrame:
    """(key, order, n_parts, k): each book's first n blocks that were split, numbered from 0."""
    blocks = items.where("part = 0").select(key, *order, "n_parts")
    return blocks.withColumn("k", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")).where(F.col("k") < n)
