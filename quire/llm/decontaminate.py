"""Benchmark decontamination with an FM-index for each shard of training text.

A shard (some megabytes of whole documents inside one task, or a stretch of a very long one) becomes
a sequence of word symbols: words of the benchmark's vocabulary have ids, any other word and every
document's end is a separator, since no phrase can cross it. Words are told apart by their bytes. The
shard's suffixes are sorted (prefix doubling, distinct separators), the Burrows-Wheeler transform
goes into a wavelet matrix, and suffix positions are sampled. The test phrases are searched backwards
together by the matrix's ranks; the occurrences are located by walking to a sampled suffix, and their
words are merged into spans to remove.

Every document lies in one task, so nothing is shuffled. The benchmark is shipped in blocks of
bounded size, a bounded number of them to a pass; a shard's index is built once a pass and searched
for all its blocks. A benchmark beyond that takes more passes over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Part, byte_table, chunks, dictionary, owner, parts, spaced, table, text_bytes, word_spans

#: Words of a window; text bytes a shard; bytes of benchmark text a block; suffixes from sample to sample.
WINDOW, SHARD_BYTES, BLOCK_CHARS, SAMPLE = 10, 3 << 20, 2 << 20, 32
#: Blocks that a pass over the rows searches for: at most some 32 MB of benchmark are shipped at once.
BLOCKS_A_PASS = 16

#: Words are runs of 0-9, A-Z, a-z (A-Z are lower-cased) and anything beyond ASCII.
_WORD = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- the benchmark


@dataclass
class Vocabulary:
    """Symbols (from 1) of the benchmark's words, by the words' bytes."""

    symbols: dict[bytes, int] = field(default_factory=dict)

    def learn(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.symbols.setdefault(w, len(self.symbols) + 1) for w in words], np.int64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """0 for a word that the benchmark has not."""
        return np.array([self.symbols.get(w, 0) for w in words], np.int64)


@dataclass
class Phrases:
    """Distinct windows of one block of the benchmark."""

    windows: np.ndarray  # n x WINDOW symbols, aligned right, 0 before shorter ones
    sizes: np.ndarray  # words of each
    item_at: np.ndarray  # windows' items: items[item_at[w] : item_at[w + 1]]
    items: np.ndarray  # indices into names
    names: list[str]


def phrases(items: list[tuple[str, str]], vocabulary: Vocabulary, window: int = WINDOW) -> Phrases:
    """From (item id, text) rows; items without words give no window."""
    data, off = text_bytes(pa.array([t for _, t in items], pa.large_string()))
    data = _LOWER[data]
    s, e, first = word_spans(data, off, _WORD)
    index, forms = dictionary(*spaced(data, s, e))
    symbol = vocabulary.learn(forms)[index] if len(index) else index
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    seen: dict[tuple, set[int]] = {}
    for k, (name, _) in enumerate(items):
        words = symbol[first[k] : first[k + 1]]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            seen.setdefault(tuple(words[i : i + size].tolist()), set()).add(number[name])
    rows = np.zeros((len(seen), window), np.int32)
    for k, w in enumerate(seen):
        rows[k, window - len(w) :] = w
    sizes = np.array([len(w) for w in seen], np.int64)
    counts = np.array([len(v) for v in seen.values()], np.int64)
    flat = np.array([i for v in seen.values() for i in sorted(v)], np.int64)
    return Phrases(rows, sizes, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), flat, names)


# ---------------------------------------------------------------- the index


def suffix_order(text: np.ndarray, top: int) -> np.ndarray:
    """Suffixes sorted; symbols are 1..top, and 0 separates: separators differ, the earlier the smaller."""
    n = len(text)
    zero = np.flatnonzero(text == 0)
    at = np.flatnonzero(text)
    if not len(at):
        return zero
    bits = max(1, int(top).bit_length())
    step = max(1, 62 // bits)
    padded = np.concatenate([text, np.zeros(step, text.dtype)])
    key = padded[at].astype(np.int64)
    alive = np.ones(len(at), bool)
    for j in range(1, step):
        c = padded[at + j]
        alive &= c > 0
        key = key << bits | np.where(alive, c, 0)
    order = np.argsort(key, kind="stable")
    sa, key, alive = at[order], key[order], alive[order]
    # groups that agree in all `step` symbols without meeting a separator go on
    new = np.ones(len(sa), bool)
    new[1:] = (key[1:] != key[:-1]) | ~alive[1:]
    base = len(zero)
    rank = np.empty(n, np.int64)
    rank[zero] = np.arange(base)
    head = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
    rank[sa] = base + head
    same = ~new
    same[:-1] |= ~new[1:]
    todo = np.flatnonzero(same)
    while len(todo):
        pos = sa[todo]
        group = rank[pos]
        k2 = group * n + rank[pos + step]
        order = np.argsort(k2, kind="stable")
        pos, k2 = pos[order], k2[order]
        sa[todo] = pos
        new = np.ones(len(pos), bool)
        new[1:] = k2[1:] != k2[:-1]
        head = np.maximum.accumulate(np.where(new, todo, 0))
        rank[pos] = base + head
        same = ~new
        same[:-1] |= ~new[1:]
        todo = todo[same]
        step *= 2
    return np.concatenate([zero, sa])


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        sa = suffix_order(text, top)
        n = len(text)
        before = np.where(sa > 0, text[sa - 1], 0)
        self.bits = max(1, int(top).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.ones, self.zeros, seq = [], [], before
        for level in reversed(range(self.bits)):
            bit = (seq >> level & 1).astype(bool)
            count = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(n - int(count[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])
        marked = (sa % SAMPLE == 0) | (before == 0)
        self.before, self.marked = before, marked
        self.sampled_rank = np.cumsum(marked, dtype=np.int64) - 1
        self.samples = sa[marked]

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place of the transform."""
        base, at = np.zeros(len(symbol), np.int64), [p.astype(np.int64) for p in places]
        for k, level in enumerate(reversed(range(self.bits))):
            one = (symbol >> level & 1).astype(bool)
            count, z = self.ones[k], self.zeros[k]
            base = np.where(one, z + count[base], base - count[base])
            at = [np.where(one, z + count[p], p - count[p]) for p in at]
        return [p - base for p in at]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and the suffix ranges that start with them."""
        live = np.arange(len(windows))
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.before), np.int64)
        for j in reversed(range(windows.shape[1])):
            c = windows[live, j]
            go = c > 0
            if go.any():
                a, b = self.rank(c[go], lo[go], hi[go])
                lo[go], hi[go] = self.starts[c[go]] + a, self.starts[c[go]] + b
            keep = lo < hi
            live, lo, hi = live[keep], lo[keep], hi[keep]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the nearest sampled one."""
        out, steps, at, todo = np.empty(len(rows), np.int64), 0, rows, np.arange(len(rows))
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = self.samples[self.sampled_rank[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                c = self.before[at]
                at = self.starts[c] + self.rank(c, at)[0]
            steps += 1
        return out


# ---------------------------------------------------------------- one shard


def search_part(p: Part, vocabulary: Vocabulary, blocks: list[Phrases]) -> tuple[np.ndarray, list[set[str]]]:
    """For each word of a part (lower-cased) whether a window covers it, and the items found in each text."""
    found: list[set[str]] = [set() for _ in p.rows]
    hit = np.zeros(len(p.s), bool)
    if not len(p.s) or not vocabulary.symbols:
        return hit, found
    index, forms = dictionary(*spaced(p.data, p.s, p.e))
    doc = owner(p.first, len(p.s))
    place = np.arange(len(p.s)) + doc  # a separator behind each document
    text = np.zeros(len(p.s) + len(p.rows), np.int64)
    text[place] = vocabulary.look_up(forms)[index]
    known = np.unique(text)  # the shard's own symbols are fewer: number those
    own = known[known > 0]
    if not len(own):
        return hit, found
    index = FMIndex(np.where(text > 0, np.searchsorted(own, text) + 1, 0), len(own))
    edge = np.zeros(len(p.s) + 1, np.int64)
    for block in blocks:
        at = np.minimum(np.searchsorted(own, block.windows), len(own) - 1)
        mine = (own[at] == block.windows) | (block.windows == 0)
        some = np.flatnonzero(mine.all(1))
        if not len(some):
            continue
        live, lo, hi = index.search(np.where(block.windows[some] > 0, at[some] + 1, 0))
        size = hi - lo
        rows = np.repeat(lo, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        which = np.repeat(some[live], size)
        if not len(rows):
            continue
        word = np.searchsorted(place, index.locate(rows))
        np.add.at(edge, word, 1)
        np.add.at(edge, word + block.sizes[which], -1)
        pairs = np.unique(np.stack([doc[word], which], 1), axis=0)
        for d, w in pairs.tolist():
            found[d].update(block.names[i] for i in block.items[block.item_at[w] : block.item_at[w + 1]].tolist())
    return np.cumsum(edge)[:-1] > 0, found


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


# ---------------------------------------------------------------- Spark


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's rows in blocks of about `limit` bytes, one at least; only one block is held at a time."""
    src = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    n = -(-total // limit) or 1
    for k in range(n):
        part = src if n == 1 else src.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def _passes(docs: DataFrame, keep: list[str], benchmark: DataFrame, finish: str, window: int, shard_bytes: int) -> DataFrame:
    """Add n_words, spans (of words) and items pass by pass; `finish` drops the text, or cuts the spans out of it."""
    df = docs.select(*keep, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    context, blocks = docs.sparkSession.sparkContext, blocks_of(benchmark)
    block = next(blocks)
    while block is not None:
        vocabulary, shipped = Vocabulary(), []
        while block is not None and len(shipped) < BLOCKS_A_PASS:
            shipped.append(context.broadcast(phrases(block, vocabulary, window)))
            block = next(blocks, None)
        last = block is None
        words = context.broadcast(vocabulary)
        fields = [f for f in df.schema.fields if f.name != "text" or not last or finish == "cut"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        df = df.mapInArrow(_pass(words, shipped, last, finish, shard_bytes, window, [f.name for f in fields]), schema)
        if not last:
            df = table(df, "decontaminated")
            for b in (words, *shipped):
                b.destroy()
    return df


def _pass(words, shipped: list, last: bool, finish: str, shard_bytes: int, window: int, names: list[str]):
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, blocks = words.value, [b.value for b in shipped]
        for b in chunks(batches, "text", shard_bytes):
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            old = [[(x["a"], x["b"]) for x in v or ()] for v in cols["spans"].to_pylist()]
            items = [set(v or ()) for v in cols["items"].to_pylist()]
            off = text_bytes(cols["text"])[1]
            n_words, spans = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            carry = np.zeros(0, bool)  # the words that the next part of a long text shows again
            for p in parts(cols["text"], _WORD, window - 1, shard_bytes):
                p.data = _LOWER[p.data]
                hit, found = search_part(p, vocabulary, blocks)
                if len(p.rows) == 1:
                    hit[: len(carry)] |= carry
                    carry = hit[p.own[0] :]
                for k, row in enumerate(p.rows.tolist()):
                    a, own, base = int(p.first[k]), int(p.own[k]), int(p.base[k])
                    mine = hit[a : a + own]
                    for x, y in old[row]:
                        mine[max(x - base, 0) : max(y - base, 0)] = True
                    items[row] |= found[k]
                    n_words[row] += own
                    for x, y in _runs(mine) if mine.any() else ():
                        at, to = p.start + int(p.s[a + x] - off[row]), p.start + int(p.e[a + y - 1] - off[row])
                        if spans[row] and spans[row][-1][1] == base + x:
                            spans[row][-1][1::2] = [base + y, to]
                        else:
                            spans[row].append([base + x, base + y, at, to])
            cols["n_words"] = pa.array(n_words)
            if last and finish == "cut" and any(spans):
                whole = cols["text"].to_pylist()
                for row, cuts in enumerate(spans):
                    if cuts:
                        raw, ends = whole[row].encode(), [0, *[c[3] for c in cuts]]
                        whole[row] = b"".join([raw[x:y] for x, y in zip(ends, [*[c[2] for c in cuts], len(raw)], strict=True)]).decode()
                cols["text"] = pa.array(whole, cols["text"].type)
            cols["spans"] = pa.array([[{"a": c[0], "b": c[1]} for c in v] for v in spans], span)
            cols["items"] = pa.array([sorted(v) for v in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, spans, items: what of each document occurs in the benchmark.

    spans are ranges [a, b) of the document's words inside some window of `window` consecutive words
    of an item (an item of fewer words, but not none, is one window); items are the ids, as sorted
    strings, whose windows occur (a null id counts as ''). Null texts have no words; empty items
    match nothing; repeated rows are answered each; a very long text is searched in stretches that
    overlap by a window; other columns, whatever their names, are ignored; empty tables are fine.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _passes(src, ["doc_id"], benchmark, "drop", window, shard_bytes)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with the found spans cut out of the texts, from a span's first word to its last; all else stays.

    What stands around a span, spaces too, stays as it is. Null, empty and untouched texts stay; repeated
    rows are cut alike; null ids are fine; an empty table, or an empty benchmark, changes nothing;
    columns may have any names, those used inside included.
    """
    fields = [f.name for f in docs.schema.fields]
    inner = [f"c{i}" for i in range(len(fields))]
    src = docs.toDF(*inner)
    at = fields.index(text_col)
    keep = [c for i, c in enumerate(inner) if i != at]
    src = src.select(*keep, F.col(inner[at]).cast("string").alias("text"))
    done = _passes(src, keep, benchmark, "cut", window, shard_bytes)
    return done.select(*[F.col("text" if i == at else inner[i]).alias(f) for i, f in enumerate(fields)])
