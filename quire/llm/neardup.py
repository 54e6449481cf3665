"""N-gram Jaccard join: all links of similarity >= threshold between texts, with Bayesian pruning.

A text is the set of its 5-word shingles. Copies (same word sequence, by a 128-bit digest of the
words' bytes) are one node; a shingle has a 64-bit name made of its words' digests. A node has 128
MinHash values in 32 bands of 4; nodes meet in a bucket for each band they share, and two texts of
similarity 0.8 share none with probability (1 - 0.8**4)**32 < 5e-8. Buckets with the same members
are one. A pair counts only in its first common band, so nothing needs to be made distinct.

In a bucket the values are compared in steps of 32; a pair goes as soon as the posterior probability
(uniform prior) that its similarity reaches the threshold falls under the tolerance. The rest is
verified exactly on the shingle sets, which only texts with a surviving pair ship.

Pairs are never rows: a task takes a tile (two bounded chunks of a bucket's members) and returns a
row a member, with its number of links and one member of its group in the tile. Classes are the
components of those stars, by rounds of large and small stars in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACED, U64, Part, chunks, drop, mix, parts, row_key, spaced, table, word_names

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
BANDS, ROWS, STEP = 32, 4, 32
HASHES = BANDS * ROWS
#: Members and words of a chunk of a bucket; a tile holds two chunks.
CHUNK_MEMBERS, CHUNK_WORDS = 1024, 1 << 20

_A = (mix(np.arange(1, HASHES + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_X = (mix(np.arange(1001, HASHES + 1001, dtype=U64)) >> U64(32)).astype(np.uint32)
_STEP = U64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- shingles and signatures


def shingles(words: np.ndarray, first: np.ndarray, size: int = SHINGLE, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names of all shingles (with repeats), and where each text's begin. A shorter text, if not empty, is one shingle.

    base tells how many words of a text stand before those given: behind some, a rest too short for a
    shingle is none.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1) if base is None else np.where(base == 0, np.minimum(n, 1), 0))
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = first[doc] + np.arange(begin[-1]) - begin[doc]
    end = np.minimum(at + size, first[doc + 1])
    h = mix(words[at] + _STEP) if len(at) else np.zeros(0, U64)
    for j in range(1, size):
        more = at + j < end
        if more.all():
            h = mix(h * _STEP + words[at + j])
        else:
            h[more] = mix(h[more] * _STEP + words[at[more] + j])
    return h, begin


def part_shingles(p: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """shingles() of a part, and its words as spaced() gives them."""
    buf, at = spaced(p.data, p.s, p.e)
    return *shingles(word_names(buf, at), p.first, SHINGLE, p.base), buf, at


def signatures(shingle: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """HASHES minima for each text that has shingles."""
    full = np.flatnonzero(np.diff(begin))
    out = np.empty((len(full), HASHES), np.uint32)
    if len(full):
        x = (shingle >> U64(32)).astype(np.uint32)
        at = begin[full]
        buf = np.empty_like(x)
        for j in range(HASHES):
            np.bitwise_xor(x, _X[j], out=buf)
            np.multiply(buf, _A[j], out=buf)
            out[:, j] = np.minimum.reduceat(buf, at)
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values: the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    Under a uniform prior that probability is P(Binomial(n + 1, threshold) <= matches).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def candidates(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Of pairs (a, b) those whose first common band is `band` and that no step prunes (indices)."""
    live = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    met = np.zeros(len(a), bool)
    for at in range(0, HASHES, STEP):
        same = sig[a[live], at : at + STEP] == sig[b[live], at : at + STEP]
        in_band = same.reshape(len(live), STEP // ROWS, ROWS).all(2)
        k = at // ROWS + np.arange(STEP // ROWS)[None, :]
        early = (in_band & (k < band[live][:, None])).any(1)
        met[live] |= (in_band & (k == band[live][:, None])).any(1)
        matches[live] += same.sum(1)
        live = live[~early & (matches[live] >= least[at + STEP])]
    return live[met[live]]


# ---------------------------------------------------------------- a tile


def tile_pairs(chunk: np.ndarray, low: int, high: int, limit: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of a tile, in blocks: within one chunk, or across two."""
    rows, cols = (np.flatnonzero(chunk == low), np.flatnonzero(chunk == high))
    if not len(rows) or not len(cols):
        return
    step = max(1, limit // len(cols))
    for i in range(0, len(rows), step):
        a, b = np.repeat(rows[i : i + step], len(cols)), np.tile(cols, len(rows[i : i + step]))
        if low == high:
            keep = a < b
            a, b = a[keep], b[keep]
        yield a, b


class Sets:
    """Shingle sets of a tile; sizes of intersections of many pairs."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.bits: np.ndarray | None = None

    def _pack(self) -> None:
        flat = np.concatenate(self.sets)
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        width = int(shared.sum()) + 63 >> 6
        if width * len(self.sets) > 1 << 23:
            self.bits = np.zeros((0, 0), U64)
            return
        row = np.repeat(np.arange(len(self.sets)), self.size)
        keep = shared[at]
        flags = np.zeros((len(self.sets), width * 64), bool)
        flags[row[keep], number[at[keep]]] = True
        self.bits = np.packbits(flags, axis=1, bitorder="little").view(U64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) > 64 and self.bits is None:
            self._pack()
        if self.bits is None or len(a) <= 64 or not len(self.bits):
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        out, step = np.empty(len(a), np.int64), max(1, (1 << 21) // max(1, self.bits.shape[1]))
        for i in range(0, len(a), step):
            out[i : i + step] = np.bitwise_count(self.bits[a[i : i + step]] & self.bits[b[i : i + step]]).sum(1)
        return out


def similar(common: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Jaccard >= threshold without a division's rounding."""
    return common.astype(np.float64) * (1 + threshold) >= threshold * (x + y) - 1e-9


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


# ---------------------------------------------------------------- Spark


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, node, words, sig): a node is the digest of a text's words, one space apart; a text without words has none."""
    for b in chunks(batches):
        words, sig = np.zeros(b.num_rows, np.int64), np.full((b.num_rows, HASHES), 0xFFFFFFFF, np.uint32)
        digests = [blake2b(digest_size=16) for _ in range(b.num_rows)]
        for p in parts(b.column(1), SPACED, SHINGLE - 1):
            shingle, begin, buf, at = part_shingles(p)
            full = p.rows[np.diff(begin) > 0]
            sig[full] = np.minimum(sig[full], signatures(shingle, begin))
            words[p.rows] += p.own
            raw = memoryview(buf)
            for row, x, y in zip(p.rows.tolist(), at[p.first[:-1]].tolist(), at[p.first[:-1] + p.own].tolist(), strict=True):
                digests[row].update(raw[x:y])
        some = (words > 0).tolist()
        names = [d.digest() if ok else None for d, ok in zip(digests, some, strict=True)]
        sigs = [sig[i].tobytes() if ok else None for i, ok in enumerate(some)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(words), pa.array(sigs, pa.binary())], ["rid", "node", "words", "sig"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of equal, adjacent keys, one after another."""
    held: list[pa.RecordBatch] = []
    held_key = None

    def take() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]

    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([np.asarray(b.column(b.schema.get_field_index(k))).astype(np.int64) for k in keys], 1)
        edge = np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1
        bounds = [0, *edge.tolist(), b.num_rows]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(cols[x])
            if held and key != held_key:
                yield take()
                held = []
            held.append(b.slice(x, y - x))
            held_key = key
    if held:
        yield take()


_TILE = ["bucket", "band", "low", "high"]


def _open(b: pa.RecordBatch):
    """A tile's columns as arrays, one row a node."""
    col = lambda n: b.column(b.schema.get_field_index(n))
    nodes = col("node").to_pylist()
    rows = list({n: i for i, n in reversed(list(enumerate(nodes)))}.values())
    rows = sorted(rows, key=lambda i: nodes[i])
    sig = np.frombuffer(b"".join(col("sig")[i].as_py() for i in rows), np.uint32).reshape(-1, HASHES)
    chunk = np.asarray(col("chunk"))[rows]
    return rows, [nodes[i] for i in rows], sig, chunk, int(col("low")[0].as_py()), int(col("high")[0].as_py()), int(col("band")[0].as_py())


def _needed(least: dict[int, int]):
    """Rows of tiles that have at least one surviving pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, _TILE):
            rows, _, sig, chunk, low, high, band = _open(b)
            use = np.zeros(len(rows), bool)
            for x, y in tile_pairs(chunk, low, high):
                ok = candidates(sig, x, y, np.full(len(x), band), least)
                use[x[ok]] = True
                use[y[ok]] = True
            if use.any():
                yield b.take(pa.array(np.array(rows)[use]))

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingle set beside each tile that needs it."""
    for b in chunks(batches):
        found: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
        for p in parts(b.column(b.schema.get_field_index("text")), SPACED, SHINGLE - 1):
            shingle, begin, _, _ = part_shingles(p)
            for row, x, y in zip(p.rows.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                found[row].append(np.unique(shingle[x:y]))
        tiles = b.column(b.schema.get_field_index("tiles"))
        at = np.asarray(tiles.offsets)
        count = np.diff(at)
        sets = [(f[0] if len(f) == 1 else np.unique(np.concatenate(f))).tobytes() for f in found]
        flat = tiles.flatten()
        row = np.repeat(np.arange(b.num_rows), count)
        pick = lambda n: b.column(b.schema.get_field_index(n)).take(pa.array(row))
        limit, start = 32 << 20, 0
        sizes = np.cumsum(np.array([len(sets[i]) for i in row.tolist()], np.int64)) if len(row) else np.zeros(0, np.int64)
        fields = [*_TILE, "chunk"]
        columns = [*[flat.field(f) for f in fields], pick("node"), pick("copies"), pick("sig")]
        while start < len(row):
            done = int(sizes[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
            part = pa.array([sets[i] for i in row[start:stop].tolist()], pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*[c.slice(start, stop - start) for c in columns], part], [*fields, "node", "copies", "sig", "shingles"])
            start = stop


def _linked(least: dict[int, int], threshold: float):
    """For each member of a tile with links there: how many, and a member of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, _TILE):
            rows, nodes, sig, chunk, low, high, band = _open(b)
            raw = b.column(b.schema.get_field_index("shingles"))
            sets = Sets([np.frombuffer(raw[i].as_buffer(), U64) for i in rows])
            copies = np.asarray(b.column(b.schema.get_field_index("copies")))[rows]
            links, texts, parent = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), list(range(len(rows)))
            for x, y in tile_pairs(chunk, low, high):
                ok = candidates(sig, x, y, np.full(len(x), band), least)
                x, y = x[ok], y[ok]
                ok = similar(sets.common(x, y), sets.size[x], sets.size[y], threshold)
                x, y = x[ok], y[ok]
                for p, q in ((x, y), (y, x)):
                    np.add.at(links, p, copies[q])
                    np.add.at(texts, p, 1)
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    i, j = _find(parent, i), _find(parent, j)
                    if i != j:
                        parent[max(i, j)] = min(i, j)
            has = np.flatnonzero(texts).tolist()
            if has:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in has], pa.binary()), pa.array(links[has]), pa.array(texts[has]), pa.array([nodes[_find(parent, i)] for i in has], pa.binary())], ["node", "links", "texts", "peer"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of edges (u, v): root is the smallest node of the component.

    Rounds of large stars and small stars until the edges stay the same; each is a table in the
    shared folder.
    """
    state = lambda t: tuple(t.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
    now = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = state(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        new = table(small.where("u <> v").distinct(), "edges")
        drop(now)
        now, last, mark = new, mark, state(new)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _classes(src: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, node) of all rows, and (node, copies, root, links, texts) of all nodes."""
    least = least_matches(threshold, TOLERANCE)
    ids = src.select("rid", "text", "doc_id")
    rows = table(ids.select("rid", "text").mapInArrow(_nodes, "rid binary, node binary, words long, sig binary"), "rows")
    nodes = table(rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("rid").alias("rid"), F.first("words").alias("words"), F.first("sig").alias("sig")), "nodes")
    width = 4 * ROWS
    bands = nodes.select("node", "words", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width))))).alias("band", "bucket"))
    met = bands.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("words").alias("w"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")).where("m > 1")
    met = met.groupBy("m", "x", "y").agg(F.min(F.struct("band", "bucket", "w")).alias("one")).select("one.bucket", "one.band", F.greatest(F.ceil(F.col("m") / CHUNK_MEMBERS), F.ceil(F.col("one.w") / CHUNK_WORDS)).cast("int").alias("parts"))
    met = table(met, "buckets")
    members = bands.join(met.hint("merge"), ["bucket", "band"]).select("node", "bucket", "band", "parts", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int").alias("chunk"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = members.select("node", "bucket", "band", "chunk", other.alias("o")).select("node", "bucket", F.least("chunk", "o").alias("low"), F.greatest("chunk", "o").alias("high"), "band", "chunk")
    tiles = tiles.join(nodes.select("node", "copies", "sig", F.col("rid").alias("rep")), "node")
    by_tile = lambda df: df.repartition(*_TILE).sortWithinPartitions(*_TILE, "node")
    kept = "node binary, bucket long, low int, high int, band int, chunk int, copies long, sig binary, rep binary"
    need = table(by_tile(tiles.select(*[f.split()[0] for f in kept.split(", ")])).mapInArrow(_needed(least), kept), "needed")
    drop(met)
    where = need.groupBy(F.col("rep").alias("rid")).agg(F.first("node").alias("node"), F.first("copies").alias("copies"), F.first("sig").alias("sig"), F.collect_list(F.struct(*_TILE, "chunk")).alias("tiles"))
    # rows that repeat a chosen one (same key) would ship its set again; the join has dealt them by that key already
    chosen = ids.select("rid", "text").join(where, "rid").dropDuplicates(["rid"])
    sets = chosen.select("rid", "text", "node", "copies", "sig", "tiles").mapInArrow(_set_rows, "bucket long, band int, low int, high int, chunk int, node binary, copies long, sig binary, shingles binary")
    found = table(by_tile(sets).mapInArrow(_linked(least, threshold), "node binary, links long, texts long, peer binary"), "found")
    drop(need)
    roots = components(found.select(F.col("node").alias("u"), F.col("peer").alias("v")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    whole = nodes.select("node", "copies").join(degree.join(roots, "node", "left"), "node", "left")
    whole = table(whole.select("node", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")), "classes")
    drop(found, nodes)
    return rows.select("rid", "node"), whole


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _members(src: DataFrame, threshold: float) -> DataFrame:
    """(rid, doc_id, root, copies, links, texts), one row a distinct row key; texts without words have null root."""
    rows, whole = _classes(src, threshold)
    counted = rows.groupBy("rid").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("same"))
    ids = src.select("rid", "doc_id").distinct()
    return ids.join(counted.join(whole, "node", "left"), "rid")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, n_texts for every row of docs.

    Two rows are linked if the Jaccard similarity of their sets of 5-word shingles is at least the
    threshold; a text of fewer words, but not none, is one shingle. Classes are the components of
    links; class_id is the smallest doc_id of the class. n_links counts the other rows linked to a
    row, copies included; n_texts the different texts among them. Null, empty or blank texts link
    to nothing and are classes of their own. Repeated rows count as copies of each other. A null id
    is left out of the choice of class_id where the class has another. Very long texts are worked on
    in parts. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    m = table(_members(_source(docs, id_col, text_col), threshold), "members")
    names = table(m.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id")), "names")
    out = m.join(names.hint("merge"), "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"), F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))).alias("k"))
    return out.drop("k")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, of equal ones that of the smallest row key.

    A row that repeats (same id, same text) is a copy and goes. Null, empty and blank texts all stay,
    repeated ones too; a null id is the smallest; very long texts are worked on in parts; an empty
    table stays empty; columns may have any names, those used inside included.
    """
    m = _members(_source(docs, id_col, text_col), threshold)
    first = m.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("one")).select("one.rid")
    first = table(first, "survivors")
    fields = [f.name for f in docs.schema.fields]
    inner = docs.toDF(*[f"c{i}" for i in range(len(fields))])
    key, text = f"c{fields.index(id_col)}", f"c{fields.index(text_col)}"
    worded = F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = inner.where(worded).withColumn("rid", row_key(key, text)).join(first.hint("merge"), "rid", "left_semi").dropDuplicates(["rid"])
    return kept.drop("rid").unionByName(inner.where(~worded)).toDF(*fields)
