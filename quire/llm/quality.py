"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes run over every byte of a document. Their answers are max-pooled over
overlapping chunks that cover the whole text; a document's features are, for each filter, the
maximum over its chunks and the mean over them, combined by one logistic unit.

Training reads a bounded sample of labelled rows on the driver; scoring is one pass over the rows
where they lie, without a shuffle. While scoring, a filter over 8 bytes is the sum of four table
look-ups by byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, text_bytes

#: Bytes a filter sees, filters, embedding size, positions a block, blocks a chunk, blocks from chunk to chunk.
WIDTH, FILTERS, EMBED, BLOCK, CHUNK, HOP = 8, 16, 8, 64, 4, 2
#: Training sample: rows of each label, bytes of each text, and the windows in which a longer text gives them.
MAX_ROWS, MAX_TEXT, WINDOWS = 1200, 1 << 14, 16
EPOCHS, BATCH, STEP = 14, 24, 0.01

SEGMENT = 1 << 17


@dataclass
class Model:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS
    shift: float

    def tables(self) -> list[np.ndarray]:
        """For byte pairs at 0, 2, 4, 6 in the filter: what they add to each filter's answer."""
        per_byte = np.einsum("be,wef->wbf", self.embed, self.filters)
        return [(per_byte[j][None, :, :] + per_byte[j + 1][:, None, :]).reshape(65536, -1).astype(np.float32) for j in range(0, WIDTH, 2)]


def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts set apart in whole blocks (zeros behind each): bytes, blocks of each text, positions that begin no filter."""
    n = np.diff(off)
    blocks = -(-(n + WIDTH - 1) // BLOCK)
    start = np.concatenate([[0], np.cumsum(blocks * BLOCK)])
    x = np.zeros(int(start[-1]) + WIDTH, np.uint8)
    x[np.arange(len(data)) + np.repeat(start[:-1] - off[:-1], n)] = data
    fill = blocks * BLOCK - np.maximum(n, 1)
    dead = np.arange(int(fill.sum())) + np.repeat(start[1:] - np.cumsum(fill), fill)
    return x, blocks, dead


def block_max(x: np.ndarray, dead: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """The largest answer of each filter in each block; long inputs go in segments."""
    m = len(x) - WIDTH
    out = np.empty((m // BLOCK, tables[0].shape[1]), np.float32)
    edges = np.searchsorted(dead, np.arange(0, m + SEGMENT, SEGMENT))
    for i, a in enumerate(range(0, m, SEGMENT)):
        b = min(a + SEGMENT, m)
        part = x[a : b + WIDTH].astype(np.int64)
        pair = part[:-1] | part[1:] << 8
        conv = np.take(tables[0], pair[: b - a], axis=0)
        for j in range(1, WIDTH // 2):
            conv += np.take(tables[j], pair[2 * j : 2 * j + b - a], axis=0)
        conv[dead[edges[i] : edges[i + 1]] - a] = -np.inf
        out[a // BLOCK : b // BLOCK] = conv.reshape(-1, BLOCK, conv.shape[1]).max(axis=1)
    return out


def chunk_starts(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chunks of all texts: first block, one behind the last block of its text; and chunks of each text."""
    n = np.maximum(1, -(-(blocks - CHUNK) // HOP) + 1)
    first = np.concatenate([[0], np.cumsum(blocks)])
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[:-1], n) + k * HOP, np.repeat(first[1:], n), n


def pooled(best: np.ndarray, blocks: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Features of each text from its blocks' maxima."""
    start, end, n = chunk_starts(blocks)
    top = best[start]
    for i in range(1, CHUNK):
        np.maximum(top, best[np.minimum(start + i, end - 1)], out=top)
    top = np.maximum(top + bias, 0)
    at = np.cumsum(n) - n
    return np.concatenate([np.maximum.reduceat(top, at), np.add.reduceat(top, at) / n[:, None]], 1)


def score_bytes(data: np.ndarray, off: np.ndarray, model: Model, tables: list[np.ndarray]) -> np.ndarray:
    x, blocks, dead = layout(data, off)
    z = pooled(block_max(x, dead, tables), blocks, model.bias) @ model.weights + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


# ---------------------------------------------------------------- training


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, windows: np.ndarray | None = None) -> Model:
    """Adam on the logistic loss with both classes weighted alike: 0.5 is where they are equally likely.

    windows: for each text, the length of the windows of which it consists, 0 where it is whole.
    """
    windows = np.zeros(len(texts), np.int64) if windows is None else windows
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "weights": rng.normal(0, 0.1, 2 * FILTERS),
        "shift": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    ones = max(1, int(labels.sum()))
    weight = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * max(1, len(labels) - ones))).astype(np.float32)
    order, step = np.arange(len(texts)), 0
    for epoch in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            grads = _gradients(p, [texts[i] for i in rows], labels[rows], weight[rows], windows[rows])
            step += 1
            rate = STEP * (0.5 if epoch > epochs * 0.6 else 1) * (0.3 if epoch > epochs * 0.85 else 1)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return Model(p["embed"], p["filters"], p["bias"], p["weights"], float(p["shift"][0]))


def _seams(starts: np.ndarray, off: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Positions whose filter would reach over the end of a window, in texts laid out from starts."""
    ends = [starts[i] + np.arange(windows[i], off[i + 1] - off[i] + 1, windows[i]) for i in np.flatnonzero(windows)]
    if not ends:
        return np.zeros(0, np.int64)
    return np.unique((np.concatenate(ends)[:, None] - np.arange(1, WIDTH)).clip(0))


def _gradients(p: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray, windows: np.ndarray) -> dict:
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, blocks, dead = layout(data, off)
    m = len(x) - WIDTH
    per_byte = np.einsum("be,wef->wbf", p["embed"], p["filters"])
    conv = np.take(per_byte[0], x[:m], axis=0)
    for j in range(1, WIDTH):
        conv += np.take(per_byte[j], x[j : j + m], axis=0)
    conv[dead] = -np.inf
    conv[_seams(np.cumsum(blocks * BLOCK) - blocks * BLOCK, off, windows)] = -np.inf
    cube = conv.reshape(-1, BLOCK, FILTERS)
    where = cube.argmax(axis=1)  # block x filter
    best = np.take_along_axis(cube, where[:, None, :], 1)[:, 0, :]
    where += np.arange(len(best))[:, None] * BLOCK
    start, end, n = chunk_starts(blocks)
    options = np.minimum(start[:, None] + np.arange(CHUNK), (end - 1)[:, None])
    pick = best[options].argmax(axis=1)  # chunk x filter
    block = np.take_along_axis(options, pick, 1)
    cols = np.arange(FILTERS)[None, :]
    top = best[block, cols] + p["bias"]
    pos = where[block, cols]
    act = np.maximum(top, 0)
    at = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    high, mean = np.maximum.reduceat(act, at), np.add.reduceat(act, at) / n[:, None]
    feats = np.concatenate([high, mean], 1)
    z = feats @ p["weights"] + p["shift"]
    d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
    g_feats = d[:, None] * p["weights"]
    is_high = act == high[doc]
    share = np.add.reduceat(is_high.astype(np.float32), at)
    g_act = g_feats[doc, FILTERS:] / n[doc][:, None] + is_high * (g_feats[:, :FILTERS] / share)[doc]
    g_top = np.where(top > 0, g_act, 0).astype(np.float32)
    g_embed, g_filters = np.zeros_like(p["embed"]), np.zeros_like(p["filters"])
    for j in range(WIDTH):
        b = x[pos + j]  # chunk x filter
        by = np.zeros((256, FILTERS), np.float32)
        np.add.at(by, (b, np.broadcast_to(cols, b.shape)), g_top)
        g_filters[j] = p["embed"].T @ by
        g_embed += by @ p["filters"][j].T
    return {"embed": g_embed, "filters": g_filters, "bias": g_top.sum(0), "weights": feats.T @ d + 1e-4 * p["weights"], "shift": np.array([d.sum()])}


# ---------------------------------------------------------------- Spark


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_text: int = MAX_TEXT) -> Model | None:
    """Fit on at most max_rows rows of each label that have a text and are not held out.

    The rows of smallest id hash are taken, so the sample is the same each time; ids with several
    labels take the lowest. Of a text over max_text bytes, that many take part: WINDOWS windows, one
    at a place chosen by hash in each equal part of the text. Labels without a row in docs take no
    place in the sample. None where one of the labels has no rows.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    marks = marks.where(~held_out("doc_id")).join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    long, window = F.octet_length("text") > max_text, max(1, max_text // WINDOWS)
    part = F.when(long, _windows("doc_id", "text", window)).otherwise(F.col("text"))
    rows = src.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(part.alias("text"), long.alias("long"))).alias("part")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return fit([bytes(r["part"]["text"]) for r in rows], y, windows=np.array([window if r["part"]["long"] else 0 for r in rows]))


def _windows(doc_id: str, text: str, window: int) -> Column:
    """WINDOWS windows of the bytes, each within its own equal part of the text."""
    n = F.octet_length(text).cast("long")
    taken = []
    for k in range(WINDOWS):
        start, end = F.floor(n * k / WINDOWS), F.floor(n * (k + 1) / WINDOWS)
        room = F.greatest(end - start - window + 1, F.lit(1))
        taken.append(F.col(text).substr((start + F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), room) + 1).cast("int"), F.lit(window)))
    return F.concat(*taken)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the whole text is read, in bounded segments.

    Null texts count as empty and get the empty text's score. Without a model (no labels to learn
    from) every score is 0.5. Repeated rows stay, other columns are ignored, an empty table gives none.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else []
        for b in chunks(batches, "text", 1 << 19):
            data, off = text_bytes(b.column(1))
            s = score_bytes(data, off, model, tables) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows that score below the threshold; nothing is shuffled.

    Null and empty texts are scored as the empty text; whole texts count at any length; repeated rows
    share their fate; without a model all rows stay; an empty table stays empty; columns may have any
    names, those used inside included.
    """
    fields = [f.name for f in docs.schema.fields]
    inner = docs.toDF(*[f"c{i}" for i in range(len(fields))])
    at = fields.index(text_col)
    inner = inner.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else []
        for b in chunks(batches, f"c{at}", 1 << 19):
            if model:
                good = score_bytes(*text_bytes(b.column(at)), model, tables) >= threshold
                b = b.filter(pa.array(good))
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    return inner.mapInArrow(run, schema).toDF(*fields)
