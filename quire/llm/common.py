"""What the operators share: row keys, Arrow chunking, words and their names in numpy.

All names are functions of the content alone, so every task on every executor names the same
content alike and a recomputed task gives the same names again. Where equality decides a result,
a name is a 128-bit BLAKE2b digest of the bytes themselves; words are told apart by the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.shared import drop, shared_dir, table  # noqa: F401  operators take them from here

#: Bytes of text that a Python worker holds as numpy arrays at once (a longer single text goes alone).
CHUNK_BYTES = 1 << 20

U64 = np.uint64


def row_key(doc_id: str, text: str):
    """A 128-bit key of a row out of SHA-256: rows that repeat (same id, same text) share it and get the same results."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.substring(F.unhex(F.sha2(F.concat(part(doc_id), part(text)).cast("binary"), 256)), 1, 16)


# ---------------------------------------------------------------- Arrow chunks


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most about limit bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(text_lengths(batch.column(batch.schema.get_field_index(column))) + 16)
        start, base = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, end - start)
            start, base = end, int(sizes[end - 1])


def _offsets(col: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], width, len(col) + 1, col.offset * np.dtype(width).itemsize).astype(np.int64)


def text_lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each text; null: 0."""
    return np.diff(_offsets(col)) if len(col) else np.zeros(0, np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each begins (and the last ends)."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = _offsets(col)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on a uint64 array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


# ---------------------------------------------------------------- words


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes that belong to words: all but the ranges."""
    t = np.ones(256, bool)
    for a, b in ranges:
        t[a : b + 1] = False
    return t


#: Words are runs of anything but space and \t \n \v \f \r.
SPACED = byte_table((0x20, 0x20), (0x09, 0x0D))


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = inside[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    cut = off[(off > 0) & (off < n)]
    start[cut] = w[cut]
    stop = w.copy()
    stop[:-1] &= ~w[1:]
    stop[cut - 1] = w[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, off)


def spaced(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, one space behind each, and where each word begins there (and the last space ends)."""
    size = e - s + 1
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    if not len(s):
        return np.zeros(0, np.uint8), at
    kind = np.int32 if len(data) < 1 << 30 and at[-1] < 1 << 30 else np.int64
    take = np.repeat((s - at[:-1]).astype(kind), size)
    take += np.arange(at[-1], dtype=kind)
    take[-1] = min(int(take[-1]), len(data) - 1)
    out = data[take]
    out[at[1:] - 1] = 0x20
    return out, at


def dictionary(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each word of spaced() the index of its form, and the different forms (without the space), told apart by their bytes."""
    if len(at) < 2:
        return np.zeros(0, np.int64), []
    kind, width = (pa.binary(), np.int32) if at[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    words = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(width)), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), [w[:-1] for w in coded.dictionary.to_pylist()]


def word_names(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word: of the digest of its bytes, so no rule of arithmetic makes two words alike."""
    index, forms = dictionary(buf, at)
    names = np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in forms]), U64)
    return names[index] if len(index) else np.zeros(0, U64)


def range_digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For ranges of bytes their 128-bit digests, as two int64 columns."""
    raw = memoryview(np.ascontiguousarray(buf))
    return np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


@dataclass
class Part:
    """Words of some texts: of many whole ones, or of a stretch of a very long one.

    rows are the texts, base how many words of each stand before, own how many words belong to this
    part; up to `overlap` words behind those are shown again by the next part.
    """

    rows: np.ndarray
    base: np.ndarray
    own: np.ndarray
    data: np.ndarray
    start: int  # of data in its text
    s: np.ndarray
    e: np.ndarray
    first: np.ndarray


def parts(col: pa.Array, inside: np.ndarray, overlap: int = 0, limit: int = CHUNK_BYTES) -> Iterator[Part]:
    """A chunk's texts as parts of bounded size: a text of more than `limit` bytes comes in several, cut between words."""
    data, off = text_bytes(col)
    if len(col) != 1 or len(data) <= limit:
        s, e, first = word_spans(data, off, inside)
        yield Part(np.arange(len(col)), np.zeros(len(col), np.int64), np.diff(first), data, 0, s, e, first)
        return
    zero, p, base = np.zeros(1, np.int64), 0, 0
    while p < len(data):
        q = word_end(data, min(len(data), p + limit), inside)
        reach, r = 16 * overlap, q
        while overlap and r < len(data):
            r = word_end(data, min(len(data), q + reach), inside)
            s, _, _ = word_spans(data[q:r], np.array([0, r - q]), inside)
            if len(s) >= overlap:
                break
            reach *= 4
        piece = data[p:r]
        s, e, _ = word_spans(piece, np.array([0, r - p]), inside)
        own = int(np.searchsorted(s, q - p))
        s, e = s[: own + overlap], e[: own + overlap]
        yield Part(zero, zero + base, zero + own, piece, p, s, e, np.array([0, len(s)]))
        p, base = q, base + own


def word_end(data: np.ndarray, at: int, inside: np.ndarray) -> int:
    """The first place from `at` on that is not inside a word that began before it."""
    if not at or at >= len(data) or not inside[data[at - 1]]:
        return min(at, len(data))
    step = 1 << 12
    while at < len(data):
        out = ~inside[data[at : at + step]]
        if out.any():
            return at + int(np.argmax(out))
        at, step = at + step, step * 2
    return len(data)


def owner(first: np.ndarray, total: int) -> np.ndarray:
    """For items 0..total-1 grouped by first (as word_spans gives it): the group of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if total else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
