"""Packing documents into training sequences of balanced attention cost.

A document's tokens (and a closing id) are cut into pieces of at most the sequence length. The cost
of a piece of n tokens is linear * n + quadratic * n**2. Pieces go, longest first, to the sequence of
lowest cost among those with room; a piece that fits nowhere whole is cut at the largest room left.
As many sequences are opened as the tokens need, so a packing group wastes less than one sequence.

Each task packs the rows of its own input split in groups of a bounded number of documents, so no
row is shuffled, memory is bounded, and a lost task computes the same sequences again. Sequence ids
are the number of the split and a running number.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks

#: Default parameters: tokens a sequence, the id that closes a document, documents packed together.
SEQ_LEN, CLOSING_ID, GROUP_DOCS = 1024, 0, 8192
#: Characters encoded at once, about.
SEGMENT = 1 << 20
_CUT = re.compile("[a-z](?= [a-z])")
#: The string that the vocabulary file declares special, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the tokenizers library gives them for the vocabulary file, add_special_tokens=False.

    The file's rank twin (same name, .tiktoken) yields the same ids several times faster; it is used
    where it lies beside the file. A text that the fast library can't take goes to the other one.
    """

    def __init__(self, path: str):
        from pathlib import Path

        self.path, self.fast, self.slow = path, None, None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            with ranks.open("rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(self._ids(part), "<u4") for part in segments(text)])

    def _ids(self, text: str) -> list[int]:
        if self.fast is None:
            return self.exact(text)
        try:
            parts = text.split(SPECIAL)
            ids = self.fast.encode_ordinary(parts[0])
            for part in parts[1:]:
                ids.append(SPECIAL_ID)
                ids += self.fast.encode_ordinary(part)
            return ids
        except BaseException as e:
            # the fast library panics on some very long runs; that exception derives from BaseException alone
            if isinstance(e, Exception) and not isinstance(e, MemoryError) or type(e).__name__ == "PanicException":
                return self.exact(text)
            raise


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A long text in stretches that give its ids one after another.

    It is cut only where a letter, a space and a letter of a-z follow each other: the vocabulary's
    pattern always ends a token's run before that space, whatever stands around.
    """
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class Balancer:
    """Open sequences by room left; gives the cheapest with enough room in O(log seq_len)."""

    def __init__(self, n: int, seq_len: int):
        self.size = 1 << seq_len.bit_length()
        self.none = (float("inf"), -1)
        self.best = [self.none] * (2 * self.size)
        self.heaps: list[list] = [[] for _ in range(seq_len + 1)]
        self.heaps[seq_len] = [(0.0, i) for i in range(n)]
        self._refresh(seq_len)

    def _refresh(self, room: int) -> None:
        i = room + self.size
        self.best[i] = self.heaps[room][0] if self.heaps[room] else self.none
        while i > 1:
            i >>= 1
            a, b = self.best[2 * i], self.best[2 * i + 1]
            self.best[i] = a if a <= b else b

    def take(self, need: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, room) of the cheapest sequence with room >= need."""
        lo, hi, found, at = need + self.size, 2 * self.size, self.none, 0
        while lo < hi:
            if lo & 1:
                if self.best[lo] < found:
                    found, at = self.best[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if self.best[hi] < found:
                    found, at = self.best[hi], hi
            lo >>= 1
            hi >>= 1
        if found[1] < 0:
            return None
        while at < self.size:
            at = 2 * at if self.best[2 * at] == found else 2 * at + 1
        room = at - self.size
        heapq.heappop(self.heaps[room])
        self._refresh(room)
        return found[0], found[1], room

    def roomiest(self) -> int:
        return max(r for r, h in enumerate(self.heaps) if h)

    def put(self, cost: float, seq: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, seq))
        self._refresh(room)


def balance(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int, float]]:
    """Place pieces shorter than a sequence: (piece, start in it, length, sequence, offset, sequence's cost then)."""
    total = sum(lengths)
    if not total:
        return []
    open_ = Balancer(-(-total // seq_len), seq_len)
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        got = open_.take(n)
        if got is None:
            fits = open_.roomiest()
            heapq.heappush(queue, (fits - n, i, start + fits))
            n, got = fits, open_.take(fits)
        cost, seq, room = got
        cost += linear * n + quadratic * n * n
        out.append((i, start, n, seq, seq_len - room, cost))
        if room > n:
            open_.put(cost, seq, room - n)
    return out


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, closing: int, linear: float, quadratic: float, group_docs: int) -> Iterator[pa.RecordBatch]:
    encode = Encoder(path)
    context = TaskContext.get()
    seq = (context.partitionId() if context else 0) << 40
    full_cost = linear * seq_len + quadratic * seq_len * seq_len
    rows: list[list] = []
    id_type = None
    rest: list[tuple] = []  # (doc_id, start, doc_tokens, ids of the part shorter than a sequence)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seq, rows
        top = -1
        for i, start, n, s, offset, cost in balance([len(r[3]) for r in rest], seq_len, linear, quadratic):
            doc, base, tokens, ids = rest[i]
            rows.append((doc, base + start, n, zlib.crc32(ids[start : start + n]), tokens, seq + s, offset, cost))
            top = max(top, s)
        seq += top + 1
        rest.clear()
        if rows:
            cols = zip(*rows, strict=True)
            kinds = [id_type] + [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", *[f.split()[0] for f in SCHEMA.split(", ")]])
        rows = []

    for batch in chunks(batches):
        id_type = batch.column(0).type
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(encode(text or ""), np.uint32(closing)).astype("<u4")
            n = len(ids)
            whole = n - n % seq_len
            for start in range(0, whole, seq_len):
                rows.append((doc, start, seq_len, zlib.crc32(ids[start : start + seq_len]), n, seq, 0, full_cost))
                seq += 1
            if n > whole:
                rest.append((doc, whole, n, ids[whole:].copy()))
            if len(rest) >= group_docs:
                yield from flush()
    yield from flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, seq_len: int = SEQ_LEN, closing_id: int = CLOSING_ID, linear: float = 1.0, quadratic: float = 1.0 / SEQ_LEN, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    Null or empty text: the closing id alone. Ids keep their type, null ones too. Repeated rows are packed each on
    its own. A text of any length is cut into as many pieces as it needs. An empty table: no rows.
    Other columns are ignored. cost is the sequence's cost with this piece and those before it.
    vocabulary is a tokenizers file; it is read on the executors, never copied.
    """
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(lambda it: pack_batches(it, path, seq_len, closing_id, linear, quadratic, group_docs), f"doc_id {kind}, {SCHEMA}")
