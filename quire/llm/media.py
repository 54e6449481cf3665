"""Media columns: what bytes are, by signature and structure, and media embedded in other bytes.

An Aho-Corasick automaton finds every magic string in one pass over the bytes. A format's validator
then walks the structure behind a hit (chunks, segments, boxes, checksums where the format has
them) and gives the length, or rejects the hit. The hit at the start decides the true type, which
corrects a declared one; valid hits behind it are carved: outermost ones only, in order.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks

# ---------------------------------------------------------------- fixed values: magic strings
#: (kind, MIME type, magic string, its distance from the start of the file)
SIGNATURES = [
    ("png", "image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("jpeg", "image/jpeg", b"\xff\xd8\xff", 0),
    ("gif", "image/gif", b"GIF87a", 0),
    ("gif", "image/gif", b"GIF89a", 0),
    ("bmp", "image/bmp", b"BM", 0),
    ("wav", "audio/wav", b"WAVE", 8),
    ("webp", "image/webp", b"WEBP", 8),
    ("pdf", "application/pdf", b"%PDF-", 0),
    ("zip", "application/zip", b"PK\x03\x04", 0),
    ("gzip", "application/gzip", b"\x1f\x8b\x08", 0),
    ("flac", "audio/flac", b"fLaC", 0),
    ("ogg", "audio/ogg", b"OggS\x00", 0),
    ("mp4", "video/mp4", b"ftyp", 4),
]
UNKNOWN = "application/octet-stream"
MIME = {kind: mime for kind, mime, _, _ in SIGNATURES}


# ---------------------------------------------------------------- validators: length from `at`, or 0


class Bytes:
    """A value's bytes, and what walks through them have found out, so that many hits cost one walk together."""

    def __init__(self, raw: bytes):
        self.raw, self.view, self.places, self.known = raw, memoryview(raw), {}, {}

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, at):
        return self.view[at]

    def find(self, what: bytes) -> list[int]:
        """All places of a string, in order."""
        if what not in self.places:
            self.places[what] = [m.start() for m in re.finditer(b"(?=" + re.escape(what) + b")", self.raw)]
        return self.places[what]

    def follow(self, walk: str, p: int, step: Callable[[int], tuple[bool, int]]) -> int:
        """Where a chain of steps from p comes to an end (0: broken); step gives (done, next place or the end)."""
        ends, path, done = self.known.setdefault(walk, {}), [], False
        while not done:
            if p in ends:
                end = ends[p]
                break
            path.append(p)
            done, p = step(p)
            end = p
        ends.update(dict.fromkeys(path, end))
        return end


def _png(b: Bytes, at: int) -> int:
    def chunk(p: int) -> tuple[bool, int]:
        if p + 12 > len(b):
            return True, 0
        n, kind = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        end = p + 12 + n
        if end > len(b) or not kind.isalpha() or zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return True, 0
        return kind == b"IEND", end

    if bytes(b[at + 8 : at + 16]) != b"\0\0\0\x0dIHDR":
        return 0
    return max(b.follow("png", at + 8, chunk) - at, 0)


_JPEG_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _jpeg(b: Bytes, at: int) -> int:
    def segment(p: int) -> tuple[bool, int]:
        if p + 4 > len(b) or b[p] != 0xFF:
            return True, 0
        kind = b[p + 1]
        if kind == 0xFF:
            return False, p + 1
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or not 0xC0 <= kind <= 0xFE:
            return True, 0
        p += 2 + n
        if kind == 0xDA:  # coded data up to a marker that is neither stuffing nor a restart
            return coded(p)
        return False, p

    def coded(p: int) -> tuple[bool, int]:
        m = _JPEG_MARKER.search(b.raw, p)
        if m is None:
            return True, 0
        return (True, m.start() + 2) if b[m.start() + 1] == 0xD9 else (False, m.start())

    return max(b.follow("jpeg", at + 2, segment) - at, 0)


def _gif(b: Bytes, at: int) -> int:
    def block(p: int) -> tuple[bool, int]:
        return (False, p + b[p] + 1) if p < len(b) and b[p] else (True, p + 1)

    def part(p: int) -> tuple[bool, int]:
        if p >= len(b):
            return True, 0
        if b[p] == 0x3B:
            return True, p + 1
        if b[p] == 0x21:
            return False, b.follow("gif blocks", p + 2, block)
        if b[p] == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            return False, b.follow("gif blocks", p + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), block)
        return True, 0

    if at + 13 > len(b):
        return 0
    return max(b.follow("gif", at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0), part) - at, 0)


def _bmp(b: Bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", b.raw, at + 2)
    ok = reserved == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(b) - at
    return size if ok else 0


def _riff(form: bytes) -> Callable[[Bytes, int], int]:
    need = {b"WAVE": (b"fmt ", b"data"), b"WEBP": ()}[form]

    def check(b: Bytes, at: int) -> int:
        if at < 0 or bytes(b[at : at + 4]) != b"RIFF" or at + 12 > len(b):
            return 0
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        if end > len(b):
            return 0
        p, seen = at + 12, set()
        while p + 8 <= end:
            n = int.from_bytes(b[p + 4 : p + 8], "little")
            if p + 8 + n > end:
                return 0
            seen.add(bytes(b[p : p + 4]))
            p += 8 + n + n % 2
        return end - at if p == end and seen and seen.issuperset(need) else 0

    return check


def _pdf(b: Bytes, at: int) -> int:
    """To the last end mark before the next header; there must be a cross-reference before it."""
    if at + 8 > len(b) or not (48 <= b[at + 5] <= 57 and b[at + 6] == 46):
        return 0
    heads, ends, refs = b.find(b"%PDF-"), b.find(b"%%EOF"), b.find(b"startxref")
    k = bisect_left(heads, at + 5)
    last = bisect_left(ends, heads[k]) if k < len(heads) and ends and heads[k] < ends[-1] else len(ends)
    if not last or ends[last - 1] <= at:
        return 0
    end, r = ends[last - 1], bisect_left(refs, at)
    return end + 5 - at if r < len(refs) and refs[r] + 9 <= end else 0


def _zip(b: Bytes, at: int) -> int:
    """To the first end record whose directory, by its own size and offset, belongs to an archive that begins here."""
    if "zip" not in b.known:
        first: dict[int, int] = {}
        for p in b.find(b"PK\x05\x06"):
            if p + 22 <= len(b):
                size, start = struct.unpack_from("<II", b.raw, p + 12)
                first.setdefault(p - start - size, p)
        b.known["zip"] = first
    p = b.known["zip"].get(at, -1)
    if p < 0:
        return 0
    end = p + 22 + int.from_bytes(b[p + 20 : p + 22], "little")
    return end - at if end <= len(b) else 0


def _gzip(b: Bytes, at: int) -> int:
    """A header as the format has it, then deflated data that end and agree with the checksum and length behind them."""
    flags, p = b[at + 3] if at + 18 <= len(b) else 0xFF, at + 10
    if flags & 0xE0:
        return 0
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    zeros = b.find(b"\0") if flags & 24 else []
    for bit in (8, 16):  # a name, a comment
        if flags & bit:
            k = bisect_left(zeros, p)
            if k == len(zeros):
                return 0
            p = zeros[k] + 1
    end = b.follow("gzip", p + (2 if flags & 2 else 0), lambda q: (True, _inflated(b, q)))
    good = end and (not flags & 2 or zlib.crc32(b[at:p]) & 0xFFFF == int.from_bytes(b[p : p + 2], "little"))
    return end - at if good else 0


def _inflated(b: Bytes, p: int) -> int:
    """Where the deflated data from p and their trailer end, or 0."""
    d, crc, size = zlib.decompressobj(-15), 0, 0
    step = 1 << 10
    try:
        while p < len(b) and not d.eof:
            out = d.decompress(b[p : p + step])
            crc, size = zlib.crc32(out, crc), size + len(out)
            p = min(len(b), p + step)
            step = min(step * 4, 1 << 16)
    except zlib.error:
        return 0
    p -= len(d.unused_data)
    return p + 8 if d.eof and bytes(b[p : p + 8]) == struct.pack("<II", crc, size & 0xFFFFFFFF) else 0


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_header(b: Bytes, p: int, bits: int) -> tuple[int, int, int, int, int] | None:
    """Of a frame: end of its header, samples, channel code, bits a sample, number."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] >> 1 != 0x7C:
        return None
    size, rate, channels, width = b[p + 2] >> 4, b[p + 2] & 15, b[p + 3] >> 4, b[p + 3] >> 1 & 7
    if not size or rate == 15 or channels > 10 or width == 3 or b[p + 3] & 1:
        return None
    lead = b[p + 4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if lead >> (6 - k) == (1 << (k + 2)) - 2), None)
    at = p + 5 + (more or 0) + (size == 6) + 2 * (size == 7) + (rate == 12) + 2 * (rate in (13, 14))
    if more is None or at >= len(b):
        return None
    number = lead & (0x7F if not more else (1 << (6 - more)) - 1)
    for x in b[p + 5 : p + 5 + more]:
        number = number << 6 | x & 63
    q = p + 5 + more
    n = 192 if size == 1 else 576 << (size - 2) if size < 6 else b[q] + 1 if size == 6 else (b[q] << 8 | b[q + 1]) + 1 if size == 7 else 256 << (size - 8)
    crc = 0
    for x in b[p:at]:
        crc = _CRC8[crc ^ x]
    return (at + 1, n, channels, (bits, 8, 12, 0, 16, 20, 24, 32)[width], number) if crc == b[at] else None


def _flac_subframes(bits: str, n: int, channels: int, width: int) -> int:
    """Bits that the subframes take; ValueError where they are broken, or bits too short."""
    pos = 0

    def take(k: int) -> int:
        nonlocal pos
        pos += k
        return int(bits[pos - k : pos] or "0", 2)

    for c in range(channels + 1 if channels < 8 else 2):
        own = width + (channels in (8, 10) and c == 1 or channels == 9 and c == 0)
        if take(1):
            raise ValueError
        kind = take(6)
        if take(1):
            one = bits.index("1", pos)
            own -= one - pos + 1
            pos = one + 1
        order = kind & 7 if 8 <= kind <= 12 else (kind & 31) + 1 if kind >= 32 else -1
        if own < 1 or order < 0 and kind > 1 or order > n:
            raise ValueError
        if order < 0:
            pos += own * (n if kind else 1)
            continue
        pos += own * order
        if kind >= 32:
            precision = take(4) + 1
            if precision == 16:
                raise ValueError
            pos += 5 + precision * order
        method, parts = take(2), take(4)
        if method > 1 or n % (1 << parts) or n >> parts < order:
            raise ValueError
        for k in range(1 << parts):
            rice, count = take(4 + method), (n >> parts) - (0 if k else order)
            if rice == (31 if method else 15):
                pos += take(5) * count
            else:
                for _ in range(count):
                    pos = bits.index("1", pos) + 1 + rice
        if pos > len(bits):
            raise ValueError
    if pos > len(bits):
        raise ValueError
    return pos


def _flac_frame(b: Bytes, p: int, bits: int) -> tuple[int, int, int] | None:
    """End, samples and number of the frame at p; None where it is broken."""
    head = _flac_header(b, p, bits)
    if head is None or not head[3]:
        return None
    at, n, channels, width, number = head
    room = (channels + 1 if channels < 8 else 2) * (n * (width + 1) // 8 + 64)
    while True:
        part = b[at : at + room]
        try:
            used = _flac_subframes(bin(int.from_bytes(b"\1" + part, "big"))[3:], n, channels, width)
            break
        except ValueError:
            if at + room >= len(b) or room > 1 << 24:
                return None
            room *= 8
    end = at + -(-used // 8) + 2
    if end > len(b):
        return None
    crc = 0
    for x in bytes(b[p : end - 2]):
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ x]
    return (end, n, number) if crc == b[end - 2] << 8 | b[end - 1] else None


def _flac(b: Bytes, at: int) -> int:
    """To the end of the last valid frame. Negative (to the end of the bytes at most) where already the first is broken."""
    p, first, bits, total = at + 4, True, 0, 0
    while p + 4 <= len(b):
        last, kind, n = b[p] >> 7, b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind != 0 or n != 34) or kind > 6:
            return 0
        if first and p + 38 <= len(b):
            packed = int.from_bytes(b[p + 14 : p + 22], "big")
            bits, total = (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        p, first = p + 4 + n, False
        if last:
            break
    else:
        return 0
    if not (p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] >> 2 == 0x3E):
        return 0
    start = p  # the first frame says whether blocks are of one size; the others say the same
    end, done, number = 0, 0, -1
    while True:
        frame = _flac_frame(b, p, bits)
        if frame and (not end or frame[2] > number):
            p, number = frame[0], frame[2]
            end, done = p, done + frame[1]
            if total and done >= total:
                break
            continue
        if not end or not total:
            break
        # A broken frame: go on with a later one of this stream.
        heads, syncs = b.find(b"fLaC"), b.find(b"\xff\xf8" if b[start + 1] == 0xF8 else b"\xff\xf9")
        stop, k = bisect_left(heads, end), bisect_left(syncs, p + 1)
        if k == len(syncs) or stop < len(heads) and syncs[k] >= heads[stop]:
            break
        p = syncs[k]
    return end - at if end else at - len(b)


def _ogg(b: Bytes, at: int) -> int:
    """To the page with which all streams that have begun have ended."""
    ends = b.known.setdefault("ogg", {})
    if at in ends:
        return max(ends[at] - at, 0)
    pages, p = [], at  # (place, end, serial, last of its stream)
    while p + 27 <= len(b) and p not in ends and bytes(b[p : p + 5]) == b"OggS\x00":
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + 27 + n > len(b) or end > len(b):
            break
        pages.append((p, end, bytes(b[p + 14 : p + 18]), b[p + 5] & 4))
        p = end
    # From the last page back: a page needs its stream's next last page, and what stands between needs the same.
    done, need = {}, {}
    for k in reversed(range(len(pages))):
        p, _, serial, last = pages[k]
        if last:
            need[serial] = k
        top, j = need.get(serial), k + 1
        while top is not None and j <= top:
            top = max(top, done[j]) if done[j] is not None else None
            j = done[j] + 1 if top is not None else j
        done[k] = top
        ends[p] = pages[top][1] if top is not None else 0
    return max(ends.get(at, 0) - at, 0)


def _mp4(b: Bytes, at: int) -> int:
    """To the last box, or to the ftyp of a next file; a moov box must be among them."""

    def box(p: int) -> tuple[bytes, int]:
        if p + 8 > len(b):
            return b"", 0
        n, kind = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        if n == 1 and p + 16 <= len(b):
            n = int.from_bytes(b[p + 8 : p + 16], "big")
        return (kind, p + n) if n >= 8 and p + n <= len(b) and kind.isalnum() else (b"", 0)

    def to_end(p: int) -> tuple[bool, int]:
        kind, end = box(p)
        return (False, end) if kind not in (b"", b"ftyp") else (True, p)

    def to_moov(p: int) -> tuple[bool, int]:
        kind, end = box(p)
        return (True, p) if kind == b"moov" else (False, end) if kind not in (b"", b"ftyp") else (True, 0)

    kind, p = box(at) if at >= 0 else (b"", 0)
    return b.follow("mp4", p, to_end) - at if kind == b"ftyp" and b.follow("moov", p, to_moov) else 0


VALIDATORS = {"png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "wav": _riff(b"WAVE"), "webp": _riff(b"WEBP"), "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg, "mp4": _mp4}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, _, magic, back in SIGNATURES:
            self.automaton.add_word(magic.decode("latin-1"), (kind, back + len(magic) - 1))
        self.automaton.make_automaton()

    def __call__(self, raw: bytes) -> tuple[str | None, int, list[tuple[str, int, int]]]:
        """(kind at the start or None, its length, carved media behind the start as (kind, offset, length))."""
        view, kind, length, carved, until, open_ = Bytes(raw), None, 0, [], 1, None
        hits = sorted({(end - back, k) for end, (k, back) in self.automaton.iter(raw.decode("latin-1")) if end >= back})
        for at, k in hits:
            if at and at < until:
                continue
            n = VALIDATORS[k](view, at)
            if n and open_ is not None:  # what has no end of its own ends where the next begins
                if open_:
                    carved[-1] = (*carved[-1][:2], at - open_)
                else:
                    length = at
                open_ = None
            if n < 0:
                open_, n = at, -n
                end = at + 1
            else:
                end = at + n
            if n and at == 0:
                kind, length = k, n
            elif n:
                carved.append((k, at, n))
                until = end
        return kind, length, carved


# ---------------------------------------------------------------- storing text as 8-bit samples

RATE = 8000


def to_wav(text: bytes) -> bytes:
    """The bytes, padded with 0 to a positive multiple of 64, as 8-bit mono samples; `size` keeps the unpadded length."""
    payload = text + bytes(-len(text) % 64 if text else 64)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sIQ", b"size", 8, len(text)) + struct.pack("<4sI", b"data", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_chunks(raw: bytes) -> dict[bytes, bytes]:
    out, p = {}, 12
    while p + 8 <= len(raw):
        n = int.from_bytes(raw[p + 4 : p + 8], "little")
        out[raw[p : p + 4]] = raw[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(media_id, media, declared): each whole text as a WAV file of 8-bit samples; null text: empty.

    Ids keep their type, null ones too; equal texts give equal bytes; repeated rows give repeated rows;
    other columns, whatever their names, are ignored; an empty table gives no rows. A text's file must
    stay under WAV's 4 GB, which Spark's own limit for a value (2 GB) ensures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            media = [to_wav((t or "").encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(media))], ["media_id", "media", "declared"])

    src = docs.select(F.col(id_col).alias("media_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"media_id {src.schema['media_id'].dataType.simpleString()}, media binary, declared string")


INSPECTED = "declared string, media_type string, corrected boolean, valid_bytes long, carved array<struct<media_type:string,offset:long,length:long,sha256:string>>, media_bytes long, media_sha256 string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def inspect(media: DataFrame, id_col: str = "media_id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """One row per media value: its true type, whether that corrects the declared one, and what is carved from it.

    For 8-bit WAV the samples are read back: payload_* and tail_crc32 are theirs, n_bytes is the
    length stored beside them (else the number of samples); for other types these are null. Null
    media: counts 0 and an unknown type. Bytes of no known type, or broken ones, keep the declared
    type if that names no known format, else become unknown. Repeated rows give repeated rows, an
    empty table gives none, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniff = Sniffer()
        known = set(MIME.values())
        schema = pa.schema([("declared", pa.string()), ("media_type", pa.string()), ("corrected", pa.bool_()), ("valid_bytes", pa.int64()), ("carved", pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])
        for b in chunks(batches, "media"):
            rows = []
            for raw, declared in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = raw or b""
                kind, n, found = sniff(raw)
                true = MIME[kind] if kind else UNKNOWN if declared is None or declared in known else declared
                carved = [{"media_type": MIME[k], "offset": at, "length": m, "sha256": hashlib.sha256(raw[at : at + m]).hexdigest()} for k, at, m in found]
                row = {"declared": declared, "media_type": true, "corrected": true != declared, "valid_bytes": n, "carved": carved, "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()}
                shape = ""
                parts = wav_chunks(raw) if kind == "wav" else {}
                if len(parts.get(b"fmt ", b"")) >= 16:
                    _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
                    shape = f";rate={rate};channels={channels};bits={bits}"
                    if bits == 8:
                        samples = parts[b"data"]
                        size = int.from_bytes(parts[b"size"], "little") if b"size" in parts else len(samples)
                        row |= {"n_bytes": size, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-64:])}
                        shape += f";samples={len(samples)}"
                row["feature"] = f"{true}{shape};carved=" + ",".join(f"{k}@{at}+{m}" for k, at, m in found)
                rows.append(row)
            done = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([b.column(0), *done.columns], ["media_id", *schema.names])

    src = media.select(F.col(id_col).alias("media_id"), F.col(media_col).alias("media"), F.col(declared_col).cast("string").alias("declared"))
    return src.mapInArrow(run, f"media_id {src.schema['media_id'].dataType.simpleString()}, {INSPECTED}")
