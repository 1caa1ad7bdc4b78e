"""Types of media columns by signature, and media carved out of them.

1. Aho-Corasick finds all magic numbers of all formats in one pass over a value's bytes.
2. A validator of the format walks its structure (chunks with checksums, markers, boxes, sizes in
   headers) and gives the length of the object, or refuses it.
3. The value's type is that of the valid object at its start (after white space for text formats); else
   text/html or image/svg+xml or application/json or text/plain for UTF-8 text that looks so, else
   application/octet-stream.  `mismatch` says that the declared type is another one;
   parameters, case and synonyms of a declared type don't count, and text/plain declared for
   any text is right.
4. Valid objects elsewhere in the value, and in base64 data: URIs of a text, are carved: type, offset
   and length in bytes, where the carved bytes are those of the value or of the decoded URI (whose
   offset and length are those of the URI).  An object inside another carved one, or inside the object
   at the start, is part of that one and isn't carved again.

Values are read whole, hits in order of place, and what lies in an object already found is not validated;
compressed data is checked in pieces of PIECE bytes of output, so that a bomb costs time but no memory.
Null and empty values have a null type, no mismatch and nothing to carve; a null
declared type is no mismatch.  Rows that repeat give equal rows, an empty table gives an empty
result, columns besides the key, the value and the declared type are ignored.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._spark import named

SYNONYMS = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "image/x-png": "image/png", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "application/x-gzip": "application/gzip", "application/x-zip-compressed": "application/zip", "audio/mp3": "audio/mpeg", "application/xhtml+xml": "text/html", "image/x-ms-bmp": "image/bmp", "text/json": "application/json"}


def _u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def _u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big")


def _l32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = _u32(b, p), b[p + 4 : p + 8]
        end = p + 12 + n
        if end > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : end - 4]) != _u32(b, end - 4):
            return 0
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return 0


def jpeg(b: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        m = b[p + 1]
        if m == 0xFF:
            p += 1
            continue
        if m == 0xD9:
            return p + 2 - at if frame else 0
        if m == 1 or 0xD0 <= m <= 0xD7:
            p += 2
            continue
        n = _u16(b, p + 2)
        if m < 0xC0 or m == 0xD8 or n < 2:
            return 0
        frame |= 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if m == 0xDA:
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if b[p + 1] == 0xD9:
                return p + 2 - at if frame else 0
    return p + 2 - at if frame and b[p : p + 2] == b"\xff\xd9" else 0


def _gif_blocks(b: bytes, p: int) -> int:
    while p < len(b):
        if not b[p]:
            return p + 1
        p += 1 + b[p]
    return 0


def gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    images = 0
    while 0 < p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if images else 0
        if b[p] == 0x21:
            p = _gif_blocks(b, p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = _gif_blocks(b, p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
            images += 1
        else:
            return 0
    return 0


def _riff(form: bytes, chunk: tuple[bytes, ...]) -> Callable[[bytes, int], int]:
    def check(b: bytes, at: int) -> int:
        n = 8 + _l32(b, at + 4)
        if b[at + 8 : at + 12] != form or n < 20 or at + n > len(b):
            return 0
        p, seen = at + 12, False
        while p + 8 <= at + n:
            seen |= b[p : p + 4] in chunk
            p += 8 + _l32(b, p + 4)
            p += (p - at) & 1
        return n if seen and p - at in (n, n + 1) else 0

    return check


def bmp(b: bytes, at: int) -> int:
    n, start, header = _l32(b, at + 2), _l32(b, at + 10), _l32(b, at + 14)
    planes, depth = b[at + 26 : at + 28], int.from_bytes(b[at + 28 : at + 30], "little")
    ok = header in (40, 52, 56, 64, 108, 124) and planes == b"\1\0" and depth in (1, 4, 8, 16, 24, 32) and not _l32(b, at + 6)
    return n if ok and 14 + header <= start < n and at + n <= len(b) else 0


def pdf(b: bytes, at: int) -> int:
    if not re.compile(rb"%PDF-[12]\.\d").match(b, at):
        return 0
    stop = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, stop if stop > 0 else len(b))
    if end < 0 or b.rfind(b"startxref", at, end) < 0:
        return 0
    end += 5
    return end + len(re.compile(rb"\r?\n?").match(b, end).group()) - at


#: Bytes that are read, and decompressed, at once.
PIECE = 1 << 20


def gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    d, p, rest = zlib.decompressobj(31), at, b""
    try:
        while not d.eof:
            if not rest:
                if p >= len(b):
                    return 0
                rest = b[p : p + PIECE]
                p += len(rest)
            d.decompress(rest, PIECE)
            rest = d.unconsumed_tail
    except zlib.error:
        return 0
    return p - at - len(d.unused_data)


@lru_cache(maxsize=1)
def zip_ends(b: bytes) -> dict[int, int]:
    """Where each archive of a value begins and ends, out of all end records, once for a value."""
    out, p = {}, 0
    while (p := b.find(b"PK\x05\x06", p)) >= 0 and p + 22 <= len(b):
        size, offset = _l32(b, p + 12), _l32(b, p + 16)
        at, end = p - offset - size, p + 22 + int.from_bytes(b[p + 20 : p + 22], "little")
        if at >= 0 and end <= len(b) and (not size or b[at + offset : at + offset + 4] == b"PK\x01\x02"):
            out.setdefault(at, end)
        p += 4
    return out


def zip_(b: bytes, at: int) -> int:
    return max(zip_ends(b).get(at, 0) - at, 0)


def ogg(b: bytes, at: int) -> int:
    p, serial = at, b[at + 14 : at + 18]
    if at + 27 > len(b) or not b[at + 5] & 2:
        return 0
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and not b[p + 4]:
        table = b[p + 27 : p + 27 + b[p + 26]]
        end = p + 27 + b[p + 26] + sum(table)
        if len(table) != b[p + 26] or end > len(b):
            return 0
        last = b[p + 5] & 4 and b[p + 14 : p + 18] == serial
        p = end
        if last:
            return p - at
    return 0


def flac(b: bytes, at: int) -> int:
    p = at + 4
    if b[p : p + 4] != b"\0\0\0\x22" and b[p : p + 4] != b"\x80\0\0\x22":
        return 0
    while p + 4 <= len(b):
        last, n = b[p] & 0x80, int.from_bytes(b[p + 1 : p + 4], "big")
        p += 4 + n
        if p > len(b):
            return 0
        if last:
            # frames have no length of their own: they go to the end of the value
            return len(b) - at if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else 0
    return 0


_BIT_RATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]


def mp3(b: bytes, at: int) -> int:
    """An ID3v2 tag and the MPEG-1 layer 3 frames after it."""
    size = b[at + 6 : at + 10]
    if len(size) < 4 or max(size) > 127 or b[at + 3] > 4:
        return 0
    p = at + 10 + (size[0] << 21 | size[1] << 14 | size[2] << 7 | size[3])
    frames = 0
    while p + 4 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFE == 0xFA:
        rate, hz = b[p + 2] >> 4, b[p + 2] >> 2 & 3
        if not 0 < rate < 15 or hz == 3:
            break
        n = 144_000 * _BIT_RATES[rate] // (44100, 48000, 32000)[hz] + (b[p + 2] >> 1 & 1)
        if p + n > len(b):
            break
        p += n
        frames += 1
    return p - at if frames else 0


_BOXES = frozenset([b"ftyp", b"moov", b"mdat", b"free", b"skip", b"meta", b"uuid", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"pdin", b"emsg"])


def mp4(b: bytes, at: int) -> int:
    """`at` is the start of the ftyp box."""
    p, seen = at, set()
    while p + 8 <= len(b) and (kind := b[p + 4 : p + 8]) in _BOXES:
        n = _u32(b, p)
        if n == 1:
            n = int.from_bytes(b[p + 8 : p + 16], "big")
        elif n == 0:
            n = len(b) - p
        if n < 8 or p + n > len(b):
            return 0
        seen.add(kind)
        p += n
    return p - at if seen & {b"moov", b"moof", b"meta"} else 0


def tiff(b: bytes, at: int) -> int:
    order = "little" if b[at] == 0x49 else "big"
    num = lambda p, n: int.from_bytes(b[p : p + n], order)
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    p, end, seen = num(at + 4, 4), 8, set()
    while p:
        many = num(at + p, 2)
        if p < 8 or p in seen or not many or at + p + 6 + 12 * many > len(b):
            return 0
        seen.add(p)
        end = max(end, p + 6 + 12 * many)
        offsets, counts = [], []
        for e in range(p + 2, p + 2 + 12 * many, 12):
            tag, kind, count = num(at + e, 2), num(at + e + 2, 2), num(at + e + 4, 4)
            n = size.get(kind, 0) * count
            if not n:
                return 0
            where = e + 8 if n <= 4 else num(at + e + 8, 4)
            end = max(end, where + n)
            if at + end > len(b):
                return 0
            if tag in (273, 324, 279, 325):
                (offsets if tag in (273, 324) else counts).extend(num(at + where + i * size[kind], size[kind]) for i in range(count))
        end = max([end, *(o + c for o, c in zip(offsets, counts, strict=False))])
        p = num(at + p + 2 + 12 * many, 4)
    return end if seen and at + end <= len(b) else 0


#: Magic bytes, how far they are behind the object's start, type and validator.
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg),
    (b"GIF87a", 0, "image/gif", gif),
    (b"GIF89a", 0, "image/gif", gif),
    (b"WEBPVP8", 8, "image/webp", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"WAVEfmt ", 8, "audio/wav", _riff(b"WAVE", (b"data",))),
    (b"AVI LIST", 8, "video/x-msvideo", _riff(b"AVI ", (b"LIST",))),
    (b"BM", 0, "image/bmp", bmp),
    (b"%PDF-", 0, "application/pdf", pdf),
    (b"\x1f\x8b\x08", 0, "application/gzip", gzip),
    (b"PK\x03\x04", 0, "application/zip", zip_),
    (b"OggS\0\2", 0, "audio/ogg", ogg),
    (b"fLaC", 0, "audio/flac", flac),
    (b"ID3", 0, "audio/mpeg", mp3),
    (b"ftyp", 4, "video/mp4", mp4),
    (b"II*\0", 0, "image/tiff", tiff),
    (b"MM\0*", 0, "image/tiff", tiff),
]
_DATA_URI = re.compile(rb"data:([a-z]+/[a-z0-9.+-]+)?(?:;[a-z0-9-]+=[^;,\s]+)*;base64,([A-Za-z0-9+/_-]+(?:\s*[A-Za-z0-9+/_-]+)*={0,2})", re.I)
_HTML = re.compile(rb"(?:<!--.*?-->\s*|<\?xml[^>]*\?>\s*)*<(?:!doctype\s+html|html|head|body)\b", re.I | re.S)
_SVG = re.compile(rb"(?:<!--.*?-->\s*|<\?xml[^>]*\?>\s*|<!doctype\s+svg[^>]*>\s*)*<svg\b", re.I | re.S)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, _, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), i)
    a.add_word(";base64,", -1)
    a.make_automaton()
    return a


def text_type(b: bytes) -> str:
    """Type of bytes in which no media object begins."""
    try:
        text = b.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream"
    if "\0" in text:
        return "application/octet-stream"
    head = b.lstrip(b"\xef\xbb\xbf \t\r\n")
    if _HTML.match(head):
        return "text/html"
    if _SVG.match(head):
        return "image/svg+xml"
    if head[:1] in (b"{", b"["):
        import json

        try:
            json.loads(text)
            return "application/json"
        except (ValueError, RecursionError):
            pass
    return "text/plain"


def sniff(b: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """Type of the whole value, and (type, offset, length) of each carved object in order."""
    hits: list[tuple[int, int]] = []
    uris = False
    for end, i in automaton().iter(b.decode("latin-1")):
        if i < 0:
            uris = True
        elif (at := end + 1 - len(FORMATS[i][0]) - FORMATS[i][1]) >= 0:
            hits.append((at, i))
    inner: dict[int, tuple[int, str]] = {}
    if uris:
        for m in _DATA_URI.finditer(b):
            try:
                value = base64.b64decode(re.sub(rb"\s", b"", m.group(2)).translate(bytes.maketrans(b"-_", b"+/")), validate=True)
            except binascii.Error:
                continue
            kind, _ = sniff(value)
            if kind not in ("application/octet-stream", "text/plain"):
                inner[m.start()] = (m.end() - m.start(), kind)
                hits.append((m.start(), -1))
    hits.sort()
    whole, carved, end, n = None, [], 0, 0
    while n < len(hits):
        at = hits[n][0]
        best = (0, "")
        while n < len(hits) and hits[n][0] == at:
            i = hits[n][1]
            n += 1
            if at >= end:
                size, kind = inner[at] if i < 0 else (FORMATS[i][3](b, at), FORMATS[i][2])
                if size > best[0] or (size == best[0] and kind < best[1]):
                    best = (size, kind)
        size, kind = best
        if not size:
            continue
        end = at + size
        if at == 0 and b[:5].lower() != b"data:":
            whole = kind
        else:
            carved.append((kind, at, size))
    return whole or text_type(b), carved


def canonical(declared: str) -> str:
    name = declared.split(";")[0].strip().lower()
    return SYNONYMS.get(name, name)


def mismatch(declared: str | None, kind: str) -> bool:
    if declared is None or not declared.strip():
        return False
    name = canonical(declared)
    return name != kind and not (name == "text/plain" and kind in ("text/html", "image/svg+xml", "application/json"))


_CARVED = "array<struct<type:string,offset:long,length:long>>"


def _sniff_batches(key: str):
    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, declared = batch.column("value"), batch.column("declared").to_pylist()
            types, wrong, carved, sizes = [], [], [], []
            for i in range(batch.num_rows):  # one value at a time: they may be large
                b = values[i].as_py()
                t, c = sniff(b) if b else (None, [])
                types.append(t)
                wrong.append(t is not None and mismatch(declared[i], t))
                carved.append([{"type": x, "offset": o, "length": n} for x, o, n in c])
                sizes.append(None if b is None else len(b))
            cols = [batch.column(key), pa.array(sizes, pa.int64()), batch.column("declared"), pa.array(types, pa.string()), pa.array(wrong), pa.array(carved, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "bytes", "declared_type", "type", "mismatch", "carved"])

    return run


def media_types(rows: DataFrame, key: str, value: str, declared: str | None = None, default: str | None = None) -> DataFrame:
    """(key, bytes, declared_type, type, mismatch, carved) of a string or binary column.

    The declared type is in the column `declared`; without one it is `default` for all rows.  See the
    module for all cases.
    """
    rows = named(rows, *dict.fromkeys([key, value, *([declared] if declared is not None else [])]))
    said = F.lit(default).cast("string") if declared is None else F.col(declared).cast("string")
    d = rows.select(F.col(key), F.col(value).cast("binary").alias("value"), said.alias("declared"))
    out = f"`{key}` {dict(rows.dtypes)[key]}, bytes long, declared_type string, type string, mismatch boolean, carved {_CARVED}"
    return d.mapInArrow(_sniff_batches(key), out)


def op9_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as the bytes that a server declared to be text/html."""
    return media_types(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", default="text/html")


QUERIES = {"op9_media_sniffing": op9_media_sniffing}
ORACLE: dict[str, str] = {}
