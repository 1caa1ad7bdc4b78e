"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on the raw UTF-8 bytes of an Arrow string column with numpy, so that no
Python code runs per character or per word.  Batches are cut into chunks of bounded bytes
(a single longer text is a chunk of its own), which bounds memory without cutting any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[int, np.ndarray] = {}
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * _B)


def byte_table(seed: int = 7) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = seeded(seed, 256)
    return _tables[seed]


def _pow(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept and grown per process."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end], from one prefix sum: position-independent and
    order-dependent.  Segments may overlap."""
    n = len(values)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _pow(_B, n), out=prefix[1:], dtype=np.uint64)
    return mix((prefix[ends] - prefix[starts]) * _pow(_B_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def string_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n+1 offsets; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.binary() if pa.types.is_large_binary(col.type) else pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about `limit` text bytes each, with the bytes and offsets of `column`."""
    if not batch.num_rows:
        return
    data, off = string_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, as UTF-8 bytes of the same length."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        out[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def words(data: np.ndarray, off: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 offsets into them by text.

    Words are runs of bytes other than ASCII white space; with `letters`, runs of ASCII
    letters, digits and bytes above 127 (so punctuation never belongs to a word).
    """
    inside = _LETTER[data] if letters else ~_SPACE[data]
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < n]
    begins[cut] = inside[cut]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    return segment_hash(byte_table(seed)[data], starts, ends)


def text_of(position: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which text each word belongs to, given the offsets by text."""
    return np.searchsorted(off, position, side="right") - 1


def window_hashes(hashes: np.ndarray, word_off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `length` words that lie in one text; their first words and texts."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    per = np.maximum(np.diff(word_off) - length + 1, 0)
    text = np.repeat(np.arange(len(per)), per)
    ends = np.cumsum(per)
    at = np.arange(int(ends[-1])) - np.repeat(ends - per, per) + np.repeat(word_off[:-1], per)
    return segment_hash(hashes, at, at + length), at, text


def sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over each values[i : i + width], for i up to len(values) - width."""
    n = len(values)
    rows = -(-n // width)
    block = np.full(rows * width, fill, dtype=values.dtype)
    block[:n] = values
    block = block.reshape(rows, width)
    before = best.accumulate(block, axis=1).ravel()
    after = best.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])


def winnow(h: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """True where h is the smallest of some `width` neighbouring windows of one text."""
    n = len(h)
    if n < width:
        return np.zeros(n, bool)
    low = sliding(h, width, np.minimum, np.iinfo(np.uint64).max)
    low[text[width - 1 :] != text[: n - width + 1]] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return sliding(padded, width, np.maximum, 0) == h
