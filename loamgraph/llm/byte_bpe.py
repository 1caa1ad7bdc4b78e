"""Byte-level BPE with a sentencepiece model that is serialised from a vocabulary of ranks.

The vocabulary file (base64 token and rank a line) is turned into a sentencepiece BPE model without any
training: every token becomes a piece of byte-mapped characters (one printable character for each
byte, so no piece holds white space) with the score -rank, and the normaliser is the identity.
sentencepiece merges the pair with the highest score, which is the pair with the lowest rank, so it
gives the tokens of the original encoder.  The ids are the ranks.

Encoding splits a text into pre-tokens and encodes every distinct one once in a while (a cache of
bounded size); decoding looks up each id's bytes, the inverse of the mapping, so that
decode(encode(x)) = x for every text, also for bytes that aren't UTF-8.  Whole texts are encoded.  A null text has null ids, no
count and a null `lossless`; an empty one an empty list.  Rows that repeat give equal rows,
an empty table an empty result; columns besides the key and text are ignored.  Ids that are null or not
in the vocabulary decode to no bytes.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loamgraph.llm._spark import documents, named, text_input
from loamgraph.llm._text import byte_table, chunks, segment_hash, string_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, letters, digits, other signs and white space, each with at most one space before it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CACHE = 1 << 19
_UNKNOWN = 0


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    table = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chr(b) if b in own else table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token of each rank; ranks must be 0 .. n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"the ranks in {path} have gaps")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model: the unknown piece at 0, then token r at r + 1 with the score -r."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        piece = "".join([chars[b] for b in token]).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, float(-rank))))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, _UNKNOWN) + b"".join(_field(i, (1 << 64) - 1) for i in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


_WHITE, _ALPHA, _DIGIT, _OTHER, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[:128] = _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE
_KIND[28:32] = _HARD
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3:0xCA] = _ALPHA


def plain_cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of PATTERN begin, as a mask over the bytes, and which texts it holds for:
    those of ASCII (without its separators 28 to 31) and the letters from U+00C0 to U+027F."""
    n = len(data)
    kind = _KIND[data]
    tail = (data & 0xC0) == 0x80
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    after_letter = tail & (before >= 0xC3) & (before < 0xCA) & ~((before == 0xC3) & ((data == 0x97) | (data == 0xB7)))
    kind[after_letter] = _ALPHA
    hard = np.concatenate([[0], np.cumsum(kind == _HARD)])
    plain = hard[off[1:]] == hard[off[:-1]]
    first = np.zeros(n + 1, bool)
    first[off] = True
    first = first[:n]
    last = np.concatenate([first[1:], [True]])
    next_kind = np.concatenate([kind[1:], [_WHITE]])
    next_white = (next_kind == _WHITE) | last
    before_kind = np.concatenate([[_HARD], kind[:-1]])
    new = first | (kind != before_kind)
    white = kind == _WHITE
    # the last of several white characters is cut off before a word; a blank joins the word
    new |= white & ~next_white
    joins = (before_kind == _WHITE) & (before == 32) & ~white & ~first
    new &= ~joins
    quote = np.flatnonzero((data == 39) & (first | ((before_kind != _OTHER) & (before != 32))) & ~last)
    if len(quote):
        room = np.concatenate([data, np.zeros(3, np.uint8)])
        ends = off[np.searchsorted(off, quote, side="right")]
        one = np.isin(room[quote + 1], np.frombuffer(b"stmd", np.uint8))
        x, y = room[quote + 1], room[quote + 2]
        two = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & (quote + 2 < ends)
        new[quote[one | two] + 1] = False
        new[(quote + 2)[one & (quote + 2 < n)]] = True
        new[(quote + 3)[two & (quote + 3 < n)]] = True
    return new, plain


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], model: bytes | None = None):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model or model_bytes(tokens))
        self.split = regex.compile(PATTERN).findall
        self.map = dict(enumerate(byte_characters()))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.clear()

    def clear(self) -> None:
        """Forget all pre-tokens: hashes in order, and where the ids of each are."""
        self.hash, self.at, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[start:end], one after another, and how many each has."""
        mapped = gather(data, starts, ends - starts).tobytes().decode("latin-1").translate(self.map)
        stop = np.cumsum(ends - starts)
        words = [mapped[a:b] for a, b in zip((stop - (ends - starts)).tolist(), stop.tolist(), strict=True)]
        found = self.model.encode(words, num_threads=1)
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(count.sum())) - 1, count

    def _known(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions of the sorted hashes in the cache, after it learned what is new."""
        if len(self.hash) > CACHE:
            self.clear()
        at = np.searchsorted(self.hash, hashes)
        new = at == len(self.hash)
        new[~new] = self.hash[at[~new]] != hashes[~new]
        if new.any():
            ids, count = self.pieces(data, starts[new], ends[new])
            place = at[new]  # both are sorted, so the new ones are merged in
            self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(count) - count)
            self.count = np.insert(self.count, place, count)
            self.ids = np.concatenate([self.ids, ids])
            self.hash = np.insert(self.hash, place, hashes[new])
            at = np.searchsorted(self.hash, hashes)
        return at

    def encode_one(self, text: bytes) -> np.ndarray:
        """The ids of one text by PATTERN itself, without the cache."""
        words = [w.encode("utf-8", "surrogateescape") for w in self.split(text.decode("utf-8", "surrogateescape"))]
        ends = np.cumsum([len(w) for w in words]).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return self.pieces(np.frombuffer(text, np.uint8), starts, ends)[0] if words else np.empty(0, np.int32)

    def encode_bytes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n+1 offsets into them by text.

        Pre-tokens are told apart by a 64-bit hash, so every text is decoded again, and one that does
        not come back (as after a collision) is encoded without the cache.
        """
        n = len(off) - 1
        new, plain = plain_cuts(data, off)
        starts = np.flatnonzero(new & np.repeat(plain, np.diff(off)))
        text = np.searchsorted(off, starts, side="right") - 1
        ends = np.empty_like(starts)
        if len(starts):
            ends[:-1] = starts[1:]
            ends[-1] = len(data)
            ends = np.minimum(ends, off[text + 1])
        hashes = segment_hash(byte_table(17)[data], starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._known(unique, data, starts[first], ends[first])[inverse]
        size = self.count[at]
        ids = gather(self.ids, self.at[at], size)
        per = np.bincount(text, weights=size, minlength=n).astype(np.int64)
        done = np.concatenate([[0], np.cumsum(per)])
        back, where = self.decode_all(ids, done)
        wrong = np.flatnonzero(np.diff(where) != np.diff(off))
        if not len(wrong) and len(back) == len(data):
            differ = np.flatnonzero(back != data)
            wrong = np.unique(np.searchsorted(off, differ, side="right") - 1) if len(differ) else wrong
        else:
            wrong = np.array([i for i in range(n) if back[where[i] : where[i + 1]].tobytes() != data[off[i] : off[i + 1]].tobytes()], np.int64)
        if len(wrong):
            parts = [ids[done[i] : done[i + 1]] for i in range(n)]
            for i in wrong.tolist():
                parts[i] = self.encode_one(data[off[i] : off[i + 1]].tobytes())
            ids = np.concatenate(parts)
            done = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, done

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, off = string_bytes(pa.array(texts, pa.string()))
        return self.encode_bytes(data, off)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.begin[ids], self.size[ids]).tobytes()

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many lists of ids, and the offsets into them by list."""
        size = np.concatenate([[0], np.cumsum(self.size[ids])])
        return gather(self.bytes, self.begin[ids], self.size[ids]), size[off]


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin : begin + size] of all, one after another."""
    total = int(size.sum())
    shift = begin - (np.cumsum(size) - size)
    return values[np.arange(total) + np.repeat(shift, size)]


def _list(ids: np.ndarray, off: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null)


def _codec(shared) -> Codec:
    tokens, model = shared.value
    return Codec(tokens, model)


def _encode_batches(key: str, shared, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                null = part.column("text").is_null()
                ids, at = codec.encode_bytes(data, off)
                arrays = [part.column(key), _list(ids, at, null), pa.array(np.diff(at), mask=null.to_numpy(zero_copy_only=False))]
                names = [key, "ids", "n_tokens"]
                if check:
                    back, where = codec.decode_all(ids, at)
                    same = np.array([back[where[i] : where[i + 1]].tobytes() == data[off[i] : off[i + 1]].tobytes() for i in range(part.num_rows)], bool)
                    arrays.append(pa.array(same, mask=null.to_numpy(zero_copy_only=False)))
                    names.append("lossless")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _decode_batches(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column("ids")
                null = col.is_null().to_numpy(zero_copy_only=False)
                size = np.where(null, 0, pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
                flat = pc.fill_null(pc.list_flatten(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                ok = (flat >= 0) & (flat < len(codec.size))
                off = np.concatenate([[0], np.cumsum(ok)])[off]
                back, where = codec.decode_all(flat[ok], off)
                # the bytes as they are, whether UTF-8 or not
                valid = pa.array(~null).buffers()[1] if null.any() else None
                texts = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(where.astype(np.int32).tobytes()), pa.py_buffer(back.tobytes()), valid)
                yield pa.RecordBatch.from_arrays([part.column(key), texts], names=[key, "text"])

    return run


def _share(spark: SparkSession, vocabulary: str):
    # one vocabulary, whose size does not depend on the data
    tokens = read_ranks(vocabulary)
    return spark.sparkContext.broadcast((tokens, model_bytes(tokens)))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", check: bool = True) -> DataFrame:
    """(key, ids, n_tokens) of every document and, with `check`, whether decoding gives its bytes
    again; see the module for all cases."""
    kind = dict(named(docs, key).dtypes)[key]
    fields = f"`{key}` {kind}, ids array<int>, n_tokens long" + ", lossless boolean" * check
    shared = _share(docs.sparkSession, vocabulary)
    return text_input(docs, key).mapInArrow(_encode_batches(key, shared, check), fields)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows of (key, ids); null ids give a null text, no ids an empty one."""
    encoded = named(encoded, key, "ids")
    kind = dict(encoded.dtypes)[key]
    shared = _share(encoded.sparkSession, vocabulary)
    return encoded.select(key, encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(_decode_batches(key, shared), f"`{key}` {kind}, text string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLE: dict[str, str] = {}
