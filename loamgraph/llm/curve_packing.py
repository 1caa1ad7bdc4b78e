"""Packing of documents along a space-filling curve.

A document's vector holds the signed hashed counts of its words; it is projected to DIMS
dimensions by random signs, divided by its length, and each coordinate is put on a grid of
2**BITS cells over [-1, 1].  The grid cell's position on the Hilbert curve is the key.  Documents are
ordered by (key, doc_id with nulls last, text key) and laid end to end; every CAPACITY words of this
line are a pack, so that a pack holds neighbours on the curve, none of it is unused but the last one's
end, and documents longer than what is left of a pack go on in the next.

The order is a range sort by key; a position on the line is the words of all earlier ranges plus those
before it in its range, so nothing but one sum for each range is gathered.  Words are runs of bytes
other than ASCII white space.  Null, empty and wordless texts have no words: they are put in no pack.
Rows that repeat are packed as often as they occur; ties in every ordering column are between
equal rows.  An empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._spark import cut, documents, text_input, text_key
from loamgraph.llm._text import chunks, lower_bytes, seeded, text_of, word_hashes, words

CAPACITY = 2048
DIMS = 5
BITS = 12


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points of (n, dims) unsigned grid cells.

    Skilling's transposition, for all points at once: undo the excess work of each bit plane,
    then Gray-encode and interleave.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.view(np.int64)


def coordinates(data: np.ndarray, off: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Projected unit vectors in [-1, 1] (n, dims), and the number of words of every text.

    A word's hash gives its random signs in all dimensions, so the projection of the hashed vector is a
    sum of signs over words; dividing by the root of the summed squares makes it a direction.
    """
    starts, ends, word_off = words(data, off)
    n = len(off) - 1
    low = lower_bytes(data)
    h = word_hashes(low, starts, ends) ^ seeded(41, 1)[0]
    text = text_of(np.arange(len(h)), word_off)
    out = np.zeros((n, dims))
    for j in range(dims):
        sign = ((h >> np.uint64(j * 7 + 3)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out[:, j] = np.bincount(text, weights=sign, minlength=n)
    return out / np.maximum(np.sqrt((out**2).sum(1)), 1e-12)[:, None], np.diff(word_off)


def _key_batches(dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                x, n = coordinates(data, off, dims)
                cells = np.clip(np.floor((x + 1) / 2 * (1 << bits)), 0, (1 << bits) - 1).astype(np.uint64)
                some = pa.array(n > 0)
                cols = [part.column("doc_id"), part.column("k"), pa.array(hilbert_keys(cells, bits)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "key", "n"]).filter(some)

    return run


def _line_batches(ranges: dict[int, int]):
    """Word positions on the line; the input's partitions are whole ranges in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rng, n = batch.column("rng").to_numpy(), batch.column("n").to_numpy()
            begin = np.empty(len(n), np.int64)
            for r in np.unique(rng).tolist():
                sel = rng == r
                total = np.cumsum(n[sel])
                begin[sel] = at.get(r, ranges[r]) + total - n[sel]
                at[r] = at.get(r, ranges[r]) + int(total[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("key"), pa.array(begin)], names=["doc_id", "n", "key", "begin"])

    return run


def line(docs: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """(doc_id, n, key, begin): where each document begins on the line of all words."""
    d = text_input(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("k", text_key())
    keyed = d.mapInArrow(_key_batches(dims, bits), "doc_id long, k long, key long, n long")
    order = ["key", F.col("doc_id").isNull(), "doc_id", "k"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # checkpointed, so that the ranges are the same when they are summed and when they are read
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("rng", F.spark_partition_id())
    ranged = cut(ranged)
    sums = sorted((r["rng"], r["n"]) for r in ranged.groupBy("rng").agg(F.sum("n").alias("n")).collect())
    begins, total = {}, 0
    for r, n in sums:
        begins[r] = total
        total += n
    return ranged.mapInArrow(_line_batches(begins), "doc_id long, n long, key long, begin long")


def pack(docs: DataFrame, capacity: int = CAPACITY, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """(pack_id, doc_ids, starts, lengths, words, first_key, last_key): lists in curve order; a
    document's words from starts on, lengths of them, are in the pack."""
    on = line(docs, dims, bits)
    end = F.col("begin") + F.col("n")
    pieces = on.withColumn("pack_id", F.explode(F.sequence(F.floor(F.col("begin") / capacity), F.floor((end - 1) / capacity))))
    start = F.greatest(F.col("begin"), F.col("pack_id") * capacity)
    stop = F.least(end, (F.col("pack_id") + 1) * capacity)
    pieces = pieces.select("pack_id", "doc_id", "key", start.alias("at"), (start - F.col("begin")).alias("start"), (stop - start).alias("length"))
    packs = pieces.groupBy("pack_id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("doc_id", F.lit(None).cast("long")).alias("doc_id"), "start", "length"))).alias("p"),
        F.sum("length").alias("words"),
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
    )
    return packs.select(
        "pack_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"), "words", "first_key", "last_key"
    )


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op8_curve_packing": op8_curve_packing}
ORACLE: dict[str, str] = {}
