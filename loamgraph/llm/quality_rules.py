"""Quality by the hashed n-gram log-likelihood ratio of trusted text to the raw corpus.

A word becomes two tokens: itself in lower case, and its shape (letters, capitals, digits and letters
beyond ASCII as one class each, every run as one; other bytes as they are), marked where the word
repeats the one before it.  The 1-, 2- and 3-grams of a document's words and those of its shapes
are hashed to BUCKETS.  Two multinomials
are estimated, the raw one over all documents, the target one over all documents
that `labels` trusts (quality 1 in all of a document's labels).  A bucket's log ratio is log((t + PRIOR) / (e + PRIOR)), where t is its
n-grams in the target and e those to be expected there by its share of the raw corpus; so n-grams too rare
to tell weigh little.  A document's score is the mean over its n-grams; it is kept where that
is at least THRESHOLD nats per n-gram.

Whole texts and all n-grams count.  Null, empty and wordless texts have no n-gram: their score is
0 and they are rejected.  Without any trusted document there is no target: every score is 0 and
every document with a word is kept.  Labels with a null doc_id or quality trust nothing.  Rows that
repeat are scored alike, ties with the threshold are kept, an empty table gives an empty
result, and columns besides doc_id and text pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._spark import any_columns, cut, documents, named, text_input, with_text
from loamgraph.llm._text import byte_table, chunks, lower_bytes, segment_hash, text_of, window_hashes, word_hashes, words

BUCKETS = 1 << 18
ORDERS = (1, 2, 3)
THRESHOLD = -0.6
#: N-grams of a bucket that speak neither for nor against it.
PRIOR = 5.0
#: Trusted ids beyond which they are no longer broadcast but joined by a shuffle, with the same rows.
BROADCAST_IDS = 1 << 20

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of every word and of its shape, and the n+1 offsets into them by text."""
    starts, ends, word_off = words(data, off)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), word_off
    cls = _CLASS[data]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[starts] = True
    rank = np.cumsum(keep) - 1
    out = segment_hash(byte_table(11)[cls[keep]], rank[starts], rank[ends - 1] + 1)
    same = word_hashes(lower_bytes(data), starts, ends)
    text = text_of(np.arange(len(starts)), word_off)
    again = np.zeros(len(starts), bool)
    again[1:] = (same[1:] == same[:-1]) & (text[1:] == text[:-1])
    out[again] ^= _REPEAT
    return same, out, word_off


def buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the text of every n-gram."""
    *both, word_off = tokens(data, off)
    grams, texts = [], []
    for h in both:
        for n in ORDERS:
            g, _, text = window_hashes(h, word_off, n)
            grams.append(g)
            texts.append(text)
    return (np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(texts)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part, data, off in chunks(batch, "text"):
            g, text = buckets(data, off)
            raw += np.bincount(g, minlength=BUCKETS)
            trusted = part.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            target += np.bincount(g[trusted[text]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids that every label of theirs calls good."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("t_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"))
    return good.where("q = 1").select("t_id")


def ratios(docs: DataFrame, labels: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> np.ndarray:
    """log(p_target / p_raw), smoothed, of every bucket."""
    d, trusted = text_input(docs, "doc_id"), cut(trusted_ids(labels))
    few = trusted.count() <= broadcast_ids
    d = d.join(trusted.hint("broadcast" if few else "shuffle_hash"), d["doc_id"].cast("long") == F.col("t_id"), "left")
    counted = d.select(F.col("t_id").isNotNull().alias("trusted"), "text").mapInArrow(_count_batches, "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]] = rows["raw"]
    target[rows["bucket"]] = rows["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def score_texts(data: np.ndarray, off: np.ndarray, llr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio and number of n-grams of every text."""
    g, text = buckets(data, off)
    n = np.bincount(text, minlength=len(off) - 1)
    return np.bincount(text, weights=llr[g], minlength=len(off) - 1) / np.maximum(n, 1), n


def _score_batches(columns: list[str], text: str, llr, threshold: float, filtering: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch, text):
                score, n = score_texts(data, off, llr.value)
                keep = (score >= threshold) & (n > 0)
                arrays = [part.column(c) for c in columns]
                if filtering:
                    yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))
                else:
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(score), pa.array(n), pa.array(keep)], names=[*columns, "score", "ngrams", "keep"])

    return run


def _apply(docs: DataFrame, labels: DataFrame, columns: list[str], filtering: bool, threshold: float) -> DataFrame:
    llr = docs.sparkSession.sparkContext.broadcast(ratios(docs, labels))
    fields = [f"`{c}` {t}" for c, t in docs.select(*columns).dtypes]
    if not filtering:
        fields += ["score double", "ngrams long", "keep boolean"]
    d, text = with_text(docs, columns)
    return d.mapInArrow(_score_batches(columns, text, llr, threshold, filtering), ", ".join(fields))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, ngrams, keep) of every document; see the module for all cases."""
    return _apply(named(docs, "doc_id", "text"), labels, ["doc_id"], False, threshold)


@any_columns
def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold, all columns kept."""
    return _apply(docs, labels, docs.columns, True, threshold)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE: dict[str, str] = {}
