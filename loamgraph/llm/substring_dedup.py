"""Substring deduplication by level-wise doubling of repeated windows.

Words are runs of bytes other than ASCII white space, compared exactly.  A passage counts as
repeated when a window of LENGTH words occurs at two different places of the distinct texts.

1. Half-length windows (LENGTH // 2 words) are winnowed: in every run of LENGTH - LENGTH // 2 + 1
   neighbouring windows the one with the smallest hash is taken.  The choice depends on the
   words alone, so any repeated passage of LENGTH words has an anchor that is taken at each of
   its occurrences; about one position in 13 is shuffled and still no passage is missed.
2. Only where an anchor repeats are windows twice as long looked at: every window of LENGTH words
   that contains a repeated anchor is hashed and shuffled; those that occur once end here.
3. Windows repeated at one length alone are extended to twice that length, level by level, until
   no candidates survive: a window of twice the length can only repeat where its two halves do, and
   its hash is made of theirs.  The words that repeat are already settled by step 2; the further
   levels measure how long a repetition is: `longest` is the longest of the repeated windows of
   LENGTH, 2 LENGTH, 4 LENGTH ... words that overlap a span.

Of the occurrences of a window the one with the smallest (text key, position) stays.  A word is
removed if a removed window covers it and no window that stays does.  Among documents of the same
text the smallest doc_id stays (null ids last) and the others are removed as a whole; texts under
LENGTH words are never touched.  Rows repeating a (doc_id, text) are one document.  Null and
empty texts have no words and give no rows; an empty table gives an empty result; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._spark import Scratch, any_columns, cut, documents, join_groups, text_input, text_key, with_text
from loamgraph.llm._text import chunks, mix, segment_hash, window_hashes, winnow, word_hashes, words

#: Words of a passage that is to be found.
LENGTH = 50


def _anchor_batches(length: int):
    base = length // 2
    width = length - base + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                starts, ends, word_off = words(data, off)
                h, at, text = window_hashes(word_hashes(data, starts, ends), word_off, base)
                take = np.flatnonzero(winnow(h, text, width))
                k = part.column("k").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[take].view(np.int64)),
                        pa.array(k[text[take]]),
                        pa.array((at[take] - word_off[text[take]]).astype(np.int32)),
                    ],
                    names=["h", "k", "pos"],
                )

    return run


def repeated(rows: DataFrame) -> DataFrame:
    """Rows (h, k, pos) whose h occurs at two different (k, pos), with the smallest k of h as `low`.

    Rows must be a written table: they are read to count each h, combined before the shuffle, and again to
    be joined with the h that repeat; an h of very many rows is dealt to several tasks.
    """
    ends = rows.groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.min("pos").alias("a"), F.max("pos").alias("z"), F.count("*").alias("n"))
    return join_groups(rows, ends.where("low <> high or a <> z").select("h", "low", "n"), ["h"], "n", ["k", "pos"])


def _fresh_batches(length: int):
    """(k, text) with the copies that one task meets dropped, and texts too short for `length` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, _, off in chunks(batch, "text"):
                long = (np.diff(off) >= 2 * length - 1).tolist()
                ks = part.column("k").to_numpy(zero_copy_only=False).tolist()
                yield part.filter(pa.array([x and not (k in seen or seen.add(k)) for k, x in zip(ks, long, strict=True)], pa.bool_()))

    return run


def _window_batches(length: int):
    base = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                ks = part.column("k").to_numpy(zero_copy_only=False)
                starts, ends, word_off = words(data, off)
                h = word_hashes(data, starts, ends)
                anchors = part.column("anchors")
                size = np.diff(anchors.offsets.to_numpy()).astype(np.int64)
                text = np.repeat(np.arange(part.num_rows), size)
                a = anchors.flatten().to_numpy().astype(np.int64) + word_off[text]
                low, high = np.maximum(a - (length - base), word_off[text]), np.minimum(a, word_off[text + 1] - length)
                mark = np.zeros(len(h) + 2, np.int64)
                np.add.at(mark, low, 1)
                np.add.at(mark, high + 1, -1)
                cand = np.cumsum(mark[: len(h)]) > 0
                p = np.flatnonzero(cand)
                if not len(p):
                    continue
                hw = segment_hash(h, p, p + length)
                text = np.searchsorted(word_off, p, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(hw.view(np.int64)), pa.array(ks[text]), pa.array((p - word_off[text]).astype(np.int32))], names=["h", "k", "pos"])

    return run


def _double_batches(size: int):
    """Windows of twice `size` words, out of each text's repeated windows of `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, wins in zip(batch.column("k").to_pylist(), batch.column("wins"), strict=True):
                pos, h = wins.values.field("pos").to_numpy().astype(np.int64), wins.values.field("h").to_numpy().view(np.uint64)
                order = np.argsort(pos)
                pos, h = pos[order], h[order]
                at = np.minimum(np.searchsorted(pos, pos + size), len(pos) - 1)
                ok = np.flatnonzero(pos[at] == pos + size)
                if len(ok):
                    both = mix(mix(h[ok]) + h[at[ok]])
                    yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(np.full(len(ok), k, np.int64)), pa.array(pos[ok].astype(np.int32))], names=["h", "k", "pos"])

    return run


def _span_batches(length: int):
    """Spans of words by text, out of its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, wins in zip(batch.column("k").to_pylist(), batch.column("wins"), strict=True):
                v = wins.values
                pos, size = v.field("pos").to_numpy().astype(np.int64), v.field("words").to_numpy().astype(np.int64)
                # of a window whose smallest text is this one the first occurrence stays
                own, h = v.field("low").to_numpy(zero_copy_only=False), v.field("h").to_numpy()
                at = np.flatnonzero(own)
                at = at[np.lexsort((pos[at], h[at]))]
                own = np.zeros(len(pos), bool)
                own[at[np.concatenate([[True], h[at[1:]] != h[at[:-1]]])[: len(at)]]] = True
                n = int((pos + size).max())
                mark = np.zeros((2, n + 1), np.int64)
                base = size == length
                for row, sel in ((0, base), (1, base & own)):
                    np.add.at(mark[row], pos[sel], 1)
                    np.add.at(mark[row], pos[sel] + length, -1)
                covered, kept = np.cumsum(mark, axis=1)[:, :n] > 0
                state = covered.astype(np.int8) + (covered & ~kept)
                edge = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1], [True]]))
                # the longest window that covers each word
                longest = np.zeros(n, np.int64)
                for one in np.unique(size):
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, pos[size == one], 1)
                    np.add.at(cover, pos[size == one] + one, -1)
                    longest[np.cumsum(cover[:n]) > 0] = one
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if state[s]:
                        out.append((k, s, e, bool(state[s] == 2), int(longest[s:e].max())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["k", "start_word", "end_word", "removed", "longest"])

    return run


_WINDOW = "h long, k long, pos int"
_SPAN = "k long, start_word int, end_word int, removed boolean, longest int"


def text_spans(texts: DataFrame, length: int = LENGTH, measure: bool = True) -> DataFrame:
    """Spans (k, start_word, end_word, removed, longest) of the distinct texts of (k, text).

    What is removed is settled by windows of `length`; without `measure` the further levels, which
    only measure, are left out and `longest` is `length`.
    """
    texts = texts.mapInArrow(_fresh_batches(length), "k long, text string")
    with Scratch(texts.sparkSession) as tables:
        anchors = repeated(tables.keep(texts.mapInArrow(_anchor_batches(length), _WINDOW)))
        found = anchors.groupBy("k").agg(F.collect_list("pos").alias("anchors"))
        rows = tables.keep(texts.join(found, "k").mapInArrow(_window_batches(length), _WINDOW))
        alive = base = tables.keep(repeated(rows))
        size = length
        wins = base.select("k", "pos", F.lit(length).alias("words"), (F.col("k") == F.col("low")).alias("low"), "h")
        while measure:
            halves = alive.groupBy("k").agg(F.collect_list(F.struct("pos", "h")).alias("wins"))
            longer = tables.keep(halves.mapInArrow(_double_batches(size), _WINDOW))
            alive = tables.keep(repeated(longer).select("h", "k", "pos"))
            if alive.isEmpty():
                break
            size *= 2
            wins = wins.unionByName(alive.select("k", "pos", F.lit(size).alias("words"), F.lit(False).alias("low"), F.lit(0).cast("long").alias("h")))
        grouped = wins.groupBy("k").agg(F.collect_list(F.struct("pos", "words", "low", "h")).alias("wins"))
        return cut(grouped.mapInArrow(_span_batches(length), _SPAN))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, k, n): words of each document."""
    for batch in batches:
        for part, data, off in chunks(batch, "text"):
            _, _, word_off = words(data, off)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), pa.array(np.diff(word_off).astype(np.int32))], names=["doc_id", "k", "n"])


def passages(docs: DataFrame, length: int = LENGTH, measure: bool = True) -> DataFrame:
    """(doc_id, k, start_word, end_word, removed, longest, copies) of all repeated passages; copies is the
    number of rows of this (doc_id, text).

    Where several documents have one text of at least `length` words, a row spans each of them
    as a whole, removed but for the smallest doc_id; the passages inside are listed for that one.
    """
    d = text_input(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("k", text_key())
    spans = text_spans(d.select("k", "text"), length, measure)
    counted = d.mapInArrow(_count_batches, "doc_id long, k long, n int").where(F.col("n") >= length)
    ids = cut(counted.groupBy("doc_id", "k", "n").agg(F.count("*").alias("copies")))
    # nulls last: a null id is the first only where there is no other
    texts = ids.groupBy("k").agg(F.min("doc_id").alias("first"), F.max_by("copies", F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("-inf")))).alias("first_copies"), F.count("*").alias("docs"))
    whole = join_groups(ids, texts.where("docs > 1").select("k", "first", "docs"), ["k"], "docs", ["doc_id"]).select(
        "doc_id", "k", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), (~F.col("first").eqNullSafe(F.col("doc_id"))).alias("removed"), F.col("n").alias("longest"), "copies"
    )
    inside = texts.join(spans, "k").select(F.col("first").alias("doc_id"), "k", "start_word", "end_word", "removed", "longest", F.col("first_copies").alias("copies"))
    return whole.unionByName(inside)


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, end_word, removed, longest); see the module for all cases."""
    return passages(docs, length).select("doc_id", "start_word", "end_word", "removed", "longest")


def _cut_batches(columns: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch, text):
                texts = part.column(text).to_pylist()
                spans = part.column("_spans")
                if spans.null_count < len(spans):
                    starts, ends, word_off = words(data, off)
                    for i, own in enumerate(spans.to_pylist()):
                        if own:
                            keep = np.ones(len(data[off[i] : off[i + 1]]), bool)
                            for s in own:
                                lo, hi = word_off[i] + s["start_word"], word_off[i] + s["end_word"]
                                keep[starts[lo] - off[i] : (starts[hi] if hi < word_off[i + 1] else off[i + 1]) - off[i]] = False
                            texts[i] = data[off[i] : off[i + 1]][keep].tobytes().decode("utf-8")
                arrays = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([not o for o in spans.to_pylist()])], names=[*columns, "_whole"])

    return run


@any_columns
def remove_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all columns kept, without the removed passages; n_chars, where there is such
    a column, follows the text.  A document of which no word is left goes; rows repeating a
    (doc_id, text) are cut alike."""
    spans = passages(docs, length, measure=False).where("removed").groupBy(F.col("doc_id").alias("_s_id"), F.col("k").alias("_k"))
    spans = spans.agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"), F.max("copies").alias("_copies"))
    # a null id has a key of its own, so that the join is on plain equality
    spans = spans.withColumn("_null", F.col("_s_id").isNull()).withColumn("_id", F.coalesce("_s_id", F.lit(0))).drop("_s_id")
    given = docs["doc_id"].cast("long")
    d = docs.withColumn("_k", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))).withColumn("_null", given.isNull()).withColumn("_id", F.coalesce(given, F.lit(0).cast("long")))
    joined = join_groups(d, spans, ["_k", "_null", "_id"], "_copies", [F.monotonically_increasing_id()], "left")
    joined, text = with_text(joined.select(*docs.columns, "_spans"), [*docs.columns, "_spans"])
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    out = joined.mapInArrow(_cut_batches(docs.columns, text), f"{fields}, _whole boolean")
    out = out.where(F.col("_whole") | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("_whole"), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE: dict[str, str] = {}
