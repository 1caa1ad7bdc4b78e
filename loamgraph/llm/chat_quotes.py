"""Conversations in reply order, without quotes, by quotation linking.

1. Parsing.  A line's quote level is the number of ">" at its start, white space among them ignored.  A
   passage is a run of lines of one level above 0; lines of level 0 are a message's own.  A line of
   level n right before a passage of level n + 1 that names who wrote it ("... wrote:", "a écrit :",
   "schrieb ...:", "escribió:") belongs to the quote and goes.
2. Normalising.  Lower case, white space as one blank, quote marks off: a sequence of words.  Units of a
   message's own text are the whole of it, each paragraph and each line; each is hashed, as is each passage.
   A passage of at least SHORTEST words may also be any run of words in its original (some of its
   lines or paragraphs, cut at either end, wrapped anew): 5-word anchors are winnowed on both sides, an
   anchor of the passage names where in a message the passage would lie, and the run of words there is
   hashed as a further unit.
3. Linking.  A passage's original is the first message (by turn) of its conversation with an equal
   unit, an earlier one than the quoting message; failing that, the first message of another
   conversation with one (the smallest conv_id and turn).  Only the first message of each unit,
   once in each conversation and once over all, enters the joins, so units that many messages
   share cost one row each.
4. Order.  A message replies to the original of its first linked passage of level 1 in the same
   conversation, else to the message before it; the conversation is the tree of replies in
   depth-first order, earlier turns first.

A null or empty text is a message without lines.  Rows that repeat, and other rows with the same
conv_id and turn, are messages of their own, ordered by role and text; null turns come last.  A row with a
null conv_id is a conversation of its own, so that such rows never come together in one task.  Passages
without words are dropped but link to nothing.  Very long messages are read whole.  An
empty table gives an empty result; columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.llm._spark import cut, join_groups, named
from loamgraph.llm._text import segment_hash, string_bytes, window_hashes, winnow, word_hashes, words

#: Words of an anchor, neighbouring anchors of which one is taken, and words of a passage that has one for sure.
ANCHOR, WINDOW = 5, 8
SHORTEST = ANCHOR + WINDOW - 1

_MARKS = re.compile(r"[ \t]*>[> \t]*")
_SPACE = re.compile(r"\s+")
_WROTE = re.compile(r"(?:\bwrote|a écrit|\bescribió)\s?:\s*\Z|\bschrieb\b.*:\s*\Z", re.I)
_PARSED = "own string, units array<long>, anchors array<struct<h:long,pos:int>>, passages array<struct<level:int,h:long,size:int,anchor:long,pos:int>>"
_MESSAGE = "turn:bigint,role:string,reply_to:bigint,text:string"


def normalise(text: str) -> str:
    return _SPACE.sub(" ", text).strip().lower()


def level_of(line: str) -> tuple[int, str]:
    """Quote level of a line and the line without its marks."""
    m = _MARKS.match(line)
    return (line.count(">", 0, m.end()), line[m.end() :]) if m else (0, line)


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """Own text, its lines, and the passages with words in order as (level, normalised text)."""
    if not text:
        return "", [], []
    lines = [level_of(x) for x in text.split("\n")] if ">" in text else [(0, x) for x in text.split("\n")]
    quoted = any(level for level, _ in lines)
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for i, (level, line) in enumerate(lines):
        ahead = next((n for n, x in lines[i + 1 : i + 3] if n or x.strip()), 0) if quoted else 0
        if ahead == level + 1 and _WROTE.search(line):
            continue
        if not level:
            own.append(line)
        elif level == before:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        before = level
    body = "\n".join(own)
    if quoted:
        body = re.sub(r"\n{3,}", "\n\n", body).strip("\n")
    found = [(level, normalise("\n".join(x))) for level, x in passages]
    return body, body.split("\n"), [(n, u) for n, u in found if u]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of normalised texts, and the n+1 offsets into them by text."""
    data, off = string_bytes(pa.array(texts, pa.string()))
    starts, ends, word_off = words(data, off)
    return word_hashes(data, starts, ends), word_off


def anchors(h: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in the text of every winnowed anchor."""
    a, at, text = window_hashes(h, word_off, ANCHOR)
    take = np.flatnonzero(winnow(a, text, WINDOW))
    return a[take].view(np.int64), text[take], (at[take] - word_off[text[take]]).astype(np.int32)


def _lists(values: pa.Array, text: np.ndarray, n: int) -> pa.Array:
    """One list for each of n texts of the values that belong to it, in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), values)


def parse_all(texts: list[str | None]) -> list[pa.Array]:
    """The columns of _PARSED of many messages."""
    parsed = [parse(t) for t in texts]
    n = len(parsed)
    # units are runs of words of the own text, which is hashed once
    h, off = hashed([normalise(body) for body, _, _ in parsed])
    first, last, of = [], [], []
    for i, (body, lines, _) in enumerate(parsed):
        at = int(off[i])
        if off[i + 1] == at:
            continue
        cuts = {(at, int(off[i + 1]))}
        begin = at  # of the paragraph
        for line in lines:
            size = len(line.split())
            if size:
                cuts.add((at, at + size))
            elif at > begin:
                cuts.add((begin, at))
            at += size
            begin = begin if size else at
        cuts.add((begin, at))
        for a, z in cuts:
            if z > a:
                first.append(a)
                last.append(z)
                of.append(i)
    first, last, of = (np.array(x, np.int64) for x in (first, last, of))
    unit = segment_hash(h, first, last).view(np.int64)
    distinct = np.unique(np.stack([of, unit]), axis=1) if len(of) else np.zeros((2, 0), np.int64)
    a, at_text, pos = anchors(h, off)
    quotes = [(i, level, text) for i, p in enumerate(parsed) for level, text in p[2]]
    q, q_off = hashed([text for _, _, text in quotes])
    size = np.diff(q_off)
    whole = segment_hash(q, q_off[:-1], q_off[1:]).view(np.int64)
    qa, q_text, q_pos = anchors(q, q_off)
    at = np.searchsorted(q_text, np.arange(len(quotes)))
    has = np.zeros(len(quotes), bool)
    inside = at < len(q_text)
    has[inside] = q_text[at[inside]] == np.flatnonzero(inside)
    pick = at[has]
    anchor, place = np.zeros(len(quotes), np.int64), np.zeros(len(quotes), np.int32)
    anchor[has], place[has] = qa[pick], q_pos[pick]
    passages = pa.StructArray.from_arrays(
        [pa.array(np.array([x[1] for x in quotes], np.int32)), pa.array(whole), pa.array(size.astype(np.int32)), pa.array(anchor, mask=~has), pa.array(place, mask=~has)], names=["level", "h", "size", "anchor", "pos"]
    )
    return [
        pa.array([body for body, _, _ in parsed], pa.string()),
        _lists(pa.array(distinct[1]), distinct[0], n),
        _lists(pa.StructArray.from_arrays([pa.array(a), pa.array(pos)], names=["h", "pos"]), at_text, n),
        _lists(passages, np.array([x[0] for x in quotes], np.int64), n),
    ]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            cols = [part.column(c) for c in ("conv_id", "lone", "turn", "role", "seq")]
            yield pa.RecordBatch.from_arrays([*cols, *parse_all(part.column("text").to_pylist())], names=["conv_id", "lone", "turn", "role", "seq", "own", "units", "anchors", "passages"])


def messages(chats: DataFrame) -> DataFrame:
    """(conv_id, lone, turn, role, text, seq): seq numbers the messages of a conversation; lone numbers the rows
    without a conv_id, from 1 on, and is 0 elsewhere."""
    chats = named(chats, "conv_id", "turn", "role", "text")
    d = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    same = W.partitionBy(F.coalesce("conv_id", F.lit(0)), "lone").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    return d.withColumn("seq", F.row_number().over(same))


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, lone, seq, turn, h): the hashed runs of words that a passage may quote."""
    for batch in batches:
        h, off = hashed([normalise(x) for x in batch.column("own").to_pylist()])
        runs = batch.column("runs")
        row = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
        flat = runs.flatten()
        start = flat.field("start").to_numpy().astype(np.int64) + off[row]
        end = start + flat.field("size").to_numpy()
        ok = (start >= off[row]) & (end <= off[row + 1])
        row, unit = row[ok], segment_hash(h, start[ok], end[ok]).view(np.int64)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in ("conv_id", "lone", "seq", "turn")], pa.array(unit)], names=["conv_id", "lone", "seq", "turn", "h"])


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, lone, seq, at, level, to_conv, to_lone, to_seq, to_turn) of every passage that has an original."""
    keys = ["conv_id", "lone", "seq"]
    quoted = parsed.select(*keys, F.posexplode("passages").alias("at", "p")).select(*keys, "at", "p.*")
    if quoted.isEmpty():  # nothing is joined where nothing is quoted
        return quoted.select(*keys, "at", "level", *[F.lit(None).cast(t).alias(c) for c, t in (("to_conv", "long"), ("to_lone", "long"), ("to_seq", "int"), ("to_turn", "long"))])
    # how a passage would lie around its anchor, once for all that lie alike
    shape = quoted.where("anchor is not null").select(F.col("anchor").alias("a"), "pos", "size").distinct()
    lie = shape.groupBy("a").agg(F.collect_set(F.struct("pos", "size")).alias("lies"), F.lit(1).alias("one"))
    seen = parsed.select(*keys, F.explode("anchors").alias("x")).select(*keys, F.col("x.h").alias("a"), F.col("x.pos").alias("place"))
    runs = seen.join(lie.drop("one"), "a").select(*keys, "place", F.explode("lies").alias("lie"))
    runs = runs.select(*keys, (F.col("place") - F.col("lie.pos")).alias("start"), F.col("lie.size").alias("size")).where("start >= 0").groupBy(*keys).agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    body = parsed.select("conv_id", "lone", "seq", "turn", "own").alias("p")
    r = runs.alias("r")
    same = F.col("p.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("p.lone") == F.col("r.lone")) & (F.col("p.seq") == F.col("r.seq"))
    runs = body.join(r, same).select("p.*", "runs").mapInArrow(_run_batches, "conv_id long, lone long, seq int, turn long, h long")
    units = parsed.select(*keys, "turn", F.explode("units").alias("h")).unionByName(runs)
    # only units that some passage quotes matter
    units = units.join(quoted.select("h").distinct(), "h", "left_semi")
    here = units.groupBy("conv_id", "lone", "h").agg(F.min(F.struct("seq", "turn")).alias("here"))
    whose = F.struct(F.col("conv_id").isNull().alias("null_id"), "conv_id", "lone", F.col("here.seq").alias("seq"), F.col("here.turn").alias("turn"))
    # the two smallest conversations, so that one of them is not the quoting message's own
    low = here.groupBy("h").agg(F.min(whose).alias("one"))
    # of all conversations but the smallest the smallest
    second = here.join(low, "h").where(~(F.col("conv_id").eqNullSafe(F.col("one.conv_id")) & (F.col("lone") == F.col("one.lone")))).groupBy("h").agg(F.min(whose).alias("two"))
    there = low.join(second, "h", "left").join(quoted.groupBy("h").agg(F.count("*").alias("n")), "h")
    q, h = quoted.alias("q"), here.alias("h")
    out = q.join(h, (F.col("q.h") == F.col("h.h")) & F.col("q.conv_id").eqNullSafe(F.col("h.conv_id")) & (F.col("q.lone") == F.col("h.lone")), "left").select("q.*", "here")
    out = join_groups(out, there, ["h"], "n", ["conv_id", "lone", "seq"])
    mine = lambda x: F.col(f"{x}.conv_id").eqNullSafe(F.col("conv_id")) & (F.col(f"{x}.lone") == F.col("lone"))
    to = lambda c, l, s: F.struct(F.col(c).alias("conv_id"), F.col(l).alias("lone"), F.col(f"{s}.seq").alias("seq"), F.col(f"{s}.turn").alias("turn"))  # noqa: E731, E741
    own = F.when(F.col("here.seq") < F.col("seq"), to("conv_id", "lone", "here"))
    other = F.when(~mine("one"), to("one.conv_id", "one.lone", "one")).when(F.col("two").isNotNull(), to("two.conv_id", "two.lone", "two"))
    out = out.withColumn("to", F.coalesce(own, other)).where("to is not null")
    return out.select(*keys, "at", "level", F.col("to.conv_id").alias("to_conv"), F.col("to.lone").alias("to_lone"), F.col("to.seq").alias("to_seq"), F.col("to.turn").alias("to_turn"))


def reply_order(parents: list[int]) -> list[int]:
    """Depth-first order of messages 0 .. n-1, of which message i replies to parents[i] < i (-1: none)."""
    below: list[list[int]] = [[] for _ in parents]
    roots = []
    for i, p in enumerate(parents):
        (below[p] if p >= 0 else roots).append(i)
    out, stack = [], roots[::-1]
    while stack:
        i = stack.pop()
        out.append(i)
        stack.extend(reversed(below[i]))
    return out


def _order_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        orders = []
        for seqs, tos in zip(batch.column("seqs").to_pylist(), batch.column("tos").to_pylist(), strict=True):
            place = {s: i for i, s in enumerate(seqs)}
            orders.append(reply_order([place[t] if t else i - 1 for i, t in enumerate(tos)]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("m"), batch.column("linked"), pa.array(orders, pa.list_(pa.int32()))], names=["conv_id", "m", "linked", "ord"])


def conversations(chats: DataFrame) -> DataFrame:
    """(conv_id, messages, n_messages, n_quotes, n_linked, linked_elsewhere): messages in reply order with
    the turn each replies to; see the module for all cases."""
    parsed = cut(messages(chats).mapInArrow(_parse_batches, "conv_id long, lone long, turn long, role string, seq int, " + _PARSED))
    link = links(parsed)
    here = F.col("conv_id").eqNullSafe(F.col("to_conv")) & (F.col("lone") == F.col("to_lone"))
    per = link.groupBy("conv_id", "lone", "seq").agg(
        F.min(F.when(here & (F.col("level") == 1), F.struct("at", "to_seq", "to_turn"))).alias("to"), F.count("*").alias("linked"), F.count_if(~here).alias("elsewhere")
    )
    p, k = parsed.select("conv_id", "lone", "turn", "role", "seq", "own", F.size("passages").alias("quotes")).alias("p"), per.alias("k")
    rows = p.join(k, F.col("p.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("p.lone") == F.col("k.lone")) & (F.col("p.seq") == F.col("k.seq")), "left")
    rows = rows.select("p.*", F.col("k.to.to_seq").alias("to_seq"), F.col("k.to.to_turn").alias("to_turn"), F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("elsewhere", F.lit(0)).alias("elsewhere"))
    same = [F.coalesce("conv_id", F.lit(0)), F.col("lone")]
    before = F.lag("turn").over(W.partitionBy(*same).orderBy("seq"))
    rows = rows.withColumn("reply_to", F.when(F.col("to_seq").isNotNull(), F.col("to_turn")).otherwise(before))
    grouped = rows.groupBy("conv_id", "lone").agg(
        F.sort_array(F.collect_list(F.struct("seq", "turn", "role", "reply_to", F.col("own").alias("text"), "to_seq"))).alias("x"),
        F.struct(F.sum("quotes").alias("quotes"), F.sum("linked").alias("linked"), F.sum("elsewhere").alias("elsewhere")).alias("linked"),
    )
    message = F.transform("x", lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["reply_to"].alias("reply_to"), m["text"].alias("text")))
    # where nothing is quoted the order is that of the turns, and no Python is run
    plain = grouped.where("linked.linked = 0").select("conv_id", message.alias("m"), "linked")
    tree = grouped.where("linked.linked > 0").select("conv_id", message.alias("m"), "linked", F.col("x.seq").alias("seqs"), F.col("x.to_seq").alias("tos"))
    tree = tree.mapInArrow(_order_batches, f"conv_id long, m array<struct<{_MESSAGE}>>, linked struct<quotes:long,linked:long,elsewhere:long>, ord array<int>")
    tree = tree.select("conv_id", F.transform("ord", lambda i: F.element_at("m", i + 1)).alias("m"), "linked")
    out = plain.unionByName(tree)
    return out.select(
        "conv_id",
        F.col("m").alias("messages"),
        F.size("m").alias("n_messages"),
        F.col("linked.quotes").alias("n_quotes"),
        F.col("linked.linked").alias("n_linked"),
        F.col("linked.elsewhere").alias("linked_elsewhere"),
    )


def op6_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op6_chat_quotes": op6_chat_quotes}
ORACLE: dict[str, str] = {}
