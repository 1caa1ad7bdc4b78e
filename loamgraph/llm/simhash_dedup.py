"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints.  A text's features are its words, lower-cased, without punctuation.  Words of LONG_WORD
   bytes or more have one weight; the weight of shorter ones falls from that by half with every
   HALVING long words of the text, so that they carry a text with few others and never drown many,
   and one changed word changes the weights little.  Two independent 64-bit SimHashes are taken;
   the first is searched, both verify.
2. Partitions.  The correlation of every two fingerprint bits is summed over all distinct
   fingerprints; correlated bits are put in the same partition greedily, since a partition of
   correlated bits is the one to give a small threshold.
3. Thresholds.  If the partitions' thresholds t_i satisfy sum(t_i + 1) >= radius + 1, two
   fingerprints within `radius` agree within t_i bits in some partition i.  The candidate count of
   every (partition, threshold) is estimated from a bounded sample of fingerprint pairs (which
   decides cost, never results), and dynamic programming takes the cheapest allocation;
   t_i = -1 leaves a partition out.
4. Probing.  A value within t bits of another meets it at a value floor(t/2) bits from one and
   ceil(t/2) from the other, so index and probe signatures are enumerated on both sides.
   Rows are partitioned by (partition, signature); within each bucket every pair is verified on
   the full fingerprints.  A bucket emits only a spanning forest of its verified pairs, which keeps
   the output linear while the connected components stay exact, and pairs that the forest connects
   already are dropped block by block.  A bucket of over BUCKET rows is cut into blocks of so many; two
   blocks that meet are a task's work of their own, so that no task holds more than two blocks.
5. Groups.  Connected components by alternating large-star and small-star steps.  Minima are aggregated
   before they are joined back, and keys of very many rows are dealt to several tasks.

Fingerprints that are equal in all 128 bits are one node, so exact copies cost one row.  Null,
empty and wordless texts have no features and are never grouped.  Rows that repeat a
(doc_id, text) are members of one group.  The member with the smallest (doc_id, text key), null
ids last, is kept.  Very long texts are read whole, one at a time; an empty table gives an empty
result; columns besides doc_id and text are ignored, or kept where documents are returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._spark import Scratch, any_columns, cut, documents, join_groups, text_input, text_key
from loamgraph.llm._text import chunks, lower_bytes, mix, text_of, word_hashes, words

#: Differing bits of the searched fingerprint, and of the second, that a near copy may have.
RADIUS = 8
VERIFY_RADIUS = 14
LONG_WORD = 6
HALVING = 4
_WEIGHT = 1 << 16
PARTITIONS = 3
SAMPLE = 2048
#: Rows of a bucket that are compared in one piece.
BUCKET = 1 << 16
#: Pairs verified at once.
PAIR_BLOCK = 1 << 20


def fingerprints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both SimHashes of every text, and whether it has any feature."""
    low = lower_bytes(data)
    starts, ends, word_off = words(low, off, letters=True)
    h = word_hashes(low, starts, ends)
    n = len(off) - 1
    text = text_of(np.arange(len(h)), word_off)
    long = (ends - starts) >= LONG_WORD
    count, many = np.bincount(text, minlength=n), np.bincount(text[long], minlength=n)
    short = np.maximum(np.rint(_WEIGHT * np.exp2(-many / HALVING)).astype(np.int64), 1)
    weight = _WEIGHT * many + short * (count - many)
    out = []
    for values in (h, mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A))):
        ones = np.zeros((n, 64), np.int64)
        for pick, times in ((long, np.full(n, _WEIGHT)), (~long, short)):
            t = text[pick]
            if len(t):
                bits = np.unpackbits(values[pick].view(np.uint8).reshape(-1, 8), axis=1)
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                ones[t[first]] += times[t[first], None] * np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * ones > weight[:, None], axis=1).view(np.uint64).ravel())
    return out[0], out[1], count > 0


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in chunks(batch, "text"):
            a, b, some = fingerprints(data, off)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("k"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                names=["doc_id", "k", "a", "b"],
            ).filter(pa.array(some))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k, a, b) of every document that has a feature."""
    d = text_input(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("k", text_key())
    return d.mapInArrow(_fingerprint_batches, "doc_id long, k long, a long, b long")


def bits_of(values: np.ndarray) -> np.ndarray:
    """(n, 64) zeros and ones; column j is bit j."""
    return np.unpackbits(values.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((65, 65))
    for batch in batches:
        x = np.ones((batch.num_rows, 65), np.float32)
        x[:, :64] = bits_of(batch.column("a").to_numpy(zero_copy_only=False).view(np.uint64))
        for at in range(0, len(x), 1 << 16):
            total += x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]
    at = np.flatnonzero(total.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], names=["cell", "n"])


def correlations(nodes: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the searched bits over all nodes."""
    summed = nodes.select("a").mapInArrow(_gram_batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    g = np.zeros(65 * 65)
    for r in summed:
        g[r["cell"]] = r["n"]
    g = g.reshape(65, 65)
    n = max(g[64, 64], 1)
    mean = g[64, :64] / n
    cov = g[:64, :64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def partition_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """All 64 bits in `parts` groups of nearly equal size; each group starts from the bit most
    correlated with the rest and takes the bits most correlated with it in turn."""
    left = set(range(64))
    groups = []
    for i in range(parts):
        width = 64 // parts + (i < 64 % parts)
        group = [max(sorted(left), key=lambda b: sum(corr[b, c] for c in left if c != b))]
        left.discard(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda b: sum(corr[b, c] for c in group))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    return sum(len(list(itertools.combinations(range(width), r))) for r in range(radius + 1))


def allocate(cost: np.ndarray, radius: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 and the least sum of cost[i, t_i + 1],
    by dynamic programming over the partitions."""
    parts, options = cost.shape
    best = np.full((parts + 1, radius + 2), np.inf)
    take = np.zeros((parts + 1, radius + 2), int)
    best[0, 0] = 0
    for i in range(parts):
        for have in range(radius + 2):
            for t in range(min(options, have + 1)):
                c = best[i, have - t] + cost[i, t]
                if c < best[i + 1, have]:
                    best[i + 1, have], take[i + 1, have] = c, t
    if not np.isfinite(best[parts, radius + 1]):
        raise ValueError("no allocation of thresholds reaches the radius")
    out, have = [], radius + 1
    for i in range(parts, 0, -1):
        out.append(int(take[i, have]) - 1)
        have -= take[i, have]
    return out[::-1]


def plan(corr: np.ndarray, sample: np.ndarray, n: int, radius: int, parts: int, most: int = 4) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds: costs are signatures to shuffle plus estimated pairs to verify."""
    groups = partition_bits(corr, parts)
    x = bits_of(sample).astype(np.float32)
    cost = np.full((parts, most + 2), np.inf)
    for i, group in enumerate(groups):
        y = x[:, group]
        ones = y.sum(1)
        d = np.rint(ones[:, None] + ones[None, :] - 2 * (y @ y.T)).astype(int)
        hist = np.bincount(d[np.triu_indices(len(y), 1)], minlength=len(group) + 1) if len(y) > 1 else np.zeros(len(group) + 1)
        # a uniform floor keeps an estimate of zero out of a small sample from looking free
        share = hist / max(hist.sum(), 1)
        cost[i, 0] = 0
        for t in range(most + 1):
            near = max(share[: t + 1].sum(), ball(len(group), t) / 2.0 ** len(group))
            rows = ball(len(group), t // 2) + (ball(len(group), t - t // 2) if t % 2 else 0)
            cost[i, t + 1] = 30.0 * n * rows + 0.5 * n * n * near * (2 if t else 1)
    return groups, allocate(cost, radius)


def partition_value(fp: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(group):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)], dtype=np.uint64)


def _signature_batches(groups: list[list[int]], limits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a = part.column("a").to_numpy(zero_copy_only=False).view(np.uint64)
                b = part.column("b").to_numpy(zero_copy_only=False)
                for i, (group, t) in enumerate(zip(groups, limits, strict=True)):
                    if t < 0:
                        continue
                    value = partition_value(a, group)
                    # role 0: index and probe alike (t even); 1: index, 2: probe
                    sides = [(0, t // 2)] if t % 2 == 0 else [(1, t // 2), (2, t // 2 + 1)]
                    for role, radius in sides:
                        masks = _masks(len(group), radius)
                        key = (value[:, None] ^ masks[None, :]).ravel() | np.uint64(i << 56)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(key.view(np.int64)),
                                pa.array(np.repeat(a, len(masks)).view(np.int64)),
                                pa.array(np.repeat(b, len(masks))),
                                pa.array(np.full(len(key), role, np.int8)),
                            ],
                            names=["key", "a", "b", "role"],
                        )

    return run


def _pairs(size: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs within each group of consecutive rows, in blocks of bounded size."""
    rows = np.repeat(first + size, size) - np.arange(int(size.sum())) - 1 - (first[0] if len(first) else 0)
    base = first[0] if len(first) else 0
    done = np.concatenate([[0], np.cumsum(rows)])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIR_BLOCK, side="right")) - 1)
        n = rows[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(done[at:to] - done[at], n)
        yield left + base, right + base
        at = to


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Spanning forest of pairs that come in blocks; holds a label for each row and the kept pairs alone."""

    def __init__(self, rows: int):
        self.label = np.arange(rows)
        self.pairs: list[np.ndarray] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        x, y = self.label[left], self.label[right]
        new = np.flatnonzero(x != y)
        if not len(new):
            return
        x, y = np.minimum(x[new], y[new]), np.maximum(x[new], y[new])
        _, first = np.unique(x * len(self.label) + y, return_index=True)
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            root = v
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(v, v)) != root:
                parent[v], v = root, up
            return root

        keep = []
        for i, a, b in zip(first.tolist(), x[first].tolist(), y[first].tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
                keep.append(i)
        self.pairs.append(np.stack([left[new[keep]], right[new[keep]]]))
        moved = np.arange(len(self.label))
        for v in parent:
            moved[v] = find(v)
        self.label = moved[self.label]


def _edge_batch(a: np.ndarray, b: np.ndarray, forest: Forest) -> pa.RecordBatch | None:
    if not forest.pairs:
        return None
    left, right = np.concatenate(forest.pairs, axis=1)
    cols = [a[left], b[left], a[right], b[right]]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], names=["a", "b", "a2", "b2"])


def _verified(a, b, role, left, right, radius: int, verify: int) -> tuple[np.ndarray, np.ndarray]:
    ok = (popcount(a[left] ^ a[right]) <= radius) & ((role[left] != role[right]) | (role[left] == 0))
    left, right = left[ok], right[ok]
    ok = (popcount(b[left] ^ b[right]) <= verify) & ((a[left] != a[right]) | (b[left] != b[right]))
    return left[ok], right[ok]


_EDGE = "a long, b long, a2 long, b2 long"
#: Edges, and rows (key, block, a, b, role) of buckets that are too large for one piece.
_FOUND = _EDGE + ", key long, block int, role byte"


def _bucket_batches(radius: int, verify: int, bucket: int):
    """Edges between fingerprints of one bucket; rows arrive sorted by key.  Of a bucket of over `bucket` rows
    the pairs within each block are settled here, and its rows go on with the number of their block."""

    def edges(key: np.ndarray, a: np.ndarray, b: np.ndarray, role: np.ndarray) -> pa.RecordBatch | None:
        change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([change, [len(key)]]))
        many = size > 1
        if not many.any():
            return None
        index = np.repeat(many, size)
        a, b, role = a[index], b[index], role[index]
        size = size[many]
        forest = Forest(len(a))
        for left, right in _pairs(size, np.cumsum(size) - size):
            forest.add(*_verified(a, b, role, left, right, radius, verify))
        found = _edge_batch(a, b, forest)
        if found is None:
            return None
        none = [pa.nulls(found.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int8())]
        return pa.RecordBatch.from_arrays([*found.columns, *none], names=["a", "b", "a2", "b2", "key", "block", "role"])

    def onward(key: int, block: int, a: np.ndarray, b: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        cols = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none, pa.array(np.full(len(a), key)), pa.array(np.full(len(a), block, np.int32)), pa.array(role)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "a2", "b2", "key", "block", "role"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held, large, block = 0, None, 0

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            get = lambda c: table.column(c).to_numpy()
            cols = get("key"), get("a").view(np.uint64), get("b").view(np.uint64), get("role")
            if (out := edges(*cols)) is not None:
                yield out

        def piece(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """One block of the large bucket."""
            nonlocal block
            yield from settle(table)
            get = lambda c: table.column(c).to_numpy()
            yield onward(large, block, get("a").view(np.uint64), get("b").view(np.uint64), get("role"))
            block += 1

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            """All whole buckets and whole blocks of what is held; the rest stays."""
            nonlocal rest, held, large, block
            table = pa.Table.from_batches(rest)
            while table.num_rows:
                key = table.column("key").to_numpy()
                if large is not None and key[0] != large:
                    large, block = None, 0
                if large is None:
                    open_ = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
                    if last and table.num_rows - open_ <= bucket:
                        open_ = table.num_rows
                    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    size = np.diff(np.concatenate([start, [len(key)]]))
                    over = np.flatnonzero(size > bucket)
                    end = min(open_, int(start[over[0]]) if len(over) else open_)
                    if end:
                        yield from settle(table.slice(0, end))
                        table = table.slice(end)
                        continue
                    if table.num_rows <= bucket:
                        break
                    large = int(key[0])
                    continue
                end = int(np.searchsorted(key, large, side="right"))
                if end == table.num_rows and end < bucket and not last:
                    break
                yield from piece(table.slice(0, min(end, bucket)))
                table = table.slice(min(end, bucket))
            rest = table.combine_chunks().to_batches()
            held = table.num_rows

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            held += batch.num_rows
            if held > 100_000 + bucket:
                yield from work(False)
        if rest:
            yield from work(True)

    return run


def _meeting_batches(radius: int, verify: int):
    """Edges between two blocks of one bucket; rows arrive sorted by (key, x, y, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            get = lambda c: table.column(c).to_numpy()
            meets, block = np.stack([get("key"), get("x"), get("y")]), get("block")
            a, b, role = get("a").view(np.uint64), get("b").view(np.uint64), get("role")
            start = np.flatnonzero(np.concatenate([[True], (meets[:, 1:] != meets[:, :-1]).any(0)]))
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(block)], strict=True):
                mid = lo + int(np.searchsorted(block[lo:hi], meets[2, lo]))
                forest = Forest(hi - lo)
                step = max(PAIR_BLOCK // max(hi - mid, 1), 1)
                for at in range(lo, mid, step):
                    left = np.repeat(np.arange(at, min(at + step, mid)), hi - mid)
                    right = np.tile(np.arange(mid, hi), min(at + step, mid) - at)
                    left, right = _verified(a, b, role, left, right, radius, verify)
                    forest.add(left - lo, right - lo)
                if (out := _edge_batch(a[lo:hi], b[lo:hi], forest)) is not None:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            last = [batch.column(c)[-1] for c in ("key", "x", "y")]
            if [rest[0].column(c)[0] for c in ("key", "x", "y")] == last:
                continue
            table = pa.Table.from_batches(rest)
            same = np.logical_and.reduce([table.column(c).to_numpy() == v.as_py() for c, v in zip(("key", "x", "y"), last, strict=True)])
            end = int(np.argmax(same))  # the last meeting may go on in the next batch
            yield from settle(table.slice(0, end))
            rest = table.slice(end).to_batches()
        if rest:
            yield from settle(pa.Table.from_batches(rest))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges (u, v): root is the smallest vertex of its component.

    Alternating large-star and small-star steps until the labels no longer change; each step
    is checkpointed, so its plan stays short and a lost executor costs one step.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def total(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def lowest(x: DataFrame) -> DataFrame:
        """Each (u, v) with the smallest v of u; x is checkpointed or a few steps from it."""
        low = x.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return join_groups(x, low, ["u"], "n", ["v"])

    before = total(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).withColumn("m", F.least("u", "m"))
        large = cut(low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = lowest(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = total(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(roots)


def near_edges(nodes: DataFrame, tables: Scratch, radius: int, verify: int, parts: int, bucket: int = BUCKET) -> DataFrame:
    """Edges that connect exactly the components of all pairs of nodes (a, b) within both radii."""
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("a", "b")).limit(SAMPLE).select("a").toPandas()["a"].to_numpy(np.int64).view(np.uint64)
    groups, limits = plan(correlations(nodes), sample, n, radius, parts)
    rows = nodes.mapInArrow(_signature_batches(groups, limits), "key long, a long, b long, role byte")
    count = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = tables.keep(rows.repartition(count, "key").sortWithinPartitions("key").mapInArrow(_bucket_batches(radius, verify, bucket), _FOUND))
    edges = found.where("key is null").select("a", "b", "a2", "b2")
    onward = found.where("key is not null").select("key", "block", "a", "b", "role")
    if onward.isEmpty():
        return edges
    # a block meets every other of its bucket once, as the earlier (x) or the later (y) of the two
    last = onward.groupBy("key").agg(F.max("block").alias("last"), F.count("*").alias("n"))
    every = join_groups(onward, last, ["key"], "n", ["a", "b"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).where("other <> block")
    meeting = every.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "a", "b", "role")
    meeting = meeting.repartition(count, "key", "x", "y").sortWithinPartitions("key", "x", "y", "block")
    return edges.unionByName(meeting.mapInArrow(_meeting_batches(radius, verify), _EDGE))


def groups(docs: DataFrame, radius: int = RADIUS, verify: int = VERIFY_RADIUS, parts: int = PARTITIONS) -> DataFrame:
    """(doc_id, k, group_id, keep, group_size, copies): one row for each distinct (doc_id, text) in a
    group of at least two rows; group_id is the kept member's doc_id and copies the number of
    rows that repeat this (doc_id, text)."""
    node = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    rows = cut(with_fingerprints(docs).groupBy("doc_id", "k", "a", "b").agg(F.count("*").alias("copies")))
    with Scratch(docs.sparkSession) as tables:
        nodes = tables.keep(rows.groupBy("a", "b").agg(F.count("*").alias("n")))
        edges = near_edges(nodes.select("a", "b"), tables, radius, verify, parts)
        label = components(edges.select(node("a", "b").alias("u"), node("a2", "b2").alias("v")))
        label = nodes.join(label.select("v.a", "v.b", "root"), ["a", "b"], "left").select("a", "b", "n", F.coalesce("root", node("a", "b")).alias("root"))
        member = cut(join_groups(rows, label, ["a", "b"], "n", ["doc_id", "k"]).select("doc_id", "k", "copies", F.col("root.a").alias("ra"), F.col("root.b").alias("rb")))
    # the smallest id, nulls last, and of equal ids the smallest key
    size = member.groupBy("ra", "rb").agg(F.min("doc_id").alias("group_id"), F.sum("copies").alias("group_size"), F.count("*").alias("n")).where("group_size > 1")
    member = join_groups(member, size, ["ra", "rb"], "n", ["doc_id", "k"])
    least = member.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("ra", "rb").agg(F.min("k").alias("first_k"), F.max("group_size").alias("n"))
    out = join_groups(member, least, ["ra", "rb"], "n", ["doc_id", "k"])
    return out.select("doc_id", "k", "group_id", (F.col("group_id").eqNullSafe(F.col("doc_id")) & (F.col("first_k") == F.col("k"))).alias("keep"), "group_size", "copies")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, verify: int = VERIFY_RADIUS, parts: int = PARTITIONS) -> DataFrame:
    """(doc_id, group_id, keep, group_size) of every document with a near or exact copy.

    Nulls in doc_id, empty texts, ties and repeated rows are treated as the module says; an
    empty table gives an empty result; columns besides doc_id and text are ignored.
    """
    return groups(docs, radius, verify, parts).select("doc_id", "group_id", "keep", "group_size")


@any_columns
def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, verify: int = VERIFY_RADIUS, parts: int = PARTITIONS) -> DataFrame:
    """The documents, all columns kept, with one row of each group."""
    g = groups(docs, radius, verify, parts).select("keep", "copies", "doc_id", F.col("k").alias("_k"))
    # a null id has a key of its own, so that the join is on plain equality
    g = cut(g.select("_k", F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("keep").alias("_keep"), F.col("copies").alias("_copies")))
    given = docs["doc_id"].cast("long")
    d = docs.withColumn("_k", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))).withColumn("_null", given.isNull()).withColumn("_id", F.coalesce(given, F.lit(0).cast("long")))
    keys, spread = ["_k", "_null", "_id"], [F.monotonically_increasing_id()]
    # rows of no group, and kept ones that occur once; then one row of each kept one that occurs again
    first = join_groups(d, g.select(*keys, "_copies", (F.col("_keep") & (F.col("_copies") == 1)).alias("_stays")), keys, "_copies", spread, "left")
    again = g.where(F.col("_keep") & (F.col("_copies") > 1)).select(*keys, "_copies")
    every = F.struct(*docs.columns)
    order = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t])
    again = join_groups(d, again, keys, "_copies", spread).groupBy(*keys).agg(F.min_by(every, order).alias("_row"))
    return first.where(F.coalesce("_stays", F.lit(True))).select(*docs.columns).unionByName(again.select("_row.*"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLE: dict[str, str] = {}
