"""Vector search: exact top-k, filters, clusters, hyperplane hashes, several indexes, product codes.

An index is a table (row id, cell), built once and joined on its cell: a query reads the cells that it
probes and no others.  Every order ends in the id, so that ties have one result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loamgraph.functions import vectors as V


def acl_filter(acl: Column, allowed: Sequence[str]) -> Column:
    """Any of `allowed`; a row without any entry is out."""
    return F.coalesce(F.arrays_overlap(acl, F.array(*[F.lit(a) for a in allowed])), F.lit(False))


def metadata_filter(metadata: Column, wanted: dict[str, str]) -> Column:
    """All equal; a missing key counts as the empty string."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit("")) == v)
    return out


def metadata_exists(metadata: Column, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.coalesce(F.map_contains_key(metadata, k), F.lit(False))
    return out


def top_k(
    rows: DataFrame, query: Sequence[float], k: int, *, metric: str = "cosine", threshold: float | None = 0.0, id_col: str = "id", vector_col: str = "vector", where: Column | None = None, filter_mode: str = "post"
) -> DataFrame:
    """The k best rows with their `score`, all for k <= 0; `where` filters them after the cut ("post") or
    before ("pre")."""
    if where is not None and filter_mode == "pre":
        rows = rows.where(where)
    scored = rows.withColumn("score", V.score(F.col(vector_col), V.literal(query), metric))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    best = scored.orderBy(F.desc("score"), id_col)
    best = best.limit(k) if k > 0 else best
    return best.where(where) if where is not None and filter_mode == "post" else best


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) by cosine for every query at once; rows are (id, vector), queries
    (query_id, query).

    Blocks of rows meet blocks of queries in Arrow batches as one product of normalised matrices, and only the k
    best of each meeting are ranked over all blocks.
    """
    some = F.array(F.lit(0))
    return _best_of(rows.withColumn("keys", some), queries.withColumn("keys", some), k, lambda a, b: np.ones((len(a), len(b)), bool), False)


def fetch(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the given ids; missing ones are dropped."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_semi")


#: Rows from which centroids are chosen.  The bound decides cost; every row is put in a cluster.
SEED_ROWS = 4096


def centroids(rows: DataFrame, clusters: int = 10, id_col: str = "id", vector_col: str = "vector", seed: int = 42) -> np.ndarray:
    """Spread-out rows as cluster centres: each next one is drawn in proportion to its distance."""
    sample = rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(SEED_ROWS).select(vector_col).collect()
    x = np.array([r[0] for r in sample], float)
    if not len(x):
        return x
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    far = np.linalg.norm(x - x[picked[0]], axis=1)
    while len(picked) < min(clusters, len(x)) and far.sum() > 0:
        picked.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, np.linalg.norm(x - x[picked[-1]], axis=1))
    return x[picked]


def nearest_centroid(vector: Column, centres: np.ndarray) -> Column:
    d = F.array(*[F.struct(V.euclidean(vector, V.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(d)["i"]


def ivf_index(rows: DataFrame, centres: np.ndarray, vector_col: str = "vector") -> DataFrame:
    return rows.withColumn("cell", nearest_centroid(F.col(vector_col), centres) if len(centres) else F.lit(0))


#: Share of the true k best that an index has to find, measured when it is searched without a setting of its own.
RECALL = 0.95


def _sampled(rows: DataFrame, k: int, id_col: str, vector_col: str, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Up to SEED_ROWS vectors, and for each of them the places of its k best by cosine among these."""
    sample = rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(SEED_ROWS).select(vector_col).collect()
    x = np.array([r[0] for r in sample], float)
    if not len(x):
        return x, np.zeros((0, 0), int)
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    return x, np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :k]


def _least(needed: np.ndarray, most: int, recall: float) -> int:
    """The smallest setting that reaches the recall; `needed` is the setting at which each true neighbour is found."""
    return next((n for n in range(most) if (needed <= n).mean() >= recall), most) if needed.size else most


def ivf_probes(rows: DataFrame, centres: np.ndarray, k: int, recall: float = RECALL, id_col: str = "id", vector_col: str = "vector") -> int:
    """Nearest cells to read so that the sampled rows find that share of their true k best."""
    x, best = _sampled(rows, k, id_col, vector_col)
    if not len(x) or not len(centres):
        return 1
    near = np.argsort(((x[:, None] - centres[None]) ** 2).sum(-1), axis=1, kind="stable")
    place = np.argsort(near, axis=1)  # of each cell in the row's order
    return _least(np.take_along_axis(place, near[best, 0], 1) + 1, len(centres), recall)


def ivf_search(index: DataFrame, centres: np.ndarray, query: Sequence[float], k: int, probes: int | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Best k by cosine within the nearest cells, as many as RECALL needs; all cells are the exact result."""
    if probes is None:
        probes = ivf_probes(index, centres, k, id_col=id_col, vector_col=vector_col)
    near = np.argsort(np.linalg.norm(centres - np.array(query), axis=1), kind="stable")[:probes].tolist() if len(centres) else [0]
    return top_k(index.where(F.col("cell").isin(near)), query, k, threshold=None, id_col=id_col, vector_col=vector_col)


#: Rows, and queries, that are compared at once.
BLOCK = 2048


def _best_of(rows: DataFrame, queries: DataFrame, k: int, match: Callable[[np.ndarray, np.ndarray], np.ndarray], fallback: bool) -> DataFrame:
    """(query_id, id, score, rank): the k best by cosine of each query among the rows whose keys match its own.

    Rows are (id, vector, keys), queries (query_id, query, keys); match takes the keys of queries and rows as
    matrices and gives their pairs.  With `fallback` a query that no row matches is compared with all.  Blocks
    of rows meet blocks of queries, and of every meeting only the k best of each query go on.
    """
    rows, queries = rows.select("id", "vector", "keys"), queries.select("query_id", "query", "keys")
    n, m = (-(-max(x.count(), 1) // BLOCK) for x in (rows, queries))
    part = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    r = rows.withColumn("rb", part("id", n)).withColumn("qb", every(m))
    q = queries.withColumn("qb", part("query_id", m)).withColumn("rb", every(n))
    kinds = [pa.int64() if dict(t.dtypes)[c] == "bigint" else pa.int32() if dict(t.dtypes)[c] == "int" else pa.string() for t, c in ((queries, "query_id"), (rows, "id"))]

    def unit(v: pa.ChunkedArray) -> np.ndarray:
        flat = v.combine_chunks()
        flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
        size = np.diff(flat.offsets.to_numpy())
        if len(size) and (size == size[0]).all() and not flat.null_count:
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(size), -1)
        else:
            x = np.array(v.to_pylist(), float)
        size = np.linalg.norm(x, axis=1)[:, None]
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        out: list[pa.Array] = []
        if q.num_rows and r.num_rows:
            r = r.sort_by("id")  # a stable order below then ends in the id
            score = np.round(unit(q["query"]) @ unit(r["vector"]).T, 12)
            hit = match(np.array(q["keys"].to_pylist()), np.array(r["keys"].to_pylist()))
            any_hit = hit.any(1)
            score = np.where(hit | (~any_hit & fallback)[:, None], score, -np.inf)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            s = np.take_along_axis(score, best, 1)
            i, j = np.nonzero(s > -np.inf)
            out = [q["query_id"].take(pa.array(i)), r["id"].take(pa.array(best[i, j])), pa.array(s[i, j]), pa.array(any_hit[i])]
        return pa.table(dict(zip(("query_id", "id", "score", "hit"), out or [pa.array([], t) for t in (*kinds, pa.float64(), pa.bool_())], strict=True)))

    types = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double, hit boolean"
    local = q.groupBy("rb", "qb").cogroup(r.groupBy("rb", "qb")).applyInArrow(meet, types)
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("hit"), F.desc("score"), "id")))
    first = ranked.withColumn("_any", F.max("hit").over(W.partitionBy("query_id")))
    return first.where((F.col("rank") <= k) & (F.col("hit") == F.col("_any"))).select("query_id", "id", "score", "rank")


def ivf_batch(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """ivf_search for every query at once; rows are (id, vector, cell), queries (query_id, query)."""
    if probes is None:
        probes = ivf_probes(index, centres, k)
    q, r = queries.withColumn("keys", F.array(F.lit(0))), index.withColumn("keys", F.array("cell"))
    if len(centres):
        d = F.array(*[F.struct(V.euclidean(F.col("query"), V.literal(c)).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centres)])
        q = queries.withColumn("keys", F.slice(F.array_sort(d), 1, probes)["cell"])

    def match(near: np.ndarray, cell: np.ndarray) -> np.ndarray:
        read = np.zeros((len(near), max(len(centres), 1)), bool)
        np.put_along_axis(read, near, True, 1)
        return read[:, cell[:, 0]]

    return _best_of(r, q, k, match, False)


def hyperplanes(dim: int, planes: int = 16, tables: int = 4, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, planes, dim))


def lsh_codes(vector: Column, planes: np.ndarray) -> Column:
    """One code of sign bits for each table."""
    codes = []
    for table in planes:
        bits = [F.when(V.dot(vector, V.literal(p)) >= 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(table)]
        codes.append(sum(bits[1:], bits[0]))
    return F.array(*codes)


def lsh_index(rows: DataFrame, planes: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, tab, code): one row for each table."""
    return rows.select(id_col, F.posexplode(lsh_codes(F.col(vector_col), planes)).alias("tab", "code"))


def _codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sign-bit codes (rows, tables)."""
    return ((x @ planes.transpose(0, 2, 1)) >= 0).transpose(1, 0, 2) @ (1 << np.arange(planes.shape[1]))


def lsh_radius(rows: DataFrame, planes: np.ndarray, k: int, recall: float = RECALL, id_col: str = "id", vector_col: str = "vector") -> int:
    """Bits in which a probed code may differ so that the sampled rows find that share of their true k best."""
    x, best = _sampled(rows, k, id_col, vector_col)
    if not len(x):
        return 0
    codes = _codes(x, planes)
    differ = np.bitwise_count(codes[best] ^ codes[:, None]).min(-1)
    return _least(differ, planes.shape[1], recall)


def lsh_search(rows: DataFrame, index: DataFrame, planes: np.ndarray, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "vector", radius: int | None = None) -> DataFrame:
    """Best k by cosine among rows with a code within `radius` bits of the query's, as many as RECALL
    needs; among all rows if there is none."""
    if radius is None:
        radius = lsh_radius(rows, planes, k, id_col=id_col, vector_col=vector_col)
    hit = F.lit(False)
    for t, c in enumerate(_codes(np.array([query], float), planes)[0].tolist()):
        hit = hit | ((F.col("tab") == t) & (F.bit_count(F.col("code").bitwiseXOR(F.lit(c))) <= radius))
    found = index.where(hit).select(id_col).distinct()
    pool = rows if found.isEmpty() else rows.join(found, id_col, "left_semi")
    return top_k(pool, query, k, threshold=None, id_col=id_col, vector_col=vector_col)


def lsh_batch(rows: DataFrame, planes: np.ndarray, queries: DataFrame, k: int, radius: int | None = None) -> DataFrame:
    """lsh_search for every query at once; rows are (id, vector), queries (query_id, query)."""
    if radius is None:
        radius = lsh_radius(rows, planes, k)

    def match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hit = np.zeros((len(a), len(b)), bool)
        for t in range(a.shape[1]):
            hit |= np.bitwise_count(a[:, None, t] ^ b[None, :, t]) <= radius
        return hit

    return _best_of(rows.withColumn("keys", lsh_codes(F.col("vector"), planes)), queries.withColumn("keys", lsh_codes(F.col("query"), planes)), k, match, True)


def multi_index(results: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None, id_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Weighted reciprocal rank fusion of several indexes' results (id, score), for each value of `by`."""
    share = weights or {name: 1.0 / len(results) for name in results}
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    best = group.orderBy(F.desc("score"), id_col)
    parts = None
    for name, r in results.items():
        part = r.select(*by, id_col, "score").withColumn("s", F.lit(float(share.get(name, 0.0))) / (F.lit(60) + F.row_number().over(best))).select(*by, id_col, "s")
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy(*by, id_col).agg(F.sum("s").alias("score"))
    if not by:
        return fused.orderBy(F.desc("score"), id_col).limit(k)
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class ProductQuantizer:
    """Codebooks of each part of a vector, from k-means over a bounded sample."""

    def __init__(self, parts: int = 8, codes: int = 256, rounds: int = 20, seed: int = 42):
        self.parts, self.codes, self.rounds, self.seed = parts, min(codes, 256), rounds, seed
        self.books: np.ndarray | None = None

    def train(self, rows: DataFrame, vector_col: str = "vector", id_col: str = "id") -> ProductQuantizer:
        sample = rows.orderBy(F.xxhash64(F.col(id_col), F.lit(self.seed)), id_col).limit(SEED_ROWS).select(vector_col).collect()
        x = np.array([r[0] for r in sample], float)
        if not len(x) or x.shape[1] % self.parts:
            return self  # untrained, as lengths that do not divide are
        rng = np.random.default_rng(self.seed)
        books = []
        for part in np.split(x, self.parts, axis=1):
            c = part[rng.integers(len(part), size=min(self.codes, len(part)))]
            for _ in range(self.rounds):
                at = ((part[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                c = np.array([part[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
            books.append(c)
        self.books = np.array(books)
        return self

    def encode(self, vector: Column) -> Column:
        books, parts = self.books, self.parts
        if books is None:
            return F.lit(None).cast("array<int>")

        @pandas_udf("array<int>")
        def codes(v: pd.Series) -> pd.Series:
            x = np.stack([np.asarray(a, float) for a in v]) if len(v) else np.zeros((0, books.shape[0] * books.shape[2]))
            out = [((p[:, None] - c[None]) ** 2).sum(-1).argmin(1) for p, c in zip(np.split(x, parts, axis=1), books, strict=True)]
            return pd.Series(np.stack(out, 1).astype(np.int32).tolist(), index=v.index)

        return codes(vector)

    def decode(self, codes: Column) -> Column:
        tables = [F.array(*[V.literal(c) for c in book]) for book in self.books]
        return F.flatten(F.array(*[F.get(t, F.get(codes, F.lit(i))) for i, t in enumerate(tables)]))

    def distance(self, codes: Column, query: Sequence[float]) -> Column:
        """Squared distance of the query to what the codes stand for."""
        q = np.split(np.array(query, float), self.parts)
        tables = [V.literal(((book - p) ** 2).sum(1)) for book, p in zip(self.books, q, strict=True)]
        terms = [F.get(t, F.get(codes, F.lit(i))) for i, t in enumerate(tables)]
        return sum(terms[1:], terms[0])
