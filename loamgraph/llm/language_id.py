"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds its letters' vectors,
rotated by two, one and no positions, by elementwise product; a text's vector is the bundle (sum)
of the vectors of all its trigrams; a language's prototype is the bundle of its documents'
normalised vectors.  A document belongs to the prototype of the largest cosine, ties to the first
name.  Letters are those of ASCII and, for other scripts, a class for every byte that ends or continues a
letter together with the byte that begins it; anything else counts as one space.

Prototypes are fitted on every distinct (doc_id, text) of every value of `lang`, so repeated rows count once:
each of n copies weighs 1 / n (nulls in lang or doc_id teach nothing).  At most LANGUAGES values of `lang`, those of the most documents, have a
prototype, which bounds what is broadcast where the column is dirty.  Every document is compared on its
whole text.  A document is rejected if no trigram is in it, or if its best
cosine is below the bound of that language for texts of its length.  Bounds come from cosines of
all these documents with the prototype of the other documents of their language.  A bound is the least of three: half the
median of beginnings of 4, 8, 16 ... trigrams, the SHORT_TOLERANCE quantile of these, and the TOLERANCE
quantile of whole texts of at least ENOUGH trigrams.  Cosines rise with length, so short texts
have low bounds of their own, and texts under 4 trigrams none.  A language of under LEAST
texts has none at all; there texts of at least ENOUGH trigrams need MIN_COSINE.  Null and empty texts get a null language, cosine 0
and are rejected; without any prototype every document gets a null language and those with a
trigram are kept.  Rows that repeat are treated alike, an empty table gives an empty
result, columns besides doc_id, text and lang pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.llm._spark import any_columns, cut, documents, named, with_text
from loamgraph.llm._text import chunks, lower_bytes, seeded, text_of

DIMENSIONS = 1024
LANGUAGES = 1_000
MIN_COSINE = 0.12
ENOUGH = 100
#: Share of a known language's whole texts, and of beginnings of one length, that a bound may leave below it.
TOLERANCE = 0.01
SHORT_TOLERANCE = 0.05
#: Texts of one length that a bound takes at least.
LEAST = 20
#: Lengths of beginnings are 2 ** 2 to 2 ** (_GRID - 1) trigrams.
_GRID = 20
_SYMBOLS = 64

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
#: Bytes above 127 that continue a letter fall in the other classes, by themselves and the byte that began it.
_OTHERS = 37
#: Texts compared at once: bounds the dense matrix of counts.
_ROWS = 512
_CODES = 1024
#: Beginnings of up to 2 ** _NEAR trigrams are summed trigram by trigram where at most _TABLE bound vectors
#: are needed; a matrix of counts is quicker for longer ones and needs no table.
_NEAR, _TABLE = 8, 8192
#: Cosines are counted in steps of 1 / _STEPS, sums of vectors in steps of 1 / _UNIT, so their order is no matter.
_STEPS, _UNIT = 1_000_000, 1 << 30
#: Repeated rows beyond which their numbers are no longer broadcast but joined by a shuffle, with the same rows.
BROADCAST_REPEATS = 1 << 18
#: Bytes of text taken at once: the more, the more texts share the bound vectors of their trigrams.
_CHUNK = 1 << 20


def letter_vectors(dimensions: int) -> np.ndarray:
    bits = np.unpackbits(seeded(5, _SYMBOLS * dimensions // 64).view(np.uint8)).reshape(_SYMBOLS, dimensions)
    return np.where(bits > 0, 1, -1).astype(np.float32)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code and the text of every trigram of letters and single spaces."""
    low = lower_bytes(data)
    letter = low < 0xC0  # a lead byte only says that a letter follows
    at = np.flatnonzero(letter)
    s, text = _SYMBOL[low[at]], text_of(at, off)
    begins = np.maximum.accumulate(np.where(low >= 0xC0, np.arange(len(low)), 0))
    more = low[at] >= 0x80
    s[more] = 27 + (low[at[more]].astype(np.int64) % 64 + 11 * low[begins[at[more]]].astype(np.int64)) % _OTHERS
    gap = np.zeros(len(s), bool)
    gap[1:] = (s[1:] == 0) & (s[:-1] == 0) & (text[1:] == text[:-1])
    s, text = s[~gap], text[~gap]
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
    ok = text[:-2] == text[2:]
    return code[ok], text[:-2][ok]


def bind(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return np.roll(letters, 2, 1)[codes >> 12] * np.roll(letters, 1, 1)[(codes >> 6) & 63] * letters[codes & 63]


def bundles(data: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all texts (zero where there is no trigram) and their trigram counts."""
    return bundles_of(*trigrams(data, off), len(off) - 1, letters)


def bundles_of(code: np.ndarray, text: np.ndarray, n: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = sums_of(code, text, n, letters)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None], np.bincount(text, minlength=n)


def sums_of(code: np.ndarray, text: np.ndarray, n: int, letters: np.ndarray) -> np.ndarray:
    """Bundles of all texts, not normalised; they are whole numbers, so exact."""
    out = np.zeros((n, letters.shape[1]), np.float32)
    for at in range(0, n, _ROWS):
        lo, hi = np.searchsorted(text, [at, at + _ROWS])
        if lo == hi:
            continue
        rows = min(_ROWS, n - at)
        seen = np.zeros(1 << 18, bool)
        seen[code[lo:hi]] = True
        u = np.flatnonzero(seen)
        rank = np.zeros(1 << 18, np.int64)
        rank[u] = np.arange(len(u))
        m = np.bincount((text[lo:hi] - at) * len(u) + rank[code[lo:hi]], minlength=rows * len(u))
        m = m.reshape(rows, len(u))
        for i in range(0, len(u), _CODES):  # bounds the bound vectors held at once
            out[at : at + rows] += m[:, i : i + _CODES].astype(np.float32) @ bind(u[i : i + _CODES], letters)
    return out


def beginnings(code: np.ndarray, text: np.ndarray, n: int, letters: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Bundles of all texts, and j, texts and bundles of the beginnings of 2 ** j trigrams of those that have as
    many; each begins with the one before it.  For at most _ROWS texts, which bounds what is held."""
    count, start = np.bincount(text, minlength=n), np.searchsorted(text, np.arange(n))
    rank = np.arange(len(text)) - start[text]
    used = np.unique(code[rank < 1 << _NEAR])
    table = np.empty((len(used), letters.shape[1]), np.float32) if len(used) <= _TABLE else None
    for i in range(0, len(used) if table is not None else 0, _CODES):  # bounds what bind() holds beside it
        table[i : i + _CODES] = bind(used[i : i + _CODES], letters)
    out, found = np.zeros((n, letters.shape[1]), np.float32), []
    for j in range(2, _GRID):
        rows = np.flatnonzero(count >= 1 << j)
        if not len(rows):
            break
        low = 0 if j == 2 else 1 << (j - 1)
        size = (1 << j) - low
        new = code[start[rows][:, None] + np.arange(low, 1 << j)]
        if j <= _NEAR and table is not None:
            place, step = np.searchsorted(used, new), max(1, 2 * _CODES // size)
            for i in range(0, len(rows), step):
                out[rows[i : i + step]] += table[place[i : i + step]].sum(1)
        else:
            out[rows] += sums_of(new.ravel(), np.repeat(np.arange(len(rows)), size), len(rows), letters)
        found.append((j, rows, out[rows]))
    done = np.where(count < 4, 0, 1 << np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), _GRID - 1))
    rest = rank >= done[text]
    return out + sums_of(code[rest], text[rest], n, letters), found


def _bundle_batches(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(dimensions)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, off in chunks(batch, "text", _CHUNK):
                v, _ = bundles(data, off, letters)
                v = np.rint(v * (part.column("w").to_numpy()[:, None] * _UNIT)).astype(np.int64)
                lang = np.array(part.column("lang").to_pylist(), object)
                for name in set(lang.tolist()):
                    total[name] = total.get(name, 0) + v[lang == name].sum(0)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].tolist() for x in names], pa.list_(pa.int64()))], names=["lang", "v"])

    return run


def cosines(code: np.ndarray, text: np.ndarray, at: np.ndarray, total: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """j, texts and cosines of whole texts (j = 0) and of their beginnings of 2 ** j trigrams with the bundle of
    their language without the text itself."""
    for lo in range(0, len(at), _ROWS):
        i, k = np.searchsorted(text, [lo, lo + _ROWS])
        own, found = beginnings(code[i:k], text[i:k] - lo, min(_ROWS, len(at) - lo), letters)
        mine = at[lo : lo + _ROWS]
        rest = total[mine] - own / np.maximum(np.linalg.norm(own, axis=1), 1e-9)[:, None]
        size = np.linalg.norm(rest, axis=1)
        rest = (rest / np.maximum(size, 1e-9)[:, None]).astype(np.float32)
        long = np.flatnonzero(np.bincount(text[i:k] - lo, minlength=len(mine)) >= ENOUGH)
        for j, rows, v in [(0, long, own[long]), *found]:
            ok = (mine[rows] >= 0) & (size[rows] > 1e-3)
            v, r = v[ok], rows[ok]
            yield j, r + lo, np.einsum("ij,ij->i", v, rest[r]).astype(np.float64) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)


def _bound_batches(names: list[str], sums, dimensions: int):
    """Language, j, cosine in steps and weight of every text's cosines."""
    place = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letter_vectors(dimensions), sums.value
        for batch in batches:
            for part, data, off in chunks(batch, "text", _CHUNK):
                at = np.array([place.get(x, -1) for x in part.column("lang").to_pylist()], np.int64)
                w = part.column("w").to_numpy()
                for j, rows, cos in cosines(*trigrams(data, off), at, total, letters):
                    columns = [at[rows], np.full(len(rows), j), np.floor(cos * _STEPS).astype(np.int64), w[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "j", "step", "w"])

    return run


def taught(docs: DataFrame, languages: int, per_language: int | None = None, broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """(lang, text, w) of every row that teaches; the weights of a repeated row's copies add up to one."""
    docs = named(docs, "doc_id", "text", "lang")
    d = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    d = d.where("lang is not null and id is not null").withColumn("h", F.xxhash64("id", "text")).drop("id")
    counts = cut(d.groupBy("lang", "h").agg(F.count("*").alias("n")))
    many = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).orderBy(F.desc("n"), "lang").limit(languages)
    u = F.col("h").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    # one row for each language, at most `languages` of them
    d = d.join(F.broadcast(many.select("lang", "texts")), "lang")
    if per_language is not None:  # a caller that asks for a sample
        d = d.where(u <= F.lit(per_language) / F.col("texts"))
    repeats = counts.where("n > 1")
    few = repeats.count() <= broadcast_repeats
    d = d.join(repeats.hint("broadcast" if few else "shuffle_hash"), ["lang", "h"], "left")
    return d.select("lang", "text", (1 / F.coalesce("n", F.lit(1))).alias("w"))


def fit(docs: DataFrame, per_language: int | None = None, dimensions: int = DIMENSIONS, tolerance: float = TOLERANCE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of the languages, their unit prototypes, and their bounds by log2 of the trigrams (nan: none)."""
    d = taught(docs, languages, per_language)
    parts = d.mapInArrow(_bundle_batches(dimensions), "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    # as many rows as there are languages and dimensions
    rows = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    total = {r["lang"]: np.array([x for _, x in r["v"]], np.float64) / _UNIT for r in rows}
    names = sorted(k for k in total if total[k].any())
    if not names:
        return [], np.zeros((0, dimensions)), np.zeros((0, _GRID))
    sums = np.array([total[k] for k in names])
    p = sums / np.linalg.norm(sums, axis=1)[:, None]
    cos = d.mapInArrow(_bound_batches(names, d.sparkSession.sparkContext.broadcast(sums), dimensions), "at long, j long, step long, w double")
    # of one language and length there are no more rows than steps
    steps, group = cos.groupBy("at", "j", "step").agg(F.sum("w").alias("w")), W.partitionBy("at", "j")
    steps = steps.withColumn("below", F.sum("w").over(group.orderBy("step").rowsBetween(W.unboundedPreceding, 0))).withColumn("texts", F.round(F.sum("w").over(group)))
    low = lambda share: F.min(F.when(F.col("below") > F.floor(share * (F.col("texts") - 1)) + 0.5, F.col("step")))
    found = steps.groupBy("at", "j").agg(F.max("texts").alias("texts"), low(0.5).alias("half"), low(SHORT_TOLERANCE).alias("short"), low(tolerance).alias("whole")).collect()
    whole = {r["at"]: r["whole"] for r in found if not r["j"]}
    bounds = np.full((len(names), _GRID), np.nan)
    for r in found:
        if r["j"] and r["texts"] >= LEAST:
            bounds[r["at"], r["j"]] = min(r["half"] // 2, r["short"], whole.get(r["at"], r["short"])) / _STEPS
    for j in range(3, _GRID):  # beyond the long texts their bound stays
        bounds[:, j] = np.where(np.isnan(bounds[:, j]), bounds[:, j - 1], bounds[:, j])
    return names, np.round(p, 9), bounds


def prototypes(docs: DataFrame, per_language: int | None = None, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Names of the languages and their unit prototypes."""
    return fit(docs, per_language, dimensions)[:2]


def known(best: np.ndarray, cos: np.ndarray, n: np.ndarray, bounds: np.ndarray, min_cosine: float, enough: int) -> np.ndarray:
    """Whether a text is in the language it is nearest to; all are where there is no prototype."""
    if not len(bounds):
        return n > 0
    j = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), _GRID - 1)
    bound = bounds[best, j]
    fixed = np.isnan(bounds[best]).all(1)
    return (n > 0) & np.where(fixed, (n < enough) | (cos >= min_cosine), (cos >= bound) | np.isnan(bound))


def classify(data: np.ndarray, off: np.ndarray, letters: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of the best prototype, its cosine and the number of trigrams of every text."""
    v, n = bundles(data, off, letters)
    if not len(p):
        return np.zeros(len(n), np.int64), np.zeros(len(n)), n
    cos = np.round(v.astype(np.float64) @ p.T, 6)
    best = cos.argmax(1)
    return best, cos[np.arange(len(best)), best], n


def _classify_batches(columns: list[str], text: str, fitted, dimensions: int, min_cosine: float, enough: int, filtering: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p, bounds = fitted.value
        letters = letter_vectors(dimensions)
        for batch in batches:
            for part, data, off in chunks(batch, text, _CHUNK):
                best, cos, n = classify(data, off, letters, p)
                keep = known(best, cos, n, bounds, min_cosine, enough)
                arrays = [part.column(c) for c in columns]
                if filtering:
                    yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))
                    continue
                lang = [names[b] if k and names else None for b, k in zip(best.tolist(), (n > 0).tolist(), strict=True)]
                more = [pa.array(lang, pa.string()), pa.array(cos), pa.array(n), pa.array(keep)]
                yield pa.RecordBatch.from_arrays([*arrays, *more], names=[*columns, "language", "cosine", "trigrams", "keep"])

    return run


def _apply(docs: DataFrame, columns: list[str], filtering: bool, per_language: int | None, dimensions: int, min_cosine: float, enough: int) -> DataFrame:
    # a prototype for each language: no more rows than there are languages
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, dimensions))
    fields = [f"`{c}` {t}" for c, t in docs.select(*columns).dtypes]
    if not filtering:
        fields += ["language string", "cosine double", "trigrams long", "keep boolean"]
    d, text = with_text(docs, columns)
    return d.mapInArrow(_classify_batches(columns, text, fitted, dimensions, min_cosine, enough, filtering), ", ".join(fields))


def identify(docs: DataFrame, per_language: int | None = None, dimensions: int = DIMENSIONS, min_cosine: float = MIN_COSINE, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, language, cosine, trigrams, keep) of every document; see the module for all cases."""
    return _apply(named(docs, "doc_id", "text", "lang"), ["doc_id"], False, per_language, dimensions, min_cosine, enough)


@any_columns
def keep_known_languages(docs: DataFrame, per_language: int | None = None, dimensions: int = DIMENSIONS, min_cosine: float = MIN_COSINE, enough: int = ENOUGH) -> DataFrame:
    """The documents in a known language, all columns kept."""
    return _apply(docs, docs.columns, True, per_language, dimensions, min_cosine, enough)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES = {"op7_language_id": op7_language_id}
ORACLE: dict[str, str] = {}
