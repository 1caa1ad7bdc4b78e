"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters.  Each lexicon voter says toxic (1), clean (0) or nothing (-1).  Some lexicons are written
   here (kinds of abuse, in four languages); others are mined from at most LABELLED labelled
   documents (those with the smallest hash of the id): whole words, and beginnings of words of 4, 5,
   6 and 8 bytes, that at least MIN_FOUND toxic documents have and almost no clean one.  Documents
   that share their smallest long-word hash count as one there, so that copies don't mine
   their own words.  Pattern voters look at how found words stand: aimed, repeated, dense,
   varied.  The distinct rows of votes with their numbers of documents are counted over all
   documents: a table bounded by the voters alone.
2. Label model.  EM fits each voter's vote distribution given the hidden label, at first as if voters were
   independent.  The correlation of two voters' votes that this leaves unexplained within a label
   is then estimated, and EM runs again with each voter's evidence divided by 1 plus its
   correlations above CORRELATED, so that voters that say the same count about once.
3. Classifier.  A logistic regression over the words and beginnings of words present in a text
   (the FEATURES that differ most) is fitted to the posterior labels of about TRAIN_DOCS documents
   of each side, those with the smallest share of a hash of id and text.  The bounds affect
   fitting alone: every document is scored, over its whole text.

A document is toxic if its probability is at least TOXIC.  Null, empty and wordless texts have
probability 0 and are clean.  If no document draws a toxic vote, all have probability 0.  Rows
that repeat are scored alike, an empty table gives an empty result, columns besides doc_id and text are
ignored.  Labels with a null doc_id or toxic count for nothing; without labels nothing is mined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._spark import documents, named, text_input, text_key
from loamgraph.llm._text import byte_table, chunks, lower_bytes, seeded, segment_hash, word_hashes, words

LEXICONS = {
    "intelligence": "idiot idiots idiotic moron morons moronic stupid imbecile imbeciles dumb dumbass halfwit dimwit cretin retard",
    "worth": "worthless pathetic loser losers wretch goodfornothing",
    "filth": "trash scum garbage vermin filth filthy scumbag dirtbag lowlife maggot parasite",
    "disgust": "disgusting repulsive vile revolting sickening despicable loathsome",
    "mockery": "clown clowns buffoon laughingstock weirdo crybaby",
    "profanity": "fuck fucking fucker shit shitty bullshit bitch bastard asshole damn cunt dickhead slut whore",
    "threat": "kill murder strangle",
    "french": "imbécile crétin connard connasse salope ordure débile abruti salaud pourriture",
    "german": "arschloch dummkopf schlampe abschaum scheiße miststück vollidiot trottel hurensohn widerlich",
    "spanish": "estúpido imbécil pendejo cabrón basura asqueroso mierda gilipollas escoria puta",
}
#: Lexicons of words that clean texts use too: they speak against a text only where they come again.
COMMON = ("threat", "profanity")
PREFIXES = (4, 5, 6, 8)
MINED = ["mined_words", *[f"mined_{n}" for n in PREFIXES]]
#: Voters that look at how the found words stand in a text.
PATTERNS = ["aimed", "repeated", "dense", "varied"]
VOTERS = [*LEXICONS, *MINED, *PATTERNS]
_AIM = "you your youre you're u ur he she they tu vous du ihr sie usted eres"
CORRELATED = 0.1
LABELLED = 10_000
MIN_FOUND = 6
CLEAN_SHARE = 0.01
TRAIN_DOCS = 1_500
FEATURES = 4096
TOXIC = 0.5

_MARK = seeded(91, 1 + len(PREFIXES))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, words) hashes of every word and its beginnings (0 where a word is no longer than that),
    in lower case, and the text of every word."""
    low = lower_bytes(data)
    starts, ends, word_off = words(low, off, letters=True)
    size = ends - starts
    values = byte_table(7)[low]
    out = np.zeros((1 + len(PREFIXES), len(starts)), np.uint64)
    out[0] = segment_hash(values, starts, ends)
    for i, n in enumerate(PREFIXES, 1):
        long = size > n
        out[i, long] = segment_hash(values, starts[long], starts[long] + n) ^ _MARK[i]
    return out, np.repeat(np.arange(len(off) - 1), np.diff(word_off))


class Members:
    """Fast test of hashes against a bounded sorted set."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are members, and which member each is."""
        at = np.flatnonzero(self.map[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[which] == h[at]
        return at[ok], which[ok]


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), letters=True)
    return word_hashes(data, starts, ends)


_lexicon: tuple[Members, np.ndarray, np.ndarray] | None = None


def lexicon() -> tuple[Members, np.ndarray, np.ndarray]:
    """The lexicon words, the voter of each, and the hashes of words that aim."""
    global _lexicon
    if _lexicon is None:
        own = {h: v for v, text in reversed(list(enumerate(LEXICONS.values()))) for h in _hashes(text).tolist()}
        _lexicon = (Members(np.array(list(own), np.uint64)), np.array([own[h] for h in sorted(own)]), np.unique(_hashes(_AIM)))
    return _lexicon


def votes(f: np.ndarray, text: np.ndarray, n: int, mined: list[Members]) -> np.ndarray:
    """(n, voters) votes: 1 toxic, 0 clean, -1 none; a wordless text gets none at all."""
    written, voter, aims = lexicon()
    h = f[0]
    count = np.bincount(text, minlength=n)
    some = count > 0
    out = np.full((n, len(VOTERS)), -1, np.int8)
    per = np.zeros((n, len(LEXICONS) + len(MINED)), np.int64)
    hit = np.zeros(len(h), bool)
    at, which = written.find(h)
    np.add.at(per, (text[at], voter[which]), 1)
    hit[at] = True
    out[some, : len(LEXICONS)] = 0
    for i, m in enumerate(mined):
        got, _ = m.find(f[i])
        per[:, len(LEXICONS) + i] = np.bincount(text[got], minlength=n)
        hit[got] = True
        if len(m.values):
            out[some, len(LEXICONS) + i] = 0
    common = np.array([name in COMMON for name in [*LEXICONS, *MINED]])
    own = out[:, : per.shape[1]]
    own[per > np.where(common, 1, 0)] = 1
    own[(per == 1) & common] = -1
    at = np.flatnonzero(hit)
    where = text[at]
    total = np.bincount(where, minlength=n)
    base = per.shape[1]
    for back in (1, 2, 3):
        prev = at - back
        ok = prev >= 0
        ok[ok] = text[prev[ok]] == where[ok]
        ok[ok] = np.isin(h[prev[ok]], aims)
        out[where[ok], base] = 1
    out[total > 1, base + 1] = 1
    out[(total == 0) & some, base + 1] = 0
    out[(total * 200 > count) & (total > 0), base + 2] = 1
    out[(total * 2000 < count) & some, base + 2] = 0
    out[(per > 0).sum(1) > 1, base + 3] = 1
    return out


_POWERS = 3 ** np.arange(len(VOTERS), dtype=np.int64)


def pattern_code(v: np.ndarray) -> np.ndarray:
    return ((v + 1).astype(np.int64) * _POWERS).sum(1)


def pattern_votes(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // _POWERS % 3 - 1).astype(np.int8)


def distinct(f: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, kind, hash) of all words and beginnings, by text."""
    kind = np.repeat(np.arange(len(f)), f.shape[1])
    h, t = f.ravel(), np.tile(text, len(f))
    some = np.flatnonzero(h)
    some = some[np.lexsort((h[some], t[some]))]
    kind, h, t = kind[some], h[some], t[some]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return t[new], kind[new], h[new]


def _mine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, h, g, toxic): words and beginnings of the labelled documents; copies share g."""
    for batch in batches:
        for part, data, off in chunks(batch, "text"):
            f, text = features(data, off)
            n = part.num_rows
            has = np.bincount(text, minlength=n) > 0
            if not has.any():
                continue
            # words over five bytes before all others
            key = np.where(f[2] != 0, f[0] >> np.uint64(1), np.uint64(1 << 63) | (f[0] >> np.uint64(1)))
            group = np.zeros(n, np.uint64)
            group[has] = np.minimum.reduceat(key, np.searchsorted(text, np.flatnonzero(has)))
            t, kind, h = distinct(f, text)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[t]
            cols = [pa.array(kind.astype(np.int8)), pa.array(h.view(np.int64)), pa.array(group[t].view(np.int64)), pa.array(toxic.astype(np.int8))]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "h", "g", "toxic"])


def mine(d: DataFrame, labels: DataFrame | None, most: int = LABELLED) -> list[np.ndarray]:
    """Hashes of the mined words and beginnings, by kind, out of (doc_id, text)."""
    none = [np.empty(0, np.uint64) for _ in MINED]
    if labels is None:
        return none
    known = labels.select(labels["doc_id"].cast("long").alias("l_id"), labels["toxic"].cast("int").alias("toxic")).where("l_id is not null and toxic is not null")
    known = known.groupBy("l_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return none
    # at most `most` ids, so their broadcast has a bounded size
    rows = d.join(F.broadcast(known), d["doc_id"].cast("long") == F.col("l_id")).select("text", "toxic")
    rows = rows.mapInArrow(_mine_batches, "kind byte, h long, g long, toxic byte").distinct()
    count = rows.groupBy("kind", "h").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    found = count.where((F.col("bad") >= MIN_FOUND) & (F.col("good") / n[0] <= CLEAN_SHARE * F.col("bad") / n[1])).toPandas()
    return [np.sort(found["h"][found["kind"] == i].to_numpy(np.int64).view(np.uint64)) for i in range(len(MINED))]


def _pattern_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        mined = [Members(m) for m in shared.value]
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                f, text = features(data, off)
                codes, n = np.unique(pattern_code(votes(f, text, part.num_rows, mined)), return_counts=True)
                for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                    total[c] = total.get(c, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])

    return run


class LabelModel:
    """P(toxic | votes) by EM over counted rows of votes."""

    def __init__(self, v: np.ndarray, n: np.ndarray, rounds: int = 60):
        n = np.where((v >= 0).any(1), n, 0)  # texts that no voter spoke of teach nothing
        self.share = np.ones(v.shape[1])
        self._fit(v, n, rounds)
        self.correlation = self._left_over(v, n)
        self.share = 1 / (1 + np.where(self.correlation > CORRELATED, self.correlation, 0).sum(1))
        self._fit(v, n, rounds)
        self.accuracy = self._accuracies(v, n)

    def _fit(self, v: np.ndarray, n: np.ndarray, rounds: int) -> None:
        """Starts from the belief that any two toxic votes mean toxic."""
        p = np.clip((v == 1).sum(1) / 2, 0.001, 0.999)
        for _ in range(rounds):
            w1, w0 = n * p, n * (1 - p)
            self.prior = float(np.clip(w1.sum() / n.sum(), 1e-6, 0.49))
            logit = np.full(len(n), np.log(self.prior / (1 - self.prior)))
            for j in range(v.shape[1]):
                a = (np.bincount(v[:, j] + 1, weights=w1, minlength=3) + 0.1) / (w1.sum() + 0.3)
                b = (np.bincount(v[:, j] + 1, weights=w0, minlength=3) + 0.1) / (w0.sum() + 0.3)
                ratio = np.log(a / b) * self.share[j]
                ratio[2] = max(ratio[2], 0)  # a voter is no worse than chance
                logit += ratio[v[:, j] + 1]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            p = np.where((v == 1).any(1), p, np.minimum(p, self.prior))  # without a toxic vote nothing is
        self.p = p

    def _accuracies(self, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected share of each voter's votes that agree with the label."""
        right = np.where(v == 1, self.p[:, None], np.where(v == 0, 1 - self.p[:, None], 0))
        return (right * n[:, None]).sum(0) / np.maximum(((v >= 0) * n[:, None]).sum(0), 1e-9)

    def _left_over(self, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Largest absolute correlation of two voters' toxic votes within one label."""
        out = np.zeros((v.shape[1], v.shape[1]))
        x = (v == 1).astype(float)
        for weight in (n * self.p, n * (1 - self.p)):
            if weight.sum() < 1:
                continue
            mean = weight @ x / weight.sum()
            cov = (x * weight[:, None]).T @ x / weight.sum() - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            out = np.maximum(out, np.abs(cov / np.outer(sd, sd)))
        np.fill_diagonal(out, 0)
        return out


def label_model(d: DataFrame, mined: list[np.ndarray]) -> tuple[LabelModel | None, np.ndarray, np.ndarray]:
    """The model, the codes of all rows of votes and their numbers."""
    shared = d.sparkSession.sparkContext.broadcast(mined)
    counted = d.select("text").mapInArrow(_pattern_batches(shared), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = counted.toPandas().sort_values("code")
    code, n = counted["code"].to_numpy(np.int64), counted["n"].to_numpy(float)
    v = pattern_votes(code)
    if not len(code) or not (v == 1).any():
        return None, code, n
    return LabelModel(v, n), code, n


def _sample_batches(shared):
    """Distinct words and beginnings of the sampled documents with their posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, share1, share0, mined = shared.value
        mined = [Members(m) for m in mined]
        most = max(share1, share0)
        for batch in batches:
            u = (batch.column("k").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
            for part, data, off in chunks(batch.filter(pa.array(u < most)), "text"):
                f, text = features(data, off)
                p = np.array([table[c] for c in pattern_code(votes(f, text, part.num_rows, mined)).tolist()])
                k = part.column("k").to_numpy(zero_copy_only=False)
                take = (k.view(np.uint64) >> np.uint64(11)) / float(1 << 53) < np.where(p >= 0.5, share1, share0)
                pick = take[text]
                t, _, h = distinct(f[:, pick], text[pick])
                rows, size = np.unique(t, return_counts=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                cols = [pa.array(k[rows]), pa.array(p[rows]), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "p", "h"])

    return run


def fit_linear(feature: np.ndarray, row: np.ndarray, p: np.ndarray, weight: np.ndarray, width: int, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by accelerated gradient steps."""
    n = len(p)
    w, look, bias, look_b = np.zeros(width), np.zeros(width), 0.0, 0.0
    size = np.bincount(row, minlength=n)
    step = 1.0 / (0.25 * (1 + np.average(size, weights=weight)) + ridge)
    for i in range(rounds):
        z = np.bincount(row, weights=look[feature], minlength=n) + look_b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p) / weight.sum()
        new = look - step * (np.bincount(feature, weights=g[row], minlength=width) + ridge * look)
        new_b = look_b - step * g.sum()
        m = i / (i + 3)
        look, look_b, w, bias = new + m * (new - w), new_b + m * (new_b - bias), new, new_b
    return w, float(bias)


_NOTHING = (np.empty(0, np.uint64), np.empty(0), -np.inf)


def classifier(docs: DataFrame, labels: DataFrame | None, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes in order, their weights, and the bias; the bias is -inf where nothing is toxic."""
    d = text_input(docs, "doc_id")
    mined = mine(d, labels)
    model, code, n = label_model(d, mined)
    if model is None or not (model.p >= 0.5).any():
        return _NOTHING
    toxic = model.p >= 0.5
    share1, share0 = train_docs / n[toxic].sum(), train_docs / max(n[~toxic].sum(), 1)
    shared = d.sparkSession.sparkContext.broadcast((dict(zip(code.tolist(), model.p.tolist(), strict=True)), share1, share0, mined))
    keyed = d.select(F.xxhash64(F.col("doc_id").cast("long"), text_key()).alias("k"), "text")
    rows = keyed.mapInArrow(_sample_batches(shared), "k long, p double, h array<long>").toArrow().sort_by("k")
    if not rows.num_rows:
        return _NOTHING
    lists = rows.column("h").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    row = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
    hashes, at = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    p = rows.column("p").to_numpy()
    side = p >= 0.5
    n1, n0 = max(side.sum(), 1), max((~side).sum(), 1)
    bad, good = np.bincount(at[side[row]], minlength=len(hashes)) / n1, np.bincount(at[~side[row]], minlength=len(hashes)) / n0
    differ = np.abs(bad - good) / np.sqrt(bad * (1 - bad) / n1 + good * (1 - good) / n0 + 1 / min(n1, n0) ** 2)
    keep = np.sort(np.lexsort((hashes, -differ))[:FEATURES])
    rank = np.full(len(hashes), -1)
    rank[keep] = np.arange(len(keep))
    used = rank[at] >= 0
    w, bias = fit_linear(rank[at][used], row[used], p, np.where(side, 1 / n1, 1 / n0), len(keep))
    return hashes[keep], np.round(w, 6), round(bias, 6)


def score_texts(data: np.ndarray, off: np.ndarray, members: Members, w: np.ndarray, bias: float) -> np.ndarray:
    """Probability of every text; each of its features counts once."""
    n = len(off) - 1
    f, text = features(data, off)
    if not np.isfinite(bias):
        return np.zeros(n)
    pairs = []
    for kind in f:
        at, which = members.find(kind)
        pairs.append(text[at] * len(w) + which)
    pair = np.unique(np.concatenate(pairs))
    z = np.bincount(pair // len(w), weights=w[pair % len(w)], minlength=n) + bias
    p = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)
    p[np.bincount(text, minlength=n) == 0] = 0
    return p


def _score_batches(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w, bias = shared.value
        members = Members(hashes)
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                p = score_texts(data, off, members, w, bias)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "p_toxic", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame | None = None, threshold: float = TOXIC, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, p_toxic, toxic) of every document; see the module for all cases."""
    # at most FEATURES weights, whatever the data
    shared = docs.sparkSession.sparkContext.broadcast(classifier(docs, labels, train_docs))
    return text_input(docs, "doc_id").mapInArrow(_score_batches(shared, threshold), f"doc_id {dict(named(docs, 'doc_id').dtypes)['doc_id']}, p_toxic double, toxic boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
