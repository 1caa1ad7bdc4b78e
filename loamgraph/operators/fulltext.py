"""Full-text search over a table of postings (id, term, tf), and fusion and reranking of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.sources.store import cut


def postings(docs: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, term, tf): tokens with their synonyms, counts up to 255."""
    exploded = docs.select(F.col(id_col).alias("id"), F.explode(T.expanded_tokens(F.col(content_col))).alias("term"))
    return exploded.groupBy("id", "term").agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("tf"))


def _prefix(terms: list[str]) -> str | None:
    return terms[0][2:] if len(terms) == 1 and terms[0].startswith("*:") else None


def _counts_for(terms: list[str], fuzzy: int) -> tuple[Callable[[Column], Column], Callable[[str], bool]]:
    """Whether a term of the index counts for one of the query's, as a Column and for a known term."""
    base = _prefix(terms)
    if base is not None:
        return lambda t: t.startswith(base), lambda t: t.startswith(base)
    if fuzzy > 0:

        def near(t: Column) -> Column:
            out = F.lit(False)
            for x in terms:
                # terms of other lengths are further away, which costs less to see
                out = out | (F.octet_length(t).between(len(x.encode()) - fuzzy, len(x.encode()) + fuzzy) & (T.levenshtein(t, F.lit(x)) <= fuzzy))
            return out

        return near, lambda t: any(T.levenshtein_bytes(t, x) <= fuzzy for x in terms)
    return lambda t: t.isin(terms), lambda t: t in terms


def postings_of(docs: DataFrame, terms: list[str], fuzzy: int = 0, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """The rows of postings() that count for these terms of a query.  All texts are read and no other word of
    them leaves its task, so what is shuffled grows with what is found."""
    counts, known = _counts_for(terms, fuzzy)
    leads = sorted(w for w in {*T.SYNONYMS, *T.SYNONYMS.values()} if any(known(x) for x in T.expand(w)))
    w = F.col("_w")
    # explode() would have its array made twice, the first time to see whether it is empty
    words = docs.select(F.col(id_col).alias("id"), F.explode_outer(T.words(F.col(content_col))).alias("_w"))
    words = words.where((counts(w) | w.isin(leads)) & (F.octet_length(w) > 1) & ~w.isin(T.STOP_WORDS))
    # a word and its synonyms first become one row each where it has any
    found = words.select("id", F.explode(T.with_synonyms(w)).alias("term")).where(counts(F.col("term")))
    return found.groupBy("id", "term").agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("tf"))


def matches(index: DataFrame, terms: list[str], fuzzy: int = 0) -> DataFrame:
    """Postings of the query terms as (query_term, id, tf), summed over what a term expands to."""
    if _prefix(terms) is not None:
        hit = index.where(F.col("term").startswith(_prefix(terms))).withColumn("query_term", F.lit(terms[0]))
    elif fuzzy > 0:
        near = [F.when(_counts_for([t], fuzzy)[0](F.col("term")), F.lit(t)) for t in terms]
        # a term of the index counts once for each term of the query that it is near to
        hit = index.select("id", "tf", F.explode(F.array_compact(F.array(*near))).alias("query_term"))
    else:
        hit = index.where(F.col("term").isin(terms)).withColumn("query_term", F.col("term"))
    return hit.groupBy("query_term", "id").agg(F.sum("tf").alias("tf"))


def bm25(index: DataFrame, terms: list[str], n_docs: int | Column, *, k: int | None = None, fuzzy: int = 0) -> DataFrame:
    """(id, score), best first.  The length norm is constant, so a term gives idf * 2.2 tf / (tf + 1.2).

    Scores have 9 digits, so that equal ones stay equal in whatever order they are summed.
    """
    m = matches(index, terms, fuzzy)
    # tf is never null; counting it leaves both uses of m the same columns, so that m is shuffled once for both
    df = m.groupBy("query_term").agg(F.count("tf").alias("df"))
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    # one row for each term of the query
    idf = df.select("query_term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    part = F.col("idf") * (F.col("tf") * 2.2) / (F.col("tf") + 1.2)
    out = m.join(F.broadcast(idf), "query_term").groupBy("id").agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return out if k is None else out.limit(k)


def phrase(index: DataFrame, terms: list[str], *, docs: DataFrame | None = None, adjacent: str | None = None, id_col: str = "id", content_col: str = "content", k: int | None = None) -> DataFrame:
    """Documents that have all terms, by the sum of counts; with `adjacent`, also this text as it is."""
    hit = index.where(F.col("term").isin(terms)).groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").cast("double").alias("score"))
    hit = hit.where(F.col("n") == len(set(terms))).select("id", "score")
    if adjacent is not None and docs is not None:
        has = docs.where(F.lower(F.col(content_col)).contains(adjacent.lower())).select(F.col(id_col).alias("id"))
        hit = hit.join(has, "id", "left_semi")
    out = hit.orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return out if k is None else out.limit(k)


def search(index: DataFrame, query: str, n_docs: int, *, k: int = 10, fuzzy: int = 0, is_phrase: bool = False, synonyms: bool = True) -> DataFrame:
    terms = T.query_tokens(query, synonyms)
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    return phrase(index, terms, k=k) if is_phrase else bm25(index, terms, n_docs, k=k, fuzzy=fuzzy)


def rrf(lists: list[DataFrame], k: int | None = None, constant: int = 60, per_doc: int | None = None, doc_of: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of top-k lists (id, score).

    `per_doc` keeps as many of each document after the cut; doc_of is (id, doc_id).
    """
    total = None
    for r in lists:
        # a list is the top of a search, so it ranks in one task
        rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.asc_nulls_last("id")))
        part = r.select("id", "score").withColumn("s", F.lit(1.0) / (F.lit(constant) + rank)).select("id", "s")
        total = part if total is None else total.unionByName(part)
    out = total.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = out if k is None else out.limit(k)
    if per_doc is not None and doc_of is not None:
        ranked = out.join(doc_of, "id").withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))))
        out = ranked.where(F.col("_r") <= per_doc).drop("_r")
    return out


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Fused; where one side is empty, the other as it is.  Both lists are tops of searches, each run once."""
    both = vector_hits.select("id", "score", F.lit(0).alias("side")).unionByName(text_hits.select("id", "score", F.lit(1).alias("side")))
    every = W.partitionBy(F.lit(1))
    rank = F.row_number().over(W.partitionBy("side").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    d = both.withColumn("s", 1.0 / (F.lit(constant) + rank)).withColumn("sides", F.max("side").over(every) - F.min("side").over(every))
    d = d.groupBy("id").agg(F.sum("s").alias("fused"), F.max("score").alias("own"), F.max("sides").alias("sides"))
    return d.select("id", F.when(F.col("sides") > 0, F.col("fused")).otherwise(F.col("own")).alias("score")).orderBy(F.desc("score"), F.asc_nulls_last("id")).limit(k)


def rerank_bm25(candidates: DataFrame, terms: list[str], content_col: str = "content") -> DataFrame:
    """Half the old score and half a BM25 over the candidates alone, by substring counts; best first."""
    every = W.partitionBy(F.lit(1))
    low = F.lower(F.coalesce(F.col(content_col), F.lit("")))
    d = candidates.withColumn("_len", F.octet_length(F.col(content_col)).cast("double")).withColumn("_n", F.count("*").over(every)).withColumn("_avg", F.avg("_len").over(every))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = (F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / F.lit(float(len(t)))
        d = d.withColumn(f"_tf{i}", tf)
        found = F.greatest(F.count_if(F.col(f"_tf{i}") > 0).over(every), F.lit(1))
        d = d.withColumn(f"_idf{i}", F.log((F.col("_n") - found + 1) / found + 1))
        norm = F.col(f"_tf{i}") + 1.2 * (0.25 + 0.75 * F.coalesce(F.try_divide(F.col("_len"), F.col("_avg")), F.lit(0.0)))
        score = score + F.col(f"_idf{i}") * F.col(f"_tf{i}") * 2.2 / norm
    d = d.withColumn("score", 0.5 * F.col("score") + 0.5 * score)
    return d.orderBy(F.desc("score"), *([F.col("id")] if "id" in candidates.columns else [])).select(*candidates.columns)


def rerank_cosine(candidates: DataFrame, query: str, content_col: str = "content") -> DataFrame:
    """The cosine of the token sets in place of the score."""
    q = F.array(*[F.lit(t) for t in T.query_tokens(query)])
    tokens = T.tokenize(F.col(content_col))
    value = F.try_divide(F.size(F.array_intersect(q, tokens)).cast("double"), F.sqrt(F.size(q).cast("double") * F.size(tokens)))
    return candidates.withColumn("score", F.coalesce(value, F.lit(0.0)))


class TextIndex:
    """Stored postings: the terms are dealt to PARTS folders by their hash and sorted within, so that a query
    reads the folders of its terms and, by the files' statistics, little else.  The ids of all indexed documents
    are a table beside them.  Adding writes new files alone; removing writes the touched folders anew."""

    PARTS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def part(term) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(TextIndex.PARTS)).cast("int")

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        """By part and term; a part too large for a task's memory goes to several, each with a file of its own."""
        return rows.hint("rebalance", F.col("part")).sortWithinPartitions("part", "term")

    def _write(self, name: str, rows: DataFrame, how: str) -> None:
        self._dealt(rows.withColumn("part", self.part(F.col("term")))).write.partitionBy("part").mode(how).parquet(f"{self.path}/{name}")

    def build(self, docs: DataFrame) -> TextIndex:
        """The index of (id, content) in place of what there is."""
        self._write("postings", postings(docs), "overwrite")
        docs.select("id").write.mode("overwrite").parquet(f"{self.path}/documents")
        return self

    def index(self, docs: DataFrame) -> None:
        """Further documents; one that is indexed already is replaced."""
        docs = cut(docs.select("id", "content"))
        self.unindex(docs.select("id"))
        self._write("postings", postings(docs), "append")
        docs.select("id").write.mode("append").parquet(f"{self.path}/documents")

    def unindex(self, ids: DataFrame) -> None:
        """Without these documents.  Only the parts that hold one of their terms are written anew."""
        have = self.spark.read.parquet(f"{self.path}/documents")
        gone = cut(ids.select("id").distinct().join(have, "id", "left_semi"))
        if gone.isEmpty():
            return
        old = self.spark.read.parquet(f"{self.path}/postings")
        touched = [r["part"] for r in old.join(gone, "id", "left_semi").select("part").distinct().collect()]
        left = cut(old.where(F.col("part").isin(touched)).join(gone, "id", "left_anti"))
        (self._dealt(left).write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/postings"))
        kept = {r["part"] for r in left.select("part").distinct().collect()}
        jvm = self.spark.sparkContext._jvm
        for n in set(touched) - kept:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings/part={n}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        cut(have.join(gone, "id", "left_anti")).write.mode("overwrite").parquet(f"{self.path}/documents")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(id, term, tf); with terms, only the folders that can hold one of them are read."""
        rows = self.spark.read.parquet(f"{self.path}/postings")
        if terms is not None:
            parts = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self.part(F.col("term"))).collect()}) if terms else []
            rows = rows.where(F.col("part").isin(parts) & F.col("term").isin(terms))
        return rows.select("id", "term", "tf")

    def n_docs(self) -> int:
        """Out of the files' footers."""
        return self.spark.read.parquet(f"{self.path}/documents").count()

    def search(self, query: str, *, k: int = 10, fuzzy: int = 0, is_phrase: bool = False, synonyms: bool = True) -> DataFrame:
        terms = T.query_tokens(query, synonyms)
        whole = fuzzy > 0 or (len(terms) == 1 and terms[0].startswith("*:"))
        return search(self.postings(None if whole else terms), query, self.n_docs(), k=k, fuzzy=fuzzy, is_phrase=is_phrase, synonyms=synonyms)


class Scan:
    """Searches of documents (id, content) that have no stored index: each reads all texts once and keeps the
    postings of its terms.  For one search that moves and writes far less than an index of all terms would."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def search(self, query: str, *, k: int = 10, fuzzy: int = 0, is_phrase: bool = False, synonyms: bool = True) -> DataFrame:
        hits = postings_of(self.docs, T.query_tokens(query, synonyms), 0 if is_phrase else fuzzy)
        return search(hits, query, self.docs.count(), k=k, fuzzy=fuzzy, is_phrase=is_phrase, synonyms=synonyms)
