"""Knowledge and memories: chunks, search, ranking by several signals, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import scalars as S
from loamgraph.functions import text as T
from loamgraph.functions import vectors as V
from loamgraph.operators import fulltext


def chunks(docs: DataFrame, id_col: str = "id", content_col: str = "content", size: int = 500, overlap: int = 125) -> DataFrame:
    """(knowledge_id, chunk_no, start, end, content)."""
    cut = T.chunker(size, overlap)
    d = docs.select(F.col(id_col).alias("knowledge_id"), F.explode(cut(F.col(content_col))).alias("c"))
    return d.select("knowledge_id", "c.*")


def save_knowledge(old: DataFrame, new: DataFrame) -> DataFrame:
    """`new` in place of rows of the same id, one version up, metadata and creation time merged."""
    o = old.select("id", F.col("version").alias("_v"), F.col("created_at").alias("_c"), F.col("metadata").alias("_m"))
    keep = F.map_filter(F.coalesce("_m", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("metadata", k), F.lit(False)))
    merged = new.join(o, "id", "left").withColumn("version", F.coalesce(F.col("_v") + 1, F.lit(1))).withColumn("created_at", F.coalesce("_c", "created_at"))
    merged = merged.withColumn("metadata", F.map_concat(keep, F.coalesce("metadata", F.create_map().cast("map<string,string>")))).drop("_v", "_c", "_m")
    return old.join(new.select("id"), "id", "left_anti").unionByName(merged.select(*old.columns))


def update(rows: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the non-null values of the patch of their key in place of their own; maps are merged, the patch's
    entries first; patches of unknown keys change nothing."""
    names = [c for c in patch.columns if c != key]
    p = patch.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_p_{c}") for c in names])
    kinds = dict(rows.dtypes)

    def value(c: str) -> Column:
        if c not in names:
            return F.col(c)
        if kinds[c].startswith("map<"):
            mine = F.map_filter(F.col(c), lambda k, v: ~F.coalesce(F.map_contains_key(f"_p_{c}", k), F.lit(False)))
            return F.when(F.col(f"_p_{c}").isNull(), F.col(c)).when(F.col(c).isNull(), F.col(f"_p_{c}")).otherwise(F.map_concat(mine, f"_p_{c}"))
        return F.coalesce(F.col(f"_p_{c}"), F.col(c))

    return rows.join(p, key, "left").select(*[value(c).alias(c) for c in rows.columns])


def search_knowledge(chunk_postings: DataFrame, pieces: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(knowledge_id, score, snippet, chunk_nos): score is the number of (term, chunk) matches.

    Postings are (id: struct knowledge_id, chunk_no; term; tf); the snippet is the first matched chunk.
    Chunks of no id have no text to be joined with, so they take none of the k places.
    """
    terms = T.query_tokens(query)
    hit = chunk_postings.where(F.col("term").isin(terms) & F.col("id.knowledge_id").isNotNull()).select("id.knowledge_id", "id.chunk_no")
    best = hit.groupBy("knowledge_id").agg(F.count("*").alias("score"), F.min("chunk_no").alias("chunk_no"), F.sort_array(F.collect_set("chunk_no")).alias("chunk_nos"))
    # the k best, whose number is bounded, go to the chunks
    best = F.broadcast(best.orderBy(F.desc("score"), "knowledge_id").limit(k))
    text = pieces.select("knowledge_id", "chunk_no", T.truncate(F.col("content"), 200).alias("snippet"))
    return text.join(best, ["knowledge_id", "chunk_no"]).select("knowledge_id", "score", "snippet", "chunk_nos")


def latest(rows: DataFrame, key: str = "id", time: str = "updated_at", then: str | None = None) -> DataFrame:
    """The last written row of each key, of equal times the one of the largest `then`; combined before the shuffle."""
    order = F.struct(F.col(time).isNotNull(), F.col(time), F.col(then) if then else F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]))
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return best.select("_row.*")


def alive(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (expires_at >= now)


def sweep(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(alive(F.col("expires_at"), now))


def bucket_of(scope: str = "", user_id: str = "", session_id: str = "", namespace: str = "") -> tuple[str, str, str]:
    """(scope, owner, namespace).  Without a scope it is the session's, else the user's, else everybody's."""
    scope, namespace = scope.strip().lower(), namespace or "default"
    if not scope:
        scope = "session" if session_id.strip() else "user" if user_id.strip() else "global"
    if scope not in ("global", "user", "session"):
        raise ValueError(f"unsupported memory scope: {scope}")
    owner = {"global": "", "user": user_id, "session": session_id}[scope]
    if scope != "global" and not owner.strip():
        raise ValueError(f"{scope}_id is required for {scope} scope")
    return scope, owner, namespace


def bucket(rows: DataFrame, scope: str = "", user_id: str = "", session_id: str = "", namespace: str = "") -> DataFrame:
    """The memories of one bucket, out of rows with scope, user_id, session_id and namespace."""
    scope, owner, namespace = bucket_of(scope, user_id, session_id, namespace)
    mine = (F.col("scope") == scope) & (F.coalesce("namespace", F.lit("default")) == namespace)
    return rows.where(mine if scope == "global" else mine & (F.col(f"{scope}_id") == owner))


def search_memory(
    memories: DataFrame, now: Column, *, query: str = "", vector: Sequence[float] | None = None, k: int = 5, weights: tuple[float, float, float, float] = (0, 0, 0, 0), half_life_hours: float = 168.0
) -> DataFrame:
    """(id, semantic, lexical, importance, recency, score) of one bucket's memories, best first.

    Expired rows still count in the document numbers and in the largest lexical score, and go after that.
    """
    terms = T.query_tokens(query)
    if not terms and vector is None:
        return memories.select("id", *[F.lit(0.0).alias(c) for c in ("semantic", "lexical", "importance", "recency", "score")]).limit(0)
    base = memories.select("id", "importance", "updated_at", "created_at", "expires_at", *(["vector"] if vector is not None else []))
    if vector is not None:
        sim = V.cosine(F.col("vector"), V.literal(vector))
        top = memories.select("id", sim.alias("semantic")).where("semantic > 0").orderBy(F.desc("semantic"), "id").limit(4 * k)
    else:
        top = memories.select("id", F.lit(0.0).alias("semantic")).limit(0)
    if terms:
        found = fulltext.bm25(fulltext.postings(memories), terms, memories.count())
        # one row, whatever the data
        words = found.crossJoin(F.broadcast(found.agg(F.max("score").alias("_most")))).select("id", (F.col("score") / F.col("_most")).alias("lexical"))
    else:
        words = memories.select("id", F.lit(0.0).alias("lexical")).limit(0)
    joined = top.join(words, "id", "full").join(base, "id").where(alive(F.col("expires_at"), now))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = joined.select(
        "id", zero("semantic").alias("semantic"), zero("lexical").alias("lexical"), S.clamp01(zero("importance")).alias("importance"),
        S.recency(F.col("updated_at"), F.col("created_at"), now, half_life_hours).alias("recency"),
    )
    out = out.withColumn("score", S.weighted(F.col("semantic"), F.col("lexical"), F.col("importance"), F.col("recency"), weights))
    return out.orderBy(F.desc("score"), "id").limit(k)


def history(messages: DataFrame, n: int, session: str = "session_id", order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """The last n messages of each session."""
    last = W.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")


def episodes(turns: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
    """exchanges() as memories (id, session_id, role, content): the id is episode:<session>:<number>."""
    x = exchanges(turns, session, order)
    return x.select(F.concat(F.lit("episode:"), F.col(session).cast("string"), F.lit(":"), F.col("exchange").cast("string")).alias("id"), F.col(session).cast("string").alias("session_id"), F.lit("episode").alias("role"), "content")


def exchanges(turns: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
    """(session, exchange, content, n): turns up to each answer that is not alone, as "[role] text" lines.

    The state "an answer ends an exchange of two or more" depends on one turn before: a turn opens an
    exchange if it is the first or follows a closing answer, and an answer closes unless it opens one.
    """
    w = W.partitionBy(session).orderBy(order)
    d = turns.withColumn("_answer", F.col("role") == "assistant").withColumn("_n", F.row_number().over(w))
    # within a run of answers only the first can close; every later one opens an exchange of its own
    run = d.withColumn("_prev", F.coalesce(F.lag("_answer").over(w), F.lit(False)))
    run = run.withColumn("_run", F.sum(F.when(F.col("_answer") & F.col("_prev"), 0).otherwise(1)).over(w))
    at = W.partitionBy(session, "_run").orderBy(order)
    run = run.withColumn("_i", F.row_number().over(at))
    first_alone = F.min(F.when(F.col("_n") == 1, 1).otherwise(2)).over(W.partitionBy(session, "_run"))
    # the first answer closes if it has company; answers after it pair up
    closes = F.col("_answer") & F.when(first_alone == 1, F.col("_i") % 2 == 0).otherwise(F.col("_i") % 2 == 1)
    marked = run.withColumn("_closes", closes)
    ident = F.coalesce(F.sum(F.col("_closes").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("] "), F.coalesce("text", F.lit("")))
    grouped = marked.withColumn("exchange", ident).groupBy(session, "exchange").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("x"))
    return grouped.select(session, F.col("exchange").cast("int").alias("exchange"), F.array_join("x.line", "\n").alias("content"), F.size("x").alias("n"))


def facts(rows: DataFrame, session: str = "session_id", content_col: str = "content", kinds: Sequence[str] = ("decision", "preference", "milestone", "problem")) -> DataFrame:
    """(session, kind, sentence, fact_id): sentences worth keeping, each once."""
    s = rows.select(session, F.explode(T.sentences(F.col(content_col))).alias("sentence")).withColumn("kind", T.classify_sentence(F.col("sentence")))
    s = s.where(F.col("kind").isin(*kinds)).withColumn("_low", F.lower("sentence"))
    first = s.groupBy(session, "kind", "_low").agg(F.min("sentence").alias("sentence"))
    return first.select(session, "kind", "sentence", F.substring(F.sha2(F.concat_ws("|", "kind", "_low"), 256), 1, 16).alias("fact_id"))
