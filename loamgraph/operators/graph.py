"""Property graph: nodes (id, type) and edges (id, from_id, to_id, type, weight)."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.sources.store import cut


def upsert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    new = new.dropDuplicates([key])
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and without the edges at them."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def directed(edges: DataFrame, direction: str = "out", types: Sequence[str] | None = None) -> DataFrame:
    """(src, dst, id, type, side): each edge as seen from its start; "both" adds it from its other end."""
    e = edges if not types else edges.where(F.col("type").isin(*types))
    out = e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "id", "type", F.lit(0).alias("side"))
    back = e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "id", "type", F.lit(1).alias("side"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbors(edges: DataFrame, start: DataFrame, direction: str = "out", types: Sequence[str] | None = None, limit: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, id, type) of all start ids at once; `limit` counts edges of each, by type and id."""
    e = directed(edges, direction, types).join(start.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    if limit is not None:
        order = W.partitionBy("src").orderBy("side", "type", "id")
        e = e.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
    if nodes is not None:
        e = e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.select("src", "dst", "id", "type")


def bfs(edges: DataFrame, start: Sequence, max_depth: int = 3, direction: str = "out", types: Sequence[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(id, depth) of what is reached, without the start.

    One join for each level: the frontier meets the edges, and what was seen before is taken away.
    Every level is checkpointed, so a plan never grows with the depth and a level is computed once.
    """
    spark = edges.sparkSession
    hop = directed(edges, direction, types).select("src", "dst").distinct()
    if nodes is not None:
        hop = hop.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    if max_depth > 1:
        hop = cut(hop)
    kind = dict(edges.dtypes)["from_id"]
    seen = spark.createDataFrame([(s,) for s in start], f"id {kind}").withColumn("depth", F.lit(0))
    frontier = seen.select("id")
    for depth in range(1, max_depth + 1):
        step = frontier.join(hop, frontier["id"] == hop["src"]).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        step = step.withColumn("depth", F.lit(depth))
        if depth < max_depth:
            step = cut(step)
            if step.isEmpty():
                break
        seen, frontier = seen.unionByName(step), step.select("id")
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, source, target, max_depth: int | None = None) -> tuple[list, list] | None:
    """Nodes and edges of a path with the fewest hops along the edges' direction, or None; of several the one
    whose edges are first by (type, id), from the source on.

    A level is one join and one action: it keeps one row for each node, with the way to it.  The search ends at
    the target or where nothing new is reached, however far that is.
    """
    if source == target:
        return [source], []
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["from_id"]
    hop = edges.select("from_id", "to_id", F.coalesce("type", F.lit("")).alias("type"), F.col("id").cast("string").alias("edge"))
    seen = spark.createDataFrame([(source,)], f"id {kind}")
    way = seen.select("id", F.array("id").alias("nodes"), F.array().cast("array<struct<type:string,edge:string>>").alias("path"))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = way.join(hop, way["id"] == hop["from_id"]).join(seen.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        path = F.concat("path", F.array(F.struct("type", "edge")))
        step = step.select(F.col("to_id").alias("id"), F.concat("nodes", F.array("to_id")).alias("nodes"), path.alias("path"))
        way = cut(step.groupBy("id").agg(F.min_by("nodes", "path").alias("nodes"), F.min("path").alias("path")))
        found = way.agg(F.count("*").alias("n"), F.max(F.when(F.col("id") == target, F.struct("nodes", "path"))).alias("hit")).first()
        if found["hit"] is not None:
            return list(found["hit"]["nodes"]), [x["edge"] for x in found["hit"]["path"]]
        if not found["n"]:
            return None
        seen = seen.unionByName(way.select("id"))
    return None


def dfs(edges: DataFrame, start, max_depth: int = 3, types: Sequence[str] | None = None, most: int = 1_000_000) -> list:
    """Preorder from the start, each node once.  The order is sequential by nature, so the edges within
    reach, and no others, come to the driver; more than `most` of them are an error."""
    near = bfs(edges, [start], max_depth, types=types).select("id").unionByName(edges.sparkSession.createDataFrame([(start,)], f"id {dict(edges.dtypes)['from_id']}"))
    e = cut(neighbors(edges, near, types=types))
    if (n := e.count()) > most:
        raise ValueError(f"{n} edges are in reach, more than {most}")
    e = e.orderBy("src", "type", "id").collect()
    below: dict = {}
    for r in e:
        below.setdefault(r["src"], []).append(r["dst"])
    out, seen, stack = [], set(), [(start, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append(node)
        if depth < max_depth:
            stack.extend((n, depth + 1) for n in reversed(below.get(node, [])))
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree)."""
    ends = edges.select(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def analyze(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density, isolated; nodes count once for each id."""
    n = nodes.select("id").distinct()
    counts = n.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    alone = n.join(degrees(edges), "id", "left_anti").agg(F.count("*").alias("isolated"))
    density = F.coalesce(F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)), F.lit(0.0))
    return counts.crossJoin(alone).select("n_nodes", "n_edges", density.alias("density"), "isolated")


def type_counts(nodes: DataFrame) -> DataFrame:
    """Occurrences, not distinct ids."""
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def top_nodes(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of the largest degree."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def report(nodes: DataFrame, edges: DataFrame, style: str = "text", k: int = 10) -> str:
    """Counts, types and most connected nodes as text, Markdown or HTML."""
    if style not in ("text", "markdown", "html"):
        raise ValueError(f"no such format: {style}")
    a = analyze(nodes, edges).first()
    head = [f"Nodes: {a['n_nodes']}", f"Edges: {a['n_edges']}", f"Density: {a['density']:.4f}", f"Isolated: {a['isolated']}"]
    kinds = [("Node types", [f"{r['type']}: {r['n']}" for r in type_counts(nodes).orderBy("type").collect()]), ("Edge types", [f"{r['type']}: {r['n']}" for r in type_counts(edges).orderBy("type").collect()])]
    top = [f"{r['id']} ({r['degree']})" for r in top_nodes(edges, k).collect()]
    parts = [("Graph report", head), *kinds, ("Most connected", top)]
    if style == "markdown":
        return "\n\n".join("#" * min(i + 1, 2) + f" {title}\n\n" + "\n".join(f"- {x}" for x in lines) for i, (title, lines) in enumerate(parts))
    if style == "html":
        safe = lambda x: html.escape(str(x))
        return "".join(f"<h{min(i + 1, 2)}>{safe(title)}</h{min(i + 1, 2)}><ul>{''.join(f'<li>{safe(x)}</li>' for x in lines)}</ul>" for i, (title, lines) in enumerate(parts))
    return "\n".join(x for title, lines in parts for x in (title, *lines))


_STRIP = r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$"


def extract_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, name): words of over two bytes that begin with an ASCII capital, punctuation off."""
    w = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")).alias("pos", "word"))
    w = w.withColumn("name", F.regexp_replace("word", _STRIP, ""))
    return w.where((F.octet_length("word") > 2) & F.col("word").rlike("^[A-Z]") & (F.octet_length("name") >= 2)).select("doc_id", "pos", "name")


def co_occurrence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, from_id, to_id, weight) of neighbouring entities; any other word between breaks the pair."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")).alias("pos", "word"))
    words = words.where("word <> ''").withColumn("name", F.regexp_replace("word", _STRIP, ""))
    opens = (F.octet_length("word") > 2) & F.col("word").rlike("^[A-Z]") & (F.octet_length("name") >= 2)
    # a word counts as an entity wherever its document names it so at least once
    known = F.max(opens).over(W.partitionBy("doc_id", "name"))
    node = F.when(known, F.concat(F.lit("node:"), F.lower("name")))
    d = words.withColumn("node", node).withColumn("prev", F.lag("node").over(W.partitionBy("doc_id").orderBy("pos")))
    pairs = d.where("prev is not null and node is not null and prev <> node")
    return pairs.groupBy("doc_id", F.col("prev").alias("from_id"), F.col("node").alias("to_id")).agg(F.count("*").alias("weight"))


def build(nodes: DataFrame, edges: DataFrame, min_weight: float = 0.0, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each id once, the first by the column `order` where one is named, and edges of at least the least weight."""
    e = edges if min_weight <= 0 else edges.where(F.col("weight") >= min_weight)

    def first(rows: DataFrame) -> DataFrame:
        if order is None:
            return rows.dropDuplicates(["id"])
        return rows.groupBy(F.col("id").alias("_id")).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")

    return first(nodes), first(e)


def validate_extraction(document_id: str, nodes: list) -> None:
    """An extraction names its document and has at least one node."""
    if not document_id or not document_id.strip():
        raise ValueError("an extraction needs a document id")
    if not nodes:
        raise ValueError("an extraction needs at least one node")


_EXTRACTED = "doc_id string, node_id string, name string, kind string, from_id string, to_id string, relation string, weight double"


def extract_with(docs: DataFrame, generate, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an injected extractor: generate(text) gives entities (name, kind) and relations
    (from, to, kind).  Each document is a node that mentions its entities; ids occur once."""

    def run(batches):
        for batch in batches:
            out = []
            for d, text in zip(batch[id_col].astype(str), batch[text_col], strict=True):
                entities, relations = generate(text or "")
                doc = f"doc:{d}"
                ident = lambda name: f"node:{name.strip().lower()}"
                validate_extraction(d, [doc, *entities])
                out.append((d, doc, d, "document", None, None, None, None))
                for name, kind in entities:
                    out.append((d, ident(name), name, kind, None, None, None, None))
                    out.append((d, None, None, None, doc, ident(name), "mentions", 1.0))
                out.extend((d, None, None, None, ident(a), ident(b), kind, 1.0) for a, b, kind in relations)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _EXTRACTED.split(", ")])

    rows = cut(docs.select(id_col, text_col).mapInPandas(run, _EXTRACTED))
    nodes = rows.where("node_id is not null").groupBy(F.col("node_id").alias("id")).agg(F.min("name").alias("name"), F.min("kind").alias("type"))
    edge = rows.where("from_id is not null").groupBy("from_id", "to_id", F.col("relation").alias("type")).agg(F.max("weight").alias("weight"))
    return nodes, edge.withColumn("id", F.concat_ws(":", "from_id", "type", "to_id"))
