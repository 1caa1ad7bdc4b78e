"""Memories and knowledge as one service: saving, recall, reflection, sessions and the tools that call them.

Tables are read and written as DataFrames; only the best k hits of a search, whose number the caller sets,
come to the driver, where context and summaries are put together.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import fulltext, graph, memory
from loamgraph.sources.store import Engine, cut

MEMORIES, KNOWLEDGE, CONTEXT_BYTES, GRAPH_NODES = 5, 4, 1200, 50
FACTS, THEMES, SUMMARY_BYTES = 6, 6, 320


@dataclass
class Context:
    """What a recall found, packed for a prompt."""

    query: str
    memories: list = field(default_factory=list)
    knowledge: list = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    chunk_ids: list[str] = field(default_factory=list)
    graph: str = ""
    text: str = ""


def memory_lines(memories: Iterable, most_items: int, most_bytes: int) -> str:
    """Lines "[id] content" of the first memories, the last of them clipped, in at most so many bytes."""
    lines, used = [], 0
    for m in list(memories)[:most_items]:
        line = f"[{m['id']}] {(m['content'] or '').strip()}"
        if most_bytes > 0 and used + len(line.encode()) > most_bytes:
            if most_bytes <= used:
                break
            line = T.clip(line, most_bytes - used)
        lines.append(line)
        used += len(line.encode())
        if 0 < most_bytes <= used:
            break
    return "\n".join(lines).strip()


def pack(query: str, memories: list, knowledge: list, entities: Iterable[str] = (), most_items: int = MEMORIES, most_bytes: int = CONTEXT_BYTES) -> Context:
    """Sections of memories and of knowledge with their sources."""
    found = T.distinct([*entities, *(n for m in memories for n in T.names_in(m["content"] or "")), *(n for k in knowledge for n in [*(k["entities"] or []), *T.names_in(k["title"] or ""), *T.names_in(k["snippet"] or "")])])
    chunk_ids = [f"{k['knowledge_id']}#{n}" for k in knowledge for n in k["chunk_nos"]]
    known = "\n".join(f"[{k['knowledge_id']}] {k['snippet'] or k['title']}" for k in knowledge if k["snippet"] or k["title"])
    sections = [("MEMORIES", memory_lines(memories, most_items, most_bytes)), ("KNOWLEDGE", known if chunk_ids else "")]
    text = "\n\n".join(f"[{name}]\n{body.strip()}" for name, body in sections if body.strip())
    return Context(query, memories, knowledge, found, T.distinct(chunk_ids), "", text)


def reflect(c: Context, instructions: str = "", facts: int = FACTS, themes: int = THEMES, most_bytes: int = SUMMARY_BYTES) -> dict:
    """A reflection by rule: the first hits as facts, their clipped sequence as summary, entities and keywords as themes."""
    said = [(T.compact_snippet(m["content"] or ""), m["id"], None) for m in c.memories]
    said += [(T.compact_snippet(k["snippet"] or k["title"] or ""), None, k["knowledge_id"]) for k in c.knowledge]
    said = said[:facts]
    lines = [x for x, _, _ in said if x] or ([T.compact_snippet(c.text)] if c.text.strip() else [])
    return {
        "summary": T.clip(" ".join(lines).strip(), most_bytes),
        "facts": lines,
        "themes": T.distinct([*c.entities, *T.keyword_list(c.query), *T.keyword_list(instructions)])[:themes],
        "entities": c.entities,
        "memory_ids": T.distinct([m["id"] for m in c.memories]),
        "knowledge_ids": T.distinct([k["knowledge_id"] for k in c.knowledge]),
        "chunk_ids": c.chunk_ids,
    }


def plan(query: str, user_id: str = "", session_id: str = "") -> dict:
    """The default plan of a query: its words, asked of vectors and of text."""
    return {"query": query, "keywords": T.keyword_list(query), "entities": [], "mode": "hybrid", "user_id": user_id, "session_id": session_id}


@dataclass
class Strategy:
    """Fills in namespace, keywords, entities and mode of a recall that leaves them open."""

    bank: str = ""
    namespace: str = ""
    keywords: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    mode: str = ""
    use_graph: bool = False

    def enrich(self, asked: dict, tags: Iterable[str] = (), state_namespace: str = "") -> dict:
        out = dict(asked)
        own = self.namespace.strip() or (f"hindsight:{T.bank_id(self.bank)}" if self.bank.strip() else "")
        out["namespace"] = (out.get("namespace") or "").strip() or own
        out["keywords"] = T.merge_distinct(out.get("keywords", []), self.keywords, tags, [self.bank], [state_namespace])
        out["entities"] = T.merge_distinct(out.get("entities", []), self.entities)
        out["mode"] = self.mode or ("graph" if self.use_graph and out["entities"] else out.get("mode") or "lexical")
        return out


class Service:
    """One engine with its memories and its knowledge; embed, where given, makes a Column of vectors of one of texts."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[Column], Column] | None = None, reflector: Callable | None = None, extractor: Callable | None = None, policy: Callable | None = None, strategy: Strategy | None = None):
        self.spark, self.engine, self.embed = spark, Engine(spark, root), embed
        self.reflector, self.extractor, self.policy, self.strategy = reflector, extractor, policy, strategy
        self.tools = {
            "search_knowledge": self._tool_search_knowledge, "save_knowledge": self._tool_save_knowledge, "search_memory": self._tool_search_memory, "save_memory": self._tool_save_memory,
            "expand_graph": self._tool_expand_graph, "recall_knowledge_memory": self._tool_recall, "reflect": self._tool_reflect, "consolidate": self._tool_consolidate, "build_context": self._tool_context,
        }

    # --- memories

    def save_memories(self, rows: DataFrame) -> None:
        """Rows of `memories`; each counts in its bucket, the last written of an id stays, a text without a vector gets one."""
        now = F.current_timestamp()
        rows = self.engine._fit("memories", rows).withColumn("namespace", F.coalesce(F.when(F.col("namespace") != "", F.col("namespace")), F.lit("default")))
        default = F.when(F.coalesce("session_id", F.lit("")) != "", "session").when(F.coalesce("user_id", F.lit("")) != "", "user").otherwise("global")
        rows = rows.withColumn("scope", F.coalesce(F.when(F.trim("scope") != "", F.lower(F.trim("scope"))), default))
        if self.embed is not None:
            rows = rows.withColumn("vector", F.coalesce("vector", self.embed(F.col("content"))))
        rows = rows.withColumn("updated_at", F.coalesce("updated_at", now)).withColumn("created_at", F.coalesce("created_at", now))
        ends = F.when(F.col("ttl_seconds") > 0, F.timestamp_seconds(F.unix_micros("updated_at") / 1e6 + F.col("ttl_seconds")))
        rows = rows.withColumn("expires_at", F.coalesce("expires_at", ends))
        owner = F.when(F.col("scope") == "user", F.col("user_id")).when(F.col("scope") == "session", F.col("session_id")).when(F.col("scope") == "global", F.lit("-"))
        rows = cut(rows.withColumn("_bad", F.coalesce(owner, F.lit("")) == ""))
        if not rows.where("_bad").isEmpty():
            raise ValueError("a memory's scope is unknown or lacks its owner")
        old = self.engine.read("memories").select("id", F.col("created_at").alias("_c"))
        rows = rows.join(old, "id", "left").withColumn("created_at", F.coalesce("_c", "created_at"))
        self.engine.upsert("memories", rows)

    def remember(self, memory_id: str, content: str, **columns) -> None:
        names = ["id", "content", *columns]
        kinds = {f.name: f.dataType.simpleString() for f in self.engine.read("memories").schema.fields}
        self.save_memories(self.spark.createDataFrame([(memory_id, content, *columns.values())], ", ".join(f"{n} {kinds[n]}" for n in names)))

    def update_memories(self, patch: DataFrame) -> None:
        rows = memory.update(self.engine.read("memories"), patch)
        if self.embed is not None and "content" in patch.columns:
            changed = patch.where("content is not null").select("id", F.lit(True).alias("_new"))
            rows = rows.join(changed, "id", "left").withColumn("vector", F.when(F.col("_new"), self.embed(F.col("content"))).otherwise(F.col("vector")))
        self.engine.replace("memories", rows)

    def delete_memory(self, memory_id: str) -> None:
        self.engine.delete("memories", F.col("id") == memory_id)

    def sweep(self, now: Column | None = None) -> None:
        self.engine.replace("memories", memory.sweep(self.engine.read("memories"), now if now is not None else F.current_timestamp()))

    def search_memory(self, query: str, *, scope: str = "", user_id: str = "", session_id: str = "", namespace: str = "", k: int = MEMORIES, now: Column | None = None, **ranking) -> DataFrame:
        """Hits (id, semantic, lexical, importance, recency, score, content) of one bucket, best first."""
        rows = memory.bucket(self.engine.read("memories"), scope, user_id, session_id, namespace)
        vector = None
        if self.embed is not None and query:
            vector = self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first()["v"]
        hits = memory.search_memory(rows, now if now is not None else F.current_timestamp(), query=query, vector=vector, k=k if k > 0 else MEMORIES, **ranking)
        return rows.select("id", "content", "scope").join(F.broadcast(hits), "id").orderBy(F.desc("score"), "id")

    # --- knowledge

    def save_knowledge(self, rows: DataFrame, size: int = 500, overlap: int = 125) -> None:
        """Rows of `knowledge`: a version up where the id is there, cut into chunks anew."""
        now = F.current_timestamp()
        new = self.engine._fit("knowledge", rows).withColumn("collection", F.coalesce("collection", F.lit("default"))).withColumn("created_at", F.coalesce("created_at", now)).withColumn("updated_at", now)
        new = cut(new)
        self.engine.replace("knowledge", memory.save_knowledge(self.engine.read("knowledge"), new))
        pieces = memory.chunks(new, size=size, overlap=overlap).join(new.select(F.col("id").alias("knowledge_id"), "collection"), "knowledge_id")
        pieces = pieces.select(F.concat_ws("#", "knowledge_id", "chunk_no").alias("id"), "knowledge_id", "collection", "chunk_no", "content")
        left = self.engine.read("chunks").join(new.select(F.col("id").alias("knowledge_id")), "knowledge_id", "left_anti")
        self.engine.replace("chunks", left.unionByName(pieces))

    def update_knowledge(self, patch: DataFrame) -> None:
        """Patched rows are saved anew, with their next version and new chunks."""
        have = self.engine.read("knowledge").join(patch.select("id"), "id", "left_semi")
        self.save_knowledge(memory.update(have, patch))

    def knowledge(self, knowledge_id: str) -> DataFrame:
        """The row with the ids of its chunks in order."""
        ids = self.engine.read("chunks").where(F.col("knowledge_id") == knowledge_id).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "id")))["id"].alias("chunk_ids"))
        return self.engine.get("knowledge", knowledge_id).crossJoin(F.broadcast(ids))

    def delete_knowledge(self, knowledge_id: str) -> None:
        self.engine.delete("knowledge", F.col("id") == knowledge_id)
        self.engine.delete("chunks", F.col("knowledge_id") == knowledge_id)

    def search_knowledge(self, query: str, collection: str = "default", k: int = 10) -> DataFrame:
        pieces = self.engine.read("chunks").where(F.col("collection") == collection)
        index = fulltext.postings(pieces.select(F.struct("knowledge_id", "chunk_no").alias("id"), "content"))
        hits = memory.search_knowledge(index, pieces, query, k)
        about = self.engine.read("knowledge").select(F.col("id").alias("knowledge_id"), "title", "entities")
        return about.join(F.broadcast(hits), "knowledge_id").orderBy(F.desc("score"), "knowledge_id")

    # --- recall

    def recall(self, query: str = "", *, entities: Iterable[str] = (), collection: str = "default", memories: int = MEMORIES, knowledge: int = KNOWLEDGE, most_bytes: int = CONTEXT_BYTES, hops: int = 0, now: Column | None = None, **bucket) -> Context:
        """Memories and knowledge for a query, or for entities where there is none, with the entities' neighbourhood."""
        entities = list(entities)
        query = query.strip() or " ".join(entities)
        if not query:
            raise ValueError("there is nothing to recall by")
        m = self.search_memory(query, k=memories, now=now, **bucket).collect()
        c = pack(query, m, self.search_knowledge(query, collection, knowledge).collect(), entities, memories, most_bytes)
        if hops > 0 and c.entities:
            c.graph = self.expand(["entity:" + x for x in c.entities], hops)
        return c

    def expand(self, node_ids: list[str], hops: int, most: int = GRAPH_NODES) -> str:
        """Nodes within some hops, and their edges, one a line."""
        edges, nodes = self.engine.read("graph_edges"), self.engine.read("graph_nodes")
        near = graph.bfs(edges, node_ids, hops).orderBy("depth", "id").limit(most)
        seen = near.join(nodes, "id", "left").orderBy("depth", "id").collect()
        ids = [*node_ids, *(r["id"] for r in seen)]
        between = edges.where(F.col("from_id").isin(ids) & F.col("to_id").isin(ids)).orderBy("type", "id").limit(most * most).collect()
        return "\n".join([f"[Node: {r['id']} ({r['type'] or ''})]" for r in seen] + [f"[Edge: {r['from_id']} ->{r['type']}-> {r['to_id']}]" for r in between])

    def reflect(self, query: str, instructions: str = "", **recall) -> dict:
        c = self.recall(query, **recall)
        return self.reflector(query, c) if self.reflector is not None else reflect(c, instructions)

    def consolidate(self, query: str, *, memory_id: str = "", promote: bool = False, knowledge_id: str = "", collection: str = "default", **bucket) -> dict:
        """A reflection's summary as a memory, and as knowledge where that is asked for."""
        found = self.reflect(query, collection=collection, **bucket)
        if not found["summary"].strip():
            raise ValueError("the reflection has no summary")
        session = bucket.get("session_id", "")
        own = {k: v for k, v in bucket.items() if k in ("scope", "user_id", "session_id", "namespace")}
        self.remember(memory_id or f"summary:{session}", found["summary"], role="summary", metadata=json.dumps({k: found[k] for k in ("themes", "entities", "memory_ids", "knowledge_ids", "chunk_ids")}), **own)
        if promote:
            row = [(knowledge_id or f"knowledge:{session}", collection, T.compact_title(found["summary"]), found["summary"])]
            self.save_knowledge(self.spark.createDataFrame(row, "id string, collection string, title string, content string"))
        return found

    # --- sessions

    def ingest(self, turns: DataFrame, **columns) -> int:
        """The exchanges of transcripts (session_id, turn, role, text) as memories; their number."""
        rows = cut(memory.episodes(turns))
        for name, value in columns.items():
            rows = rows.withColumn(name, F.lit(value))
        self.save_memories(rows)
        return rows.count()

    def flow_recall(self, query: str, *, collection: str = "default", memories: int = MEMORIES, knowledge: int = 10, most_chars: int = 0, most_hits: int = 0, tags: Iterable[str] = (), **bucket) -> dict:
        """Hits of both kinds with their text in one piece; of many hits at most half are memories."""
        asked = plan(query)
        if self.strategy is not None:
            asked = self.strategy.enrich(asked | {"namespace": bucket.get("namespace", "")}, tags)
            bucket = bucket | {"namespace": asked["namespace"]}
        m, k = self.search_memory(query, k=memories, **bucket).collect(), self.search_knowledge(query, collection, knowledge).collect()
        text = "\n".join([f"[Memory: {x['scope']}] {x['content']}" for x in m] + [f"[Knowledge: {x['title']}] {x['snippet']}" for x in k])
        if 0 < most_chars < len(text):
            text = text[:most_chars] + "..."
        if 0 < most_hits < len(m) + len(k):
            m = m[: most_hits // 2]
            k = k[: most_hits - len(m)]
        return {"plan": asked, "memories": m, "knowledge": k, "context": text}

    def wake_up(self, query: str, identity: str = "", **recall) -> list[tuple[str, str, str]]:
        """(level, title, text) of identity, memories, knowledge and all of it, where there is any."""
        r = self.flow_recall(query, **recall)
        layers = [("L0", "Identity", identity), ("L1", "Recent Memories", "".join(f"- {x['content']}\n" for x in r["memories"])), ("L2", "Knowledge", "".join(f"- [{x['title']}] {x['snippet']}\n" for x in r["knowledge"])), ("L3", "Full Context", r["context"])]
        return [x for x in layers if x[2]]

    def close_session(self, turns: DataFrame, promote: bool = False, collection: str = "default", **columns) -> int:
        """Episodes saved, and facts that the policy lets through as knowledge; the number of both."""
        n = self.ingest(turns, **columns)
        if promote and self.extractor is not None:
            found = self.extractor(turns)  # (id, title, content)
            found = cut(self.policy(found) if self.policy is not None else found)
            self.save_knowledge(found.withColumn("collection", F.lit(collection)))
            n += found.count()
        return n

    def add_diary(self, entry_id: str, content: str, session_id: str, **columns) -> None:
        self.remember(entry_id, content, session_id=session_id, role="diary", **({"scope": "session", "namespace": "diary"} | columns))

    def diary(self, session_id: str, limit: int = 50) -> DataFrame:
        """Entries of a session, the latest first."""
        return memory.bucket(self.engine.read("memories"), "session", "", session_id, "diary").orderBy(F.desc("created_at"), "id").limit(limit)

    # --- tools

    def call(self, name: str, payload: dict):
        if name not in self.tools:
            raise ValueError(f"unknown tool: {name}")
        return self.tools[name](payload)

    @staticmethod
    def _need(payload: dict, *names: str) -> list:
        for n in names:
            if not payload.get(n):
                raise ValueError(f"{n} is required")
        return [payload[n] for n in names]

    def _bucket(self, p: dict) -> dict:
        return {k: p[k] for k in ("scope", "user_id", "session_id", "namespace") if p.get(k)}

    def _tool_search_knowledge(self, p: dict) -> dict:
        (query,) = self._need(p, "query")
        hits = self.search_knowledge(query, p.get("collection") or "default", p.get("top_k") or 10).collect()
        return {"query": query, "chunks": [{"id": h["knowledge_id"], "content": h["snippet"], "score": h["score"]} for h in hits]}

    def _tool_save_knowledge(self, p: dict) -> dict:
        id_, content = self._need(p, "knowledge_id", "content")
        self.save_knowledge(self.spark.createDataFrame([(id_, p.get("collection") or "default", p.get("title") or "", content)], "id string, collection string, title string, content string"))
        return {"knowledge_id": id_, "chunk_count": len(self.knowledge(id_).first()["chunk_ids"])}

    def _tool_search_memory(self, p: dict) -> dict:
        (query,) = self._need(p, "query")
        hits = self.search_memory(query, k=p.get("top_k") or MEMORIES, **self._bucket(p)).collect()
        return {"results": [{"id": h["id"], "content": h["content"], "score": h["score"]} for h in hits]}

    def _tool_save_memory(self, p: dict) -> dict:
        id_, content = self._need(p, "memory_id", "content")
        self.remember(id_, content, **self._bucket(p))
        return {"memory_id": id_}

    def _tool_expand_graph(self, p: dict) -> dict:
        (ids,) = self._need(p, "node_ids")
        return {"context": self.expand(list(ids), p.get("max_depth") or 1)}

    def _tool_recall(self, p: dict) -> dict:
        (query,) = self._need(p, "query")
        c = self.recall(query, memories=p.get("top_k") or MEMORIES, **self._bucket(p))
        return {"context": c.text, "entities": c.entities}

    def _tool_reflect(self, p: dict) -> dict:
        (query,) = self._need(p, "query")
        return self.reflect(query, memories=p.get("top_k") or MEMORIES, **self._bucket(p))

    def _tool_consolidate(self, p: dict) -> dict:
        (query,) = self._need(p, "query")
        return self.consolidate(query, promote=bool(p.get("promote")), **self._bucket(p))

    def _tool_context(self, p: dict) -> dict:
        (query,) = self._need(p, "query")
        return {"context": T.clip(self.recall(query, **self._bucket(p)).text, p.get("max_chars") or 0)}

    def handle(self, line: str) -> str | None:
        """One JSON-RPC request a line: initialize, tools/list and tools/call; a notification has no answer."""
        try:
            asked = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
        if not isinstance(asked, dict) or "method" not in asked:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}})
        if "id" not in asked:
            return None
        reply = {"jsonrpc": "2.0", "id": asked["id"]}
        method, params = asked["method"], asked.get("params") or {}
        if method == "initialize":
            reply["result"] = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "loamgraph", "version": "1"}}
        elif method == "tools/list":
            reply["result"] = {"tools": [{"name": n} for n in self.tools]}
        elif method != "tools/call":
            reply["error"] = {"code": -32601, "message": f"no such method: {method}"}
        elif params.get("name") not in self.tools:
            reply["error"] = {"code": -32602, "message": f"unknown tool: {params.get('name')}"}
        else:
            try:
                reply["result"] = {"content": [{"type": "text", "text": json.dumps(self.call(params["name"], params.get("arguments") or {}), default=str)}]}
            except Exception as e:  # the caller gets every failure as an answer
                reply["error"] = {"code": -32603, "message": str(e)}
        return json.dumps(reply)
