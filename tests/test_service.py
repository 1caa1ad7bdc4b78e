"""Memories, knowledge, recall, sessions and tools, on small tables with known results."""

import json

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import fulltext, graph
from loamgraph.service import Service, Strategy, memory_lines


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    s = Service(spark, str(tmp_path_factory.mktemp("service")))
    s.remember("m1", "Alice prefers green tea", user_id="u1", importance=0.5)
    s.remember("m2", "Bob ships the tea engine", user_id="u1")
    s.remember("m3", "tea for everybody")
    s.save_knowledge(spark.createDataFrame([("k1", "Tea", "Green tea is brewed by Carol."), ("k2", "Go", "x" * 1200)], "id string, title string, content string"))
    return s


def test_buckets_updates_and_versions(spark, service):
    assert [r["id"] for r in service.search_memory("tea", user_id="u1").collect()] == ["m1", "m2"]
    assert [r["id"] for r in service.search_memory("tea").collect()] == ["m3"]
    with pytest.raises(ValueError):
        service.remember("bad", "x", scope="session")
    with pytest.raises(ValueError):
        service.search_memory("tea", scope="galaxy")
    service.update_memories(spark.createDataFrame([("m2", "Bob ships coffee")], "id string, content string"))
    assert [r["id"] for r in service.search_memory("coffee", user_id="u1").collect()] == ["m2"]
    assert len(service.knowledge("k2").first()["chunk_ids"]) == 4
    service.update_knowledge(spark.createDataFrame([("k2", "short")], "id string, content string"))
    k2 = service.knowledge("k2").first()
    assert (k2["version"], k2["title"], k2["chunk_ids"]) == (2, "Go", ["k2#0"])


def test_recall_reflection_and_consolidation(service):
    c = service.recall("tea", user_id="u1")
    assert c.text == "[MEMORIES]\n[m1] Alice prefers green tea\n\n[KNOWLEDGE]\n[k1] Green tea is brewed by Carol."
    assert c.entities == ["Alice", "Tea", "Green", "Carol"] and c.chunk_ids == ["k1#0"]
    r = service.reflect("tea time", user_id="u1")
    assert r["summary"].startswith("Alice prefers green tea") and r["themes"][-2:] == ["tea", "time"]
    found = service.consolidate("tea", user_id="u1", session_id="s1", scope="user", promote=True)
    assert service.knowledge("knowledge:s1").first()["content"] == found["summary"]
    assert service.engine.get("memories", "summary:s1").first()["role"] == "summary"
    assert memory_lines([{"id": "a", "content": "12345"}, {"id": "b", "content": "67890 12345"}], 5, 18) == "[a] 12345\n[b] 67..."
    with pytest.raises(ValueError):
        service.recall(" ")
    service.delete_knowledge("knowledge:s1")
    service.delete_memory("summary:s1")
    assert service.knowledge("knowledge:s1").isEmpty()


def test_sessions_and_diary(spark, service):
    turns = spark.createDataFrame([("t", 0, "user", "Where is it?"), ("t", 1, "assistant", "It shipped."), ("t", 2, "user", "Thanks")], "session_id string, turn int, role string, text string")
    service.extractor = lambda t: t.where("text like '%shipped%'").select(F.lit("f1").alias("id"), F.lit("Fact").alias("title"), F.col("text").alias("content"))
    assert service.close_session(turns, promote=True, collection="facts") == 3
    assert {r["id"] for r in service.engine.read("memories").where("session_id = 't'").collect()} == {"episode:t:0", "episode:t:1"}
    assert [r["title"] for r in service.search_knowledge("shipped", "facts").collect()] == ["Fact"]
    layers = service.wake_up("shipped", identity="I am a test", session_id="t", collection="facts")
    assert [x[0] for x in layers] == ["L0", "L1", "L2", "L3"] and "It shipped." in layers[1][2]
    assert len(service.flow_recall("shipped", session_id="t", collection="facts", most_chars=5, most_hits=1)["context"]) == 8
    service.add_diary("d1", "first", "t")
    assert [r["content"] for r in service.diary("t").collect()] == ["first"]


def test_strategy_and_tools(service):
    asked = Strategy(bank="My Bank", keywords=("A", "b"), entities=("X",), use_graph=True).enrich({"keywords": ["a"]}, tags=["c"])
    assert asked == {"keywords": ["a", "b", "c", "My Bank"], "entities": ["X"], "namespace": "hindsight:my-bank", "mode": "graph"}
    ask = lambda method, **p: json.loads(service.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})))
    assert len(ask("tools/list")["result"]["tools"]) == 9 and "serverInfo" in ask("initialize")["result"]
    found = ask("tools/call", name="search_memory", arguments={"query": "tea"})
    assert [x["id"] for x in json.loads(found["result"]["content"][0]["text"])["results"]] == ["m3"]
    assert ask("tools/call", name="search_memory", arguments={})["error"]["code"] == -32603
    assert ask("tools/call", name="nothing")["error"]["code"] == -32602 and ask("nothing")["error"]["code"] == -32601
    assert json.loads(service.handle("{"))["error"]["code"] == -32700 and service.handle('{"method": "x"}') is None


def test_small_texts():
    assert T.clip("abcdefgh", 6) == "abc..." and T.clip("ééé", 5) == "é..." and T.clip("abc", 0) == "abc"
    assert T.compact_title("") == "Knowledge" and T.names_in("Ab Alice bobCarol") == ["Alice", "Carol"]
    assert T.merge_distinct(["Tea", "tea "], ["TEA", "x"]) == ["Tea", "x"] and T.expand_query("a", ["b", "a"], [" "]) == ["a", "b"]


def test_stored_text_index(spark, tmp_path):
    rows = [("1", "machine learning"), ("2", "machine tools"), ("3", "garden tools")]
    index = fulltext.TextIndex(spark, str(tmp_path / "text")).build(spark.createDataFrame(rows, "id string, content string"))
    assert [r["id"] for r in index.search("machine").collect()] == ["1", "2"] and index.n_docs() == 3
    index.index(spark.createDataFrame([("2", "rivers"), ("4", "machine rivers")], "id string, content string"))
    assert [r["id"] for r in index.search("machine").collect()] == ["1", "4"] and index.n_docs() == 4
    index.unindex(spark.createDataFrame([("1",)], "id string"))
    assert [r["id"] for r in index.search("machi*").collect()] == ["4"] and index.n_docs() == 3
    plan = index.postings(["machine"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [" in plan


def test_injected_extraction(spark):
    d = spark.createDataFrame([(1, "Alice meets Bob"), (2, "Bob")], "doc_id int, text string")
    nodes, edges = graph.extract_with(d, lambda t: ([(w, "person") for w in t.split() if w[0].isupper()], [("Alice", "Bob", "meets")] if "meets" in t else []))
    assert sorted(r["id"] for r in nodes.collect()) == ["doc:1", "doc:2", "node:alice", "node:bob"]
    assert sorted(r["type"] for r in edges.collect()) == ["meets", "mentions", "mentions", "mentions"]
    with pytest.raises(ValueError):
        graph.validate_extraction(" ", ["n"])
