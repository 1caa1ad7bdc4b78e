"""The engine's own operators: every query against its SQL, and fixtures with known results."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgraph.functions import scalars as S
from loamgraph.functions import text as T
from loamgraph.functions import vectors as V
from loamgraph.operators import aggregates, fulltext, graph, memory, routing, triples
from loamgraph.operators import vector_search as VS
from loamgraph.plans import registry
from loamgraph.sources.store import Engine
from loamgraph.streaming import retention

DATA = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def norm(v):
    return (0.0 if v == 0 else round(v, 4)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in registry.ORACLE:
        found = duck.execute(registry.ORACLE[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(repr([norm(r[columns.index(c)]) for c in df.columns]) for r in found.fetchall())
        assert sorted(repr([norm(x) for x in r]) for r in rows) == want
    else:
        assert rows


def test_vector_functions(spark):
    a, b = V.literal([1, 2, 3]), V.literal([4, 5, 6])
    r = one(spark, V.dot(a, b), V.euclidean(V.literal([0, 0, 0]), V.literal([3, 4, 0])), V.cosine(V.literal([1, 0]), V.literal([-1, 0])), V.cosine(a, V.literal([1])), V.dot(a, V.literal([1])), V.cosine(a, V.literal([0, 0, 0])))
    assert list(r) == [32, 5, -1, 0, 0, 0]
    q = V.scalar_range(V.literal([-1, 0, 0.5, 1]))
    r = one(spark, V.scalar_quantize(V.literal([-1, 0, 0.5, 1]), q["low"], q["high"]), V.binary_quantize(V.literal([1, -0.5, 0.3, -0.1, 0.8])), V.scalar_range(V.literal([2, 2])))
    assert r[0] == [0, 127, 191, 255] and r[1] == [21] and tuple(r[2]) == (0, 1)


def test_top_k_and_filters(spark):
    rows = spark.createDataFrame([("v1", [1.0, 0.0, 0.0]), ("v2", [0.9, 0.1, 0.0]), ("v3", [0.0, 1.0, 0.0]), ("v4", [0.0, 0.0, 1.0])], "id string, vector array<float>")
    got = VS.top_k(rows, [0.95, 0.05, 0], 3).collect()
    assert [r["id"] for r in got] == ["v1", "v2", "v3"] and got[0]["score"] == pytest.approx(0.998618, abs=1e-5)
    assert VS.top_k(rows, [1, 0, 0], 2, where=F.col("id") == "v3").count() == 0
    assert VS.top_k(rows, [1, 0, 0], 2, where=F.col("id") == "v3", filter_mode="pre").count() == 1
    centres = VS.centroids(rows, 3)
    index = VS.ivf_index(rows, centres)
    assert [r["id"] for r in VS.ivf_search(index, centres, [1, 0, 0], 2, probes=3).collect()] == ["v1", "v2"]
    planes = VS.hyperplanes(3)
    assert "v1" in [r["id"] for r in VS.lsh_search(rows, VS.lsh_index(rows, planes), planes, [1, 0, 0], 2).collect()]
    pq = VS.ProductQuantizer(parts=3, codes=4).train(rows)
    coded = rows.select("vector", pq.encode(F.col("vector")).alias("c")).select("vector", pq.decode(F.col("c")).alias("d"), pq.distance(F.col("c"), [1.0, 0, 0]).alias("x"))
    assert all(len(r["d"]) == 3 and r["x"] >= 0 for r in coded.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_indexes_find_true_neighbours(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    best = np.argsort(-(x @ x.T), axis=1)[:, :10]
    true = {i: set(ids[b].tolist()) for i, b in zip(ids.tolist(), best, strict=True)}
    for name in ("ivf_search", "lsh_search", "multi_index"):
        got = {}
        for r in registry.QUERIES[name](spark, DATA).collect():
            got.setdefault(r["query_id"], set()).add(r["id"])
        assert got.keys() == {i for i in true if i % 20 == 0} and all(len(g) == 10 for g in got.values())
        assert sum(len(g & true[i]) for i, g in got.items()) >= 0.9 * 10 * len(got), name


def naive_chunks(text, size, overlap):
    out, at = [], 0
    while at < len(text):
        end = best = min(at + size, len(text))
        if at + size < len(text):
            for i in range(end - 1, at + size // 2, -1):
                if text[i] in "。！？\n.!?":
                    best = i + 1
                    if best != end:
                        break
        out.append((at, best))
        at = best - overlap if best - overlap > at else best
    return out


def test_chunks_are_the_loop():
    r = random.Random(3)
    for size, overlap in [(500, 125), (30, 5), (8, 0), (3, 1), (1, 0)]:
        for _ in range(300):
            text = "".join(r.choices("xyz。.\n", [9, 9, 9, 1, 1, 1], k=r.randint(0, 4 * size)))
            assert T.chunk_spans(text, size, overlap) == naive_chunks(text, size, overlap)


def test_chunks_leave_python_in_small_pieces(spark):
    texts = ["x" * 300_000] * 20 + [None, ""]
    sizes = [len(x) for x in T.chunker().func(iter([pa.array(texts)]))]
    assert sum(sizes) == len(texts) and max(sizes) == -(-T.CHUNKED // 300_000)
    docs = spark.createDataFrame([(i, f"{i}" * 300_000) for i in range(10)] + [(10, None)], "id int, content string").coalesce(1)
    got = memory.chunks(docs).groupBy("knowledge_id").agg(F.max("end"), F.min(F.substring("content", 1, 1)), F.max(F.substring("content", 1, 1))).collect()
    assert sorted(map(tuple, got)) == [(i, 300_000, f"{i}", f"{i}") for i in range(10)]


@pytest.mark.parametrize("name", ["chunk_stats", "knowledge_search"])
def test_chunks_of_signs_at_their_ends(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    # the 500th character is a sign, with and without another one in the chunk's second half
    texts = ["onen " * 60 + "tion. " + "x" * 193 + "." + " onen tion" * 60, "x" * 499 + "." + " onen" * 90, "tion " * 99 + "tion!" + " onen" * 40, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())


@pytest.mark.parametrize("rows", [[(None, "onen tion search " * 60), (None, "code onen"), *[(i, "tion. " * (i % 7)) for i in range(40)]], [(1, "tİon"), (2, "SEARCH"), (3, "İtion"), (4, "t İon onen")]], ids=["no id", "dotted capital"])
def test_knowledge_of_odd_rows(spark, tmp_path, rows):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = registry.QUERIES["knowledge_search"](spark, str(tmp_path))
    found = con.execute(registry.ORACLE["knowledge_search"])
    columns = [c[0] for c in found.description]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())
    assert T.query_tokens("İstanbul") == ["istanbul"]


def test_full_text(spark):
    docs = spark.createDataFrame([("1", "machine learning and machine learning"), ("2", "machine learning"), ("3", "the quick brown fox jumps over the lazy dog"), ("4", "js"), ("5", None)], "id string, content string")
    index = fulltext.postings(docs)
    tokens = docs.where("id = '3'").select(T.tokenize(F.col("content"))).first()[0]
    assert tokens == ["quick", "brown", "fox", "jumps", "lazy", "dog"]
    assert [r["id"] for r in fulltext.search(index, "machine learning", 5).collect()] == ["1", "2"]
    scores = {r["id"]: round(r["score"], 6) for r in fulltext.bm25(index.where("id in ('1', '2')"), ["machine"], 2).collect()}
    assert scores == {"1": 0.250692, "2": 0.182322}
    assert [r["id"] for r in fulltext.search(index, "javascript", 5).collect()] == ["4"]
    assert [r["id"] for r in fulltext.search(index, "qui*", 5).collect()] == ["3"]
    assert sorted(r["id"] for r in fulltext.search(index, "machien", 5, fuzzy=2).collect()) == ["1", "2"]
    assert fulltext.search(index, "", 5).count() == 0
    assert T.levenshtein_bytes("机器", "机") == 3 and T.levenshtein_bytes("machien", "machine") == 2
    fused = fulltext.rrf([spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double"), spark.createDataFrame([("b", 2.0), ("a", 1.0)], "id string, score double")]).collect()
    assert [round(r["score"], 6) for r in fused] == [0.032522, 0.032522]


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def wordy(spark, tmp_path_factory):
    """Documents of many words of which few are asked for, with odd ones among them, and vectors."""
    path = tmp_path_factory.mktemp("wordy")
    odd = ["onen ONENR tİon search 搜索 golang code", "检索 程序 erment the " * 300, "oneñ onem nenr tions tional", "", None, "_tion tion_ 1tion onen-tion", "onen reer reer"]
    texts = odd + [" ".join(f"w{i}x{j}" for j in range(400)) + " onen" * (i % 3) for i in range(50)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "search tion"), (None, "onen tion")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(40)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["fts_bm25", "fts_fuzzy", "fts_prefix", "fts_phrase", "hybrid_rrf"])
def test_searches_move_what_they_find_alone(spark, wordy, name):
    before = shuffled(spark)
    got, want = against_sql(spark, wordy, name)
    assert got == want and got
    assert shuffled(spark) - before < 2000  # there are 20,000 postings


@pytest.mark.parametrize("query, fuzzy", [("onen tion search code", 0), ("tion*", 0), ("langauge", 2), ("golnag onen", 2), ("machine learning db", 0), ("数据库", 1)])
def test_scan_is_the_search_of_all_postings(spark, query, fuzzy):
    texts = ["onen onen tional the thee", "search language", "golang go 数据库 tion", "machine learning ml js", "large language model llm dbs", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    want = fulltext.search(fulltext.postings(docs), query, len(texts), fuzzy=fuzzy).collect()
    assert want and fulltext.Scan(docs).search(query, fuzzy=fuzzy).collect() == want


def test_text_functions(spark):
    assert T.chunk_spans("x" * 300, 500, 125) == [(0, 300), (175, 300)]
    assert T.bank_id("My Project") == "my-project" and T.bank_id("") == "default" and len(T.bank_id("y" * 60)) == 49
    assert T.merge_distinct(["a", "b", "c"], ["b", "c", "d"]) == ["a", "b", "c", "d"]
    said = ["I prefer tea", "We decided on it", "It shipped", "There is a bug", "Nothing else"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r[0] for r in d.orderBy("i").select(T.classify_sentence(F.col("s"))).collect()] == ["preference", "decision", "milestone", "problem", "note"]
    r = one(spark, T.jaccard(F.array(F.lit("hello"), F.lit("world")), F.array(F.lit("hello"), F.lit("there"))), T.normalize_label(F.lit(" A b/c:d ")), S.expand_prefix(F.lit("rdf:type")), S.expand_prefix(F.lit("no:x")), T.document_kind(F.lit("a.MD")), T.truncate(F.lit("abcdef"), 3))
    assert [round(r[0], 6), *r[1:]] == [0.333333, "a_b_c_d", triples.TYPE, "no:x", "markdown", "abc..."]


def test_scalars(spark):
    r = one(spark, S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), S.triple_id(F.lit("http://example.com/alice"), F.lit("http://schema.org/name"), F.lit("Alice")), S.clamp01(F.lit(2.0)))
    assert round(r[0], 4) == 111194.9266 and r[1] == "97a3d151994e7e84" and r[2] == 1
    d = spark.createDataFrame([("0.5", "a"), (" 1.5 ", "a"), ("abc", "b"), (None, "a"), ("1d", "b"), ("2", None)], "v string, g string")
    total = aggregates.aggregate(d, F.col("v")).first()
    assert (total["count"], total["sum"]) == (3, 4.0)
    groups = {r["group_key"]: (r["count"], r["sum"]) for r in aggregates.group_aggregate(d, F.col("g"), F.col("v")).collect()}
    assert groups == {"a": (2, 2.0), "b": (0, 0.0)}
    assert tuple(aggregates.aggregate(d.limit(0), F.col("v")).first()) == (0, 0, 0, 0, 0)


def test_memory(spark):
    rows = [("sem", "other words", [1.0, 0.0], 0.0, "2024-01-01"), ("imp", "Shared retrieval phrase.", [0.0, 1.0], 1.0, "2024-01-01")]
    m = spark.createDataFrame(rows, "id string, content string, vector array<double>, importance double, t string")
    m = m.withColumn("updated_at", F.col("t").cast("timestamp")).withColumn("created_at", F.col("updated_at")).withColumn("expires_at", F.lit(None).cast("timestamp"))
    now = F.lit("2024-01-08").cast("timestamp")
    assert memory.search_memory(m, now, query="shared", vector=[1.0, 0.0]).first()["id"] == "sem"
    assert memory.search_memory(m, now, query="shared", vector=[1.0, 0.0], weights=(0, 1, 1, 0)).first()["id"] == "imp"
    assert memory.search_memory(m, now).count() == 0
    assert memory.search_memory(m, now, query="shared").first()["recency"] == pytest.approx(0.5)


def naive_exchanges(roles):
    out, buffer = [], []
    for i, r in enumerate(roles):
        buffer.append(i)
        if (r == "assistant" and len(buffer) >= 2) or i == len(roles) - 1:
            out.append(buffer)
            buffer = []
    return out


def test_exchanges_are_the_state_machine(spark):
    r = random.Random(4)
    talks = {c: [r.choice(["user", "assistant", "system"]) for _ in range(r.randint(1, 14))] for c in range(40)}
    d = spark.createDataFrame([(c, i, x, str(i)) for c, t in talks.items() for i, x in enumerate(t)], "session_id int, turn int, role string, text string")
    got = {}
    for x in memory.exchanges(d).orderBy("session_id", "exchange").collect():
        got.setdefault(x["session_id"], []).append([int(line.split("] ")[1]) for line in x["content"].split("\n")])
    assert got == {c: naive_exchanges(t) for c, t in talks.items()}


def test_graph(spark):
    e = spark.createDataFrame([("1", "A", "B", "x", 1.0), ("2", "B", "C", "x", 1.0), ("3", "C", "D", "y", 1.0)], "id string, from_id string, to_id string, type string, weight double")
    n = spark.createDataFrame([(x, "t") for x in "ABCDE"], "id string, type string")
    assert {r["id"] for r in graph.bfs(e, ["A"], 2).collect()} == {"B", "C"}
    assert graph.shortest_path(e, "A", "C") == (["A", "B", "C"], ["1", "2"])
    assert graph.shortest_path(e, "C", "A") is None and graph.shortest_path(e, "A", "A") == (["A"], [])
    assert graph.dfs(e, "A", 3) == ["A", "B", "C", "D"]
    left = graph.delete_nodes(n, e, spark.createDataFrame([("B",)], "id string"))
    assert left[0].count() == 4 and [r["id"] for r in left[1].collect()] == ["3"]
    r = graph.analyze(n, e).first()
    assert (r["n_nodes"], r["n_edges"], r["density"], r["isolated"]) == (5, 3, 0.3, 1)
    d = spark.createDataFrame([(1, "Alice and Bob work on the Apollo project at Google.")], "doc_id int, text string")
    assert sorted(r["name"] for r in graph.extract_mentions(d).collect()) == ["Alice", "Apollo", "Bob", "Google"]
    assert graph.co_occurrence(d).count() == 0
    for style in ("text", "markdown", "html"):
        assert "B (2)" in graph.report(n, e, style) and "Nodes: 5" in graph.report(n, e, style)
    chain = spark.createDataFrame([(str(i), i, i + 1, "t") for i in range(8)] + [("a", 0, 2, "z"), ("b", 0, 2, "y")], "id string, from_id int, to_id int, type string")
    assert graph.shortest_path(chain, 0, 8) == ([0, *range(2, 9)], ["b", *map(str, range(2, 8))])
    with pytest.raises(ValueError):
        graph.dfs(chain, 0, 3, most=1)


def test_triples(spark):
    o = triples.Ontology(spark).define_class("ex:Person").define_class("ex:Employee", "ex:Person").add_type("ex:alice", "ex:Employee").fact("ex:alice", "ex:name", "Alice", language="en")
    o.define_shape("ex:shape", "ex:Employee", [{"path": "ex:mail", "minCount": 1}, {"path": "ex:name", "pattern": "lic"}])
    found = {tuple(r) for r in o.infer().collect()}
    assert ("ex:alice", triples.TYPE, "ex:Person") in found
    assert [r["rule"] for r in o.validate().collect()] == ["minCount"]
    assert o.sparql("SELECT ?n WHERE { ?x ex:name ?n . ?x a ex:Employee }").first()["n"] == "Alice"
    assert o.sparql("ASK { ex:bob ex:name ?n }").first()["ask"] is False
    lines = spark.createDataFrame([('<a> <b> <c> .',), ('<a> <b> "x \\"y\\"" .',), ('<a> <b> "z"@en .',), ('<a> <b> "1"^^<int> .',), ("# no",), ("bad",)], "value string")
    t = triples.parse_ntriples(lines)
    assert t.count() == 4 and {r["language"] for r in t.collect()} == {None, "en"}
    assert {r["value"] for r in triples.format_ntriples(t).collect()} == {r["value"] for r in lines.limit(4).collect()}


def against_sql(spark, path, name):
    """The sorted rows of a query over tables under path, and of its SQL."""
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(path):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}/{f}/*.parquet')")
    df, found = registry.QUERIES[name](spark, str(path)), con.execute(registry.ORACLE[name])
    columns = [c[0] for c in found.description]
    rows = lambda x: sorted((tuple(map(norm, r)) for r in x), key=repr)
    return rows([r[c] for c in columns] for r in df.collect()), rows(found.fetchall())


def customers(spark, path, n=40, nations=5):
    """nation, region and customer with and without a balance."""
    tables = {"region": spark.range(2).selectExpr("cast(id as int) r_regionkey"), "nation": spark.range(nations).selectExpr("cast(id as int) n_nationkey", "cast(id % 2 as int) n_regionkey")}
    tables["customer"] = spark.range(n).selectExpr("id c_custkey", f"cast(id % {nations} as int) c_nationkey", "(id % 3 - 1) * 1.5D c_acctbal", "if(id % 2 = 0, 'BUILDING', 'HOUSEHOLD') c_mktsegment")
    for name, t in tables.items():
        t.write.parquet(f"{path}/{name}.parquet")


def test_shapes_of_each_rule_are_the_sql(spark, tmp_path):
    customers(spark, tmp_path)
    got, want = against_sql(spark, tmp_path, "shacl_validate")
    assert got == want and {r[3] for r in got} == {"pattern", "minCount", "datatype"}
    o = triples.Ontology(spark).add_type("ex:a", "ex:C").define_shape("ex:shape", "ex:C", [{"path": "ex:mail", "minCount": 1}])
    assert [(r["shape"], r["prop"]) for r in o.validate().collect()] == [("ex:shape", "ex:shape/property/0")]


@pytest.mark.parametrize("few", [triples.FEW, 0], ids=["few rules", "many rules"])
def test_inference_moves_each_triple_twice(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(triples, "FEW", few)
    customers(spark, tmp_path, n=3000)
    before = shuffled(spark)
    got, want = against_sql(spark, tmp_path, "rdfs_infer")
    assert got == want and len(got) > 3000 * 4
    # 11,000 triples and as many as they make; joined by their predicates they would move for each rule
    assert few == 0 or shuffled(spark) - before < 3 * (11_000 + len(got))


def test_inference_goes_on_and_makes_nothing_of_nulls(spark):
    t = triples.make(spark, [("a", triples.SUB_CLASS, "b", "iri", None, None, None, False), ("x", triples.TYPE, "a", "iri", None, None, None, False), ("x", "p", None, "iri", None, None, None, False), *[(f"{i}", triples.SUB_CLASS, f"{i + 1}", "iri", None, None, None, False) for i in range(5)]])
    assert {tuple(r) for r in triples.rdfs_infer(t).where("p = 'p' or s = 'x'").collect()} == {("x", triples.TYPE, "b")}
    found = triples.rdfs_infer(t, 5).where(F.col("p") == triples.SUB_CLASS).collect()
    assert {(r["s"], r["o"]) for r in found} == {(f"{i}", f"{j}") for i in range(6) for j in range(i + 2, 6)}


def test_routing(spark):
    routes = spark.createDataFrame([("greeting", 0, "hello world there you"), ("search", 1, "search documents")], "route string, place int, utterance string")
    q = spark.createDataFrame([(1, "hello world"), (2, "search for documents"), (3, "zzz")], "query_id int, text string")
    got = {r["query_id"]: (r["route"], round(r["score"], 6), r["matched"]) for r in routing.lexical(q, routes).collect()}
    assert got == {1: ("greeting", 0.5, True), 2: ("search", 0.666667, True), 3: ("greeting", 0.0, False)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_hybrid_routes_every_item_with_a_vector(spark):
    big = DATA.replace("sf0.001", "sf0.1")
    items = {r[0] for r in spark.read.parquet(f"{big}/benchmark.parquet").select("item_id").collect()}
    vectors = {r[0] for r in spark.read.parquet(f"{big}/embeddings.parquet").select("vec_id").collect()}
    got = [r["query_id"] for r in registry.QUERIES["route_hybrid"](spark, big).collect()]
    assert len(items & vectors) > 40 and sorted(got) == sorted(items & vectors)


def test_store(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.create_collection("c")
    with pytest.raises(ValueError):
        e.create_collection("c")
    e.insert_text(spark.createDataFrame([("c", "d1", "text"), ("c", "d2", " ")], "collection string, doc_id string, content string"), lambda c: F.array(F.length(c).cast("float")))
    e.upsert("graph_nodes", spark.createDataFrame([("n", "t")], "id string, type string"))
    e.upsert("graph_nodes", spark.createDataFrame([("n", "u")], "id string, type string"))
    assert [r["type"] for r in e.read("graph_nodes").collect()] == ["u"]
    assert tuple(e.stats().first()) == (1, 1, 0, 0, 0)
    e.backup(str(tmp_path / "copy"))
    e.delete_collection("c")
    assert e.scan("embeddings", "c").count() == 0
    e.restore(str(tmp_path / "copy"))
    assert e.scan("embeddings", "c", vectors=False).columns.count("vector") == 0 and e.read("embeddings").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant" if t % 3 else "system", f"m{c}.{t}") for c in range(5) for t in range(9)]
    d = spark.createDataFrame(rows, "session_id long, turn long, role string, content string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = retention.auto_retain_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted(map(tuple, retention.auto_retain(d).collect()))
