"""Hot keys, blocks and large buckets give the same results as small ones."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import simhash_dedup, substring_dedup
from loamgraph.llm._spark import Scratch, join_groups, named
from tests.llm.test_operators import arrays, frame, prose


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_and_nothing_is_lost(spark, how):
    rows = spark.range(1000).select((F.col("id") % 7).alias("h"), "id").unionByName(spark.range(5000).select(F.lit(3).cast("long").alias("h"), (F.col("id") + 5000).alias("id")))
    groups = rows.where("h <> 5").groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = sorted(map(tuple, rows.join(groups.drop("n"), "h", how).select("h", "id", "m").collect()), key=repr)
    got = join_groups(rows, groups, ["h"], "n", ["id"], how, hot=100)
    assert sorted(map(tuple, got.select("h", "id", "m").collect()), key=repr) == want


def test_names_that_differ_in_case_alone(spark):
    d = spark.createDataFrame([(1, "a", "b", 2)], "doc_id int, TEXT string, text string, Doc_ID int")
    assert named(d, "doc_id", "text").select("doc_id", "text").first()[:] == (1, "b")
    assert named(d.toDF("doc_id", "TEXT", "x", "y"), "text").select("text").first()[0] == "a"
    with pytest.raises(ValueError):
        named(d, "html")


@pytest.mark.parametrize("bucket", [2, 5, 1 << 16])
def test_large_buckets_are_brute_force(spark, bucket):
    r = random.Random(3)
    a = [r.getrandbits(64) for _ in range(6)]
    nodes = {(x, r.getrandbits(64)) for x in a}
    for x, y in list(nodes):
        for _ in range(12):
            flip = lambda v, most: v ^ sum(1 << b for b in r.sample(range(64), r.randint(0, most)))
            nodes.add((flip(x, 6), flip(y, 9)))
    nodes = sorted(nodes)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    d = spark.createDataFrame([(signed(x), signed(y)) for x, y in nodes], "a long, b long")
    with Scratch(spark) as tables:
        edges = simhash_dedup.near_edges(d, tables, 8, 14, 3, bucket).collect()
    parent = {n: n for n in nodes}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    near = [(p, q) for p, q in itertools.combinations(nodes, 2) if (p[0] ^ q[0]).bit_count() <= 8 and (p[1] ^ q[1]).bit_count() <= 14]
    for p, q in near:
        parent[find(p)] = find(q)
    want = {frozenset(n for n in nodes if find(n) == root) for root in {find(n) for n in nodes}}
    parent = {n: n for n in nodes}
    real = lambda v: v % (1 << 64)
    pairs = {((real(e["a"]), real(e["b"])), (real(e["a2"]), real(e["b2"]))) for e in edges}
    assert all((p, q) in near or (q, p) in near for p, q in pairs)
    for p, q in pairs:
        parent[find(p)] = find(q)
    assert {frozenset(n for n in nodes if find(n) == root) for root in {find(n) for n in nodes}} == want


def test_one_word_never_switches_the_features():
    r = random.Random(8)
    for long in range(0, 16):
        text = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(long)] + ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(30)]
        texts = [" ".join(text), " ".join([*text[:-1], "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8))])]
        a, b, _ = simhash_dedup.fingerprints(*arrays(texts))
        assert int(a[0] ^ a[1]).bit_count() <= 20 and int(b[0] ^ b[1]).bit_count() <= 20


def test_one_text_of_a_third_of_all_rows(spark):
    """A text that repeats 200,000 times and one with 20,000 near copies."""
    base = prose(4, 60)
    d = spark.range(220_000).select(
        "id", F.when(F.col("id") < 200_000, F.lit(base)).otherwise(F.concat(F.lit(prose(5, 300)), F.lit(" "), F.col("id").cast("string"))).alias("text")
    )
    d = d.select(F.col("id").alias("doc_id"), "text")
    g = simhash_dedup.near_duplicates(d)
    sizes = {r["group_id"]: (r["n"], r["k"], r["s"]) for r in g.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if("keep").alias("k"), F.max("group_size").alias("s")).collect()}
    assert sizes == {0: (200_000, 1, 200_000), 200_000: (20_000, 1, 20_000)}
    found = substring_dedup.repeated_passages(d)
    assert found.where("removed").select("doc_id").distinct().count() == 199_999 + 19_999


def test_hot_rows_keep_one(spark):
    d = frame(spark, [(1, prose(1, 50))] * 40 + [(2, prose(1, 50)), (3, prose(2, 50))])
    kept = sorted(r["doc_id"] for r in simhash_dedup.drop_near_duplicates(d).collect())
    assert kept == [1, 3]
    assert np.all(np.array(kept) > 0)
