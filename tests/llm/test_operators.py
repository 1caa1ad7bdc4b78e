"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import base64
import gzip
import io
import itertools
import random
import re
import struct
import time
import tracemalloc
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import byte_bpe, chat_quotes, curve_packing, html_extraction, language_id, media_sniffing, quality_rules, simhash_dedup, substring_dedup, toxicity
from loamgraph.llm._text import string_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(5)
VOCABULARY = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(900)]


def prose(seed, n, vocabulary=VOCABULARY):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, "  \n\t "), (None, "a few words of no id"), (5, "x"), (5, "x"), (6, "x"), (7, "word " * 30_000), (8, "\u0000 odd   é 日本")]


def clashing(df):
    for c in ("k", "_text", "_d_k", "_spans", "score", "keep", "t_id", "_rank", "value", "h"):
        df = df.withColumn(c, F.lit(7))
    return df


def arrays(texts):
    import pyarrow as pa

    return string_bytes(pa.array(texts, pa.string()))


# --- 1 ---------------------------------------------------------------------------------------------------


def naive_passages(texts, length):
    """Covered and removed words of distinct texts: the first occurrence by (key, place) stays."""
    where = {}
    for k, t in texts.items():
        w = t.split()
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), []).append((k, i))
    covered, kept = {k: set() for k in texts}, {k: set() for k in texts}
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                covered[k] |= set(range(i, i + length))
            k, i = min(places)
            kept[k] |= set(range(i, i + length))
    return covered, {k: covered[k] - kept[k] for k in texts}


def test_substring_dedup_is_brute_force(spark):
    shared = [prose(100 + i, n) for i, n in enumerate((20, 25, 60, 130))]
    texts = {i: " ".join(itertools.chain([prose(i, 30 + i)], random.Random(i).sample(shared, i % 4), [prose(900 + i, 10)])) for i in range(12)}
    texts[12] = texts[3] + " " + shared[2] + " " + shared[2]
    d = frame(spark, texts.items())
    keys = {r["doc_id"]: r["k"] for r in d.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    covered, removed = naive_passages({keys[i]: t for i, t in texts.items()}, 20)
    got_c, got_r = {k: set() for k in covered}, {k: set() for k in covered}
    for r in substring_dedup.repeated_passages(d, 20).collect():
        span = set(range(r["start_word"], r["end_word"]))
        got_c[keys[r["doc_id"]]] |= span
        if r["removed"]:
            got_r[keys[r["doc_id"]]] |= span
    assert got_c == covered
    assert got_r == removed
    left = substring_dedup.remove_passages(d, 20).collect()
    first = {r["doc_id"]: r["text"] for r in left}
    assert all(" ".join(first[i].split()) == " ".join(w for j, w in enumerate(texts[i].split()) if j not in removed[keys[i]]) for i in first)


def test_longest_is_brute_force(spark):
    shared = [prose(500 + i, n) for i, n in enumerate((10, 19, 20, 39, 40, 41, 43, 80, 86, 170))]
    texts = {i: " ".join([prose(700 + i, 7), shared[i % 10], prose(720 + i, 5), shared[(3 * i + i // 10) % 10]]) for i in range(20)}
    texts[20] = " ".join([prose(750, 3), "word " * 4300, prose(751, 30), shared[9]])
    d = frame(spark, texts.items())
    where, repeats = {}, {i: [] for i in texts}
    for n in (10 << j for j in range(10)):
        where.clear()
        for i, t in texts.items():
            w = t.split()
            for p in range(len(w) - n + 1):
                where.setdefault(hash(tuple(w[p : p + n])), []).append((i, p))
        for places in where.values():
            if len(places) > 1:
                for i, p in places:
                    repeats[i].append((p, p + n))
    rows = substring_dedup.repeated_passages(d, 10).collect()
    assert {r["longest"] for r in rows} >= {10, 20, 40, 80, 160}
    for r in rows:
        assert r["longest"] == max(e - s for s, e in repeats[r["doc_id"]] if s < r["end_word"] and e > r["start_word"])


def test_substring_dedup_edges(spark):
    long = prose(1, 80)
    d = frame(spark, [*EDGE, (20, long), (21, long), (21, long), (None, long)])
    rows = {(r["doc_id"], r["start_word"], r["end_word"], r["removed"]) for r in substring_dedup.repeated_passages(d).collect()}
    assert {(20, 0, 80, False), (21, 0, 80, True), (None, 0, 80, True)} <= rows
    out = substring_dedup.remove_passages(clashing(d))
    assert out.columns == clashing(d).columns
    ids = sorted(r["doc_id"] or -1 for r in out.collect())
    assert ids.count(20) == 1 and 21 not in ids
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0
    assert substring_dedup.remove_passages(frame(spark, [])).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------


def test_quality_is_brute_force(spark):
    good = [(i, (prose(i, 60) + ". ").capitalize()) for i in range(20)]
    junk = [(100 + i, " ".join(w.upper() + "%%!!" for w in prose(i, 60).split())) for i in range(10)]
    d = frame(spark, good + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(15)] + [(100, 0), (None, 1), (16, None)], "doc_id long, quality int")
    grams = {i: quality_rules.buckets(*arrays([t]))[0] for i, t in good + junk}
    for i, t in good + junk:  # one bucket for each equal n-gram of words, and of shapes, and about as many as there are
        w = t.lower().split()
        kinds = {tuple(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)}
        shape = [re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", x)))) + "=" * (k > 0 and w[k] == w[k - 1]) for k, x in enumerate(t.split())]
        kinds |= {(0, *shape[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)}
        assert len(grams[i]) == 6 * len(w) - 6 and len(kinds) - 3 <= len(set(grams[i].tolist())) <= len(kinds)
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i < 15:
            np.add.at(target, g, 1)
    llr = np.log((target + quality_rules.PRIOR) / (raw * target.sum() / raw.sum() + quality_rules.PRIOR))
    for r in quality_rules.quality_scores(d, labels).collect():
        assert r["score"] == pytest.approx(llr[grams[r["doc_id"]]].mean())
        assert r["ngrams"] == len(grams[r["doc_id"]])
        assert r["keep"] == (r["doc_id"] < 100)


def test_quality_counts_all_trusted_documents(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    d = frame(spark, [(i * 500, prose(i, 30)) for i in range(60)] + [(40_000 + i, prose(100 + i, 30)) for i in range(20)] + [(None, prose(99, 30))])
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for r in d.collect():
        g = quality_rules.buckets(*arrays([r["text"]]))[0]
        np.add.at(raw, g, 1)
        if r["doc_id"] is not None and r["doc_id"] < 30_000:
            np.add.at(target, g, 1)
    llr = np.log((target + quality_rules.PRIOR) / (raw * target.sum() / raw.sum() + quality_rules.PRIOR))
    assert quality_rules.trusted_ids(labels).count() == 30_000
    assert np.allclose(quality_rules.ratios(d, labels), llr)
    assert np.allclose(quality_rules.ratios(d, labels, broadcast_ids=10), llr)


def test_quality_edges(spark):
    d = frame(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.quality_scores(d, none).collect()
    assert len(rows) == len(EDGE) and all(r["score"] == 0 for r in rows)
    assert {r["doc_id"] for r in rows if not r["keep"]} == {1, 2, 3}
    kept = quality_rules.keep_quality(clashing(d), none)
    assert kept.columns == clashing(d).columns and kept.count() == len(EDGE) - 3
    assert quality_rules.keep_quality(frame(spark, []), none).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    insults = ["idiot", "moron", "worthless", "pathetic", "scum", "clown"]
    invented = [f"zorblax{x}" for x in ("o", "an", "ing", "er", "est", "ul")]

    def text(i):
        words = prose(i, 80).split()
        r = random.Random(i)
        for w in r.sample(insults if i % 20 else invented, 4) if i % 10 == 0 else []:
            words.insert(r.randrange(len(words)), w)
        return " ".join(words)

    d = frame(spark, [(i, text(i)) for i in range(600)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = toxicity.toxicity(d, labels).collect()
    held = [r for r in rows if r["doc_id"] >= 400]
    assert all(r["toxic"] == (r["doc_id"] % 10 == 0) for r in held)


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(3)
    y = r.random(20_000) < 0.2
    flip = lambda p: (np.where(r.random(len(y)) < p, y, ~y)).astype(np.int8)
    a, b, c, e = flip(0.95), flip(0.9), flip(0.85), flip(0.9)
    v, n = np.unique(np.stack([a, b, c, e, e], 1), axis=0, return_counts=True)
    m = toxicity.LabelModel(v, n.astype(float))
    assert m.correlation[3, 4] > 0.9 and m.correlation[3, 4] > m.correlation[:3].max() and m.share[3] <= 0.55
    assert m.accuracy[0] > m.accuracy[2]


def test_toxicity_edges(spark):
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(frame(spark, EDGE), none).collect()
    assert len(rows) == len(EDGE) and not any(r["toxic"] or r["p_toxic"] for r in rows)
    mixed = toxicity.toxicity(clashing(frame(spark, [*EDGE, *((i, prose(i, 40)) for i in range(100, 140)), *[(30, "you idiot moron scum " + prose(1, 20))] * 5]))).collect()
    assert [r["doc_id"] for r in mixed if r["toxic"]] == [30] * 5
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------

TEXTS = ["", " ", "a  b\n\n c\t", "'s a's a 's x\n'll'l'llx'r é'd", "日本語 🎉 é ▁ <unk> x×y", "a" * 3000, "1a2 ... !?\r\n", "end  \n", "\x1c\x00"]


def test_byte_bpe_is_the_original_encoder(spark):
    import tiktoken

    tokens = byte_bpe.read_ranks(byte_bpe.VOCABULARY)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = byte_bpe.Codec(tokens)
    texts = TEXTS + [prose(i, 200) + ", it's École" for i in range(20)]
    ids, off = codec.encode(texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == own.encode_ordinary(t)


def test_byte_bpe_round_trip_and_edges(spark):
    rows = [*EDGE, *enumerate(TEXTS, 100)]
    d = clashing(frame(spark, rows))
    enc = byte_bpe.encode(d)
    got = enc.collect()
    assert all(r["lossless"] is not False for r in got)
    assert [r["ids"] for r in got if r["doc_id"] == 1] == [None] and [r["ids"] for r in got if r["doc_id"] == 2] == [[]]
    back = sorted((r["doc_id"] or -1, r["text"] or "") for r in byte_bpe.decode(enc).collect())
    assert back == sorted((i or -1, t or "") for i, t in rows)
    assert byte_bpe.encode(frame(spark, [])).count() == 0
    raw = [b"plain \xff\xfe bytes", b"\x80", "é".encode()[:1] + b" end", b"\xed\xa0\x80", b"ok"]
    d = spark.createDataFrame(list(enumerate(raw)), "doc_id int, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    enc = byte_bpe.encode(d)
    assert all(r["lossless"] for r in enc.collect())
    back = byte_bpe.decode(enc).select("doc_id", F.col("text").cast("binary").alias("b")).collect()
    assert {r["doc_id"]: bytes(r["b"]) for r in back} == dict(enumerate(raw))
    odd = spark.createDataFrame([(1, [0, None, -4, 10**9]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode(odd).collect()} == {1: byte_bpe.read_ranks(byte_bpe.VOCABULARY)[0].decode(), 2: None, 3: ""}


# --- 5 ---------------------------------------------------------------------------------------------------


def page(i, tag="article"):
    r = random.Random(i)
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.choices(VOCABULARY, k=6))
    body = "".join(f"<p>{prose(i * 50 + j, r.randint(8, 60))}.</p>" if j % 3 else f"<p><b>{prose(i * 50 + j, 9)}<br>" for j in range(5))
    return f'<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">{prose(i + 7000, 9)}</div><{tag}>{body}</{tag}><footer>&copy; {prose(i + 9000, 5)}</footer></body></html>'


def test_html_held_out(spark):
    x, y = html_extraction._training_rows([page(i) for i in range(150)])
    model = html_extraction.Boosted().fit(x, y)
    xt, yt = html_extraction._training_rows([page(i) for i in range(500, 600)])
    assert ((model.margin(xt) > 0) == yt).mean() > 0.98
    for i in range(700, 720):
        source = page(i, "div")
        text, _, _ = html_extraction.extract_all([source], model)[0]
        body = re.search(r"<div>(<p>.*)</div><footer>", source).group(1)
        wanted = [re.sub("<[^>]*>", "", x).strip() for x in re.split("<p>", body) if x]
        assert text.split("\n") == [x for x in wanted if x]


def test_html_decoding_is_consistent():
    t = html_extraction.parse("<div><p>one two three</p><div><p>four</p><p>five six</p></div></div>")
    x, own = html_extraction.features(t)
    worth = lambda pick, score: sum(score[i] * np.log1p(own[i]) for i in pick)
    below = lambda i: {j for j in range(i, t.end[i])}
    for seed in range(20):
        score = np.random.default_rng(seed).normal(size=len(x))
        inside = html_extraction.decode(t, score, own)
        for i, p in enumerate(t.parent):
            assert p < 0 or not inside[p] or inside[i]
        # no other choice of whole subtrees is worth more
        options = [set().union(*map(below, c)) for n in range(4) for c in itertools.combinations(range(1, len(x)), n)]
        assert worth(np.flatnonzero(inside), score) == pytest.approx(max(worth(o, score) for o in options), abs=1e-4)


@pytest.mark.parametrize("piece", ['<a "x ', "<div>", "<a ", "<p>x", "<!", "<!-- ", '<a href="', "<a '\">", "<table><tr><td>", "</div>", "<![CDATA[", '<x class="id=\'', "<script>"])
def test_hostile_pages_take_linear_time(piece):
    hostile = piece * (1_000_000 // len(piece))
    began = time.process_time()
    t = html_extraction.parse(hostile)
    html_extraction.features(t)
    assert time.process_time() - began < 6
    assert all(p < i < e <= len(t.tag) for i, (p, e) in enumerate(zip(t.parent, t.end)))
    for i, p in enumerate(t.parent[1:2000], 1):
        assert t.end[i] <= t.end[p] and t.depth[i] == t.depth[p] + 1


def test_html_edges(spark):
    pages = [(1, None), (2, ""), (3, "no tags & text"), (4, "<p>a<p>b</i></p><!-- x"), (5, "<div>" * 3000 + "deep"), (6, "<script>x")]
    d = clashing(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string"))
    rows = {r["page_id"]: r for r in html_extraction.main_text(d).collect()}
    assert rows[1]["text"] == rows[2]["text"] == rows[6]["text"] == ""
    assert rows[4]["text"] == "a\nb" and rows[5]["text"] == "deep"
    assert html_extraction.main_text(d.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string"


def test_chat_quotes(spark):
    rows = [
        (1, 0, "user", "First line here.\nSecond line there.\n\nA paragraph of its own."),
        (1, 1, "assistant", "On Monday someone wrote:\n> Second   LINE there.\n\nI answer that."),
        (1, 2, "user", "> A paragraph of its own.\nAnd I that.\n>> I answer that."),
        (1, 3, "user", "> I answer that.\n> > Second line there.\nDeep."),
        (2, 0, "user", "> Deep.\nElsewhere."),
    ]
    out = {r["conv_id"]: r for r in chat_quotes.conversations(spark.createDataFrame(rows, CHATS)).collect()}
    m = out[1]["messages"]
    assert [(x["turn"], x["reply_to"]) for x in m] == [(0, None), (1, 0), (3, 1), (2, 0)]
    assert m[1]["text"] == "I answer that." and m[2]["text"] == "Deep."
    assert all(">" not in x["text"] and "wrote" not in x["text"] for x in m)
    assert out[1]["n_quotes"] == 5 and out[1]["n_linked"] == 5
    assert out[2]["linked_elsewhere"] == 1 and out[2]["messages"][0]["reply_to"] is None


def test_chat_links_are_brute_force(spark):
    r = random.Random(2)
    rows, own = [], {}
    for c in range(4):
        for t in range(8):
            lines = [prose(r.randrange(40) + 300, 4) for _ in range(2)]
            quote = ["> " + r.choice(list(own.values()))[0]] if own and r.random() < 0.7 else []
            own[(c, t)] = lines
            rows.append((c, t, "user", "\n".join(quote + lines)))
    out = {x["conv_id"]: x["messages"] for x in chat_quotes.conversations(spark.createDataFrame(rows, CHATS)).collect()}
    for c, t, _, text in rows:
        want = t - 1 if t else None
        if text.startswith("> "):
            quoted = text.split("\n")[0][2:]
            first = min((b for (a, b), x in own.items() if a == c and quoted in x), default=t)
            want = first if first < t else want
        assert [m["reply_to"] for m in out[c] if m["turn"] == t] == [want]


def test_chat_links_trimmed_quotes(spark):
    """Any run of words of at least SHORTEST links to the first message that has it, as brute force finds."""
    r = random.Random(6)
    rows, own = [], {}
    for c in range(3):
        for t in range(10):
            body = "\n\n".join("\n".join(prose(r.randrange(10**6), 9) for _ in range(3)) for _ in range(3))
            quote = ""
            if t:
                source = own[(r.randrange(c + 1), r.randrange(t))].split()
                a = r.randrange(len(source) - 30)
                run = source[a : a + r.randint(chat_quotes.SHORTEST, 30)]
                cut = r.randrange(len(run))
                quote = "> " + " ".join(run[:cut]) + "\n>  " + " ".join(run[cut:]) + "\n"
            own[(c, t)] = body
            rows.append((c, t, "user", quote + body))
    out = {x["conv_id"]: x for x in chat_quotes.conversations(spark.createDataFrame(rows, CHATS)).collect()}
    for c in range(3):
        found = here = 0
        for t in range(1, 10):
            quoted = " ".join(" ".join(x[1:] for x in rows[c * 10 + t][3].split("\n") if x.startswith(">")).split())
            holds = [k for k, body in sorted(own.items()) if f" {quoted} " in f" {' '.join(body.split())} "]
            mine = [k for k in holds if k[0] == c and k[1] < t]
            reply = next(m["reply_to"] for m in out[c]["messages"] if m["turn"] == t)
            assert reply == (mine[0][1] if mine else t - 1)
            found += bool(mine) or any(k[0] != c for k in holds)
            here += bool(mine)
        assert out[c]["n_linked"] == found == 9 and out[c]["linked_elsewhere"] == found - here


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, None, "user", "> x"), (None, 1, "user", "x"), (3, 1, "user", ">>>\n> \n" + "> y\n" * 5000)]
    d = clashing(spark.createDataFrame(rows, CHATS))
    rows = chat_quotes.conversations(d).collect()
    out = {r["conv_id"]: r for r in rows}
    assert out[1]["n_messages"] == 3
    # every row without a conv_id is a conversation of its own
    assert sorted((r["n_messages"], r["n_linked"]) for r in rows if r["conv_id"] is None) == [(1, 0), (1, 1)]
    assert [m["text"] for m in out[3]["messages"]] == [""]
    assert chat_quotes.conversations(d.limit(0)).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    sounds = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ung", "ein", "ich"], "cc": ["ción", "os", "que", "ar"]}
    word = lambda r, s: "".join(r.choices(s, k=r.randint(1, 3)))
    rows = []
    for i in range(240):
        name = sorted(sounds)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join(word(r, sounds[name]) for _ in range(40)), name, "s", 1))
    d = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in language_id.identify(d).collect()}
    assert all(out[i]["language"] == n and out[i]["keep"] for i, _, n, _, _ in rows)
    noise = "".join(random.Random(1).choices("wzqkxj ", k=900))
    extra = d.unionByName(spark.createDataFrame([(999, noise, None, "s", 1)], DOCS))
    assert [r["keep"] for r in language_id.identify(extra).where("doc_id = 999").collect()] == [False]


def test_left_out_language_is_rejected(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 150")
    out = language_id.identify(d.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang"))))
    kept = {r["de"]: r["kept"] for r in out.join(d.select("doc_id", (F.col("lang") == "de").alias("de")), "doc_id").groupBy("de").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert kept[True] < 0.1 and kept[False] > 0.98, kept


def test_repeated_rows_keep_their_language(spark):
    sounds = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ung", "ein", "ich"]}
    text = lambda i, s: " ".join("".join(random.Random(i * 99 + j).choices(sounds[s], k=2)) for j in range(40))
    rows = [(i, text(i, "aa"), "aa", "s", 1) for i in range(60)] + [(7, text(7, "bb"), "bb", "s", 1)] * 500
    for shift in range(4):
        d = spark.createDataFrame([(i + shift * 1000, *r) for i, *r in rows], DOCS)
        names, p = language_id.prototypes(d, per_language=20)
        assert names == ["aa", "bb"] and p.shape[0] == 2
    # other scripts: two languages of one alphabet and one of another
    greek, russian, serbian = "αβγδε", "абвгд", "эюяжз"
    other = [(i, " ".join("".join(random.Random(i * 7 + j).choices((greek, russian, serbian)[i % 3], k=4)) for j in range(50)), "grs"[i % 3], "s", 1) for i in range(90)]
    out = {r["doc_id"]: r["language"] for r in language_id.identify(spark.createDataFrame(other, DOCS)).collect()}
    assert all(out[i] == name for i, _, name, _, _ in other)


@pytest.mark.parametrize("broadcast_repeats", [0, 1 << 18])
def test_all_documents_teach_their_language(spark, monkeypatch, broadcast_repeats):
    sounds = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ung", "ein", "ich"]}
    rows = []
    for i in range(5200):
        r, name = random.Random(i), "ab"[i % 2] * 2
        rows.append((i, " ".join("".join(r.choices(sounds[name], k=2)) for _ in range(r.randint(1, 14) if i % 41 else 200)), name, "s", 1))
    monkeypatch.setattr(language_id.taught, "__defaults__", (None, broadcast_repeats))
    names, p, bounds = language_id.fit(spark.createDataFrame(rows + rows[:7] * 30, DOCS), dimensions=256)
    letters = language_id.letter_vectors(256)
    code, text = language_id.trigrams(*arrays([r[1] for r in rows]))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    own, count = language_id.bundles_of(code, text, len(rows), letters)
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    assert names == ["aa", "bb"]
    for a in range(2):
        mine = np.arange(len(rows)) % 2 == a
        total = own[mine].sum(0, dtype=np.float64)
        assert np.allclose(p[a], unit(total), atol=1e-6)
        rest = unit(total - own)
        at = lambda c, share: np.sort(c)[int(share * (len(c) - 1))]
        whole = at((own * rest).sum(1)[mine & (count >= language_id.ENOUGH)], language_id.TOLERANCE)
        for j in range(2, 11):
            first = rank < 1 << j
            v, _ = language_id.bundles_of(code[first], text[first], len(rows), letters)
            c = (v * rest).sum(1)[mine & (count >= 1 << j)]
            want = min(at(c, 0.5) / 2, at(c, language_id.SHORT_TOLERANCE), whole)
            assert bounds[a, j] == pytest.approx(want, abs=3e-6), (a, j)


def test_beginnings_of_many_kinds_of_trigrams():
    """The table of bound vectors and the matrix of counts give the same sums."""
    r = np.random.default_rng(2)
    letters, sizes = language_id.letter_vectors(128), [0, 3, 4, 700, 90, 0, 5000]
    text = np.repeat(np.arange(len(sizes)), sizes)
    for kinds in (50, 1 << 18):
        code = r.integers(0, kinds, len(text))
        want = lambda use: language_id.sums_of(code[use], text[use], len(sizes), letters)  # noqa: B023, E731
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        for most in (language_id._TABLE, 10):
            language_id._TABLE, before = most, language_id._TABLE
            whole, found = language_id.beginnings(code, text, len(sizes), letters)
            language_id._TABLE = before
            assert (whole == want(rank >= 0)).all() and [j for j, _, _ in found] == list(range(2, 13))
            for j, rows, v in found:
                assert rows.tolist() == [i for i, n in enumerate(sizes) if n >= 1 << j] and (v == want(rank < 1 << j)[rows]).all()


def test_cosines_are_brute_force():
    """Bundles of bound letter vectors, one trigram and one letter at a time."""
    letters = language_id.letter_vectors(256).astype(int)
    symbol = lambda c: ord(c) - 96 if c.isalpha() else 0
    texts = ["the quick brown fox", "jumps  over -- the lazy dog", "ab", ""]
    unit, count = language_id.bundles(*arrays(texts), letters.astype(np.float32))
    for t, u, n in zip(texts, unit, count, strict=True):
        s = [symbol(c) for c in re.sub(r"[^a-z]+", " ", t)]
        total = np.zeros(256)
        for a, b, c in zip(s, s[1:], s[2:]):
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        assert n == max(len(s) - 2, 0)
        assert np.allclose(u, total / max(np.linalg.norm(total), 1e-9), atol=1e-5)


def test_language_edges(spark):
    d = clashing(frame(spark, EDGE))
    rows = language_id.identify(d).collect()
    assert len(rows) == len(EDGE) and {r["doc_id"] for r in rows if r["language"] is None} >= {1, 2}
    kept = language_id.keep_known_languages(d)
    assert kept.columns == d.columns and {1, 2}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language_id.keep_known_languages(frame(spark, [])).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.uint64)
        key = curve_packing.hilbert_keys(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(key)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing_is_brute_force(spark):
    texts = {i: prose(i, 5 + i * 7 % 90) for i in range(40)}
    packs = curve_packing.pack(frame(spark, texts.items()), capacity=64).orderBy("pack_id").collect()
    x, n = curve_packing.coordinates(*arrays(list(texts.values())), curve_packing.DIMS)
    cells = np.clip(np.floor((x + 1) / 2 * (1 << curve_packing.BITS)), 0, (1 << curve_packing.BITS) - 1).astype(np.uint64)
    order = sorted(zip(curve_packing.hilbert_keys(cells, curve_packing.BITS).tolist(), texts, strict=True))
    line = [(i, w) for _, i in order for w in range(int(n[i]))]
    assert [p["pack_id"] for p in packs] == list(range(-(-len(line) // 64)))
    for p in packs:
        got = [(i, w) for i, s, m in zip(p["doc_ids"], p["starts"], p["lengths"], strict=True) for w in range(s, s + m)]
        assert got == line[p["pack_id"] * 64 : p["pack_id"] * 64 + 64]


def test_packing_edges(spark):
    d = clashing(frame(spark, EDGE))
    packs = curve_packing.pack(d).collect()
    ids = [i for p in packs for i in p["doc_ids"]]
    assert {1, 2, 3}.isdisjoint(ids) and None in ids and ids.count(5) == 2
    assert sum(p["words"] for p in packs) == sum(len((t or "").split()) for _, t in EDGE if _ != 8) + 5
    assert curve_packing.pack(frame(spark, [])).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------


def png():
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
WAV = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4) + b"abcd"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0" + b"\0" * 9 + b"\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0\xff\xda\0\x08\1\1\0\0\x3f\0ab\xff\0c\xff\xd9"
MP4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x08moov" + b"\0\0\0\x0amdatxx"


def zipped():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello" * 9)
    return b.getvalue()


MEDIA = {"image/png": png(), "image/gif": GIF, "audio/wav": WAV, "application/pdf": PDF, "image/jpeg": JPEG, "video/mp4": MP4, "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 99)}


@pytest.mark.parametrize("kind", MEDIA)
def test_sniffing_types_lengths_and_carving(kind):
    b = MEDIA[kind]
    assert media_sniffing.sniff(b) == (kind, [])
    inside = b"some text " + b + b" and " + png() + b"."
    assert media_sniffing.sniff(inside)[1] == [(kind, 10, len(b)), ("image/png", 15 + len(b), len(png()))]
    broken = b[: len(b) * 2 // 3]
    assert media_sniffing.sniff(b"text " + broken)[1] == []


def test_sniffing_table_and_edges(spark):
    uri = b'<html><img src="data:image/jpeg;base64,' + base64.b64encode(GIF) + b'"></html>'
    rows = [(1, None, "image/png"), (2, b"", "image/png"), (3, png(), "IMAGE/X-PNG; q=1"), (4, GIF, "image/png"), (5, uri, "text/html"), (6, b"BM GIF89a %PDF-1.4 ID3 plain", None), (7, b'{"a": 1}', "text/plain"), (8, b"\xff\xfe\0", " ")]
    d = clashing(spark.createDataFrame(rows, "id long, b binary, declared string"))
    out = {r["id"]: r for r in media_sniffing.media_types(d, "id", "b", "declared").collect()}
    assert [out[i]["type"] for i in range(1, 9)] == [None, None, "image/png", "image/gif", "text/html", "text/plain", "application/json", "application/octet-stream"]
    assert [i for i in out if out[i]["mismatch"]] == [4]
    assert [(c["type"], c["offset"]) for c in out[5]["carved"]] == [("image/gif", 16)] and not out[6]["carved"]
    assert media_sniffing.media_types(d.limit(0), "id", "b").count() == 0


def naive_carving(b):
    """Every format tried at every place, the first and then the longest object first."""
    found = []
    for magic, back, kind, check in media_sniffing.FORMATS:
        for at in range(len(b)):
            if b.startswith(magic, at + back) and (n := check(b, at)):
                found.append((at, -n, kind))
    out, end = [], 0
    for at, n, kind in sorted(found):
        if at >= end:
            out.append((kind, at, -n))
            end = at - n
    return out


def test_carving_is_brute_force():
    r = random.Random(12)
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 6)):
            b = r.choice(list(MEDIA.values()))
            parts += [b if r.random() < 0.7 else b[: r.randrange(len(b))], r.randbytes(r.randrange(20))]
        b = b"start " + b"".join(parts)
        media_sniffing.zip_ends.cache_clear()
        assert media_sniffing.sniff(b)[1] == naive_carving(b)


def test_bombs_and_many_entries_stay_small():
    bomb = gzip.compress(b"\0" * 200_000_000)
    tracemalloc.start()
    assert media_sniffing.sniff(bomb) == ("application/gzip", [])
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for i in range(20_000):
            z.writestr(f"{i}.txt", "x")
    began = time.process_time()
    assert media_sniffing.sniff(buffer.getvalue()) == ("application/zip", [])
    assert media_sniffing.sniff(b" " + buffer.getvalue()[:-1])[1] == []
    assert time.process_time() - began < 5


# --- 10 --------------------------------------------------------------------------------------------------


def test_near_dedup_is_brute_force(spark):
    rows = []
    for i in range(60):
        base = prose(i, 150).split()
        rows.append((len(rows), " ".join(base)))
        for j in range(i % 4):
            w = list(base)
            for p in random.Random(i * 9 + j).sample(range(len(w)), 1 + j * 3):
                w[p] = "changed" + str(p)
            rows.append((len(rows), " ".join(w)))
    rows += [(900, rows[0][1]), (901, rows[0][1].upper())]
    a, b, some = simhash_dedup.fingerprints(*arrays([t for _, t in rows]))
    assert some.all()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (int(a[i]) ^ int(a[j])).bit_count() <= simhash_dedup.RADIUS and (int(b[i]) ^ int(b[j])).bit_count() <= simhash_dedup.VERIFY_RADIUS:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), set()).add(rows[i][0])
    want = {min(g): g for g in groups.values() if len(g) > 1}
    got = {}
    for r in simhash_dedup.near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r["group_id"], set()).add(r["doc_id"])
        assert r["keep"] == (r["doc_id"] == r["group_id"])
    assert got == want and len(want) > 20
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == {i for i, _ in rows} - {i for k, g in want.items() for i in g if i != k}


def test_allocation_covers_the_radius():
    r = np.random.default_rng(1)
    for _ in range(50):
        t = simhash_dedup.allocate(r.random((4, 6)), 8)
        assert sum(x + 1 for x in t) == 9 and min(t) >= -1


def test_near_dedup_edges(spark):
    d = clashing(frame(spark, EDGE))
    groups = simhash_dedup.near_duplicates(d).collect()
    assert sorted(r["doc_id"] for r in groups) == [5, 6] and {r["group_size"] for r in groups} == {3}
    kept = simhash_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 5, 7, 8] and None in ids
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert simhash_dedup.drop_near_duplicates(frame(spark, [])).count() == 0


def test_names_that_differ_in_case_alone_in_all_operators(spark):
    d = frame(spark, [(i, prose(i, 60)) for i in range(6)]).withColumn("c7__", F.lit(1))
    d = d.toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT").select("*", F.lit(3).alias("Doc_ID"), F.lit(2).alias("LANG"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (substring_dedup.repeated_passages, toxicity.toxicity, byte_bpe.encode, language_id.identify, curve_packing.pack, simhash_dedup.near_duplicates, lambda x: quality_rules.quality_scores(x, labels)):
        f(d).collect()
    for f in (substring_dedup.remove_passages, language_id.keep_known_languages, simhash_dedup.drop_near_duplicates, lambda x: quality_rules.keep_quality(x, labels)):
        out = f(d)
        assert out.columns == d.columns and out.count() == 6
    pages = spark.createDataFrame([(1, "<p>x", "y", 2)], "page_id int, html string, HTML string, PAGE_ID int")
    assert html_extraction.main_text(pages).first()["page_id"] == 1
    assert media_sniffing.media_types(pages, "page_id", "html").first()["page_id"] == 1
    chats = spark.createDataFrame([(1, 0, "user", "x", 9, "y")], "conv_id int, turn int, role string, text string, CONV_ID int, Text string")
    assert chat_quotes.conversations(chats).first()["conv_id"] == 1


# --- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = [(i, prose(i, 120).capitalize() + ".") for i in range(30)]
    near = [(50, good[0][1].replace(".", " indeed.")), (51, good[1][1])]
    shared = prose(777, 70)
    rows = [*EDGE, *good, *near, (60, prose(61, 40) + " " + shared), (61, prose(62, 40) + " " + shared), (70, " ".join(w.upper() + "%%!!" for w in good[3][1].split()))]
    clashing(frame(spark, rows)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 70 not in seen["quality_rules"] and set(range(30)) <= set(seen["quality_rules"])
    assert not {50, 51} & set(seen["simhash_near_dedup"]) and set(range(30)) <= set(seen["simhash_near_dedup"])
    last = seen["substring_dedup"]
    assert sum(shared in t for i, t in last.items() if i in (60, 61)) == 1
    packs = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {i for p in packs for i in p["doc_ids"]} == {i for i, t in last.items() if t.split()}
