"""The stored index against a scoring of every document, channels under a deadline, and the caps' exact ways."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import coupling, deadline, lexical, memory, rank, retrieval


def best(docs, queries, limit):
    split = {i: [w for w in (t or "").split() if len(w) > 1] for i, t in docs}
    n, avg = len(split), sum(map(len, split.values())) / max(len(split), 1)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = set()
    for q, text in queries:
        scores = {}
        for i, ws in split.items():
            s = 0.0
            for w in {w for w in text.split() if len(w) > 1}:
                if tf := ws.count(w):
                    s += max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
            if any(w in ws for w in text.split() if len(w) > 1):
                scores[i] = round(s, 6)
        for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:limit], 1):
            out.add((q, i, r, round(s, 5)))
    return out


@pytest.mark.parametrize(("shard", "first"), [(64, 8), (3, 1), (1, 2)])
def test_search_finds_what_scoring_all_finds(spark, monkeypatch, shard, first):
    monkeypatch.setattr(lexical, "FIRST", first)
    rng = random.Random(4)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for k in range(150)] + [(900, None), (901, ""), (902, "x y z")]
    docs += [(903, docs[3][1]), (904, docs[3][1])]  # ties go by id
    queries = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 20])))) for k in range(15)] + [(50, ""), (51, "unknown words"), (52, docs[3][1])]
    index = lexical.build_index(spark.createDataFrame(docs, "id long, text string").repartition(3), shard=shard)
    got = lexical.search(lexical.open_index(spark, index.path), spark.createDataFrame(queries, "q long, text string"), 6)
    assert {(r["q"], r["id"], r["rank"], round(r["score"], 5)) for r in got.collect()} == best(docs, queries, 6)


def test_a_search_reads_its_terms_folders_only(spark):
    rows = spark.range(4_000).select("id", F.concat_ws(" ", F.concat(F.lit("t"), F.col("id") % 97), F.lit("common")).alias("text"))
    index = lexical.build_index(rows)
    assert index.parts >= 8
    one = spark.createDataFrame([(1, "t5")], "q int, text string")
    _, parts = lexical._asked(index, one)
    assert len(parts) == 1
    plan = index.table("postings").filter(F.col("part").isin(parts))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan
    assert lexical.search(index, one, 100).count() == 42


def test_an_index_of_nothing(spark):
    index = lexical.build_index(spark.createDataFrame([], "id long, text string"))
    assert lexical.search(index, spark.createDataFrame([(1, "a b")], "q int, text string")).count() == 0


def test_a_late_channel_is_left_out(spark):
    def slow():
        wait = F.udf(lambda x: (time.sleep(120), x)[1], "long")
        return spark.range(1).select(wait("id").alias("id"))

    began = time.time()
    got = deadline.within(spark, {"quick": lambda: spark.range(5), "slow": slow, "broken": lambda: spark.table("no_such_table")}, 20)
    assert time.time() - began < 90 and got.channels["quick"].count() == 5
    assert got.degraded_channels == {"slow": "timeout", "broken": "error"}
    assert spark.range(3).count() == 3


def test_caps_have_an_exact_way(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(1000))))], "id int, text string")
    assert retrieval.chunks(docs, "id", "text").count() == 22 and retrieval.chunks(docs, "id", "text", most=3).count() == 3
    rows = spark.createDataFrame([(1, k, float(k)) for k in range(1500)], "q int, id int, score double")
    assert rank.union_channels({"a": rows}).count() == 1500 and rank.union_channels({"a": rows}, cap=10).count() == 10
    touches = spark.createDataFrame([(c, k) for c in range(3) for k in range(30)], "commit int, item int")
    assert coupling.pairs(touches, most=None).count() == 435 and coupling.pairs(touches).count() == 0
    text = spark.createDataFrame([("fooBar " + "x" * 5000,)], "t string")
    whole, cut = text.select(exprs.search_text(F.col("t")), exprs.search_text(F.col("t"), 2000, 9)).first()
    assert whole == "fooBar " + "x" * 5000 + " foo Bar " + "x" * 5000 and cut == "fooBar fo"
    events = spark.createDataFrame([(k, 1, k * 60, "a", 0) for k in range(40)], "id long, scope long, s long, shape string, bad int").withColumn("ts", F.timestamp_seconds("s"))
    passes = lambda n: memory.rituals(events, F.col("bad") == 1, recent=n).first()["passes"]
    assert passes(None) == 40 and passes(10) == 10


def test_channels_that_found_nothing_do_not_weigh(spark):
    a = spark.createDataFrame([(1, 7, 1.0), (2, 8, 1.0)], "q int, id int, score double")
    b = spark.createDataFrame([(1, 7, 1.0)], "q int, id int, score double")
    got = {r["q"]: r["fused"] for r in rank.fuse({"a": (a, 1.0), "b": (b, 0.5)}).collect()}
    assert got == {1: round(1 / 60, 9), 2: round(1 / 60, 9)}


@pytest.mark.parametrize("allowed", [False, True])
def test_a_search_shuffles_terms_and_not_pairs(spark, monkeypatch, allowed):
    """Many groups and blocks give what one gives, and no row of a query and a document is exchanged before it is an answer."""
    from tessera.operators import blocks

    rng = random.Random(5)
    docs = [(k, " ".join(f"w{rng.randint(10, 40)}" for _ in range(rng.randint(1, 12)))) for k in range(400)]
    index = lexical.build_index(spark.createDataFrame(docs, "id long, text string"), shard=4)
    queries = spark.createDataFrame(docs[::10], "q long, text string")
    few = spark.range(400).filter("id % 3 = 0") if allowed else None
    want = {(r["q"], r["id"], r["rank"], round(r["score"], 5)) for r in lexical.search(index, queries, 5, few).collect()}
    assert len(want) == 200 and (not allowed or all(i % 3 == 0 for _, i, _, _ in want))
    monkeypatch.setattr(blocks, "ENTRIES", 50)
    monkeypatch.setattr(blocks, "TERMS", 30)
    got = lexical.search(index, queries, 5, few)
    assert {(r["q"], r["id"], r["rank"], round(r["score"], 5)) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [q" not in plan and "inline" not in plan.lower()


def test_relevance_counts_pairs_where_they_meet(spark):
    docs = spark.createDataFrame([(k, "xy"[k % 2] if k < 30 else None, f"t{k % 5} t{k % 7} all") for k in range(40)], "id long, grp string, text string")
    telling = lexical.distinctive(docs, "grp", "text", share=0.5)
    got = lexical.relevance(docs.filter("id % 4 = 0").withColumnRenamed("id", "q"), docs, telling, "grp")
    split = {r["id"]: (r["grp"], set(r["text"].split())) for r in docs.collect()}
    known = {(r["grp"], r["term"]) for r in telling.collect()}
    want = set()
    for q, (g, a) in split.items():
        for i, (h, b) in split.items():
            n = sum((g, w) in known for w in a & b)
            if q % 4 == 0 and g and g == h and n:
                want.add((q, i, n))
    assert {tuple(r) for r in got.collect()} == want
    assert "Aggregate [q" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_build_shuffles_shards_lists_and_not_each_count(spark):
    from tests.test_growth import moved

    rng = random.Random(6)
    docs = [(k, " ".join(f"w{rng.randint(10, 60)}" for _ in range(30))) for k in range(3_000)]
    frame = spark.createDataFrame(docs, "id long, text string")
    index, rows = moved(spark, lambda: lexical.build_index(frame))
    assert rows < 3_000  # some 70,000 counts of a term in a document
    queries = docs[::500]
    got = lexical.search(index, spark.createDataFrame(queries, "q long, text string"), 6)
    assert {(r["q"], r["id"], r["rank"], round(r["score"], 5)) for r in got.collect()} == best(docs, queries, 6)


def test_packed_words_are_the_terms_of_texts(spark, monkeypatch):
    from tessera.operators import blocks

    monkeypatch.setattr(blocks, "BYTES", 40)
    texts = ["ab", "cd ef", None, "", "AB cd-ab_x", "Ünïcode ÉA1 İstanbul Kelvin straße", "a b c 9", " x1\ny22\ty22 ", "日本ab語cd", "end9", "9start", "aa" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    want = Counter((r["id"], w) for r in rows.select("id", exprs.terms(F.col("text")).alias("w")).collect() for w in r["w"] or [])
    got, lens, shards = Counter(), {}, Counter()
    held = blocks.packed(rows.select("id", F.lower("text").alias("text")), 3).collect()
    own = {r["shard"]: r for r in held if r["term"] is None}
    for r in held:
        for at, tf in zip(r["ats"], r["tfs"]) if r["term"] else ():
            got[own[r["shard"]]["ids"][at], r["term"]] += tf
        assert r["term"] is None or r["docs"] == len(r["ats"])
    for r in own.values():
        lens |= dict(zip(r["ids"], r["lens"]))
    assert got == want and sorted(lens) == list(range(len(texts))) and all(len(r["ids"]) <= 3 for r in own.values())
    assert all(n == sum(k for (i, _), k in want.items() if i == d) for d, n in lens.items())


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_frequent_terms_that_cannot_lift_a_document_are_left(spark, monkeypatch, share):
    from tessera.operators import blocks

    rng = random.Random(7)
    vocab = [f"w{int(rng.paretovariate(0.5))}" for _ in range(200)]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for k in range(500)]
    docs += [(600 + k, docs[k][1]) for k in range(0, 60)]  # ties go by id
    queries = [(k, docs[k][1]) for k in range(0, 500, 25)] + [(900, "w1 w2 w3")]
    index = lexical.build_index(spark.createDataFrame(docs, "id long, text string").repartition(5), shard=16)
    monkeypatch.setattr(blocks, "ENTRIES", 200)
    monkeypatch.setattr(blocks, "DENSE", share)
    monkeypatch.setattr(lexical, "FIRST", 2)
    got = lexical.search(index, spark.createDataFrame(queries, "q long, text string"), 6)
    assert {(r["q"], r["id"], r["rank"], round(r["score"], 5)) for r in got.collect()} == best(docs, queries, 6)


def test_error_lookup_counts_shared_terms_where_they_meet(spark, monkeypatch):
    """Signatures come without their texts: what they share with a query is counted by the search."""
    from tessera.operators import blocks

    monkeypatch.setattr(blocks, "ENTRIES", 50)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(10, 40)]
    texts = {k: " ".join(rng.choices(words, k=rng.randint(1, 9))) for k in range(200)}
    index = lexical.build_index(spark.createDataFrame(list(texts.items()), "id long, text string"), shard=16)
    places = spark.createDataFrame([(k, f"f{k}", "s", k, "commit") for k in texts], "id long, file string, symbol string, fact long, origin string")
    asked = {1: texts[3] + " nowhere", 2: "w10", 3: texts[7] + " w11 w12 w13 w14 w15 w16 w17"}
    got = lexical.error_lookup(index, places, spark.createDataFrame(list(asked.items()), "q long, text string"), 200)
    want = set()
    for q, text in asked.items():
        terms = set(text.split())
        for k, t in texts.items():
            if len(terms & set(t.split())) >= min(len(terms), max(2, math.ceil(len(terms) * 0.3))):
                want.add((q, f"f{k}"))
    assert want and {(r["q"], r["file"]) for r in got.collect()} == want
