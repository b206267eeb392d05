"""corpus_pipeline.run and each of its stages against brute force on a small corpus with the awkward cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, rules
from tessera.llm.common import BATCH_BYTES, small_batches
from tessera.llm.queries import tokenizer_file

from test_text_operators import VOCAB, _d2, _lower_words, _mcd, _removed, words

RNG = random.Random(21)
DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, set string, uid int"
PATH = tokenizer_file("piece_bpe_32k.model")


def _prose(n):
    return " ".join((w.capitalize() if RNG.random() < 0.1 else w) + ("." if RNG.random() < 0.12 else "") for w in RNG.choices(VOCAB, k=n))


ITEMS = [(1, _prose(20)), (2, _prose(12)), (3, None), (4, "")]


def _documents():
    out = [_prose(RNG.randint(40, 160)) for _ in range(120)]
    passage = _prose(60)
    for k in (3, 17, 44):
        out[k] = _prose(80) + " " + passage + " " + _prose(30)
    for k in (5, 50):
        out[k] = _prose(40) + " " + ITEMS[0][1].upper() + " " + _prose(40)
    out[60] = _prose(30) + " " + " ".join(ITEMS[1][1].split()[2:10]) + " " + _prose(30)
    copies = [out[10], out[10], " ".join("edit" if k == 7 else w for k, w in enumerate(out[11].split())) + " end"]
    junk = [" ".join(w + "***" for w in RNG.choices(VOCAB, k=60)) for _ in range(3)] + [None, "", "two words", " ".join(["same words over and over"] * 20)]
    return out + copies + junk


def _rows():
    rows = []
    for k, t in enumerate(_documents()):
        rows.append((k, t, ("en", "fr", None)[k % 3 if k % 7 == 0 else 0], f"s{k % 2}", None if t is None else len(t), k, "x", 1))
    return rows + [rows[20], (None, _prose(70), "en", "s0", 9, 1, None, None)]


def _ruled(rows):
    """Of each row whether the rules keep it: base rules, and the numpy estimate on vectors made in Python."""
    def vector(t):
        w = words(t)
        n, s = len(w), rules.SMOOTH
        chars, all_of = sum(map(len, w)), "".join(w)
        marks = sum(not c.isalnum() for c in all_of)
        x = [math.log((chars + 5 * s) / (n + s)), math.log((marks + 0.15 * s + 0.5) / (chars + 5 * s + 0.5)), math.log((sum(c.isupper() for c in all_of) + 0.1 * s + 0.5) / (chars + 5 * s + 0.5)), math.log(max(1, len(set(w)))) / math.log(max(2, n))]
        return [round(v, 9) for v in x]
    def failed(t):
        w = words(t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        gone = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w) < 10 or 100 * len(gone) > 20 * len(w)
    fine = [(k, r[2] or "none", r[3], vector(r[1])) for k, r in enumerate(rows) if not failed(r[1])]
    distinct = sorted({(a, b, tuple(x)) for _, a, b, x in fine})
    pools = {"all": (np.array([x for *_, x in distinct]), None)}
    for a in sorted({d[0] for d in distinct}):
        pools["l", a] = np.array([x for l, _, x in distinct if l == a]), "all"
    for a, b in sorted({d[:2] for d in distinct}):
        pools[a, b] = np.array([x for l, s, x in distinct if (l, s) == (a, b)]), ("l", a)
    fits, most = _mcd(pools), rules.chi_square(rules.D, rules.KEEP)
    kept = {k for k, a, b, x in fine if _d2(np.array([x]), fits[a, b])[0] <= most}
    return [r for k, r in enumerate(rows) if k in kept]


def _unique(rows):
    def shingles(t):
        w = words((t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))
    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    best = {}
    for k, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, k)
        best[root(k)] = min(best.get(root(k), (key, r)), (key, r), key=lambda x: x[0])
    return [r for _, r in best.values()]


def _without_passages(rows):
    out = []
    for r, (_, gone, kept) in zip(rows, _removed([r[1] for r in rows], 35), strict=True):
        t = " ".join(kept) if gone else r[1]
        out.append((r[0], t, r[2], r[3], None if t is None else len(t), *r[5:]))
    return out


def _clean(rows):
    windows = set()
    for _, t in ITEMS:
        w = _lower_words(t)
        windows |= {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7) if w else 0)}
    def leaks(t):
        w = _lower_words(t)
        return any(tuple(w[i : i + len(p)]) == p for p in windows for i in range(len(w) - len(p) + 1))
    return [r for r in rows if not leaks(r[1])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(_rows(), DOC).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


BRUTE = [_ruled, _unique, _without_passages, _clean]


@pytest.mark.parametrize("k", range(4))
def test_stage(spark, folder, k):
    """Each stage on the whole corpus, junk, nulls, empty texts and repeated rows included."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    got = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(BRUTE[k](given))
    none = corpus_pipeline.STAGES[k][1](spark, docs.limit(0), folder)
    assert none.columns == docs.columns and none.count() == 0


def test_run(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    for brute in BRUTE:
        rows = brute(rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = Counter((r[0], tuple(lib.encode(r[1])), r[1]) for r in rows)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
    assert 5 not in {k for k, *_ in got} and 60 not in {k for k, *_ in got} and len(got) > 90


def test_run_on_an_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_removed_stage_changes_the_result(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.clean(docs, bench).count() < docs.count()
    assert docs.filter(F.col("text").contains("***")).count() == 3 and not [r for r in rules.filtered(docs).collect() if re.search(r"\*\*\*", r["text"])]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_python_gets_small_batches(spark, folder, k):
    """After a stage that runs Python, rows of 12 MB go to it 2 MB at a time, and no row is lost."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([[b.num_rows], [b.nbytes]], ["n", "size"])

    got = spark.range(0, 600, 1, 1).selectExpr("id", "repeat('x', 20000) as text").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 600 and max(r["size"] for r in got) <= BATCH_BYTES + 25_000


def test_a_smaller_batch_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1m")
    small_batches(spark)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
