"""The operators against brute force on small tables with the awkward cases."""

import hashlib
import html
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, neardup, pages, pieces, quality, rules, simhash, substrings, tokens, toxicity
from tessera.llm.common import components
from tessera.llm.queries import tokenizer_file
from tessera.llm.trees import fit

RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
DOC = "doc_id long, text string, lang string, source string, n_chars long, id int, block int, uid string"


def prose(n, vocab=VOCAB):
    return " ".join(RNG.choice(vocab) for _ in range(n))


def texts():
    shared, base = prose(60), prose(200)
    near = base.split()
    near[50] = "changed"
    odd = [None, "", " \n\t ", "one", "two words", "a b a b a b " * 40, "same " * 100, "é ñ 漢字 🙂 ▁ x\x00y", "|||| ### $$$", base, base, " ".join(near)]
    odd += [prose(30) + "\n" + shared + "\n" + prose(40), prose(10) + " " + shared, "Line\nLine\nother\nLine", prose(9000)]
    return odd + [prose(RNG.randint(5, 300)) for _ in range(60)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, t, RNG.choice(["en", "de", None]), RNG.choice(["s0", "s0", None]), 0, 1, 2, "u") for k, t in enumerate(texts())]
    rows += [rows[9], (None, "null id here", None, None, 0, 1, 2, "u")]
    return spark.createDataFrame(rows, DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rule_counts(corpus, spark):
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    got = by_id(rules.op3(corpus))
    assert len(got) == corpus.count()
    for r in got:
        t = text[r["doc_id"]] or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            if seen[g] > 1:
                hit.update(range(i, i + 5))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert rules.op3(empty(spark)).count() == 0


def _moments_of(x, weight, scale):
    n = weight.sum()
    m = (weight[:, None] * x).sum(0) / n
    return m, scale * ((weight[:, None] * x).T @ x / n - np.outer(m, m))


def _mixed(n, own, up):
    w = rules.SHRINK / (n + rules.SHRINK)
    gap = own[0] - up[0]
    return own[0] - w * gap, (1 - w) * own[1] + w * up[1] + w * (1 - w) * np.outer(gap, gap)


def _d2(x, fit):
    return np.einsum("ni,ij,nj->n", x - fit[0], np.linalg.inv(fit[1]), x - fit[0])


def _mcd(pools):
    """{name: (vectors, parent)} with parents first: {name: (centre, scatter)}, the estimate in numpy, step by step."""
    p = rules.D
    starts = []
    for k in (0, 1):
        own = {}
        for name, (x, _) in pools.items():
            q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
            robust = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)
            own[name] = robust if k else _moments_of(x, np.ones(len(x)), 1.0)
            if name == "all":
                target = robust
        starts.append(own)
    def shrunk(own):
        out = {}
        for name, (x, up) in pools.items():
            out[name] = _mixed(len(x), own[name], out[up] if up else target)
        return out
    logdet = lambda fits: {k: np.linalg.slogdet(f[1])[1] for k, f in fits.items()}
    fits = [shrunk(own) for own in starts]
    for _ in range(rules.STEPS):
        before = [logdet(f) for f in fits]
        done = []
        for f in fits:
            own = {}
            for name, (x, _) in pools.items():
                bins = np.floor(rules.BINS * np.log(np.maximum(_d2(x, f[name]), 1e-9))).astype(int)
                need, weight = np.ceil(rules.COVER * len(x)), np.zeros(len(x))
                for b in np.unique(bins):
                    inside = bins == b
                    weight[inside] = min(1, max(0, need / inside.sum()))
                    need -= inside.sum()
                own[name] = _moments_of(x, weight, rules._consistent(rules.COVER))
            done.append(shrunk(own))
        fits = done
        if max(abs(logdet(f)[k] - b[k]) for f, b in zip(fits, before, strict=True) for k in pools) <= rules.SETTLED:
            break
    best = {k: min(fits, key=lambda f: np.linalg.slogdet(f[k][1])[1])[k] for k in pools}
    own = {k: _moments_of(x, (_d2(x, best[k]) <= rules.chi_square(p, rules.REWEIGHT)).astype(float), rules._consistent(rules.REWEIGHT)) for k, (x, _) in pools.items()}
    return shrunk(own)


def _stats(docs):
    return rules.with_statistics(docs.select("*", F.col("text").alias("_text"), F.col("lang").alias("_lang_of"), F.col("source").alias("_source_of")))


def _ruled(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = _stats(docs)
    return rules.judged(stats, rules.fit(stats)).orderBy("doc_id").select("doc_id", "lang", "source", *[f"_x{i}" for i in range(rules.D)], "_base_failed", "d2", "kept").toPandas()


def _varied(rng, n):
    w = [x.capitalize() if rng.random() < 0.1 else x for x in rng.choice(VOCAB, n)]
    return " ".join(x + ("." if rng.random() < 0.12 else "") for x in w)


def test_mcd_against_numpy(spark):
    """Groups of many texts and of few, a null language and a lone source: each estimate equals the numpy version's."""
    rng = np.random.default_rng(1)
    rows = []
    for lang, source, n in (("en", "a", 120), ("en", "b", 60), ("en", "c", 5), ("fr", "a", 40), (None, "t", 2)):
        for _ in range(n):
            k = len(rows)
            t = _varied(rng, int(rng.integers(30, 120)))
            rows.append((k, t + (" ### |||" * int(rng.integers(5, 30)) if k % 11 == 0 else ""), lang, source))
    rows += [(900, rows[0][1], "en", "a"), (999, "two words", "xx", "t")]
    got = _ruled(spark, rows)
    assert len(got) == len(rows)
    fine = got[~got["_base_failed"]]
    x = lambda part: np.unique(part[[f"_x{i}" for i in range(rules.D)]].to_numpy(), axis=0)
    lang = fine["lang"].fillna("none")
    whole = fine.assign(lang=lang).drop_duplicates(["lang", "source", *[f"_x{i}" for i in range(rules.D)]])
    columns = [f"_x{i}" for i in range(rules.D)]
    pools = {"all": (whole[columns].to_numpy(), None)}
    pools |= {("l", a): (whole[whole["lang"] == a][columns].to_numpy(), "all") for a in whole["lang"].unique()}
    pools |= {(a, b): (g[columns].to_numpy(), ("l", a)) for (a, b), g in whole.groupby(["lang", "source"])}
    fits = _mcd(pools)
    for (a, b), g in fine.assign(lang=lang).groupby(["lang", "source"]):
        assert np.allclose(g["d2"], _d2(g[columns].to_numpy(), fits[a, b]), rtol=1e-5), (a, b)
    assert (fine["kept"] == (fine["d2"] <= rules.chi_square(rules.D, rules.KEEP))).all()
    junk = fine["doc_id"] % 11 == 0
    assert not fine[junk & (fine["doc_id"] < 900)]["kept"].any() and fine[~junk]["kept"].mean() > 0.98


def test_outlier_visible_only_jointly(spark):
    """Word length and variety go together in these texts; a text of long words and little variety is odd in neither alone."""
    rng = np.random.default_rng(5)
    def text(long, repeat, n=200):
        words = ["".join(rng.choice(list("abcdefgh"), 4 + int(5 * long))) for _ in range(n)]
        return " ".join(words[int(rng.integers(0, max(1, n * (1 - repeat))))] if rng.random() < 0.9 else w for w in words)
    rows = [(k, text(u := k % 50 / 50, 0.9 * (1 - u) ** 0.5), "en", "s") for k in range(400)]
    rows += [(1000 + k, text(0.9, 0.85), "en", "s") for k in range(4)]
    got = _ruled(spark, rows)
    odd = got["doc_id"] >= 1000
    for i in range(rules.D):
        lo, hi = got[~odd][f"_x{i}"].min(), got[~odd][f"_x{i}"].max()
        assert got[odd][f"_x{i}"].between(lo, hi).all() or i in (1, 2)
    assert not got[odd]["kept"].any() and got[~odd]["kept"].mean() > 0.97


def test_rules_of_copies_constants_and_odd_tables(spark):
    rng = np.random.default_rng(6)
    one = _varied(rng, 80)
    # copies count once: they do not make the rest of their source outliers
    rows = [(k, one, "en", "s") for k in range(300)] + [(500 + k, _varied(rng, 80), "en", "s") for k in range(60)]
    got = _ruled(spark, rows)
    assert got["kept"].mean() > 0.97
    # only copies: no coordinate has spread, and none departs
    assert _ruled(spark, [(k, one, None, None) for k in range(20)])["kept"].all()
    clash = spark.createDataFrame([(k, _varied(rng, 60), "en", "s", k, k, k, "r") for k in range(30)] + [(None, None, None, None, 1, 1, 1, None), (7, "", "en", "s", 1, 1, 1, None)], "doc_id long, text string, lang string, source string, _x0 int, kept int, d2 int, _row string")
    kept = rules.filtered(clash)
    assert kept.columns == clash.columns and kept.count() == 30
    assert rules.op3(empty(spark)).count() == 0 and rules.filtered(empty(spark)).count() == 0
    long = spark.createDataFrame([(1, " ".join(_varied(rng, 200_000).split()), "en", "s"), (2, _varied(rng, 60), "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["n_words"] for r in rules.op3(long).collect()} == {1: 200_000, 2: 60}


def _fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(corpus, spark):
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    fp = {k: _fingerprint(t) for k, t in text.items()}
    parent = {k: k for k in fp}
    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    group = {}
    for k in fp:
        group.setdefault(root(k), []).append(k)
    got = simhash.op5(corpus).collect()
    assert len(got) == corpus.count()
    for r in got:
        members = [k for k in group[root(r["doc_id"])] if k is not None]
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == (min(members) if members else None)
    assert simhash.op5(empty(spark)).count() == 0
    kept = simhash.deduplicated(corpus)
    assert kept.columns == corpus.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in got}


def _near_corpus():
    """Texts with copies of one to eight changed words, so that similarities lie on both sides of 0.8."""
    out = []
    for _ in range(40):
        base = prose(120).split()
        out.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 8):
            w = list(base)
            for at in RNG.sample(range(len(w)), edits):
                w[at] = "edit%d" % RNG.randrange(10**6)
            out.append(" ".join(w))
    return [None, "", "a b", "A  b"] + out


def test_near_duplicates_on_five_word_shingles(spark):
    """The stage removes what links at a similarity of 0.8 or more, as brute force finds it."""
    import corpus_pipeline

    all_texts = _near_corpus()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in all_texts]
    parent = list(range(len(sets)))
    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for b in range(len(sets)):
        for a in range(b):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(sets)) if root(k) == k]
    assert neardup.deduplicated(docs.limit(0)).count() == 0


def test_near_duplicates_by_row_not_id(spark):
    """Of a class one row stays, whatever ids are null or repeat."""
    import corpus_pipeline

    one, two = prose(50), prose(50)
    docs = spark.createDataFrame([(None, one), (1, one), (1, one), (None, two), (None, two), (None, prose(50)), (2, prose(50)), (2, prose(50))], "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 5 and (1, one) in kept and (None, two) in kept and sum(k == 2 for k, _ in kept) == 2


def _parts(members, edges):
    parent = {int(x): int(x) for x in members}
    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for k in parent:
        groups.setdefault(root(k), set()).add(k)
    return sorted(sorted(g) for g in groups.values())


def test_posting_lists_dense_and_sparse(monkeypatch):
    rng = np.random.default_rng(0)
    fp = np.unique(np.uint64(0x123456789ABCDEF0) ^ (rng.integers(0, 1 << 16, 600).astype(np.uint64) << np.uint64(24)))
    list_number = simhash.LISTS.index((0, 1, 6, 7))
    posting = len(simhash.LISTS) + [key for own in simhash.POSTINGS for key in own].index((0, 1, 6, 7, 2, 5))
    dense = simhash.linked(fp, list_number)
    assert _parts(fp, simhash.linked(fp, posting)) == _parts(fp, dense)
    monkeypatch.setattr(simhash, "DENSE", 10**6)
    assert _parts(fp, dense) == _parts(fp, simhash.linked(fp, list_number))
    assert simhash.tally(np.array([0x11223344], np.uint64), np.array([0x11FF3344], np.uint64)).tolist() == [7]


@pytest.mark.parametrize(("dense", "long"), [(128, 50_000), (3, 50_000), (3, 2)])
def test_links_against_all_pairs(spark, monkeypatch, dense, long):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(60):
        centre = rng.getrandbits(64)
        fps.update(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for _ in range(12))
    fps.update(5 ^ (k << 24) for k in rng.sample(range(1 << 16), 300))
    fps = sorted(fps)
    want = _parts(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2])
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "LONG", long)
    rows = [((k - (1 << 64) if k >> 63 else k),) for k in fps]
    # the worker processes see DENSE as it is in the module, so the lists are linked here too
    got = simhash.links(spark.createDataFrame(rows, "fp long")).collect()
    assert _parts(fps, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in got]) == want
    members = np.array(fps, np.uint64)
    here = [e for n in range(6) for at in simhash._groups(members & np.uint64(simhash.MASKS[n]), members) for e in simhash.linked(members[at], n)]
    assert _parts(fps, here) == want


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)]
    got = components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    assert len(got) == 301 + 400 and got[got["node"] <= 300]["root"].nunique() == 1 and got[got["node"] >= 1000]["root"].nunique() == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 100, 1])
def test_components_need_no_rounds_on_a_small_graph(spark, monkeypatch, most):
    from tessera.llm import common

    labels, write = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, label: (labels.append(label), write(df, label))[1])
    monkeypatch.setattr(common, "EDGES_PER_TASK", most)
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(150)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(-900, -100), rng.randrange(-900, -100)) for _ in range(400)] + [(7000, 7000)]
    before = common.made()
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, parts.values())) == _parts({k for e in edges for k in e if e[0] != e[1]}, edges[:-1])
    assert len(got) == len({r["node"] for r in got}) and all(k in v for k, v in parts.items())
    assert ("moves" in labels) == (most < len(edges))
    assert len(common.made() - before) == 1


def test_near_duplicates_go_through_the_simhash_index(spark, monkeypatch):
    """Without the minima, what the index links within two bits still goes, as far as the shingle sets bear it out."""
    monkeypatch.setattr(neardup, "_stars", lambda batches: iter(()))
    monkeypatch.setattr(neardup, "_partial_stars", lambda batches: iter(()))
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join(["other", *base[1:]]), " ".join(rng.sample(base, 400))]
    texts += ["one two", "one  Two", "three", None, ""]
    sets = [neardup.shingle_set(t.encode() if t else None) for t in texts]
    fp = [simhash.majority(x) for x in sets]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    alike = [(i, j) for g in _parts(range(len(texts)), pairs) for i in g for j in g if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    want = sorted(g[0] for g in _parts(range(len(texts)), alike))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs).collect()) == want and len(want) < len(texts) - 30


@pytest.mark.parametrize("split", [3, 7, 10**6])
def test_large_components_verified_in_blocks(spark, monkeypatch, split):
    """Chains whose ends are far apart, tight groups and false candidates give the classes of all pairs, however they are split."""
    monkeypatch.setattr(neardup, "SPLIT", split)
    rng = random.Random(31)
    texts = []
    chain = [f"w{rng.randrange(9000)}" for _ in range(120)]
    for k in range(40):
        texts.append(" ".join(chain))
        chain[(3 * k) % 120 : (3 * k) % 120 + 3] = [f"c{k}a", f"c{k}b", f"c{k}c"]
    for _ in range(3):
        base = [f"w{rng.randrange(9000)}" for _ in range(150)]
        texts += [" ".join([*base[:j], "x", *base[j + 1 :]]) for j in rng.sample(range(150), 20)]
    texts += [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(30)]
    rng.shuffle(texts)
    sets = [neardup.shingle_set(t.encode()) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    want = sorted(g[0] for g in _parts(range(len(texts)), alike))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs).collect()) == want and len(want) == 34
    # one candidate component of everything: the links alone part it
    rows = [(0, k, x.tobytes()) for k, x in enumerate(sets)]
    held = spark.createDataFrame(rows, "root long, set long, members binary")
    sizes = spark.createDataFrame([(0, len(rows))], "root long, n long")
    links = [tuple(r) for r in neardup._split_links(held, sizes, 0.8).collect()]
    assert set(links) <= {*alike, *((j, i) for i, j in alike)} and _parts(range(len(texts)), links) == _parts(range(len(texts)), alike)


def test_near_duplicates_missed_on_the_given_documents(spark):
    """Recall of the pipeline's near-dedup at sf0.01 against an exact join of the five-word sets: nothing missed, nothing extra."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], neardup.shingle_set((r["text"] or "").encode())) for r in docs.collect())
    holders = {}
    for k, (_, s) in enumerate(rows):
        for x in s.tolist():
            holders.setdefault(x, []).append(k)
    shared = Counter(pair for h in holders.values() if len(h) > 1 for n, i in enumerate(h) for pair in ((i, j) for j in h[:n]))
    alike = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(rows[i][1]) + len(rows[j][1]) - n) - 1e-9]
    empty = [k for k, (_, s) in enumerate(rows) if not len(s)]
    want = sorted(rows[g[0]][0] for g in _parts(range(len(rows)), alike + [(k, empty[0]) for k in empty[1:]]))
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs).select("doc_id").collect()) == want


def test_a_stage_leaves_only_what_its_result_reads(spark):
    from tessera.llm.common import made

    docs = spark.createDataFrame([(k, prose(60), "en", "s") for k in range(60)], "doc_id long, text string, lang string, source string")
    docs = docs.unionAll(docs.limit(5))
    for stage, left in ((neardup.deduplicated, 3), (rules.filtered, 3)):
        before = made()
        out = stage(docs)
        assert len(made() - before) <= left and 0 < out.count() <= 65


def _removed(all_texts, size):
    docs = [words(t) for t in all_texts]
    seen = Counter(tuple(w[i : i + size]) for w in docs for i in range(len(w) - size + 1))
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out


def test_substrings(corpus, spark):
    rows = corpus.collect()
    want = Counter((r["doc_id"], n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, (n, g, k) in zip(rows, _removed([r["text"] for r in rows], 35), strict=True))
    got = Counter(tuple(r) for r in substrings.op10(corpus).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want and sum(g for _, _, g, _ in want.elements()) > 500
    assert substrings.op10(empty(spark)).count() == 0
    left = {r["doc_id"]: r for r in substrings.deduplicated(corpus).collect()}
    assert left[0]["text"] is None and left[3]["text"] == "one" and left[13]["n_chars"] == len(left[13]["text"])


@pytest.mark.parametrize("vocab", [1, 2, 5, 1000])
def test_equal_windows_get_equal_anchors(vocab):
    core = [RNG.randrange(vocab) for _ in range(60)]
    docs = [" ".join(f"w{x}" for x in [RNG.randrange(vocab) for _ in range(RNG.randint(0, 40))] + core + [RNG.randrange(vocab) for _ in range(RNG.randint(0, 40))]).encode() for _ in range(6)]
    h, edges = substrings._words(docs)
    at, pos, label = substrings._parse(h, edges, 35)
    seen = {}
    for i, p, name in zip(at.tolist(), pos.tolist(), label.tolist(), strict=True):
        assert seen.setdefault(h[i : i + 35].tobytes(), (p - i, name)) == (p - i, name) and i <= p < i + 35


def _lower_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, corpus, monkeypatch):
    rows = [r for r in corpus.collect() if r["text"]]
    items = [(k, " ".join(r["text"].split()[5:25]).upper()) for k, r in enumerate(rows[:30])] + [(90, None), (91, "!!"), (92, "one"), (93, "two, words"), (94, "same same same same same same same same same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    patterns = []
    for k, t in items:
        w = _lower_words(t)
        patterns += [(str(k), w[i : i + 8]) for i in range(max(1, len(w) - 7) if w else 0)]
    def brute(t):
        w, hit, own = _lower_words(t), set(), set()
        for k, p in patterns:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    own.add(k)
        return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= 2
    want = Counter((r["doc_id"], *brute(r["text"])) for r in corpus.collect())
    got = Counter(tuple(r) for r in decontaminate.op9(corpus, bench).collect())
    assert got == want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    assert Counter(tuple(r) for r in decontaminate.op9(corpus, bench).collect()) == want
    clean = decontaminate.clean(corpus, bench, at_least=2)
    assert clean.columns == corpus.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.clean(corpus, bench).count() == sum(n for k, n in want.items() if not k[3])
    assert decontaminate.op9(corpus, bench.limit(0)).filter("n_hit > 0").count() == 0 and decontaminate.op9(empty(spark), bench).count() == 0


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    more = spark.createDataFrame([(900, "<|endoftext|>a<|endoftext|> b"), (901, "it's  1² “quoted” — don't\n\n\tx"), (902, "word " * 300_000)], "doc_id long, text string")
    docs = corpus.select("doc_id", "text").unionByName(more)
    text = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r for r in tokens.op6(docs, path).collect()}
    for k, t in text:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert tokens.op6(empty(spark), path).count() == 0
    # the result is the same wherever the common pre-tokens end
    whole = sorted(map(tuple, tokens.token_counts(docs, path).collect()), key=repr)
    for common in (0, 50):
        assert sorted(map(tuple, tokens.token_counts(docs, path, common=common).collect()), key=repr) == whole


def test_regex_libraries_agree_on_pretokens():
    c = tokens.Splitter(tokenizer_file("byte_bpe_50k.json"))
    for x in range(0x2100):
        if not tokens._OTHER.search(ch := chr(x)):
            t = f"a{ch}b {ch} 1{ch}{ch}  {ch}c\n{ch}"
            assert c.findall(t) == [t[i:j] for _, (i, j) in c.tokenizer.pre_tokenizer.pre_tokenize_str(t)]


def test_pieces_equal_the_library(spark, corpus):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(pieces.transduce(corpus, path))
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for r in got:
        t = text[r["doc_id"]]
        if t is None:
            assert r["ids"] is None and r["decoded"] is None and r["n_pieces"] == 0
        else:
            assert r["ids"] == lib.encode(t) and r["decoded"] == lib.decode(r["ids"]) and ("▁" in t or r["decoded"] == t)
    fst = pieces.Transducer(path)
    alphabet = "abcde  éß\n\t漢字🙂aa....--  0123<s>"
    cases = ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 50))) for _ in range(500)] + ["".join(RNG.sample(list(fst.id), 3)).replace("▁", " ") for _ in range(500)]
    assert [fst.encode(s).tolist() for s in cases] == lib.encode(cases)


def test_longest_common_subsequence():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]
    for _ in range(300):
        a, b = ([RNG.choice("abcd") for _ in range(RNG.randint(0, 12))] for _ in range(2))
        s = pages.shared(a, b)
        rest = iter(b)
        assert len(s) == length(a, b) and all(a[i] in rest for i in s) and s == sorted(s)


def test_pages(spark):
    frame = "<p>Frame one</p>{}<p>Frame two</p>"
    rows = [(k, f"http://h.example/a/{k}?q#f", f"<html><head><title>t</title></head><body>{frame.format(f'<p>own &amp; {k}  text</p>')}</body></html>") for k in range(6)]
    rows += [(10, "http://x.example/1", "<nav>m</nav><article><h1>T</h1><p>in <b>bold</b>\n text<p class=ad>no<p>yes</article><footer>f</footer><div id=comments>c</div>"), (11, None, "<p>alone"), (12, "http://y/", None), (13, "http://y/", ""), (14, "bad url", "<<p>>a<b<script>x</scr"), (10, "http://x.example/1", "<article><p>in</article>")]
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in pages.op7(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert all((k, f"own & {k} text", len(f"own & {k} text")) in got for k in range(6))
    assert (10, "T\nin bold text\nyes", 18) in got and (10, "in", 2) in got and (11, "alone", 5) in got and (12, "", 0) in got and (13, "", 0) in got
    assert sum(got.values()) == len(rows)
    assert pages.op7(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _labelled(spark, n=600):
    bad = ["grak", "blorf", "zint"]
    rows, labels = [], []
    for k in range(n):
        toxic, good = int(k % 4 == 0), int(k % 3 != 0)
        w = prose(RNG.randint(20, 120)).split()
        if toxic:
            for b in RNG.sample(bad, 2):
                w.insert(RNG.randrange(len(w)), b)
        if not good:
            w = [x + "&&&" for x in w]
        rows.append((k, " ".join(w), "en" if k % 2 else "fr"))
        labels.append((k, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_learn(spark):
    docs, labels = _labelled(spark)
    for op, label in ((quality.op2, "quality"), (toxicity.op8, "toxic")):
        got = op(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
        assert len(got) > 80 and (got["predicted"] == got[label]).mean() > 0.97 and got["score"].between(0, 1).all()
        for odd in (op(docs, labels.limit(0)), op(docs.withColumn("text", F.lit(None).cast("string")), labels), op(docs.limit(0), labels)):
            assert all(0 <= r["score"] <= 1 for r in odd.collect())


def test_language(spark):
    other = ["".join(RNG.choice("vwxyzäöü") for _ in range(RNG.randint(2, 7))) for _ in range(300)]
    rows = [(k, prose(40, other if k % 2 else VOCAB), "zz" if k % 2 else "aa") for k in range(400)] + [(900, None, "aa"), (901, "12 !!", "aa"), (902, prose(200) + " " + prose(180, other), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.op1(docs).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in rows[:400]) >= 396
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[901]["score"] == 0
    mix = {r["doc_id"]: r["languages"] for r in language.identify(docs, language.train(docs)).collect()}
    assert len(mix[902]) == 2 and len(mix[0]) == 1
    assert {r["lang_pred"] for r in language.op1(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.op1(docs.limit(0)).count() == 0


def test_trees_fit_an_interaction():
    x = np.random.default_rng(0).uniform(-1, 1, (2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((fit(x, y).score(x) > 0.5) == y).mean() > 0.95 and fit(x[:0], y[:0]).score(x).max() == 0.5


def test_entities_are_decoded():
    assert pages.lines("<p>&lt;a&gt; &eacute;&nbsp;&#x41;</p>") == [("<a> é A", pages.OTHER)] and html.unescape("&nbsp;") == "\xa0"


def _page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def test_differencing_decides_inside_and_outside_articles(spark):
    """Frames without markup go, frames inside an article go, menus that differ go by markup, an article on two pages stays."""
    host = "http://h.example"
    frame = lambda k, body: _page(f"<nav><a>menu {k}</a></nav><article><p>Subscribe to our letter today</p>{body}<p>All rights kept by h</p></article>")
    own = {k: f"<p>Story {k} has words of its own and goes on</p><p>and a second paragraph number {k}</p>" for k in range(6)}
    own[3] = own[2]
    rows = [(k, f"{host}/a/{k}", frame(k, own[k])) for k in range(6)]
    plain = [(20 + k, f"http://p.example/{k}", _page(f"<div>Site name</div><div>Post {k} is about {k} things of note</div><div>Contact us</div>")) for k in range(4)]
    copies = [(40 + k, f"http://c.example/{k}", _page("<p>One text on every page of the host</p>")) for k in range(50)]
    data = spark.createDataFrame(rows + plain + copies, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.op7(data).collect()}
    for k in range(6):
        n = 2 if k == 3 else k
        assert got[k] == f"Story {n} has words of its own and goes on\nand a second paragraph number {n}"
    assert all(got[20 + k] == f"Post {k} is about {k} things of note" for k in range(4))
    assert all(got[40 + k] == "One text on every page of the host" for k in range(50))
    alone = {r["page_id"]: "\n".join(r["lines"]) for r in pages.extract(data, differ=False).collect()}
    assert alone[0] != got[0] and "Subscribe to our letter today" in alone[0] and alone[20].startswith("Site name")


def test_frame_votes_against_brute_force():
    rng = random.Random(4)
    def brute(page, others):
        votes, told = Counter(), 0
        for o in others:
            found = pages.shared(page[0], o[0])
            same = sum(page[1][k] for k in found)
            if not same or same < pages.COPY * min(sum(page[1]), sum(o[1])):
                told += 1
                votes.update(found)
        return sorted(k for k, n in votes.items() if n >= min(2, told))
    for _ in range(200):
        make = lambda: (x := [rng.randrange(6) for _ in range(rng.randint(0, 7))], [10 if v else 0 for v in x])
        page, others = make(), [make() for _ in range(rng.randint(0, 4))]
        assert pages.frame(page, others) == brute(page, others)


def test_articles_of_the_given_pages_are_whole(spark):
    """A page was made from the document whose id is in its URL: the article holds a heading and the document's lines."""
    sf = "/root/testdata/sf0.01"
    document = {r["doc_id"]: [" ".join(x.split()) for x in (r["text"] or "").split("\n") if x.split()] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    wrong = 0
    for r in pages.op7(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        doc = document[int(re.search(r"/(\d+)", re.sub(r"^\w+://[^/]*", "", r["url"]))[1])]
        wrong += r["text"].split("\n")[1:] != doc
    assert wrong == 0


def test_articles_keep_the_sentences_that_they_share(spark):
    """A closing line that several articles of a host share stays; one on all pages, at the edge, goes; in the middle it stays."""
    own = lambda k: f"<p>Story {k} has words of its own and goes on for a while</p><p>second paragraph number {k} says more</p>"
    body = lambda k: f"<p>Our letter</p>{own(k)}<p>Ask us</p><p>third paragraph {k}</p>" + ("<p>All agree on that.</p>" if k < 6 else f"<p>End {k}</p>")
    rows = [(k, f"http://h.example/{k:02}", _page(f"<article>{body(k)}</article>")) for k in range(12)]
    rows += [(k, rows[0][1], rows[0][2]) for k in range(100, 130)]  # copies of one page
    got = {r["page_id"]: r["text"].split("\n") for r in pages.op7(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == [f"Story {k} has words of its own and goes on for a while", f"second paragraph number {k} says more", "Ask us", f"third paragraph {k}", "All agree on that." if k < 6 else f"End {k}"]
    assert all(got[k] == got[0] for k in range(100, 130))


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<a b='" * 200_000, '<a b="' * 200_000, "<script " * 100_000, "<! " * 300_000, "<!--" * 200_000, "<" * 300_000, "<a =" * 200_000])
def test_stray_marks_take_linear_time(page):
    began = time.process_time()
    pages.lines(page)
    assert time.process_time() - began < 20


def test_quotes_that_never_close():
    assert [t for t, _ in pages.lines('<p class="x <b>t</b> more <a href="y">z</a>')] == ["t more z"]
    assert [t for t, _ in pages.lines("<p class='x>one</p><p>two")] == ["one", "two"]
    assert [t for t, _ in pages.lines('<p title="a > b < c">it\'s "so"</p><svg/>on')] == ['it\'s "so"', "on"]


def test_long_pages_align_in_little_memory(monkeypatch):
    rng = random.Random(8)
    a, b = ([rng.randrange(60_000) for _ in range(100_000)] for _ in range(2))
    began = time.process_time()
    got = pages.shared(a, b)
    assert time.process_time() - began < 60 and len(got) == pages._lengths(a, b)[-1]
    rest = iter(b)
    assert all(a[k] in rest for k in got)
    monkeypatch.setattr(pages, "TABLE", 20)
    test_longest_common_subsequence()


def _unigram(path, rng, fallback, crossing, charsmap, squeeze, suffix=False, user=()):
    """A unigram model put together by hand (none is trained): pieces with scores, and a public normaliser's map."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, fallback
    model.trainer_spec.treat_whitespace_as_suffix = suffix
    norm = model.normalizer_spec
    norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = True, squeeze, True
    norm.precompiled_charsmap = charsmap
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=piece, score=0, type=kind)
    if fallback:
        for b in range(256):
            model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    made = {"▁", *"abcdeé."} | {"".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5))) for _ in range(60)}
    made |= {"▁" + w for w in list(made)[:40] if "▁" not in w}
    if crossing:
        made |= {"a▁b", "c▁", "e▁a▁"}
    for w in sorted(made - {"d", *user}):
        model.pieces.add(piece=w, score=-round(rng.uniform(1, 12), 4), type=1)
    for w in user:
        model.pieces.add(piece=w, score=0, type=4)
    with open(path, "wb") as f:
        f.write(model.SerializeToString())


@pytest.mark.parametrize(("fallback", "crossing", "rule", "squeeze", "user"), [(True, False, None, False, ()), (False, False, None, True, ()), (True, True, "nmt_nfkc", True, ()), (False, True, "nmt_nfkc_cf", False, ("[x]", "ab")), (True, False, "nfkc", True, ("<s2>",))])
def test_unigram_pieces_equal_the_library(tmp_path, fallback, crossing, rule, squeeze, user):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    charsmap = b""
    if rule:
        held = pb.ModelProto()
        held.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        charsmap = held.normalizer_spec.precompiled_charsmap
        assert charsmap
    rng, path = random.Random(11), str(tmp_path / "unigram.model")
    _unigram(path, rng, fallback, crossing, charsmap, squeeze, user=user)
    lib, fst = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path)
    alphabet = [*"aabbccddeeé", " ", " ", "  ", ".", "ﬁ", "Ａ", "A", "①", "漢", "🙂", "\t", "\n", "　", "é", "[x]", "<s2>", "ab"]
    cases = ["", " ", "   ", "a", " a ", "漢字", "漢 字"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in cases:
        assert fst.normal(t) == lib.normalize(t), t
        ids = fst.encode(t)
        assert ids.tolist() == lib.encode(t), t
        assert fst.decode(ids) == lib.decode(ids.tolist()), t


def test_pieces_of_an_empty_table_and_of_repeated_rows(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    assert pieces.transduce(empty(spark), path).count() == 0
    rows = [(1, "a b", "z"), (1, "a b", "y"), (None, "", None), (2, None, None)]
    got = pieces.transduce(spark.createDataFrame(rows, "doc_id long, text string, ids string"), path).collect()
    assert len(got) == 4 and len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) == 1


def test_buckets_as_spark_has_them(spark):
    from tessera.llm.common import bucket_of

    values = [0, 1, -1, 42, 1 << 20, (7 << 24 | 3) << 20, (1 << 62) + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", F.expr("pmod(hash(v), 51)").alias("b")).collect()
    assert [bucket_of(r["v"] % (1 << 64), 51) for r in got] == [r["b"] for r in got]


def test_intermediate_results_are_released(spark):
    from tessera.llm.common import bucketed, made, release, staged

    before = made()
    one, two = staged(spark.range(5), "one"), staged(spark.range(3), "two")
    table = bucketed(spark.range(4), "id", 2, "three")
    assert len(made() - before) == 3 and table.count() == 4
    release(spark, before, keep=two)
    assert len(made() - before) == 1 and two.count() == 3
    release(spark, before)
    assert made() == before
    del one
