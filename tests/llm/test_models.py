"""The learned operators against plain versions of their methods, and their handling of odd tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import language, quality, tokens, toxicity
from tessera.llm.queries import tokenizer_file
from tessera.llm.trees import fit

RNG = random.Random(77)
CLASH = "lang_of string, id int, label string, score double, grams int, x string, piece string, n int"
VOCABS = {"aa": "abcdefgh", "bb": "abcijkl", "cc": "mnoäöü"}


def prose(letters, n):
    return " ".join("".join(RNG.choice(letters) for _ in range(RNG.randint(2, 7))) for _ in range(n))


def learns(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 0


@pytest.fixture(scope="module")
def rows():
    out = [(k, prose(VOCABS[x], RNG.randint(3, 60)), x) for k, x in enumerate(RNG.choices(list(VOCABS), k=200))]
    out += [(300 + k, prose(VOCABS["aa"], 30) + " " + prose(VOCABS["cc"], RNG.choice([2, 30])), None) for k in range(15)]
    out += [(400, None, "aa"), (401, "", "bb"), (402, "12 !!", "cc"), (403, "a", "aa"), (404, "\x00 é", None), (None, "abc", "aa")]
    return out + [out[3], out[3], (5, out[6][1], "bb"), (500, prose("abcdefghmnoäöü", 20_000), "aa")]


def table(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame([(*r, "v", 1, "w", 0.5, 2, "x", "p", 3) for r in rows], f"{schema}, {CLASH}").repartition(4)


# ---- language


def trigrams(text):
    plain = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in (text or "").lower().encode("utf-8", "replace"))
    s = b" " + plain + b" "
    return Counter((((s[i] << 16 | s[i + 1] << 8 | s[i + 2]) * 2654435761) % (1 << 32)) >> 16 for i in range(len(s) - 2) if s[i + 1] != 32)


def languages(rows):
    names = sorted({x for d, t, x in rows if learns(d) and x is not None and t is not None})
    sums = {x: Counter() for x in names}
    for d, t, x in rows:
        if learns(d) and x is not None and t is not None:
            sums[x].update(trigrams(t))
    names = [x for x in names if sums[x]]
    total = {x: sum(sums[x].values()) + 0.5 * language.BUCKETS for x in names}
    return names, lambda gram, x: (sums[x][gram] + 0.5) / total[x]


def mixture(grams, chance, chosen):
    """Eight rounds of expectation-maximisation over the chosen languages, and the log-likelihood."""
    pi, total = {x: 1 / len(chosen) for x in chosen}, sum(grams.values())
    for _ in range(8):
        new = dict.fromkeys(chosen, 0.0)
        for g, n in grams.items():
            w = {x: chance(g, x) * pi[x] for x in chosen}
            s = sum(w.values())
            for x in chosen:
                new[x] += n * w[x] / s
        pi = {x: v / total for x, v in new.items()}
    return pi, sum(n * math.log(sum(chance(g, x) * pi[x] for x in chosen)) for g, n in grams.items())


def shares(text, names, chance):
    """The language set of best penalised likelihood, grown from the best single language by the order of all proportions."""
    grams = trigrams(text)
    if not grams or not any(c.isalpha() for c in text):
        return None
    single = {x: sum(n * math.log(chance(g, x)) for g, n in grams.items()) for x in names}
    best = max(names, key=lambda x: single[x])
    pi, _ = mixture(grams, chance, names)
    order = [best, *[x for x in sorted(names, key=lambda x: -pi[x]) if x != best]]
    chosen, fitted = {best: 1.0}, single[best]
    for k in range(2, len(names) + 1):
        mixed, got = mixture(grams, chance, order[:k])
        if got - fitted <= 3.0 * math.log(max(sum(grams.values()), 2)):
            break
        chosen, fitted = mixed, got
    return chosen


def test_language_against_a_plain_mixture(spark, rows):
    names, chance = languages(rows)
    got = language.op1(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t, _ in rows:
        found = shares(t, names, chance) if t else None
        want[d, not learns(d), max(found, key=found.get) if found else "und", round(max(found.values()), 2) if found else 0.0] += 1
    have = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 2)) for r in got)
    assert sum((want - have).values()) <= 2  # a share that rounds either way
    assert Counter((k[0], k[2]) for k in want.elements()) == Counter((r["doc_id"], r["lang_pred"]) for r in got)


def test_languages_are_bounded(spark, rows, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    names, _ = language.train(table(spark, rows))
    counts = Counter(x for _, t, x in rows if x and t is not None)
    assert sorted(names) == sorted(x for x, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:2])


# ---- quality


def grown(x, y, trees, depth, rate=0.15, bins=64, ridge=1.0, least=10):
    """Greedy boosting by trying every split of the binned columns, one row and one node at a time."""
    share = (sum(y) + 0.5) / (len(y) + 1)
    margin = [math.log(share / (1 - share))] * len(y)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1]))) for j in range(x.shape[1])]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [a * (1 - a) for a in p]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            after = []
            for own in nodes:
                best = (1e-6, None, None)
                tg, th = sum(g[i] for i in own), sum(h[i] for i in own)
                for j, cuts in enumerate(edges):
                    for cut in cuts:
                        left = [i for i in own if x[i, j] <= cut]
                        if min(len(left), len(own) - len(left)) < least:
                            continue
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
                        if gain > best[0] + 1e-12:
                            best = (gain, j, cut)
                _, j, cut = best
                after += [own, []] if j is None else [[i for i in own if x[i, j] <= cut], [i for i in own if x[i, j] > cut]]
            nodes = after
        for own in nodes:
            step = rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + ridge)
            for i in own:
                margin[i] += step
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_trees_against_exhaustive_search():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 3)), 1)  # ties within a column
    x = np.vstack([x, x[:10]])  # repeated rows
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    assert np.allclose(fit(x, y, trees=5, depth=3).score(x), grown(x, y.tolist(), 5, 3), atol=1e-9)


def test_quality_scores_are_the_forest_s(spark, rows):
    """The query against the statistics of each text and a forest grown on the rows that may be learnt from."""
    labels = [(d, int(i % 3 > 0), None) for i, (d, _, _) in enumerate(rows) if i < 150]
    got = quality.op2(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = {d: q for d, q, _ in labels if learns(d)}
    text = {d: min((t.encode() for e, t, _ in rows if e == d and t is not None), default=None) for d in known}
    ids = sorted(known)
    x = np.array([quality.statistics(text[d]) for d in ids], float)
    forest = fit(x, np.array([known[d] for d in ids], float))
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (not learns(r["doc_id"])) and r["predicted"] == int(r["score"] >= 0.3)
    want = Counter((d, round(float(forest.score(np.array([quality.statistics(t.encode() if t is not None else None)], float))[0]), 6)) for d, t, _ in rows)
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in got) == want


# ---- toxicity


def test_toxicity_against_dense_regression(spark, rows, monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 12)
    labels = [(d, None, int("b" in (t or "")[:6])) for d, t, _ in rows[:150] if d is not None]
    docs = [(d, t) for d, t, _ in rows if d in {d for d, _, _ in labels}]
    known = {d: y for d, _, y in labels if learns(d)}
    text = {d: min((t for e, t in docs if e == d and t is not None), key=lambda s: s.encode(), default="") for d in known}
    ids = sorted(known, key=lambda d: (known[d], d))
    held = [set(toxicity.grams([text.get(d, "").encode()])[1].tolist()) for d in ids]
    y = np.array([known[d] for d in ids], float)
    x = np.zeros((len(ids), 1 << 12))
    for i, own in enumerate(held):
        x[i, sorted(own)] = 1
    pos, df = (x * y[:, None]).sum(0), x.sum(0)
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((df - pos + 1) / (len(y) - y.sum() + 2))
    ratio[(df < 3) | (np.abs(ratio) < 0.7)] = 0
    z = x * ratio
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    share = (y.sum() + 0.5) / (len(y) + 1)
    b = c = math.log(share / (1 - share))
    w = v = np.zeros(z.shape[1])
    step = 1 / (0.25 * float((balance * ((z**2).sum(1) + 1)).mean()) + 1e-3)
    for t in range(100):
        e = (y - 1 / (1 + np.exp(-(z @ v + c)))) * balance
        w2, b2 = v + step * (z.T @ e / len(y) - 1e-3 * v), c + step * e.mean()
        v, c, w, b = w2 + t / (t + 3) * (w2 - w), b2 + t / (t + 3) * (b2 - b), w2, b2
    of, gram = np.concatenate([np.full(len(own), i) for i, own in enumerate(held)]), np.concatenate([sorted(own) for own in held]).astype(np.int64)
    weight, base = toxicity.regression(of, gram, y, toxicity.ratios(pos, df, y.sum(), len(y)))
    assert np.allclose(weight, w * ratio, atol=1e-4) and abs(base - b) < 1e-6


def test_toxicity_handles_odd_tables(spark, rows):
    labels = spark.createDataFrame([(d, 1, int(i % 2)) for i, (d, _, _) in enumerate(rows) if i < 120], "doc_id long, quality int, toxic int")
    got = toxicity.op8(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    of = {}
    text = dict((d, t) for d, t, _ in rows)
    for r in got:
        of.setdefault(r["doc_id"], set()).add(round(r["score"], 9))
    assert of[400] == of[401] and len(of[rows[3][0]]) == 1  # null and empty alike, repeated rows alike
    assert len(text) == len({r["doc_id"] for r in got})


def test_sampled_texts_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3_000)
    docs = spark.createDataFrame([(k, "some words here " * 20) for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    seen = []
    real = toxicity.regression
    monkeypatch.setattr(toxicity, "regression", lambda of, gram, y, ratio: seen.append(len(y)) or real(of, gram, y, ratio))
    toxicity.train(docs, labels)
    assert seen and seen[0] <= 2 * (3_000 // 320 + 1)


# ---- token counts


def test_other_splitters_are_refused(tmp_path):
    import json

    spec = json.load(open(tokenizer_file("byte_bpe_50k.json")))
    for change in ({"add_prefix_space": True}, {"use_regex": False}):
        odd = json.loads(json.dumps(spec))
        odd["pre_tokenizer"].update(change)
        path = tmp_path / f"{next(iter(change))}.json"
        path.write_text(json.dumps(odd))
        with pytest.raises(ValueError, match="byte-level"):
            tokens.Splitter(str(path))


def test_token_counts_with_clashing_columns_and_long_texts(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tokens.op6(table(spark, rows), tokenizer_file("byte_bpe_50k.json")).collect())
    assert got == Counter((d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
