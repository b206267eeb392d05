"""Language identification by multilingual mixture inference.

Each language is a multinomial over hashed byte trigrams. A text is a mixture of languages: expectation-maximisation
finds its proportions from the trigram likelihoods, and the number of languages is the one of best penalised
likelihood. The answer is the language of largest proportion, and its proportion is the score.

Defined cases: a text that is null or has no letter gets `und` and score 0; with no labelled row every text is `und`;
a label with one row still counts as a language, unless LANGUAGES others have more; ties go to the language first in name order; ids may repeat or be
null, each row is answered by itself; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, slices

BUCKETS = 1 << 16
#: Languages that are learned at most, those of most rows, then by name; so the table has a bounded size.
LANGUAGES = 256
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters become spaces.
_PLAIN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of the texts, and the text each belongs to. Grams around a space in the middle are left out."""
    plain = [(t or "").lower().encode("utf-8", "replace").translate(_PLAIN) for t in texts]
    flat = np.frombuffer(b"  ".join([b"", *plain, b""]), np.uint8).astype(np.uint32)
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(plain)), np.fromiter((len(p) + 2 for p in plain), np.int64, len(plain)))
    code = ((flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    # the gram at position i has its middle at i + 1; text k starts after two spaces
    of = np.concatenate([of, np.full(max(0, len(flat) - len(of)), len(plain) - 1)])[: len(flat)]
    use = flat[1:-1] != 32
    return code[use].astype(np.int64), of[:-2][use]


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        lang, text = (batch.column(c).to_pylist() for c in ("lang", "text"))
        names = sorted(set(lang))
        code, of = _grams(text)
        row = np.array([names.index(x) for x in lang], np.int64)
        for k, name in enumerate(names):
            got = np.bincount(code[row[of] == k], minlength=BUCKETS)
            counts[name] = counts[name] + got if name in counts else got
    for name, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(c[at], pa.int64())})


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(language names, likelihood table) of rows (lang, text). All rows of a language count; the driver gets BUCKETS sums of each of
    LANGUAGES at most."""
    given = labelled.select("lang", "text").filter("lang is not null and text is not null")
    known = given.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").select("lang").limit(LANGUAGES + 1)
    known = [r["lang"] for r in known.collect()]
    if len(known) > LANGUAGES:
        given = given.filter(F.col("lang").isin(known[:LANGUAGES]))
    rows = given.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS, len(names)), 0.5)
    for k, name in enumerate(names):
        own = rows[rows["lang"] == name]
        counts[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return names, (counts / counts.sum(0)).astype(np.float32) if names else counts


def _em(p, n, of, starts, prior, rounds):
    """Proportions and log-likelihood for each text from the prior's support."""
    pi, total = prior, np.maximum(np.add.reduceat(n, starts), 1)
    for _ in range(rounds):
        w = p * pi[of]
        w *= (n / np.maximum(w.sum(1), 1e-30))[:, None]
        pi = np.add.reduceat(w, starts, axis=0) / total[:, None]
    fit = np.add.reduceat(n * np.log(np.maximum((p * pi[of]).sum(1), 1e-30)), starts)
    return pi, fit


def infer(texts: list[str | None], table: np.ndarray, rounds: int = 8, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) of the selected language sets, and whether a text had any trigram."""
    out, known = np.zeros((len(texts), table.shape[1]), np.float32), np.zeros(len(texts), bool)
    code, of = _grams(texts)
    if not len(code) or not table.shape[1]:
        return out, known
    key, n = np.unique(of * BUCKETS + code, return_counts=True)
    of, code, n = key // BUCKETS, key % BUCKETS, n.astype(np.float32)
    present, starts, of = np.unique(of, return_index=True, return_inverse=True)
    p, langs = table[code], table.shape[1]
    total = np.add.reduceat(n, starts)
    pi, _ = _em(p, n, of, starts, np.full((len(present), langs), 1 / langs, np.float32), rounds)
    single = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
    order = np.argsort(-pi, axis=1, kind="stable")
    best = single.argmax(1)
    # the best single language leads the nested sets
    order = np.array([[b, *[x for x in o if x != b]] for b, o in zip(best, order, strict=True)])
    chosen = np.zeros_like(pi)
    chosen[np.arange(len(present)), best] = 1
    fit, active = single.max(1), np.arange(len(present))
    for k in range(2, langs + 1):
        pick = np.isin(of, active)
        sub = np.searchsorted(active, of[pick])
        first = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
        prior = np.zeros((len(active), langs), np.float32)
        np.put_along_axis(prior, order[active, :k], 1 / k, axis=1)
        mixed, got = _em(p[pick], n[pick], sub, first, prior, rounds)
        better = got - fit[active] > penalty * np.log(np.maximum(total[active], 2))
        active, mixed, got = active[better], mixed[better], got[better]
        if not len(active):
            break
        chosen[active], fit[active] = mixed, got
    out[present], known[present] = chosen, True
    return out, known


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, languages) for each row of docs; languages maps every selected language to its share."""
    spark = docs.sparkSession
    names, likelihood = model
    held = spark.sparkContext.broadcast(likelihood)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            share, known = infer(texts, held.value)
            known &= np.fromiter((bool(t and _LETTER.search(t)) for t in texts), bool, len(texts))
            top = share.argmax(1) if names else np.zeros(len(texts), int)
            pred = [names[k] if ok else "und" for k, ok in zip(top, known, strict=True)]
            score = [min(1.0, float(share[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(top, known, strict=True))]
            mix = [[(names[k], float(s[k])) for k in np.flatnonzero(s > 0)] if ok else [] for s, ok in zip(share, known, strict=True)]
            yield pa.record_batch([batch.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))], ["id", "lang_pred", "score", "languages"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, languages map<string,double>")
    return out.withColumnRenamed("id", id_col)


def op1(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
