"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed byte n-grams (orders ORDERS over letters, other ASCII as spaces). Each n-gram has the
log ratio of its smoothed document frequency under the two labels; logistic regression is fitted on the so scaled
features. The fit is on a bounded sample of labelled rows (SAMPLE of each label and SAMPLE_BYTES of their texts, by hash
order of the id); every row is scored.

Texts stay on the executors: they count document frequencies, of which the driver gets the 2 ** BITS sums at most, and
then send for each sampled row the numbers of its n-grams that tell something. ORDERS were chosen on a split of the
training rows (fitted on three of the four remainders that may be learnt from, measured on the fourth).

Defined cases: a null or empty text has no n-gram and gets the score of the intercept; with no labelled row, or one
label only, every score is the smoothed share of label 1; of rows that repeat a labelled id the least text is learnt
from, and each is scored; equal texts get equal scores; a label of a null id is not learnt from; only the id and text
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, slices, staged, tasks_for
from tessera.llm.quality import labelled, sample_ids

ORDERS = (6, 7)
BITS = 20
#: Labelled rows of each label that a model is fitted on, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 3_000, 48 << 20
_LETTERS = bytes(c | 32 if chr(c).isalpha() and c < 128 else c if c > 127 else 32 for c in range(256))


def grams(texts: list[bytes | None], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) pairs as two arrays, in order; with useful, only n-grams it marks."""
    plain = [b" " + b" ".join((t or b"").translate(_LETTERS).split()) + b" " for t in texts]
    flat = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, plain), np.int64, len(plain))
    of, end = np.repeat(np.arange(len(plain)), length), np.repeat(np.cumsum(length), length)
    keys = []
    for n in ORDERS:
        if len(flat) < n:
            continue
        code = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | flat[k : len(flat) - n + 1 + k]
        code = code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        inside = np.arange(len(code)) + n <= end[: len(code)]
        if useful is not None:
            inside &= useful[code]
        keys.append(of[: len(code)][inside] << BITS | code[inside].astype(np.int64))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def ratios(pos: np.ndarray, df: np.ndarray, ones: float, rows: float, alpha: float = 1.0, least: int = 3) -> np.ndarray:
    """Naive Bayes log-count ratio of each n-gram, from its document frequencies under label 1 and in all."""
    ratio = np.log((pos + alpha) / (ones + 2 * alpha)) - np.log((df - pos + alpha) / (rows - ones + 2 * alpha))
    # an n-gram that is rare, or whose ratio is within chance, tells nothing and only adds the length of the text
    ratio[(df < least) | (np.abs(ratio) < 0.7)] = 0
    return ratio


def regression(of: np.ndarray, gram: np.ndarray, y: np.ndarray, ratio: np.ndarray, steps: int = 100, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weight of each n-gram, intercept) by accelerated gradient descent on the scaled features. of, gram: (row, n-gram) pairs."""
    weight, share = np.zeros(len(ratio)), (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return weight.astype(np.float32), base
    names, gram = np.unique(gram, return_inverse=True)
    r = ratio[names]
    rows = np.bincount(of, r[gram] ** 2, len(y))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 1 / (0.25 * float((balance * (rows + 1)).mean()) + ridge)
    w, v, b, c = np.zeros(len(names)), np.zeros(len(names)), base, base
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, (v * r)[gram], len(y)) + c, -30, 30)))
        e = (y - p) * balance
        gw = np.bincount(gram, e[of], len(names)) * r / len(y) - ridge * v
        w_, b_ = v + step * gw, c + step * e.mean()
        m = t / (t + 3)
        v, c, w, b = w_ + m * (w_ - w), b_ + m * (b_ - b), w_, b_
    weight[names] = w * r
    return weight.astype(np.float32), float(b)


def _frequencies(batches):
    """One task's document frequencies: rows (gram, pos, df)."""
    pos, df = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in slices(batches):
        of, gram = grams(batch.column("text").to_pylist())
        label = np.array(batch.column("label").to_pylist(), np.int64)
        np.add.at(pos, gram, label[of])
        df += np.bincount(gram, minlength=1 << BITS)
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(pos[at]), pa.array(df[at])], ["gram", "pos", "df"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> tuple[np.ndarray, float]:
    spark, some = docs.sparkSession, None
    for value in (0, 1):
        own = sample_ids(labels.filter(F.col(label) == value), label, id_col, rows)
        some = own if some is None else some.unionAll(own)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = staged(labelled(docs, some, id_col, text_col).withColumn("label", F.col("label").cast("int")).repartition(tasks_for(spark, 2 * rows, 250), "id"), "labelled")
    # the driver gets some numbers for each byte of these, so they are bounded too: SAMPLE sizes of each label at most
    room, over = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in texts.select("id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("id"), "id", "label").collect():
        room[r["label"]] -= r["size"]
        if room[r["label"]] < 0:
            over.append(r["id"])
    texts = texts.filter(~F.col("id").isin(over)) if over else texts
    sizes = texts.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = texts.select("text", "label").mapInArrow(_frequencies, "gram int, pos long, df long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("df").alias("df")).toArrow()
    pos, df = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = counts.column("gram").to_numpy()
    pos[at], df[at] = counts.column("pos").to_numpy(), counts.column("df").to_numpy()
    ratio = ratios(pos, df, float(sizes[1]), float(sizes[0]))
    held = spark.sparkContext.broadcast(ratio != 0)

    def rest(batches):
        for batch in slices(batches):
            of, gram = grams(batch.column("text").to_pylist(), held.value)
            own = np.split(gram.astype(np.int32), np.searchsorted(of, np.arange(1, batch.num_rows)))
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "label", "grams"])

    got = texts.select("id", "label", "text").mapInArrow(rest, f"id {kind}, label int, grams binary").collect()
    got.sort(key=lambda r: (r["label"], r["id"]))
    found = [np.frombuffer(bytes(r["grams"]), np.int32) for r in got]
    of = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
    gram = np.concatenate([np.zeros(0, np.int32), *found])
    return regression(of, gram, np.array([r["label"] for r in got], float), ratio)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weight, base = held.value
        useful = weight != 0
        for batch in slices(batches):
            of, gram = grams(batch.column("text").to_pylist(), useful)
            margin = np.bincount(of, weight[gram].astype(float), batch.num_rows) + base
            yield pa.record_batch([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
