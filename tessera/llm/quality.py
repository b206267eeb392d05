"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Statistics are shares and means of characters, words and lines, so they need no vocabulary. The model is fitted on a
bounded sample of labelled rows (SAMPLE, by hash order of the id, so the same at every run); every row is scored.

Defined cases: a null text counts as empty, and an empty text has all statistics 0 and is scored like any other;
with no labelled row, or one label only, the score is the smoothed share of label 1; a document labelled twice counts
twice; ids may repeat or be null; only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, slices
from tessera.llm.trees import Forest, fit

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 12_000
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c in b".,;:!?'\"()-" else 4 if _c in b" \t\r\n\x0b\x0c" else 6 if _c > 127 else 5
NAMES = "log_chars log_words word_mean word_std lower upper digit punct space symbol other distinct_words top_word repeat_next short_words long_words distinct_pairs lines line_words dup_lines ends_dot starts_upper bare_words entropy dup_triples".split()


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    w = text.split()
    if not w:
        return [0.0] * len(NAMES)
    n, size = len(w), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by = np.bincount(_CLASS, counts, 7) / size
    p = counts[counts > 0] / size
    length = np.fromiter(map(len, w), np.int64, n)
    tally = Counter(w)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    return [
        np.log1p(size), np.log1p(n), length.mean(), length.std(), *by[:7], len(tally) / n, tally.most_common(1)[0][1] / n,
        sum(map(bytes.__eq__, w, w[1:])) / n, (length <= 2).mean(), (length >= 12).mean(), len(set(zip(w, w[1:], strict=False))) / max(1, n - 1),
        np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), ends / len(lines), sum(x[:1].isupper() for x in lines) / len(lines),
        sum(map(bytes.isalpha, w)) / n, float(-(p * np.log(p)).sum()), 1 - len(set(zip(w, w[1:], w[2:], strict=False))) / max(1, n - 2),
    ]


def _collect(batches):
    for batch in slices(batches):
        x = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("id"), pa.array(x, pa.list_(pa.float64())), batch.column("label")], ["id", "x", "label"])


def sample_ids(labels: DataFrame, label: str, id_col: str, rows: int) -> DataFrame:
    """(id, label) of at most rows labelled rows, those first by hash of the id."""
    return labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter("id is not null and label is not null").orderBy(F.xxhash64("id"), "id", "label").limit(rows)


def labelled(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, label, text as bytes) of the ids, which are few: one for each id and label, the least text where an id is repeated."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(ids), "id")
    return some.groupBy("id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Forest:
    kind = docs.schema[id_col].dataType.simpleString()
    ids = sample_ids(labels, label, id_col, rows)  # that many rows at most are broadcast
    some = labelled(docs, ids, id_col, text_col)
    got = some.select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(_collect, f"id {kind}, x array<double>, label int").toPandas().sort_values(["id", "label"], kind="stable")
    x = np.array([*got["x"]], float).reshape(len(got), len(NAMES))
    return fit(x, got["label"].to_numpy(float))


def score(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(NAMES))
            yield pa.record_batch([batch.column("id"), pa.array(held.value.score(x), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
