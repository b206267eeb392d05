"""Substring dedup by recompression.

A text's words are renamed round by round: maximal runs of one symbol become a symbol, then pairs of a left and a right
symbol (each symbol's side is a bit of its name) become a symbol. A name is a hash of what it stands for, so every task
gives the same name to the same run or pair everywhere, and equal substrings are cut alike except near their ends. Which
symbols inside a window are cut alike wherever it stands can be told from the window alone (see `_parse`); the first
such symbol of the highest round that has one is the window's anchor.

Round one through Spark: the anchors are dealt by name; a name with one occurrence rules its windows out. Round two:
the windows of the shared names are dealt by a 96-bit hash of their words, which verifies the repeats; each window found
twice covers its words. Rows are sorted in each task and read as a stream, so a name of any frequency needs no memory,
and a task sends one row for each name of a block, however often the block has it.

Texts are packed into blocks of about BLOCK bytes, stored once in the shared folder and bucketed by block, so that the
rounds' findings come back to them without moving text again.

Defined cases: null has no words and keeps null; texts of fewer words than a window lose nothing but can not be matched
either; repeats inside one text count, overlapping ones too; ids may repeat or be null, each row is a text of its own;
an empty table gives no rows; a text of any length is one block's at least; other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, bucketed, staged, tasks_for

WINDOW, BLOCK = 35, 2 << 20
#: Rounds of runs (true) and pairs.
SCHEDULE = (True, False, True, *[False] * 7)
ROWS_PER_TASK = 4_000_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    y = b * _B
    x ^= y << np.uint64(31) | y >> np.uint64(33)
    x *= _C
    return x ^ x >> np.uint64(29)


def _pack(buckets: int):
    """Rows (block, rest, sizes, body): texts of about BLOCK bytes together.

    A block's number is chosen so that the buckets get their blocks in turn: each task starts at a place of its own, spread
    by the golden ratio, and goes on from there.
    """

    def run(batches):
        from pyspark import TaskContext

        part, n, kind = TaskContext.get().partitionId(), 0, None
        begin = int(part * 0.6180339887498949 % 1 * buckets)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        rest, sizes, body, held = [], [], [], 0

        def block():
            nonlocal rest, sizes, body, held, n
            number = (part << 24 | n) << 20
            while bucket_of(number, buckets) != (begin + n) % buckets:
                number += 1
            out = pa.record_batch([pa.array([number], pa.int64()), pa.array([rest], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([squeeze(b"".join(body))], pa.binary())], ["block", "rest", "sizes", "body"])
            rest, sizes, body, held, n = [], [], [], 0, n + 1
            return out

        for batch in batches:
            kind = batch.schema.field("rest").type
            for r, text in zip(batch.column("rest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rest.append(r)
                sizes.append(-1 if text is None else len(text))
                body.append(text or b"")
                held += len(text or b"")
                if held >= BLOCK:
                    yield block()
        if rest:
            yield block()

    return run


def texts_of(sizes: list[int], body: bytes) -> list[bytes | None]:
    flat, at, out = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(s for s in sizes if s > 0))), 0, []
    for s in sizes:
        out.append(None if s < 0 else flat[at : at + s])
        at += max(s, 0)
    return out


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the position where each text starts (and the end)."""
    digest, size, parts = xxhash.xxh64_intdigest, [0], []
    for t in texts:
        w = t.split() if t else []
        parts.append(np.fromiter(map(digest, w), np.uint64, len(w)))
        size.append(len(w))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(size)


def _starts(edges: np.ndarray, window: int) -> np.ndarray:
    """First positions of all windows that lie in one text."""
    count = np.maximum(np.diff(edges) - window + 1, 0)
    return np.repeat(edges[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _parse(h: np.ndarray, edges: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window (by first position): its anchor's position and name.

    left and right are the window's borders, moved inward in each round past what words outside may change. In a round of
    pairs the window's first symbol may have joined one outside only if it is a right symbol, its last only if it is a
    left symbol; in a round of runs the first and the last run may go on outside. Both are told from the window alone.
    """
    n = len(h)
    at = _starts(edges, window)
    left, right, live = at.copy(), at + window, np.arange(len(at))
    pos, label = at.copy(), h[at]
    name, start = h, np.arange(n + 1)
    tail = np.zeros(n, bool)
    ends = edges[1:][np.diff(edges) > 0] - 1
    tail[ends] = True
    number = np.arange(n + 1)
    for k, run in enumerate(SCHEDULE):
        first, last = number[left], number[right] - 1
        if run:
            go_on = np.r_[(name[1:] == name[:-1]) & ~tail[:-1], False]
            head = np.flatnonzero(np.r_[True, ~go_on[:-1]])
            of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(name)]))
            length = np.diff(np.r_[head, len(name)])
            left, right = start[np.r_[head, len(name)][of[first] + 1]], start[head[of[last]]]
            name = np.where(length > 1, _mix(name[head], length.astype(np.uint64)), name[head])
        else:
            side = (_mix(name, np.full(1, k + 1, np.uint64)) >> np.uint64(40) & np.uint64(1)).astype(bool)
            joins = np.r_[~side[:-1] & side[1:] & ~tail[:-1], False]
            left, right = np.where(side[first], start[first + 1], left), np.where(side[last], right, start[last])
            head = np.flatnonzero(~np.r_[False, joins[:-1]])
            pair = joins[head]
            new = name[head]
            new[pair] = _mix(name[head[pair]], name[head[pair] + 1])
            name = new
        tail = tail[np.r_[head[1:], len(tail)] - 1]
        start = np.r_[start[head], n]
        number[start] = np.arange(len(start))
        ok = left < right
        left, right, live = left[ok], right[ok], live[ok]
        if not len(live):
            break
        pos[live], label[live] = left, name[number[left]]
    return at, pos, label


def _window_hash(h: np.ndarray, at: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Hash of the window's words at each position, by doubling."""
    x = _mix(h, np.full(1, seed, np.uint64))
    out, done, size = None, 0, 1
    while size <= window:
        if window & size:
            part = x[at + done] if out is None else _mix(out, x[at + done])
            out, done = part, done + size
        grown = np.zeros_like(x)
        if len(x) > size:
            grown[:-size] = _mix(x[:-size], x[size:])
        x, size = grown, 2 * size
    return out


def _rows(block: int, key: np.ndarray, key2: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row for each key of the block, seen = 1 if the block has it again; the others go along as seen = 2 under keys of their own."""
    order = np.lexsort((pos, key2, key))
    key, key2, pos = key[order], key2[order], pos[order]
    again = np.r_[False, (key[1:] == key[:-1]) & (key2[1:] == key2[:-1])] if len(key) else np.zeros(0, bool)
    seen = np.where(again, 2, np.r_[again[1:], False]) if len(key) else np.zeros(0)
    key = np.where(again, _mix(pos.astype(np.uint64), np.full(1, block, np.uint64)), key)
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array(key2.view(np.int32)), pa.array(np.full(len(key), block), pa.int64()), pa.array(pos, pa.int32()), pa.array(seen, pa.int8())], ["key", "key2", "block", "pos", "seen"])


_ROWS = "key long, key2 int, block long, pos int, seen byte"


def _segments(pos: np.ndarray, label: np.ndarray) -> np.ndarray:
    """First windows of the stretches that share an anchor."""
    return np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (label[1:] != label[:-1])]) if len(pos) else np.zeros(0, np.int64)


def _anchors(window: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, edges = _words(texts_of(r["sizes"], r["body"]))
                at, pos, label = _parse(h, edges, window)
                s = _segments(pos, label)
                yield _rows(r["block"], label[s], np.zeros(len(s), np.uint32), at[s])

    return run


def _windows(window: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, edges = _words(texts_of(r["sizes"], r["body"]))
                at, pos, label = _parse(h, edges, window)
                s = _segments(pos, label)
                chosen = np.isin(at[s], np.array(r["found"]))
                pick = at[np.repeat(chosen, np.diff(np.r_[s, len(at)]))]
                yield _rows(r["block"], _window_hash(h, pick, window, 1), (_window_hash(h, pick, window, 2) >> np.uint64(32)).astype(np.uint32), pick)

    return run


def _shared(batches):
    """Of rows sorted by (key, key2), those whose key another row has, or that are marked as seen."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "key2", "block", "pos", "seen")]
        cols = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        key, key2, block, pos, seen = cols
        same = (key[1:] == key[:-1]) & (key2[1:] == key2[:-1])
        hit = np.r_[same, False] | np.r_[False, same] | (seen > 0)
        # the last row waits for the next batch, and takes with it that it was hit
        held = [c[-1:].copy() for c in cols]
        held[4][:] |= hit[-1]
        hit[-1] = False
        yield pa.record_batch([pa.array(block[hit]), pa.array(pos[hit])], ["block", "pos"])
    if held and held[4][0]:
        yield pa.record_batch([pa.array(held[2]), pa.array(held[3])], ["block", "pos"])


def _found(rows: DataFrame, tasks: int, label: str) -> DataFrame:
    """(block, found): the positions of rows whose key occurs again."""
    dealt = rows.repartition(tasks, "key").sortWithinPartitions("key", "key2")
    hits = dealt.mapInArrow(_shared, "block long, pos int")
    return staged(hits.groupBy("block").agg(F.array_sort(F.collect_list("pos")).alias("found")), label)


def _emit(window: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            for k, r in enumerate(batch.select(["sizes", "body", "found"]).to_pylist()):
                texts = texts_of(r["sizes"], r["body"])
                split = [t.split() if t else [] for t in texts]
                edges = np.cumsum([0, *map(len, split)])
                change = np.zeros(edges[-1] + 1, np.int64)
                if r["found"]:
                    found = np.array(r["found"])
                    np.add.at(change, found, 1)
                    np.add.at(change, found + window, -1)
                gone = change.cumsum() > 0
                count, removed, last = [], [], []
                for t, w, a in zip(texts, split, edges[:-1].tolist(), strict=True):
                    g = gone[a : a + len(w)]
                    n = int(g.sum())
                    kept = [x for x, y in zip(w, g.tolist(), strict=True) if not y] if n else w
                    count.append(len(w))
                    removed.append(n)
                    if keep_text:
                        last.append(None if t is None else (b" ".join(kept) if n else t).decode("utf-8", "replace"))
                    else:
                        last.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                rest = batch.column("rest").slice(k, 1).flatten()
                yield pa.record_batch([rest, pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(last, pa.string())], ["rest", "n_words", "n_removed", "last"])

    return run


def packed(docs: DataFrame, text_col: str, label: str) -> tuple[DataFrame, str]:
    """The blocks of docs as a bucketed table, and the type of rest, a struct of the other columns."""
    others = [c for c in docs.columns if c != text_col]
    given = docs.select((F.struct(*others) if others else F.struct(F.lit(0).alias("_"))).alias("rest"), F.col(text_col).cast("binary").alias("text"))
    rest = given.schema["rest"].dataType.simpleString()
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = given.mapInArrow(_pack(buckets), f"block long, rest array<{rest}>, sizes array<bigint>, body binary")
    return bucketed(blocks, "block", buckets, label), rest


def removed(docs: DataFrame, window: int = WINDOW, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Rows (rest, n_words, n_removed, last) for each row of docs: rest holds the other columns, and last the text left
    (as it was if nothing goes, else the kept words joined by one space), or without keep_text the kept words' SHA-256."""
    spark = docs.sparkSession
    blocks, rest = packed(docs, text_col, "recompress")
    words = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    tasks = tasks_for(spark, words // 6, ROWS_PER_TASK)
    found = _found(blocks.select("block", "sizes", "body").mapInArrow(_anchors(window), _ROWS), tasks, "anchors")
    found = _found(blocks.select("block", "sizes", "body").join(found, "block").mapInArrow(_windows(window), _ROWS), tasks, "windows")
    return blocks.join(found, "block", "left").mapInArrow(_emit(window, keep_text), f"rest {rest}, n_words long, n_removed long, last string")


def op10(docs: DataFrame) -> DataFrame:
    return removed(docs.select("doc_id", "text"), keep_text=False).select("rest.doc_id", "n_words", "n_removed", F.col("last").alias("kept_sha256"))


def deduplicated(docs: DataFrame, window: int = WINDOW, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated words removed from the text; a column of the text's length follows it."""
    out = removed(docs, window, text_col).select(*[F.col("last").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out


ORACLE = r"""
with w as (
  select doc_id, row_number() over () as r, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as w from documents),
x as (
  select r, i, array_to_string(w[i:i + 34], ' ') as k from (select r, w, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35)),
k as (select k from x group by k having count(*) > 1),
c as (select distinct r, unnest(range(i, i + 35)) as pos from x semi join k using (k)),
u as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from w),
j as (select r, string_agg(word, ' ' order by pos) as kept, count(*) as n from u anti join c using (r, pos) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(j.n, 0))::bigint as n_removed, sha256(coalesce(j.kept, '')) as kept_sha256
from w left join j using (r)
"""
