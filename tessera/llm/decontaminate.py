"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the n-word windows of the benchmark items (an item of fewer words is one window). For each pattern
length the shift table tells, by the hash of the block of two words at the end of the search position, how far the
position may move: the least shift of all blocks of that hash, so no occurrence is passed over. Where the shift is 0 the
bucket of that hash lists the patterns with such a suffix, and these are compared word by word. A word that no item has
moves the position past itself. In prose nearly every block is unknown, so the search moves n - 1 words at a time.

The tables are arrays: SHIFT_BITS bits of hash for shifts and bucket starts, and for each distinct window its words'
numbers and its items. A worker process builds them once for a broadcast block of the benchmark and keeps the last one
only; a block has BLOCK_CHARS characters at most, or one item. A benchmark of one block is searched in one scan without
a shuffle. One of more blocks numbers the documents once in a written table, and each block sends back only the rows
that it hits, which are united by that number.

Defined cases: a null or wordless text has no words and no hits; a wordless or null item, or one of a null id, gives no
window; an empty benchmark leaves all documents clean; items of one id are one item, whatever rows it has; rows of one
document id are answered each by itself; a text of any length is searched whole; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, slices, staged

WINDOW, SHIFT_BITS = 8, 20
BLOCK_CHARS = 8 << 20
#: Lower-cases A-Z; every other byte below 128 that is no digit and no a-z becomes a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_K1, _K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_FULL = (1 << 64) - 1


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class _Table:
    """Shift table and suffix buckets of the patterns of one length: rows of word numbers, and the items of each."""

    def __init__(self, rows: np.ndarray, items: np.ndarray) -> None:
        self.length = rows.shape[1]
        order = np.lexsort((items, *rows.T[::-1]))
        rows, items = rows[order], items[order]
        new = np.r_[True, (rows[1:] != rows[:-1]).any(1)]
        self.rows = np.ascontiguousarray(rows[new], np.uint32)
        again = np.r_[False, ~new[1:] & (items[1:] == items[:-1])]
        self.items = items[~again].astype(np.uint32)
        owner = (np.cumsum(new) - 1)[~again]
        self.owned = np.searchsorted(owner, np.arange(len(self.rows) + 1))
        m, block = self.length, min(2, self.length)
        self.shift = bytearray(np.full(1 << SHIFT_BITS, m - block + 1, np.uint8).tobytes())
        table = np.frombuffer(self.shift, np.uint8)
        for end in range(block, m + 1):
            table[self._hash(self.rows[:, end - block], self.rows[:, end - 1])] = m - end
        suffix = self._hash(self.rows[:, m - block], self.rows[:, m - 1])
        order = np.argsort(suffix, kind="stable")
        self.bucket = order.astype(np.uint32)
        self.start = np.searchsorted(suffix[order], np.arange((1 << SHIFT_BITS) + 1)).astype(np.uint32)

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) * np.uint64(_K1) + b.astype(np.uint64) * np.uint64(_K2)) >> np.uint64(64 - SHIFT_BITS)

    def find(self, w: list[int], spans: list[tuple[int, int]], owners: set[int]) -> None:
        m, n, shift, move = self.length, len(w), self.shift, 64 - SHIFT_BITS
        block = min(2, m)
        at = m - 1
        while at < n:
            last = w[at]
            if not last:
                at += m
                continue
            before = w[at - 1] if block == 2 else last
            if not before:
                # no pattern holds the unknown word, so the next possible start is after it
                at += m - 1
                continue
            h = (before * _K1 + last * _K2 & _FULL) >> move
            by = shift[h]
            if by:
                at += by
                continue
            here = np.array(w[at - m + 1 : at + 1], np.uint32)
            for k in self.bucket[self.start[h] : self.start[h + 1]].tolist():
                if (self.rows[k] == here).all():
                    spans.append((at - m + 1, at + 1))
                    owners.update(self.items[self.owned[k] : self.owned[k + 1]].tolist())
                    break
            at += 1


class Search:
    """The windows of items, in one table for each pattern length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.items)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            w = np.array([self.number.setdefault(x, len(self.number) + 1) for x in words(text)], np.uint32)
            if len(w):
                m = min(window, len(w))
                by_length.setdefault(m, []).append((np.lib.stride_tricks.sliding_window_view(w, m), place[item]))
        self.tables = [_Table(np.concatenate([r for r, _ in own]), np.repeat([k for _, k in own], [len(r) for r, _ in own])) for _, own in sorted(by_length.items())]

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The occurrences as (start, end), and the items that own them."""
        get, spans, owners = self.number.get, [], set()
        known = [get(x, 0) for x in w]
        for table in self.tables:
            table.find(known, spans, owners)
        return spans, {self.items[k] for k in owners}


#: The tables that this process built last, by the broadcast block's mark and the window.
_BUILT: dict[tuple[str, int], Search] = {}


def covered(spans: list[tuple[int, int]]) -> int:
    total, last = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The items in blocks of a bounded number of characters, dealt by id and text; equal rows are one."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).filter("item is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    rows = staged(rows, "items") if n > 1 else rows
    return [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _searched(given: DataFrame, block: DataFrame, window: int, only_hit: bool) -> DataFrame:
    """given (text, other columns) with n_words, spans and items in place of the text."""
    held = given.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in block.collect()])
    rest = [c for c in given.columns if c != "text"]
    kinds = given.select(*rest).schema.simpleString()[len("struct<") : -1]
    mark = uuid.uuid4().hex

    def run(batches):
        key = (mark, window)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Search(held.value, window)
        search = _BUILT[key]
        for batch in slices(batches):
            n, spans, owners = [], [], []
            for text in batch.column("text").to_pylist():
                w = words(text)
                s, o = search.find(w)
                n.append(len(w))
                spans.append([{"a": a, "b": b} for a, b in sorted(s)])
                owners.append(sorted(o))
            found = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(owners, pa.list_(pa.string()))]
            out = pa.record_batch([batch.column(c) for c in rest] + found, [*rest, "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(x) for x in owners], pa.bool_())) if only_hit else out

    return given.mapInArrow(run, f"{kinds}, n_words long, spans array<struct<a:int,b:int>>, items array<string>")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep_columns: bool = False) -> DataFrame:
    """Rows (id, n_words, spans, items) for each row of docs; with keep_columns also all columns of docs, under `row`."""
    more = [F.struct("*").alias("row")] * keep_columns
    given = docs.select(F.col(id_col).alias("id"), *more, F.col(text_col).cast("binary").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text)
    if len(blocks) == 1:
        return _searched(given, blocks[0], window, False)
    # counted without a search; the number of a row is fixed by being written
    given = staged(given.select(F.monotonically_increasing_id().alias("uid"), "*"), "numbered") if blocks else given
    none = _searched(given, benchmark.select(F.lit("").alias("item"), F.lit(b"").alias("text")).limit(0), window, False)
    if not blocks:
        return none
    parts = [_searched(given.select("uid", "text"), block, window, True).drop("n_words") for block in blocks]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    united = everything.groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = staged(united, "hits")
    few = F.broadcast(united) if united.count() <= BROADCAST_ROWS // 10 else united
    return none.drop("spans", "items").join(few, "uid", "left").withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {dict(united.dtypes)[c]})")) for c in ("spans", "items")}).drop("uid")


def _digest(batches):
    for batch in batches:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        n_hit = [covered([(s["a"], s["b"]) for s in x]) for x in spans]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        count = [len(x) for x in items]
        yield pa.record_batch([batch.column("id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array([c >= 2 for c in count])], ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = hits(docs, benchmark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_digest, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumnRenamed("id", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, at_least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in which windows of fewer than at_least items occur, with their columns.

    A null or wordless text stays; equal rows stay or go together.
    """
    found = hits(docs, benchmark, id_col=id_col, text_col=text_col, keep_columns=True)
    return found.filter(F.size("items") < at_least).select("row.*")


ORACLE = r"""
with w as (
  select doc_id, case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') end as w
  from documents),
b as (
  select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
p as (
  select distinct item, least(len(w), 8) as m, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') as k
  from (select item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from b where len(w) > 0)),
x as (
  select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as k
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select distinct m from p) where len(w) >= m)),
h as (select x.doc_id, x.i, x.m, p.item from x join p on x.m = p.m and x.k = p.k),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + m)) as pos from h) group by doc_id),
o as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from h) group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(o.n_items, 0)::bigint as n_items,
  sha256(coalesce(o.s, '')) as items_sha256, coalesce(o.n_items, 0) >= 2 as contaminated
from w left join c using (doc_id) left join o using (doc_id)
"""
