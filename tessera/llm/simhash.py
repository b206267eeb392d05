"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it set. Two fingerprints link at
BITS = 2 or fewer differing bits; then at least LEAST = 6 of their 8 positional bytes agree (the guaranteed minimum).

The inverted index files each distinct fingerprint under positional bytes. A list for one byte would hold a share of all
rows, so a list's key is the bytes of two of the four byte pairs, six lists a fingerprint: of four pairs at most BITS can
hold a difference, so a linked pair has two whole pairs alike and meets in a list. In a list the positional bytes that
each two members share are tallied over all eight positions, pairs of LEAST or more are retained, and those are verified
by their differing bits. Members of a longer list (over DENSE) meet by postings of the list instead: under each two of
the four remaining positions, so that their tally is the minimum from the start; such a posting holds 65,536 members at
most, and looks the 1 + 16 + 120 patterns of differing bits up instead of forming pairs. Lists of over LONG members are
dealt by these postings already between tasks, so no task holds a list that grows with the input. Each list gives a
spanning forest of its links only, which keeps the components the same.

Exact copies are one fingerprint from the start, so a hot text costs one row. Components are found by randomised
contraction, and each document gets the smallest id that it can reach.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; a text of fewer words than a
shingle is one shingle; rows of one id are one document for the component's smallest id, and each row is answered; a
null id takes part but is never the smallest id unless its component has no other; an empty table gives no rows; only
id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, components, join_skewed, slices, staged, tasks_for

SHINGLE, BITS, SEED = 3, 2, 42
#: Positional bytes that a linked pair shares at least; lists whose pairs are not formed one by one; lists that no task holds whole.
LEAST, DENSE, LONG = 8 - BITS, 128, 50_000


def _mask(positions) -> int:
    return sum(0xFF << 8 * k for k in positions)


#: The positions of each list's key (two of four pairs), then of each posting of a long list (two more positions).
LISTS = [(*p, *q) for p, q in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]
POSTINGS = [[(*key, *two) for two in combinations([k for k in range(8) if k not in key], LEAST - 4)] for key in LISTS]
MASKS = [_mask(key) for key in LISTS] + [_mask(key) for own in POSTINGS for key in own]
#: Patterns of at most BITS bits over 16.
NEAR = np.array(sorted({1 << a | 1 << b for a in range(16) for b in range(16)} | {0}), np.uint32)
ROWS_PER_TASK = 2_000_000


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle in order; a text of fewer words is one shingle, a wordless one has none."""
    w = text.lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    flat = b" ".join(w)
    length = np.fromiter(map(len, w), np.int64, len(w)) + 1
    start = np.r_[0, np.cumsum(length)]
    if len(w) <= shingle:
        spans = [(0, len(flat))]
    else:
        spans = zip(start[: len(w) - shingle + 1].tolist(), (start[shingle:] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, max(1, len(w) - shingle + 1))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is set where over half of them have it set."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of positional bytes that each two fingerprints share."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(1)


class _Forest:
    """A spanning forest of links among fp (distinct)."""

    def __init__(self, fp: np.ndarray) -> None:
        self.fp, self.parent, self.links = fp, list(range(len(fp))), []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = self.root(a), self.root(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                self.links.append((int(self.fp[a]), int(self.fp[b])))

    def counted(self, at: np.ndarray) -> None:
        """Tally each two of the members at, retain those of the minimum, and verify."""
        i, j = np.triu_indices(len(at), 1)
        i, j = at[i], at[j]
        retained = tally(self.fp[i], self.fp[j]) >= LEAST
        i, j = i[retained], j[retained]
        linked = np.bitwise_count(self.fp[i] ^ self.fp[j]) <= BITS
        self.add(i[linked], j[linked])

    def posting(self, at: np.ndarray, key: tuple[int, ...]) -> None:
        """Members at that share the positional bytes of key (LEAST of them): verify by the patterns that differ."""
        if len(at) <= DENSE:
            self.counted(at)
            return
        rest = np.array([8 * k for k in range(8) if k not in key], np.uint64)
        code = sum((self.fp[at] >> r & np.uint64(0xFF)) << np.uint64(8 * k) for k, r in enumerate(rest)).astype(np.uint32)
        where = np.full(1 << 16, -1)
        where[code] = at
        for pattern in NEAR[1:]:
            other = where[code ^ pattern]
            hit = other > at
            self.add(at[hit], other[hit])


def _groups(key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """The positions of the members of each posting of two or more."""
    order = np.lexsort((fp, key))
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    return [x for x in np.split(order, first[1:]) if len(x) > 1]


def linked(fp: np.ndarray, number: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members (distinct) of a list (number below 6) or of a posting of a long list."""
    forest = _Forest(fp)
    if number >= len(LISTS):
        forest.posting(np.arange(len(fp)), [key for own in POSTINGS for key in own][number - len(LISTS)])
    elif len(fp) <= DENSE:
        forest.counted(np.arange(len(fp)))
    else:
        for key in POSTINGS[number]:
            for at in _groups(fp & np.uint64(_mask(key)), fp):
                forest.posting(at, key)
    return forest.links


def _postings(batches):
    """One task's lists: rows (list number, fp) in any order."""
    held = [(b.column("list").to_numpy(), b.column("fp").to_numpy().view(np.uint64)) for b in batches if b.num_rows]
    if not held:
        return
    number, fp = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    key = fp & np.array(MASKS, np.uint64)[number]
    order = np.lexsort((fp, key, number))
    number, key, fp = number[order], key[order], fp[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (number[1:] != number[:-1])])
    size = np.diff(np.r_[first, len(fp)])
    two = first[size == 2]
    two = two[tally(fp[two], fp[two + 1]) >= LEAST]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= BITS]
    links = set(zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True))
    for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        links.update(linked(fp[a : a + n], int(number[a])))
    a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*links, strict=True) if links else ((), ())))
    yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def _key(number: str) -> str:
    """SQL: the positional bytes of fp that list `number` has as its key."""
    signed = ", ".join(f"{m - (1 << 64) if m >> 63 else m}L" for m in MASKS)
    return f"fp & array({signed})[{number}]"


def links(fps: DataFrame) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that span the components of the link graph. fps: column fp, distinct."""
    spark = fps.sparkSession
    tasks = tasks_for(spark, fps.count() * len(LISTS), ROWS_PER_TASK)
    index = fps.selectExpr("fp", f"explode(sequence(0, {len(LISTS) - 1})) as list").selectExpr("fp", "list", f"{_key('list')} as key")
    sizes = index.groupBy("list", "key").agg(F.count("*").alias("n")).filter(F.col("n") > LONG)
    long = staged(sizes.select("list", "key", F.lit(True).alias("long")), "long")
    if long.isEmpty():
        dealt = index.select("fp", "list", "key")
    else:
        marked = index.join(F.broadcast(long) if long.count() <= BROADCAST_ROWS else long, ["list", "key"], "left")
        each = len(POSTINGS[0])
        finer = marked.filter("long").selectExpr("fp", f"explode(sequence({len(LISTS)} + list * {each}, {len(LISTS)} + list * {each} + {each - 1})) as list").selectExpr("fp", "list", f"{_key('list')} as key")
        dealt = marked.filter("long is null").select("fp", "list", "key").unionByName(finer)
    return dealt.repartition(tasks, "list", "key").select("list", "fp").mapInArrow(_postings, "a long, b long")


def classes(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component) for each row of docs; component is the smallest id of the near-duplicate class."""
    fps = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    label = components(links(distinct))
    labelled = staged(distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "labels")
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    held = staged(labelled.select("root", "fp", "n").join(least, "root").select("fp", "component", "n"), "components")
    return join_skewed(fps, held, "fp", "n").select("id", "fp", "component")


def op5(docs: DataFrame) -> DataFrame:
    found = classes(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their class, with their columns; rows of a null id stay only as a class of their own."""
    found = classes(docs, SHINGLE, id_col, text_col)
    keep = found.filter(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("_keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_keep"]), "left_semi")
