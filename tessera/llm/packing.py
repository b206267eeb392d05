"""Best-fit packing of token sequences by local search over swaps.

Texts become token ids, closed by an end id, and are cut where they exceed a sequence. Only the pieces' numbers and
lengths are packed. They are dealt at random to groups of about GROUP pieces; within a group a piece goes to the fullest
sequence that it still fits, longest first. Underfull sequences then exchange documents: one moves over, or two do, one
goes for one, one for two, two for one, from the emptier to the fuller sequence, each time the exchange that fills the
fuller one most. Every exchange raises the sum of squared fills, so sequences fill up and the emptiest empty out.

Sequences that stay underfull are dealt anew with those of other groups and searched again, in rounds, as long as they
are too many for one group and get fewer by a tenth at least; so no task holds more than a group, at any size, and
sequences left half empty by the groups meet.

A tokenizer that drops white space parts texts there anyway, so each distinct run of other characters is encoded once
and a batch of texts is put together from its runs as arrays; runs of plain characters in turn from their pre-tokens. Any
other tokenizer gets whole texts.

Defined cases: a null or empty text is the end id alone; rows of one id, and null ids, are each packed by themselves; an
empty table gives no rows; a piece of a whole sequence stands alone; only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, staged, tasks_for

#: Pieces that a group has, about; runs and pre-tokens whose ids a task keeps; bytes of text put together at once; runs asked for at once.
GROUP, KEPT, BLOCK, ASKED = 8_192, 1_000_000, 8 << 20, 1_000
#: Exchanges for two pieces are looked for this far below the best fill; searches over all underfull sequences of a group.
NEAR, PASSES = 16, 4
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Characters that no normaliser composes, and on which the two regular expression libraries agree; line feeds stand between runs.
_SAFE = re.compile("[!-~À-ÖØ-öø-ÿ\n]*").fullmatch


class _Kept:
    """Strings by number, and by number where each string's ids lie in one array."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin, self.size = np.array([], "<u4"), np.array([], np.int64), np.array([], np.int64)

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        start = len(self.size)
        self.number.update(zip(names, range(start, start + len(names)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])

    def numbers(self, names: list[str]) -> np.ndarray:
        """The number of each, -1 of what is not kept."""
        return np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))

    def together(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all one after another, and where each begins; the last place is their end."""
        size = self.size[numbers]
        at = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.begin[numbers] - at[:-1], size) + np.arange(at[-1])], at


class Encoder:
    """Token ids of texts as the library gives them, without added begin and end tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        # only what matches the pattern is left, none of it white space, and nothing that normalises reaches over white space
        drops = steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and r"[^\s" in steps[0]["pattern"].get("Regex", "")
        plain = {x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"} and all(not x.get("add_prefix_space") for x in steps)
        own = [a for a in spec.get("added_tokens") or [] if not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"])]
        self.by_runs = bool(drops and plain and own and len(own) == len(spec["added_tokens"]) and not any(re.search(r"\s", a["content"]) for a in own))
        if self.by_runs:
            self.mark, self.mark_id = own[0]["content"], own[0]["id"]
            self.special = re.compile("|".join(re.escape(a["content"]) for a in own)).search
            self.pretokens = regex.compile(rf"\n|{steps[0]['pattern']['Regex']}").findall
            self.lower = "Lowercase" in str(spec["normalizer"])
            self.runs, self.parts = _Kept(), _Kept()  # parts: pre-tokens
            # the same model for what is normalised and split already
            bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None}
            bare["pre_tokenizer"] = bare["pre_tokenizer"] | {"pretokenizers": steps[1:]}
            self.bare = Tokenizer.from_str(json.dumps(bare))

    def _ids(self, text: str, by=None) -> np.ndarray:
        return np.array((by or self.tokenizer).encode(text, add_special_tokens=False).ids, "<u4")

    def _ask(self, names: list[str], into: _Kept, by=None) -> None:
        """Encodes names, as one text in which a special token, that always splits, stands between them."""
        for k in range(0, len(names), ASKED):
            part = [x for x in names[k : k + ASKED] if self.mark not in x]
            ids = self._ids(self.mark.join(part), by)
            ends = np.flatnonzero(ids == self.mark_id)
            size = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
            into.add(part, ids[ids != self.mark_id], size[: len(part)])
            for odd in (x for x in names[k : k + ASKED] if self.mark in x):
                ids = self._ids(odd, by)
                into.add([odd], ids, np.array([len(ids)]))

    def _numbers(self, runs: list[str]) -> np.ndarray:
        """The number of each distinct run among those kept; what is new is put together from pre-tokens, or asked for."""
        numbers = self.runs.numbers(runs)
        if (numbers >= 0).all():
            return numbers
        if len(self.runs.number) > KEPT:
            self.runs = _Kept()
            numbers[:] = -1
        new = np.flatnonzero(numbers < 0)
        asked = missing = [runs[k] for k in new.tolist()]
        safe = "\n".join(missing)
        if not _SAFE(safe) or self.special(safe):
            odd = [r for r in missing if not _SAFE(r) or self.special(r)]
            self._ask(odd, self.runs)
            gone = set(odd)
            missing = [r for r in missing if r not in gone]
            safe = "\n".join(missing)
        if missing:
            found = self.pretokens(safe.lower() if self.lower else safe)
            if len(self.parts.number) > KEPT:
                self.parts = _Kept()
            self._ask([p for p in set(found) if p != "\n" and p not in self.parts.number], self.parts, self.bare)
            part = self.parts.numbers(found)  # -1: a line feed, between runs
            of_run = np.cumsum(part < 0)[part >= 0]
            ids, _ = self.parts.together(part[part >= 0])
            size = np.bincount(of_run, self.parts.size[part[part >= 0]], len(missing)).astype(np.int64)
            self.runs.add(missing, ids, size)
        numbers[new] = self.runs.numbers(asked)
        return numbers

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        lists = pc.ascii_split_whitespace(texts)
        runs = lists.flatten().dictionary_encode()
        numbers = self._numbers(runs.dictionary.to_pylist())
        ids, at = self.runs.together(numbers[runs.indices.to_numpy()])
        return ids, at[np.cumsum(pc.list_value_length(lists).to_numpy())]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an array without nulls."""
        if not self.by_runs:
            yield from (self._ids(t) for t in texts.to_pylist())
            return
        at, size = 0, np.cumsum(pc.binary_length(texts).to_numpy())
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
            if end == at + 1:  # a text that may be very long, in blocks that end at white space
                data, cut, found = texts[at].as_py().encode(), 0, [np.array([], "<u4")]
                while cut < len(data):
                    gap = _GAP.search(data, cut + BLOCK)
                    upto = gap.start() if gap else len(data)
                    found.append(self._together(pa.array([data[cut:upto].decode()]))[0])
                    cut = upto
                yield np.concatenate(found)
            else:
                ids, ends = self._together(texts[at:end])
                yield from np.split(ids, ends[:-1])
            at = end


_OPEN: dict[str, Encoder] = {}


def _open(path: str) -> Encoder:
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each row of docs, and its ids if wanted.

    path: a tokenizer file that every executor has. A text's ids end with end_id and are cut every `capacity` ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _open(path)
        for batch in slices(batches, BLOCK):
            of, piece, length, crc, ids = [], [], [], [], []
            for row, own in enumerate(encoder.encode(batch.column("text"))):
                raw = own.tobytes() + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    of.append(row)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            start = pa.array(np.array(piece, np.int64) * capacity)
            cols = [batch.column("id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.record_batch([*cols, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths: longest first, each into the fullest bin that it fits, or a new one."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, fits = lengths[i], rooms >> lengths[i]
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


class _Index:
    """Positions by length, of bins that may give; lengths as the bits of an integer, upwards and downwards."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bin_of: list[dict[int, int]] = [{} for _ in range(capacity + 1)]
        self.up = self.down = 0

    def put(self, i: int, b: int) -> None:
        size = self.lengths[i]
        self.bin_of[size][i] = b
        self.up |= 1 << size
        self.down |= 1 << self.capacity - size

    def drop(self, i: int) -> None:
        size = self.lengths[i]
        if self.bin_of[size].pop(i, None) is not None and not self.bin_of[size]:
            self.up ^= 1 << size
            self.down ^= 1 << self.capacity - size

    def longest(self, most: int) -> int:
        return (self.up & (1 << most + 1) - 1).bit_length() - 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths of that sum."""
        both = self.up & self.down >> self.capacity - total
        while both:
            a = (both & -both).bit_length() - 1
            if 2 * a != total or len(self.bin_of[a]) > 1:
                return a, total - a
            both ^= 1 << a
        return None


def _exchange(own: list[int], room: int, lengths: list[int], index: _Index) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """(gain, positions that the bin gives, lengths that it takes) of the exchange that fills it most."""
    ones = [((), 0), *(((i,), lengths[i]) for i in own)]
    twos = [((i, j), lengths[i] + lengths[j]) for k, i in enumerate(own) for j in own[:k]] if len(own) <= NEAR else []
    best: tuple = (0, (), ())
    for gives, size in [*ones, *twos]:
        take = index.longest(size + room) if index.up else -1
        if take - size > best[0]:
            best = take - size, gives, (take,)
    for gain in range(room, max(best[0], room - NEAR), -1):
        for gives, size in ones:
            if found := index.pair(size + gain):
                return gain, gives, found
    return best


def improved(bins: list[list[int]], lengths: list[int], capacity: int, passes: int = PASSES) -> list[list[int]]:
    """The same bins after local search: the fullest underfull one first, each takes from emptier ones; empty ones stay as [].

    Every exchange that is made raises the sum of squared fills, so the search ends.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(passes):
        index, moves = _Index(lengths, capacity), 0
        waiting = [(-fill[b], b) for b in range(len(bins)) if 0 < fill[b] < capacity]
        heapify(waiting)
        for _, b in waiting:
            for i in bins[b]:
                index.put(i, b)
        settled = set()
        while waiting:
            was, b = heappop(waiting)
            if b in settled or -was != fill[b]:
                continue
            settled.add(b)
            for i in bins[b]:
                index.drop(i)
            while fill[b] and fill[b] < capacity:
                gain, gives, takes = _exchange(bins[b], capacity - fill[b], lengths, index)
                if gain <= 0:
                    break
                got = []
                for size in takes:
                    i = next(reversed(index.bin_of[size]))
                    got.append((i, index.bin_of[size][i]))
                    index.drop(i)
                # what is given goes to the first giver that has room for it, if that raises the squares
                back, after = sum(lengths[i] for i in gives), {a: fill[a] for _, a in got}
                for i, a in got:
                    after[a] -= lengths[i]
                to = next((a for a in after if after[a] + back <= capacity), None)
                rise = (fill[b] + gain) ** 2 - fill[b] ** 2 + sum((f + back * (a == to)) ** 2 - fill[a] ** 2 for a, f in after.items())
                if to is None or rise <= 0:
                    for i, a in got:
                        index.put(i, a)
                    break
                for i, a in got:
                    bins[a].remove(i)
                    bins[b].append(i)
                    fill[a] -= lengths[i]
                for i in gives:
                    bins[b].remove(i)
                    bins[to].append(i)
                    index.put(i, to)
                fill[b] += gain
                fill[to] += back
                moves += 1
                for a in after:
                    heappush(waiting, (-fill[a], a))
        if not moves:
            break
    return bins


def _searched(capacity: int):
    """Each group (rows in order of group) packed, or, where its rows have bins, searched on: rows (row, length, bin, at, open)."""

    def done(group, held):
        row, length, bin_ = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((row, bin_))  # the same bins whatever the order of arrival
        row, length, bin_ = row[order], length[order], bin_[order]
        sizes = length.tolist()
        if (bin_ < 0).all():
            bins = best_fit(sizes, capacity)
            names = [(group << 24) + k for k in range(len(bins))]
        else:
            names, first = np.unique(bin_, return_index=True)
            names, bins = names.tolist(), [x.tolist() for x in np.split(np.arange(len(row)), first[1:])]
        bins = improved(bins, sizes, capacity)
        at, own, is_open = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), bool)
        for name, b in zip(names, bins, strict=True):
            place = 0
            for i in b:
                at[i], own[i] = place, name
                place += sizes[i]
            is_open[b] = place < capacity
        return pa.record_batch([pa.array(x) for x in (row, length, own, at, is_open)], ["row", "length", "bin", "at", "open"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("group", "row", "length", "bin")]
            cuts = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                group = int(cols[0][a])
                if held and group != now:
                    yield done(now, held)
                    held = []
                now = group
                held.append([c[a:b] for c in cols[1:]])
        if held:
            yield done(now, held)

    return run


def packed(lengths: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """(row, sequence, at) for rows (row, length) of distinct row numbers and lengths below capacity."""
    spark, out = lengths.sparkSession, []
    left, rounds = lengths.select("row", "length", F.lit(-1).cast("long").alias("bin")), 0
    pieces_left, bins_left = left.count(), None
    while pieces_left:
        groups = -(-pieces_left // group)
        key = F.xxhash64("bin" if rounds else "row", F.lit(rounds))
        dealt = left.withColumn("group", F.pmod(key, F.lit(groups)))
        tasks = min(groups, tasks_for(spark, pieces_left, 16 * group))
        dealt = dealt.repartition(tasks, "group").sortWithinPartitions("group")
        found = staged(dealt.select("group", "row", "length", "bin").mapInArrow(_searched(capacity), "row long, length long, bin long, at long, open boolean"), "packed")
        still = found.filter("open").agg(F.count("*"), F.count_distinct("bin")).first()
        last = groups == 1 or bins_left is not None and still[1] > 0.9 * bins_left
        out.append(found if last else found.filter("not open"))
        if last:
            break
        left, pieces_left, bins_left, rounds = found.filter("open").select("row", "length", "bin"), still[0], still[1], rounds + 1
    if not out:
        return spark.createDataFrame([], "row long, sequence long, at long")
    placed = out[0]
    for more in out[1:]:
        placed = placed.unionByName(more)
    return placed.select("row", F.col("bin").alias("sequence"), "at")


def pack(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) and ids if wanted, one row a piece."""
    given = staged(pieces(docs, path, end_id, capacity, with_ids, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    places = packed(given.filter(F.col("length") < capacity).select("row", "length"), capacity)
    full = given.filter(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence"), F.lit(0).cast("long").alias("at"))
    out = given.join(places.unionByName(full), "row")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"), *(["ids"] if with_ids else []))


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences of pack(with_ids=True), at most `capacity` ids each."""
    parts = packed_pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op11(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path, end_id=1, capacity=4096)
