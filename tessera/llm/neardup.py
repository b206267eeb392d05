"""SimHash near-duplicates, every link verified on the shingle sets by Jaccard similarity.

A text is the set of the XXH64 values of its shingles of SHINGLE lower-case words. Texts of equal sets are one set from
the start, and a set has a SimHash fingerprint. Fingerprints go through the byte-position index of simhash.py: lists by
positional bytes, tallies of shared bytes, the count filter, verification of the differing bits. That index is sure of two
differing bits, and sets of SIMILARITY differ in more as a rule; so each set also has BANDS keys of ROWS minima under
different hash functions, and sets that share a key are candidates too, which two sets of similarity s miss with
probability (1 - s ** ROWS) ** BANDS: 8 in a million at 0.8 and 2 in a thousand million at 0.85, if minima were ideal.
Both kinds of candidates are joined into components (one edge for each member of a key's list, so a hot key makes no
pairs; a task sends only the first set that it has of a key), and within each component all links of SIMILARITY or more
that connect it are found by a search over the sets themselves, so no candidate stays unverified, and a miss is made good
where others connect the two. A component of over SPLIT sets is searched in blocks, so no task holds it.

Texts are packed into the blocks of substrings.py, stored once and bucketed: rows are named by block and position, and
what is found of them comes back to their block, so texts do not move again and no list of rows is broadcast.

Defined cases: a text of fewer words than a shingle is one shingle; null and wordless texts are one class; of each class
one row stays, that of the smallest id, ids of null last; rows are told apart by place, so ids may repeat or be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import BROADCAST_ROWS, components, discard, join_skewed, staged, tasks_for
from tessera.llm.simhash import SEED, shingle_hashes
from tessera.llm.substrings import packed, texts_of

SHINGLE, SIMILARITY, ROWS, BANDS = 5, 0.8, 8, 64
KEYS_PER_TASK, SETS_PER_TASK = 2_000_000, 20_000
#: Sets of a component above which it is verified in blocks of so many.
SPLIT = 128
_DRAW = np.random.default_rng(SEED)
_XOR = _DRAW.integers(0, 1 << 32, ROWS * BANDS, np.uint32)[:, None]
_TIMES = _DRAW.integers(0, 1 << 32, ROWS * BANDS, np.uint32)[:, None] | np.uint32(1)
_MIX = _DRAW.integers(0, 1 << 63, (BANDS, ROWS + 1), np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none of the empty one."""
    if not len(found):
        return np.empty(0, np.uint64)
    low = (found ^ found >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(low), 512):
        np.minimum(least, ((low[None, k : k + 512] ^ _XOR) * _TIMES).min(1), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX[:, :ROWS]).sum(1, dtype=np.uint64) + _MIX[:, ROWS]


def _keyed(blocks: DataFrame, id_col: str, shingle: int) -> DataFrame:
    """Rows (block, pos, id, set, fp, keys): set names the shingle set, fp is its SimHash fingerprint."""
    given = blocks.select("block", F.col("rest").getField(id_col).alias("ids"), "sizes", "body")
    kind = given.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k, r in enumerate(batch.select(["block", "sizes", "body"]).to_pylist()):
                ids = batch.column("ids").slice(k, 1).flatten()
                texts = texts_of(r["sizes"], r["body"])
                for at in range(0, len(texts), 1024):
                    sets = [shingle_set(t, shingle) for t in texts[at : at + 1024]]
                    names = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
                    fps = np.fromiter(map(simhash.majority, sets), np.uint64, len(sets))
                    keys = pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                    place = [pa.array(np.full(len(sets), r["block"]), pa.int64()), pa.array(np.arange(at, at + len(sets)), pa.int32())]
                    yield pa.record_batch([*place, ids.slice(at, len(sets)), pa.array(names.view(np.int64)), pa.array(fps.view(np.int64)), keys], ["block", "pos", "id", "set", "fp", "keys"])

    return given.mapInArrow(run, f"block long, pos int, id {kind}, set long, fp long, keys array<long>")


def _fingerprints(sets: DataFrame) -> DataFrame:
    """The distinct fingerprints: fp, first (one of its sets), n (its sets)."""
    return staged(sets.groupBy("fp").agg(F.min("set").alias("first"), F.count("*").alias("n")), "fingerprints")


def _simhash_edges(sets: DataFrame, fps: DataFrame) -> DataFrame:
    """(a, b) pairs of sets that span the components of the SimHash links: fingerprints of one value, and of simhash.BITS
    differing bits at most by the byte-position index, its tallies and its count filter."""
    same = join_skewed(sets.select("fp", "set"), fps, "fp", "n").select(F.col("first").alias("a"), F.col("set").alias("b"))
    link = simhash.links(fps).join(fps.select(F.col("fp").alias("a"), F.col("first").alias("fa")), "a").join(fps.select(F.col("fp").alias("b"), F.col("first").alias("fb")), "b")
    return same.unionAll(link.select("fa", "fb"))


def _edges(key: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the first set of each key's list an edge to each other, once; and the keys with their first sets."""
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    head = np.repeat(name[first], np.diff(np.r_[first, len(key)]))
    return np.unique(np.stack([head, name], 1)[head != name], axis=0), key[first], name[first]


def _partial_stars(batches):
    """Rows (key, a, b) of what a task has of each key: edges without a key, and the key's first set as a, for those of other tasks."""
    for batch in batches:
        keys = batch.column("keys")
        n = np.diff(keys.offsets.to_numpy())
        if not n.sum():
            continue
        edge, key, head = _edges(keys.flatten().to_numpy(), np.repeat(batch.column("set").to_numpy(), n))
        none = pa.nulls(len(edge), pa.int64())
        yield pa.record_batch([none, pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["key", "a", "b"])
        yield pa.record_batch([pa.array(key), pa.array(head), pa.nulls(len(key), pa.int64())], ["key", "a", "b"])


def _stars(batches):
    """One task's lists of keys, each of the first sets that tasks have found, as edges."""
    held = [(b.column("key").to_numpy(), b.column("a").to_numpy()) for b in batches if b.num_rows]
    if held:
        edge, _, _ = _edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.record_batch([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["a", "b"])


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of the sets (none empty) the position of its class's first member, by links of at least the similarity."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(token, np.cumsum(size)[:-1])
    leader, alive, flat, mark = np.arange(len(sets)), np.arange(len(sets)), token, np.zeros(len(values), np.int32)
    while len(alive) > 1:
        seed = alive[0]
        flat, alive, queue = flat[size[seed] :], alive[1:], [seed]
        while queue and len(alive):
            at = queue.pop()
            mark[own[at]] = 1
            n = size[alive]
            shared = np.add.reduceat(mark[flat], np.r_[0, np.cumsum(n)[:-1]])
            mark[own[at]] = 0
            hit = shared >= similarity * (n + size[at] - shared) - 1e-9
            if hit.any():
                leader[alive[hit]] = seed
                queue.extend(alive[hit].tolist())
                flat, alive = flat[~np.repeat(hit, n)], alive[~hit]
    return leader


def _verified(similarity: float):
    def run(batches):
        held = [(b.column("root").to_numpy(), b.column("set").to_numpy(), b.column("members")) for b in batches if b.num_rows]
        if not held:
            return
        root, name = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        sets = [np.frombuffer(v, np.uint64) for _, _, column in held for v in column.to_pylist()]
        order = np.lexsort((name, root))
        leader = name.copy()
        for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            leader[part] = name[part[linked([sets[k] for k in part], similarity)]]
        yield pa.record_batch([pa.array(name), pa.array(leader)], ["set", "leader"])

    return run


def _crossed(similarity: float):
    """Links (a, b) that connect what is linked between the sets of a group that ask and all others of the group; rows in order of
    group, those that ask first."""

    def run(batches):
        group, asks, rest = None, [], []

        def done():
            if not asks or not rest:
                return pa.record_batch([pa.array([], pa.int64())] * 2, ["a", "b"])
            sets = [np.frombuffer(m, np.uint64) for _, m in rest]
            size, name = np.fromiter(map(len, sets), np.int64, len(sets)), np.array([x for x, _ in rest])
            values, flat = np.unique(np.concatenate(sets), return_inverse=True)
            begin, out, part = np.r_[0, np.cumsum(size)[:-1]], [], np.arange(len(sets))
            for ask, m in asks:
                own = np.frombuffer(m, np.uint64)
                at = np.searchsorted(values, own).clip(max=len(values) - 1)
                mark = np.zeros(len(values), np.int32)
                mark[at[values[at] == own]] = 1
                shared = np.add.reduceat(mark[flat], begin)
                hit = np.flatnonzero((shared >= similarity * (size + len(own) - shared) - 1e-9) & (name != ask))
                # one link to each part that earlier ones have made, so a group gives no more links than it has sets
                met, first = np.unique(part[hit], return_index=True)
                out.append(np.stack([np.full(len(met), ask), name[hit[first]]], 1))
                if len(met) > 1:
                    part[np.isin(part, met)] = met[0]
            found = np.concatenate(out)
            return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                key = r["root"], r["block"], r["chunk"]
                if key != group:
                    if group:
                        yield done()
                    group, asks, rest = key, [], []
                (asks if r["asks"] else rest).append((r["set"], r["members"]))
                if len(rest) >= 4 * SPLIT:  # a group's rows are about SPLIT, but a hash may give more
                    yield done()
                    rest = []
        if group:
            yield done()

    return run


def _split_links(held: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(a, b), staged: links that connect each class of the components of sizes (root, n), without any task that has a component.

    held: (root, set, members). A component's first set is held against all others, dealt in blocks; those that it does not
    reach, against all in turn, blocks of the one against blocks of the other. Links among the reached would join what is
    joined already, so no link between classes is left out.
    """
    blocks = F.ceil(F.col("n") / SPLIT).cast("long")
    held = staged(held.join(F.broadcast(sizes), "root") if sizes.count() <= BROADCAST_ROWS else held.join(sizes, "root"), "held")
    first = held.groupBy("root").agg(F.min("set").alias("set"))
    own = F.pmod(F.xxhash64("set"), blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cols = ["root", "block", "chunk", "asks", "set", "members"]

    def links(asking: DataFrame, chunks) -> DataFrame:
        """asking: rows of held with `chunk`; chunks: how many of them each component has."""
        rest = held.join(chunks, "root").select("root", own.alias("block"), every(F.col("chunks")).alias("chunk"), F.lit(False).alias("asks"), "set", "members")
        ask = asking.select("root", every(blocks).alias("block"), "chunk", F.lit(True).alias("asks"), "set", "members")
        dealt = rest.select(*cols).unionByName(ask.select(*cols)).repartition("root", "block", "chunk").sortWithinPartitions("root", "block", "chunk", F.desc("asks"))
        return dealt.mapInArrow(_crossed(similarity), "a long, b long")

    pivot = held.join(first, ["root", "set"]).withColumn("chunk", F.lit(0).cast("long"))
    reached = staged(links(pivot, first.select("root", F.lit(1).cast("long").alias("chunks"))), "reached")
    far = held.join(reached.select(F.col("b").alias("set")).unionAll(first.select("set")), "set", "left_anti")
    many = staged(far.groupBy("root").agg(F.ceil(F.count("*") / SPLIT).cast("long").alias("chunks")), "far")
    if many.isEmpty():
        discard(held, many)
        return reached
    asking = far.join(many, "root").withColumn("chunk", F.pmod(F.xxhash64("set", F.lit(1)), F.col("chunks")))
    found = staged(reached.unionAll(links(asking, many)), "links")
    discard(held, reached, many)
    return found


def _members(shingle: int):
    """Rows (root, set, members) of the texts that a block's `found` asks for."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                texts = texts_of(r["sizes"], r["body"])
                for at in range(0, len(r["found"]), 256):
                    some = r["found"][at : at + 256]
                    held = [shingle_set(texts[x["pos"]], shingle).tobytes() for x in some]
                    yield pa.record_batch([pa.array([x[c] for x in some], pa.int64()) for c in ("root", "set")] + [pa.array(held, pa.binary())], ["root", "set", "members"])

    return run


def _stay(batches):
    """Rows (rest, text) of the positions that a block's `found` has."""
    for batch in batches:
        for k, r in enumerate(batch.select(["sizes", "body", "found"]).to_pylist()):
            texts, at = texts_of(r["sizes"], r["body"]), r["found"]
            rest = batch.column("rest").slice(k, 1).flatten().take(pa.array(at, pa.int32()))
            yield pa.record_batch([rest, pa.array([texts[p] for p in at], pa.binary())], ["rest", "text"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each near-duplicate class, with its columns."""
    spark = docs.sparkSession
    blocks, rest = packed(docs, text_col, "neardup")
    keyed = staged(_keyed(blocks, id_col, shingle), "keyed")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "block", "pos")
    sets = staged(keyed.groupBy("set").agg(F.min(place).alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets")
    discard(keyed)
    starred = staged(sets.select("set", "keys").mapInArrow(_partial_stars, "key long, a long, b long"), "stars")
    heads = starred.filter("key is not null").select("key", "a")
    tasks = tasks_for(spark, heads.count(), KEYS_PER_TASK)
    stars = starred.filter("key is null").select("a", "b").unionAll(heads.repartition(tasks, "key").mapInArrow(_stars, "a long, b long"))
    fps = _fingerprints(sets)
    near = components(_simhash_edges(sets, fps).unionAll(stars))
    slim = staged(sets.select("set", "least"), "slim")
    discard(sets, fps, starred)
    members = slim.select("set", "least.block", "least.pos").join(near.withColumnRenamed("node", "set"), "set")
    asked = staged(members.groupBy("block").agg(F.collect_list(F.struct("pos", "root", "set")).alias("found")), "members")
    held = blocks.select("block", "sizes", "body").join(asked, "block").select("sizes", "body", "found").mapInArrow(_members(shingle), "root long, set long, members binary")
    large = staged(near.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT), "large")
    tasks = tasks_for(spark, near.count(), SETS_PER_TASK)
    few = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    leaders = held.join(few, "root", "left_anti").repartition(tasks, "root").mapInArrow(_verified(similarity), "set long, leader long")
    used = [large]
    if not large.isEmpty():
        links = _split_links(held.join(few.select("root"), "root", "left_semi"), large, similarity)
        used += [links, components(links)]
        leaders = leaders.unionAll(used[-1].toDF("set", "leader"))
    leaders = staged(leaders, "leaders")
    discard(*used)
    labelled = slim.join(leaders, "set", "left").withColumn("leader", F.coalesce("leader", "set"))
    first = labelled.groupBy("leader").agg(F.min("least").alias("least")).select("least.block", "least.pos")
    keep = staged(first.groupBy("block").agg(F.array_sort(F.collect_list("pos")).alias("found")), "stay")
    discard(near, slim, asked, leaders)
    kept = blocks.join(keep, "block").select("rest", "sizes", "body", "found").mapInArrow(_stay, f"rest {rest}, text binary")
    kind = docs.schema[text_col].dataType
    return kept.select(*[F.col("text").cast(kind).alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])
