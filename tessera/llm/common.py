"""Helpers shared by the text operators: tables, staged results, joins on skewed keys, batch slicing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is counted to have no more rows than this.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds this share of all rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 2_000
#: Edges of a graph that one task may hold.
EDGES_PER_TASK = 1_000_000
#: Bytes of rows that Spark hands to Python at once; a row of more goes alone.
BATCH_BYTES = 2 << 20
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True on the fifth of the ids that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session sets none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Intermediate results that are still there: the folder, and the table's name if it is one.
_MADE: dict[str, str | None] = {}


def _remove(spark: SparkSession, path: str) -> None:
    name = _MADE.pop(path, None)
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended; its shared folder goes with it
        pass


def _made(spark: SparkSession, path: str, name: str | None = None) -> None:
    _MADE[path] = name
    atexit.register(lambda: path in _MADE and _remove(spark, path))


def made() -> set[str]:
    """The intermediate results that are there now."""
    return set(_MADE)


def discard(*frames: DataFrame) -> None:
    """Remove what staged() wrote for these; nothing that is still to be computed may read them."""
    for df in frames:
        _remove(df.sparkSession, df.staged_at)


def release(spark: SparkSession, before: set[str], keep: DataFrame | None = None) -> None:
    """Remove the intermediate results made since `before` was taken; keep is a staged DataFrame whose own rows stay.

    For callers who have written a result and need no DataFrame that was derived before it.
    """
    stay = {f.rpartition("/")[0] for f in keep.inputFiles()} if keep is not None else set()
    for path in made() - before:
        if not any(x.endswith(path.split(":", 1)[-1]) for x in stay):
            _remove(spark, path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """df written once as a table in the shared folder, in buckets by key, so that joins by key need not move it."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "uncompressed").saveAsTable(name)
    _made(spark, path, name)
    return spark.table(name)


def bucket_of(value: int, buckets: int) -> int:
    """The bucket of a long: Spark's own hash (Murmur3 of both halves, seed 42), modulo the number of buckets."""
    h, full = 42, 0xFFFFFFFF
    for half in (value & full, value >> 32 & full):
        k = half * 0xCC9E2D51 & full
        k = (k << 15 | k >> 17) * 0x1B873593 & full
        h ^= k
        h = (h << 13 | h >> 19) * 5 + 0xE6546B64 & full
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for rows, so that a task holds about per_task of them at most, and the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Inner join with a table of one row a key: broadcast if counted small, else salted so that no key meets in one task."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys)
    dealt = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns[:1]), F.lit(salts)).cast("int")).join(dealt, [*keys, "_salt"]).drop("_salt")


def join_skewed(big: DataFrame, small: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) with a table of one row a key that also holds the key's rows in big.

    Keys with over 1/HOT_SHARE of the rows, of which there can be HOT_SHARE at most, are broadcast; the rest are shuffled.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > max(total // HOT_SHARE, 1)
    hot, rest = small.filter(is_hot).drop(count), small.filter(~is_hot).drop(count)
    marked = big.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot")
    return big.join(F.broadcast(hot), key).unionByName(cold.join(rest, key, how))


def _settled(batches: Iterator) -> Iterator:
    """One task's graph: each node with the least node of its component, by hooking roots and pointer jumping."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    node, at = np.unique(np.concatenate([x[k] for k in (0, 1) for x in held]), return_inverse=True)
    i, j = np.split(at, 2)
    root = np.arange(len(node))
    while (differ := root[i] != root[j]).any():
        i, j = root[i[differ]], root[j[differ]]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (root[root] != root).any():
            root = root[root]
    yield pa.record_batch([pa.array(node), pa.array(node[root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) longs: rows (node, root), staged, for nodes with an edge.

    While there are more edges than one task may hold the graph is contracted at random: each round every node moves to
    the neighbour (or itself) of least seeded hash, which leaves a constant share of the nodes; labels are composed
    backwards. Rounds aggregate with map-side minima, so a node with very many neighbours gathers in no task. What is left
    of the graph, EDGES_PER_TASK at most, is settled in one task, so a small graph costs the driver one job and no rounds.
    """
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    pair, moves = staged(pair, "edges"), []
    while pair.count() > EDGES_PER_TASK:
        seeded = lambda c, n=len(moves): F.struct(F.xxhash64(c, F.lit(n)).alias("h"), c.alias("v"))
        a, b = F.col("a"), F.col("b")
        near = pair.select(a.alias("node"), F.least(seeded(a), seeded(b)).alias("m")).unionAll(pair.select(b.alias("node"), F.least(seeded(a), seeded(b)).alias("m")))
        move = staged(near.groupBy("node").agg(F.min("m").getField("v").alias("root")), "moves")
        moves.append(move)
        ra, rb = move.toDF("a", "ra"), move.toDF("b", "rb")
        met = pair.join(ra, "a").join(rb, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        after = staged(met.filter("a < b").distinct(), "edges")
        discard(pair)
        pair = after
    label = staged(pair.coalesce(1).mapInArrow(_settled, "node long, root long"), "settled")
    discard(pair)
    if not moves:
        return label
    rounds = [*moves, label]
    for move in reversed(moves):
        onward = label.toDF("root", "_next")
        label = move.join(onward, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    label = staged(label, "settled")
    discard(*rounds)
    return label


def small_batches(spark: SparkSession) -> None:
    """From now on Spark gathers BATCH_BYTES of rows for Python, or what the session has if that is less, not 64 MB in the
    executor's JVM and once more in the worker. It is read when a plan runs, so it stays set; no result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def slices(batches: Iterator, limit: int = 2 << 20) -> Iterator:
    """Arrow batches cut so that each holds about limit bytes, or one row."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, int(rows * limit / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
