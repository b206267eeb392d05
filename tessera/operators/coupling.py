"""What changes together: (commit, ts, item) tables of distinct touches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.cuts import cut


def sized(touches: DataFrame, least: int, most: int | None) -> DataFrame:
    """Touches of commits with least to most items (None: any number). The sweep filter stands before the self-join, so pairs stay
    bounded by most for each touch."""
    size = touches.groupBy("commit").agg(F.count("*").alias("_n")).filter((F.col("_n") >= least) & (F.lit(most is None) | (F.col("_n") <= (most or 0))))
    return touches.join(size.select("commit"), "commit", "left_semi")


#: Pairs, about, that one task forms or counts.
TASK_PAIRS = 1_000_000


def pairs(touches: DataFrame, support: int = 3, most: int | None = 20) -> DataFrame:
    """(a, b, n): unordered pairs that at least support commits touch.

    A commit of more than most items is a sweep that says nothing of any two, and is left out; None counts every commit. An
    item that fewer commits touch is in no pair, and goes before pairs are formed. A commit's items are one row, which its pairs
    come from, and tasks are as many as the pairs ask for, so what one task holds doesn't grow with the touches.
    """
    spark = touches.sparkSession
    packed = touches.filter("commit is not null").groupBy("commit").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("item")).alias("_items"))
    packed = cut(packed.filter((F.col("_n") >= 2) & (F.lit(most is None) | (F.col("_n") <= (most or 0)))).select("commit", "_items"))
    rare = cut(packed.select(F.explode("_items").alias("item")).groupBy("item").agg(F.count("*").alias("_n")).filter(F.col("_n") < support).select("item"))
    if not rare.isEmpty():
        rest = packed.select("commit", F.explode("_items").alias("item")).join(rare.hint("shuffle_hash"), "item", "left_anti")
        packed = cut(rest.groupBy("commit").agg(F.sort_array(F.collect_list("item")).alias("_items")))
    n = F.size("_items").cast("long")
    total = packed.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_PAIRS))
    each = packed.repartition(tasks).select("_items", F.posexplode("_items").alias("_k", "a"))
    each = each.select("a", F.explode(F.slice("_items", F.col("_k") + 2, F.size("_items"))).alias("b")).filter("a < b")
    return each.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= support)


def decay(age_days: Column, mode: str = "exponential", half_life: float = 1095.0, floor: float = 0.05, span: float = 1095.0) -> Column:
    if mode == "exponential":
        return F.pow(F.lit(0.5), age_days / half_life)
    if mode == "linear":
        return F.greatest(F.lit(floor), 1 - age_days / span)
    return F.lit(1.0)


def age_days(ts: Column, now: Column) -> Column:
    """Days as a fraction. The columns may be timestamps with or without a zone."""
    return (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 86400.0


def co_changes(touches: DataFrame, support: int = 3, most: int = 20, mode: str = "exponential") -> DataFrame:
    """(src, dst, n, confidence, support): both directions; admitted on the raw count, confidence is min(1, n / commits of src)."""
    t = sized(touches, 2, most)
    newest = t.agg(F.max("ts").alias("_now"))
    t = t.crossJoin(F.broadcast(newest)).withColumn("w", decay(age_days(F.col("ts"), F.col("_now")), mode)).select("commit", "item", "w")
    both = t.withColumnRenamed("item", "src").join(t.select("commit", F.col("item").alias("dst")), "commit").filter("src != dst")
    both = both.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("support")).filter(F.col("n") >= support)
    own = t.groupBy(F.col("item").alias("src")).agg(F.count("*").alias("_own"))
    return both.join(own, "src").select("src", "dst", "n", F.round(F.least(F.lit(1.0), F.col("n") / F.col("_own")), 2).alias("confidence"), "support")


def volatility(touches: DataFrame) -> DataFrame:
    """(item, n, volatility): the share of an item's touches in the newest quarter of time, over a quarter."""
    span = touches.agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    t = touches.crossJoin(F.broadcast(span))
    recent = F.unix_timestamp(F.col("ts").cast("timestamp")) >= F.unix_timestamp(F.col("_last").cast("timestamp")) - 0.25 * (F.unix_timestamp(F.col("_last").cast("timestamp")) - F.unix_timestamp(F.col("_first").cast("timestamp")))
    return t.groupBy("item").agg(F.count("*").alias("n"), F.count_if(recent).alias("recent")).select("item", "n", F.round(F.col("recent") / F.col("n") / 0.25, 6).alias("volatility"))


def change_type(files: Column, nodes: Column, added: Column, removed: Column) -> Column:
    """Bulk, additive, alter or unknown, in that order."""
    return F.when((files > 8) | (nodes > 12), "bulk").when((added > 0) & (removed == 0), "additive").when(removed > 0, "alter").otherwise("unknown")


def file_plane(touches: DataFrame, owners: DataFrame, support: int = 3, most: int | None = 20) -> DataFrame:
    """pairs() of files instead of items: (a, b, n). owners: (item, file); a commit touches each file once."""
    of_file = touches.join(owners.select("item", "file"), "item").select("commit", F.col("file").alias("item")).distinct()
    return pairs(of_file, support, most)
