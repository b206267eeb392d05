"""Ranking: deduplication, fusion, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def union_channels(channels: dict[str, DataFrame], cap: int | None = None) -> DataFrame:
    """From (q, id, score) of each channel: (q, id, channels, score, first): the best score, the channels met in order.

    cap: ids of a query at most, the best ones; None for all of them.
    """
    rows = None
    for k, (name, df) in enumerate(channels.items()):
        own = df.select("q", "id", "score", F.lit(k).alias("k"), F.lit(name).alias("channel"))
        rows = own if rows is None else rows.unionAll(own)
    merged = rows.groupBy("q", "id").agg(F.max("score").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("k", "channel"))), lambda x: x["channel"]), ",").alias("channels"), F.min("k").alias("first"))
    return top_per(merged, ["q"], [F.desc("score"), F.col("id")], cap).drop("rank") if cap else merged


def fuse(channels: dict[str, tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of (q, id, score): ranks from 0, ties by id; divided by the active weights of the query."""
    rows = None
    for channel, (df, weight) in channels.items():
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")) - 1
        own = df.select("q", "id", (F.lit(float(weight)) / (k + place)).alias("part"), F.lit(float(weight)).alias("weight"), F.lit(channel).alias("channel"))
        rows = own if rows is None else rows.unionAll(own)
    active = rows.groupBy("q", "channel").agg(F.max("weight").alias("weight")).groupBy("q").agg(F.sum("weight").alias("active"))
    parts = rows.groupBy("q", "id").agg(F.sum("part").alias("part"))
    return parts.join(active, "q").select("q", "id", F.round(F.col("part") / F.col("active"), 9).alias("fused"))


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The rows before the first whose running cost passes the budget; the first row always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("rn", F.row_number().over(w)).withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("rn") == 1) | (F.col("spent") <= budget))


def interleave(first: DataFrame, second: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Two ranked lists of one schema in turn, the first leading: column slot."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    a = first.withColumn("slot", 2 * rank - 1)
    return a.unionByName(second.withColumn("slot", 2 * rank))


def first_claim(channels: dict[str, DataFrame]) -> DataFrame:
    """(channel, n): ids that a channel is the first to find."""
    rows, names = None, list(channels)
    for k, df in enumerate(channels.values()):
        own = df.select("q", "id", F.lit(k).alias("k"))
        rows = own if rows is None else rows.unionAll(own)
    claim = rows.groupBy("q", "id").agg(F.min("k").alias("k"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return claim.groupBy(label.alias("channel")).agg(F.count("*").alias("n"))


def locality_rank(df: DataFrame, keys: list[str], weight: str, tier: str, distance: str, name: str) -> DataFrame:
    """Relations of a node: heavier first, then stronger tier, nearer place, name."""
    order = [F.desc(weight), F.col(tier).asc_nulls_last(), F.col(distance).asc_nulls_last(), F.col(name)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def running_cap(df: DataFrame, keys: list[str], order: list[Column], counted: Column, cap: int) -> DataFrame:
    """Rows in rank order without the counted ones beyond the first cap; all others stay."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_c", F.count_if(counted).over(w)).filter(~counted | (F.col("_c") <= cap)).drop("_c")
