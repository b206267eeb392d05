"""Bounded walks over (src, dst, edge_type) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cuts import cut


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to): one step out, in, or both ways. Both ways is a union of two equi-joinable sides, never an OR."""
    out, back = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")), edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction]


def walk(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out", cap: int | None = None) -> DataFrame:
    """(id, depth): least depth of every node within hops of the seeds, which have depth 0. cap: nodes of a frontier that go on, by id."""
    step, frontier = steps(edges, direction), cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, hops + 1):
        going = frontier.orderBy("id").limit(cap) if cap and depth > 1 else frontier
        reached = going.join(step, going["id"] == step["at"]).select(F.col("to").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionAll(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def blast_radius(edges: DataFrame, nodes: DataFrame, changed: DataFrame, depth: int = 2, limit: int = 25, source_types: tuple[str, ...] = ("ORDER",)) -> DataFrame:
    """Nodes that reach the changed ones, the nearest first, source types before others, then by id; limit of them with the count of all."""
    edges = cut(edges.select("src", "dst").distinct())  # read by every hop
    hit = walk(edges, changed, depth, "in").filter("depth > 0").join(nodes.select("id", "node_type", "name"), "id")
    hit = cut(hit)
    total = hit.agg(F.count("*").alias("total"))
    other = F.when(F.col("node_type").isin(*source_types), 0).otherwise(1).alias("other")
    top = hit.select("*", other).orderBy("depth", "other", "id").limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit).drop("other")


def override_closure(edges: DataFrame, seeds: DataFrame, hops: int = 8) -> DataFrame:
    """Seeds and all they override or are overridden by, over OVERRIDES edges; cycles end at visited nodes."""
    return walk(edges.filter("edge_type = 'OVERRIDES'"), seeds, hops, "both")


def fan_out_cap(edges: DataFrame, cap: int) -> DataFrame:
    """At most cap edges of each (src, edge_type), the first by dst."""
    rank = F.row_number().over(Window.partitionBy("src", "edge_type").orderBy("dst"))
    return edges.withColumn("_r", rank).filter(F.col("_r") <= cap).drop("_r")


def first_writer(edges: DataFrame, order: str) -> DataFrame:
    """One edge of each (src, dst, edge_type): the one of the earliest pass."""
    rank = F.row_number().over(Window.partitionBy("src", "dst", "edge_type").orderBy(order))
    return edges.withColumn("_r", rank).filter("_r = 1").drop("_r")


def neighbours(edges: DataFrame, nodes: DataFrame, centre: DataFrame, direction: str = "both", limit: int = 60) -> DataFrame:
    """(centre, id, edge_type, node_type, name) of incident edges, at most limit of each centre by type and id."""
    ids = centre.select(F.col("id").alias("centre"))
    out = edges.join(ids, edges["src"] == ids["centre"]).select("centre", F.col("dst").alias("id"), "edge_type", F.lit("out").alias("direction"))
    back = edges.join(ids, edges["dst"] == ids["centre"]).select("centre", F.col("src").alias("id"), "edge_type", F.lit("in").alias("direction"))
    rows = {"out": out, "in": back, "both": out.unionAll(back)}[direction]
    rank = F.row_number().over(Window.partitionBy("centre").orderBy("edge_type", "direction", "id"))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r").join(nodes.select("id", "node_type", "name"), "id")
