"""Whole-graph analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.reach import strong_components
from tessera.plans.cuts import cut

#: Weights of edge types in a node's inbound importance; all others count 0.5.
WEIGHTS = {"CALLS": 1.0, "DEPENDS_ON": 0.8}
STRUCTURAL = ("CONTAINS", "DEFINED_IN", "CO_CHANGES", "COUPLED_WITH")


def edge_weight(edge_type: Column) -> Column:
    weight = F.lit(0.5)
    for name, value in WEIGHTS.items():
        weight = F.when(edge_type == name, value).otherwise(weight)
    return weight


def god_nodes(edges: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    inbound = edges.filter(~F.col("edge_type").isin(*STRUCTURAL)).groupBy(F.col("dst").alias("id")).agg(F.round(F.sum(edge_weight(F.col("edge_type"))), 6).alias("score"), F.count("*").alias("n_in"))
    top = inbound.orderBy(F.desc("score"), "id").limit(limit)
    return top.join(nodes.select("id", "node_type", "name"), "id")


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, name, n): counts by node type, and by edge type with both ends live."""
    live = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("name")).agg(F.count("*").alias("n")).unionByName(live.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("name")).agg(F.count("*").alias("n")))


def dead_nodes(edges: DataFrame, nodes: DataFrame, node_type: str, used_by: tuple[str, ...]) -> DataFrame:
    """Nodes of a type that no live node reaches by the given edge types."""
    use = edges.filter(F.col("edge_type").isin(*used_by)).join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return nodes.filter(F.col("node_type") == node_type).join(use.select(F.col("dst").alias("id")), "id", "left_anti")


def cycles(edges: DataFrame, length: int | None = 3) -> DataFrame:
    """Simple cycles of up to length nodes (None: of any length), each once, from its least node: (n, path).

    Paths grow only inside a strongly connected component, only to nodes beyond their first, and end with the last that
    grows. A dense component of n nodes has more simple cycles than any power of n, so ask for a length there; the
    components themselves are reach.strong_components.
    """
    step = edges.select("src", "dst").filter("src != dst").distinct()
    part = strong_components(step)
    step = cut(step.join(part.toDF("src", "_a"), "src").join(part.toDF("dst", "_b"), "dst").filter("_a = _b").select("src", "dst"))
    path = step.filter("src < dst").select(F.array("src", "dst").alias("path"))
    found, n = None, 2
    while length is None or n <= length:
        head, last = F.col("path")[0], F.element_at("path", -1)
        closing = path.join(step, (last == F.col("src")) & (head == F.col("dst"))).select(F.lit(n).alias("n"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))
        found = closing if found is None else found.unionAll(closing)
        path = path.join(step, last == F.col("src")).filter((F.col("dst") > head) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        n += 1
        if length is None:
            path = cut(path)
            if path.isEmpty():
                break
    return found


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-9) -> DataFrame:
    """Personalised PageRank over undirected weighted edges (src, dst, weight); restart and dangling mass go to the seeds (id).

    Rounds end when the ranks move by no more than the tolerance in sum (None: never before `rounds`). Each is one join on the
    node and one aggregation, and the plan is cut after each.
    """
    both = edges.filter("src != dst").select("src", "dst", "weight").unionAll(edges.filter("src != dst").select(F.col("dst"), F.col("src"), "weight"))
    both = cut(both.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w")))
    out = cut(both.groupBy("src").agg(F.sum("w").alias("total")))
    step = cut(both.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    seed = seeds.select("id").distinct().crossJoin(seeds.select("id").distinct().agg((F.lit(1.0) / F.count("*")).alias("s")))
    ids = both.select(F.col("src").alias("id")).union(seeds.select("id")).distinct()
    base = cut(ids.join(seed, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("s", F.lit(0.0)).alias("rank")))
    rank = base
    for _ in range(rounds):
        moved = rank.join(step, rank["id"] == step["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        stuck = rank.join(out, rank["id"] == out["src"], "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("stuck"))
        rank = cut(rank.select("id", "s", "rank").join(moved, "id", "left").crossJoin(F.broadcast(stuck)).select("id", "s", (damping * (F.coalesce("got", F.lit(0.0)) + F.col("stuck") * F.col("s")) + (1 - damping) * F.col("s")).alias("rank"), F.col("rank").alias("was")))
        if tolerance is not None and (rank.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) <= tolerance:
            break
    return rank.select("id", F.round("rank", 6).alias("rank"))


def shrink_guard(before: DataFrame, after: DataFrame, most: float = 0.3) -> DataFrame:
    """(before, after, loss, verdict): a new snapshot that lost over the given share of rows is degraded."""
    loss = F.when(F.col("before") == 0, 0.0).otherwise(1 - F.col("after") / F.col("before"))
    return before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).withColumn("loss", F.round(loss, 6)).withColumn("verdict", F.when(loss > most, "DEGRADED").otherwise("ACTIVE"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows; unchanged ones are left out.

    Compared by a hash of all columns, each with a mark of its being null, since the hash itself passes nulls over.
    """

    def digest(df: DataFrame, name: str) -> DataFrame:
        marked = [c for x in sorted(df.columns) if x != key for c in (F.col(x).isNull(), F.col(x))]
        return df.select(key, F.xxhash64(*marked).alias(name))

    both = digest(before, "_b").join(digest(after, "_a"), key, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")
