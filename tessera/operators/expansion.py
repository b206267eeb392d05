"""From seeds to a bounded, ranked subgraph of each query, and to the text that a reader gets of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rank import budget_prefix, running_cap, top_per
from tessera.plans.cuts import cut

#: How a score falls with each hop, nodes of a capped type that stay, edges of a capped type that a node keeps,
#: how many times the wanted nodes are ranked at all, and the least length of a name that a question may hold verbatim.
DECAY, ENDPOINTS, FAN_OUT, PRELIMIT, VERBATIM = 0.6, 8, 15, 20, 4

#: Ids of a frontier that are sent to every task; more are dealt.
FEW = 1_000_000


def _typed_steps(edges: DataFrame, cap: int, frontier: DataFrame) -> DataFrame:
    """(at, to) of the frontier's nodes: both ways, of each at most `cap` steps of an edge type and way, the first by id.

    Edges of other nodes go before any is ranked; the frontier's ids are hashed, so that edges aren't sorted for that.
    """
    ids = cut(frontier.select(F.col("id").alias("src")).distinct())
    ids = F.broadcast(ids) if ids.count() <= FEW else ids.hint("shuffle_hash")
    both = None
    for way in ("out", "in"):
        side = edges.select("src", "dst", "edge_type") if way == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")
        place = F.row_number().over(Window.partitionBy("src", "edge_type").orderBy("dst"))
        own = side.join(ids, "src", "left_semi").distinct().withColumn("_r", place).filter(F.col("_r") <= cap).select(F.col("src").alias("at"), F.col("dst").alias("to"))
        both = own if both is None else both.unionAll(own)
    return both.distinct()


def expanded(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int = 2, cap: int = 12, most: int = 64, priority: dict[str, int] | None = None, excluded: tuple[str, ...] = (), endpoint: str = "ENDPOINT") -> DataFrame:
    """(q, id, depth, score, rank): the subgraph of each query around its seeds (q, id, score).

    A frontier goes on over at most `cap` edges of each node, type and way. A node has its own seed score, or the query's best
    one times DECAY for each hop. Excluded types stay only as seeds. Nodes beyond PRELIMIT times `most` go by type priority
    (small first, others last) before they are ranked; of equal score the better type, then depth, then id comes first. Of
    nodes of one name and file the one with most lines stays; of the endpoint type the first ENDPOINTS of the ranking.
    nodes: (id, node_type, name, file, size).
    """
    frontier = seen = cut(seeds.select("q", "id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        step = cut(_typed_steps(edges, cap, frontier))
        new = frontier.join(step, frontier["id"] == step["at"]).select("q", F.col("to").alias("id")).distinct()
        frontier = cut(new.join(seen, ["q", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    level = F.lit(99)
    for name, value in (priority or {}).items():
        level = F.when(F.col("node_type") == name, value).otherwise(level)
    met = seen.join(nodes, "id").filter((F.col("depth") == 0) | ~F.col("node_type").isin(*excluded)).withColumn("_level", level)
    own = seeds.groupBy("q", "id").agg(F.max("score").alias("_own"))
    best = seeds.groupBy("q").agg(F.max("score").alias("_best"))
    first = top_per(met, ["q"], [F.col("_level"), F.col("depth"), F.col("id")], most * PRELIMIT).drop("rank")
    scored = first.join(own, ["q", "id"], "left").join(best, "q")
    scored = scored.withColumn("score", F.round(F.coalesce("_own", F.col("_best") * F.pow(F.lit(DECAY), F.greatest("depth", F.lit(1)))), 6))
    rich = F.row_number().over(Window.partitionBy("q", "name", "file").orderBy(F.desc("size"), "id"))
    lone = scored.withColumn("_r", rich).filter("_r = 1 or name is null")
    order = [F.desc("score"), F.col("_level"), F.col("depth"), F.col("id")]
    few = running_cap(lone, ["q"], order, F.col("node_type") == endpoint, ENDPOINTS)
    return top_per(few, ["q"], order, most).select("q", "id", "depth", "score", "rank")


def pulled_through(edges: DataFrame, nodes: DataFrame, kept: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(q, id): what the rules (type of a kept node, edge type, type of its target) add to kept (q, id), without what is there."""
    row = F.array(*[F.struct(F.lit(a).alias("_from"), F.lit(b).alias("edge_type"), F.lit(c).alias("_to")) for a, b, c in rules])
    table = F.broadcast(kept.sparkSession.range(1).select(F.inline(row)))
    kind = nodes.select("id", "node_type")
    # a rule's edge types part a kept node's edges before they meet it: a node of very many other edges brings none of them
    source = kept.select("q", "id").join(kind, "id").select("q", F.col("id").alias("src"), F.col("node_type").alias("_from")).join(table, "_from")
    used = edges.select("src", "dst", "edge_type").filter(F.col("edge_type").isin(*{rule[1] for rule in rules}))
    met = source.join(used, ["src", "edge_type"])
    target = met.join(kind.select(F.col("id").alias("dst"), F.col("node_type").alias("_to")), ["dst", "_to"])
    return target.select("q", F.col("dst").alias("id")).distinct().join(kept.select("q", "id"), ["q", "id"], "left_anti")


def kept_edges(edges: DataFrame, kept: DataFrame, capped: tuple[str, ...] = ("CONTAINS", "USES_CONFIG")) -> DataFrame:
    """(q, src, dst, edge_type) among the kept nodes of each query; of a capped type the first FAN_OUT of a node by its target.

    Only edges between nodes that some query keeps are looked at, and a query finds each by the end that has fewer of them, so
    that a node of very many edges doesn't bring all of them to each query that keeps it.
    """
    ids = kept.select("q", "id")
    some = ids.select("id").distinct()
    held = edges.select("src", "dst", "edge_type").join(some.toDF("src"), "src", "left_semi").join(some.toDF("dst"), "dst", "left_semi")
    held = cut(held.distinct())
    degree = held.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("_n"))
    held = held.join(degree.toDF("src", "_out"), "src").join(degree.toDF("dst", "_in"), "dst")
    ends = held.select("src", "dst", "edge_type", F.when(F.col("_out") <= F.col("_in"), F.col("src")).otherwise(F.col("dst")).alias("id"))
    far = F.when(F.col("id") == F.col("src"), F.col("dst")).otherwise(F.col("src"))
    met = ends.join(ids, "id").withColumn("_far", far).join(ids.withColumnRenamed("id", "_far"), ["q", "_far"])
    place = F.row_number().over(Window.partitionBy("q", "src", "edge_type").orderBy("dst"))
    return met.withColumn("_r", place).filter(~F.col("edge_type").isin(*capped) | (F.col("_r") <= FAN_OUT)).select("q", "src", "dst", "edge_type")


def verbatim(text: Column, name: Column) -> Column:
    """Whether the text holds the name as it is, between characters that are part of no identifier; short names never are."""
    plain = F.regexp_replace(text, r"[^A-Za-z0-9_$]+", " ")
    words = F.concat(F.lit(" "), plain, F.lit(" "))
    wanted = F.concat(F.lit(" "), F.regexp_replace(name, r"[^A-Za-z0-9_$]+", " "), F.lit(" "))
    return F.coalesce((F.length(name) >= VERBATIM) & text.contains(name) & words.contains(wanted), F.lit(False))


def final_scores(kept: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, id, score, origin): 1 for a node whose name the query holds verbatim, else its own; origin `verbatim`, `seed` or `expanded`."""
    met = kept.join(nodes.select("id", "name"), "id").join(queries.select("q", "text"), "q")
    said = verbatim(F.col("text"), F.col("name"))
    origin = F.when(said, "verbatim").when(F.col("depth") == 0, "seed").otherwise("expanded")
    return met.select("q", "id", F.when(said, 1.0).otherwise(F.col("score")).alias("score"), origin.alias("origin"))


def serialised(kept: DataFrame, edges: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """(q, text): a line for each kept node (q, id, score), best first, with its edges indented below it, as many nodes as the budget of
    characters bears; the first node always is there."""
    name = nodes.select("id", F.concat_ws(" ", "node_type", "name").alias("label"))
    to = name.toDF("dst", "_to")
    out = edges.join(to, "dst").groupBy("q", "src").agg(F.array_sort(F.collect_list(F.concat(F.lit("  "), "edge_type", F.lit(" "), "_to"))).alias("_lines"))
    block = kept.join(name, "id").join(out.withColumnRenamed("src", "id"), ["q", "id"], "left")
    block = block.withColumn("_text", F.array_join(F.concat(F.array("label"), F.coalesce("_lines", F.array().cast("array<string>"))), "\n"))
    block = block.withColumn("_cost", F.length("_text") + 1)
    order = [F.desc("score"), F.col("id")]
    fits = budget_prefix(block, ["q"], order, "_cost", budget)
    lines = F.array_sort(F.collect_list(F.struct("rn", "_text")))
    return fits.groupBy("q").agg(F.array_join(F.transform(lines, lambda x: x["_text"]), "\n").alias("text"))
