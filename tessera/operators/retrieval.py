"""Retrieval: chunks, exact matching, channels, seeds. Queries are small tables (q, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rank import top_per
from tessera.operators.resolve import contained_name
from tessera.operators.traverse import walk
from tessera.plans.cuts import cut


def chunks(docs: DataFrame, key: str, text: str, size: int = 60, overlap: int = 15, most: int | None = None) -> DataFrame:
    """(key, chunk, start_line, end_line, text): windows of size lines that overlap; the last one ends with the text.

    most: windows of a text at most, the first ones; None for all of them.
    """
    step, n = size - overlap, F.size("_l")
    rows = docs.select(key, F.split(text, "\n").alias("_l")).filter(F.col("_l").isNotNull())
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    last = F.least(F.lit(most - 1), last) if most else last
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk") * step + 1
    return rows.select(key, "chunk", start.alias("start_line"), F.least(start + size - 1, n).alias("end_line"), F.array_join(F.slice("_l", start, F.lit(size)), "\n").alias("text"))


#: How well a needle meets a node by name, file name and path, best first; types of manifests, which count only
#: from MANIFEST_LEAST on; members of a tier that stay where it has more than the limit.
TIERS = {"name": 1.0, "file": 0.98, "basename": 0.97, "path": 0.95, "name_starts": 0.75, "name_holds": 0.6, "path_holds": 0.5}
MANIFESTS, MANIFEST_LEAST, FLOOD = ("DEPENDENCY", "CONFIG_VALUE", "MANIFEST"), 0.95, 8


def exact(nodes: DataFrame, needles: DataFrame, limit: int = 16) -> DataFrame:
    """(q, id, score, hits, rank): the best of each node's matches of its query's needles (q, needle), by TIERS.

    nodes: (id, name), and where known node_type and path. A tier of more nodes than limit keeps FLOOD. Needles meet names and
    paths by their rarest runs of characters, so no node meets a needle that neither of them holds.

    A needle is matched once, however many queries have it, and no query takes all nodes of its most frequent needle: those
    that hold another of its needles too come by that one, and of the rest it takes numbers, and the first of each tier.
    """
    path = F.coalesce("path", F.lit("")) if "path" in nodes.columns else F.lit("")
    kind = F.col("node_type") if "node_type" in nodes.columns else F.lit("")
    rows = nodes.select("id", "name", kind.alias("node_type"), F.lower("name").alias("_low"), F.lower(path).alias("_path"))
    both = rows.withColumn("_text", F.concat_ws("\n", "_low", "_path"))
    low = needles.filter(~F.col("needle").contains("\n")).groupBy("q", F.lower("needle").alias("needle")).agg(F.count("*").alias("_times"))
    low = cut(low)
    met = contained_name(both, "_text", low.select("needle").distinct(), "needle")
    base, need = F.regexp_extract("_path", r"([^/]*)$", 1), F.col("needle")
    rules = [
        ("name", F.col("_low") == need),
        ("file", (F.col("node_type") == "FILE") & (base == need)),
        ("basename", base == need),
        ("path", F.col("_path") == need),
        ("name_starts", F.col("_low").startswith(need)),
        ("name_holds", F.contains("_low", need)),
        ("path_holds", F.contains("_path", need)),
    ]
    score = F.coalesce(*[F.when(rule, TIERS[name]) for name, rule in rules])
    met = met.withColumn("score", score).filter("score > 0").filter(~F.col("node_type").isin(*MANIFESTS) | (F.col("score") >= MANIFEST_LEAST))
    one = cut(met.groupBy("needle", "id").agg(F.max("score").alias("score"), F.count("*").alias("hits"), F.first("name").alias("name")))
    tiers = cut(one.groupBy("needle", "score").agg(F.count("*").alias("_n")))
    asked = cut(low.join(tiers.groupBy("needle").agg(F.sum("_n").alias("_all")), "needle"))
    big = cut(asked.groupBy("q").agg(F.max(F.struct("_all", "needle", "_times")).alias("_b")).select("q", "_b.needle", "_b._times"))
    small = asked.join(big, ["q", "needle"], "left_anti").join(one, "needle").groupBy("q", "id")
    small = small.agg(F.max("score").alias("score"), F.sum(F.col("hits") * F.col("_times")).alias("hits"), F.first("name").alias("name"))
    own = one.select("needle", "id", F.col("score").alias("_of_big"), F.col("hits").alias("_more"))
    small = small.join(big, "q").join(own, ["needle", "id"], "left")
    small = cut(small.select("q", "id", F.greatest("score", "_of_big").alias("score"), (F.col("hits") + F.coalesce(F.col("_more") * F.col("_times"), F.lit(0))).alias("hits"), "name", "needle", "_of_big"))
    # what a query's most frequent needle has in each tier, without what its other needles brought
    twice = small.filter("_of_big is not null").groupBy("q", F.col("_of_big").alias("score")).agg(F.count("*").alias("_twice"))
    alone = cut(big.join(tiers, "needle").join(twice, ["q", "score"], "left").withColumn("_twice", F.coalesce("_twice", F.lit(0))))
    size = alone.select("q", "score", (F.col("_n") - F.col("_twice")).alias("_n")).unionByName(small.groupBy("q", "score").agg(F.count("*").alias("_n")))
    size = size.groupBy("q", "score").agg(F.sum("_n").alias("_n"))
    # so many of a tier hold the first that a query takes, whichever of them it has already
    first = max(limit, FLOOD)
    deep = alone.groupBy("needle", "score").agg(F.max("_twice").alias("_deep"))
    order = [F.desc("hits"), F.col("id")]
    part = Window.partitionBy("needle", "score", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order)
    head = one.join(deep, ["needle", "score"]).withColumn("_p", F.row_number().over(part)).filter(F.col("_p") <= F.col("_deep") + first)
    head = head.withColumn("_k", F.row_number().over(Window.partitionBy("needle", "score").orderBy(*order))).filter(F.col("_k") <= F.col("_deep") + first)
    head = head.select("needle", "score", "_k", "id", "hits", "name")
    taken = alone.withColumn("_k", F.explode(F.sequence(F.lit(1), (F.col("_twice") + first).cast("int")))).join(head, ["needle", "score", "_k"])
    taken = taken.select("q", "id", "score", (F.col("hits") * F.col("_times")).alias("hits"), "name").join(small.filter("_of_big is not null").select("q", "id"), ["q", "id"], "left_anti")
    node = small.select("q", "id", "score", "hits", "name").unionByName(taken)
    # the first FLOOD of a tier are found in parts before they meet
    part = Window.partitionBy("q", "score", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy(*order)
    near = node.withColumn("_p", F.row_number().over(part)).filter(F.col("_p") <= first)
    near = near.withColumn("_r", F.rank().over(Window.partitionBy("q", "score").orderBy(*order))).join(size, ["q", "score"])
    near = near.filter((F.col("_n") <= limit) | (F.col("_r") <= FLOOD))
    return top_per(near.drop("_n", "_r", "_p"), ["q"], [F.desc("score"), F.desc("hits"), F.length("name"), F.col("id")], limit).drop("name")


def graph_channel(edges: DataFrame, seeds: DataFrame, edge_types: tuple[str, ...], first: int = 12, limit: int = 12) -> DataFrame:
    """(q, id, score, rank): one-hop neighbours of each query's best seeds (q, id, score), without the seeds."""
    seed = top_per(seeds, ["q"], [F.desc("score"), F.col("id")], first).select("q", "id")
    used = edges.filter(F.col("edge_type").isin(*edge_types))
    out = seed.join(used, seed["id"] == used["src"]).select("q", F.col("dst").alias("to"))
    back = seed.join(used, seed["id"] == used["dst"]).select("q", F.col("src").alias("to"))
    met = out.union(back).distinct().toDF("q", "id").join(seed, ["q", "id"], "left_anti")
    return top_per(met.withColumn("score", F.lit(0.42)), ["q"], [F.col("id")], limit)


#: Least fused score by intent, its shift by risk, and hops by intent.
FUSION_MIN = {"lookup": 0.28, "trace": 0.30, "impact": 0.32, "architecture": 0.30, "compare": 0.30, "default": 0.30}
RISK_DELTA = {"low": -0.02, "medium": 0.0, "high": 0.04}
HOPS = {"lookup": 1, "trace": 2, "impact": 2, "architecture": 2, "compare": 2, "default": 2}


def fusion_threshold(intent: str = "default", risk: str = "medium", k: int = 60) -> float:
    """Least fused score of a seed; an unknown intent or risk counts as the default one."""
    return (FUSION_MIN.get(intent, FUSION_MIN["default"]) + RISK_DELTA.get(risk, 0.0)) / k


def seeds(fused: DataFrame, candidates: DataFrame, threshold: float, top: int, dense_least: float = 0.0, least: float = 0.34) -> DataFrame:
    """(q, id, score, origin): the `top` best of each query with a fused score of threshold or more; a query that has none takes
    all its candidates (q, id, score) of max(threshold, dense_least, least) or more instead (`rescue`).
    """
    kept = top_per(fused.filter(F.col("fused") >= threshold), ["q"], [F.desc("fused"), F.col("id")], top)
    kept = kept.select("q", "id", F.col("fused").alias("score"), F.lit("fused").alias("origin"))
    rescued = candidates.filter(F.col("score") >= max(threshold, dense_least, least)).join(kept.select("q").distinct(), "q", "left_anti")
    return kept.unionByName(rescued.select("q", "id", "score", F.lit("rescue").alias("origin")))


def plan_seeds(fused: DataFrame, plan: str = "plan", anchor: str = "anchor", anchor_seeds: int = 4, item_seeds: int = 2) -> DataFrame:
    """(plan, id, fused) from the queries (q, anchor or not) of plans: the best seeds of each query, each id once with its best score."""
    place = F.row_number().over(Window.partitionBy(plan, "q").orderBy(F.desc("fused"), "id"))
    kept = fused.withColumn("_r", place).filter(F.col("_r") <= F.when(F.col(anchor), anchor_seeds).otherwise(item_seeds))
    return kept.groupBy(plan, "id").agg(F.max("fused").alias("fused"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.6) -> DataFrame:
    """(id, depth, score) within hops of seeds (id, score), both ways: a seed's own score, else the best seed's, decayed by depth."""
    best = seeds.agg(F.max("score").alias("_best"))
    near = walk(edges, seeds, hops, "both").join(seeds.groupBy("id").agg(F.max("score").alias("_own")), "id", "left").crossJoin(F.broadcast(best))
    return near.select("id", "depth", F.coalesce("_own", F.col("_best") * F.pow(F.lit(decay), F.greatest("depth", F.lit(1)))).alias("score"))


def identity_first(exact_ids: DataFrame, pool: DataFrame, most: int = 100) -> DataFrame:
    """(q, id, place): ids with just the asked name first, at most so many by id, then the pool (q, id, rank) without them."""
    own = exact_ids.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy("id")).alias("rank")).filter(F.col("rank") <= most)
    rest = pool.join(own.select("q", "id"), ["q", "id"], "left_anti").select("q", "id", "rank", F.lit(1).alias("_tier"))
    both = own.withColumn("_tier", F.lit(0)).unionByName(rest)
    return both.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy("_tier", "rank", "id")).alias("place"))


def resolve_symbol(nodes: DataFrame, asked: list[str]) -> DataFrame:
    """(q, id, tier) for each asked symbol: nodes of just that name (0), else of that last part (1), else that hold it (2).

    The asked symbols are the caller's list, so their side is as small as the call.
    """
    asks = nodes.sparkSession.createDataFrame([(q,) for q in asked], "q string")
    name = F.lower(F.col("name"))
    want = F.lower(F.col("q"))
    last = F.element_at(F.split(name, r"[\s./#:]+"), -1)
    tier = F.when(name == want, 0).when(last == want, 1).otherwise(2)
    hit = nodes.join(F.broadcast(asks), F.contains(name, want)).select("q", "id", tier.alias("tier"))
    least = hit.groupBy("q").agg(F.min("tier").alias("tier"))
    return hit.join(F.broadcast(least), ["q", "tier"]).select("q", "id", "tier")


def focus(nodes: DataFrame, asked: list[str], size: Column, top: int = 3) -> DataFrame:
    """(id, name, score, place): nodes whose name holds words of the question; 100 more for a name that is a word; trivial ones (size <= 2) last."""
    name = F.lower(F.col("name"))
    score = F.lit(0)
    for word in asked:
        score = score + F.when(F.contains(name, F.lit(word.lower())), 1).otherwise(0) + F.when(name == word.lower(), 100).otherwise(0)
    scored = nodes.select("id", "name", score.alias("score"), (size <= 2).alias("_small")).filter("score > 0").orderBy("_small", F.desc("score"), "id").limit(top)
    return scored.select("id", "name", "score", F.row_number().over(Window.orderBy("_small", F.desc("score"), "id")).alias("place"))
