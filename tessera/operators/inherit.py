"""Links that follow chains of declarations: re-exports, bases, overrides, owners, partial declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.resolve import opened, packs
from tessera.plans.cuts import cut


def chase(forwards: DataFrame, hops: int = 8) -> DataFrame:
    """(src, target, hops): where a chain of forwards (src, dst) ends, within hops. Cycles and longer chains have no row.

    A src with several dst is refused: its chain has no single end.
    """
    one = cut(forwards.groupBy("src").agg(F.count_distinct("dst").alias("_n"), F.min("dst").alias("dst")).filter("_n = 1").select("src", "dst"))
    split = forwards.select(F.col("src").alias("at")).distinct()
    step = one.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    live, ended = one.select("src", F.col("dst").alias("at")), None
    for k in range(1, hops + 1):
        done = live.join(split, "at", "left_anti").select("src", F.col("at").alias("target"), F.lit(k).alias("hops"))
        ended = done if ended is None else ended.unionAll(done)
        if k < hops:
            live = cut(live.join(step, "at").select("src", F.col("to").alias("at")))
    return ended


def inherited(bases: DataFrame, members: DataFrame, hops: int = 5) -> DataFrame:
    """(id, name, owner, depth): members (id, name) that an id has of itself (depth 0) or from bases (src, dst) at most hops up.

    The nearest owner of a name wins, ties to the smaller owner.
    """
    found = members.select("id", "name", F.col("id").alias("owner"), F.lit(0).alias("depth"))
    up = seen = cut(bases.select(F.col("src").alias("id"), F.col("dst").alias("at")).distinct().withColumn("depth", F.lit(1)))
    for k in range(2, hops + 1):
        nxt = up.select("id", F.col("at").alias("src")).join(bases, "src").select("id", F.col("dst").alias("at")).distinct()
        up = cut(nxt.join(seen, ["id", "at"], "left_anti").withColumn("depth", F.lit(k)))
        seen = cut(seen.unionAll(up))
    far = seen.join(members.select(F.col("id").alias("at"), "name"), "at").select("id", "name", F.col("at").alias("owner"), "depth")
    best = F.min(F.struct("depth", "owner")).alias("_b")
    return found.unionAll(far).groupBy("id", "name").agg(best).select("id", "name", "_b.owner", "_b.depth")


def _named(methods: DataFrame) -> DataFrame:
    return methods.select("owner", F.lower("name").alias("_name"), "id").filter("owner is not null and _name is not null and id is not null").distinct()


def overrides(bases: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst): methods (owner, name, id) of a type with the name, in any case, of a method of a direct base (src, dst).

    Methods of one owner and name are packs of ids that meet as wholes, so one name that very many have is dealt to all tasks.
    """
    m = cut(_named(methods))
    held = packs(m, ["owner", "_name"], "id")
    low = held.withColumnsRenamed({"owner": "src", "_ids": "_low"}).join(bases.select("src", "dst").distinct(), "src")
    met = low.join(held.withColumnsRenamed({"owner": "dst", "_ids": "_high"}), ["dst", "_name"]).select("_low", "_high")
    pairs = opened(met, "_low", "_high", "src", "dst").filter("src <> dst")
    # an id of one owner and name meets another once
    several = m.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).count()
    return pairs.distinct() if several else pairs


def override_walk(bases: DataFrame, methods: DataFrame, seeds: DataFrame, hops: int = 8) -> DataFrame:
    """(id, depth): least depth of every method within hops of the seeds (id) along overrides(bases, methods), either way.

    All methods of an owner and name have the same neighbours, so owners and names are walked, each left once and reached
    once, and their pairs of methods are never formed.
    """
    m = cut(_named(methods))
    pair = bases.select("src", "dst").distinct()
    ways = pair.select(F.col("src").alias("owner"), F.col("dst").alias("to")).union(pair.select("dst", "src")).distinct()
    classes = m.select("owner", "_name").distinct()
    step = cut(classes.join(ways, "owner").join(classes.withColumnRenamed("owner", "to"), ["to", "_name"]).select("owner", "_name", "to"))
    seen = frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    left = reached = cut(classes.limit(0))
    for depth in range(1, hops + 1):
        going = cut(m.join(frontier.select("id"), "id", "left_semi").select("owner", "_name").distinct().join(left, ["owner", "_name"], "left_anti"))
        left = left.unionAll(going)
        there = cut(going.join(step, ["owner", "_name"]).select(F.col("to").alias("owner"), "_name").distinct().join(reached, ["owner", "_name"], "left_anti"))
        reached = reached.unionAll(there)
        new = m.join(there, ["owner", "_name"], "left_semi").select("id").distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        seen = seen.unionAll(frontier)
    return seen


def owners(methods: DataFrame, types: DataFrame) -> DataFrame:
    """(method, type) of methods (method, name, folder) and types (type, name, folder): the only type of the name, else the only one in the folder.

    Types become one row a name, and one a name and folder, before methods meet them.
    """

    def rung(k: int, keys: list[str]) -> DataFrame:
        ends = types.groupBy(*keys).agg(F.min("type").alias("_lo"), F.max("type").alias("_hi"))
        met = methods.join(ends, keys).groupBy("method").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        return met.filter("_lo = _hi").select("method", F.lit(k).alias("rung"), F.col("_lo").alias("type"))

    return rung(0, ["name"]).unionAll(rung(1, ["name", "folder"])).groupBy("method").agg(F.min_by("type", "rung").alias("type"))


def partials(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """(part, first) of all but the first of the parts that share keys."""
    first = parts.withColumn("first", F.min(part).over(Window.partitionBy(*keys)))
    return first.filter(F.col(part) != F.col("first")).select(part, "first")


def coverage_assertion(nodes: DataFrame, edges: DataFrame, kind: str, edge_type: str) -> DataFrame:
    """One row (nodes, edges, verdict): error where nodes of the kind exist, but no edge of the type."""
    n, e = nodes.filter(F.col("node_type") == kind).agg(F.count("*").alias("nodes")), edges.filter(F.col("edge_type") == edge_type).agg(F.count("*").alias("edges"))
    return n.crossJoin(F.broadcast(e)).withColumn("verdict", F.when((F.col("nodes") > 0) & (F.col("edges") == 0), "error").otherwise("ok"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Snapshot of old with new rows merged by key: new values win; columns of keep fall back to the old value where the new is null.

    Parquet has no merge, so this is a full outer join whose result is written as the next snapshot.
    """
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_o"))
    b = new.select(*keys, F.struct(*values).alias("_n"))
    pick = lambda c: F.when(F.col("_n").isNull(), F.col(f"_o.{c}")).otherwise(F.coalesce(f"_n.{c}", f"_o.{c}") if c in keep else F.col(f"_n.{c}")).alias(c)
    return a.join(b, keys, "full").select(*keys, *[pick(c) for c in values])
