"""A graph kept over generations: changed files are written anew, the rest is carried on, loose calls wait for their name.

State is three tables: `nodes` (key, name, file, kind, body, evidence, origin, status), `edges` (src, dst, edge_type, called:
dst is null where a call has lost its target, and called is then the name that it waits for), `members` (generation, key).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.cuts import cut

#: Kinds that stay although a file is written again without them, and the live nodes of a file that an
#: empty extraction may not take away.
LASTING, GUARDED = ("FILE", "DEPENDENCY", "DOC"), 3
_NODE = ["key", "name", "file", "kind", "body", "evidence", "origin"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    degraded: DataFrame


def _deduplicated(new: DataFrame) -> DataFrame:
    """One row a key: an extracted one before others, then by body; the first evidence of any row stays."""
    order = F.struct((F.col("origin") != "EXTRACTED").alias("o"), "body", "name", "file", "kind", "origin")
    rows = new.groupBy("key").agg(F.min(order).alias("r"), F.min_by("evidence", F.when(F.col("evidence").isNotNull(), order)).alias("evidence"))
    return rows.select("key", "r.name", "r.file", "r.kind", "r.body", "evidence", "r.origin")


def start(spark) -> Graph:
    """A graph without nodes."""
    nodes = spark.createDataFrame([], "key long, name string, file string, kind string, body string, evidence string, origin string, status string")
    edges = spark.createDataFrame([], "src long, dst long, edge_type string, called string")
    return Graph(nodes, edges, spark.createDataFrame([], "generation int, key long"), spark.createDataFrame([], "file string"))


def written(graph: Graph, generation: int, changed: DataFrame, new: DataFrame, links: DataFrame, deleted: DataFrame) -> Graph:
    """The next generation. changed: (file), read again and found to hold new (the columns of nodes but status), whose nodes have
    links (src, dst, edge_type); deleted: (file), gone.

    A changed file without any new node keeps its old ones if it has GUARDED or more live ones: it is `degraded`. A new node
    replaces the one of its key, whose evidence it keeps if it brings none and the body is the same. Live nodes of a changed
    file that are not written again, and all of a deleted one, are archived, but for LASTING kinds of a changed file. Links
    of written files are replaced. A call from elsewhere to an archived node waits for its name, other links to it go; a
    waiting call is attached when one node alone of that name is written in a later generation.
    """
    live = graph.nodes.filter("status = 'APPROVED'")
    new = cut(_deduplicated(new))
    emptied = changed.join(new.select("file").distinct(), "file", "left_anti")
    degraded = cut(emptied.join(live.groupBy("file").agg(F.count("*").alias("n")), "file").filter(F.col("n") >= GUARDED).select("file"))
    read = changed.join(degraded, "file", "left_anti").distinct()
    gone = deleted.select("file", F.lit(True).alias("_gone")).unionByName(read.select("file", F.lit(False).alias("_gone"))).groupBy("file").agg(F.max("_gone").alias("_gone"))

    old = graph.nodes.select("key", F.struct(*graph.nodes.columns).alias("o"))
    both = old.join(new.select("key", F.struct(*_NODE).alias("n")), "key", "full").join(gone, F.col("o.file") == F.col("file"), "left")
    fresh = F.col("n").isNotNull()
    kept_evidence = F.when(F.col("n.body").eqNullSafe(F.col("o.body")), F.coalesce("n.evidence", "o.evidence")).otherwise(F.col("n.evidence"))
    lost = F.col("_gone").isNotNull() & (F.col("_gone") | ~F.col("o.kind").isin(*LASTING))
    status = F.when(fresh, "APPROVED").when(lost, "ARCHIVED").otherwise(F.col("o.status"))
    value = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    columns = [value(c).alias(c) if c != "evidence" else F.when(fresh, kept_evidence).otherwise(F.col("o.evidence")).alias(c) for c in _NODE]
    # what was live before is told from what comes back
    nodes = cut(both.select(*columns, status.alias("status"), (fresh & ~F.coalesce(F.col("o.status") == "APPROVED", F.lit(False))).alias("_back")))
    alive = nodes.filter("status = 'APPROVED'")

    source = graph.nodes.select(F.col("key").alias("src"), F.col("file").alias("_file"))
    elsewhere = graph.edges.join(source, "src", "left").join(gone.select(F.col("file").alias("_file")), "_file", "left_anti").drop("_file")
    held = elsewhere.unionByName(links.select("src", "dst", "edge_type", F.lit(None).cast("string").alias("called")))
    there = alive.select(F.col("key").alias("dst"), F.lit(True).alias("_there"))
    names = nodes.select(F.col("key").alias("dst"), F.col("name").alias("_name"))
    met = held.join(alive.select(F.col("key").alias("src")), "src", "left_semi").join(there, "dst", "left").join(names, "dst", "left")
    broken = F.col("dst").isNotNull() & F.col("_there").isNull()
    met = met.filter(~broken | (F.col("edge_type") == "CALLS"))
    loose = met.select("src", F.when(~broken, F.col("dst")).alias("dst"), "edge_type", F.when(broken, F.col("_name")).otherwise(F.col("called")).alias("called"))
    # a name that came back, held by one live node
    lone = alive.groupBy(F.col("name").alias("called")).agg(F.count("*").alias("_n"), F.min("key").alias("_to"), F.max("_back").alias("_new")).filter("_n = 1 and _new")
    tied = loose.join(lone.select("called", "_to"), "called", "left")
    waits = F.col("dst").isNull() & F.col("_to").isNotNull()
    edges = cut(tied.select("src", F.when(waits, F.col("_to")).otherwise(F.col("dst")).alias("dst"), "edge_type", F.when(waits, None).otherwise(F.col("called")).alias("called")).distinct())
    members = cut(graph.members.unionByName(alive.select(F.lit(generation).alias("generation"), "key")))
    return Graph(nodes.drop("_back"), edges, members, degraded)
