"""The tools over one graph: arguments are checked against a stated table, results are DataFrames.

    Engine(spark, nodes, edges).call("blast_radius", symbols=["a.b"], depth=2)

nodes: id, node_type, name, and where known file and size; edges: src, dst, edge_type; touches: commit, ts, item;
facts: as memory.recall takes them, with body.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import allowed, terms
from tessera.operators import analytics, coupling, inherit, lexical, memory, rank, retrieval, traverse

REQUIRED = object()


@dataclass(frozen=True)
class Arg:
    kind: type
    default: Any = REQUIRED
    low: int | None = None
    high: int | None = None
    one_of: tuple[str, ...] = ()


TASKS = ("bugfix", "feature", "refactor", "config", "unknown")
#: Hops of a blast radius by kind of task.
TASK_DEPTH = {"bugfix": 1, "feature": 2, "refactor": 3, "config": 2, "unknown": 2}
DIRECTIONS = ("both", "in", "out")
#: Arguments of each tool with default and bounds.
TOOLS: dict[str, dict[str, Arg]] = {
    "explore": {"query": Arg(str)},
    "search_code": {"query": Arg(str), "limit": Arg(int, 30, 1, 100)},
    "neighbours": {"symbol": Arg(str), "direction": Arg(str, "both", one_of=DIRECTIONS), "edge_types": Arg(list, None), "include_heuristic": Arg(bool, False), "include_cochange": Arg(bool, False), "include_defined_in": Arg(bool, False), "depth": Arg(int, 1, 1, 6), "limit": Arg(int, 60, 1, 200)},
    "changes_with": {"symbol": Arg(str), "limit": Arg(int, 25, 1, 100)},
    "blast_radius": {"symbols": Arg(list), "depth": Arg(int, None, 1, 4), "task_type": Arg(str, "unknown", one_of=TASKS), "limit": Arg(int, 25, 1, 200)},
    "recall": {"file": Arg(str, None), "limit": Arg(int, 5, 1, 20)},
    "remember": {"facts": Arg(DataFrame)},
    "file_symbols": {"path": Arg(str), "node_types": Arg(list, None), "limit": Arg(int, 100, 1, 500)},
    "overview": {"limit": Arg(int, 10, 1, 50)},
}


def validate(tool: str, given: dict[str, Any]) -> dict[str, Any]:
    """The tool's arguments with defaults; ValueError names an unknown tool or argument, a missing one, a wrong type, or a value out of bounds."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool!r}; known: {', '.join(TOOLS)}")
    spec = TOOLS[tool]
    if unknown := sorted(set(given) - set(spec)):
        raise ValueError(f"{tool}: unknown argument {unknown[0]!r}; known: {', '.join(spec)}")
    out = {}
    for name, arg in spec.items():
        value = given.get(name)
        if value is None:
            if arg.default is REQUIRED:
                raise ValueError(f"{tool}: {name} is required")
            out[name] = arg.default
            continue
        if not isinstance(value, arg.kind) or (arg.kind is int and isinstance(value, bool)):
            raise ValueError(f"{tool}: {name} must be {arg.kind.__name__}, not {type(value).__name__}")
        if arg.low is not None and not arg.low <= value <= arg.high:
            raise ValueError(f"{tool}: {name} must be {arg.low} to {arg.high}, not {value}")
        if arg.one_of and value not in arg.one_of:
            raise ValueError(f"{tool}: {name} must be one of {', '.join(arg.one_of)}, not {value!r}")
        out[name] = value
    return out


@dataclass
class Engine:
    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    touches: DataFrame | None = None
    facts: DataFrame | None = None
    source_types: tuple[str, ...] = field(default=("METHOD", "CLASS", "FILE"))

    def call(self, tool: str, **given: Any) -> DataFrame:
        return getattr(self, f"_{tool}")(**validate(tool, given))

    def _ids(self, symbols: list[str]) -> DataFrame:
        return retrieval.resolve_symbol(self.nodes, symbols).select("id").distinct()

    def _need(self, part: str) -> DataFrame:
        if getattr(self, part) is None:
            raise ValueError(f"this engine was given no {part}")
        return getattr(self, part)

    def _explore(self, query: str) -> DataFrame:
        """The three best names of the question with those that call them and that they call."""
        words = self.spark.range(1).select(F.array_distinct(terms(F.lit(query))).alias("w")).first()["w"]
        size = F.col("size") if "size" in self.nodes.columns else F.lit(3)
        found = retrieval.focus(self.nodes, words, size)
        return traverse.neighbours(self.edges, self.nodes, found.select("id"), "both", 6)

    @cached_property
    def _names(self) -> lexical.TextIndex:
        """The index of the nodes' names, written at the first search and read by all that follow."""
        return lexical.build_index(self.nodes.select("id", F.coalesce("name", F.lit("")).alias("text")))

    def _search_code(self, query: str, limit: int) -> DataFrame:
        """Exact and lexical channels over names, fused."""
        ask = self.spark.createDataFrame([(0, query)], "q int, text string")
        words = ask.select("q", F.explode(F.array_append(F.array_distinct(terms(F.col("text"))), F.col("text"))).alias("needle")).distinct()
        channels = {"exact": (retrieval.exact(self.nodes, words), 1.0), "lexical": (lexical.search(self._names, ask), 1.0)}
        return rank.fuse(channels).join(self.nodes.select("id", "node_type", "name"), "id").orderBy(F.desc("fused"), "id").limit(limit)

    def _neighbours(self, symbol: str, direction: str, edge_types: list | None, include_heuristic: bool, include_cochange: bool, include_defined_in: bool, depth: int, limit: int) -> DataFrame:
        deny = [t for t, wanted in (("HEURISTIC_CALLS", include_heuristic), ("CO_CHANGES", include_cochange), ("DEFINED_IN", include_defined_in)) if not wanted]
        edges = allowed(self.edges, "edge_type", tuple(edge_types) if edge_types else None, tuple(deny) or None)
        near = traverse.walk(edges, self._ids([symbol]), depth, direction).filter("depth > 0")
        return near.join(self.nodes.select("id", "node_type", "name"), "id").orderBy("depth", "id").limit(limit)

    def _changes_with(self, symbol: str, limit: int) -> DataFrame:
        pairs = coupling.co_changes(self._need("touches")).join(self._ids([symbol]).withColumnRenamed("id", "src"), "src", "left_semi")
        best = pairs.groupBy("dst").agg(F.max("confidence").alias("confidence"), F.max("n").alias("n"))
        return best.orderBy(F.desc("confidence"), F.desc("n"), "dst").limit(limit)

    def _blast_radius(self, symbols: list, depth: int | None, task_type: str, limit: int) -> DataFrame:
        seeds = traverse.override_closure(self.edges, self._ids(symbols)).select("id")
        return traverse.blast_radius(self.edges.filter("edge_type <> 'OVERRIDES'"), self.nodes, seeds, depth or TASK_DEPTH[task_type], limit, self.source_types)

    def _recall(self, file: str | None, limit: int) -> DataFrame:
        facts = self._need("facts")
        return memory.recall(facts if file is None else facts.filter(F.col("file") == file)).orderBy("place", "file").limit(limit)

    def _remember(self, facts: DataFrame) -> DataFrame:
        """The next snapshot of the facts, to be written by the caller; this engine answers from it."""
        self.facts = inherit.upsert(self._need("facts"), facts, ["id"])
        return self.facts

    def _file_symbols(self, path: str, node_types: list | None, limit: int) -> DataFrame:
        return allowed(self.nodes.filter(F.col("file") == path), "node_type", tuple(node_types) if node_types else None).orderBy("id").limit(limit)

    def _overview(self, limit: int) -> DataFrame:
        """(kind, name, n): counts of nodes and edges by type, and the nodes on which most weight rests."""
        gods = analytics.god_nodes(self.edges, self.nodes).orderBy(F.desc("score"), "id").limit(limit)
        return analytics.graph_stats(self.edges, self.nodes).unionByName(gods.select(F.lit("god").alias("kind"), "name", F.col("score").alias("n")))
