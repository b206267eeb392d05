"""Graphs, reports and projections as lines of text: rows (ord, line) that a sink writes in order.

Lines are built by column expressions over nodes (id, node_type, name) and edges (src, dst, edge_type). `ord` is
(section, id, id, type), so a range sort gives the file; nothing is gathered on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _escaped(c: Column, *marks: str) -> Column:
    """Text for a quoted string of DOT or Cypher: a backslash before backslashes and the given marks, line feeds as \\n."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in marks:
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def _entity(c: Column) -> Column:
    """Text for Mermaid, whose labels know no escapes but character codes: all but letters, digits and a few marks as #code;."""
    coded = lambda x: F.when(x.rlike(r"^[\w .,:/@-]?$"), x).otherwise(F.concat(F.lit("#"), F.ascii(x), F.lit(";")))
    return F.array_join(F.transform(F.split(c, ""), coded), "")


def _line(form: str, **columns: Column) -> Column:
    """A line of fixed text with columns in the places <name>."""
    parts = re.split(r"<(\w+)>", form)
    return F.concat(*[columns[x] if k % 2 else F.lit(x) for k, x in enumerate(parts) if x])


def _data(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'<data key="{key}">'), _xml(value), F.lit("</data>"))


_GRAPHML = "http://graphml.graphdrawing.org/xmlns"


def _formats() -> dict[str, tuple[list[str], Column, Column, list[str]]]:
    """Of each format: head lines, a node's line, an edge's line, tail lines, as the format's public grammar has them."""
    name, kind, edge = F.coalesce(F.col("name"), F.lit("")), F.col("node_type"), F.col("edge_type")
    key, src, dst = (F.col(c).cast("string") for c in ("id", "src", "dst"))
    # a label or relationship type of Cypher may be any text between back-quotes
    ticked = lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    keys = [("label", "node"), ("kind", "node"), ("relation", "edge")]
    return {
        "mermaid": (
            ["graph TD"],
            _line('  v<id>(["<kind>: <name>"])', id=key, name=_entity(name), kind=_entity(kind)),
            _line('  v<src> -- "<edge>" --> v<dst>', src=src, dst=dst, edge=_entity(edge)),
            [],
        ),
        "dot": (
            ["digraph {"],
            _line('  <id> [label="<name>", class="<kind>"]', id=key, name=_escaped(name, '"'), kind=_escaped(kind, '"')),
            _line('  <src> -> <dst> [class="<edge>"]', src=src, dst=dst, edge=_escaped(edge, '"')),
            ["}"],
        ),
        "cypher": (
            [],
            _line("MERGE (v:<kind> {id: <id>}) SET v.name = '<name>';", id=key, name=_escaped(name, "'"), kind=ticked(kind)),
            _line("MATCH (a {id: <src>}), (b {id: <dst>}) MERGE (a)-[:<edge>]->(b);", src=src, dst=dst, edge=ticked(edge)),
            [],
        ),
        "json": (
            [],
            F.to_json(F.struct("id", F.col("node_type").alias("kind"), F.col("name").alias("label"))),
            F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("relation"))),
            [],
        ),
        "graphml": (
            [f'<graphml xmlns="{_GRAPHML}">', *[f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="string"/>' for k, of in keys], '<graph edgedefault="directed">'],
            F.concat(F.lit('<node id="v'), key, F.lit('">'), _data("label", name), _data("kind", kind), F.lit("</node>")),
            F.concat(F.lit('<edge source="v'), src, F.lit('" target="v'), dst, F.lit('">'), _data("relation", edge), F.lit("</edge>")),
            ["</graph>", "</graphml>"],
        ),
    }


def lines(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """(section, a, b, kind, line): sorted by the first four columns, the lines are the file. JSON is one object a line."""
    known = _formats()
    if form not in known:
        raise ValueError(f"unknown export format {form!r}; known: {', '.join(sorted(known))}")
    head, node, edge, tail = known[form]
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, k, 0, "", x) for k, x in enumerate(head)] + [(3, k, 0, "", x) for k, x in enumerate(tail)], "section int, a long, b long, kind string, line string")
    body = nodes.select(F.lit(1).alias("section"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("kind"), node.alias("line"))
    links = edges.select(F.lit(2).alias("section"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_type").alias("kind"), edge.alias("line"))
    return fixed.unionByName(body).unionByName(links)


def write_lines(rows: DataFrame, path: str) -> None:
    """The lines as text files whose names sort in the lines' order."""
    rows.orderBy("section", "a", "b", "kind").select("line").write.mode("overwrite").text(path)


def projection(facts: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """(file, body, digest): a Markdown list of each file's facts in order, and its SHA-256."""
    items = F.array_sort(F.collect_list(F.struct(order, text)))
    body = F.concat(F.lit("# "), F.col(file).cast("string"), F.lit("\n\n"), F.array_join(F.transform("_i", lambda x: F.concat(F.lit("- "), F.replace(x[text], F.lit("\n"), F.lit(" ")))), "\n"), F.lit("\n"))
    return facts.groupBy(file).agg(items.alias("_i")).select(file, body.alias("body")).withColumn("digest", F.sha2("body", 256))


def to_write(now: DataFrame, before: DataFrame, file: str) -> DataFrame:
    """Projected files whose digest isn't the one written before: a second run writes nothing."""
    return now.join(before.select(file, F.col("digest").alias("_d")), file, "left").filter(~F.col("digest").eqNullSafe(F.col("_d"))).drop("_d")
