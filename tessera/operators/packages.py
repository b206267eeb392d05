"""Evidence from outside a graph's text: which declarations tests reach, and which declared package an import comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.resolve import nearest

#: Fixed value: lines between a covered function and the declaration that it is.
LINE_WINDOW = 2


def coverage_marks(methods: DataFrame, functions: DataFrame, root: str, within: int = LINE_WINDOW) -> DataFrame:
    """(id, hits): the methods (id, file, start_line) that covered functions (file, line, hits) mark, with the most hits of any.

    A function marks the method of its file that begins nearest to it, at most `within` lines away, of two the one of smaller id.
    Files under root are named by their path below it.
    """
    below = root.rstrip("/") + "/"
    file = F.when(F.col("file").startswith(below), F.substring("file", len(below) + 1, 1 << 20)).otherwise(F.col("file"))
    run = functions.filter("hits > 0").groupBy(file.alias("file"), "line").agg(F.max("hits").alias("hits"))
    met = nearest(run, methods.filter("start_line is not null").select("id", "file", "start_line"), "file", "line", "start_line", within, "id")
    return met.groupBy("id").agg(F.max("hits").alias("hits"))


def _python_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def _lone(keys: DataFrame) -> DataFrame:
    """(key, declared) of keys that one package has."""
    return keys.filter("key <> ''").groupBy("key").agg(F.count_distinct("declared").alias("_n"), F.min("declared").alias("declared")).filter("_n = 1").drop("_n")


def declared_dependencies(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """(imported, declared): the package of declared (id, name, ecosystem) that provides each import of imported (id, name), if one does.

    Whole names decide first: an import's package name as npm has it, its first dotted part as Python has it, the whole of it.
    Else the longest beginning of it, up to a dot or a slash, that is a Maven group, a Go module or a crate, gem or assembly.
    """
    own = declared.select(F.col("id").alias("declared"), "name", F.lower("name").alias("low"), "ecosystem")
    kind = F.col("ecosystem")
    whole = own.filter(kind.isin("npm", "packagist", "cargo", "rubygems", "nuget")).select("low", "declared").unionAll(own.filter(kind == "pypi").select(_python_key(F.col("name")), "declared"))
    group = F.when(kind == "maven", F.split("low", ":")[0]).when(kind.isin("go", "cargo", "rubygems", "nuget"), F.col("low"))
    sep = F.when(kind == "go", "/").otherwise(".")
    starts = own.select(group.alias("start"), sep.alias("sep"), "declared").filter("start is not null")
    exact, prefix = _lone(whole.toDF("key", "declared")), _lone(starts.select(F.concat("start", "sep").alias("key"), "declared"))
    low = F.lower("name")
    npm = F.regexp_extract(low, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    given = imported.filter("name <> ''").select(F.col("id").alias("imported"), "name")
    tries = given.select("imported", F.posexplode(F.array(npm, _python_key(F.split("name", r"\.")[0]), low)).alias("rank", "key"))
    first = tries.join(exact, "key").groupBy("imported").agg(F.min_by("declared", "rank").alias("declared"))
    rest = given.join(first.select("imported"), "imported", "left_anti")
    # the beginnings of a name, each with what parts it from the next; the whole name counts as a beginning of itself
    cuts = F.expr("filter(sequence(1, length(n)), k -> substr(n, k, 1) in ('.', '/'))")
    some = rest.select("imported", low.alias("n")).select("imported", F.explode(F.concat(F.transform(cuts, lambda k: F.substring("n", F.lit(1), k)), F.array(F.concat("n", F.lit(".")), F.concat("n", F.lit("/"))))).alias("key"))
    last = some.distinct().join(prefix, "key").groupBy("imported").agg(F.max_by("declared", F.struct(F.length("key"), "key")).alias("declared"))
    return first.unionByName(last)
