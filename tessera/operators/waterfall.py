"""Loose references to declarations, rung by rung: each rung takes only what the earlier ones left.

A reference is `ref, file, folder, stem, name, receiver, assigned`: what it names, the receiver that it is called on, and the
variable that takes its result (both may be null). A declaration is `target, name, owner, returns, file, folder, stem,
test`: owner is the type that has it, returns the type of its result.

Every rung needs one target; a reference to which it offers several goes on to the next. The types of variables come from
what is declared and from the results of references that are settled already, so the rung that asks them is passed again
as long as that settles more. Declarations are counted by a rung's key before references meet them, so a name that very many
declarations share costs no more than one that two share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.code import is_test_path
from tessera.functions.exprs import directory_distance, stem_suffix
from tessera.operators.inherit import inherited
from tessera.plans.cuts import cut

RUNGS = ("import", "receiver_import", "receiver_type", "module", "global", "folded", "stem")

#: The rung that asks the types found so far, and so the one that later passes can settle more by.
TYPED = "receiver_type"


def _lone(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target) of the keys with one target."""
    one = candidates.groupBy(*keys).agg(F.count_distinct("target").alias("_n"), F.min("target").alias("target"))
    return one.filter("_n = 1").drop("_n")


def _nearest(left: DataFrame, declared: DataFrame, most: int) -> DataFrame:
    """(ref, target): of at most `most` declarations of the name, outside tests, the one in the nearest folder, if one only is."""
    known = declared.filter(~F.col("test"))
    few = known.groupBy("name").agg(F.count_distinct("target").alias("_n")).filter(F.col("_n") <= most).select("name")
    held = known.join(few, "name").select("name", "target", F.col("folder").alias("_to"))
    met = left.join(held, "name").select("ref", "target", directory_distance(F.concat("folder", F.lit("/")), F.concat("_to", F.lit("/"))).alias("_d"))
    least = met.groupBy("ref", "target").agg(F.min("_d").alias("_d"))
    near = least.groupBy("ref").agg(F.min("_d").alias("_least"))
    return _lone(least.join(near, "ref").filter("_d = _least"), ["ref"])


def _suffixed(name: Column) -> Column:
    return F.lower(stem_suffix(name))


def resolve(references: DataFrame, declared: DataFrame, imports: DataFrame, variables: DataFrame, bases: DataFrame, chain: int = 6, most: int = 3) -> DataFrame:
    """(ref, target, rung, pass) of the references that a rung settles; ref is unique.

    imports: (file, name, target). variables: (file, name, type). bases: (src, dst) of types by name, followed `chain` up.
    """
    d = cut(declared)
    imported = cut(_lone(imports, ["file", "name"]))
    types = d.select(F.col("target").alias("_type_id"), F.col("name").alias("type"))
    of_import = imported.join(types, imported["target"] == types["_type_id"]).select("file", F.col("name").alias("receiver"), "type")
    member = d.filter("owner is not null").select(F.col("owner").alias("id"), "name").distinct()
    # every type that has members or bases, with the names it has of itself or from the nearest base that has them
    has = inherited(bases, member, chain).select(F.col("id").alias("type"), "name", "owner")
    of_type = cut(_lone(has.join(d.select("owner", "name", "target"), ["owner", "name"]), ["type", "name"]))
    by_stem = cut(_lone(d.select(F.col("stem").alias("receiver"), "name", "target"), ["receiver", "name"]))
    folded = cut(_lone(d.select(F.lower("name").alias("_key"), "target"), ["_key"]))
    stems = cut(_lone(d.select(_suffixed(F.col("name")).alias("_key"), "target"), ["_key"]))
    typed = cut(variables.select("file", F.col("name").alias("receiver"), "type").distinct())
    left, found, passes = cut(references.select("ref", "file", "folder", "name", "receiver", "assigned")), None, 0
    while True:
        passes += 1
        settled = None
        # what other rungs offer a reference never changes, so what they left once they leave again
        for rung in RUNGS if passes == 1 else (TYPED,):
            held = left.filter("receiver is not null")
            new = {
                "import": lambda: left.filter("receiver is null").join(imported, ["file", "name"]),
                "receiver_import": lambda: _lone(held.join(of_import, ["file", "receiver"]).join(of_type, ["type", "name"]), ["ref"]),  # noqa: B023
                "receiver_type": lambda: _lone(held.join(typed, ["file", "receiver"]).join(of_type, ["type", "name"]), ["ref"]),  # noqa: B023
                "module": lambda: held.join(by_stem, ["receiver", "name"]),  # noqa: B023
                "global": lambda: _nearest(left, d, most),
                "folded": lambda: left.withColumn("_key", F.lower("name")).join(folded, "_key"),
                "stem": lambda: left.withColumn("_key", _suffixed(F.col("name"))).join(stems, "_key"),
            }[rung]()
            new = cut(new.select("ref", "target", F.lit(rung).alias("rung"), F.lit(passes).alias("pass")))
            if new.isEmpty():
                continue
            result = left.join(new.select("ref", "target"), "ref").filter("assigned is not null").join(d.select("target", "returns"), "target")
            typed = cut(typed.union(result.filter("returns is not null").select("file", "assigned", "returns")).distinct())
            left = cut(left.join(new.select("ref"), "ref", "left_anti"))
            settled = new if settled is None else settled.unionByName(new)
        if settled is None:
            break
        found = settled if found is None else found.unionByName(settled)
    return found if found is not None else left.limit(0).select("ref", F.lit(0).cast("long").alias("target"), F.lit("").alias("rung"), F.lit(0).alias("pass"))


def tested(path: Column) -> Column:
    """Whether a declaration's path is a test's, for `test`."""
    return is_test_path(path, "calls")
