"""Calls of routes to the handlers that serve them, by path patterns with wildcards on either side.

A path is its segments; a segment in braces, of a colon and a name, or in angle brackets is a wildcard, `{}`. Two paths meet
if they have as many segments, and each pair is equal or one of it is a wildcard; verbs meet if equal, or one is null.

A pattern is told by which of its segments are wildcards, its mask. A path with mask a meets one with mask b where they
agree outside both masks: so each side is written once for each mask that the other side has at its length, with `{}` in
the places of either, and the two meet by equality. There are few masks, whatever the number of paths, and handlers are
counted before calls meet them, so a route that very many share costs no more than one of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.cuts import cut

WILD = "{}"
TIERS = ("equal", "pattern", "suffix")


def segments(path: Column) -> Column:
    """The lower-case segments of a path or URL, without scheme, host, query and fragment; wildcards as WILD."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(path), r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(plain, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^(\{.*\}|:.+|<.*>|\*)$"), WILD).otherwise(x))


def _shaped(df: DataFrame) -> DataFrame:
    """With n, the number of segments, and mask, the places of wildcards."""
    places = F.filter(F.transform("segments", lambda x, k: F.when(x == WILD, k)), lambda k: k.isNotNull())
    return df.withColumn("n", F.size("segments")).withColumn("mask", F.array_join(places, ","))


def _masked(df: DataFrame, masks: DataFrame) -> DataFrame:
    """df once for each mask of masks (n, other) at its length, with the key that the other side has there."""
    held = df.join(F.broadcast(masks), "n")
    hide = F.split("other", ",")
    key = F.transform("segments", lambda x, k: F.when(F.array_contains(hide, k.cast("string")), WILD).otherwise(x))
    return held.withColumn("key", F.array_join(key, "/"))


def _meeting(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call, handler, last): the least and the greatest handler that each call (call, verb, segments) meets. routes: (handler, verb, segments)."""
    c, r = cut(_shaped(calls)), cut(_shaped(routes))
    mask_c = c.select("n", F.col("mask").alias("other")).distinct()
    mask_r = r.select("n", F.col("mask").alias("other")).distinct()
    # the two masks of a meeting, the call's first, are part of the key
    asked = _masked(c, mask_r).select("call", "verb", "n", F.col("mask").alias("of_call"), F.col("other").alias("of_route"), "key")
    given = _masked(r, mask_c).select("handler", "verb", "n", F.col("other").alias("of_call"), F.col("mask").alias("of_route"), "key")
    keys = ["n", "of_call", "of_route", "key"]
    known = given.groupBy(*keys, "verb").agg(F.min("handler").alias("handler"), F.max("handler").alias("last"))
    met = asked.withColumnRenamed("verb", "_verb").join(known, keys).filter("verb is null or _verb is null or verb = _verb")
    return met.groupBy("call").agg(F.min("handler").alias("handler"), F.max("last").alias("last"))


def served(calls: DataFrame, routes: DataFrame, least: int = 2) -> DataFrame:
    """(call, handler, tier) of calls (call, verb, path) that one handler of routes (handler, verb, path) serves.

    An equal path decides first, then patterns, then the longest ending of the call's path, of `least` segments or more, that
    a route has. Where a tier offers two handlers the call is refused.
    """
    c = cut(calls.select("call", "verb", segments(F.col("path")).alias("segments")).filter(F.size("segments") > 0))
    r = cut(routes.select("handler", "verb", segments(F.col("path")).alias("segments")).filter(F.size("segments") > 0).distinct())
    key = F.array_join("segments", "/").alias("key")
    known = r.select(key, F.col("verb").alias("_verb"), "handler").groupBy("key", "_verb").agg(F.min("handler").alias("handler"), F.max("handler").alias("last"))
    equal = c.select("call", "verb", key).join(known, "key").filter("verb is null or _verb is null or verb = _verb")
    equal = cut(equal.groupBy("call").agg(F.min("handler").alias("handler"), F.max("last").alias("last")).withColumn("tier", F.lit(TIERS[0])))
    left = c.join(equal.select("call"), "call", "left_anti")
    pattern = cut(_meeting(left, r).withColumn("tier", F.lit(TIERS[1])))
    left = left.join(pattern.select("call"), "call", "left_anti").filter(F.size("segments") > least)
    ends = left.select("call", "verb", F.explode(F.expr(f"transform(sequence({least}, size(segments) - 1), n -> slice(segments, -n, n))")).alias("segments"))
    one = F.struct("call", F.size("segments").alias("n"))
    met = _meeting(ends.select(one.alias("call"), "verb", "segments"), r).select("call.call", "call.n", "handler", "last")
    longest = met.groupBy("call").agg(F.max_by(F.struct("handler", "last"), "n").alias("b"))
    suffix = longest.select("call", "b.handler", "b.last", F.lit(TIERS[2]).alias("tier"))
    return equal.unionByName(pattern).unionByName(suffix).filter("handler = last").select("call", "handler", "tier")
