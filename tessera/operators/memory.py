"""What an event log teaches. Events are rows (id, scope, ts, kind, shape, value); scopes stand for (session, agent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import sketch_similarity
from tessera.operators.resolve import similar_sets

GAP = 30 * 60
ORDER = ["ts", "id"]


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def islands(events: DataFrame, keys: list[str]) -> DataFrame:
    """Adds island: a number for each stretch of consecutive events of a scope with the same keys."""
    w = Window.partitionBy("scope").orderBy(*ORDER)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    new = F.when(F.row_number().over(w) == 1, 1).when(same, 0).otherwise(1)
    return events.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def sessions(events: DataFrame, gap: float = GAP) -> DataFrame:
    """Adds session: counts up when a scope was idle for strictly more than gap seconds."""
    w = Window.partitionBy("scope").orderBy(*ORDER)
    idle = seconds(F.col("ts")) - seconds(F.lag("ts").over(w)) > gap
    return events.withColumn("_new", F.when(idle, 1).otherwise(0)).withColumn("session", F.sum("_new").over(w)).drop("_new")


def fail_fix(events: DataFrame, fail: str, edit: tuple[str, ...], done: str, gap: float = GAP) -> DataFrame:
    """(scope, session, fail_id, pass_id, edits, verdict): each failure, the next pass of its session, the edits between.

    A later failure replaces an earlier one. With an edit between it is an observation, else the failure was flaky.
    """
    e = sessions(events, gap)
    w = Window.partitionBy("scope", "session").orderBy(*ORDER)
    armed = F.last(F.when(F.col("kind") == fail, F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("fail_id", armed).filter(F.col("fail_id").isNotNull() & F.col("kind").isin(done, *edit))
    g = Window.partitionBy("scope", "session", "fail_id").orderBy(*ORDER)
    e = e.withColumn("_passes", F.coalesce(F.count_if(F.col("kind") == done).over(g.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("_passes = 0")
    out = e.groupBy("scope", "session", "fail_id").agg(F.count_if(F.col("kind").isin(*edit)).alias("edits"), F.max(F.when(F.col("kind") == done, F.col("id"))).alias("pass_id"))
    out = out.filter("pass_id is not null")
    return out.withColumn("verdict", F.when(F.col("edits") > 0, "observation").otherwise("flaky"))


def recurrence(observations: DataFrame, signature: str) -> DataFrame:
    return observations.groupBy(signature).agg(F.count("*").alias("n"), F.count_distinct("scope").alias("scopes"), F.count_distinct("scope", "session").alias("sessions"), F.min("fail_id").alias("first"), F.max("fail_id").alias("last"))


def dead_commands(events: DataFrame, failed: Column, least: int = 2) -> DataFrame:
    """(scope, shape, fails, first_fail): shapes that failed at least so often, with no pass after the first failure."""
    marked = events.withColumn("_bad", failed)
    bad = marked.filter("_bad").groupBy("scope", "shape").agg(F.count("*").alias("fails"), F.min(F.struct(*ORDER)).alias("_first")).filter(F.col("fails") >= least)
    good = marked.filter("not _bad").groupBy("scope", "shape").agg(F.max(F.struct(*ORDER)).alias("_last"))
    out = bad.join(good, ["scope", "shape"], "left").filter(F.col("_last").isNull() | (F.col("_last") < F.col("_first")))
    return out.select("scope", "shape", "fails", F.col("_first")["id"].alias("first_fail"))


def rituals(events: DataFrame, failed: Column, half_life_days: float = 30.0, passes: int = 5, weight: float = 3.0, most_failures: float = 0.25, recent: int | None = None) -> DataFrame:
    """Habits: shapes whose decayed passes weigh enough, that fail seldom and not just now. recent: events of a scope at most, the
    newest; None for all of them."""
    e = events.withColumn("_bad", failed.cast("int"))
    if recent:
        e = e.withColumn("_k", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("_k") <= recent)
    e = e.withColumn("_age", (seconds(F.max("ts").over(Window.partitionBy("scope"))) - seconds(F.col("ts"))) / 86400)
    w = Window.partitionBy("scope", "shape").orderBy(F.desc("ts"), F.desc("id"))
    good_before = F.sum(1 - F.col("_bad")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("_streak", F.when((good_before == 0) & (F.col("_bad") == 1), 1).otherwise(0))
    decayed = F.pow(F.lit(0.5), F.col("_age") / half_life_days)
    out = e.groupBy("scope", "shape").agg(F.sum(1 - F.col("_bad")).alias("passes"), F.sum("_bad").alias("fails"), F.round(F.sum(decayed * (1 - F.col("_bad"))), 6).alias("weight"), F.sum("_streak").alias("streak"))
    rate = F.col("fails") / (F.col("fails") + F.col("passes"))
    return out.filter((F.col("streak") <= 1) & (F.col("passes") >= passes) & (F.col("weight") >= weight) & (rate <= most_failures))


def episodes(turns: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """Adds episode: numbers the windows that an opening row starts; rows before the first have episode 0."""
    w = Window.partitionBy(key).orderBy(order)
    return turns.withColumn("episode", F.coalesce(F.sum(F.when(opens, 1).otherwise(0)).over(w), F.lit(0)))


def merge_mentions(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One row for each normalised text of a key: mentions, first and last."""
    norm = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " +", " "))
    return rows.withColumn("norm", norm).filter("norm != ''").groupBy(key, "norm").agg(F.count("*").alias("mentions"), F.min(order).alias("first"), F.max(order).alias("last"))


def supersede(facts: DataFrame, key: str, tokens: str, order: str, least: float = 0.6) -> DataFrame:
    """(key, old, new, similarity): a later fact of a key that restates an earlier one. Pairs meet on rare tokens within the key."""
    return similar_sets(facts, order, tokens, least, [key]).withColumnsRenamed({"a": "old", "b": "new"})


def revalidate(anchors: DataFrame, now: DataFrame, least: float = 0.6) -> DataFrame:
    """(fact, verdict) of anchors (fact, file, name, fp) against declarations (file, name, fp). Our own rules, the first that holds:
    ok (same place, same fingerprint), unconfirmed (same place, other fingerprint), moved (the fingerprint is elsewhere), renamed, orphaned.

    renamed needs a column sketch (bottom hashes) on both sides: a declaration of the same file whose estimate is at least `least`.
    Candidates meet on shared hashes within the file, so no group is compared pair by pair.
    """
    same = now.groupBy("file", "name").agg(F.min("fp").alias("_fp"), F.collect_set("fp").alias("_fps"))
    elsewhere = now.select("fp").distinct().withColumn("_m", F.lit(1))
    out = anchors.join(same, ["file", "name"], "left").join(elsewhere, "fp", "left")
    verdict = F.when(F.array_contains("_fps", F.col("fp")), "ok").when(F.col("_fp").isNotNull(), "unconfirmed").when(F.col("_m").isNotNull(), "moved")
    if "sketch" in anchors.columns and "sketch" in now.columns:
        lost = out.filter("_fp is null and _m is null").select("fact", "file", "sketch", F.explode("sketch").alias("_h"))
        there = now.select("file", F.col("name").alias("_to"), F.col("sketch").alias("_s"), F.explode("sketch").alias("_h"))
        near = lost.join(there, ["file", "_h"]).dropDuplicates(["fact", "_to"]).filter(sketch_similarity(F.col("sketch"), F.col("_s")) >= least)
        out = out.join(near.select("fact").distinct().withColumn("_r", F.lit(1)), "fact", "left")
        verdict = verdict.when(F.col("_r").isNotNull(), "renamed")
    return out.groupBy("fact").agg(F.min(verdict.otherwise("orphaned")).alias("verdict"))


#: Fixed values of a lesson's weight: points, caps, steps of turns and of seconds, and the least weight that surfaces.
POINTS = {"cross_session": 3.0, "cross_scope": 1.0, "repeat": 0.5, "abandonment": 1.25, "workaround": 0.75}
CAPS = {"repeat": 1.5, "abandonment": 2.5, "effort": 2.0}
TURN_STEPS = [(40, 1.5), (20, 1.0), (8, 0.5)]
SECOND_STEPS = [(5400, 1.5), (1800, 1.0), (600, 0.5)]
SURFACES = 3.0


def _steps(c: Column, steps: list[tuple[int, float]]) -> Column:
    out = F.lit(0.0)
    for at, points in reversed(steps):
        out = F.when(c >= at, points).otherwise(out)
    return out


def lesson_weight(sessions: Column, scopes: Column, occurrences: Column, turns: Column, seconds: Column, abandonments: Column, workaround: Column) -> Column:
    """Points for a failure that comes back, that several scopes met, that cost effort; repeats, abandonment and effort are capped."""
    over = lambda c: F.greatest(c, F.lit(0))
    back = over(sessions - 1) * POINTS["cross_session"] + over(scopes - F.greatest(sessions, F.lit(1))) * POINTS["cross_scope"]
    again = F.least(over(occurrences - F.greatest(scopes, F.lit(1))) * POINTS["repeat"], F.lit(CAPS["repeat"]))
    gone = F.least(abandonments * POINTS["abandonment"], F.lit(CAPS["abandonment"]))
    effort = F.least(_steps(turns, TURN_STEPS) + _steps(seconds, SECOND_STEPS) + F.when(workaround, POINTS["workaround"]).otherwise(0.0), F.lit(CAPS["effort"]))
    return F.round(back + again + gone + effort, 2)


def recall(facts: DataFrame, least: float = SURFACES) -> DataFrame:
    """Facts (id, tier, weight, expired, grain, valid_at) that may be shown, with place: law before observation, the finer grain, the heavier, the newer, then id.

    Expired facts and tiers other than law and observation are out; a weight under `least` is out unless the tier is law; no weight passes.
    """
    live = facts.filter(F.col("expired").isNull() & F.col("tier").isin("law", "observation")).filter((F.col("tier") == "law") | (F.coalesce(F.col("weight"), F.lit(least)) >= least))
    order = [F.col("file"), F.when(F.col("tier") == "law", 0).otherwise(1), F.desc("grain"), F.desc_nulls_last("weight"), F.desc("valid_at"), F.col("id")]
    return live.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(*order[1:])))


def contradicted(rules: DataFrame) -> DataFrame:
    """(old, new) of rules (id, prefer, over): the next later rule that prefers just the other way round."""
    later = rules.select(F.col("id").alias("_new"), F.col("over").alias("prefer"), F.col("prefer").alias("over"))
    return rules.join(later, ["prefer", "over"]).filter("_new > id").groupBy(F.col("id").alias("old")).agg(F.min("_new").alias("new"))


def once_per(rows: DataFrame, keys: list[str], place: list[Column], group: list[str], most: int = 2) -> DataFrame:
    """The first row of each key, of those at most `most` of each group: a notice is shown once a session and place."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*place))
    rows = rows.withColumn("_k", first).filter("_k = 1")
    return rows.withColumn("_g", F.row_number().over(Window.partitionBy(*group).orderBy(*place))).filter(F.col("_g") <= most).drop("_k", "_g")
