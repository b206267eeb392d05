"""What patches say: which declarations they touch, which of them undo others, and what came of the work under a prompt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(first: np.ndarray, removed: np.ndarray, added: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of lines after a patch as they were before it; a span that the patch made ends before it starts.

    The hunks are in order and apart. A line that a hunk wrote stands for the lines that it took.
    """
    shift = np.concatenate([[0], np.cumsum(removed - added)])  # of the lines behind so many hunks
    before = first + shift[:-1]

    def at(line: np.ndarray, is_end: bool) -> np.ndarray:
        passed = np.searchsorted(first + added, line, "right")  # hunks that end before the line
        own = np.minimum(passed, len(first) - 1)
        inside = (passed < len(first)) & (first[own] <= line)
        return np.where(inside, before[own] + (removed[own] - 1 if is_end else 0), line + shift[passed])

    return at(start, False), at(end, True)


def declaration_touches(hunks: DataFrame, declared: DataFrame) -> DataFrame:
    """(commit, file, id): the declarations that each commit touches; id is null where it touches a file, but none of them.

    hunks: (commit, seq, file, first, removed, added), seq rising by file, lines as after the commit; an empty hunk stands
    before line first. declared: (file, id, start_line, end_line) after the last commit. A file's spans are carried back
    from commit to commit, each time by the sums of lines that the hunks before them took and gave, so a file's hunks are
    read in order, in one task; files are dealt to all. A declaration that a commit wrote whole is none before it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*hunks.schema, *declared.schema]}

    def walk(h: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], d["id"].to_numpy()
        start, end = d["start_line"].to_numpy(np.int64), d["end_line"].to_numpy(np.int64)
        for _, patch in sorted(h.groupby("seq"), key=lambda x: -x[0]):
            patch = patch.sort_values("first")
            first, removed, added = (patch[c].to_numpy(np.int64) for c in ("first", "removed", "added"))
            last = first + np.maximum(added, 1) - 1
            # hunks are apart, so those that meet a span are the ones from the first that ends in it or behind
            met = np.searchsorted(last, start, "left") < np.searchsorted(first, end, "right")
            found = ids[met] if met.any() else [None]
            out.append(pd.DataFrame({"commit": patch["commit"].iloc[0], "file": patch["file"].iloc[0], "id": pd.array(found, "Int64")}))
            start, end = _carried(first, removed, added, start, end)
            held = start <= end
            ids, start, end = ids[held], start[held], end[held]
        return pd.concat(out) if out else pd.DataFrame({"commit": [], "file": [], "id": pd.array([], "Int64")})

    both = hunks.groupBy("file").cogroup(declared.groupBy("file"))
    return both.applyInPandas(walk, f"commit {kinds['commit']}, file {kinds['file']}, id long")


def reverts(lines: DataFrame) -> DataFrame:
    """(commit, reverted): commits that take away just what an earlier one gave and give what it took; the latest such one.

    lines: (commit, ts, file, sign, text), sign + or -. A patch is told by order-free sums of two hashes of its added and of
    its removed lines, and is held against the mirrored sums of later ones; repeated and partial patches undo nothing.
    """
    each = lambda seed: F.xxhash64("file", "text", F.lit(seed)).cast("decimal(38,0)")
    side = lambda sign: F.struct(*[F.coalesce(F.sum(F.when(F.col("sign") == sign, each(s))), F.lit(0).cast("decimal(38,0)")).alias(f"h{s}") for s in (1, 2)], F.count_if(F.col("sign") == sign).alias("n"))
    patch = lines.groupBy("commit").agg(F.min("ts").alias("ts"), side("+").alias("plus"), side("-").alias("minus")).filter("plus <> minus")
    given = patch.select("ts", "commit", F.struct(F.col("plus").alias("a"), F.col("minus").alias("b")).alias("key"), F.col("commit").alias("_own"))
    asked = patch.select("ts", "commit", F.struct(F.col("minus").alias("a"), F.col("plus").alias("b")).alias("key"), F.lit(None).cast(patch.schema["commit"].dataType).alias("_own"))
    # asked before given at one time, as a commit follows only earlier ones
    order = Window.partitionBy("key").orderBy("ts", F.col("_own").isNotNull(), "commit").rowsBetween(Window.unboundedPreceding, -1)
    met = given.unionByName(asked).withColumn("reverted", F.last("_own", ignorenulls=True).over(order))
    return met.filter("_own is null and reverted is not null").select("commit", "reverted")


def under_prompts(prompts: DataFrame, events: DataFrame, part: str = "day") -> DataFrame:
    """events with `prompt`, the last one of their scope before them or at their time; null where there is none.

    prompts: (scope, ts, prompt); events have scope and ts. Each part of a scope's time is sorted by itself, and only the
    last prompt of each part is carried on, so a scope with very many events is no single task's.
    """
    cols = events.columns
    rows = events.withColumn("_p", F.lit(None).cast(prompts.schema["prompt"].dataType)).withColumn("_e", F.lit(1))
    held = prompts.select("scope", "ts", F.col("prompt").alias("_p"), F.lit(0).alias("_e"))
    every = rows.unionByName(held, allowMissingColumns=True).withColumn("_part", F.date_trunc(part, "ts"))
    inside = Window.partitionBy("scope", "_part").orderBy("ts", "_e", "_p").rowsBetween(Window.unboundedPreceding, 0)
    last = held.groupBy("scope", F.date_trunc(part, "ts").alias("_part")).agg(F.max_by("_p", F.struct("ts", "_p")).alias("_last"))
    # one row a scope and part
    parts = every.select("scope", "_part").distinct().join(last, ["scope", "_part"], "left")
    before = Window.partitionBy("scope").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("scope", "_part", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    own = every.withColumn("_in", F.last("_p", ignorenulls=True).over(inside)).filter("_e = 1")
    return own.join(carried, ["scope", "_part"], "left").select(*cols, F.coalesce("_in", "_before").alias("prompt"))


def episodes(prompts: DataFrame, events: DataFrame, kinds: dict[str, str], files: int | None = 40, latest: int | None = 5_000) -> DataFrame:
    """(prompt, file, reads, edits, searches, survived, outcome) of the work under each prompt.

    events: (scope, ts, event, kind, file, old_fp, new_fp); kinds names the kinds that are `read`, `edit`, `search`, `pass` and
    `fail`. An edit survives unless a later one of its file brings back the text from before it. outcome: `pass` or `fail`,
    whichever came last under the prompt, or `open`. files: those of a prompt at most, the most worked on; latest: prompts
    of a scope at most, the newest; None for all.
    """
    is_kind = lambda name: F.col("kind") == kinds[name]
    kept = prompts
    if latest:
        place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("ts"), F.desc("prompt")))
        kept = prompts.withColumn("_r", place).filter(F.col("_r") <= latest).drop("_r")
    at = under_prompts(prompts, events).join(kept.select("prompt"), "prompt", "left_semi")
    back = events.filter(is_kind("edit")).groupBy("scope", "file", F.col("new_fp").alias("old_fp")).agg(F.max("ts").alias("_back"))
    seen = at.join(back, ["scope", "file", "old_fp"], "left")
    stays = is_kind("edit") & F.coalesce(F.col("_back") <= F.col("ts"), F.lit(True))
    count = lambda cond: F.count_if(cond)
    work = seen.filter(F.col("file").isNotNull() & (is_kind("read") | is_kind("edit") | is_kind("search"))).groupBy("prompt", "file")
    work = work.agg(count(is_kind("read")).alias("reads"), count(is_kind("edit")).alias("edits"), count(is_kind("search")).alias("searches"), count(stays).alias("survived"))
    if files:
        most = Window.partitionBy("prompt").orderBy(F.desc(F.col("edits") + F.col("reads") + F.col("searches")), "file")
        work = work.withColumn("_r", F.row_number().over(most)).filter(F.col("_r") <= files).drop("_r")
    said = at.filter(is_kind("pass") | is_kind("fail")).groupBy("prompt").agg(F.max_by(F.when(is_kind("pass"), "pass").otherwise("fail"), F.struct("ts", "event")).alias("outcome"))
    return work.join(said, "prompt", "left").withColumn("outcome", F.coalesce("outcome", F.lit("open")))
