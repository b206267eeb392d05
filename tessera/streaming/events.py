"""Event streams: fail-to-fix per scope with kept state, replay without repeats, session windows.

Events are rows (id, scope, ts, kind). Within a micro-batch a scope's rows are put in order (ts, id); a row older than
what the scope's state has seen is late: order decides which edit lies between a failure and a pass, so it changes nothing
any more, but it is told, as a row of the verdict LATE, and can be counted or replayed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.cuts import shared_folder

LATE = "late"
OUT = "scope long, fail_id long, pass_id long, edits long, verdict string"
STATE = "last_us long, last_id long, fail_id long, edits long"


def fail_fix(events: DataFrame, fail: str, edit: tuple[str, ...], done: str, gap: float = 1800.0) -> DataFrame:
    """(scope, fail_id, pass_id, edits, verdict): each failure with the next pass of its session, as in memory.fail_fix, but over a stream;
    and a row (scope, null, id, null, LATE) for each late event. An event that comes twice is late the second time.

    A failure replaces the one before; idle time of strictly more than gap seconds clears the state. A scope's state is four
    numbers, whatever it has seen; a batch's rows of one scope are bounded by the source's rate limit (maxFilesPerTrigger).
    """
    gap_us = int(gap * 1e6)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        last_us, last_id, armed, edits = state.get if state.exists else (None, -1, -1, 0)
        out = []
        for us, i, kind in zip(rows["us"], rows["id"], rows["kind"]):
            if last_us is not None and (us, i) <= (last_us, last_id):
                out.append((key[0], None, int(i), None, LATE))
                continue
            if last_us is not None and us - last_us > gap_us:
                armed, edits = -1, 0
            last_us, last_id = int(us), int(i)
            if kind == fail:
                armed, edits = int(i), 0
            elif armed >= 0 and kind in edit:
                edits += 1
            elif armed >= 0 and kind == done:
                out.append((key[0], armed, int(i), edits, "observation" if edits else "flaky"))
                armed, edits = -1, 0
        state.update((last_us, last_id, armed, edits))
        yield pd.DataFrame(out, columns=["scope", "fail_id", "pass_id", "edits", "verdict"]).astype({"fail_id": "Int64", "edits": "Int64"})

    slim = events.filter("scope is not null and id is not null and ts is not null").select("scope", "id", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return slim.groupBy("scope").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame, keys: list[str], overlap: str = "30 minutes") -> DataFrame:
    """A stream whose source reads an overlap again: rows of the same keys within the overlap count once."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", overlap).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """(scope, start, n) of session windows; a window ends gap after its last event, and is out once the watermark has passed it."""
    w = F.session_window("ts", gap)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("scope", w).agg(F.count("*").alias("n")).select("scope", F.col("session_window.start").alias("start"), "n")


def read(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Parquet files at a path, or one file, as a stream of at most so many files a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path[:-1] + f"[{path[-1]}]")


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives for the input there is now, through a Parquet sink with a checkpoint in the shared folder."""
    at = shared_folder(stream.sparkSession)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
