"""Git history as a data source: `spark.read.format("git_history").option("path", repo)`, a row for each file of each commit.

Columns sha, ts, author, subject, path, added, removed (null for binary files). The driver reads only the list of commit
ids; each partition asks git for its slice, so the repository must be readable where executors run.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sha string, ts timestamp, author string, subject string, path string, added long, removed long"


class Slice(InputPartition):
    def __init__(self, head: str, first: int, count: int) -> None:
        super().__init__(first)
        self.head, self.first, self.count = head, first, count


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size, self.ref = options["path"], int(options.get("commits_per_partition", "2000")), options.get("ref", "HEAD")

    def git(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.path, *args], capture_output=True, check=True, encoding="utf-8", errors="replace").stdout

    def partitions(self) -> list[Slice]:
        # a fixed commit, so that every partition and every retry counts from the same end
        head = self.git("rev-parse", "--verify", f"{self.ref}^{{commit}}").strip()
        total = int(self.git("rev-list", "--count", head))
        return [Slice(head, k, self.size) for k in range(0, total, self.size)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        out = self.git("log", partition.head, f"--skip={partition.first}", f"--max-count={partition.count}", "--no-renames", "--numstat", "-z", "--format=%x01%H%x02%ct%x02%an%x02%s%x03")
        for commit in out.split("\x01")[1:]:
            head, files = commit.split("\x03", 1)
            sha, seconds, author, subject = head.split("\x02", 3)
            for item in files.split("\0"):
                parts = item.lstrip("\n").split("\t", 2)
                if len(parts) == 3:
                    yield sha, datetime.fromtimestamp(int(seconds), timezone.utc), author, subject, parts[2], *(None if n == "-" else int(n) for n in parts[:2])


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitHistory)
