"""Files of a tree: which are read and why not, and the entries of configuration files. Patterns are our own choice within each reason."""

from __future__ import annotations

import configparser
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reasons in the order in which they are tried, with patterns over lower-case paths; then the size limit.
REASONS = [
    ("binary", r"\.(png|jpe?g|gif|ico|webp|pdf|zip|gz|tgz|jar|class|so|dll|dylib|exe|woff2?|ttf|mp[34]|bin)$"),
    ("generated", r"(\.min\.(js|css)|\.map|\.pb\.go|_pb2\.py|\.g\.dart|\.designer\.cs|(^|/)(package-lock\.json|yarn\.lock|go\.sum|cargo\.lock))$"),
    ("story", r"\.stories\.[a-z]+$"),
    ("e2e", r"(^|/)(e2e|cypress)/"),
    ("dir_segment", r"(^|/)(node_modules|\.git|dist|build|target|vendor|__pycache__|\.venv|coverage)/"),
    ("secret", r"((^|/|\.)env(\.[a-z]+)?|\.pem|\.key|(^|/)id_(rsa|ed25519))$"),
]
SIZE_LIMIT = 200_000


def reason(path: Column, size: Column, ignore: str | None = None, include: str | None = None, exclude: str | None = None) -> Column:
    """Why a file isn't read, the first reason that holds, or kept. ignore, include and exclude are patterns that come after the fixed ones; null paths are ignored."""
    low = F.lower(path)
    tests = [(name, low.rlike(pattern)) for name, pattern in REASONS]
    tests += [(name, test) for name, given, test in (("ignore", ignore, lambda p: path.rlike(p)), ("include", include, lambda p: ~path.rlike(p)), ("exclude", exclude, lambda p: path.rlike(p))) if given for test in [test(given)]]
    out = F.when(path.isNull(), "ignore")
    for name, test in [*tests, ("size", size > SIZE_LIMIT)]:
        out = out.when(test, name)
    return out.otherwise("kept")


def looks_binary(content: Column, head: int = 8000) -> Column:
    """A zero byte, or over 30 % of control bytes, in the first bytes."""
    start = F.hex(F.substring(content, 1, head))
    odd = F.regexp_count(F.regexp_replace(start, "(..)", "$1 "), F.lit("(0[0-8BEF]|1[0-9A-F]|7F) "))
    zero = F.regexp_replace(start, "(..)", "$1 ").rlike("(^| )00 ")
    return F.when(F.length(start) == 0, False).otherwise(zero | (odd / (F.length(start) / 2) > 0.3))


def walk(spark: SparkSession, root: str, **patterns: str | None) -> DataFrame:
    """(path, size, reason, content): every file below root but empty ones, which the file source skips; content as text where it is read, else null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    why = reason(F.col("path"), F.col("length"), **patterns)
    out = raw.withColumn("reason", why).withColumn("reason", F.when((F.col("reason") == "kept") & looks_binary(F.col("content")), "binary").otherwise(F.col("reason")))
    return out.select("path", F.col("length").alias("size"), "reason", F.when(F.col("reason") == "kept", F.make_valid_utf8(F.col("content").cast("string"))).alias("content"))


def _flat(value: object, key: str) -> Iterator[tuple[str, str | None]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{key}.{k}" if key else str(k))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _flat(v, f"{key}[{k}]")
    else:
        yield key, None if value is None else json.dumps(value) if isinstance(value, bool) else str(value)


def _properties(text: str) -> Iterator[tuple[str, str]]:
    for line in text.splitlines():
        if "=" in line and line.lstrip()[:1] not in "#!":
            key, value = line.split("=", 1)
            yield key.strip(), value.strip()


def _ini(text: str) -> Iterator[tuple[str, str]]:
    read = configparser.ConfigParser(interpolation=None, strict=False, allow_no_value=True)
    read.read_string("[DEFAULT]\n" + text)
    for k, v in read.defaults().items():
        yield k, v
    for name in read.sections():
        for k in read._sections[name]:
            yield f"{name}.{k}", read._sections[name][k]


READERS = {"json": lambda s: _flat(json.loads(s), ""), "toml": lambda s: _flat(tomllib.loads(s), ""), "properties": _properties, "ini": _ini, "editorconfig": _ini}


def entries(path: str, text: str) -> list[tuple[str, str | None]]:
    reader = READERS.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1])
    try:
        return list(reader(text)) if reader else []
    except (ValueError, configparser.Error, RecursionError):
        return []  # a broken file has no entries


def config_entries(files: DataFrame, *keep: str) -> DataFrame:
    """(keep, key, value) of JSON, TOML, properties and INI files (path, content), nested keys joined by dots."""

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def read(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k, "value": v} for k, v in entries(p, s)] if p and s else [] for p, s in zip(paths, texts)])

    return files.select(*keep, F.explode(read("path", "content")).alias("_e")).select(*keep, "_e.*")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of a statement coverage artifact: {file: {statementMap: {id: {start: {line}}}, s: {id: hits}}}."""
    span = "struct<start:struct<line:int>>"
    schema = f"map<string,struct<statementMap:map<string,{span}>,s:map<string,bigint>>>"
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("file", "_c"))
    lines = parsed.select("file", F.explode("_c.statementMap").alias("_id", "_at"), F.col("_c.s").alias("_s"))
    return lines.groupBy("file", F.col("_at.start.line").alias("line")).agg(F.max(F.col("_s")[F.col("_id")]).alias("hits"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines (transcripts, call traces, tool events) under a stated schema; broken lines keep their text in _broken."""
    return spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
