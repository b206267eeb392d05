"""Declared dependencies of manifest files (path, content): npm, composer, pip, pyproject, go.mod, cargo, gem, maven, gradle, csproj.

The formats are their makers' public ones. A file of another name, or one that can't be parsed, gives no row.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "array<struct<ecosystem:string,name:string,version:string,scope:string>>"
Found = Iterator[tuple[str, str, str | None, str]]
_PIP = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([=<>!~][^;#]*)?")


def _json(text: str, kind: str, sections: dict[str, str]) -> Found:
    data = json.loads(text)
    for section, scope in sections.items():
        for name, version in (data.get(section) or {}).items():
            if isinstance(version, str):
                yield kind, name, version, scope


def _pip_line(line: str, scope: str = "runtime") -> Found:
    if (m := _PIP.match(line.strip())) is not None:
        yield "pip", m[1].lower().replace("_", "-"), (m[2] or "").strip() or None, scope


def _pip(text: str) -> Found:
    for line in text.splitlines():
        yield from _pip_line(line)


def _pyproject(text: str) -> Found:
    project = tomllib.loads(text).get("project", {})
    for line in project.get("dependencies", []):
        yield from _pip_line(line)
    for group in project.get("optional-dependencies", {}).values():
        for line in group:
            yield from _pip_line(line, "optional")


def _go(text: str) -> Found:
    inside = False
    for line in text.splitlines():
        words = line.split("//")[0].split()
        if words[:1] == ["require"] and words[1:2] == ["("]:
            inside = True
        elif words == [")"]:
            inside = False
        elif len(pair := words if inside else words[1:] if words[:1] == ["require"] else []) == 2:
            yield "go", pair[0], pair[1], "indirect" if "// indirect" in line else "runtime"


def _cargo(text: str) -> Found:
    data = tomllib.loads(text)
    for section, scope in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
        for name, spec in data.get(section, {}).items():
            yield "cargo", name, spec if isinstance(spec, str) else spec.get("version"), scope


def _gem(text: str) -> Found:
    for m in re.finditer(r"^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", text, re.M):
        yield "gem", m[1], m[2], "runtime"


def _maven(text: str) -> Found:
    for item in ET.fromstring(text).iter():
        if item.tag.rsplit("}", 1)[-1] == "dependency":
            parts = {c.tag.rsplit("}", 1)[-1]: (c.text or "").strip() for c in item}
            if parts.get("artifactId"):
                yield "maven", f"{parts.get('groupId', '')}:{parts['artifactId']}", parts.get("version"), parts.get("scope") or "runtime"


def _gradle(text: str) -> Found:
    for m in re.finditer(r"\b(implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*['\"]([^:'\"]+:[^:'\"]+)(?::([^'\"]+))?['\"]", text):
        yield "maven", m[2], m[3], "test" if m[1].startswith("test") else "runtime"


def _csproj(text: str) -> Found:
    for item in ET.fromstring(text).iter():
        if item.tag.rsplit("}", 1)[-1] == "PackageReference" and item.get("Include"):
            yield "nuget", item.get("Include"), item.get("Version"), "runtime"


PARSERS = {
    "package.json": lambda s: _json(s, "npm", {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}),
    "composer.json": lambda s: _json(s, "composer", {"require": "runtime", "require-dev": "dev"}),
    "pyproject.toml": _pyproject, "go.mod": _go, "Cargo.toml": _cargo, "Gemfile": _gem, "pom.xml": _maven, "build.gradle": _gradle, "build.gradle.kts": _gradle,
}


def parse(path: str, text: str) -> list[tuple[str, str, str | None, str]]:
    name = path.rsplit("/", 1)[-1]
    reader = PARSERS.get(name) or (_csproj if name.endswith(".csproj") else _pip if re.fullmatch(r"requirements[\w.-]*\.txt", name) else None)
    try:
        return list(reader(text)) if reader else []
    except (ValueError, AttributeError, TypeError, ET.ParseError):
        return []  # a broken manifest declares nothing


def dependencies(files: DataFrame, *keep: str) -> DataFrame:
    """(keep, ecosystem, name, version, scope) of files (path, content), a row for each declared dependency. Null paths and contents declare none."""

    @F.pandas_udf(FIELDS)
    def read(paths: pd.Series, texts: pd.Series) -> pd.Series:
        fields = ("ecosystem", "name", "version", "scope")
        return pd.Series([[dict(zip(fields, x)) for x in parse(p, s)] if p and s else [] for p, s in zip(paths, texts)])

    return files.select(*keep, F.explode(read("path", "content")).alias("_d")).select(*keep, "_d.*")
