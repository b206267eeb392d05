"""Column functions on source code's names, paths, imports and commands, and on JSON objects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Four ways to tell a test's path, which differ in purpose and are not interchangeable.
TEST_PATHS = {
    "blast_radius": r"(\.test\.|\.spec\.|__tests__/|(^|/)tests?/|_test\.)",
    "calls": r"(^|/)(tests?|specs?|__tests__|testing)/|(^|/)[^/]*[._-](spec|test|tests)\.[A-Za-z]+$|(^|/)test_[^/]*$|Test\.(java|kt|cs)$",
    "typing": r"(?i)(^|/)(tests?|__tests__|spec)(/|$)|(\.|_)(test|spec)\.[\w]+$|Tests?\.java$|Test\.kt$",
}
#: Of the fourth way, whole segments of a path, and names of a file (whatever case, then of just this case).
TEST_SEGMENTS = ("tests", "test", "spec", "specs", "__tests__")
TEST_FILE_ANY_CASE = (r"^test_.*", r".*_test\..+$", r".*\.test\..+$", r".*\.spec\..+$", r".*_spec\..+$", r".*\.tests\.ps1$")
TEST_FILE_THIS_CASE = (r".*Test\.java$", r".*Tests\.java$", r".*Tests\.cs$")
#: What is tried after an import's path, in this order.
IMPORT_SUFFIXES = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".py", ".go", ".java", ".rb", ".php", ".cs", ".kt", ".rs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/__init__.py")
#: Words of a rule that say nothing about which rule it is, and those that turn it round.
FILLERS = ("here", "just", "really", "actually", "simply", "generally", "usually", "typically", "currently", "also", "please", "basically", "essentially", "now", "then", "so", "anyway", "overall")
NEGATIONS = ("never", "no", "not", "none", "avoid", "without", "dont", "disable", "disallow", "forbid", "stop")
#: Programs that say where a command runs, not what it does.
PLACES = ("cd", "export", "set", "unset", "mkdir", "rm", "cp", "mv", "touch", "source", ".", "shopt", "umask", "alias", "true", "pushd", "popd", "time")
#: What tools print, in lower case, by the kind of failure that it tells of: first what the surroundings do to a command,
#: then what the code does. The kinds and their order are fixed values; the phrases are the tools' own messages.
SURROUNDINGS = {
    "worktree_isolation": ("isolated in the worktree",),
    "interrupt": ("keyboardinterrupt", "sigint", "interrupted by user", "command was interrupted"),
    "timeout": ("timed out", "etimedout", "deadline exceeded"),
    "oom": ("out of memory", "enomem", "cannot allocate memory", "oomkilled"),
    "missing_path": ("no such file or directory", "enoent"),
    "command_not_found": ("command not found", "is not recognized as an internal or external command"),
    "shell_syntax": ("syntax error near unexpected token", "unexpected eof", "parse error near", "no matches found", "bad substitution"),
    "tool_usage": ("usage:", "invalid option", "unknown option", "unrecognized option", "illegal option"),
    "permission": ("permission denied", "eacces", "operation not permitted", "read-only file system"),
}
FAULTS = {
    "module_not_found": ("cannot find module", "cannot find package", "no module named", "could not resolve"),
    "sql": ("sqliteerror", "operationalerror", "programmingerror", "integrityerror", "no such table", "no such column", "constraint failed"),
    "assertion": ("assertionerror", "assertion failed", "assertion `"),
    "compile": ("error ts", "error[e", "cannot find symbol", "undefined reference to", "undefined: ", "implicit declaration of", "syntaxerror", "error: expected"),
    "panic": ("panic:", "panicked at"),
    "exception": ("error:", "exception:", "traceback (most recent call last)"),
    "test_failure": ("tests failed", "test failed", "failing", "--- fail", "failed,"),
    "lint": ("problems (", "problem ("),
}


def is_test_path(path: Column, way: str) -> Column:
    """Whether a path is a test's, in one of the ways of TEST_PATHS or as `symbols`; false for null."""
    if way != "symbols":
        return F.coalesce(path.rlike(TEST_PATHS[way]), F.lit(False))
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    name = F.coalesce(F.element_at(parts, -1), F.lit(""))
    by_name = name.rlike("(?i)" + "|".join(f"(?:{x})" for x in TEST_FILE_ANY_CASE)) | name.rlike("|".join(f"(?:{x})" for x in TEST_FILE_THIS_CASE))
    return F.coalesce(F.exists(parts, lambda x: F.lower(x).isin(*TEST_SEGMENTS)) | by_name, F.lit(False))


def bare_type(name: Column) -> Column:
    """A type's own name without generic arguments, array marks and qualifier; null if no identifier is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), r"(?s)<.*", ""), r"\[\s*\]", ""))
    last = F.trim(F.regexp_extract(plain, r"(?s)([^.]*)\z", 1))
    return F.when(last.rlike(r"\A[A-Za-z_$][\w$]*\z"), last)


def receiver_field(receiver: Column) -> Column:
    """The field that a call's receiver names: after `this.`, or a plain name; null for a dotted one, an empty one or null."""
    after = F.substring(receiver, F.lit(6), F.length(receiver))
    return F.when(receiver.startswith("this."), F.nullif(after, F.lit(""))).when(~receiver.contains("."), F.nullif(receiver, F.lit("")))


def _normal(parts: Column) -> Column:
    """Segments without empty ones and `.`, each `..` taking the one before it along, or staying where there is none."""

    def step(done: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("..")) != "..")
        return F.when((x == "") | (x == "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def import_path(file: Column, spec: Column) -> Column:
    """The path, without an ending, that a relative import in a file names; null for an import of a package.

    `./a` and `../a` are read as paths; `.a.b` and `..a` as dotted names, one directory up for each further dot.
    """
    dots, rest = F.length(F.regexp_extract(spec, r"^(\.*)", 1)), F.regexp_extract(spec, r"^\.*(.*)$", 1)
    dotted = (dots > 0) & rest.rlike(r"^([A-Za-z_]\w*(\.[A-Za-z_]\w*)*)?$") & ((rest != "") | (dots > 1))
    slashed = F.concat(F.when(dots > 1, F.lit("")).otherwise(F.lit("./")), F.array_join(F.concat(F.array_repeat(F.lit(".."), dots - 1), F.filter(F.split(rest, r"\."), lambda x: x != "")), "/"))
    path = F.when(spec.rlike(r"^\.{1,2}/"), spec).when(dotted, slashed)
    folder = F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"/?[^/]*$", "")
    return F.when(path.isNotNull() & (file != ""), F.array_join(_normal(F.split(F.concat(folder, F.lit("/"), path), "/")), "/"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, spec) with `target`: the first known file (path) on the suffix ladder, then .ts or .tsx in place of .js or .jsx.

    Candidates are at most 22 an import and meet the files by equality; an import without a target is left out.
    """
    base = F.col("_base")
    to_ts = F.when(base.endswith(".jsx") | base.endswith(".js"), F.regexp_replace(base, r"\.js(x?)$", ".ts$1"))
    tried = F.filter(F.array(*[F.concat(base, F.lit(x)) for x in IMPORT_SUFFIXES], to_ts), lambda x: x.isNotNull())
    given = imports.distinct().withColumn("_base", import_path(F.col("file"), F.col("spec"))).filter("_base is not null")
    met = given.select("file", "spec", F.posexplode(tried).alias("_k", "path")).join(files.select("path").distinct(), "path")
    return met.groupBy("file", "spec").agg(F.min_by("path", "_k").alias("target"))


def restates(a: Column, b: Column) -> Column:
    """Whether rule b (an array of content tokens) restates a: not if both hold a word that the other lacks, or if all that one
    holds beyond the other turns it round. Words of one stem are equal: one is the other's start, of four letters or more."""

    def stem(x: Column, y: Column) -> Column:
        return (x == y) | ((F.length(x) >= 4) & y.startswith(x)) | ((F.length(y) >= 4) & x.startswith(y))

    plain = lambda t: F.filter(F.array_distinct(t), lambda x: ~x.isin(*FILLERS))
    only = lambda s, t: F.filter(plain(s), lambda x: ~F.exists(plain(t), lambda y: stem(x, y)))
    turned = lambda t: (F.size(t) > 0) & F.forall(t, lambda x: x.isin(*NEGATIONS))
    of_a, of_b = only(a, b), only(b, a)
    return ~turned(of_a) & ~turned(of_b) & ~((F.size(of_a) > 0) & (F.size(of_b) > 0))


def command_shape(command: Column, most: int = 24) -> Column:
    """The first program that a command line runs and the word after it; null if there is none.

    The line is read up to its first quote or here-document. Programs of PLACES, and names with anything but letters, digits
    and `.+_-`, are no program. A word with a dot, a slash or any other sign, or of more than `most` characters, is left out.
    """
    read = F.regexp_extract(F.regexp_replace(command, r"\\\n", " "), r"(?s)^((?:(?!<<)[^'\"])*)", 1)
    simple = F.regexp_extract_all(read, F.lit(r"[^&|;\n]+"), F.lit(0))
    words = F.transform(simple, lambda x: F.filter(F.split(x, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\w+=")))
    named = F.transform(words, lambda w: F.struct(F.element_at(F.split(F.get(w, F.lit(0)), "/"), -1).alias("program"), F.get(w, F.lit(1)).alias("word")))
    first = F.get(F.filter(named, lambda x: x["program"].rlike(r"^[\w.+-]+$") & ~x["program"].isin(*PLACES)), F.lit(0))
    word = F.when(first["word"].rlike(rf"^[\w:=-]{{1,{most}}}$"), first["word"])
    return F.when(first.isNotNull(), F.concat_ws(" ", first["program"], word))


def command_prefix(command: Column, words: int = 3) -> Column:
    """The first words of a command that are no flag, path, assignment or number, in lower case."""
    plain = F.filter(F.split(F.coalesce(command, F.lit("")), r"\s+"), lambda x: (x != "") & ~x.rlike(r"^-|/|=|^\d"))
    return F.array_join(F.slice(F.transform(plain, F.lower), 1, words), " ")


def json_merge(a: Column, b: Column) -> Column:
    """Shallow merge of two JSON objects, the right one's values winning, nulls kept; what is no object counts as an empty one."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    left, right = read(a), read(b)
    return F.to_json(F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right))


def json_merge_arrays(a: Column, b: Column) -> Column:
    """Items of both as one JSON array; a scalar is one item, text that is no JSON is a string item, null has none."""

    def items(c: Column) -> Column:
        trimmed = F.trim(c)
        valid = F.try_parse_json(c).isNotNull()
        inner = F.trim(F.regexp_extract(trimmed, r"(?s)^\[(.*)\]$", 1))
        one = F.when(valid, F.when(trimmed.startswith("["), inner).otherwise(trimmed)).otherwise(F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6))
        return F.nullif(one, F.lit(""))

    return F.concat(F.lit("["), F.concat_ws(",", items(a), items(b)), F.lit("]"))


def glob_pattern(glob: str) -> str:
    """The pattern, for rlike, of a path policy's glob: `*` and `?` stay in a segment, `**` crosses segments.

    A glob meets whole segments anywhere in a path, from its beginning after a leading `/`; a folder's glob meets all in it.
    """
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = glob.removesuffix("/").removeprefix("/")
    inner = "".join(wild.get(x) or re.escape(x) for x in re.split(r"(\*\*|\*|\?)", body))
    begin = "^" if glob.startswith("/") else "" if glob.startswith("**") else "(?:^|/)"
    return f"{begin}{inner}(?:/|$)"


def _cause(family: str, line: Column, phrases: str) -> Column:
    """What a line of a family says, without what varies between repeats: positions, packages, and what follows a module's name."""
    if family == "module_not_found":
        return F.coalesce(F.nullif(F.regexp_extract(line, rf"(?i)((?:{phrases})\s+['\"]?[^'\"\s]+)", 1), F.lit("")), line)
    own = {
        "sql": (r"^.*?\b\w+Error\b\s*:\s*(?=\S)", ""),
        "compile": (r"^\.?/?(\S+?\.\w+):\d+(?::\d+)?:\s*(?=\S)", "$1 "),
        "exception": (r"^(?:\w+\.)+(?=\w*(?:Error|Exception)\b)", ""),
    }
    return F.regexp_replace(line, *own[family]) if family in own else line


def failure(text: Column) -> Column:
    """Struct (class, family, message) of a failed command's output: the first kind of which any line has a phrase, and that line's cause.

    Lines that only tell the exit code are passed over. Output without text is `empty` and output of no kind
    `unrecognised`, both of the class environment, with an empty message; null counts as empty.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike(r"^(error: )?exit code \d+$"))
    said = lambda kind, family, message: F.struct(F.lit(kind).alias("class"), F.lit(family).alias("family"), message.alias("message"))

    def met(kind: str, family: str, phrases: tuple[str, ...]) -> Column:
        any_of = "|".join(map(re.escape, phrases))
        line = F.get(F.filter(lines, lambda x: F.lower(x).rlike(any_of)), F.lit(0))
        return F.when(line.isNotNull(), said(kind, family, _cause(family, line, any_of)))

    kinds = [met("environment", *x) for x in SURROUNDINGS.items()] + [met("code", *x) for x in FAULTS.items()]
    return F.coalesce(F.when(F.size(lines) == 0, said("environment", "empty", F.lit(""))), *kinds, said("environment", "unrecognised", F.lit("")))


def json_length(text: Column) -> Column:
    """Items of a JSON array; null for anything else."""
    return F.json_array_length(text)


def json_set(text: Column, key: str, value: Column) -> Column:
    """A JSON object with the key set to a JSON value, whatever it was before; what is no object counts as an empty one."""
    return json_merge(text, F.concat(F.to_json(F.create_map(F.lit(key), F.lit(0))).substr(F.lit(1), F.lit(len(key) + 4)), value, F.lit("}")))


def json_remove(text: Column, *keys: str) -> Column:
    """A JSON object without the keys; what is no object counts as an empty one."""
    held = F.coalesce(F.from_json(text, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    return F.to_json(F.map_filter(held, lambda k, _: ~k.isin(*keys)))


def json_each(df: DataFrame, column: str) -> DataFrame:
    """df without the column, once for each member of its JSON object: `key` and `value`, as JSON; none for what is no object."""
    held = F.from_json(F.col(column), "map<string,variant>")
    return df.select(*[c for c in df.columns if c != column], F.explode(held).alias("key", "_v")).withColumn("value", F.coalesce(F.to_json("_v"), F.lit("null"))).drop("_v")
