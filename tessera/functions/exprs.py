"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of each resolution tier, and the label of tiers.
TIER_LABELS = {"EXTRACTED": (1, 2, 5, 6), "INFERRED": (3, 4, 7, 10, 11), "AMBIGUOUS": (8, 9)}


def tier_label(tier: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, tiers in TIER_LABELS.items():
        out = F.when(tier.isin(*tiers), label).otherwise(out)
    return out


def camel_split(text: Column) -> Column:
    """Parts of a name at its case borders."""
    return F.split(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def terms(text: Column) -> Column:
    """Lower-case letter and digit runs of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def search_text(text: Column, token_bytes: int | None = None, most: int | None = None) -> Column:
    """The text, then its names parted at case borders, dots, slashes and underscores.

    token_bytes: longer tokens are left out; most: characters at most. None for all of them.
    """
    tokens = F.filter(F.split(text, r"\s+"), lambda t: (t != "") & (F.lit(token_bytes is None) | (F.octet_length(t) <= (token_bytes or 0))))
    parts = F.flatten(F.transform(tokens, lambda t: F.split(F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1 $2"), r"[\s./_-]+")))
    whole = F.concat_ws(" ", tokens, F.filter(parts, lambda p: p != ""))
    return F.substring(whole, 1, most) if most else whole


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def line_fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the lines, each trimmed and with single spaces, without empty ones."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != "")
    return F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the code units of a text in the basic plane."""
    units = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    step = lambda h, u: F.expr("0") + (h.bitwiseXOR(u.cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(units, F.lit(2166136261).cast("long"), step)


def sketch(text: Column, size: int = 64) -> Column:
    """Bottom-size FNV hashes of the text's distinct token trigrams."""
    words = F.filter(F.split(text, r"[^A-Za-z0-9_]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: fnv1a(F.concat_ws(" ", F.slice(w, i, 3))))

    return F.slice(F.array_sort(F.array_distinct(F.element_at(F.transform(F.array(words), grams), 1))), 1, size)


def sketch_similarity(a: Column, b: Column, size: int = 64) -> Column:
    """Bottom-k estimate of Jaccard similarity."""
    low = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    shared = F.size(F.array_intersect(F.array_intersect(low, a), b))
    return F.when(F.size(low) == 0, 0.0).otherwise(shared / F.size(low))


def error_signature(text: Column) -> Column:
    """Error text with paths, numbers, hex and quoted values replaced, so that repeats of one failure meet."""
    out = F.regexp_replace(text, r"0x[0-9a-fA-F]+", "<hex>")
    out = F.regexp_replace(out, r"(?:/[\w.-]+)+", "<path>")
    out = F.regexp_replace(out, r"'[^']*'|\"[^\"]*\"", "<str>")
    out = F.regexp_replace(out, r"\d+", "<n>")
    return F.trim(F.regexp_replace(F.lower(out), r"\s+", " "))


def redact(text: Column) -> Column:
    """E-mail addresses, long hex and key-like values, and bearer tokens masked; terminal escapes dropped."""
    out = F.regexp_replace(text, "\\x1b\\[[0-9;]*[A-Za-z]", "")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"(?i)\b(bearer\s+)[A-Za-z0-9._-]{8,}", "$1[token]")
    return F.regexp_replace(out, r"\b[A-Fa-f0-9]{32,}\b", "[hex]")


def json_kind(text: Column) -> Column:
    """Type of a JSON text by DuckDB's names; null for null and for text that is no JSON."""
    t = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    whole = t.try_cast("decimal(38,0)")
    number = F.when(~t.rlike(r"^-?[0-9]+$"), "DOUBLE").when(whole.between(F.lit("0").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)")) & ~t.startswith("-"), "UBIGINT")
    number = number.when(whole.between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("0").cast("decimal(38,0)")), "BIGINT").otherwise("DOUBLE")
    kind = number
    for start, name in (("{", "OBJECT"), ("[", "ARRAY"), ('"', "VARCHAR"), ("t", "BOOLEAN"), ("f", "BOOLEAN"), ("n", "NULL")):
        kind = F.when(t.startswith(start), name).otherwise(kind)
    return F.when(F.try_parse_json(text).isNotNull(), kind)


def url_path(url: Column) -> Column:
    """Path of a url without scheme, host, query, fragment and trailing slash; parameters and numbers as {}."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    segments = F.filter(F.split(rest, "/"), lambda s: (s != "") & ~s.rlike("^v[0-9]+$"))
    shaped = F.transform(segments, lambda s: F.when(s.rlike(r"^(\{.*\}|:.+|<.+>|[0-9]+)$"), "{}").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(shaped, "/"))


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def plural(text: Column) -> Column:
    return F.when(text.rlike("(s|x|z|ch|sh)$"), F.concat(text, F.lit("es"))).when(text.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(text, "y$", ""), F.lit("ies"))).otherwise(F.concat(text, F.lit("s")))


def table_name(given: Column, entity: Column) -> Column:
    """The table of an entity: the name that it states, unless empty, else the plural of its own in snake case."""
    return F.coalesce(F.nullif(given, F.lit("")), plural(snake_case(entity)))


def directory_distance(a: Column, b: Column) -> Column:
    """Steps up and down between the folders of two paths."""
    pa_, pb = F.slice(F.split(a, "/"), 1, F.greatest(F.size(F.split(a, "/")) - 1, F.lit(0))), F.slice(F.split(b, "/"), 1, F.greatest(F.size(F.split(b, "/")) - 1, F.lit(0)))
    agree = F.zip_with(pa_, pb, lambda x, y: x.eqNullSafe(y) & x.isNotNull() & y.isNotNull())
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    common = F.aggregate(agree, zero, lambda s, t: F.struct((s["n"] + F.when(s["on"] & t, 1).otherwise(0)).alias("n"), (s["on"] & t).alias("on")), lambda s: s["n"])
    return F.size(pa_) + F.size(pb) - 2 * common


#: Endings of type names that a stem loses.
STEM_SUFFIXES = "Impl Service Repository Controller Handler Manager Factory Util Utils Helper Adapter Provider Client".split()


def stem_suffix(name: Column) -> Column:
    """The name without one known ending; a name that is only an ending stays."""
    return F.regexp_replace(name, f"(?<=.)({'|'.join(STEM_SUFFIXES)})$", "")


def replace_first(text: Column, pattern: str, by: str) -> Column:
    """The first match alone."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", f"$1{by}")


def greatest_or_null(*columns: Column) -> Column:
    """The greatest value; null if any is null."""
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*columns))


def module_stem(path: Column) -> Column:
    """Lower-case file name without folders and the last extension."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]*$", ""))


def is_prose(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|mdc|markdown|rst|adoc|txt)$")


def allowed(df: DataFrame, column: str, allow: tuple[str, ...] | None = None, deny: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose column is allowed and not denied; a list that isn't given filters nothing."""
    out = df if allow is None else df.filter(F.col(column).isin(*allow))
    return out if deny is None else out.filter(~F.col(column).isin(*deny))


#: Types of a conventional commit that say that it mends something.
FIX_TYPES = ("fix", "bugfix", "hotfix")


def commit_kind(message: Column) -> Column:
    """What a commit message says it does: revert, fix (conventional), issue (closes a number), keyword, other; the first that holds."""
    m = F.lower(message)
    # the head of a conventional commit: a type, then perhaps a scope in brackets, then perhaps a mark of a break
    head = F.regexp_replace(F.substring_index(m, ":", 1), "!$", "")
    conventional = m.contains(":") & F.regexp_replace(head, r"\([^()]*\)$", "").isin(*FIX_TYPES)
    issue = m.rlike(r"\b(close|fix|resolve)[sd]?(es|ed)? #[0-9]+")
    return F.when(m.rlike("^revert"), "revert").when(conventional, "fix").when(issue, "issue").when(m.rlike(r"\b(bug|crash|error)\b"), "keyword").otherwise("other")
