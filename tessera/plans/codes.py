"""Queries of the functions on code, paths and commands; inputs are columns of varied cases made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import code as C
from tessera.functions import exprs as X
from tessera.plans.registry import query

#: SQL that both sides evaluate: a varied path, type, command or name for each part.
PATHS = "concat(case p_partkey % 5 when 0 then 'src/' when 1 then 'tests/' when 2 then 'lib/__tests__/' when 3 then 'a/spec/' else '' end, case p_size % 4 when 0 then 'test_' when 1 then 'Order' else 'x' end, substr(p_brand, 7), case p_partkey % 7 when 0 then '.test.js' when 1 then '_test.go' when 2 then 'Test.java' when 3 then '.spec.ts' when 4 then 'Tests.cs' when 5 then '_spec.RB' else '.py' end)"
TYPES = "concat(case p_partkey % 4 when 0 then 'java.util.' when 1 then ' a.b.' else '' end, case p_size % 5 when 0 then 'Map' when 1 then 'Order$Item' when 2 then '9bad' when 3 then '?' else 'List' end, case p_partkey % 3 when 0 then '<String, List<Long>>' when 1 then '[ ][]' else '' end)"
RECEIVERS = "case p_partkey % 5 when 0 then concat('this.', p_brand) when 1 then 'this.' when 2 then 'a.b' when 3 then '' else substr(p_name, 1, 5) end"
COMMANDS = "concat(case p_partkey % 5 when 0 then 'cd /repo && ' when 1 then 'SP=/tmp/x; A=1 ' when 2 then 'mkdir -p a | ' else '' end, case p_size % 6 when 0 then 'npx vitest' when 1 then '/usr/bin/node probe.mjs' when 2 then 'npm run Build' when 3 then 'go test ./...' when 4 then 'python -m pytest' else '$RUN x' end, case p_partkey % 3 when 0 then ' --silent' when 1 then ' -e \"code; x\"' else ' 42 word' end)"


def _ends(names: str) -> str:
    return " or ".join(f"regexp_matches(n, '{x}')" for x in names)


@query(rf"""with x as (select p_partkey, {PATHS} as p from part), y as (select p_partkey, p, string_split(p, '/')[-1] as n, string_split(p, '/') as s from x) select p_partkey,
regexp_matches(p, '\.(test|spec)\.') or contains(p, '__tests__/') or list_contains(s[:-2], 'test') or list_contains(s[:-2], 'tests') or contains(p, '_test.') as blast_radius,
len(list_filter(s[:-2], lambda d: d in ('test', 'tests', 'spec', 'specs', '__tests__', 'testing'))) > 0 or regexp_matches(n, '[._-](spec|tests?)\.[A-Za-z]+$') or starts_with(n, 'test_') or regexp_matches(n, 'Test\.(java|kt|cs)$') as calls,
len(list_filter(s, lambda d: lower(d) in ('test', 'tests', 'spec', '__tests__'))) > 0 or regexp_matches(lower(n), '[._](test|spec)\.\w+$') or regexp_matches(lower(n), 'tests?\.java$|test\.kt$') as typing,
len(list_filter(s, lambda d: lower(d) in ('test', 'tests', 'spec', 'specs', '__tests__'))) > 0 or starts_with(lower(n), 'test_') or regexp_matches(lower(n), '[._]test\..|[._]spec\..|\.tests\.ps1$') or regexp_matches(n, 'Tests?\.java$|Tests\.cs$') as symbols from y""")
def f11_test_paths(t):
    path = t.part.select("p_partkey", F.expr(PATHS).alias("p"))
    return path.select("p_partkey", *[C.is_test_path(F.col("p"), way).alias(way) for way in (*C.TEST_PATHS, "symbols")])


@query(rf"""with x as (select p_partkey, {TYPES} as t, {RECEIVERS} as r from part), y as (select p_partkey, r, trim(string_split(trim(replace(replace(string_split(trim(t), '<')[1], '[ ]', ''), '[]', '')), '.')[-1]) as b from x)
select p_partkey, case when regexp_full_match(b, '[A-Za-z_$][A-Za-z0-9_$]*') then b end as bare, case when starts_with(r, 'this.') then nullif(substr(r, 6), '') when contains(r, '.') then null else nullif(r, '') end as field from y""")
def c14_types_and_receivers(t):
    given = t.part.select("p_partkey", F.expr(TYPES).alias("t"), F.expr(RECEIVERS).alias("r"))
    return given.select("p_partkey", C.bare_type(F.col("t")).alias("bare"), C.receiver_field(F.col("r")).alias("field"))


@query(r"""with f as (select distinct 'src/Man' || (p_size % 9)::int || '/m' || (p_partkey % 40)::int || case p_partkey % 4 when 0 then '.ts' when 1 then '.py' when 2 then '/index.js' else '.tsx' end as path from part where p_partkey % 3 <> 0),
i as (select distinct 'src/Man' || (p_size % 9)::int || '/a.ts' as file, case p_partkey % 5 when 0 then './m' when 1 then '../Man' || (p_partkey % 9)::int || '/./m' when 2 then '.m' when 3 then '..Man' || (p_size % 7)::int || '.m' else 'm' end || (p_partkey % 40)::int || case when p_partkey % 5 < 2 and p_partkey % 2 = 0 then '.js' else '' end as spec from part),
b as (select file, spec, case when starts_with(spec, './') then regexp_extract(file, '(.*)/', 1) || substr(spec, 2) when starts_with(spec, '../') then 'src/' || replace(substr(spec, 4), '/./', '/') when starts_with(spec, '..') then 'src/' || replace(substr(spec, 3), '.', '/') when starts_with(spec, '.') then regexp_extract(file, '(.*)/', 1) || '/' || substr(spec, 2) end as p from i),
c as (select file, spec, unnest([{'k': 0, 'c': p}, {'k': 3, 'c': p || '.ts'}, {'k': 4, 'c': p || '.tsx'}, {'k': 8, 'c': p || '.py'}, {'k': 16, 'c': p || '/index.js'}, {'k': 21, 'c': regexp_replace(p, '\.js$', '.ts')}], recursive := true) from b where p is not null)
select file, spec, arg_min(c, k) as target from c join f on c.c = f.path group by file, spec""")
def c13_imports(t):
    part = t.part
    path = F.expr("concat('src/Man', p_size % 9, '/m', p_partkey % 40, case p_partkey % 4 when 0 then '.ts' when 1 then '.py' when 2 then '/index.js' else '.tsx' end)")
    spec = F.expr("concat(case p_partkey % 5 when 0 then './m' when 1 then concat('../Man', p_partkey % 9, '/./m') when 2 then '.m' when 3 then concat('..Man', p_size % 7, '.m') else 'm' end, p_partkey % 40, case when p_partkey % 5 < 2 and p_partkey % 2 = 0 then '.js' else '' end)")
    files = part.filter("p_partkey % 3 <> 0").select(path.alias("path"))
    return C.resolve_imports(part.select(F.expr("concat('src/Man', p_size % 9, '/a.ts')").alias("file"), spec.alias("spec")), files)


@query("""with x as (select i1.item_id as a_id, i2.item_id as b_id, list_distinct(regexp_extract_all(lower(i1.text), '[a-z]+')[1:(2 + i1.item_id % 3)::int]) as a, list_concat(list_distinct(regexp_extract_all(lower(i1.text), '[a-z]+')[(1 + i1.item_id % 2)::int:(2 + i1.item_id % 3)::int]), case i1.item_id % 4 when 0 then ['never'] when 1 then ['here', 'really'] when 2 then ['widgets'] else ['stop', 'now'] end) as b from benchmark i1 join benchmark i2 on i1.item_id = i2.item_id),
f as (select *, ['here', 'just', 'really', 'actually', 'simply', 'generally', 'usually', 'typically', 'currently', 'also', 'please', 'basically', 'essentially', 'now', 'then', 'so', 'anyway', 'overall'] as fill, ['never', 'no', 'not', 'none', 'avoid', 'without', 'dont', 'disable', 'disallow', 'forbid', 'stop'] as neg from x),
p as (select a_id, neg, list_filter(a, lambda w: not list_contains(fill, w)) as a, list_filter(b, lambda w: not list_contains(fill, w)) as b from f),
o as (select a_id, neg, list_filter(a, lambda w: len(list_filter(b, lambda v: v = w or (len(w) >= 4 and starts_with(v, w)) or (len(v) >= 4 and starts_with(w, v)))) = 0) as oa, list_filter(b, lambda w: len(list_filter(a, lambda v: v = w or (len(w) >= 4 and starts_with(v, w)) or (len(v) >= 4 and starts_with(w, v)))) = 0) as ob from p)
select a_id as item_id, not (len(oa) > 0 and len(list_filter(oa, lambda w: not list_contains(neg, w))) = 0) and not (len(ob) > 0 and len(list_filter(ob, lambda w: not list_contains(neg, w))) = 0) and not (len(oa) > 0 and len(ob) > 0) as restates from o""")
def c22_restates(t):
    words = F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")
    upto = (2 + F.col("item_id") % 3).cast("int")
    begin = (1 + F.col("item_id") % 2).cast("int")
    more = F.expr("case item_id % 4 when 0 then array('never') when 1 then array('here', 'really') when 2 then array('widgets') else array('stop', 'now') end")
    pair = t.benchmark.select("item_id", F.slice(words, F.lit(1), upto).alias("a"), F.concat(F.slice(words, begin, upto - begin + 1), more).alias("b"))
    return pair.select("item_id", C.restates(F.col("a"), F.col("b")).alias("restates"))


@query(rf"""with x as (select p_partkey, p_size, {COMMANDS.replace(chr(92), '')} as c from part) select p_partkey,
case p_size % 6 when 0 then 'npx vitest' when 1 then 'node' when 2 then 'npm run' when 3 then 'go test' when 4 then 'python -m' end as shape,
array_to_string(list_transform(list_filter(string_split_regex(c, '\s+'), lambda w: w <> '' and not starts_with(w, '-') and not contains(w, '/') and not contains(w, '=') and not regexp_matches(w, '^[0-9]')), lambda w: lower(w))[1:3], ' ') as prefix from x""")
def c25_commands(t):
    given = t.part.select("p_partkey", F.expr(COMMANDS).alias("c"))
    return given.select("p_partkey", C.command_shape(F.col("c")).alias("shape"), C.command_prefix(F.col("c")).alias("prefix"))


@query("""select p_partkey, '{' || case p_partkey % 3 when 2 then '' else '"a":' || p_size || ',' end || '"b":null,"c":"' || p_brand || '"' || case p_partkey % 3 when 2 then '' else ',"d":[1,{"e":2}]' end || '}' as merged,
case p_partkey % 4 when 0 then '["x",1,"y"]' when 1 then '["a b"]' when 2 then '[{"k":2},"z"]' else '[]' end as arrays from part""")
def c3_c4_json_merges(t):
    left = F.expr("""case p_partkey % 3 when 2 then 'no json' else concat('{"a":', p_size, ',"b":7,"d":[1,{"e":2}]}') end""")
    right = F.expr("""concat('{"c":"', p_brand, '","b":null}')""")
    a = F.expr("""case p_partkey % 4 when 0 then '["x",1]' when 1 then null when 2 then '{"k":2}' else '[]' end""")
    b = F.expr("""case p_partkey % 4 when 0 then '"y"' when 1 then 'a b' when 2 then '["z"]' end""")
    merged = t.part.select("p_partkey", C.json_merge(left, right).alias("m"), C.json_merge_arrays(a, b).alias("arrays"))
    # keys in order, so that the text can be compared
    ordered = F.expr("""concat('{', array_join(transform(array_sort(map_keys(o)), k -> concat('"', k, '":', coalesce(to_json(o[k]), 'null'))), ','), '}')""")
    return merged.select("p_partkey", F.from_json("m", "map<string,variant>").alias("o"), "arrays").select("p_partkey", ordered.alias("merged"), "arrays")


@query(r"""with x as (select p_partkey, replace(p_name, ' ', case p_partkey % 3 when 0 then '.' when 1 then '/' else ' ' end) || ' get' || substr(p_brand, 1, 5) || 'Name' as t from part),
w as (select p_partkey, t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') as k from x)
select p_partkey, array_to_string(list_concat(k, list_filter(flatten(list_transform(k, lambda x: string_split_regex(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[\s./_-]+'))), lambda x: x <> '')), ' ') as searched from w""")
def c9_search_text(t):
    text = F.expr("concat(replace(p_name, ' ', case p_partkey % 3 when 0 then '.' when 1 then '/' else ' ' end), ' get', substr(p_brand, 1, 5), 'Name')")
    return t.part.select("p_partkey", X.search_text(text).alias("searched"))


@query("""with s as (select s_suppkey, lower(replace(s_name, ' ', '')) as n, s_nationkey from supplier), o as (select c_custkey, lower(replace('call ' || replace(c_name, 'Customer', 'Supplier') || ' now', ' ', '')) as target, c_nationkey from customer where c_custkey <= 100000000)
select c_custkey, min(s_suppkey) as s_suppkey from o join s on contains(target, n) and s_nationkey <> c_nationkey group by c_custkey""")
def j13_name_contained(t):
    from tessera.operators.resolve import contained_name

    plain = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    targets = t.customer.select("c_custkey", plain(F.concat(F.lit("call "), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), F.lit(" now"))).alias("target"), "c_nationkey")
    names = t.supplier.select("s_suppkey", plain(F.col("s_name")).alias("name"), "s_nationkey")
    met = contained_name(targets, "target", names, "name").filter("s_nationkey <> c_nationkey")
    return met.groupBy("c_custkey").agg(F.min("s_suppkey").alias("s_suppkey"))


#: Globs, and what each says of a path's segments s.
GLOBS = {
    "folder": ("tests/", "list_contains(s, 'tests')"),
    "python": ("*.py", "len(list_filter(s, lambda x: ends_with(x, '.py'))) > 0"),
    "nested": ("**/__tests__", "list_contains(s[2:], '__tests__')"),
    "rooted": ("/src/*.spec.ts", "s[1] = 'src' and ends_with(coalesce(s[2], ''), '.spec.ts')"),
    "letters": ("x??.py", "len(list_filter(s, lambda x: length(x) = 6 and starts_with(x, 'x') and ends_with(x, '.py'))) > 0"),
    "across": ("/lib/**.go", "s[1] = 'lib' and ends_with(s[-1], '.go')"),
}


@query(f"""with x as (select p_partkey, string_split({PATHS}, '/') as s from part)
select p_partkey, {", ".join(f"{sql} as {name}" for name, (_, sql) in GLOBS.items())} from x""")
def s2_globs(t):
    path = t.part.select("p_partkey", F.expr(PATHS).alias("p"))
    return path.select("p_partkey", *[F.col("p").rlike(C.glob_pattern(glob)).alias(name) for name, (glob, _) in GLOBS.items()])


#: Outputs of failed commands (n: a part's name), and the class, family and message of each.
OUTPUTS = [
    (r"concat('Error: Exit code 1\n> npm test\nfoo.test.js\nAssertionError: expected ', n)", "code", "assertion", "'AssertionError: expected ' || n"),
    (r"concat('Exit code 127\nbash: ', n, ': command not found')", "environment", "command_not_found", "'bash: ' || n || ': command not found'"),
    (r"concat('running\nFAIL ', n, '\n./pkg/a.go:12:3: undefined: x')", "code", "compile", "'pkg/a.go undefined: x'"),
    (r"concat('SqliteError: no such column: ', n)", "code", "sql", "'no such column: ' || n"),
    (r"concat('Cannot find module ', n, '\nENOMEM')", "environment", "oom", "'ENOMEM'"),
    (r"concat('Cannot find module ', n, '\n1 failed')", "code", "module_not_found", "'Cannot find module ' || string_split(n, ' ')[1]"),
    (r"'Exit code 2'", "environment", "empty", "''"),
    (r"concat('all is well with ', n)", "environment", "unrecognised", "''"),
    (r"concat('  java.lang.IllegalStateException: ', n, '\n at x')", "code", "exception", "'IllegalStateException: ' || n"),
    (r"concat('panic: ', n)", "code", "panic", "'panic: ' || n"),
    (r"concat('cat: ', n, ': No such file or directory')", "environment", "missing_path", "'cat: ' || n || ': No such file or directory'"),
    (r"concat(n, '\n7 tests failed')", "code", "test_failure", "'7 tests failed'"),
]


def _by_part(expressions: list[str]) -> str:
    whens = " ".join(f"when {k} then {x}" for k, x in enumerate(expressions))
    return f"case p_partkey % {len(expressions)} {whens} end"


@query(f"""with x as (select p_partkey, p_name as n from part)
select p_partkey, {_by_part([f"'{x[1]}'" for x in OUTPUTS])} as class, {_by_part([f"'{x[2]}'" for x in OUTPUTS])} as family,
{_by_part([x[3] for x in OUTPUTS])} as message from x""")
def c24_failures(t):
    said = t.part.withColumn("n", F.col("p_name")).select("p_partkey", F.expr(_by_part([x[0] for x in OUTPUTS])).alias("text"))
    return said.select("p_partkey", C.failure(F.col("text")).alias("f")).select("p_partkey", "f.*")


@query("""select p_partkey, case when p_size % 3 = 0 or p_partkey % 5 = 0 then null else greatest(p_size::double, p_partkey % 50, 0.36) end as top
from part""")
def c6_greatest_or_null(t):
    size = F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double"))
    key = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 50).cast("double"))
    return t.part.select("p_partkey", X.greatest_or_null(size, key, F.lit(0.36)).alias("top"))


@query("""with x as (select p_partkey, p_size, p_brand from part)
select p_partkey, case p_partkey % 3 when 0 then 3 when 1 then 0 end as items, k as key, case k when 'a' then case when p_partkey % 2 = 0 then p_size::varchar else 'null' end when 'b' then '[1,"x"]' else '"' || p_brand || '"' end as value
from x, (select unnest(['a', 'b', 'c']) as k) where k <> 'b' or p_partkey % 5 > 0""")
def c5_json_changes(t):
    """Lengths of arrays, and the members of objects after keys were set and removed."""
    array = F.expr("case p_partkey % 3 when 0 then '[1,[2],{}]' when 1 then '[]' else '{}' end")
    given = F.expr("""case when p_partkey % 2 = 0 then '{"a":1,"b":[1,"x"],"d":0}' else '{"a":null,"b":[1,"x"]}' end""")
    changed = C.json_set(C.json_remove(given, "d"), "c", F.to_json(F.struct("p_brand")).substr(F.lit(12), F.length("p_brand") + 2))
    changed = F.when(F.col("p_partkey") % 2 == 0, C.json_set(changed, "a", F.col("p_size").cast("string"))).otherwise(changed)
    changed = F.when(F.col("p_partkey") % 5 == 0, C.json_remove(changed, "b", "none")).otherwise(changed)
    rows = t.part.select("p_partkey", C.json_length(array).alias("items"), changed.alias("o"))
    return C.json_each(rows, "o")
