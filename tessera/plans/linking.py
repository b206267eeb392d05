"""Reachability, resolution, generations and routes as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.exprs import STEM_SUFFIXES
from tessera.operators import generations, packages, reach, routes, waterfall
from tessera.plans.cuts import cut
from tessera.plans.registry import query

# -- reachability ------------------------------------------------------------------------------------------------------

_LINKS = """links as (
  select distinct s_suppkey as src, (s_suppkey * 3 + s_nationkey % 5) % (select count(*) from supplier) + 1 as dst from supplier where s_suppkey % 4 < 3
  union select s_suppkey, s_suppkey % 17 + 1 from supplier where s_suppkey % 5 = 0)"""


def _links(t):
    n = t.supplier.agg(F.count("*").alias("n"))
    far = t.supplier.filter("s_suppkey % 4 < 3").crossJoin(F.broadcast(n)).selectExpr("s_suppkey as src", "(s_suppkey * 3 + s_nationkey % 5) % n + 1 as dst")
    return far.union(t.supplier.filter("s_suppkey % 5 = 0").selectExpr("s_suppkey as src", "s_suppkey % 17 + 1 as dst")).distinct()


_REACHED = f"{_LINKS}, reached(src, dst) as (select src, dst from links union select r.src, l.dst from reached r join links l on r.dst = l.src)"


@query(f"""with recursive {_REACHED}, mates as (select a.src as id, a.dst as mate from reached a join reached b on a.src = b.dst and a.dst = b.src and a.src <> a.dst)
select id, least(id, min(mate)) as component from mates group by id""")
def g11_components(t):
    """Every supplier that lies on a cycle of links, with the least one of its strongly connected component."""
    return reach.strong_components(_links(t))


@query(f"with recursive {_REACHED} select src, count(*) as n, sum(dst)::bigint as ids from reached group by src")
def r0_closure(t):
    """How many suppliers each reaches, and the sum of their ids: the closure by doubling against a recursive query."""
    return reach.closure(_links(t)).groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("ids"))


@query(f"""with recursive {_LINKS}, stay as (select * from links where src % 10 <> 1),
reached(src, dst) as (select src, dst from stay union select r.src, l.dst from reached r join stay l on r.dst = l.src)
select src, count(*) as n, sum(dst)::bigint as ids from reached group by src""")
def r0_closure_kept(t):
    """The same after the links of a tenth of the suppliers went: from the closure before, not anew."""
    links = _links(t)
    gone = F.col("src") % 10 == 1
    after = reach.closure_without(reach.closure(links), links.filter(~gone), links.filter(gone))
    return after.groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("ids"))


_TYPES = """types as (select s_suppkey as id, 'T' || s_suppkey % 40 as name from supplier),
descends(src, dst) as (select s_suppkey, s_suppkey // 2 from supplier where s_suppkey % 11 > 0 and s_suppkey > 1 union select d.src, s_suppkey // 2 from descends d join supplier on d.dst = s_suppkey where s_suppkey % 11 > 0 and s_suppkey > 1),
methods as (select p_partkey as target, p_name || p_size as name, case when p_partkey % 9 > 0 then p_partkey % 97 + 1 end as owner from part),
loose as (select o_orderkey as edge, case when o_orderkey % 3 = 0 then p_partkey else -o_custkey end as caller, p_name || p_size as name, o_custkey % 50 as file from orders join part on p_partkey = o_orderkey % (select count(*) from part) + 1),
imports as (select distinct c_custkey % 50 as file, 'T' || c_custkey % 43 as name from customer where c_custkey % 4 = 0),
known as (select caller, target from loose join methods using (name) where edge % 6 = 0 and target % 2 = 0)"""


@query(f"""with recursive {_TYPES}, cand as (select edge, caller, file, target, owner from loose join methods using (name) where target <> caller),
roots as (select file, id from imports join types using (name)),
allowed as (select file, id as owner from roots union select file, src from roots join descends on dst = id),
one as (select edge, min(target) as target from cand group by edge having count(distinct target) = 1),
near as (
  select edge, min(target) as target from cand where edge not in (select edge from one) and (file, owner) in (select (file, owner) from allowed) group by edge
  having count(distinct target) = 1),
found as (select * from one union all select * from near)
select f.edge, l.caller, f.target, 10::int as tier, case when (l.caller, f.target) in (select (caller, target) from known) then 'dropped' else 'upgraded' end as verdict
from found f join loose l using (edge)""")
def e13_reresolve(t):
    """Ambiguous calls that the callers' imports and the types' descendants settle."""
    types = t.supplier.selectExpr("s_suppkey as id", "concat('T', s_suppkey % 40) as name")
    up = t.supplier.filter("s_suppkey % 11 > 0 and s_suppkey > 1").selectExpr("s_suppkey as src", "s_suppkey div 2 as dst")
    methods = t.part.selectExpr("p_partkey as target", "concat(p_name, p_size) as name", "case when p_partkey % 9 > 0 then p_partkey % 97 + 1 end as owner")
    n = t.part.agg(F.count("*").alias("n"))
    calls = t.orders.crossJoin(F.broadcast(n)).selectExpr("o_orderkey as edge", "o_custkey", "o_orderkey % n + 1 as p_partkey").join(t.part, "p_partkey")
    loose = calls.selectExpr("edge", "case when edge % 3 = 0 then p_partkey else -o_custkey end as caller", "concat(p_name, p_size) as name", "o_custkey % 50 as file")
    imports = t.customer.filter("c_custkey % 4 = 0").selectExpr("c_custkey % 50 as file", "concat('T', c_custkey % 43) as name")
    return reach.reresolve(loose, methods, reach.closure(up), imports, types, loose.filter("edge % 6 = 0"), methods.filter("target % 2 = 0"))


# -- the waterfall of references ---------------------------------------------------------------------------------------


def _declared(t):
    own = """select p_partkey as target, concat(case when p_partkey % 13 = 0 then upper(p_name) else p_name end, '_', p_size % 9, case when p_partkey % 6 = 0 then 'Impl' else '' end) as name,
      case when p_partkey % 4 > 0 then p_brand end as owner, concat('Brand#', p_partkey % 25 + 1) as returns,
      concat('src/m', p_partkey % 40) as folder, concat('f', p_partkey % 11) as stem, p_partkey % 10 = 0 as test from {part}"""
    types = """select -cast(substr(p_brand, 7) as bigint) as target, p_brand as name, cast(null as string) as owner, cast(null as string) as returns, 'src/types' as folder, 'types' as stem, false as test from {part}"""
    spark, part = t.spark, t.part
    return spark.sql(own, part=part).unionByName(spark.sql(types, part=part).distinct())


_WORLD = """
declared as materialized (
  select p_partkey as target, (case when p_partkey % 13 = 0 then upper(p_name) else p_name end) || '_' || p_size % 9 || (case when p_partkey % 6 = 0 then 'Impl' else '' end) as name,
    case when p_partkey % 4 > 0 then p_brand end as owner, 'Brand#' || (p_partkey % 25 + 1) as returns, 'src/m' || p_partkey % 40 as folder, 'f' || p_partkey % 11 as stem, p_partkey % 10 = 0 as test from part
  union select -substr(p_brand, 7)::bigint, p_brand, null, null, 'src/types', 'types', false from part),
n as (select count(*) as n from part),
refs as materialized (
  select o_orderkey as ref, 'src/m' || o_custkey % 40 || '/g' || o_custkey % 7 as file, 'src/m' || o_custkey % 40 as folder,
    case o_orderkey % 7 when 5 then lower(name) when 6 then name || 'Service' else name end as name,
    case o_orderkey % 5 when 1 then 'v' || o_custkey % 9 when 2 then 'f' || o_orderkey % 11 when 3 then 'p' || o_custkey % 6 when 4 then 'v' || o_orderkey % 9 end as receiver,
    case when o_orderkey % 3 = 0 then 'v' || o_orderkey % 9 end as assigned
  from orders, n join declared on target = o_orderkey % n + 1),
imports as materialized (
  select 'src/m' || c_custkey % 40 || '/g' || c_custkey % 7 as file, name, target from customer, n join declared on target = c_custkey % n + 1
  union all select 'src/m' || c_custkey % 40 || '/g' || c_custkey % 7, 'p' || c_custkey % 6, target from customer join declared on target = -(c_custkey % 27) where c_custkey % 2 = 0),
variables as materialized (select distinct 'src/m' || c_custkey % 40 || '/g' || c_custkey % 7 as file, 'v' || c_custkey % 9 as receiver, 'Brand#' || (c_custkey % 30) as type from customer where c_custkey % 7 = 0),
bases as (select distinct p_brand as src, 'Brand#' || (substr(p_brand, 7)::int + 1) as dst from part),
up as (select src as id, src as own, 0 as depth from (select src from bases union select dst from bases) union select id, dst, depth + 1 from up join bases on own = src where depth < 6),
has as (
  select id as type, name, owner from up join (select distinct owner, name from declared where owner is not null) on owner = own
  qualify row_number() over (partition by id, name order by depth, owner) = 1),
of_type as materialized (select type, name, min(target) as target from has join declared using (owner, name) group by all having count(distinct target) = 1),
imported as materialized (select file, name, min(target) as target from imports group by all having count(distinct target) = 1),
of_import as (select i.file, i.name as receiver, d.name as type from imported i join declared d using (target)),
by_stem as (select stem as receiver, name, min(target) as target from declared group by all having count(distinct target) = 1),
few as (select name from declared where not test group by name having count(distinct target) <= 3),
folded as (select lower(name) as key, min(target) as target from declared group by 1 having count(distinct target) = 1),
stems as (select lower(regexp_replace(name, '{suffix}', '')) as key, min(target) as target from declared group by 1 having count(distinct target) = 1)"""


def _waterfall_sql(passes: int) -> str:
    """Each rung of each pass as three tables: what it settles, the types known after it, what is left."""
    out, left, typed = [], "refs", "variables"
    lone = "select ref, min(target) as target from ({}) group by ref having count(distinct target) = 1"
    # distances of folders that share src or all: every folder has two parts
    near = """select ref, target from (select ref, target, case when r.folder = d.folder then 0 else 2 end as dist from {left} r join declared d using (name) join few using (name) where not test)
      qualify dist = min(dist) over (partition by ref)"""
    for p in range(1, passes + 1):
        for rung, body in (
            ("import", "select ref, target from {left} join imported using (file, name) where receiver is null"),
            ("receiver_import", lone.format("select ref, target from {left} join of_import using (file, receiver) join of_type using (type, name)")),
            ("receiver_type", lone.format("select ref, target from {left} join {typed} using (file, receiver) join of_type using (type, name)")),
            ("module", "select ref, target from {left} join by_stem using (receiver, name)"),
            ("global", lone.format(near)),
            ("folded", "select ref, target from {left} join folded on key = lower(name)"),
            ("stem", "select ref, target from {left} join stems on key = lower(regexp_replace(name, '{suffix}', ''))"),
        ):
            own = f"{rung}_{p}"
            out.append(f"new_{own} as materialized ({body.replace('{left}', left).replace('{typed}', typed)})")
            out.append(f"typed_{own} as materialized (select * from {typed} union select file, assigned, returns from new_{own} join {left} using (ref) join declared using (target) where assigned is not null and returns is not null)")
            out.append(f"left_{own} as materialized (select * from {left} where ref not in (select ref from new_{own}))")
            left, typed = f"left_{own}", f"typed_{own}"
    every = " union all ".join(f"select ref, target, '{r}' as rung, {p}::int as pass from new_{r}_{p}" for p in range(1, passes + 1) for r in waterfall.RUNGS)
    return f"with recursive {_WORLD}, {', '.join(out)} {every}"


@query(_waterfall_sql(4).replace("{suffix}", f"({'|'.join(STEM_SUFFIXES)})$"))
def e1_waterfall(t):
    """Seven rungs over 15 references an import, of which some are settled only by the types that earlier rungs found."""
    declared = cut(_declared(t))
    n = t.part.agg(F.count("*").alias("n"))
    spark = t.spark
    refs = spark.sql(
        """select o_orderkey as ref, concat('src/m', o_custkey % 40, '/g', o_custkey % 7) as file, concat('src/m', o_custkey % 40) as folder,
          case o_orderkey % 7 when 5 then lower(name) when 6 then concat(name, 'Service') else name end as name,
          case o_orderkey % 5 when 1 then concat('v', o_custkey % 9) when 2 then concat('f', o_orderkey % 11) when 3 then concat('p', o_custkey % 6) when 4 then concat('v', o_orderkey % 9) end as receiver,
          case when o_orderkey % 3 = 0 then concat('v', o_orderkey % 9) end as assigned
        from {orders} cross join {n} join {declared} on target = o_orderkey % n + 1""",
        orders=t.orders, n=F.broadcast(n), declared=declared,
    )
    customers = t.customer.crossJoin(F.broadcast(n)).selectExpr("c_custkey", "concat('src/m', c_custkey % 40, '/g', c_custkey % 7) as file", "c_custkey % n + 1 as target")
    imports = customers.join(declared.select("target", "name"), "target").select("file", "name", "target")
    of_types = customers.filter("c_custkey % 2 = 0").selectExpr("file", "concat('p', c_custkey % 6) as name", "-(c_custkey % 27) as target").join(declared.select("target"), "target").select("file", "name", "target")
    variables = customers.filter("c_custkey % 7 = 0").selectExpr("file", "concat('v', c_custkey % 9) as name", "concat('Brand#', c_custkey % 30) as type")
    bases = t.part.selectExpr("p_brand as src", "concat('Brand#', cast(substr(p_brand, 7) as int) + 1) as dst").distinct()
    return waterfall.resolve(refs, declared, imports.unionByName(of_types), variables, bases)


# -- routes ------------------------------------------------------------------------------------------------------------

_PATHS = r"""paths as (
  select page_id, list_filter(string_split(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') as s from pages),
routed as (
  select page_id, case page_id % 3 when 0 then 'GET' when 1 then 'POST' end as verb,
    case when page_id % 4 = 0 then list_transform(s, lambda x: case when regexp_matches(x, '^[0-9]+') then '{}' else x end) else s end as s
  from paths where page_id % 2 = 0 and len(s) > 0),
called as (
  select page_id, case page_id % 5 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' end as verb,
    case page_id % 6 when 0 then list_concat(['api', 'v1'], s) when 1 then list_transform(s, lambda x: case when len(x) = 2 then '{}' else x end) else s end as s
  from paths where len(s) > 0),
tried as (
  select page_id as call, verb, s, 0 as tier, 0 as cut from called
  union all select page_id, verb, s, 1, 0 from called
  union all select page_id, verb, s[k + 1:], 2, k from (select *, unnest(range(1, len(s) - 1)) as k from called)),
met as (
  select call, tier, cut, r.page_id as handler from tried t join routed r on len(t.s) = len(r.s) and (t.verb is null or r.verb is null or t.verb = r.verb)
    and case when tier = 0 then t.s = r.s else list_bool_and(list_transform(list_zip(t.s, r.s), lambda p: p[1] = p[2] or p[1] = '{}' or p[2] = '{}')) end),
first as (select * from met qualify rank() over (partition by call order by tier, cut) = 1)"""


@query(rf"""with {_PATHS} select call, min(handler) as handler, ['equal', 'pattern', 'suffix'][any_value(tier) + 1] as tier from first group by call having count(distinct handler) = 1""")
def e11_routes(t):
    """The one route that serves each call of a page's path: wildcards on either side, verbs, longest endings, refusal of two."""
    parts = routes.segments(F.col("url"))
    pages = t.pages.select("page_id", parts.alias("s"))
    number = F.transform("s", lambda x: F.when(x.rlike("^[0-9]+"), "{id}").otherwise(x))
    language = F.transform("s", lambda x: F.when(F.length(x) == 2, ":lang").otherwise(x))
    given = pages.filter("page_id % 2 = 0").select(
        F.col("page_id").alias("handler"), F.expr("case page_id % 3 when 0 then 'GET' when 1 then 'POST' end").alias("verb"),
        F.array_join(F.when(F.col("page_id") % 4 == 0, number).otherwise(F.col("s")), "/").alias("path"),
    )
    own = F.when(F.col("page_id") % 6 == 0, F.concat(F.array(F.lit("api"), F.lit("v1")), "s")).when(F.col("page_id") % 6 == 1, language).otherwise(F.col("s"))
    verb = F.expr("case page_id % 5 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' end").alias("verb")
    calls = pages.filter(F.size("s") > 0).select(F.col("page_id").alias("call"), verb, F.array_join(own, "/").alias("path"))
    return routes.served(calls, given)


# -- generations -------------------------------------------------------------------------------------------------------


def _written_sql(g: int) -> str:
    """Generation g of parts: which files are read, what they hold, and the state after it, from that of g - 1."""
    b = g - 1
    return f"""
changed{g} as (select distinct p_brand as file from part where substr(p_brand, 7)::int % 3 <> {g % 3} or {g} = 1),
new{g} as (
  select p_partkey as key, p_name || p_size % 4 as name, p_brand as file, case when p_partkey % 17 = 0 then 'DOC' else 'METHOD' end as kind,
    p_type || (case when p_partkey % 5 = {g} then '{g}' else '' end) as body, case when p_partkey % 4 = {g % 4} then 'seen {g}' end as evidence
  from part join changed{g} on file = p_brand where p_partkey % 7 <> {g} and p_size % 50 <> {g}),
links{g} as (select distinct key as src, key * 3 % (select count(*) from part) + 1 as dst, case when key % 6 = 0 then 'IMPORTS' else 'CALLS' end as edge_type from new{g}),
nodes{g} as materialized (
  select coalesce(n.key, o.key) as key, coalesce(n.name, o.name) as name, coalesce(n.file, o.file) as file, coalesce(n.kind, o.kind) as kind, coalesce(n.body, o.body) as body,
    case when n.key is null then o.evidence when n.body = o.body then coalesce(n.evidence, o.evidence) else n.evidence end as evidence,
    case when n.key is not null then 'APPROVED' when o.file in (select file from changed{g}) and o.kind not in ('FILE', 'DEPENDENCY', 'DOC') then 'ARCHIVED' else o.status end as status,
    n.key is not null and coalesce(o.status <> 'APPROVED', true) as back
  from nodes{b} o full join new{g} n on o.key = n.key),
alive{g} as (select * from nodes{g} where status = 'APPROVED'),
held{g} as (
  select e.* from edges{b} e left join nodes{b} s on s.key = e.src where s.file is null or s.file not in (select file from changed{g})
  union all select src, dst, edge_type, null from links{g}),
loose{g} as (
  select src, case when dst in (select key from alive{g}) then dst end as dst, edge_type,
    case when dst is null then called when dst not in (select key from alive{g}) then (select name from nodes{g} n where n.key = h.dst) end as called
  from held{g} h where src in (select key from alive{g}) and (dst is null or dst in (select key from alive{g}) or edge_type = 'CALLS')),
lone{g} as (select name as called, min(key) as target from alive{g} group by name having count(*) = 1 and bool_or(back)),
edges{g} as materialized (
  select distinct src, case when l.dst is null and target is not null then target else l.dst end as dst, edge_type, case when l.dst is null and target is null then l.called end as called
  from loose{g} l left join lone{g} on lone{g}.called = l.called)"""


_NONE = """nodes0 as (select 0::bigint as key, '' as name, '' as file, '' as kind, '' as body, '' as evidence, '' as status where false),
edges0 as (select 0::bigint as src, 0::bigint as dst, '' as edge_type, '' as called where false)"""


@query(f"""with {_NONE}, {_written_sql(1)}, {_written_sql(2)}, {_written_sql(3)},
members as (select 1 as generation, key from alive1 union all select 2, key from alive2 union all select 3, key from alive3)
select 'node' as part, key as a, null::bigint as b, status as x, coalesce(evidence, '') || '|' || body as y from nodes3
union all select 'edge', src, dst, edge_type, called from edges3
union all select 'member', key, generation, null, null from members""")
def e23_e24_generations(t):
    """Three generations of parts by brand: nodes, links and membership after the last; calls are lost and found again by name."""
    spark, n = t.spark, t.part.agg(F.count("*").alias("n"))
    graph = generations.start(spark)
    nothing = spark.createDataFrame([], "file string")
    for g in (1, 2, 3):
        changed = t.part.filter(f"cast(substr(p_brand, 7) as int) % 3 <> {g % 3} or {g} = 1").select(F.col("p_brand").alias("file")).distinct()
        new = t.part.withColumnRenamed("p_brand", "file").join(changed, "file").filter(f"p_partkey % 7 <> {g} and p_size % 50 <> {g}").selectExpr(
            "p_partkey as key", "concat(p_name, p_size % 4) as name", "file", "case when p_partkey % 17 = 0 then 'DOC' else 'METHOD' end as kind",
            f"concat(p_type, case when p_partkey % 5 = {g} then '{g}' else '' end) as body", f"case when p_partkey % 4 = {g % 4} then 'seen {g}' end as evidence", "'EXTRACTED' as origin",
        )
        links = new.crossJoin(F.broadcast(n)).selectExpr("key as src", "key * 3 % n + 1 as dst", "case when key % 6 = 0 then 'IMPORTS' else 'CALLS' end as edge_type")
        graph = generations.written(graph, g, changed, new, links, nothing)
    nodes = graph.nodes.selectExpr("'node' as part", "key as a", "cast(null as bigint) as b", "status as x", "concat(coalesce(evidence, ''), '|', body) as y")
    edges = graph.edges.selectExpr("'edge'", "src", "dst", "edge_type", "called")
    return nodes.union(edges).union(graph.members.selectExpr("'member'", "key", "cast(generation as bigint)", "cast(null as string)", "cast(null as string)"))


# -- coverage and packages ---------------------------------------------------------------------------------------------


@query("""with f as (select case when p_partkey % 2 = 0 then '/repo/src/' || p_brand else 'src/' || p_brand end as file, p_size * 2 + p_partkey % 3 as line, p_partkey % 11 as hits from part where p_partkey % 3 > 0),
r as (select case when starts_with(file, '/repo/') then file[7:] else file end as file, line, max(hits) as hits from f where hits > 0 group by all),
m as (select p_partkey as id, 'src/' || p_brand as file, p_size * 2 as start_line from part where p_partkey % 3 = 0),
n as (
  select r.file, line, hits, id from r join m on r.file = m.file and abs(line - start_line) <= 2
  qualify row_number() over (partition by r.file, line order by abs(line - start_line), id) = 1)
select id, max(hits) as hits from n group by id""")
def e22_coverage_marks(t):
    """Covered functions on the nearest methods of their files, which some reports name by absolute paths."""
    file = "concat(case when p_partkey % 2 = 0 then '/repo/src/' else 'src/' end, p_brand) as file"
    functions = t.part.filter("p_partkey % 3 > 0").selectExpr(file, "p_size * 2 + p_partkey % 3 as line", "p_partkey % 11 as hits")
    methods = t.part.filter("p_partkey % 3 = 0").selectExpr("p_partkey as id", "concat('src/', p_brand) as file", "p_size * 2 as start_line")
    return packages.coverage_marks(methods, functions, "/repo")


_PACKAGES = """d as (
  select s_suppkey as id, ['npm', 'pypi', 'maven', 'go', 'cargo'][s_suppkey % 5 + 1] as eco,
    case s_suppkey % 5 when 0 then (case when s_suppkey % 10 = 0 then '@s/' else '' end) || 'Pkg' || s_suppkey when 1 then 'Py_' || s_suppkey % 70 || '.x'
      when 2 then 'org.g' || s_suppkey // 10 || (case when s_suppkey % 10 = 7 then '.sub' else '' end) || ':art' when 3 then 'go/m' || s_suppkey when 4 then 'crate' || s_suppkey end as name from supplier),
i as (
  select c_custkey as id, case c_custkey % 7 when 0 then (case when c_custkey % 2 = 0 then '@s/' else '' end) || 'pkg' || c_custkey % 100 || '/lib/x' when 1 then 'py-' || c_custkey % 70 || '-x.mod' when 2 then 'org.g' || c_custkey % 12 || '.sub.Cls'
    when 3 then 'go/m' || c_custkey % 100 || '/pkg' when 4 then 'Crate' || c_custkey % 100 when 5 then 'crate' || c_custkey % 100 || '.part' else '' end as name from customer)"""


@query(rf"""with {_PACKAGES}, whole as (select lower(name) as key, id from d where eco in ('npm', 'cargo') union all select regexp_replace(lower(name), '[-_.]+', '-', 'g'), id from d where eco = 'pypi'),
exact as (select key, min(id) as id from whole group by key having count(distinct id) = 1),
starts as (select case eco when 'maven' then split_part(lower(name), ':', 1) || '.' when 'go' then lower(name) || '/' else lower(name) || '.' end as key, id from d where eco in ('maven', 'go', 'cargo')),
prefix as (select key, min(id) as id from starts group by key having count(distinct id) = 1),
tries as (
  select id, 0 as r, regexp_extract(lower(name), '^(@[^/]+/[^/]+|[^/]+)', 1) as key from i where name <> ''
  union all select id, 1, regexp_replace(lower(split_part(name, '.', 1)), '[-_.]+', '-', 'g') from i where name <> '' union all select id, 2, lower(name) from i where name <> ''),
first as (select tries.id as imported, exact.id as declared from tries join exact using (key) qualify row_number() over (partition by tries.id order by r) = 1),
rest as (
  select i.id as imported, p.id as declared from i join prefix p on starts_with(lower(i.name) || '.', p.key) or starts_with(lower(i.name) || '/', p.key)
  where name <> '' and i.id not in (select imported from first) qualify row_number() over (partition by i.id order by length(p.key) desc, p.key desc) = 1)
select * from first union all select * from rest""")
def e16_declared_dependencies(t):
    """Imports of five ecosystems to the packages that declare them."""
    d = t.supplier.selectExpr(
        "s_suppkey as id", "array('npm', 'pypi', 'maven', 'go', 'cargo')[cast(s_suppkey % 5 as int)] as ecosystem",
        """case s_suppkey % 5 when 0 then concat(case when s_suppkey % 10 = 0 then '@s/' else '' end, 'Pkg', s_suppkey) when 1 then concat('Py_', s_suppkey % 70, '.x')
          when 2 then concat('org.g', s_suppkey div 10, case when s_suppkey % 10 = 7 then '.sub' else '' end, ':art') when 3 then concat('go/m', s_suppkey) else concat('crate', s_suppkey) end as name""",
    )
    i = t.customer.selectExpr(
        "c_custkey as id",
        """case c_custkey % 7 when 0 then concat(case when c_custkey % 2 = 0 then '@s/' else '' end, 'pkg', c_custkey % 100, '/lib/x') when 1 then concat('py-', c_custkey % 70, '-x.mod') when 2 then concat('org.g', c_custkey % 12, '.sub.Cls')
          when 3 then concat('go/m', c_custkey % 100, '/pkg') when 4 then concat('Crate', c_custkey % 100) when 5 then concat('crate', c_custkey % 100, '.part') else '' end as name""",
    )
    return packages.declared_dependencies(d, i)
