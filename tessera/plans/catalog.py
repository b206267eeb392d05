"""Queries over the driver's tables, each with an independent DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import analytics, coupling, memory, rank, resolve, retrieval, traverse
from tessera.plans.cuts import cut
from tessera.plans.graphview import SQL_EDGES, SQL_NODES, SQL_TOUCHES, SQL_TRADE, Tables, node_id
from tessera.plans.registry import query

_FIRST_BRAND = "(select min(p_brand) from part)"


def _brand(t: Tables) -> DataFrame:
    return t.part.join(F.broadcast(t.part.agg(F.min("p_brand").alias("p_brand"))), "p_brand", "left_semi").select(node_id("PART", "p_partkey").alias("id"))


# -- traversal -----------------------------------------------------------------------------------------------------

_WALK_IN = f"""
with {SQL_EDGES}, {SQL_NODES},
s as (select p_partkey * 8 + 4 as id from part where p_brand = {_FIRST_BRAND}),
h1 as (select distinct src as id from edges join s on dst = s.id),
f1 as (select id from h1 where id not in (select id from s)),
h2 as (select distinct src as id from edges join f1 on dst = f1.id),
f2 as (select id from h2 where id not in (select id from s) and id not in (select id from f1)),
hit as (select id, 1 as depth from f1 union all select id, 2 from f2)
"""


@query(_WALK_IN + "select id, depth, node_type, name, (select count(*) from hit) as total, (select count(*) from hit) > 25 as truncated from hit join nodes using (id) order by depth, (node_type <> 'ORDER')::int, id limit 25")
def g4_blast_radius(t):
    return traverse.blast_radius(t.edges, t.nodes, _brand(t))


@query(_WALK_IN + "select depth, node_type, count(*) as n from hit join nodes using (id) group by all")
def g4_reach_by_depth(t):
    hit = traverse.walk(t.edges, _brand(t), 2, "in").filter("depth > 0")
    return hit.join(t.nodes.select("id", "node_type"), "id").groupBy("depth", "node_type").agg(F.count("*").alias("n"))


@query(f"with {SQL_EDGES}, c as (select dst as id, count(*) as callers from edges where edge_type = 'CALLS' group by dst), o as (select src as id, count(*) as callees from edges where edge_type = 'CALLS' group by src) select id, coalesce(callers, 0) as callers, coalesce(callees, 0) as callees from c full join o using (id)")
def g1_callers_callees(t):
    calls = t.edges.filter("edge_type = 'CALLS'")
    callers, callees = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers")), calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    return callers.join(callees, "id", "full").select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


@query(f"""with {SQL_EDGES}, e as (select * from edges where edge_type = 'CONTAINS'), u as (select src as a, dst as b from e union all select dst, src from e),
s as (select 0::bigint * 8 as id), f1 as (select distinct b as id from u join s on a = s.id where b not in (select id from s)),
f2 as (select distinct b as id from u join f1 on a = f1.id where b not in (select id from s) and b not in (select id from f1)),
n as (select id from s union select id from f1 union select id from f2) select src, dst, edge_type from e where src in (select id from n) and dst in (select id from n)""")
def g2_impact_subgraph(t):
    contains = t.edges.filter("edge_type = 'CONTAINS'")
    seeds = t.region.filter("r_regionkey = 0").select(node_id("REGION", "r_regionkey").alias("id"))
    return traverse.induced(contains, traverse.walk(contains, seeds, 2, "both"))


@query(f"with {SQL_EDGES}, {SQL_NODES}, c as (select n_nationkey::bigint * 8 + 1 as centre from nation), r as (select centre, dst as id, edge_type, 'out' as direction from edges join c on src = centre union all select centre, src, edge_type, 'in' from edges join c on dst = centre), k as (select *, row_number() over (partition by centre order by edge_type, direction, id) as r from r) select centre, k.id, edge_type, direction, node_type, name from k join nodes on k.id = nodes.id where r <= 60")
def g6_neighbours(t):
    return traverse.neighbours(t.edges, t.nodes, t.nation.select(node_id("NATION", "n_nationkey").alias("id")))


@query(f"with {SQL_EDGES}, k as (select *, row_number() over (partition by src, edge_type order by dst) as r from edges) select src, edge_type, count(*) as n from k where r <= 3 group by all")
def o3_fan_out_cap(t):
    return traverse.fan_out_cap(t.edges, 3).groupBy("src", "edge_type").agg(F.count("*").alias("n"))


@query("select l_orderkey as src, l_partkey as dst, min(l_linenumber) as pass from lineitem group by all")
def e_first_writer(t):
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("CALLS").alias("edge_type"), F.col("l_linenumber").alias("pass"))
    return traverse.first_writer(edges, "pass").drop("edge_type")


# -- analytics -----------------------------------------------------------------------------------------------------

@query(f"with {SQL_EDGES}, {SQL_NODES}, i as (select dst as id, round(sum(case edge_type when 'CALLS' then 1.0 when 'DEPENDS_ON' then 0.8 else 0.5 end::double), 6) as score, count(*) as n_in from edges where edge_type <> 'CONTAINS' group by dst), k as (select * from i order by score desc, id limit 10) select k.*, node_type, name from k join nodes using (id)")
def g9_god_nodes(t):
    return analytics.god_nodes(t.edges, t.nodes)


@query(f"with {SQL_EDGES}, {SQL_NODES}, e as (select id, count(*) as c from (select dst as id from edges union all select src from edges) group by id order by c desc, id limit 50) select src, dst, edge_type from edges where src in (select id from e) and dst in (select id from e) union all select scope, id, 'SCOPE' from nodes where id in (select id from e) and scope is not null")
def g13_focused_export(t):
    ends = t.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    top = cut(ends.groupBy("id").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "id").limit(50))
    scope = t.nodes.join(F.broadcast(top.select("id")), "id", "left_semi").filter("scope is not null").select(F.col("scope").alias("src"), F.col("id").alias("dst"), F.lit("SCOPE").alias("edge_type"))
    return traverse.induced(t.edges, top).unionByName(scope)


@query(f"with {SQL_EDGES}, {SQL_NODES} select 'node' as kind, node_type as name, count(*) as n from nodes group by all union all select 'edge', edge_type, count(*) from edges where src in (select id from nodes) and dst in (select id from nodes) group by all")
def g12_graph_stats(t):
    return analytics.graph_stats(t.edges, t.nodes)


@query("select p_partkey * 8 + 4 as id, p_name as name from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_shipdate >= timestamp '1998-01-01')")
def g14_dead_nodes(t):
    used = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.expr("timestamp_ntz '1998-01-01'")))
    edges = used.select(node_id("ORDER", "l_orderkey").alias("src"), node_id("PART", "l_partkey").alias("dst"), F.lit("CALLS").alias("edge_type")).distinct()
    return analytics.dead_nodes(edges, t.nodes, "PART", ("CALLS",)).select("id", "name")


@query("select p_partkey, p_brand, p_size, row_number() over (partition by p_brand order by p_size desc, p_partkey)::int as rank from part qualify rank <= 5")
def g15_most_complex(t):
    return rank.top_per(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], 5)


@query("select p_brand, count(*) as n, max(p_size) as worst, round(avg(p_size), 6) as mean from part group by p_brand having count(*) > 10")
def g15_complexity_by_file(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("worst"), F.round(F.avg("p_size"), 6).alias("mean")).filter("n > 10")


@query("select p_partkey, p_name, p_type from part where p_brand = (select min(p_brand) from part) order by p_partkey limit 100")
def g16_file_symbols(t):
    first = F.broadcast(t.part.agg(F.min("p_brand").alias("p_brand")))
    return t.part.join(first, "p_brand", "left_semi").select("p_partkey", "p_name", "p_type").orderBy("p_partkey").limit(100)


@query(f"""with {SQL_TRADE}, m as (select avg(weight) as m from trade), e as (select src, dst from trade, m where weight > m * 1.2 and src <> dst)
select 2 as n, a.src || '>' || a.dst as path from e a join e b on a.dst = b.src and b.dst = a.src where a.src < a.dst
union all select 3, a.src || '>' || a.dst || '>' || b.dst from e a join e b on a.dst = b.src join e c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.src < b.dst and b.dst <> a.dst""")
def g11_cycles(t):
    heavy = t.trade.crossJoin(F.broadcast(t.trade.agg(F.avg("weight").alias("m")))).filter("weight > m * 1.2")
    return analytics.cycles(heavy, 3)


@query("""with recursive e as (select distinct s_nationkey as src, s_suppkey % 7 + s_nationkey // 7 * 7 as dst from supplier where s_suppkey % 3 = 0 and s_suppkey % 7 + s_nationkey // 7 * 7 <> s_nationkey),
p as (select [src, dst] as path from e where src < dst union all select list_append(path, dst) from p join e on p.path[-1] = e.src where e.dst > p.path[1] and not list_contains(path, e.dst))
select len(path)::int as n, array_to_string(path, '>') as path from p join e on p.path[-1] = e.src and p.path[1] = e.dst""")
def g11_cycles_any_length(t):
    ring = F.expr("s_suppkey % 7 + s_nationkey div 7 * 7")
    edges = t.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_nationkey").cast("long").alias("src"), ring.cast("long").alias("dst"))
    return analytics.cycles(edges, None)


def _ppr_sql(rounds: int = 8) -> str:
    ctes = [SQL_TRADE, """b as (select src, dst, sum(weight)::double as w from (select src, dst, weight from trade where src <> dst union all select dst, src, weight from trade where src <> dst) group by all),
p as (select src, dst, w / sum(w) over (partition by src) as p from b), ids as (select distinct src as id from b),
r0 as (select id, case when id in (0, 1, 2) then 1.0 / 3 else 0.0 end::double as s, case when id in (0, 1, 2) then 1.0 / 3 else 0.0 end::double as r from ids)"""]
    for k in range(rounds):
        ctes.append(f"r{k + 1} as (select r{k}.id, r{k}.s, 0.85 * coalesce(g.got, 0) + 0.15 * r{k}.s as r from r{k} left join (select dst as id, sum(r * p) as got from r{k} join p on r{k}.id = p.src group by dst) g using (id))")
    return f"with {', '.join(ctes)} select id, round(r, 6) as rank from r{rounds}"


@query(_ppr_sql())
def g3_personalised_pagerank(t):
    seeds = t.nation.filter("n_nationkey in (0, 1, 2)").select(F.col("n_nationkey").alias("id"))
    return analytics.pagerank(t.trade, seeds, rounds=8, tolerance=None)


@query("""with b as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 3), a as (select o_orderkey, o_orderstatus, case when o_orderkey % 10 = 5 then 0 else o_totalprice end as o_totalprice from orders where o_orderkey % 10 <> 4)
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'removed' else 'changed' end as change from a full join b on a.o_orderkey = b.o_orderkey
where a.o_orderkey is null or b.o_orderkey is null or a.o_orderstatus is distinct from b.o_orderstatus or a.o_totalprice is distinct from b.o_totalprice""")
def g17_graph_diff(t):
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").filter("o_orderkey % 10 <> 3")
    new = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.expr("o_orderkey % 10 = 5"), 0).otherwise(F.col("o_totalprice")).alias("o_totalprice")).filter("o_orderkey % 10 <> 4")
    return analytics.snapshot_diff(old, new, "o_orderkey")


@query("""with b as (select o_orderkey, case when o_orderkey % 7 in (1, 2) then null else o_orderstatus end as x, case when o_orderkey % 7 in (1, 3) then null else o_orderstatus end as y from orders where o_orderkey % 10 <> 3),
a as (select o_orderkey, case when o_orderkey % 7 in (1, 3) then null else o_orderstatus end as x, case when o_orderkey % 7 in (1, 2, 4) then null else o_orderstatus end as y from orders where o_orderkey % 10 <> 4)
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'removed' else 'changed' end as change
from b full join a on a.o_orderkey = b.o_orderkey where b.o_orderkey is null or a.o_orderkey is null or a.x is distinct from b.x or a.y is distinct from b.y""")
def g17_graph_diff_nulls(t):
    kept = lambda name, *gone: F.when(~(F.col("o_orderkey") % 7).isin(*gone), F.col("o_orderstatus")).alias(name)
    old = t.orders.filter("o_orderkey % 10 <> 3").select("o_orderkey", kept("x", 1, 2), kept("y", 1, 3))
    new = t.orders.filter("o_orderkey % 10 <> 4").select("o_orderkey", kept("x", 1, 3), kept("y", 1, 2, 4))
    return analytics.snapshot_diff(old, new, "o_orderkey")


@query("with n as (select (select count(*) from orders where o_orderdate < timestamp '1997-01-01') as before, (select count(*) from orders where o_orderdate < timestamp '1996-01-01') as after) select before, after, round(1 - after / before, 6) as loss, case when 1 - after / before > 0.3 then 'DEGRADED' else 'ACTIVE' end as verdict from n")
def g20_shrink_guard(t):
    return analytics.shrink_guard(t.orders.filter("o_orderdate < timestamp_ntz '1997-01-01'"), t.orders.filter("o_orderdate < timestamp_ntz '1996-01-01'"))


@query("select c_custkey, max(o_orderdate) as head, case when max(o_orderdate) is null then 'unknown' when max(o_orderdate) < timestamp '1998-01-01' then 'stale' else 'fresh' end as state from customer left join orders on c_custkey = o_custkey group by all")
def g18_staleness(t):
    head = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("head"))
    state = F.when(F.col("head").isNull(), "unknown").when(F.col("head") < F.expr("timestamp_ntz '1998-01-01'"), "stale").otherwise("fresh")
    return t.customer.select("c_custkey").join(head, "c_custkey", "left").withColumn("state", state)


# -- coupling ------------------------------------------------------------------------------------------------------

_SIZED = f"with {SQL_TOUCHES}, z as (select commit from touches group by commit having count(*) between 2 and 20), t as (select touches.* from touches semi join z using (commit))"


@query(_SIZED + "select a.item as a, b.item as b, count(*) as n from t a join t b on a.commit = b.commit and a.item < b.item group by all having count(*) >= 3")
def p1_coupled_pairs(t):
    return coupling.pairs(t.touches)


_COCHANGE = _SIZED + """, w as (select *, pow(0.5, (epoch((select max(ts) from t)) - epoch(ts)) / 86400 / 1095) as w from t),
c as (select a.item as src, b.item as dst, count(*) as n, sum(a.w) as support from w a join w b on a.commit = b.commit and a.item <> b.item group by all having count(*) >= 3),
o as (select item, count(*) as own from t group by item),
r as (select src, dst, n, round(least(1.0, n / own), 2) as confidence, round(support, 6) as support from c join o on src = item)
"""


@query(_COCHANGE + "select * from r")
def p3_co_changes(t):
    return coupling.co_changes(t.touches)


@query(_COCHANGE + "select src, dst, confidence, n, row_number() over (partition by src order by confidence desc, n desc, dst)::int as rank from r qualify rank <= 2")
def g8_changes_with(t):
    return rank.top_per(coupling.co_changes(t.touches).drop("support"), ["src"], [F.desc("confidence"), F.desc("n"), F.col("dst")], 2)


@query(_COCHANGE + "select src as id, count(*) as churn from r group by src order by churn desc, id limit 10")
def g10_churn_hotspots(t):
    return coupling.co_changes(t.touches).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("churn")).orderBy(F.desc("churn"), "id").limit(10)


@query(f"with {SQL_TOUCHES}, s as (select epoch(min(ts))::bigint as a, epoch(max(ts))::bigint as b from touches) select item, count(*) as n, round(count(*) filter (epoch(ts)::bigint >= b - 0.25 * (b - a)) / count(*) / 0.25, 6) as volatility from touches, s group by item")
def p6_volatility(t):
    return coupling.volatility(t.touches)


@query("with o as (select l_orderkey, count(distinct l_suppkey) as files, count(distinct l_partkey) as nodes, count(*) filter (l_returnflag = 'N') as added, count(*) filter (l_returnflag = 'R') as removed from lineitem group by all) select l_orderkey, case when files > 8 or nodes > 12 then 'bulk' when added > 0 and removed = 0 then 'additive' when removed > 0 then 'alter' else 'unknown' end as change from o")
def p4_change_type(t):
    o = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("f"), F.count_distinct("l_partkey").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return o.select("l_orderkey", coupling.change_type(F.col("f"), F.col("n"), F.col("a"), F.col("r")).alias("change"))


@query("with d as (select o_orderkey, (epoch(timestamp '1999-01-01') - epoch(o_orderdate)) / 86400 as age from orders) select o_orderkey, round(pow(0.5, age / 1095), 6) as exponential, round(greatest(0.05, 1 - age / 1095), 6) as linear from d")
def p5_decay(t):
    age = coupling.age_days(F.col("o_orderdate"), F.lit("1999-01-01"))
    return t.orders.select("o_orderkey", F.round(coupling.decay(age), 6).alias("exponential"), F.round(coupling.decay(age, "linear"), 6).alias("linear"))


# -- retrieval -----------------------------------------------------------------------------------------------------

_NEEDLES = "n(q, needle) as (values (1, 'ivory'), (1, 'blue'), (2, 'st'), (3, 'Customer#000000012'), (3, '00012'))"


def _needles(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "ivory"), (1, "blue"), (2, "st"), (3, "Customer#000000012"), (3, "00012")], "q int, needle string")


_EXACT = f"""{SQL_NODES}, {_NEEDLES}, m as (select q, id, name, case when lower(name) = lower(needle) then 1.0 when starts_with(lower(name), lower(needle)) then 0.75 when contains(lower(name), lower(needle)) then 0.6 else 0 end::double as score from nodes, n),
b as (select q, id, max(score) as score, count(*) as hits, any_value(name) as name from m where score > 0 group by q, id),
k as (select *, count(*) over (partition by q, score) as pop, rank() over (partition by q, score order by hits desc, id) as r from b),
ex as (select q, id, score, hits, row_number() over (partition by q order by score desc, hits desc, length(name), id)::int as rank from k where pop <= 16 or r <= 8 qualify rank <= 16)"""


@query(f"with {_EXACT} select * from ex")
def t1_exact_channel(t):
    return retrieval.exact(t.nodes, _needles(t))


_GRAPH = f"""{SQL_EDGES}, {_EXACT}, sd as (select q, id from (select q, id, row_number() over (partition by q order by score desc, id) as r from ex) where r <= 12),
g0 as (select q, dst as id from sd join edges on sd.id = src union select q, src from sd join edges on sd.id = dst),
g as (select q, id, 0.42::double as score, row_number() over (partition by q order by id)::int as rank from g0 where (q, id) not in (select q, id from sd) qualify rank <= 12)"""


def _graph(t: Tables, found: DataFrame) -> DataFrame:
    return retrieval.graph_channel(t.edges, found, ("CALLS", "CONTAINS", "DEPENDS_ON"))


@query(f"with {_GRAPH} select * from g")
def t4_graph_channel(t):
    return _graph(t, retrieval.exact(t.nodes, _needles(t)))


@query(f"with {_GRAPH}, u as (select q, id, score, 0 as k, 'exact' as c from ex union all select q, id, score, 1, 'graph' from g) select q, id, max(score) as score, string_agg(c, ',' order by k) as channels, min(k)::int as first from u group by q, id")
def t5_channel_union(t):
    found = retrieval.exact(t.nodes, _needles(t))
    return rank.union_channels({"exact": found, "graph": _graph(t, found)})


@query(f"with {_GRAPH}, u as (select q, id, 0 as k from ex union all select q, id, 1 from g), f as (select q, id, min(k) as k from u group by q, id) select case k when 0 then 'exact' else 'graph' end as channel, count(*) as n from f group by all")
def t6_first_claim(t):
    found = retrieval.exact(t.nodes, _needles(t))
    return rank.first_claim({"exact": found, "graph": _graph(t, found)})


@query("""with l as (select doc_id, string_split(text, chr(10)) as l from documents), c as (select doc_id, l, unnest(range(0, ceil(greatest(len(l) - 60, 0) / 45)::int + 1))::int as chunk from l)
select doc_id, chunk, chunk * 45 + 1 as start_line, least(chunk * 45 + 60, len(l))::int as end_line, array_to_string(l[chunk * 45 + 1:chunk * 45 + 60], chr(10)) as text from c""")
def t21_chunks(t):
    return retrieval.chunks(t.documents, "doc_id", "text")


# -- expressions ---------------------------------------------------------------------------------------------------

@query("select doc_id, left(sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10))), 16) as fingerprint from documents")
def c19_line_fingerprint(t):
    return t.documents.select("doc_id", X.line_fingerprint(F.col("text")).alias("fingerprint"))


@query(r"select page_id, '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda s: s <> '' and not regexp_matches(s, '^v[0-9]+$')), lambda s: case when regexp_matches(s, '^(\{.*\}|:.+|<.+>|[0-9]+)$') then '{}' else s end), '/') as path from pages")
def c15_url_path(t):
    return t.pages.select("page_id", X.url_path(F.col("url")).alias("path"))


_ENTITY = """array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || case p_partkey % 6 when 0 then 'Box' when 1 then 'Baby' when 2 then 'Bus' when 3 then 'Day' when 4 then 'Watch' else '' end"""


@query(rf"""with e as (select p_partkey, {_ENTITY} as entity, case when p_partkey % 7 = 0 then 'T_' || p_size when p_partkey % 7 = 1 then '' end as given from part),
s as (select *, lower(regexp_replace(entity, '([a-z0-9])([A-Z])', '\1_\2', 'g')) as snake from e),
p as (select *, case when regexp_matches(snake, '(s|x|z|ch|sh)$') then snake || 'es' when regexp_matches(snake, '[^aeiou]y$') then snake[:-2] || 'ies' else snake || 's' end as plural from s)
select p_partkey, snake, plural, case when given <> '' then given else plural end as table_name from p""")
def c17_snake_case(t):
    """Names of tables: what an entity states, else the plural of its name in snake case."""
    entity = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.expr("case p_partkey % 6 when 0 then 'Box' when 1 then 'Baby' when 2 then 'Bus' when 3 then 'Day' when 4 then 'Watch' else '' end"))
    given = F.expr("case when p_partkey % 7 = 0 then concat('T_', p_size) when p_partkey % 7 = 1 then '' end")
    snake = X.snake_case(entity)
    return t.part.select("p_partkey", snake.alias("snake"), X.plural(snake).alias("plural"), X.table_name(given, entity).alias("table_name"))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '(?i)\b(bearer\s+)[A-Za-z0-9._-]{8,}', '\1[token]', 'g'), '\b[A-Fa-f0-9]{32,}\b', '[hex]', 'g') as text from documents")
def c26_redact(t):
    return t.documents.select("doc_id", X.redact(F.col("text")).alias("text"))


@query("""with a as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as w from benchmark)
select a.item_id as a, b.item_id as b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) as jaccard from a join a b on a.item_id < b.item_id where len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.15""")
def c21_jaccard(t):
    return resolve.similar_sets(t.benchmark.select("item_id", X.terms(F.col("text")).alias("w")), "item_id", "w", 0.15).withColumnRenamed("similarity", "jaccard")


@query("select levenshtein(a.n_name, b.n_name)::int as distance, a.n_name as a, b.n_name as b from nation a join nation b on a.n_nationkey < b.n_nationkey where levenshtein(a.n_name, b.n_name) <= 3")
def c32_near_misses(t):
    names = t.nation.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a"))
    return resolve.near_misses(names, names.toDF("j", "b")).filter("i < j").select("distance", "a", "b")


@query("select event_id, json_extract_string(props, '$.page') as page, json_type(props) as kind from events")
def c5_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"), X.json_kind(F.col("props")).alias("kind"))


# -- resolution ----------------------------------------------------------------------------------------------------

@query("""with c as (select o_orderkey, 0 as rung, p_brand as target from orders join part on p_size = o_orderkey % 97 union all select o_orderkey, 1, s_name from orders join supplier on s_nationkey = o_custkey % 31),
u as (select o_orderkey, rung, count(distinct target) as n, min(target) as target from c group by all having count(distinct target) = 1)
select o_orderkey, target, rung::int as rung from u qualify row_number() over (partition by o_orderkey order by rung) = 1""")
def e1_unique_or_refuse(t):
    references = t.orders.select("o_orderkey", (F.col("o_orderkey") % 97).alias("size"), (F.col("o_custkey") % 31).alias("nation"))
    by_size = t.part.select(F.col("p_size").cast("long").alias("key"), F.col("p_brand").alias("target"))
    by_nation = t.supplier.select(F.col("s_nationkey").cast("long").alias("key"), F.col("s_name").alias("target"))
    return resolve.ladder(references, ["o_orderkey"], [("size", by_size), ("nation", by_nation)])


@query("""with c as (select c_custkey, s_suppkey, c_nationkey = s_nationkey as near from customer join supplier on c_custkey % 10 = s_suppkey % 10), n as (select *, max(near) over (partition by c_custkey) as any_near from c),
k as (select c_custkey, s_suppkey from n where near or not any_near), f as (select *, count(*) over (partition by c_custkey) as n from k) select c_custkey, s_suppkey, case when n <= 3 then 'CALLS' else 'HEURISTIC_CALLS' end as edge_type from f where n <= 10""")
def e2_narrow_and_fan_out(t):
    references = t.customer.select("c_custkey", (F.col("c_custkey") % 10).alias("key"), F.col("c_nationkey").alias("nation"))
    declared = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 10).alias("key"), F.col("s_nationkey").alias("nation"))
    return resolve.narrow_and_fan_out(references, declared, "key", "nation").select("c_custkey", "s_suppkey", "edge_type")


@query("""with x as (select distinct p_type, unnest(range(1, len(string_split(p_type, ' ')) + 1)) as k from part), c as (select p_type, k, array_to_string(string_split(p_type, ' ')[1:k], ' ') as p from x),
r as (select distinct array_to_string(string_split(p_type, ' ')[1:1], ' ') as p, left(p_type, 1) as target from part), h as (select p_type, k, c.p, target from c join r on c.p = r.p), b as (select * from h qualify k = max(k) over (partition by p_type)),
o as (select p_type, min(target) as target, min(p) as prefix from b group by p_type having count(distinct target) = 1) select p_partkey, part.p_type, target, prefix from part join o on part.p_type = o.p_type""")
def j11_longest_prefix(t):
    known = t.part.select(F.split("p_type", " ")[0].alias("p"), F.substring("p_type", 1, 1).alias("target"))
    return resolve.longest_prefix(t.part.select("p_partkey", "p_type"), known, "p_type", "p", "target")


@query("""with u as (select distinct regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages), s as (select path, unnest(range(1, len(string_split(path, '/')) + 1)) as k from u), c as (select path, k as length, array_to_string(string_split(path, '/')[-k:], '/') as suffix from s),
r as (select distinct array_to_string(string_split(path, '/')[-2:], '/') as suffix, path as target from u where ascii(path) % 2 = 0), h as (select path, length, target from c join r using (suffix)), b as (select * from h qualify length = max(length) over (partition by path))
select path, min(target) as target, max(length)::int as length from b group by path having count(distinct target) = 1""")
def j12_suffix_match(t):
    u = t.pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()
    known = u.filter(F.ascii("path") % 2 == 0).select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("suffix"), F.col("path").alias("target"))
    return resolve.suffix_match(u, known, "path", "target", "suffix")


@query("""with s as (select p_brand as file, p_partkey as span_id, p_size as start_line, p_size + p_partkey % 13 as end_line from part), p as (select distinct p_brand as file, p_size + 2 as line from part)
select p.file, p.line, span_id, start_line, end_line from p join s on p.file = s.file and line between start_line and end_line qualify row_number() over (partition by p.file, line order by (end_line = start_line)::int, end_line - start_line, span_id) = 1""")
def j7_innermost_span(t):
    spans = t.part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("span_id"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 13).alias("end_line"))
    points = t.part.select(F.col("p_brand").alias("file"), (F.col("p_size") + 2).alias("line")).distinct()
    return resolve.innermost(points, spans, "file", "line")


@query("""with l as (select distinct p_brand as file, p_size as line from part where p_partkey % 3 = 0), r as (select p_brand as file, p_partkey, p_size as def_line from part where p_partkey % 7 = 1)
select l.file, line, p_partkey, def_line, abs(line - def_line) as distance from l join r on l.file = r.file and abs(line - def_line) <= 2 qualify row_number() over (partition by l.file, line order by abs(line - def_line), p_partkey) = 1""")
def j8_nearest_line(t):
    left = t.part.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("file"), F.col("p_size").alias("line")).distinct()
    right = t.part.filter("p_partkey % 7 = 1").select(F.col("p_brand").alias("file"), "p_partkey", F.col("p_size").alias("def_line"))
    return resolve.nearest(left, right, "file", "line", "def_line", 2, "p_partkey")


@query("""with u as (select distinct regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages), s as (select path, unnest(range(1, len(string_split(path, '/')))) as k from u where len(string_split(path, '/')) > 1)
select distinct array_to_string(string_split(path, '/')[1:k], '/') as parent, array_to_string(string_split(path, '/')[1:k + 1], '/') as child from s""")
def e9_directory_tree(t):
    return resolve.directory_tree(t.pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")), "path")


@query("with a as (select p_brand, p_size, min(p_partkey) as a_id from part where p_partkey % 2 = 0 group by all having count(*) = 1), b as (select p_brand, p_size, min(p_partkey) as b_id from part where p_partkey % 2 = 1 group by all having count(*) = 1) select * from a join b using (p_brand, p_size)")
def e15_plane_join(t):
    side = lambda k, name: t.part.filter(f"p_partkey % 2 = {k}").select("p_brand", "p_size", F.col("p_partkey").alias(name))
    return resolve.plane_join(side(0, "a_id"), side(1, "b_id"), ["p_brand", "p_size"], "a_id", "b_id")


@query("""with s as (select distinct l_partkey, l_suppkey from lineitem where l_shipdate < timestamp '1996-01-01'), r as (select distinct l_partkey, l_suppkey from lineitem where l_shipdate >= timestamp '1996-01-01')
select verdict, count(*) as n from (select case when s.l_partkey is null then 'runtime_only' when r.l_partkey is null then 'static_only' else 'confirmed' end as verdict from s full join r on s.l_partkey = r.l_partkey and s.l_suppkey = r.l_suppkey) group by verdict""")
def e21_runtime_merge(t):
    cut = F.col("l_shipdate") < F.expr("timestamp_ntz '1996-01-01'")
    return resolve.runtime_merge(t.lineitem.filter(cut), t.lineitem.filter(~cut), ["l_partkey", "l_suppkey"]).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""with o as (select o_orderkey, o_orderstatus as body, o_orderpriority as evidence from orders where o_orderkey % 10 <> 3), n as (select o_orderkey, case when o_orderkey % 10 = 5 then 'X' else o_orderstatus end as body, case when o_orderkey % 4 = 0 then o_orderpriority end as evidence from orders where o_orderkey % 10 <> 4)
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when n.o_orderkey is null then o.body else n.body end as body,
case when n.o_orderkey is null then o.evidence when n.body is not distinct from o.body then coalesce(n.evidence, o.evidence) else n.evidence end as evidence, case when n.o_orderkey is null then 'ARCHIVED' else 'APPROVED' end as status from o full join n on o.o_orderkey = n.o_orderkey""")
def e23_replace_changed(t):
    old = t.orders.filter("o_orderkey % 10 <> 3").select("o_orderkey", F.col("o_orderstatus").alias("body"), F.col("o_orderpriority").alias("evidence"))
    new = t.orders.filter("o_orderkey % 10 <> 4").select("o_orderkey", F.when(F.expr("o_orderkey % 10 = 5"), "X").otherwise(F.col("o_orderstatus")).alias("body"), F.when(F.expr("o_orderkey % 4 = 0"), F.col("o_orderpriority")).alias("evidence"))
    return resolve.replace_changed(old, new, "o_orderkey", "body", "evidence")


@query("""with t as (select p_brand, p_size, count(*) as t from part where p_partkey % 3 > 0 group by all), s as (select p_brand, p_size, count(*) as s from part where p_partkey % 3 < 2 group by all), b as (select coalesce(t, 0) as t, coalesce(s, 0) as s from t full join s using (p_brand, p_size))
select sum(least(t, s))::bigint as matched, sum(t)::bigint as truth, sum(s)::bigint as system, round(sum(least(t, s)) / sum(t), 6) as recall, round(sum(least(t, s)) / sum(s), 6) as precision from b""")
def a9_multiset_score(t):
    return resolve.multiset_score(t.part.filter("p_partkey % 3 > 0"), t.part.filter("p_partkey % 3 < 2"), ["p_brand", "p_size"])


# -- memory --------------------------------------------------------------------------------------------------------

_EVENTS = "e as (select event_id as id, user_id as scope, ts, event_type as kind, event_type as shape, value from events)"
_SESSION = _EVENTS + ", i as (select *, case when epoch(ts) - lag(epoch(ts)) over (partition by scope order by ts, id) > {gap} then 1 else 0 end as new from e), x as (select *, sum(new) over (partition by scope order by ts, id)::bigint as session from i)"


def _events(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("scope"), "ts", F.col("event_type").alias("kind"), F.col("event_type").alias("shape"), "value")


@query("with " + _SESSION.format(gap=43200) + " select scope, session, count(*) as n, min(id) as first, max(id) as last from x group by all")
def r23_sessions(t):
    return memory.sessions(_events(t), 43_200).groupBy("scope", "session").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("with " + _EVENTS + ", i as (select *, case when kind is not distinct from lag(kind) over (partition by scope order by ts, id) then 0 else 1 end as new from e), x as (select *, sum(new) over (partition by scope order by ts, id)::bigint as island from i) select scope, island, min(kind) as kind, count(*) as n from x group by scope, island having count(*) > 1")
def r22_islands(t):
    return memory.islands(_events(t), ["kind"]).groupBy("scope", "island").agg(F.min("kind").alias("kind"), F.count("*").alias("n")).filter("n > 1")


_FAILFIX = "with " + _SESSION.format(gap=259200) + """, f as (select *, last_value(case when kind = 'error' then id end ignore nulls) over (partition by scope, session order by ts, id rows between unbounded preceding and 1 preceding) as fail_id from x),
g as (select *, coalesce(count(*) filter (kind = 'purchase') over (partition by scope, session, fail_id order by ts, id rows between unbounded preceding and 1 preceding), 0) as passes from f where fail_id is not null and kind in ('purchase', 'click', 'view')),
o as (select scope, session, fail_id, count(*) filter (kind <> 'purchase') as edits, max(case when kind = 'purchase' then id end) as pass_id from g where passes = 0 group by all)
"""


@query(_FAILFIX + "select *, case when edits > 0 then 'observation' else 'flaky' end as verdict from o where pass_id is not null")
def r24_fail_fix(t):
    return memory.fail_fix(_events(t), "error", ("click", "view"), "purchase", 259_200)


@query(_FAILFIX + "select case when edits > 0 then 'observation' else 'flaky' end as verdict, count(*) as n, count(distinct scope) as scopes, count(distinct (scope, session)) as sessions, min(fail_id) as first, max(fail_id) as last from o where pass_id is not null group by 1")
def r26_recurrence(t):
    return memory.recurrence(memory.fail_fix(_events(t), "error", ("click", "view"), "purchase", 259_200), "verdict")


@query("with " + _EVENTS + ", b as (select scope, shape, count(*) as fails, min((ts, id)) as f from e where value < 20 group by all having count(*) >= 2), g as (select scope, shape, max((ts, id)) as l from e where value >= 20 or value is null group by all) select scope, shape, fails, f[2] as first_fail from b left join g using (scope, shape) where l is null or l < f")
def r28_dead_commands(t):
    return memory.dead_commands(_events(t), F.coalesce(F.col("value") < 20, F.lit(False)))


@query("with " + _EVENTS + """, m as (select *, (value < 20)::int as bad, (epoch(max(ts) over (partition by scope)) - epoch(ts)) / 86400 as age from e where value is not null),
s as (select *, case when bad = 1 and sum(1 - bad) over (partition by scope, shape order by ts desc, id desc) = 0 then 1 else 0 end as streak from m),
o as (select scope, shape, sum(1 - bad)::bigint as passes, sum(bad)::bigint as fails, round(sum(pow(0.5, age / 30) * (1 - bad)), 6) as weight, sum(streak)::bigint as streak from s group by all)
select * from o where streak <= 1 and passes >= 5 and weight >= 3 and fails / (fails + passes) <= 0.25""")
def r29_rituals(t):
    return memory.rituals(_events(t).filter("value is not null"), F.col("value") < 20)


@query("with e as (select conv_id, turn, role, text, sum((role = 'user')::int) over (partition by conv_id order by turn)::bigint as episode from conversations) select conv_id, episode, count(*) as turns, count(*) filter (role = 'assistant') as answers, min(turn) as first, max(turn) as last from e group by all")
def r30_episodes(t):
    e = memory.episodes(t.conversations, "conv_id", "turn", F.col("role") == "user")
    return e.groupBy("conv_id", "episode").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("with n as (select role, turn, trim(regexp_replace(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g')) as norm from conversations) select role, norm, count(*) as mentions, min(turn) as first, max(turn) as last from n where norm <> '' group by all")
def r37_open_loops(t):
    return memory.merge_mentions(t.conversations, "role", "text", "turn")


@query("""with r as (select s_nationkey, s_suppkey, length(s_name) + (s_suppkey % 40)::int as cost, s_acctbal from supplier), w as (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn, sum(cost) over (partition by s_nationkey order by s_acctbal desc, s_suppkey)::bigint as spent from r)
select s_nationkey, s_suppkey, rn::int as rn, spent from w where rn = 1 or spent <= 120""")
def o5_budget_prefix(t):
    r = t.supplier.select("s_nationkey", "s_suppkey", (F.length("s_name") + F.col("s_suppkey") % 40).alias("cost"), "s_acctbal")
    return rank.budget_prefix(r, ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], "cost", 120).select("s_nationkey", "s_suppkey", "rn", "spent")


@query("""with a as (select 'c' as list, c_nationkey as k, c_custkey as id, row_number() over (partition by c_nationkey order by c_custkey) * 2 - 1 as slot from customer), b as (select 's' as list, s_nationkey as k, s_suppkey as id, row_number() over (partition by s_nationkey order by s_suppkey) * 2 as slot from supplier) select list, k, id, slot::int as slot from a union all select list, k, id, slot::int from b""")
def o6_interleave(t):
    a = t.customer.select(F.lit("c").alias("list"), F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    b = t.supplier.select(F.lit("s").alias("list"), F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return rank.interleave(a, b, ["k"], [F.col("id")])


@query("select event_type, date_trunc('day', ts)::timestamp as day, count(*) as n, count(*) filter (value is null) as no_value, count(distinct user_id) as users from events group by all")
def r40_digest(t):
    return t.events.groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("no_value"), F.count_distinct("user_id").alias("users"))


# -- relational forms ----------------------------------------------------------------------------------------------

@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1))")
def f1_scope_filter(t):
    scope = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    live = t.customer.join(F.broadcast(scope), "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(live, "o_custkey", "left_semi")


@query("select p_partkey, p_name from part where p_name ilike '%st\\_%' escape '\\' or p_name ilike '%blue%'")
def f5_ilike(t):
    return t.part.filter(F.col("p_name").ilike(r"%st\_%") | F.col("p_name").ilike("%blue%")).select("p_partkey", "p_name")


def _brands(t: Tables, suppliers: DataFrame) -> DataFrame:
    rows = suppliers.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left")
    out = rows.groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.substring("p_brand", 1, 7))), ",").alias("brands"), F.count_distinct("l_partkey").alias("parts"))
    return out.filter("parts > 1")


@query("select s_suppkey, string_agg(distinct left(p_brand, 7), ',' order by left(p_brand, 7)) as brands, count(distinct l_partkey) as parts from supplier left join lineitem on s_suppkey = l_suppkey left join part on p_partkey = l_partkey group by s_suppkey having count(distinct l_partkey) > 1")
def a5_group_concat(t):
    return _brands(t, t.supplier)


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n, count(*) filter (l_quantity > 25) as large, max(l_tax) as max_tax from lineitem group by all")
def a1_grouped_sums(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.max("l_tax").alias("max_tax"))


@query("""
with d as (select p_brand as file, p_type as name, min(p_size) as fp from part where p_partkey % 20 = 1 group by all),
a as (select p_partkey as fact, p_brand as file, p_type as name, p_size as fp from part where p_partkey % 4 = 0)
select fact, case when d.fp = a.fp then 'ok' when d.fp is not null then 'unconfirmed' when a.fp in (select fp from d) then 'moved' else 'orphaned' end as verdict
from a left join d using (file, name)
""")
def r33_revalidate(t):
    part = t.part.select(F.col("p_partkey").alias("fact"), F.col("p_brand").alias("file"), F.col("p_type").alias("name"), F.col("p_size").alias("fp"))
    now = part.filter("fact % 20 = 1").groupBy("file", "name").agg(F.min("fp").alias("fp"))
    return memory.revalidate(part.filter("fact % 4 = 0"), now)
