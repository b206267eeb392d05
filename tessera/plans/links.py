"""Linking, merging, memory and export operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import inherit, memory, rank, retrieval
from tessera.plans.graphview import SQL_EDGES, SQL_NODES, node_id
from tessera.plans.registry import query
from tessera.sources import exports, files, manifests
from tessera.streaming import events as streams

# -- chains of declarations ------------------------------------------------------------------------------------------

_FORWARD = "fw as (select c_custkey as src, c_custkey // 3 as dst from customer where c_custkey % 4 <> 1 and c_custkey > 0)"


def _forwards(t):
    return t.customer.filter("c_custkey % 4 <> 1 and c_custkey > 0").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 3").alias("dst"))


@query(f"""with recursive {_FORWARD}, w as (select src, dst, 1 as hops from fw union all select w.src, fw.dst, hops + 1 from w join fw on w.dst = fw.src where hops < 4)
select src, dst as target, hops::int as hops from w where dst not in (select src from fw)""")
def e4_reexport_chase(t):
    return inherit.chase(_forwards(t), 4)


@query(f"""with recursive {_FORWARD}, m as (select c_custkey as id, c_mktsegment as name from customer where c_custkey % 2 = 0),
w as (select src, dst, 1 as depth from fw union all select w.src, fw.dst, depth + 1 from w join fw on w.dst = fw.src where depth < 5),
a as (select id, name, id as owner, 0 as depth from m union all select src, name, dst, depth from w join m on dst = m.id)
select id, name, owner, depth::int as depth from a qualify row_number() over (partition by id, name order by depth, owner) = 1""")
def e12_inherited_members(t):
    members = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    return inherit.inherited(_forwards(t), members)


_BASES = "ba as (select distinct p_brand as src, 'Brand#' || (substr(p_brand, 7)::int + 1) as dst from part)"
_OVERRIDES = f"{_BASES}, ov as (select distinct a.p_partkey as src, b.p_partkey as dst from part a join ba on a.p_brand = ba.src join part b on b.p_brand = ba.dst and lower(b.p_name || ' ' || b.p_type) = lower(a.p_name || ' ' || a.p_type))"


def _declared(t):
    bases = t.part.select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), (F.substring("p_brand", 7, 9).cast("int") + 1).cast("string")).alias("dst"))
    return bases, t.part.select(F.col("p_brand").alias("owner"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_partkey").alias("id"))


@query(f"with {_OVERRIDES} select * from ov")
def e6_overrides(t):
    return inherit.overrides(*_declared(t))


@query(f"""with recursive {_OVERRIDES}, u as (select src as a, dst as b from ov union all select dst, src from ov), s as (select p_partkey as id from part where p_partkey % 20 = 0),
w as (select id, 0 as depth from s union select b, depth + 1 from w join u on id = a where depth < 8) select id, min(depth)::int as depth from w group by id""")
def g4_override_closure(t):
    return inherit.override_walk(*_declared(t), t.part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id")))


@query("""with ty as (select p_partkey as type, p_brand || p_type as name, p_size % 3 as folder from part where p_partkey % 7 = 0), me as (select p_partkey as method, p_brand || p_type as name, p_size % 3 as folder from part where p_partkey % 7 <> 0),
c as (select method, 0 as rung, type from me join ty using (name) union all select method, 1, type from me join ty using (name, folder)), o as (select method, rung, min(type) as type from c group by all having count(distinct type) = 1)
select method, arg_min(type, rung) as type from o group by method""")
def e7_method_owner(t):
    rows = t.part.select("p_partkey", F.concat("p_brand", "p_type").alias("name"), (F.col("p_size") % 3).alias("folder"))
    return inherit.owners(rows.filter("p_partkey % 7 <> 0").withColumnRenamed("p_partkey", "method"), rows.filter("p_partkey % 7 = 0").withColumnRenamed("p_partkey", "type"))


@query("select p_partkey, first from (select p_partkey, min(p_partkey) over (partition by p_brand, p_type) as first from part) where p_partkey <> first")
def e14_partials(t):
    return inherit.partials(t.part, ["p_brand", "p_type"], "p_partkey")


_CHECKED = [("PART", "IMPORTS"), ("ORDER", "CALLS"), ("COUNTRY", "IMPORTS"), ("CUSTOMER", "DEPENDS_ON"), ("REGION", "EXTENDS")]


@query(f"""with {SQL_EDGES}, {SQL_NODES}, c(kind, edge_type) as (values {', '.join(map(str, _CHECKED))}),
n as (select kind, c.edge_type, (select count(*) from nodes where node_type = kind) as nodes, (select count(*) from edges e where e.edge_type = c.edge_type) as edges from c)
select *, case when nodes > 0 and edges = 0 then 'error' else 'ok' end as verdict from n""")
def g5_coverage_assertion(t):
    """Kinds of nodes that ought to have edges of a type: with both, without edges, without nodes."""
    out = None
    for kind, edge_type in _CHECKED:
        row = inherit.coverage_assertion(t.nodes, t.edges, kind, edge_type).withColumn("kind", F.lit(kind)).withColumn("edge_type", F.lit(edge_type))
        out = row if out is None else out.unionByName(row)
    return out


@query("""select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_quantity desc, case when l_returnflag <> 'N' then l_linenumber end nulls last, l_suppkey, l_partkey::varchar || '/' || l_linenumber)::int as rank from lineitem""")
def g7_relation_ranking(t):
    rows = t.lineitem.withColumn("tier", F.when(F.col("l_returnflag") != "N", F.col("l_linenumber"))).withColumn("name", F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")))
    return rank.locality_rank(rows, ["l_orderkey"], "l_quantity", "tier", "l_suppkey", "name").select("l_orderkey", "l_partkey", "rank")


@query("""with a as (select c_custkey as k, c_mktsegment as v, c_acctbal as e from customer where c_custkey % 3 <> 0), b as (select c_custkey as k, 'NEW' as v, case when c_custkey % 2 = 0 then 1.0 end as e from customer where c_custkey % 5 = 0)
select k, case when b.v is null then a.v else b.v end as v, coalesce(b.e, a.e) as e from a full join b using (k)""")
def k2_upsert(t):
    old = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.col("c_acctbal").alias("e"))
    new = t.customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.lit("NEW").alias("v"), F.when(F.expr("c_custkey % 2 = 0"), 1.0).alias("e"))
    return inherit.upsert(old, new, ["k"], keep=("e",))


# -- exports ---------------------------------------------------------------------------------------------------------

_SMALL = f"""{SQL_EDGES}, {SQL_NODES}, n as (select * from nodes where node_type in ('REGION', 'NATION')), e as (select * from edges where src in (select id from n) and dst in (select id from n))"""


def _small(t):
    nodes = t.region.select(node_id("REGION", "r_regionkey").alias("id"), F.lit("REGION").alias("node_type"), F.col("r_name").alias("name")).unionAll(t.nation.select(node_id("NATION", "n_nationkey"), F.lit("NATION"), "n_name"))
    return nodes, t.nation.select(node_id("REGION", "n_regionkey").alias("src"), node_id("NATION", "n_nationkey").alias("dst"), F.lit("CONTAINS").alias("edge_type"))


@query(f"""with {_SMALL}
select 'dot' as form, unnest(['digraph {{', '}}']) as line union all select 'mermaid', 'graph TD'
union all select 'mermaid', '  v' || id || '(["' || node_type || ': ' || name || '"])' from n
union all select 'mermaid', '  v' || src || ' -- "' || edge_type || '" --> v' || dst from e
union all select 'dot', '  ' || id || ' [label="' || name || '", class="' || node_type || '"]' from n
union all select 'dot', '  ' || src || ' -> ' || dst || ' [class="' || edge_type || '"]' from e
union all select 'cypher', 'MERGE (v:`' || node_type || '` {{id: ' || id || '}}) SET v.name = ''' || name || ''';' from n
union all select 'cypher', 'MATCH (a {{id: ' || src || '}}), (b {{id: ' || dst || '}}) MERGE (a)-[:`' || edge_type || '`]->(b);' from e
union all select 'json', '{{"id":' || id || ',"kind":"' || node_type || '","label":"' || name || '"}}' from n
union all select 'json', '{{"source":' || src || ',"target":' || dst || ',"relation":"' || edge_type || '"}}' from e""")
def k3_graph_exports(t):
    out = None
    for form in ("dot", "mermaid", "cypher", "json"):
        rows = exports.lines(*_small(t), form).select(F.lit(form).alias("form"), "line")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("select n_regionkey, sha256('# ' || n_regionkey || chr(10) || chr(10) || string_agg('- ' || n_name, chr(10) order by n_nationkey) || chr(10)) as digest from nation where n_regionkey <> 2 group by n_regionkey")
def k5_projection(t):
    now = exports.projection(t.nation, "n_regionkey", "n_nationkey", "n_name")
    return exports.to_write(now, now.filter("n_regionkey = 2"), "n_regionkey").select("n_regionkey", "digest")


# -- retrieval -------------------------------------------------------------------------------------------------------


@query("""with f as (select c_nationkey as plan, c_custkey % 4 as q, c_custkey % 4 = 0 as anchor, c_custkey // 7 as id, c_acctbal as fused from customer),
k as (select * from f qualify row_number() over (partition by plan, q order by fused desc, id) <= case when anchor then 4 else 2 end) select plan, id, max(fused) as fused from k group by all""")
def t11_plan_seeds(t):
    key = F.col("c_custkey")
    return retrieval.plan_seeds(t.customer.select(F.col("c_nationkey").alias("plan"), (key % 4).alias("q"), (key % 4 == 0).alias("anchor"), F.expr("c_custkey div 7").alias("id"), F.col("c_acctbal").alias("fused")))


@query(f"""with {SQL_EDGES}, s as (select n_nationkey::bigint * 8 + 1 as id, (n_nationkey + 1) / 10 as score from nation where n_nationkey < 5), u as (select src as a, dst as b from edges union all select dst, src from edges),
f1 as (select distinct b as id from u join s on a = s.id where b not in (select id from s)) select id, 0::int as depth, score::double as score from s union all select id, 1, round((select max(score) from s) * 0.6, 6) from f1""")
def t13_expand(t):
    seeds = t.nation.filter("n_nationkey < 5").select(node_id("NATION", "n_nationkey").alias("id"), ((F.col("n_nationkey") + 1) / 10).alias("score"))
    return retrieval.expand(t.edges, seeds, 1).withColumn("score", F.round("score", 6))


@query("""with p as (select o_custkey % 9 as q, o_orderkey as id, row_number() over (partition by o_custkey % 9 order by o_totalprice desc, o_orderkey) as rank from orders), x as (select o_custkey % 9 as q, o_orderkey as id, row_number() over (partition by o_custkey % 9 order by o_orderkey) as rank from orders where o_orderkey % 50 = 0),
o as (select * from x where rank <= 100), b as (select *, 0 as tier from o union all select *, 1 from p where (q, id) not in (select q, id from o)) select q, id, row_number() over (partition by q order by tier, rank, id)::int as place from b qualify place <= 40""")
def t18_identity_first(t):
    rows = t.orders.select((F.col("o_custkey") % 9).alias("q"), F.col("o_orderkey").alias("id"), "o_totalprice")
    pool = rank.top_per(rows, ["q"], [F.desc("o_totalprice"), F.col("id")], 40 + 100).select("q", "id", "rank")
    return retrieval.identity_first(rows.filter("id % 50 = 0").select("q", "id"), pool).filter("place <= 40")


@query("""with a(q) as (values ('red widget'), ('Widget'), ('old')), h as (select q, p_partkey as id, case when lower(p_name) = lower(q) then 0 when string_split(lower(p_name), ' ')[-1] = lower(q) then 1 else 2 end as tier from part join a on contains(lower(p_name), lower(q)))
select q, id, tier::int as tier from h qualify tier = min(tier) over (partition by q)""")
def t19_resolve_symbol(t):
    return retrieval.resolve_symbol(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), ["red widget", "Widget", "old"])


@query("""with s as (select p_partkey as id, p_name as name, contains(p_name, 'cold')::int + contains(p_name, 'widget')::int + 100 * (p_name = 'cold')::int + 100 * (p_name = 'widget')::int as score, p_size <= 2 as small from part)
select id, name, score, row_number() over (order by small, score desc, id)::int as place from s where score > 0 qualify place <= 3""")
def t20_explore_focus(t):
    return retrieval.focus(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size"), ["cold", "widget"], F.col("p_size"))


# -- streams ---------------------------------------------------------------------------------------------------------


@query("""with e as (select event_id as id, user_id as scope, ts, event_type as kind from events), l as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by scope order by ts, id) > 259200000000 as idle from e),
x as (select *, count(*) filter (idle) over (partition by scope order by ts, id) as session from l),
f as (select *, last_value(case when kind = 'error' then id end ignore nulls) over (partition by scope, session order by ts, id rows between unbounded preceding and 1 preceding) as fail_id from x),
p as (select *, coalesce(count(*) filter (kind = 'purchase') over (partition by scope, session, fail_id order by ts, id rows between unbounded preceding and 1 preceding), 0) as passed from f where fail_id is not null and kind in ('purchase', 'click', 'view'))
select scope, fail_id, max(id) filter (kind = 'purchase') as pass_id, count(*) filter (kind <> 'purchase') as edits, case when count(*) filter (kind <> 'purchase') > 0 then 'observation' else 'flaky' end as verdict
from p where passed = 0 group by scope, session, fail_id having count(*) filter (kind = 'purchase') > 0""")
def r24_fail_fix_stream(t):
    rows = streams.read(t.spark, f"{t.sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("scope"), "ts", F.col("event_type").alias("kind"))
    return streams.drained(streams.fail_fix(rows, "error", ("click", "view"), "purchase", 259_200)).filter(F.col("verdict") != streams.LATE)


@query("select event_id, user_id from events")
def r21_replay_stream(t):
    rows = streams.read(t.spark, f"{t.sf_dir}/events.parquet")
    return streams.drained(streams.replayed(rows.unionAll(rows), ["event_id"]).select("event_id", "user_id"))


# -- sources ---------------------------------------------------------------------------------------------------------


@query("select p_partkey, 'npm' as ecosystem, 'lib-' || (p_partkey % 7) as name, '^' || p_size || '.0.0' as version, 'runtime' as scope from part union all select p_partkey, 'npm', 'tool', '1.0.0', 'dev' from part")
def s5_manifests(t):
    text = F.format_string('{"name": "x", "dependencies": {"lib-%d": "^%d.0.0"}, "devDependencies": {"tool": "1.0.0"}}', F.col("p_partkey") % 7, F.col("p_size"))
    files = t.part.select("p_partkey", F.lit("web/package.json").alias("path"), text.alias("content"))
    return manifests.dependencies(files, "p_partkey").select("p_partkey", "ecosystem", "name", "version", "scope")


@query("""with f as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') || case page_id % 6 when 0 then '.min.js' when 1 then '/node_modules/a.js' when 2 then '.png' when 3 then '.env' when 4 then '.stories.tsx' else '.py' end as path, case when page_id % 12 = 11 then 300000 else 10 end as size from pages)
select page_id, case page_id % 6 when 2 then 'binary' when 0 then 'generated' when 4 then 'story' when 1 then 'dir_segment' when 3 then 'secret' else case when size > 200000 then 'size' else 'kept' end end as reason from f""")
def s1_walk_policy(t):
    tails = F.array(*[F.lit(x) for x in (".min.js", "/node_modules/a.js", ".png", ".env", ".stories.tsx", ".py")])
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", ""), F.element_at(tails, (F.col("page_id") % 6 + 1).cast("int")))
    size = F.when(F.col("page_id") % 12 == 11, 300_000).otherwise(10)
    return t.pages.select("page_id", files.reason(path, size).alias("reason"))


@query("select p_partkey, 'app.size' as key, p_size::varchar as value from part union all select p_partkey, 'app.tags[0]', p_brand from part")
def s6_config_entries(t):
    text = F.format_string('{"app": {"size": %d, "tags": ["%s"]}}', F.col("p_size"), F.col("p_brand"))
    return files.config_entries(t.part.select("p_partkey", F.lit("conf/app.json").alias("path"), text.alias("content")), "p_partkey")


# -- memory ----------------------------------------------------------------------------------------------------------


@query("""with w as (select p_partkey, p_size % 4 as s, p_size % 6 as c, p_size % 9 as o, p_size as t, p_size * 120 as sec, p_size % 3 as a, p_size % 2 = 0 as wk from part)
select p_partkey, round(greatest(s - 1, 0) * 3.0 + greatest(c - greatest(s, 1), 0) + least(greatest(o - greatest(c, 1), 0) * 0.5, 1.5) + least(a * 1.25, 2.5)
+ least(case when t >= 40 then 1.5 when t >= 20 then 1 when t >= 8 then 0.5 else 0 end + case when sec >= 5400 then 1.5 when sec >= 1800 then 1 when sec >= 600 then 0.5 else 0 end + case when wk then 0.75 else 0 end, 2), 2)::double as weight from w""")
def r27_lesson_weight(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", memory.lesson_weight(s % 4, s % 6, s % 9, s, s * 120, s % 3, s % 2 == 0).alias("weight"))


@query("""with f as (select o_orderkey as id, o_custkey as file, case o_orderstatus when 'F' then 'law' when 'O' then 'observation' else 'hypothesis' end as tier, case when o_orderkey % 3 > 0 then o_totalprice / 50000 end as weight, o_orderkey % 11 = 0 as gone, o_orderkey % 4 as grain, o_orderdate as valid_at from orders)
select file, id, row_number() over (partition by file order by (tier <> 'law')::int, grain desc, weight desc nulls last, valid_at desc, id)::int as place from f where not gone and tier <> 'hypothesis' and (tier = 'law' or coalesce(weight, 3) >= 3)""")
def r34_recall(t):
    tier = F.when(F.col("o_orderstatus") == "F", "law").when(F.col("o_orderstatus") == "O", "observation").otherwise("hypothesis")
    key = F.col("o_orderkey")
    facts = t.orders.select(key.alias("id"), F.col("o_custkey").alias("file"), tier.alias("tier"), F.when(key % 3 > 0, F.col("o_totalprice") / 50000).alias("weight"), F.when(key % 11 == 0, F.col("o_orderdate")).alias("expired"), (key % 4).alias("grain"), F.col("o_orderdate").alias("valid_at"))
    return memory.recall(facts).select("file", "id", "place")


@query("""with w as (select p_partkey, p_brand, list_distinct(string_split(p_name || ' ' || p_type, ' ')) as w from part)
select a.p_brand, a.p_partkey as old, b.p_partkey as new, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) as similarity
from w a join w b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey where len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.6""")
def r36_supersede(t):
    return memory.supersede(t.part.select("p_brand", "p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("w")), "p_brand", "w", "p_partkey")


@query("with r as (select s_suppkey as id, s_nationkey as prefer, s_suppkey % 5 as over_ from supplier) select a.id as old, min(b.id) as new from r a join r b on a.prefer = b.over_ and a.over_ = b.prefer and b.id > a.id group by a.id")
def r38_contradicted(t):
    return memory.contradicted(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("prefer"), (F.col("s_suppkey") % 5).cast("int").alias("over")))


@query("with f as (select event_id, user_id, event_type, ts from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1) select event_id, user_id from f qualify row_number() over (partition by user_id order by ts, event_id) <= 2")
def r39_preflight_once(t):
    return memory.once_per(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["user_id"]).select("event_id", "user_id")


@query("""with f as (select o_orderkey // 8 as commit, o_custkey as anchor, o_orderstatus = 'F' as fix, left(o_orderpriority, 1) as p from orders) select anchor, count(distinct commit) as fixes, string_agg(distinct p, ',' order by p) as priorities from f where fix group by all having count(distinct commit) >= 2""")
def r32_hazards(t):
    fix = t.orders.filter("o_orderstatus = 'F'").select(F.expr("o_orderkey div 8").alias("commit"), F.col("o_custkey").alias("anchor"), F.substring("o_orderpriority", 1, 1).alias("p"))
    return fix.groupBy("anchor").agg(F.count_distinct("commit").alias("fixes"), F.array_join(F.array_sort(F.collect_set("p")), ",").alias("priorities")).filter("fixes >= 2")


#: Commit messages (n: a part's name), and the kind of each.
_MESSAGES = [
    ("concat('Revert \"Fix(db): ', n, '\"')", "revert"),
    ("concat('fix(', n, ')!: null key')", "fix"),
    ("concat('Tidy ', n, ', closes #', p_size)", "issue"),
    ("concat('Avoid a crash on ', n)", "keyword"),
    ("concat('Add fixtures #', p_size, ' ', n)", "other"),
    ("concat('hotfix: ', n)", "fix"),
    ("concat('bugfix(a)(b): ', n)", "other"),
    ("concat('fixed ', n, ': all')", "other"),
    ("concat(n, ' resolves #', p_partkey)", "issue"),
    ("concat('prefix(x): ', n)", "other"),
    ("concat('Bug in ', n)", "keyword"),
]


@query("select p_partkey, case p_partkey % 11 " + " ".join(f"when {k} then '{kind}'" for k, (_, kind) in enumerate(_MESSAGES)) + " end as kind from part")
def c27_commit_kind(t):
    says = F.expr("case p_partkey % 11 " + " ".join(f"when {k} then {text}" for k, (text, _) in enumerate(_MESSAGES)) + " end")
    return t.part.withColumn("n", F.col("p_name")).select("p_partkey", X.commit_kind(says).alias("kind"))
