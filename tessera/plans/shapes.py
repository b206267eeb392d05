"""Plain relational shapes and column functions as queries: joins, aggregates, windows, orders, sets, text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import rank
from tessera.plans.graphview import SQL_EDGES, SQL_NODES
from tessera.plans.registry import query

# -- joins -----------------------------------------------------------------------------------------------------------


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey and n_regionkey < 3")
def j1_j2_inner_left(t):
    near = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(near, "c_nationkey", "left").select("o_orderkey", "c_name", "n_name")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def j3_semi(t):
    large = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(large, "c_custkey", "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def j4_anti(t):
    return t.customer.select("c_custkey").join(t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"with {SQL_EDGES}, {SQL_NODES} select id, count(*) as degree from nodes join edges on id = src or id = dst where node_type = 'CUSTOMER' group by id")
def j5_either_end(t):
    ends = t.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(t.nodes.filter("node_type = 'CUSTOMER'").select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))


@query("select a.l_orderkey, a.l_linenumber as a, b.l_linenumber as b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber where a.l_returnflag = 'R' and b.l_returnflag = 'R'")
def j6_co_membership(t):
    back = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("a"))
    return back.join(back.withColumnRenamed("a", "b"), "l_orderkey").filter("a < b")


@query("select c_custkey, o.o_orderkey from customer, lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) o")
def j9_lateral_first(t):
    return rank.best_per(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").join(t.customer.select("c_custkey"), "c_custkey", "left_semi")


@query("select p_partkey from part where exists (select 1 from (select unnest(string_split(p_name, ' ')) as w), (values ('old'), ('red')) v(p) where contains(w, p))")
def j10_arrays_meet(t):
    patterns = F.array(F.lit("old"), F.lit("red"))
    return t.part.filter(F.exists(F.split("p_name", " "), lambda w: F.exists(patterns, lambda p: F.contains(w, p)))).select("p_partkey")


@query("select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by all")
def j14_unnest(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# -- aggregates ------------------------------------------------------------------------------------------------------


@query("select o_custkey, count(distinct o_orderpriority) as priorities, count(*) filter (o_orderstatus = 'F') as closed from orders group by all having count(*) >= 3")
def a2_a3_a4_distinct_filter_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("priorities"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.count("*").alias("n")).filter("n >= 3").drop("n")


@query("select l_partkey, sum(case l_returnflag when 'R' then 1.0 when 'A' then 0.8 else 0.5 end)::double as score from lineitem group by all")
def a6_weighted_sum(t):
    weight = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.8).otherwise(0.5)
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.sum(weight), 6).alias("score"))


@query("select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as best from orders group by all")
def a8_max_by(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("select o_custkey, round(sum(pow(0.5, (epoch(timestamp '1999-01-01') - epoch(o_orderdate)) / 86400 / 365)), 6) as weight from orders group by all")
def a10_decayed_sum(t):
    age = F.date_diff(F.lit("1999-01-01"), F.col("o_orderdate"))
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum(F.pow(F.lit(0.5), age / 365)), 6).alias("weight"))


@query("select distinct p_brand, p_type from part")
def a11_distinct(t):
    return t.part.select("p_brand", "p_type").distinct()


# -- windows, orders, sets -------------------------------------------------------------------------------------------


@query("select p_brand, p_partkey, p_size from part qualify row_number() over (partition by p_brand order by p_size desc, p_partkey) = 1")
def w1_first_per_key(t):
    return rank.best_per(t.part, ["p_brand"], [F.desc("p_size"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_size")


@query("select p_partkey, count(*) over (partition by p_size) as population, rank() over (partition by p_size order by p_retailprice desc, p_brand)::int as place from part")
def w2_w3_tier_population_and_rank(t):
    w = Window.partitionBy("p_size")
    return t.part.select("p_partkey", F.count("*").over(w).alias("population"), F.rank().over(w.orderBy(F.desc("p_retailprice"), "p_brand")).alias("place"))


@query("select c_custkey, (row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) - 1)::int as rank0 from customer")
def w4_ranks_from_zero(t):
    return t.customer.select("c_custkey", (F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")) - 1).alias("rank0"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, case when o_totalprice > 100000 then o_totalprice end nulls last, o_orderkey)::int as place from orders")
def o1_case_order_nulls_last(t):
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    large = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(tier, large.asc_nulls_last(), "o_orderkey")).alias("place"))


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) > 5")
def o2_rows_to_prune(t):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return t.orders.withColumn("_r", place).filter("_r > 5").select("o_custkey", "o_orderkey")


@query("""with r as (select p_brand, p_partkey, p_type = (select min(p_type) from part) as endpoint, p_size from part),
k as (select *, count(*) filter (endpoint) over (partition by p_brand order by p_size desc, p_partkey rows unbounded preceding) as met from r) select p_brand, p_partkey from k where not endpoint or met <= 2""")
def o4_running_cap(t):
    first = t.part.agg(F.min("p_type").alias("_first"))
    rows = t.part.join(F.broadcast(first), F.col("p_type") == F.col("_first"), "left").withColumn("_e", F.col("_first").isNotNull())
    return rank.running_cap(rows, ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], F.col("_e"), 2).select("p_brand", "p_partkey")


@query("select c_nationkey as nation from customer union select s_nationkey from supplier")
def u1_union(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("select 'both' as side, k from (select c_custkey as k from customer intersect select o_custkey from orders) union all select 'first', k from (select c_custkey as k from customer except select o_custkey from orders)")
def u2_intersect_except(t):
    a, b = t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("side"), "k").union(a.subtract(b).select(F.lit("first"), "k"))


# -- filters ---------------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_orderstatus <> 'P' as in_tools, o_orderstatus = 'F' as in_retrieval from orders")
def f2_lifecycle_forms(t):
    return t.orders.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("in_tools"), (F.col("o_orderstatus") == "F").alias("in_retrieval"))


@query("with g as (select p_partkey, case when p_size % 3 = 0 then null else p_size % 3 end as gen from part) select p_partkey, gen from g where gen is null or gen in (select max(gen) from g)")
def f3_generations(t):
    g = t.part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3).alias("gen"))
    active = g.agg(F.max("gen").alias("_g"))
    return g.join(F.broadcast(active), F.col("gen") == F.col("_g"), "left").filter("gen is null or _g is not null").drop("_g")


@query("with l as (select p_partkey, case when p_size % 11 + 1 in (1, 2, 5, 6) then 'EXTRACTED' when p_size % 11 + 1 in (3, 4, 7, 10, 11) then 'INFERRED' else 'AMBIGUOUS' end as label from part) select * from l where label <> 'AMBIGUOUS'")
def f4_ambiguity_exclusion(t):
    return t.part.select("p_partkey", X.tier_label(F.col("p_size") % 11 + 1).alias("label")).filter("label <> 'AMBIGUOUS'")


@query("select p_partkey from part where regexp_matches(p_name, '^[a-c].*[dt]$') or regexp_matches(p_type, '(?i)eco')")
def f6_regexp(t):
    return t.part.filter(F.col("p_name").rlike("^[a-c].*[dt]$") | F.col("p_type").rlike("(?i)eco")).select("p_partkey")


@query("with a as (select o_orderkey, nullif(o_orderstatus, 'P') as x, nullif(o_orderpriority, '3-MEDIUM') as y from orders) select o_orderkey, x is not distinct from left(y, 1) as same, x is null and y is null as none from a")
def f7_f13_null_safe(t):
    x, y = F.nullif("o_orderstatus", F.lit("P")), F.nullif("o_orderpriority", F.lit("3-MEDIUM"))
    return t.orders.select("o_orderkey", x.eqNullSafe(F.substring(y, 1, 1)).alias("same"), (x.isNull() & y.isNull()).alias("none"))


@query(f"with {SQL_EDGES} select edge_type, count(*) as n from edges where edge_type in ('CALLS', 'CONTAINS') and edge_type not in ('CONTAINS') group by all")
def f8_f9_edge_types(t):
    return X.allowed(t.edges, "edge_type", allow=("CALLS", "CONTAINS"), deny=("CONTAINS",)).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("select page_id, regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(md|mdc|markdown|rst|adoc|txt)$') as prose from pages")
def f12_prose_paths(t):
    return t.pages.select("page_id", X.is_prose(F.regexp_replace("url", "[?#].*$", "")).alias("prose"))


# -- functions -------------------------------------------------------------------------------------------------------


@query("select p_partkey, lower(p_type) as low, upper(p_name) as up, greatest(p_size, p_partkey % 50)::bigint as top, instr(p_name, 'e') as at, substr(p_name, 2, 3) as mid, replace(p_name, ' ', '-') as dashed, concat_ws('/', p_brand, p_type) as path, length(p_name) as n from part")
def c1_c6_c7_strings(t):
    return t.part.select("p_partkey", F.lower("p_type").alias("low"), F.upper("p_name").alias("up"), F.greatest(F.col("p_size").cast("long"), F.col("p_partkey") % 50).alias("top"), F.instr("p_name", "e").cast("long").alias("at"), F.substring("p_name", 2, 3).alias("mid"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("dashed"), F.concat_ws("/", "p_brand", "p_type").alias("path"), F.length("p_name").cast("long").alias("n"))


@query("select p_partkey, regexp_replace(p_name, '[aeiou]', '_') as first, regexp_replace(p_name, '[aeiou]', '_', 'g') as every from part")
def c2_regexp_replace(t):
    return t.part.select("p_partkey", X.replace_first(F.col("p_name"), "[aeiou]", "_").alias("first"), F.regexp_replace("p_name", "[aeiou]", "_").alias("every"))


@query("""with w as (select p_partkey, string_split(p_name, ' ') as w from part)
select p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda k: case
  when k = 1 and p_partkey % 3 = 0 then w[k] when k = 1 and p_partkey % 3 = 1 then upper(w[k]) else upper(w[k][1:1]) || w[k][2:] end), '|') as parts from w""")
def c8_camel_split(t):
    capital = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    first = F.substring_index("p_name", " ", 1)
    rest = F.substring(capital, F.length(first) + 1, F.length(capital))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(first, rest)).when(F.col("p_partkey") % 3 == 1, F.concat(F.upper(first), rest)).otherwise(capital)
    return t.part.select("p_partkey", F.array_join(X.camel_split(name), "|").alias("parts"))


@query(r"select page_id, lower(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '\.[^.]*$', '')) as stem from pages")
def c11_module_stem(t):
    return t.pages.select("page_id", X.module_stem(F.regexp_replace("url", "[?#].*$", "")).alias("stem"))


@query("""with d as (select page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[1:-2] as a, string_split((select min(url) from pages), '/')[1:-2] as b from pages)
select page_id, (len(a) + len(b) - 2 * len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])))::int as distance from d""")
def c12_directory_distance(t):
    least = F.broadcast(t.pages.agg(F.min("url").alias("_b")))
    return t.pages.crossJoin(least).select("page_id", X.directory_distance(F.regexp_replace("url", "[?#].*$", ""), F.col("_b")).alias("distance"))


_ENDINGS = ["", "Thing", *X.STEM_SUFFIXES]


@query(f"""with x as (select *, p_partkey % {len(_ENDINGS)} as k from part)
select p_partkey, case when k = 1 then case when p_size % 10 = 0 then '' else p_name end || 'Thing' when p_size % 10 = 0 then {_ENDINGS}[k + 1] else p_name end as stem from x""")
def c18_stem_suffix(t):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int"))
    front = F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.stem_suffix(F.concat(front, ending)).alias("stem"))


_FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"


@query(f"select p_partkey, {_FNV.format('p_name')} as hash from part")
def c20_fnv1a(t):
    return t.part.select("p_partkey", X.fnv1a(F.col("p_name")).alias("hash"))


_SKETCH = f"""w as (select item_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x <> '') as w from benchmark),
g as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) as gram from w),
h as (select distinct item_id, {_FNV.format('gram')} as h from g), s as (select item_id, list_sort(list(h))[1:64] as s from h group by all)"""


@query(f"""with {_SKETCH}, p as (select a.item_id, a.s as a, b.s as b, list_sort(list_distinct(list_concat(a.s, b.s)))[1:64] as low from s a join s b on b.item_id = a.item_id + 1)
select item_id, len(a)::int as n, round(len(list_intersect(list_intersect(low, a), b)) / len(low), 6) as similarity from p""")
def c20_sketches(t):
    s = t.benchmark.select("item_id", X.sketch(F.col("text")).alias("a"))
    nxt = s.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return s.join(nxt, "item_id").select("item_id", F.size("a").alias("n"), F.round(X.sketch_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""select case event_id % 4 when 0 then event_type || ' at <path>:<n> code <hex> in <str>' when 1 then 'cannot open <path> for ' || event_type
  when 2 then '<n> of <n> ' || event_type || 's failed' else '<str> is no ' || event_type end as signature, count(*) as n from events group by all""")
def c23_error_signature(t):
    text = F.expr(r"""case event_id % 4 when 0 then concat(upper(event_type), ' at  /srv/app', event_id, '.py:', event_id, ' code 0xAF', user_id % 10, ' in \'main\'')
        when 1 then concat('Cannot open /var/', user_id, '/log  for ', event_type) when 2 then concat(event_id, ' of ', user_id, ' ', event_type, 's failed')
        else concat('"user ', user_id, '" is no\t', event_type, ' ') end""")
    return t.events.groupBy(X.error_signature(text).alias("signature")).agg(F.count("*").alias("n"))


@query("select doc_id, ceil(length(text) / 4)::bigint as tokens, greatest(25, least(200, ceil(length(text) / 4 / 34)))::bigint as nodes, greatest(8, least(64, ceil(greatest(25, least(200, ceil(length(text) / 4 / 34))) * 35 / 100)))::bigint as seeds from documents where text is not null")
def c31_t12_budgets(t):
    nodes = F.greatest(F.lit(25), F.least(F.lit(200), F.ceil(F.length("text") / 4 / 34)))
    return t.documents.filter("text is not null").select("doc_id", F.ceil(F.length("text") / 4).alias("tokens"), nodes.cast("long").alias("nodes"), F.greatest(F.lit(8), F.least(F.lit(64), F.ceil(nodes * 35 / 100))).cast("long").alias("seeds"))
