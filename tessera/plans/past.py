"""Patches, reverts and episodes as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import coupling, history
from tessera.plans.graphview import SQL_TOUCHES
from tessera.plans.registry import query

# -- declarations that patches touch -------------------------------------------------------------------------------------

_COMMITS = 5
_HUNKS = """placed as (
  select file, seq, j, 10 * j + (seq * 3 + file) % 5 + 1 as first, (j + seq) % 3 as removed, (j * seq + file) % 4 as added
  from (select distinct substr(p_brand, 7)::int as file from part), (select unnest(range(1, 6)) as seq), (select unnest(range(0, 9)) as j)
  where (j + seq + file) % 3 = 0),
hunks as materialized (
  select file, seq, first, removed, added, first + coalesce(sum(removed - added) over (partition by file, seq order by first rows between unbounded preceding and 1 preceding), 0) as was
  from placed where removed + added > 0),
spans5 as materialized (
  select substr(p_brand, 7)::int as file, p_partkey as id, p_size + p_partkey % 20 + 1 as s, p_size + p_partkey % 20 + 1 + p_partkey % 9 as e from part)"""


def _back_sql(seq: int) -> str:
    """Touches of commit seq, and the spans before it: each end by the sums of the hunks that it has passed, or its hunk's own lines."""
    shift = "(select coalesce(sum(removed - added), 0) from hunks h where h.file = p.file and h.seq = {seq} and h.first + h.added <= p.{x})"
    inside = "(select min({value}) from hunks h where h.file = p.file and h.seq = {seq} and h.first <= p.{x} and p.{x} < h.first + h.added)"
    end = lambda x, value: f"coalesce({inside.format(value=value, x=x, seq=seq)}, {x} + {shift.format(x=x, seq=seq)})"
    return f"""
met{seq} as (select distinct h.file, id from hunks h join spans{seq} p on p.file = h.file and h.seq = {seq} and first <= e and s <= first + greatest(added, 1) - 1),
spans{seq - 1} as materialized (select * from (select file, id, {end('s', 'was')} as s, {end('e', 'was + removed - 1')} as e from spans{seq} p) where s <= e)"""


@query(f"""with {_HUNKS}, {', '.join(_back_sql(s) for s in range(_COMMITS, 0, -1))},
touched as ({' union all '.join(f'select {s} as seq, * from met{s}' for s in range(1, _COMMITS + 1))})
select c.file * 100 + c.seq as commit, c.file::int as file, id from (select distinct file, seq from hunks) c left join touched using (file, seq)""")
def p2_declaration_touches(t):
    """Which parts' lines each of five patches of a brand touches, carried back through the later ones; the brand alone where none is."""
    files = t.part.select(F.expr("cast(substr(p_brand, 7) as int)").alias("file")).distinct()
    each = files.withColumn("seq", F.explode(F.expr("sequence(1, 5)"))).withColumn("j", F.explode(F.expr("sequence(0, 8)"))).filter("(j + seq + file) % 3 = 0")
    hunks = each.selectExpr("file * 100 + seq as commit", "seq", "file", "10 * j + (seq * 3 + file) % 5 + 1 as first", "(j + seq) % 3 as removed", "(j * seq + file) % 4 as added").filter("removed + added > 0")
    declared = t.part.selectExpr("cast(substr(p_brand, 7) as int) as file", "p_partkey as id", "p_size + p_partkey % 20 + 1 as start_line", "p_size + p_partkey % 20 + 1 + p_partkey % 9 as end_line")
    return history.declaration_touches(hunks, declared)


# -- reverts -------------------------------------------------------------------------------------------------------------

_LINES = """own as (select l_orderkey as commit, l_partkey % 7 as file, (l_linenumber % 3 > 0) as plus, l_partkey || '-' || l_quantity::int as text, l_linenumber as line from lineitem),
lines as (
  select commit, commit as ts, file, plus, text from own
  union all select commit + 1000000000, commit + 1000000000, file, not plus, text from own where commit % 11 = 0 and (commit % 22 > 0 or line > 1)
  union all select commit + 2000000000, commit + 2000000000, file, plus, text from own where commit % 33 = 0),
patches as (
  select commit, min(ts) as ts, coalesce(string_agg(file || ':' || text, '|' order by file, text) filter (plus), '') as given,
    coalesce(string_agg(file || ':' || text, '|' order by file, text) filter (not plus), '') as taken from lines group by commit)"""


@query(f"""with {_LINES} select a.commit, b.commit as reverted from patches a join patches b on a.given = b.taken and a.taken = b.given and b.ts < a.ts and a.given <> a.taken
qualify row_number() over (partition by a.commit order by b.ts desc, b.commit desc) = 1""")
def c27_reverts(t):
    """Orders as patches of their lines, with planted reverts, partial reverts and repeats among them."""
    own = t.lineitem.selectExpr("l_orderkey as commit", "l_partkey % 7 as file", "l_linenumber % 3 > 0 as plus", "concat(l_partkey, '-', cast(l_quantity as int)) as text", "l_linenumber as line")
    back = own.filter("commit % 11 = 0 and (commit % 22 > 0 or line > 1)").selectExpr("commit + 1000000000 as commit", "file", "not plus as plus", "text")
    again = own.filter("commit % 33 = 0").selectExpr("commit + 2000000000 as commit", "file", "plus", "text")
    lines = own.select("commit", "file", "plus", "text").unionAll(back).unionAll(again)
    return history.reverts(lines.selectExpr("commit", "commit as ts", "file", "if(plus, '+', '-') as sign", "text"))


# -- episodes ------------------------------------------------------------------------------------------------------------

_KINDS = {"read": "view", "edit": "click", "search": "search", "pass": "purchase", "fail": "error"}


@query("""with e as (
  select user_id as scope, ts, event_id as event, case when event_id % 6 = 0 then 'search' else event_type end as kind, 'f' || event_id % 5 as file,
    'v' || floor(value)::int % 4 as old_fp, 'v' || (floor(value)::int + event_id) % 4 as new_fp from events where event_id % 8 > 0),
p as (select user_id as scope, ts, event_id as prompt from events where event_id % 8 = 0),
kept as (select prompt from p qualify row_number() over (partition by scope order by ts desc, prompt desc) <= 5000),
met as (
  select e.*, p.prompt from e join p on p.scope = e.scope and p.ts <= e.ts
  qualify row_number() over (partition by event order by p.ts desc, p.prompt desc) = 1),
seen as (select * from met where prompt in (select prompt from kept)),
back as (select scope, file, new_fp, max(ts) as ts from e where kind = 'click' group by all),
work as (
  select prompt, a.file, count(*) filter (kind = 'view') as reads, count(*) filter (kind = 'click') as edits, count(*) filter (kind = 'search') as searches,
    count(*) filter (kind = 'click' and (b.ts is null or b.ts <= a.ts)) as survived
  from seen a left join back b on b.scope = a.scope and b.file = a.file and b.new_fp = a.old_fp where kind in ('view', 'click', 'search') group by all),
few as (select * from work qualify row_number() over (partition by prompt order by reads + edits + searches desc, file) <= 40),
said as (
  select prompt, case kind when 'purchase' then 'pass' else 'fail' end as outcome from seen where kind in ('purchase', 'error')
  qualify row_number() over (partition by prompt order by ts desc, event desc) = 1)
select few.*, coalesce(outcome, 'open') as outcome from few left join said using (prompt)""")
def r30_episode_work(t):
    """What was read, changed and searched under each prompt, what of it stayed, and how it ended."""
    e = t.events
    prompts = e.filter("event_id % 8 = 0").selectExpr("user_id as scope", "ts", "event_id as prompt")
    events = e.filter("event_id % 8 > 0").selectExpr(
        "user_id as scope", "ts", "event_id as event", "case when event_id % 6 = 0 then 'search' else event_type end as kind", "concat('f', event_id % 5) as file",
        "concat('v', cast(floor(value) as int) % 4) as old_fp", "concat('v', (cast(floor(value) as int) + event_id) % 4) as new_fp",
    )
    return history.episodes(prompts, events, _KINDS)


@query(f"""with {SQL_TOUCHES}, f as (select distinct commit, (item // 16)::bigint as item from touches), z as (select commit from f group by commit having count(*) between 2 and 20), t as (select f.* from f semi join z using (commit))
select a.item as a, b.item as b, count(*) as n from t a join t b on a.commit = b.commit and a.item < b.item group by all having count(*) >= 4""")
def p7_file_plane(t):
    """Coupled files: parts of sixteen by number as a file's declarations."""
    owners = t.part.selectExpr("p_partkey as item", "p_partkey div 16 as file")
    return coupling.file_plane(t.touches, owners, 4)
