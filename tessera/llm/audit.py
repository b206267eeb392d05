"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Exact copies are found by partition refinement. Texts are split by their number of code points, then by the hash of one
block of code points after another (BLOCKS, the last block is the rest of the text); whatever stands alone in its class
drops out after each step. The whole texts of what is left are compared, and all rows of a text but those of its least
id fail filter E. Rows that carry no text go through the steps; the texts of survivors are grouped with map-side minima.

Each document then is a mask of the filters that it fails. Documents are counted by (part, mask), and a filter's effect
after a set of others follows from these counts alone, 80 sums a part, whatever the number of documents.

A class may hold any share of the rows: classes with more than a two-thousandth of them are joined by broadcast.

Defined cases: a null text is an empty one, which fails A, and E if a smaller id has an empty or null text; a null id is
neither smaller nor greater than any, so its row never fails E and has no labels; rows of one id are all counted; of
several labels of an id any that is 1 counts; a null part is the empty string; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_skewed, staged

FILTERS = "ABCDE"
#: Ends of the blocks in code points; the last block runs to the end of the text.
BLOCKS = (256, 2_048, 16_384)
_SPACE = r"[\x20\x09-\x0D]+"
KEYS = [f"key{k}" for k in range(len(BLOCKS) + 2)]


def own_failures(text: Column) -> Column:
    """The mask of filters A to D that a non-null text fails; filter k has bit 2 ** k."""
    trimmed = F.trim(text, F.lit(" \t\n\v\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, 100 * distinct < 80 * n, 100 * capitals.cast("long") > 10 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum(F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails))


def _keys(text: Column) -> list[Column]:
    """The class of a text at each step: its length, then that and the hashes of its first blocks."""
    size = F.length(text)
    out, last, begin = [size.cast("long").alias(KEYS[0])], size.cast("long"), 1
    for k, end in enumerate([*BLOCKS, None]):
        block = F.substring(text, begin, end - begin + 1) if end else F.substring(text, F.lit(begin), size)
        last = F.xxhash64(last, block)
        out.append(last.alias(KEYS[k + 1]))
        begin = (end or 0) + 1
    return out


def copies(docs: DataFrame, narrow: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, least, n, text): for classes of more than one row, the least id of each text; text only where a class has several.

    narrow: KEYS and no text. n: the rows of the class.
    """
    rows, classes = narrow.select(*KEYS), None
    for step, key in enumerate(KEYS):
        classes = staged(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), "classes")
        if step < len(KEYS) - 1:
            rows = staged(join_skewed(rows, classes, key, "n"), "survivors")
    last, text = KEYS[-1], F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", _keys(F.col("text"))[-1])
    found = join_skewed(texts, classes, last, "n").groupBy(last, "text").agg(F.min("id").alias("least"))
    found = staged(found, "texts")
    several = found.groupBy(last).agg(F.count("*").alias("texts"))
    text = F.when(F.col("texts") > 1, F.col("text")).alias("text")
    return staged(found.join(several, last).join(classes, last).select(last, "least", "n", text), "copies")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) for each row of docs: the filters that it fails, filter k of FILTERS as bit 2 ** k."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), part.alias("part"), text.alias("text"))
    narrow = staged(given.select("id", "part", own_failures(F.col("text")).alias("mask"), *_keys(F.col("text"))), "masks")
    found, last = copies(docs, narrow, id_col, text_col), KEYS[-1]
    marked = narrow.select("id", "part", "mask", last)
    alone = join_skewed(marked, found.filter("text is null").select(last, "n", "least"), last, "n", how="left")
    # a class of several texts: two texts of equal hashes, so its rows are told apart by their texts
    mixed = found.filter("text is not null")
    if mixed.isEmpty():
        fails = F.col("id") > F.col("least")
    else:
        texts = given.select("id", "text", _keys(F.col("text"))[-1])
        apart = join_skewed(texts, mixed.select(last, "n").distinct(), last, "n").join(mixed.select(last, "text", F.col("least").alias("least_of")), [last, "text"])
        apart = apart.filter("id > least_of").select("id", last).distinct()
        alone = alone.join(apart.withColumn("_apart", F.lit(True)), ["id", last], "left")
        fails = (F.col("id") > F.col("least")) | F.col("_apart")
    return alone.select("id", "part", (F.col("mask") + F.when(fails, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def counted(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, those with label quality 1, those with label toxic 1."""
    held = masked.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))  # a repeated id meets its label once a mask
    label = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    lost = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return held.join(label, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *lost)


def _steps() -> list[tuple[int, int, int]]:
    """(earlier filters as a mask, filter, orders in which just these come earlier): 16 sets for each of five filters."""
    n = len(FILTERS)
    rest = lambda f: [x for x in range(n) if x != f]
    return [(sum(1 << x for x in earlier), f, factorial(size) * factorial(n - 1 - size)) for f in range(n) for size in range(n) for earlier in combinations(rest(f), size)]


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from counted()."""
    spark = counts.sparkSession
    of_step = spark.createDataFrame(_steps(), "earlier int, filter int, orders long").coalesce(1)
    # 80 rows and 600 rows, whatever the data
    every = counts.select("*", F.inline(F.array(*[F.struct(F.lit(e).alias("earlier"), F.lit(f).alias("filter")) for e, f, _ in _steps()])))
    bit, n = F.expr("shiftleft(1, filter)"), F.col("n")
    fails, before = F.expr("mask & shiftleft(1, filter)") != 0, F.expr("mask & earlier") != 0
    total = lambda cond, c=n: F.sum(F.when(cond, c).otherwise(0))
    sums = every.groupBy("part", "earlier", "filter").agg(
        total(~fails & ~before).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(fails & ~before, F.col("good")).alias("good_lost"),
        total(fails & ~before, F.col("toxic")).alias("toxic_lost"),
    )
    worth = sums.join(F.broadcast(of_step), ["earlier", "filter"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    at = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(len(o))]
    orders = spark.createDataFrame(at, "filter_order string, step int, earlier int, filter int").coalesce(1)
    out = sums.join(worth, ["part", "filter"]).join(F.broadcast(orders), ["earlier", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(staged(counted(masks(docs), labels), "counts"))


ORACLE = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    min(doc_id) over (partition by coalesce(text, '')) as least
  from documents),
masks as (
  select doc_id, part,
    (case when len(words) < 100 then 1 else 0 end)
    + (case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end)
    + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > least then 16 else 0 end) as mask
  from texts),
marked as (
  select part, mask, count(*) as n, count(*) filter (exists (select 1 from labels l where l.doc_id = m.doc_id and quality = 1)) as good,
    count(*) filter (exists (select 1 from labels l where l.doc_id = m.doc_id and toxic = 1)) as toxic
  from masks m group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
  select filter_order, step, filter_order[step] as x, (1::bigint << (ascii(filter_order[step]) - 65)::bigint) as bit,
    coalesce(list_sum([(1::bigint << (ascii(filter_order[j]) - 65)::bigint) for j in range(1, step)]), 0)::bigint as earlier
  from orders, (select unnest(range(1, 6))::int as step)),
sums as (
  select part, filter_order, step, x,
    coalesce(sum(n) filter (mask & (bit | earlier) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & earlier <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as toxic_lost
  from marked, steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, x))::bigint as shapley
from sums
"""
