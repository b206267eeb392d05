"""Ties, nulls, empty inputs and caps on graphs of a few nodes."""

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import analytics, memory, rank, resolve, traverse


def test_walk_is_cycle_safe_and_keeps_least_depth(spark):
    edges = spark.createDataFrame([(1, 2, "A"), (2, 3, "A"), (3, 1, "A"), (1, 3, "A")], "src long, dst long, edge_type string")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {(r["id"], r["depth"]) for r in traverse.walk(edges, seeds, 5).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert traverse.walk(edges, seeds.limit(0), 5).count() == 0
    assert {r["id"] for r in traverse.walk(edges, seeds, 1, "in").collect()} == {1, 3}


def test_unique_or_refuse_skips_ambiguous_rungs(spark):
    c = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "a"), (2, 0, "a"), (3, 0, "a"), (3, 0, "b")], "k long, rung int, target string")
    assert {(r["k"], r["target"], r["rung"]) for r in resolve.unique_or_refuse(c, ["k"]).collect()} == {(1, "c", 1), (2, "a", 0)}


def test_budget_prefix_keeps_the_first_row(spark):
    df = spark.createDataFrame([("x", 1, 500), ("x", 2, 1), ("y", 1, 4), ("y", 2, 4), ("y", 3, 4)], "k string, o int, cost int")
    got = {(r["k"], r["o"]) for r in rank.budget_prefix(df, ["k"], [F.col("o")], "cost", 9).collect()}
    assert got == {("x", 1), ("y", 1), ("y", 2)}


def test_cycles_are_found_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 3)], "src long, dst long")
    assert sorted((r["n"], r["path"]) for r in analytics.cycles(edges, 3).collect()) == [(2, "1>2"), (3, "1>2>3")]


def test_pagerank_sums_to_one_and_dangling_mass_restarts(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    got = analytics.pagerank(edges, spark.createDataFrame([(1,), (9,)], "id long"), rounds=5).collect()
    assert abs(sum(r["rank"] for r in got) - 1) < 1e-5


def test_later_failure_replaces_an_earlier_one(spark):
    rows = [(1, "s", 0, "fail"), (2, "s", 60, "edit"), (3, "s", 120, "fail"), (4, "s", 180, "pass"), (5, "s", 9000, "pass"), (6, "t", 0, "fail"), (7, "t", 1, "edit"), (8, "t", 2, "pass"), (9, "t", 3, "pass")]
    e = spark.createDataFrame(rows, "id long, scope string, s long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["scope"], r["fail_id"], r["pass_id"], r["verdict"]) for r in memory.fail_fix(e, "fail", ("edit",), "pass").collect()}
    assert got == {("s", 3, 4, "flaky"), ("t", 6, 8, "observation")}


def test_revalidate(spark):
    anchors = spark.createDataFrame([(1, "f", "a", "x"), (2, "f", "b", "y"), (3, "f", "c", "z"), (4, "f", "d", "w")], "fact long, file string, name string, fp string")
    now = spark.createDataFrame([("f", "a", "x"), ("f", "b", "changed"), ("g", "c", "z")], "file string, name string, fp string")
    assert {(r["fact"], r["verdict"]) for r in memory.revalidate(anchors, now).collect()} == {(1, "ok"), (2, "unconfirmed"), (3, "moved"), (4, "orphaned")}


def test_supersede(spark):
    f = spark.createDataFrame([("r", 1, ["use", "tabs", "here"]), ("r", 2, ["use", "tabs", "here", "now"]), ("q", 3, ["use", "tabs", "here"])], "k string, o long, t array<string>")
    assert [(r["k"], r["old"], r["new"], r["similarity"]) for r in memory.supersede(f, "k", "t", "o").collect()] == [("r", 1, 2, 0.75)]


def test_expressions(spark):
    df = spark.createDataFrame([("parseHTTPBody", "a/b/c.py", "a/d.py")], "n string, p string, q string")
    r = df.select(X.camel_split(F.col("n")).alias("c"), X.snake_case(F.lit("fooBar")).alias("s"), X.plural(F.lit("box")).alias("x"), X.directory_distance(F.col("p"), F.col("q")).alias("d"), X.fnv1a(F.lit("a")).alias("h"), X.error_signature(F.lit("Fail 12 at /a/b.py 'x'")).alias("e")).first()
    assert r["c"] == ["parse", "HTTP", "Body"] and r["s"] == "foo_bar" and r["x"] == "boxes" and r["d"] == 1 and r["h"] == 0xE40C292C and r["e"] == "fail <n> at <path> <str>"


def test_similar_sets_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    sets = {k: {rng.choice("abcdefghij") for _ in range(rng.randint(0, 7))} for k in range(60)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k long, w array<string>")
    for least in (0.2, 0.6, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        got = [(r["a"], r["b"]) for r in resolve.similar_sets(df, "k", "w", least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_json_kinds(spark):
    from tessera.plans import catalog  # noqa: F401 - it registers the query
    from tessera.plans.registry import QUERIES

    want = [('{"a": 1}', "OBJECT"), (" [1, 2]", "ARRAY"), ('"x"', "VARCHAR"), ("true", "BOOLEAN"), ("null", "NULL"), ("12", "UBIGINT"), ("-3", "BIGINT"), ("1.5", "DOUBLE"), ("{a", None), ("", None), (None, None)]
    df = spark.createDataFrame([(p,) for p, _ in want], "p string")
    assert [r["k"] for r in df.select(X.json_kind(F.col("p")).alias("k")).collect()] == [k for _, k in want]
    assert QUERIES["c5_json"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
