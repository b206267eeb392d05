"""Pairs of equal or like rows: classes meet, and their rows are opened from packs at the end."""

from pyspark.sql import functions as F

from tessera.operators import inherit, resolve, traverse


def test_equal_sets_are_compared_once(spark, monkeypatch):
    """Rows of equal sets are opened from packs at the end, so the sets that meet are the distinct ones."""
    monkeypatch.setattr(resolve, "PACK", 3)
    sets = [(k, g, t.split()) for k, (g, t) in enumerate([("x", "a b c"), ("x", "c b a"), ("x", "a b c d"), ("y", "a b c"), (None, "a b c"), ("x", "")] * 8)]
    got = resolve.similar_sets(spark.createDataFrame(sets, "k long, g string, w array<string>"), "k", "w", 0.7, ["g"])
    want = set()
    for i, g, x in sets:
        for j, h, y in sets:
            if i < j and g and g == h and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.7:
                want.add((g, i, j, round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "explode(_y" in got._jdf.queryExecution().optimizedPlan().toString()


def test_types_are_one_row_a_name_before_methods_meet_them(spark):
    methods = spark.createDataFrame([(k, "ab"[k % 2], k % 3) for k in range(60)] + [(99, "c", 0)], "method long, name string, folder int")
    types = spark.createDataFrame([(100, "a", 0), (101, "a", 1), (102, "a", 1), (103, "b", 2), (103, "b", 2)], "type long, name string, folder int")
    got = inherit.owners(methods, types)
    want = {(k, 103) for k in range(1, 60, 2)} | {(k, 100) for k in range(0, 60, 2) if k % 3 == 0}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max(type") == 2


def _methods(spark, ids):
    return spark.createDataFrame([(f"t{k % 4}", "Run" if k % 3 else "run", k) for k in range(ids)], "owner string, name string, id long")


def test_overrides_open_packs_without_an_exchange_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PACK", 2)
    bases = spark.createDataFrame([("t0", "t1"), ("t0", "t1"), ("t1", "t2"), ("t3", "t3")], "src string, dst string")
    got = inherit.overrides(bases, _methods(spark, 40))
    want = {(a, b) for a in range(40) for b in range(40) if a != b and (a % 4, b % 4) in {(0, 1), (1, 2), (3, 3)}}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_high") < plan.index("Repartition")


def test_an_override_walk_equals_the_walk_over_pairs(spark):
    bases = spark.createDataFrame([("t0", "t1"), ("t1", "t2"), ("t3", "t3")], "src string, dst string")
    methods = _methods(spark, 24).unionByName(spark.createDataFrame([("t3", "go", 0), ("t3", "go", 50), ("t0", "lone", 51), (None, "run", 52)], "owner string, name string, id long"))
    seeds = spark.createDataFrame([(0,), (51,), (77,)], "id long")
    pairs = inherit.overrides(bases, methods).withColumn("edge_type", F.lit("OVERRIDES"))
    for hops in (1, 2, 8):
        want = {(r["id"], r["depth"]) for r in traverse.override_closure(pairs, seeds, hops).collect()}
        assert {(r["id"], r["depth"]) for r in inherit.override_walk(bases, methods, seeds, hops).collect()} == want


def test_spans_of_the_same_lines_are_one_before_points_meet_them(spark):
    spans = spark.createDataFrame([("f", k, 1 + k % 3, 4 + k % 2, f"n{k}") for k in range(40)] + [("f", 90, 2, 2, "stub")], "file string, span_id long, start_line int, end_line int, name string")
    points = spark.createDataFrame([("f", line) for line in range(8)] + [("f", 2), ("g", 2)], "file string, line int")
    got = resolve.innermost(points, spans, "file", "line")
    want = set()
    for line in range(8):
        held = [(e == s, e - s, k, s, e, n) for _, k, s, e, n in (tuple(r) for r in spans.collect()) if s <= line <= e]
        if held:
            _, _, k, s, e, n = min(held)
            want.add(("f", line, k, s, e, n))
    rows = [(r["file"], r["line"], r["span_id"], r["start_line"], r["end_line"], r["name"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "min(span_id" in got._jdf.queryExecution().optimizedPlan().toString()
