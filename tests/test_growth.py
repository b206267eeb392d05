"""Steps whose work must follow the input: results against brute force, and what passes between tasks."""

import random
import re
from collections import Counter, defaultdict

from tessera.operators import coupling, expansion, reach, retrieval, waterfall
from tessera.plans.cuts import cut


def moved(spark, run):
    """(result, rows that the stages of run() gave to later ones)."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = {s.stageId() for s in _stages(spark, store)}
    result = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return result, sum(s.shuffleWriteRecords() for s in _stages(spark, store) if s.stageId() not in before)


def _stages(spark, store):
    gateway = spark.sparkContext._gateway
    found = store.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


def _tiered(nodes, needles, limit=16):
    """What the query's SQL says, pair by pair."""
    met = defaultdict(list)
    for q, needle in needles:
        need = needle.lower()
        for i, kind, name, path in nodes:
            low, base = name.lower() if name else None, path.rsplit("/", 1)[-1]
            if not need:
                continue
            score = (1.0 if low == need else 0.98 if kind == "FILE" and base == need else 0.97 if base == need else 0.95 if path == need
                     else 0.75 if low and low.startswith(need) else 0.6 if low and need in low else 0.5 if need in path else 0)
            if score and (kind != "DEPENDENCY" or score >= 0.95):
                met[q, i].append(score)
    tiers = defaultdict(list)
    for (q, i), scores in met.items():
        tiers[q, max(scores)].append((-len(scores), i))
    names, kept = {n[0]: n[2] for n in nodes}, defaultdict(list)
    for (q, score), rows in tiers.items():
        for hits, i in sorted(rows)[: None if len(rows) <= limit else 8]:
            kept[q].append((-score, hits, -1 if names[i] is None else len(names[i]), i))
    return {(q, i, -s, -h, r) for q, rows in kept.items() for r, (s, h, _, i) in enumerate(sorted(rows)[:limit], 1)}


def test_a_needle_of_many_queries_is_matched_once(spark):
    rng = random.Random(2)
    nodes = [(k, ("FILE", "METHOD", "DEPENDENCY")[k % 3], None if k % 3 == 0 else f"get{k}", f"host/{'en' if k % 5 else 'fr'}/{rng.randrange(90)}") for k in range(400)]
    needles = [(q, n) for q in range(150) for n in ["en" if q % 5 else "FR", nodes[q][3].rsplit("/", 1)[-1], f"get{q // 10}", "", *(["en"] if q % 7 == 0 else []), *([nodes[q][3]] if q % 2 else [])]]
    needles += [(900, "nowhere"), (901, "en"), (902, "get"), (902, "host"), (903, "host\nen")]
    frame = spark.createDataFrame(nodes, "id long, node_type string, name string, path string")
    got, rows = moved(spark, lambda: retrieval.exact(frame, spark.createDataFrame(needles, "q long, needle string")).collect())
    want = _tiered(nodes, [x for x in needles if "\n" not in x[1]])
    assert len(got) == len(want) and {(r["q"], r["id"], r["score"], r["hits"], r["rank"]) for r in got} == want
    assert rows < 60_000  # 320 nodes to each of 120 queries, through each exchange, are above 100,000


def test_known_calls_are_not_paired_with_the_methods_of_their_name(spark):
    rng = random.Random(3)
    methods = [(1000 + k, f"m{0 if k < 300 else k}", k % 4) for k in range(320)]
    loose = [(k, rng.choice([7, 8, 1310]), f"m{0 if k < 300 else rng.randrange(300, 320)}", k % 3) for k in range(400)]
    make = spark.createDataFrame
    calls, all_methods = make(loose, "edge long, caller long, name string, file long"), make(methods, "target long, name string, owner long")
    few = make([(2, 1)], "src long, dst long"), make([(f, f"T{k}") for f in range(3) for k in range(12)], "file long, name string"), make([(k, f"T{k}") for k in range(12)], "id long, name string")
    known = calls.filter("edge % 2 = 0"), all_methods.filter("target % 2 = 0")
    run = lambda *how: reach.reresolve(calls, all_methods, *few, *how).collect()
    got, rows = moved(spark, lambda: run(*known))
    want = run(known[0].join(known[1], "name").select("caller", "target"))
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["verdict"] for r in got} == {"dropped", "upgraded"}
    assert rows < 8_000  # 150 calls with 150 methods are 22,500


def test_coupled_pairs_come_from_tasks_that_follow_their_number(spark, monkeypatch):
    rng = random.Random(4)
    touches = list({(c, rng.randrange(30)) for c in range(120) for _ in range(rng.randint(0, 25))} | {(c, None) for c in range(9)} | {(500, k) for k in range(100, 120)})
    frame = spark.createDataFrame(touches, "commit long, item long")
    of = defaultdict(list)
    for c, i in touches:
        of[c].append(i)
    for most in (20, None):
        n = Counter((a, b) for items in of.values() if len(items) >= 2 and (not most or len(items) <= most) for a in items for b in items if a is not None and b is not None and a < b)
        got = coupling.pairs(frame, 3, most).collect()
        assert {tuple(r) for r in got} == {(a, b, k) for (a, b), k in n.items() if k >= 3} and len({(r["a"], r["b"]) for r in got}) == len(got)
    monkeypatch.setattr(coupling, "TASK_PAIRS", 500)
    plan = coupling.pairs(frame)._jdf.queryExecution().optimizedPlan().toString()
    tasks = [max(map(int, re.findall(r"(?<![#\w])\d+", x))) for x in plan.splitlines() if "Repartition" in x]
    assert "Join" not in plan and len(tasks) == 2 and min(tasks) >= 8 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def _hub(spark):
    """A hub of 1,500 members that 40 queries keep, each with one member and a leaf of it."""
    edges = [(0, k, "CONTAINS") for k in range(1, 1501)] + [(k, 5000 + k, "USES") for k in range(1, 1501)]
    kept = [(q, i) for q in range(40) for i in (0, q + 1, 5001 + q)]
    nodes = [(0, "HUB")] + [(k, "MEMBER") for k in range(1, 1501)] + [(5000 + k, "LEAF") for k in range(1, 1501)]
    return spark.createDataFrame(edges, "src long, dst long, edge_type string"), spark.createDataFrame(kept, "q long, id long"), spark.createDataFrame(nodes, "id long, node_type string")


def test_a_hub_does_not_bring_its_edges_to_each_query(spark):
    edges, kept, _ = _hub(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, rows = moved(spark, lambda: expansion.kept_edges(edges, kept).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got)) == sorted([(q, 0, q + 1, "CONTAINS") for q in range(40)] + [(q, q + 1, 5001 + q, "USES") for q in range(40)])
    assert rows < 20_000  # 1,500 members for 40 queries are 60,000


def test_pulling_through_joins_on_the_rules_edge_types(spark):
    edges, kept, nodes = _hub(spark)
    some = kept.filter("id < 5000")
    got = expansion.pulled_through(edges, nodes, some, [("MEMBER", "USES", "LEAF"), ("LEAF", "USES", "MEMBER")])
    assert {tuple(r) for r in got.collect()} == {(q, 5001 + q) for q in range(40)}
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any("edge_type" in x and "src" in x for x in joins)


def test_steps_are_ranked_for_the_frontier_only(spark):
    edges, _, _ = _hub(spark)
    nodes = spark.range(7000).selectExpr("id", "'N' as node_type", "cast(id as string) as name", "'f' as file", "1 as size")
    run = lambda: sorted((r["q"], r["id"], r["depth"]) for r in expansion.expanded(edges, nodes, spark.createDataFrame([(1, 7, 1.0)], "q long, id long, score double"), 2, 3).collect())
    got, rows = moved(spark, run)
    want = [(1, 0, 1), (1, 1, 2), (1, 2, 2), (1, 3, 2), (1, 7, 0), (1, 5007, 1)]
    assert got == want and rows < 3_000  # 3,000 edges, each way, are 6,000
    few, expansion.FEW = expansion.FEW, 0
    try:
        assert run() == want
    finally:
        expansion.FEW = few


def test_later_passes_take_only_the_rung_that_types_can_change(spark, monkeypatch):
    """Each call's result is the next one's receiver: a pass for each, of one rung but for the first."""
    n, made = 4, []
    monkeypatch.setattr(waterfall, "cut", lambda df: made.append(1) or cut(df))
    make = spark.createDataFrame
    # two declarations of each name, in folders equally far, so only a receiver's type tells them apart
    declared = [(k, f"m{k // 2}", f"T{k // 2}" if k % 2 == 0 else "Other", f"T{k // 2 + 1}", f"d{k % 2}", "s", False) for k in range(2 * n)]
    refs = [(k, "f", "src", "g", f"m{k % n}", f"v{k % n}", f"v{k % n + 1}") for k in range(3 * n)] + [(90, "f", "src", "g", "m1", None, None), (91, "f", "src", "g", "none", "v1", None)]
    got = waterfall.resolve(
        make(refs[::-1], "ref long, file string, folder string, stem string, name string, receiver string, assigned string"),
        make(declared, "target long, name string, owner string, returns string, folder string, stem string, test boolean"),
        make([], "file string, name string, target long"),
        make([("f", "v0", "T0")], "file string, name string, type string"),
        make([], "src string, dst string"),
    )
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 3 * n and set(rows) == {(k, 2 * (k % n), "receiver_type", k % n + 1) for k in range(3 * n)}
    assert len(made) <= 6 + 7 + 3 * n + 4
