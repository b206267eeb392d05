"""Generations and routes against brute force on small tables."""

import random

from tessera.operators import generations, routes

NODE = "key long, name string, file string, kind string, body string, evidence string, origin string"


def step(state, changed, new, links, deleted):
    """written() over plain dictionaries."""
    nodes, edges = state
    files = {f for f in changed}
    by_key = {}
    for r in new:
        by_key.setdefault(r[0], []).append(r)
    rows = {}
    for k, rs in by_key.items():
        order = lambda r: (r[6] != "EXTRACTED", r[4], r[1], r[2], r[3], r[6])
        best = min(rs, key=order)
        said = [r for r in rs if r[5] is not None]
        rows[k] = (*best[:5], min(said, key=order)[5] if said else None, best[6])
    live = {k: n for k, n in nodes.items() if n[7] == "APPROVED"}
    full = {r[2] for r in rows.values()}
    degraded = {f for f in files - full if sum(n[2] == f for n in live.values()) >= 3}
    read = files - degraded
    out = {}
    for k, n in nodes.items():
        lost = n[2] in deleted or n[2] in read and n[3] not in generations.LASTING
        out[k] = (*n[:7], "ARCHIVED" if lost else n[7])
    for k, r in rows.items():
        evidence = r[5] if r[5] is not None or k not in nodes or nodes[k][4] != r[4] else nodes[k][5]
        out[k] = (*r[:5], evidence, r[6], "APPROVED")
    alive = {k for k, n in out.items() if n[7] == "APPROVED"}
    held = {e for e in edges if nodes.get(e[0]) is None or nodes[e[0]][2] not in read | deleted} | {(*e, None) for e in links}
    after = set()
    for s, d, kind, called in held:
        if s not in alive:
            continue
        if d is not None and d not in alive:
            if kind != "CALLS":
                continue
            d, called = None, out[d][1] if d in out else None
        if d is None:
            same = [k for k in alive if out[k][1] == called]
            if len(same) == 1 and (same[0] not in live) and same[0] in rows:
                d, called = same[0], None
        after.add((s, d, kind, called))
    return (out, after), degraded


def test_generations(spark):
    rng = random.Random(6)
    files = [f"f{k}" for k in range(6)]
    graph, state, members = generations.start(spark), ({}, set()), set()
    for generation in range(1, 5):
        changed = set(rng.sample(files, 4)) if generation > 1 else set(files)
        deleted = {rng.choice(files)} if generation == 3 else set()
        changed -= deleted
        new = []
        for f in sorted(changed):
            if rng.random() < 0.25 and generation > 1:
                continue
            for k in range(7):
                if rng.random() < 0.6:
                    key = int(f[1]) * 10 + k
                    for _ in range(rng.choice([1, 1, 2])):
                        new.append((key, f"n{key % 9}", f, rng.choice(["METHOD", "METHOD", "FILE"]), rng.choice("ab"), rng.choice([None, "e1", "e2"]), rng.choice(["EXTRACTED", "INFERRED"])))
        sources = sorted({r[0] for r in new})
        every = sorted(set(state[0]) | set(sources)) or [0]
        links = sorted({(s, rng.choice(every), rng.choice(["CALLS", "CALLS", "IMPORTS"])) for s in sources for _ in range(2)})
        make = spark.createDataFrame
        graph = generations.written(graph, generation, make([(f,) for f in sorted(changed)], "file string"), make(new, NODE), make(links, "src long, dst long, edge_type string"), make([(f,) for f in deleted], "file string"))
        state, degraded = step(state, changed, new, links, deleted)
        assert {tuple(r) for r in graph.nodes.select(*[c.split()[0] for c in NODE.split(", ")], "status").collect()} == set(state[0].values())
        assert {tuple(r) for r in graph.edges.select("src", "dst", "edge_type", "called").collect()} == state[1]
        assert {r[0] for r in graph.degraded.collect()} == degraded
        members |= {(generation, k) for k, n in state[0].items() if n[7] == "APPROVED"}
    assert {tuple(r) for r in graph.members.collect()} == members


def meets(a, b):
    return len(a) == len(b) and all(x == y or "{}" in (x, y) for x, y in zip(a, b, strict=True))


def test_routes(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["{}", "{id}", ":x", "<y>", "a", "b", "c", "D"])
    path = lambda n: "/" + "/".join(word() for _ in range(n))
    verb = lambda: rng.choice(["GET", "POST", None])
    given = [(k, verb(), path(rng.randint(1, 4))) for k in range(14)] + [(90, "GET", "/v1/items/{id}/parts"), (91, "GET", "/solo/one"), (92, None, "/")]
    calls = [(k, verb(), "http://h:80" * (k % 2) + path(rng.randint(1, 5)) + "?q=1" * (k % 3 == 0)) for k in range(250)]
    calls += [(900, "GET", "https://x/base/v1/items/7/parts"), (901, "POST", "https://x/base/v1/items/7/parts"), (902, "GET", "/deep/er/solo/one"), (903, None, ""), (904, None, None)]

    def parts(p):
        p = (p or "").lower()
        p = p.split("://", 1)[1].partition("/")[2] if "://" in p else p
        return ["{}" if x[0] in "{:<" else x for x in p.partition("?")[0].split("/") if x]

    known = [(h, v, parts(p)) for h, v, p in given if parts(p)]
    want = set()
    for call, v, p in calls:
        s = parts(p)
        if not s:
            continue
        fits = lambda w, v=v: v is None or w is None or v == w
        tiers = [("equal", {h for h, w, r in known if fits(w) and r == s}), ("pattern", {h for h, w, r in known if fits(w) and meets(r, s)})]
        tiers += [("suffix", {h for h, w, r in known if fits(w) and meets(r, s[-n:])}) for n in range(len(s) - 1, 1, -1)]
        tier, found = next(((t, f) for t, f in tiers if f), (None, set()))
        if len(found) == 1:
            want.add((call, *found, tier))
    got = routes.served(spark.createDataFrame(calls, "call long, verb string, path string"), spark.createDataFrame(given, "handler long, verb string, path string"))
    assert {tuple(r) for r in got.collect()} == want
    assert (900, 90, "suffix") in want and {t for _, _, t in want} == set(routes.TIERS)
