"""Touches, reverts and episodes against brute force."""

import random
from datetime import datetime, timedelta

from tessera.operators import history


def test_touches_follow_lines_through_versions(spark):
    rng = random.Random(14)
    hunks, declared, want = [], [], set()
    for file in range(6):
        versions, fresh = [[f"{file}:{k}" for k in range(60)]], iter(range(10**6))
        for seq in range(1, 6):
            old, new, at = versions[-1], [], 0
            while at < len(old):
                step = rng.randint(3, 14)
                new += old[at : at + step]
                at += step
                if at < len(old) and rng.random() < 0.6:
                    removed, added = rng.randint(0, 3), rng.randint(0, 3)
                    removed = min(removed, len(old) - at)
                    if removed or added:
                        hunks.append((100 * file + seq, seq, file, len(new) + 1, removed, added))
                        new += [f"{file}:new{next(fresh)}" for _ in range(added)]
                        at += removed
                        new += old[at : at + 1]
                        at += 1
            versions.append(new)
        spans = [(k, rng.randint(1, len(versions[-1]) - 8)) for k in range(8)]
        spans = {1000 * file + k: (s, s + rng.randint(0, 7)) for k, s in spans}
        declared += [(file, i, s, e) for i, (s, e) in spans.items()]
        for seq in range(5, 0, -1):
            own = [h for h in hunks if h[2] == file and h[1] == seq]
            new, old = versions[seq], versions[seq - 1]
            where = {x: k + 1 for k, x in enumerate(old)}
            hit = {i for i, (s, e) in spans.items() for h in own if h[3] <= e and s <= h[3] + max(h[5], 1) - 1}
            if own:
                want |= {(own[0][0], file, i) for i in hit} or {(own[0][0], file, None)}
            before = {}
            for i, (s, e) in spans.items():
                # a line that is new stands for the old lines between its surviving neighbours
                a = where.get(new[s - 1]) or max([where[x] for x in new[: s - 1] if x in where], default=0) + 1
                b = where.get(new[e - 1]) or min([where[x] for x in new[e:] if x in where], default=len(old) + 1) - 1
                if a <= b:
                    before[i] = (a, b)
            spans = before
    got = history.declaration_touches(
        spark.createDataFrame(hunks, "commit long, seq int, file int, first int, removed int, added int").repartition(3),
        spark.createDataFrame(declared, "file int, id long, start_line int, end_line int"),
    )
    assert {tuple(r) for r in got.collect()} == want and any(i is None for _, _, i in want)


def test_reverts(spark):
    base = [("a", "+", "x"), ("a", "+", "x"), ("b", "-", "y")]
    swap = [(f, "-" if s == "+" else "+", t) for f, s, t in base]
    patches = {
        1: base,
        2: swap,  # undoes 1
        3: base,  # the patch again: it undoes 2, as it gives what 2 took
        4: swap[1:],  # a part
        5: [("c", "+", "x"), ("c", "+", "x"), ("b", "-", "y")],  # another file
        6: [*swap, ("z", "+", "more")],
        7: swap,  # undoes 3, the latest
        8: [("m", "+", "same"), ("m", "-", "same")],
        9: [("m", "-", "same"), ("m", "+", "same")],  # undoes nothing, as nothing changed
    }
    rows = [(c, c, f, s, t) for c, p in patches.items() for f, s, t in p]
    got = history.reverts(spark.createDataFrame(rows, "commit long, ts long, file string, sign string, text string").repartition(4))
    assert {tuple(r) for r in got.collect()} == {(2, 1), (3, 2), (7, 3)}


def test_episodes(spark):
    rng = random.Random(8)
    begin = datetime(2024, 1, 1)
    when = lambda: begin + timedelta(minutes=rng.randrange(9000))
    prompts = [(scope, when(), 1000 * scope + k) for scope in range(3) for k in range(12)]
    kinds = {"read": "r", "edit": "e", "search": "s", "pass": "ok", "fail": "no"}
    events = [(rng.randrange(4), when(), k, rng.choice([*kinds.values(), "other"]), rng.choice(["f", "g", "h", None]), f"v{rng.randrange(4)}", f"v{rng.randrange(4)}") for k in range(600)]
    out, outcome = {}, {}
    for scope, ts, event, kind, file, old, _ in events:
        before = [p for p in prompts if p[0] == scope and p[1] <= ts]
        if not before:
            continue
        prompt = max(before, key=lambda p: (p[1], p[2]))[2]
        if kind in ("ok", "no"):
            outcome[prompt] = max(outcome.get(prompt, (begin, -1, "")), (ts, event, {"ok": "pass", "no": "fail"}[kind]))
        if file and kind in ("r", "e", "s"):
            row = out.setdefault((prompt, file), [0, 0, 0, 0])
            row["res".index(kind)] += 1
            undone = any(s == scope and f == file and k == "e" and n == old and t > ts for s, t, _, k, f, _, n in events)
            row[3] += kind == "e" and not undone
    want = {(p, f, *row, outcome[p][2] if p in outcome else "open") for (p, f), row in out.items()}
    make = spark.createDataFrame
    p, e = make(prompts, "scope int, ts timestamp, prompt long"), make(events, "scope int, ts timestamp, event long, kind string, file string, old_fp string, new_fp string")
    got = history.episodes(p, e, kinds, None, None)
    assert {tuple(r) for r in got.collect()} == want
    few = history.episodes(p, e, kinds, files=1, latest=2).collect()
    newest = {x[2] for s in range(3) for x in sorted((x for x in prompts if x[0] == s), key=lambda x: (x[1], x[2]))[-2:]}
    assert {r["prompt"] for r in few} <= newest and len({r["prompt"] for r in few}) == len(few)
