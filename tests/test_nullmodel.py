"""The null model against plain loops."""

import hashlib
import random
from collections import Counter

from sightline.operators import nullmodel as nm


def one_by_one(sizes: list[int], target: int) -> list[int]:
    out = sorted(sizes)
    while out and len(out) < target and out[-1] > 1:
        x = out.pop()
        out = sorted([*out, x // 2, x - x // 2])
    while len(out) > max(1, target):
        out = sorted([out[0] + out[1], *out[2:]])
    return out


def test_sizes_together_as_one_by_one():
    rng = random.Random(4)
    for _ in range(500):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 15))]
        target = rng.randint(0, 40)
        assert sorted(Counter(nm.resized(Counter(sizes), target)).elements()) == one_by_one(sizes, target)
    assert nm.resized({}, 3) == {} and sum(s * c for s, c in nm.equal_sizes(11, 4).items()) == 11 and nm.equal_sizes(0, 4) == {}


def test_runs_match_a_plain_contraction(spark):
    rng = random.Random(7)
    types = {f"n{i}": "A" if i < 14 else "B" if i < 24 else "C" for i in range(30)}
    edges = sorted({tuple(sorted(rng.sample(sorted(types), 2))) for _ in range(60)})
    reports = sorted({(n, f"r{rng.randrange(12)}") for n in types for _ in range(2)})
    sizes = {"A": {3: 2, 2: 1}, "B": {5: 2}}  # six A's lie beyond the groups, C has none
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    groups = nm.contracted(frame(sorted(types.items()), "node_id string, type string"), sizes, 4).persist()
    got = {(r["run"], r["node_id"]): r["group"] for r in groups.collect()}
    for run in range(1, 5):
        want = {}
        for kind in "ABC":
            order = sorted((n for n in types if types[n] == kind), key=lambda n: (hashlib.md5(f"{run}:{n}".encode()).hexdigest(), n))
            widths = [s for s, c in sorted(sizes.get(kind, {}).items()) for _ in range(c)]
            for i, width in enumerate(widths):
                for n in order[:width]:
                    want[n] = f"{kind}#{i}"
                order = order[width:]
            want |= {n: n for n in order}
        assert {n: got[run, n] for n in types} == want
        links = {tuple(sorted((want[a], want[b]))) for a, b in edges if want[a] != want[b]}
        held = {}
        for n, r in reports:
            held.setdefault(want[n], set()).add(r)
        cer = round(sum(not held[a] & held[b] for a, b in links) / len(links), 6)
        link_frame = frame(edges, "a string, b string")
        row = nm.run_metrics(groups, link_frame, frame(reports, "node_id string, report_id string")).where(f"run = {run}").first()
        assert tuple(row) == (run, len(set(want.values())), len(links), cer)
        part = {g: g for g in want.values()}
        for _ in part:
            for a, b in links:
                part[a] = part[b] = min(part[a], part[b])
        sizes_ = Counter(part.values())
        row = nm.run_components(groups, link_frame).where(f"run = {run}").first()
        assert tuple(row) == (run, len(sizes_), round(max(sizes_.values()) / sum(sizes_.values()), 6))
