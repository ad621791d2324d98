"""Alignment of buckets against plain loops."""

import itertools
import json
import math
import random
from collections import Counter

from sightline.operators import align as al
from sightline.operators.backend import RuleBackend


def test_chunks_along_a_budget(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(1, 30)) for g in "abc" for i in range(rng.randint(1, 60))] + [("d", 0, 500), ("d", 1, 1), ("d", 2, 500)]
    want = {}
    for g, own in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        chunk, held = 0, 0
        for _, i, size in own:
            if held and 10 + held + size > 60:
                chunk, held = chunk + 1, 0
            held += size
            want[g, i] = chunk
    got = al.token_chunks(spark.createDataFrame(rows, "g string, i long, size long"), "g", "i", "size", 60, 10).collect()
    assert {(r["g"], r["i"]): r["chunk"] for r in got} == want
    assert al.token_chunks(spark.createDataFrame([], "g string, i long, size long"), "g", "i", "size", 60).count() == 0


def test_pairs_stay_in_their_window(spark):
    class Failing(RuleBackend):
        def complete(self, task, items):
            if any("bad" in m for x in items for m in x["members"]):
                raise ValueError("no answer")
            return super().complete(task, items)

    rows = [("k", f"same {c}") for c in "abcdefgh"] + [("one", "alone"), ("fails", "same bad"), ("fails", "same x"), ("odd", "p q r"), ("odd", "p q s")]
    frame = spark.createDataFrame(rows, "bucket string, entity string")
    got = {(r["bucket"], r["a"], r["b"], r["score"]) for r in al.proposed_pairs(frame, "bucket", 3, Failing).collect()}
    names = [f"same {c}" for c in "abcdefgh"]
    close = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = {("k", a, b, round(close(a, b), 6)) for w in range(0, 8, 3) for a, b in itertools.combinations(names[w : w + 3], 2) if close(a, b) >= 0.5}
    assert got == want | {("odd", "p q r", "p q s", 0.5)}


def cosines(texts: dict[str, str]) -> dict[tuple[str, str], float]:
    counts = {i: Counter(t.lower()[k : k + n] for n in (1, 2) for k in range(len(t) - n + 1)) for i, t in texts.items()}
    df = Counter(g for c in counts.values() for g in c)
    raw = {i: {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()} for i, c in counts.items()}
    unit = {i: {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()} for i, w in raw.items()}
    return {(a, b): round(sum(x * unit[b].get(g, 0) for g, x in unit[a].items()), 9) for a, b in itertools.combinations(sorted(texts), 2)}


def linked(sims: dict, ids: list, threshold: float) -> set[frozenset]:
    """Complete linkage over the whole matrix."""
    clusters = [[i] for i in sorted(ids)]
    while True:
        best = min(((-min(sims[tuple(sorted((x, y)))] for x in a for y in b), min(a), min(b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j), default=None)
        if best is None or -best[0] < threshold:
            return {frozenset(c) for c in clusters}
        clusters[best[3]] += clusters.pop(best[4])
        clusters.sort(key=min)


def test_semantic_groups_match_the_whole_matrix(spark):
    rng = random.Random(5)
    stems = ["payment fails at checkout", "app crashes on start", "video does not load", "login code never comes"]
    texts = {}
    for i in range(40):
        t = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
        texts[f"b{i:02}"] = "".join(t)
    frame = spark.createDataFrame(list(texts.items()), "id string, text string")
    sims = cosines(texts)
    pairs = {(r["a"], r["b"]): r["similarity"] for r in al.similar_pairs(frame, 0.85).collect()}
    assert set(pairs) == {p for p, s in sims.items() if s >= 0.85} and all(abs(pairs[p] - sims[p]) < 1e-6 for p in pairs)
    want = {g for g in linked(sims, list(texts), 0.85) if len(g) > 1}
    copies = frame.unionAll(spark.createDataFrame([("z1", texts["b00"]), ("z0", "only copies"), ("z2", "only copies"), ("e", " ")], "id string, text string"))
    for rows, extra in ((al.semantic_groups(frame), {}), (al.semantic_groups(frame, largest=3), None)):
        groups = {}
        for r in rows.collect():
            groups.setdefault(r["group"], set()).add(r["id"])
        assert all(g == min(ids) for g, ids in groups.items())
        assert {frozenset(x) for x in groups.values()} == {g for g in want if extra is not None or len(g) <= 3}
    groups = {}
    for r in al.semantic_groups(copies).collect():
        groups.setdefault(r["group"], set()).add(r["id"])
    assert {"z0", "z2"} in groups.values() and any({"b00", "z1"} <= g for g in groups.values()) and not any("e" in g for g in groups.values())


def plain_rounds(buckets: dict, most: int, budget: int, overhead: int) -> tuple[dict, list[int]]:
    counts = [len(buckets)]
    for _ in range(most):
        groups = {}
        for b, x in buckets.items():
            for k in x["keywords"]:
                groups.setdefault(k, set()).add(b)
        parent = {b: b for b in buckets}

        def find(b):
            while parent[b] != b:
                b = parent[b]
            return b

        for ids in groups.values():
            chunks, held = [[]], 0
            for b in sorted(ids):
                size = len(buckets[b]["concept"]) + len("".join(buckets[b]["examples"])) + 40
                if held and overhead + held + size > budget:
                    chunks.append([])
                    held = 0
                chunks[-1].append(b)
                held += size
            for chunk in chunks:
                for group in RuleBackend().merges({"members": chunk, "concepts": [buckets[b]["concept"] for b in chunk]}):
                    for other in group[1:]:
                        a, b = sorted((find(group[0]), find(other)))
                        parent[b] = a
        out = {}
        for b, x in buckets.items():
            root = find(b)
            new = out.setdefault(root, {"concept": buckets[root]["concept"], "examples": set(), "keywords": set(), "entities": set()})
            for c in ("examples", "keywords", "entities"):
                new[c] |= set(x[c])
        buckets = out
        counts.append(len(buckets))
        if counts[-1] == counts[-2]:
            break
    return buckets, counts


def test_merge_rounds_match_a_plain_loop(spark):
    rng = random.Random(8)
    words = ["red", "blue", "cold", "hot", "pump", "valve"]
    buckets = {f"b{i:02}": {"concept": " ".join(rng.sample(words, 3)), "examples": [rng.choice(words)], "keywords": rng.sample(words, 2), "entities": [f"e{i}"]} for i in range(40)}
    rows = [(b, x["concept"], "", x["examples"], x["keywords"], x["entities"]) for b, x in buckets.items()]
    frame = spark.createDataFrame(rows, "bucket_id string, concept string, definition string, examples array<string>, keywords array<string>, entities array<string>")
    for most in (1, 4):
        got, counts = al.merge_rounds(frame, most=most, threshold=1.1, budget=250, overhead=20)  # 1.1: no semantic groups
        want, expected = plain_rounds(buckets, most, 250, 20)
        assert counts == expected
        assert {r["bucket_id"]: (r["concept"], *(set(r[c]) for c in ("examples", "keywords", "entities"))) for r in got.collect()} == {b: (x["concept"], x["examples"], x["keywords"], x["entities"]) for b, x in want.items()}
    assert counts[-1] == counts[-2] and len(counts) <= 5  # it stopped as nothing changed

    class Silent(RuleBackend):
        def complete(self, task, items):
            return "not json"

    assert al.merge_rounds(frame, Silent, 3, 1.1)[1] == [40, 40]


def plain_attach(buckets, n, merge, attach, smallest):
    sig = lambda items: set().union(*(al.grams(e, n) for e in items))
    score = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    out = []
    for items in buckets:
        scores = [score(sig(items), sig(b)) for b in out]
        if scores and max(scores) >= merge:
            out[scores.index(max(scores))] += items
        else:
            out.append(list(items))
    large = [b for b in out if len(b) >= smallest]
    sigs, gone = [sig(b) for b in large], []
    for b in [b for b in out if len(b) < smallest]:
        scores = [score(sig(b), s) for s in sigs]
        if scores and max(scores) >= attach:
            large[scores.index(max(scores))] += b
            gone.append(b)
    return [b for b in out if not any(b is g for g in gone)]


def test_merge_and_attach_with_ties(spark):
    rng = random.Random(2)
    for _ in range(200):
        buckets = [[("".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 12))]
        args = (2, rng.choice((0.3, 0.6)), rng.choice((0.2, 0.4)), 2)
        assert al.merge_and_attach([list(b) for b in buckets], *args) == plain_attach(buckets, *args), json.dumps(buckets)
    rows = [("T", "ab", 0, "abc"), ("T", "ab", 0, "abd"), ("T", "zz", 0, "abce"), ("U", "q", 0, "q")]
    got = {(r["type"], r["entity"], r["bucket"], r["chunk"]) for r in al.coarse_buckets(spark.createDataFrame(rows, "type string, block string, chunk long, entity string"), 2).collect()}
    assert {(t, e) for t, e, _, _ in got} == {(r[0], r[3]) for r in rows} and max(k for *_, k in got) == 1
