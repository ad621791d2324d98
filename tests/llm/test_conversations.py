import hashlib
import itertools
import random
import zlib

import pytest

from sightline.llm import prefix_trie, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        kids = sum(len(x) == len(node) + 1 for x in below)
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns_of(rows) -> dict[int, list[tuple[str, str]]]:
    convs: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in convs.items()}


def shared(convs: dict) -> dict:
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in convs.items()}


@pytest.mark.parametrize(("ranges", "limit", "piece"), [(1, 20_000, 1 << 20), (7, 1, 5), (40, 3, 40)])
def test_trie_matches_brute_force(spark, monkeypatch, ranges, limit, piece):
    rng = random.Random(ranges)
    rows = [(c, t, rng.choice(("user", None)), rng.choice("ab") * rng.randint(0, 2)) for c in range(200) for t in range(rng.choice((1, 2, 3, 5, 9)))]
    rows += [(c, t, "user", "copy") for c in range(300, 420) for t in range(3)] + [(1000, t, "user", "é") for t in range(400)]
    rows += [(None, 0, "user", "x"), (500, None, None, None), (500, 0, "user", "after null")]
    frame = spark.createDataFrame(rows, SCHEMA)
    convs = turns_of(rows)
    swept = prefix_trie.turn_arrays(frame)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(ranges)}
    held = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(prefix_trie.Sweep, "LIMIT", limit)
    monkeypatch.setattr(prefix_trie.Sweep, "PIECE", piece)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert {tuple(r) for r in prefix_trie.trie(swept).collect()} == brute_trie(convs)
        assert {tuple(r) for r in prefix_trie.rebuilt_trie(frame).collect()} == brute_trie(shared(convs))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_sweep_hands_on_wide_nodes_and_long_lists_of_ids():
    """The sweep alone, limits of a few: what one range hands on adds up to what it would have told itself."""
    rng = random.Random(3)
    convs = {c: tuple(rng.choice((b"a", b"b")) * prefix_trie.WIDTH for _ in range(rng.randint(0, 4))) for c in range(80)}
    ordered = sorted((b"".join(x), c) for c, x in convs.items())

    class Narrow(prefix_trie.Sweep):
        LIMIT, PIECE = 1, 4

    for kind in (prefix_trie.Sweep, Narrow):
        sweep = kind()
        for key, c in ordered:
            sweep.row(c, key, [1] * (len(key) // prefix_trie.WIDTH), 0)
        sweep.end()
        known = {r["node"]: r["conv_id"] for r in sweep.out if r["kind"] == "part"}
        ends: dict[bytes, list[str]] = {}
        for r in sweep.out:
            if r["kind"] == "piece":
                ends.setdefault(r["node"], []).append(r["ends"])
        got = set()
        for r in sweep.out:
            if r["kind"] != "piece":
                said = r["ends"] if r["kind"] == "node" else hashlib.sha256(",".join(ends.get(r["node"], [])).encode()).hexdigest()
                parent = r.get("parent_conv_id") if r.get("parent") is None else known[r["parent"]]
                got.add((r["conv_id"], r["depth"], parent, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], said))
        assert got == brute_trie({c: [("", "x" if t[:1] == b"a" else "y") for t in x] for c, x in convs.items()})


def test_trie_of_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.rebuilt_trie(empty).count() == 0
    rows = [(1, 0, "user", "a", 5, b"x"), (1, 0, "user", "a", 6, b"y"), (2, 0, "user", "a", 7, b"z")]
    frame = spark.createDataFrame(rows, SCHEMA + ", depth int, key binary")
    nodes = prefix_trie.prefix_trie(frame)
    assert {tuple(r)[:6] for r in nodes.collect()} == {(1, 0, None, 2, 1, 1), (1, 1, 1, 2, 1, 1), (1, 2, 1, 1, 0, 1)}
    told = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in prefix_trie.node_texts(nodes, frame).collect()}
    assert told == {(1, 0): (None, None), (1, 1): ("user", "a"), (1, 2): ("user", "a")}


# Repair


def cheapest(rows: list[tuple]) -> tuple[int, str, str]:
    """Least cost, least audit, repaired text: forward over all states, every tie kept by string order."""
    found = structure_repair.faults(rows)
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    named = {"u": "user", "a": "assistant"}
    best = {"0": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for q, (cost, audit, said) in list(out.items()):
                for k in "ua":
                    if to := step.get((q, k)):
                        new = (cost + 2, audit + "I", (*said, named[k] + ":"))
                        out[to] = min(out.get(to, new), new, key=lambda x: x[:2])
        return out

    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for q, (cost, audit, said) in inserted(best).items():
            options = [(q, 3, "D", ())]
            if fault in ("", "truncated"):
                more = int(fault == "truncated")
                if to := step.get((q, role[:1])):
                    options.append((to, more, "K", (f"{role}:{text}",)))
                options += [(to, 2 + more, "R", (f"{named[k]}:{text}",)) for k in "ua" if (to := step.get((q, k)))]
            for to, price, edit, line in options:
                new = (cost + price, audit + edit, (*said, *line))
                after[to] = min(after.get(to, new), new, key=lambda x: x[:2])
        best = after
    cost, audit, said = min((x for q, x in inserted(best).items() if q in "0a"), key=lambda x: x[:2])
    return cost, audit, "\n".join(said)


@pytest.mark.parametrize("whole", [2000, 0])
def test_layers_match_brute_force(monkeypatch, whole):
    monkeypatch.setattr(structure_repair, "WHOLE", whole)  # 0: layers are made again while walking
    rng = random.Random(whole)
    short = [list(x) for n in range(5) for x in itertools.product(("system", "user", "assistant", "tool"), repeat=n)]
    cases = [[(i, role, rng.choice(("Good.", "cut", f"text {i}.", "", " \n"))) for i, role in enumerate(roles)] for roles in short]
    for n in (6, 9, 30, 120):
        cases += [[(i, rng.choice(("system", "user", "assistant", "user", "assistant", "")), rng.choice((f"ok {i}.", f"cut {i}", "Same!", " "))) for i in range(n)] for _ in range(40)]
    for rows in cases:
        got = structure_repair.repair_one(rows)
        said = "\n".join(f"{t['role']}:{t['text']}" for t in got["repaired"])
        assert (got["cost"], got["audit"], said) == cheapest(rows), rows


def test_a_very_long_conversation_keeps_few_layers():
    rows = [(i, ("user", "assistant", "assistant")[i % 3], f"turn {i}" + "." * (i % 5 > 0)) for i in range(3000)]
    got = structure_repair.repair_one(rows)
    assert (got["cost"], got["audit"]) == cheapest(rows)[:2]


def test_repair_on_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, 0, None, None), (1, 0, "assistant", "Yes."), (None, 3, "user", "Alone"), (2, 0, "system", "Only."), (3, 5, "user", "Q?"), (3, 5, "user", "Q?"), (3, 9, "assistant", "x" * 2_000_000 + ".")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", cost long, audit string")
    got = {r["conv_id"]: r for r in structure_repair.repair(frame).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1]["audit"] == "KDK" and got[1]["blank"] == 1 and got[1]["gaps"] == 0 and got[1]["illegal"] == 2
    assert got[None]["audit"] == "D" and got[None]["truncated"] == 1  # keeping it takes an answer and its fault: 3, and D is before K
    assert got[2]["audit"] == "D" and got[2]["repaired"] == []
    assert got[3]["audit"] == "KDK" and got[3]["gaps"] == 3 and len(got[3]["repaired"][1]["text"]) == 2_000_001
    assert structure_repair.repaired_damage(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_matches_its_definition(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}! and. more?") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if f == 1 else text.translate(str.maketrans("", "", ".!?")) if f == 2 else text
        want += [(c, t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    got = structure_repair.damaged(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, (tuple(r)[:4] for r in got.collect() if not r["dropped"]))) == sorted(map(str, want))
    out = {r["conv_id"]: r for r in structure_repair.repaired_damage(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {r[0] for r in rows}
    for c in out:
        cost, audit, said = cheapest([x[1:] for x in sorted((w for w in want if w[0] == c), key=lambda w: (w[1] is not None, w[1] or 0, w[2], w[3]))])
        assert (out[c]["cost"], out[c]["audit"], out[c]["repaired_sha256"]) == (cost, audit, hashlib.sha256(said.encode()).hexdigest())
