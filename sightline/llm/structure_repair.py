"""Least-cost repair of a conversation's structure, in the manner of Wu and Manber's cost layers.

Repaired roles must read (s?(ua)+)? by their initials. A layer holds, for each state of that grammar, the set of
places from which the rest can be repaired at exactly its cost, as the bits of one integer (bit j: j turns are
left), so a layer follows from the three before it by a few shifts and masks over all turns at once, and runs of
turns kept at no cost by the carry of an addition. The first layer in which the whole conversation is repaired tells
the cost; walking the layers back down, always with the ASCII-least edit that still ends in its layer, gives the
audit. Layers are kept sparsely and made again while walking where they would take much memory.

Edits: K keeps a turn (0), R gives it the role user or assistant (2), D deletes it (3, required for blank and
duplicate turns), I inserts an empty turn of user or assistant (2); truncated turns not deleted add 1.

Defined cases: null conv_id is a conversation of its own; null turns come first; turns of one number come by role,
then text, both null as given; an empty role has no initial and can't be kept; extra columns are not read; an empty
table gives no rows. One conversation is the unit: its texts must fit in a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import map_batches
from sightline.llm.prefix_trie import CRC32

SPACE = " \t\n\x0b\x0c\r"  # what may end a text after its last character
ENDS = ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after s, after u, after a
STEPS = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER), (USER, "a", ASSISTANT))
NEXT = {(q, role): to for q, role, to in STEPS}
LEGAL = {"su", "ua", "au"}
WHOLE = 2000  # layers that are all kept
REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired array<struct<role:string,text:string>>"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (nulls of role and text: one space) with faults by crc32(conv_id:turn) % 20: 0 drops a row (it stays
    here as dropped, without role and text), 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it the user's."""
    c = conversations
    conv_id, turn = c["conv_id"].cast("long"), c["turn"].cast("long")
    name = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    fault = F.crc32(name.cast("binary")) % 20
    rows = c.select(
        conv_id.alias("conv_id"), turn.alias("turn"), fault.alias("fault"),
        F.coalesce(c["role"].cast("string"), F.lit(" ")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit(" ")).alias("text"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).when(F.col("fault") > 0, F.col("text"))
    role = F.when(F.col("fault") == 4, "user").when(F.col("fault") > 0, F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def faults(rows: list[tuple]) -> list[str]:
    """Each row's first fault, or nothing. rows: (turn, role, text)."""
    seen, found = set(), []
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        found.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ENDS else "")
        seen.add((role, text))
    return found


class Layers:
    """Cost layers of one conversation: lists of four integers, by state."""

    def __init__(self, roles: list[str], found: list[str]):
        self.n, self.roles, self.found = len(roles), roles, found
        masks = {(role, cut): 0 for role in "sua" for cut in (0, 1)}
        self.live = [0, 0]  # turns that may stay, whole and truncated
        for i, (role, fault) in enumerate(zip(roles, found, strict=True)):
            if fault in ("", "truncated"):
                bit, cut = 1 << (self.n - i), int(fault != "")
                self.live[cut] |= bit
                if role in ("s", "u", "a"):
                    masks[role, cut] |= bit
        self.masks, self.all = masks, (1 << (self.n + 1)) - 2
        u, a = masks["u", 0], masks["a", 0]
        self.runs = (a & (u << 1)) | (u & (a << 1))

    def settle(self, layer: list[int]) -> list[int]:
        """Add the places from which turns kept at no cost lead into the layer."""
        u, a = self.masks["u", 0], self.masks["a", 0]
        kept = (layer[USER] << 1 & u) | (layer[ASSISTANT] << 1 & a)
        begun = kept << 1 & self.runs
        kept |= begun | (((begun + self.runs) ^ self.runs) & self.runs)
        layer[START] |= kept & u
        layer[SYSTEM] |= kept & u
        layer[ASSISTANT] |= kept & u
        layer[USER] |= kept & a
        layer[START] |= layer[SYSTEM] << 1 & self.masks["s", 0]
        return layer

    def after(self, three: list[list[int]]) -> list[int]:
        """The layer that follows the last three."""
        c3, c2, c1 = three
        layer = [q << 1 & self.all for q in c3]  # D
        for q, role, to in STEPS:
            layer[q] |= c1[to] << 1 & self.masks[role, 1]  # K, truncated
            if role != "s":
                layer[q] |= c2[to] | (c2[to] << 1 & self.live[0]) | (c3[to] << 1 & self.live[1])  # I, R, R of a truncated one
        return self.settle(layer)

    def solve(self) -> tuple[int, Callable[[int], list[int]]]:
        """The cost, and what gives a layer again; it is asked for layers in falling order."""
        none = [0, 0, 0, 0]
        three, marks, cost = [none, none, self.settle([1, 0, 0, 1])], {}, 0
        layers, every = [three[-1]], max(1, isqrt(9 * self.n)) if 3 * self.n > WHOLE else 1
        while not three[-1][START] >> self.n & 1:
            if cost % every == 0:
                marks[cost] = three
            three = [*three[1:], self.after(three)]
            cost += 1
            if every == 1:
                layers.append(three[-1])
        if every == 1:
            return cost, lambda c: layers[c] if c >= 0 else none
        block: dict[int, list[int]] = {}

        def layer(c: int) -> list[int]:
            if c < 0:
                return none
            if c not in block:
                at = c - c % every if c - c % every in marks else c - c % every - every
                known = {k: x for k, x in block.items() if c < k <= c + 3}
                block.clear()
                block.update(known)
                held = marks[at]
                for k in range(at, min(at + every, cost) + 1):
                    block[k] = held[-1]
                    held = [*held[1:], self.after(held)]
            return block[c]

        return cost, layer

    def walk(self) -> tuple[int, str, list[tuple[str, int | None]]]:
        """Cost, audit, and the repaired turns: (role, its turn's place or None where inserted); role K: as it was."""
        cost, layer = self.solve()
        left, q, i, audit, out = cost, START, 0, [], []
        while i < self.n or left:
            later = self.n - i - 1
            fault = self.found[i] if i < self.n else None
            stays = fault in ("", "truncated")
            cut, role = int(fault == "truncated"), self.roles[i] if i < self.n else ""
            to, kept = (ASSISTANT if q == USER else USER), NEXT.get((q, role))
            if i < self.n and layer(left - 3)[q] >> later & 1:
                audit.append("D")
                left, i = left - 3, i + 1
            elif layer(left - 2)[to] >> (self.n - i) & 1:
                audit.append("I")
                out.append((to, None))
                left, q = left - 2, to
            elif stays and kept is not None and layer(left - cut)[kept] >> later & 1:
                audit.append("K")
                out.append((None, i))
                left, q, i = left - cut, kept, i + 1
            else:
                audit.append("R")
                out.append((to, i))
                left, q, i = left - 2 - cut, to, i + 1
        names = {USER: "user", ASSISTANT: "assistant", None: None}
        return cost, "".join(audit), [(names[to], at) for to, at in out]


def repair_one(rows: list[tuple]) -> dict:
    """Figures and repaired turns of one conversation's rows (turn, role, text), in order."""
    found, initials = faults(rows), [role[:1] for _, role, _ in rows]
    cost, audit, kept = Layers(initials, found).walk()
    numbers = [turn for turn, _, _ in rows if turn is not None]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{kind: found.count(kind) for kind in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit,
        "repaired": [{"role": rows[at][1] if role is None else role, "text": "" if at is None else rows[at][2]} for role, at in kept],
    }


NAMES = [column.split()[0] for column in REPAIRED.split(", ")]


def _repair():
    state: dict = {"rows": None, "conv_id": None}

    def done() -> dict:
        return {"conv_id": state["conv_id"], **repair_one(state["rows"])}

    def table(found: list[dict]) -> dict[str, list]:
        return {name: [f[name] for f in found] for name in NAMES}

    def work(batch: pa.RecordBatch):
        found, held = [], 0
        for conv_id, turn, role, text, dropped in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped")), strict=True):
            if state["rows"] is None or state["conv_id"] != conv_id:
                if state["rows"] is not None:
                    found.append(done())
                state["conv_id"], state["rows"] = conv_id, []
            if not dropped:
                state["rows"].append((turn, role, text))
                held += len(text)
            if held > 1 << 22:
                yield table(found)
                found, held = [], 0
        if found:
            yield table(found)

    def finish():
        if state["rows"] is not None:
            yield table([done()])

    work.finish = finish
    return work


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation its faults, the least cost, the audit and the repaired turns. conversations may have a column
    dropped: such rows only name their conversation."""
    c = conversations
    dropped = c["dropped"] if "dropped" in c.columns else F.lit(False)
    role, text = (F.coalesce(c[n].cast("string"), F.lit(" ")).alias(n) for n in ("role", "text"))
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), role, text, dropped.alias("dropped"))
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return map_batches(ordered, REPAIRED, _repair)


def repaired_damage(conversations: DataFrame) -> DataFrame:
    """repair() of damaged() conversations, the repaired turns as a digest."""
    whole = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repair(damaged(conversations)).withColumn("repaired_sha256", F.sha2(whole, 256)).drop("repaired")


ORACLE = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
faulty AS (SELECT conv_id, turn, role, text, {CRC32.format(s="s")} % 20 AS f FROM named),
rows0 AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE f <> 0),
rows1 AS (
  SELECT coalesce(conv_id, -1) AS c, turn, role, text, left(role, 1) AS k, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows0),
rows2 AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS times, coalesce(lag(k) OVER (PARTITION BY c ORDER BY i), '?') || k AS pair FROM rows1),
rows3 AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM rows2),
figures AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows3 GROUP BY c),
steps(q, k, z) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
made(q, z, cost, audit) AS (
  SELECT q, q, 0, '' FROM (VALUES ('0'), ('s'), ('u'), ('a')) t(q)
  UNION ALL SELECT q, z, 2, 'I' FROM steps WHERE k <> 's'
  UNION ALL SELECT a.q, b.z, 4, 'II' FROM steps a JOIN steps b ON b.q = a.z WHERE a.k <> 's' AND b.k <> 's'),
edits AS (
  SELECT c, i, q, q AS z, 3 AS cost, 'D' AS audit, NULL AS role, '' AS text, false AS said FROM rows3, (VALUES ('0'), ('s'), ('u'), ('a')) t(q)
  UNION ALL SELECT c, i, q, z, (fault <> '')::INT, 'K', role, text, true FROM rows3 JOIN steps USING (k) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT c, i, q, z, 2 + (fault <> '')::INT, 'R', CASE z WHEN 'u' THEN 'user' ELSE 'assistant' END, text, true
  FROM rows3, steps WHERE steps.k <> 's' AND fault IN ('', 'truncated')),
best AS (
  SELECT c, 0::BIGINT AS i, '0' AS q, struct_pack(cost := 0, audit := '', said := ''::VARCHAR) AS b FROM figures
  UNION ALL
  SELECT e.c, e.i, e.z, min(struct_pack(cost := t.b.cost + m.cost + e.cost, audit := t.b.audit || m.audit || e.audit, said := t.b.said
         || CASE m.audit WHEN '' THEN '' WHEN 'I' THEN CASE m.z WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10)
            ELSE CASE m.z WHEN 'u' THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10) END
         || CASE WHEN e.said THEN e.role || ':' || e.text || chr(10) ELSE '' END))
  FROM best t JOIN made m ON m.q = t.q JOIN edits e ON e.c = t.c AND e.i = t.i + 1 AND e.q = m.z GROUP BY ALL),
ends AS (
  SELECT t.c, min(struct_pack(cost := t.b.cost + m.cost, audit := t.b.audit || m.audit, said := t.b.said
         || CASE m.audit WHEN '' THEN '' WHEN 'I' THEN CASE m.z WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10)
            ELSE CASE m.z WHEN 'u' THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10) END)) AS b
  FROM best t JOIN figures f ON f.c = t.c AND f.n = t.i JOIN made m ON m.q = t.q WHERE m.z IN ('0', 'a') GROUP BY t.c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(b.said[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS c FROM conversations) o LEFT JOIN figures USING (c) LEFT JOIN ends USING (c)"""
