"""Prefix trie of conversations from globally sorted turn arrays.

A turn is the first 128 bits of the SHA-256 of its role and text, a conversation the array of its turns. The arrays
are range-sorted over all partitions, so that a trie node is an interval of rows whose longest common prefix with
their neighbours is at least its depth. Each task sweeps its range once: the common prefix with the row before tells
which stack entries (open intervals) close; a closed interval is a node. Entries on the path of a range's first or
last row may go on in a neighbour: they leave as fragments, and fragments of one prefix are stitched by sums, after
those counts are corrected that depend on what two adjacent ranges share. The stack, one conversation and LIMIT
waiting children an entry are all that a task holds.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or text is empty; turns
come by number, null first, those of one number by digest; repeated rows are turns of their own; an empty table has
no node, not even a root. One conversation is the unit: its digests (16 bytes a turn) must fit in a task's memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import durable, map_batches

WIDTH = 16  # bytes of a turn's digest
SHARED = 8  # most turns that a rebuilt conversation takes from another
SMALL = 200_000  # stitched nodes that are broadcast
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SWEPT = (
    "kind string, node binary, parent binary, part int, seq int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, n_bytes long, path_bytes long, on_first boolean, on_last boolean, ends string"
)
NAMES = [column.split()[0] for column in SWEPT.split(",")]


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of structs (turn, digest, n_bytes) in order; block is what rebuilt() groups by."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    conv_id = conversations["conv_id"].cast("long")
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(conversations["turn"].cast("long").alias("turn"), F.substring(named, 1, 2 * WIDTH).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = conversations.select(conv_id.alias("conv_id"), (conv_id - conv_id % 5).alias("block"), turn.alias("t")).where("conv_id IS NOT NULL")
    return rows.repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """Each conversation c with its first h = crc32(c) % 9 turns replaced by those of conversation c - c % 5."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    first = F.first(F.when(F.col("conv_id") == F.col("block"), F.slice("turns", 1, SHARED)), ignorenulls=True).over(Window.partitionBy("block"))
    lent = F.coalesce(F.slice(F.col("lent"), F.lit(1), h), F.slice("turns", 1, 0))
    own = F.when(F.size("turns") > h, F.slice(F.col("turns"), h + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    return arrays.withColumn("lent", first).select("block", "conv_id", F.concat(lent, own).alias("turns"))


class _Open:
    """A stack entry: an interval that may still grow."""

    __slots__ = ("conv", "n", "kids", "leaves", "saved", "n_bytes", "path_bytes", "first", "wide", "waiting", "ends", "held", "seq")

    def __init__(self, n_bytes: int, path_bytes: int, first: bool):
        self.conv, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.n_bytes, self.path_bytes, self.first, self.wide = n_bytes, path_bytes, first, False
        self.waiting, self.ends, self.held, self.seq = [], [], 0, 0


class Sweep:
    """The stack sweep over one sorted range of (conv_id, key, sizes)."""

    LIMIT = 20_000  # children that an open node keeps waiting for its smallest member
    PIECE = 1 << 20  # characters of ids that an open node keeps before they leave as a piece

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.key, self.part, self.out = b"", 0, []
        self.named: tuple[bytes, list[bytes]] = (b"", [])

    def ids(self) -> list[bytes]:
        """Names of the nodes on the path of the last row, by depth."""
        if not self.named[1] or self.named[0] != self.key:
            running, found = hashlib.sha256(), []
            for at in range(0, len(self.key) + 1, WIDTH):
                found.append(running.copy().digest())
                running.update(self.key[at : at + WIDTH])
            self.named = (self.key, found)
        return self.named[1]

    def row(self, conv: int, key: bytes, sizes: list[int], part: int) -> None:
        begun, self.part = not self.stack, part
        shared = -1 if begun else common(self.key, key)
        while len(self.stack) - 1 > shared and not begun:
            self.close(False)
        for depth in range(len(self.stack), len(sizes) + 1):
            n_bytes = sizes[depth - 1] if depth else 0
            self.stack.append(_Open(n_bytes, n_bytes + (self.stack[-1].path_bytes if depth else 0), begun))
        self.key, top = key, self.stack[-1]
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.n += 1
        top.ends.append(said := str(conv))
        top.held += len(said) + 1
        if top.held > self.PIECE:
            top.wide = True
            self.piece(top, self.ids()[len(self.stack) - 1])

    def piece(self, node: _Open, name: bytes) -> None:
        self.out.append({"kind": "piece", "node": name, "part": self.part, "seq": node.seq, "ends": ",".join(node.ends)})
        node.ends, node.held, node.seq = [], 0, node.seq + 1

    def flush(self, node: _Open, name: bytes) -> None:
        """Children of a node whose smallest member is not known here carry its name instead."""
        self.out += [child | {"parent": name} for child in node.waiting]
        node.waiting = []

    def close(self, last: bool) -> None:
        depth = len(self.stack) - 1
        node, parent = self.stack.pop(), self.stack[-1] if depth else None
        leaves, saved = node.leaves + (not node.kids), node.saved + (node.n - 1) * node.n_bytes
        found = {"depth": depth, "conv_id": node.conv, "n_convs": node.n, "n_children": node.kids, "n_leaves": leaves, "saved_tokens": saved}
        if parent is not None:
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
            parent.n, parent.kids, parent.leaves, parent.saved = parent.n + node.n, parent.kids + 1, parent.leaves + leaves, parent.saved + saved
        if node.first or last or node.wide:
            names = self.ids()
            self.flush(node, names[depth])
            if node.ends:
                self.piece(node, names[depth])
            own = {"kind": "part", "node": names[depth], "parent": names[depth - 1] if depth else None, "part": self.part}
            self.out.append(found | own | {"n_bytes": node.n_bytes, "path_bytes": node.path_bytes, "on_first": node.first, "on_last": last})
            if parent is not None:
                parent.wide = True
            return
        self.out += [child | {"parent_conv_id": node.conv} for child in node.waiting]
        parent.waiting.append(found | {"kind": "node", "ends": hashlib.sha256(",".join(node.ends).encode()).hexdigest()})
        if len(parent.waiting) > self.LIMIT:
            parent.wide = True
            self.flush(parent, self.ids()[depth - 1])

    def taken(self) -> dict[str, list]:
        out, self.out = self.out, []
        return {name: [row.get(name) for row in out] for name in NAMES}

    def end(self) -> None:
        while self.stack:
            self.close(True)


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:  # slices are compared by memcmp
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid - 1)
    return low


def _sweep():
    sweep = Sweep()

    def work(batch: pa.RecordBatch):
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "sizes", "part")), strict=True)
        for conv, key, sizes, part in rows:
            sweep.row(conv, key, sizes, part)
            if len(sweep.out) >= 10_000:
                yield sweep.taken()

    def finish():
        sweep.end()
        yield sweep.taken()

    work.finish = finish
    return work


def _joined_ids():
    """Streaming SHA-256 of each node's pieces, which come by node, part and place."""
    state = {}

    def work(batch: pa.RecordBatch):
        done = []
        for node, ends in zip(*(batch.column(c).to_pylist() for c in ("node", "ends")), strict=True):
            if node in state:
                state[node].update(b",")
            else:
                done += [(k, h.hexdigest()) for k, h in state.items()]
                state.clear()
                state[node] = hashlib.sha256()
            state[node].update(ends.encode())
        yield {"node": [k for k, _ in done], "ends_sha256": [h for _, h in done]}

    def finish():
        yield {"node": list(state), "ends_sha256": [h.hexdigest() for h in state.values()]}

    work.finish = finish
    return work


def _corrected(parts: DataFrame) -> DataFrame:
    """Fragments with the counts that hold once adjacent ranges are seen together.

    Where the path of a range's first row shares s turns with the path of the last row before it, the nodes at depths
    up to s do not begin there: they are no further children, and save their bytes once more. Where it extends or
    repeats that last row as a whole, the last row's node is no leaf of its range."""
    ranges = parts.where("depth = 0").select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))  # a row for each range
    last = parts.where("on_last").select("part", "node", "depth").join(ranges, "part")
    first = parts.where("on_first").select(F.col("part").alias("next"), "node", F.col("depth").alias("same"), F.col("path_bytes").alias("same_bytes"))
    links = last.join(first, ["next", "node"], "left").groupBy("part", "next").agg(F.max("depth").alias("length"), F.max("same").alias("same"), F.max("same_bytes").alias("same_bytes"))
    before = links.select(F.col("next").alias("part"), "same", "same_bytes")
    after = links.select("part", (F.col("same") == F.col("length")).alias("goes_on"))
    on = parts.join(before.where("part IS NOT NULL"), "part", "left").join(after, "part", "left")
    going = F.col("on_first") & (F.col("depth") <= F.col("same"))
    return on.select(
        "node", "parent", "depth", "conv_id", "n_convs",
        (F.col("n_children") - F.coalesce((F.col("on_first") & (F.col("depth") < F.col("same"))).cast("long"), F.lit(0))).alias("n_children"),
        (F.col("n_leaves") - F.coalesce((F.col("on_last") & F.col("goes_on")).cast("long"), F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce(F.when(going, F.col("same_bytes") - F.col("path_bytes") + F.col("n_bytes")), F.lit(0))).alias("saved_tokens"),
    )


def trie(arrays: DataFrame) -> DataFrame:
    """A row of NODE for each distinct prefix of the arrays (conv_id, turns)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = arrays.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes"))
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    swept = durable(map_batches(ordered, SWEPT, _sweep), "swept")
    pieces = swept.where("kind = 'piece'").select("node", "part", "seq", "ends")
    ends = map_batches(pieces.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ends"), "node binary, ends_sha256 string", _joined_ids)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = _corrected(swept.where("kind = 'part'")).groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums)
    whole = durable(whole.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))), "stitched")
    nodes = swept.where("kind = 'node'").withColumnRenamed("ends", "ends_sha256")
    known = nodes.where("parent IS NULL").select(*NODE)
    named = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = F.broadcast(named) if whole.count() <= SMALL else named
    columns = [c for c in NODE if c != "parent_conv_id"]
    rest = nodes.where("parent IS NOT NULL").select("parent", *columns).unionByName(whole.select("parent", *columns))
    return known.unionByName(rest.join(named, "parent", "left").select(*NODE))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(turn_arrays(conversations))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share openings: see rebuilt()."""
    return trie(rebuilt(turn_arrays(conversations)))


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of prefix_trie() with role and text of their last turn (the root: null)."""
    c = conversations
    role, text = (F.coalesce(c[n].cast("string"), F.lit("")).alias(n) for n in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), role, text)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.substring(digest, 1, 2 * WIDTH), "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(order).cast("long")).drop("turn")
    return nodes.join(rows, ["conv_id", "depth"], "left")


#: crc32 of a short ASCII string s, unsigned, in DuckDB: fixed start, end and polynomial of that checksum.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::BIGINT)),
  lambda x, b: list_reduce(list_concat([xor(x, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""

ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {CRC32.format(s="CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM own)),
moved AS (
  SELECT i.c, o.r, o.t, o.p FROM ids i JOIN own o ON o.c = i.c - i.c % 5 AND o.p <= i.h
  UNION ALL SELECT i.c, o.r, o.t, 1000 + o.p FROM ids i JOIN own o ON o.c = i.c AND o.p > i.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, sha256(length(r)::VARCHAR || ':' || r || t) AS k, strlen(t) AS b FROM moved),
prefixes AS (
  SELECT c, d, b, sha256(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM ids),
above AS (SELECT c, d, b, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d)) AS parent, max(d) OVER (PARTITION BY c) AS n FROM prefixes),
nodes AS (
  SELECT node, any_value(parent) AS parent, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM above GROUP BY node, d),
kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
told AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.parent = nodes.node),
lines AS (SELECT DISTINCT p.node AS top, q.node FROM nodes q JOIN above x ON x.c = q.conv_id AND x.d = q.d JOIN above p ON p.c = x.c AND p.d <= x.d),
sums AS (SELECT top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM lines JOIN told USING (node) GROUP BY top)
SELECT t.conv_id, t.d::BIGINT AS depth, up.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, t.ends_sha256
FROM told t JOIN sums s ON s.top = t.node LEFT JOIN nodes up ON up.node = t.parent"""
