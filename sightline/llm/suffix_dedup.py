"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts elsewhere.

1. Anchors: of the GRAM-byte strings in a LENGTH-byte string one is chosen by its hash alone (winnowing), so
   two equal strings have an anchor in common. Anchors that occur once in the corpus rule out all strings
   around them; only hashes travel.
2. An anchor's surroundings are the at most 2 * LENGTH - GRAM bytes that strings with it can reach. Where all
   of them occur again, all are repeated. Anchors that occur in different surroundings remain.
3. One copy of each of those surroundings goes to a shard by its anchor, so that equal strings meet. In a shard
   what follows the anchors, and, read backwards, what precedes them are sorted into suffix arrays
   (Larsson-Sadakane); Kasai's common prefixes tell which strings are repeated. Shards that share an anchor are
   merged by binary search of one's suffixes in the other's order. Anchors with more than HOT surroundings are first split by the bytes to the left or right:
   every string holds one half or the other, so halves are groups of their own, again and again.

Texts that occur twice are repeated as a whole; a task uses one copy of those it meets. A text is told by 128 bits of
its SHA-256, an anchor in its surroundings by two hashes of 64 bits.

Defined cases: null text counts as empty; texts below LENGTH bytes lose nothing; repeated rows are copies;
matches never cross texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import durable, map_batches, scoped, slices, texts
from sightline.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 200, 100
SHARD, HOT, SENT = 2048, 8192, 500_000
_BASE = 0x9E3779B97F4A7C15


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("text")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of x[i:i+width], by doubling."""
    span = 1
    while 2 * span <= width:
        x, span = best(x[:-span], x[span:]), 2 * span
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of data[i:i+gram] for each i, by doubling."""
    h, span, out, done, factor = data.astype(np.uint64) + np.uint64(1), 1, None, 0, _BASE
    n = len(data) - gram + 1
    while span <= gram:
        if gram & span:  # the powers of two that make up gram, laid end to end
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(factor) + part
            done += span
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor, span = factor * factor & (1 << 64) - 1, 2 * span
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some whole string of a text."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    least = _sliding(h, width, np.minimum)  # of the strings that begin at each position
    whole = np.zeros(len(data) + 1, np.int64)
    inner = offsets[1:-1]
    np.add.at(whole, np.maximum(inner - length + 1, 0), 1)  # a string may not run over a text's end
    np.add.at(whole, inner, -1)
    least = np.where(np.cumsum(whole)[: len(least)] > 0, np.uint64(0), least)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    return at, h[at]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_class(raw: bytes) -> bytes:
    """What texts share that are equal, and no others: of 10^10 texts two differ under it with a chance below 10^-18."""
    return hashlib.sha256(raw).digest()[:16]


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id, cls (text_class), n_bytes, sha."""

    def make():
        def work(batch):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            yield {
                "doc_id": batch.column("doc_id"), "cls": [text_class(t) for t in raw],
                "n_bytes": [len(t) for t in raw], "sha": [hashlib.sha256(t).hexdigest() for t in raw],
            }

        return work

    return map_batches(texts(docs), "doc_id long, cls binary, n_bytes long, sha string", make)


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """fp (anchor), ctx (its surroundings), cls, pos, a, b (surroundings' ends in the text)."""

    def make():
        met = set()

        def work(batch):
            for cut in slices(batch, "text", 1 << 20):
                data, offsets = _bytes(cut)
                raw = data.tobytes()
                at, fp = anchors(data, offsets, length, gram)
                cls = [text_class(raw[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                fresh = np.zeros(len(cls), bool)
                for i, c in enumerate(cls):
                    if c not in met:
                        met.add(c)
                        fresh[i] = True
                doc = np.searchsorted(offsets, at, "right") - 1
                some = fresh[doc]
                at, fp, doc = at[some], fp[some], doc[some]
                a, b = np.maximum(at - (length - gram), offsets[doc]), np.minimum(at + length, offsets[doc + 1])
                digest = xxhash.xxh3_64_intdigest
                ctx = np.fromiter((digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(at))
                ctx ^= (at - a).astype(np.uint64) * np.uint64(_BASE)
                yield {"fp": _signed(fp), "ctx": _signed(ctx), "cls": pa.array(cls, pa.binary()).take(pa.array(doc)), "pos": (at - offsets[doc]).astype(np.int32)}

        return work

    return map_batches(texts(docs), "fp long, ctx long, cls binary, pos int", make)


def _of_class(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """cls, text for ids (id, cls): one document each."""
    ids = durable(ids, "ids")
    ids = F.broadcast(ids) if ids.count() <= SENT else ids
    rows = texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("cls", "text")

    def make():
        def work(batch):  # a doc_id may stand for several texts: the class's own is meant
            for cut in slices(batch, "text"):
                fine = [text_class(t.encode()) == c for c, t in zip(*(cut.column(k).to_pylist() for k in ("cls", "text")))]
                kept = cut.filter(pa.array(fine, pa.bool_()))
                yield {"cls": kept.column("cls"), "text": kept.column("text")}

        return work

    return map_batches(rows, "cls binary, text string", make)


SURROUNDED = "key long, fp long, ctx long, cls binary, start int, at int, many boolean, body binary"


def surroundings(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around each wanted anchor. rows: cls, text, wanted (array of pos, fp, ctx, many)."""

    def make():
        def work(batch):
            for cut in slices(batch, "text"):
                out = {k: [] for k in ("key", "fp", "ctx", "cls", "start", "at", "many", "body")}
                for cls, text, wanted in zip(*(cut.column(c).to_pylist() for c in ("cls", "text", "wanted"))):
                    raw = text.encode()
                    for w in wanted:
                        a = max(0, w["pos"] - (length - gram))
                        for k, v in zip(out, (w["fp"], w["fp"], w["ctx"], cls, a, w["pos"] - a, w["many"], raw[a : w["pos"] + length])):
                            out[k].append(v)
                yield out

        return work

    return map_batches(rows, SURROUNDED, make)


def halves(rows: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """Each surroundings twice: as strings that hold the anchor with half of the free bytes to its left, and
    those with half to its right. At level n an anchor has grown to gram + (length - gram)(1 - 2^-n) bytes."""

    def make():
        def work(batch):
            out = {k: [] for k in ("key", "fp", "ctx", "cls", "start", "at", "many", "body")}
            for key, fp, ctx, cls, start, at, many, body in zip(*(batch.column(c).to_pylist() for c in out)):
                free = length - gram >> level  # bytes by which a string may still exceed the grown anchor
                size = length - free
                grow = (free + 1) // 2
                for left in (True, False):
                    a = at - grow if left else at
                    b = a + size + grow
                    if a < 0 or b > len(body):
                        continue
                    low, high = max(0, b - length), min(len(body), a + length)
                    name = xxhash.xxh3_64_intdigest(body[a:b], seed=1 + level) - (1 << 63)
                    for k, v in zip(out, (name, fp, ctx, cls, start + low, a - low, many, body[low:high])):
                        out[k].append(v)
            yield out

        return work

    return map_batches(rows, SURROUNDED, make)


class Side:
    """One side's bytes of some surroundings (rows of a matrix, the key first), sorted."""

    def __init__(self, matrix: np.ndarray, order: np.ndarray, prefix: np.ndarray):
        self.matrix, self.order, self.prefix = matrix, order, prefix

    @classmethod
    def built(cls, matrix: np.ndarray) -> Side:
        """A sparse suffix array: of the suffixes of the rows laid end to end, eight bytes a symbol, those
        that begin a row; and the bytes that each has in common with the one before."""
        m, width = matrix.shape
        symbols = matrix.view(">u8").astype(np.uint64).ravel()
        per_row = width // 8
        sa = suffix_array(symbols, per_row)
        lcp = common_prefixes(symbols, sa, per_row)
        places = np.flatnonzero(sa % per_row == 0)
        order = sa[places] // per_row
        low = np.minimum.reduceat(lcp[: places[-1] + 1], np.append(0, places[:-1] + 1))  # over all the suffixes between two rows
        prefix = 8 * low
        part = np.flatnonzero(low[1:] < per_row) + 1
        x, y = order[part] * per_row + low[part], order[part - 1] * per_row + low[part]
        differ = symbols[x] ^ symbols[y]
        for k in range(1, 8):
            prefix[part] += (differ >> np.uint64(64 - 8 * k)) == 0
        prefix[:1] = 0
        return cls(matrix, order, prefix)

    def merged(self, other: Side) -> Side:
        """Two shards' orders in one: the other's rows find their places here by binary search."""
        width = self.matrix.shape[1]
        mine, theirs = (np.ascontiguousarray(s.matrix[s.order]).view(f"S{width}").ravel() for s in (self, other))
        order = np.insert(self.order, np.searchsorted(mine, theirs, "right"), other.order + len(self.matrix))
        matrix = np.concatenate([self.matrix, other.matrix])
        rows = matrix[order]
        differ = rows[1:] != rows[:-1]
        prefix = np.where(differ.any(1), differ.argmax(1), width)
        return Side(matrix, order, np.append(0, prefix))

    def groups(self, most: int) -> np.ndarray:
        """For each row and depth 0 to most a number that rows share whose key and first depth bytes agree."""
        m = len(self.order)
        starts = self.prefix[:, None] < 8 + np.arange(most + 1)[None, :]
        out = np.empty((m, most + 1), np.int64)
        out[self.order] = np.maximum.accumulate(np.where(starts, np.arange(m)[:, None], 0), axis=0)
        return out


class Shard:
    """Some surroundings by key and anchor; which of the strings that hold their anchor are repeated."""

    def __init__(self, rows: list[tuple], length: int, size: int, sides: tuple[Side, Side] | None = None):
        self.rows, self.length, self.size, self.free = rows, length, size, length - size
        if sides is None:
            width = 8 + -(-self.free // 8) * 8
            left, right = (np.zeros((len(rows), width), np.uint8) for _ in range(2))
            for i, row in enumerate(rows):
                at, body = row[5], row[7]
                head = (row[0] + (1 << 63)).to_bytes(8, "big")
                before, after = body[max(0, at - self.free) : at][::-1], body[at + size : at + length]
                left[i, : 8 + len(before)] = np.frombuffer(head + before, np.uint8)
                right[i, : 8 + len(after)] = np.frombuffer(head + after, np.uint8)
            sides = Side.built(left), Side.built(right)
        self.sides = sides

    def merged(self, other: Shard) -> Shard:
        sides = tuple(mine.merged(theirs) for mine, theirs in zip(self.sides, other.sides))
        return Shard(self.rows + other.rows, self.length, self.size, sides)

    def found(self) -> dict:
        """fp, ctx, and start and end of the bytes covered by runs of repeated strings."""
        m, free = len(self.rows), self.free
        cls, start, at = (np.array([r[i] for r in self.rows], np.int64) for i in (3, 4, 5))
        many = np.array([r[6] for r in self.rows], bool)
        after = np.array([len(r[7]) for r in self.rows]) - at - self.size
        back = np.arange(free + 1)  # bytes of a string before its anchor
        whole = (back <= at[:, None]) & (free - back <= after[:, None])
        left, right = (side.groups(free) for side in self.sides)
        key = (left * m + right[:, ::-1]) * (free + 1) + back
        row, col = np.nonzero(whole)
        key = key[row, col]
        owner = cls[row].astype(np.uint64) * np.uint64(_BASE) ^ (start[row] + at[row] - col).astype(np.uint64)
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        repeated = np.zeros((m, free + 3), bool)  # a frame of False around
        if len(firsts):
            several = np.minimum.reduceat(owner, firsts) != np.maximum.reduceat(owner, firsts)
            several |= np.logical_or.reduceat(many[row[order]], firsts)
            repeated[row[order], col[order] + 1] = np.repeat(several, np.diff(np.append(firsts, len(key))))
        r, first = np.nonzero(repeated[:, 1:] & ~repeated[:, :-1])
        _, last = np.nonzero(repeated[:, :-1] & ~repeated[:, 1:])
        anchor = start[r] + at[r]
        names = {k: np.array([x[i] for x in self.rows], np.int64)[r] for i, k in ((1, "fp"), (2, "ctx"))}
        return names | {"start": anchor - (last - 1), "end": anchor - first + self.length}


def sharded(rows: DataFrame, length: int, size: int) -> DataFrame:
    """fp, ctx, start, end: repeated bytes of the text that each surroundings came from; anchors have size
    bytes."""

    def make():
        held, open_shard = [], []

        def build(last: bool):
            if held:
                shard = Shard(held[:], length, size)
                held.clear()
                if open_shard and open_shard[0].rows[-1][0] == shard.rows[0][0]:
                    open_shard[0] = open_shard[0].merged(shard)
                else:
                    for other in open_shard:
                        yield other.found()
                    open_shard[:] = [shard]
            if last:
                for other in open_shard:
                    yield other.found()
                open_shard.clear()

        def work(batch):
            for cut in slices(batch, "body", 1 << 20):
                columns = {c: cut.column(c).to_pylist() for c in ("key", "fp", "ctx", "cls", "start", "at", "many", "body")}
                columns["cls"] = [int.from_bytes(c[:8], "big", signed=True) for c in columns["cls"]]  # only told apart where 200 bytes are equal
                for row in zip(*columns.values()):
                    # a shard ends with its anchor if it can; the anchor that spans shards is merged alone
                    if held and (len(held) >= SHARD or len(held) >= SHARD // 2 and held[-1][0] != row[0]):
                        yield from build(False)
                    held.append(row)

        work.finish = lambda: build(True)
        return work

    placed = rows.repartition("key").sortWithinPartitions("key")
    return map_batches(placed, "fp long, ctx long, start long, end long", make)


SPANS = "array<struct<start:long,end:long>>"


def _merged(cover: list[dict], size: int) -> list[tuple[int, int]]:
    """The bytes of cover as spans that neither overlap nor touch."""
    out = []
    for a, b in sorted((c["start"], min(c["end"], size)) for c in cover):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(raw[begin:a] for begin, a in zip(ends, [*(a for a, _ in spans), len(raw)]))


def _removed(rows: DataFrame) -> DataFrame:
    """cls, spans, kept_sha256 from cls, text, cover (array of start, end)."""

    def make():
        def work(batch):
            out = {"spans": [], "kept_sha256": []}
            for text, cover in zip(batch.column("text").to_pylist(), batch.column("cover").to_pylist()):
                raw = text.encode()
                spans = _merged(cover, len(raw))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["kept_sha256"].append(hashlib.sha256(_kept(raw, spans)).hexdigest())
            yield {"cls": batch.column("cls")} | out

        return work

    return map_batches(rows, f"cls binary, spans {SPANS}, kept_sha256 string", make)


@scoped
def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """doc_id, cls (text_class), n_bytes, spans (array of start, end: the bytes to remove), kept_sha256."""
    gram = gram or length // 2
    whole = durable(whole_texts(docs), "texts")
    copies = whole.groupBy("cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"), F.max("n_bytes").alias("n_bytes"))
    copies = durable(copies.where(F.col("n_bytes") >= length), "copies")

    placed = durable(anchored(docs, length, gram), "placed")  # read twice: once for two columns, once to be joined
    counted = placed.groupBy("fp").agg(F.count("*").alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
    twice = counted.where("n > 1").select("fp", (F.col("low") != F.col("high")).alias("mixed"))
    twice = durable(twice, "twice")  # read back, so that the join can split an anchor that a large share of the rows has
    found = durable(placed.join(twice, "fp"), "anchors")
    kinds = found.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("cls", "pos")).alias("one"))
    kinds = durable(kinds, "kinds")

    # surroundings of anchors that have several: one copy of each
    wanted = kinds.where("mixed").select(F.col("one.cls").alias("cls"), F.struct(F.col("one.pos").alias("pos"), "fp", "ctx", (F.col("n") > 1).alias("many")).alias("w"))
    wanted = durable(wanted.groupBy("cls").agg(F.collect_list("w").alias("wanted")), "wanted")
    own = _of_class(docs, copies.join(wanted, "cls", "left_semi").select("id", "cls"))
    bodies = surroundings(own.join(wanted, "cls"), length, gram)
    results, level = [], 0
    counts = durable(kinds.where("mixed").groupBy("fp").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select(F.col("fp").alias("key")), "hot")
    while not counts.isEmpty():  # at most log2 of the free bytes: then a string is its own key
        bodies = durable(bodies, f"bodies{level}")
        results.append(sharded(bodies.join(counts, "key", "left_anti"), length, length - (length - gram >> level)))
        bodies = durable(halves(bodies.join(counts, "key", "left_semi"), level, length, gram), f"halves{level}")
        met = bodies.groupBy("key").agg(F.count("*").alias("m"), F.min("body").alias("low"), F.max("body").alias("high"))
        bodies = bodies.join(durable(met.where("m > 1").select("key"), "met"), "key", "left_semi")
        level += 1
        if length - gram >> level == 0:  # a key is a string
            break
        counts = durable(met.where((F.col("m") > HOT) & (F.col("low") != F.col("high"))).select("key"), "hot")
    results.append(sharded(bodies, length, length - (length - gram >> level)))
    marked = results[0]
    for more in results[1:]:
        marked = marked.unionByName(more)
    marked = durable(marked, "marked")

    single = copies.where("n = 1").select("cls", "n_bytes", "id")
    full = found.join(kinds.where("n > 1").select("fp", "ctx"), ["fp", "ctx"]).select(
        "cls", F.greatest(F.col("pos") - (length - gram), F.lit(0)).cast("long").alias("start"), (F.col("pos") + length).cast("long").alias("end")
    )
    parts = marked.join(kinds.where("n = 1").select("fp", "ctx", F.col("one.cls").alias("cls")), ["fp", "ctx"]).select("cls", "start", "end")
    cover = full.unionByName(parts).distinct().join(single.select("cls"), "cls", "left_semi")
    cover = durable(cover.groupBy("cls").agg(F.collect_list(F.struct("start", "end")).alias("cover")), "cover")
    text = _of_class(docs, single.join(cover, "cls", "left_semi").select("id", "cls"))
    cleaned = durable(_removed(text.join(cover, "cls")), "cleaned")

    gone = durable(copies.where("n > 1").select("cls", F.lit(True).alias("gone")), "gone")
    out = whole.join(gone, "cls", "left").join(cleaned, "cls", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(
        "doc_id", "cls", "n_bytes", F.when(F.col("gone"), everything).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.when(F.col("gone"), nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return removed_spans(docs, length, gram).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def cleaned_texts(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """doc_id, kept: the bytes of each row's text that stay (binary, as a cut may part a character's bytes)."""
    found = removed_spans(docs, length, gram).where(F.size("spans") > 0).select("cls", "spans").dropDuplicates(["cls"])

    def classed():
        def work(batch):
            for cut in slices(batch, "text"):
                yield {"doc_id": cut.column("doc_id"), "cls": [text_class(t.encode()) for t in cut.column("text").to_pylist()], "text": cut.column("text")}

        return work

    def cut_out():
        def work(batch):
            for cut in slices(batch, "text"):
                rows = zip(cut.column("text").to_pylist(), cut.column("spans").to_pylist())
                yield {"doc_id": cut.column("doc_id"), "kept": [_kept(t.encode(), [(x["start"], x["end"]) for x in spans or ()]) for t, spans in rows]}

        return work

    own = map_batches(texts(docs), "doc_id long, cls binary, text string", classed).join(found, "cls", "left")
    return map_batches(own, "doc_id long, kept binary", cut_out)
