"""Exact dedup by content-defined chunk recipes.

Every text, A-Z lower-cased, is cut where a rolling hash of the last WINDOW bytes says so; its recipe
is the ordered list of its chunks' identifiers. Chunks are deduplicated and their identifiers verified
against the bytes once, in one shuffle to which each map task sends a chunk's bytes at most once; after
that only recipes travel. Two texts are equal exactly when their recipes of verified identifiers are.

Defined cases: null text counts as empty; all empty texts are equal (an empty recipe); of equal texts the
largest doc_id stays (null is smallest), of rows that repeat that doc_id exactly one; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import durable, keep_decided, map_batches, row_mark, scoped, slices, texts

WINDOW, LEAST, MOST = 16, 512, 16384
MASK = np.uint32(0x7FF)  # a cut every 2 KB on average
SALTS = 64
#: Broadcast the list of colliding keys only up to so many.
COLLISIONS_SENT = 100_000


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that start at each position, by doubling: log2(WINDOW) passes."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    factor, span = 0x01000193, 1
    while span < WINDOW:
        h = h[:-span] * np.uint32(factor) + h[span:]
        factor, span = factor * factor & 0xFFFFFFFF, span * 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return h ^ (h >> np.uint32(13))


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text data[offsets[i]:offsets[i+1]] its chunks' ends, relative to data."""
    hashed = rolling(data) if len(data) >= WINDOW else np.empty(0, np.uint32)
    marks = np.flatnonzero((hashed & MASK) == MASK) + WINDOW
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = marks[np.searchsorted(marks, begin + WINDOW) : np.searchsorted(marks, end)].tolist()
        ends, last = [], begin
        for m in own:
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST:
                ends.append(m)
                last = m
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end > last:
            ends.append(end)
        out.append(ends)
    return out


def _lowered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = pc.ascii_lower(batch.column("text"))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def xxh128(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes] = xxh128) -> DataFrame:
    """uid, doc_id, mark, text_sha256, recipe: for each chunk its digest and its length, concatenated."""

    def make():
        def work(batch):
            for part in slices(batch, "text"):
                data, offsets = _lowered(part)
                raw, sha, recipe = data.tobytes(), [], []
                for begin, end, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cuts(data, offsets)):
                    sha.append(hashlib.sha256(raw[begin:end]).hexdigest())
                    keys, last = [], begin
                    for e in ends:
                        keys.append(digest(raw[last:e]) + (e - last).to_bytes(4, "little"))
                        last = e
                    recipe.append(b"".join(keys))
                yield {"uid": part.column("uid"), "doc_id": part.column("doc_id"), "mark": part.column("mark"), "text_sha256": sha, "recipe": recipe}

        return work

    rows = texts(docs, F.monotonically_increasing_id().alias("uid"), row_mark(docs).alias("mark"))
    return map_batches(rows, "uid long, doc_id long, mark long, text_sha256 string, recipe binary", make)


def chunks(docs: DataFrame, digest: Callable[[bytes], bytes] = xxh128) -> DataFrame:
    """key, chunk: a slice's distinct chunks with their identifiers."""

    def make():
        def work(batch):
            for part in slices(batch, "text"):
                data, offsets = _lowered(part)
                raw, found = data.tobytes(), set()
                for begin, ends in zip(offsets[:-1].tolist(), cuts(data, offsets)):
                    for e in ends:
                        found.add(raw[begin:e])
                        begin = e
                yield {"key": [digest(c) + len(c).to_bytes(4, "little") for c in found], "chunk": list(found)}

        return work

    return map_batches(texts(docs), "key binary, chunk binary", make)


def placed(docs: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """sha, place, key, chunk of every text: only needed where identifiers collide."""

    def make():
        def work(batch):
            for part in slices(batch, "text"):
                data, offsets = _lowered(part)
                raw, rows = data.tobytes(), []
                for begin, end, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cuts(data, offsets)):
                    sha = hashlib.sha256(raw[begin:end]).hexdigest()
                    for i, e in enumerate(ends):
                        c = raw[begin:e]
                        rows.append((sha, i, digest(c) + len(c).to_bytes(4, "little"), c))
                        begin = e
                yield {k: [r[i] for r in rows] for i, k in enumerate(("sha", "place", "key", "chunk"))}

        return work

    return map_batches(texts(docs), "sha string, place int, key binary, chunk binary", make)


def decided(docs: DataFrame, digest: Callable[[bytes], bytes] = xxh128) -> DataFrame:
    """doc_id, mark, keep_id, group_size, kept, text_sha256 for every row of docs.

    A group of copies may hold a third of all rows: groups are first counted under SALTS salts and the
    result returns to the rows under the same salts, so that no task meets more than its share.
    """
    rows = durable(recipes(docs, digest), "recipes")
    distinct = chunks(docs, digest).groupBy("key", "chunk").agg(F.count("*").alias("n"))
    collide = durable(distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "collisions")
    n = collide.count()
    if n:  # two different chunks share an identifier: tell them apart by their bytes
        few = F.broadcast(collide) if n <= COLLISIONS_SENT else collide
        own = placed(docs, digest).join(few, "key", "left_semi").distinct()
        names = own.groupBy("key", "chunk").agg(F.count("*").alias("n"))
        names = names.select("key", "chunk", F.sha2("chunk", 512).alias("name"))
        told = own.join(names, ["key", "chunk"]).groupBy("sha").agg(
            F.concat_ws(",", F.sort_array(F.collect_list(F.format_string("%010d:%s", "place", "name")))).alias("told")
        )
        rows = rows.join(told.withColumnRenamed("sha", "text_sha256"), "text_sha256", "left")
        rows = rows.withColumn("recipe", F.concat("recipe", F.coalesce("told", F.lit("")).cast("binary"))).drop("told")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    last = F.max(F.struct("doc_id", "uid")).alias("last")
    salted = rows.groupBy("recipe", "salt").agg(last, F.count("*").alias("n"))
    groups = salted.groupBy("recipe").agg(F.max("last").alias("last"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    back = groups.select("recipe", F.explode("salts").alias("salt"), F.col("last.doc_id").alias("keep_id"), F.col("last.uid").alias("keep_uid"), "group_size")
    return rows.join(back, ["recipe", "salt"]).select(
        "doc_id", "mark", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256"
    )


@scoped
def exact_dedup(docs: DataFrame, digest: Callable[[bytes], bytes] = xxh128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    return decided(docs, digest).drop("mark")


@scoped
def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, mark, kept for every row of docs."""
    return decided(docs).select("doc_id", "mark", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that stay, with the columns of docs. Of rows that repeat both id and text
    one stays; rows that share an id are told apart by their texts."""
    return keep_decided(docs, decisions(docs))
