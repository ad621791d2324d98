"""Packing: documents into sequences of at most LIMIT tokens by first-fit decreasing.

A document's tokens (its ids, then END) are cut into full pieces of LIMIT and a rest. Pieces are dealt at
random (by hash) to groups of about GROUP documents; in each group, first-fit decreasing puts a piece into
the first sequence with room, found by a tournament tree of the sequences' free capacities in O(log n).
Sequences are padded to LIMIT, except those whose length is a power of two. The ids of pieces are written once,
apart from what is packed, and join their places only where they are asked for.

Word ids: the tokenizer drops white space and never merges across it, so ids are encoded once for each
distinct word between ASCII spaces and kept in a bounded cache.

Defined cases: null or empty text has only END; a repeated row is packed as often as it is there; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from itertools import chain
from struct import pack as pack_ids

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import durable, keep, map_batches, slices, texts

LIMIT, END, GROUP, CACHE = 4096, 2, 2048, 350_000
PIECES = "uid long, doc_id long, start long, length long, ids binary, doc_tokens long"
PLACES = "uid long, start long, sequence_id long, offset long"
#: The digests of the packed pieces.
PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Encoder:
    """Little-endian 32-bit ids of whole texts through two generations of known words: when the younger
    is full, the older goes. A worker process keeps its words from task to task. A tokenizer for which case or white
    space matters is refused with a ValueError."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old, self.cache = Tokenizer.from_file(path), {}, {}, cache
        seen, same = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in (" Some\n\tWORDS  here ", "some words here"))
        if seen != same:
            raise ValueError(f"{path}: words can't be encoded one by one, as case or white space matters")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [text.encode().split() for text in texts]
        words = set(chain.from_iterable(split))
        if len(self.young) + len(words) > self.cache:
            self.young, self.old = {}, self.young
        young, old, new, joined = self.young, self.old, set(), []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                    continue
                base = w.rstrip(b".,")
                if base[-1:].isalnum() and b"<|" not in base:  # marks behind a letter or digit, and A-Z, have no say in its ids
                    parts = base.lower(), w[len(base) :]
                    new.update(x for x in parts if x and x not in young)
                    joined.append((w, *parts))
                else:
                    new.add(w)
        plain, other = [], []
        for w in new:
            text = w.decode()
            (plain if text.isalpha() and text.lower().isalpha() else other).append(text)
        for i in range(0, len(plain), 4096):
            if not self._at_once(part := plain[i : i + 4096]):
                other += part
        for text, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            ids = e.ids
            young[text.encode()] = pack_ids(f"<{len(ids)}I", *ids)
        for w, base, marks in joined:
            young[w] = young[base] + young[marks] if marks else young[base]
        return [b"".join(map(young.__getitem__, w)) for w in split]

    def _at_once(self, words: list[str]) -> bool:
        """Words of letters alone, as one text: each ends with its only id that ends a word."""
        (coded,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(coded.ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return False
        raw, begin = ids.tobytes(), 0
        for w, end in zip(words, ends):
            self.young[w.encode()] = raw[begin:end]
            begin = end
        return True


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """uid (of a row), doc_id, start, length, ids (little-endian, 32 bits each), doc_tokens."""

    def make():
        encode, last = keep(("encoder", tokenizer), lambda: Encoder(tokenizer)), pack_ids("<I", end)

        def work(batch):
            rows = []
            for cut in slices(batch, "text"):
                uids, doc_ids, texts_ = (cut.column(c).to_pylist() for c in ("uid", "doc_id", "text"))
                for uid, doc_id, ids in zip(uids, doc_ids, encode(texts_)):
                    ids += last
                    for start in range(0, len(ids), 4 * limit):
                        part = ids[start : start + 4 * limit]
                        rows.append((uid, doc_id, start // 4, len(part) // 4, part, len(ids) // 4))
            yield {k: [r[i] for r in rows] for i, k in enumerate(("uid", "doc_id", "start", "length", "ids", "doc_tokens"))}

        return work

    return map_batches(texts(docs, F.monotonically_increasing_id().alias("uid")), PIECES, make)


def first_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items go by falling length, ties by place."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    tree = [limit] * (2 * leaves)  # the winner of each match is the larger free capacity
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order.tolist():
        n, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < n:
                node += 1
        at[i], offset[i] = node - leaves, limit - tree[node]
        tree[node] -= n
        node //= 2
        while node:
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
            node //= 2
    return at, offset


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids of each piece."""
    rows = durable(pieces(docs, tokenizer, limit, end).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    groups = max(1, rows.count() // group)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "start"], ignore_index=True)
        at, offset = first_fit_decreasing(pdf["length"].to_numpy(), limit)
        pdf["sequence_id"], pdf["offset"] = pdf["group"].to_numpy() * (1 << 24) + at, offset
        return pdf[["uid", "start", "sequence_id", "offset"]]

    dealt = rows.select("uid", "start", "length", F.pmod(F.xxhash64("uid", "start"), F.lit(groups)).alias("group"))
    return rows.join(dealt.groupBy("group").applyInPandas(fit, PLACES), ["uid", "start"]).select(*PACKED, "ids")


def sequences(packed: DataFrame, limit: int = LIMIT, pad: int = END) -> DataFrame:
    """sequence_id, length (without padding), ids of each sequence of pack(), padded."""

    def make():
        fill = pack_ids("<I", pad)

        def work(batch):
            for begin in range(0, batch.num_rows, 64):
                cut, out = batch.slice(begin, 64), {"length": [], "ids": []}
                for parts in cut.column("parts").to_pylist():
                    ids = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"]))
                    n = len(ids) // 4
                    out["length"].append(n)
                    out["ids"].append(ids if n & (n - 1) == 0 else ids + fill * (limit - n))
                yield {"sequence_id": cut.column("sequence_id")} | out

        return work

    parts = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts"))
    return map_batches(parts, "sequence_id long, length long, ids binary", make)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the sequences, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
