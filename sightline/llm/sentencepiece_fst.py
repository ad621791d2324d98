"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into three transducers: the normaliser (a blank before the text, blanks to their
mark), the pieces (a trie from characters to ids) and the byte fallback (a character without a piece to its
bytes). Composed with an input they give a lattice of pieces, whose tropical shortest path is the encoding.

Models of type unigram have their scores as weights. For type bpe scores are merge ranks, not costs: there the
lattice is composed with a bigram acceptor that lets piece v follow u only if merging their joint characters
gives u, v again. An encoding by merges is the one path whose every pair is accepted, so the shortest path is
that encoding whatever the weights; each piece costs 1.

No piece has a blank mark after another character, so the lattice falls apart before each run of blanks: units
(blanks and the word behind them) are composed once and kept, the most recent in each worker process.

Defined cases: null text counts as empty, and empty text has no ids; a repeated row is encoded as often as it
is there; a text with the blank mark itself decodes with a blank there (round_trip is false); models with a
character map of their own are refused; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from itertools import chain

from pyspark.sql import DataFrame

from sightline.llm.common import keep, map_batches, slices, texts

MARK = "▁"
#: Units and accepted pairs kept in a generation of the caches; longer units are not kept.
UNITS, PAIRS, LONGEST = 250_000, 300_000, 48
#: The fallback's cost: dearer than any path of pieces over one character.
FALLBACK = 1_000.0
#: Marks that mostly stand behind a word which is known without them.
MARKS = ".,"
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message: ints, 4 or 8 raw bytes, or a field's bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """What a model file says: pieces by id, their scores and kinds, and how text is normalised."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.type, self.prefix, self.trim, self.fallback = UNIGRAM, True, True, False
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, 1))
            elif number == 2:
                own = dict(_fields(value))
                self.type, self.fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a character map are not supported")
                self.prefix, self.trim = bool(own.get(3, 1)), bool(own.get(4, 1))
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0


class Transducer:
    def __init__(self, model: Model):
        self.model, self.ids, self.trie = model, {}, {}
        for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds)):
            if kind in (1, 4) and piece:
                self.ids[piece] = i
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("a piece has a blank mark inside")
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (piece, i, 1.0 if model.type == BPE else -model.scores[i])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.sound: dict[str, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        kinds = zip(model.pieces, model.kinds)
        self.text_of = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(MARK, " ").encode() for p, k in kinds]

    # the normaliser
    def normalised(self, text: str) -> str:
        if self.model.trim:
            text = re.sub(" +", " ", text).strip(" ")
        return (" " * (self.model.prefix and text != "") + text).replace(" ", MARK)

    def denormalised(self, raw: bytes) -> bytes:
        return raw[1:] if self.model.prefix and raw.startswith(b" ") else raw

    # the bigram acceptor
    def merged(self, text: str) -> list[str]:
        parts, score, ids = list(text), self.model.scores, self.ids
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, u: str | None, v: str) -> bool:
        if v not in self.sound:
            self.sound[v] = self.merged(v) == [v]
        if not self.sound[v] or u is None:
            return self.sound[v]
        known = self.pairs.get((u, v))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[u, v] = self.merged(u + v) == [u, v]
        return known

    # composition and the shortest path
    def arcs(self, unit: str, i: int) -> list[tuple]:
        """(end, piece, ids, cost) of the arcs that leave place i, shorter ones first."""
        out, node = [], self.trie
        for j in range(i, len(unit)):
            node = node.get(unit[j])
            if node is None:
                break
            if "" in node:
                piece, number, cost = node[""]
                out.append((j + 1, piece, (number,), cost))
        if not out or out[0][0] > i + 1:
            c, model = unit[i], self.model
            raw = tuple(model.bytes_of[b] for b in c.encode()) if model.fallback else (model.unknown,)
            out.insert(0, (i + 1, c, raw, FALLBACK))
        return out

    def accepted(self, unit: str) -> list[int]:
        """For bpe, where only one path is accepted and so is the shortest: states are composed as a search
        from long to short arcs comes to them, and those that lead nowhere are met once."""
        path, dead = [(0, None, ())], set()
        waiting = [self.arcs(unit, 0)]
        while path[-1][0] < len(unit):
            last = path[-1][1]
            if not waiting[-1]:
                waiting.pop()
                dead.add(path.pop()[:2])
                continue
            arc = waiting[-1].pop()
            if arc[:2] not in dead and self.follows(last, arc[1]):
                path.append(arc)
                waiting.append(self.arcs(unit, arc[0]) if arc[0] < len(unit) else [])
        return list(chain.from_iterable(a[2] for a in path))

    def shortest(self, unit: str) -> list[int]:
        """Ids of the cheapest accepted path; a state is a place and, for bpe, the piece before it."""
        bpe = self.model.type == BPE
        states: list[dict] = [{} for _ in range(len(unit) + 1)]
        states[0][None] = (0.0, None, ())
        for i in range(len(unit)):
            if not states[i]:
                continue
            arcs = self.arcs(unit, i)
            for last, (cost, _, _) in states[i].items():
                for end, piece, numbers, weight in arcs:
                    if not bpe or self.follows(last, piece):
                        key = piece if bpe else ""
                        if key not in states[end] or states[end][key][0] > cost + weight:
                            states[end][key] = (cost + weight, (i, last), numbers)
        place, out = (len(unit), min(states[-1], key=lambda k: states[-1][k][0])), []
        while place is not None:
            _, back, numbers = states[place[0]][place[1]]
            out.append(numbers)
            place = back
        return list(chain.from_iterable(reversed(out)))

    def _found(self, unit: str) -> bytes:
        ids = (self.accepted if self.model.type == BPE else self.shortest)(unit)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _extended(self, unit: str) -> bytes:
        """A unit and a mark behind it: if the acceptor lets the mark follow, the unit's path goes on with it."""
        base, mark = unit[:-1], unit[-1]
        ids = self.young.get(base) or self.old.get(base)
        if ids is None:
            ids = self.young[base] = self._found(base)
        last = int.from_bytes(ids[-4:], "little")
        if mark in self.ids and self.model.kinds[last] == 1 and self.follows(self.model.pieces[last], mark):
            return ids + self.ids[mark].to_bytes(4, "little")
        return self._found(unit)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [_UNIT.findall(self.normalised(t)) for t in batch]
        units = set(chain.from_iterable(split))
        if len(self.young) + len(units) > UNITS:
            self.young, self.old = {}, self.young
        young, old, bpe = self.young, self.old, self.model.type == BPE
        for u in units:
            if u not in young:
                found = old.get(u)
                if found is None:
                    found = self._extended(u) if bpe and u[-1] in MARKS and len(u) > 2 else self._found(u)
                young[u] = found
        out = [b"".join(map(young.__getitem__, own)) for own in split]
        for u in units:
            if len(u) > LONGEST:
                young.pop(u, None)
        return out

    def decode(self, ids: bytes) -> str:
        """The transducers read backwards; bytes that are no UTF-8 become the replacement character."""
        raw = b"".join(map(self.text_of.__getitem__, memoryview(ids).cast("I")))
        return self.denormalised(raw).decode("utf-8", "replace")


_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
def transducer(path: str) -> Transducer:
    """Compiled once in each process."""

    def load():
        with open(path, "rb") as f:
            return Transducer(Model(f.read()))

    return keep(("transducer", path), load)


RESULT = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>)."""

    def make():
        fst = transducer(model)

        def work(batch):
            for cut in slices(batch, "text"):
                coded = fst.encode(cut.column("text").to_pylist())
                yield {"doc_id": cut.column("doc_id"), "ids": [list(memoryview(c).cast("I")) for c in coded]}

        return work

    return map_batches(texts(docs), "doc_id long, ids array<int>", make)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """For each text the digest of its ids, of what they decode to, and whether that is the text again."""

    def make():
        fst = transducer(model)
        low = {i for i in fst.model.bytes_of.values()}

        def work(batch):
            for cut in slices(batch, "text"):
                own = cut.column("text").to_pylist()
                out = {k: [] for k in ("n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip")}
                for text, ids in zip(own, fst.encode(own)):
                    back = fst.decode(ids)
                    out["n_ids"].append(len(ids) // 4)
                    out["n_byte_ids"].append(sum(map(low.__contains__, memoryview(ids).cast("I"))))
                    out["ids_crc32"].append(zlib.crc32(ids))
                    out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                    out["round_trip"].append(back == text)
                yield {"doc_id": cut.column("doc_id")} | out

        return work

    return map_batches(texts(docs), RESULT, make)
