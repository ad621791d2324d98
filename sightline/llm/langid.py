"""Language ID by rank-order profiles.

A language's profile is its PROFILE most frequent letter n-grams (1 to 3 long, words padded with a blank)
in a bounded sample of labelled texts. A document's own PROFILE most frequent n-grams, over its whole text,
are compared with each profile by the out-of-place distance: the sum of rank differences, PROFILE for an
n-gram that the profile lacks. The nearest profile wins, ties by name.

Defined cases: null text, or text without a letter, is `und` with score 0; so is every text if nothing was
learned; rows without lang or of the held-out fold teach nothing; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import held_out, map_batches, slices, texts

#: N-grams in a profile; texts of each language that are learned from, about; languages that are learned, at most, the
#: most frequent ones first (profiles are sent to every task).
PROFILE, SAMPLE, LANGUAGES = 300, 2000, 1000
BLANK = 32


def _letters() -> np.ndarray:
    """Of each code point below 0x20000 whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x20000)), bool, 0x20000)


def ngrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a letter) and counts of the text's n-grams."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known = letters[np.minimum(points, len(letters) - 1)]
    if len(points) and points.max() >= len(letters):
        high = points >= len(letters)
        known = np.where(high, [chr(p).isalpha() for p in points.tolist()], known) if high.any() else known
    points = np.concatenate([[BLANK], np.where(known, points, BLANK), [BLANK]]).astype(np.uint64)
    gap = points == BLANK
    points, gap = (x[np.append(True, ~(gap[1:] & gap[:-1]))] for x in (points, gap))  # one blank between words
    two = points[:-1] << np.uint64(21) | points[1:]
    three = two[:-1] << np.uint64(21) | points[2:]
    codes = np.concatenate([points[~gap], two, three[~gap[1:-1]]])
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, ties by code; codes come sorted."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")[:most]]


def profiles(docs: DataFrame, sample: int = SAMPLE, most: int = PROFILE) -> dict[str, list[int]]:
    """lang -> its n-grams by rank, learned from about sample texts a language."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(float(sample)) / F.col("n") * F.lit(1 << 20)
    chosen = known.select("doc_id", "text", "lang").join(F.broadcast(counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES)), "lang")
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)

    def make():
        letters = _letters()

        def work(batch):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                codes, n = ngrams(text, letters)
                yield {"lang": [lang] * len(codes), "code": codes.astype(np.int64), "n": n.astype(np.int64)}

        return work

    total = map_batches(texts(chosen, "lang"), "lang string, code long, n long", make)
    total = total.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    found: dict[str, list[int]] = {}
    for r in total.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r["code"])
    return found


def identify(docs: DataFrame, learned: dict[str, list[int]], most: int = PROFILE) -> DataFrame:
    names = sorted(learned)

    def make():
        letters, tables = _letters(), []
        for name in names:
            codes = np.array(learned[name], np.uint64)
            order = np.argsort(codes)
            tables.append((codes[order], order))

        def nearest(text: str) -> tuple[str, float]:
            codes = ranked(*ngrams(text, letters), most)
            if not len(codes) or not tables:
                return "und", 0.0
            own, away = np.arange(len(codes)), []
            for sorted_codes, rank in tables:
                at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
                away.append(int(np.where(sorted_codes[at] == codes, np.abs(rank[at] - own), most).sum()))
            best = int(np.argmin(away))
            return names[best], 1 - away[best] / (most * len(codes))

        def work(batch):
            for cut in slices(batch, "text"):
                found = [nearest(text) for text in cut.column("text").to_pylist()]
                yield {"doc_id": cut.column("doc_id"), "held_out": cut.column("held_out"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    rows = texts(docs, held_out(docs["doc_id"]).alias("held_out"))
    return map_batches(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, profiles(docs))
