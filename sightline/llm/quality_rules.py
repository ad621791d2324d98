"""Quality rules: word counts, then compression bands.

A text passes the bands if its zstandard ratio (compressed by raw bytes) lies within the limits for its
length, and at most a quarter of its chunks lie outside theirs: every chunk of CHUNK bytes and the rest behind
them, each judged by the limits for its own length, widened by SLACK. A low ratio means repetition, a high one
noise; short texts have looser limits, as a frame's overhead weighs more.

Defined cases: null text counts as empty; texts of fewer than 50 words fail the base rules; a repeated row
is judged as often as it is there; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from sightline.llm.common import map_batches, slices, texts

CHUNK, LEVEL = 4096, 3
#: (bytes below, least ratio, most ratio) of whole texts.
BANDS = (
    (100, 0.50, 9.0), (300, 0.50, 1.25), (600, 0.50, 0.85), (1200, 0.46, 0.76), (2500, 0.43, 0.66),
    (5000, 0.40, 0.60), (10000, 0.385, 0.56), (float("inf"), 0.365, 0.53),
)
#: A chunk is a smaller sample than its text: its limits are wider by this share.
SLACK = 0.1
#: Share of chunks that may lie outside their band.
ODD_CHUNKS = 0.25
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_odd_chunks long"
)


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, covered = 0, 0  # covered: first place that is not yet counted
    for i, window in enumerate(windows):
        if seen[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def limits(n: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in BANDS if n < below)


def bands(raw: bytes, compress) -> tuple[float, int, bool]:
    """Ratio of the whole, chunks outside their limits, verdict. Empty: ratio 0, fails."""
    if not raw:
        return 0.0, 0, False
    ratio, parts, odd = len(compress(raw)) / len(raw), range(0, len(raw), CHUNK), 0
    for i in parts if len(raw) > CHUNK else ():
        part = raw[i : i + CHUNK]
        low, high = limits(len(part))
        odd += not low * (1 - SLACK) <= len(compress(part)) / len(part) <= high * (1 + SLACK)
    low, high = limits(len(raw))
    return ratio, odd, low <= ratio <= high and odd <= ODD_CHUNKS * len(parts)


def judge(text: str, compress) -> tuple:
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeat = repeated_words(words)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    ratio, odd, fine = bands(text.encode(), compress)
    return (
        len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat,
        failed, fine and not failed, ratio, odd,
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in RESULT.split(", ")][1:]

    def make():
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def work(batch):
            for cut in slices(batch, "text"):
                rows = [judge(t, compress) for t in cut.column("text").to_pylist()]
                yield {"doc_id": cut.column("doc_id")} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return work

    return map_batches(texts(docs), RESULT, make)
