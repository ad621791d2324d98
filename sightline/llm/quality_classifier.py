"""Quality classifier: Bradley-Terry pairwise ranking.

Every text gets a vector of features; a document's strength is linear in it. The weights are learned from
preference pairs (a text labelled 1 over one labelled 0) by logistic loss on the differences of their
features. The threshold is a quantile of the training strengths, the one that splits the labels best; the
score is the logistic of the strength above that quantile, in units of the gap between the classes.

Defined cases: null text counts as empty and is scored as such; labels that contradict each other or are
neither 0 nor 1 teach nothing; without labels of both kinds every score is 0.5; a repeated row is scored as
often as it is there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import held_out, map_batches, slices, texts

#: Labelled rows that are learned from, at most; preference pairs; hashed word shapes.
SAMPLE, PAIRS, SHAPES = 20_000, 40_000, 32
SHAPE_OF = re.compile(r"[^\W\d_]+|\d+")


def features(text: str) -> np.ndarray:
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    raw = text.encode()
    letters = sum(map(str.isalpha, text))
    most = counts.most_common(1)[0][1] if words else 0
    out = [
        np.log1p(len(words)), np.log1p(len(raw)), len(text) / n, len(counts) / n, np.log1p(n) * (1 - len(counts) / n),
        sum(a == b for a, b in zip(words, words[1:])) / n, most / n,
        sum(map(str.isupper, text)) / max(1, letters), letters / chars, sum(map(str.isdigit, text)) / chars,
        sum(map(text.count, "|<>")) / n, sum(map(text.count, "#*$%&@^~")) / n, sum(map(text.count, "!?")) / n,
        sum(map(text.count, ",;:")) / n, text.count(".") / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
        len(zlib.compress(raw, 1)) / max(40, len(raw)), sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(w[-1].isalnum() for w in words) / n, float(not words),
    ]
    shapes = np.zeros(SHAPES)
    for w, k in counts.items():
        shape = SHAPE_OF.sub(lambda m: "9" if m[0][0].isdigit() else "A" if m[0].isupper() else "a", w)[:6]
        shapes[zlib.crc32(shape.encode()) % SHAPES] += k
    return np.concatenate([out, np.sqrt(shapes / n)])


def learn(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict | None:
    """Weights and threshold from features x and labels y."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w, velocity = np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for _ in range(300):  # accelerated gradient descent on mean log(1 + exp(-w.d)) + a small ridge
        ahead = w + 0.9 * velocity
        p = 1 / (1 + np.exp(np.clip(d @ ahead, -30, 30)))
        velocity = 0.9 * velocity + 0.02 * (d.T @ p / len(d) - 1e-3 * ahead)
        w = w + velocity
    s = z @ w
    grid = np.quantile(s, np.arange(0.002, 1, 0.002))
    right = [((s[good] >= t).mean() + (s[bad] < t).mean()) / 2 for t in grid]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    t = grid[best[len(best) // 2]]
    gap = max(1e-6, np.median(s[good]) - np.median(s[bad]))
    return {"mean": mean, "scale": scale, "w": w, "t": t, "gap": gap}


def _vectors(rows: DataFrame) -> DataFrame:
    def make():
        def work(batch):
            for cut in slices(batch, "text"):
                yield {"id": cut.column("id"), "y": cut.column("y"), "x": [features(t) for t in cut.column("text").to_pylist()]}

        return work

    return map_batches(rows, "id long, y int, x array<double>", make)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Learn from at most sample labelled ids outside the held-out fold, the same ones each time; an id that stands
    for several texts teaches one of them."""
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    ids = ids.where("y = z").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", F.col("y").cast("int").alias("y"))
    rows = texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    got = _vectors(rows).groupBy("id").agg(F.min("y").alias("y"), F.max("x").alias("x")).toPandas()
    if got.empty:
        return None
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort(np.column_stack([x, y]).T)  # the same whatever the order of arrival
    return learn(x[order], y[order])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    def make():
        def work(batch):
            for cut in slices(batch, "text"):
                x = np.array([features(t) for t in cut.column("text").to_pylist()])
                if model is None:
                    p = np.full(len(x), 0.5)
                else:
                    s = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
                    p = 1 / (1 + np.exp(-np.clip(6 * (s - model["t"]) / model["gap"], -30, 30)))
                yield {"doc_id": cut.column("doc_id"), "held_out": cut.column("held_out"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return work

    rows = texts(docs, held_out(docs["doc_id"]).alias("held_out"))
    return map_batches(rows, "doc_id long, held_out boolean, score double, predicted int", make)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs without those predicted to be of low quality; their columns stay as they are."""
    from sightline.llm.common import read

    model = train(docs, read(spark, sf_dir, "labels"))
    names = docs.columns

    def make():
        def work(batch):
            for cut in slices(batch, "text"):
                fine = np.ones(cut.num_rows, bool)
                if model is not None:
                    x = np.array([features(t or "") for t in cut.column("text").to_pylist()])
                    fine = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] >= model["t"]
                kept = cut.filter(pa.array(fine))
                yield {k: kept.column(k) for k in names}

        return work

    return map_batches(docs, docs.schema, make)
