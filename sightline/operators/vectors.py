"""Text and dense vectors in long form, similarity rankings, agglomerative clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.components import cut


def _strings(points: np.ndarray) -> pa.Array:
    """Arrow strings of rows of code points."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(wide.sum(axis=1))))
    return pa.LargeStringArray.from_buffers(len(points), pa.py_buffer(ends.astype("<i8")), pa.py_buffer(data))


def count_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts as rows of code points, and how often each is there. Characters are numbered within
    the texts, so that a gram is one number; where that has no room, a row of them."""
    points = [np.frombuffer(x.encode("utf-32-le"), "<u4") for x in texts]
    points = [x for x in points if len(x) >= n]
    if not points:
        return np.empty((0, n), "<u4"), np.empty(0, np.int64)
    every = np.concatenate(points)
    letters = np.flatnonzero(np.bincount(every)).astype("<u4")
    place = np.searchsorted(letters, every)
    base, begin, codes = len(letters), 0, []
    for x in points:
        own, begin = place[begin : begin + len(x)].astype(np.int64), begin + len(x)
        codes.append(np.lib.stride_tricks.sliding_window_view(own, n) if base**n >= 1 << 63 else sum(own[k : len(own) - n + k + 1] * base ** (n - 1 - k) for k in range(n)))
    codes = np.concatenate(codes)
    found, times = np.unique(codes, return_counts=True, axis=None if codes.ndim == 1 else 0)
    return letters[found if found.ndim == 2 else found[:, None] // base ** np.arange(n - 1, -1, -1, dtype=np.int64) % base], times


#: Rows of a batch of counted grams.
ROWS = 1 << 16


def gram_counts(df: DataFrame, low: int, high: int) -> DataFrame:
    """app, id, term, tf: every character n-gram of the lower-cased texts of an (app, id) with its number. The texts are
    shuffled and counted where they lie; no row is made for each place of a text."""
    arrow = pa.schema([("app", pa.string()), ("id", pa.string()), ("term", pa.large_string()), ("tf", pa.int64())])

    def rows(held):
        counts = [len(times) for *_, times in held]
        names = [pa.array(column, pa.string()).take(pa.array(np.repeat(np.arange(len(held)), counts))) for column in list(zip(*held))[:2]]
        terms = pa.concat_arrays([_strings(grams) for _, _, grams, _ in held])
        return pa.RecordBatch.from_arrays([*names, terms, pa.array(np.concatenate([times for *_, times in held]))], schema=arrow)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for app, key, texts in zip(*(batch.column(c).to_pylist() for c in ("app", "id", "texts"))):
                for n in range(low, high + 1):
                    grams, times = count_grams(texts, n)
                    for i in range(0, len(times), ROWS):
                        held.append((app, key, grams[i : i + ROWS], times[i : i + ROWS]))
                        size += len(held[-1][3])
                        if size >= ROWS:
                            yield rows(held)
                            held, size = [], 0
        if held:
            yield rows(held)

    texts = df.groupBy("app", "id").agg(F.collect_list(F.lower("text")).alias("texts"))
    return texts.mapInArrow(run, "app string, id string, term string, tf long")


#: Terms whose weights are sent to every task; with more of them they are joined by a shuffle.
TERMS_SENT = 300_000


def raw_weights(df: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """app, id, term, w: raw counts times smooth idf within the app."""
    tf = gram_counts(df, low, high)
    n = df.groupBy("app").agg(F.countDistinct("id").alias("n"))
    idf = tf.groupBy("app", "term").agg(F.count("*").alias("df")).join(F.broadcast(n), "app").select("app", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = cut(idf, "idf")
    return tf.join(F.broadcast(idf) if idf.count() <= TERMS_SENT else idf, ["app", "term"]).select("app", "id", "term", (F.col("tf") * F.col("idf")).alias("w"))


def tfidf(df: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """app, id, term, weight: raw weights, of unit length."""
    raw = raw_weights(df, low, high)
    norm = raw.groupBy("app", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["app", "id"]).select("app", "id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_summary(df: DataFrame, low: int, high: int) -> DataFrame:
    """app, id, n_terms, top_weight, sum_weight of the unit weights of a text: only sums of a text's terms are shuffled."""
    sums = raw_weights(df, low, high).groupBy("app", "id").agg(F.count("*").alias("n_terms"), F.max("w").alias("top"), F.sum("w").alias("total"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.select("app", "id", "n_terms", F.round(F.col("top") / F.col("norm"), 6).alias("top_weight"), F.round(F.col("total") / F.col("norm"), 4).alias("sum_weight"))


def pruned_terms(df: DataFrame, min_df: int, max_df: float, most: int, low: int = 2, high: int = 4) -> DataFrame:
    """app, term, df, tf of the most frequent terms within the document-frequency limits."""
    tf = gram_counts(df, low, high).groupBy("app", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    n = df.groupBy("app").agg(F.countDistinct("id").alias("n"))
    own = tf.join(F.broadcast(n), "app").where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))
    place = F.row_number().over(Window.partitionBy("app").orderBy(F.desc("tf"), "term"))
    return own.withColumn("place", place).where(F.col("place") <= most).select("app", "term", "df", "tf")


def term_scores(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """app, query_id, doc_id, score: cosine of long-form unit vectors by their shared terms."""
    q = queries.select("app", F.col("id").alias("query_id"), "term", F.col("weight").alias("wq"))
    d = weights.select("app", F.col("id").alias("doc_id"), "term", F.col("weight").alias("wd"))
    return q.join(d, ["app", "term"]).where("query_id <> doc_id").groupBy("app", "query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


#: Scores that a task holds at once.
SCORES = 250_000


def dense_scores(queries: DataFrame, corpus: DataFrame, most: int | None = None, digits: int = 6, held: int = SCORES) -> DataFrame:
    """app, query_id, doc_id, score of unit vectors: a stated set of queries, in blocks, against all rows of
    their app. Each task multiplies its rows' matrix with the queries' (a checked, broadcast matrix), a block of queries at a
    time, so that it holds about `held` scores (one query's against a batch of rows at least), however many queries there are.
    With most, a batch gives only what may be among a query's best by scores rounded to digits; `ranked` settles the rest."""
    size = queries.agg(F.sum(F.size("vector")).alias("n")).first()["n"] or 0
    if size > 50_000_000:
        raise ValueError("give the queries in smaller blocks")
    names = queries.select("app", "id", "vector").orderBy("app", "id").toPandas()
    table = {app: (own["id"].to_numpy(dtype=object), np.array(own["vector"].tolist())) for app, own in names.groupby("app")}
    shared = corpus.sparkSession.sparkContext.broadcast(table)

    def run(pdfs):
        for pdf in pdfs:
            for app, own in pdf.groupby("app"):
                if app in shared.value:
                    ids, q = shared.value[app]
                    docs, x = own["id"].to_numpy(dtype=object), np.array(own["vector"].tolist()).T
                    # a query's own rows may be among its best, and rounding may make neighbours tie
                    n = None if most is None else most + int(own["id"].value_counts().max())
                    step = max(1, held // len(docs))
                    for begin in range(0, len(ids), step):
                        s, asked = q[begin : begin + step] @ x, ids[begin : begin + step]
                        if n is not None and n < len(docs):
                            row, col = np.nonzero(s >= np.partition(s, -n, axis=1)[:, [-n]] - 10.0**-digits)
                            yield pd.DataFrame({"app": app, "query_id": asked[row], "doc_id": docs[col], "score": s[row, col]})
                            continue
                        yield pd.DataFrame({"app": app, "query_id": np.repeat(asked, len(docs)), "doc_id": np.tile(docs, len(asked)), "score": s.ravel()})

    return corpus.select("app", "id", "vector").mapInPandas(run, "app string, query_id string, doc_id string, score double").where("query_id <> doc_id")


def ranked(scores: DataFrame, most: int, digits: int = 6) -> DataFrame:
    """app, query_id, doc_id, rank, score: the best by rounded score, ties by id."""
    out = scores.withColumn("score", F.round("score", digits))
    place = F.row_number().over(Window.partitionBy("app", "query_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= most).select("app", "query_id", "doc_id", "rank", "score")


def centroids(vectors: DataFrame) -> DataFrame:
    """app, cluster_id, vector: the mean of a cluster's vectors, of unit length. Summed by position, so that
    partial sums and not vectors are gathered."""
    parts = vectors.select("app", "cluster_id", F.posexplode("vector").alias("i", "x")).groupBy("app", "cluster_id", "i").agg(F.avg("x").alias("x"))
    rows = parts.groupBy("app", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    return rows.select("app", "cluster_id", unit(F.col("vector")).alias("vector"))


def agglomerate(x: np.ndarray, k: int | None = None, threshold: float | None = None, linkage: str = "average") -> np.ndarray:
    """Cluster numbers (the least member's place) by merging the nearest pair by cosine distance."""
    n = len(x)
    d = x @ x.T
    np.subtract(1, d, out=d)
    np.fill_diagonal(d, np.inf)
    size, label, left = np.ones(n), np.arange(n), n
    near = d.argmin(axis=1)  # each row's nearest, the first of those that tie, so that a merge looks at few rows
    low = d[np.arange(n), near]
    while left > 1 and (k is None or left > k):
        i = int(np.argmin(low))
        j = int(near[i])
        if threshold is not None and low[i] > threshold:
            break
        i, j = min(i, j), max(i, j)
        new = np.maximum(d[i], d[j]) if linkage == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        left -= 1
        low[j], near[j] = np.inf, 0
        nearer = (new < low) | (new == low) & (i < near)
        lost = ((near == i) | (near == j)) & ~nearer & (low < np.inf)
        nearer[[i, j]] = False
        low[nearer], near[nearer] = new[nearer], i
        lost[i], lost[j] = True, False
        for row in np.flatnonzero(lost).tolist():
            near[row] = d[row].argmin()
            low[row] = d[row, near[row]]
    return label


def hierarchical(vectors: DataFrame, k: int | None = None, threshold: float | None = None, linkage: str = "average") -> DataFrame:
    """app, id, cluster_id; a problem of quadratic memory, so an app must be small enough for one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.array(pdf["vector"].tolist())
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        label = agglomerate(x, min(k, len(x)) if k else None, threshold, linkage)
        names = {v: i for i, v in enumerate(dict.fromkeys(label.tolist()))}
        return pd.DataFrame({"app": pdf["app"], "id": pdf["id"], "cluster_id": [f"{a}__C{names[v]}" for a, v in zip(pdf["app"], label.tolist())]})

    return vectors.select("app", "id", "vector").groupBy("app").applyInPandas(run, "app string, id string, cluster_id string")
