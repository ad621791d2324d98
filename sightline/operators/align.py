"""Alignment of concept buckets: chunks of a token budget, pair proposal in windows, semantic groups, merge rounds,
and the two-threshold assignment of coarse buckets.

Buckets are rows: bucket_id, concept, definition, examples, keywords, entities (the last three arrays). A bucket keeps
its own id whatever its label, so two of one label never overwrite each other.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sightline.operators.backend import Backend, RuleBackend, model_column
from sightline.operators.components import all_components, components, cut
from sightline.operators.vectors import tfidf


def token_chunks(items: DataFrame, group: str, order: str, tokens: str, budget: int, overhead: int = 0) -> DataFrame:
    """items plus chunk: along the order of a group a chunk ends where its overhead and tokens would pass the budget;
    an item above the budget is a chunk of its own. A group's rows pass one task as a stream, of which only the
    running sum is kept."""
    schema = StructType([*items.schema.fields, StructField("chunk", LongType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, held = object(), 0, 0
        for pdf in pdfs:
            out = []
            for key, size in zip(pdf[group], pdf[tokens], strict=True):
                if key != now:
                    now, chunk, held = key, 0, 0
                elif held and overhead + held + size > budget:
                    chunk, held = chunk + 1, 0
                held += size
                out.append(chunk)
            yield pdf.assign(chunk=pd.Series(out, index=pdf.index, dtype="int64"))

    return items.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)


def windows(entities: DataFrame, group: str, limit: int) -> DataFrame:
    """entities plus window: each group's entities in order, so many a window; pairs never cross windows."""
    place = F.row_number().over(Window.partitionBy(group).orderBy("entity")) - 1
    return entities.withColumn("window", F.floor(place / limit))


def proposed_pairs(entities: DataFrame, group: str, limit: int, make: Callable[[], Backend] = RuleBackend) -> DataFrame:
    """group, a, b, score that a backend proposes for each window of a group; a failed window proposes none.
    Windows of one entity are not asked about."""
    rows = windows(entities, group, limit).groupBy(group, "window").agg(F.array_sort(F.collect_set("entity")).alias("members"))
    asked = rows.where(F.size("members") > 1).withColumn("id", F.concat_ws("#", F.col(group), "window"))
    told = model_column(asked, "pairs", make, batch=1, default="[]")
    pair = F.explode(F.from_json("value", "array<struct<a:string,b:string,score:double>>")).alias("p")
    return told.select(F.col(group), "members", pair).where(F.array_contains("members", F.col("p.a")) & F.array_contains("members", F.col("p.b"))).select(group, "p.a", "p.b", F.round("p.score", 6).alias("score"))


# semantic groups


def similar_pairs(texts: DataFrame, threshold: float, low: int = 1, high: int = 2) -> DataFrame:
    """a < b, similarity of distinct texts (id, text) whose character TF-IDF has a cosine of threshold or more.

    Terms are ordered from rare to frequent, and a text looks for partners by its first terms alone: once the rest of
    its vector is shorter than the threshold, no text that shares only the rest can reach it."""
    weights = cut(tfidf(texts.select(F.lit("all").alias("app"), "id", "text"), low, high).select("id", "term", "weight"), "weights")
    often = weights.groupBy("term").agg(F.count("*").alias("n"))
    rest = Window.partitionBy("id").orderBy("n", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = weights.join(often, "term").withColumn("left", F.sum(F.col("weight") * F.col("weight")).over(rest)).where(F.col("left") >= threshold * threshold - 1e-9)
    met = first.select("term", F.col("id").alias("x")).join(weights.select("term", F.col("id").alias("y")), "term").where("x <> y")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    wa, wb = (weights.select(F.col("id").alias(c), "term", F.col("weight").alias(f"w{c}")) for c in "ab")
    dots = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("similarity"))
    return dots.where(F.col("similarity") >= threshold)


def complete_linkage(edges: list[tuple[str, str, float]]) -> dict[str, str]:
    """Member -> least member of its cluster. Two clusters join while every pair across them is an edge, the pair of
    clusters with the largest least similarity first, ties by their least members."""
    near: dict[str, dict[str, float]] = {}
    for a, b, s in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = s
    heap = [(-s, *sorted((a, b)), 0, 0) for a, b, s in edges]
    heapq.heapify(heap)
    members, version = {x: [x] for x in near}, Counter()
    while heap:
        s, a, b, va, vb = heapq.heappop(heap)
        if version[a] != va or version[b] != vb or a not in near or b not in near:
            continue
        own, other = near[a], near.pop(b)
        members[a] += members.pop(b)
        near[a] = {}
        version[a] += 1
        version[b] += 1
        for c in own.keys() | other.keys():
            if c not in (a, b):
                near[c].pop(b, None)
                if c in own and c in other:
                    near[a][c] = near[c][a] = min(own[c], other[c])
                    low, high = sorted((a, c))
                    heapq.heappush(heap, (-near[a][c], low, high, version[low], version[high]))
                else:
                    near[c].pop(a, None)
    return {x: least for least, xs in members.items() for x in xs}


def semantic_groups(texts: DataFrame, threshold: float = 0.85, smallest: int = 2, largest: int | None = None) -> DataFrame:
    """id, group (its least member) of texts that complete linkage joins at the threshold, in groups of the given sizes.

    Only pairs at the threshold matter, so linkage runs within the components of their graph, each by itself; equal
    texts are one, and come back at the end."""
    texts = texts.where(F.trim("text") != "").select("id", "text")
    least = texts.groupBy("text").agg(F.min("id").alias("rep"))
    pairs = cut(similar_pairs(least.select(F.col("rep").alias("id"), "text"), threshold), "pairs")
    parts = components(pairs.select("a", "b")).select(F.col("node").alias("a"), "component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = complete_linkage(list(zip(pdf["a"], pdf["b"], pdf["similarity"], strict=True)))
        return pd.DataFrame(sorted(found.items()), columns=["rep", "group"])

    linked = pairs.join(parts, "a").groupBy("component").applyInPandas(run, "rep string, `group` string")
    named = least.join(linked, "rep", "left").select("text", F.coalesce("group", "rep").alias("group"))
    rows = texts.join(named, "text").select("id", "group")
    size = F.count("*").over(Window.partitionBy("group"))
    kept = rows.withColumn("n", size).where((F.col("n") >= smallest) & (F.lit(largest is None) | (F.col("n") <= F.lit(largest or 0))))
    return kept.select("id", "group")


# merge rounds


def candidate_groups(buckets: DataFrame, threshold: float) -> DataFrame:
    """kind, key, bucket_id: buckets that share a keyword, and semantic groups by their signature, of two or more."""
    words = buckets.select(F.lit("keyword").alias("kind"), F.explode("keywords").alias("key"), "bucket_id").where("trim(key) <> ''").distinct()
    shared = words.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    alike = semantic_groups(buckets.select(F.col("bucket_id").alias("id"), _signature().alias("text")), threshold)
    return words.join(shared, "key", "left_semi").select("kind", "key", "bucket_id").unionByName(alike.select(F.lit("semantic").alias("kind"), F.col("group").alias("key"), F.col("id").alias("bucket_id")))


def _signature() -> Column:
    from sightline.functions.text import signature_text

    return signature_text(F.col("concept"), F.col("definition"), F.col("examples"))


def merge_round(buckets: DataFrame, make: Callable[[], Backend], threshold: float, budget: int, overhead: int) -> DataFrame:
    """The buckets after one round: a backend says for each chunk of a group which of its buckets are one; what it
    says is closed over all chunks. A chunk whose answer fails merges nothing."""
    size = F.length("concept") + F.length(F.coalesce("definition", F.lit(""))) + F.length(F.array_join("examples", "")) + 40
    named = buckets.select("bucket_id", "concept", size.cast("long").alias("tokens"))
    groups = candidate_groups(buckets, threshold).join(named, "bucket_id").withColumn("group", F.concat_ws(":", "kind", "key"))
    chunks = token_chunks(groups.select("group", "bucket_id", "concept", "tokens"), "group", "bucket_id", "tokens", budget, overhead)
    rows = chunks.groupBy("group", "chunk").agg(F.array_sort(F.collect_list(F.struct("bucket_id", "concept"))).alias("m")).where(F.size("m") > 1)
    asked = rows.select(F.concat_ws("#", "group", "chunk").alias("id"), F.col("m.bucket_id").alias("members"), F.col("m.concept").alias("concepts"))
    told = model_column(asked, "merges", make, batch=1, default="[]").select("members", F.explode(F.from_json("value", "array<array<string>>")).alias("g"))
    known = F.filter("g", lambda x: F.exists("members", lambda m: m == x))
    pairs = told.select(known.alias("g")).where(F.size("g") > 1).select(F.col("g")[0].alias("a"), F.explode(F.slice("g", 2, 1_000_000)).alias("b")).where("a <> b").distinct()
    pairs = cut(pairs, "verdicts")
    roots = all_components(buckets.select(F.col("bucket_id").alias("node")), pairs).select(F.col("node").alias("bucket_id"), F.col("component").alias("root"))
    own = lambda c: F.max(F.when(F.col("bucket_id") == F.col("root"), F.col(c))).alias(c)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    out = buckets.join(roots, "bucket_id").groupBy("root").agg(own("concept"), own("definition"), union("examples"), union("keywords"), union("entities"))
    return out.withColumnRenamed("root", "bucket_id")


def merge_rounds(buckets: DataFrame, make: Callable[[], Backend] = RuleBackend, most: int = 3, threshold: float = 0.85, budget: int = 7000, overhead: int = 700) -> tuple[DataFrame, list[int]]:
    """The buckets after at most so many rounds, and their number before and after each; stops once it stays.
    Every round is a table of its own, from which the next one starts again if an executor is lost."""
    buckets = cut(buckets.select("bucket_id", "concept", "definition", "examples", "keywords", "entities"), "buckets")
    counts = [buckets.count()]
    for k in range(most):
        buckets = cut(merge_round(buckets, make, threshold, budget, overhead), f"round_{k}")
        counts.append(buckets.count())
        if counts[-1] == counts[-2]:
            break
    return buckets, counts


# coarse buckets


def grams(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))} if text else set()


class Best:
    """Growing signatures, and the one most alike to a set: by an index of grams, so that only those with one in common
    are compared; ties go to the earlier."""

    def __init__(self):
        self.signatures: list[set[str]] = []
        self.index: dict[str, set[int]] = {}

    def add(self, own: set[str], at: int | None = None) -> int:
        if at is None:
            at = len(self.signatures)
            self.signatures.append(set())
        for g in own - self.signatures[at]:
            self.index.setdefault(g, set()).add(at)
        self.signatures[at] |= own
        return at

    def find(self, own: set[str]) -> tuple[float, int]:
        shared = Counter(i for g in own for i in self.index.get(g, ()))
        return max(((n / (len(own) + len(self.signatures[i]) - n), -i) for i, n in shared.items()), default=(0.0, 0))


def merge_and_attach(buckets: list[list[str]], n: int, merge: float, attach: float, smallest: int) -> list[list[str]]:
    """In order each bucket joins the most alike one before it at the first threshold; then those still below the
    smallest size join the most alike larger one, as it was, at the second. Ties go to the earlier bucket."""
    best, out = Best(), []
    for items in buckets:
        own = set().union(*(grams(e, n) for e in items))
        score, at = best.find(own)
        if out and score >= merge and score > 0:
            out[-at] += items
            best.add(own, -at)
        else:
            best.add(own)
            out.append(list(items))
    large = [i for i, b in enumerate(out) if len(b) >= smallest]
    if not large or len(large) == len(out):
        return out
    fixed, gone = Best(), set()
    for i in large:
        fixed.add(set().union(*(grams(e, n) for e in out[i])))
    for i, items in enumerate(out):
        if i not in set(large):
            score, at = fixed.find(set().union(*(grams(e, n) for e in items)))
            if score >= attach and score > 0:
                out[large[-at]] += items
                gone.add(i)
    return [b for i, b in enumerate(out) if i not in gone]


def coarse_buckets(entities: DataFrame, size: int, n: int = 2, merge: float = 0.6, attach: float = 0.4, smallest: int = 2) -> DataFrame:
    """type, entity, bucket, chunk from coarse chunks (type, block, chunk, entity): merged, attached, and cut to a size.
    A type is one sequence, as each bucket depends on those before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["block", "chunk", "entity"])
        first = [g["entity"].tolist() for _, g in ordered.groupby(["block", "chunk"], sort=True)]
        rows = [(e, i, k // size) for i, items in enumerate(merge_and_attach(first, n, merge, attach, smallest)) for k, e in enumerate(items)]
        out = pd.DataFrame(rows, columns=["entity", "bucket", "chunk"])
        out.insert(0, "type", pdf["type"].iloc[0])
        return out

    return entities.select("type", "block", "chunk", "entity").groupBy("type").applyInPandas(run, "type string, entity string, bucket long, chunk long")
