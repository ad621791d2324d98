"""Entity unification: n-gram blocking, leader clusters, buckets, pair validation, closure and its statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import char_ngrams
from sightline.operators.components import all_components


def ngram_pairs(entities: DataFrame, n: int, threshold: float) -> DataFrame:
    """type, a < b, jaccard of entities of one type that share an n-gram and are alike enough. A shared gram
    is a join key, so only entities that can be alike meet."""
    grams = entities.select("type", "entity", F.explode(char_ngrams(F.col("entity"), n)).alias("gram"))
    size = grams.groupBy("type", "entity").agg(F.count("*").alias("size"))
    shared = grams.withColumnRenamed("entity", "a").join(grams.withColumnRenamed("entity", "b"), ["type", "gram"]).where("a < b").groupBy("type", "a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(size.select("type", F.col("entity").alias("a"), F.col("size").alias("size_a")), ["type", "a"]).join(size.select("type", F.col("entity").alias("b"), F.col("size").alias("size_b")), ["type", "b"])
    j = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    return out.where(j >= threshold).select("type", "a", "b", F.round(j, 6).alias("jaccard"))


def closure(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """entity, cluster: the least member that pairs (a, b) lead to."""
    found = all_components(entities.select(F.col("entity").alias("node")).distinct(), pairs.select("a", "b"))
    return found.select(F.col("node").alias("entity"), F.col("component").alias("cluster"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster").agg(F.countDistinct("entity").alias("n"))
    out = sizes.agg(F.sum("n").alias("n_entities"), F.count("*").alias("n_clusters"), F.avg("n").alias("avg"), F.max("n").alias("max_size"), F.avg((F.col("n") == 1).cast("double")).alias("single"))
    return out.select("n_entities", "n_clusters", F.round(1 - F.col("n_clusters") / F.greatest("n_entities", F.lit(1)), 6).alias("reduction"), F.round("avg", 6).alias("avg_size"), "max_size", F.round("single", 6).alias("singleton_ratio"))


def top_clusters(clusters: DataFrame, most: int = 20, examples: int = 10) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("entity"))
    few = clusters.withColumn("place", place)
    out = few.groupBy("cluster").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= examples, F.col("entity")))), "|").alias("examples"))
    return out.orderBy(F.desc("n"), "cluster").limit(most)


def keyword_groups(buckets: DataFrame) -> DataFrame:
    """keyword, n, bucket_ids of keywords that several buckets share. buckets: bucket_id, keyword."""
    out = buckets.distinct().groupBy("keyword").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("bucket_id")), "|").alias("bucket_ids"))
    return out.where("n > 1")


def prefix_chunks(entities: DataFrame, prefix: int, size: int) -> DataFrame:
    """type, block, chunk, entity: entities of one prefix in chunks of a size."""
    block = F.substring("entity", 1, prefix)
    place = F.row_number().over(Window.partitionBy("type", block).orderBy("entity"))
    return entities.select("type", block.alias("block"), "entity", F.floor((place - 1) / size).alias("chunk"))


def leaders(names: list[str], n: int, threshold: float) -> list[tuple[str, str]]:
    """(entity, leader): in order each joins the best leader so far whose growing n-gram set is alike enough."""
    grams = lambda s: {s[i : i + n] for i in range(max(1, len(s) - n + 1))} if s else set()
    found: list[list] = []
    out = []
    for name in names:
        own = grams(name)
        scored = [(len(own & g) / len(own | g) if own | g else 0.0, -i) for i, (_, g) in enumerate(found)]
        best = max(scored, default=(0.0, 0))
        if scored and best[0] >= threshold:
            leader = found[-best[1]]
            leader[1] |= own
        else:
            leader = [name, set(own)]
            found.append(leader)
        out.append((name, leader[0]))
    return out


def leader_clusters(entities: DataFrame, n: int = 2, threshold: float = 0.6) -> DataFrame:
    """type, entity, leader; a type is one sequence, as each entity depends on those before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(leaders(sorted(pdf["entity"]), n, threshold), columns=["entity", "leader"])
        out.insert(0, "type", pdf["type"].iloc[0])
        return out

    return entities.groupBy("type").applyInPandas(run, "type string, entity string, leader string")


def accepted_pairs(pairs: DataFrame, verdict: Column, score: Column) -> DataFrame:
    """Pairs proposed at 0.5 that a validator passes at 0.6; a missing verdict rejects."""
    return pairs.where((score >= 0.5) & (F.coalesce(verdict, F.lit("否决")) == "通过") & (score >= 0.6))
