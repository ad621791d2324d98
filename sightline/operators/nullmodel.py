"""The random-contraction null model: all its runs in one plan, the run as a column."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.components import all_components, cut
from sightline.operators.ranking import global_rank


def resized(sizes: dict[int, int], target: int) -> dict[int, int]:
    """Group sizes (size: how many) brought to a number of groups: a largest splits in halves, or the two smallest
    merge, again and again. All groups of one size are alike, so they are treated together: the work grows with the
    number of different sizes, not of groups."""
    out, n = Counter({s: c for s, c in sizes.items() if c > 0}), sum(sizes.values())
    while n < target and out and max(out) > 1:
        size = max(out)
        k = min(out[size], target - n)
        out[size] -= k
        out[size // 2] += k
        out[size - size // 2] += k
        n += k
        out = +out
    while n > max(1, target):
        size = min(out)
        if out[size] >= 2:
            k = min(out[size] // 2, n - max(1, target))
            out[size] -= 2 * k
            out[2 * size] += k
            n -= k
        else:
            out[size] -= 1
            other = min(+out)
            out[other] -= 1
            out[size + other] += 1
            n -= 1
        out = +out
    return dict(out)


def equal_sizes(n: int, groups: int) -> dict[int, int]:
    """n nodes in so many groups, as equal as can be."""
    groups = max(1, min(groups, n))
    low, more = divmod(n, groups)
    return dict(Counter({low: groups - more}) + Counter({low + 1: more})) if n else {}


def contracted(nodes: DataFrame, sizes: dict[str, dict[int, int]], runs: int) -> DataFrame:
    """run, node_id, type, group of each run: a type's nodes in an order by hash, cut into groups of the given sizes,
    smaller ones first; what lies beyond them, or has no sizes, is a group of its own."""
    blocks = []
    for kind, own in sizes.items():
        place, number = 0, 0
        for size in sorted(own):
            blocks.append((kind, size, place, place + size * own[size], number))
            place, number = place + size * own[size], number + own[size]
    table = nodes.sparkSession.createDataFrame(blocks, "type string, size long, low long, high long, first long")  # a row for each different size
    copies = nodes.select("node_id", "type", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    drawn = copies.withColumn("draw", F.md5(F.concat_ws(":", F.col("run").cast("string"), "node_id")))
    ranked = cut(global_rank(drawn, ["run", "type", "draw", "node_id"], "n"), "ranked")
    begins = ranked.groupBy("run", "type").agg(F.min("n").alias("begin"))
    own = ranked.join(F.broadcast(begins), ["run", "type"]).select("run", "node_id", "type", (F.col("n") - F.col("begin")).alias("place"))
    at = (own["type"] == table["type"]) & (own["place"] >= table["low"]) & (own["place"] < table["high"])
    number = F.col("first") + F.floor((F.col("place") - F.col("low")) / F.col("size"))
    named = F.coalesce(F.concat(own["type"], F.lit("#"), number.cast("string")), own["node_id"])
    return own.join(F.broadcast(table), at, "left").select("run", "node_id", own["type"], named.alias("group"))


def contracted_edges(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """run, a, b: the simple edges between groups."""
    a, b = (groups.select("run", F.col("node_id").alias(c), F.col("group").alias(f"g{c}")) for c in "ab")
    rows = edges.join(a, "a").join(b, ["run", "b"]).where("ga <> gb")
    return rows.select("run", F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()


def run_metrics(groups: DataFrame, edges: DataFrame, node_report: DataFrame) -> DataFrame:
    """run, n_nodes, n_edges, cer: groups, simple edges between them, and the share of edges whose ends have no report
    in common. An edge is looked up by the reports of its end that has fewer."""
    links = cut(contracted_edges(groups, edges), "links")
    held = cut(groups.join(node_report, "node_id").select("run", "group", "report_id").distinct(), "held")
    n = held.groupBy("run", "group").agg(F.count("*").alias("n"))
    na, nb = (n.select("run", F.col("group").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    sized = links.join(na, ["run", "a"]).join(nb, ["run", "b"])
    fewer = F.col("na") <= F.col("nb")
    probe = sized.select("run", "a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("group"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    both = probe.join(held, ["run", "group"]).join(held.withColumnRenamed("group", "other"), ["run", "other", "report_id"], "left_semi")
    joined = both.select("run", "a", "b").distinct().groupBy("run").agg(F.count("*").alias("joined"))
    nodes = groups.groupBy("run").agg(F.countDistinct("group").alias("n_nodes"))
    counts = links.groupBy("run").agg(F.count("*").alias("n_edges"))
    rows = nodes.join(counts, "run", "left").join(joined, "run", "left").na.fill(0, ["n_edges", "joined"])
    return rows.select("run", "n_nodes", "n_edges", F.round(1 - F.col("joined") / F.greatest("n_edges", F.lit(1)), 6).alias("cer"))


def run_components(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """run, n_components, lcc_ratio: one search over the runs' graphs side by side, as a run is part of a group's name."""
    name = lambda c: F.concat_ws("|", F.col("run").cast("string"), c)
    nodes = groups.select(name("group").alias("node")).distinct()
    found = all_components(nodes, contracted_edges(groups, edges).select(name("a").alias("a"), name("b").alias("b")))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).withColumn("run", F.substring_index("component", "|", 1).cast("int"))
    return sizes.groupBy("run").agg(F.count("*").alias("n_components"), F.round(F.max("n") / F.sum("n"), 6).alias("lcc_ratio"))


def null_quantiles(runs: DataFrame, values: list[str], points: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """metric, mean, std and the quantiles of each value over the runs."""
    long = runs.select("run", *(F.col(v).cast("double").alias(v) for v in values)).unpivot(["run"], values, "metric", "value")
    shares = [F.round(F.percentile("value", p), 6).alias(f"q{p * 1000:g}") for p in points]
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), *shares)
