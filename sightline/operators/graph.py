"""Nodes, edges, provenance bridges and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_table(mentions: DataFrame) -> DataFrame:
    """type, name, n_reports, report_ids (joined, by text) of each (name, type)."""
    ids = F.array_sort(F.collect_set("report_id"))
    return mentions.groupBy("type", "name").agg(ids.alias("ids")).select("type", "name", F.size("ids").cast("bigint").alias("n_reports"), F.array_join("ids", "|").alias("report_ids"))


def relabelled(triples: DataFrame, clusters: DataFrame) -> DataFrame:
    """Triples with each end replaced by its cluster's first entity; ends without a cluster stay."""
    first = clusters.groupBy("cluster").agg(F.min("entity").alias("name"))
    named = clusters.groupBy("entity").agg(F.min("cluster").alias("cluster")).join(first, "cluster").select("entity", "name")
    out = triples
    for end in ("subject", "object"):
        out = out.join(named.select(F.col("entity").alias(end), F.col("name").alias(f"{end}_name")), end, "left")
        out = out.withColumn(end, F.coalesce(f"{end}_name", end)).drop(f"{end}_name")
    return out


def edge_bag(edges: DataFrame) -> DataFrame:
    """Parallel edges kept as a count: source, relation, target, n_rows, n_reports. Counted in each report first, so that
    of rows that are dealt by report partial counts alone are shuffled."""
    key = ["source_type", "source", "relation", "target_type", "target"]
    own = edges.groupBy("report_id", *key).agg(F.count("*").alias("n"))
    return own.groupBy(*key).agg(F.sum("n").alias("n_rows"), F.count("report_id").alias("n_reports"))


def edge_ends(edges: DataFrame) -> DataFrame:
    """node_id, report_id of both ends."""
    return edges.select("report_id", F.explode(F.array("source", "target")).alias("node_id"))


def backfilled(node_report: DataFrame, edges: DataFrame) -> DataFrame:
    """node_report with what only the edges say."""
    return node_report.select("node_id", "report_id").unionByName(edge_ends(edges).select("node_id", "report_id")).distinct()


def gained(node_report: DataFrame, edges: DataFrame) -> DataFrame:
    """Links that only the edges give: grouped with the others and not joined, so that rows dealt by report stay where they are."""
    known = node_report.select("report_id", "node_id", F.lit(True).alias("known"))
    both = known.unionByName(edge_ends(edges).select("report_id", "node_id", F.lit(False).alias("known")))
    links = both.where("report_id IS NOT NULL AND node_id IS NOT NULL").groupBy("report_id", "node_id").agg(F.max("known").alias("known"))
    return links.where("NOT known").select("report_id", "node_id")


def backfill_audit(node_report: DataFrame, edges: DataFrame) -> DataFrame:
    return gained(node_report, edges).agg(F.countDistinct("node_id").alias("nodes_gaining"), F.count("*").alias("links_gained"))


def edge_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that no node row has."""
    return edge_ends(edges).select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def type_counts(nodes: DataFrame, covered: DataFrame, universe: tuple[str, ...]) -> DataFrame:
    """Of the universe's types how many nodes there are, how many are covered and how many not."""
    own = nodes.where(F.col("type").isin(*universe)).join(covered.select("node_id").distinct().withColumn("hit", F.lit(1)), "node_id", "left")
    return own.groupBy("type").agg(F.count("*").alias("n_universe"), F.count("hit").alias("n_covered"), (F.count("*") - F.count("hit")).alias("n_uncovered"))


def type_votes(votes: DataFrame) -> DataFrame:
    """The type most voted for, of node_id, type, first (when it was seen first); UNK has no vote."""
    n = votes.where("type <> 'UNK'").groupBy("node_id", "type").agg(F.count("*").alias("votes"), F.min("first").alias("first"))
    best = n.groupBy("node_id").agg(F.max(F.struct("votes", (-F.col("first")).alias("early"), F.col("type"))).alias("best"), F.count("*").alias("n_types"))
    return best.select("node_id", F.col("best.type").alias("type"), F.col("best.votes").alias("votes"), F.col("n_types"), (F.col("n_types") > 1).alias("conflict"))


def type_histogram(types: DataFrame, spark) -> DataFrame:
    """Counts of the seven types, zeros included."""
    every = spark.createDataFrame([(t,) for t in ("MOD", "OP", "ELEM", "PHEN", "DIAG", "ISSUE", "UNK")], "type string")
    n = types.groupBy("type").agg(F.count("*").alias("n"))
    return every.join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def simple_graph(edges: DataFrame) -> DataFrame:
    """Undirected, without loops and parallels: a < b, relations (joined), n_reports."""
    own = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relation", "report_id")
    by_relation = own.groupBy("report_id", "a", "b").agg(F.collect_set("relation").alias("relations"))
    return by_relation.groupBy("a", "b").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("relations")))), "|").alias("relations"), F.count("report_id").alias("n_reports"))


def consistent_ids(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """name, type, raw_id (order of type and name), unified_id: the least raw id of the cluster and type.

    The order comes from counts by range partition, not from one task's window."""
    from sightline.operators.ranking import global_rank

    raw = global_rank(nodes.select("type", "name").distinct(), ["type", "name"], "raw_id")
    own = raw.join(clusters.select(F.col("entity").alias("name"), "cluster"), "name", "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("\u0000"), "name")))
    least = own.groupBy("cluster", "type").agg(F.min("raw_id").alias("unified_id"))
    return own.join(least, ["cluster", "type"]).select("name", "type", "raw_id", "unified_id")


def numeric_first(node_report: DataFrame) -> DataFrame:
    """node_id, report_ids joined with numeric ids first."""
    from sightline.functions.ids import order_key

    w = F.array_sort(F.collect_set(order_key(F.col("report_id"))))
    return node_report.groupBy("node_id").agg(F.array_join(F.transform(w, lambda x: x["text"]), "|").alias("report_ids"))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("row_in_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("row_in_key = 1").drop("row_in_key")
