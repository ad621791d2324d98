"""The benchmark tables seen as inputs of the engine: an evidence graph, a vector corpus, a text corpus.

Each adapter has the same content as SQL, for the oracles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.components import cut

_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def built(spark, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session start from, written once under the checkpoint folder."""
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key not in _BUILT:
        _BUILT[key] = cut(make(), name)
    return _BUILT[key]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark, sf_dir: str, by: str = "report_id") -> DataFrame:
    """A row for each line item: its report (the order) and the names of its entities. Dealt by report while rows are still
    narrow, so that what is distinct within a report (bridges, mentions, edges) needs no further shuffle of names; or by
    l_partkey (partkey)."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        text("l_orderkey").alias("report_id"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", "p_brand"
    )
    return rows.repartition(by).select(
        "report_id",
        F.concat(F.lit("P"), text("l_partkey")).alias("issue"),
        F.concat(F.lit("F"), text("l_suppkey"), F.lit("-"), "l_returnflag", "l_linestatus").alias("phen"),
        F.concat(F.lit("D"), (F.col("l_partkey") % 50).cast("string"), F.lit("-"), text("l_linenumber")).alias("diag"),
        F.concat(F.lit("B"), "p_brand", F.lit("-"), text("l_suppkey")).alias("elem"),
        F.concat(F.lit("S"), text("l_suppkey")).alias("mod"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("partkey"),
    )


ENDS = {"issue": "ISSUE", "phen": "PHEN", "diag": "DIAG", "elem": "ELEM", "mod": "MOD"}
EDGES = (("issue", "concerns", "elem"), ("elem", "located_in", "mod"), ("phen", "accompanied_by", "diag"), ("diag", "reported_in", "mod"))


def mentions(spark, sf_dir: str) -> DataFrame:
    """report_id, type, name, line: an entity's mention in a report (not distinct)."""
    ends = F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).alias("name")) for c, t in ENDS.items()))
    return facts(spark, sf_dir).select("report_id", "line", F.inline(ends))


def edge_rows(spark, sf_dir: str) -> DataFrame:
    """report_id, source, relation, target, source_type, target_type, line; one row for each line item."""
    rows = F.array(*(
        F.struct(F.col(a).alias("source"), F.lit(r).alias("relation"), F.col(b).alias("target"), F.lit(ENDS[a]).alias("source_type"), F.lit(ENDS[b]).alias("target_type"))
        for a, r, b in EDGES
    ))
    return facts(spark, sf_dir).select("report_id", "line", F.inline(rows))


FACTS_SQL = """facts AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS report_id, 'P' || l_partkey AS issue, 'F' || l_suppkey || '-' || l_returnflag || l_linestatus AS phen,
         'D' || (l_partkey % 50) || '-' || l_linenumber AS diag, 'B' || p_brand || '-' || l_suppkey AS elem, 'S' || l_suppkey AS mod,
         l_linenumber AS line, l_partkey AS partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey),
mentions AS (""" + " UNION ALL ".join(f"SELECT report_id, line, '{t}' AS type, {c} AS name FROM facts" for c, t in ENDS.items()) + """),
edge_rows AS (""" + " UNION ALL ".join(
    f"SELECT report_id, line, {a} AS source, '{r}' AS relation, {b} AS target, '{ENDS[a]}' AS source_type, '{ENDS[b]}' AS target_type FROM facts" for a, r, b in EDGES
) + """),
bridge AS (SELECT DISTINCT name AS node_id, report_id FROM mentions WHERE type <> 'MOD'),
node_types AS (SELECT DISTINCT name AS node_id, type FROM mentions)"""


def bridge(spark, sf_dir: str) -> DataFrame:
    """node_id, report_id without the hub type MOD."""
    return mentions(spark, sf_dir).where("type <> 'MOD'").select(F.col("name").alias("node_id"), "report_id").distinct()


def node_types(spark, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select(F.col("name").alias("node_id"), "type").distinct()


def seeds(spark, sf_dir: str) -> DataFrame:
    """Every part as a seed."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("seed"))


SEEDS_SQL = "seeds AS (SELECT 'P' || p_partkey AS seed FROM part)"


def urgent_issues(spark, sf_dir: str) -> DataFrame:
    """node_id, report_id: a scope of reports and types, parts within orders of the highest priority."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("report_id"))
    issues = mentions(spark, sf_dir).where("type = 'ISSUE'").select(F.col("name").alias("node_id"), "report_id").distinct()
    return issues.join(urgent, "report_id", "left_semi").select("node_id", "report_id")


URGENT_SQL = """lean AS (SELECT DISTINCT name AS node_id, report_id FROM mentions
  WHERE type = 'ISSUE' AND report_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'))"""


def vectors(spark, sf_dir: str) -> DataFrame:
    """app, id, issue_key, cluster_id, vector of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("emb").alias("app"), F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("issue_key"),
        F.concat(F.lit("emb__C"), (F.col("vec_id") % 20).cast("string")).alias("cluster_id"), F.col("embedding").cast("array<double>").alias("vector"),
    )


VECTORS_SQL = """vectors AS (SELECT 'emb' AS app, CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS issue_key, 'emb__C' || (vec_id % 20) AS cluster_id,
  CAST(embedding AS DOUBLE[]) AS vector, vec_id FROM embeddings)"""


def corpus(spark, sf_dir: str) -> DataFrame:
    """app, id, issue_key, text of the documents: a report's text is the document's whole text."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("app"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("issue_key"), "text", "n_chars", "doc_id"
    )


CORPUS_SQL = "corpus AS (SELECT lang AS app, CAST(doc_id AS VARCHAR) AS id, source AS issue_key, text, n_chars, doc_id FROM documents)"


def names(spark, sf_dir: str) -> DataFrame:
    """entity, type of parts, brands and market segments."""
    part = table(spark, sf_dir, "part")
    return (
        part.select(F.col("p_name").alias("entity"), F.lit("ELEM").alias("type"))
        .unionByName(part.select(F.col("p_brand").alias("entity"), F.lit("MOD").alias("type")))
        .unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("entity"), F.lit("OP").alias("type")))
        .distinct()
    )


NAMES_SQL = """names AS (SELECT DISTINCT p_name AS entity, 'ELEM' AS type FROM part UNION SELECT DISTINCT p_brand, 'MOD' FROM part
  UNION SELECT DISTINCT c_mktsegment, 'OP' FROM customer)"""
