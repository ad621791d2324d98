"""Summary tables: strict joins, scopes, formatted means, snapshots, gains, audits and repaired clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns. A key that either side repeats, or that right lacks, is an error when the rows
    are read, whichever task meets it."""

    def single(df: DataFrame, name: str) -> DataFrame:
        more = [c for c in df.columns if c not in keys]
        rows = df.groupBy(*keys).agg(F.count("*").alias("n"), F.first(F.struct(F.lit(True).alias("there"), *more)).alias(name))
        told = F.raise_error(F.concat_ws(" ", F.lit(f"{name} side repeats the key"), *(F.col(k).cast("string") for k in keys)))
        return rows.select(*keys, F.when(F.col("n") == 1, F.col(name)).otherwise(told.cast(rows.schema[name].dataType)).alias(name))

    rows = single(left, "left").join(single(right, "right"), keys, "left")
    told = F.raise_error(F.concat_ws(" ", F.lit("no row for the key"), *(F.col(k).cast("string") for k in keys)))
    rows = rows.withColumn("right", F.when(F.col("right").isNotNull(), F.col("right")).otherwise(told.cast(rows.schema["right"].dataType)))
    more = [F.col(side)[c].alias(c) for side, df in (("left", left), ("right", right)) for c in df.columns if c not in keys]
    return rows.select(*keys, *more)


def in_scope(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Bridge or edge rows of the allowed reports (report_id)."""
    return rows.join(allowed.select("report_id").distinct(), "report_id", "left_semi").select(*rows.columns)


def chosen_methods(rows: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the methods asked for (all, if none is named), less the excluded ones."""
    rows = rows.where(F.col("method").isin(*include)) if include else rows
    return rows.where(~F.col("method").isin(*exclude)) if exclude else rows


def universes(raw: DataFrame, unified: DataFrame) -> DataFrame:
    """Sizes of the report universes of two provenance tables, what only one has, and whether they are equal."""
    side = lambda df, bit: df.select("report_id", F.lit(bit).alias("bit"))
    seen = side(raw, 1).unionByName(side(unified, 2)).groupBy("report_id").agg(F.bit_or("bit").alias("in"))
    return seen.agg(
        F.count_if(F.col("in") != 2).alias("n_raw"), F.count_if(F.col("in") != 1).alias("n_unified"), F.count_if(F.col("in") == 1).alias("only_raw"),
        F.count_if(F.col("in") == 2).alias("only_unified"), (F.count_if(F.col("in") != 3) == 0).alias("equal"),
    )


def uncovered(nodes: DataFrame) -> DataFrame:
    """Uncovered nodes (ever_in_candidate, n_reports), those that no candidate has first, then by reports."""
    return nodes.orderBy("ever_in_candidate", F.desc("n_reports"), "node_id")


def mean_std_text(value: str) -> Column:
    """An aggregate: mean±population standard deviation, four places."""
    return F.format_string("%.4f±%.4f", F.round(F.avg(value), 6), F.round(F.stddev_pop(value), 6))


def run_summary(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Runs a method had and mean±std of each value over them."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *(mean_std_text(c).alias(c) for c in values))


def balanced_sample(rows: DataFrame, by: list[str], key: str, cap: int, seed: int) -> DataFrame:
    """At most cap rows of each group, the first by a seeded hash of their key."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    return rows.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def snapshots(curves: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Of curves (app, method, rho, coverage) the coverage reached at each share of the budget, as median and
    quartiles over the apps; an app without a point by then counts with 0."""
    at = F.explode(F.array(*(F.lit(s) for s in shares))).alias("share")
    reached = curves.select("app", "method", "rho", "coverage", at).groupBy("app", "method", "share").agg(
        F.coalesce(F.max(F.when(F.col("rho") <= F.col("share"), F.col("coverage"))), F.lit(0.0)).alias("v")
    )
    quartile = lambda q: F.round(F.percentile("v", F.lit(q)), 6)
    return reached.groupBy("method", "share").agg(quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"), F.count("*").alias("n_apps"))


def selected_counts(table: DataFrame, views: DataFrame) -> DataFrame:
    """Median, mean and total number of selected views of each method over apps: by the table (method, app,
    n_sel) if it has the method, else by counting the views (method, app)."""
    counted = views.groupBy("method", "app").agg(F.count("*").alias("n_sel"))
    counted = counted.join(table.select("method").distinct(), "method", "left_anti")
    rows = table.select("method", "app", "n_sel").unionByName(counted.select("method", "app", "n_sel"))
    return rows.groupBy("method").agg(
        F.percentile("n_sel", F.lit(0.5)).alias("median"), F.round(F.avg("n_sel"), 6).alias("mean"), F.sum("n_sel").alias("total"), F.count("*").alias("n_apps")
    )


def positive_pairs(n: Column, share: Column) -> Column:
    """Pairs that a share of all n(n-1)/2 stands for, rounded."""
    return F.round(share * n * (n - 1) / 2).cast("long")


def gains(rows: DataFrame, baseline: str, order: list[str], values: list[str]) -> DataFrame:
    """boundary, method, place in the given order, and each value's gain over the boundary's baseline row."""
    base = rows.where(F.col("method") == baseline).select("boundary", *(F.col(v).alias(f"base_{v}") for v in values))
    place = F.array_position(F.array(*(F.lit(m) for m in order)), F.col("method"))
    own = rows.where(F.col("method").isin(*order) & (F.col("method") != baseline)).join(base, "boundary")
    return own.select("boundary", "method", place.alias("place"), *(F.round(F.col(v) - F.col(f"base_{v}"), 6).alias(f"delta_{v}") for v in values))


def pool_audit(pool: DataFrame, cap: int) -> DataFrame:
    """Of each method's candidate pool (method, kind, cost) the candidates, those of each kind, and whether the cap binds."""
    return pool.groupBy("method").agg(
        F.count("*").alias("n_candidates"), F.count_if(F.col("kind") == "merged").alias("n_merged"), F.count_if(F.col("kind") == "single").alias("n_single"),
        F.round(F.avg("cost"), 6).alias("avg_cost"), (F.count("*") >= cap).alias("cap_binds"),
    )


def repaired_clusters(clusters: DataFrame, reports: DataFrame) -> DataFrame:
    """cluster_id, report_no: an iterative clustering made complete and valid. Reports in no cluster share a new
    one; a report in several stays in the largest (the least id if they tie); those not asked for go; what is
    left is numbered from 1 without gaps. clusters: cluster_id, report_no; reports: report_no."""
    clusters = clusters.where("report_no > 0").distinct()
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    known = clusters.join(reports.select("report_no").distinct(), "report_no", "left_semi").join(sizes, "cluster_id")
    owned = known.groupBy("report_no").agg(F.min(F.struct(-F.col("size"), "cluster_id")).alias("best")).select(F.col("best.cluster_id").alias("cluster_id"), "report_no")
    top = clusters.agg((F.coalesce(F.max("cluster_id"), F.lit(0)) + 1).alias("cluster_id"))
    missing = reports.select("report_no").distinct().join(clusters.select("report_no"), "report_no", "left_anti")
    whole = owned.unionByName(missing.join(F.broadcast(top)).select("cluster_id", "report_no"))  # top is one row
    numbers = whole.select("cluster_id").distinct().select("cluster_id", F.row_number().over(Window.orderBy("cluster_id")).alias("number"))
    return whole.join(numbers, "cluster_id").select(F.col("number").cast("long").alias("cluster_id"), "report_no")


def summary_text(text: Column) -> Column:
    """White space squeezed, a list's mark in front dropped, 300 characters at most (fixed values)."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.substring(F.regexp_replace(squeezed, r"^[\-*\d.\s]+", ""), 1, 300)


def boundary_token(text: Column, fallback: str = "llmcluster") -> Column:
    """A name for files and methods: other characters become _, 64 at most, never empty (fixed values)."""
    plain = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^a-zA-Z0-9_.\-]+", "_")
    token = F.trim(F.substring(plain, 1, 64), F.lit("_"))
    return F.when(token == "", fallback).otherwise(token)
