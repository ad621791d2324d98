"""The tables of a selection's report and of a comparison of methods; each is a DataFrame, written by sinks.write_report()."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def selection(
    nodes: DataFrame, edges: DataFrame, states: DataFrame, sized: DataFrame, view_reports: DataFrame, status: DataFrame, chosen: DataFrame, r_max: int,
    bridge: DataFrame, best: DataFrame | None = None, texts: DataFrame | None = None, own: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The fourteen tables of a selection.

    nodes: node_id, type, n_reports; edges: report_id and an edge's columns; states: node_id, state of the universe, as
    views.reachability() gives it; sized: seed, n_reports, n_nodes, n_edges, cost, n_covered of all views; view_reports: seed,
    report_id; status: seed, stopped_reason, hop; chosen: seed; own, bridge: node_id, report_id before and after the
    edges' reports were added to nodes; best: views.missed(), without it there is no table of missed nodes; texts: report_id, description."""
    picked = chosen.select("seed").distinct()
    here = lambda df: df.join(F.broadcast(picked), "seed", "left_semi")  # noqa: E731  a selection is a short list
    reports = here(view_reports).select("seed", "report_id")
    state = states.join(nodes, "node_id")
    held = bridge.join(F.broadcast(reports), "report_id").select("seed", "node_id").unionByName(picked.select("seed", F.col("seed").alias("node_id"))).distinct()
    by_type = lambda rows: rows.groupBy("type").agg(F.count("*").alias("n"))
    described = texts if texts is not None else nodes.sparkSession.createDataFrame([], "report_id string, description string")
    out = {
        "selected": here(sized).select("seed", "cost", "n_reports", "n_nodes", "n_edges", "n_covered"),
        "sel_reports": reports,
        "sel_defects": described.join(F.broadcast(reports.select("report_id").distinct()), "report_id", "left_semi").select("report_id", "description").distinct(),
        "sel_nodes": nodes.join(F.broadcast(held), "node_id").select("seed", "node_id", "type", "n_reports"),
        "sel_edges": edges.join(F.broadcast(reports), "report_id").select("report_id", "seed", *(c for c in edges.columns if c != "report_id")),
        "seed_stats": status.join(sized, "seed").where("stopped_reason <> 'seed-has-no-reports'").select(
            "seed", "n_reports", (F.col("n_reports") >= r_max).alias("maybe_truncated"), "stopped_reason", "hop", "n_nodes", "n_edges", "n_covered"
        ),
        "skipped_seeds": status.where("stopped_reason = 'seed-has-no-reports'"),
        "uncovered_nodes": state.where("state <> 'covered'").select("node_id", "type", "n_reports", (F.col("state") == "missed").alias("ever_in_candidate")),
        "unreachable_nodes": state.where("state = 'unreachable'").select("node_id", "type", "n_reports"),
        "type_universe": by_type(state), "type_covered": by_type(state.where("state = 'covered'")), "type_uncovered": by_type(state.where("state <> 'covered'")),
    }
    if best is not None:
        out["missed_nodes"] = state.where("state = 'missed'").select("node_id", "type", "n_reports").join(best, "node_id")
    counts = [("universe_nodes", states), ("universe_nodes_without_reports", state.where("n_reports = 0"))]
    if own is not None:
        both = bridge.select("report_id", "node_id", F.lit(False).alias("known")).unionByName(own.select("report_id", "node_id", F.lit(True).alias("known")))
        added = both.groupBy("report_id", "node_id").agg(F.max("known").alias("known")).where("NOT known")  # links dealt by report stay where they are
        counts += [("backfilled_links", added), ("backfilled_nodes", added.select("node_id").distinct()), ("edge_only_nodes", bridge.select("node_id").distinct().join(own, "node_id", "left_anti"))]
    meta = None
    for key, rows in counts:
        row = rows.agg(F.count("*").alias("value")).select(F.lit(key).alias("key"), "value")
        meta = row if meta is None else meta.unionByName(row)
    return out | {"meta": meta}


def type_counts(sheets: dict[str, DataFrame]) -> DataFrame:
    """set, type, n: the universe, what is covered and what is not, in one table."""
    out = None
    for name in ("universe", "covered", "uncovered"):
        rows = sheets[f"type_{name}"].select(F.lit(name).alias("set"), "type", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def curves(chosen: DataFrame, items: DataFrame, view_reports: DataFrame, budget: float, n_items: int, n_reports: int) -> DataFrame:
    """method, step, seed, cost, cum_cost, rho, cov_entity, cov_report along each method's choice (method, step, seed, cost)."""
    upto = Window.partitionBy("method").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)

    def new(rows: DataFrame, key: str, name: str) -> DataFrame:
        few = F.broadcast(chosen.select("method", "step", "seed"))  # a choice is a short list
        first = rows.select("seed", key).join(few, "seed").groupBy("method", key).agg(F.min("step").alias("step"))
        return first.groupBy("method", "step").agg(F.count("*").alias(name))

    rows = chosen.join(new(items, "node_id", "e"), ["method", "step"], "left").join(new(view_reports, "report_id", "r"), ["method", "step"], "left").na.fill(0, ["e", "r"])
    share = lambda c, n: F.round(F.sum(c).over(upto) / F.lit(max(n, 1)), 6)
    cum = F.sum("cost").over(upto)
    return rows.select(
        "method", "step", "seed", F.round("cost", 6).alias("cost"), F.round(cum, 6).alias("cum_cost"), F.round(F.least(F.lit(1.0), cum / budget), 6).alias("rho"),
        share("e", n_items).alias("cov_entity"), share("r", n_reports).alias("cov_report"),
    )


def at_budget(curve: DataFrame) -> DataFrame:
    """A row a method: views, cost and coverage of what fits in the budget."""
    return curve.groupBy("method").agg(
        F.count("*").alias("n_views"), F.count_if(F.col("rho") < 1).alias("n_within"), F.round(F.max("cum_cost"), 6).alias("cost"),
        *(F.round(F.coalesce(F.max(F.when(F.col("rho") < 1, F.col(c))), F.lit(0.0)), 6).alias(f"{c}_at_budget") for c in ("cov_entity", "cov_report")),
        *(F.round(F.max(c), 6).alias(f"{c}_end") for c in ("cov_entity", "cov_report")),
    )


def repeated(curve: DataFrame, name: str) -> DataFrame:
    """step, mean and deviation of both coverages over the runs of a method (method: name, a dash, the run), the
    monotone envelope of the mean."""
    rows = curve.where(F.col("method").startswith(f"{name}-")).groupBy("step").agg(
        F.count("*").alias("n_runs"), *(f(c).alias(f"{c}_{n}") for c in ("cov_entity", "cov_report") for n, f in (("mean", lambda c: F.round(F.avg(c), 4)), ("std", lambda c: F.round(F.stddev_pop(c), 4))))
    )
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as steps
    return rows.withColumn("envelope", F.max("cov_entity_mean").over(upto))
