"""The tables of a selection's report and of a comparison of methods, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import report as rp
from sightline.plans import analytics_queries as aq
from sightline.plans import fixtures as fx
from sightline.plans import graph_queries as gq

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The selection that is reported: the ten dearest views.
PICK = """, chosen AS MATERIALIZED (SELECT seed FROM costs ORDER BY cost DESC, seed LIMIT 10), nn AS (SELECT node_id, type, coalesce(n, 0) AS n_reports FROM node_types LEFT JOIN (SELECT node_id, count(*) AS n FROM bridge GROUP BY node_id) USING (node_id)),
nc AS (SELECT seed, count(*) AS n_covered FROM items GROUP BY seed),
st AS (SELECT node_id, type, n_reports, CASE WHEN node_id IN (SELECT node_id FROM items JOIN chosen USING (seed)) THEN 'covered' WHEN node_id IN (SELECT node_id FROM items) THEN 'missed' ELSE 'unreachable' END AS state FROM nn WHERE type IN ('PHEN', 'DIAG', 'ISSUE'))"""
ITEMS = gq.ITEMS + PICK


def _sheets(spark, sf, best=None):
    reports, _, status = gq._expanded(spark, sf)
    types, bridge, chosen = fx.node_types(spark, sf), fx.bridge(spark, sf), gq._dearest(spark, sf)
    nodes = types.join(bridge.groupBy("node_id").agg(F.count("*").alias("n_reports")), "node_id", "left").na.fill(0, ["n_reports"])
    sized = gq._view_rows(spark, sf).select("seed", "n_reports", "n_nodes", "n_edges", "cost", F.size("items").cast("bigint").alias("n_covered"))
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("report_id"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("description"))
    own = bridge.where("node_id NOT LIKE 'D%'")
    return rp.selection(nodes, fx.edge_rows(spark, sf).select("report_id", "source", "relation", "target"), gq._states(spark, sf), sized, reports, status, chosen, gq.RMAX, bridge, best, orders, own)


@query(ITEMS + " SELECT seed, CAST(cost AS DOUBLE) AS cost, n_reports, n_nodes, n_edges, coalesce(n_covered, 0) AS n_covered FROM costs JOIN chosen USING (seed) LEFT JOIN nc USING (seed)")
def report_selected(spark, sf):
    return _sheets(spark, sf)["selected"]


@query(ITEMS + " SELECT seed, report_id FROM reports JOIN chosen USING (seed)")
def report_sel_reports(spark, sf):
    return _sheets(spark, sf)["sel_reports"]


@query(ITEMS + " SELECT DISTINCT report_id, o_orderstatus || ' ' || o_orderpriority AS description FROM reports JOIN chosen USING (seed) JOIN orders ON o_orderkey = CAST(report_id AS BIGINT)")
def report_sel_defects(spark, sf):
    return _sheets(spark, sf)["sel_defects"]


@query(ITEMS + " SELECT seed, node_id, type, n_reports FROM nodes JOIN chosen USING (seed) JOIN nn USING (node_id)")
def report_sel_nodes(spark, sf):
    return _sheets(spark, sf)["sel_nodes"]


@query(ITEMS + " SELECT seed, report_id, source, relation, target FROM reports JOIN chosen USING (seed) JOIN edge_rows USING (report_id)")
def report_sel_edges(spark, sf):
    return _sheets(spark, sf)["sel_edges"]


@query(ITEMS + f""", sr AS (SELECT seed, CASE WHEN max(n) > {gq.RMAX} THEN 'r-max-truncated' WHEN max(depth) < 1 THEN 'no-growth' ELSE 'k-reached' END AS stopped_reason FROM reports GROUP BY seed)
SELECT seed, n_reports, n_reports >= {gq.RMAX} AS maybe_truncated, stopped_reason, 1 AS hop, n_nodes, n_edges, coalesce(n_covered, 0) AS n_covered FROM sr JOIN costs USING (seed) LEFT JOIN nc USING (seed)""")
def report_seed_stats(spark, sf):
    return _sheets(spark, sf)["seed_stats"]


@query(ITEMS + " SELECT seed, 'seed-has-no-reports' AS stopped_reason, 0 AS hop FROM seeds WHERE seed NOT IN (SELECT seed FROM reports)")
def report_skipped_seeds(spark, sf):
    return _sheets(spark, sf)["skipped_seeds"].select("seed", "stopped_reason", "hop")


@query(ITEMS + " SELECT node_id, type, n_reports, state = 'missed' AS ever_in_candidate FROM st WHERE state <> 'covered'")
def report_uncovered_nodes(spark, sf):
    return _sheets(spark, sf)["uncovered_nodes"]


@query(ITEMS + " SELECT node_id, type, n_reports FROM st WHERE state = 'unreachable'")
def report_unreachable_nodes(spark, sf):
    return _sheets(spark, sf)["unreachable_nodes"]


@query(ITEMS + """, m AS (SELECT node_id, seed, cost, row_number() OVER (PARTITION BY node_id ORDER BY cost, seed) AS place FROM items JOIN costs USING (seed) JOIN st USING (node_id) WHERE state = 'missed')
SELECT node_id, any_value(type) AS type, any_value(n_reports) AS n_reports, count(*) AS n_candidates, min(seed) FILTER (place = 1) AS cheapest, CAST(min(cost) AS DOUBLE) AS cheapest_cost, string_agg(seed, '|' ORDER BY place) FILTER (place <= 5) AS top_views FROM m JOIN st USING (node_id) GROUP BY node_id""")
def report_missed_nodes(spark, sf):
    return _sheets(spark, sf, gq._missed(spark, sf))["missed_nodes"]


@query(ITEMS + " SELECT 'universe' AS set, type, count(*) AS n FROM st GROUP BY type UNION ALL SELECT 'covered', type, count(*) FROM st WHERE state = 'covered' GROUP BY type UNION ALL SELECT 'uncovered', type, count(*) FROM st WHERE state <> 'covered' GROUP BY type")
def report_type_counts(spark, sf):
    return rp.type_counts(_sheets(spark, sf))


@query(ITEMS + """, own AS (SELECT * FROM bridge WHERE node_id NOT LIKE 'D%'), added AS (SELECT * FROM bridge ANTI JOIN own USING (node_id, report_id))
SELECT 'universe_nodes' AS key, count(*) AS value FROM st UNION ALL SELECT 'universe_nodes_without_reports', count(*) FROM st WHERE n_reports = 0 UNION ALL SELECT 'backfilled_links', count(*) FROM added
UNION ALL SELECT 'backfilled_nodes', count(DISTINCT node_id) FROM added UNION ALL SELECT 'edge_only_nodes', count(DISTINCT node_id) FROM bridge WHERE node_id NOT IN (SELECT node_id FROM own)""")
def report_meta(spark, sf):
    return _sheets(spark, sf)["meta"]


# comparison of methods

RUNS, STEPS, BUDGET = 30, 50, 2000.0
CONTRAST = gq.ITEMS + f""", orders_ AS (SELECT 'cost' AS method, seed, CAST(cost AS DOUBLE) AS cost, row_number() OVER (ORDER BY cost DESC, seed) AS step FROM costs
UNION ALL SELECT 'random-' || run, seed, CAST(cost AS DOUBLE), row_number() OVER (PARTITION BY run ORDER BY md5(run || ':' || seed), seed) FROM costs, range(1, {RUNS + 1}) r(run)),
chosen AS MATERIALIZED (SELECT * FROM orders_ WHERE step <= {STEPS}),
ne AS (SELECT method, step, count(*) AS e FROM (SELECT method, node_id, min(step) AS step FROM chosen JOIN items USING (seed) GROUP BY ALL) GROUP BY ALL),
nr AS (SELECT method, step, count(*) AS r FROM (SELECT method, report_id, min(step) AS step FROM chosen JOIN reports USING (seed) GROUP BY ALL) GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM node_types WHERE type IN ('PHEN', 'DIAG', 'ISSUE')) AS items, (SELECT count(DISTINCT report_id) FROM bridge) AS reps),
curve AS (SELECT method, step, seed, round(cost, 6) AS cost, round(sum(cost) OVER w, 6) AS cum_cost, round(least(1, sum(cost) OVER w / {BUDGET}), 6) AS rho,
round(sum(coalesce(e, 0)) OVER w / items, 6) AS cov_entity, round(sum(coalesce(r, 0)) OVER w / reps, 6) AS cov_report FROM chosen LEFT JOIN ne USING (method, step) LEFT JOIN nr USING (method, step), n WINDOW w AS (PARTITION BY method ORDER BY step))"""


def _drawn(spark, sf):
    """The dearest views first, and thirty orders by hash."""
    costs = gq._costs(spark, sf).select("seed", "cost")
    runs = costs.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(RUNS))))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.md5(F.concat_ws(":", F.col("run").cast("string"), "seed")), "seed"))
    rows = runs.withColumn("step", place).where(F.col("step") <= STEPS).select(F.concat_ws("-", F.lit("random"), F.col("run").cast("string")).alias("method"), "seed", "cost", "step")
    first = costs.orderBy(F.desc("cost"), "seed").limit(STEPS)
    return rows.unionByName(first.withColumn("step", F.row_number().over(Window.orderBy(F.desc("cost"), "seed"))).select(F.lit("cost").alias("method"), "seed", "cost", "step"))


def _curves(spark, sf, chosen):
    universe = fx.node_types(spark, sf).where(F.col("type").isin(*gq.UNIVERSE)).count()
    return rp.curves(chosen, gq._item_numbers(spark, sf).withColumnRenamed("item", "node_id"), gq._expanded(spark, sf)[0], BUDGET, universe, fx.bridge(spark, sf).select("report_id").distinct().count())


@query(CONTRAST + " SELECT method, CAST(step AS INT) AS step, seed, cost, cum_cost, rho, cov_entity, cov_report FROM curve")
def contrast_curves(spark, sf):
    return fx.built(spark, sf, "contrast", lambda: _curves(spark, sf, _drawn(spark, sf)))


@query(CONTRAST + """ SELECT method, count(*) AS n_views, count(*) FILTER (rho < 1) AS n_within, max(cum_cost) AS cost, coalesce(max(cov_entity) FILTER (rho < 1), 0) AS cov_entity_at_budget, coalesce(max(cov_report) FILTER (rho < 1), 0) AS cov_report_at_budget,
max(cov_entity) AS cov_entity_end, max(cov_report) AS cov_report_end FROM curve GROUP BY method""")
def contrast_at_budget(spark, sf):
    return rp.at_budget(contrast_curves(spark, sf))


@query(CONTRAST + """, b AS (SELECT CAST(step AS INT) AS step, count(*) AS n_runs, round(avg(cov_entity), 4) AS cov_entity_mean, round(stddev_pop(cov_entity), 4) AS cov_entity_std, round(avg(cov_report), 4) AS cov_report_mean, round(stddev_pop(cov_report), 4) AS cov_report_std
FROM curve WHERE method LIKE 'random-%' GROUP BY step) SELECT *, max(cov_entity_mean) OVER (ORDER BY step) AS envelope FROM b""")
def contrast_random_runs(spark, sf):
    return rp.repeated(contrast_curves(spark, sf), "random")


@query()
def contrast_covers(spark, sf):
    """The greedy methods beside those orders, at the same budget."""
    covers = {"greedy": {}, "annealed": {"gain_power": 1.2, "cost_power": (1.8, 1.0), "fixed": 1.0}, "budget": {"budget": aq.BUDGET}, "gain_only": {"budget": aq.BUDGET, "unit_cost": True}}
    rows = None
    for name, how in covers.items():
        own = aq._cover(spark, sf, name, **how).select(F.lit(name).alias("method"), "seed", "cost", "step")
        rows = own if rows is None else rows.unionByName(own)
    return rp.at_budget(_curves(spark, sf, rows))
