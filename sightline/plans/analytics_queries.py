"""Selection, curves, structure metrics, unification and statistics: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import components as cc
from sightline.operators import compress as cm
from sightline.operators import cover as co
from sightline.operators import curves as cv
from sightline.operators import graph as g
from sightline.operators import merge as me
from sightline.operators import metrics as mt
from sightline.operators import nullmodel as nm
from sightline.operators import select as se
from sightline.operators import unify as un
from sightline.operators import views as vw
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


K = 50


def _greedy_sql(steps: int) -> str:
    """The greedy cover of every view, step by step: what is left of the items, the best view, what it leaves."""
    out = gq.ITEMS + """, sid AS MATERIALIZED (SELECT seed, cost, row_number() OVER (ORDER BY seed) AS s FROM costs), nid AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY node_id) AS n FROM (SELECT DISTINCT node_id FROM items)),
        l1 AS MATERIALIZED (SELECT s, n FROM items JOIN sid USING (seed) JOIN nid USING (node_id))"""
    for k in range(1, steps + 1):
        out += f""", s{k} AS MATERIALIZED (SELECT {k} AS step, s, seed, gain, CAST(cost AS DOUBLE) AS cost FROM (SELECT s, count(*) AS gain FROM l{k} GROUP BY s) JOIN sid USING (s)
        ORDER BY round(gain / greatest(CAST(cost AS DOUBLE), 1e-9), 9) DESC, gain DESC, seed LIMIT 1),
        l{k + 1} AS MATERIALIZED (SELECT s, n FROM l{k} ANTI JOIN (SELECT n FROM l{k} WHERE s = (SELECT s FROM s{k})) USING (n))"""
    return out + ", picked AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT step, seed, gain, cost FROM s{i}" for i in range(1, steps + 1)) + ")"


#: The first steps by joins alone.
FEW_STEPS = 4
PICKED = _greedy_sql(K)


def _cover(spark, sf, name, **how):
    """A cover over every part as a seed, to its real end: full coverage, the budget or K."""
    kinds = [F.col("items").alias("entities"), *(["reports"] if how.get("objective") in ("hybrid", "report") else [])]
    return fx.built(spark, sf, f"cover_{name}", lambda: co.cover_views(gq._view_rows(spark, sf).select("seed", "cost", *kinds), most=K, **how))


def _picked(spark, sf):
    steps = _cover(spark, sf, "greedy").select("step", "seed", F.col("gain").cast("long").alias("gain"), "score", "cost")
    return steps.select(F.lit("all").alias("problem"), "*")


@query(PICKED + " SELECT step, seed, gain, round(cost, 6) AS cost FROM picked")
def cover_greedy(spark, sf):
    return _picked(spark, sf).select("step", "seed", "gain", F.round("cost", 6).alias("cost"))


@query(_greedy_sql(FEW_STEPS) + " SELECT step, seed, gain, round(cost, 6) AS cost FROM picked")
def cover_greedy_joins(spark, sf):
    return se.exact_greedy_sql_steps(gq._item_numbers(spark, sf).withColumnRenamed("item", "node_id"), gq._costs(spark, sf), FEW_STEPS).select("step", "seed", "gain", F.round("cost", 6).alias("cost"))


@query()
def cover_annealed(spark, sf):
    return co.trace(_cover(spark, sf, "annealed", gain_power=1.2, cost_power=(1.8, 1.0), fixed=1.0))


@query()
def cover_hybrid(spark, sf):
    """Entities and reports count, the exponent of the cost falls, and a shadow list goes on beyond the budget."""
    return co.trace(_cover(spark, sf, "hybrid", objective="hybrid", budget=BUDGET, shadow=True, cost_power=(1.8, 1.0)))


@query()
def cover_budget(spark, sf):
    return co.trace(_cover(spark, sf, "budget", budget=BUDGET))


@query()
def cover_gain_only(spark, sf):
    return co.trace(_cover(spark, sf, "gain_only", budget=BUDGET, unit_cost=True))


BUDGET = 1000.0


@query(gq.COSTS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS MATERIALIZED (SELECT seed, CAST(cost AS DOUBLE) AS cost, row_number() OVER (ORDER BY cost DESC, seed) AS place FROM costs),
walk AS (SELECT CAST(0 AS BIGINT) AS place, CAST(0 AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS seed, CAST(0 AS DOUBLE) AS cost, false AS taken
UNION ALL SELECT o.place, CASE WHEN total + o.cost <= {BUDGET} + 1e-9 THEN total + o.cost ELSE total END, o.seed, o.cost, total + o.cost <= {BUDGET} + 1e-9 FROM walk JOIN o ON o.place = walk.place + 1)
SELECT seed, cost, round(total, 6) AS cum_cost FROM walk WHERE taken""")
def feasible_prefix(spark, sf):
    from pyspark.sql import Window

    ordered = gq._costs(spark, sf).withColumn("place", F.row_number().over(Window.orderBy(F.desc("cost"), "seed")))
    return se.feasible_prefix(ordered, BUDGET)


@query()
def random_k_views(spark, sf):
    return se.hashed_order(gq._costs(spark, sf), 7).where("place <= 10").select("place", "seed", "cost")


@query(gq.COSTS + ", n AS (SELECT count(DISTINCT report_id) AS n FROM bridge) SELECT seed, n_reports, CAST(cost AS DOUBLE) AS cost FROM costs, n WHERE n_reports <= floor(0.002 * n)")
def capped_views(spark, sf):
    n = fx.bridge(spark, sf).select("report_id").distinct().count()
    return se.capped(gq._costs(spark, sf), n, 0.002).select("seed", "n_reports", "cost")


#: How much the chosen views overlap.
JACCARD = PICKED + """, own AS (SELECT seed, node_id FROM items JOIN picked USING (seed)), n AS (SELECT seed, count(*) AS n FROM own GROUP BY seed),
s AS (SELECT a.seed AS a, b.seed AS b, count(*) AS shared FROM own a JOIN own b USING (node_id) WHERE a.seed < b.seed GROUP BY 1, 2),
j AS (SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON x.seed = a JOIN n y ON y.seed = b)"""


def _chosen_items(spark, sf):
    picked = F.broadcast(_picked(spark, sf).select("seed"))
    return gq._view_items(spark, sf).join(picked, "seed", "left_semi").select("seed", F.explode("items").alias("node_id"))


@query(JACCARD + """, c AS (SELECT count(*) AS n_views FROM n), t AS (SELECT coalesce(sum(jaccard), 0) AS total, coalesce(max(jaccard), 0) AS top, count(*) AS k FROM j)
SELECT n_views, k AS n_overlapping, round(total / greatest(n_views * (n_views - 1) / 2, 1), 6) AS jaccard_avg, round(top, 6) AS jaccard_max, round(total / greatest(k, 1), 6) AS jaccard_avg_nonzero,
round(k / greatest(n_views * (n_views - 1) / 2, 1), 6) AS frac_overlapping, round(k / greatest(n_views * (n_views - 1) / 2, 1) * (n_views - 1), 6) AS overlap_degree FROM c, t""")
def redundancy(spark, sf):
    return vw.overlap_stats(_chosen_items(spark, sf))


@query(JACCARD + " SELECT a, b, shared, jaccard FROM j ORDER BY jaccard DESC, a, b LIMIT 20")
def top_overlap_pairs(spark, sf):
    return vw.jaccard_pairs(_chosen_items(spark, sf)).orderBy(F.desc("jaccard"), "a", "b").limit(20)


CURVE = PICKED + f""", f AS (SELECT node_id, min(step) AS k FROM picked JOIN items USING (seed) GROUP BY node_id), u AS (SELECT count(*) AS n FROM node_types WHERE type IN ('PHEN', 'DIAG', 'ISSUE')),
curve AS (SELECT k, count(node_id) AS covered, round(count(node_id) / max(n), 6) AS coverage FROM (SELECT unnest(range(1, {K} + 1)) AS k) g CROSS JOIN u LEFT JOIN (SELECT node_id, k AS first FROM f) ON first <= k GROUP BY k)"""


def _curve(spark, sf):
    universe = fx.node_types(spark, sf).where("type IN ('PHEN', 'DIAG', 'ISSUE')").agg(F.count("*").alias("n"))
    return cv.coverage(_picked(spark, sf), gq._item_numbers(spark, sf).withColumnRenamed("item", "node_id"), universe, K)


@query(CURVE + " SELECT 'all' AS problem, k, covered, coverage FROM curve")
def curve_count(spark, sf):
    return _curve(spark, sf)


@query(CURVE + " SELECT 'all' AS problem, round(avg(coverage), 6) AS nauc, max(coverage) FILTER (k = 5) AS cov_at_5, max(coverage) FILTER (k = 10) AS cov_at_10 FROM curve")
def curve_auc(spark, sf):
    return cv.auc(_curve(spark, sf))


COSTCURVE = PICKED + f""", universe AS (SELECT greatest(count(*), 1) AS n FROM node_types WHERE type IN ('PHEN', 'DIAG', 'ISSUE')), cc AS (SELECT step, round(sum(cost) OVER w, 6) AS cum_cost, round(least(1, sum(cost) OVER w / 300), 6) AS rho, round(sum(gain) OVER w / (SELECT n FROM universe), 6) AS coverage FROM picked WINDOW w AS (ORDER BY step))"""


def _cost_curve(spark, sf):
    """The cost curve over the universe of the tables read."""
    universe = fx.node_types(spark, sf).where("type IN ('PHEN', 'DIAG', 'ISSUE')").count()
    return cv.cost_curve(_picked(spark, sf), 300.0, F.lit(max(universe, 1)))


@query(COSTCURVE + " SELECT 'all' AS problem, step, cum_cost, rho, coverage FROM cc")
def curve_cost(spark, sf):
    return _cost_curve(spark, sf)


@query(COSTCURVE + """, x AS (SELECT *, coalesce(lead(rho) OVER (ORDER BY step), 1) AS nxt FROM cc) SELECT 'all' AS problem, round(sum(coverage * (nxt - rho)), 6) AS nauc_budget,
coalesce(max(coverage) FILTER (rho <= 0.25), 0) AS cov_at_25, coalesce(max(coverage) FILTER (rho <= 0.5), 0) AS cov_at_50, coalesce(max(coverage) FILTER (rho <= 0.75), 0) AS cov_at_75 FROM x""")
def curve_cost_auc(spark, sf):
    return cv.cost_auc(_cost_curve(spark, sf))


@query(COSTCURVE + " SELECT 'all' AS problem, coalesce(min(step) FILTER (rho >= 1), min(step) FILTER (cum_cost >= 300), max(step)) AS end_step FROM cc")
def curve_budget_end(spark, sf):
    return cv.budget_end(_cost_curve(spark, sf), 300.0)


@query()
def curve_interpolated(spark, sf):
    return cv.on_grid(_cost_curve(spark, sf), 11)


@query(COSTCURVE + " SELECT 'all' AS problem, rho, max(coverage) AS coverage FROM cc GROUP BY rho")
def curve_plateau(spark, sf):
    return cv.plateau(_cost_curve(spark, sf))


@query(COSTCURVE + " SELECT 'all' AS problem, step, metric, value FROM (UNPIVOT (SELECT step, rho, coverage FROM cc) ON rho, coverage INTO NAME metric VALUE value)")
def curve_long(spark, sf):
    return cv.long_form(_cost_curve(spark, sf).select("problem", "step", "rho", "coverage"), ["problem", "step"], ["rho", "coverage"])


@query(gq.COSTS + """, s AS (SELECT CAST(cost AS DOUBLE) AS cost, CAST(cost AS DOUBLE) / sum(CAST(cost AS DOUBLE)) OVER () AS share FROM costs) SELECT 'all' AS problem, count(*) AS n_sel, round(sum(cost), 6) AS total_cost,
round(avg(cost), 6) AS avg_cost, round(max(share), 6) AS top1_share, round(sum(share * share), 6) AS hhi, round(quantile_cont(cost, 0.5), 6) AS median_cost,
round(quantile_cont(cost, 0.75) - quantile_cont(cost, 0.25), 6) AS iqr_cost, round(quantile_cont(cost, 0.95), 6) AS p95_cost FROM s""")
def portfolio(spark, sf):
    return cv.portfolio(gq._costs(spark, sf).withColumn("problem", F.lit("all")))


RUNS = "runs AS (SELECT l_linenumber AS k, l_suppkey % 5 AS run, count(DISTINCT l_partkey) / (SELECT greatest(count(*), 1) FROM part) AS coverage FROM lineitem GROUP BY ALL)"


def _runs(spark, sf):
    """Coverage over the parts of the tables read."""
    li, parts = fx.table(spark, sf, "lineitem"), max(fx.table(spark, sf, "part").count(), 1)
    return li.groupBy(F.col("l_linenumber").alias("k"), (F.col("l_suppkey") % 5).alias("run")).agg((F.countDistinct("l_partkey") / parts).alias("coverage"))


@query(f"WITH {RUNS}, b AS (SELECT k, round(avg(coverage), 6) AS mean, round(stddev_pop(coverage), 6) AS std FROM runs GROUP BY k) SELECT *, max(mean) OVER (ORDER BY k) AS envelope FROM b")
def run_bands(spark, sf):
    return cv.run_bands(_runs(spark, sf))


@query(f"""WITH {RUNS}, m AS (SELECT 'm' || (k % 3) AS method, run AS app, avg(coverage) AS v FROM runs GROUP BY ALL),
q AS (SELECT method, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, count(*) AS n_apps FROM m GROUP BY method)
SELECT *, round((median - (SELECT median FROM q WHERE method = 'm0')) * 100, 4) AS delta_pp FROM q""")
def across_apps(spark, sf):
    return _across(_runs(spark, sf))


def _across(runs):
    rows = runs.groupBy(F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("method"), F.col("run").alias("app")).agg(F.avg("coverage").alias("v"))
    return cv.across(rows, "method", "v", "m0")


@query()
def merge_signature(spark, sf):
    return _merged(spark, sf, me.Rules(threshold=0.2, max_nodes=4000))


@query()
def merge_report(spark, sf):
    return _merged(spark, sf, me.Rules(mode="report", threshold=0.05, max_nodes=4000))


@query()
def merge_ungated(spark, sf):
    return _merged(spark, sf, me.Rules(gated=False, empty_both=0.0))


def _merged(spark, sf, rules):
    return me.merged(_views(spark, sf), fx.edge_rows(spark, sf).select("report_id"), rules=rules)


@query()
def merge_compress(spark, sf):
    """Every part's view, united with those alike, its nodes and edges those of the united reports."""
    reports, nodes = gq._expanded(spark, sf)[0], gq._nodes(spark, sf)
    groups = cm.compressed_groups(nodes.join(fx.node_types(spark, sf), "node_id"), reports, threshold=0.35, symptoms=0.35, max_reports=2000)
    return cm.reinduced(groups, reports.select("seed", "report_id"), fx.bridge(spark, sf), fx.edge_rows(spark, sf).select("report_id"), 4000)


def _views(spark, sf):
    """Every part's view with its reports and nodes. A problem is a component of views that share a node: no view lacks
    issues or symptoms, and the likeness of empty operations weighs less than any threshold here."""

    def make():
        reports, nodes = gq._expanded(spark, sf)[0], gq._nodes(spark, sf)
        typed = nodes.join(fx.node_types(spark, sf), "node_id")
        r = reports.groupBy("seed").agg(F.collect_set("report_id").alias("report_ids"))
        n = typed.groupBy("seed").agg(F.collect_list(F.struct("node_id", "type")).alias("nodes"))
        return r.join(n, "seed").join(cm.problems(typed.where("type IN ('ISSUE', 'PHEN', 'DIAG', 'OP')").select("seed", "node_id")), "seed").select("problem", "seed", "report_ids", "nodes")

    return fx.built(spark, sf, "views", make)


# structure

#: Labels fall to the least of a node and its neighbours, more often than the graph is wide.
ROUNDS = 14
SPARSE = gq.FACTS + """, sp AS MATERIALIZED (SELECT DISTINCT issue AS a, elem AS b FROM facts), lk AS MATERIALIZED (SELECT a AS x, b AS y FROM sp UNION SELECT b, a FROM sp),
l0 AS (SELECT DISTINCT x AS node, x AS root FROM lk)""" + "".join(f""",
l{k} AS MATERIALIZED (SELECT node, min(root) AS root FROM (SELECT node, root FROM l{k - 1} UNION ALL SELECT y, root FROM l{k - 1} JOIN lk ON node = x) GROUP BY node)""" for k in range(1, ROUNDS + 1))


def _sparse(spark, sf):
    links = fx.facts(spark, sf, "l_partkey").select("partkey", F.col("issue").alias("a"), F.col("elem").alias("b"))
    return cc.two_sided(links, "partkey")


@query(SPARSE + f" SELECT node, root AS component FROM l{ROUNDS}")
def components(spark, sf):
    return _sparse(spark, sf)


@query(SPARSE + f", c AS (SELECT node, root AS component FROM l{ROUNDS})" + """, z AS (SELECT component, count(*) AS n FROM c GROUP BY component)
SELECT CAST(sum(n) AS BIGINT) AS n_nodes, count(*) AS n_components, max(n) AS lcc_size, round(max(n) / sum(n), 6) AS lcc_ratio FROM z""")
def lcc(spark, sf):
    return cc.largest(_sparse(spark, sf))


@query(gq.FACTS + """, e AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edge_rows WHERE relation IN ('concerns', 'accompanied_by')), half AS (SELECT DISTINCT name AS node_id, report_id FROM mentions WHERE type <> 'MOD'),
n AS (SELECT node_id, count(*) AS n FROM half GROUP BY node_id), s AS (SELECT a, b, count(*) AS shared FROM e JOIN half x ON x.node_id = a JOIN half y ON y.node_id = b AND x.report_id = y.report_id GROUP BY a, b),
r AS (SELECT coalesce(shared, 0) AS shared, na.n AS na, nb.n AS nb FROM e LEFT JOIN s USING (a, b) LEFT JOIN n na ON na.node_id = a LEFT JOIN n nb ON nb.node_id = b)
SELECT count(*) AS n_edges, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS n_eligible, round(avg(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN CAST(shared = 0 AS INT) END), 6) AS cer,
round(avg(1 - shared / (na + nb - shared)), 6) AS cer_j, round(count(*) FILTER (shared = 0 AND na IS NOT NULL AND nb IS NOT NULL) / count(*), 6) AS cer_all FROM r""")
def graph_metrics(spark, sf):
    edges = fx.edge_rows(spark, sf).where("relation IN ('concerns', 'accompanied_by') AND source <> target")
    half = fx.mentions(spark, sf).where("type <> 'MOD'").select(F.col("name").alias("node_id"), "type", "report_id").distinct()
    kinds = tuple((fx.ENDS[a], fx.ENDS[b]) for a, r, b in fx.EDGES if r in ("concerns", "accompanied_by"))
    return mt.cross_report(edges.select("report_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")), half, kinds)


@query()
def random_contract(spark, sf):
    """One contraction with given cluster sizes, brought to nine tenths and six fifths as many."""
    nodes = fx.node_types(spark, sf)
    counts, sizes = {r["type"]: r["count"] for r in nodes.groupBy("type").count().collect()}, {}
    for kind, width, share in (("ELEM", 5, 0.9), ("ISSUE", 4, 1.2)):
        whole, rest = divmod(counts.get(kind, 0), width)
        own = {width: whole} | ({rest: 1} if rest else {})
        sizes[kind] = nm.resized(own, round(share * sum(own.values())))
    return nm.contracted(nodes, sizes, 1).groupBy("type", "group").agg(F.count("*").alias("n"))


#: Runs of the null model, and its groups: sizes of five and four, brought to nine tenths and six fifths as many.
RUNS_DRAWN = 30
NULL = gq.FACTS + """, e AS MATERIALIZED (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edge_rows WHERE relation = 'concerns'), kinds AS (SELECT type, count(*) AS n FROM node_types WHERE type IN ('ELEM', 'ISSUE') GROUP BY type),
cut AS (SELECT type, n, greatest(1, n // (CASE type WHEN 'ELEM' THEN 5 ELSE 4 END)) AS k FROM kinds),
drawn AS (SELECT run, node_id, type, row_number() OVER (PARTITION BY run, type ORDER BY md5(run || ':' || node_id), node_id) - 1 AS place FROM node_types, range(1, 31) r(run) WHERE type IN ('ELEM', 'ISSUE')),
gr AS MATERIALIZED (SELECT run, node_id, type || '#' || (CASE WHEN place < (k - n % k) * (n // k) THEN place // (n // k) ELSE (k - n % k) + (place - (k - n % k) * (n // k)) // (n // k + 1) END) AS g FROM drawn JOIN cut USING (type)),
ce AS MATERIALIZED (SELECT DISTINCT x.run, least(x.g, y.g) AS a, greatest(x.g, y.g) AS b FROM e JOIN gr x ON x.node_id = a JOIN gr y ON y.node_id = b AND y.run = x.run WHERE x.g <> y.g),
held AS MATERIALIZED (SELECT DISTINCT run, g, report_id FROM gr JOIN bridge USING (node_id)),
j AS (SELECT run, count(*) AS joined FROM (SELECT DISTINCT ce.run, a, b FROM ce JOIN held x ON x.run = ce.run AND x.g = a JOIN held y ON y.run = ce.run AND y.g = b AND y.report_id = x.report_id) GROUP BY run),
runs AS (SELECT n.run, n.n_nodes, m.n_edges, round(1 - coalesce(joined, 0) / m.n_edges, 6) AS cer FROM (SELECT run, count(DISTINCT g) AS n_nodes FROM gr GROUP BY run) n JOIN (SELECT run, count(*) AS n_edges FROM ce GROUP BY run) m USING (run) LEFT JOIN j USING (run))"""


def _null(spark, sf):
    """Groups of every run, and the links that they contract."""
    kinds = fx.node_types(spark, sf).where("type IN ('ELEM', 'ISSUE')")
    counts = {r["type"]: r["count"] for r in kinds.groupBy("type").count().collect()}
    sizes = {t: nm.equal_sizes(n, n // (5 if t == "ELEM" else 4)) for t, n in counts.items()}
    groups = fx.built(spark, sf, "null_groups", lambda: nm.contracted(kinds, sizes, RUNS_DRAWN))
    return groups, g.simple_graph(fx.edge_rows(spark, sf).where("relation = 'concerns'")).select("a", "b")


def _null_runs(spark, sf):
    return fx.built(spark, sf, "null_runs", lambda: nm.run_metrics(*_null(spark, sf), fx.bridge(spark, sf)))


@query(NULL + " SELECT CAST(run AS INT) AS run, n_nodes, n_edges, cer FROM runs")
def null_metrics(spark, sf):
    return _null_runs(spark, sf)


@query(NULL + """, l AS (UNPIVOT (SELECT run, CAST(n_nodes AS DOUBLE) AS n_nodes, CAST(n_edges AS DOUBLE) AS n_edges, CAST(cer AS DOUBLE) AS cer FROM runs) ON n_nodes, n_edges, cer INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.025), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q500, round(quantile_cont(value, 0.975), 6) AS q975 FROM l GROUP BY metric""")
def null_quantiles(spark, sf):
    return nm.null_quantiles(_null_runs(spark, sf), ["n_nodes", "n_edges", "cer"])


@query()
def null_components(spark, sf):
    return nm.run_components(*_null(spark, sf))


# unification

PAIRS = f"""{fx.NAMES_SQL}, gr AS (SELECT DISTINCT type, entity, substr(entity, CAST(i AS INT), 2) AS gram FROM names, range(1, greatest(2, length(entity))) r(i)), sz AS (SELECT type, entity, count(*) AS n FROM gr GROUP BY ALL),
sh AS (SELECT x.type, x.entity AS a, y.entity AS b, count(*) AS shared FROM gr x JOIN gr y USING (type, gram) WHERE x.entity < y.entity GROUP BY ALL),
pairs AS (SELECT sh.type, a, b, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM sh JOIN sz p ON p.type = sh.type AND p.entity = a JOIN sz q ON q.type = sh.type AND q.entity = b WHERE shared / (p.n + q.n - shared) >= 0.6)"""


def _pairs(spark, sf):
    return un.ngram_pairs(fx.names(spark, sf), 2, 0.6)


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def ngram_pairs(spark, sf):
    return _pairs(spark, sf)


CLOSED = f"WITH RECURSIVE {PAIRS}, lk AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT entity AS root, entity AS node FROM names UNION SELECT r.root, l.y FROM reach r JOIN lk l ON r.node = l.x), cl AS (SELECT node AS entity, min(root) AS cluster FROM reach GROUP BY node)"


def _closed(spark, sf):
    return un.closure(fx.names(spark, sf), _pairs(spark, sf))


@query(CLOSED + " SELECT entity, cluster FROM cl")
def unify_closure(spark, sf):
    return _closed(spark, sf)


@query(CLOSED + """, z AS (SELECT cluster, count(*) AS n FROM cl GROUP BY cluster) SELECT CAST(sum(n) AS BIGINT) AS n_entities, count(*) AS n_clusters, round(1 - count(*) / sum(n), 6) AS reduction, round(avg(n), 6) AS avg_size, max(n) AS max_size, round(avg(CAST(n = 1 AS INT)), 6) AS singleton_ratio FROM z""")
def unify_stats(spark, sf):
    return un.cluster_stats(_closed(spark, sf))


@query(CLOSED + """, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY entity) AS i FROM cl) SELECT cluster, count(*) AS n, string_agg(entity, '|' ORDER BY entity) FILTER (i <= 10) AS examples FROM r GROUP BY cluster ORDER BY n DESC, cluster LIMIT 20""")
def unify_top_clusters(spark, sf):
    return un.top_clusters(_closed(spark, sf))


@query(f"WITH {fx.NAMES_SQL}, k AS (SELECT DISTINCT entity AS bucket_id, unnest(string_split(entity, ' ')) AS keyword FROM names) SELECT keyword, count(*) AS n, string_agg(bucket_id, '|' ORDER BY bucket_id) AS bucket_ids FROM k GROUP BY keyword HAVING count(*) > 1")
def keyword_groups(spark, sf):
    return un.keyword_groups(fx.names(spark, sf).select(F.col("entity").alias("bucket_id"), F.explode(F.split("entity", " ")).alias("keyword")))


@query(f"WITH {fx.NAMES_SQL} SELECT type, substr(entity, 1, 2) AS block, entity, CAST(floor((row_number() OVER (PARTITION BY type, substr(entity, 1, 2) ORDER BY entity) - 1) / 5) AS BIGINT) AS chunk FROM names")
def prefix_chunks(spark, sf):
    return un.prefix_chunks(fx.names(spark, sf), 2, 5)


@query()
def leader_clusters(spark, sf):
    return un.leader_clusters(fx.names(spark, sf))


# statistics

REGION = """vals AS (SELECT r_name AS app, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS variant, CAST(o_orderkey AS VARCHAR) AS query_id, o_totalprice / 1000 AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), app_vals AS (SELECT app, variant, round(avg(value), 4) AS value FROM vals GROUP BY ALL)"""


def _vals(spark, sf):
    o, c, n, r = (fx.table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    variant = F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")
    return rows.select(F.col("r_name").alias("app"), variant.alias("variant"), F.col("o_orderkey").cast("string").alias("query_id"), (F.col("o_totalprice") / 1000).alias("value"))


def _app_vals(spark, sf):
    return _vals(spark, sf).groupBy("app", "variant").agg(F.round(F.avg("value"), 4).alias("value"))


DIFFS = f"WITH RECURSIVE {REGION}, d AS (SELECT app, round(b.value - a.value, 9) AS d FROM (SELECT * FROM app_vals WHERE variant = 'a') a JOIN (SELECT * FROM app_vals WHERE variant = 'b') b USING (app))"


def _diffs(spark, sf):
    return mt.paired(_app_vals(spark, sf), ["app"], "variant", "value", "a", "b")


@query(DIFFS + """, r AS (SELECT sign(d) AS sg, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS rk, row_number() OVER (ORDER BY abs(d), app) - 1 AS i FROM d WHERE d <> 0),
k AS (SELECT count(*) AS n, sum(rk) AS total, least(coalesce(sum(rk) FILTER (sg > 0), 0), sum(rk) - coalesce(sum(rk) FILTER (sg > 0), 0)) AS w FROM r),
s AS (SELECT m, coalesce(sum(rk) FILTER ((m >> i) & 1 = 1), 0) AS plus FROM r, (SELECT unnest(range(0, 1 << (SELECT count(*) FROM r)::INT)) AS m) GROUP BY m)
SELECT n, CAST(w AS DOUBLE) AS w, round(avg(CAST(least(plus, total - plus) <= w + 1e-9 AS INT)), 6) AS p FROM s, k GROUP BY n, w""")
def wilcoxon_exact(spark, sf):
    return mt.wilcoxon(_diffs(spark, sf))


@query(f"WITH {REGION}" + " SELECT app, round(a.value, 6) AS before, round(b.value, 6) AS after, round(b.value - a.value, 6) AS delta, format('{:+.4f}', round(b.value - a.value, 9)) AS delta_text FROM (SELECT * FROM app_vals WHERE variant = 'a') a JOIN (SELECT * FROM app_vals WHERE variant = 'b') b USING (app)")
def inflation_table(spark, sf):
    return mt.inflation(_app_vals(spark, sf), "a", "b")


@query(f"WITH {REGION} SELECT variant, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std_sample, round(stddev_pop(value), 6) AS std_population FROM app_vals GROUP BY variant")
def mean_std_apps(spark, sf):
    return mt.spread(_app_vals(spark, sf), ["variant"], "value")


@query(DIFFS + " SELECT app, a.value AS a, b.value AS b, d FROM d JOIN (SELECT app, value FROM app_vals WHERE variant = 'a') a USING (app) JOIN (SELECT app, value FROM app_vals WHERE variant = 'b') b USING (app)")
def paired_delta(spark, sf):
    return _diffs(spark, sf)


@query()
def paired_t_test(spark, sf):
    return mt.t_test(_diffs(spark, sf))


@query()
def bootstrap_apps(spark, sf):
    rows = fx.vectors(spark, sf).select(F.col("cluster_id").alias("app"), F.col("id").alias("query_id"), F.lit("a").alias("method"), F.get("vector", F.lit(0)).alias("value"))
    other = fx.vectors(spark, sf).select(F.col("cluster_id").alias("app"), F.col("id").alias("query_id"), F.lit("b").alias("method"), F.get("vector", F.lit(1)).alias("value"))
    return mt.bootstrap(rows.unionByName(other), 200, 3, "a", "b")
