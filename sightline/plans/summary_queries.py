"""Summary tables over the benchmark tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import summary as sm
from sightline.plans import fixtures as fx
from sightline.plans import graph_queries as gq

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""SELECT s_suppkey AS id, s_name AS name, n_parts, qty FROM supplier JOIN (SELECT s_suppkey, count(DISTINCT l_partkey) AS n_parts, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS qty
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey) USING (s_suppkey)""")
def j_one_to_one(spark, sf):
    supplier, li = fx.table(spark, sf, "supplier"), fx.table(spark, sf, "lineitem")
    right = supplier.join(li, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy(F.col("s_suppkey").alias("id")).agg(
        F.countDistinct("l_partkey").alias("n_parts"), F.coalesce(F.sum("l_quantity"), F.lit(0)).cast("double").alias("qty")
    )
    return sm.one_to_one(supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), right, ["id"])


@query(gq.FACTS + ", ok AS (SELECT CAST(o_orderkey AS VARCHAR) AS report_id FROM orders WHERE o_orderstatus = 'F') SELECT node_id, count(*) AS n_reports FROM bridge SEMI JOIN ok USING (report_id) GROUP BY node_id")
def scope_nodes(spark, sf):
    allowed = fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("report_id"))
    return sm.in_scope(fx.bridge(spark, sf), allowed).groupBy("node_id").agg(F.count("*").alias("n_reports"))


_METHODS = "SELECT o_orderpriority AS method, o_orderstatus AS app, CAST(o_totalprice AS DOUBLE) AS v, o_orderkey AS id FROM orders"


def _methods(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("app"), F.col("o_totalprice").cast("double").alias("v"), F.col("o_orderkey").alias("id")
    )


@query(f"WITH m AS ({_METHODS}) SELECT method, count(*) AS n FROM m WHERE method IN ('1-URGENT', '2-HIGH', '5-LOW') AND method <> '5-LOW' GROUP BY method")
def methods_chosen(spark, sf):
    return sm.chosen_methods(_methods(spark, sf), ("1-URGENT", "2-HIGH", "5-LOW"), ("5-LOW",)).groupBy("method").agg(F.count("*").alias("n"))


@query(gq.FACTS + """, raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS report_id FROM orders), uni AS (SELECT DISTINCT report_id FROM mentions), j AS (SELECT r.report_id AS a, u.report_id AS b FROM raw r FULL JOIN uni u USING (report_id))
SELECT count(a) AS n_raw, count(b) AS n_unified, count(*) FILTER (b IS NULL) AS only_raw, count(*) FILTER (a IS NULL) AS only_unified, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS equal FROM j""")
def report_universes(spark, sf):
    raw = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("report_id"))
    return sm.universes(raw, fx.mentions(spark, sf).select("report_id"))


@query(gq.FACTS + ", c AS (SELECT DISTINCT source AS node_id FROM edge_rows WHERE line = 1) SELECT node_id, n_reports, node_id IN (SELECT node_id FROM c) AS ever_in_candidate FROM (SELECT node_id, count(*) AS n_reports FROM bridge GROUP BY node_id)")
def uncovered_nodes(spark, sf):
    first = fx.edge_rows(spark, sf).where("line = 1").select(F.col("source").alias("node_id"), F.lit(True).alias("there")).distinct()
    n = fx.bridge(spark, sf).groupBy("node_id").agg(F.count("*").alias("n_reports"))
    return sm.uncovered(n.join(first, "node_id", "left").select("node_id", "n_reports", F.coalesce("there", F.lit(False)).alias("ever_in_candidate")))


@query(f"WITH m AS ({_METHODS}) SELECT method, count(*) AS n_runs, printf('%.4f±%.4f', round(avg(v), 6), round(stddev_pop(v), 6)) AS v FROM m GROUP BY method")
def run_summary(spark, sf):
    return sm.run_summary(_methods(spark, sf), ["method"], ["v"])


@query(f"WITH m AS ({_METHODS}), r AS (SELECT *, row_number() OVER (PARTITION BY app, method ORDER BY md5('7:' || id), id) AS place FROM m) SELECT app, method, id FROM r WHERE place <= 20")
def balanced_sample(spark, sf):
    return sm.balanced_sample(_methods(spark, sf), ["app", "method"], "id", 20, 7).select("app", "method", "id")


_CURVES = """c AS (SELECT l_suppkey % 5 AS app, l_returnflag AS method, l_linenumber AS step, count(DISTINCT l_partkey) / (SELECT count(*) FROM part) AS coverage FROM lineitem GROUP BY ALL),
k AS (SELECT app, method, round(step / 7, 6) AS rho, coverage FROM c)"""


@query(f"""WITH {_CURVES}, r AS (SELECT app, method, share, coalesce(max(coverage) FILTER (rho <= share), 0) AS v FROM k CROSS JOIN (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS share) GROUP BY ALL)
SELECT method, share, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, count(*) AS n_apps FROM r GROUP BY method, share""")
def budget_snapshots(spark, sf):
    parts = max(fx.table(spark, sf, "part").count(), 1)
    curves = fx.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("app"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("step")).agg((F.countDistinct("l_partkey") / parts).alias("coverage"))
    return sm.snapshots(curves.select("app", "method", F.round(F.col("step") / 7, 6).alias("rho"), "coverage"))


@query(f"""WITH m AS ({_METHODS}), t AS (SELECT method, app, count(*) * 2 AS n FROM m WHERE method <> '5-LOW' GROUP BY ALL), w AS (SELECT method, app, count(*) AS n FROM m WHERE method NOT IN (SELECT method FROM t) GROUP BY ALL),
u AS (SELECT * FROM t UNION ALL SELECT * FROM w) SELECT method, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, round(avg(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_apps FROM u GROUP BY method""")
def selected_counts(spark, sf):
    views = _methods(spark, sf).select("method", "app")
    table = views.where("method <> '5-LOW'").groupBy("method", "app").agg((F.count("*") * 2).alias("n_sel"))
    return sm.selected_counts(table, views)


@query("""WITH n AS (SELECT l_suppkey % 5 AS app, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY app) SELECT app, share, n, CAST(round(share * n * (n - 1) / 2) AS BIGINT) AS n_positive
FROM n CROSS JOIN (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS share)""")
def positive_pair_counts(spark, sf):
    n = fx.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("app")).agg(F.countDistinct("l_partkey").alias("n"))
    swept = n.select("app", "n", F.explode(F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75)))).alias("share"))
    return swept.select("app", "share", "n", sm.positive_pairs(F.col("n"), F.col("share")).alias("n_positive"))


_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


@query(f"""WITH m AS ({_METHODS}), a AS (SELECT app AS boundary, method, round(avg(v), 6) AS v, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY ALL)
SELECT x.boundary, x.method, list_position({_ORDER}, x.method) AS place, round(x.v - b.v, 6) AS delta_v, round(x.n - b.n, 6) AS delta_n FROM a x JOIN a b ON b.boundary = x.boundary AND b.method = '4-NOT SPECIFIED' WHERE x.method IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')""")
def gain_over_baseline(spark, sf):
    rows = _methods(spark, sf).groupBy(F.col("app").alias("boundary"), "method").agg(F.round(F.avg("v"), 6).alias("v"), F.count("*").cast("double").alias("n"))
    out = sm.gains(rows, "4-NOT SPECIFIED", _ORDER, ["v", "n"])
    return out.withColumn("place", F.col("place").cast("int"))


@query(f"""WITH m AS ({_METHODS}), p AS (SELECT method, CASE WHEN app = 'O' THEN 'single' ELSE 'merged' END AS kind, v AS cost FROM m)
SELECT method, count(*) AS n_candidates, count(*) FILTER (kind = 'merged') AS n_merged, count(*) FILTER (kind = 'single') AS n_single, round(avg(cost), 6) AS avg_cost, count(*) >= 3000 AS cap_binds FROM p GROUP BY method""")
def pool_audit(spark, sf):
    pool = _methods(spark, sf).select("method", F.when(F.col("app") == "O", "single").otherwise("merged").alias("kind"), F.col("v").alias("cost"))
    return sm.pool_audit(pool, 3000)


_CLUSTERS = """cl AS (SELECT DISTINCT CAST(event_id % 37 AS BIGINT) AS cluster_id, CAST(user_id AS BIGINT) AS report_no FROM events WHERE event_id % 3 = 0 AND user_id > 0), rp AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS report_no FROM events WHERE user_id > 0),
sz AS (SELECT cluster_id, count(*) AS size FROM cl GROUP BY cluster_id), ow AS (SELECT report_no, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY report_no ORDER BY size DESC, cluster_id) AS r FROM cl JOIN sz USING (cluster_id)) WHERE r = 1),
al AS (SELECT cluster_id, report_no FROM ow UNION ALL SELECT (SELECT coalesce(max(cluster_id), 0) + 1 FROM cl), report_no FROM rp ANTI JOIN cl USING (report_no))"""


@query(f"WITH {_CLUSTERS} SELECT CAST(dense_rank() OVER (ORDER BY cluster_id) AS BIGINT) AS cluster_id, report_no FROM al")
def repaired_clusters(spark, sf):
    events = fx.table(spark, sf, "events").where("user_id > 0")
    number = F.col("user_id").cast("long").alias("report_no")
    return sm.repaired_clusters(events.where("event_id % 3 = 0").select((F.col("event_id") % 37).cast("long").alias("cluster_id"), number), events.select(number))


@query(r"""SELECT conv_id, turn, substr(regexp_replace(trim(regexp_replace('- 12. ' || coalesce(text, ''), '\s+', ' ', 'g')), '^[-*\d.\s]+', ''), 1, 300) AS summary,
CASE WHEN tok = '' THEN 'llmcluster' ELSE tok END AS token FROM (SELECT *, trim(substr(regexp_replace(trim(coalesce(text, '')), '[^a-zA-Z0-9_.-]+', '_', 'g'), 1, 64), '_') AS tok FROM conversations)""")
def summary_tokens(spark, sf):
    rows = fx.table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", sm.summary_text(F.concat(F.lit("- 12. "), F.coalesce("text", F.lit("")))).alias("summary"), sm.boundary_token(F.col("text")).alias("token"))
