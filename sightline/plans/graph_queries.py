"""Graph construction, expansion and views: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import ids as I  # noqa: N812
from sightline.functions import jsonx as X  # noqa: N812
from sightline.functions import text as T  # noqa: N812
from sightline.operators import components as cc
from sightline.operators import expand as ex
from sightline.operators import graph as g
from sightline.operators import views as v
from sightline.plans import fixtures as fx
from sightline.schema import UNIVERSE

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with the SQL of its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FACTS = f"WITH {fx.FACTS_SQL}"


@query(FACTS + """
SELECT type, name, count(DISTINCT report_id) AS n_reports, string_agg(DISTINCT report_id, '|' ORDER BY report_id) AS report_ids FROM mentions GROUP BY ALL""")
def g_nodes(spark, sf):
    return g.node_table(fx.mentions(spark, sf))


@query(FACTS + """
SELECT source_type, source, relation, target_type, target, count(*) AS n_rows, count(DISTINCT report_id) AS n_reports FROM edge_rows GROUP BY ALL""")
def g_edges(spark, sf):
    return g.edge_bag(fx.edge_rows(spark, sf))


def _thin(spark, sf):
    """A bridge that lacks what only first lines say, for the backfill."""
    return fx.mentions(spark, sf).where("line <> 1").select(F.col("name").alias("node_id"), "report_id").distinct()


THIN = FACTS + ", thin AS (SELECT DISTINCT name AS node_id, report_id FROM mentions WHERE line <> 1), ends AS (SELECT source AS node_id, report_id FROM edge_rows UNION SELECT target, report_id FROM edge_rows)"


@query(THIN + " SELECT node_id, report_id FROM thin UNION SELECT node_id, report_id FROM ends")
def g_bridge_backfill(spark, sf):
    return g.backfilled(_thin(spark, sf), fx.edge_rows(spark, sf))


@query(THIN + ", gain AS (SELECT * FROM ends EXCEPT SELECT * FROM thin) SELECT count(DISTINCT node_id) AS nodes_gaining, count(*) AS links_gained FROM gain")
def g_backfill_audit(spark, sf):
    return g.backfill_audit(_thin(spark, sf), fx.edge_rows(spark, sf))


@query(FACTS + ", few AS (SELECT DISTINCT name FROM mentions WHERE partkey IS NULL OR type <> 'DIAG') SELECT node_id FROM (SELECT source AS node_id FROM edge_rows UNION SELECT target FROM edge_rows) WHERE node_id NOT IN (SELECT name FROM few)".replace("partkey IS NULL OR ", ""))
def g_edge_only_nodes(spark, sf):
    nodes = fx.mentions(spark, sf).where("type <> 'DIAG'").select(F.col("name").alias("node_id")).distinct()
    return g.edge_only(nodes, fx.edge_rows(spark, sf))


@query(FACTS + """
SELECT type, count(*) AS n_universe, count(*) FILTER (hit) AS n_covered, count(*) FILTER (NOT hit) AS n_uncovered
FROM (SELECT type, node_id, node_id IN (SELECT name FROM mentions WHERE line = 7) AS hit FROM node_types WHERE type IN ('PHEN', 'DIAG', 'ISSUE')) GROUP BY type""")
def g_type_counts(spark, sf):
    hit = fx.mentions(spark, sf).where("line = 7").select(F.col("name").alias("node_id"))
    return g.type_counts(fx.node_types(spark, sf), hit, UNIVERSE)


VOTES = """, votes AS (SELECT name AS node_id, CASE WHEN line % 5 = 0 THEN 'UNK' WHEN line % 3 = 0 AND type = 'ISSUE' THEN 'PHEN' ELSE type END AS type,
  CAST(report_id AS BIGINT) * 10 + line AS first FROM mentions)"""


@query(FACTS + VOTES + """, n AS (SELECT node_id, type, count(*) AS votes, min(first) AS first FROM votes WHERE type <> 'UNK' GROUP BY ALL)
SELECT node_id, type, votes, n_types, n_types > 1 AS conflict FROM (SELECT *, count(*) OVER (PARTITION BY node_id) AS n_types,
  row_number() OVER (PARTITION BY node_id ORDER BY votes DESC, first, type DESC) AS r FROM n) WHERE r = 1""")
def g_type_votes(spark, sf):
    kind = F.when(F.col("line") % 5 == 0, "UNK").when((F.col("line") % 3 == 0) & (F.col("type") == "ISSUE"), "PHEN").otherwise(F.col("type"))
    first = F.col("report_id").cast("bigint") * 10 + F.col("line")
    return g.type_votes(fx.mentions(spark, sf).select(F.col("name").alias("node_id"), kind.alias("type"), first.alias("first")))


@query(FACTS + " SELECT t.type, count(n.node_id) AS n FROM (VALUES ('MOD'), ('OP'), ('ELEM'), ('PHEN'), ('DIAG'), ('ISSUE'), ('UNK')) t(type) LEFT JOIN node_types n ON n.type = t.type GROUP BY t.type")
def g_type_histogram(spark, sf):
    return g.type_histogram(fx.node_types(spark, sf), spark)


@query(FACTS + """
SELECT least(source, target) AS a, greatest(source, target) AS b, string_agg(DISTINCT relation, '|' ORDER BY relation) AS relations, count(DISTINCT report_id) AS n_reports
FROM edge_rows WHERE source <> target GROUP BY 1, 2""")
def g_simple_graph(spark, sf):
    return g.simple_graph(fx.edge_rows(spark, sf))


@query(FACTS + """, c AS (SELECT DISTINCT name AS entity, type || '-' || substr(name, 1, 3) AS cluster FROM mentions WHERE type IN ('ISSUE', 'ELEM')),
r AS (SELECT name, type, row_number() OVER (ORDER BY type, name) - 1 AS raw_id FROM (SELECT DISTINCT type, name FROM mentions))
SELECT name, type, raw_id, min(raw_id) OVER (PARTITION BY coalesce(cluster, chr(1) || name), type) AS unified_id FROM r LEFT JOIN c ON c.entity = r.name""")
def g_consistent_ids(spark, sf):
    m = fx.mentions(spark, sf)
    own = m.where("type IN ('ISSUE', 'ELEM')").select(F.col("name").alias("entity"), F.concat("type", F.lit("-"), F.substring("name", 1, 3)).alias("cluster")).distinct()
    return g.consistent_ids(m, own)


@query(FACTS + " SELECT node_id, string_agg(report_id, '|' ORDER BY CAST(report_id AS BIGINT), report_id) AS report_ids FROM bridge GROUP BY node_id")
def x_stable_sort(spark, sf):
    return g.numeric_first(fx.bridge(spark, sf))


@query(FACTS + """, c AS (SELECT issue AS entity, 'C' || (partkey % 7) AS cluster FROM facts GROUP BY ALL), f AS (SELECT cluster, min(entity) AS name FROM c GROUP BY cluster)
SELECT f.name AS subject, relation, target AS object, count(*) AS n FROM edge_rows JOIN c ON c.entity = source JOIN f USING (cluster) WHERE source_type = 'ISSUE' GROUP BY ALL""")
def g_relabelled(spark, sf):
    c = fx.facts(spark, sf).select(F.col("issue").alias("entity"), F.concat(F.lit("C"), (F.col("partkey") % 7).cast("string")).alias("cluster")).distinct()
    t = fx.edge_rows(spark, sf).where("source_type = 'ISSUE'").select(F.col("source").alias("subject"), "relation", F.col("target").alias("object"))
    return g.relabelled(t, c).groupBy("subject", "relation", "object").agg(F.count("*").alias("n"))


@query("SELECT 'app' || n_nationkey AS app, 1000 + CAST(('0x' || substr(md5('app' || n_nationkey), 1, 8)) AS BIGINT) % 9000 AS code FROM nation")
def x_app_code(spark, sf):
    app = F.concat(F.lit("app"), F.col("n_nationkey").cast("string"))
    return fx.table(spark, sf, "nation").select(app.alias("app"), I.app_code(app).alias("code"))


_RAW = "CAST(user_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN '.00' WHEN event_id % 3 = 1 THEN '|' || event_id ELSE ' ; ' || event_type || ',' || user_id END"


@query(f"""SELECT event_id, len(parts) AS n_ids, array_to_string(parts, '|') AS id_list FROM (
SELECT event_id, list_distinct_ordered(string_split_regex(trim({_RAW}), '[|,;\\s]+')) AS parts FROM events)""".replace(
    "list_distinct_ordered(", "(SELECT list(x ORDER BY o) FROM (SELECT x, min(i) AS o FROM (SELECT unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT "
).replace("'[|,;\\s]+')) AS parts", "'[|,;\\s]+') AS s)) WHERE x <> '' GROUP BY x)) AS parts"))
def x_split_ids(spark, sf):
    parts = I.split_ids(F.expr(_RAW.replace("VARCHAR", "STRING")))
    return fx.table(spark, sf, "events").select("event_id", F.size(parts).cast("bigint").alias("n_ids"), F.array_join(parts, "|").alias("id_list"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN CAST(user_id * 100 AS VARCHAR) WHEN 3 THEN NULL
ELSE 'a' || user_id END AS id FROM events""")
def x_norm_ids(spark, sf):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN user_id || '.00' WHEN 2 THEN user_id || 'e2' WHEN 3 THEN 'NaN' ELSE ' a' || user_id END")
    return fx.table(spark, sf, "events").select("event_id", I.normal_id(raw).alias("id"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^一-鿿a-z0-9]+', ' ', 'g')) AS text_key FROM documents")
def x_text_key(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", T.text_key(F.col("text")).alias("text_key"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || '  ' || chr(9) || p_brand || ' '), '\\s+', ' ', 'g')) AS squeezed FROM part")
def x_squeeze(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", T.squeeze(F.concat("p_name", F.lit("　 \t"), "p_brand", F.lit(" "))).alias("squeezed"))


@query(f"WITH {fx.NAMES_SQL} SELECT entity, count(DISTINCT gram) AS n, string_agg(DISTINCT gram, '|' ORDER BY gram) AS grams FROM (SELECT entity, substr(entity, CAST(i AS INT), 3) AS gram FROM names, range(1, greatest(2, length(entity) - 1)) r(i)) GROUP BY entity")
def x_char_ngrams(spark, sf):
    grams = T.char_ngrams(F.col("entity"), 3)
    return fx.names(spark, sf).select("entity").distinct().select("entity", F.size(grams).cast("bigint").alias("n"), F.array_join(F.array_sort(grams), "|").alias("grams"))


def _triple_json(spark, sf):
    one = F.struct(F.col("issue").alias("subject"), F.lit("ISSUE").alias("subject_type"), F.lit("concerns").alias("relation"), F.col("elem").alias("object"), F.lit("ELEM").alias("object_type"))
    return fx.facts(spark, sf).groupBy("report_id").agg(F.to_json(F.collect_list(one)).alias("raw"))


@query(FACTS + " SELECT report_id, issue AS subject, 'ISSUE' AS subject_type, 'concerns' AS relation, elem AS object, 'ELEM' AS object_type FROM facts")
def x_triples_flatten(spark, sf):
    raw = _triple_json(spark, sf).withColumn("raw", F.concat(F.lit("Here:\n```json\n"), F.regexp_replace("raw", r"\]$", ",]"), F.lit("\n```")))
    return X.flatten_triples(raw.withColumn("raw", X.clean_json(F.col("raw"))), "raw")


@query(FACTS + " SELECT report_id, issue AS subject, 'ISSUE' AS subject_type, 'concerns' AS relation, elem AS object, 'ELEM' AS object_type FROM facts")
def x_json_repair(spark, sf):
    """Curly quotes, a fence, and a missing end; the last object is closed by hand."""
    worse = F.concat(F.lit("```json\n"), F.translate(F.regexp_replace("raw", r"\}\]$", ""), '"', "“"), F.lit("\n"))
    return X.flatten_triples(_triple_json(spark, sf).withColumn("raw", X.repair_json(worse)), "raw")


@query(FACTS + " SELECT report_id, line, issue AS subject, 'ISSUE' AS subject_type, elem AS object, 'ELEM' AS object_type FROM facts")
def x_legacy_triples(spark, sf):
    text = F.concat(F.lit("###"), F.concat_ws("￨", "issue", F.lit("ISSUE实体"), F.lit("concerns"), "elem", F.lit(" ELEM ")), F.lit("###bad￨row"))
    out = fx.facts(spark, sf).select("report_id", "line", F.inline(X.legacy_triples(text)))
    return out.select("report_id", "line", "subject", "subject_type", "object", "object_type")


@query("SELECT user_id, unnest([user_id, user_id + 1]) AS member FROM (SELECT DISTINCT user_id FROM events)")
def x_cluster_lines(spark, sf):
    text = F.concat(F.lit("CURRENT CLUSTERS:\nCluster 1 {"), F.col("user_id"), F.lit("}\nCluster 2 {"), F.col("user_id") + 1, F.lit(" }"))
    return fx.table(spark, sf, "events").select("user_id").distinct().select("user_id", F.explode(F.flatten(X.cluster_lines(text)).cast("array<bigint>")).alias("member"))


@query("SELECT p_partkey, p_brand || '。' || p_type || '。' || p_name AS signature FROM part")
def x_signature_text(spark, sf):
    examples = F.array("p_name", F.lit("（no）"), F.lit(" "), F.lit("未明确 x"))
    return fx.table(spark, sf, "part").select("p_partkey", T.signature_text(F.col("p_brand"), F.col("p_type"), examples).alias("signature"))


@query("SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS mean, n_nationkey / 4 AS std FROM nation")
def x_plus_minus(spark, sf):
    text = F.concat(F.col("n_nationkey").cast("string"), F.lit("±"), (F.col("n_nationkey") / 4).cast("string"))
    return fx.table(spark, sf, "nation").select("n_nationkey", T.plus_minus(text).alias("p")).select("n_nationkey", "p.*")


@query("SELECT DISTINCT r_regionkey, CAST(x AS DOUBLE) AS cost FROM (SELECT r_regionkey, unnest(list_concat(range(r_regionkey, r_regionkey + 7, 2), [10])) AS x FROM region)")
def x_schedule(spark, sf):
    spec = F.concat(F.col("r_regionkey").cast("string"), F.lit(":"), (F.col("r_regionkey") + 6).cast("string"), F.lit(":2, 10"))
    return fx.table(spark, sf, "region").select("r_regionkey", F.explode(T.schedule(spec)).alias("cost"))


@query("SELECT conv_id, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def x_token_accounting(spark, sf):
    return fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(T.tokens_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("n_turns"))


# expansion

RMAX = 100
_EXPAND = f""", r0 AS (SELECT seed, report_id, 0 AS depth FROM seeds JOIN bridge ON node_id = seed),
v1 AS (SELECT DISTINCT seed, node_id FROM r0 JOIN bridge USING (report_id)),
g1 AS (SELECT seed, report_id, min(depth) AS depth FROM (SELECT * FROM r0 UNION ALL SELECT DISTINCT seed, report_id, 1 FROM v1 JOIN bridge USING (node_id)) GROUP BY 1, 2),
n1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, CAST(report_id AS BIGINT)) AS place, count(*) OVER (PARTITION BY seed) AS n FROM g1),
reports AS (SELECT seed, report_id, depth, n FROM n1 WHERE place <= {RMAX}),
nodes AS (SELECT seed, node_id FROM reports JOIN bridge USING (report_id) UNION SELECT seed, seed FROM seeds)"""


EXPAND = FACTS + ", " + fx.SEEDS_SQL + _EXPAND


_EXPANDED: dict[tuple[str, str], tuple] = {}


def _expanded(spark, sf):
    """Reports, nodes and status of each seed's expansion, from one run; nodes are made where they are read."""
    key = (spark.sparkContext.applicationId, str(sf))
    if key not in _EXPANDED:
        _EXPANDED[key] = ex.expand(fx.seeds(spark, sf), fx.bridge(spark, sf), 1, RMAX)
    return _EXPANDED[key]


def _nodes(spark, sf):
    """Nodes of each seed's expansion, written once for those who read them more than once."""
    return fx.built(spark, sf, "seeds_nodes", lambda: _expanded(spark, sf)[1])


@query(EXPAND + " SELECT seed, report_id, depth FROM reports")
def expand_k1(spark, sf):
    return _expanded(spark, sf)[0].select("seed", "report_id", "depth")


@query(EXPAND + f""" SELECT s.seed, CASE WHEN max(n) IS NULL THEN 'seed-has-no-reports' WHEN max(n) > {RMAX} THEN 'r-max-truncated' WHEN max(depth) < 1 THEN 'no-growth' ELSE 'k-reached' END AS stopped_reason,
CASE WHEN max(n) IS NULL THEN 0 ELSE 1 END AS hop FROM seeds s LEFT JOIN reports USING (seed) GROUP BY s.seed""")
def expand_stop_reasons(spark, sf):
    return _expanded(spark, sf)[2].select("seed", "stopped_reason", "hop")


# a scope of reports and types, where two hops don't reach everything
LEAN = FACTS + f""", {fx.URGENT_SQL}, {fx.SEEDS_SQL}, r0 AS (SELECT seed, report_id, 0 AS depth FROM seeds JOIN lean ON node_id = seed),
v1 AS (SELECT DISTINCT seed, node_id FROM r0 JOIN lean USING (report_id)),
g1 AS (SELECT seed, report_id, min(depth) AS depth FROM (SELECT * FROM r0 UNION ALL SELECT DISTINCT seed, report_id, 1 FROM v1 JOIN lean USING (node_id)) GROUP BY 1, 2),
n1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, CAST(report_id AS BIGINT)) AS place, count(*) OVER (PARTITION BY seed) AS n, max(depth) OVER (PARTITION BY seed) AS deep FROM g1),
h1 AS (SELECT seed, report_id, depth FROM n1 WHERE place <= 400 AND (n > 400 OR deep < 1)), l1 AS (SELECT seed, report_id, depth FROM n1 WHERE n <= 400 AND deep = 1),
v2 AS (SELECT DISTINCT seed, node_id FROM l1 JOIN lean USING (report_id)),
g2 AS (SELECT seed, report_id, min(depth) AS depth FROM (SELECT * FROM l1 UNION ALL SELECT DISTINCT seed, report_id, 2 FROM v2 JOIN lean USING (node_id)) GROUP BY 1, 2),
n2 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, CAST(report_id AS BIGINT)) AS place FROM g2)
SELECT seed, report_id, depth FROM h1 UNION ALL SELECT seed, report_id, depth FROM n2 WHERE place <= 400"""


@query(LEAN)
def expand_k2_strict(spark, sf):
    return ex.expand(fx.seeds(spark, sf), fx.urgent_issues(spark, sf), 2, 400, 0)[0].select("seed", "report_id", "depth")


LINKS = ", links AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edge_rows WHERE relation IN ('concerns', 'accompanied_by')), bi AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links)"


def _links(spark, sf):
    return g.simple_graph(fx.edge_rows(spark, sf).where("relation IN ('concerns', 'accompanied_by')")).select("a", "b")


def _link_rows(spark, sf):
    """Those links once for each line item."""
    return fx.edge_rows(spark, sf).where("relation IN ('concerns', 'accompanied_by')").select(F.col("source").alias("a"), F.col("target").alias("b"))


def _link_parts(spark, sf):
    """node, component: these links join issues with elements and phenomena with diagnoses, no node is on both sides."""
    return fx.built(spark, sf, "link_parts", lambda: cc.two_sided(_link_rows(spark, sf)))


BALL = FACTS + f", {fx.SEEDS_SQL}" + LINKS + """, b0 AS (SELECT seed, seed AS node_id FROM seeds), b1 AS (SELECT DISTINCT seed, y AS node_id FROM b0 JOIN bi ON x = node_id),
b2 AS (SELECT DISTINCT seed, y AS node_id FROM b1 JOIN bi ON x = node_id),
ball AS (SELECT seed, node_id, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM b0 UNION ALL SELECT *, 1 FROM b1 UNION ALL SELECT *, 2 FROM b2) GROUP BY 1, 2)"""


@query(BALL + " SELECT seed, node_id, depth FROM ball")
def bfs_ball(spark, sf):
    return ex.ball_in_parts(fx.seeds(spark, sf), _link_rows(spark, sf), 2, _link_parts(spark, sf))


@query(BALL + " SELECT seed, count(DISTINCT report_id) AS n_reports FROM ball JOIN bridge USING (node_id) JOIN node_types USING (node_id) WHERE type IN ('PHEN', 'DIAG', 'ISSUE') GROUP BY seed")
def khop_coverage(spark, sf):
    universe = fx.node_types(spark, sf).where(F.col("type").isin(*UNIVERSE))
    return ex.neighbourhood_reports(fx.seeds(spark, sf), _link_rows(spark, sf), fx.bridge(spark, sf), universe, 2, _link_parts(spark, sf))


@query(FACTS + LINKS + """, d AS (SELECT x AS node_id, count(*) AS degree FROM bi GROUP BY x)
SELECT node_id, n_reports, coalesce(degree, 0) AS degree, round(n_reports + ln(1 + coalesce(degree, 0)), 6) AS score
FROM (SELECT node_id, count(*) AS n_reports FROM bridge GROUP BY node_id) LEFT JOIN d USING (node_id) ORDER BY score DESC, node_id DESC LIMIT 400""")
def seed_rank(spark, sf):
    links = _links(spark, sf)
    degrees = links.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return ex.ranked_seeds(fx.bridge(spark, sf), degrees, 400)


# views

_COSTS = """, er AS (SELECT report_id, count(*) AS k FROM edge_rows GROUP BY report_id),
costs AS (SELECT seed, coalesce(n_reports, 0) AS n_reports, n_nodes, coalesce(n_edges, 0) AS n_edges, round(1.0 * coalesce(n_reports, 0) + 0.02 * n_nodes + 0.01 * coalesce(n_edges, 0), 6) AS cost FROM
  (SELECT seed, count(*) AS n_nodes FROM nodes GROUP BY seed) LEFT JOIN (SELECT seed, count(*) AS n_reports, CAST(sum(k) AS BIGINT) AS n_edges FROM reports JOIN er USING (report_id) GROUP BY seed) USING (seed))"""
_ITEMS = ", items AS (SELECT seed, node_id FROM nodes JOIN node_types USING (node_id) WHERE type IN ('PHEN', 'DIAG', 'ISSUE'))"
COSTS = EXPAND + _COSTS
ITEMS = COSTS + _ITEMS


def _numbers(spark, sf):
    """Nodes by number, the universe's first."""
    return fx.built(spark, sf, "numbers", lambda: v.node_numbers(fx.node_types(spark, sf), F.col("type").isin(*UNIVERSE)))


def _view_rows(spark, sf):
    """Each view as one row: its costs, the numbers of its universe's nodes and of its reports."""

    def make():
        return v.numbered_views(fx.seeds(spark, sf), _expanded(spark, sf)[0], fx.bridge(spark, sf), _numbers(spark, sf), fx.edge_rows(spark, sf).select("report_id"))

    return fx.built(spark, sf, "seeds_views", make)


def _costs(spark, sf):
    return _view_rows(spark, sf).select("seed", "n_reports", "n_nodes", "n_edges", "cost")


def _universe_numbers(spark, sf):
    """node_id, number of the universe's nodes, from 0 on."""
    return _numbers(spark, sf).where("first").select("node_id", "number")


def _view_items(spark, sf):
    """seed, items: each view as one row with the numbers of its universe's nodes; a view's own seed is one of them, whether a report has it or not."""
    return _view_rows(spark, sf).select("seed", "items")


def _item_numbers(spark, sf):
    """seed, item of _view_items()."""
    return _view_items(spark, sf).select("seed", F.explode("items").alias("item"))


def _dearest(spark, sf):
    """A selection: the ten dearest views."""
    make = lambda: _costs(spark, sf).orderBy(F.desc("cost"), "seed").limit(10).select("seed")
    return fx.built(spark, sf, "dearest", make)


def _states(spark, sf):
    """node_id, state of the universe's nodes for the dearest views. What a view may cover is read off the reports that views hold, and their seeds."""

    def make():
        universe = fx.node_types(spark, sf).where(F.col("type").isin(*UNIVERSE)).select("node_id")
        held = fx.bridge(spark, sf).join(_expanded(spark, sf)[0].select("report_id").distinct(), "report_id", "left_semi")
        reached = held.select("node_id").unionByName(fx.seeds(spark, sf).select(F.col("seed").alias("node_id")))
        few = _item_numbers(spark, sf).join(F.broadcast(_dearest(spark, sf)), "seed", "left_semi").select(F.col("item").alias("number")).distinct()
        return v.reachability(universe, reached, _universe_numbers(spark, sf).join(F.broadcast(few), "number"))

    return fx.built(spark, sf, "states", make)


def _missed(spark, sf):
    return fx.built(spark, sf, "missed", lambda: v.missed_items(_view_rows(spark, sf), _dearest(spark, sf), _universe_numbers(spark, sf)))


@query(COSTS + " SELECT seed, n_reports, n_nodes, n_edges, CAST(cost AS DOUBLE) AS cost FROM costs")
def view_cost(spark, sf):
    return _costs(spark, sf)


@query(ITEMS + " SELECT seed, node_id FROM items")
def view_universe(spark, sf):
    return v.named_items(_view_items(spark, sf), _universe_numbers(spark, sf))


PAIRS = ITEMS + """, n AS (SELECT seed, count(*) AS n FROM items GROUP BY seed),
s AS (SELECT a.seed AS a, b.seed AS b, count(*) AS shared FROM items a JOIN items b USING (node_id) WHERE a.seed < b.seed GROUP BY 1, 2)"""


def _pairs(spark, sf):
    """Pairs of all parts' expanded views: a node that every view has makes them as many as there can be."""
    return v.block_pairs(_view_items(spark, sf))


@query(PAIRS + " SELECT a, b, shared FROM s")
def view_blocking_pairs(spark, sf):
    return _pairs(spark, sf).select("a", "b", "shared")


@query(PAIRS + " SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON x.seed = a JOIN n y ON y.seed = b")
def view_pairs_jaccard(spark, sf):
    share = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return _pairs(spark, sf).select("a", "b", "shared", (F.floor(share * 1e6 + 0.5) / 1e6).alias("jaccard"))  # a half of the last digit goes as in SQL


@query(ITEMS + """, chosen AS (SELECT seed FROM costs ORDER BY cost DESC, seed LIMIT 10), hit AS (SELECT DISTINCT node_id FROM items JOIN chosen USING (seed)),
m AS (SELECT node_id, seed, cost, row_number() OVER (PARTITION BY node_id ORDER BY cost, seed) AS place FROM items JOIN costs USING (seed) WHERE node_id NOT IN (SELECT node_id FROM hit))
SELECT node_id, count(*) AS n_candidates, min(seed) FILTER (place = 1) AS cheapest, CAST(min(cost) AS DOUBLE) AS cheapest_cost, string_agg(seed, '|' ORDER BY place) FILTER (place <= 5) AS top_views FROM m GROUP BY node_id""")
def missed_nodes(spark, sf):
    return _missed(spark, sf)


@query(ITEMS + """, chosen AS (SELECT seed FROM costs ORDER BY cost DESC, seed LIMIT 10) SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM items JOIN chosen USING (seed)) THEN 'covered'
WHEN node_id IN (SELECT node_id FROM items) THEN 'missed' ELSE 'unreachable' END AS state FROM node_types WHERE type IN ('PHEN', 'DIAG', 'ISSUE')""")
def universe_reachability(spark, sf):
    return _states(spark, sf)


@query(FACTS + " SELECT quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, max(n) AS most FROM (SELECT node_id, count(*) AS n FROM bridge GROUP BY node_id)")
def report_quantiles(spark, sf):
    n = fx.bridge(spark, sf).groupBy("node_id").agg(F.count("*").alias("n"))
    return n.agg(F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"), F.max("n").alias("most"))


@query(FACTS + " SELECT n AS value FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM (SELECT node_id, count(*) AS n FROM bridge GROUP BY node_id)) WHERE i = floor(total * 0.95)")
def nearest_rank_p95(spark, sf):
    return v.nearest_rank(fx.bridge(spark, sf).groupBy("node_id").agg(F.count("*").alias("n")), "n", 0.95)


@query(COSTS + " SELECT seed, n_reports, n_nodes, n_edges, CAST(cost AS DOUBLE) AS cost FROM costs ORDER BY cost DESC, seed LIMIT 20")
def topk_views(spark, sf):
    return _costs(spark, sf).orderBy(F.desc("cost"), "seed").limit(20)
