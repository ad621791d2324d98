"""The order-dependent operators against small brute-force versions, and the helpers."""

import itertools
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sightline.functions import ids, jsonx, text
from sightline.operators import backend, components, metrics, paths, select, vectors
from sightline.sources import readers, sinks
from sightline.streaming import incremental


def test_greedy_prefers_score_then_gain_then_id():
    items = {"a": frozenset("xyz"), "b": frozenset("xyw"), "c": frozenset("w")}
    out = select.greedy(items, {"a": 1.0, "b": 1.0, "c": 0.5}, 5)
    assert [r[1] for r in out] == ["a", "c"] and out[-1][2] == 1
    assert [r[1] for r in select.greedy(items, {"a": 3.0, "b": 2.0, "c": 9.0}, 5, budget=2.5)] == ["b"]


def test_wilcoxon_counts_signs(spark):
    d = [0.5, -0.2, 0.5, 0.9, 0.0, 0.1]
    own = sorted((abs(x), x > 0) for x in d if x)
    sizes = [a for a, _ in own]
    ranks = [sum(i + 1 for i, s in enumerate(sizes) if s == a) / sizes.count(a) for a in sizes]
    w = min(sum(r for r, (_, p) in zip(ranks, own) if p), sum(r for r, (_, p) in zip(ranks, own) if not p))
    hits = [min(s := sum(r for r, on in zip(ranks, signs) if on), sum(ranks) - s) <= w + 1e-9 for signs in itertools.product([0, 1], repeat=len(ranks))]
    got = metrics.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double")).first()
    assert (got["n"], got["w"], got["p"]) == (5, w, round(sum(hits) / len(hits), 6))


def test_t_distribution():
    assert metrics._beta(2.5, 0.5, 0.0) == 0 and abs(2 * (1 - metrics._beta(0.5, 0.5, 0.5)) - 1) < 1e-9


def test_components_of_chains_and_hubs(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z", f"h{i}") for i in range(30)] + [("s", "s")]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and {v for k, v in got.items() if k[0] in "hz"} == {"h0"}


@pytest.mark.parametrize("raw, want", [
    ('```json\n[{"a": 1},]\n```', [{"a": 1}]), ("{a: True, b: None}", {"a": True, "b": None}), ("[{'x': 'y'}", [{"x": "y"}]),
    ('note [{“k”: “v”}, {"k": "w', [{"k": "v"}, {"k": "w"}]), ("no json", None), (None, None),
])
def test_repair(raw, want):
    out = jsonx.repair(raw)
    assert (json.loads(out) if out else out) == want


def test_ids(spark):
    rows = [("1|2,2 ; 3",), (" 12.00 ",), ("1e5",), ("nan",), (None,), ("[7, '8']",), ("a1",)]
    df = spark.createDataFrame(rows, "s string").select("s", ids.parse_ids(F.col("s")).alias("p"))
    got = {r["s"]: r["p"] for r in df.collect()}
    assert got["1|2,2 ; 3"] == ["1", "2", "3"] and got[" 12.00 "] == ["12"] and got["1e5"] == ["100000"]
    assert got["nan"] == [] and got[None] == [] and got["[7, '8']"] == ["7", "8"] and got["a1"] == ["a1"]
    order = [r["s"] for r in spark.createDataFrame([("10",), ("a1",), ("2",), ("007",)], "s string").orderBy(*ids.order_columns(F.col("s"))).collect()]
    assert order == ["2", "007", "10", "a1"]
    assert text.path_name("雅a") == "#U96c5a"


def test_paths_drop_parts_of_better_ones():
    types = {"i": "ISSUE", "p": "PHEN", "d": "DIAG", "m": "MOD"}
    out = paths.enumerate_paths([("i", "r", "p"), ("p", "s", "d"), ("d", "t", "m")], types)
    assert out == [["i", "r", "p", "s", "d", "t", "m"]]
    assert paths.grouped([["a", "r", "b"], ["a", "r", "c"]]) == ["a -[r]-> {b, c}"]


def test_linkage():
    import numpy as np

    x = np.array([[1.0, 0], [0.99, 0.14], [0, 1.0], [0.1, 0.99]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert vectors.agglomerate(x, k=2).tolist() == [0, 0, 2, 2]
    assert vectors.agglomerate(x, threshold=1e-9, linkage="complete").tolist() == [0, 1, 2, 3]


def test_backend_defaults_on_failure(spark):
    class Broken(backend.RuleBackend):
        def complete(self, task, items):
            raise TimeoutError

    df = spark.createDataFrame([("1", "Login Button."), ("2", "none")], "id string, text string")
    good = {r["id"]: r["status"] for r in backend.model_column(df, "extract").collect()}
    assert good == {"1": "success", "2": "empty"} and df.columns == ["id", "text"]
    bad = backend.model_column(df, "extract", make=Broken, default="[]").collect()
    assert {(r["status"], r["value"]) for r in bad} == {("failed", "[]")}


def test_workbook_and_sinks(spark, tmp_path):
    book = tmp_path / "b.xlsx"
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
    cell = '<c r="{}" t="inlineStr"><is><t>{}</t></is></c>'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", sheet.format("<row>" + cell.format("A1", "id") + cell.format("C1", "text") + "</row><row>" + cell.format("A2", "7") + cell.format("C2", "hi") + "</row>"))
    df = readers.read_table(spark, str(book))
    assert [tuple(r) for r in df.select("sheet", "id", "text").collect()] == [("one", "7", "hi")]
    sinks.write_report({"a/b": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "sheet=a_b")).count() == 1
    assert "7" in sinks.latex(df, "c")
    with pytest.raises(ValueError, match="missing columns"):
        readers.nodes(df)


def test_stream_adds_each_row_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "bridge")
    one = spark.createDataFrame([("a", "ISSUE", "r", "b", "ELEM", "1")], "subject string, subject_type string, relation string, object string, object_type string, source_row_index string")
    for _ in range(2):
        one.write.mode("append").parquet(src)
        incremental.keep_bridge(spark.readStream.schema(one.schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2


def test_sizes_come_from_the_tables(spark):
    from sightline.plans import analytics_queries as aq
    from sightline.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    counts = {r["type"]: r["count"] for r in fx.node_types(spark, sf).groupBy("type").count().collect()}
    universe, parts = sum(counts[t] for t in ("PHEN", "DIAG", "ISSUE")), fx.table(spark, sf, "part").count()
    assert universe != 2950 and parts != 2000
    groups = aq.random_contract(spark, sf).collect()
    for t, n in counts.items():
        assert sum(r["n"] for r in groups if r["type"] == t) == n
    gain = sum(r["gain"] for r in aq.cover_greedy(spark, sf).collect())
    for curve in (aq.curve_interpolated(spark, sf), aq.curve_cost(spark, sf), aq.curve_plateau(spark, sf)):
        assert abs(max(r["coverage"] for r in curve.collect()) - gain / universe) < 1e-5


def test_every_vector_is_clustered(spark):
    from sightline.plans import fixtures as fx
    from sightline.plans import retrieval_queries as rq

    sf = "/root/testdata/sf0.001"
    ids = sorted(r["id"] for r in fx.vectors(spark, sf).collect())
    for f in (rq.hc_average, rq.hc_complete):
        rows = f(spark, sf).collect()
        assert sorted(r["id"] for r in rows) == ids
    assert len({r["cluster_id"] for r in rq.hc_average(spark, sf).collect()}) == 20


def test_one_to_one_join_refuses_repeated_and_missing_keys(spark):
    import pytest

    from sightline.operators import summary

    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 20)], "app string, id int, x int")
    right = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 9, 7)], "app string, id int, y int")
    assert sorted(map(tuple, summary.one_to_one(left, right, ["app", "id"]).collect())) == [("a", 1, 10, 5), ("a", 2, 20, None)]
    for bad_left, bad_right in ((left.union(left), right), (left, right.union(right)), (left, right.where("id <> 2"))):
        with pytest.raises(Exception, match="key"):
            summary.one_to_one(bad_left, bad_right, ["app", "id"]).collect()


def test_repaired_clusters_by_brute_force(spark):
    import random

    from sightline.operators import summary

    rng = random.Random(4)
    for _ in range(3):
        clusters = {c: {rng.randrange(-1, 25) for _ in range(rng.randrange(1, 8))} for c in rng.sample(range(1, 30), 5)}
        reports = list(range(1, 21))
        clusters_ = {c: {m for m in ms if m > 0} for c, ms in clusters.items()}
        clusters_ = {c: ms for c, ms in clusters_.items() if ms}
        own = {}
        for r in reports:
            owners = sorted((-len(ms), c) for c, ms in clusters_.items() if r in ms)
            own[r] = owners[0][1] if owners else max(clusters_, default=0) + 1
        number = {c: i + 1 for i, c in enumerate(sorted(set(own.values())))}
        got = summary.repaired_clusters(
            spark.createDataFrame([(c, m) for c, ms in clusters.items() for m in ms], "cluster_id long, report_no long"), spark.createDataFrame([(r,) for r in reports], "report_no long")
        )
        assert {r["report_no"]: r["cluster_id"] for r in got.collect()} == {r: number[c] for r, c in own.items()}


def test_graph_ranking_counts_the_reports_own_anchors(spark):
    from sightline.operators import retrieve

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    anchors = frame([("q", "n1"), ("q", "n2"), ("q", "n2")], "query_id string, node_id string")
    nodes = frame([("s", "n1"), ("s", "n2"), ("t", "n1")], "seed string, node_id string")
    reports = frame([("s", "q"), ("s", "r1"), ("s", "r2"), ("t", "r2")], "seed string, report_id string")
    costs = frame([("s", 2.0), ("t", 1.0)], "seed string, cost double")
    bridge = frame([("n1", "q"), ("n2", "q"), ("n1", "r2"), ("x", "r1")], "node_id string, report_id string")
    got = {r["doc_id"]: (r["support"], r["shared"], r["min_cost"], r["score"], r["rank"]) for r in retrieve.graph_ranking(anchors, nodes, reports, costs, bridge).collect()}
    assert got == {"r2": (2, 1, 1.0, 2.5, 1), "r1": (1, 0, 2.0, 1.0, 2)}


def test_merged_views_cost_as_unmerged_ones_do(spark):
    from pyspark.sql import functions as F

    from sightline.operators import merge, views

    reports = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2")], "seed string, report_id string")
    nodes = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "seed string, node_id string")
    edges = spark.createDataFrame([("1",), ("1",), ("2",), ("7",)], "report_id string")
    want = {r["seed"]: r["cost"] for r in views.view_costs(reports, nodes, edges).collect()}
    rows = reports.groupBy("seed").agg(F.collect_set("report_id").alias("report_ids")).join(
        nodes.groupBy("seed").agg(F.collect_list(F.struct("node_id", F.lit("ISSUE").alias("type"))).alias("nodes")), "seed"
    ).withColumn("problem", F.lit("all"))
    assert {r["view_id"]: r["cost"] for r in merge.merged(rows, edges, rules=merge.Rules(threshold=0.9)).collect()} == want


def test_bounded_hop_by_brute_force(spark):
    """A hop keeps the nearest r_max reports, ties by id, though later reports leave before the shuffle."""
    import random

    from sightline.operators import expand

    rng = random.Random(3)
    links = sorted({(f"n{min(int(rng.expovariate(0.2)), 30)}", str(rng.randrange(300))) for _ in range(700)})
    of_node, of_report = {}, {}
    for n, r in links:
        of_node.setdefault(n, set()).add(r)
        of_report.setdefault(r, set()).add(n)
    want = set()
    for seed in ("n20", "n12", "n30"):
        first = of_node.get(seed, set())
        depth = {r: 0 for r in first}
        if len(first) <= 12:
            for r in {x for f in first for n in of_report[f] for x in of_node[n]} - first:
                depth[r] = 1
        want |= {(seed, r, depth[r]) for r in sorted(depth, key=lambda r: (depth[r], int(r)))[:12]}
    seeds = spark.createDataFrame([("n20",), ("n12",), ("n30",)], "seed string")
    reports, _, _ = expand.expand(seeds, spark.createDataFrame(links, "node_id string, report_id string"), 1, 12)
    assert {tuple(r) for r in reports.select("seed", "report_id", "depth").collect()} == want


def _plain_expansion(links, seeds, r_max):
    of_node, of_report = {}, {}
    for n, r in links:
        of_node.setdefault(n, set()).add(r)
        of_report.setdefault(r, set()).add(n)
    want, order = set(), lambda r: (not r.isdigit(), int(r) if r.isdigit() else 0, r)
    for seed in seeds:
        depth = {r: 0 for r in of_node.get(seed, ())}
        if len(depth) <= r_max:
            depth |= {r: 1 for f in set(depth) for n in of_report[f] for r in of_node[n] if r not in depth}
        want |= {(seed, r, depth[r]) for r in sorted(depth, key=lambda r: (depth[r], *order(r)))[:r_max]}
    return want


def test_expansion_by_hubs_looks_at_the_first_reports_alone(spark, monkeypatch):
    from sightline.operators import expand

    links = [("hub", str(r)) for r in range(400)] + [(f"n{r % 40}", str(r)) for r in range(400)]
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(40)], "seed string")
    monkeypatch.setattr(expand, "_reached", None)
    reports, _, _ = expand.expand(seeds, spark.createDataFrame(links, "node_id string, report_id string"), 1, 20)
    assert {tuple(r) for r in reports.select("seed", "report_id", "depth").collect()} == _plain_expansion(links, [f"n{i}" for i in range(40)], 20)


def test_expansion_with_and_without_hubs_and_with_text_ids(spark):
    import random

    from sightline.operators import expand

    rng = random.Random(5)
    near = [(f"n{rng.randrange(60)}", f"{'a' if r % 3 == 0 else ''}{r}") for r in (rng.randrange(900) for _ in range(900))]
    links = sorted({*near, *(("hub", str(r)) for r in range(1, 200, 2))})
    seeds = sorted({n for n, _ in links} | {"absent"})
    reports, _, status = expand.expand(spark.createDataFrame([(s,) for s in seeds], "seed string"), spark.createDataFrame(links, "node_id string, report_id string"), 1, 30)
    assert {tuple(r) for r in reports.select("seed", "report_id", "depth").collect()} == _plain_expansion(links, seeds, 30)
    assert {r["seed"] for r in status.where("stopped_reason = 'seed-has-no-reports'").collect()} == {"absent"}
