"""What large tables need: plans that shuffle no more than they must, memory that is bounded, whole results."""

import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from sightline.operators import graph as g
from sightline.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


def test_names_of_a_report_are_not_shuffled(spark):
    """rows are dealt by report once; no pair of node and report is shuffled after that."""
    thin = fx.mentions(spark, SF).where("line <> 1").select("report_id", "name").withColumnRenamed("name", "node_id").distinct()
    for df in (fx.bridge(spark, SF), g.backfilled(thin, fx.edge_rows(spark, SF)), g.backfill_audit(thin, fx.edge_rows(spark, SF)), g.edge_bag(fx.edge_rows(spark, SF))):
        assert not [x for x in exchanges(df) if "report_id" in x and ("node_id" in x or "source" in x)]


def test_gained_links_skip_what_is_known(spark):
    known = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None)], "node_id string, report_id string")
    edges = spark.createDataFrame([("1", "a", "b"), ("1", "a", "b"), ("2", "a", "c")], "report_id string, source string, target string")
    assert sorted(tuple(r) for r in g.gained(known, edges).select("node_id", "report_id").collect()) == [("a", "2"), ("b", "1"), ("c", "2")]


def test_filter_sizes_has_both_stages(spark, tmp_path):
    """where no row is kept, SQL and query say so with a row of 0 issues."""
    text = "x" * 500
    spark.createDataFrame([(i, "en", "s", f"{text} {i}", 500) for i in range(20)], "doc_id long, lang string, source string, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in range(20)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.sql(__spark_entry__.oracle_sql()["filter_sizes"]).fetchall())
    got = sorted(tuple(r) for r in __spark_entry__.queries()["filter_sizes"](spark, str(tmp_path)).collect())
    assert got == want == [("kept", 0, None, None, None), ("raw", 1, 20.0, 20.0, 20)]


def test_a_round_of_a_cover_shuffles_no_items(spark, monkeypatch):
    """Gains are counted where a view's row lies."""
    from sightline.operators import cover as co

    plans, write = {}, co.cut
    monkeypatch.setattr(co, "cut", lambda df, name: plans.setdefault(name, df) is None or write(df, name))
    views = spark.createDataFrame([(f"s{i}", 1.0, list(range(i, i + 3))) for i in range(9)], "seed string, cost double, entities array<int>")
    assert [r["gain"] for r in co.cover_views(views, held=6).orderBy("step").collect()] == [3.0, 3.0, 3.0, 2.0]
    assert "Exchange" not in plans["gains"]._jdf.queryExecution().executedPlan().toString()


def test_block_pairs_are_all_pairs(spark):
    """every two views with an item in common, whatever the blocks and columns."""
    import random

    from sightline.operators import views as v

    rng = random.Random(1)
    views = {f"s{i}": sorted(rng.sample(range(60), rng.randint(0, 12))) for i in range(30)}
    df = spark.createDataFrame(list(views.items()), "seed string, items array<int>")
    want = sorted((a, b, n, len(x), len(y)) for a, x in views.items() for b, y in views.items() if a < b and (n := len(set(x) & set(y))))
    for block, wide in ((1024, 16384), (7, 5)):
        assert sorted(tuple(r) for r in v.block_pairs(df, block, wide).collect()) == want


def test_scores_are_held_in_blocks_of_queries(spark, monkeypatch):
    """What a task holds doesn't grow with the queries; the rows are the same."""
    import numpy as np

    from sightline.operators import vectors as vc

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    rows = [("a", str(i), (r / np.linalg.norm(r)).tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "app string, id string, vector array<double>").coalesce(1)
    for most in (None, 5):
        whole, parts = (sorted(tuple(r) for r in vc.ranked(vc.dense_scores(df, df, most, held=held), 5).collect()) for held in (10**9, 50))
        assert whole == parts and len(whole) == 200


def test_a_reading_is_tried_once(monkeypatch):
    """steps of the ladder that change nothing parse nothing again."""
    from sightline.functions import jsonx as X

    tried, loads = [], X.json.loads
    monkeypatch.setattr(X.json, "loads", lambda s: tried.append(s) or loads(s))
    assert X.repair('```json\n[{“a“: “x“}, {“a“: “y“') == '[{"a": "x"}, {"a": "y"}]'
    assert len(tried) == len(set(tried)) <= 4


def test_cross_report_copies_no_reports_to_edges(spark):
    """pairs are made within a report; no row for each edge and report of its end is shuffled."""
    import random

    from sightline.operators import metrics as mt

    rng = random.Random(2)
    names = [f"{t[0]}{i}" for t in ("ISSUE", "ELEM", "PHEN") for i in range(12)]
    kind = {n: {"I": "ISSUE", "E": "ELEM", "P": "PHEN"}[n[0]] for n in names}
    held = sorted({(rng.choice(names[:-3]), str(rng.randrange(15))) for _ in range(120)})
    told = [(str(rng.randrange(15)), *sorted((rng.choice(names[:12]), rng.choice(names[12:24])))) for _ in range(90)]
    node_report = spark.createDataFrame([(n, r, kind[n]) for n, r in held], "node_id string, report_id string, type string")
    edges = spark.createDataFrame(told, "report_id string, a string, b string")
    of = {n: {r for m, r in held if m == n} for n in names}
    pairs = {(a, b) for _, a, b in told}
    both = [(a, b) for a, b in pairs if of[a] and of[b]]
    apart = sum(not of[a] & of[b] for a, b in both)
    far = sum(1 - len(of[a] & of[b]) / len(of[a] | of[b]) for a, b in both) / len(both)
    want = (len(pairs), len(both), round(apart / len(both), 6), round(far, 6), round(apart / len(pairs), 6))
    for df in (mt.cross_report(edges, node_report, (("ISSUE", "ELEM"),)), mt.cross_report(edges.select("a", "b").distinct(), node_report.drop("type"))):
        assert tuple(df.first()) == want
        assert not [x for x in exchanges(df) if "report_id" in x and ("node" in x or "other" in x)]


def test_grams_are_counted_where_a_text_lies(spark):
    """no row for each place of a text is shuffled; texts of one id count as one, in any script."""
    from collections import Counter

    import numpy as np

    from sightline.operators import vectors as vc

    texts = [("a", "1", "AbcabC"), ("a", "1", "abc"), ("a", "2", "äöü\U0001f600äöü"), (None, "3", "xyz"), ("b", "4", None), ("b", "5", "x"), ("b", "6", "")]
    df = spark.createDataFrame(texts, "app string, id string, text string")
    for low, high in ((3, 3), (2, 4)):
        want = Counter((a, i, t[k : k + n].lower()) for a, i, t in texts if t for n in range(low, high + 1) for k in range(len(t) - n + 1))
        counted = vc.gram_counts(df, low, high)
        assert {(r["app"], r["id"], r["term"]): r["tf"] for r in counted.collect()} == want
        assert not [x for x in exchanges(vc.pruned_terms(df, 1, 1.0, 9, low, high)) + exchanges(vc.tfidf_summary(df, low, high)) if "term" in x and "id#" in x]
    grams, times = vc.count_grams(["".join(map(chr, range(0x4E00, 0x4E00 + 9000))) + "一丁七"], 5)  # more characters than fit in one number
    assert len(grams) == 8999 and times.sum() == 8999 and grams.dtype == np.uint32
    # a summary is that of the long form
    w = vc.tfidf(df, 2, 3).groupBy("app", "id").agg({"*": "count", "weight": "max"}).collect()
    assert sorted((r[0], r[1], r["count(1)"], round(r["max(weight)"], 6)) for r in w) == sorted(tuple(r)[:4] for r in vc.tfidf_summary(df, 2, 3).collect())


def test_edges_of_a_list_are_shuffled_together(spark):
    """no shuffle by an edge's names."""
    assert not [x for x in exchanges(__spark_entry__.queries()["edge_scan"](spark, SF)) if "source" in x or "target" in x]


def test_a_view_is_one_row(spark):
    """F32: edges, repeated or not, are dealt by their view once, and no task is made for a view alone."""
    from sightline.operators import paths as pt

    rows = [(s, s, "ISSUE", "concerns", f"e{i % 3}", "ELEM") for s in ("p1", "p2") for i in range(6)] + [("p2", "e0", "ELEM", "located_in", "m", "MOD")]
    df = pt.view_paths(spark.createDataFrame(rows, "seed string, source string, source_type string, relation string, target string, target_type string"))
    assert len(exchanges(df)) == 1 and "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("p1", 0, "p1 -[concerns]-> {e0, e1, e2}"), ("p2", 0, "p2 -[concerns]-> {e1, e2}"), ("p2", 1, "p2 -[concerns]-> e0 -[located_in]-> m")]


def test_every_edge_of_a_view_is_in_a_path():
    """neither a start's paths, nor a view's, nor its lines are cut."""
    from sightline.operators import paths as pt

    wide = [("p", "concerns", f"e{i:03}") for i in range(200)]
    assert pt.grouped(pt.enumerate_paths(wide, {"p": "ISSUE"})) == ["p -[concerns]-> {" + ", ".join(b for _, _, b in wide) + "}"]
    apart = [(f"p{i:02}", "concerns", f"e{i:02}") for i in range(50)]
    assert len(pt.grouped(pt.enumerate_paths(apart, {a: "ISSUE" for a, *_ in apart}))) == 50
    deep = [(f"p{i}", "r", f"{'pq'[k]}{i + 1}") for i in range(6) for k in (0, 1)]
    nodes = {n for a, _, b in deep for n in (a, b)}
    want = {(a, "r", b) for a, _, b in deep}
    got = pt.enumerate_paths(deep, dict.fromkeys(nodes, "ISSUE"))
    assert {tuple(p[i : i + 3]) for p in got for i in range(0, len(p) - 2, 2)} == want and max(map(len, got)) == 9


def test_a_model_gets_what_it_reads(spark):
    """a text that the model doesn't look at is not sent to an app's task."""
    from sightline.operators import iterative as it

    class Short(it.ByLabel):
        reads = ("text", "label")

    df = spark.createDataFrame([("a", str(i), "t" * 100, f"L{i % 3}") for i in range(60)], "app string, id string, text string, label string")
    few, whole = it.cluster_apps(df), it.cluster_apps(df, Short)
    assert sorted(few.collect()) == sorted(whole.collect())
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan(few).split("LogicalRDD")[0] and "text#" in plan(whole).split("LogicalRDD")[0]


def test_rounds_see_few_links(spark, monkeypatch):
    """links between parts and brands are shuffled twice; only ties between the least names go through rounds."""
    from sightline.operators import components as cc

    seen, rounds = [], cc.components
    monkeypatch.setattr(cc, "components", lambda links, *rest: seen.append(links.count()) or rounds(links, *rest))
    links = fx.facts(spark, SF).select("issue", "elem").distinct().count()
    assert __spark_entry__.queries()["lcc"](spark, SF).first()["n_nodes"] == 450
    assert len(seen) == 1 and 8 * seen[0] < links


def test_two_sides_have_the_components_of_their_links(spark):
    """whichever side has the lesser names; repeated links, chains, a hub, an a without b and a null b."""
    import random

    from sightline.operators import components as cc

    rng = random.Random(3)
    wide = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] * 2
    chain = [(100 + i, 100 + j) for i in range(12) for j in (i, i + 1)]
    hub = [(200 + i, 200) for i in range(30)]
    for kinds in ("xy", "yx"):
        links = [(f"{kinds[0]}{a}", f"{kinds[1]}{b}") for a, b in wide + chain + hub] + [(f"{kinds[0]}{a}", None) for a in (0, 300, 300)]
        rng.shuffle(links)
        want = {n: n for pair in links for n in pair}
        for _ in want:
            for a, b in links:
                if b is not None:
                    want[a] = want[b] = min(want[a], want[b])
        df = spark.createDataFrame(links, "a string, b string")
        for by in ("a", "number"):
            got = [tuple(r) for r in cc.two_sided(df.withColumn("number", F.substring("a", 2, 9).cast("int")), by).collect()]
            assert len(got) == len(want) and dict(got) == want


def test_views_items_are_not_written_by_name(spark):
    """A view is one row of numbers; no table has a row for each view and item, and only rows of the chosen are named."""
    q = __spark_entry__.queries()
    for name in ("view_universe", "missed_nodes", "report_missed_nodes", "report_sel_nodes", "report_type_counts", "top_overlap_pairs", "cover_hybrid"):
        q[name](spark, SF).collect()
    assert not [name for _, sf, name in fx._BUILT if sf == SF and name in ("seeds_items", "cover_views", "seeds_view_items")]
    assert not exchanges(q["view_universe"](spark, SF))


def test_rows_of_views_count_as_their_reports_do(spark, monkeypatch):
    """Whether a report is told to all tasks, has too many nodes for that, or is shuffled; a seed without reports or number."""
    import random

    from sightline.operators import views as v

    rng = random.Random(5)
    held = {str(r): {f"n{rng.randrange(40)}" for _ in range(rng.randint(1, 9))} for r in range(30)}
    reports = {f"n{i}": set(rng.sample(sorted(held), rng.randint(1, 12))) for i in range(20)} | {"n77": set(), "x": set()}
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    kinds = frame([(f"n{i}", "A" if i % 3 else "B") for i in range(80)], ["node_id", "type"])
    numbers = v.node_numbers(kinds, F.col("type") == "A").cache()
    number = {r["node_id"]: (r["number"], r["first"]) for r in numbers.collect()}
    rows = [frame([(k, x) for k, own in d.items() for x in own], n) for d, n in ((reports, ["seed", "report_id"]), (held, ["report_id", "node_id"]))]
    seeds, edges = frame([(s,) for s in reports], ["seed"]), frame([(r,) for r in held for _ in range(int(r) % 4)], ["report_id"])
    for common, nodes in ((1, 0), (10, 100), (100, 5)):
        monkeypatch.setattr(v, "COMMON", common)
        monkeypatch.setattr(v, "COMMON_NODES", nodes)
        got = {r["seed"]: r for r in v.numbered_views(seeds, rows[0], rows[1].select("node_id", "report_id"), numbers, edges).collect()}
        assert got.keys() == reports.keys()
        for seed, own in reports.items():
            nodes_of, n_edges = {seed}.union(*(held[r] for r in own)), sum(int(r) % 4 for r in own)
            r = got[seed]
            assert (r["n_reports"], r["n_nodes"], r["n_edges"]) == (len(own), len(nodes_of), n_edges) and r["cost"] == round(len(own) + 0.02 * len(nodes_of) + 0.01 * n_edges, 6)
            assert sorted(r["items"]) == sorted(number[n][0] for n in nodes_of if n in number and number[n][1]) and len(set(r["reports"])) == len(own) == len(r["reports"])


def test_missed_items_are_those_of_named_rows(spark, monkeypatch):
    """counted in parts, and trimmed between, as from a row for each view and item; costs tie."""
    import random

    from sightline.operators import views as v

    monkeypatch.setattr(v, "PAIRS", 4)
    rng = random.Random(7)
    views = [(f"s{i}", float(rng.randrange(4)), sorted(rng.sample(range(60), rng.randint(0, 25)))) for i in range(80)]
    df = spark.createDataFrame(views, "seed string, cost double, items array<int>")
    numbers = spark.createDataFrame([(f"n{i:02}", i) for i in range(70)], "node_id string, number int")
    named = v.named_items(df, numbers).cache()
    assert sorted(named.collect()) == sorted((s, f"n{i:02}") for s, _, items in views for i in items)
    monkeypatch.setattr(v, "NAMES_SENT", 1)
    assert sorted(v.named_items(df, numbers).collect()) == sorted(named.collect())
    for few in (["s1", "s2"], []):
        chosen = spark.createDataFrame([(s,) for s in few], "seed string")
        want = v.missed(named, df, chosen)
        assert sorted(v.missed_items(df, chosen, numbers).select(*want.columns).collect()) == sorted(want.collect()) != []


def test_a_merge_looks_at_few_rows():
    """clusters as by the least of the whole matrix at each merge, ties included, without reading it each time."""
    import time

    import numpy as np

    from sightline.operators import vectors as vc

    def plain(x, k, threshold, linkage):
        n, d = len(x), 1 - x @ x.T
        np.fill_diagonal(d, np.inf)
        size, label, left = np.ones(n), np.arange(n), n
        while left > 1 and (k is None or left > k):
            i, j = sorted(divmod(int(np.argmin(d)), n))
            if threshold is not None and d[i, j] > threshold:
                break
            new = np.maximum(d[i], d[j]) if linkage == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i], d[:, i] = new, new
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            label[label == j] = i
            left -= 1
        return label

    rng = np.random.default_rng(1)
    for case in range(40):
        x = rng.integers(-2, 3, (60, 3)).astype(float) if case % 2 else rng.normal(size=(60, 5))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        for how in ((None, None, "average"), (7, None, "average"), (None, 0.3, "complete"), (1, None, "complete")):
            assert (vc.agglomerate(x.copy(), *how) == plain(x, *how)).all()
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    begin = time.process_time()
    vc.agglomerate(x, 20)
    new = time.process_time() - begin
    plain(x, 20, None, "average")
    assert 2 * new < time.process_time() - begin - new


def test_balls_lie_in_parts(spark, monkeypatch):
    """as by joins, whether a part is held by a task or too large for one; repeated links, a start alone, one without reports."""
    import random

    from sightline.operators import components as cc
    from sightline.operators import expand as ex

    rng = random.Random(11)
    links = [(f"p{k}", f"b{rng.randrange(9) + 10 * (k % 3)}") for k in range(30) for _ in range(3)]
    links += links[:20]
    df = spark.createDataFrame(links, "a string, b string")
    starts = spark.createDataFrame([(f"p{k}",) for k in (*range(0, 30, 2), 77, 78)], "seed string")
    reports = spark.createDataFrame([(f"p{k}", str(rng.randrange(12))) for k in (*range(20), 77) for _ in range(4)] + [("b1", "99")], "node_id string, report_id string").distinct()
    universe = spark.createDataFrame([(f"p{k}",) for k in range(80)], "node_id string")
    parts, one = cc.two_sided(df).cache(), df.distinct()
    for held in (1_000_000, 0):
        monkeypatch.setattr(ex, "LINKS_HELD", held)
        for radius in (1, 2, 3):
            near = ex.ball(starts, one, radius).cache()
            assert sorted(ex.ball_in_parts(starts, df, radius, parts).collect()) == sorted(near.collect())
            want = near.join(universe, "node_id").join(reports, "node_id").groupBy("seed").agg(F.countDistinct("report_id"))
            assert sorted(ex.neighbourhood_reports(starts, df, reports, universe, radius, parts).collect()) == sorted(want.collect())
    monkeypatch.undo()
    q = __spark_entry__.queries()["bfs_ball"](spark, SF)
    assert not [x for x in exchanges(q) if "seed" in x]
