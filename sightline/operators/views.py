"""Views induced from expanded reports: items, costs, similarities, diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.components import cut


def view_costs(reports: DataFrame, nodes: DataFrame, edge_report: DataFrame, alpha: float = 1.0, beta: float = 0.02, gamma: float = 0.01) -> DataFrame:
    """seed, n_reports, n_nodes, n_edges, cost. Edges count as a bag: every row that a report gives."""
    r = reports.groupBy("seed").agg(F.count("*").alias("n_reports"))
    v = nodes.groupBy("seed").agg(F.count("*").alias("n_nodes"))
    per_report = edge_report.groupBy("report_id").agg(F.count("*").alias("n"))
    e = reports.join(per_report, "report_id").groupBy("seed").agg(F.sum("n").alias("n_edges"))
    out = v.join(r, "seed", "left").join(e, "seed", "left").na.fill(0, ["n_reports", "n_edges"])
    cost = F.lit(alpha) * F.col("n_reports") + F.lit(beta) * F.col("n_nodes") + F.lit(gamma) * F.col("n_edges")
    return out.select("seed", "n_reports", "n_nodes", "n_edges", F.round(cost, 6).alias("cost"))


def node_numbers(nodes: DataFrame, first: Column | None = None) -> DataFrame:
    """node_id, number: whole numbers for distinct nodes, small enough for arrays of them to be gathered. Nodes with a row
    for which first holds come before the others."""
    from sightline.operators.ranking import global_rank

    if first is None:
        own, order = nodes.select("node_id").distinct(), ["node_id"]
    else:
        own, order = nodes.groupBy("node_id").agg(F.min(F.when(first, 0).otherwise(1)).alias("later")), ["later", "node_id"]
    named = ["node_id", F.col("number").cast("int").alias("number")]
    return global_rank(own, order, "number").select(*named, *([] if first is None else [(F.col("later") == 0).alias("first")]))


#: Reports whose nodes every task is told, and nodes that such a report has at most. They are the first in id order: these
#: survive a truncation, so that most views have many of them.
COMMON, COMMON_NODES = 434, 1000
#: Bits of a word.
WORD = 62


def numbered_views(
    seeds: DataFrame, reports: DataFrame, node_report: DataFrame, numbers: DataFrame, edge_report: DataFrame, alpha: float = 1.0, beta: float = 0.02, gamma: float = 0.01
) -> DataFrame:
    """seed, n_reports, n_nodes, n_edges, cost (as view_costs() has them), items, reports: each view as one row, with the numbers of its
    nodes that come first among numbers (node_id, number, first) and of its reports; every seed is a node of its view.

    Of the reports that most views share (COMMON) a view is told bits; only its other reports' nodes are shuffled, once."""
    from sightline.functions.ids import order_columns
    from sightline.operators.ranking import global_rank

    none = F.array().cast("array<int>")
    kinds = {"items": F.col("first"), "others": ~F.col("first")}
    per_report = edge_report.groupBy("report_id").agg(F.count("*").alias("k"))
    own = node_report.join(numbers, "node_id").groupBy("report_id").agg(*(F.collect_set(F.when(which, F.col("number"))).alias(c) for c, which in kinds.items()))
    own = own.join(per_report, "report_id", "full").select("report_id", F.coalesce("k", F.lit(0)).alias("k"), *(F.coalesce(c, none).alias(c) for c in kinds))
    own = cut(global_rank(own, order_columns(F.col("report_id")), "number").withColumn("number", F.col("number").cast("int")), "report_numbers")
    common = own.where((F.col("number") < COMMON) & (F.size("items") + F.size("others") <= COMMON_NODES)).withColumnRenamed("number", "place")
    words = range(-(-COMMON // WORD))

    def word(i: int) -> Column:
        at = F.col("place") - i * WORD
        return F.bit_or(F.when(at.between(0, WORD - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), at)).otherwise(0)).alias(f"w{i}")

    rows = reports.select("seed", "report_id").join(F.broadcast(common.select("report_id", "place", "k")), "report_id", "left")
    near = rows.where("place IS NOT NULL").groupBy("seed").agg(F.count("*").alias("n"), F.sum("k").alias("k"), *map(word, words))  # where its rows lie, nearly
    far = rows.where("place IS NULL").select("seed", "report_id").join(own, "report_id", "left").select("seed", F.lit(1).alias("n"), "k", F.col("number").alias("report"), *kinds)
    of_seed = seeds.select("seed").distinct().join(numbers.withColumnRenamed("node_id", "seed"), "seed", "left")
    of_seed = of_seed.select(
        "seed", F.lit(0).alias("n"), F.lit(0).alias("k"), F.col("number").isNull().cast("int").alias("unnumbered"),
        *(F.when(which, F.array("number")).otherwise(none).alias(c) for c, which in kinds.items()),
    )
    every = far.unionByName(near, True).unionByName(of_seed, True).repartition("seed").groupBy("seed").agg(
        F.sum("n").alias("n_reports"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_edges"), F.max("unnumbered").alias("unnumbered"), F.collect_list("report").alias("reports"),
        *(F.flatten(F.collect_list(c)).alias(c) for c in kinds), *(F.coalesce(F.bit_or(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in words),
    )
    few = F.size("items") + F.size("others") <= COMMON_NODES
    told = own.where(F.col("number") < COMMON).agg(F.array_sort(F.collect_list(F.struct("number", *(F.when(few, F.col(c)).otherwise(none).alias(c) for c in kinds)))).alias("told"))

    def places(i: int) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(F.col(f"w{i}"), b) == 1)
        return F.transform(bits, lambda b: b + i * WORD)

    every = every.withColumn("places", F.concat(*map(places, words))).join(F.broadcast(told)).withColumn("common", F.transform("places", lambda p: F.get("told", p)))
    out = every.select(
        "seed", "n_reports", "n_edges", "unnumbered", F.concat("reports", "places").alias("reports"),
        *(F.array_distinct(F.concat(c, F.flatten(F.col(f"common.{c}")))).alias(c) for c in kinds),
    )
    out = out.withColumn("n_nodes", (F.size("items") + F.size("others") + F.coalesce("unnumbered", F.lit(0))).cast("bigint"))
    cost = F.lit(alpha) * F.col("n_reports") + F.lit(beta) * F.col("n_nodes") + F.lit(gamma) * F.col("n_edges")
    return out.select("seed", "n_reports", "n_nodes", "n_edges", F.round(cost, 6).alias("cost"), "items", "reports")


#: Names that are sent to every task; with more of them they are joined by a shuffle.
NAMES_SENT = 4_000_000


def named_items(views: DataFrame, numbers: DataFrame) -> DataFrame:
    """seed, node_id of views (seed, items) with names of numbers (node_id, number), whose numbers are 0 and on. Names are told to every
    task, so that the rows, many times as many as the views, are not shuffled."""
    n = numbers.count()
    if n > NAMES_SENT:
        return views.select("seed", F.explode("items").alias("number")).join(numbers, "number").select("seed", "node_id")
    names = numbers.orderBy("number").select("node_id").toArrow().column("node_id").cast(pa.string())
    sent = views.sparkSession.sparkContext.broadcast(pa.concat_arrays([pa.array([], pa.string()), *names.chunks]))

    def run(batches):
        for batch in batches:
            seeds, items = batch.column("seed"), batch.column("items")
            for begin in range(0, batch.num_rows, 64):
                own = items.slice(begin, 64)
                place = np.repeat(np.arange(begin, begin + len(own)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([seeds.take(pa.array(place)), sent.value.take(own.flatten())], ["seed", "node_id"])

    return views.select("seed", "items").mapInArrow(run, "seed string, node_id string")


#: Pairs of an item and a view that a task holds, about; parts into which items are dealt; ranks of views that are broadcast at most.
PAIRS, DEALT, RANKS_SENT = 1 << 18, 256, 1_500_000


def missed_items(views: DataFrame, chosen: DataFrame, numbers: DataFrame, most: int = 5) -> DataFrame:
    """missed() of views as rows (seed, cost, items) and numbers (node_id, number), whose numbers are below 2^31.

    An item and a view's place by cost go as one number, in arrays by part of the items, and are counted there."""
    from sightline.operators.ranking import global_rank

    own = views.join(F.broadcast(chosen.select("seed")), "seed", "left_semi").select(F.explode("items").alias("item")).distinct().toPandas()["item"]  # a choice is a short list
    hit = views.sparkSession.sparkContext.broadcast(np.sort(own.to_numpy(np.int64)))
    placed = cut(global_rank(views.select("seed", "cost"), ["cost", "seed"], "place"), "placed")
    ranks = placed.select("seed", "place")
    rows = views.select("seed", "items").join(F.broadcast(ranks) if ranks.count() <= RANKS_SENT else ranks, "seed").select("place", "items")

    def tell(batches):
        held, size = [], 0

        def flush():
            pairs = np.concatenate(held)
            part = (pairs >> 32) % DEALT
            pairs = pairs[np.argsort(part, kind="stable")]
            many = np.bincount(part, minlength=DEALT)
            some = np.flatnonzero(many)
            ends = np.concatenate([[0], np.cumsum(many[some])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs))], ["part", "pairs"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                items, place = batch.column("items").slice(begin, 64), batch.column("place").slice(begin, 64).to_numpy()
                flat = items.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = flat << 32 | np.repeat(place, items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(hit.value, flat), max(len(hit.value) - 1, 0))
                held.append(pairs[hit.value[at] != flat] if len(hit.value) else pairs)
                size += len(held[-1])
                if size >= PAIRS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def gather(batches):
        fresh, size = [], 0
        few = items = counts = np.empty(0, np.int64)  # the first pairs of each item; the items, and how often each is there

        def settle():
            nonlocal few, items, counts
            new = np.concatenate([np.empty(0, np.int64), *fresh])
            fresh.clear()
            seen, n = np.unique(np.concatenate([items, new >> 32]), return_counts=True)
            total = n.astype(np.int64)
            total[np.searchsorted(seen, items)] += counts - 1
            items, counts = seen, total
            pairs = np.sort(np.concatenate([few, new]))
            own = np.searchsorted(items, pairs >> 32)
            first = np.searchsorted(own, own)
            few = pairs[np.arange(len(pairs)) - first < most]

        for batch in batches:
            fresh.append(batch.column("pairs").flatten().to_numpy(zero_copy_only=False))
            size += len(fresh[-1])
            if size >= 16 * PAIRS:
                settle()
                size = 0
        settle()
        ends = np.searchsorted(few >> 32, items, "right").astype(np.int64)
        for begin in range(0, len(items), 50_000):
            own = slice(begin, begin + 50_000)
            start = ends[begin - 1] if begin else 0
            offsets = np.concatenate([[0], ends[own] - start]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(few[start : ends[own][-1]] & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(items[own].astype(np.int32)), pa.array(counts[own]), places], ["number", "n_candidates", "places"])

    told = rows.mapInArrow(tell, "part int, pairs array<long>").repartition("part")
    found = cut(told.mapInArrow(gather, "number int, n_candidates long, places array<long>"), "missed")
    tops = found.select("number", F.explode("places").alias("place")).join(placed, "place").groupBy("number").agg(
        F.min_by("seed", "place").alias("cheapest"), F.min("cost").alias("cheapest_cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "seed"))), lambda x: x["seed"]), "|").alias("top_views"),
    )
    return found.select("number", "n_candidates").join(tops, "number").join(numbers, "number").select("node_id", "n_candidates", "cheapest", "cheapest_cost", "top_views")


def covered(nodes: DataFrame, types: DataFrame, universe: tuple[str, ...]) -> DataFrame:
    """seed, node_id of the universe's types."""
    return nodes.join(types.where(F.col("type").isin(*universe)).select("node_id"), "node_id", "left_semi").select("seed", "node_id")


def sharing_pairs(items: DataFrame, key: str = "node_id", view: str = "seed", most: int | None = None) -> DataFrame:
    """a < b, shared: views with an item in common. Items of more than `most` views are left to the caller:
    their pairs grow with the square of that number."""
    own = items.select(F.col(view).alias("v"), F.col(key).alias("k")).distinct()
    if most is not None:
        own = own.join(own.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("k"), "k", "left_semi")
    pairs = own.withColumnRenamed("v", "a").join(own.withColumnRenamed("v", "b"), "k").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


#: Views of a block, and items of the columns that a task holds as a matrix.
BLOCK, WIDE = 1024, 16384


def block_pairs(views: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """a < b, shared, n_a, n_b of all views (seed, items: an array of whole numbers, none twice) with an item in common.

    Views are dealt to blocks of about `block`; a task multiplies the rows of bits of two blocks, `wide` items at a time, so it
    holds no more however many views share an item, and no pair is made for each item that it shares. There are as many
    pairs as there are: their number may grow with the square of the views."""
    blocks = -(-max(1, views.count()) // block)
    dealt = views.select(F.pmod(F.xxhash64("seed"), F.lit(blocks)).alias("block"), "seed", "items").repartition(blocks, "block")
    one = cut(dealt.groupBy("block").agg(F.collect_list(F.struct("seed", "items")).alias("views")), "blocks").repartition(blocks, "block")
    both = one.select(F.col("block").alias("i"), F.col("views").alias("x")).crossJoin(one.select(F.col("block").alias("j"), F.col("views").alias("y"))).where("i <= j")

    def rows(lists: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """seeds, sizes, and (view's place, item) of every item, by item."""
        seeds, items = lists.values.field("seed"), lists.values.field("items")
        sizes = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, place = items.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(flat, kind="stable")
        return seeds.to_numpy(zero_copy_only=False), sizes, place[order], flat[order]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (seeds_x, n_x, place_x, item_x), (seeds_y, n_y, place_y, item_y) = (rows(batch.column(c)[k]) for c in ("x", "y"))
                common = np.intersect1d(item_x, item_y)
                shared = np.zeros((len(seeds_x), len(seeds_y)), np.float32)  # whole numbers, exact up to 2^24
                for begin in range(0, len(common), wide):
                    part, bits = common[begin : begin + wide], []
                    for seeds, place, item in ((seeds_x, place_x, item_x), (seeds_y, place_y, item_y)):
                        from_, upto = np.searchsorted(item, [part[0], part[-1] + 1])
                        at = np.searchsorted(part, item[from_:upto])
                        hit = part[at] == item[from_:upto]
                        m = np.zeros((len(seeds), len(part)), np.float32)
                        m[place[from_:upto][hit], at[hit]] = 1
                        bits.append(m)
                    shared += bits[0] @ bits[1].T
                same = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                for begin in range(0, len(seeds_x), 64):
                    row, col = np.nonzero(shared[begin : begin + 64])
                    n, row = shared[begin + row, col], row + begin
                    a, b, n_a, n_b = seeds_x[row], seeds_y[col], n_x[row], n_y[col]
                    swap = a > b
                    kept = ~swap & (a != b) if same else np.ones(len(a), bool)
                    a, b, n_a, n_b = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)
                    found = {"a": pa.array(a[kept], pa.string()), "b": pa.array(b[kept], pa.string())} | {c: pa.array(v[kept].astype(np.int64)) for c, v in (("shared", n), ("n_a", n_a), ("n_b", n_b))}
                    yield pa.RecordBatch.from_pydict(found)

    return both.mapInArrow(run, "a string, b string, shared long, n_a long, n_b long")


def jaccard_pairs(items: DataFrame, key: str = "node_id", view: str = "seed") -> DataFrame:
    """a < b, shared, jaccard of views with an item in common."""
    n = items.groupBy(view).agg(F.countDistinct(key).alias("n"))
    out = sharing_pairs(items, key, view).join(n.select(F.col(view).alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col(view).alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "shared", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6).alias("jaccard"))


def overlap_stats(items: DataFrame, key: str = "node_id", view: str = "seed") -> DataFrame:
    """Mean, largest and non-zero mean Jaccard over all pairs of views, the share that overlap,
    and how many others a view overlaps with. Pairs without a common item are counted, not made."""
    n = items.select(view).distinct().agg(F.count("*").alias("n_views"))
    j = jaccard_pairs(items, key, view).agg(F.sum("jaccard").alias("total"), F.max("jaccard").alias("top"), F.count("*").alias("n_pos"))
    pairs = F.greatest(F.col("n_views") * (F.col("n_views") - 1) / 2, F.lit(1.0))
    return n.join(F.broadcast(j)).select(
        "n_views", F.col("n_pos").alias("n_overlapping"), F.round(F.coalesce("total", F.lit(0.0)) / pairs, 6).alias("jaccard_avg"), F.round(F.coalesce("top", F.lit(0.0)), 6).alias("jaccard_max"),
        F.round(F.coalesce("total", F.lit(0.0)) / F.greatest("n_pos", F.lit(1)), 6).alias("jaccard_avg_nonzero"), F.round(F.col("n_pos") / pairs, 6).alias("frac_overlapping"),
        F.round(F.col("n_pos") / pairs * (F.col("n_views") - 1), 6).alias("overlap_degree"),
    )


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """The value at place floor(n * share) of the sorted ones, not interpolated."""
    counts = df.groupBy(value).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = counts.agg(F.sum("rows").alias("total"))
    at = counts.withColumn("upto", upto).join(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") * share))
    return at.agg(F.min(value).alias("value"))


def missed(candidate_items: DataFrame, costs: DataFrame, chosen: DataFrame, most: int = 5) -> DataFrame:
    """Nodes in some candidate but in none chosen: how many candidates, the cheapest, the first few by cost."""
    hit = candidate_items.join(chosen, "seed", "left_semi").select("node_id").distinct()
    rows = candidate_items.join(hit, "node_id", "left_anti").join(costs.select("seed", "cost"), "seed")
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("cost", "seed"))
    few = rows.withColumn("place", place).where(F.col("place") <= most)
    firsts = few.groupBy("node_id").agg(
        F.min_by("seed", "place").alias("cheapest"), F.min("cost").alias("cheapest_cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "seed"))), lambda x: x["seed"]), "|").alias("top_views"),
    )
    return rows.groupBy("node_id").agg(F.count("*").alias("n_candidates")).join(firsts, "node_id")


def reachability(universe: DataFrame, candidate_items: DataFrame, covered_items: DataFrame) -> DataFrame:
    """node_id, state: covered, missed (in a candidate only) or unreachable."""
    c = candidate_items.select("node_id").distinct().withColumn("c", F.lit(1))
    s = covered_items.select("node_id").distinct().withColumn("s", F.lit(1))
    state: Column = F.when(F.col("s") == 1, "covered").when(F.col("c") == 1, "missed").otherwise("unreachable")
    return universe.join(c, "node_id", "left").join(s, "node_id", "left").select("node_id", state.alias("state"))
